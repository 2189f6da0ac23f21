import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bargspark.llm import encode as E
from bargspark.llm import split as S

ENC = E.Encoder(E.vocab_path())
ODD = ["", " ", "\n\n", "a", "        ", "x   y", "foo \n bar", "a \n b  c", "سلام  دنیا\n\n‌می‌روم ٠ ٠", "<|endoftext|>", "'s ('s it's don't", "\r\n\r\n# فصل ۱", "x" * 3000, "کتاب" * 900, "🙂 🙂", "\x1c \x85 z"]


def reference(text):
    return ENC.bpe.encode_ordinary(text)


def test_odd_texts_as_the_library_encodes_them():
    for t in ODD:
        assert np.frombuffer(ENC.ids(t), np.int32).tolist() == reference(t), t


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t\r  ٠'sالبت‌aéZ09.#|🙂ß")), max_size=60))
def test_random_texts(t):
    assert np.frombuffer(ENC.ids(t), np.int32).tolist() == reference(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("'sالبتیمدکسa‌éZ09.#|🙂ßчш的")), min_size=1, max_size=40), min_size=8, max_size=40), st.sampled_from(["", "", " ", "\n", "\xa0"]))
def test_long_texts_with_little_white_space(parts, between):
    t = between.join(parts)
    assert np.frombuffer(ENC.ids(t), np.int32).tolist() == reference(t)


def test_words_of_a_language_without_white_space():
    rng = random.Random(8)
    letters = "ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی"
    for n in (255, 256, 257, 300, 1000, 5000):
        for _ in range(20):
            t = "".join(rng.choice(letters + "aeiou'" if rng.random() < 0.3 else letters) for _ in range(n))
            assert np.frombuffer(ENC.ids(t), np.int32).tolist() == reference(t), t


def test_table(spark):
    rows = [(1, "a b", 7), (2, None, 7), (3, "", 8), (4, "سلام دنیا", 8), (4, "سلام دنیا", 8)]
    got = {r.doc_id: list(r.ids) for r in E.encode(spark.createDataFrame(rows, "doc_id bigint, text string, ids int")).collect()}
    assert got == {1: reference("a b"), 2: [], 3: [], 4: reference("سلام دنیا")}
    assert E.encode(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def greedy(text, limit, overlap):
    """Step by step, without tables: the same rule for each next cut."""
    fragments = ENC.fragments(text)
    ends = np.cumsum([len(ENC.memo[f]) // 4 for f in fragments]).tolist()
    kinds = dict(zip(ends, S.boundary_kinds(fragments).tolist()))
    total, at, out = ends[-1], 0, []
    while at < total:
        start = max(at - overlap, 0)
        high = start + limit
        if high >= total:
            nxt = total
        else:
            inside = [e for e in kinds if max(start + limit // 2, at) < e <= high and e < total]
            best = max((kinds[e] for e in inside), default=None)
            nxt = max([e for e in inside if kinds[e] >= best] if inside else [e for e in kinds if at < e <= high and e < total])
        out.append((start, nxt))
        at = nxt
    return out


def test_doubling_equals_greedy():
    rng = random.Random(5)
    for _ in range(30):
        text = "".join(rng.choice(["word", "دنیا", "خانه‌ها", "x."]) + rng.choice([" ", " ", " ", "\n", ". ", "\n\n", "\n\n# فصل ۲ "]) for _ in range(rng.randint(60, 900)))
        limit, overlap = rng.choice([(64, 8), (100, 0), (48, 16)])
        got = S.cut(ENC, text, limit, overlap)
        assert [(a, b) for a, b, *_ in got] == (greedy(text, limit, overlap) if len(reference(text)) > limit else [])


def test_text_without_boundaries_keeps_whole_characters():
    text = "بپتثجچ" * 500
    got = S.cut(ENC, text, 200, 20)
    raw = text.encode()
    assert got[0][2] == 0 and got[-1][3] == len(raw)
    for a, b, i, j, _ in got:
        assert b - a <= 200
        raw[i:j].decode()
    assert all(y[0] == x[1] - 20 for x, y in zip(got, got[1:]))


def test_limits_too_small_for_a_character():
    with pytest.raises(ValueError):
        S.cut(ENC, "🜁🜂🜃🜄" * 20, 4, 3)
    for a, b, *_ in S.cut(ENC, "🜁🜂🜃🜄" * 200, 32, 4):
        assert b - a <= 32


def test_pieces(spark):
    long = "\n\n".join(["این یک جمله است. " * 30] * 60)
    df = spark.createDataFrame([(1, long, 1), (2, None, 1), (3, "", 1), (4, "short", 1), (5, " " * 9000, 1)], "doc_id bigint, text string, piece int")
    got = S.pieces(df).orderBy("doc_id", "piece").collect()
    mine = [r for r in got if r.doc_id == 1]
    ids = reference(long)
    assert {r.doc_id for r in got} <= {1, 5} and len(mine) > 2
    assert mine[-1].tok_end == len(ids) and all(r.n_tokens <= 2048 for r in got)
    assert all(b.tok_start == a.tok_end - 128 for a, b in zip(mine, mine[1:]))
    assert {r.ends_at for r in mine[:-1]} == {"paragraph"} and mine[-1].ends_at == "end"
    assert S.pieces(df.limit(0)).count() == 0
