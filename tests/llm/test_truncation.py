import random

import pytest

from bargspark.llm import truncation as T

VOCAB = "کتاب خانه درخت رودخانه پرنده آسمان کوه دریا باران نامه چراغ دیوار پنجره ستاره بزرگ کوچک روشن زیبا".split()


@pytest.mark.parametrize(
    "text,kind",
    [("جمله.", "whole"), ("گفت: «نه».", "whole"), ("جمله", "open"), ("جمله …", "open"), ("| a | b |", "whole"), ("| a | b", "cut"), ("```verse\nx --- y", "cut"), ("```verse\nx\n```", "whole"), ("# سر", "cut"), ("۱. یک؛", "whole"), ("۱. یک", "cut"), ("کتا-", "broken"), ("", "whole"), ("رفت.[^1]", "whole"), ("رفت[^1]", "open"), ("«vol»", "open")],
)
def test_ending(text, kind):
    assert T.ending(text.split("\n"))[0] == kind


def test_alignment():
    a = list(range(60))
    assert T.aligned_early(a[:55], "x", a, "y")
    assert not T.aligned_early(a, "x", a, "x")
    assert T.aligned_early([*a[:-1], 999], "کتا", a, "کتاب")
    assert not T.aligned_early([*a[:-1], 999], "کتات", a, "کتاب")
    assert not T.aligned_early(list(range(100, 150)), "x", a, "y")
    assert not T.aligned_early([1], "x", a, "y")


def test_min_hash_finds_near_copies():
    import numpy as np

    rng = random.Random(7)
    hits = 0
    for _ in range(60):
        a = np.array([rng.randint(-(2**31), 2**31 - 1) for _ in range(120)], np.int32)
        x, y = T.min_hash_bands([a, a[:98]])  # similarity 0.81
        hits += bool(set(x) & set(y))
    assert hits >= 59
    assert T.min_hash_bands([np.zeros(3, np.int32)]) == [[]]


def test_truncated(spark):
    rng = random.Random(9)
    sentence = lambda n=9: " ".join(rng.choice(VOCAB) for _ in range(n)) + "."
    rows, flags = [], []
    for i in range(600):
        origin = "abc"[i % 3]
        text = " ".join(sentence() for _ in range(rng.randint(6, 60)))
        if origin == "a" and len(text) > 900:
            text = text[:900]
        rows.append((i, f"b{i // 60}", i % 60, origin, text))
        flags.append((i, False, False))
    want = {i for i, _, _, o, t in rows if o == "a" and len(t) == 900}

    def put(i, text, starts=False, goes_on=False):
        rows[i] = (i, *rows[i][1:3], "b", text)
        flags[i] = (i, starts, goes_on)
        want.discard(i)

    whole = " ".join(sentence() for _ in range(12))
    put(10, "درخت بزرگ. " + "کوه رودخ"), want.add(10)  # inside a word
    put(20, "درخت بزرگ. " + "کوه زیبا"), want.add(20)  # inside a sentence, next page starts anew
    put(31, "درخت بزرگ. " + "کوه زیبا", goes_on=True)
    put(32, "روشن. " + sentence(), starts=True)
    put(40, whole[: whole.index(".", len(whole) * 9 // 10) + 1]), want.add(40)  # ends like a sentence, but its copy goes on
    put(50, whole)
    put(55, "# درخت"), want.add(55)
    put(56, None), put(57, ""), put(58, "  \n")
    pages = spark.createDataFrame([(*r, "x") for r in [*rows, rows[10]]], "rec_id bigint, book string, page int, origin string, text_md string, word string")
    fields = spark.createDataFrame(flags, "rec_id bigint, starts_mid_paragraph boolean, continues_next boolean")
    none = spark.createDataFrame([], "rec_id bigint, line_no int")
    got = T.truncated(pages, fields, none).collect()
    assert len(got) == len({r.rec_id for r in got}) and {r.rec_id for r in got} == want
    assert {r.why for r in got if r.rec_id == 40} == {"copy"}
    s = {r.origin: r for r in T.shares(pages, T.truncated(pages, fields, none)).collect()}
    assert sum(r.truncated for r in s.values()) == len(want) and sum(r.records for r in s.values()) == 600
    assert T.truncated(pages.limit(0), fields.limit(0), none).count() == 0


def copies(spark, texts):
    """The records that cut_copies finds, of texts as words; all are attempts at one page and share the bands of their hashes."""
    import numpy as np

    hashes = [np.array([T.WORDS[w] for w in t], np.int32) for t in texts]
    rows = [(i, "b", 1, t[-1], len(t), h.tolist(), b) for i, (t, h, b) in enumerate(zip(texts, hashes, T.min_hash_bands(hashes)))]
    ends = spark.createDataFrame(rows, "rec_id bigint, book string, page int, last string, n_words int, words array<int>, bands array<bigint>")
    brute = {i for i, a in enumerate(texts) for j, b in enumerate(texts) if i != j and T.aligned_early(hashes[i].tolist(), a[-1], hashes[j].tolist(), b[-1])}
    return {r.rec_id for r in T.cut_copies(ends).collect()}, brute


def test_copies_that_the_longest_does_not_settle(spark):
    rng = random.Random(3)
    whole = [f"{rng.choice(VOCAB)}{i}" for i in range(60)]
    longest = [*whole[:53], "misread", *whole[54:], "more"]  # misread just before the place where the copy below ends
    got, brute = copies(spark, [whole, whole[:55], longest])
    assert 1 in brute and got == brute
    # of equal counts of words the greatest rec_id is cut inside its last word
    got, brute = copies(spark, [whole, whole, [*whole[:-1], whole[-1][:2]]])
    assert brute == {2} and got == brute


def test_noisy_copies_against_all_pairs(spark):
    rng = random.Random(11)
    whole = [f"{rng.choice(VOCAB)}{i % 40}" for i in range(90)]
    texts = []
    for i in range(30):
        t = [w if rng.random() > 0.06 else f"{w}{rng.randint(0, 9)}" for w in whole[: rng.choice([90, 90, 88, 84, 76])]]
        if rng.random() < 0.3:
            del t[rng.randrange(len(t) - 1)]
        texts.append([*t[:-1], t[-1][:2]] if rng.random() < 0.3 else t)
    got, brute = copies(spark, texts)
    assert got == brute and 5 < len(brute) < 30
