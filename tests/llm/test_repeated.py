import random
import re
from collections import defaultdict

import numpy as np

from bargspark.llm import repeated as R
from bargspark.llm.visual import canonical

WORDS = "کتاب خانه درخت رودخانه پرنده آسمان کوه دریا باران نامه چراغ دیوار پنجره ماه ستاره".split()


def brute(rows, books=3, letters=25):
    seen, where = defaultdict(set), defaultdict(set)
    for rec, origin, book, text in rows:
        if text and origin is not None and book is not None:
            for no, line in enumerate(text.split("\n"), 1):
                key = re.sub(r"\d+", "0", canonical(line).strip())
                if sum(c.isalpha() for c in key) >= letters:
                    seen[origin, key].add(book), where[origin, key].add((rec, no))
    return {x for k, v in seen.items() if len(v) >= books for x in where[k]}


def test_against_brute_force(spark):
    rng = random.Random(3)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    common = {o: [line(8) + " 12", line(30), line(5), "short"] for o in "ab"}
    rows = []
    for rec in range(400):
        origin, book = rng.choice("aab"), f"b{rng.randint(0, 30)}"
        text = [line(rng.randint(3, 40)) for _ in range(4)]
        if rng.random() < 0.3:
            text.insert(rng.randint(0, 4), rng.choice(common[origin]).replace("12", str(rng.randint(1, 99))).replace("ی", rng.choice("یي")))
        rows.append((rec, origin, book, "\n".join(text)))
    rows += [(500, None, "b1", common["a"][1]), (501, "a", None, common["a"][1]), (502, "a", "b1", None), (503, "a", "b1", ""), (504, "a", "b1", common["a"][1] + "\r\n" + common["a"][1]), rows[0], (505, "a", "b2", "x" * 60_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "rec_id bigint, origin string, book string, text_md string, key int")
    got = [tuple(r) for r in R.repeated(df).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert R.repeated(df.limit(0)).count() == 0


def test_without(spark):
    pages = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (2, None), (3, "")], "rec_id bigint, text_md string")
    found = spark.createDataFrame([(1, 2)], "rec_id bigint, line_no int")
    got = {r.rec_id: (r.text_md, r.n_cut) for r in R.without(pages, found).collect()}
    assert got == {1: ("a\nc", 1), 2: (None, 0), 3: ("", 0)}


def test_equal_lines_have_equal_chunks():
    rng = random.Random(1)
    lines = [" ".join(rng.choice(WORDS) for _ in range(n)) for n in (5, 9, 40, 200)]
    sizes = lambda x: np.array([len(s) for s in x])
    alone = [R.chunk_hashes(sizes([x]), R.codes([x]))[0].tolist() for x in lines]
    hashes, line, start, end = R.chunk_hashes(sizes(lines), R.codes(lines))
    assert end.tolist()[-1] == sum(map(len, lines)) and (start[1:] == end[:-1]).all()
    assert [hashes[line == i].tolist() for i in range(len(lines))] == alone and len(alone[3]) > 3


def test_chunks_do_not_depend_on_line_breaks(spark):
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    notice = line(120)
    half = len(notice) // 2
    wrapped = notice[: notice.rfind(" ", 0, half)] + "\n" + notice[notice.rfind(" ", 0, half) + 1 :]
    rows = [(i, "a", f"b{i % 6}", f"{line(30)}\n{notice if i % 2 else wrapped}\n{line(30)}") for i in range(20)]
    rows += [(30, "a", "b1", None), (31, None, "b1", notice), (32, "a", None, notice), (33, "a", "b1", ""), rows[0], (40, "c", "b1", notice), (41, "c", "b2", notice)]
    df = spark.createDataFrame(rows, "rec_id bigint, origin string, book string, text_md string")
    found = R.repeated_chunks(df)
    got = {r.rec_id: r for r in R.without_chunks(df, found).collect()}
    assert len(got) == 26 and got[30].text is None and got[33].text == "" and got[40].n_cut == 0 == got[31].n_cut
    whole = R.whole_key(notice)
    for i in range(20):
        kept, own = got[i].text, R.whole_key(rows[i][3])
        assert got[i].n_cut and len(own) - len(kept) > 0.6 * len(whole), i  # all of the notice but the chunks over its ends
        a, b = own.split(whole)
        assert kept.startswith(a[: len(a) - 200]) and kept.endswith(b[200:])
    assert R.repeated_chunks(df.limit(0)).count() == 0


def test_numbers_are_zeros():
    keys = ["12 ab 3", "45", "x9", "9۱x"]
    code, sizes = R._with_zeros(R.codes(keys), np.array([len(k) for k in keys]))
    text = code.tobytes().decode("utf-32-le")
    assert text == "0 ab 00x00x" and sizes.tolist() == [6, 1, 2, 2]
