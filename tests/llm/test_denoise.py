import random

from bargspark.llm import denoise as D

VOCAB = "کتاب خانه درخت رودخانه پرنده آسمان کوه دریا باران نامه چراغ دیوار پنجره ستاره بزرگ کوچک روشن زیبا برای میان گفت آمد نوشت خواند".split()


def corpus(spark):
    rng = random.Random(4)
    line = lambda: " ".join(rng.choice(VOCAB) for _ in range(9))
    pages = []
    for book in range(6):
        for page in range(1, 60):
            pages.append([book * 100 + page, f"b{book}", page, [line() for _ in range(8)]])
    noisy = {
        1: ("l", 2, "ب)ای", "misread"), 2: ("l", 3, "کتات", "misread"), 3: ("l", 1, "درخ~ت", "misread"), 4: ("l", 4, "بزرک", "misread"), 20: ("l", 4, "تاران", "misread"), 21: ("l", 4, "کفت", "misread"),
    }
    want = set()
    for rec, (_, no, word, kind) in noisy.items():
        pages[rec - 1][3][no - 1] = "آمد " + word + " نوشت"
        want.add((rec, no, kind))
    pages[9][3][3], pages[9][3][4] = "آمد رودخ-", "انه نوشت"
    want.add((10, 4, "broken_word"))
    pages[10][3][3], pages[10][3][4] = "آمد پنج)-", "ه نوشت"
    want |= {(11, 4, "broken_word"), (11, 4, "misread")}
    out = []
    for rec, book, page, lines in pages:
        if book in ("b0", "b1"):
            head = {0: f"{page} | داستان ستاره‌های روشن", 1: f"داستان ستاره‌های روشن … {page}", 2: "داستان ستاره‌های روشن"}[page % 3]
            lines = [head, "", *lines, "", f"– {page} –"]
            want = {(r, n + 2 if r == rec else n, k) for r, n, k in want}
            want |= {(rec, 1, "running_line"), (rec, len(lines), "page_number")}
        out.append((rec, book, page, "\n".join(lines)))
    out += [(900, "b0", 90, None), (901, "b0", 91, ""), (902, None, 5, "آمد ب)ای نوشت"), out[0], (903, "b5", 3, "آمد ب)ای نوشت\n3"), (904, "b0", None, "5"), (905, "b0", 92, "# ب)ای\n- ب)ای\n| ب)ای |\n```verse\nب)ای\n```\n> ب)ای\n1. ب)ای"), (906, "b0", 93, "آمد " * 30_000)]
    df = spark.createDataFrame([(*r, None, 0) for r in out], "rec_id bigint, book string, page int, text_md string, origin string, n int")
    books = spark.createDataFrame([("b0", None, "scanned"), ("b1", "داستان ستاره‌های روشن", "mixed"), *((f"b{i}", None, "digital") for i in range(2, 6))], "book string, title_fa string, source_type string")
    return df, books, spark.createDataFrame([("b0", None), ("b0", "هیچ")], "book string, title string"), want


def test_noise(spark):
    df, books, chapters, want = corpus(spark)
    found, fixed = D.noise(df, books, chapters)
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    words = {(r.was, r.word) for r in fixed.collect()}
    assert {("ب)ای", "برای"), ("کتات", "کتاب"), ("درخ~ت", "درخت"), ("بزرک", "بزرگ"), ("پنج)ه", "پنجره"), ("تاران", "باران"), ("کفت", "گفت")} == words


def test_empty(spark):
    df, books, chapters, _ = corpus(spark)
    assert D.noise(df.limit(0), books, chapters)[0].count() == 0


def test_page_numbers():
    for s in ("12", "– 12 –", "( ۱۲ )", "[۱۲]", "ص. ۱۲", "صفحهٔ ۱۲", "Page 12"):
        assert D.page_number(s, 12), s
    for s in ("13", "۱۲ شب", "12 13", "", "در ۱۲"):
        assert not D.page_number(s, 12), s
    assert not D.page_number("12", None)


def test_viterbi_uses_pairs():
    words = ["سر", "باز", "گفت"]
    options = [[("سر", None, 0.0)], [("باز", 5, 0.0), ("بار", 5, -1.0)], [("گفت", None, 0.0)]]
    assert D.viterbi(words, options, {}, 1000)[1] == "باز"
    assert D.viterbi(words, options, {("سر", "بار"): 50, ("بار", "گفت"): 50}, 1000)[1] == "بار"


def test_bits(spark):
    df = spark.createDataFrame([(f"w{i}",) for i in range(500)], "word string")
    bits = D.Bits(df, 12)
    assert all(f"w{i}" in bits for i in range(500)) and sum(f"x{i}" in bits for i in range(1000)) < 300


def test_rebuilt():
    text = "۳ | سر\n\nآمد ب)ای رودخ-\nانه نوشت\n# سر فصل\nکتات روش-\n\n– ۳ –"
    fixes = [{"line_no": 3, "was": "ب)ای", "word": "برای", "part": 0}, {"line_no": 6, "was": "کتات", "word": "کتاب", "part": 0}]
    assert D.rebuilt(text, {1, 8}, fixes) == (["آمد برای رودخانه نوشت", "# سر فصل", "کتاب روش-"], True)
    assert D.rebuilt("", set(), []) == ([], False)


def test_paragraphs(spark):
    pages = spark.createDataFrame([(1, "b", 1, 1, "الف ب\nپ روش-"), (2, "b", 2, 1, "ن است"), (3, "b", 3, 1, "و ادامه.\n\n# سر"), (4, "b", 3, 2, "و ادامه.\n\n# سر"), (5, "b", 4, 1, None), (6, "c", 1, 1, "x")], "rec_id bigint, book string, page int, attempt int, text_md string")
    flags = spark.createDataFrame([(1, False, False), (2, False, True), (3, True, False), (4, True, False)], "rec_id bigint, starts_mid_paragraph boolean, continues_next boolean")
    books = spark.createDataFrame([("b", "mixed"), ("c", "digital")], "book string, source_type string")
    none = spark.createDataFrame([], "rec_id bigint, line_no int, kind string")
    fixed = spark.createDataFrame([], "rec_id bigint, line_no int, place int, was string, word string, part int")
    got = sorted(tuple(r) for r in D.paragraphs(pages, flags, none, fixed, books).collect())
    assert got == [("b", 1, 1, 3, "الف ب پ روشن است و ادامه."), ("b", 3, 2, 3, "# سر")]
