import pytest

from bargspark.llm import visual as V

SAME = [
    ("آب", "آب"), ("café", "café"), ("۱۲۳", "١٢٣"), ("كتابي", "کتابی"), ("على", "علی"), ("ﮐﺘﺎﺏ", "کتاب"), ("ﻻ", "لا"),
    ("a b", "a b"), ("a b", "a b"), ("a　b", "a b"), ("ab​c", "abc"), ("تخ­ت", "تخت"), ("رحم‌ت", "رحم‌ت"),
    ("دار‌ا", "دارا"), ("می‌‌رود", "می‌رود"), ("کتاب‌ ها", "کتاب ها"), ("ｔａｂｌｅ", "table"), ("соре", "cope"), ("νοl", "vol"), ("（۲）", "(۲)"),
    ("پایٔیز", "پائیز"), ("خانهٔ", "خانۀ"), ("‏سلام‎", "سلام"), ("a\r\nb", "a\nb"), ("ب‍ب", "بب"), ("ئ", "ئ"),
]
DIFFERENT = [("می‌رود", "میرود"), ("محمّد", "محمد"), ("٤", "۴"), ("٥", "۵"), ("٦", "۶"), ("1", "۱"), ("A", "a"), ("é", "e"), ("بـت", "بت"), ("a  b", "a b"), ("ه‍", "ه"), ("²", "2"), ("کتاب", "کتات"), ("a\tb", "a b")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert V.canonical(a) == V.canonical(b)
    assert V.canonical(V.canonical(a)) == V.canonical(a)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different(a, b):
    assert V.canonical(a) != V.canonical(b)
    assert V.guard(V.canonical(a)) != V.guard(V.canonical(b))


def test_null_and_empty():
    assert V.canonical(None) is None and V.canonical("") == ""


def test_collation_keeps_guarded_values_apart(spark):
    rows = [(V.guard(V.canonical(a)), V.guard(V.canonical(b))) for a, b in DIFFERENT]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.where("a COLLATE UNICODE = b COLLATE UNICODE").count() == 0


def test_pairs(spark):
    pages = spark.createDataFrame(
        [(1, "x", "كتاب خوب", 9), (2, "x", "کتاب خوب", 9), (2, "x", "کتاب خوب", 8), (3, "x", "کتاب خوب", 9), (4, "y", "كتاب خوب", 9), (5, "x", None, 9), (6, "x", "", 9), (7, "x", "کتاب بد", 9), (8, None, "كتاب خوب", 9), (9, None, "کتاب خوب", 9)],
        "rec_id bigint, book string, text_md string, value int",
    )
    fields = spark.createDataFrame(
        [(1, "x", ["ا", "علي"]), (2, "x", ["ا", "علی"]), (3, "x", ["ا علی"]), (4, "x", []), (5, "x", None), (6, "x", [None, "ي"]), (7, "x", [None, "ی"]), (7, "x", [None, "ی"])], "rec_id bigint, book string, headings array<string>"
    )
    got = {tuple(r) for r in V.pairs(V.values(pages, fields)).collect()}
    assert got == {("text_md", 1, 2), ("text_md", 1, 3), ("headings", 1, 2), ("headings", 6, 7)}
    assert V.pairs(V.values(pages.limit(0), fields.limit(0))).count() == 0
