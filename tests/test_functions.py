import pytest
from pyspark.sql import functions as F

from bargspark.functions import measures as M
from bargspark.functions import text as X
from bargspark.operators import pages


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "given,want",
    [("كتابي", "کتابی"), ("کـتاب", "کتاب"), ("a \t b", "a b"), ("می ‌ رود", "می‌رود"), ("سلام ،دنیا", "سلام، دنیا"), ("چرا ؟!", "چرا؟ !"), ("۱۲:۳۰ و 3.14", "۱۲:۳۰ و 3.14"), ("۱.متن", "۱. متن"), ("...", ". . ."), ("« متن »", "«متن»"), ("خط  \nدوم \t", "خط\nدوم"), ("", ""), (None, None), ("گفت :«بیا»", "گفت: «بیا»"), ("(بله ،)", "(بله،)")],
)
def test_normalize(spark, given, want):
    c = X.normalize(F.lit(given).cast("string"))
    assert value(spark, c) == want
    if given:
        assert value(spark, X.normalize(F.lit(want))) == want


def test_bags(spark):
    assert value(spark, X.bag_words(F.lit("کلاس کالس (ه.ق) می‌رود"))) == ["اسلک", "اسلک", "می", "درو"][:2] + ["می", "درو"]
    got = value(spark, X.bag(F.lit("کلاس کالس آب")))
    assert {(r.w, r.n) for r in got} == {("اسلک", 2), ("اب", 1)}
    for t in ("", "ه 12 ."):
        assert value(spark, X.bag(F.lit(t))) == []


def test_cosine(spark):
    bag = lambda t: X.bag(F.lit(t))
    cos = lambda a, b: value(spark, M.cosine(bag(a), bag(b)))
    assert cos("سرد گرم", "گرم سرد") == pytest.approx(1.0)
    assert cos("سرد گرم", "سرد باد") == pytest.approx(0.5)
    assert cos("سرد سرد گرم", "سرد") == pytest.approx(2 / 5**0.5)
    assert cos("", "سرد") == 0.0 and cos("سرد", "تند") == 0.0


def test_small_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(X.heading_lines(F.lit("# a\n#### b\n##  c \nx\n### d"))) == ["a", "c", "d"]
    assert v(X.countable(F.lit("## a [^12] **b** |"))) == 2
    assert v(X.cap_words(F.lit(" a b  c d e f g"))) == " a b  c d e" and v(X.cap_words(F.lit("a b "))) == "a b "
    assert v(X.occurrences(F.lit("aaa"), F.lit("aa"))) == [0, 1] and v(X.occurrences(F.lit("a"), F.lit(""))) == [0] and v(X.occurrences(F.lit("a"), F.lit("ab"))) == []
    assert v(X.slug(F.lit("My  Book_1!"))) == "my-book-1" and v(X.slug(F.lit("کتاب"))) == "book"
    assert v(X.safe_name(F.lit('a/b: "c"  d'))) == 'a-b- -c- d' and v(X.safe_name(F.lit("  "))) == "book"
    assert v(X.inline(F.lit("**a** *b* <i> & **c*"))) == "<strong>a</strong> <em>b</em> &lt;i&gt; &amp; **c*"
    assert "<" not in v(X.script_json(F.struct(F.lit("</script>").alias("a"))))


@pytest.mark.parametrize("b,want", [([10, 20, 5, 30], None), ([-5, 0, 2000, 10], [0, 0, 1000, 10]), ([1, 2, 3], None), (None, None), ([1, None, 3, 4], None), ([5, 5, 5, 9], None), ([], None)])
def test_clean_bbox(spark, b, want):
    df = spark.createDataFrame([(b,)], "b array<int>")
    assert df.select(M.clean_bbox(F.col("b")).alias("v")).first()["v"] == want


def test_buckets(spark):
    df = spark.createDataFrame([(x,) for x in (0.69, 0.7, 0.8, 0.9, None, float("nan"))], "c double")
    assert [r.v for r in df.select(M.bucket(F.col("c")).alias("v")).collect()] == ["<0.7", "0.7-0.8", "0.8-0.9", "0.9-1.0", None, None]


@pytest.mark.parametrize("spec,want", [("5", [5]), ("3-5", [3, 4, 5]), ("8-", [8, 9, 10]), ("-2", [1, 2]), ("1,3-4", [1, 3, 4]), ("", list(range(1, 11))), ("9-20", [9, 10]), ("5-3", [])])
def test_page_spec(spark, spec, want):
    assert pages.page_spec(spec, 10) == want
    got = spark.range(0, 15).where(pages.in_spec(spec, F.col("id"), F.lit(10))).collect()
    assert sorted(r.id for r in got) == want


def test_page_spec_refuses_words():
    with pytest.raises(ValueError):
        pages.page_spec("a-b", 5)
