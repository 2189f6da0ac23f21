from bargspark.llm import vocabulary as V

LIST = [("flags", "image", "picture or illustration", "تصویر"), ("flags", "table", "table", "جدول"), ("flags", "two_column", "two columns", "دوستونی"), ("issue_type", "table_structure", "layout of table", "ساختار جدول"), ("issue_type", "verse_structure", "layout of verse", "ساختار شعر"), ("issue_type", "other", "anything else", None)]


def vocab(spark):
    return spark.createDataFrame(LIST, "field string, code string, label_en string, label_fa string")


def test_mapping(spark):
    want = {
        ("flags", "tabel"): "table", ("flags", " TABLE!"): "table", ("flags", "جدول​"): "table", ("flags", "column, two"): "two_column", ("flags", "TwoColumn"): "two_column", ("flags", "pictureorillustration"): "image", ("flags", "تصوير"): "image",
        ("flags", "coffee stain"): "", ("flags", "???"): "", ("issue_type", "taboe_tructure"): "table_structure", ("issue_type", "layout ofv erse"): "verse_structure", ("issue_type", "structure"): "", ("issue_type", "type: othr"): "other",
    }
    df = spark.createDataFrame([(f, v, 1) for f, v in want] * 2, "field string, value string, score int")
    got = V.mapping(df, vocab(spark)).collect()
    assert {(r.field, r.value): r.code for r in got} == want and len(got) == len(want)


def test_cases(spark):
    fields = spark.createDataFrame([(1, ["table", "tabel", None, " "]), (1, ["table", "tabel", None, " "]), (2, None), (3, []), (4, ["​ "])], "rec_id bigint, flags array<string>")
    reports = spark.createDataFrame([(7, [("othr", 1), ("other", 2), (None, 3), ("zzz", 4)])], "report_id bigint, issues array<struct<type: string, pos: int>>")
    got = {tuple(r) for r in V.cases(fields, reports, vocab(spark)).collect()}
    assert got == {("flags", 1, 1, "table"), ("issue_type", 7, 0, "other"), ("issue_type", 7, 3, "")}
    assert V.cases(fields.limit(0), reports.limit(0), vocab(spark)).count() == 0
