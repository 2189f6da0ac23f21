from bargspark.operators import markdown


def test_headings_over_a_million_characters_stay_whole(spark):
    long = "آ" * 1_000_001
    df = spark.createDataFrame([(n, f"{'#' * n} {long}") for n in (1, 2, 3)], "rec_id bigint, text_md string")
    got = {r.rec_id: [len(x) for x in r["items"]] for r in markdown.blocks(df).collect()}
    assert got == {n: [len(long)] for n in (1, 2, 3)}
