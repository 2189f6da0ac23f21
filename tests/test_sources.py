import json
import os
import zipfile

import pytest

from bargspark.sources import epub, readers, workspace


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "books" / "b1"
    (base / "text").mkdir(parents=True), (base / "pages" / "hires").mkdir(parents=True)
    (base / "text" / "0001.md").write_text("# سر\nمتن", encoding="utf-8")
    (base / "text" / "0001.orig.md").write_text("کهنه", encoding="utf-8")
    (base / "text" / "notes.md").write_text("x")
    (base / "text" / "0001.json").write_text(json.dumps({"page": 1, "confidence": 0.5, "flags": ["table"], "other": 1}))
    (base / "text" / "0002.json").write_text("{broken")
    (base / "pages" / "0001.png").write_bytes(b"std"), (base / "pages" / "hires" / "0001.png").write_bytes(b"hi"), (base / "pages" / "0002.png").write_bytes(b"two")
    return str(tmp_path / "books")


def test_workspace(spark, root):
    assert [tuple(r) for r in workspace.read_texts(spark, root).select("book", "page", "text_md").collect()] == [("b1", 1, "# سر\nمتن")]
    got = {r.page: r for r in workspace.read_fields(spark, root).collect()}
    assert got[1].confidence == 0.5 and got[1].flags == ["table"] and got[2].confidence is None
    assert {(r.page, bytes(r.content)) for r in workspace.read_images(spark, root).collect()} == {(1, b"hi"), (2, b"two")}
    old = spark.createDataFrame([("b", 1, "x", None), ("b", 2, "y", "o"), ("b", 3, "z", None)], "book string, page int, text_md string, orig_text_md string")
    new = spark.createDataFrame([("b", 1, "X"), ("b", 2, "Y")], "book string, page int, text_md string")
    assert {tuple(r) for r in workspace.keep_first(old, new).collect()} == {("b", 1, "X", "x"), ("b", 2, "Y", "o"), ("b", 3, "z", None)}
    workspace.write_texts(new, root)
    assert open(os.path.join(root, "b", "text", "0002.md")).read() == "Y"


def test_epub(spark, tmp_path):
    rows = [("b1", "کتاب", "نویسنده", "fa", 1, "فصل یک", "<h1>فصل یک</h1><p>الف</p>"), ("b1", "کتاب", "نویسنده", "fa", 2, "فصل & دو", "<p>ب</p>"), ("b2", None, None, None, 0, None, None)]
    df = spark.createDataFrame(rows, "book string, title string, author string, language string, chapter int, chapter_title string, body string")
    out = str(tmp_path / "out")
    epub.write_epub(df, out)
    assert sorted(os.listdir(out)) == ["b1.epub", "b2.epub"]
    z = zipfile.ZipFile(os.path.join(out, "b1.epub"))
    names = z.namelist()
    assert names[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and z.read("mimetype") == b"application/epub+zip"
    opf, nav = z.read("OEBPS/content.opf").decode(), z.read("OEBPS/nav.xhtml").decode()
    assert 'page-progression-direction="rtl"' in opf and "<dc:creator>نویسنده</dc:creator>" in opf
    assert nav.index("فصل یک") < nav.index("فصل &amp; دو")
    assert "<h1>فصل &amp; دو</h1><p>ب</p>" in z.read("OEBPS/chap_002.xhtml").decode()
    import xml.dom.minidom

    for n in names:
        if n.endswith((".xhtml", ".opf", ".ncx")):
            xml.dom.minidom.parseString(z.read(n))
    first = {n: z.read(n) for n in names}
    epub.write_epub(df, out)
    again = zipfile.ZipFile(os.path.join(out, "b1.epub"))
    assert {n: again.read(n) for n in again.namelist()} == first


def test_epub_in_parts(spark, tmp_path):
    rows = [("b1", "ت", None, "fa", 1, "یک", p, b, f"<p>{p}.{b}</p>", None) for p in (1, 2, 3) for b in (0, 1)] + [("b1", "ت", None, "fa", 2, "دو", 4, 0, "<p>x</p>", None)]
    (tmp_path / "f.ttf").write_bytes(b"font"), (tmp_path / "OFL.txt").write_text("licence")
    covers = spark.createDataFrame([("b1", bytearray(b"\x89PNG\r\n\x1a\nx")), ("b9", bytearray(b"y")), ("b1", None)], "book string, cover binary")
    epub.write_epub(spark.createDataFrame(rows, epub.SCHEMA).repartition(3), str(tmp_path / "out"), covers, str(tmp_path / "f.ttf"), str(tmp_path / "OFL.txt"))
    assert os.listdir(tmp_path / "out") == ["b1.epub"]
    z = zipfile.ZipFile(tmp_path / "out" / "b1.epub")
    body = z.read("OEBPS/chap_001.xhtml").decode()
    assert "<h1>یک</h1><p>1.0</p><p>1.1</p><p>2.0</p><p>2.1</p><p>3.0</p><p>3.1</p></body>" in body and body.count("<h1>") == 1
    opf = z.read("OEBPS/content.opf").decode()
    assert 'properties="cover-image"' in opf and z.read("OEBPS/cover.png").startswith(b"\x89PNG") and z.read("OEBPS/fonts/f.ttf") == b"font" and "fonts/OFL.txt" in opf
    assert "fonts/f.ttf" in z.read("OEBPS/style.css").decode() and epub.checked(str(tmp_path), "no-such-checker") is None


def test_a_failed_job_leaves_old_books(spark, tmp_path):
    out = str(tmp_path / "out")
    schema = "book string, title string, author string, language string, chapter int, chapter_title string, body string"
    epub.write_epub(spark.createDataFrame([("b1", "old", None, "fa", 1, "t", "<p>old</p>")], schema), out)
    before = open(os.path.join(out, "b1.epub"), "rb").read()
    new = spark.createDataFrame([(f"b{i}", "new", None, "fa", 1, "t", "<p>new</p>") for i in range(1, 9)], schema)
    from pyspark.sql import functions as F

    with pytest.raises(Exception):
        epub.write_epub(new.withColumn("body", F.when(F.col("book") == "b8", F.raise_error(F.lit("lost"))).otherwise(F.col("body"))), out)
    assert os.listdir(out) == ["b1.epub"] and open(os.path.join(out, "b1.epub"), "rb").read() == before
    with pytest.raises(Exception):
        epub.write_epub(new, "s3a://bucket/x")


def test_books(spark, tmp_path):
    root = str(tmp_path / "books")
    workspace.create(spark.createDataFrame([("b1", bytearray(b"%PDF")), ("b2", None)], "book string, content binary"), root)
    assert open(os.path.join(root, "b1", "source.pdf"), "rb").read() == b"%PDF" and os.path.isdir(os.path.join(root, "b2", "pages", "hires"))
    with pytest.raises(FileNotFoundError):
        workspace.load(spark, root, "b1")
    workspace.write_meta(spark.createDataFrame([("b1", "کتاب: یک", None, 12, "x"), ("b2", None, "fa", None, None)], "book string, title_fa string, language string, page_count int, note string"), root)
    got = {r.book: r for r in workspace.read_meta(spark, root).collect()}
    assert (got["b1"].title_fa, got["b1"].page_count, json.loads(got["b1"].other)) == ("کتاب: یک", 12, {"note": "x"}) and got["b2"].language == "fa" and got["b2"].page_count is None
    open(os.path.join(root, "b2", "book.yaml"), "w").write("[broken")
    assert workspace.read_meta(spark, root, "b2").first().language is None
    workspace.write_fields(spark.createDataFrame([("b1", 3, 0.5, ["table"], None)], "book string, page int, confidence double, flags array<string>, model_used string"), root)
    workspace.write_texts(spark.createDataFrame([("b1", 3, "متن")], "book string, page int, text_md string"), root)
    t = workspace.load(spark, root, "b1")
    assert t["texts"].first().text_md == "متن" and t["fields"].first().flags == ["table"] and t["meta"].first().title_fa == "کتاب: یک"
    with pytest.raises(ValueError):
        workspace.write_texts(t["texts"].select("book", "page", "text_md"), "hdfs://x/y")


def test_log(spark, tmp_path):
    from bargspark.sources import log

    doc, folder = str(tmp_path / "h.json"), str(tmp_path / "log")
    assert log.read_document(spark, doc).count() == 0 and log.read_lines(spark, folder).count() == 0
    event = {"date": "2025-01-01", "book": "b", "page": 1, "detected_by": "auto_qc", "issue_type": "pass", "features": {"flags": [], "confidence_bucket": "<0.7", "char_signals": ["zwnj"]}}
    open(doc, "w").write(json.dumps({"events": [event, event]}))
    assert [r.features.char_signals for r in log.read_document(spark, doc).collect()] == [["zwnj"]] * 2
    open(doc, "w").write('{"events": [')
    assert log.read_document(spark, doc).count() == 0
    events = spark.createDataFrame([("d", "b", 1, None, None, "auto_qc", "pass", (["x"], None, None))], log.EVENT)
    log.append(events, folder), log.append(events, folder)
    open(os.path.join(folder, "broken.json"), "w").write('{"date": \nnothing\n{"issue_type": "digit_error", "page": 2}\n')
    assert sorted(r.issue_type for r in log.read_lines(spark, folder).collect()) == ["digit_error", "pass", "pass"]


def test_answers_keep_their_contract(spark, tmp_path):
    store, calls = str(tmp_path / "store"), str(tmp_path / "calls")
    spark.createDataFrame([], "key string, answer string, error string").write.parquet(store)

    def ask(content):
        with open(calls, "a") as f:
            f.write("x")
        return '{"verdict": "pass", "issues": []}' if content == b"ok" else {"verdict": "maybe", "issues": []}

    todo = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"ok"),), (bytearray(b"odd"),), (None,)], "content binary").coalesce(1)
    got = sorted(readers.answers(todo, store, ask, "verify", 0).collect(), key=lambda r: r.answer or "")
    assert [bool(r.answer) for r in got] == [False, True] and "verdict maybe" in got[0].error and len(open(calls).read()) == 4
    readers.answers(todo, store, ask, "verify", 0).count()
    assert len(open(calls).read()) == 7  # only the one that failed is asked again
    for bad in ("[]", "{", '{"verdict": "pass"}', {"verdict": "pass", "issues": True}):
        with pytest.raises(readers.SchemaError):
            readers.agreed("verify", bad)
    tries = []

    def busy(status):
        tries.append(status)
        raise readers.StatusError(status)

    for status, n in ((429, 3), (503, 3), (401, 1)):
        tries.clear()
        with pytest.raises(readers.StatusError):
            readers.with_retry(busy, status, wait=0)
        assert len(tries) == n


def test_reader_is_asked_once(spark, tmp_path):
    store, calls = str(tmp_path / "answers"), str(tmp_path / "calls")
    spark.createDataFrame([], "key string, lines array<string>").write.parquet(store)

    def read(strips):
        with open(calls, "a") as f:
            f.write("x" * len(strips))
        return [["متن"] if s != b"bad" else None for s in map(bytes, strips)]

    todo = spark.createDataFrame([(bytearray(b"a"),), (bytearray(b"a"),), (bytearray(b"bad"),), (None,)], "content binary")
    for _ in range(2):
        got = readers.read_once(todo, spark.read.schema("key string, lines array<string>").parquet(store), read, store).collect()
        assert sorted(r.lines or [] for r in got) == [[], ["متن"]]
    assert len(open(calls).read()) == 2


def test_retry():
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert readers.with_retry(flaky, wait=0) == "ok"
    with pytest.raises(ValueError):
        readers.with_retry(lambda: (_ for _ in ()).throw(ValueError()), wait=0)
    with pytest.raises(ConnectionError):
        readers.with_retry(lambda: (_ for _ in ()).throw(ConnectionError()), wait=0)
