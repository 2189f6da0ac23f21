"""Page workspaces: a folder per book with page texts and their fields, read as tables and written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = "page INT, model_used STRING, resolution STRING, is_blank BOOLEAN, confidence DOUBLE, quality_score DOUBLE, needs_review BOOLEAN, flags ARRAY<STRING>, headings ARRAY<STRING>, starts_mid_paragraph BOOLEAN, continues_next BOOLEAN"


def paths(root: str, book: str, page: int) -> dict[str, str]:
    """Where the parts of a page are."""
    n = f"{page:04d}"
    at = f"{root.rstrip('/')}/{book}"
    return {"text": f"{at}/text/{n}.md", "fields": f"{at}/text/{n}.json", "original": f"{at}/text/{n}.orig.md", "image": f"{at}/pages/{n}.png", "hires": f"{at}/pages/hires/{n}.png", "pdf": f"{at}/source.pdf", "meta": f"{at}/book.yaml", "out": f"{at}/out"}


def _keyed(df: DataFrame, pattern: str) -> DataFrame:
    name = F.input_file_name() if "path" not in df.columns else F.col("path")
    return df.withColumn("_p", name).withColumn("book", F.regexp_extract("_p", r"/([^/]+)/[^/]+(?:/hires)?/[^/]+$", 1)).withColumn("page", F.expr(f"try_cast(regexp_extract(_p, '{pattern}', 1) AS INT)")).where("page IS NOT NULL").drop("_p")


def read_texts(spark: SparkSession, root: str, book: str = "*") -> DataFrame:
    """(book, page, text_md): every numbered page text; originals kept aside and other files are left out. The file listing is pruned to the book."""
    return _keyed(spark.read.text(f"{root}/{book}/text/*.md", wholetext=True).withColumnRenamed("value", "text_md"), r"/(\\d+)\\.md$")


def read_fields(spark: SparkSession, root: str, book: str = "*") -> DataFrame:
    """(book, page, …): the fields of every page; missing ones are null, corrupt files give nulls."""
    df = spark.read.schema(FIELDS).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{root}/{book}/text/*.json")
    return _keyed(df.drop("page"), r"/(\\d+)\\.json$")


def read_images(spark: SparkSession, root: str, book: str = "*") -> DataFrame:
    """(book, page, content): the page images, the one of higher resolution where there are two."""
    std, hi = (_keyed(spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(f"{root}/{book}/{d}").select("path", "content"), r"/(\\d+)\\.png$").drop("path") for d in ("pages", "pages/hires"))
    return std.join(hi.withColumnRenamed("content", "hires"), ["book", "page"], "full").select("book", "page", F.coalesce("hires", "content").alias("content"))


META = "title_fa STRING, author_fa STRING, title_en STRING, publisher_fa STRING, language STRING, source_type STRING, page_count INT, created STRING"
FOLDERS = ("pages/hires", "text", "review", "out")


def _parsed(text: str) -> dict:
    """A book's metadata; what is no mapping is none. JSON is YAML, so it is read without a YAML library too."""
    import json

    try:
        import yaml

        found = yaml.safe_load(text)
    except ImportError:
        found = json.loads(text)
    return found if isinstance(found, dict) else {}


def read_meta(spark: SparkSession, root: str, book: str = "*") -> DataFrame:
    """(book, title_fa, …, other): the metadata of every book; keys beside the known ones come as JSON in `other`, a corrupt file gives nulls."""
    names = [c.split()[0] for c in META.split(", ")]

    def run(batches):
        import json

        import pyarrow as pa

        for b in batches:
            rows = []
            for text in b.column("value").to_pylist():
                try:
                    m = _parsed(text)
                except Exception:
                    m = {}
                count = m.get("page_count")
                known = [str(m[n]) if n != "page_count" and m.get(n) is not None else None for n in names]
                known[names.index("page_count")] = count if isinstance(count, int) and not isinstance(count, bool) else None
                rest = {k: v for k, v in m.items() if k not in names}
                rows.append([*known, json.dumps(rest, ensure_ascii=False, default=str) if rest else None])
            columns = list(zip(*rows)) or [[]] * (len(names) + 1)
            types = [pa.int32() if n == "page_count" else pa.string() for n in (*names, "other")]
            yield pa.RecordBatch.from_arrays([b.column("book"), *(pa.array(c, t) for c, t in zip(columns, types))], ["book", *names, "other"])

    files = spark.read.text(f"{root}/{book}/book.yaml", wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"/([^/]+)/book\.yaml$", 1).alias("book"))
    return files.mapInArrow(run, f"book string, {META}, other string")


def _local(root: str) -> str:
    if "://" in root and not root.startswith("file://"):
        raise ValueError(f"{root}: page files need a mounted or local folder")
    return root.removeprefix("file://").removeprefix("file:")


def _written(df: DataFrame, write) -> int:
    """Runs `write(row)` on the executors for each row and gives their number."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                write(row)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return df.mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def _put(path: str, data: bytes) -> None:
    """By a rename, so that a reader or a task's second attempt never sees half a file."""
    import os
    import uuid

    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(tmp, "wb") as f:
        f.write(data)
    os.replace(tmp, path)


def write_meta(books: DataFrame, root: str) -> int:
    """Writes (book, …) as each book's metadata, nulls left out, in the order of the columns."""
    root = _local(root)

    def write(row):
        import json

        kept = {k: v for k, v in row.items() if k != "book" and v is not None}
        try:
            import yaml

            text = yaml.safe_dump(kept, allow_unicode=True, sort_keys=False)
        except ImportError:
            text = json.dumps(kept, ensure_ascii=False, indent=2)
        _put(paths(root, row["book"], 0)["meta"], text.encode())

    return _written(books, write)


def create(sources: DataFrame, root: str) -> int:
    """Makes the folders of each (book, content) and puts its source in."""
    root = _local(root)

    def write(row):
        import os

        for f in FOLDERS:
            os.makedirs(f"{root.rstrip('/')}/{row['book']}/{f}", exist_ok=True)
        _put(paths(root, row["book"], 0)["pdf"], bytes(row["content"] or b""))

    return _written(sources.select("book", "content"), write)


def load(spark: SparkSession, root: str, book: str) -> dict[str, DataFrame]:
    """The tables of one book; FileNotFoundError if there is no such book or it has no metadata."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(paths(root, book, 0)["meta"])
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(f"no book {book} in {root}")
    return {"meta": read_meta(spark, root, book), "texts": read_texts(spark, root, book), "fields": read_fields(spark, root, book)}


def write_fields(fields: DataFrame, root: str) -> int:
    """Writes (book, page, …) as the fields of each page, in place of those before; nulls are left out."""
    root = _local(root)

    def write(row):
        import json

        kept = {k: v for k, v in row.items() if k != "book" and v is not None}
        _put(paths(root, row["book"], row["page"])["fields"], json.dumps(kept, ensure_ascii=False, indent=2, default=str).encode())

    return _written(fields, write)


def keep_first(old: DataFrame, new: DataFrame) -> DataFrame:
    """Of (book, page, text_md, orig_text_md) and (book, page, text_md): the new texts, with what was there before the first change kept as the original."""
    n = new.select("book", "page", F.col("text_md").alias("_new"))
    return old.join(n, ["book", "page"], "left").select("book", "page", F.coalesce("_new", "text_md").alias("text_md"), F.when(F.col("_new").isNotNull(), F.coalesce("orig_text_md", "text_md")).otherwise(F.col("orig_text_md")).alias("orig_text_md"))


def write_texts(pages: DataFrame, root: str) -> int:
    """Writes (book, page, text_md) as page files from the executors. `root` must be a folder all executors share, mounted or local."""
    root = _local(root)
    return _written(pages.select("book", "page", "text_md"), lambda row: _put(paths(root, row["book"], row["page"])["text"], (row["text_md"] or "").encode()))
