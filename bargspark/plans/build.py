"""From page texts to books: the whole line from pages over blocks, chapters and notes to EPUB files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bargspark.functions import text as X
from bargspark.operators import markdown
from bargspark.session import keep
from bargspark.sources import epub


def chapters(pages: DataFrame, books: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Of (rec_id, book, page, starts_mid_paragraph, continues_next, text_md), one record per page: rows for the EPUB sink, one for each part of a chapter.

    Books with a list of chapters are cut at its pages, the others at headings of level 1; blank pages are left out, empty chapters vanish. A book without title is named by its key."""
    clean = pages.where(F.length(X.strip(F.col("text_md"))) > 0).withColumn("text_md", X.normalize(F.col("text_md")))
    raw = keep(markdown.blocks(clean.select("rec_id", "book", "page", "text_md"), with_notes=True), "blocks")
    b = markdown.chapters_by_heading(markdown.stitched(clean, raw))
    if listed is not None:
        at = markdown.chapters_by_page(clean, listed).select("book", "page", (F.coalesce("idx", F.lit(-1)) + 1).alias("by_page"))
        has = listed.select("book").distinct().withColumn("has_list", F.lit(True))
        # a paragraph over pages belongs to the chapter of its first page
        first = b.groupBy("para").agg(F.min("page").alias("page"))
        placed = b.withColumnRenamed("page", "own_page").join(first, "para").join(at, ["book", "page"], "left").join(has, "book", "left")
        b = placed.withColumn("chapter", F.when(F.col("has_list"), F.coalesce("by_page", F.lit(0))).otherwise(F.col("chapter"))).drop("page", "by_page", "has_list").withColumnRenamed("own_page", "page")
    b = keep(b, "chapters")
    refs = keep(markdown.references(b, markdown.notes_of(raw)), "references")
    body = markdown.chapter_parts(markdown.xhtml(b, refs), refs)
    named = b.where("kind = 'h1'").groupBy("book", "chapter").agg(F.min_by(F.get("items", F.lit(0)), F.struct("page", "block")).alias("heading"))
    out = body.join(named, ["book", "chapter"], "left")
    if listed is not None:
        out = out.join(listed.select("book", (F.col("idx") + 1).alias("chapter"), F.col("title").alias("list_title")), ["book", "chapter"], "left")
        out = out.withColumn("heading", F.coalesce("list_title", "heading"))
    meta = books.select("book", "title_fa", "author_fa")
    return out.join(meta, "book", "left").select(
        "book", F.coalesce("title_fa", "book").alias("title"), F.coalesce("author_fa", F.lit("Unknown")).alias("author"), F.lit("fa").alias("language"), "chapter", F.coalesce("heading", "title_fa", "book").alias("chapter_title"), "page", "block", "body"
    )


def build(pages: DataFrame, books: DataFrame, path: str, listed: DataFrame | None = None, covers: DataFrame | None = None, font: str | None = None, licence: str | None = None) -> DataFrame:
    """Writes an EPUB file per book to the shared folder `path` and returns (book, chapters, parts), what was written."""
    rows = keep(chapters(pages, books, listed), "chapters")
    epub.write_epub(rows, path, covers, font, licence)
    return rows.groupBy("book").agg(F.countDistinct("chapter").alias("chapters"), F.count("*").alias("parts"))
