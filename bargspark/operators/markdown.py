"""Markdown pages as blocks, paragraphs joined over pages, chapters, notes and XHTML.

Lines are classified and runs of lines become blocks by windows over one page
(partitioned by record, so a book that holds a third of all pages is still spread
page by page). What follows pages (joins of paragraphs, chapters, numbers of
notes) needs running values over a book; these run on one slim row per page in
blocks of pages (windows.py), and the results are joined back, so no task holds a
book's texts or all of its pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bargspark.functions import text as X
from bargspark.session import keep

from . import windows

# The shapes of lines.
NOTE = r"(?s)^\[\^([^\]]+)\]:\s?(.*)$"
BULLET, NUMBERED, TABLE, REFERENCE = r"^[-*]\s+", r"^\p{Nd}+\.\s+", f"^{X.WHITE}*\\|", r"\[\^([^\]]+)\]"
RULE_CELL = "^:?-+:?$"


def page_lines(pages: DataFrame, text: str = "text_md") -> DataFrame:
    """(…keys, line, raw, s): every line of a page, 0-based, as stored and stripped."""
    keys = [c for c in pages.columns if c != text]
    return pages.select(*keys, F.posexplode(X.lines(F.col(text))).alias("line", "raw")).withColumn("s", X.strip(F.col("raw")))


def classified(pages: DataFrame, key: str = "rec_id", text: str = "text_md") -> DataFrame:
    """Adds `kind` of each line: blank, fence, verse, h1..h3, note, quote, table, bullet, number, p. Inside an open block of verse every line up to its end is verse; a missing end is tolerated."""
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    s = F.col("s")
    # the state before a line: the last line that opens or closes a block of verse; a close outside of one is none
    mark = F.when(s == "```verse", 1).when(s == "```", 0)
    df = page_lines(pages, text).withColumn("_in", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(0)) == 1)
    kind = (
        F.when(F.col("_in") & (s == "```"), "fence").when(F.col("_in"), "verse").when(s == "", "blank").when(s == "```verse", "fence")
        .when(s.startswith("### "), "h3").when(s.startswith("## "), "h2").when(s.startswith("# "), "h1")
        .when(s.rlike(NOTE), "note").when(s.startswith(">"), "quote").when(F.col("raw").rlike(TABLE), "table")
        .when(s.rlike(BULLET), "bullet").when(s.rlike(NUMBERED), "number").otherwise("p")
    )
    return df.withColumn("kind", kind).drop("_in")


def parity_verse(pages: DataFrame, key: str = "rec_id", text: str = "text_md") -> DataFrame:
    """(key, line, inside): the other reading of fences, by which every line of three backticks opens or closes and only what a `verse` one opened is verse."""
    w = W.partitionBy(key).orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    fence = F.col("s").startswith("```")
    df = page_lines(pages, text).withColumn("before", F.sum(fence.cast("int")).over(w)).withColumn("tag", F.when(fence & (F.coalesce("before", F.lit(0)) % 2 == 0), X.strip(F.expr("substring(s, 4)"))))
    inside = ~fence & (F.coalesce("before", F.lit(0)) % 2 == 1) & (F.last("tag", ignorenulls=True).over(w) == "verse")
    return df.select(key, "line", F.coalesce(inside, F.lit(False)).alias("inside"))


def blocks(pages: DataFrame, key: str = "rec_id", text: str = "text_md", with_notes: bool = False) -> DataFrame:
    """(…keys, block, kind, items): the blocks of each page from 0; items are the texts of its lines. Notes' definitions are no blocks; runs of quotes, rows and items of one kind are one block, ended by anything else.

    With `with_notes` each definition has a row too, of the kind note and a block below 0, for `notes_of`."""
    keys = [c for c in pages.columns if c != text]
    w = W.partitionBy(key).orderBy("line")
    lines = classified(pages, key, text)
    run = F.col("kind").isin("quote", "table", "bullet", "number", "verse")
    before = F.lag("kind").over(w)
    # an empty block of verse is a block too, so its opening fence starts it; verse lines belong to it
    opens = ((F.col("kind") == "fence") & (F.col("s") == "```verse")) | F.col("kind").isin("h1", "h2", "h3", "p") | (run & (F.col("kind") != "verse") & ~before.eqNullSafe(F.col("kind")))
    df = lines.withColumn("opens", opens).withColumn("block", F.sum(F.col("opens").cast("int")).over(w) - 1)
    some = F.col("kind").isin("h1", "h2", "h3", "p", "quote", "table", "bullet", "number", "verse") | F.col("opens")
    if with_notes:
        some = some | (F.col("kind") == "note")
        df = df.withColumn("block", F.when(F.col("kind") == "note", -1 - F.col("line")).otherwise(F.col("block")))
    df = df.where(some)
    s = F.col("s")
    item = (
        F.when(F.col("kind") == "h1", X.strip(F.expr("substring(s, 3)"))).when(F.col("kind") == "h2", X.strip(F.expr("substring(s, 4)"))).when(F.col("kind") == "h3", X.strip(F.expr("substring(s, 5)")))
        .when(F.col("kind") == "quote", F.nullif(F.regexp_replace(s, "^> ?", ""), F.lit("")))
        .when(F.col("kind") == "bullet", F.regexp_replace(s, BULLET, "")).when(F.col("kind") == "number", F.regexp_replace(s, NUMBERED, ""))
        .when(F.col("kind") == "table", F.when(F.forall(cells(s), lambda c: c.rlike(RULE_CELL)), F.lit(None)).otherwise(s))
        .when(F.col("kind") == "fence", F.lit(None)).otherwise(s)
    )
    kind = F.when(F.col("kind") == "fence", "verse").when(F.col("kind") == "bullet", "ul").when(F.col("kind") == "number", "ol").otherwise(F.col("kind"))
    df = df.withColumn("item", item).withColumn("kind", kind)
    got = df.groupBy(*keys, "block").agg(F.first("kind").alias("kind"), F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("line", "item")))).alias("i"))
    return got.select(*keys, "block", "kind", F.transform("i", lambda x: x["item"]).alias("items"))


def cells(row: Column) -> Column:
    """The cells of a table row, stripped."""
    return F.transform(F.split(F.regexp_replace(X.strip(row), r"^\|+|\|+$", ""), r"\|", -1), X.strip)


def notes(pages: DataFrame, key: str = "rec_id", text: str = "text_md") -> DataFrame:
    """(key, label, definition): the last definition of each label of a page."""
    found = classified(pages, key, text).where("kind = 'note'").select(key, "line", F.regexp_extract("s", NOTE, 1).alias("label"), F.regexp_extract("s", NOTE, 2).alias("definition"))
    return found.groupBy(key, "label").agg(F.max_by("definition", "line").alias("definition"))


def notes_of(b: DataFrame, key: str = "rec_id") -> DataFrame:
    """The same as `notes`, of blocks made with them."""
    s = F.get("items", F.lit(0))
    found = b.where("kind = 'note'").select(key, (-1 - F.col("block")).alias("line"), F.regexp_extract(s, NOTE, 1).alias("label"), F.regexp_extract(s, NOTE, 2).alias("definition"))
    return found.groupBy(key, "label").agg(F.max_by("definition", "line").alias("definition"))


def stitched(pages: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Of (rec_id, book, page, starts_mid_paragraph, continues_next, text_md), one record per page: the blocks with `para`, the same for the blocks that are one paragraph over pages, and `joined`, true for its later parts.

    A page's first block joins the last block of the book before it if both are
    paragraphs, the page before is the number before, it goes on and this one
    starts inside a paragraph. A page without blocks doesn't stand between them. `b` is
    a kept table of the pages' blocks, where there is one."""
    b = keep(blocks(pages.select("rec_id", "book", "page", "text_md")), "md-blocks") if b is None else b.where("kind <> 'note'")
    ends = b.groupBy("rec_id").agg(F.min_by("kind", "block").alias("first_kind"), F.max_by("kind", "block").alias("last_kind"), F.min("block").alias("first"), F.max("block").alias("last"))
    # a slim row per page, in order of the book
    slim = keep(pages.select("rec_id", "book", "page", "starts_mid_paragraph", "continues_next").join(ends, "rec_id", "left"), "md-pages")
    slim = windows.last_before(slim, ["book"], "page", {"_page": F.struct("page", "continues_next"), "_kind": F.col("last_kind")})
    joins = (F.col("_page.page") == F.col("page") - 1) & F.col("_page.continues_next") & F.col("starts_mid_paragraph") & (F.col("_kind") == "p") & (F.col("first_kind") == "p")
    slim = slim.withColumn("joins", F.coalesce(joins, F.lit(False)))
    # a page of one paragraph that was joined passes the join on: the head is the last block of the last page before that isn't such a page
    single = F.col("joins") & (F.col("first") == F.col("last"))
    slim = keep(slim.select("rec_id", "book", "page", "first", "last", "joins", single.alias("single")), "md-joins")
    slim = windows.last_before(slim, ["book"], "page", {"head": F.when(F.col("last").isNotNull() & ~F.coalesce("single", F.lit(False)), F.struct("rec_id", "last"))})
    joined = b.join(slim.where("joins").select("rec_id", F.col("first").alias("block"), F.col("head.rec_id").alias("h_rec"), F.col("head.last").alias("h_block")), ["rec_id", "block"], "left")
    para = F.concat_ws(".", F.coalesce("h_rec", "rec_id"), F.coalesce("h_block", "block"))
    return joined.select("rec_id", "book", "page", "block", "kind", "items", para.alias("para"), F.col("h_rec").isNotNull().alias("joined"))


def chapters_by_heading(b: DataFrame) -> DataFrame:
    """Of the blocks of `stitched`: adds `chapter` (0 before the first heading of level 1, then counting) per book. Counted per page first; the running sum is over pages."""
    per = b.groupBy("rec_id", "book", "page").agg(F.sum((F.col("kind") == "h1").cast("int")).alias("n"))
    before = windows.sums_before(per, ["book"], "page", F.col("n"), "before", ("rec_id",)).select("rec_id", "before")
    here = F.sum((F.col("kind") == "h1").cast("int")).over(W.partitionBy("rec_id").orderBy("block"))
    return b.withColumn("here", here).join(before, "rec_id").withColumn("chapter", (F.col("here") + F.col("before")).cast("int")).drop("here", "before")


def chapters_by_page(pages: DataFrame, chapters: DataFrame) -> DataFrame:
    """(book, page, idx, title): the last chapter that starts at or before the page, the later entry on ties; null before the first. An as-of join by one sort of pages and chapters together."""
    marks = chapters.select("book", F.col("start_page").alias("page"), F.lit(0).alias("side"), F.col("idx"), "title")
    rows = pages.select("book", "page").distinct().select("book", "page", F.lit(1).alias("side"), F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("title"))
    found = windows.last_before(marks.unionByName(rows), ["book"], "page", {"c": F.when(F.col("side") == 0, F.struct("idx", "title"))}, ("side", "idx"))
    return found.where("side = 1").select("book", "page", "c.idx", "c.title")


def references(b: DataFrame, defs: DataFrame) -> DataFrame:
    """Of blocks with `chapter`: (rec_id, book, chapter, page, block, item, at, label, number, definition): every reference to a note, numbered through its chapter, with its page's definition or an empty one."""
    found = b.select("rec_id", "book", "chapter", "page", "block", F.posexplode("items").alias("item", "t")).select("rec_id", "book", "chapter", "page", "block", "item", F.posexplode(F.regexp_extract_all("t", F.lit(REFERENCE), F.lit(1))).alias("at", "label"))
    found = keep(found, "md-references")
    # running numbers: within a page by a window, over pages by a running sum of one row per page and chapter
    per = found.groupBy("book", "chapter", "page", "rec_id").agg(F.count("*").alias("n"))
    before = windows.sums_before(per, ["book", "chapter"], "page", F.col("n"), "before", ("rec_id",)).select("book", "chapter", "rec_id", "before")
    here = F.row_number().over(W.partitionBy("book", "chapter", "rec_id").orderBy("block", "item", "at"))
    numbered = found.withColumn("here", here).join(before, ["book", "chapter", "rec_id"]).withColumn("number", (F.col("here") + F.col("before")).cast("int"))
    return numbered.join(defs, ["rec_id", "label"], "left").select("rec_id", "book", "chapter", "page", "block", "item", "at", "label", "number", F.coalesce("definition", F.lit("")).alias("definition"))


def with_references(html: Column, chapter: Column, first: Column) -> Column:
    """Rendered text with each reference as a numbered link; `first` is the number of its first reference."""
    parts = F.split(html, REFERENCE, -1)

    def link(n: Column) -> Column:
        fid = F.concat(F.lit("c"), chapter.cast("string"), F.lit("-"), n.cast("string"))
        return F.concat(F.lit('<a id="fnref-'), fid, F.lit('" href="#fn-'), fid, F.lit('" epub:type="noteref" class="fnref"><sup>'), n.cast("string"), F.lit("</sup></a>"))

    return X.let(parts, lambda p: F.array_join(F.transform(p, lambda s, i: F.when(i == 0, s).otherwise(F.concat(link(first + i - 1), s))), ""))


def xhtml(b: DataFrame, refs: DataFrame) -> DataFrame:
    """Of blocks with `chapter` and their `references`: (rec_id, book, chapter, page, block, para, joined, kind, html), the inner XHTML of each block; a paragraph's element is put around its joined parts by `chapter_bodies`."""
    starts = refs.groupBy("rec_id", "chapter", "block", "item").agg(F.min("number").alias("first"))
    each = b.select("rec_id", "book", "chapter", "page", "block", "para", "joined", "kind", F.posexplode_outer("items").alias("item", "t")).join(starts, ["rec_id", "chapter", "block", "item"], "left")
    body = lambda t: with_references(X.inline(t), F.col("chapter"), F.coalesce("first", F.lit(1)))
    half = F.split("t", " --- ", 2)
    refs_in = lambda t: F.size(F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(1)))
    left, right = X.strip(F.get(half, F.lit(0))), X.strip(F.get(half, F.lit(1)))
    verse = F.when(F.col("t") == "", "").when(
        F.size(half) == 2,
        F.concat(F.lit('<p class="v"><span class="m1">'), body(left), F.lit('</span><span class="m2">'), with_references(X.inline(right), F.col("chapter"), F.coalesce("first", F.lit(1)) + refs_in(left)), F.lit("</span></p>")),
    ).otherwise(F.concat(F.lit('<p class="v"><span class="m-full">'), body(F.col("t")), F.lit("</span></p>")))
    cell = F.when(F.col("item") == 0, "th").otherwise("td")
    row = F.concat(F.lit("<tr>"), F.array_join(F.transform(F.split(with_references(F.array_join(F.transform(cells(F.col("t")), X.inline), "|"), F.col("chapter"), F.coalesce("first", F.lit(1))), r"\|", -1), lambda c: F.concat(F.lit("<"), cell, F.lit(">"), c, F.lit("</"), cell, F.lit(">"))), ""), F.lit("</tr>"))
    row = F.when(F.col("item") == 0, F.concat(F.lit("<thead>"), row, F.lit("</thead>"))).otherwise(row)
    k = F.col("kind")
    html = F.when(F.col("t").isNull(), "").when(k == "verse", verse).when(k == "table", row).when(k == "quote", F.concat(F.lit("<p>"), body(F.col("t")), F.lit("</p>"))).when(k.isin("ul", "ol"), F.concat(F.lit("<li>"), body(F.col("t")), F.lit("</li>"))).otherwise(body(F.col("t")))
    got = each.withColumn("html", html).groupBy("rec_id", "book", "chapter", "page", "block", "para", "joined", "kind").agg(F.array_sort(F.collect_list(F.struct("item", "html"))).alias("h"))
    inner = F.array_join(F.transform("h", lambda x: x["html"]), "")
    wrapped = (
        F.when(k == "verse", F.concat(F.lit('<div class="verse">'), inner, F.lit("</div>")))
        .when((k == "table") & (inner == ""), "").when(k == "table", F.concat(F.lit("<table>"), F.regexp_replace(inner, "(?s)^(<thead>.*?</thead>)(.*)$", "$1<tbody>$2</tbody>"), F.lit("</table>")))
        .when(k == "quote", F.concat(F.lit("<blockquote>"), inner, F.lit("</blockquote>")))
        .when(k.isin("ul", "ol", "h1", "h2", "h3"), F.concat(F.lit("<"), k, F.lit(">"), inner, F.lit("</"), k, F.lit(">"))).otherwise(inner)
    )
    return got.withColumn("html", wrapped).drop("h")


#: Behind all pages of a chapter.
END = 2_147_483_647


def chapter_parts(x: DataFrame, refs: DataFrame) -> DataFrame:
    """(book, chapter, page, block, body): the XHTML of each chapter in parts that follow in order of (page, block), its notes last. Only the parts of one paragraph are put together, so no row holds a chapter."""
    head = x.where("NOT joined").select(F.col("para"), "book", "chapter", "page", "block", "kind")
    parts = x.groupBy("para").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block", "html"))), lambda s: s["html"]), " ").alias("inner"))
    whole = head.join(parts, "para").select("book", "chapter", "page", "block", F.when(F.col("kind") == "p", F.concat(F.lit("<p>"), "inner", F.lit("</p>"))).otherwise(F.col("inner")).alias("body"))
    fid = F.concat(F.lit("c"), F.col("chapter").cast("string"), F.lit("-"), F.col("number").cast("string"))
    li = F.concat(F.lit('<li id="fn-'), fid, F.lit('">'), X.inline(F.col("definition")), F.lit(' <a href="#fnref-'), fid, F.lit('" class="fnback" epub:type="backlink">↩</a></li>'))
    notes_ = refs.select("book", "chapter", F.lit(END).alias("page"), F.col("number").alias("block"), li.alias("body"))
    some = refs.select("book", "chapter").distinct()
    start, end = (some.select("book", "chapter", F.lit(END).alias("page"), F.lit(n).alias("block"), F.lit(t).alias("body")) for n, t in ((0, '<section class="endnotes" epub:type="footnotes"><hr/><ol>'), (END, "</ol></section>")))
    return whole.withColumn("block", F.col("block").cast("int")).unionByName(start).unionByName(notes_).unionByName(end)


def chapter_bodies(x: DataFrame, refs: DataFrame) -> DataFrame:
    """(book, chapter, body): the parts of each chapter as one value, for reading a chapter; files are written from the parts."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "block", "body"))), lambda s: s["body"]), "")
    return chapter_parts(x, refs).groupBy("book", "chapter").agg(whole.alias("body"))
