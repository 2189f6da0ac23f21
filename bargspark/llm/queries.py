"""The queries of this subpackage: name -> function of (spark, folder of tables)."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import denoise, encode, leakage, repeated, split, truncation, visual, vocabulary
from .common import keep, read, spread

PAGE = ("rec_id", "book", "origin", "text_md")


def p1_found(spark, d):
    return visual.pairs(_values(spark, d))


def _values(spark, d):
    return visual.values(read(spark, d, "page_text", "rec_id", "book", "text_md"), read(spark, d, "page_fields", "rec_id", "book", "headings"))


def p1_consistent(spark, d):
    """(field, rec_id, value, member): every text and array of headings in its one form, and the least record of the book that looks the same."""
    vals = _values(spark, d).dropDuplicates(["field", "rec_id"])
    once = visual.members(_values(spark, d)).select("field", "rec_id", "member").distinct()
    out = visual.with_canonical(spread(vals)).select("field", "rec_id", F.translate("mapped", visual.BETWEEN, "\n").alias("value"))
    return out.join(once, ["field", "rec_id"], "left").withColumn("member", F.coalesce("member", "rec_id"))


def p1_classes(spark, d):
    return visual.classes(_values(spark, d))


def p2_found(spark, d):
    return vocabulary.cases(read(spark, d, "page_fields", "rec_id", "flags"), read(spark, d, "qc_reports", "report_id", "issues"), read(spark, d, "vocab_ref"))


def p2_mapping(spark, d):
    """(field, value, code): every distinct typed value and its code, unmatched ones with an empty code."""
    typed = vocabulary.entries(read(spark, d, "page_fields", "rec_id", "flags"), read(spark, d, "qc_reports", "report_id", "issues"))
    return vocabulary.mapping(typed, read(spark, d, "vocab_ref")).select("field", "value", "code")


def _noise(spark, d):
    return denoise.noise(read(spark, d, "page_text", "rec_id", "book", "page", "origin", "text_md"), *_layout(spark, d))


def _layout(spark, d):
    return read(spark, d, "books", "book", "title_fa", "source_type"), read(spark, d, "chapters", "book", "title")


def p3_found(spark, d):
    return _noise(spark, d)[0]


def p3_paragraphs(spark, d):
    """(book, page, n, to_page, text): the continuous paragraphs of the scanned and mixed books."""
    found, fixed = _noise(spark, d)
    pages = read(spark, d, "page_text", "rec_id", "book", "page", "attempt", "origin", "text_md")
    found = found.unionByName(repeated.repeated(pages).withColumn("kind", F.lit("origin_line")))
    return denoise.paragraphs(pages, read(spark, d, "page_fields", "rec_id", "starts_mid_paragraph", "continues_next"), found, fixed, read(spark, d, "books", "book", "source_type"))


def _truncated(spark, d):
    pages = read(spark, d, "page_text", "rec_id", "book", "page", "origin", "text_md")
    books, chapters = _layout(spark, d)
    titles = keep(denoise.titles_of(books, chapters), "p4-titles")
    lines, edges = denoise.lines_and_edges(pages, books, denoise.Titles(titles))
    left = repeated.repeated(pages, all_lines=lines).unionByName(denoise.furniture(edges, titles).select("rec_id", "line_no"))
    return truncation.truncated(pages, read(spark, d, "page_fields", "rec_id", "starts_mid_paragraph", "continues_next"), left)


def p4_found(spark, d):
    return _truncated(spark, d).select("rec_id")


def p4_shares(spark, d):
    """(origin, records, truncated, share): how often each origin truncates."""
    return truncation.shares(read(spark, d, "page_text", "rec_id", "origin"), _truncated(spark, d))


def p4_reasons(spark, d):
    """(rec_id, origin, why, terminality): each truncated record with the first reason that holds and the terminality of its closing word."""
    return _truncated(spark, d)


def p5_found(spark, d):
    return repeated.repeated(read(spark, d, "page_text", *PAGE))


def p5_without(spark, d):
    """(rec_id, n_cut, text_md): every record without the lines repeated within its origin."""
    pages = read(spark, d, "page_text", *PAGE)
    return repeated.without(pages, repeated.repeated(pages)).select("rec_id", "n_cut", "text_md")


def p5_chunks(spark, d):
    """(rec_id, n_cut, text): every record, in canonical characters, without the chunks repeated within its origin, however they are wrapped into lines."""
    pages = read(spark, d, "page_text", *PAGE)
    return repeated.without_chunks(pages, repeated.repeated_chunks(pages))


def p6_ids(spark, d):
    return encode.encode(read(spark, d, "documents", "doc_id", "text"))


def p7_found(spark, d):
    return leakage.leaked(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "eval_items", "item_id", "text"))


def p7_cleaned(spark, d):
    return leakage.cleaned(read(spark, d, "documents", "doc_id", "text"), read(spark, d, "eval_items", "item_id", "text"))


def p8_found(spark, d):
    return split.pieces(read(spark, d, "documents", "doc_id", "text"), with_text=False).where("piece = 2").select("doc_id")


def p8_pieces(spark, d):
    return split.pieces(read(spark, d, "documents", "doc_id", "text"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {}
