"""The same operators as SQL for DuckDB, to hold results against. RE2 has no look-around: a private-use mark stands where a rule looks."""

from __future__ import annotations

from bargspark.functions import text as X

W = X.WHITE
MARK = ""
T = "t AS (SELECT DISTINCT rec_id, book, page, attempt, text_md FROM page_text)"
F = "f AS (SELECT DISTINCT rec_id, is_blank, headings, flags, starts_mid_paragraph, continues_next, confidence, model_used, resolution FROM page_fields)"
Q = "q AS (SELECT DISTINCT report_id, rec_id, verdict, issues, suggested_text_md FROM qc_reports)"
E = "e AS (SELECT DISTINCT ON (event_id) * FROM qc_events)"
#: Of the attempts at a page the last one that isn't blank.
LAST = "last AS (SELECT rec_id, book, page, text_md, starts_mid_paragraph, continues_next FROM t JOIN f USING (rec_id) WHERE text_md IS NOT NULL AND NOT coalesce(is_blank, false) QUALIFY row_number() OVER (PARTITION BY book, page ORDER BY attempt DESC, rec_id DESC) = 1)"


def rx(value: str, pattern: str, to: str = "") -> str:
    p = pattern.replace("'", "''")
    return f"regexp_replace({value}, '{p}', '{to}', 'g')"


def strip(x: str) -> str:
    return rx(x, f"^{W}+|{W}+$")


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{W}+'), lambda w: w <> '')"


def normalize(x: str) -> str:
    m, d, c, s = MARK, X.DIGITS, X.CLOSERS, X.SPACES
    t = f"translate({x}, '{X.PERSIAN[0]}{X.KASHIDA}', '{X.PERSIAN[1]}')"
    for p, to in (
        ("[ \t]+", " "), (f" +{X.ZWNJ}", X.ZWNJ), (f"{X.ZWNJ} +", X.ZWNJ),
        (f"[ \t]+([{X.MARKS}])", r"\1"), (f"([{X.MARKS}])", rf"\1{m}"), (rf"{m}[ \t]*([^{s}{c}])", r" \1"), (m, ""),
        ("([.:])", rf"{m}\1"), (rf"(^|[^{d} \t])[ \t]+{m}", r"\1"), (m, ""),
        ("([.:])", rf"\1{m}"), (rf"{m}[ \t]*([^{s}{d}{c}])", r" \1"), (m, ""),
        ("«[ \t]+", "«"), ("[ \t]+»", "»"), ("[ \t]+(\n|$)", r"\1"),
    ):
        t = rx(t, p, to)
    return t


def bag_words(x: str) -> str:
    t = rx(rx(x, X.JOINERS, " "), X.VOWELS)
    t = rx(f"translate({t}, '{X.BAG_FOLD[0]}{X.KASHIDA}', '{X.BAG_FOLD[1]}')", X.BAG_DROP, " ")
    return f"list_transform(list_filter(string_split_regex({t}, '{W}+'), lambda w: length(w) >= 2), lambda w: array_to_string(list_sort(string_split(w, '')), ''))"


def bag_table(name: str, source: str, keys: str, x: str) -> str:
    """CTE (keys, w, n)."""
    return f"{name} AS (SELECT {keys}, w, count(*) AS n FROM (SELECT {keys}, unnest({bag_words(x)}) AS w FROM {source}) GROUP BY ALL)"


def count_of(x: str, cls: str) -> str:
    return f"length({rx(x, f'[^{cls}]')})::INTEGER"


def countable(x: str) -> str:
    return "length(" + rx(rx(rx(x, r"\[\^[^\]]{1,10}\]"), r"[#>*_`|~\[\]]"), W) + ")::INTEGER"


def heading_lines(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '(?m)^#{{1,3}} (.+)$', 1), lambda h: {strip('h')})"


def bucket(c: str) -> str:
    return f"CASE WHEN {c} < 0.7 THEN '<0.7' WHEN {c} < 0.8 THEN '0.7-0.8' WHEN {c} < 0.9 THEN '0.8-0.9' WHEN {c} IS NOT NULL THEN '0.9-1.0' END"


def escape(x: str) -> str:
    return f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def inline(x: str) -> str:
    """Bold and emphasis as elements; stars beside other stars are put aside while single ones are sought."""
    t = rx(escape(x), r"\*\*(.+?)\*\*", r"<strong>\1</strong>")
    t = rx(rx(rx(t, r"\*\*", "\ue001\ue001"), "\ue001\\*", "\ue001\ue001"), "\\*\ue001", "\ue001\ue001")
    return f"replace({rx(t, r'\*(.+?)\*', r'<em>\1</em>')}, '\ue001', '*')"


def linked(html: str, first: str) -> str:
    """Text with its references to notes as numbered links; `first` is the number of its first one."""
    n = f"({first} + i - 2)"
    link = f"""'<a id="fnref-c' || chapter || '-' || {n} || '" href="#fn-c' || chapter || '-' || {n} || '" epub:type="noteref" class="fnref"><sup>' || {n} || '</sup></a>'"""
    return f"array_to_string(list_transform(string_split_regex({html}, '\\[\\^[^\\]]+\\]'), lambda s, i: CASE WHEN i = 1 THEN s ELSE {link} || s END), '')"


#: Over `cp` (blocks with their chapter) and `fn` (numbered references): the inner XHTML of each block.
def xhtml() -> str:
    body = lambda t: linked(inline(t), "first")
    cells = rf"list_transform(string_split({rx(strip('t'), chr(94) + r'\|+|\|+$')}, '|'), lambda c: {inline(strip('c'))})"
    row = f"array_to_string(list_transform(string_split({linked(f'array_to_string({cells}, chr(124))', 'first')}, '|'), lambda c: '<' || CASE WHEN item = 0 THEN 'th' ELSE 'td' END || '>' || c || '</' || CASE WHEN item = 0 THEN 'th' ELSE 'td' END || '>'), '')"
    cut = "strpos(t, ' --- ')"
    left, right = strip(f"substring(t, 1, {cut} - 1)"), strip(f"substring(t, {cut} + 5)")
    seen = f"len(regexp_extract_all({left}, '\\[\\^[^\\]]+\\]'))"
    verse = f"""CASE WHEN t = '' THEN '' WHEN {cut} > 0 THEN '<p class="v"><span class="m1">' || {body(left)} || '</span><span class="m2">' || {linked(inline(right), f'(first + {seen})')} || '</span></p>' ELSE '<p class="v"><span class="m-full">' || {body('t')} || '</span></p>' END"""
    return f"""st0 AS (SELECT rec_id, chapter, block, item, min(number) AS first FROM fn GROUP BY ALL),
    ea AS (SELECT rec_id, book, chapter, page, block, para, joined, kind, unnest(CASE WHEN len(items) > 0 THEN range(len(items)) ELSE [0] END)::INT AS item, unnest(CASE WHEN len(items) > 0 THEN items ELSE [NULL] END) AS t FROM cp),
    eb AS (SELECT ea.*, coalesce(first, 1) AS first FROM ea LEFT JOIN st0 USING (rec_id, chapter, block, item)),
    ec AS (SELECT *, CASE WHEN t IS NULL THEN '' WHEN kind = 'verse' THEN {verse} WHEN kind = 'table' THEN CASE WHEN item = 0 THEN '<thead><tr>' || {row} || '</tr></thead>' ELSE '<tr>' || {row} || '</tr>' END
      WHEN kind = 'quote' THEN '<p>' || {body('t')} || '</p>' WHEN kind IN ('ul', 'ol') THEN '<li>' || {body('t')} || '</li>' ELSE {body('t')} END AS html FROM eb),
    ed AS (SELECT rec_id, book, chapter, page, block, para, joined, kind, string_agg(html, '' ORDER BY item) AS i FROM ec GROUP BY ALL),
    xh AS (SELECT * EXCLUDE (i), CASE WHEN kind = 'verse' THEN '<div class="verse">' || i || '</div>' WHEN kind = 'table' AND i = '' THEN '' WHEN kind = 'table' THEN '<table>' || regexp_replace(i, '(?s)^(<thead>.*?</thead>)(.*)$', '\\1<tbody>\\2</tbody>') || '</table>'
      WHEN kind = 'quote' THEN '<blockquote>' || i || '</blockquote>' WHEN kind IN ('ul', 'ol', 'h1', 'h2', 'h3') THEN '<' || kind || '>' || i || '</' || kind || '>' ELSE i END AS html FROM ed)"""


#: Lines of the pages `src` with their kinds, as classified() has them.
def kinds(src: str, keys: str = "rec_id") -> str:
    return f"""ln AS (SELECT {keys}, line, raw, {strip('raw')} AS s FROM (SELECT {keys}, unnest(range(len(l))) AS line, unnest(l) AS raw FROM (SELECT {keys}, string_split(text_md, chr(10)) AS l FROM {src}))),
    lm AS (SELECT *, coalesce(last_value(CASE WHEN s = '```verse' THEN 1 WHEN s = '```' THEN 0 END IGNORE NULLS) OVER (PARTITION BY rec_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS inn FROM ln),
    kind AS (SELECT *, CASE WHEN inn AND s = '```' THEN 'fence' WHEN inn THEN 'verse' WHEN s = '' THEN 'blank' WHEN s = '```verse' THEN 'fence'
      WHEN starts_with(s, '### ') THEN 'h3' WHEN starts_with(s, '## ') THEN 'h2' WHEN starts_with(s, '# ') THEN 'h1'
      WHEN regexp_matches(s, '(?s)^\\[\\^([^\\]]+)\\]:\\s?(.*)$') THEN 'note' WHEN starts_with(s, '>') THEN 'quote' WHEN regexp_matches(raw, '^{W}*\\|') THEN 'table'
      WHEN regexp_matches(s, '^[-*]\\s+') THEN 'bullet' WHEN regexp_matches(s, '^\\p{{Nd}}+\\.\\s+') THEN 'number' ELSE 'p' END AS kind FROM lm)"""


def blocks(src: str, keys: str = "rec_id") -> str:
    cells = rf"list_transform(string_split({rx('s', chr(94) + r'\|+|\|+$')}, '|'), lambda c: {strip('c')})"
    return kinds(src, keys) + f""",
    bl AS (SELECT *, ((kind = 'fence' AND s = '```verse') OR kind IN ('h1','h2','h3','p') OR (kind IN ('quote','table','bullet','number') AND lag(kind) OVER w IS DISTINCT FROM kind)) AS opens FROM kind WINDOW w AS (PARTITION BY rec_id ORDER BY line)),
    bn AS (SELECT *, sum(opens::INT) OVER (PARTITION BY rec_id ORDER BY line) - 1 AS block,
      CASE WHEN kind = 'h1' THEN {strip('substring(s, 3)')} WHEN kind = 'h2' THEN {strip('substring(s, 4)')} WHEN kind = 'h3' THEN {strip('substring(s, 5)')}
        WHEN kind = 'quote' THEN nullif(regexp_replace(s, '^> ?', ''), '') WHEN kind = 'bullet' THEN regexp_replace(s, '^[-*]\\s+', '') WHEN kind = 'number' THEN regexp_replace(s, '^\\p{{Nd}}+\\.\\s+', '')
        WHEN kind = 'table' THEN CASE WHEN len(list_filter({cells}, lambda c: NOT regexp_matches(c, '^:?-+:?$'))) = 0 THEN NULL ELSE s END WHEN kind = 'fence' THEN NULL ELSE s END AS item FROM bl),
    block AS (SELECT {keys}, block::INT AS block, first(CASE kind WHEN 'fence' THEN 'verse' WHEN 'bullet' THEN 'ul' WHEN 'number' THEN 'ol' ELSE kind END ORDER BY line) AS kind,
      coalesce(list(item ORDER BY line) FILTER (WHERE item IS NOT NULL), []) AS items FROM bn WHERE kind IN ('h1','h2','h3','p','quote','table','bullet','number','verse') OR opens GROUP BY {keys}, block)"""


#: Over `last` and `block` (keys rec_id, book, page): the joined blocks.
STITCH = """ends AS (SELECT rec_id, arg_min(kind, block) AS first_kind, arg_max(kind, block) AS last_kind, min(block) AS fst, max(block) AS lst FROM block GROUP BY rec_id),
    pg AS (SELECT l.rec_id, l.book, l.page, starts_mid_paragraph AS sm, continues_next AS cn, first_kind, last_kind, fst, lst FROM last l LEFT JOIN ends USING (rec_id)),
    j AS (SELECT *, coalesce(lag(page) OVER w = page - 1 AND lag(cn) OVER w AND sm AND last_value(last_kind IGNORE NULLS) OVER o = 'p' AND first_kind = 'p', false) AS joins,
      last_value(CASE WHEN lst IS NOT NULL THEN concat_ws('.', rec_id, lst) END IGNORE NULLS) OVER o AS prev FROM pg
      WINDOW w AS (PARTITION BY book ORDER BY page), o AS (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    ch AS (SELECT *, coalesce(last_value(CASE WHEN lst IS NOT NULL THEN joins AND fst = lst END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS chained FROM j),
    hd AS (SELECT *, last_value(CASE WHEN joins AND NOT chained THEN prev END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page) AS head FROM ch),
    st AS (SELECT b.rec_id, b.book, b.page, b.block, b.kind, b.items, coalesce(h.head, concat_ws('.', b.rec_id, b.block)) AS para, h.head IS NOT NULL AS joined
      FROM block b LEFT JOIN (SELECT rec_id, fst, head FROM hd WHERE joins) h ON h.rec_id = b.rec_id AND h.fst = b.block),
    cp AS (SELECT *, sum((kind = 'h1')::INT) OVER (PARTITION BY book ORDER BY page, rec_id, block)::INT AS chapter FROM st)"""

#: A page as a printer might set it: a line of print for each line of text, words from the right edge.
PRINT = f"""pr AS (SELECT rec_id, line, raw, length({rx('raw', W)}) AS n FROM (SELECT rec_id, unnest(range(len(l)))::INT AS line, unnest(l) AS raw FROM (SELECT rec_id, string_split(text_md, chr(10)) AS l FROM t WHERE text_md IS NOT NULL))),
    pl AS (SELECT rec_id, line, n, (20 + 14 * line)::DOUBLE AS y0, (32 + 14 * line)::DOUBLE AS y1, (2000 - 4 * n)::DOUBLE AS x0, 2000::DOUBLE AS x1 FROM pr WHERE n >= 2),
    pw0 AS (SELECT rec_id, line, unnest(range(len(ws)))::INT AS word, unnest(ws) AS w FROM (SELECT rec_id, line, {words('raw')} AS ws FROM pr WHERE n >= 2)),
    pw AS (SELECT rec_id, line, word, length(w) AS chars, 2000 - 5 * (sum(length(w)) OVER o - length(w))::DOUBLE - word AS x1, 2000 - 5 * sum(length(w)) OVER o::DOUBLE - word AS x0, (20 + 14 * line)::DOUBLE AS y0, (32 + 14 * line)::DOUBLE AS y1 FROM pw0 WINDOW o AS (PARTITION BY rec_id, line ORDER BY word))"""
#: The snippets of findings that stand in their text as they are, in shares of its characters.
SPANS = f"""qs AS (SELECT rec_id, report_id * 100 + pos AS qid, i.snippet AS snippet FROM (SELECT rec_id, report_id, unnest(range(len(issues))) AS pos, unnest(issues) AS i FROM q)),
    sp AS (SELECT rec_id, qid, text_md, strpos(text_md, snippet) AS spot, length(snippet) AS n FROM qs JOIN t USING (rec_id) WHERE length(snippet) > 0 AND strpos(text_md, snippet) > 0),
    sh AS (SELECT rec_id, qid, {countable('substring(text_md, spot, n)')} AS chars, {countable('text_md')} AS total, {countable('substring(text_md, 1, spot - 1)')} AS a FROM sp),
    fr AS (SELECT rec_id, qid, chars, total, a::DOUBLE / total AS fa, (a + chars)::DOUBLE / total AS fb FROM sh WHERE total > 0)"""


def line_ranges(weight: str) -> str:
    return f"lr AS (SELECT *, sum({weight}) OVER p AS pwt, (sum({weight}) OVER o - {weight})::DOUBLE / sum({weight}) OVER p AS ls, (sum({weight}) OVER o)::DOUBLE / sum({weight}) OVER p AS le FROM pl WINDOW p AS (PARTITION BY rec_id), o AS (PARTITION BY rec_id ORDER BY round(y0, 1), x0, line))"


HITS = """hb AS (SELECT *, CASE WHEN le > fa AND ls < fb THEN 0 WHEN ls <= fa AND fa < le THEN 1 ELSE 2 END AS rank FROM fr JOIN (SELECT rec_id, line, ls, le, pwt FROM lr WHERE pwt > 0) USING (rec_id) WHERE pwt / total BETWEEN 0.5 AND 2.0),
    hm AS (SELECT *, row_number() OVER (PARTITION BY rec_id, qid ORDER BY CASE WHEN rank = 2 THEN abs((ls + le) / 2 - fa) ELSE 0.0 END, line) AS n FROM (SELECT * FROM hb QUALIFY rank = min(rank) OVER (PARTITION BY rec_id, qid))),
    ht AS (SELECT rec_id, qid, line, (greatest(fa, ls) - ls) / nullif(le - ls, 0) AS u0, (least(fb, le) - ls) / nullif(le - ls, 0) AS u1, least(fb, le) - greatest(fa, ls) AS overlap, chars FROM hm WHERE rank = 0 OR n = 1)"""
