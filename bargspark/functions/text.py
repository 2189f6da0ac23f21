"""Text as Column expressions: nothing here leaves the JVM, so all of it stays inside whole-stage code generation and may be pushed or folded by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that splits words, as characters (a class of both Java's and RE2's expressions).
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x20), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WHITE, SOLID = f"[{SPACES}]", f"[^{SPACES}]"
# Letter folds of the page normaliser and of the word bags.
PERSIAN = ("يك", "یک")
BAG_FOLD = ("يكۀةأإآؤئ", "یکههاااوی")
KASHIDA, ZWNJ = "ـ", "‌"
DIGITS, CLOSERS, MARKS = "0-9٠-٩۰-۹", r"»\")”’\]}", "،؛؟"
JOINERS, VOWELS = "[\u200c\u200a\u00ad]", "[\u064b-\u0652\u0670]"
BAG_DROP = r"[\p{Nd}.,:;!?()\[\]{}«»،؛؟\-—_*#>`^\"'|/\\]+"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: inside lambdas an expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words between white space; null for null."""
    return F.filter(F.split(text, f"{WHITE}+"), lambda w: w != "")


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def normalize(text: Column) -> Column:
    """The conservative page normaliser, rule after rule: letter forms, kashida, runs of spaces, spaces beside the non-joiner, spacing of Persian marks, of full stops and colons away from digits, of guillemets, and line ends. Null stays null."""
    t = F.translate(text, PERSIAN[0] + KASHIDA, PERSIAN[1])
    # The rules of the page normaliser in their order; each sees what the one before left
    for pattern, to in (
        (r"[ \t]+", " "),
        (f" +{ZWNJ}", ZWNJ),
        (f"{ZWNJ} +", ZWNJ),
        (rf"[ \t]+([{MARKS}])", "$1"),
        (rf"([{MARKS}])[ \t]*(?=[^{SPACES}{CLOSERS}])", "$1 "),
        (rf"(?<![{DIGITS}])[ \t]+(?=[.:])", ""),
        (rf"([.:])(?![{DIGITS}])[ \t]*(?=[^{SPACES}{DIGITS}{CLOSERS}])", "$1 "),
        (r"«[ \t]+", "«"),
        (r"[ \t]+»", "»"),
        (r"[ \t]+(?=\n|\z)", ""),
    ):
        t = F.regexp_replace(t, pattern, to)
    return t


def bag_words(text: Column) -> Column:
    """Words of two or more letters, the letters of each sorted: equal for words whose letters an extractor reordered."""
    t = F.regexp_replace(F.regexp_replace(text, JOINERS, " "), VOWELS + "+", "")
    t = F.regexp_replace(F.translate(t, BAG_FOLD[0] + KASHIDA, BAG_FOLD[1]), BAG_DROP, " ")
    long = F.filter(words(t), lambda w: F.length(w) >= 2)
    return F.transform(long, lambda w: F.array_join(F.array_sort(F.split(w, "")), ""))


def bag(text: Column) -> Column:
    """array<struct<w, n>>: each bag word once with its count, in order. One sort of the text's words; no explode, no shuffle."""
    return let(F.array_sort(bag_words(text)), runs)


def runs(ordered: Column) -> Column:
    """The runs of a sorted array: each place where a run ends, less the one before."""
    n = F.size(ordered)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i == n) | ((i < n) & (F.get(ordered, i) != F.get(ordered, i - 1))))
    return let(ends, lambda e: F.transform(e, lambda x, i: F.struct(F.get(ordered, x - 1).alias("w"), (x - F.coalesce(F.get(e, i - 1), F.lit(0))).alias("n"))))


def count_of(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))  # whole runs: one replacement each


def heading_lines(text: Column) -> Column:
    """The texts of lines with one to three number signs, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)(?d)^#{1,3} (.+)$"), F.lit(1)), strip)


def countable(text: Column) -> Column:
    """Number of characters that are also in print: no notes' marks, Markdown signs and white space."""
    t = F.regexp_replace(text, r"\[\^[^\]]{1,10}\]", "")
    return F.length(F.regexp_replace(F.regexp_replace(t, r"[#>*_`|~\[\]]+", ""), f"{WHITE}+", ""))


def slug(name: Column) -> Column:
    """A file name's stem as lower-case letters, digits and single hyphens; 'book' if nothing is left."""
    t = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9-]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(t, "^-+|-+$", ""), F.lit("")), F.lit("book"))


def safe_name(title: Column) -> Column:
    """A title as a file name: characters that file systems refuse become a hyphen, white space a single space."""
    t = F.regexp_replace(F.regexp_replace(title, r'[\\/:*?"<>|]+', "-"), f"{WHITE}+", " ")
    return F.coalesce(F.nullif(strip(t), F.lit("")), F.lit("book"))


def cap_words(text: Column, most: int = 5) -> Column:
    """The prefix of at most `most` words, characters as they are; a text of no more words is unchanged."""
    head = F.regexp_extract(text, f"^({WHITE}*{SOLID}+(?:{WHITE}+{SOLID}+){{0,{most - 1}}})", 1)
    return F.when(F.size(words(text)) <= most, text).otherwise(head)


def occurrences(text: Column, part: Column) -> Column:
    """All 0-based places where `part` starts, overlapping ones too; [0] for an empty part."""
    last = F.length(text) - F.length(part)
    spots = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i <= last) & (F.substring(text, i + 1, F.length(part)) == part))
    return F.when(F.length(part) == 0, F.array(F.lit(0))).otherwise(spots)


def has_arabic(word: Column) -> Column:
    return word.rlike("[؀-ۿ]")


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def inline(text: Column) -> Column:
    """Markup-safe text with bold and emphasis as elements."""
    t = F.regexp_replace(escape(text), r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(t, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "<em>$1</em>")


def script_json(value: Column) -> Column:
    """JSON that may stand inside a script element: no less-than sign is left as such."""
    return F.replace(F.to_json(value), F.lit("<"), F.lit("\\u003c"))
