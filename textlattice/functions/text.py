"""Column expressions over text: no Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from textlattice.functions import patterns as P


def strip(x: Column) -> Column:
    """Unicode white space off both ends, as Python's str.strip()."""
    return F.btrim(x, F.lit(P.WHITE_SPACE))


def is_blank(x: Column) -> Column:
    return strip(x) == ""


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, rf"{P.WS}+", " "))


def word_list(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(f"({P.WORD})"), F.lit(1))


def word_count(x: Column) -> Column:
    """ASCII letter-digit runs that no other word character touches."""
    return F.regexp_count(x, F.lit(P.WORD)).cast("long")


def sentences(x: Column) -> Column:
    """Sentences, abbreviations kept whole. Between two none is blank and none has white space at its ends."""
    return F.filter(F.split(strip(x), P.SENTENCE, -1), lambda s: s != "")


def sentence_count(x: Column) -> Column:
    """0 for a blank text, else one more than its boundaries."""
    return F.when(is_blank(x), 0).otherwise(F.regexp_count(strip(x), F.lit(P.BOUNDARY)) + 1).cast("long")


def paragraphs(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, rf"\n{P.WS}*\n", -1), strip), lambda p: F.length(p) >= 3)


def clauses(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, P.CLAUSE, -1), strip), lambda c: c != "")


def newlines(x: Column) -> Column:
    return F.regexp_replace(x, "\r\n?", "\n")


def strip_boilerplate(x: Column) -> Column:
    """What stands after the first start marker line, and before the first end marker line after it."""
    after = F.split(x, f"(?imd){P.START_MARK}", 2)
    body = F.when(F.size(after) > 1, after[1]).otherwise(x)
    return F.split(body, f"(?imd){P.END_MARK}", 2)[0]


def normalise_blank_lines(x: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(x, "\n[ \t]+\n", "\n\n"), "\n{3,}", "\n\n"))


def each(df: DataFrame, keep: list, array: Column, at: str, item: str) -> DataFrame:
    """keep, and a row for each element of the array with its place (from 0).

    An outer generator, whose empty row then goes: for an inner one the optimizer adds a filter on the array's size
    below it, which works the whole array out a second time.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())


def lines(x: Column) -> Column:
    """Lines as Python's str.splitlines() sees them."""
    ends = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(x, rf"(?:{ends})\z", ""), ends, -1))


def html_to_text(x: Column) -> Column:
    """Tags out by pattern: ends of blocks and line breaks become blank lines; character references are dropped."""
    t = F.regexp_replace(x, r"(?i)</(?:p|div|h[1-6]|section|article|pre)>|<br\s*/?>", "\n\n")
    t = F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"&(?:#\d+|#x[\da-fA-F]+|[a-zA-Z]+);", " ")
    return F.array_join(F.transform(lines(t), strip), "\n")


def closed_references(x: Column) -> Column:
    """Markup in which only character references that end with a semicolon are ones; parsers of HTML know some without it, as in a title that is cut off."""
    return F.regexp_replace(x, r"&(?!(?:#[0-9]+|#x[0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)", "&amp;")


def bare_urls(x: Column) -> Column:
    return F.regexp_count(x, F.lit(rf"(?U)(?i)(?<!{P.WORD_CHAR}){P.BARE_URL}")).cast("long")


def ratio(w: Column, n: Column) -> Column:
    """w / n for whole numbers, rounded to 2 places as Python's round() does: by the exact binary value."""
    w, n = w.cast("long"), n.cast("long")
    hundred, x = w * 100, w.cast("double") / n
    q = F.call_function("div", hundred, n)
    r2 = (hundred - q * n) * 2
    p = F.call_function("shiftleft", F.lit(1).cast("long"), (F.lit(52) - F.floor(F.log2(x))).cast("int"))
    m = (x * p).cast("long") * 200
    edge = (q * 2 + 1) * p
    up = F.when(r2 > n, 1).when(r2 < n, 0).when(m > edge, 1).when(m < edge, 0).otherwise(q % 2)
    return F.when(w == 0, 0.0).otherwise((q + up) / 100.0)


# ---- opening contents pages

_ENTRY = rf"(?iu)\A{P.CONTENTS_ENTRY}\z"
_LABEL = rf"(?i)\A{P.CONTENTS_LABEL}\z"


def _is_entry(block: Column) -> Column:
    """Every line is short, not a sentence, and looks like a line of a table of contents."""
    ok = F.forall(lines(block), lambda l: (F.length(l) <= 100) & (F.size(F.split(collapse(l), " ")) <= 12) & ~l.rlike(r"[!?]|[a-z]\.(?:\s|\z)") & strip(l).rlike(_ENTRY))
    return (F.size(lines(block)) > 0) & ok


def _entry_key(line: Column) -> Column:
    """A line without its page number; of a numbered one only the word and number."""
    x = F.lower(strip(F.regexp_replace(line, P.CONTENTS_PAGE, "")))
    number = F.regexp_extract(x, rf"\A{P.CONTENTS_NUMBER}{P.WORD_CHAR}+", 0)
    return F.coalesce(F.nullif(number, F.lit("")), x)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def _contents_end(rest: Column) -> Column:
    """Of the blocks after a contents page's label (stripped): how many the page takes; 0 or less where it is none."""

    def fold(facts: Column) -> Column:
        start = F.struct(F.lit(0).alias("cut"), F.lit(0).alias("entries"), F.array().cast("array<string>").alias("seen"))

        def step(s: Column, j: Column) -> Column:
            now, nxt = F.get(facts, j - 1), F.get(facts, j)
            again = (now["n"] == 1) & now["entry"] & ~now["paged"] & F.coalesce(nxt["full"] & ~nxt["entry"], F.lit(False)) & (s["entries"] >= 2) & F.array_contains(s["seen"], F.get(now["keys"], F.lit(0)))
            end = F.when(again, j).when(~now["entry"], F.when(s["entries"] >= 2, j).otherwise(-1)).otherwise(0)
            more = (s["cut"] == 0) & (end == 0)
            return F.struct(
                F.when(s["cut"] != 0, s["cut"]).otherwise(end).alias("cut"), F.when(more, s["entries"] + now["n"]).otherwise(s["entries"]).alias("entries"),
                F.when(more, F.concat(s["seen"], now["keys"])).otherwise(s["seen"]).alias("seen"),
            )

        steps = F.when(F.size(facts) > 0, F.sequence(F.lit(1), F.size(facts))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda s: s["cut"])

    fact = lambda c: F.struct(_is_entry(c).alias("entry"), F.size(lines(c)).alias("n"), F.transform(lines(c), _entry_key).alias("keys"), c.rlike(P.CONTENTS_PAGE).alias("paged"), (c != "").alias("full"))
    # what comes after the first block that is no entry decides nothing; it nearly always is among the first
    other = F.array_position(F.transform(F.slice(rest, 1, 64), _is_entry), F.lit(False)).cast("int")
    return let(other, lambda n: let(F.transform(F.when(n > 0, F.slice(rest, F.lit(1), n)).otherwise(rest), fact), fold))


def strip_contents(x: Column) -> Column:
    """Removes a labelled opening contents page: one pass over the blocks after the label, carrying what has been listed.

    Only short title lines may stand before the label, and at least two entries must follow. The body begins at the
    first block that is no entry, or where a listed heading comes again before prose.
    """
    short = lambda p: (F.size(F.split(collapse(p), " ")) <= 12) & ~p.rlike(r"[.!?]")

    def body(b: Column) -> Column:
        label = F.array_position(F.transform(F.slice(b, 1, 10), lambda p: strip(p).rlike(_LABEL)), F.lit(True)).cast("int")

        def end(at: Column) -> Column:
            plain = F.forall(F.slice(b, F.lit(1), F.greatest(at - 1, F.lit(0))), short)
            return F.when((at > 0) & plain, let(F.transform(F.slice(b, at + 1, F.size(b)), strip), lambda rest: F.struct(at.alias("at"), _contents_end(rest).alias("n"))))

        return let(let(label, end), lambda e: F.when(e["n"] > 0, F.array_join(F.slice(b, e["at"] + e["n"], F.size(b)), "\n\n")))

    labelled = x.rlike(rf"(?i)(?:\A|\n\n){P.WS}*{P.CONTENTS_LABEL}{P.WS}*(?:\n\n|\z)")  # most texts end here
    return F.when(labelled, F.coalesce(let(F.split(x, "\n\n", -1), body), x)).otherwise(x)


def preprocess(x: Column) -> Column:
    """A book's own text: newlines, license boundaries, blank lines, an opening contents page."""
    return strip_contents(normalise_blank_lines(strip_boilerplate(newlines(x))))


# ---- Markdown inlines


def md_plain(x: Column) -> Column:
    """What is seen of Markdown inlines: the text of links; neither addresses, images nor footnote marks."""
    for kind, keep in P.MARKDOWN_SHOWS:
        x = F.regexp_replace(x, f"(?U){P.MARKDOWN[kind]}", keep.replace("\\1", "$1"))
    return collapse(x)


def md_links(x: Column) -> Column:
    """Inline links, reference links, autolinks, then bare addresses outside images: each kind is taken out before the next."""
    n = F.lit(0).cast("long")
    for kind in ("inline_link", "reference_link", "autolink"):
        n += F.regexp_count(x, F.lit(f"(?U){P.MARKDOWN[kind]}"))
        x = F.regexp_replace(x, f"(?U){P.MARKDOWN[kind]}", " ")
    return n + bare_urls(F.regexp_replace(x, P.MARKDOWN["image"], " "))
