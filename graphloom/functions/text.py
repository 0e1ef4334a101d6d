"""Text expressions: sentences, chunks, clean-up, markup, names, masks and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)^\s+|\s+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(text) -> Column:
    """All Unicode white space trimmed."""
    return F.regexp_replace(_c(text), SPACE, "")


def key(text) -> Column:
    """Lower case, trimmed."""
    return F.lower(trimmed(text))


def sentences(text) -> Column:
    """Cut after ``! ? .`` but not at a full stop between two digits; trimmed; one byte or less goes."""
    parts = F.split(F.coalesce(_c(text), F.lit("")), r"(?<=[!?])|(?<=[.])(?<![0-9][.](?=[0-9]))", -1)
    return F.filter(F.transform(parts, lambda s: trimmed(s)), lambda s: F.octet_length(s) > 1)


def packed(parts, limit: int = 512) -> Column:
    """Neighbours joined by a space while a chunk holds at most ``limit`` bytes; a longer sentence stays whole."""
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, s: Column) -> Column:
        fits = F.octet_length(a["open"]) + 1 + F.octet_length(s) <= limit
        empty = a["open"] == ""
        return F.struct(
            F.when(empty, s).when(fits, F.concat(a["open"], F.lit(" "), s)).otherwise(s).alias("open"),
            F.when(empty | fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))).alias("done"),
        )

    return F.aggregate(_c(parts), state, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def chunks(text, limit: int = 512) -> Column:
    return packed(sentences(text), limit)


def cleaned(text) -> Column:
    """No carriage returns and controls, form feeds as blank lines, at most two line breaks and one blank in a row, trimmed."""
    t = F.regexp_replace(_c(text), "\r", "")
    t = F.regexp_replace(t, "\f", "\n\n")
    t = F.regexp_replace(t, r"[\x00-\x08\x0B\x0E-\x1F\x7F]", "")
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return trimmed(t)


def pages(text) -> Column:
    """``array<struct<page, text>>``, cut at form feeds; blank pages are numbered but not returned."""
    parts = F.transform(F.split(_c(text), "\f", -1), lambda p, i: F.struct((i + 1).alias("page"), trimmed(p).alias("text")))
    return F.filter(parts, lambda p: p["text"] != "")


def _joined(parts: Column, limit: int, glue: str) -> Column:
    """Neighbours joined by ``glue`` while they hold at most ``limit`` bytes; a longer part stays whole."""
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, s: Column) -> Column:
        new = (a["open"] != "") & (F.octet_length(a["open"]) + F.octet_length(s) + len(glue) > limit)
        return F.struct(
            F.when(new | (a["open"] == ""), s).otherwise(F.concat(a["open"], F.lit(glue), s)).alias("open"),
            F.when(new, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
        )

    return F.aggregate(parts, state, step, lambda a: F.when(a["open"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["open"]))))


def long_sentences(text: Column) -> Column:
    """Sentences of more than ten bytes: a shorter one stays with what follows; trimmed."""
    parts = F.filter(F.split(text, r"(?<=[!?])|(?<=[.])(?<![0-9][.](?=[0-9]))", -1), lambda s: s != "")
    state = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, s: Column) -> Column:
        whole = F.concat(a["open"], s)
        ends = F.rlike(s, F.lit(r"[.!?]\z")) & (F.octet_length(whole) > 10)
        return F.struct(F.when(ends, "").otherwise(whole).alias("open"), F.when(ends, F.concat(a["done"], F.array(trimmed(whole)))).otherwise(a["done"]).alias("done"))

    return F.aggregate(parts, state, step, lambda a: F.when(trimmed(a["open"]) == "", a["done"]).otherwise(F.concat(a["done"], F.array(trimmed(a["open"])))))


def document_chunks(text, limit: int = 512) -> Column:
    """Chunks of ``limit`` bytes: whole pages, else whole paragraphs, else sentences; nothing is joined over a page's end.

    A paragraph above the limit is cut into sentences on its own; a longer sentence stays whole.
    """
    # runs of paragraphs that fit, and long paragraphs alone, in order
    long = lambda p: F.octet_length(p) > limit
    paragraphs = lambda page: F.filter(F.transform(F.split(page, "\n\n", -1), lambda p: trimmed(p)), lambda p: p != "")
    state = F.struct(F.array().cast("array<string>").alias("run"), F.array().cast("array<string>").alias("done"))

    def step(a: Column, p: Column) -> Column:
        closed = F.concat(a["done"], _joined(a["run"], limit, "\n\n"))
        return F.when(long(p), F.struct(F.array().cast("array<string>").alias("run"), F.concat(closed, _joined(long_sentences(p), limit, " ")).alias("done"))).otherwise(
            F.struct(F.concat(a["run"], F.array(p)).alias("run"), a["done"].alias("done"))
        )

    of_page = lambda t: F.when(~long(t), F.array(t)).otherwise(F.aggregate(paragraphs(t), state, step, lambda a: F.concat(a["done"], _joined(a["run"], limit, "\n\n"))))
    return F.flatten(F.transform(pages(text), lambda p: of_page(p["text"])))


def stripped_html(text) -> Column:
    """Tags removed, then entities decoded in this order."""
    t = F.regexp_replace(_c(text), "<[^>]*>?", "")
    # Entity and character.
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def truncated(text, limit: int) -> Column:
    """At most ``limit`` bytes, cut at a character, then ``...``."""
    # the longest prefix whose bytes fit: characters are at least one byte, so at most `limit` of them
    head = F.substring(_c(text), 1, limit)
    sizes = F.aggregate(
        F.split(head, ""), F.struct(F.lit(0).alias("bytes"), F.lit(0).alias("chars")),
        lambda a, ch: F.when(a["bytes"] + F.octet_length(ch) <= limit, F.struct((a["bytes"] + F.octet_length(ch)).alias("bytes"), (a["chars"] + F.least(F.length(ch), F.lit(1))).alias("chars"))).otherwise(F.struct(F.lit(2**31 - 1 - 8).alias("bytes"), a["chars"].alias("chars"))),
        lambda a: a["chars"],
    )
    return F.when(F.octet_length(_c(text)) <= limit, _c(text)).otherwise(F.concat(F.substring(_c(text), F.lit(1), sizes), F.lit("...")))


def wikilinks(text) -> Column:
    """Link targets before ``|`` and ``#``, first seen first."""
    found = F.regexp_extract_all(_c(text), F.lit(r"\[\[([^\]\[]+)\]\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: trimmed(F.regexp_replace(t, r"[|#].*$", ""))), lambda t: t != ""))


def tags(text) -> Column:
    """``#tags`` outside code fences, first seen first."""
    open_text = F.regexp_replace(_c(text), r"(?s)```.*?(```|$)", "")
    return F.array_distinct(F.regexp_extract_all(open_text, F.lit(r"(?:^|\s)#([\p{L}0-9_/-]*[\p{L}_][\p{L}0-9_/-]*)"), F.lit(1)))


def frontmatter(text) -> Column:
    """The block between leading ``---`` lines; empty if there is none."""
    return F.regexp_extract(_c(text), r"(?s)\A---\n(.*?)\n---(?:\n|\z)", 1)


def masked(secret) -> Column:
    """At most 8 characters become ``****``, longer ones keep the first 3 and last 4."""
    s = _c(secret)
    return F.when(F.length(s) <= 8, F.lit("****")).otherwise(F.concat(F.substring(s, 1, 3), F.lit("****"), F.substring(s, -4, 4)))


def partial_date(text) -> Column:
    """A date of year, year-month or year-month-day; null otherwise."""
    t = trimmed(text)
    full = F.when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), t).when(t.rlike(r"^[0-9]{4}-[0-9]{2}$"), F.concat(t, F.lit("-01"))).when(t.rlike(r"^[0-9]{4}$"), F.concat(t, F.lit("-01-01")))
    return F.try_to_timestamp(full, F.lit("yyyy-MM-dd")).cast("date")


def iso_seconds(text) -> Column:
    """S17 (Q29): seconds since 1970 of an ISO time, offset and fraction ignored; 0 if it does not parse."""
    head = F.substring(F.regexp_replace(trimmed(text), "T", " "), 1, 19)
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm:ss"))), F.lit(0)).cast("long")


def approximate_tokens(text) -> Column:
    """a quarter of the bytes, rounded up."""
    return F.ceil(F.octet_length(_c(text)) / 4).cast("long")


def entity_name(content) -> Column:
    """The first sentence, at most 60 characters."""
    return F.substring(F.coalesce(F.get(sentences(content), F.lit(0)), trimmed(content)), 1, 60)


def cost(input_tokens, output_tokens, price_in: float, price_out: float) -> Column:
    """Tokens in thousands x price."""
    return _c(input_tokens) / 1000.0 * price_in + _c(output_tokens) / 1000.0 * price_out


def glob(pattern: str) -> str:
    """F16: the regular expression of a path pattern with ``*``, ``**`` and ``?``."""
    import re

    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = pattern[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c)), i + 1
    return f"^{out}$"
