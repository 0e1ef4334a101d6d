"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Base spans come from one expression per kind.  Their values are the seeds: the words before and
after a span are a lexical pattern of its kind.  Patterns and identifier-like instances form a
bipartite graph that is scored in turns - a pattern by the mean score of the instances it
extracts, smoothed, an instance by one minus the product of its patterns' doubts - and instances
that the base expressions do not know, but that confident patterns extract, are added as spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import broadcast_if_small, checkpointed, chunked, let, running

#: The base expressions.  Lookbehinds and possessive runs change no match; they keep long runs linear and off the matcher's stack.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SIGNS = r"[\p{L}0-9._%+@/:#-]"
#: Runs of signs and letters, brackets inside; plain words are passed over.
RUN = rf"(?<![^\s\"'(<\[])(?=\p{{L}}*+[0-9._%+@/:#(\[-]){_SIGNS}++(?:[(\[]{_SIGNS}++[)\]]{_SIGNS}++)*+"
#: Identifier-like tokens that a pattern may extract hold a digit, ``@``, ``_``, or a dot or bracket inside.
INSTANCE = r"[0-9@_]|\p{L}[.(\[]\p{L}"
CONTEXT = 24  # characters on either side in which the neighbouring words are sought
SEGMENT = 1_024
ROUNDS, MIN_PATTERN, MIN_SUPPORT, MIN_INSTANCE = 3, 0.8, 3, 0.9


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.filter(F.split(F.reverse(_digits(value)), ""), lambda d: d != "")
    twice = lambda d, i: F.when(i % 2 == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    return F.aggregate(F.transform(F.transform(digits, lambda d: d.cast("int")), twice), F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.split(value, r"\.")
        # more than 15 digits after leading zeros are above 255 anyway
        return F.forall(parts, lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(parts, lambda p: F.substring(F.concat(F.lit("000"), p), -3, 3).cast("int") <= 255)
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def spans(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of the matches, leftmost and non-overlapping, in code points.

    The pieces between the matches give their places.
    """
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    sized = lambda c: F.zip_with(c["m"], F.slice(c["p"], F.lit(1), F.size(c["m"])), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("gap"), F.length(m).alias("n")))
    place = lambda x, at: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["m"].alias("value"))
    return let(let(cut, sized), lambda z: F.zip_with(z, running(F.transform(z, lambda x: x["gap"] + x["n"])), place))


def _named(found: Column, kind: str, number: int) -> Column:
    kept = F.filter(found, lambda s: _holds(kind, s["value"]))
    return F.transform(kept, lambda s: F.struct(F.lit(number).alias("n"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda b: b["kind"] == kind)).cast("long").alias(f"n_{kind}")


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, text_hash, text, base``, with ``base`` an array of (kind number, kind, start, end, value)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signs = {"email": "@", "ip": ".", "phone": "+"}
    for number, (kind, pattern) in enumerate(KINDS.items()):
        # what a text cannot hold is not sought: each match needs its sign, and all but e-mail a digit
        may = F.contains("text", F.lit(signs[kind])) if kind in signs else F.lit(True)
        may &= F.lit(True) if kind == "email" else F.rlike("text", F.lit("[0-9]"))
        rows = rows.withColumn(f"_{kind}", F.when(may, _named(spans(F.col("text"), pattern), kind, number)).otherwise(F.array()))
    return rows.select("id", "text_hash", "text", F.concat(*[F.col(f"_{k}") for k in KINDS]).alias("base"))


def _context(segments: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The last word before and the first word after a span, lower case; ``^`` and ``$`` where there is none.

    ``segments``: the text in parts of ``SEGMENT`` characters, so that no place is counted from the text's begin.
    """
    part = lambda k: F.coalesce(F.get(segments, k), F.lit(""))
    k, e = F.floor(start / SEGMENT).cast("int"), F.floor(end / SEGMENT).cast("int")
    left = F.concat(part(k - 1), F.substring(part(k), F.lit(1), start - k * SEGMENT))
    right = F.substring(F.concat(part(e), part(e + 1)), end - e * SEGMENT + 1, F.lit(CONTEXT))
    before = F.lower(F.regexp_extract(F.right(left, F.lit(CONTEXT)), r"([\p{L}]+[^\p{L}\n]*)$", 1))
    after = F.lower(F.regexp_extract(right, r"^([^\p{L}\n]*[\p{L}]+)", 1))
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, r"[0-9]+", "0"), r"\s+", " ")
    return F.when(before == "", "^").otherwise(tidy(before)), F.when(after == "", "$").otherwise(tidy(after))


def _untouched(runs: Column, base: Column) -> Column:
    """The runs that no base span overlaps; base spans are passed over by slices."""
    reach = lambda p: F.struct(F.array_min(F.transform(p, lambda b: b["start"])).alias("lo"), F.array_max(F.transform(p, lambda b: b["end"])).alias("hi"), p.alias("all"))
    meets = lambda s, b: (b["start"] < s["end"]) & (b["end"] > s["start"])
    parts = F.coalesce(F.transform(chunked(base, 64), reach), F.array().cast("array<struct<lo:int,hi:int,all:array<struct<n:int,kind:string,start:int,end:int,value:string>>>>"))
    return let(parts, lambda ps: F.filter(runs, lambda s: ~F.exists(ps, lambda p: (p["lo"] < s["end"]) & (p["hi"] > s["start"]) & F.exists(p["all"], lambda b: meets(s, b)))))


def discovered(found: DataFrame, rounds: int = ROUNDS, min_pattern: float = MIN_PATTERN, min_support: int = MIN_SUPPORT, min_instance: float = MIN_INSTANCE) -> DataFrame:
    """``id, text_hash, start, end, kind`` of identifiers that confident patterns extract and no base span touches.

    Three patterns stand for a place: the words on either side, and each side alone.  Scores are
    kept per distinct (pattern, value), counted before any join, so a common pattern or value is
    one row however often it occurs.
    """
    may = F.rlike("text", F.lit(INSTANCE))
    runs = F.filter(spans(F.col("text"), RUN), lambda s: F.rlike(s["value"], F.lit(INSTANCE)))
    # the end mark of a sentence is no part of an identifier without digits
    tidy = lambda v: F.when(F.rlike(v, F.lit("[0-9]")), v).otherwise(F.regexp_replace(v, r"[^\p{L}]+$", ""))
    runs = F.transform(runs, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(tidy(s["value"]))).alias("end"), tidy(s["value"]).alias("value"), F.lit(None).cast("string").alias("known")))
    unknown = _untouched(F.when(may, runs).otherwise(F.array()), F.col("base"))
    seeds = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["value"].alias("value"), b["kind"].alias("known")))

    def near(segments: Column, s: Column) -> Column:
        before, after = _context(segments, s["start"], s["end"])
        return F.struct(*[s[x].alias(x) for x in ("start", "end", "value", "known")], F.struct(before.alias("b"), after.alias("a")).alias("near"))

    tokens = F.concat(seeds, unknown)
    # the text is dropped before a row becomes a row a token
    placed = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0)), lambda segments: F.transform(tokens, lambda s: near(segments, s)))
    placed = found.where((F.size("base") > 0) | may).select("id", "text_hash", placed.alias("tokens")).select("id", "text_hash", F.explode("tokens").alias("s")).select("id", "text_hash", "s.*")
    placed = checkpointed(placed)
    b, a = F.col("near.b"), F.col("near.a")
    each = placed.select("value", "known", F.explode(F.array(F.concat(F.lit("<"), b), F.concat(F.lit(">"), a), F.concat(b, F.lit(" _ "), a))).alias("pattern")).where(~F.col("pattern").isin("<^", ">$", "^ _ $"))
    graph = checkpointed(each.groupBy("pattern", "value").agg(F.max("known").alias("known"), F.count(F.lit(1)).alias("n")))
    # the kind of a pattern is that of most of its seeds
    kinds = graph.where("known is not null").groupBy("pattern", "known").agg(F.count(F.lit(1)).alias("seeds"))
    kinds = kinds.groupBy("pattern").agg(F.max_by("known", F.struct("seeds", "known")).alias("kind"), F.sum("seeds").alias("seeds")).where(F.col("seeds") >= min_support)
    scored = checkpointed(graph.join(kinds, "pattern"))
    instances = scored.select("value", "known").groupBy("value").agg(F.when(F.max("known").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    for _ in range(rounds):
        patterns = scored.join(instances.select("value", "score"), "value").groupBy("pattern", "kind").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("trust"))
        doubt = F.when(F.col("trust") >= min_pattern, F.log1p(-F.least("trust", F.lit(0.999)))).otherwise(0.0)
        strong = scored.join(patterns, ["pattern", "kind"]).groupBy("value").agg(F.max("known").alias("known"), F.sum(doubt).alias("doubt"), F.max_by("kind", F.struct("trust", "kind")).alias("kind"))
        instances = checkpointed(strong.select("value", "kind", F.when(F.col("known").isNotNull(), 1.0).otherwise(1 - F.exp("doubt")).alias("score")))
    chosen = instances.where(F.col("score") >= min_instance).select("value", "kind")
    return placed.where("known is null").join(broadcast_if_small(chosen, 100_000), "value").select("id", "text_hash", "start", "end", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_discovered)``, one row per row of ``docs``.

    Counts and ``base_sha256`` are of base spans; ``spans`` holds base and discovered ones as
    kind:start:end (code points, end exclusive), by kind as listed, then start.  Null text is
    empty (no spans, the hash of an empty string).  Every row has the spans of its own text, also
    where its id is null or repeated.  The context of a span is sought in ``CONTEXT`` characters on
    either side; texts of any length are searched whole.  Other columns are ignored; an empty table
    gives an empty result.
    """
    found = base_spans(docs, id_col, text_col)
    more = discovered(found, **parameters).groupBy("id", "text_hash").agg(F.collect_set(F.struct("kind", "start", "end")).alias("more"))
    more = more.withColumnsRenamed({"id": "_id", "text_hash": "_hash"})
    rows = found.select("id", "text_hash", F.transform("base", lambda b: b.dropFields("value")).alias("base")).join(broadcast_if_small(more, 100_000), F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    order = F.create_map(*[x for n, k in enumerate(KINDS) for x in (F.lit(k), F.lit(n))])
    added = F.transform(F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>")), lambda s: F.struct(F.element_at(order, s["kind"]).alias("n"), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    text = lambda items: F.concat_ws(",", F.transform(F.array_sort(items), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    counted = [_count(k) for k in KINDS]
    place = lambda items: F.transform(items, lambda s: F.struct(s["n"].alias("n"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select(F.col("id").alias(id_col), *counted, F.sha2(text(place("base")), 256).alias("base_sha256"), text(place(F.concat("base", added))).alias("spans"), F.size(added).cast("long").alias("n_discovered"))
