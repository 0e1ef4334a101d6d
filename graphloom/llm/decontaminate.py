"""Benchmark decontamination by template windows, in DataFrame operations only.

Text becomes a sequence of template tokens: numbers, units after numbers and names (capitalised
words inside a sentence) turn into typed placeholders, other words are lower-cased.  Windows of
``WINDOW`` template tokens are hashed and joined with the benchmark's windows.  What matches is
aligned by its offset; a value of the item must stand for one value in the document, and windows
over placeholders that do not fit are dropped: a question with other numbers or names is still
found, a mere coincidence of shape is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import broadcast_if_small, checkpointed, let

WINDOW, MIN_WINDOW = 8, 3
MIN_WORDS = 4
MIN_COVERAGE = 0.3
BROADCAST_WINDOWS = 1_000_000
#: Units that may follow a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s ms sec min h hr hrs hour hours minute minutes second seconds day days week weeks month months year years mph kph hz khz mhz ghz b kb mb gb tb w kw mw kwh v a c f k percent degrees degree dollars dollar euros euro cents cent pounds pound meters metres meter metre kilometers kilometres miles mile inches inch feet foot grams gram kilograms kilogram liters litres liter litre".split()
#: A token, with the sentence mark and signs that stand before it if it begins a sentence.
#: Possessive runs: no other match is possible, and no run is too long for the matcher's stack.
TOKEN = r"(?:[.!?\n][^\p{L}0-9]*+)?(?:[0-9]++(?:[.,:/][0-9]++)*+|\p{L}[\p{L}\p{M}]*+)"


def _raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _typed(token: Column, at: Column) -> Column:
    """``n:`` + number, ``p:`` + name or ``w:`` + lower-case word."""
    first = F.substring(token, 1, 1)
    starts = first.isin(".", "!", "?", "\n")
    core = F.when(starts, F.regexp_replace(token, r"^[^\p{L}0-9]+", "")).otherwise(token)
    number = F.substring(token, -1, 1).between("0", "9")
    second = F.substring(token, 2, 1)
    # a word in capitals throughout is shouted, not a name
    capital = (F.upper(first) == first) & (F.lower(first) != first) & (F.lower(second) == second) & (F.upper(second) != second)
    return F.when(number, F.concat(F.lit("n:"), core)).when(~starts & capital & (at > 0), F.concat(F.lit("p:"), core)).otherwise(F.concat(F.lit("w:"), F.lower(core)))


def with_tokens(rows: DataFrame, text: str = "text") -> DataFrame:
    """``typed``: the typed tokens of ``text``."""
    raw = rows.withColumn("_raw", _raw_tokens(F.col(text))).drop(text)
    return raw.withColumn("typed", F.transform("_raw", _typed)).drop("_raw")


def _is_unit(typed: Column, at: Column) -> Column:
    # `get` gives null before the first token
    token = F.get(typed, at)
    return token.isin(*[f"w:{u}" for u in UNITS]) & F.coalesce(F.startswith(F.get(typed, at - 1), F.lit("n:")), F.lit(False))


def _template(typed: str) -> Column:
    """Hashes of template tokens: a placeholder of its type, or the word."""
    c = F.col(typed)
    return F.transform(c, lambda t, i: F.xxhash64(F.when(_is_unit(c, i), "u:").when(F.startswith(t, F.lit("w:")), t).otherwise(F.substring(t, 1, 2))))


def _slots(typed: str) -> Column:
    """Values of placeholders, null for words."""
    c = F.col(typed)
    return F.transform(c, lambda t, i: F.when(_is_unit(c, i), t).when(~F.startswith(t, F.lit("w:")), t))


def _windows(rows: DataFrame, column: str, size: int, out: str) -> DataFrame:
    """Hashes of all runs of ``size`` elements, built by doubling; each step uses its input twice, so none is inlined."""
    n = F.size(column)

    def joined(a: str, b: str, shift: int, length: int) -> Column:
        count = F.greatest(n - (length - 1), F.lit(0))
        return F.zip_with(F.slice(F.col(a), F.lit(1), count), F.slice(F.col(b), F.lit(1 + shift), count), lambda x, y: F.xxhash64(x, y))

    rows, have, parts = rows.withColumn("_w1", F.col(column)), 1, {1: "_w1"}
    while 2 * have <= size:
        rows = rows.withColumn(f"_w{2 * have}", joined(parts[have], parts[have], have, 2 * have))
        have *= 2
        parts[have] = f"_w{have}"
    last, length = parts[have], have
    for power in sorted(parts, reverse=True):
        while length + power <= size:
            rows = rows.withColumn(f"_x{length + power}", joined(last, parts[power], length, length + power))
            length += power
            last = f"_x{length}"
    return rows.withColumn(out, F.col(last)).drop(*[c for c in rows.columns if c.startswith(("_w", "_x")) and c != out])


def _variants(typed: str, text: str) -> Column:
    """The typed tokens of an item as a document may hold it: after other words of the sentence, and in one case."""
    tokens = lambda c: F.transform(_raw_tokens(c), _typed)
    inside = lambda c: F.transform(_raw_tokens(c), lambda t, i: _typed(t, i + 1))
    return F.array_distinct(F.array(F.col(typed), inside(F.col(text)), tokens(F.lower(text)), tokens(F.upper(text)), inside(F.upper(text))))


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """``item, variant, typed, template, fixed, width``: one row per variant of a class of items.

    Items that share template and slot pattern are one class, named by the smallest id.  ``fixed``:
    whether a token is a word of the item that only its place or case makes a name.
    """
    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null")
    rows = rows.withColumn("own", F.transform(_raw_tokens(F.col("text")), _typed)).where(F.size("own") >= MIN_WINDOW)
    rows = _with_pattern(rows.withColumn("typed", F.col("own")))
    classes = rows.groupBy("template", "pattern").agg(F.min("item").alias("class"))
    rows = rows.join(classes, ["template", "pattern"]).select(F.col("class").alias("item"), "own", F.explode(_variants("own", "text")).alias("typed"))
    fixed = F.zip_with("own", "typed", lambda o, t: F.coalesce(F.startswith(o, F.lit("w:")) & F.startswith(t, F.lit("p:")), F.lit(False)))
    rows = _with_pattern(rows.withColumn("fixed", fixed))
    words = F.array_join(F.transform(F.arrays_zip("typed", "fixed"), lambda x: F.when(x["fixed"], x["typed"]).otherwise("")), " ")
    rows = rows.groupBy("item", "template", "pattern", words.alias("words")).agg(F.min_by(F.struct("typed", "fixed"), "typed").alias("first"))
    return rows.select("item", F.xxhash64("template", "pattern", "words").alias("variant"), "first.typed", "template", "first.fixed", F.least(F.lit(window), F.size("template")).alias("width"))


def _with_pattern(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("template", _template("typed")).withColumn("slots", F.filter(_slots("typed"), lambda s: s.isNotNull()))
    return rows.withColumn("pattern", F.transform("slots", lambda s: F.array_position(F.col("slots"), s))).drop("slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, items, coverage)`` of the documents that hold a benchmark item.

    An item is sought as it stands, after other words of a sentence and in lower or upper case.
    It counts if, in one of these forms, at least ``min_coverage`` of its windows are found in the
    document with consistent slots.  Only windows with ``min_words`` ordinary words count (if an
    item has none such, those with the most): a run of placeholders fits too much.  Items shorter
    than ``window`` are one window of their own length; items of fewer than three tokens take no
    part.  Rows are told apart by id and ``text_hash``, so one id's texts do not share windows.
    """
    items = checkpointed(benchmark_windows(benchmark, item_col, item_text_col, window))
    widths = sorted(r.width for r in items.select("width").distinct().collect())  # at most `window` numbers
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    same = lambda a, b: F.col(f"{a}id").eqNullSafe(F.col(f"{b}id")) & (F.col(f"{a}text_hash") == F.col(f"{b}text_hash"))
    if not widths:
        return texts.select(F.col("id").alias(id_col), "text_hash", F.array().cast("array<long>").alias("items"), F.lit(0.0).alias("coverage")).limit(0)
    templates = with_tokens(texts).withColumn("template", _template("typed")).drop("typed")
    keys, found = [], []
    for width in widths:
        own = _windows(items.where(F.col("width") == width), "template", width, "hashes")
        own = own.select("item", "variant", "typed", F.posexplode("hashes").alias("item_at", "hash"))
        words = F.size(F.filter(F.slice("typed", F.col("item_at") + 1, F.lit(width)), lambda t: F.startswith(t, F.lit("w:"))))
        own = own.select("item", "variant", "item_at", "hash", words.alias("words"), F.lit(width).alias("width"))
        keys.append(own)
    keys = checkpointed(_unioned(keys))
    most = keys.groupBy("item", "variant").agg(F.max("words").alias("most"))
    keys = keys.join(most, ["item", "variant"]).where(F.col("words") >= F.least(F.lit(min_words), F.col("most"))).select("item", "variant", "item_at", "hash", "width")
    keys = checkpointed(keys)
    totals = keys.groupBy("item", "variant").agg(F.count(F.lit(1)).alias("windows"))
    for width in widths:
        # the outer form keeps the optimizer from inferring a filter that would compute all of this a second time
        rows = _windows(templates, "template", width, "hashes").select("id", "text_hash", F.posexplode_outer("hashes").alias("at", "hash"))
        own = keys.where(F.col("width") == width).select("item", "variant", "item_at", "hash")
        hits = rows.join(broadcast_if_small(own, BROADCAST_WINDOWS), "hash")
        found.append(hits.select("id", "text_hash", "item", "variant", "item_at", (F.col("at") - F.col("item_at")).alias("shift"), F.lit(width).alias("width")))
    # at most one row a matched offset; a passage repeated in a text gives one row a repetition
    runs = _unioned(found).groupBy("id", "text_hash", "item", "variant", "shift", "width").agg(F.collect_set("item_at").alias("starts"))
    runs = checkpointed(runs)
    ids = runs.select(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash")).distinct()
    held = texts.join(broadcast_if_small(ids), same("", "_"), "left_semi").dropDuplicates(["id", "text_hash"])
    held = with_tokens(held).select(F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash"), _slots("typed").alias("doc_slots"))
    slots = items.select(F.col("item").alias("_item"), F.col("variant").alias("_variant"), "fixed", _slots("typed").alias("item_slots"))
    aligned = runs.join(broadcast_if_small(slots), (F.col("item") == F.col("_item")) & (F.col("variant") == F.col("_variant"))).join(held, same("", "_"))
    covered = F.filter(
        F.transform("item_slots", lambda s, p: F.when(s.isNotNull() & F.exists("starts", lambda q: (p >= q) & (p < q + F.col("width"))), F.struct(p.alias("at"), s.alias("ours"), F.get(F.col("doc_slots"), p + F.col("shift")).alias("theirs")))),
        lambda x: x.isNotNull(),
    )
    clear = lambda bad: F.filter("starts", lambda q: ~F.exists(bad, lambda p: (p >= q) & (p < q + F.col("width"))))
    # a word that only its place makes a name must be the same word
    other = F.filter(F.transform("fixed", lambda f, p: F.when(f & ~F.get("item_slots", p).eqNullSafe(F.get("doc_slots", p + F.col("shift"))), p)), lambda p: p.isNotNull())
    aligned = aligned.withColumn("starts", let(other, clear))
    sound = aligned.withColumn("starts", let(covered, lambda c: let(_conflicts(c), clear)))
    per = sound.select("id", "text_hash", "item", "variant", F.explode("starts").alias("start")).distinct().groupBy("id", "text_hash", "item", "variant").agg(F.count(F.lit(1)).alias("n"))
    per = per.join(totals, ["item", "variant"]).withColumn("coverage", F.col("n") / F.col("windows")).where(F.col("coverage") >= min_coverage)
    return per.groupBy("id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("coverage").alias("coverage")).withColumnRenamed("id", id_col)


def _conflicts(covered: Column) -> Column:
    """Places of slots whose values do not fit the rest of the alignment.

    A value of the item stands for the value that most of its mentions have in the document, or
    for itself.  Two numbers of the item that became one fit nowhere.
    """
    same = lambda x, y: (x["ours"] == y["ours"]) & (x["theirs"] == y["theirs"])
    rank = lambda x: F.struct(x["n"], x["ours"] == x["theirs"], x["theirs"])
    pairs = F.array_distinct(F.transform(covered, lambda x: F.struct(x["ours"].alias("ours"), x["theirs"].alias("theirs"))))
    votes = F.transform(pairs, lambda x: F.struct(x["ours"].alias("ours"), x["theirs"].alias("theirs"), F.size(F.filter(covered, lambda y: same(x, y))).alias("n")))
    mapped = let(votes, lambda v: F.filter(v, lambda x: (x["ours"] == x["theirs"]) | ~F.exists(v, lambda y: (x["ours"] == y["ours"]) & (rank(y) > rank(x)))))
    merged = lambda x, v: F.startswith(x["ours"], F.lit("n:")) & F.exists(v, lambda y: (x["theirs"] == y["theirs"]) & (x["ours"] != y["ours"]))
    fit = let(mapped, lambda v: F.filter(v, lambda x: ~merged(x, v)))
    return let(fit, lambda v: F.transform(F.filter(covered, lambda x: ~F.exists(v, lambda y: same(x, y))), lambda x: x["at"]))


def _unioned(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _findings(docs: DataFrame, benchmark: DataFrame, **parameters) -> tuple[DataFrame, DataFrame, Column]:
    """The rows as structs, what is found under names of its own, and the condition that joins them."""
    id_col, text_col = parameters.get("id_col", "doc_id"), parameters.get("text_col", "text")
    hits = checkpointed(contaminated(docs, benchmark, **parameters)).withColumnsRenamed({id_col: "_hit", "text_hash": "_hash", "items": "_items", "coverage": "_coverage"})
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    fits = F.col(f"row.`{id_col}`").eqNullSafe(F.col("_hit")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("_hash"))
    return own, hits, fits


def decontaminate(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """``(doc_id, contaminated, item_ids, coverage)``, one row per row of ``docs``.

    ``item_ids``: sorted ids of the item classes found (items of one template and slot pattern
    are one class, named by its smallest id).  Null or empty text is clean; every row is judged by
    its own text, also where its id is null or repeated; null items are ignored; other columns are
    ignored; empty tables give an empty result or only clean rows.
    """
    id_col = parameters.get("id_col", "doc_id")
    own, hits, fits = _findings(docs, benchmark, **parameters)
    out = own.join(broadcast_if_small(hits, 200_000), fits, "left")
    return out.select(F.col(f"row.`{id_col}`").alias(id_col), F.col("_items").isNotNull().alias("contaminated"), F.coalesce("_items", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("_coverage", F.lit(0.0)).alias("coverage"))


def clean(docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns, whatever these are called."""
    own, hits, fits = _findings(docs, benchmark, **parameters)
    return own.join(broadcast_if_small(hits.select("_hit", "_hash")), fits, "left_anti").select("row.*")
