"""BagMinHash near-duplicates: weighted Jaccard over multisets of five-word shingles.

A shingle's weight is how often it occurs.  Weights are discretised at the integers and grouped
in dyadic intervals (0,1], (1,2], (2,4], ...; each interval of a shingle has a Poisson process of
its length as rate, whose points carry a time, a register and a level.  A document keeps the
points at levels up to its weight and each register holds the earliest time, so two registers
agree with probability sum(min) / sum(max).  Only points up to a cut-off at which all registers
are filled are generated (the cut-off moves on where one is empty).

Signatures are banded; candidates are held against an estimate from the signatures, then
verified on the exact multisets.  Groups are connected components of verified links:

1. documents with the same words are one class, of which one representative goes on;
2. each member of a bucket is held against the bucket's smallest id, the likeliest partner kept;
3. buckets whose members are still in different components are cut into tiles of bounded size,
   in which each document names its likeliest partner of another component;
4. at last all candidates that still lie in different components are held against an estimate
   from finer signatures, made for these documents only, and what passes is verified.

So a bucket of n near copies costs about n verifications, not n squared.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import broadcast_if_small, checkpointed, connected_components, text_batches

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 7
REGISTERS = BANDS * ROWS
FINE_REGISTERS = 1_024


def least_estimate(registers: int) -> float:
    """Four standard deviations of the estimate below the threshold."""
    return SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / registers) ** 0.5


TILE = 512
#: Pairs of one partner beyond which they are dealt over several tasks.
HOT_PAIRS = 256
BATCH_CHARS, BATCH_DOCS = 2 << 20, 2_048

_IS_WORD = np.array([chr(b).isalnum() or b >= 0x80 for b in range(128)] + [True] * 128)
#: Blocks of scripts that are written without spaces between words.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x1950, 0x19DF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAADF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1B000, 0x1B16F), (0x20000, 0x3FFFF)]
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW52 = np.uint64((1 << 52) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers (splitmix64's finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int, base: int = 0x100000001B3) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[1], np.full(max(0, n - 1), base)]).astype(np.uint64), dtype=np.uint64)


@functools.cache
def _classes() -> np.ndarray:
    """Of each code point: 0 no word, 1 letter or digit, 2 mark, 3 a word of its own."""
    of = {"L": 1, "N": 1, "M": 2}
    out = np.fromiter((of.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)
    for low, high in UNSPACED:
        block = out[low : high + 1]
        block[block == 1] = 3
    return out


def _spaced(text: str) -> str:
    """Signs beyond ASCII as spaces, and spaces around each character, with its marks, of a script without spaces."""
    if text.isascii():
        return text
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    kind = _classes()[code]
    code[(kind == 0) & (code >= 128)] = 32
    alone = kind == 3
    if alone.any():
        # a mark belongs to the character before it
        base = np.maximum.accumulate(np.where(kind != 2, np.arange(len(kind)), 0))
        after = alone[base]
        code = np.insert(code, np.flatnonzero((kind[1:] != 2) & (alone[1:] | after[:-1])) + 1, 32)
    return code.tobytes().decode("utf-32-le")


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters, marks and digits, lower case, or single characters of scripts without spaces) of the texts, and each word's text."""
    raw = [_spaced(t.lower()).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    begins = np.cumsum([0, *[len(r) + 1 for r in raw]])
    word = _IS_WORD[data]
    edge = np.diff(word.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    length = end - start
    at = np.flatnonzero(word)
    first = np.cumsum(length) - length
    place = np.arange(len(at)) - np.repeat(first, length)
    with np.errstate(over="ignore"):
        value = (data[at].astype(np.uint64) + np.uint64(1)) * _powers(int(length.max()))[place]
        hashed = _mix(np.add.reduceat(value, first) + length.astype(np.uint64) * _GOLD)
    return hashed, np.searchsorted(begins, start, side="right") - 1


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """52-bit hashes of the shingles of each text, each one's text, and a digest of each text's words.

    A text of fewer than five words, but one at least, has one shingle: all its words.
    """
    words, doc = word_hashes(texts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    digests = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]
    n = len(words) - WORDS + 1
    parts, owners = [], []
    with np.errstate(over="ignore"):
        if n > 0:
            inside = doc[:n] == doc[WORDS - 1 :]
            total = sum(words[j : j + n] * np.uint64(2 * j + 3) + (words[j : j + n] >> np.uint64(7 * j + 1)) for j in range(WORDS))
            parts.append(_mix(total[inside]) & _LOW52)
            owners.append(doc[:n][inside])
        count = np.diff(bounds)
        short = np.flatnonzero((count > 0) & (count < WORDS))
        if len(short):
            total = np.array([int(sum(int(w) * (2 * j + 3) for j, w in enumerate(words[bounds[i] : bounds[i + 1]]))) % (1 << 64) for i in short], np.uint64)
            parts.append(_mix(total + count[short].astype(np.uint64) * _GOLD) & _LOW52)
            owners.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), digests
    return np.concatenate(parts), np.concatenate(owners), digests


def multisets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Distinct shingles, their text, their weight; sorted by text, then shingle.  At most 4,096 texts."""
    hashed, doc, digests = shingles(texts)
    keys, weight = np.unique((doc.astype(np.uint64) << np.uint64(52)) | hashed, return_counts=True)
    return keys & _LOW52, (keys >> np.uint64(52)).astype(np.int64), weight, digests


def bag_minhash(shingle: np.ndarray, doc: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """Signatures, (docs, registers) of times; infinite where a text has no words."""
    signature = np.full((docs, registers), np.inf)
    total = np.bincount(doc, weight, docs)
    todo, reach = np.flatnonzero(total), 2.0
    while len(todo):
        cut = np.zeros(docs)
        cut[todo] = registers * (np.log(registers) + reach) / total[todo]
        take = cut[doc] > 0
        _points(shingle[take], doc[take], weight[take], cut, signature)
        todo = todo[np.isinf(signature[todo]).any(1)]
        reach *= 2
    return signature


def _points(shingle: np.ndarray, doc: np.ndarray, weight: np.ndarray, cut: np.ndarray, signature: np.ndarray) -> None:
    registers, flat, level = signature.shape[1], signature.reshape(-1), 0
    low, high = 0, 1
    while len(doc):
        with np.errstate(over="ignore"):
            seed = _mix(shingle + np.uint64(level + 1) * np.uint64(0xD6E8FEB86659FD93))
            at, own, most, time, step = seed, doc, weight, np.zeros(len(doc)), 0
            while len(at):
                step += 1
                draw = _mix(at + np.uint64(step) * _GOLD)
                time = time - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / (high - low)
                alive = time <= cut[own]
                at, own, most, time, draw = at[alive], own[alive], most[alive], time[alive], draw[alive]
                second = _mix(draw ^ np.uint64(0xA0761D6478BD642F))
                register = (second & np.uint64(0xFFFFFFFF)) % np.uint64(registers)
                place = low + 1 + ((second >> np.uint64(32)) % np.uint64(high - low)).astype(np.int64)
                kept = place <= most
                np.minimum.at(flat, own[kept] * registers + register[kept].astype(np.int64), time[kept])
        low, high, level = high, 2 * high, level + 1
        more = weight > low
        shingle, doc, weight = shingle[more], doc[more], weight[more]


def bands_of(signature: np.ndarray, bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (docs, bands) and one byte of each register."""
    bits = _mix(signature.view(np.uint64))
    rows = bits.reshape(len(bits), bands, -1)
    with np.errstate(over="ignore"):
        folded = np.zeros(rows.shape[:2], np.uint64) + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD
        for j in range(rows.shape[2]):
            folded = _mix(folded ^ rows[:, :, j])
    return folded.view(np.int64), bits.astype(np.uint8)


def weighted_jaccard(left: list[str], right: list[str]) -> np.ndarray:
    """Exact sum(min) / sum(max) of the shingle multisets of paired texts; 0 where both have none."""
    out = []
    for lo in range(0, len(left), 2_000):
        a, b = left[lo : lo + 2_000], right[lo : lo + 2_000]
        n = len(a)
        sa, da, wa, _ = multisets(a)
        sb, db, wb, _ = multisets(b)
        ka, kb = (da.astype(np.uint64) << np.uint64(52)) | sa, (db.astype(np.uint64) << np.uint64(52)) | sb
        common, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
        both = np.bincount(da[ia], np.minimum(wa[ia], wb[ib]), n)
        every = np.bincount(da, wa, n) + np.bincount(db, wb, n) - both
        out.append(np.where(every > 0, both / np.maximum(every, 1), 0.0))
    return np.concatenate(out) if out else np.zeros(0)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", registers: int = REGISTERS) -> DataFrame:
    """``(id, text_hash, digest, size, bands, bytes)``: the signature of every whole text; nulls where it has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), [t or "" for t in batch.column(2).to_pylist()]
            step = max(64, BATCH_DOCS * REGISTERS // registers)  # the same memory for signatures of any length
            for first in range(0, len(texts), step):
                part = texts[first : first + step]
                for lo, hi in text_batches(part, BATCH_CHARS):
                    shingle, doc, weight, digests = multisets(part[lo:hi])
                    n = hi - lo
                    band, small = bands_of(bag_minhash(shingle, doc, weight, n, registers))
                    none = np.array([d is None for d in digests])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), pa.array(band.reshape(-1)), mask=pa.array(none))
                    size = np.bincount(doc, weight, n).astype(np.int64)
                    columns = [ids.slice(first + lo, n), batch.column(1).slice(first + lo, n), pa.array(digests, pa.binary()), pa.array(size), lists, pa.array([None if z else s.tobytes() for z, s in zip(none, small)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "digest", "size", "bands", "bytes"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, text_hash long, digest binary, size long, bands array<long>, bytes binary")


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of registers that agree, corrected for bytes that agree by chance."""
    return ((a == b).mean(-1) - 1 / 256) / (1 - 1 / 256)


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs with a ``salt``, and the partners of so many pairs that they are dealt over several salts."""
    hot = checkpointed(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HOT_PAIRS).cast("int").alias("salts")).where("salts > 1"))
    dealt = pairs.join(broadcast_if_small(hot), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    return dealt, hot


def _salted(side: DataFrame, hot: DataFrame) -> DataFrame:
    """One row a salt of each row of ``side``, keyed by ``b``."""
    out = side.join(broadcast_if_small(hot), "b", "left")
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def _estimates(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``(a, b, estimate)`` of the pairs whose sizes and signatures allow the threshold."""
    pairs, hot = _dealt(checkpointed(pairs))
    side = lambda x: reps.select(F.col("id").alias(x), F.col("size").alias(f"size_{x}"), F.col("bytes").alias(f"bytes_{x}"))
    joined = pairs.join(side("a"), "a").join(_salted(side("b"), hot), ["b", "salt"])
    joined = joined.where(F.least("size_a", "size_b") >= (SIMILARITY - 1e-9) * F.greatest("size_a", "size_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (2, 3))
            share = _agreement(a, b) if len(a) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "estimate"])

    return joined.select("a", "b", "bytes_a", "bytes_b").mapInArrow(run, "a long, b long, estimate double").where(F.col("estimate") >= least_estimate(REGISTERS))


def _texts(docs: DataFrame, need: DataFrame, reps: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text)`` of the classes in ``need``, by the text that stands for each: only such texts are shuffled."""
    chosen = reps.select("id", "doc", "text_hash").join(need, "id", "left_semi")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")).where("doc is not null and text is not null")
    return rows.join(broadcast_if_small(chosen), ["doc", "text_hash"]).groupBy("id").agg(F.first("text").alias("text"))


def _verified(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The pairs that reach the threshold on the exact multisets."""
    own = texts(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    pairs, hot = _dealt(pairs)
    right = _salted(own.withColumnsRenamed({"id": "b", "text": "text_b"}), hot)
    joined = pairs.join(own.withColumnsRenamed({"id": "a", "text": "text_a"}), "a").join(right, ["b", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            share = [np.zeros(0)]
            for lo, hi in text_batches([x if len(x) > len(y) else y for x, y in zip(left, right)], BATCH_CHARS):
                share.append(weighted_jaccard(left[lo:hi], right[lo:hi]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate(share))], ["a", "b", "similarity"])

    return checkpointed(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, similarity double").where(F.col("similarity") >= SIMILARITY - 1e-9).select("a", "b"))


def _unsettled(buckets: DataFrame, components: DataFrame) -> DataFrame:
    """``(bucket, id, component, blocks)``: the members of buckets that still hold several components."""
    placed = buckets.join(components.withColumnsRenamed({"component": "known"}), "id", "left").withColumn("component", F.coalesce("known", "id")).drop("known")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    return placed.join(mixed.where("low <> high").select("bucket", "blocks"), "bucket")


def _tile_pairs(placed: DataFrame, reps: DataFrame, best_only: bool, registers: int) -> DataFrame:
    """Candidate pairs of different components inside buckets, found tile by tile; of each document only its likeliest if ``best_only``."""
    least = least_estimate(registers)
    placed = placed.join(reps.select("id", "size", "bytes"), "id")
    dealt = placed.withColumn("block", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = dealt.groupBy("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).agg(F.collect_list(F.struct("id", "component", "size", "block", "bytes")).alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same, members in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = members.values
                ids, component, size, block = (part.field(x).to_numpy(zero_copy_only=False) for x in ("id", "component", "size", "block"))
                small = np.frombuffer(b"".join(part.field("bytes").to_pylist()), np.uint8).reshape(len(part), -1)
                found = []
                for i in range(len(ids) if best_only else len(ids) - 1):
                    near = slice(0, None) if best_only else slice(i + 1, None)
                    fits = (component[near] != component[i]) & (np.minimum(size[near], size[i]) >= (SIMILARITY - 1e-9) * np.maximum(size[near], size[i]))
                    if not same:
                        fits &= block[near] != block[i]
                    where = np.flatnonzero(fits)
                    if not len(where):
                        continue
                    share = _agreement(small[near][where], small[i])
                    ok = share >= least
                    if best_only and ok.any():
                        top = where[share.argmax()]
                        found.append((ids[i], ids[near][top], share.max()))
                    elif not best_only:
                        found += [(ids[i], x, s) for x, s in zip(ids[near][where[ok]], share[ok])]
                if found:
                    a, b, s = (np.array(x) for x in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s)], ["a", "b", "estimate"])

    pairs = tiles.select((F.col("i") == F.col("j")).alias("same"), "members").mapInArrow(run, "a long, b long, estimate double")
    if best_only:
        pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _groups(docs: DataFrame, id_col: str, text_col: str, best_rounds: int) -> DataFrame:
    """``(doc, text_hash, class_id, group_id, first)``, one row per row of ``docs``; ``first``: the row's text and id stand for its group.

    Classes (texts of the same words) have keys of their own, so texts that share an id are not one document.
    """
    signed = checkpointed(signatures(docs, id_col, text_col).withColumnRenamed("id", "doc"))
    least = F.min(F.struct("doc", "text_hash")).alias("own")
    classes = signed.where("digest is not null and doc is not null").groupBy("digest").agg(least, F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("bytes").alias("bytes"))
    # the checkpoint fixes the keys
    classes = checkpointed(classes.select("digest", "own.doc", "own.text_hash", "size", "bands", "bytes", F.monotonically_increasing_id().alias("id")))
    reps = classes.select("id", "doc", "text_hash", "size", "bytes")
    texts = lambda need: _texts(docs, need, reps, id_col, text_col)

    banded = classes.select("id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("pivot")).where("n > 1").select("bucket", "pivot")
    buckets = checkpointed(banded.join(shared, "bucket"))
    first = buckets.where("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    first = _estimates(first, reps).groupBy("a").agg(F.max_by("b", F.struct("estimate", -F.col("b"))).alias("b"))
    tried = checkpointed(first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    links = _verified(tried, texts)
    components = checkpointed(connected_components(links, "a", "b"))
    for best_only in [True] * best_rounds + [False]:
        placed = checkpointed(_unsettled(buckets.drop("pivot"), components))
        if best_only:
            pairs = _tile_pairs(placed, reps, True, REGISTERS)
        else:
            fine = signatures(texts(placed.select("id").distinct()), "id", "text", FINE_REGISTERS)
            pairs = _tile_pairs(placed, checkpointed(fine.select("id", "size", "bytes")), False, FINE_REGISTERS)
        more = checkpointed(pairs.join(tried, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        found = _verified(more, texts)
        tried = tried.unionByName(more)
        if not found.isEmpty():
            links = components.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(found)
            components = checkpointed(connected_components(links, "a", "b"))

    group = classes.select("digest", "doc", "text_hash", "id").join(components, "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = group.groupBy("component").agg(F.min(F.struct("doc", "text_hash")).alias("best"))
    group = group.join(of, "component").select(F.col("digest").alias("_digest"), F.col("doc").alias("class_id"), "best")
    out = signed.select("doc", "text_hash", "digest").join(group, F.col("digest") == F.col("_digest"), "left")
    alone = F.col("doc").isNull() | F.col("best").isNull()
    return out.select(
        "doc",
        "text_hash",
        F.when(F.col("doc").isNotNull(), F.coalesce("class_id", "doc")).alias("class_id"),
        F.when(F.col("doc").isNotNull(), F.coalesce("best.doc", "doc")).alias("group_id"),
        (alone | ((F.col("best.doc") == F.col("doc")) & (F.col("best.text_hash") == F.col("text_hash")))).alias("first"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", best_rounds: int = 1) -> DataFrame:
    """``(doc_id, class_id, group_id, kept)``, one row per row of ``docs``.

    ``class_id``: smallest id with the same words; ``group_id``: smallest id reachable over links
    of weighted Jaccard >= 0.8; ``kept``: whether the row stands for its group.  A link at exactly
    0.8 is a candidate with probability 0.9995, a higher one more surely.  Texts without words
    (null, empty, signs only) are alone; rows with a null id have null class and group and are
    kept.  Different texts under one id are documents of their own, linked by their texts alone;
    equal rows that stand for a group are all marked as kept.  Whole texts, no cap on buckets;
    other columns are ignored; an empty table gives an empty result.
    """
    out = _groups(docs, id_col, text_col, best_rounds)
    return out.select(F.col("doc").alias(id_col), "class_id", "group_id", F.col("first").alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near copies, with all its columns: that of the smallest id, and of equal rows one.

    Rows with a null id and rows without words all stay.
    """
    groups = checkpointed(_groups(docs, id_col, text_col, 1))
    own = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    named = {"doc": "_doc", "text_hash": "_hash"}
    fits = F.col(f"row.`{id_col}`").eqNullSafe(F.col("_doc")) & (F.xxhash64(F.col(f"row.`{text_col}`")) == F.col("_hash"))
    copies = groups.where(~F.col("first")).select("doc", "text_hash").distinct().withColumnsRenamed(named)
    kept = own.join(broadcast_if_small(copies), fits, "left_anti")
    again = checkpointed(groups.where("first and doc is not null").groupBy("doc", "text_hash").count().where("count > 1").drop("count").withColumnsRenamed(named))
    if again.isEmpty():
        return kept.select("row.*")
    key = [F.col(f"row.`{id_col}`").alias("_id"), F.xxhash64(F.col(f"row.`{text_col}`")).alias("_hash")]
    repeated = kept.join(broadcast_if_small(again), fits, "left_semi").select(*key, "row")
    # equal in id and text, not always in other columns: the least by these stands
    repeated = repeated.groupBy("_id", "_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.join(broadcast_if_small(again), fits, "left_anti").unionByName(repeated.select("row")).select("row.*")
