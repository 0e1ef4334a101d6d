"""Groups of spelling variants: words at Levenshtein distance one, found in compact trie shards.

The vocabulary is sorted by range and built into tries of at most ``SHARD_WORDS`` words, stored as
a table.  Shards are broadcast in groups of at most ``GROUP_BYTES``; under each group every word
runs its distance-one automaton over every shard depth-first: along the word's own path, each
node offers a deletion, and each child a replacement and an insertion, after which only the exact
rest may follow.  A branch that cannot accept dies at its first wrong character, and a shard
whose range the word cannot reach dies at its root.

A shard sends, for a word with neighbours in it, their number and the best of them: no pair is
emitted.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.shared import discard, written

RUN = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, DROP = 5, 3, 97
SHARD_WORDS = 50_000
SHARD_CHARS = 4 << 20
GROUP_BYTES = 64 << 20
BLOCK_WORDS = 10_000
MAX_ROUNDS = 64


class Trie:
    """Sorted distinct words in flat arrays: children of a node stand together, a lone rest is one string.

    ``labels[i]`` is the character that leads to node ``i``, ``start[i] : start[i + 1]`` are its
    children, ``value[i]`` is the count of the word that ends there (0: none).  A node without
    children ends with the rest ``tails[tail[i] : tail[i + 1]]``.
    """

    def __init__(self, labels: str, start: array, value: array, tails: str, tail: array):
        self.labels, self.start, self.value, self.tails, self.tail = labels, start, value, tails, tail

    @classmethod
    def build(cls, words: list[str], counts: list[int]) -> Trie:
        labels, start, value, tails, tail = ["\0"], array("I"), array("q"), [], array("I", [0])
        level, n, size = [(0, len(words), 0)], 1, 0
        while level:  # breadth first, so that children stand together
            below = []
            for lo, hi, depth in level:
                start.append(n)
                if hi - lo == 1:
                    tails.append(words[lo][depth:])
                    size += len(words[lo]) - depth
                    value.append(counts[lo])
                else:
                    ends = hi > lo and len(words[lo]) == depth
                    value.append(counts[lo] if ends else 0)
                    lo += ends
                    while lo < hi:
                        c, at = words[lo][depth], lo + 1
                        while at < hi and words[at][depth] == c:
                            at += 1
                        labels.append(c)
                        below.append((lo, at, depth + 1))
                        n += 1
                        lo = at
                tail.append(size)
            level = below
        start.append(n)
        return cls("".join(labels), start, value, "".join(tails), tail)

    def pack(self) -> tuple[str, bytes, bytes, str, bytes]:
        return self.labels, self.start.tobytes(), self.value.tobytes(), self.tails, self.tail.tobytes()

    @classmethod
    def unpack(cls, labels: str, start: bytes, value: bytes, tails: str, tail: bytes) -> Trie:
        return cls(labels, array("I", start), array("q", value), tails, array("I", tail))

    def _exact(self, node: int, word: str, i: int) -> int:
        """The node at which ``word[i:]`` ends, or -1."""
        labels, start, length = self.labels, self.start, len(word)
        while True:
            lo, hi = start[node], start[node + 1]
            if lo == hi:
                a, b = self.tail[node], self.tail[node + 1]
                return node if b - a == length - i and self.tails.startswith(word[i:], a) else -1
            if i == length:
                return node if self.value[node] else -1
            node = labels.find(word[i], lo, hi)
            if node < 0:
                return -1
            i += 1

    def neighbours(self, word: str) -> dict[int, str]:
        """Node and text of each word at distance exactly one: the automaton's accepting nodes, depth first."""
        found: dict[int, str] = {}
        labels, start, exact, length = self.labels, self.start, self._exact, len(word)
        node = i = 0
        before = ""
        while True:
            lo, hi = start[node], start[node + 1]
            if lo == hi:
                if self.value[node]:
                    rest = self.tails[self.tail[node] : self.tail[node + 1]]
                    if one_apart(word, i, rest):
                        found[node] = word[:i] + rest
                return found
            here = word[i] if i < length else ""
            if here and here != before and (at := exact(node, word, i + 1)) >= 0:
                found[at] = word[:i] + word[i + 1 :]
            for child in range(lo, hi):
                c = labels[child]
                if here and c != here and (at := exact(child, word, i + 1)) >= 0:
                    found[at] = word[:i] + c + word[i + 1 :]
                if c != before and (at := exact(child, word, i)) >= 0:
                    found[at] = word[:i] + c + word[i:]
            if not here:
                return found
            node = labels.find(here, lo, hi)
            if node < 0:
                return found
            before = here
            i += 1


def one_apart(word: str, i: int, rest: str) -> bool:
    """Whether ``word[i:]`` and ``rest`` differ by exactly one insertion, deletion or replacement."""
    m, n = len(word) - i, len(rest)
    if abs(m - n) > 1:
        return False
    same = 0
    while same < min(m, n) and word[i + same] == rest[same]:
        same += 1
    if m == n:
        return same < m and word[i + same + 1 :] == rest[same + 1 :]
    return word[i + same + 1 :] == rest[same:] if m > n else word[i + same :] == rest[same + 1 :]


def words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: runs of letters in whole texts, A-Z in lower case, one letter lost in one run of ``drop``.

    A run of document ``id`` whose crc32 of ``<id>:<run>`` is divisible by ``drop`` loses the code
    point at that checksum modulo its length (a null id is empty text there).  Words are the
    distinct results of at least ``min_length`` code points and ``min_count`` occurrences.  Counts
    are combined before they are shuffled.
    """
    text = F.translate(F.col(text_col), UPPER, LOWER)
    run = F.explode(F.regexp_extract_all(text, F.lit(f"{RUN}{{{min_length},}}"), F.lit(0)))  # shorter runs cannot become words
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % drop == 0, cut).otherwise(F.col("run")).alias("word")
    return runs.select(word).where(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def shards(vocabulary: DataFrame, rows: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``(labels, start, value, tails, tail)``: compact tries of neighbouring words, at most ``shard_words`` words and about ``SHARD_CHARS`` characters each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        counts: list[int] = []
        chars = 0

        def shard() -> pa.RecordBatch:
            parts = Trie.build(held, counts).pack()
            return pa.RecordBatch.from_arrays([pa.array([p]) for p in parts], ["labels", "start", "value", "tails", "tail"])

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and (len(held) >= shard_words or chars + len(word) > SHARD_CHARS):
                    yield shard()
                    held, counts, chars = [], [], 0
                held.append(word)
                counts.append(n)
                chars += len(word)
        if held:
            yield shard()

    dealt = vocabulary.select("word", "n").repartitionByRange(max(1, -(-rows // shard_words)), "word").sortWithinPartitions("word")
    return dealt.mapInArrow(run, "labels string, start binary, value binary, tails string, tail binary")


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(word, n_near, form, form_n)`` of each word that has near words; ``form`` is the commonest, the smallest of equals.

    ``vocabulary`` has distinct words and their counts.  One pass over the words per group of
    shards; a group's size is known before it is broadcast.
    """
    spark = vocabulary.sparkSession
    rows = vocabulary.count()
    kept, path = written(shards(vocabulary, rows, shard_words).withColumn("shard", F.monotonically_increasing_id()), "trie-shards")
    size = sum((F.octet_length(c) for c in kept.columns if c != "shard"), F.lit(0))
    groups: list[list[int]] = [[]]
    room = group_bytes
    for shard, n in kept.select("shard", size).orderBy("shard").toLocalIterator():
        if groups[-1] and n > room:
            groups.append([])
            room = group_bytes
        groups[-1].append(shard)
        room -= n
    blocks = vocabulary.select("word").repartition(max(spark.sparkContext.defaultParallelism, -(-rows // BLOCK_WORDS)), "word")
    parts = []
    for group in groups:
        sent = spark.sparkContext.broadcast([tuple(r) for r in kept.where(F.col("shard").between(group[0], group[-1])).drop("shard").collect()] if group else [])
        parts.append(written(blocks.mapInArrow(_search(sent), "word string, n_near long, form string, form_n long"), "near-words"))
        sent.unpersist()
    discard(spark, path)
    found = parts[0][0]
    for part, _ in parts[1:]:
        found = found.unionByName(part)
    best = F.min(F.struct((-F.col("form_n")).alias("minus"), "form")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def _search(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = None
        for batch in batches:
            if tries is None:
                tries = [Trie.unpack(*parts) for parts in sent.value]
            rows = []
            for word in batch.column(0).to_pylist():
                n, best = 0, None
                for trie in tries:
                    found = trie.neighbours(word)
                    n += len(found)
                    for node, text in found.items():
                        key = (-trie.value[node], text)
                        if best is None or key < best:
                            best = key
                if n:
                    rows.append((word, n, best[1], -best[0]))
            if rows:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["word", "n_near", "form", "form_n"])

    return run


def roots(links: DataFrame) -> DataFrame:
    """``(word, root)``: the end of each chain of ``(word, form)``, in rounds that double the way covered.

    A form is at least twice as common as its word, so there are no rings and no long chains.
    """
    spark = links.sparkSession
    now, path = written(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(MAX_ROUNDS):
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        old = path
        step, path = written(step, "roots")
        discard(spark, old)
        now = step.select("word", "root")
        if not step.where("moved").limit(1).count():
            return now
    raise RuntimeError(f"roots are not settled after {MAX_ROUNDS} rounds")


def variants(docs: DataFrame, factor: int = 2, shard_words: int = SHARD_WORDS, group_bytes: int = GROUP_BYTES, **options) -> DataFrame:
    """``(word, n, form, root, n_near, form_n)`` of every word of ``docs`` (see ``words``).

    ``form`` is the near word of largest count (ties: smallest in code-point order) if that is at
    least ``factor`` times the word's own, else null; ``root`` is where the forms lead.  Null and
    empty texts have no words, a very long text is read whole, repeated rows count as often as
    they stand, other columns are ignored, an empty table gives no rows.
    """
    vocabulary, _ = written(words(docs, **options), "words")
    near = near_words(vocabulary, shard_words, group_bytes)
    is_form = F.col("form_n") >= factor * F.col("n")
    near = vocabulary.join(near, "word", "left")
    near = near.select("word", "n", F.when(is_form, F.col("form")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n"))
    near, _ = written(near, "near")
    ends = roots(near.where("form is not null"))
    return near.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")
