"""Texts as runs of bytes that no token spans, found in numpy and told apart in Arrow.

No Python string is made for a word: a window of a batch's bytes is cut, its distinct pieces are
numbered by Arrow, and only those are encoded.  What is kept between windows is bounded in bytes
and given back when the task ends.
"""

from __future__ import annotations

import ctypes
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW_BYTES = 1 << 20
#: Bytes of pieces, of their ids and of the table around them that a worker keeps between windows.
KEPT_BYTES = 80 << 20
ENTRY_BYTES = 200
LONGEST_KEPT = 64

_VISIBLE, _LETTER, _SIGN, _LEAD, _TAIL = 1, 2, 4, 8, 16
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] |= _VISIBLE
_KIND[[*range(65, 91), *range(97, 123)]] |= _LETTER
_KIND[list(b".,!?;:#$%&*")] |= _SIGN
#: First bytes of U+00C0 to U+07FF, none of which is white space.
_KIND[0xC3:0xE0] |= _LEAD
_KIND[0x80:0xC0] |= _TAIL

_held: dict = {}


def held(owner: str, key, make):
    """``make()``, kept in this Python worker while tasks of one ``owner`` follow each other; another owner's things go first."""
    if _held.get("owner") != owner:
        _held.clear()
        _held["owner"] = owner
        give_back()
    if key not in _held:
        _held[key] = make()
    return _held[key]


def give_back() -> None:
    """Hand freed memory to the system, so that an idle worker does not hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def starts(data: np.ndarray, lo: int, hi: int, own: np.ndarray) -> np.ndarray:
    """Places in ``lo..hi`` at which a piece begins; ``own``: where texts begin, ascending.

    Before a space that a visible character follows; around a single line break; between a Latin
    letter and a sign that no letter joins.
    """
    first = max(0, lo - 2)
    b = data[first : hi + 1]
    kind = _KIND[b]
    visible = kind & _VISIBLE > 0
    begins = kind & (_VISIBLE | _LEAD) > 0
    ends, letter = visible.copy(), kind & _LETTER > 0
    tail = kind[1:] & _TAIL > 0
    ends[1:] |= tail & (kind[:-1] & _LEAD > 0)
    letter[1:] |= tail & (b[:-1] == 0xC3) & (b[1:] != 0x97) & (b[1:] != 0xB7)
    line = b == 10
    cut = np.zeros(len(b), bool)
    cut[:-1] |= (b[:-1] == 32) & begins[1:]
    # a space at the end of a text belongs to the white space before it
    near = own[(own > first) & (own <= first + len(b))] - first
    cut[near - 1] = False
    cut[1:] |= ends[:-1] & line[1:]
    cut[2:] |= ends[:-2] & line[1:-1] & begins[2:]
    cut[1:] |= letter[:-1] & (kind[1:] & _SIGN > 0)
    cut[own[(own >= lo) & (own < hi)] - first] = True
    return np.flatnonzero(cut[lo - first : hi - first]) + lo


def _as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of strings without nulls."""
    array = texts.cast(pa.large_binary())
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return offsets, data


def windows(texts: pa.Array, window_bytes: int = WINDOW_BYTES) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """``(pieces, owner)`` of about ``window_bytes`` each: the pieces tile the texts, ``owner`` is the row of each.

    A text longer than a window goes over several, parted where a piece begins; a piece is never parted.
    """
    offsets, data = _as_bytes(texts)
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        size = window_bytes
        while True:
            hi = min(stop, at + size)
            cut = starts(data, at, hi, offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, hi + 1, side="right")])
            cut = cut[1:] if len(cut) and cut[0] == at else cut
            if hi == stop or len(cut):
                break
            size *= 2
        cut = np.concatenate([[at], cut])
        edges = np.append(cut, stop) if hi == stop else cut
        owner = np.searchsorted(offsets, edges[:-1], side="right") - 1
        base = int(edges[0])
        place = pa.py_buffer(np.ascontiguousarray(edges - base))
        yield pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, place, pa.py_buffer(data[base : edges[-1]])]), owner
        at = int(edges[-1])


def byte_batches(texts: pa.Array, limit: int = WINDOW_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``limit`` bytes each; a longer text stands alone."""
    offsets, _ = _as_bytes(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, len(texts))
        lo = hi


def load_tokenizer(path: str):
    """The tokenizer of a .json or .model file, kept between the tasks of one operator."""

    def make():
        if path.endswith(".model"):
            import sentencepiece

            return sentencepiece.SentencePieceProcessor(model_file=path)
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return held(path, "tokenizer", make)


def ids_of(path: str, texts: list[str]) -> list[bytes]:
    """Little-endian 32-bit ids of texts that are encoded one by one, no special token added."""
    tokenizer = load_tokenizer(path)
    if path.endswith(".model"):
        return [np.array(x, "<u4").tobytes() for x in tokenizer.encode(texts, num_threads=1)]
    return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def splits_safely(path: str) -> bool:
    """Whether no token of the file spans two pieces: byte-level BPE whose words end at white space and signs."""
    if path.endswith(".model"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = json.dumps(spec.get("pre_tokenizer"))
    kinds = set(re.findall(r'"type": ?"(\w+)"', before))
    normal = set(re.findall(r'"type": ?"(\w+)"', json.dumps(spec.get("normalizer"))))
    added = spec.get("added_tokens") or []
    plain = all(not a["lstrip"] and not a["rstrip"] and not re.search(r"[\s.,!?;:#$%&*]", a["content"]) for a in added)
    return "ByteLevel" in kinds and '"add_prefix_space": true' not in before and plain and normal <= {"Sequence", "NFC", "Replace", "Lowercase"}


def _line_break(path: str) -> int | None:
    """The id of a line break, if it is one token that leaves its neighbours as they are."""
    ids = lambda x: load_tokenizer(path).encode(x, add_special_tokens=False).ids
    own = ids("\n")
    return own[0] if len(own) == 1 and ids("ab,\n cd\nef") == ids("ab,") + own + ids(" cd") + own + ids("ef") else None


class Encoder:
    """Ids of pieces; each distinct piece is encoded once, as long as the kept table of at most ``kept_bytes`` holds it."""

    def __init__(self, path: str, kept_bytes: int | None = None):
        self.path, self.kept_bytes, self.kept, self.older, self.size = path, KEPT_BYTES if kept_bytes is None else kept_bytes, {}, {}, 0
        load_tokenizer(path)
        self.line_break = held(path, "line break", lambda: (_line_break(path),))[0]

    def _learn(self, new: list[bytes]) -> list[bytes]:
        text = [x.decode("utf-8", "replace") for x in new]
        out: list = [None] * len(new)
        # a run without white space inside can be a line of one text: the line break's id parts them again
        plain = [i for i, x in enumerate(text) if " " not in x[1:] and x != " " and x.isprintable()] if self.line_break is not None else []
        for lo in range(0, len(plain), 5_000):
            some = plain[lo : lo + 5_000]
            ids = np.frombuffer(ids_of(self.path, ["\n".join(text[i] for i in some)])[0], "<u4")
            ends = [*np.flatnonzero(ids == self.line_break).tolist(), len(ids)]
            if len(ends) != len(some):
                raise ValueError("pieces do not part at line breaks")
            data, at = ids.tobytes(), 0
            for i, end in zip(some, ends):
                out[i] = data[4 * at : 4 * end]
                at = end + 1
        rest = [i for i, x in enumerate(out) if x is None]
        for lo in range(0, len(rest), 20_000):
            some = rest[lo : lo + 20_000]
            for i, ids in zip(some, ids_of(self.path, [text[i] for i in some])):
                out[i] = ids
        return out

    def __call__(self, pieces: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """The number of each piece among the distinct ones, and the ids of those."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        values = list(map(self.kept.get, distinct))
        old = [i for i, v in enumerate(values) if v is None]
        for i, v in zip(old, map(self.older.get, [distinct[i] for i in old])):
            values[i] = v
        new = [i for i in old if values[i] is None]
        for i, ids in zip(new, self._learn([distinct[i] for i in new])):
            values[i] = ids
        fresh = [i for i in old if len(distinct[i]) <= LONGEST_KEPT]
        size = sum(len(distinct[i]) + len(values[i]) + ENTRY_BYTES for i in fresh)
        if self.size + size > self.kept_bytes // 2:  # what was not met since the last turn is given up
            self.older, self.kept, self.size = self.kept, {}, 0
        if size <= self.kept_bytes // 2:
            self.kept.update((distinct[i], values[i]) for i in fresh)
            self.size += size
        return coded.indices.to_numpy(zero_copy_only=False), values


def lengths(path: str, texts: pa.Array, encoder: Encoder | None) -> np.ndarray:
    """Token counts of whole texts."""
    counts = np.zeros(len(texts), np.int64)
    if encoder is None:
        for lo, hi in byte_batches(texts):
            counts[lo:hi] = [len(x) // 4 for x in ids_of(path, texts.slice(lo, hi - lo).to_pylist())]
        return counts
    for pieces, owner in windows(texts):
        index, values = encoder(pieces)
        own = np.fromiter(map(len, values), np.int64, len(values))[index] // 4
        counts += np.bincount(owner, own, len(texts)).astype(np.int64)
    return counts


def ids(path: str, texts: pa.Array, encoder: Encoder | None) -> Iterator[np.ndarray]:
    """Ids of whole texts, in order; a window in memory, and what is begun of one text."""
    if encoder is None:
        for lo, hi in byte_batches(texts):
            for x in ids_of(path, texts.slice(lo, hi - lo).to_pylist()):
                yield np.frombuffer(x, "<u4")
        return
    done, begun = 0, []
    for pieces, owner in windows(texts):
        index, values = encoder(pieces)
        size = np.fromiter(map(len, values), np.int64, len(values)) // 4
        table, first = np.frombuffer(b"".join(values), "<u4"), np.cumsum(size) - size
        own = size[index]
        ends = np.cumsum(own)
        out = table[np.repeat(first[index] - (ends - own), own) + np.arange(int(own.sum()))]
        edge = np.flatnonzero(np.diff(owner)) + 1  # where another text begins
        places = [0, *ends[edge - 1].tolist(), len(out)]
        for k, row in enumerate(owner[np.concatenate([[0], edge])].tolist()):
            while done < row:
                yield np.concatenate(begun) if begun else np.zeros(0, "<u4")
                begun, done = [], done + 1
            begun.append(out[places[k] : places[k + 1]])
    while done < len(texts):
        yield np.concatenate(begun) if begun else np.zeros(0, "<u4")
        begun, done = [], done + 1
