"""Token ids and counts by pieces against the library, on every vocabulary file."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from graphloom.llm import pieces, sstable, token_counts
from tokenizers import Tokenizer

ATOMS = [
    " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", "a", "The", "the", ".", ",", "!!", "?", "'s", "'re", "'", "don't", "12", "3.5", "é", "Ü", "ß", "×", "÷", " ", " ", "　", "…", "“", "—",
    "中文", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "İ", "ǅ", "é", "́", "|", "#", "$", "%", "&", "*", "(", ")", "-", "_", "x" * 70, "\x85", "\x1c", "​", "ﬁ",
]


def texts(seed: int, n: int = 1_500) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS) for _ in range(rng.choice([0, 1, 2, 5, 30, 100]))) for _ in range(n)]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
@pytest.mark.parametrize("window", [40, 3_000])
def test_ids_are_the_library_s(file, window, monkeypatch):
    path = public_tokenizers.path(file)
    some = texts(window)
    if file.endswith(".model"):
        want = [x for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(some, num_threads=1)]
    else:
        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]
    encoder = pieces.Encoder(path) if pieces.splits_safely(path) else None
    assert (encoder is None) == file.endswith(".model")
    cut = pieces.windows
    monkeypatch.setattr(pieces, "windows", lambda t: cut(t, window))
    monkeypatch.setattr(pieces, "KEPT_BYTES", 100_000)
    assert [x.tolist() for x in pieces.ids(path, pa.array(some), encoder)] == want
    assert pieces.lengths(path, pa.array(some), encoder).tolist() == list(map(len, want))


def test_pieces_tile_each_text_and_stay_inside_it():
    some = texts(7)
    for window in (16, 1 << 20):
        rows = [b""] * len(some)
        for part, owner in pieces.windows(pa.array(some), window):
            for x, i in zip(part.to_pylist(), owner.tolist()):
                rows[i] += x
        assert rows == [x.encode() for x in some]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_every_vocabulary(spark, file):
    path, some = public_tokenizers.path(file), texts(3, 300)
    want = [len(x) for x in (sentencepiece.SentencePieceProcessor(model_file=path).encode(some) if file.endswith(".model") else [x.ids for x in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)])]
    got = token_counts.count_tokens(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string"), path).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {i: (len(x.encode()), n) for i, (x, n) in enumerate(zip(some, want))}


def test_shards_of_texts_without_a_safe_cut(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "1.1" * 40_000), (2, "中文" * 5_000), (2, ""), (3, "word " * 100_000), (4, None)]
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in sstable.token_shards(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    t = Tokenizer.from_file(path)
    ids = [(i, np.array(t.encode(x or "", add_special_tokens=False).ids + [0], "<u4")) for i, x in rows]
    assert got == {(i, len(x), zlib.crc32(x.tobytes())) for i, x in ids}
