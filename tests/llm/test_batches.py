"""What a worker of token_shards holds at once: a batch bounded in bytes and a bounded table of pieces."""

import pyarrow as pa

from graphloom.llm import pieces, sstable
from graphloom.llm.queries import vocabulary

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_shards_are_written_from_small_batches(spark, tmp_path, monkeypatch):
    seen, plain = [], sstable.checkpointed

    def spied(df):
        sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
        seen.extend(r.n for r in long_texts.mapInArrow(sizes, "n long").collect())
        return plain(df)

    long_texts = spark.range(0, 2_000, numPartitions=1).selectExpr("id doc_id", "repeat('some words ', 900) text")
    before = spark.conf.get(KEY, None)
    monkeypatch.setattr(sstable, "checkpointed", spied)
    got = sstable.token_shards(long_texts.limit(20), vocabulary("byte_bpe_50k.json"), folder=str(tmp_path / "shards"))
    assert got.count() == 20
    assert sum(seen) > 15e6 and max(seen) < 2 * sstable.BATCH_BYTES
    assert spark.conf.get(KEY, None) == before


def test_a_small_table_of_pieces_gives_the_same_ids():
    path = vocabulary("byte_bpe_50k.json")
    texts = pa.array([" ".join(f"word{i * 7919 % 5000}" for i in range(n, n + 900)) for n in range(0, 9_000, 900)])
    few, many = pieces.Encoder(path, 1 << 16), pieces.Encoder(path)
    for a, b in zip(pieces.ids(path, texts, few), pieces.ids(path, texts, many)):
        assert a.tolist() == b.tolist()
    assert few.size <= 1 << 15
