"""What Python workers hold while they work and after it: bounded, and not kept for the stages that follow."""

from __future__ import annotations

import tracemalloc

import pyarrow as pa
import public_tokenizers

from millrace.llm import bpe, quality

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_pieces_are_given_up_with_the_task(spark):
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('piece', id, ' of text', id * 7) AS text").repartition(8)
    assert bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN).where("n_tokens > 0").count() == 200

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(bpe.load_encoder(PATH, public_tokenizers.PATTERN).known)] * batch.num_rows})

    assert {r.n for r in spark.range(800).repartition(8).mapInArrow(held, "n long").collect()} == {0}


def test_pieces_brought_together(monkeypatch):
    encoder, sizes = bpe.Encoder(PATH, public_tokenizers.PATTERN), []
    plain = encoder.merges.replay
    monkeypatch.setattr(encoder.merges, "replay", lambda pieces: (sizes.append(len(pieces)), plain(pieces))[1])
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}x{chr(97 + j)}{chr(97 + j // 26)}" for j in range(26)) for i in range(3000)]
    got = list(encoder.encode(texts))
    assert max(sizes) < 30_000
    assert [encoder.merges.decode(memoryview(ids).cast("I")).decode() for ids in got] == texts


def test_pairs_are_bounded(monkeypatch):
    merges = bpe.Merges(PATH)
    want = merges.replay([b"abcdefgh" * 3, b"zyxwvut"])
    monkeypatch.setattr(bpe, "PAIRS", 1, raising=False)
    merges.pairs[-5, -6] = 7
    assert merges.replay([b"abcdefgh" * 3, b"zyxwvut"]) == want and (-5, -6) not in merges.pairs


def test_quality_features_of_many_texts(spark, monkeypatch):
    """Trigrams of a batch are counted a part at a time."""
    texts = [f"{k} " + "some words and others " * 200 for k in range(700)]
    found = {}

    class Rows:
        def select(self, *names):
            return self

        def mapInArrow(self, work, schema):
            found["work"] = work
            return self

    quality._feature_rows(Rows())
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(700)), "y": pa.array([1] * 700, pa.int32()), "t": texts})
    tracemalloc.start()
    rows = sum(out.num_rows for out in found["work"](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert rows == 700 and peak < 40
