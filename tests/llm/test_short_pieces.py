"""Short pieces are merged in arrays: the ids of the library, and work of the interpreter by piece, not by byte."""

from __future__ import annotations

import base64
import random
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from millrace.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def pieces_of(count: int, longest: int, letters: str) -> list[bytes]:
    made = random.Random(7)
    return ["".join(made.choices(letters, k=made.randint(1, longest))).encode("utf-8") for _ in range(count)]


def test_ids_of_short_and_long_pieces(monkeypatch):
    monkeypatch.setattr(bpe, "SHORT_BYTES", 5000, raising=False)  # many blocks
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    pieces = pieces_of(3000, 30, "etaoinschrd ") + pieces_of(500, 90, "abñ漢🙂 !") + [b"a" * n for n in range(1, 200)] + [b" \n" * n for n in range(1, 70)]
    got = bpe.Merges(PATH).replay(pieces)
    assert [np.frombuffer(ids, np.uint32).tolist() for ids in got] == [library.encode_ordinary(p.decode()) for p in pieces]


def test_lower_ranks_after_merges_in_a_block():
    """With tokens of any order: always the leftmost pair of lowest rank, piece by piece."""
    made = random.Random(3)
    for _ in range(30):
        merges = bpe.Merges.__new__(bpe.Merges)
        tokens = [bytes([b]) for b in range(256)] + sorted({bytes(made.choices(b"ab", k=made.randint(2, 5))) for _ in range(12)}, key=lambda t: made.random())
        merges.ranks = {t: i for i, t in enumerate(tokens)}
        merges.tokens = dict(enumerate(tokens))
        merges.single, merges.pairs = list(range(256)), {}
        pieces = [bytes(made.choices(b"aabc", k=made.randint(1, 20))) for _ in range(40)]
        for piece, ids in zip(pieces, merges.replay(pieces)):
            parts = [piece] if piece in merges.ranks else [bytes([b]) for b in piece]
            while True:
                ranks = [merges.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
                if not ranks or min(ranks) == 1 << 30:
                    break
                k = ranks.index(min(ranks))
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            assert np.frombuffer(ids, np.uint32).tolist() == [merges.ranks[p] for p in parts]


def test_calls_follow_pieces_not_bytes():
    merges = bpe.Merges(PATH)
    merges.replay([b"qzqzqzjx"])  # tables are made
    pieces = list(dict.fromkeys(pieces_of(5000, 40, "etaoinschrdlu")))
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "c_call"

    sys.setprofile(count)
    try:
        merges.replay(pieces)
    finally:
        sys.setprofile(None)
    assert calls < 8 * len(pieces) + 5000


def test_pairs_of_long_pieces_are_bounded(monkeypatch):
    merges, pieces = bpe.Merges(PATH), [b"abcdefgh" * 30, b"zyxwvut" * 20]
    want = merges.replay(pieces)
    held = len(merges.pairs)
    assert held > 2
    monkeypatch.setattr(bpe, "PAIRS", held - 1)
    merges.pairs[-5, -6] = 7
    assert merges.replay(pieces) == want and (-5, -6) not in merges.pairs and len(merges.pairs) == held


def test_batches_that_leave_a_task_are_small(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    found, plain = {}, type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, schema: (found.update(work=work), plain(self, work, schema))[1])
    bpe.encode_decode(docs, PATH, public_tokenizers.PATTERN, with_ids=True)
    texts = [f"text {k}" for k in range(3000)]
    batch = pa.RecordBatch.from_pydict({"_0": list(range(3000)), "_1": texts, "_t": texts})
    made = [(b.num_rows, b.column(b.schema.get_field_index("decoded")).to_pylist()) for b in found["work"](iter([batch]))]
    assert max(n for n, _ in made) <= 512
    assert [t.decode() for _, part in made for t in part] == texts
