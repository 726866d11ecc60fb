"""Collocations, context mixing and ranked search against brute force on small tables with awkward rows."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import collocations, lexical, mixing
from millrace.llm.queries import LLM_QUERIES, seventh


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def random_text(rng, words, size):
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", ". ", ", ", "\t", "\n", "!? ", "  "]) for _ in range(size))


# Collocations.


def collocated(rows, least, longest, top, covered=100):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, longest + 1):
                f.update((lang, tuple(w[i : i + size])) for i in range(len(w) - size + 1))
    found = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    inner = {(l, w[i:j]) for (l, w), v in found.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1)
             if j - i < len(w) and 100 * v >= covered * f[l, w[i:j]]}
    out = collections.defaultdict(list)
    for (l, w), a in found.items():
        if (l, w) not in inner:
            score, k = min((1000 * a * n[l] // (f[l, w[:k]] * f[l, w[k:]]), k) for k in range(1, len(w)))
            out[l].append((-score, -a, " ".join(w).encode(), f[l, w[:k]], f[l, w[k:]], n[l], k))
    return sorted(
        (l, i + 1, p.decode(), -a, left, right, total, -s, k) for l, rows in out.items() for i, (s, a, p, left, right, total, k) in enumerate(sorted(rows)[:top])
    )


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(3)
    words = "a A b c d ee Ff g \x01 a\x01 é É the of".split(" ")
    rows = [(random_text(rng, words, rng.randint(0, 60)), rng.choice(["en", "de", None, ""])) for _ in range(250)]
    rows += [(None, "en"), ("", "en"), (" . , ", "x"), ("New york city hall the Big one " * 50, "en"), ("w" * 70_000 + " " + "w" * 70_000, "en")]
    return rows + [("only copies of this sentence stand here.", "en")] * 30


@pytest.mark.parametrize(("least", "longest", "top", "covered"), [(3, 5, 50, 100), (2, 3, 2000, 100), (3, 5, 2000, 60), (3, 4, None, 100)])
def test_collocations(spark, phrases, least, longest, top, covered):
    df = spark.createDataFrame([(t, l, "n", 5) for t, l in phrases], "text string, lang string, phrase string, n int").repartition(5)
    got = sorted(tuple(r) for r in collocations.mine_collocations(df, least, longest, top, covered).collect())
    assert got == collocated(phrases, least, longest, top, covered)


def test_full_filter_changes_nothing(spark, phrases, monkeypatch):
    """A bitmap without free bits lets everything through."""
    df = spark.createDataFrame(phrases, "text string, lang string")
    monkeypatch.setattr(collocations, "_bitmap", lambda level: b"\xff" * (8 << (collocations.FILTER_BITS - 6)))
    got = sorted(tuple(r) for r in collocations.mine_collocations(df, 3, 3, 500).collect())
    assert got == collocated(phrases, 3, 3, 500)


def test_products_beyond_64_bits(spark):
    """Counts of a large corpus: the quotient is exact."""
    row = spark.sql("SELECT 9000000000L AS a, 9000000000000L AS n, 9000000001L AS l, 9000000007L AS r")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    got = row.select(F.call_function("div", F.lit(1000).cast("decimal(4,0)") * wide("a") * wide("n"), wide("l") * wide("r"))).first()[0]
    assert got == 1000 * 9000000000 * 9000000000000 // (9000000001 * 9000000007)


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert collocations.mine_collocations(empty).collect() == []
    assert collocations.mine_collocations(spark.createDataFrame([("a b", "x"), (None, None)], "text string, lang string")).collect() == []


# Context mixing.


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = "a A b c d ee Ff g x1 é É the of and rare1 rare2 zz".split(" ")
    rows = [(k, random_text(rng, [*words, f"u{rng.randint(0, 500)}"], rng.randint(0, 80))) for k in range(160)]
    return rows + [(None, "the w1 w2 rare1"), (7, None), (8, ""), (9, "..."), (9, "a b the"), (9, "a b the"), (500, "x" * 9000), (501, "the of " * 900)]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, score string, _0 int").repartition(5)


def units_of(text):
    """(window, prefix, byte) of each place, byte by byte."""
    body = b"\xff" * 5 + lower(text).encode() + b"\xff"
    out = []
    for i in range(5, len(body)):
        start = i
        while start and body[start - 1] not in b"\x20\x09\x0a\x0b\x0c\x0d\xff":
            start -= 1
        out.append((body[i - 5 : i], body[max(start, i - mixing.WORD_BYTES) : i], body[i]))
    return out


@pytest.mark.parametrize(("sent", "piece"), [(200_000, 4 << 20), (3, 700)])
def test_base_scores(spark, texts, sent, piece, monkeypatch):
    monkeypatch.setattr(mixing, "SENT_TOKENS", sent)
    monkeypatch.setattr(mixing, "PIECE", piece)
    tokens = lambda t: [*re.findall("[^\x20\x09-\x0d]+", lower(t)), ""]
    c = collections.Counter(w for i, t in texts if not held(i) for w in tokens(t))
    total, kinds = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in texts:
        w = tokens(t)
        want[i, held(i), len(w), sum(x in c for x in w), total, round(sum(math.log10((c[x] + 1) / (total + kinds + 1)) for x in w), 4)] += 1
    got = mixing.score_texts(frame(spark, texts), ~seventh())
    assert got.columns.count("score") == 1 and "_0" in got.columns
    rows = got.withColumn("held_out", seventh()).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == want


def test_scores_byte_by_byte(spark, texts, monkeypatch):
    """Slots, mixing and refinement again in plain Python, one bit at a time, with the learnt weights."""
    train = [t for i, t in texts if not held(i)]
    column = spark.createDataFrame([(t or "",) for t in train], "t string").repartition(3)
    model = mixing.fit(column)
    slots = mixing.Slots(model.bits)

    def places(past, prefix, node):
        window = np.array([int.from_bytes(past + b"\0", "big")], np.uint64)
        return [int(slots.at(context, np.array([node]))[0]) for context in slots.of(window, prefix)]

    # Hashes of beginnings of words as the operator has them; equal beginnings must share one.
    prefix_of = {}
    for t in {t or "" for _, t in texts}:
        (piece,) = mixing.pieces(pa.array([t]))
        for k, (past, word, byte) in zip(piece.code, units_of(t), strict=True):
            assert int(piece.units.window[k]) == int.from_bytes(past + bytes([byte]), "big")
            assert prefix_of.setdefault(word, int(piece.units.prefix[k])) == int(piece.units.prefix[k])
    assert len(set(prefix_of.values())) == len(prefix_of)
    key = lambda word: np.array([prefix_of[word]], np.uint64)
    counts, seen = collections.Counter(), collections.Counter(u for t in train for u in units_of(t))
    for (past, word, byte), n in seen.items():
        for j in range(8):
            for at in places(past, key(word), (1 << j) | (byte >> (8 - j))):
                counts[at, (byte >> (7 - j)) & 1] += n

    def one(past, word, node, j):
        odds, known = [], []
        for at in places(past, key(word), node):
            zeros, ones = counts[at, 0], counts[at, 1]
            odds.append(math.log((ones + 0.4) / (zeros + 0.4)))
            known.append(sum(zeros + ones > limit for limit in (0, 2, 15)))
        weights = model.weights[(j * 4 + known[-2]) * 4 + known[-1]]
        total = max(-8.0, min(8.0, sum(w * x for w, x in zip(weights, [*odds, 1]))))
        spot = (total + 8) * 2
        low = min(int(spot), 31)
        cells = model.refine[past[-1], j]
        refined = cells[low] * (1 - (spot - low)) + cells[low + 1] * (spot - low)
        return max(1e-6, min(1 - 1e-6, 0.5 / (1 + math.exp(-total)) + 0.5 * refined))

    def byte_share(past, word, byte):
        share = 1.0
        for j in range(8):
            p = one(past, word, (1 << j) | (byte >> (8 - j)), j)
            share *= p if (byte >> (7 - j)) & 1 else 1 - p
        return share

    for past, word, _ in units_of("the of")[:3]:
        assert abs(sum(byte_share(past, word, b) for b in range(256)) - 1) < 1e-4  # a distribution over all bytes
    got = {(r.doc_id, r.text): r.score for r in frame(spark, texts).transform(lambda d: mixing.score_texts(d.withColumn("text", F.col("text")), ~seventh())).collect()}
    for i, t in texts[:25] + texts[160:166]:
        want = sum(math.log10(byte_share(*u)) for u in units_of(t))
        assert abs(got[i, t] - want) < 1e-3 * max(1, -want)


def test_scores_beat_byte_shares(spark, sf_dir):
    """Held-out texts cost far fewer bits than under the shares of single bytes in the training texts."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = LLM_QUERIES["op12_mixing"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    shares = collections.Counter(b for i, t in texts.items() if not held(i) for b in lower(t).encode() + b"\xff")
    total = sum(shares.values()) + 256
    unseen = [r for r in rows if r.held_out]
    single = sum(math.log10((shares[b] + 1) / total) for r in unseen for b in lower(texts[r.doc_id]).encode() + b"\xff")
    assert len(unseen) > 10 and sum(r.score for r in unseen) > 0.65 * single
    assert all(r.score < 0 for r in rows)


def test_scores_without_training(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = mixing.score_texts(df, F.lit(False)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)]
    assert abs(rows[1].bits_per_byte - 8) < 1e-3
    assert mixing.score_texts(df.where("doc_id = 5"), F.lit(True)).collect() == []


@pytest.mark.parametrize("kinds", [1, 7, 5000])
def test_first_places(kinds):
    keys = np.random.default_rng(1).integers(0, 2**63, kinds).astype(np.uint64)
    own = keys[np.random.default_rng(2).integers(0, kinds, 40_000)]
    first, code = mixing._first_places(own)
    assert (own[first][code] == own).all() and len(first) == len(np.unique(own))


def test_counts_beyond_16_bits(spark):
    """A pair is halved until it fits; the rare side may vanish, and learning still gives finite weights."""
    docs = spark.createDataFrame([("a" * 90_000 + "b",), ("a" * 90_000,), ("abc",)], "t string")
    model = mixing.fit(docs)
    assert np.isfinite(model.weights).all() and ((model.refine > 0) & (model.refine < 1)).all()


def test_gathered_units_are_all_counted(spark, monkeypatch):
    """Packed units hold each (last bytes, word so far, byte) with its count, and grow with the rows."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(60)] + ["", "A a"]
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    for gathered in (1_500_000, 500):
        monkeypatch.setattr(mixing, "GATHERED", gathered)
        rows = mixing.gather_units(docs).collect()
        got = collections.Counter()
        for r in rows:
            for window, prefix, n in zip(np.frombuffer(r.window, np.uint64), np.frombuffer(r.prefix, np.uint64), np.frombuffer(r.n, np.int64)):
                assert (int(window), int(prefix)) not in got
                got[int(window), int(prefix)] = int(n)
        want = collections.Counter(u for t in texts for u in units_of(t))
        assert sorted(got.values()) == sorted(want.values()) and sum(r.units for r in rows) == len(want)
        windows = collections.Counter()
        for (past, _, byte), n in want.items():
            windows[int.from_bytes(past + bytes([byte]), "big")] += n
        for (window, _), n in got.items():
            windows[window] -= n
        assert not any(windows.values())
    few = mixing.gather_units(docs.limit(20)).agg(F.sum("units")).first()[0]
    assert len(want) > 1.5 * few


# Ranked search.


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower(text))


def ranked(rows, items, top):
    docs = [(i, collections.Counter(terms(t)), len(terms(t))) for i, t in rows if terms(t)]
    count, length = len(docs), sum(d[2] for d in docs)
    df = collections.Counter(w for d in docs for w in d[1])
    out = []
    for item, text in set(items):
        found = []
        for i, c, n in docs:
            m = 100 - 25 + 25 * n * count // length
            score = sum(k * math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, k in collections.Counter(terms(text)).items() if c[w])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def library():
    rng = random.Random(3)
    words = "a A b c d ee Ff g x1 é É the of and rare1 rare2 zz".split(" ") + [f"w{i}" for i in range(60)]
    rows = [(rng.choice([k, k // 2]), random_text(rng, words[: rng.choice([8, 77])], rng.randint(0, rng.choice([5, 60, 300])))) for k in range(400)]
    rows += [(None, "the w1 w2 rare1"), (7, None), (8, ""), (9, "..."), (9, "a b the"), (9, "a b the"), (600, "w3 of " * 30_000), (601, "y" * 90_000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for i in range(30)]
    return rows, items + [(100, None), (101, ""), (102, "nowhere"), (103, "the the w1"), (103, "the the w1"), (None, "rare1"), (104, "the"), (104, "w3")]


@pytest.mark.parametrize(("block", "queries", "sent"), [(1024, 1000, 500_000), (7, 5, 3)])
def test_search(spark, library, block, queries, sent, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical, "QUERIES", queries)
    monkeypatch.setattr(lexical, "SENT_TERMS", sent)
    rows, items = library
    docs = spark.createDataFrame([(i, t, 1, "m") for i, t in rows], "doc_id long, text string, tf int, m string").repartition(5)
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, score int")
    got = sorted((tuple(r) for r in lexical.search_texts(docs, asked, 20).collect()), key=str)
    assert got == ranked(rows, items, 20)


def test_blocks_hold_one_stratum_and_fall_by_frequency(spark, library):
    docs = spark.createDataFrame(library[0], "doc_id long, text string")
    index = lexical.build_index(docs)
    assert (index.documents, index.length) == (sum(bool(terms(t)) for _, t in library[0]), sum(len(terms(t)) for _, t in library[0]))
    norm = collections.defaultdict(set)
    for i, t in library[0]:
        if terms(t):
            norm[75 + 25 * len(terms(t)) * index.documents // index.length].add(i)
    for block in index.blocks.collect():
        assert set(block.docs) <= norm[block.m]
        at = 0
        for size in block.held:
            assert list(block.tf[at : at + size]) == sorted(block.tf[at : at + size], reverse=True)
            at += size


def test_bounds_skip_blocks(spark, library, monkeypatch):
    """Queries for a rare word touch fewer blocks than there are, and find the same."""
    rows, _ = library
    index = lexical.build_index(spark.createDataFrame(rows, "doc_id long, text string"))
    block = index.blocks.toArrow().to_batches()[0]
    queries = lexical.Queries(pa.array(["rare1", "the"]), np.array([5, 1]), np.array([0, 1]), np.array([0, 1]), np.array([1, 2]), 2)
    for i in range(block.num_rows):
        opened = lexical._opened(block, i, queries)
        limits = lexical._bounds(queries, opened)
        assert (limits == 0).tolist() == [bool(a == b) for a, b in zip(opened.first, opened.last)]


def test_search_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.search_texts(docs, items).collect() == []
    assert lexical.search_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), items.limit(0)).collect() == []
