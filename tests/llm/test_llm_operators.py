"""Operators of the llm subpackage against brute force on small tables with awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, decontaminate, htmltext, licences, minhash, quality, repeats, shards, toxicity, vectors
from millrace.llm.components import connected_components

WORDS = [a + b for a in "ba ce di fo gu la me ni po ru".split() for b in "ta se ki no vu".split()]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, NULLs, empty and long texts, repeated rows."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(20, 120)) for _ in range(40)]
    passage = sentence(rng, 60)
    texts: list[str | None] = list(base)
    texts += base[:5]  # exact copies
    for text in base[5:15]:  # near copies, some changed in few words and some in many
        words = text.split(" ")
        for _ in range(rng.choice((1, 2, 8))):
            words[rng.randrange(len(words))] = rng.choice(WORDS).upper()
        texts.append(" ".join(words))
    texts += [base[20] + " " + passage, passage + " " + base[21], base[22][:50] + passage + base[23], passage[:230]]
    texts += [None, "", " \t\n", "one", "one two", "One TWO", "ünïcode ßtraße 日本語 " * 20, "ab" * 400, "x" * 1000, sentence(rng, 3000)]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [out[3], out[3], (None, base[1])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Extra columns take the names of results and of inner columns.
    schema = "doc_id long, text string, kept string, d int, n_words string, shard int, score string, t string, _0 int"
    return spark.createDataFrame([(i, t, "k", 1, "w", 2, "s", "t", 0) for i, t in rows], schema).repartition(4)


def shingles(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if len(words) >= size:
        return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return frozenset([tuple(words)]) if words else frozenset()


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, rows, size, percent):
    got = collections.defaultdict(list)
    for r in minhash.near_duplicates(docs, size, percent).collect():
        got[r.doc_id].append(r)
    assert sum(map(len, got.values())) == len(rows)
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if j < i and both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    for i in sets:
        for r in got[i]:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[i]), find(i), find(i) == i)


def test_open_buckets_join_components(spark):
    """Chains of edits: ends differ too much, neighbours link; small chunks deal one bucket to many tasks."""
    rng = random.Random(9)
    words = sentence(rng, 200).split(" ")
    table = []
    for i in range(60):
        words = list(words)
        words[rng.randrange(200)] = f"edit{i}"
        table.append((rng.randrange(10**9), " ".join(words)))
    df = spark.createDataFrame(table, "doc_id long, text string")
    old, minhash.CHUNK = minhash.CHUNK, 8
    try:
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 3, 85).collect()}
    finally:
        minhash.CHUNK = old
    assert set(got.values()) == {min(i for i, _ in table)}


def removed(rows, length):
    bodies = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[s : s + length] for _, b in bodies for s in range(len(b) - length + 1))
    out = collections.Counter()
    for i, b in bodies:
        cover = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                cover[s : s + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, cover) if not c)
        spans = sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1]))
        out[i, len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("bucket", [10_000, 1])  # with 1 every undecided seed is counted by hash
def test_remove_repeats(docs, rows, bucket):
    got = repeats.remove_repeats(docs, 200, bucket=bucket)
    assert got.columns.count("kept") == 1
    found = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect())
    assert found == removed(rows, 200)


def test_long_text_in_windows(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    data[5000:5600] = data[1000:1600]
    whole = {(int(a), int(l), int(h)) for f in repeats.find_anchors(data, np.array([0, 9000]), 200) for a, l, h in zip(f.at, f.low, f.high)}
    monkeypatch.setattr(repeats, "WINDOW", 700)
    cut = {(int(a), s) for f in repeats.find_anchors(data, np.array([0, 9000]), 200) for a, l, h in zip(f.at, f.low, f.high) for s in range(int(l), int(h) + 1)}
    assert cut == {(a, s) for a, l, h in whole for s in range(l, h + 1)}
    assert len(cut) == 9000 - 199  # every stretch has one owner


def test_maximal_repeats_have_all_occurrences():
    left = [b"abc", b"abd", b"xbc", b"abc"]
    right = [b"seedxx", b"seedxy", b"seedxx", b"seedz"]
    found = {(before, after, tuple(sorted(m))) for before, after, m in repeats.maximal_repeats(left, right, 5)}
    assert (0, 6, (0, 2)) in found and (2, 5, (0, 1)) in found and (3, 4, (0, 3)) in found
    for before, after, members in found:
        assert len({left[i][:before] + right[i][:after] for i in members}) == 1


@pytest.fixture(scope="module")
def benchmark_rows():
    rng = random.Random(21)
    return [(1, sentence(rng, 40)), (2, sentence(rng, 15)), (3, sentence(rng, 7)), (4, "too short"), (5, None), (None, sentence(rng, 30)), (1, sentence(rng, 25))]


def test_decontamination(spark, rows, benchmark_rows):
    rng = random.Random(2)
    long, middle, short = benchmark_rows[0][1], benchmark_rows[1][1], benchmark_rows[2][1]
    swapped = long.split(" ")
    for k in (3, 11, 20, 33):
        swapped[k] = "zzz"
    ruined = [w if k % 2 else "zzz" for k, w in enumerate(long.split(" "))]
    planted = {
        1000: sentence(rng, 30) + " " + long.upper(), 1001: " ".join(swapped), 1002: sentence(rng, 200) + ", " + middle.replace(" ", "; ") + ".",
        1003: short, 1004: " ".join(long.split(" ")[8:30]),
    }
    clean = {2000: " ".join(ruined), 2001: "too short", 2002: benchmark_rows[5][1], 2003: " ".join(long.split(" ")[:8])}
    table = [(i, t) for i, t in rows] + [*planted.items(), *clean.items()]
    df = spark.createDataFrame([(i, t, 7) for i, t in table], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    got = decontaminate.contamination(df, bench)
    assert got.count() == len(table)
    assert {r.doc_id for r in got.where("contaminated").collect()} == set(planted)
    none = decontaminate.contamination(df, bench.limit(0))
    assert none.where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, benchmark_rows, monkeypatch):
    df = spark.createDataFrame([(1, benchmark_rows[0][1]), (2, "nothing of that kind here at all")], "doc_id long, text string")
    bench = spark.createDataFrame(benchmark_rows, "item_id long, text string")
    want = decontaminate.overlaps(df, bench).collect()
    monkeypatch.setattr(decontaminate, "BLOCK_SEEDS", 60)
    assert sorted(decontaminate.overlaps(df, bench).collect()) == sorted(want)


def test_licences(spark):
    table = [
        (1, "Released under the MIT License. Under  the\nmit-license!"), (2, "Apache License, Version 2.0 and CC BY-NC 4.0"), (3, None), (4, ""),
        (5, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0 WITH LLVM-exception */"), (6, "sunder the mit licenses"),
        (7, "SPDX-License-Identifier: MIT AND AND"), (8, "word " * 30_000 + "cc by nc"), (9, "SPDX-License-Identifier: GPL-3.0-or-later"), (1, "cc by nc"),
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in table], "doc_id long, text string, labels string")
    got = {(r.doc_id, r.text): r for r in licences.scan_licences(df).collect()}
    for i, text in table:
        r = got[i, text]
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        places = [(k, label) for p, label in licences.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert 0 <= r.score <= 1
    assert got[5, table[4][1]].labels == "apache-2,gpl-2,mit" and got[5, table[4][1]].permitted
    assert got[7, table[6][1]].labels == "" and got[9, table[8][1]].permitted is False


def test_expressions():
    value = lambda text: licences.evaluate(licences.parse_expression(text))[1]
    assert value("MIT OR GPL-3.0-only") and not value("MIT AND GPL-3.0-only")
    assert value("GPL-2.0-only AND ISC OR MIT") and not value("GPL-2.0-only AND (ISC OR MIT)")
    assert value("Apache-2.0 WITH LLVM-exception")
    assert all(licences.parse_expression(x) is None for x in ("", "MIT OR", "(MIT", "MIT)", "MIT MIT", "AND MIT", "()"))


def test_bpe_equals_library(docs, rows):
    import base64

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = collections.Counter()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.encode_decode(docs, path, public_tokenizers.PATTERN, with_ids=True)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert all(len(r.ids) == r.n_tokens for r in got.collect())


def test_bpe_lower_rank_after_merge():
    """A merge may make a pair of lower rank; it goes first, as in a single piece."""
    merges = bpe.Merges.__new__(bpe.Merges)
    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab", b"bb"]
    merges.ranks = {t: i for i, t in enumerate(tokens)}
    merges.tokens = dict(enumerate(tokens))
    merges.single, merges.pairs = list(range(256)), {}
    for piece in (b"ababcabc", b"abcabab", b"bbbb", b"abbbbc"):
        parts = [bytes([b]) for b in piece]
        while True:
            ranks = [merges.ranks.get(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
            if not ranks or min(ranks) == 1 << 30:
                break
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        assert np.frombuffer(merges.replay([piece])[0], np.uint32).tolist() == [merges.ranks[p] for p in parts]


def test_shards(docs, rows):
    got = shards.assign_shards(docs, 5).collect()
    want = collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots, sizes = collections.defaultdict(list), collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 8 for _, t in rows)
    assert max(sizes.values()) - min(sizes[k] for k in range(5)) <= 2 * largest
    assert shards.assign_shards(docs.limit(0), 5).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(4)
    table, n = [], 0
    for label in (0, 1, None):
        centres = rng.standard_normal((6, 16))
        for centre in centres:
            for spread in (0.0, 0.05, 0.2, 0.3, 0.4, 0.6):
                table.append((n, (centre + spread * rng.standard_normal(16)).astype(np.float32).tolist(), label))
                n += 1
    table += [(n, table[0][1], 0), (n + 1, table[0][1], 0), (n + 2, [0.0] * 16, 0), (n + 3, None, 0), (n + 4, [float("nan")] * 16, 0), (n + 5, [1e30] * 16, 1), (n + 6, [], 0), (n + 7, [None] * 16, 1)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int")
    usable = lambda e: bool(e) and all(x is not None and np.isfinite(x) for x in e) and any(e)
    unit = {i: np.array(e) / np.linalg.norm(np.array(e)) for i, e, label in table if label is not None and usable(e)}
    group = {i: label for i, _, label in table}
    links = {i: [j for j in unit if j != i and group[i] == group[j] and unit[i] @ unit[j] >= 0.93] for i in unit}
    for chunk in (2048, 5):
        got = {r.vec_id: r for r in vectors.linked_vectors(df, 0.93, chunk=chunk).collect()}
        assert len(got) == len(table)
        for i, *_ in table:
            seen, todo = {i}, [i]
            while todo:
                for j in links.get(todo.pop(), ()):
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(seen), min(seen) == i)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in p and p[0] != p[1] for p in pairs)}


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Head</header><nav><ul><li>a<li>b</ul></nav>"
        "<main><div class='cookie-notice'>We use cookies</div><article><h1>Big &amp; bold</h1><p>First   long paragraph of the story,<br>with a break.<p>Short."
        "<script>var x='<p>no</p>'</script><form>Sign up</form><aside>Aside</aside><blockquote>Quoted words of some length here.</blockquote></article>"
        "<section id='comments'><p>Reader says something long enough to count as text.</p></section></main><footer>&copy; me</footer>"
    )
    assert htmltext.main_text(page) == "Big & bold\nFirst long paragraph of the story, with a break.\nShort.\nQuoted words of some length here."
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p></p><!-- x -->") == ""
    plain = "<div id=menu><a>x</a><a>y</a></div><h2>Title</h2><div><p>" + "A long line of text. " * 20 + "</p><p>" + "More of it. " * 30 + "</p></div><div class=footer>f</div>"
    assert htmltext.main_text(plain).split("\n")[0] == "Title" and len(htmltext.main_text(plain).split("\n")) == 3


def test_extracted_pages_keep_columns(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hello there</p></article>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in htmltext.extract_main_text(df).collect()}
    assert got == {1: "Hello there", 2: ""}


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.score(docs.select("doc_id", "text"), model).join(labels, "doc_id").where(held).select("score", "toxic").collect()
    bad, good = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    assert np.mean([b > g for b in bad for g in good]) > 0.75
    odd = spark.createDataFrame([(1, None, 0.0), (2, "", 0.0)], "doc_id long, text string, score double")
    assert len({r.score for r in toxicity.score(odd, model).collect()}) == 1
    assert {r.score for r in toxicity.score(odd, toxicity.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_ordinal_grades_recover_order(spark):
    rng = random.Random(8)
    table, grades = [], []
    for i in range(400):
        g = i % 3
        words = [rng.choice(WORDS) if rng.random() > 0.3 * g else "%%%" for _ in range(60)]
        table.append((i, " ".join(words)))
        grades.append((i, 2 - g))
    docs = spark.createDataFrame(table + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame(grades + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.grade(docs, model).collect()}
    assert np.mean([round(got[i].expected_grade) == g for i, g in grades]) > 0.95
    assert got[900].expected_grade == got[901].expected_grade and 0 <= got[900].tail_probability <= 1
    single = quality.fit(docs, labels.where("quality = 1"))
    assert {r.expected_grade for r in quality.grade(docs, single).collect()} == {1.0}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vecs = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (
        minhash.near_duplicates(docs), repeats.remove_repeats(docs), decontaminate.contamination(docs, bench), licences.scan_licences(docs),
        quality.grade(docs, quality.fit(docs, labels)), toxicity.score(docs, toxicity.fit(docs, labels)), vectors.linked_vectors(vecs),
        htmltext.extract_main_text(docs.withColumnRenamed("text", "html")),
    ):
        assert df.count() == 0
