"""The operators of this subpackage applied to whole test tables, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from millrace.llm import bpe, collocations, decontaminate, htmltext, lexical, licences, minhash, mixing, quality, repeats, shards, toxicity, vectors
from millrace.llm.tables import read_table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        LLM_QUERIES[name] = function
        if sql is not None:
            LLM_ORACLES[name] = sql
        return function

    return keep


_SEED_COLUMNS = ", ".join(f"lead(w0, {k}) OVER p AS w{k}" for k in range(1, 10))


def _seed_sql(table: str, rest: str) -> str:
    """Rows of every mask whose stretch lies within the text; kept words stand for their hash."""
    return " UNION ALL ".join(
        f"SELECT {rest}, {n} AS m, {" || chr(1) || ".join(f'w{k}' for k in mask)} AS k FROM {table} WHERE w{mask[-1]} IS NOT NULL"
        for n, mask in enumerate(decontaminate.MASKS)
    )


#: Items of the test table are all longer than the masks, so the mask for short items is left out.
_OP1_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS item FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS pos FROM d),
bw AS (SELECT item_id, item, unnest(item) AS w0, generate_subscripts(item, 1) - 1 AS place FROM b WHERE len(item) >= 5),
dl AS (SELECT *, {_SEED_COLUMNS} FROM dw WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
bl AS (SELECT *, {_SEED_COLUMNS} FROM bw WINDOW p AS (PARTITION BY item_id ORDER BY place)),
ds AS ({_seed_sql("dl", "doc_id, pos")}),
bs AS ({_seed_sql("bl", "item_id, item, place")}),
h AS (SELECT DISTINCT doc_id, pos, item_id, item, place, least(len(item), 20) AS n FROM ds JOIN bs USING (m, k)),
e AS (SELECT doc_id, item_id, n, list_transform(range(-19, 29), lambda j: CASE WHEN place + j >= 0 AND pos + j >= 0 AND coalesce(item[place + j + 1] = w[pos + j + 1], false) THEN 1 ELSE 0 END) AS q
  FROM h JOIN d USING (doc_id)),
o AS (SELECT doc_id, item_id, max(list_max(list_transform(range(0, 49 - n), lambda s: list_sum(q[s + 1 : s + n]))) / n) AS overlap FROM e GROUP BY 1, 2),
g AS (SELECT doc_id, count(*) AS n_items, max(overlap) AS overlap, min(item_id) AS first_item FROM o WHERE overlap >= 0.8 GROUP BY 1)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, CAST(coalesce(overlap, 0) AS DOUBLE) AS overlap, first_item FROM documents LEFT JOIN g USING (doc_id)
"""


@query("op1_decontaminate", _OP1_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(docs, read_table(spark, sf_dir, "benchmark"))


#: Bytes as pairs of hexadecimal digits; covered spans from the starts of repeated strings.
_OP2_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 199)) AS s, x FROM d WHERE len(x) >= 400),
k AS (SELECT doc_id, s, md5(substr(x, 2 * s + 1, 400)) AS m FROM w),
r AS (SELECT doc_id, s FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
f AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 200 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT doc_id, s, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS span FROM f),
c AS (SELECT doc_id, span, min(s) AS a, max(s) + 200 AS b FROM g GROUP BY 1, 2),
z AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM c),
y AS (SELECT doc_id, count(*) AS n, sum(b - a) AS cut, max(b) AS last, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head FROM z JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, len(x) // 2 AS n_bytes, CAST(coalesce(cut, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN y USING (doc_id)
"""


@query("op2_repeats", _OP2_SQL)
def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, 200).drop("text", "kept")


def held_out(key: str = "doc_id"):
    """Rows that are never learnt from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 3 == 1


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), ~held_out())
    return toxicity.score(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")
    )


_COMPONENTS_SQL = """
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT id, id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON r.id = e.a)"""

_OP4_SQL = f"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id AS id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM t),
v AS (SELECT id, len(g) AS n FROM s),
u AS (SELECT id, unnest(g) AS x FROM s),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS k FROM u x JOIN u y ON x.x = y.x AND x.id < y.id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN v x ON x.id = a JOIN v y ON y.id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),{_COMPONENTS_SQL}
SELECT id AS doc_id, n AS n_shingles, min(c) AS component_id, id = min(c) AS kept FROM r JOIN v USING (id) GROUP BY id, n
"""


@query("op4_minhash", _OP4_SQL)
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, size=3, percent=85)


def _places_sql(names: dict[str, str], base: bool) -> str:
    """(doc_id, pos, label, base) where a phrase's words stand one after another in ``l``."""
    return " UNION ALL ".join(
        f"SELECT doc_id, pos, '{label}' AS label, {base} AS base FROM l WHERE " + " AND ".join(f"w{k} = '{word}'" for k, word in enumerate(phrase.split()))
        for phrase, label in names.items()
    )


_MOST_WORDS = max(len(p.split()) for p in (*licences.BASE_PHRASES, *licences.NOTICES))

#: The test table has no identifier tags, so the expressions behind them are left out.
_OP5_SQL = f"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda k: k <> '') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) - 1 AS pos FROM t),
l AS MATERIALIZED (SELECT *, {", ".join(f"lead(w0, {k}) OVER p AS w{k}" for k in range(1, _MOST_WORDS))} FROM u WINDOW p AS (PARTITION BY doc_id ORDER BY pos)),
m AS ({_places_sql(licences.BASE_PHRASES, True)} UNION ALL {_places_sql(licences.NOTICES, False)}),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE base) AS n_base, min(pos) FILTER (WHERE base) AS first_word, max(pos) FILTER (WHERE base) AS last_word,
  list_sort(list(DISTINCT label) FILTER (WHERE base)) AS bl, list_sort(list(DISTINCT label)) AS al FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(bl, ','), '') AS base_labels,
  coalesce(array_to_string(al, ','), '') AS labels, 1.0 - CAST(0.4 AS DOUBLE) ** coalesce(n, 0) AS score, CAST(0 AS BIGINT) AS n_tags,
  CASE WHEN n > 0 THEN len(list_filter(al, lambda k: k NOT IN ({", ".join(f"'{k}'" for k in sorted(licences.PERMISSIVE))}))) = 0 END AS permitted
FROM t LEFT JOIN g USING (doc_id)
"""


@query("op5_licences", _OP5_SQL)
def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan_licences(docs).drop("text")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN).drop("text")


@query("op7_quality")
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.grade(docs, model).drop("text")


@query("op8_shards")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return shards.assign_shards(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


_OP9_SQL = f"""
WITH RECURSIVE x AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS u FROM embeddings),
g AS (SELECT * FROM x WHERE label IS NOT NULL AND len(u) > 0 AND len(list_filter(u, lambda k: k IS NULL OR isnan(k) OR isinf(k))) = 0 AND len(list_filter(u, lambda k: k <> 0)) > 0),
l AS (SELECT y.id AS a, z.id AS b FROM g y JOIN g z ON y.label = z.label AND y.id < z.id AND len(y.u) = len(z.u) WHERE list_cosine_similarity(y.u, z.u) >= 0.93),
v AS (SELECT id FROM x),{_COMPONENTS_SQL},
c AS (SELECT a AS id, count(*) AS n FROM e GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, min(c) AS component_id, id = min(c) AS kept FROM r LEFT JOIN c USING (id) GROUP BY id, n
"""


@query("op9_vectors", _OP9_SQL)
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.linked_vectors(read_table(spark, sf_dir, "embeddings"), 0.93)


#: For the make of the test pages: the blocks of the only article.
_OP10_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS x FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?(p|h1|h2|h3|div|ul|ol|li|blockquote|section)>', chr(1), 'g'), '<[^>]*>', '', 'g') AS x FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&') AS x FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(x, chr(1)), lambda k: trim(regexp_replace(k, '\s+', ' ', 'g'))), lambda k: k <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""


@query("op10_main_text", _OP10_SQL)
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    text = htmltext.extract_main_text(pages)
    return text.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11_SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER_SQL}, '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents),
l AS (SELECT lang, list_filter(regexp_split_to_array(x, '[\\x20\\x09]+'), lambda k: k <> '') AS w FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 6), lambda n: list_transform(range(1, len(w) - n + 2), lambda i: w[i : i + n - 1])))) AS ph FROM l),
f AS (SELECT lang, ph, count(*) AS c FROM g GROUP BY ALL),
t AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE len(ph) = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE len(ph) > 1 AND c >= 100),
i AS (SELECT lang, c, ph, unnest(range(1, len(ph))) AS a FROM c),
j AS (SELECT lang, c, len(ph) AS m, unnest(list_transform(range(a + 1, len(ph) + 1), lambda b: ph[a:b])) AS ph FROM i
  UNION ALL SELECT lang, c, len(ph), ph[len(ph) - 1 :] FROM c),
x AS (SELECT DISTINCT s.lang, s.ph FROM j JOIN c s ON j.lang = s.lang AND j.ph = s.ph AND j.m > len(s.ph) WHERE 100 * j.c >= 100 * s.c),
k AS (SELECT lang, c, ph, unnest(range(1, len(ph))) AS k FROM c ANTI JOIN x USING (lang, ph)),
s AS (SELECT k.lang, k.ph, k.c AS a, y.c AS l, z.c AS r, n, k, (CAST(1000 AS HUGEINT) * k.c * n) // (CAST(y.c AS HUGEINT) * z.c) AS score
  FROM k JOIN f y ON y.lang = k.lang AND y.ph = k.ph[1 : k] JOIN f z ON z.lang = k.lang AND z.ph = k.ph[k + 1 :] JOIN t ON t.lang = k.lang),
b AS (SELECT *, array_to_string(ph, ' ') AS phrase FROM s QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score, CAST(k AS INTEGER) AS cut
FROM b QUALIFY rank <= 2000
"""


@query("op11_collocations", _OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(read_table(spark, sf_dir, "documents").select("lang", "text"))


def seventh(key: str = "doc_id"):
    """Rows that the language model never learns from: crc32 of the id as text leaves 2 when divided by 7."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


@query("op12_mixing")
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = mixing.score_texts(docs, ~seventh(), keep=["doc_id"])
    return scored.select("doc_id", seventh().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


_TERMS_SQL = f"regexp_extract_all({_LOWER_SQL}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

_OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS w FROM documents),
e AS (SELECT doc_id, len(w) AS n, w FROM d WHERE len(w) > 0),
z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM e),
f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM e) GROUP BY 1, 2),
g AS (SELECT t, CAST(floor(1000 * ln((2 * nn + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, z GROUP BY t, nn),
q AS (SELECT item_id, t, count(*) AS k FROM (SELECT item_id, unnest({_TERMS_SQL}) AS t FROM benchmark) GROUP BY 1, 2),
m AS (SELECT doc_id, 100 - 25 + ((25 * n * nn) // ll) AS m FROM e, z),
s AS (SELECT item_id, doc_id, CAST(sum(k * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN g USING (t) JOIN f USING (t) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 20
"""


@query("op13_search", _OP13_SQL)
def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search_texts(docs, read_table(spark, sf_dir, "benchmark").select("item_id", "text"), 20)


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
