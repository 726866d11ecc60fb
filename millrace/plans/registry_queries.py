"""Registry and catalog queries.

Suppliers stand for models, parts for datasets and lines for the rows that link them. Catalog
documents are JSON built from part, links come from pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import catalog as K
from millrace.operators import profile as P
from millrace.operators import registry as G
from millrace.operators import sinks as S
from millrace.operators import versions
from millrace.plans.registry import query, table
from millrace.session import scratch_path
from millrace.sources import documents as D


def _models(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def _datasets(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


def _links(spark, sf_dir, condition):
    lines = table(spark, sf_dir, "lineitem").where(condition)
    return lines.select(F.col("l_suppkey").alias("learning_model_id"), F.col("l_partkey").alias("dataset_id"), "l_orderkey", "l_linenumber")


@query(
    "registry_subtypes",
    "REG-1",
    "SELECT p_partkey AS id, p_name AS name, 'dataset' AS object_type, p_type AS dataset_type, p_size AS size FROM part WHERE p_size > 10",
)
def registry_subtypes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    parent = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.lit("dataset").alias("object_type"))
    child = part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.lit("old").alias("name"), F.col("p_type").alias("dataset_type"), F.col("p_size").alias("size"))
    return G.with_parent(parent, child)


@query(
    "registry_pairs",
    "REG-2",
    """SELECT l_orderkey, l_linenumber, l_suppkey AS learning_model_id, l_partkey AS dataset_id, s_name AS model_name, p_name AS dataset_name
       FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5""",
)
def registry_pairs(spark, sf_dir):
    datasets = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return G.pairs_with_parents(_links(spark, sf_dir, "true"), _models(spark, sf_dir), datasets)


@query(
    "registry_dependencies",
    "REG-3",
    """SELECT p_partkey AS id, count(l_orderkey) FILTER (WHERE l_returnflag = 'R') AS linked_studies, count(l_orderkey) FILTER (WHERE l_returnflag = 'N') AS linked_inferences,
       count(l_orderkey) = 0 AS can_delete FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag IN ('R', 'N')) ON l_partkey = p_partkey GROUP BY p_partkey""",
)
def registry_dependencies(spark, sf_dir):
    studies = _links(spark, sf_dir, "l_returnflag = 'R'")
    inferences = _links(spark, sf_dir, "l_returnflag = 'N'")
    return G.dependency_report(_datasets(spark, sf_dir), studies, inferences, "dataset_id")


@query(
    "registry_lookup",
    "REG-4",
    """WITH k AS (SELECT DISTINCT CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE 'Supplier#' || printf('%09d', c_custkey) END AS key FROM customer)
       SELECT key, coalesce(i.s_suppkey, n.s_suppkey) AS id FROM k LEFT JOIN supplier i ON i.s_suppkey = TRY_CAST(key AS BIGINT) LEFT JOIN supplier n ON n.s_name = key""",
)
def registry_lookup(spark, sf_dir):
    c = F.col("c_custkey")
    keys = table(spark, sf_dir, "customer").select(
        F.when(c % 2 == 0, F.concat(F.lit(" "), c.cast("string"))).otherwise(F.concat(F.lit("Supplier#"), F.lpad(c.cast("string"), 9, "0"))).alias("key")
    )
    return G.lookup(_models(spark, sf_dir), keys)


_SPELLINGS = "CASE p_partkey % 6 WHEN 0 THEN ' CSV' WHEN 1 THEN 'time-series' WHEN 2 THEN 'Tabular ' WHEN 3 THEN 'dataset' WHEN 4 THEN 'custom' ELSE NULL END"


@query(
    "registry_type_repair",
    "REG-5",
    """SELECT dataset_type, count(*) AS n, count(*) FILTER (WHERE repaired) AS repaired FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'dataset' WHEN 1 THEN 'timeseries_dataset'
       WHEN 2 THEN 'dataset' WHEN 3 THEN 'dataset' WHEN 4 THEN 'custom' END AS dataset_type, p_partkey % 6 < 3 AS repaired FROM part) GROUP BY dataset_type""",
)
def registry_type_repair(spark, sf_dir):
    fixed = G.repair_types(table(spark, sf_dir, "part").select(F.expr(_SPELLINGS).alias("dataset_type")), "dataset_type")
    return fixed.groupBy("dataset_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("repaired").alias("repaired"))


@query(
    "registry_container_repair",
    "REG-6",
    """SELECT event_id, props AS params, '["' || event_type || '"]' AS history, CAST(event_id % 2 = 0 AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER) AS repaired FROM events""",
)
def registry_container_repair(spark, sf_dir):
    history = F.to_json(F.array("event_type"))
    wrapped = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    stored = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 2 == 0, wrapped(F.col("props"))).otherwise(F.col("props")).alias("params"),
        F.when(F.col("event_id") % 3 == 0, wrapped(history)).otherwise(history).alias("history"),
    )
    return G.repair_containers(stored, {"params": "{", "history": "["})


@query(
    "registry_payload_coercion",
    "REG-7",
    r"""SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k, CASE WHEN event_id % 4 <> 0 THEN 2 END AS size,
        CASE WHEN event_id % 5 <> 0 THEN strftime(date_trunc('second', ts) - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') END AS seen FROM events""",
)
def registry_payload_coercion(spark, sf_dir):
    e = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        "event_id", F.when(e % 3 != 0, F.concat(F.lit(" "), "props")).otherwise("").alias("params"),
        F.when(e % 4 != 0, F.to_json(F.array("event_type", F.lit("x")))).otherwise("plain").alias("features"),
        F.when(e % 5 != 0, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise("soon").alias("seen"),
    )
    return raw.select(
        "event_id", F.get_json_object(G.coerce_json(F.col("params")), "$.k").cast("bigint").alias("k"),
        F.when(G.coerce_array(F.col("features")).isNotNull(), F.size(G.coerce_array(F.col("features")))).alias("size"),
        F.date_format(G.coerce_datetime(F.col("seen")), "yyyy-MM-dd HH:mm:ss").alias("seen"),
    )


@query(
    "registry_compact_context",
    "REG-8",
    """WITH w AS (SELECT doc_id, regexp_split_to_array(text, '\\s+') AS f FROM documents WHERE text <> '')
       SELECT doc_id, CAST(len(f) AS INTEGER) AS features_count, array_to_string(f[1:24], ' ') AS features, CAST(least(16, 20) AS INTEGER) AS metric_count FROM w""".replace("'\\\\s+'", "'\\s+'"),
)
def registry_compact_context(spark, sf_dir):
    metrics = F.map_from_entries(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.struct(i.cast("string").alias("k"), (i + F.col("doc_id")).alias("v"))))
    docs = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", F.split("text", r"\s+").alias("features"), metrics.alias("metrics"))
    made = G.compact_context(docs, ["features"], ["metrics"], features=24, entries=16)
    return made.select("doc_id", "features_count", F.array_join("features", " ").alias("features"), F.size("metrics").alias("metric_count"))


@query(
    "registry_history",
    "REG-9",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'created' || '|' || o_orderstatus ELSE o_orderstatus END AS history FROM orders",
)
def registry_history(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("created"))).alias("history"))
    made = G.append_history(rows, F.col("o_orderstatus"))
    return made.select("o_orderkey", F.array_join("history", "|").alias("history"))


_UPSERTED = """
    WITH p AS (SELECT l_suppkey AS m, l_partkey AS d, sum(l_quantity) AS q, max(l_tax) AS t FROM lineitem GROUP BY 1, 2),
    o AS (SELECT *, m || ':' || d AS name, CASE WHEN d % 2 = 0 THEN '/old' END AS path FROM p WHERE d % 3 <> 0),
    n AS (SELECT *, 'new' AS name, CASE WHEN d % 5 <> 0 THEN '/new' END AS path FROM p WHERE d % 3 <> 1)
    SELECT coalesce(o.m, n.m) AS learning_model_id, coalesce(o.d, n.d) AS dataset_id, coalesce(o.name, n.name) AS name, coalesce(n.path, o.path) AS path,
      CASE WHEN n.m IS NULL THEN 'old' ELSE 'new' END AS status, CASE WHEN o.m IS NOT NULL THEN 'yes' END AS kept,
      CASE WHEN o.m IS NULL THEN 'sync' WHEN n.m IS NULL THEN 'made' ELSE 'made|sync' END AS history
    FROM o FULL JOIN n ON o.m = n.m AND o.d = n.d
    """


def _pairs(spark, sf_dir):
    """(stored, incoming) inference pairs from lineitem."""
    d = F.col("dataset_id")
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("learning_model_id"), F.col("l_partkey").alias("dataset_id")).distinct()
    stored = pairs.where(d % 3 != 0).select(
        "*", F.concat_ws(":", "learning_model_id", "dataset_id").alias("name"), F.when(d % 2 == 0, "/old").alias("path"), F.lit(1).alias("version"),
        F.create_map(F.lit("status"), F.lit("old"), F.lit("kept"), F.lit("yes")).alias("params"), F.array(F.lit("made")).alias("history"),
    )
    incoming = pairs.where(d % 3 != 1).select(
        "*", F.lit("new").alias("name"), F.when(d % 5 != 0, "/new").alias("path"), F.lit(2).alias("version"),
        F.create_map(F.lit("status"), F.lit("new")).alias("params"), F.lit("sync").alias("entry"),
    )
    return stored, incoming


def _shown(made):
    return made.select("learning_model_id", "dataset_id", "name", "path", F.col("params")["status"].alias("status"),
                       F.try_element_at("params", F.lit("kept")).alias("kept"), F.array_join("history", "|").alias("history"))


@query("registry_upsert_pairs", "SNK-6", _UPSERTED)
def registry_upsert_pairs(spark, sf_dir):
    return _shown(G.upsert_pairs(*_pairs(spark, sf_dir)))


@query("sink_upserted_pairs", "SNK-6", _UPSERTED)
def sink_upserted_pairs(spark, sf_dir):
    """The same pairs merged into a stored table, and read back from its second version."""
    root = scratch_path(spark, "pairs")
    stored, incoming = _pairs(spark, sf_dir)
    versions.replace_version(stored, root)
    return _shown(S.upsert_to(root, incoming))


def _documents(spark, sf_dir):
    """Portal and generic catalog documents from part."""
    p = F.col("p_partkey")
    none = F.lit(None).cast("string")

    def theme(title, name):  # to_json leaves NULL fields out
        return F.struct((none if title is None else title).alias("title"), (none if name is None else name).alias("name"))

    resource = F.struct(
        F.concat(F.lit("r"), p.cast("string")).alias("id"), F.when(p % 2 == 0, F.col("p_name")).alias("titulo"), F.lit("x.y").alias("name"),
        F.concat(F.lit("https://dados.gov.br/f/"), p.cast("string"), F.lit(".csv/view")).alias("link"), F.lit("CSV").alias("formato"), F.col("p_size").alias("tamanho"),
    )
    detail = F.struct(
        p.cast("string").alias("id"), F.when(p % 3 != 0, F.col("p_name")).alias("titulo"), F.col("p_brand").alias("nome"), F.lit("").alias("catalogacao"),
        F.col("p_brand").alias("organizacao"), F.array(theme(F.col("p_type"), None), theme(None, F.lit("extra"))).alias("temas"),
        F.array(F.struct(F.lit("t1").alias("name"))).alias("tags"), F.when(p % 4 != 0, F.array(resource, resource)).alias("recursos"),
        F.struct(F.struct(F.array(F.col("p_type"), F.col("p_brand")).alias("names")).alias("b")).alias("a"), F.lit("2024-01-01").alias("modified"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.to_json(detail).alias("doc"))


@query(
    "catalog_portal_items",
    "CAT-1 SRC-15",
    """SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE p_brand END AS title, p_brand AS name, '' AS category,
       p_brand AS organization, '' AS updated_at FROM part""",
)
def catalog_portal_items(spark, sf_dir):
    path = scratch_path(spark, "catalog")
    _documents(spark, sf_dir).select("doc").write.text(path)
    return K.portal_items(D.read_catalog(spark, path), "doc").select("external_id", "title", "name", "category", "organization", "updated_at")


@query(
    "catalog_generic_items",
    "CAT-2",
    """SELECT CAST(p_partkey AS VARCHAR) AS external_id, CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS title,
       CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE CAST(p_partkey AS VARCHAR) END AS name, p_brand AS category, '2024-01-01' AS updated_at FROM part""",
)
def catalog_generic_items(spark, sf_dir):
    made = K.generic_items(_documents(spark, sf_dir), "doc", {"category": "a.b.names[1]"})
    return made.select("external_id", "title", "name", "category", "updated_at")


@query(
    "catalog_details",
    "CAT-3",
    """SELECT CAST(p_partkey AS VARCHAR) AS external_id, p_type || ', extra' AS category, 't1' AS tags,
       CASE WHEN p_partkey % 4 <> 0 THEN 'r' || p_partkey END AS resource_external_id,
       CASE WHEN p_partkey % 4 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN p_name ELSE 'x.y' END AS resource_title,
       CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS BIGINT) END AS resource_size
       FROM part, range(2) t(i) WHERE p_partkey % 4 <> 0 OR i = 0""",
)
def catalog_details(spark, sf_dir):
    details = K.portal_details(_documents(spark, sf_dir), "doc").withColumn("tags", F.array_join("tags", ","))
    return K.resources(details, ["external_id", "category", "tags"]).select(
        "external_id", "category", "tags", "resource_external_id", "resource_title", "resource_size"
    )


@query(
    "catalog_resource_facts",
    "CAT-3",
    """SELECT p_partkey, 'r' || p_partkey AS resource_external_id, CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS BIGINT) WHEN 1 THEN CAST(p_size + 1 AS BIGINT) END AS resource_size,
       CAST(p_size * 2 AS BIGINT) AS resource_download_count, CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey % 7 AS BIGINT) END AS resource_order FROM part""",
)
def catalog_resource_facts(spark, sf_dir):
    """Sizes under either key; an own size that is null is not replaced by the other key."""
    p = F.col("p_partkey")
    text = F.concat(
        F.lit('{"id":"r'), p.cast("string"), F.lit('",'),
        F.when(p % 3 == 0, F.concat(F.lit('"tamanho":'), F.col("p_size").cast("string"), F.lit(',"size":-1,')))
        .when(p % 3 == 1, F.concat(F.lit('"size":'), (F.col("p_size") + 1).cast("string"), F.lit(","))).otherwise(F.lit('"tamanho":null,"size":5,')),
        F.when(p % 5 != 0, F.concat(F.lit('"numOrdem":'), (p % 7).cast("string"), F.lit(","))).otherwise(F.lit("")),
        F.lit('"quantidadeDownloads":'), (F.col("p_size") * 2).cast("string"), F.lit("}"),
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(text).alias("resources"))
    return K.resources(rows, ["p_partkey"]).select("p_partkey", "resource_external_id", "resource_size", "resource_download_count", "resource_order")


@query(
    "catalog_generic_resources",
    "CAT-2 CAT-3",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN 'r' || p_partkey END AS resource_external_id,
       CASE WHEN p_partkey % 4 <> 0 THEN 'https://dados.gov.br/f/' || p_partkey || '.csv/view' END AS resource_url, CASE WHEN p_partkey % 4 <> 0 THEN 'CSV' END AS resource_format
       FROM part, range(2) t(i) WHERE p_partkey % 4 <> 0 OR i = 0""",
)
def catalog_generic_resources(spark, sf_dir):
    made = K.generic_resources(_documents(spark, sf_dir), "doc", {"resources_path": "recursos"}, ["p_partkey"])
    return made.select("p_partkey", "resource_external_id", "resource_url", "resource_format")


@query(
    "catalog_formats",
    "CAT-4",
    """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'csv' WHEN 1 THEN 'pdf' WHEN 2 THEN 'json' WHEN 3 THEN 'parquet' WHEN 4 THEN 'csv' END AS extension,
       CASE p_partkey % 6 WHEN 1 THEN 'unsupported' WHEN 5 THEN 'unknown' ELSE 'supported' END AS format_status FROM part""",
)
def catalog_formats(spark, sf_dir):
    p = F.col("p_partkey")
    case = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (p % 6 + 1).cast("int"))
    named = table(spark, sf_dir, "part").select(
        "p_partkey", case("data%2Ecsv", None, None, "", None, "archive").alias("file_name"),
        case("http://x.org/a.pdf", "https://x.org/files/report.PDF/view?x=1", "https://x.org/api", "https://x.org/d/t.parquet#p", None, "https://x.org/q").alias("url"),
        case(None, "table.csv", "export.json", None, None, "thing").alias("title"), case(None, "csv", None, None, ".CSC", "shp").alias("declared"),
    )
    return K.resource_format(named, "file_name", "url", "title", "declared").select("p_partkey", "extension", "format_status")


@query(
    "catalog_page",
    "CAT-5",
    "SELECT p_partkey AS external_id, p_type AS category FROM part WHERE contains(lower(p_type), 'eco') ORDER BY p_partkey LIMIT 20 OFFSET 40",
)
def catalog_page(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("external_id"), F.col("p_type").alias("category"))
    return K.filter_catalog(items, "ECO", page=3)


@query(
    "catalog_connections",
    "CAT-6",
    """SELECT page_id, 'store://portal%20a/' || replace(url_encode(url), '+', '%20') || '/r' || page_id AS connection, 'portal a' AS provider_id, url AS dataset_external_id, 'r' || page_id AS resource_external_id FROM pages""",
)
def catalog_connections(spark, sf_dir):
    made = table(spark, sf_dir, "pages").select(
        "page_id", K.connection_string(F.lit("portal a"), F.col("url"), F.concat(F.lit("r"), F.col("page_id").cast("string"))).alias("connection")
    )
    return K.parse_connection(made, "connection")


@query(
    "catalog_direct_links",
    "CAT-7",
    """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.dados.gov.br/p/' || page_id || '/@@download/file?v=' || page_id ELSE 'https://example.org/p/' || page_id || '/view' END AS link FROM pages""",
)
def catalog_direct_links(spark, sf_dir):
    k = F.col("page_id").cast("string")
    link = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://www.dados.gov.br/p/"), k, F.lit("/view?v="), k)).otherwise(
        F.concat(F.lit("https://example.org/p/"), k, F.lit("/view"))
    )
    return table(spark, sf_dir, "pages").select("page_id", K.direct_url(F.lit("dados_gov_br"), link).alias("link"))


@query(
    "catalog_preview",
    "CAT-8",
    """SELECT p_partkey, p_name, (SELECT count(*) FROM part) AS row_count, 6 AS column_count, (SELECT count(DISTINCT p_brand) FROM part) AS brands
       FROM part ORDER BY p_partkey LIMIT 5""",
)
def catalog_preview(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    explorer = P.column_explorer(part, ["p_partkey"])
    head = part.orderBy("p_partkey").limit(5).select("p_partkey", "p_name")
    return head.withColumns({
        "row_count": explorer.agg(F.max("rows").alias("n")).scalar(), "column_count": F.lit(len(part.columns)),
        "brands": explorer.where("column = 'p_brand'").select("unique_count").scalar(),
    })
