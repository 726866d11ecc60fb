"""Harvested catalog documents: normalising, resources, formats, links."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

# ---------------------------------------------------------------------------
# Key names of the two document styles and known file formats.
PORTAL_ITEM = {
    "external_id": ("id",), "title": ("title", "titulo", "nome"), "name": ("nome", "title"), "category": ("catalogacao",),
    "organization": ("nomeOrganizacao", "organizacao"), "updated_at": ("ultimaAtualizacaoDados", "ultimaAlteracaoMetadados"),
}
PORTAL_DETAIL = {
    "external_id": ("id",), "title": ("titulo", "title", "nome"), "name": ("nome", "titulo"), "description": ("descricao",),
    "organization": ("organizacao",), "license": ("licenca",), "periodicity": ("periodicidade",), "visibility": ("visibilidade",),
    "updated_at": ("dataUltimaAtualizacaoArquivo", "dataUltimaAtualizacaoMetadados"),
}
PORTAL_RESOURCE = {
    "external_id": ("id", "link", "url"), "title": ("titulo", "name", "nomeArquivo", "id"), "description": ("descricao", "description"),
    "url": ("link", "url"), "format": ("formato", "format"), "type": ("tipo",), "file_name": ("nomeArquivo",),
    "updated_at": ("dataUltimaAtualizacaoArquivo", "last_modified", "metadata_modified"),
}
GENERIC_ITEM = {
    "external_id": ("item_id", ("id", "name", "slug", "url")), "title": ("title", ("title", "titulo", "name")), "name": ("name", ("name", "slug")),
    "category": ("category", ("category", "catalogacao", "theme")), "organization": ("organization", ("organization", "org", "publisher")),
    "updated_at": ("updated_at", ("updated_at", "modified", "last_modified")),
}
GENERIC_RESOURCE = {
    "external_id": ("resource_id", ("id", "url", "link")), "title": ("resource_title", ("title", "name", "titulo", "nomeArquivo")),
    "url": ("resource_url", ("url", "link", "download_url")), "format": ("resource_format", ("format", "formato")),
    "file_name": ("resource_file_name", ("file_name", "nomeArquivo")),
}
PREVIEW_FORMATS = ("csv", "tsv", "txt", "json", "jsonl", "parquet", "xlsx", "xls")
FORMAT_ALIASES = {"csc": "csv"}
REFUSED_FORMATS = ("doc", "docx", "html", "htm", "pdf", "ppt", "pptx", "rar", "zip")
# ---------------------------------------------------------------------------


def json_text(doc: Column, path: str) -> Column:
    """Text at a JSON path, NULL where missing or empty."""
    return F.nullif(F.get_json_object(doc, path), F.lit(""))


def first_text(doc: Column, keys: Sequence[str]) -> Column:
    return F.coalesce(*[json_text(doc, f"$.{k}") for k in keys], F.lit(""))


def json_path(path: str) -> str:
    """``a.b[0].c`` as a JSON path."""
    return "$" if path in ("", "$", ".") else "$." + path


def configured(doc: Column, mappings: Mapping[str, str], field: str, fallback: Sequence[str]) -> Column:
    """The mapped path if one is configured, else the first non-empty fallback key."""
    if mappings.get(field):
        return json_text(doc, json_path(str(mappings[field])))
    return F.nullif(first_text(doc, fallback), F.lit(""))


def portal_items(docs: DataFrame, doc: str) -> DataFrame:
    """Catalog list entries of the government-portal style."""
    return docs.select("*", *[first_text(F.col(doc), keys).alias(n) for n, keys in PORTAL_ITEM.items()], json_text(F.col(doc), "$.isAtualizado").alias("is_current"))


def generic_items(docs: DataFrame, doc: str, mappings: Mapping[str, str]) -> DataFrame:
    """Catalog entries of any style, with configurable paths."""
    got = {n: configured(F.col(doc), mappings, field, keys) for n, (field, keys) in GENERIC_ITEM.items()}
    none = F.lit("")
    return docs.select(
        "*", F.coalesce(got["external_id"], got["title"], F.md5(doc)).alias("external_id"),
        F.coalesce(got["title"], got["external_id"], F.lit("Untitled dataset")).alias("title"),
        F.coalesce(got["name"], got["title"], got["external_id"], none).alias("name"),
        *[F.coalesce(got[n], none).alias(n) for n in ("category", "organization", "updated_at")],
    )


def _elements(doc: Column, path: str) -> Column:
    """JSON texts of the objects in an array."""
    found = F.from_json(F.get_json_object(doc, path), "array<string>")
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda e: F.ltrim(e).startswith("{"))


def portal_details(docs: DataFrame, doc: str) -> DataFrame:
    """Detail documents with category text, tags and the resources as JSON texts."""
    d = F.col(doc)
    categories = F.filter(F.transform(_elements(d, "$.temas"), lambda e: first_text(e, ("title", "name"))), lambda c: c != "")
    tags = F.transform(_elements(d, "$.tags"), lambda e: first_text(e, ("display_name", "name", "id")))
    return docs.select(
        "*", *[first_text(d, keys).alias(n) for n, keys in PORTAL_DETAIL.items()],
        categories.alias("categories"), F.array_join(categories, ", ").alias("category"), tags.alias("tags"), _elements(d, "$.recursos").alias("resources"),
    )


def resources(details: DataFrame, keep: Sequence[str], column: str = "resources") -> DataFrame:
    """One row per resource; a document without resources keeps one row."""
    rows = details.select(*keep, F.explode_outer(column).alias("_r"))
    found = F.col("_r").isNotNull()
    own = F.array_contains(F.json_object_keys("_r"), "tamanho")  # a size that is there but empty wins, too
    size = F.when(own, json_text(F.col("_r"), "$.tamanho")).otherwise(json_text(F.col("_r"), "$.size"))
    return rows.select(
        *keep, *[F.when(found, first_text(F.col("_r"), keys)).alias(f"resource_{n}") for n, keys in PORTAL_RESOURCE.items()],
        size.try_cast("bigint").alias("resource_size"), json_text(F.col("_r"), "$.quantidadeDownloads").try_cast("bigint").alias("resource_download_count"),
        json_text(F.col("_r"), "$.numOrdem").try_cast("bigint").alias("resource_order"), F.col("_r").alias("resource_raw"),
    )


def generic_resources(docs: DataFrame, doc: str, mappings: Mapping[str, str], keep: Sequence[str]) -> DataFrame:
    """Resources below a configurable path, with configurable field paths."""
    rows = docs.select(*keep, F.explode_outer(_elements(F.col(doc), json_path(mappings.get("resources_path") or "resources"))).alias("_r"))
    return rows.select(*keep, *[configured(F.col("_r"), mappings, field, keys).alias(f"resource_{n}") for n, (field, keys) in GENERIC_RESOURCE.items()])


def _extension(col: Column) -> Column:
    """First known extension inside a name or link, else its last extension."""
    text = F.lower(F.try_url_decode(F.coalesce(col, F.lit(""))))
    text = F.coalesce(text, F.lower(col), F.lit(""))
    inside = F.regexp_extract_all(text, F.lit(r"\.([a-z0-9]{2,8})(?=$|[/?#])"), F.lit(1))
    known = F.element_at(F.filter(inside, lambda e: e.isin(*PREVIEW_FORMATS, *REFUSED_FORMATS)), 1)
    known = F.when(F.size(F.filter(inside, lambda e: e.isin(*PREVIEW_FORMATS, *REFUSED_FORMATS))) > 0, known)
    path = F.regexp_replace(F.regexp_replace(text, r"[?#].*$", ""), r"^[a-z][a-z0-9+.-]*://[^/]*", "")
    return F.coalesce(known, F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def resource_format(df: DataFrame, file_name: str, url: str, title: str, declared: str) -> DataFrame:
    """Adds ``extension`` and ``format_status``: supported, unsupported or unknown.

    File name, link and title are asked in this order, the declared format last.
    """
    seen = [_extension(F.col(c)) for c in (file_name, url, title)]
    word = F.regexp_replace(F.lower(F.trim(F.coalesce(declared, F.lit("")))), r"^\.+", "")
    for other, accepted in FORMAT_ALIASES.items():
        word = F.when(word == other, F.lit(accepted)).otherwise(word)
    known = [F.when(c.isin(*PREVIEW_FORMATS, *REFUSED_FORMATS), c) for c in [*seen, word]]
    return df.withColumn("extension", F.coalesce(*known)).withColumn(
        "format_status",
        F.when(F.col("extension").isin(*PREVIEW_FORMATS), "supported").when(F.col("extension").isin(*REFUSED_FORMATS), "unsupported").otherwise("unknown"),
    )


def filter_catalog(items: DataFrame, category: str = "", page: int = 1, page_size: int = 20, order: Sequence[str] = ("external_id",)) -> DataFrame:
    """One page of the items whose category contains the text."""
    found = items.where(F.contains(F.lower("category"), F.lit(category.lower()))) if category else items
    skip = (max(1, int(page or 1)) - 1) * page_size
    return found.orderBy(*order).offset(skip).limit(page_size)


def _quote(col: Column) -> Column:
    # Spark's form encoding differs from percent encoding in three characters.
    text = F.replace(F.url_encode(col.cast("string")), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(text, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def connection_string(provider: Column, dataset: Column, resource: Column) -> Column:
    return F.concat(F.lit("store://"), _quote(provider), F.lit("/"), _quote(dataset), F.lit("/"), _quote(resource))


def parse_connection(df: DataFrame, column: str) -> DataFrame:
    """Adds provider_id, dataset_external_id and resource_external_id; NULL for other text."""
    text = F.col(column)
    parts = F.filter(F.split(F.regexp_replace(text, "^store://", ""), "/"), lambda p: p != "")
    valid = text.startswith("store://") & (F.size(parts) >= 3)

    def part(i: int) -> Column:
        return F.when(valid, F.url_decode(F.get(parts, F.lit(i))))

    return df.withColumns({"provider_id": part(0), "dataset_external_id": part(1), "resource_external_id": part(2)})


def direct_url(provider_type: Column, url: Column) -> Column:
    """View links of the government portal become download links."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))
    portal = (F.lower(provider_type) == "dados_gov_br") & host.endswith("gov.br")
    return F.when(portal, F.regexp_replace(url, r"^([^?#]*)/view(?=$|[?#])", "$1/@@download/file")).otherwise(url)
