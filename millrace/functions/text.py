"""Column expressions for text: normalising, summarising, redaction, hashing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------
# Limits, sentences and patterns that decide the results.
SUMMARY_LIMIT = 420
EXCERPT_LIMIT = 260
EXCERPT_COUNT = 3
EMPTY_SUMMARY = "Reference metadata without raw text."
SECRET_MARK = "[REDACTED]"
SECRET_KEY = r"(?i)(api[_-]?key|authorization|bearer|password|secret|token)"
SECRET_PAIR = r"(?i)(api[_-]?key|authorization|bearer|password|secret|token)\s*[:=]\s*['\"]?[^'\"\s,;]+"
SECRET_BEARER = r"(?i)bearer\s+[a-z0-9._\-]+"
SECRET_WORDS = ("apikey", "api_key", "api-key", "authorization", "bearer", "password", "secret", "token")
SENTENCE_END = r"(?:\r?\n){2,}|(?<=[.!?])\s+"
# Log rules, applied in this order.
LOG_URL_LOGIN = r"(?i)([a-z][a-z0-9+.-]*://)([^/\s:@]+:[^@\s/]+)@"
LOG_BEARER = r"(?i)\bBearer\s+[A-Za-z0-9._~+/\-]+=*"
LOG_KEY_VALUE = (
    r"(?i)(\b(?:api[_-]?key|authorization|bearer|credential|fernet[_-]?key|password|passwd|"
    r"private[_-]?key|secret|sql[_-]?alchemy[_-]?conn|token)\b)(\s*[:=]\s*)"
    r"(\"[^\"]*\"|'[^']*'|[^\s,;]+)"
)
LOG_JSON_KEY = (
    r"(?i)(\"(?:api[_-]?key|authorization|credential|fernet[_-]?key|password|passwd|"
    r"private[_-]?key|secret|sql[_-]?alchemy[_-]?conn|token)\"\s*:\s*)(\"[^\"]*\"|[^,\}\]]+)"
)
LOG_QUERY_PARAM = r"(?i)([?&](?:api[_-]?key|password|secret|token)=)([^&\s]+)"
# Without any of these no log rule can apply.
LOG_WORDS = SECRET_WORDS + ("://", "credential", "fernet", "passwd", "private", "alchemy")
# ---------------------------------------------------------------------------

# Every Unicode space; Java's own \s is ASCII only.
SPACE_SET = r"\s\x0B\x1C-\x1F\x85\p{Z}"
SPACES = f"[{SPACE_SET}]+"
# Only what has to change: a run of two or more, or a single space other than a blank.
_UNEVEN_SPACES = f" [{SPACE_SET}]+|[{SPACE_SET}&&[^ ]][{SPACE_SET}]*"


def let(col: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(col), body), 1)


def or_else(col: Column, default: str) -> Column:
    """The text, or a default where it is empty."""
    return let(col, lambda t: F.when(t == "", F.lit(default)).otherwise(t))


def mentions(col: Column, words: Sequence[str]) -> Column:
    """Any of the lower-case words occurs, in any case. A quick test before a costly pattern."""
    return let(F.lower(col), lambda t: reduce(lambda a, b: a | b, [t.contains(w) for w in words]))


def squeeze(col: Column) -> Column:
    """Runs of white space become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col.cast("string"), F.lit("")), _UNEVEN_SPACES, " "))


def shorten(col: Column, limit: int | None) -> Column:
    """Cut to ``limit`` characters, the last three of them dots; no limit keeps the whole text."""
    if limit is None:
        return col
    cut = lambda t: F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))
    return let(col, lambda t: F.when(F.length(t) > limit, cut(t)).otherwise(t))


def summarise(col: Column, limit: int = SUMMARY_LIMIT) -> Column:
    return summarise_flat(squeeze(col), limit)


def summarise_flat(flat: Column, limit: int = SUMMARY_LIMIT) -> Column:
    """Summary of text that is already squeezed."""
    return or_else(shorten(flat, limit), EMPTY_SUMMARY)


def excerpts(flat: Column, count: int = EXCERPT_COUNT, limit: int = EXCERPT_LIMIT) -> Column:
    """The first distinct sentences of squeezed text, each shortened."""
    chunks = F.filter(F.split(flat, SENTENCE_END), lambda c: c != "")
    return F.slice(F.array_distinct(F.transform(chunks, lambda c: shorten(c, limit))), 1, count)


def redact(col: Column) -> Column:
    """Secret values in running text."""
    def marked(t: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(t, SECRET_PAIR, "$1=" + SECRET_MARK), SECRET_BEARER, "secret=" + SECRET_MARK)

    text = F.coalesce(col.cast("string"), F.lit(""))
    return let(text, lambda t: F.when(mentions(t, SECRET_WORDS), marked(t)).otherwise(t))


def redact_log(col: Column) -> Column:
    """Secrets in log lines: URL logins, bearer tokens, pairs, JSON keys, query parameters."""
    def marked(t: Column) -> Column:
        for pattern, mark in (
            (LOG_URL_LOGIN, "$1[REDACTED]@"), (LOG_BEARER, "Bearer [REDACTED]"), (LOG_KEY_VALUE, "$1$2[REDACTED]"),
            (LOG_JSON_KEY, '$1"[REDACTED]"'), (LOG_QUERY_PARAM, "$1[REDACTED]"),
        ):
            t = F.regexp_replace(t, pattern, mark)
        return t

    text = F.coalesce(col.cast("string"), F.lit(""))
    return let(text, lambda t: F.when(mentions(t, LOG_WORDS), marked(t)).otherwise(t))


def redact_map(col: Column) -> Column:
    """map<string,string>: whole value by key name, text rule on the others."""
    return F.transform_values(col, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit(SECRET_MARK)).otherwise(redact(v)))


def content_hash(col: Column) -> Column:
    """sha256 of normalised, redacted text; NULL when nothing is left."""
    return let(squeeze(redact(col)), lambda t: F.when(t != "", F.sha2(t, 256)))


def clip_record_text(col: Column, limit: int | None = None) -> Column:
    """The whole text; with a limit, longer text is cut 80 characters early and says how long it was."""
    if limit is None:
        return col

    def cut(t: Column) -> Column:
        head = F.regexp_replace(F.substring(t, 1, limit - 80), SPACES + "$", "")
        return F.concat(head, F.lit("\n\n[TRUNCATED: original_length="), F.length(t).cast("string"), F.lit("]"))

    return let(col, lambda t: F.when(F.length(t) > limit, cut(t)).otherwise(t))


def slug(col: Column) -> Column:
    """Lower case words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(col)), r"[^a-z0-9_]+", "_"), r"^_+|_+$", "")


def token_count(col: Column) -> Column:
    """Runs of non-space characters."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(f"[^{SPACE_SET}]+"))
