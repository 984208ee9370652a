"""Scalar string helpers used across operators (F3-F5, F9, F12, S15, U4, 2.0.5)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- term match -------------------------------------------------------------------

_REGEX_META = re.compile(r"([.^$*+?()\[\]{}|\\])")


def term_pattern(term: str) -> str:
    """Case-insensitive, term-bounded containment, as a log query's ``has``.

    A term edge is a non-alphanumeric character or the string end. Only plain
    character classes are used, so the same pattern runs in Java regex and RE2.
    """
    body = _REGEX_META.sub(r"\\\1", term.lower())
    front = "(^|[^a-z0-9])" if term[:1].isalnum() else ""
    back = "([^a-z0-9]|$)" if term[-1:].isalnum() else ""
    return f"(?i){front}{body}{back}"


def has_term(col: Column | str, term: str) -> Column:
    return _c(col).rlike(term_pattern(term))


def has_any(col: Column | str, terms: list[str] | tuple[str, ...]) -> Column:
    out = None
    for t in terms:
        m = has_term(col, t)
        out = m if out is None else (out | m)
    return out if out is not None else F.lit(False)


def starts_with_ci(col: Column | str, prefix: str) -> Column:
    """Case-insensitive prefix (``startswith``)."""
    return F.lower(_c(col)).startswith(prefix.lower())


# --- ids, titles, sections -----------------------------------------------------------

def source_of(doc_id: Column | str) -> Column:
    """The id prefix before the first ``:`` (``blob:a/b.md`` -> ``blob``)."""
    return F.split_part(_c(doc_id), F.lit(":"), F.lit(1))


def file_title(uri: Column | str) -> Column:
    """File name without its last extension, ``_``/``-`` to spaces, trimmed; else the uri."""
    name = F.element_at(F.split(_c(uri), "/"), -1)
    stem = F.regexp_replace(name, r"\.[^.]+$", "")
    cleaned = F.trim(F.translate(stem, "_-", "  "))
    return F.coalesce(F.nullif(cleaned, F.lit("")), _c(uri))


def derive_title(uri: Column | str, first_headings: Column | str | None = None) -> Column:
    """First heading of the first chunk, else the cleaned file name, else the uri."""
    if first_headings is None:
        return file_title(uri)
    h = _c(first_headings)
    return F.when(F.size(h) > 0, F.element_at(h, 1)).otherwise(file_title(uri))


def section_path(headings: Column | str, chunk_index: Column | str) -> Column:
    """Headings joined by `` > ``, else ``chunk <i>``."""
    h = _c(headings)
    return F.when(F.coalesce(F.size(h), F.lit(0)) > 0, F.array_join(h, " > ")) \
        .otherwise(F.concat(F.lit("chunk "), _c(chunk_index).cast("string")))


def contextualize(headings: Column | str, text: Column | str) -> Column:
    """Heading path then text, newline separated: the text that is embedded and stored."""
    return F.concat_ws("\n", F.coalesce(_c(headings), F.array().cast("array<string>")), _c(text))


# --- content type (S15) ---------------------------------------------------------------

# Extension -> MIME type, as a standard MIME table maps the common
# document formats of a corpus upload. Unlisted extensions fall back to the default.
MIME_BY_EXTENSION = {
    "md": "text/markdown",
    "markdown": "text/markdown",
    "txt": "text/plain",
    "text": "text/plain",
    "csv": "text/csv",
    "htm": "text/html",
    "html": "text/html",
    "xml": "application/xml",
    "json": "application/json",
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
}
DEFAULT_MIME = "application/octet-stream"


def content_type(uri: Column | str) -> Column:
    ext = F.lower(F.regexp_extract(F.element_at(F.split(_c(uri), "/"), -1), r"\.([^.]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in MIME_BY_EXTENSION.items() for x in kv])
    return F.coalesce(F.element_at(table, ext), F.lit(DEFAULT_MIME))


# --- options list (U4) ------------------------------------------------------------------

def distinct_options(csv: Column | str) -> Column:
    """CSV text to trimmed, non-empty, first-seen-order distinct list."""
    parts = F.transform(F.split(_c(csv), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


# --- telemetry helpers ----------------------------------------------------------------

def prop_string(props: Column | str, key: str) -> Column:
    return F.element_at(_c(props), F.lit(key))


def prop_int(props: Column | str, key: str) -> Column:
    """Typed bag read: null if absent or not a number (``toint(Properties[k])``)."""
    return prop_string(props, key).try_cast("int")


def status_label(success: Column | str, result_code: Column | str) -> Column:
    """``ok`` if Success is true, else the result code, else ``FAIL``."""
    return F.when(_c(success) == F.lit(True), F.lit("ok")) \
        .otherwise(F.coalesce(F.nullif(_c(result_code), F.lit("")), F.lit("FAIL")))
