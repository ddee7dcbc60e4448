"""Canonical JSON and content hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields whose change is an edit, in stored order.
HASHED_FIELDS = [
    "question",
    "description",
    "resolution_source",
    "outcomes",
    "clob_token_ids",
    "end_date",
    "active",
    "closed",
]

_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def canonical_json(value: Column, dtype: str) -> Column:
    """Stable JSON of one typed value; null is the text ``null``. Timestamps become ISO."""
    if dtype.startswith("timestamp"):
        value = F.date_format(value, _ISO)
    wrapped = F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)  # drop {"v": and }


def canonical_struct(df_types: dict[str, str], fields: Sequence[str], alias: str | None = None) -> Column:
    """Canonical JSON object of typed columns with sorted keys and kept nulls."""
    parts = []
    for f in sorted(fields):
        col = F.col(f if alias is None else f"{alias}.{f}")
        if df_types[f].startswith("timestamp"):
            col = F.date_format(col, _ISO)
        parts.append(col.alias(f))
    return F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})


def content_hash(df_types: dict[str, str], fields: Sequence[str] = HASHED_FIELDS) -> Column:
    return F.sha2(canonical_struct(df_types, fields), 256)


def response_hash(body: Column) -> Column:
    """SHA-256 of a response body with object keys in order and spacing removed.

    The variant encoding keeps object keys sorted, so equal documents give equal
    text whatever their key order; text that is not JSON is wrapped. The parser stops after
    the first value, so text is JSON only if it also is the one entry of an array and of an
    object: what closes one of them early leaves the other broken.
    """
    whole = F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull()
    parsed = F.when(whole, F.try_parse_json(body))
    wrapped = F.to_json(F.struct(body.alias("unparsed")))
    return F.sha2(F.coalesce(F.to_json(parsed), wrapped), 256)
