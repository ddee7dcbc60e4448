"""Loose JSON fields to typed values, one field at a time.

A record is a VARIANT. Every coercion yields ``struct(value, issue)``: absent input
(missing, null, blank) is null without an issue, unusable input is null with one,
and neither harms the other fields of the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
NUMERIC = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
EPOCH_SECONDS_BELOW = 1e11
ISO_TIME = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
TRUE_WORDS = ["true", "yes", "1"]
FALSE_WORDS = ["false", "no", "0"]
# ------------------------------------------------------------------------------

_NUMBER_KINDS = r"^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"


def get(record: Column, path: str) -> Column:
    """The raw value at a path of a VARIANT, as VARIANT."""
    return F.try_variant_get(record, path, "variant")


def kind(raw: Column) -> Column:
    return F.schema_of_variant(raw)


def _text(raw: Column) -> Column:
    return F.try_variant_get(raw, "$", "string")


def absent(raw: Column) -> Column:
    k = kind(raw)
    return raw.isNull() | (k == "VOID") | ((k == "STRING") & (F.trim(_text(raw)) == ""))


def aliased(record: Column, name: str, alias: str | None) -> Column:
    raw = get(record, f"$.{name}")
    if alias is None:
        return raw
    return F.when(absent(raw), get(record, f"$.{alias}")).otherwise(raw)


def _is_number(raw: Column) -> Column:
    return kind(raw).rlike(_NUMBER_KINDS)


def _is_string(raw: Column) -> Column:
    return kind(raw) == "STRING"


def to_numeric(raw: Column) -> Column:
    text = F.trim(_text(raw))
    return F.when((_is_number(raw) | _is_string(raw)) & text.rlike(NUMERIC), text.try_cast("double"))


def to_boolean(raw: Column) -> Column:
    word = F.lower(F.trim(_text(raw)))
    usable = (kind(raw) == "BOOLEAN") | _is_number(raw) | _is_string(raw)
    return F.when(usable & word.isin(TRUE_WORDS), True).when(usable & word.isin(FALSE_WORDS), False)


def to_identifier(raw: Column) -> Column:
    text = F.trim(_text(raw))
    return F.when((_is_number(raw) | _is_string(raw)) & (text != ""), text)


def to_string(raw: Column) -> Column:
    return F.when(_is_string(raw), _text(raw))


def to_url(raw: Column) -> Column:
    text = F.trim(_text(raw))
    return F.when(_is_string(raw) & text.rlike(r"(?i)^https?://"), text)


def text_to_timestamp(text: Column) -> Column:
    """ISO, bare date (UTC midnight), `date time+00`, or epoch digits; impossible days are null."""
    text = F.trim(text)
    day = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    real = (day == "") | F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNotNull()
    number = text.try_cast("double")
    # The first space becomes a T; a two-digit offset gets its minutes.
    iso = F.regexp_replace(F.regexp_replace(text, r"^(\S+) ", "$1T"), r"([+-]\d{2})$", "$1:00")
    return F.when(
        real,
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
        .when(text.rlike(r"^\d+$"), epoch(number))
        .when(iso.rlike(ISO_TIME), iso.try_cast("timestamp")),
    )


def epoch(number: Column) -> Column:
    ms = F.when(number < EPOCH_SECONDS_BELOW, number * 1000).otherwise(number)
    return F.timestamp_millis(ms.cast("bigint"))


def to_timestamp(raw: Column) -> Column:
    return F.when(_is_number(raw), epoch(_text(raw).try_cast("double"))).when(
        _is_string(raw), text_to_timestamp(_text(raw))
    )


def _elements(raw: Column) -> Column:
    decoded = F.when(_is_string(raw), F.try_parse_json(_text(raw))).otherwise(raw)
    return F.when(kind(decoded).startswith("ARRAY"), F.try_variant_get(decoded, "$", "array<variant>"))


def _all_or_nothing(items: Column) -> Column:
    return F.when(~F.exists(items, lambda x: x.isNull()), items)


def to_string_list(raw: Column) -> Column:
    """Array, or JSON text of one; every element a string or number."""
    return _all_or_nothing(
        F.transform(_elements(raw), lambda e: F.when(_is_string(e) | _is_number(e), _text(e)))
    )


def to_number_list(raw: Column) -> Column:
    return _all_or_nothing(F.transform(_elements(raw), to_numeric))


def to_tags(raw: Column) -> Column:
    """array<struct<id,label,slug>>; one unusable tag nulls the list."""
    items = F.when(kind(raw).startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>"))
    tag_id = F.transform(items, lambda e: to_identifier(get(e, "$.id")))
    tags = F.transform(
        items,
        lambda e: F.struct(
            to_identifier(get(e, "$.id")).alias("id"),
            to_string(get(e, "$.label")).alias("label"),
            to_string(get(e, "$.slug")).alias("slug"),
        ),
    )
    return F.when(~F.exists(tag_id, lambda x: x.isNull()), tags)


COERCIONS = {
    "string": to_string,
    "identifier": to_identifier,
    "numeric": to_numeric,
    "boolean": to_boolean,
    "timestamp": to_timestamp,
    "strings": to_string_list,
    "numbers": to_number_list,
    "url": to_url,
    "tags": to_tags,
}
EXPECTED = {
    "string": "expected a string",
    "identifier": "expected a string or numeric id",
    "numeric": "expected a number or numeric string",
    "boolean": "expected a boolean, true/false or 0/1",
    "timestamp": "expected a date string or epoch number",
    "strings": "expected an array or a JSON-encoded array of strings",
    "numbers": "expected an array or a JSON-encoded array of numbers",
    "url": "expected an http(s) URL",
    "tags": "expected an array of tags",
}


def settled(df: DataFrame, name: str, fields: dict[str, Column]) -> DataFrame:
    """Add a struct of ``fields`` as a generated column: later steps read it and don't copy what is behind it."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in fields.items()]))).alias(name))


def soft(records: DataFrame, fields: dict[str, str], aliases: dict[str, str]) -> DataFrame:
    """Add ``value``, a struct of the typed fields, and ``issues``, array of struct(field, reason, received).

    ``records`` has a VARIANT column ``record``. Each field is looked up in it once, looked at
    once and coerced once, in steps of their own; absent fields go no further than the first.
    """
    out = settled(records, "raw", {name: get(F.col("record"), f"$.{name}") for name in fields})
    other = {name: get(F.col("record"), f"$.{alias}") for name, alias in aliases.items() if name in fields}
    if other:
        out = settled(out, "raw", {
            name: F.when(absent(F.col("raw")[name]), other[name]).otherwise(F.col("raw")[name]) if name in other else F.col("raw")[name] for name in fields
        })
        out = out.toDF(*[c if k != out.columns.index("raw") else "__first" for k, c in enumerate(out.columns)])
    out = settled(out, "there", {name: ~absent(F.col("raw")[name]) for name in fields})
    out = settled(out, "value", {name: F.when(F.col("there")[name], COERCIONS[how](F.col("raw")[name])) for name, how in fields.items()})
    issues = [
        F.when(
            F.col("there")[name] & F.col("value")[name].isNull(),
            F.struct(F.lit(name).alias("field"), F.lit(EXPECTED[how]).alias("reason"), F.to_json(F.col("raw")[name]).alias("received")),
        )
        for name, how in fields.items()
    ]
    return out.select(*records.columns, "value", F.array_compact(F.array(*issues)).alias("issues"))
