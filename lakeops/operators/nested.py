"""Nested documents: item definitions packed as base64 parts, response pages, role rules.

Item definitions (FIXTURES ``definitions``): ``itemId, format, parts ARRAY<STRUCT<path,
payload, payloadType>>``. The part at ``payload.json`` holds the item's definition as
base64 JSON; ``.platform`` holds JSON whose ``metadata`` overrides the item's type, display
name and description; every other part is carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeops.functions.codec import b64_decode_text, b64_encode

# Fixed values (must equal the reference).
DEFAULT_PART = "payload.json"
PLATFORM_PART = ".platform"
INLINE_BASE64 = "InlineBase64"

PART_TYPE = "struct<path:string,payload:string,payloadType:string>"
PLATFORM_SCHEMA = "struct<metadata:struct<type:string,displayName:string,description:string>>"
RESPONSE_SCHEMA = "struct<definition:struct<parts:array<struct<path:string,payload:string,payloadType:string>>>>"


def _last_part(parts: Column, path: str) -> Column:
    """The last part with this path (later parts overwrite earlier ones in the reference)."""
    return F.try_element_at(F.filter(parts, lambda p: p["path"] == F.lit(path)), F.lit(-1))


def unpack_definitions(items: DataFrame, definitions: DataFrame,
                       default_definition: str | None = None) -> DataFrame:
    """Items with their decoded definition and metadata overrides.

    Returns the item columns (``type``, ``displayName``, ``description`` taken from the
    ``.platform`` metadata when it gives them) plus ``definition`` (VARIANT; falls back to
    ``default_definition`` JSON) and ``additionalParts``. A part whose base64 or JSON is
    broken yields null for that part only, where the reference would drop all later parts.
    """
    # One definition for an item (of several the largest by content), and only what is needed of
    # it: the two special payloads and the other parts travel, not the parts twice.
    one = definitions.groupBy(F.col("itemId").alias("id")).agg(F.max("parts").alias("_parts"))
    d = one.select("id", _last_part(F.col("_parts"), DEFAULT_PART)["payload"].alias("_main"),
                   _last_part(F.col("_parts"), PLATFORM_PART)["payload"].alias("_plat"),
                   F.filter("_parts", lambda p: ~F.coalesce(p["path"].isin(DEFAULT_PART, PLATFORM_PART), F.lit(False))
                            ).alias("_others"))
    j = items.join(d, "id", "left")
    parsed = F.try_parse_json(b64_decode_text(F.col("_main")))
    meta = F.from_json(b64_decode_text(F.col("_plat")), PLATFORM_SCHEMA)["metadata"]
    default = (F.parse_json(F.lit(default_definition)) if default_definition is not None
               else F.lit(None).cast("variant"))
    others = F.coalesce(F.col("_others"), F.array().cast(f"array<{PART_TYPE}>"))
    with_meta = j.withColumn("_meta", meta)
    out_cols = []
    for c in items.columns:
        if c in ("type", "displayName", "description"):
            out_cols.append(F.coalesce(F.col("_meta")[c], F.col(c)).alias(c))
        else:
            out_cols.append(F.col(c))
    return with_meta.select(*out_cols, F.coalesce(parsed, default).alias("definition"),
                            others.alias("additionalParts"))


def definition_part(definition: Column, path: str = DEFAULT_PART) -> Column:
    """One ``InlineBase64`` part holding ``definition`` (struct, map, variant or JSON text).

    The JSON is compact; the reference indents by two spaces, so payloads must be
    compared after decoding and parsing, never byte for byte.
    """
    return F.struct(F.lit(path).alias("path"), b64_encode(definition).alias("payload"),
                    F.lit(INLINE_BASE64).alias("payloadType"))


def json_text(c: Column, is_text: bool) -> Column:
    return F.to_json(F.parse_json(c)) if is_text else F.to_json(c)


def pack_definitions(items: DataFrame, definition_col: str = "definition",
                     additional_col: str | None = "additionalParts",
                     id_col: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
    """``itemId, format, parts``: the definition as ``payload.json`` first, then the
    additional parts unchanged. A definition given as text must be valid JSON. ``keep``
    names item columns to carry along (e.g. ``workspaceId``)."""
    dtype = dict(items.dtypes)[definition_col]
    doc = json_text(F.col(definition_col), dtype == "string")
    first = F.array(definition_part(doc))
    parts = (F.concat(first, F.coalesce(F.col(additional_col), F.array().cast(f"array<{PART_TYPE}>")))
             if additional_col and additional_col in items.columns else first)
    return items.select(F.col(id_col).alias("itemId"), F.lit(None).cast("string").alias("format"),
                        parts.alias("parts"), *keep)


def normalize_parts(responses: DataFrame, body_col: str = "body") -> DataFrame:
    """Parse definition responses: ``definition`` with ``format`` null and ``parts`` whose
    ``payloadType`` defaults to ``InlineBase64``. A body that is not JSON, or has no
    ``definition.parts`` array, gives a null ``definition``."""
    parsed = F.from_json(F.col(body_col), RESPONSE_SCHEMA)
    parts = parsed["definition"]["parts"]
    fixed = F.transform(parts, lambda p: F.struct(
        p["path"].alias("path"), p["payload"].alias("payload"),
        F.coalesce(p["payloadType"], F.lit(INLINE_BASE64)).alias("payloadType")))
    defn = F.when(parts.isNotNull(), F.struct(F.lit(None).cast("string").alias("format"),
                                              fixed.alias("parts")))
    return responses.withColumn("definition", defn)


def load_page_dumps(pages: DataFrame, page_col: str = "page", skip_errors: bool = False) -> DataFrame:
    """Concatenate the items of landed response pages into rows (``item`` VARIANT).

    A page is an object with a ``value`` array, a bare array, or one object (one item). A page
    that is not JSON fails the load; with ``skip_errors`` it is left out, and ``page_errors``
    gives those rows.
    """
    v = F.try_parse_json(F.col(page_col))
    if not skip_errors:
        v = F.coalesce(v, F.when(F.col(page_col).isNotNull() | F.col(page_col).isNull(), F.raise_error(F.concat(
            F.lit("a page is not JSON: "), F.coalesce(F.left(F.col(page_col), F.lit(200)), F.lit("null"))))).cast("variant"))
    items = F.coalesce(F.try_variant_get(v, "$.value", "array<variant>"),
                       F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    keep = [c for c in pages.columns if c != page_col]
    good = pages.where(F.try_parse_json(F.col(page_col)).isNotNull()) if skip_errors else pages
    return good.select(*keep, F.explode(items).alias("item"))


def page_errors(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """The pages that are not JSON."""
    return pages.where(F.try_parse_json(F.col(page_col)).isNull())
