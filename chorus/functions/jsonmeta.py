"""Reading and updating a JSON metadata column."""

from __future__ import annotations

import json

from pyspark.sql import Column, functions as F


def field(meta: Column, key: str) -> Column:
    return F.get_json_object(meta, f"$.{key}")


def field_equals(meta: Column, key: str, value: str) -> Column:
    return field(meta, key) == value


def field_in_text(meta: Column, key: str, value: str) -> Column:
    """Test on the raw JSON text, with or without a blank after the colon."""
    return (F.contains(meta, F.lit(f'"{key}": "{value}"'))
            | F.contains(meta, F.lit(f'"{key}":"{value}"')))


def is_blank(meta: Column, key: str) -> Column:
    """The key is absent, null or empty."""
    return F.coalesce(field(meta, key), F.lit("")) == ""


def settable(meta: Column) -> Column:
    """The text is missing or a JSON object."""
    return meta.isNull() | F.json_object_keys(meta).isNotNull()


# A string, a sign, white space, or a number or literal.
_PARTS = r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|\s+|[^\s{}\[\]:,"]+'


def set_field(meta: Column, key: str, value: str) -> Column:
    """JSON text with ``key`` of the outer object set to ``value``.

    Only the text of that value is replaced, at every place of the key, or the member is
    added at the end: all other text, with its numbers and repeated members, stays as it
    is. Text that is no JSON object stays as it is, missing text becomes an object.
    """
    name, new = json.dumps(key, ensure_ascii=False), json.dumps(value, ensure_ascii=False)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("own"),
                     F.lit(False).alias("skip"), F.lit(False).alias("found"), F.lit(False).alias("some"))

    def step(s: Column, part: Column) -> Column:
        opens, closes = part.isin("{", "["), part.isin("}", "]")
        depth = s["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        outer = s["depth"] == 1  # directly in the outer object
        ends = outer & (part.isin(",") | (closes & (depth == 0)))
        member = outer & F.startswith(part, F.lit('"')) & ~s["skip"]
        value_of_own = outer & (part == ":") & s["own"]
        added = F.when(closes & (depth == 0) & ~s["found"],
                       F.concat(F.when(s["some"], ",").otherwise(""), F.lit(f"{name}:{new}"))).otherwise("")
        shown = (F.when(value_of_own, F.lit(":" + new)).when(s["skip"] & ~ends, F.lit(""))
                 .otherwise(F.concat(added, part)))
        return F.struct(
            F.concat(s["out"], shown).alias("out"), depth.alias("depth"),
            F.when(member, (part == name) & ~s["own"]).when(outer & (ends | (part == ":")), F.lit(False))
            .otherwise(s["own"]).alias("own"),
            F.when(ends, F.lit(False)).otherwise(s["skip"] | value_of_own).alias("skip"),
            (s["found"] | value_of_own).alias("found"),
            (s["some"] | (outer & (part == ":"))).alias("some"))

    parts = F.regexp_extract_all(meta, F.lit(_PARTS), F.lit(0))
    spliced = F.aggregate(parts, start, step, lambda s: s["out"])
    return (F.when(meta.isNull(), F.lit(f"{{{name}:{new}}}"))
            .when(F.json_object_keys(meta).isNotNull(), spliced).otherwise(meta))


def backfill(meta: Column, key: str, value: str) -> Column:
    """Set ``key`` only where it is blank."""
    return F.when(is_blank(meta, key), set_field(meta, key, value)).otherwise(meta)
