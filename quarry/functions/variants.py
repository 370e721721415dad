"""Semi-structured values as VARIANT columns: text at a path, containment of typed and nested values, canonical JSON, fields with their types.

Everything is a plan over the binary form; nothing is parsed twice. Malformed JSON, and JSON with a key twice in one object, is a null value.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def _path(*steps: str | int) -> str:
    return "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s + "']" for s in steps)


def at(value: Column, *steps: str | int) -> Column:
    """The value under these keys and array places; null where it is absent. A JSON null is a value."""
    return F.try_variant_get(value, _path(*steps), "variant")


def text_at(value: Column, *steps: str | int) -> Column:
    """The text of what lies under these keys: strings as they are, objects and arrays as JSON; null where there is none, or a JSON null."""
    return F.try_variant_get(value, _path(*steps), "string")


def kind(value: Column) -> Column:
    """object, array, string, number, boolean or null; SQL null where there is no value."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), F.lit(None).cast("string")).when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def _elements(value: Column) -> Column:
    """The elements of an array; none where the value is something else."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))


Json = dict | list | str | int | float | bool | None


def contains(value: Column, wanted: Json) -> Column:
    """Whether a value holds what `wanted` says: objects by their named fields, each of an array's elements in some element, scalars by type and value.

    An array holds a scalar that is one of its elements, at the top only. A number is no string, and a null is not an absent field.
    """
    inside = _holds(value, wanted)
    if not isinstance(wanted, dict | list):
        inside = inside | F.exists(_elements(value), lambda e: _holds(e, wanted))
    return F.coalesce(inside, F.lit(False))


def _holds(value: Column, wanted: Json) -> Column:
    is_a = lambda name: F.coalesce(kind(value) == name, F.lit(False))
    if isinstance(wanted, dict):
        out = is_a("object")
        for key, v in wanted.items():
            out = out & _holds(at(value, key), v)
    elif isinstance(wanted, list):
        out = is_a("array")
        for v in wanted:
            out = out & F.exists(_elements(value), lambda e: _holds(e, v))  # noqa: B023
    elif wanted is None:
        out = is_a("null")
    elif isinstance(wanted, str):
        out = is_a("string") & (text_at(value) == wanted)
    elif isinstance(wanted, bool):
        out = is_a("boolean") & (F.try_variant_get(value, "$", "boolean") == wanted)
    elif isinstance(wanted, int):
        out = is_a("number") & (F.try_variant_get(value, "$", "decimal(38,9)") == F.lit(Decimal(wanted)).cast("decimal(38,9)"))
    else:
        out = is_a("number") & (F.try_variant_get(value, "$", "double") == wanted)
    return F.coalesce(out, F.lit(False))


def canonical(text: Column) -> Column:
    """JSON without blanks, the keys of every object in order, at any depth; the binary form keeps fields in the order of their names."""
    return F.to_json(parse(text))


def fields(rows: DataFrame, value: str) -> DataFrame:
    """The columns of rows and, for each field of the object or element of the array, pos, key, value and its kind; one level."""
    spark = rows.sparkSession
    return rows.lateralJoin(spark.tvf.variant_explode(F.col(value).outer()).select(F.col("pos"), F.col("key"), F.col("value").alias("field")), how="inner").withColumn("kind", kind(F.col("field")))
