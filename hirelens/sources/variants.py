"""Declared columns read from JSON values of unknown shape, leaf by leaf.

A leaf that is not what it is declared to be reads as null and costs nothing else; list items that should be objects and are not
are left out of a list, or kept as null places where the place counts. Columns that folders name, such as company=Acme, go along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

CORRUPT = "_corrupt_record"


def variant_documents(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    """(v, _corrupt_record): a row per JSON document or line; text that is no JSON has a null v and stands in the other column."""
    reader = spark.read.schema(f"v VARIANT, {CORRUPT} STRING").option("singleVariantColumn", "v")
    return reader.option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).json(path)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def items_of(value: Column, path: str = "$") -> Column:
    """The items of a list; null where there is no list."""
    return F.try_variant_get(value, path, "array<variant>")


def shaped(value: Column, kind: DataType, path: str = "$") -> Column:
    """What stands at a path of a variant, as a declared type."""
    if isinstance(kind, StructType):
        return F.struct(*(shaped(value, f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind.fields))
    if isinstance(kind, ArrayType):
        listed = items_of(value, path)
        if isinstance(kind.elementType, StructType):
            listed = F.filter(listed, is_object)
        return F.transform(listed, lambda item: shaped(item, kind.elementType))
    if isinstance(kind, MapType):
        entries = F.try_variant_get(value, path, "map<string,variant>")
        return F.transform_values(entries, lambda _, item: shaped(item, kind.valueType))
    return F.try_variant_get(value, path, kind.simpleString())


def fields_of(value: Column, ddl: str) -> list[Column]:
    """The declared columns of an object."""
    return [shaped(value, f.dataType, f"$.{f.name}").alias(f.name) for f in StructType.fromDDL(ddl).fields]


def objects(spark: SparkSession, path: str, ddl: str, multi_line: bool) -> DataFrame:
    """A row per object, from documents that are objects or lists of objects, with `ordinal`, its place in its document. Anything
    else stands in the corrupt column and has no other value."""
    whole = variant_documents(spark, path, multi_line)
    beside = [name for name in whole.columns if name not in ("v", CORRUPT)]
    listed = F.coalesce(items_of(F.col("v")), F.array("v"))
    items = whole.select(CORRUPT, *beside, F.posexplode(listed).alias("ordinal", "item"))
    good = is_object(F.col("item"))
    text = F.coalesce(CORRUPT, F.when(~good, F.to_json("item")), F.when(~good, F.lit("null")))
    return items.select(*fields_of(F.col("item"), ddl), *beside, "ordinal", text.alias(CORRUPT))


def envelopes(spark: SparkSession, path: str, items: str, ddl: str, multi_line: bool) -> DataFrame:
    """A row per document that holds a list named `items`, every item read on its own.

    `ddl` declares the document's columns, the list of objects among them. The list keeps its length: an item that is no
    object is a null there, and stands in `odd_items` as (place, item). A document without such a list is corrupt as a whole.
    """
    whole = variant_documents(spark, path, multi_line)
    declared = StructType.fromDDL(ddl)
    listed, element = items_of(F.col("v"), f"$.{items}"), declared[items].dataType.elementType
    read = F.transform(listed, lambda item: F.when(is_object(item), shaped(item, element)))
    odd = F.filter(
        F.transform(listed, lambda item, place: F.when(~is_object(item), F.struct(place.alias("place"), F.to_json(item).alias("item")))),
        lambda item: item.isNotNull(),
    )
    has_list = listed.isNotNull()
    columns = [
        read.alias(items) if f.name == items else F.when(has_list, shaped(F.col("v"), f.dataType, f"$.{f.name}")).alias(f.name) for f in declared.fields
    ]
    text = F.when(~has_list, F.coalesce(F.col(CORRUPT), F.to_json("v"), F.lit("null")))
    beside = [name for name in whole.columns if name not in ("v", CORRUPT)]
    return whole.select(*columns, *beside, odd.alias("odd_items"), text.alias(CORRUPT))


def odd_items(landed: DataFrame) -> DataFrame:
    """(place, item) of list items that are no objects."""
    return landed.select(F.inline("odd_items"))
