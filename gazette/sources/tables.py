"""A1: tables by a declared schema. What doesn't parse goes to an error output, never into the rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, NumericType, StringType, StructType, TimestampNTZType, TimestampType

#: Declared columns of the tables that come in.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
TRUE, FALSE = ("1", "true", "t", "yes"), ("0", "false", "f", "no")


def parsed(value: Column, found: DataType, wanted: DataType) -> Column:
    """value as the declared type, null where it doesn't parse: times in ISO form or SQL's, flags as 0 and 1 or words, numbers from text."""
    text = F.trim(value.cast("string"))
    if isinstance(wanted, StringType):
        return value.cast("string")
    if isinstance(wanted, BooleanType):
        return F.when(F.lower(text).isin(*TRUE), True).when(F.lower(text).isin(*FALSE), False)
    if isinstance(wanted, (TimestampType, TimestampNTZType)):
        if isinstance(found, NumericType):  # milliseconds since 1970
            return F.timestamp_millis(value.try_cast("long")).cast(wanted)
        return (F.try_to_timestamp(text) if isinstance(found, StringType) else value).try_cast(wanted)
    if isinstance(wanted, DateType):
        return F.try_to_timestamp(text).try_cast("date") if isinstance(found, StringType) else value.try_cast("date")
    if isinstance(found, StringType):
        return F.when(text == "", None).otherwise(text).try_cast(wanted)
    whole = isinstance(wanted, NumericType) and not isinstance(wanted, DecimalType) and wanted.typeName() in ("byte", "short", "integer", "long")
    out = value.try_cast(wanted)
    return F.when(out.cast(found) == value, out) if whole and isinstance(found, NumericType) else out  # nothing is rounded


@dataclass
class Loaded:
    """rows of the declared schema, and what doesn't fit: raw (the row as JSON) and reasons (the columns that don't parse or are null against the declaration)."""

    rows: DataFrame
    errors: DataFrame


def fitted(raw: DataFrame, schema: StructType | str) -> Loaded:
    """raw in the declared schema. A column that raw lacks is null; further ones are left out; an empty text isn't a number, flag or time but null.

    Columns that have their declared type already aren't looked at, so a clean table is still read by the columns and filters that a query needs.
    """
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    have = {f.name: f.dataType for f in raw.schema}
    columns, faults = [], []
    for f in schema:
        if f.name not in have:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
            missing = F.lit(True)
        elif have[f.name] == f.dataType:
            columns.append(F.col(f"`{f.name}`"))
            missing = F.col(f"`{f.name}`").isNull()
        else:
            value = parsed(F.col(f"`{f.name}`"), have[f.name], f.dataType)
            columns.append(value.alias(f.name))
            missing = value.isNull()
            given = F.col(f"`{f.name}`").isNotNull()
            if isinstance(have[f.name], StringType):
                given = given & (F.trim(f"`{f.name}`") != "")
            faults.append((f.name, given & value.isNull()))
        if not f.nullable:
            faults.append((f.name, missing))
    if not faults:
        return Loaded(raw.select(*columns), raw.limit(0).select(F.lit(None).cast("string").alias("raw"), F.array().cast("array<string>").alias("reasons")))
    reasons = F.array_distinct(F.array_compact(F.array(*[F.when(fault, F.lit(name)) for name, fault in faults])))
    judged = raw.withColumn("_reasons", reasons)
    errors = judged.where(F.size("_reasons") > 0).select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in raw.columns])).alias("raw"), F.col("_reasons").alias("reasons"))
    return Loaded(judged.where(F.size("_reasons") == 0).select(*columns), errors)


def load(spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None) -> Loaded:
    """A1: the table name of a folder, by its declared schema."""
    raw = spark.read.parquet(f"{folder}/{name}.parquet")
    declared = schema or SCHEMAS[name]
    declared = StructType.fromDDL(declared) if isinstance(declared, str) else declared
    # zoned and unzoned times are read as the files have them
    kinds = {f.name: f.dataType for f in raw.schema}
    times = (TimestampType, TimestampNTZType)
    agreed = StructType([type(f)(f.name, kinds[f.name], f.nullable) if isinstance(f.dataType, times) and isinstance(kinds.get(f.name), times) else f for f in declared])
    return fitted(raw, agreed)
