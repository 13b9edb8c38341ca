"""Schema and constraint checks (Q1-Q3) as single-pass aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def validate_table(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Q1: one row per declared column: whether it is there and has the
    declared type, nulls in required columns (every row where the column is
    missing), values outside the declared enum, and rows beyond the first of a
    value in unique columns.  One aggregation pass."""
    aggs, facts = [F.count(F.lit(1)).alias("_rows")], []
    for f in schema.fields:
        present = f.name in df.columns
        required, unique, enum = bool(f.metadata.get("required")), bool(f.metadata.get("unique")), f.metadata.get("enum")
        zero = F.lit(0)
        null_bad = enum_bad = repeat_bad = zero
        if present:
            c = F.col(f"`{f.name}`")
            null_bad = F.count(F.when(c.isNull(), 1)) if required else zero
            enum_bad = F.count(F.when(c.isNotNull() & ~c.cast("string").isin([str(e) for e in enum]), 1)) if enum else zero
            repeat_bad = F.count(c) - F.countDistinct(c) if unique else zero
        aggs += [null_bad.cast("bigint").alias(f"{f.name}__null"), enum_bad.cast("bigint").alias(f"{f.name}__enum"),
                 repeat_bad.cast("bigint").alias(f"{f.name}__repeat")]
        typed = present and df.schema[f.name].dataType == f.dataType
        facts.append((f.name, required, bool(enum), present, typed))
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("column"), F.lit(r).alias("required"), F.lit(e).alias("has_enum"),
                              F.lit(p).alias("present"), F.lit(t).alias("type_ok"),
                              (F.col(f"{n}__null") if p or not r else F.col("_rows")).alias("null_violations"),
                              F.col(f"{n}__enum").alias("enum_violations"), F.col(f"{n}__repeat").alias("unique_violations"))
                     for n, r, e, p, t in facts])
    return one.select(F.inline(rows))


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Q2: keys that occur more than once (partial aggregation per key)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def cast_failures(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Q3: per declared column that is there, how many values don't convert to
    the declared type (``apply_defaults`` treats them as missing)."""
    fields = [f for f in schema.fields if f.name in df.columns]
    one = df.agg(*[F.count(F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(), 1)).alias(f.name) for f in fields])
    rows = F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("n")) for f in fields])
    return one.select(F.inline(rows)) if fields else one.select(F.lit("").alias("column"), F.lit(0).cast("bigint").alias("n")).limit(0)


def apply_defaults(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Q3: declared defaults fill NULLs (missing columns are added); columns
    take the declared type, and a value that doesn't convert counts as missing
    (``cast_failures`` reports those)."""
    out = df
    for f in schema.fields:
        c = F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in out.columns else F.lit(None).cast(f.dataType)
        if "default" in f.metadata:
            d = f.metadata["default"]
            lit = F.array().cast(f.dataType) if isinstance(d, list) else F.lit(d).cast(f.dataType)
            c = F.coalesce(c, lit)
        out = out.withColumn(f.name, c)
    return out
