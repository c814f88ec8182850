"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from estatum.scratch import stored

#: What counts as space between words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


materialize = stored


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(f"({WORD})"), F.lit(1))


def with_rank(df: DataFrame, keys: list[str], order: list[str], name: str = "rank", salts: int = 64) -> DataFrame:
    """Add the 0-based rank of each row among the rows of equal ``keys``.

    The order is (salt, ``order``), the salt a hash of ``order``, so that one hot
    key is numbered by ``salts`` tasks; the offsets of the salts are sums over at
    most ``salts`` rows a key.  Rows equal in ``order`` are interchangeable.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order)
    ranked = salted.withColumn("_rn", F.row_number().over(within) - 1)
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_salt") == F.col("_s")]
    cond = on[0]
    for c in on[1:]:
        cond &= c
    return ranked.join(offsets, cond).withColumn(name, (F.col("_rn") + F.col("_before")).cast("long")).drop("_salt", "_rn", "_before", "_s", *[f"_k_{k}" for k in keys])


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], T._parse_datatype_string(schema))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` with the fields of a DDL string behind its own."""
    return T.StructType([*schema.fields, *T._parse_datatype_string(ddl).fields])
