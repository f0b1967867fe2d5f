"""Joins and aggregates that graph queries are made of and that are of use by themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """``left`` with the ``value`` of the last row of ``right`` at or before its ``time``, for equal ``by``; null without one.

    Both sides become one ordered stream of each key and the last value is carried on: no pairs are
    built. A row of ``right`` at the same time counts.
    """
    own = [c for c in left.columns if c not in (*by, time)]
    a = left.select(*by, time, F.lit(1).alias("_side"), F.struct(*own).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))
    b = right.select(*by, time, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    order = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(order)).where("_side = 1")
    return out.select(*by, time, *(F.col(f"_row.{c}").alias(c) for c in own), F.col("_last").alias(value))


def in_bands(rows: DataFrame, value: str, bands: DataFrame, width: float) -> DataFrame:
    """``rows`` joined with the bands (low, high and more) that hold ``value``, low included and high not.

    Bands are cut at multiples of ``width`` and rows go to the one cell that they lie in: an equal
    join on cells with the bounds as a filter, not a join of all pairs.
    """
    cells = bands.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.ceil(F.col("high") / width) - 1)))
    placed = rows.withColumn("_cell", F.floor(F.col(value) / width))
    return placed.join(cells, "_cell").where((F.col(value) >= F.col("low")) & (F.col(value) < F.col("high"))).drop("_cell")


def implementers(methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """(iface, type) for which the type has every method of the interface; an interface without methods has none.

    ``methods`` (type, method), ``wanted`` (iface, method). Relational division by counting: a type
    implements what it shares all methods with, so only pairs with a common method meet.
    """
    need = wanted.distinct().groupBy("iface").agg(F.count("*").alias("need"))
    shared = wanted.distinct().join(methods.distinct(), "method").groupBy("iface", "type").agg(F.count("*").alias("have"))
    return shared.join(need, "iface").where("have = need").select("iface", "type")


def grains(rows: DataFrame, keys: list[str], *measures: Column, cube: bool = False) -> DataFrame:
    """Aggregates at every grain of ``keys`` in one pass, with ``grain`` the bits of the keys that are summed over."""
    grouped = rows.cube(*keys) if cube else rows.rollup(*keys)
    return grouped.agg(F.grouping_id().cast("long").alias("grain"), *measures)


def matrix(rows: DataFrame, row: str, column: str, names: list[str], value: Column) -> DataFrame:
    """Rows by ``row`` with a column for each of ``names``, which the caller knows; 0 where there is nothing."""
    return rows.groupBy(row).pivot(column, names).agg(value).na.fill(0, names)
