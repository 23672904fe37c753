"""Exact places in an order without sorting a whole key in one task.

The values of a key are dealt to ``CELLS`` cells of equal width between its least and greatest value. The cell depends on
the value alone and never falls as the value rises, so a place is the rows of the cells before and the place in the own
cell. Equal values are counted before they are sorted. Values that crowd into one cell are sorted by one task, which
spills; none is gathered into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024


def span(value: str) -> list[Column]:
    return [F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high")]


def cell(value: str) -> Column:
    """-1 for null; 0 for all where the span is no number (NaN or infinite values)."""
    share = (F.col(value).cast("double") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    return F.when(F.col(value).isNull(), -1).when(F.col("_high") > F.col("_low"), F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).otherwise(0).cast("int")


def floor_quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """T4: for each key the value at index ``floor((n - 1) p)`` of its sorted non-null values, one column a ``p`` of ``at``.

    The key is the struct ``_key`` of the columns ``by`` (null is a key like any other); keys without a value are absent.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.struct(*by).alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = counted.join(counted.groupBy("_key").agg(*span("_v"), F.sum("_n").alias("_all")), "_key").select("_key", "_v", "_n", "_all", cell("_v").alias("_cell"))
    up_to = lambda w: F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), F.floor((F.col("_all") - 1) * F.lit(p)).alias("at")) for name, p in at.items()])
    cells = placed.groupBy("_key", "_cell", "_all").agg(F.sum("_n").alias("_n"))
    cells = cells.withColumn("_before", up_to(Window.partitionBy("_key").orderBy("_cell")) - F.col("_n"))
    # Exploded in a step of its own: beside the window it would multiply the rows that the window adds up.
    held = cells.withColumn("_w", F.explode(wanted)).filter((F.col("_w.at") >= F.col("_before")) & (F.col("_w.at") < F.col("_before") + F.col("_n"))).select("_key", "_cell", "_before", F.col("_w.name").alias("_name"), F.col("_w.at").alias("_at"))
    ranked = placed.select("_key", "_cell", "_v", "_n").join(held, ["_key", "_cell"])
    ranked = ranked.withColumn("_last", F.col("_before") + up_to(Window.partitionBy("_key", "_name").orderBy("_v")))
    hit = ranked.filter((F.col("_at") < F.col("_last")) & (F.col("_at") >= F.col("_last") - F.col("_n")))
    return hit.groupBy("_key").agg(*[F.max(F.when(F.col("_name") == name, F.col("_v"))).alias(name) for name in at])


def positions(df: DataFrame, part: str, order: str, tie: str) -> DataFrame:
    """``df`` with ``position`` (from 1) in the order of ``part`` (few values), ``order`` (a number or a timestamp; null first) and ``tie``."""
    placed = df.join(F.broadcast(df.agg(*span(order)))).withColumn("_cell", cell(order)).drop("_low", "_high")
    cells = placed.groupBy(part, "_cell").agg(F.count("*").alias("_n"))
    # At most CELLS + 1 rows a part.
    before = cells.select(part, "_cell", (F.sum("_n").over(Window.orderBy(part, "_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(part, "_cell").orderBy(order, tie))
    return placed.join(F.broadcast(before), [part, "_cell"]).withColumn("position", F.col("_before") + own).drop("_before", "_cell")
