"""Running recursions of a key, split over blocks of time.

A state that depends on all earlier rows of its key, such as a recursive average, needs no task that holds the whole key:
each row is a map of the state, maps of a block compose to one map, and a running composition over the few block rows of a
key gives the state that each block starts from. Rows are dealt by (key, block), so a key of any length spreads over tasks.

A map takes a state ``s`` to ``a * s + b``, and the empty state to ``first`` (null: it stays empty). The rows of a block
compose in runs of ``RUN``, with no sum over more rows that could grow or cancel. The runs' maps are written once; those of
a key compose in one window if they are few, else in blocks of blocks in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources.scratch import stored

DAY = 86_400
RUN = 32
TOP = 1024
_NO_TIME = -(1 << 62)


def block_of(df: DataFrame, time: str, width: int) -> Column:
    """The number of the block that a time (or a number) falls into; a block of its own, the first, for null."""
    at = F.unix_seconds(F.col(time).cast("timestamp")) if isinstance(df.schema[time].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(time)
    return F.coalesce(F.floor(at / width).cast("long"), F.lit(_NO_TIME))


def _in_runs(df: DataFrame, block: str, run: str, order: list[str], names: list[str]) -> DataFrame:
    """``df`` with the ``run`` of each row in its block, and its maps after those of the rows before it in the run."""
    df = df.withColumn(run, F.floor((F.row_number().over(Window.partitionBy("_key", block).orderBy(*order)) - 1) / RUN).cast("long"))
    maps = [f"_{x}_{n}" for n in names for x in "abf"]
    so_far = F.collect_list(F.struct(*maps)).over(Window.partitionBy("_key", block, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))

    def then(s: Column, x: Column) -> Column:
        out = []
        for n in names:
            a, b, f = (f"_{c}_{n}" for c in "abf")
            out += [(s[a] * x[a]).alias(a), (x[a] * s[b] + x[b]).alias(b), F.coalesce(x[a] * s[f] + x[b], x[f]).alias(f)]
        return F.struct(*out)

    same = F.struct(*[F.lit(v).cast("double").alias(f"_{c}_{n}") for n in names for c, v in (("a", 1.0), ("b", 0.0), ("f", None))])
    df = df.withColumn("_maps", F.aggregate(so_far, same, then))
    return df.withColumns({m: F.col("_maps")[m] for m in maps}).drop("_maps")


def _ends(df: DataFrame, block: str, run: str, order: list[str], names: list[str]) -> DataFrame:
    """The whole map of each run, written once: few rows, from which the states at the starts of runs are made."""
    maps = [f"_{x}_{n}" for n in names for x in "abf"]
    ends = df.groupBy("_key", block, run).agg(F.max_by(F.struct(*maps), F.struct(*order)).alias("_end"))
    return stored(ends.select("_key", block, run, "_end.*"), "scan-runs")


def _starts(ends: DataFrame, order: list[str], names: list[str], level: int = 0) -> DataFrame:
    """``ends`` (one row a run, in ``order`` within its key) with ``_from_``: the state that each run starts from.

    Up to ``TOP`` rows a key compose by doubling in one window; more are dealt to blocks of blocks like the rows were.
    """
    most = ends.groupBy("_key").count().agg(F.max("count")).first()[0] or 0
    if most <= TOP:
        window = Window.partitionBy("_key").orderBy(*order)
        for k in range(max(most - 1, 0).bit_length()):
            new = {}
            for n in names:
                a, b, f = (f"_{x}_{n}" for x in "abf")
                before = lambda c: F.lag(c, 1 << k).over(window)  # noqa: B023, E731
                new[a] = F.coalesce(before(a) * F.col(a), F.col(a))
                new[b] = F.coalesce(F.col(a) * before(b) + F.col(b), F.col(b))
                new[f] = F.coalesce(F.col(a) * before(f) + F.col(b), F.col(f))
            ends = ends.withColumns(new)
        return ends.withColumns({f"_from_{n}": F.lag(f"_f_{n}").over(window) for n in names})
    block, run = f"_block{level}", f"_run{level}"
    rows = _in_runs(ends.withColumn(block, F.floor(F.col(order[0]) / RUN).cast("long")), block, run, order, names)
    rows = _seeded(rows, _starts(_ends(rows, block, run, order, names), [block, run], names, level + 1), block, run, names)
    inside = Window.partitionBy("_key", block, run).orderBy(*order)
    return rows.withColumns({f"_from_{n}": F.coalesce(F.lag(f"_to_{n}").over(inside), F.col("_seed")[f"_from_{n}"]) for n in names})


def _seeded(rows: DataFrame, starts: DataFrame, block: str, run: str, names: list[str]) -> DataFrame:
    """``rows`` with the state after each (``_to_``) and that which its run started from (``_seed``)."""
    # One row a block, dealt like the rows themselves, so that they aren't shuffled again.
    seeds = starts.groupBy("_key", block).agg(F.map_from_entries(F.collect_list(F.struct(run, F.struct(*[f"_from_{n}" for n in names])))).alias("_seeds"))
    rows = rows.join(seeds.hint("merge"), ["_key", block]).withColumn("_seed", F.try_element_at("_seeds", F.col(run))).drop("_seeds")
    return rows.withColumns({f"_to_{n}": F.coalesce(F.col(f"_a_{n}") * F.col("_seed")[f"_from_{n}"] + F.col(f"_b_{n}"), F.col(f"_f_{n}")) for n in names})


def affine_scan(df: DataFrame, by: list[str], time: str, maps: dict[str, tuple[Column, Column, Column]], width: int = DAY) -> DataFrame:
    """``df`` with one column for each of ``maps``: the state after each row, in the order of ``time`` within ``by``.

    A map is (a, b, first); one with a null in it leaves the state as it is. ``width`` is a block's length in seconds.
    Runs an action: the maps of the runs are written to the shared folder.
    """
    names = [str(k) for k in range(len(maps))]
    columns = {"_key": F.struct(*by), "_block": block_of(df, time, width)}
    for n, (a, b, first) in zip(names, maps.values()):
        known = a.isNotNull() & b.isNotNull() & first.isNotNull()
        columns |= {f"_a_{n}": F.when(known, a.cast("double")).otherwise(1.0), f"_b_{n}": F.when(known, b.cast("double")).otherwise(0.0), f"_f_{n}": F.when(known, first.cast("double"))}
    rows = _in_runs(df.withColumns(columns), "_block", "_run", [time], names)
    starts = _starts(_ends(rows, "_block", "_run", [time], names), ["_block", "_run"], names)
    return _seeded(rows, starts, "_block", "_run", names).select(*df.columns, *[F.col(f"_to_{n}").alias(name) for n, name in zip(names, maps)])


def last_value_scan(df: DataFrame, by: list[str], order: list[str], value: str, out: str, width: int = DAY) -> DataFrame:
    """``df`` with ``out``: the last non-null ``value`` up to each row, in ``order`` (a time first) within ``by``.

    The last values of the blocks run over the block rows of a key; a block takes the one before it where it has none yet.
    """
    rows = df.withColumns({"_key": F.struct(*by), "_block": block_of(df, order[0], width)})
    ends = rows.groupBy("_key", "_block").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_key", "_block", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    local = Window.partitionBy("_key", "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(carried.hint("merge"), ["_key", "_block"])
    return rows.withColumn(out, F.coalesce(F.last(value, ignorenulls=True).over(local), "_carried")).drop("_key", "_block", "_carried")
