"""The anchored search space. For each base configuration, the configurations to try, nearest choices first.

Each axis lists its choices in order: numbers by their distance from the base's own (then the smaller first), modes with
the base's own first and the others as given. Configurations come in the order of the axes, the last one turning fastest,
and only the first ``cap`` of a base are made: the place of a configuration says which choice of each axis it takes, so
that no product is ever built. ``rising`` axes are one wheel of the combinations in which no value falls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_distance(values: list, anchor: Column) -> Column:
    """Distinct numbers by distance from ``anchor``, then by value; the anchor alone where the list is empty."""
    if not values:
        return F.array(anchor)
    distinct = F.array(*[F.lit(v) for v in dict.fromkeys(values)])
    keyed = F.array_sort(F.transform(distinct, lambda v: F.struct(F.abs(v - anchor).alias("d"), v.alias("v"))))
    return F.transform(keyed, lambda x: x["v"])


def anchor_first(values: list, anchor: Column) -> Column:
    """The anchor, then the other distinct values in their order."""
    if not values:
        return F.array(anchor)
    distinct = F.array(*[F.lit(v) for v in dict.fromkeys(values)])
    return F.concat(F.array(anchor), F.filter(distinct, lambda v: v != anchor))


def _rising(wheels: list[tuple[str, Column]]) -> Column:
    """All combinations of some wheels in which no value falls, in order, as structs."""
    made = F.transform(wheels[0][1], lambda v: F.struct(v.alias(wheels[0][0])))
    for k in range(1, len(wheels)):
        made = _grown(made, [n for n, _ in wheels[:k]], *wheels[k])
    return made


def _grown(made: Column, names: list[str], name: str, wheel: Column) -> Column:
    """Each of ``made`` with each value of one more wheel that isn't below its last."""
    longer = lambda s: F.transform(F.filter(wheel, lambda v: v >= s[names[-1]]), lambda v: F.struct(*[s[n].alias(n) for n in names], v.alias(name)))
    return F.flatten(F.transform(made, longer))


def _single(wheel: Column, name: str) -> Column:
    return F.transform(wheel, lambda v: F.struct(v.alias(name)))


def anchored_space(bases: DataFrame, key: list[str], axes: dict[str, list], modes: tuple[str, ...] = (), rising: tuple[str, ...] = (), cap: int = 1000) -> DataFrame:
    """(key, place, axes): the first ``cap`` configurations of each of ``bases``, which has a column for each axis.

    ``rising`` axes follow each other in ``axes``. ``place`` counts from 0; where the base's own values are among the
    choices (and rise), place 0 is the base.
    """
    wheel = {n: anchor_first(v, F.col(n)) if n in modes else by_distance(v, F.col(n)) for n, v in axes.items()}
    names = list(axes)
    at = [names.index(n) for n in rising]
    if at and at != list(range(at[0], at[0] + len(at))):
        raise ValueError("rising axes follow each other")
    wheels: list[tuple[str, Column, list[str]]] = []
    for n in names:
        if n not in rising:
            wheels.append((f"_w_{n}", _single(wheel[n], n), [n]))
        elif n == rising[0]:
            wheels.append((f"_w_{n}", _rising([(m, wheel[m]) for m in rising]), list(rising)))
    held = bases.select(*key, *[w.alias(c) for c, w, _ in wheels])
    # How many configurations pass while a wheel moves on by one: exact up to 2 ** 53, and beyond that above any place.
    step = F.lit(1.0)
    for c, _, _ in reversed(wheels):
        held = held.withColumns({f"_step{c}": step, f"_size{c}": F.size(c).cast("long")})
        step = F.col(f"_step{c}") * F.col(f"_size{c}")
    total = F.least(step, F.lit(float(cap))).cast("long")
    rows = held.withColumn("place", F.explode(F.when(total > 0, F.sequence(F.lit(0).cast("long"), total - 1))))
    turned = lambda c: F.pmod(F.floor(F.col("place") / F.col(f"_step{c}")), F.col(f"_size{c}")).cast("int")
    chosen = [F.get(c, turned(c))[m].alias(m) for c, _, members in wheels for m in members]
    return rows.select(*key, "place", *chosen).select(*key, "place", *names)
