"""Order books: levels from JSON text, top of book, depth and imbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = "array<struct<price:double,size:double>>"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _number(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(_NUMBER)), text.try_cast("double"))


def parse_levels(text: Column, depth: int = 1000, descending: bool = False) -> Column:
    """levels of a JSON array of ``[price, size]`` arrays or ``{"price":, "size":}`` objects.

    Entries without two numbers are dropped; sorted by price, equal prices as they stood; the first ``depth`` (one at least).
    Null, blank or malformed text has no levels.
    """
    entries = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))

    def level(x: Column, i: Column) -> Column:
        pair, named = F.from_json(x, "array<string>"), F.from_json(x, "price string, size string")
        price, size = (F.when(x.startswith("["), F.get(pair, k)).otherwise(named[n]) for k, n in enumerate(("price", "size")))
        p = _number(price)
        return F.struct((-p if descending else p).alias("key"), i.alias("i"), p.alias("price"), _number(size).alias("size"))

    good = F.filter(F.transform(F.filter(entries, lambda x: x.isNotNull()), level), lambda v: v["price"].isNotNull() & v["size"].isNotNull())
    return F.transform(F.slice(F.array_sort(good), 1, max(1, depth)), lambda v: F.struct(v["price"].alias("price"), v["size"].alias("size")))


def volume(levels: Column, depth: int = 10) -> Column:
    """I8: the summed size of the first ``depth`` levels."""
    return F.aggregate(F.slice(levels, 1, depth), F.lit(0.0), lambda total, x: total + x["size"])


def imbalance(bids: Column, asks: Column, depth: int = 10) -> Column:
    """I8: (bid volume - ask volume) / (their sum); 0 without volume."""
    b, a = volume(bids, depth), volume(asks, depth)
    return F.when(b + a > 0, (b - a) / (b + a)).otherwise(0.0)


def top_of_book(books: DataFrame, bids: str = "bids", asks: str = "asks") -> DataFrame:
    """``books`` (arrays of levels, in any order) with best prices, spread, mid, spread in % of mid and depth of ten levels.

    The spread is floored at 0, and 0 when a side is empty; mid and percentage are null then, and the percentage also
    where the mid isn't positive.
    """
    order = lambda side, sign: F.transform(F.array_sort(F.transform(F.col(side), lambda x, i: F.struct((sign * x["price"]).alias("key"), i.alias("i"), x.alias("x")))), lambda v: v["x"])
    b, a = F.col("_bids"), F.col("_asks")
    out = books.withColumns({"_bids": order(bids, -1), "_asks": order(asks, 1)})
    out = out.withColumns({"best_bid": F.get(b, 0)["price"], "best_ask": F.get(a, 0)["price"], "bid_depth_10": volume(b), "ask_depth_10": volume(a)})
    both = F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()
    out = out.withColumns({"spread": F.when(both, F.greatest(F.col("best_ask") - F.col("best_bid"), F.lit(0.0))).otherwise(0.0), "mid_price": F.when(both, (F.col("best_ask") + F.col("best_bid")) / 2.0)})
    return out.withColumn("spread_pct", F.when(F.col("mid_price") > 0, F.col("spread") / F.col("mid_price") * 100.0)).drop("_bids", "_asks")
