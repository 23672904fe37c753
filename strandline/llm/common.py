"""Shared helpers: durable intermediate tables, column guards, word splitting and hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits on exactly these.
WORD_SPACE = b" \t\n\x0b\x0c\r"

_FALLBACK: dict[str, str] = {}
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir`` (or of ``setCheckpointDir``).

    Where neither is set, a local master gets a folder of its own (tests); any other master is an error, because its
    executors would write to their own disks and the driver would read nothing back.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        root = root.rstrip("/")
        if "://" not in root:  # a bare path means the default file system, for every reader of it alike
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            root = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
            root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="spark-strandline-")
    return _FALLBACK[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read of committed files, never a recomputation of the plan below. The
    shuffle files of the write go with its end, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    had = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_FREE) if had is None else spark.conf.set(_FREE, had)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns only, so that extra columns of the input can never clash with ours."""
    return df.select(*[df[n] for n in names])


def fresh(df: DataFrame, *labels: str) -> list[str]:
    """Column names of our own, made from ``labels``, that ``df`` doesn't have (in any case of letters)."""
    taken, out = {c.lower() for c in df.columns}, []
    for label in labels:
        while label.lower() in taken:
            label += "_"
        taken.add(label.lower())
        out.append(label)
    return out


class WordHash(dict):
    """word (bytes) -> 64-bit XXH64, remembered; forgets everything at ``limit`` words to bound the memory."""

    def __init__(self, seed: int = 0, limit: int = 400_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Odd multipliers of the polynomial window hashes (fixed, arbitrary).
BASE_A = np.uint64(0x9E3779B97F4A7C15)
BASE_B = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def window_hash(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes (empty if there are fewer).

    Doubles the run length log2(size) times, so the cost is a few vector operations per word.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, have, power, rest = None, 0, h, size
    width, factor = 1, base
    while rest:
        if rest & 1:
            piece = power[have : have + n]
            out = piece.copy() if out is None else out * factor + piece
            have += width
        rest >>= 1
        if rest:
            power = power[: len(power) - width] * factor + power[width:]
            factor = np.uint64(int(factor) * int(factor) & 0xFFFFFFFFFFFFFFFF)
            width *= 2
    return mix(out)


class BitTable:
    """A set of 64-bit keys as a fixed number of bits: finds all that was put in, and at times more."""

    @staticmethod
    def has(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Which ``keys`` (unsigned) the words of the ``table`` hold."""
        at = keys & np.uint64(64 * len(table) - 1)
        return (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """The bit table of the first column (well-mixed longs): 2 ** ``bits`` bits whatever the number of keys.

    Only its words of 64 bits, joined per word before they move, reach the driver.
    """
    name = keys.columns[0]
    words = keys.select(F.shiftright(F.col(name), 6).bitwiseAND(F.lit((1 << bits - 6) - 1)).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col(name).bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = words.groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << bits - 6, np.uint64)
    table[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def connected(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for the nodes of an undirected edge list (src, dst): root is the smallest node of the component.

    Large-star and small-star rounds (Kiveris et al., 2014). Minima are aggregated and joined back, so that no
    neighbour list is ever gathered or broadcast; every round is written to the shared folder, which cuts the lineage.
    """
    star = materialize(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).filter("src <> dst"), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    seen = mark(star)
    for _ in range(rounds if seen[0] else 0):
        both = star.select("src", "dst").union(star.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("low"))
        large = both.join(low.hint("merge"), "src").filter("dst > src").select(F.col("dst").alias("src"), F.least("src", "low").alias("dst")).distinct()
        down = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(down.hint("merge"), "src").select(F.explode(F.array(F.struct(F.col("dst").alias("src"), F.col("low").alias("dst")), F.struct("src", F.col("low").alias("dst")))).alias("e")).select("e.*").filter("src <> dst").distinct()
        star = materialize(small, "edges")
        now = mark(star)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return star.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(star.select(F.col("dst").alias("node"), F.col("dst").alias("root"))).distinct()
