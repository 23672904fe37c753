"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A 64-bit fingerprint has eight byte positions. Two fingerprints that differ in at most ``MAX_BITS`` = 4 bits differ in
at most four bytes, so they share at least four positional bytes: the guaranteed minimum of the count filter. The index
therefore posts every distinct fingerprint under each choice of four positions and their bytes (70 posting keys of 32
bits): exactly the pairs that reach the minimum meet, and the tally of shared bytes lets each pair through once. The
fingerprints are then compared bit by bit. Exact copies share a fingerprint and are one class from the start.

``components`` works on one fingerprint a document. ``keep_one``, the pipeline's stage, takes the index's links as
candidates and compares shingle sets. At a shingle similarity of 0.8 two fingerprints differ in about ten bits, which no
choice of equal bytes guarantees; the pairs beyond the index meet through an exact prefix filter (``minhash``).

Defined results: a text without words (null, empty, white space) has fingerprint 0 and is linked like any other; fewer
words than a shingle make one shingle; rows repeated under one id give one fingerprint row per row; an empty table gives
an empty result; extra columns are ignored by ``fingerprints`` and kept by ``keep_one``, which keys rows by id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import BASE_A, connected, fresh, materialize, mix, pick

MAX_BITS = 4
SHINGLE = 4
SEED = 42
#: Near-duplicate stages: words of a shingle.
NEAR_SHINGLE = 5
POSITIONS = list(combinations(range(8), 8 - MAX_BITS))


def shingle_hashes(text: bytes, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of the word shingles of a lower-cased text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-size].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as an unsigned 64-bit number."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        block = np.ascontiguousarray(hashes[i : i + 8192]).view(np.uint8).reshape(-1, 8)
        bits = np.unpackbits(block, axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # sums of at most 255 fit in a byte
            ones += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: bytes, size: int = SHINGLE) -> int:
    return simhashes(text, size, 1)[0]


def fingerprint_of(text: bytes, size: int) -> int:
    """``simhash`` on the distinct shingles, which is what near-duplicate stages compare."""
    h = shingle_hashes(text, size)
    return majority(np.unique(h)) if len(h) else 0


def simhashes(text: bytes, size: int, count: int) -> list[int]:
    """``count`` fingerprints: the first on the shingle hashes, the others on further mixes of them."""
    h = shingle_hashes(text, size)
    if not len(h):
        return [0] * count
    with np.errstate(over="ignore"):
        return [majority(h), *(majority(mix(h + np.uint64(k) * BASE_A)) for k in range(1, count))]


def fingerprints(docs: DataFrame, size: int = SHINGLE, count: int = 1) -> DataFrame:
    """(doc_id, fp, and with a ``count`` over 1 fp1, fp2, ...): fingerprints of every whole text as signed longs."""
    names = ["fp", *(f"fp{k}" for k in range(1, count))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([simhashes(t or b"", size, count) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64).reshape(-1, count)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(values[:, k]).view(np.int64)) for k in range(count))], ["doc_id", *names])

    return pick(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(src, dst): each pair of distinct fingerprints within ``max_bits`` (at most 4) differing bits, once, src < dst."""
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the index guarantees pairs up to {MAX_BITS} bits")
    choices = F.array(*[F.struct(F.lit(k).cast("byte").alias("choice"), F.lit(_signed(sum(255 << 8 * i for i in c))).alias("mask")) for k, c in enumerate(POSITIONS)])
    posted = fps.select("fp").distinct().select("fp", F.explode(choices).alias("c")).select("fp", "c.choice", F.col("fp").bitwiseAND(F.col("c.mask")).alias("shared"))
    a, b = posted.alias("a"), posted.alias("b")  # the same rows, so one shuffle serves both sides
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # The tally up to the last chosen position: 4 only under the first choice that the pair shares.
    last = F.get(F.array(*[F.lit(c[-1]) for c in POSITIONS]), F.col("a.choice").cast("int"))
    tally = sum(F.when((F.lit(i) <= last) & (F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0), 1).otherwise(0) for i in range(8))
    met = (F.col("a.choice") == F.col("b.choice")) & (F.col("a.shared") == F.col("b.shared")) & (F.col("a.fp") < F.col("b.fp"))
    # Spark doesn't count what the explode adds, so it would take 70 rows for each fingerprint for a table to broadcast.
    return a.join(b.hint("merge"), met & (F.bit_count(differ) <= max_bits) & (tally == 8 - MAX_BITS)).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def components(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included."""
    fps = materialize(fps, "simhash-fp")
    labels = connected(links(fps, max_bits))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first")).join(labels.withColumnRenamed("node", "fp").hint("merge"), "fp", "left")
    classes = classes.select("fp", "first", "root")
    smallest = classes.filter(F.col("root").isNotNull()).groupBy("root").agg(F.min("first").alias("reached"))
    named = classes.join(smallest.hint("merge"), "root", "left").select("fp", F.coalesce("reached", "first").alias("component_id"))
    return fps.join(named.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = NEAR_SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest doc_id, then of the smallest text hash.

    Components are linked by the Jaccard similarity of word shingles (``minhash.near_components``); candidates come from the
    fingerprint index, and from an exact prefix filter where the index guarantees nothing. Rows
    are keyed by doc_id and text, so an id that occurs with several texts has several rows, each judged by its own text. A
    null doc_id is no id in common: such rows are told apart by their texts and come after all others in the choice. Of rows
    with one id and one text, the first by the JSON of the other columns stays.
    Only light rows are grouped; whole texts move to be compared, and once more to meet the keys that go. Repeated rows
    are thinned to one a task before that move.
    """
    from strandline.llm.minhash import near_components

    found = materialize(near_components(docs, size), "near-found")
    key = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    chosen = found.groupBy("root").agg(F.min(key).alias("chosen"))
    null, id_, row, turn = names = fresh(docs, "null", "id", "row", "turn")
    gone = found.join(chosen.hint("merge"), "root").filter(key != F.col("chosen"))
    gone = gone.select(F.col("doc_id").isNull().alias(null), F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("row").alias(row)).distinct()
    # What goes grows with the corpus, so it is never broadcast: one plan at every size.
    keyed = docs.withColumns({null: F.col("doc_id").isNull(), id_: F.coalesce("doc_id", F.lit(0)), row: F.xxhash64("text")})
    others = F.to_json(F.struct(*[F.col(c) for c in docs.columns if c != "text"]))
    once = keyed.withColumn(turn, F.row_number().over(Window.partitionBy(*names[:3]).orderBy(others))).filter(F.col(turn) == 1)
    return once.join(gone.hint("merge"), names[:3], "left_anti").select(*docs.columns)
