"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

A document's set has the hashes of its distinct word shingles. Sizes fall into bands so that two sets of a similarity of
``SIMILAR`` hundredths lie in one band or in neighbouring ones; each set is signed for its own band and for the next. In a
band, similar sets differ in at most k = 2 * (1 - s) / (1 + s) * (largest size of the band) features. The feature domain is
hashed into n1 = ceil((k + 1) / (SPARE + 1)) parts, one of which then holds at most ``SPARE`` differences, and each part
into ``SPLIT`` smaller ones. A signature is a part and a choice of all but ``SPARE`` of its smaller parts, with the sum of
the hashed features that fall there: similar sets share at least one, so no pair is lost.

A window over the signatures finds those that different sets have, in one shuffle; most are gone after it. Sets that
share one meet as in ``minhash``: first with the smallest set of the signature, then in pairs that aren't in one
component yet, and where more than ``minhash.BUCKET`` sets share a signature, through their rarest shingles (an exact
prefix filter). Each pair is compared by its whole sets. Nothing is capped.

Defined results: a text without words (null, empty, white space) has an empty set and is linked with nothing; fewer words
than a shingle are one shingle; texts with equal sets are one class; rows repeated under one id give a row each; a null
doc_id is no smallest id, so a component of null ids only has a null component_id; an empty table gives an empty result;
extra columns are ignored. Features are 64-bit hashes: two shingles with one hash would count as one.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import BASE_A, BASE_B, materialize, mix, pick
from strandline.llm.minhash import components_of
from strandline.llm.simhash import shingle_hashes

SIMILAR = 90  # hundredths
SHINGLE = 3
SPARE = 1  # differences that a signature leaves room for in its part
SPLIT = 3  # smaller parts of a part
_CHOICES = list(combinations(range(SPLIT), SPLIT - SPARE))


def bands(similar: int = SIMILAR, longest: int = 1 << 40) -> list[int]:
    """The smallest size of each band: the largest size s of a band has s * similar <= 100 * its smallest."""
    out = [1]
    while out[-1] <= longest:
        out.append(out[-1] * 100 // similar + 1)
    return out


def differences(band: int, lows: list[int], similar: int = SIMILAR) -> int:
    """Features in which two similar sets of sizes up to the largest of the band differ at most."""
    return 2 * (lows[band + 1] - 1) * (100 - similar) // (100 + similar)


def band_signatures(features: np.ndarray, band: int, k: int) -> np.ndarray:
    """The signatures of one set in one band; none where similar sets are equal (equal sets are one class)."""
    if k == 0:
        return np.empty(0, np.uint64)
    parts = -(-(k + 1) // (SPARE + 1))
    with np.errstate(over="ignore"):
        spread = mix(features * BASE_A + np.uint64(band))
        part = ((spread >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        cell = (part * np.uint64(SPLIT) + (spread & np.uint64(0xFFFFFFFF)) % np.uint64(SPLIT)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(features[order] + BASE_B), dtype=np.uint64)])
        ends = np.searchsorted(cell[order], np.arange(parts * SPLIT + 1))
        sums = np.diff(summed[ends]).reshape(parts, SPLIT)
        tag = mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40))
        made = [mix(mix(sums[:, list(c)].sum(axis=1, dtype=np.uint64) ^ (tag * BASE_A)) + tag + np.uint64(i)) for i, c in enumerate(_CHOICES)]
    return np.concatenate(made)


def signatures(features: np.ndarray, lows: list[int], similar: int = SIMILAR) -> np.ndarray:
    """The signatures of a set (distinct 64-bit features) in its own band and the next."""
    if not len(features):
        return np.empty(0, np.uint64)
    own = bisect_right(lows, len(features)) - 1
    return np.concatenate([band_signatures(features, b, differences(b, lows, similar)) for b in (own, own + 1)])


def set_name(features: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(features.tobytes(), len(features))


def _sets(frame: DataFrame, values, shingle: int) -> DataFrame:
    """(doc_id, row, text) -> (doc_id, row, node, size, values): the set's name and size, and what ``values`` makes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [np.unique(shingle_hashes(t or b"", shingle)) for t in part.column(2).cast(pa.binary()).to_pylist()]
                nodes = np.array([set_name(s) for s in sets], np.uint64).view(np.int64)
                made = pa.array([values(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), pa.array(list(map(len, sets)), pa.int64()), made], ["doc_id", "row", "node", "size", "values"])

    return frame.mapInArrow(run, "doc_id long, row long, node long, size long, values array<long>")


def jaccard_components(docs: DataFrame, similar: int = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest doc_id reachable over links, itself included, for every row."""
    if not 50 <= similar < 100:
        raise ValueError("similar is in hundredths, from 50 to 99")
    keyed = pick(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("row"), "text")
    lows = bands(similar)
    found = materialize(_sets(keyed, lambda s: signatures(s, lows, similar), shingle), "join-signatures")
    # One row stands for a set; copies have the same signatures.
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    nodes = materialize(found.filter("size > 0").groupBy("node").agg(F.min(first).alias("first")), "join-nodes")
    # One shuffle of the signatures: of each key the window tells whether different sets have it. Copies come along (they
    # have equal signatures) and are one row from there on. Few signatures are shared.
    key = Window.partitionBy("key")
    posted = found.select("node", F.explode("values").alias("key"))
    ends = posted.withColumns({"hub": F.min("node").over(key), "last": F.max("node").over(key)})
    once = ends.filter("hub <> last").groupBy("key", "node", "hub").agg(F.lit(0).alias("band"))
    met = once.withColumn("n", F.count("*").over(key))
    met = materialize(met.select("band", "key", "node", "n", "hub"), "join-buckets")
    involved = met.select("node").distinct().join(nodes.select("node", "first"), "node").select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row"))
    texts = keyed.join(involved.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text")
    sets = materialize(_sets(texts, lambda s: s, shingle).select("node", "values").dropDuplicates(["node"]), "join-sets")

    labels = components_of(met, sets, similar, 100)
    classes = nodes.select("node", F.col("first.doc_id").alias("first")).join(labels.hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    reached = classes.groupBy("root").agg(F.min("first").alias("component_id"))
    named = classes.join(reached.hint("merge"), "root").select("node", "component_id")
    out = found.select("doc_id", "size", "node").join(named.hint("merge"), "node", "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
