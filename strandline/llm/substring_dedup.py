"""Substring deduplication on a compacted de Bruijn graph of word k-mers.

A window is ``WINDOW`` = 50 consecutive words. Its node is its minimiser: the least hashed k-mer (k = ``K`` = 20 words) in
it, which depends on the window's words alone, so equal windows have equal nodes and about one word in sixteen starts a
node. The windows of one text around one node are consecutive and form its edge bundle (*block*): they share the node
and differ by how far they reach on either side.

1. Every text is reduced to its nodes and blocks once; a node of 64 bits and a block of 64 bits name the block's words.
2. Equal blocks compact: one grouped minimum gives the smallest document of each block, and one join sends it back. A
   node with a single block is nonbranching, so for it this decides all windows. In a branching node it decides all
   blocks but one for each group of equal blocks (the smallest document's own).
3. Repeated blocks and those remaining blocks of branching nodes go back to their source coordinates. Every occurrence of
   a repeated block is verified by a BLAKE2 digest (128 bits) of its words there; blocks whose occurrences differ decide
   nothing. The windows of remaining (and of differing) blocks are hashed word for word (128 bits) and the smallest
   document of each window is found the same way.

Nothing is paired: each step is a grouped minimum, pre-aggregated before its shuffle, and a join with one row a key.

Results (``report``): every word covered by a window whose word sequence also starts in a document with a smaller doc_id
is removed. A null or empty text has no words; a text of fewer than 50 words keeps all; repeats inside one document, or
in rows with the same doc_id, are kept; a null doc_id is neither smaller nor larger than any, so such a row keeps all
its words and removes none; an empty table gives an empty result; extra columns are ignored by ``report`` and kept by
``remove``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BASE_A, BASE_B, WordHash, fresh, materialize, mix, pick, window_hash

WINDOW = 50
K = 20
_C = [np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def nodes(h: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, ...]:
    """(kmer, block, lo, hi) of the nodes of a text: its windows lo..hi have this node."""
    kmers = window_hash(h, k, BASE_B)
    at = sliding_window_view(kmers, window - k + 1).argmin(axis=1) + np.arange(len(h) - window + 1)
    lo = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    hi = np.r_[lo[1:], len(at)] - 1
    whole = window_hash(h, window, BASE_A)
    # hi - lo <= window - k, so the first and the last window cover the block's words without a gap.
    shape = ((hi - lo) * window + at[lo] - lo).astype(np.uint64)
    block = mix(whole[lo] * _C[0] + mix(whole[hi] * _C[1] + shape * _C[2]))
    return kmers[at[lo]].view(np.int64), block.view(np.int64), lo.astype(np.int32), hi.astype(np.int32)


_NODE = pa.struct([("kmer", pa.int64()), ("block", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def _reduce(docs: DataFrame, window: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash(2)
        for batch in batches:
            counts, digests, sizes, parts = [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words = (text or b"").split()
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) >= window:
                    parts.append(nodes(known.array(words), window, k))
                    sizes.append(len(parts[-1][0]))
                else:
                    sizes.append(0)
            columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, t) for t in (np.int64, np.int64, np.int32, np.int32)]
            offsets = pa.array(np.r_[0, np.cumsum(np.array(sizes, np.int64))], pa.int32())
            found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(c) for c in columns], fields=list(_NODE)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), found], ["doc_id", "row", "n_words", "digest", "nodes"])

    keyed = _keyed(pick(docs, ["doc_id", "text"])).select("doc_id", "row", "text")
    return keyed.mapInArrow(run, "doc_id long, row long, n_words long, digest string, nodes array<struct<kmer:long,block:long,lo:int,hi:int>>")


def _keyed(docs: DataFrame, name: str = "row") -> DataFrame:
    """With the hash that tells rows of one doc_id apart."""
    return docs.withColumn(name, F.xxhash64("text"))


_SPAN = "doc_id long, row long, at int, w1 long, w2 long, kmer long, block long"


def _read(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """What stands at the source coordinates ``wanted`` (doc_id, row, ranges of lo, hi, kmer, block, whole).

    A whole range gives one row with a digest of its words (kmer, block, w1, w2); any other gives a row for each of its
    windows (doc_id, row, at, w1, w2).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash(2)
        for batch in batches:
            for doc_id, row, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                words = text.split()
                if whole := [r for r in ranges if r["whole"]]:
                    digests = b"".join(hashlib.blake2b(b" ".join(words[r["lo"] : r["hi"] + window]), digest_size=16).digest() for r in whole)
                    w = np.frombuffer(digests, np.int64).reshape(-1, 2)
                    none = lambda kind: pa.nulls(len(whole), kind)  # noqa: E731, B023
                    keys = [pa.array([r[c] for r in whole], pa.int64()) for c in ("kmer", "block")]
                    yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.int64()), none(pa.int32()), pa.array(w[:, 0]), pa.array(w[:, 1]), *keys], ["doc_id", "row", "at", "w1", "w2", "kmer", "block"])
                if parts := [r for r in ranges if not r["whole"]]:
                    h = known.array(words)
                    at = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in parts]))
                    w1, w2 = window_hash(h, window, BASE_A)[at].view(np.int64), window_hash(h, window, BASE_B)[at].view(np.int64)
                    same = lambda x: pa.array(np.full(len(at), x, np.int64))  # noqa: E731, B023
                    none = pa.nulls(len(at), pa.int64())
                    yield pa.RecordBatch.from_arrays([same(doc_id), same(row), pa.array(at.astype(np.int32)), pa.array(w1), pa.array(w2), none, none], ["doc_id", "row", "at", "w1", "w2", "kmer", "block"])

    joined = _keyed(pick(docs, ["doc_id", "text"])).join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "ranges")
    return joined.mapInArrow(run, _SPAN)


def _ranges(df: DataFrame, *more: str) -> DataFrame:
    """One row a text; its ranges, each once, number no more than twice its words."""
    return df.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi", *more)).alias("ranges"))


def repeated(docs: DataFrame, reduced: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, row, ranges): the window ranges lo..hi of each text to be removed; texts without any are absent."""
    name = ["kmer", "block"]
    seen = reduced.filter(F.col("doc_id").isNotNull()).select("doc_id", "row", F.explode("nodes").alias("n")).select("doc_id", "row", "n.*")
    blocks = materialize(seen.groupBy(*name).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "blocks")
    branching = blocks.groupBy("kmer").agg(F.count("*").alias("n")).filter("n > 1").select("kmer", F.lit(True).alias("branching"))
    marked = blocks.join(branching, "kmer", "left").filter("branching OR first < last")
    met = materialize(seen.join(materialize(marked, "marked"), name).select("doc_id", "row", "lo", "hi", *name, "first", "last", F.coalesce("branching", F.lit(False)).alias("branching")), "met")
    # Every occurrence of a repeated block is read at its source, and so are the windows that blocks don't decide.
    whole = met.filter("first < last").withColumn("whole", F.lit(True))
    parts = met.filter("branching AND doc_id = first").withColumn("whole", F.lit(False))
    read = materialize(_read(docs, _ranges(whole.unionByName(parts), *name, "whole"), window), "windows")
    checked = read.filter("kmer IS NOT NULL").groupBy(*name).agg((F.min("w1") < F.max("w1")).alias("a"), (F.min("w2") < F.max("w2")).alias("b"))
    differ = materialize(checked.filter("a OR b").select(*name), "differing-blocks")
    settled, windows = met.filter("doc_id > first"), read.filter("kmer IS NULL")
    if not differ.isEmpty():  # different words under one name (not seen): their windows decide
        settled = settled.join(differ.hint("merge"), name, "left_anti")
        again = met.join(differ.hint("merge"), name).withColumn("whole", F.lit(False))
        windows = windows.union(materialize(_read(docs, _ranges(again, *name, "whole"), window), "windows")).distinct()
    least = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    single = windows.join(materialize(least, "least"), ["w1", "w2"]).filter("doc_id > first")
    return _ranges(settled.select("doc_id", "row", "lo", "hi").union(single.select("doc_id", "row", F.col("at").alias("lo"), F.col("at").alias("hi"))))


def covered(n: int, ranges: list[dict], window: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, [r["lo"] for r in ranges], 1)
    np.add.at(edge, [r["hi"] + window for r in ranges], -1)
    return np.cumsum(edge[:-1]) > 0


def _kept(text: bytes, ranges: list[dict], window: int) -> tuple[int, bytes]:
    words = text.split()
    gone = covered(len(words), ranges, window)
    return int(gone.sum()), b" ".join([w for w, g in zip(words, gone.tolist()) if not g])


def report(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    reduced = materialize(_reduce(docs, window, k), "nodes")
    found = repeated(docs, reduced, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            done = [_kept(t, r, window) for t, r in zip(texts, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([n for n, _ in done], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for _, x in done], pa.string())],
                ["doc_id", "row", "removed", "kept"],
            )

    cut = _keyed(pick(docs, ["doc_id", "text"])).join(found, ["doc_id", "row"]).select("doc_id", "row", "text", "ranges")
    cut = cut.mapInArrow(run, "doc_id long, row long, removed long, kept string").dropDuplicates(["doc_id", "row"])
    return reduced.select("doc_id", "row", "n_words", "digest").join(cut, ["doc_id", "row"], "left").select("doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "digest").alias("kept_sha256"))


def remove(docs: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """``docs`` with repeated passages taken out: a changed text is its kept words joined by one space."""
    found = repeated(docs, materialize(_reduce(docs, window, k), "nodes"), window)

    @F.pandas_udf("string")
    def kept(text, ranges):
        return text.combine(ranges, lambda t, r: _kept((t or "").encode(), list(r), window)[1].decode())

    id_, row, ranges, key = fresh(docs, "id", "row", "ranges", "key")
    found = found.select(F.col("doc_id").alias(id_), F.col("row").alias(row), F.col("ranges").alias(ranges))
    cut = _keyed(docs, key).join(found.hint("merge"), (F.col("doc_id") == F.col(id_)) & (F.col(key) == F.col(row)), "left")
    changed = kept("text", F.coalesce(ranges, F.array().cast("array<struct<lo:int,hi:int>>")))
    return cut.withColumn("text", F.when(F.col(ranges).isNull(), F.col("text")).otherwise(changed)).select(*docs.columns)
