"""Pairs of similar sets: exact comparison, and an exact prefix filter for what an index of candidates can't guarantee.

Every candidate pair is compared by its whole shingle sets: linked means a Jaccard similarity of at least ``similar`` parts
``of`` the union. ``components_of`` takes the buckets of an index. No bucket is compared with the square of its size: first
each node meets the smallest node of each of its buckets, then the pairs of a bucket of at most ``BUCKET`` nodes meet that
aren't in one component yet. Nodes of larger buckets, and in the pipeline's stage (``near_components``) all texts, meet
through their rarest shingles (prefix filtering, Chaudhuri et al., 2006, with the position bound of Xiao et al., 2008): two
sets of similarity 0.8 share a shingle among the first fifth of each, in any common order, and in the order of frequency
(from a table of ``COUNTERS`` counts) the shingles that many of them share come last. That loses no pair, and texts that
only have a large passage in common don't meet at all; bit sets of the shingles bound what a pair can share before it is
made. In the list of a shingle only those outside its most frequent component look for partners.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import connected, materialize, pick
from strandline.llm.simhash import fingerprint_of, links, shingle_hashes

BUCKET = 32
SIMILAR = 8  # tenths
COUNTERS = 1 << 18  # of shingle frequencies
MASKS = 32  # 64-bit words of the bit set of a node's shingles
_MASKS = [f"m{i}" for i in range(MASKS)]


def node_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()))


def _batches(frame: DataFrame, one, schema: str, kind: pa.DataType, size: int, name=lambda text, hashes: node_of(text)) -> DataFrame:
    """(doc_id, row, text) -> (doc_id, row, node, values), with ``one`` making the values of the shingle hashes and ``name`` the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                sets = [np.unique(shingle_hashes(t, size)) for t in texts]
                nodes = np.array([name(t, h) for t, h in zip(texts, sets)], np.uint64).view(np.int64)
                values = pa.array([one(h).view(np.int64) for h in sets], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes), values], ["doc_id", "row", "node", "values"])

    return frame.mapInArrow(run, schema)


_SCHEMA, _KIND = "doc_id long, row long, node long, values array<long>", pa.list_(pa.int64())


def _keyed(docs: DataFrame) -> DataFrame:
    return pick(docs, ["doc_id", "text"]).select("doc_id", F.xxhash64("text").alias("row"), "text")


def frequencies(frame: DataFrame, tokens_of) -> np.ndarray:
    """How often the tokens of all batches (``tokens_of`` gives a batch's arrays) fall on each of ``COUNTERS`` counters.

    Any common order of shingles is right; frequencies only make it selective, so a table of fixed size holds them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)  # one table a task, so that it sends each counter once
        for batch in batches:
            for tokens in tokens_of(batch):
                seen += np.bincount(tokens % COUNTERS, minlength=COUNTERS)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["k", "n"])

    counted = frame.mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(COUNTERS, np.int64)
    table[counted["k"].to_numpy()] = counted["n"].to_numpy()
    return table


def prefix(tokens: np.ndarray, frequency: np.ndarray, similar: int, of: int) -> np.ndarray:
    """The rarest tokens of a set: so many that two similar sets share one of them."""
    first = len(tokens) - -(-len(tokens) * similar // of) + 1  # places that a similar pair can share first
    return tokens[np.lexsort((tokens, frequency[tokens % COUNTERS]))[:first]]


def _confirmed(pairs: DataFrame, sets: DataFrame, similar: int = SIMILAR, of: int = 10) -> DataFrame:
    """The ``pairs`` (src, dst) that are similar, ``similar`` parts ``of`` the union, by their whole ``sets`` (node, values)."""
    a, b = (sets.select(F.col("node").alias(x), F.col("values").alias(f"{x}_set")).hint("merge") for x in ("src", "dst"))
    both = F.size(F.array_intersect("src_set", "dst_set"))
    ends = F.size("src_set") + F.size("dst_set")
    shorter, longer = F.least(F.size("src_set"), F.size("dst_set")), F.greatest(F.size("src_set"), F.size("dst_set"))
    met = pairs.join(a, "src").join(b, "dst").filter(of * shorter >= similar * longer)
    return met.filter(of * both >= similar * (ends - both)).select("src", "dst")


def _rare_pairs(met: DataFrame, sets: DataFrame, roots: DataFrame, similar: int = SIMILAR, of: int = 10) -> DataFrame:
    """(src, dst): pairs of the nodes of large buckets that share a rare shingle where a similar pair must."""
    crowd = met.filter(F.col("n") > BUCKET).select("node").distinct()
    held = sets.join(crowd.hint("merge"), "node").join(roots.hint("merge"), "node", "left")
    held = materialize(held.select("node", F.coalesce("root", "node").alias("root"), F.size("values").alias("size"), "values"), "near-crowd")
    table = frequencies(held.select("values"), lambda batch: [batch.column(0).flatten().to_numpy(zero_copy_only=False)])
    frequency = held.sparkSession.sparkContext.broadcast(table)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, found = batch.slice(lo, 256), []
                for values in part.column(3):
                    tokens = values.values.to_numpy(zero_copy_only=False)
                    found.append(prefix(tokens, frequency.value, similar, of))
                sizes = [len(x) for x in found]
                rows = np.repeat(np.arange(len(found)), sizes)
                at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(pa.array(rows)) for k in range(3)), pa.array(at), pa.array(np.concatenate(found))], ["node", "root", "size", "at", "token"])

    posted = held.mapInArrow(rare, "node long, root long, size int, at int, token long")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    mask = lambda i: F.aggregate("values", F.lit(0).cast("long"), lambda seen, x: F.when(F.pmod(F.shiftright(x, 6), F.lit(MASKS)) == i, seen.bitwiseOR(bit(x))).otherwise(seen))
    bits = held.select("node", *[mask(i).alias(f"m{i}") for i in range(MASKS)])
    return _listed_pairs(materialize(posted, "near-rare"), bits, similar, of)


def _listed_pairs(posted: DataFrame, bits: DataFrame, similar: int, of: int) -> DataFrame:
    """(src, dst): the pairs under one token of ``posted`` (node, root, size, at, token) that can be similar by places and ``bits``."""
    heads = posted.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.count("*").alias("roots")).filter("roots > 1")
    listed = posted.join(heads.select("token", "major").hint("merge"), "token").withColumn("minor", F.col("root") != F.col("major")).drop("major")
    listed = materialize(listed.join(bits.hint("merge"), "node").withColumn("excess", F.col("size") - sum(F.bit_count(m) for m in _MASKS)), "near-lists")
    a, b = listed.filter("minor").alias("a"), listed.alias("b")
    least = F.ceil((F.col("a.size") + F.col("b.size")) * similar / (of + similar))  # shingles that a similar pair shares
    fits = (F.col("a.at") <= F.col("a.size") - least) & (F.col("b.at") <= F.col("b.size") - least)
    # Common shingles are at most the common bits and the shingles that had no bit of their own.
    reach = sum(F.bit_count(F.col(f"a.{m}").bitwiseAND(F.col(f"b.{m}"))) for m in _MASKS) + F.least("a.excess", "b.excess") >= least
    new = (F.col("a.token") == F.col("b.token")) & (F.col("a.root") != F.col("b.root")) & (~F.col("b.minor") | (F.col("a.node") < F.col("b.node"))) & fits & reach
    return a.join(b.hint("merge"), new).select(F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")).distinct()


def components_of(met: DataFrame, sets: DataFrame, similar: int = SIMILAR, of: int = 10) -> DataFrame:
    """(node, root) of the linked nodes among ``met``, the buckets (band, key, node, n, hub), by their ``sets``."""
    hubs = met.filter("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst")).distinct()
    linked = materialize(_confirmed(hubs, sets, similar, of), "near-links")
    roots = materialize(connected(linked), "near-roots")
    small = met.filter((F.col("n") > 2) & (F.col("n") <= BUCKET)).join(roots.hint("merge"), "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"), "hub")
    a, b = small.alias("a"), small.alias("b")
    same = (F.col("a.band") == F.col("b.band")) & (F.col("a.key") == F.col("b.key"))
    # Pairs with the hub have been compared.
    new = same & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & (F.col("a.node") != F.col("a.hub"))
    rest = a.join(b.hint("merge"), new).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst"))
    more = materialize(_confirmed(rest.union(_rare_pairs(met, sets, roots, similar, of)).distinct(), sets, similar, of), "near-links")
    # Only the roots' own links are new; a node without links is its own component.
    return connected(linked.union(more))


def _fingerprinted(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, node, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or b"" for t in part.column(2).cast(pa.binary()).to_pylist()]
                made = [pa.array(np.array(list(map(f, texts)), np.uint64).view(np.int64)) for f in (node_of, lambda t: fingerprint_of(t, size))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], ["doc_id", "row", "node", "fp"])

    return _keyed(docs).mapInArrow(run, "doc_id long, row long, node long, fp long")


def _rare_shingles(docs: DataFrame, size: int) -> DataFrame:
    """(token, node, size, at, hub, n): the rarest shingles of the texts, those that different texts have; hub: the token's smallest node."""
    signed = lambda text: np.unique(shingle_hashes(text or b"", size)).view(np.int64)
    texts = pick(docs, ["text"])
    table = frequencies(texts, lambda batch: (signed(t) for t in batch.column(0).cast(pa.binary()).to_pylist()))
    frequency = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                held = [t for t in batch.slice(lo, 256).column(0).cast(pa.binary()).to_pylist() if t]
                sets = list(map(signed, held))
                found = [prefix(x, frequency.value, SIMILAR, 10) if len(x) else x for x in sets]
                many = list(map(len, found))
                node = np.repeat(np.array(list(map(node_of, held)), np.uint64).view(np.int64), many)
                place = np.concatenate([np.empty(0, np.int32), *(np.arange(n, dtype=np.int32) for n in many)])
                token = np.concatenate([np.empty(0, np.int64), *found])
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node), pa.array(np.repeat(list(map(len, sets)), many), pa.int32()), pa.array(place)], ["token", "node", "size", "at"])

    same = Window.partitionBy("token")
    ends = texts.mapInArrow(run, "token long, node long, size int, at int").withColumns({"hub": F.min(F.struct("node", "size", "at")).over(same), "high": F.max("node").over(same), "n": F.count("*").over(same)})
    return ends.filter("hub.node <> high").drop("high").dropDuplicates(["token", "node"])


def _indexed_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst): each node of ``nodes`` (node, fp) with the smallest of its fingerprint, and that with the smallest that the index links."""
    classes = materialize(nodes.withColumn("hub", F.min("node").over(Window.partitionBy("fp"))), "near-classes")
    heads = classes.groupBy("fp").agg(F.min("node").alias("hub"))
    near = links(nodes.select("fp")).groupBy("dst").agg(F.min("src").alias("src"))
    a, b = (heads.select(F.col("fp").alias(x), F.col("hub").alias(f"{x}_hub")).hint("merge") for x in ("src", "dst"))
    met = near.join(a, "src").join(b, "dst").select(F.col("src_hub").alias("src"), F.col("dst_hub").alias("dst"))
    return met.union(classes.filter("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst")))


def _bits(sets: DataFrame) -> DataFrame:
    """(node, m0, m1, ...): the bit set of each node's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks = np.zeros((batch.num_rows, MASKS), np.uint64)
            for k, values in enumerate(batch.column(1)):
                x = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
                np.bitwise_or.at(masks[k], ((x >> np.uint64(6)) % np.uint64(MASKS)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(masks[:, k]).view(np.int64)) for k in range(MASKS))], ["node", *_MASKS])

    return sets.select("node", "values").mapInArrow(run, "node long, " + ", ".join(f"{m} long" for m in _MASKS))


def near_components(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, row, root) of every row of ``docs``; ``row`` is the hash of its text, ``root`` names its component.

    The byte-position index of the fingerprints (``simhash.links``) makes the candidates: each text meets the smallest one
    that the index links it to. Similar texts whose fingerprints differ in more bits than the index guarantees meet by their
    rarest shingles: first with the smallest text of each, then in pairs that aren't in one component yet. No pair of
    similar texts is lost, and each pair is compared by its whole sets.
    """
    found = materialize(_fingerprinted(docs, size), "near-found")
    # One row stands for a node: texts with equal lower-cased words have one fingerprint.
    first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    nodes = materialize(found.groupBy("node").agg(F.min(first).alias("first"), F.min("fp").alias("fp")), "near-nodes")
    indexed = _indexed_pairs(nodes.select("node", "fp"))
    listed = materialize(_rare_shingles(docs, size), "near-rare")
    least = F.ceil((F.col("size") + F.col("hub.size")) * SIMILAR / (10 + SIMILAR))
    hubs = listed.filter((F.col("node") != F.col("hub.node")) & (F.col("at") <= F.col("size") - least) & (F.col("hub.at") <= F.col("hub.size") - least))
    candidates = materialize(indexed.union(hubs.select(F.col("hub.node").alias("src"), F.col("node").alias("dst"))).distinct(), "near-candidates")
    more = listed.filter("n > 2")  # the only pair of two texts has met
    involved = candidates.select(F.explode(F.array("src", "dst")).alias("node")).union(more.select("node")).distinct()
    involved = involved.join(nodes.select("node", "first").hint("merge"), "node").select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_row"))
    texts = _keyed(docs).join(involved.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))).select("doc_id", "row", "text")
    sets = materialize(_batches(texts, lambda h: h, _SCHEMA, _KIND, size).select("node", "values").dropDuplicates(["node"]), "near-sets")

    linked = materialize(_confirmed(candidates, sets), "near-links")
    roots = materialize(connected(linked), "near-roots")
    posted = more.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "size", "at", "token")
    rest = _listed_pairs(materialize(posted, "near-posted"), _bits(sets), SIMILAR, 10)
    labels = connected(linked.union(materialize(_confirmed(rest, sets), "near-links")))
    return found.select("doc_id", "row", "node").join(labels.hint("merge"), "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))
