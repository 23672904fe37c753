"""Best-fit packing with Martello-Toth dominance reduction.

Bin packing only depends on how many pieces there are of each length, and there are at most ``capacity`` lengths. The
plan is therefore made on the length histogram (at most 1024 rows, whatever the corpus): dominance first fixes small sets
that provably dominate every other set holding their largest piece, whole multiplicities at a time; best-fit decreasing
then packs what is left, again in whole classes of equal bins. The plan is a list of slot ranges per length (bounded by
capacity squared, not by the corpus). Pieces get a rank within their length, in groups whose size is bounded, and take
the slot of that rank by a broadcast join with the plan.

Defined results: a null or empty text is the end token alone (one piece of length 1); only documents longer than the
capacity are cut, and only their first piece may be shorter; rows repeated under one id give one set of pieces each; an
empty table gives an empty result; extra columns of ``docs`` are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import materialize, pick

CAPACITY = 1024
END_TOKEN = 2
VOCABULARY = "byte_bpe_50k"
#: Pieces ranked together at most; a longer run of one length is split into that many groups.
RANK_GROUP = 2_000
#: Rows of the plan that may be broadcast. The plan cannot exceed it at the default capacity: at most about three
#: patterns for each length, each with at most 44 different lengths (1 + 2 + ... + 45 > 1024).
PLAN_ROWS = 3 * CAPACITY * 45


@cache
def _encoder(vocabulary: str):
    """text -> ids of the public tokenizer. The same vocabulary as ranks is four times as fast where it is present."""
    import base64
    import os

    import public_tokenizers as public
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    whole = Tokenizer.from_file(public.path(f"{vocabulary}.json"))
    special = [t.content for t in whole.get_added_tokens_decoder().values()]

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4")

    ranks_file = public.path(f"{vocabulary}.tiktoken")
    if not os.path.exists(ranks_file):
        return slow
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return slow(text)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, np.ndarray]]:
    """(start, ids) of the pieces; only the first may be shorter than the capacity."""
    n = len(ids)
    if n <= capacity:
        return [(0, ids)]
    first = n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, ids[a:b]) for a, b in zip(edges, edges[1:])]


def tokenise(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end_token: int = END_TOKEN) -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit numbers, the layout of a token shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # bounds what is held besides the batch
                part = batch.slice(at, 500)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encode(text), end_token) if text else np.array([end_token])
                    rows += [(doc_id, k, start, len(x), x.astype("<u4").tobytes()) for k, (start, x) in enumerate(cut(ids, capacity))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "piece", "start", "length", "ids"])

    return pick(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def _smallest(left: Counter, lengths: list[int], without: Counter, above: int, want: int) -> list[int]:
    """The ``want`` smallest pieces longer than ``above``, besides those of ``without``. ``lengths`` is ascending."""
    out: list[int] = []
    for w in lengths:
        if w > above:
            out += [w] * min(want - len(out), left[w] - without[w])
            if len(out) == want:
                break
    return out


def _largest(left: Counter, lengths: list[int], without: Counter, most: int) -> int:
    return next((w for w in reversed(lengths) if w <= most and left[w] > without[w]), 0)


def dominance(left: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets and take them out of ``left``, until none is found.

    For the largest piece j and the room r beside it: (1) nothing fits: {j}. (2) with k the largest piece that fits,
    {j, k} if it fills the bin, or if no two pieces fit in r: whatever else stood with j is no longer than k and can take
    k's place. (3) If no three pieces fit in r: {j, k} when k is at least as long as the longest feasible pair; else
    {j, k, b}, b the largest beside k, when no two pieces longer than b fit together, for then every pair is covered by
    (k, b) one to one. Taking pieces out only makes these conditions easier, so all equal sets are fixed at once.
    """
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for j in sorted((w for w in left if left[w]), reverse=True):
            while left[j]:
                lengths = sorted(w for w in left if left[w])
                one, room, inf = Counter({j: 1}), capacity - j, capacity + 1
                s = (_smallest(left, lengths, one, 0, 3) + [inf] * 3)[:3]
                k = _largest(left, lengths, one, room)
                if not k:
                    pieces = one
                elif j + k == capacity or s[0] + s[1] > room:
                    pieces = one + Counter({k: 1})
                elif sum(s) > room:
                    b = _largest(left, lengths, one + Counter({k: 1}), room - k)
                    best, low = 0, [w for w in lengths if w <= room]
                    for a in low:
                        partner = _largest(left, low, one + Counter({a: 1}), room - a)
                        best = max(best, a + partner if partner else 0)
                    longer = (_smallest(left, lengths, one, b, 2) + [inf] * 2)[:2]
                    if k >= best:
                        pieces = one + Counter({k: 1})
                    elif b and sum(longer) > room:
                        pieces = one + Counter([k, b])
                    else:
                        break
                else:
                    break
                times = min(left[w] // m for w, m in pieces.items())
                for w, m in pieces.items():
                    left[w] -= m * times
                fixed.append((tuple(sorted(pieces.items(), reverse=True)), times))
                changed = True
    return fixed


def best_fit(left: Counter, capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over classes of equal bins: each length goes to the fullest bins that still take it."""
    open_bins: list[list[tuple[Counter, int]]] = [[] for _ in range(capacity + 1)]
    for w in sorted((w for w in left if left[w]), reverse=True):
        n = left[w]
        while n:
            room = next((r for r in range(w, capacity + 1) if open_bins[r]), None)
            if room is None:
                fit = capacity // w
                for times, count in ((fit, n // fit), (n % fit, 1)):
                    if times and count:
                        open_bins[capacity - times * w].append((Counter({w: times}), count))
                break
            pattern, count = open_bins[room].pop()
            took = min(n, count)
            if count > took:
                open_bins[room].append((pattern, count - took))
            open_bins[room - w].append((pattern + Counter({w: 1}), took))
            n -= took
    return [(tuple(sorted(p.items(), reverse=True)), c) for bins in open_bins for p, c in bins]


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slot ranges (length, first rank, end rank, times in a bin, first bin, offset in the bin)."""
    left = Counter(histogram)
    patterns = dominance(left, capacity) + best_fit(left, capacity)
    used: Counter = Counter()
    out, bins = [], 0
    for pattern, count in patterns:
        offset = 0
        for w, times in pattern:
            out.append((w, used[w], used[w] + times * count, times, bins, offset))
            used[w] += times * count
            offset += w * times
        bins += count
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and whatever else it carries) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = materialize(pieces, "pieces")
    # At most ``capacity`` rows come to the driver.
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if any(not 0 < w <= capacity for w in histogram):
        raise ValueError("a piece is longer than the capacity or empty")
    slots = plan(histogram, capacity)
    if len(slots) > max(PLAN_ROWS, 3 * capacity * 45):
        raise ValueError("the plan is larger than its proven bound")
    plan_df = spark.createDataFrame(slots or [(0, 0, 0, 1, 0, 0)], "_w long, _from long, _to long, _times long, _bin long, _at long")
    groups = spark.createDataFrame([(w, max(1, math.ceil(n / RANK_GROUP))) for w, n in histogram.items()] or [(0, 1)], "_len long, _groups int")
    salted = pieces.join(F.broadcast(groups), pieces["length"] == groups["_len"]).withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece"), F.col("_groups")))
    sizes = salted.groupBy("_len", "_group").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_len").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select(F.col("_len").alias("_l"), F.col("_group").alias("_g"), F.coalesce(before, F.lit(0)).alias("_base"))
    ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy("_len", "_group").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(bases, (F.col("_len") == F.col("_l")) & (F.col("_group") == F.col("_g"))).withColumn("_rank", F.col("_rank") + F.col("_base"))
    placed = ranked.join(F.broadcast(plan_df), (F.col("_len") == F.col("_w")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    turn = F.col("_rank") - F.col("_from")
    return placed.select(
        *pieces.columns,
        (F.col("_bin") + F.floor(turn / F.col("_times"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (turn % F.col("_times")) * F.col("_len")).cast("long").alias("offset"),
    )
