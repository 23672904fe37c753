"""Benchmark decontamination by CGK embedding and bit-sampling LSH over item-sized windows.

Words are compared without ASCII punctuation and ASCII case. An item of n words contaminates a document if some window
of n words of it (the whole document, if that is shorter) is within an edit distance of ``floor(0.2 n)`` words, a
similarity of 0.8. For each text:

1. A lossless count bound finds the window starts worth embedding: a window within t edits of the item shares at least
   ``n - q + 1 - q t`` of its word q-grams, so starts with fewer shared q-grams can't match.
2. The CGK random walk embeds the window and the item into strings of the same length, where few edits become few
   Hamming differences: a shared random bit for each step and word says whether the walk moves on. Windows of one size
   are embedded together, once for each of ``WALKS`` walks.
3. Bit sampling: each walk has as many keys of ``BITS`` sampled positions as the target recall asks for, at the agreement
   expected at the edit bound; a window that agrees with the item in all positions of one key is a candidate.
4. Candidates are verified by their exact edit distance, bit-parallel.

The benchmark goes to the tasks in blocks of at most ``BLOCK_ITEMS`` items, one pass over the documents for each block,
so nothing that grows with the data is broadcast. There is no shuffle: a text is decided where it is read.

Defined results: a null or empty text or item matches nothing; rows repeated under one id match each on their own; an
empty table of either kind gives no match; extra columns are ignored by ``matches`` and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import BASE_A, WordHash, mix, pick, window_hash

EDITS = 0.2
WALKS = 3
BITS = 2
AGREE = 0.45  # share of equal positions that the embedding leaves at the edit bound
RECALL = 0.999
BLOCK_ITEMS = 20_000
SLICE = 2_048  # windows embedded at a time
_TABLE = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER, _PUNCTUATION).split()


def keys_for(recall: float = RECALL, agree: float = AGREE, bits: int = BITS) -> int:
    """Keys needed so that a pair that agrees in a share ``agree`` of the positions meets with probability ``recall``."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def walk(strings: np.ndarray, seed: int, steps: int) -> np.ndarray:
    """CGK embeddings of the rows of ``strings`` (word hashes, all of one length), ``steps`` symbols each."""
    n = strings.shape[1]
    padded = np.concatenate([strings, np.zeros((len(strings), 1), np.uint64)], axis=1)
    rows, at = np.arange(len(strings)), np.zeros(len(strings), np.int64)
    out = np.empty((len(strings), steps), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(steps):
            symbol = padded[rows, at]
            out[:, j] = symbol
            bit = mix(symbol + np.uint64((seed * 1_000_003 + j + 1) & 0xFFFFFFFF) * _STEP) >> np.uint64(63)
            at = np.minimum(at + bit.astype(np.int64), n)
    return out


def sampled(n: int, seed: int, keys: int, bits: int = BITS) -> np.ndarray:
    """Positions of the keys: a fixed pseudo-random choice among the first 2 n, after which most walks have ended."""
    return np.random.default_rng([n, seed]).integers(0, max(1, 2 * n), (keys, bits))


def edit_distance(a: list[int], b: list[int]) -> int:
    """Levenshtein distance of two sequences, one integer operation chain for each element of ``b`` (Myers, 1999)."""
    if not a:
        return len(b)
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for x in b:
        eq = where.get(x, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        up, down = mh | (full & ~(xv | ph)), ph & xv
    return score


@dataclass
class Item:
    item_id: int
    words: np.ndarray
    edits: int
    q: int
    least: int  # q-grams that a window within the bound shares at least


class Benchmark:
    """A block of items with its q-gram index."""

    def __init__(self, rows: list[tuple[int, bytes]], edits: float = EDITS, recall: float = RECALL):
        known = WordHash(3)
        self.items: list[Item] = []
        for item_id, text in rows:
            h = known.array(words_of(text or b""))
            n = len(h)
            if n:
                t = math.floor(edits * n)
                q = next((q for q in (3, 2) if n - q + 1 - q * t >= 1), 1)
                self.items.append(Item(item_id, h, t, q, max(1, n - q + 1 - q * t)))
        self.keys = keys_for(recall) if self.items else 0
        self.grams = {}
        for q in {x.q for x in self.items}:
            held = [(g, k) for k, x in enumerate(self.items) if x.q == q for g in set(window_hash(x.words, q, BASE_A).tolist())]
            held.sort()
            grams = np.array([g for g, _ in held], np.uint64)
            hint = np.zeros(_TABLE, bool)
            hint[(grams % np.uint64(_TABLE)).astype(np.int64)] = True
            self.grams[q] = grams, np.array([k for _, k in held]), hint
        self.sketches: dict[tuple[int, int], np.ndarray] = {}

    def sketch(self, k: int, seed: int) -> np.ndarray:
        if (k, seed) not in self.sketches:
            n = len(self.items[k].words)
            at = sampled(n, seed, self.keys)
            self.sketches[k, seed] = walk(self.items[k].words[None, :], seed, int(at.max()) + 1)[0][at]
        return self.sketches[k, seed]

    def starts(self, h: np.ndarray) -> dict[int, np.ndarray]:
        """item -> the window starts that reach the count bound."""
        hits = defaultdict(list)
        for q, (grams, owner, hint) in self.grams.items():
            g = window_hash(h, q, BASE_A)
            at = np.flatnonzero(hint[(g % np.uint64(_TABLE)).astype(np.int64)])
            lo, hi = np.searchsorted(grams, g[at], "left"), np.searchsorted(grams, g[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                for k in owner[a:b].tolist():
                    hits[k].append(p)
        out = {}
        for k, places in hits.items():
            item = self.items[k]
            if len(places) < item.least:
                continue
            n, p = len(item.words), np.array(places)
            first, last = p[: len(p) - item.least + 1], p[item.least - 1 :]
            near = last - first <= n - item.q
            end = max(0, len(h) - n)
            edge = np.zeros(end + 2, np.int64)
            np.add.at(edge, np.clip(last[near] + item.q - n, 0, end), 1)
            np.add.at(edge, np.clip(first[near], 0, end) + 1, -1)
            found = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
            if len(found):
                out[k] = found
        return out

    def _verify(self, n: int, group: list[tuple[int, int, np.ndarray, np.ndarray]], best: dict) -> None:
        """Embed the windows of ``n`` words of ``group`` (text, item, hashes, starts) and verify those that meet their item."""
        windows = np.concatenate([h[at[:, None] + np.arange(n)] for _, _, h, at in group])
        owner = np.repeat(np.arange(len(group)), [len(at) for *_, at in group])
        begins = np.concatenate([at for *_, at in group])
        met = np.zeros(len(windows), bool)
        lengths = np.array([len(self.items[k].words) for _, k, *_ in group])
        for size in set(lengths.tolist()):
            rows = np.flatnonzero(lengths[owner] == size)
            for seed in range(WALKS):
                at = sampled(size, seed, self.keys)
                own = walk(windows[rows], seed, int(at.max()) + 1)[:, at]
                theirs = np.stack([self.sketch(k, seed) for _, k, *_ in group])
                met[rows] |= (own == theirs[owner[rows]]).all(axis=2).any(axis=1)
        for r in np.flatnonzero(met).tolist():
            i, k, *_ = group[owner[r]]
            item = self.items[k]
            had = best.get((i, k), (item.edits + 1, 0, 0))
            if had[0] == 0:
                continue  # an exact copy, and starts only grow within a text and item
            exact = n == len(item.words) and bool((windows[r] == item.words).all())
            d = 0 if exact else edit_distance(item.words.tolist(), windows[r].tolist())
            if d <= item.edits and (d, begins[r]) < had[:2]:
                best[i, k] = d, int(begins[r]), n

    def find(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item_id, start, words, edits): the closest window of each item that contaminates a text."""
        known = WordHash(3)
        jobs = defaultdict(list)  # windows by size
        for i, text in enumerate(texts):
            h = known.array(words_of(text))
            if len(h):
                for k, at in self.starts(h).items():
                    n = min(len(self.items[k].words), len(h))
                    if len(self.items[k].words) - n <= self.items[k].edits:
                        jobs[n].append((i, k, h, at))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        pending: list[tuple[int, int, np.ndarray, np.ndarray]] = []  # at most twice ``SLICE`` windows are embedded at a time
        for n, group in jobs.items():
            held = 0
            for i, k, h, at in ((i, k, h, at[lo : lo + SLICE]) for i, k, h, at in group for lo in range(0, len(at), SLICE)):
                pending.append((i, k, h, at))
                held += len(at)
                if held >= SLICE:
                    self._verify(n, pending, best)
                    pending, held = [], 0
            if pending:
                self._verify(n, pending, best)
                pending = []
        for (i, k), (d, start, n) in sorted(best.items()):
            yield i, self.items[k].item_id, start, n, d


def _blocks(benchmark: DataFrame, edits: float, recall: float) -> Iterator[Benchmark]:
    items = pick(benchmark, ["item_id", "text"])
    count = max(1, math.ceil(items.count() / BLOCK_ITEMS))
    for b in range(count):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == b) if count > 1 else items
        yield Benchmark([(r["item_id"], (r["text"] or "").encode()) for r in part.orderBy("item_id").collect()], edits, recall)


def matches(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """(doc_id, item_id, start, n_words, edits): the closest window of each document for each item that contaminates it."""
    out = None
    for block in _blocks(benchmark, edits, recall):
        known = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], *rest) for i, *rest in known.value.find([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "start", "n_words", "edits"])

        found = pick(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, item_id long, start int, n_words int, edits int")
        out = found if out is None else out.union(found)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns as they are."""
    at = docs.columns.index("text")
    for block in _blocks(benchmark, edits, recall):
        known = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], known=known) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, *_ in known.value.find([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()]):
                    keep[i] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
