"""Phrase collocations by top-order marginalisation.

Every word starts one window of the ``LONGEST`` words from it on, padded where its piece of text ends. Only these longest
windows are counted; one Spark ROLLUP over the window columns then sums them to every shorter prefix, so that the counts
of all phrases of 1 to ``LONGEST`` words, and of all words of a language, come out of one aggregation.

A phrase that is frequent has frequent words, pairs and triples only (its parts occur wherever it does). Windows are
therefore padded from the first word, pair or triple that occurs fewer than ``least`` times in its language: what they
lose is in no candidate and in no part of one. Counts for this are taken on hashes (words and pairs, then triples of
frequent pairs); the frequent hashes are kept as bit tables of fixed size. Equal hashes and shared bits can only keep more.

A candidate is cut in two at each place; l and r count the parts, and the score is floor(1000 * a * n / (l * r)), in
decimals of 38 digits. The lowest cut counts. A candidate inside a longer one that is as frequent is dropped.

Defined results: a null text is an empty text, a null lang is ``und``; doc_id and extra columns are ignored, so repeated
rows count as often as they occur; an empty table gives an empty result; ties go by count, then by the UTF-8 order of the
phrase; texts without separators are one piece, in time and memory in proportion to their length.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.common import BASE_A, BASE_B, BitTable, WordHash, bit_table, materialize, mix, pick

LONGEST = 5
LEAST = 100
SCALE = 1000
SHARE = 100  # per cent of its count that a longer candidate needs to drop one inside it
TOP = 2000
BITS = 26  # binary logarithm of the bits of a level's table
SALTS = 64
_WINDOW = [f"w{k}" for k in range(1, LONGEST + 1)]
_LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
#: What separates pieces; everything else that is not a space or a tab is part of a word.
_PIECES = re.compile(rb"[.,;:!?\n\x0b\x0c\r]")
SLICE = 1 << 23  # bytes of text that are tokenised at a time, whole texts only


class _Words:
    """The words of some texts in a row: codes into ``names``, and where pieces end."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        words, ends, counts = [], [], []
        for text in texts:
            before = len(words)
            for piece in _PIECES.split(text.translate(_LOWER)):
                found = piece.split()  # pieces hold no other white space than spaces and tabs
                if found:
                    words += found
                    ends.append(len(words))
            counts.append(len(words) - before)
        coded = pa.array(words, pa.binary()).dictionary_encode()
        self.names, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.langs = pa.array(langs, pa.string()).dictionary_encode()
        self.lang = np.repeat(self.langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts)
        self.last = np.zeros(len(words), bool)  # the last word of its piece
        self.last[np.array(ends, np.int64) - 1] = True


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[_Words]:
    """(lang, text) batches as words of some whole texts at a time."""
    for batch in batches:
        langs, texts, size = [], [], 0
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            data = text.as_py() or b""
            langs.append(lang)
            texts.append(data)
            size += len(data)
            if size >= SLICE:
                yield _Words(langs, texts)
                langs, texts, size = [], [], 0
        if texts:
            yield _Words(langs, texts)


class _Keys:
    """64-bit keys of the words, pairs and triples of a language; those of a pair or triple count where its piece goes on."""

    def __init__(self):
        self.word, self.lang = WordHash(), WordHash(1)

    def of(self, x: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        with np.errstate(over="ignore"):
            langs = self.lang.array([v.encode() for v in x.langs.dictionary.to_pylist()])
            words = self.word.array(x.names.to_pylist())
            if not len(words):
                return (np.empty(0, np.uint64),) * 3
            one = mix(words[x.codes] + langs[x.lang] * BASE_A)
            two = mix(one * BASE_B + _after(one, 1))
            return one, two, mix(two * BASE_B + _after(one, 2))


def _after(values: np.ndarray, k: int) -> np.ndarray:
    """The value ``k`` places on; 0 past the end."""
    out = np.zeros_like(values)
    out[: max(len(values) - k, 0)] = values[k:]
    return out


def _frequent(x: _Words, keys: tuple, tables: list[np.ndarray]) -> list[np.ndarray]:
    """Where a word, a pair and a triple starts that is frequent, as far as there are ``tables``."""
    word = BitTable.has(tables[0], keys[0])
    pair = BitTable.has(tables[0], keys[1]) & ~x.last & word & _after(word, 1)
    inside = pair & _after(pair, 1)
    return [word, pair, inside & BitTable.has(tables[1], keys[2]) if len(tables) > 1 else inside]


def _level(texts: DataFrame, tables: list, least: int, bits: int) -> np.ndarray:
    """The next bit table: words and pairs that occur ``least`` times and more, then triples of frequent pairs that do.

    Words and pairs are counted in each slice first; triples hardly repeat there, so Spark alone combines them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, known = _Keys(), [t.value for t in tables]
        for x in _slices(batches):
            one, two, three = keys = made.of(x)
            if tables:
                found = three[_frequent(x, keys, known)[2]]
                n = np.ones(len(found), np.int64)
            else:
                found, n = np.unique(np.concatenate([one, two[~x.last]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], ["key", "n"])

    counted = texts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return bit_table(counted.filter(F.col("n") >= least).select("key"), bits)


def windows(texts: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, w1 .. w5, n): padded longest windows of (lang, text), the short ones counted in each slice; pads are empty.

    A word below ``least`` is a window of pads only, which counts for nothing but the words of its language.
    """
    spark, tables = texts.sparkSession, []
    for _ in range(2):
        tables.append(spark.sparkContext.broadcast(_level(texts, tables, least, bits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, known = _Keys(), [t.value for t in tables]
        for x in _slices(batches):
            if not len(x.codes):
                continue
            word, pair, triple = _frequent(x, made.of(x), known)
            words = pa.concat_arrays([x.names.cast(pa.string()), pa.array([""])])
            pad, size = len(x.names), len(words)
            first, second = np.where(word, x.codes, pad), np.where(pair, _after(x.codes, 1), pad)
            short, n = np.unique(((x.lang * size + first) * size + second)[~triple], return_counts=True)
            yield batch(x, words, short // (size * size), [short // size % size, short % size, *[np.full(len(short), pad)] * (LONGEST - 2)], n)
            at = np.flatnonzero(triple)
            columns, alive = [x.codes[at], x.codes[at + 1]], np.ones(len(at), bool)
            for k in range(2, LONGEST):
                alive = alive & _after(triple, k - 2)[at]
                columns.append(np.where(alive, _after(x.codes, k)[at], pad))
            yield batch(x, words, x.lang[at], columns, np.ones(len(at), np.int64))

    def batch(x: _Words, words: pa.Array, lang: np.ndarray, columns: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        taken = [x.langs.dictionary.take(pa.array(lang)), *(words.take(pa.array(c)) for c in columns), pa.array(n)]
        return pa.RecordBatch.from_arrays(taken, ["lang", *_WINDOW, "n"])

    return texts.mapInArrow(run, "lang string, " + ", ".join(f"{c} string" for c in _WINDOW) + ", n long")


def counts(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, k, phrase, f): phrases of k words that occur ``least`` times and more; k = 0 has the words of the language."""
    texts = pick(docs, ["lang", "text"]).select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    summed = windows(texts, least, bits).rollup("lang", *_WINDOW).agg(F.sum("n").alias("f"))
    # A column that the rollup has summed over is null; a prefix that ends in a pad is no phrase.
    k = sum(F.when(F.col(c).isNull(), 0).otherwise(1) for c in _WINDOW)
    padded = F.greatest(*[F.when(F.col(c) == "", True).otherwise(False) for c in _WINDOW])
    found = summed.filter(F.col("lang").isNotNull() & ~padded).select("lang", k.alias("k"), F.concat_ws(" ", *_WINDOW).alias("phrase"), "f")
    return materialize(found.filter((F.col("k") == 0) | (F.col("f") >= least)), "phrase-counts")


def scored(found: DataFrame, scale: int = SCALE) -> DataFrame:
    """(lang, k, phrase, a, l, r, n, score) of every phrase of two words and more, by its lowest cut."""
    words = F.split("phrase", " ", -1)
    cuts = found.filter("k > 1").select("lang", "k", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "k", "phrase", "a", "cut", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("cut"))).alias("first"), F.concat_ws(" ", F.slice("w", F.col("cut") + 1, F.col("k") - F.col("cut"))).alias("rest"))
    part = found.filter("k > 0")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(part.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # One row a language, salted so that a language with most phrases isn't one key.
    total = found.filter("k = 0").select("lang", F.col("f").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cuts = cuts.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int")).join(total, ["lang", "salt"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("top", (F.lit(scale).cast("decimal(6,0)") * (whole("a") * whole("n")).cast("decimal(32,0)")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("bottom", (whole("l") * whole("r")).cast("decimal(38,0)")).withColumn("score", F.expr("top div bottom"))
    best = cuts.groupBy("lang", "k", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    return best.select("lang", "k", "phrase", "a", F.col("low.l").alias("l"), F.col("low.r").alias("r"), "n", F.col("low.score").alias("score"))


def maximal(candidates: DataFrame, share: int = SHARE) -> DataFrame:
    """The candidates that lie in no longer candidate with ``share`` per cent of their count."""
    words = F.split("phrase", " ", -1)
    places = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda size: F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda at: F.struct(at.alias("at"), size.alias("size"))))))
    inside = candidates.filter("k > 2").select("lang", F.col("a").alias("f"), words.alias("w"), places.alias("p")).select("lang", F.concat_ws(" ", F.slice("w", F.col("p.at"), F.col("p.size"))).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    held = candidates.join(inside, ["lang", "phrase"], "left")
    return held.filter(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))).drop("longer")


def first_of_each(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` of each language with their ``rank``: first of each of ``SALTS`` parts, then of what is left."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language."""
    candidates = materialize(scored(counts(docs, least, bits)), "phrase-scores")
    return first_of_each(maximal(candidates), top)
