"""Quality rules as a bitmask ledger.

Each document is measured once (``measure``); each rule is evaluated once against the measurements and leaves one bit in
``failures`` (``ledger``). Policies are versioned sets of rules, applied to the stored bits without touching the text
(``apply_policy``), and ablations are counts over the few distinct bit patterns (``ablation``).

Defined results: null, empty and blank texts measure zero and fail ``few_words``; rows repeated under one id give one
ledger row each; an empty table gives an empty ledger; extra columns of the input are ignored by ``measure`` and
``ledger`` and kept by ``keep_passing``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm.common import BASE_A, WORD_SPACE, WordHash, fresh, pick, window_hash

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
_CONTINUATION = bytes(range(0x80, 0xC0))
_UPPER = bytes(range(65, 91))
_LETTER = _UPPER + bytes(range(97, 123))
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters"]


def repeat_words(h: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text, first occurrence included."""
    w = window_hash(h, size, BASE_A)
    if len(w) < 2:
        return 0
    _, back, count = np.unique(w, return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[back] > 1)
    if not len(at):
        return 0
    edge = np.zeros(len(h) + 1, np.int32)
    edge[at] += 1
    edge[at + size] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure_text(text: bytes, known: WordHash) -> tuple[int, ...]:
    words = text.split()
    lines = text.split(b"\n")
    worded = [x for x in lines if x and not x.isspace()]
    return (
        len(words),
        len(text.translate(None, _CONTINUATION + WORD_SPACE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(worded) - len(set(worded)),
        repeat_words(known.array(words)),
        len(worded),
        len(text) - len(text.translate(None, _UPPER)),
        len(text) - len(text.translate(None, _LETTER)),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash(1)
        for batch in batches:
            rows = [measure_text(t or b"", known) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])

    return pick(docs, ["doc_id", "text"]).mapInArrow(run, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))


@dataclass(frozen=True)
class Rule:
    """A document fails when ``fails`` is true. ``bit`` never changes once published."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines"),
    Rule(4, "capitals", "n_letters >= 100 AND 100 * n_upper > 40 * n_letters"),
    Rule(5, "word_length", "n_words >= 20 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
)

#: Policy version -> rules that reject. Versions are only ever added.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "repeated_lines", "capitals", "word_length"),
}
CURRENT = 2


def policy_mask(version: int = CURRENT, without: tuple[str, ...] = ()) -> int:
    return sum(1 << r.bit for r in RULES if r.name in POLICIES[version] and r.name not in without)


def failure_bits() -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and failure bits, one row per document."""
    return measure(docs).withColumn("failures", failure_bits())


def apply_policy(entries: DataFrame, version: int = CURRENT, without: tuple[str, ...] = ()) -> DataFrame:
    """The ledger with ``kept``; no text is read."""
    return entries.withColumn("kept", F.col("failures").bitwiseAND(F.lit(policy_mask(version, without))) == 0)


def ablation(entries: DataFrame, version: int = CURRENT) -> DataFrame:
    """(rule, failed, only_this): documents each rule of the policy rejects, and those that no other rule rejects.

    Counts are taken over distinct bit patterns, of which there are at most 2^rules.
    """
    mask = policy_mask(version)
    patterns = entries.groupBy(F.col("failures").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("own")) for r in RULES if mask >> r.bit & 1])
    hit = F.col("bits").bitwiseAND(F.col("own")) != 0
    return (
        patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.*").groupBy("rule")
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("failed"), F.sum(F.when(F.col("bits") == F.col("own"), F.col("n")).otherwise(0)).alias("only_this"))
    )


def keep_passing(docs: DataFrame, version: int = CURRENT) -> DataFrame:
    """The rows of ``docs`` that pass, all columns: the ledger's measurements, bits and policy, with each row beside its entry.

    Rows go through the measuring pass as they are; nothing is shuffled.
    """
    at, (name,) = docs.columns.index("text"), fresh(docs, "ledger")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHash(1)
        for batch in batches:
            rows = [dict(zip(MEASURES, measure_text(t or b"", known))) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            entry = pa.array(rows, pa.struct([(m, pa.int64()) for m in MEASURES]))
            yield pa.RecordBatch.from_arrays([*batch.columns, entry], [*batch.schema.names, name])

    measured = docs.mapInArrow(run, schema)
    entries = measured.select(F.struct(*[measured[c] for c in docs.columns]).alias("row"), f"{name}.*").withColumn("failures", failure_bits())
    return apply_policy(entries, version).filter("kept").select("row.*")
