"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

Rules name a host and a path prefix; a rule fits its host and all subdomains, the longest fitting rule decides. URLs
without a rule are judged by gradient-boosted trees on length, depth, digit ratio, entropy, parameter counts, host shape
and suffix statistics, trained from labelled URLs. Suffix statistics (rate and number of positive labels by the host's
last label) are counted over all labelled rows. Only the fit of the trees uses a sample: at most ``TRAIN_ROWS`` distinct
labelled URLs, up to half of them of each label, those of the smallest hash, so copies of one URL count once and a rare
label isn't lost. The rate that a training row sees is that of the other ``FOLDS`` - 1 folds of URLs, never its own label.
Every URL is judged.

``seed_labels`` gives labels where none are at hand: URLs whose host holds a word of ``SEED_WORDS`` are positive, the
others negative. The words themselves are not features, so what is learned is the shape of such addresses.

Defined results: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the trees as
the empty string; without any positive or any negative label everything not blocked by a rule is allowed; repeated rows
are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import materialize, pick

TRAIN_ROWS = 20_000
FOLDS = 5
TREES = 20
DEPTH = 4
SEED = 42

#: (verdict, host, path): fixed values of the contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Words of hosts that stand for spam, gambling, adult and tracking addresses in the seed labels.
SEED_WORDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "farm", "free", "pills", "porn", "spam", "track", "win", "xxx")
FEATURES = ("length", "depth", "digits", "entropy", "parameters", "host_length", "host_labels", "longest_label", "hyphens", "path_length", "extension")
_HOST = re.compile(r"://([^/?#]*)([^?#]*)(?:\?([^#]*))?", re.S)
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. ``rules`` is a short list; it becomes one expression."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def lexical(url: str) -> tuple[float, ...]:
    """The features of one URL, in the order of ``FEATURES``."""
    m = _HOST.search(url)
    host, path, query = (m[1].lower(), m[2], m[3] or "") if m else ("", "", "")
    labels = host.split(".")
    n = len(url)
    counts = Counter(url).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0
    last = path.rsplit("/", 1)[-1]
    return (
        float(n),
        float(sum(1 for x in path.split("/") if x)),
        sum(c.isdigit() for c in url) / n if n else 0.0,
        entropy,
        float(sum(1 for x in query.split("&") if x)),
        float(len(host)),
        float(len(labels)),
        float(max(map(len, labels))),
        float(host.count("-")),
        float(len(path)),
        float("." in last),
    )


def features(urls: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, the lexical features, and ``suffix`` (the last label of the host)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [lexical(u or "") for u in batch.column("url").to_pylist()]
            columns = [pa.array(c, pa.float64()) for c in zip(*values)] if values else [pa.array([], pa.float64())] * len(FEATURES)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *columns], [*keep, *FEATURES])

    fields = ", ".join(f"{k} {urls.schema[k].dataType.simpleString()}" for k in keep)
    made = pick(urls, list(dict.fromkeys([*keep, "url"]))).mapInArrow(run, f"{fields}, " + ", ".join(f"{n} double" for n in FEATURES))
    return made.withColumn("suffix", F.substring_index(host_of(F.col("url")), ".", -1)) if "url" in keep else made


def seed_labels(urls: DataFrame) -> DataFrame:
    """(url, label): positive where a word of the host is one of ``SEED_WORDS``."""
    words = F.split(host_of(F.col("url")), r"[^a-z0-9]+")
    return urls.select("url", F.arrays_overlap(words, F.array(*[F.lit(w) for w in SEED_WORDS])).cast("double").alias("label"))


def _fold(url: Column) -> Column:
    return F.pmod(F.xxhash64("url", F.lit(7)), F.lit(FOLDS))


def suffix_counts(labelled: DataFrame) -> DataFrame:
    """(suffix, fold, ones, rows) over all labelled rows."""
    held = labelled.select(F.substring_index(host_of(F.col("url")), ".", -1).alias("suffix"), _fold(F.col("url")).alias("fold"), "label")
    return held.groupBy("suffix", "fold").agg(F.sum("label").alias("ones"), F.count("*").alias("rows"))


def _rate(ones: Column, rows: Column) -> Column:
    """The rate of positives with one row of the average added; no row gives the average."""
    return (ones + F.col("base")) / (rows + 1)


@dataclass
class Judge:
    """Fitted trees and the suffix statistics (suffix, suffix_rate, suffix_count) of all labelled rows."""

    model: GBTClassificationModel | None
    suffixes: DataFrame
    base: float

    def judge(self, made: DataFrame) -> DataFrame:
        """``made`` (from ``features``) with ``blocked``. Suffixes are joined by key: few of them are broadcast, many are shuffled."""
        if self.model is None:
            return made.withColumn("blocked", F.lit(False))
        known = made.join(self.suffixes, "suffix", "left")
        known = known.withColumns({"suffix_rate": F.coalesce("suffix_rate", F.lit(self.base)), "suffix_count": F.coalesce("suffix_count", F.lit(0.0))})
        return self.model.transform(_vectors(known)).withColumn("blocked", F.col("prediction") == 1.0)


def _vectors(made: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*FEATURES, "suffix_rate", "suffix_count"], outputCol="vector").transform(made)


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Judge:
    """Trees from labelled URLs (url, label 0 or 1), fitted on at most ``rows`` distinct ones; statistics over all."""
    labelled = pick(labelled, ["url", "label"]).filter("url IS NOT NULL AND label IS NOT NULL").select("url", F.col("label").cast("double").alias("label"))
    counts = materialize(suffix_counts(labelled), "suffix-counts")
    total = counts.agg(F.coalesce(F.sum("ones"), F.lit(0.0)).alias("ones"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).first()
    base = total["ones"] / total["rows"] if total["rows"] else 0.0
    whole = counts.groupBy("suffix").agg(F.sum("ones").alias("all_ones"), F.sum("rows").alias("all_rows")).withColumn("base", F.lit(base))
    statistics = whole.select("suffix", _rate(F.col("all_ones"), F.col("all_rows")).alias("suffix_rate"), F.log1p("all_rows").alias("suffix_count"))
    judge = Judge(None, materialize(statistics, "suffix-statistics"), base)
    distinct = labelled.distinct()
    parts = [distinct.filter(F.col("label") == y).orderBy(F.xxhash64("url"), "url").limit(rows // 2) for y in (0.0, 1.0)]
    made = features(materialize(parts[0].union(parts[1]), "url-sample"), ["url", "label"]).withColumn("fold", _fold(F.col("url")))
    made = made.join(whole, "suffix").join(counts, ["suffix", "fold"])
    others = F.col("all_rows") - F.col("rows")
    made = made.withColumns({"suffix_rate": _rate(F.col("all_ones") - F.col("ones"), others), "suffix_count": F.log1p(others)})
    made = materialize(made.select("label", *FEATURES, "suffix_rate", "suffix_count"), "url-features")
    if made.select("label").distinct().count() < 2:
        return judge
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1)
    judge.model = trees.fit(_vectors(made).select("vector", "label").coalesce(4))
    return judge


def decide(pages: DataFrame, judge: Judge, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict)."""
    made = judge.judge(features(pages, ["page_id", "url"]))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    found = made.select("page_id", host.alias("host"), path.alias("path"), "blocked")
    return found.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
