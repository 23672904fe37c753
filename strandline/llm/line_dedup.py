"""Line deduplication by content-defined units of lines, with Spark functions only.

A unit is a pair of neighbouring lines that hold text (with the blank lines between them), or one line of at least
``LONG_WORDS`` words. Units overlap and depend on nothing outside themselves, so every shared run of two or more lines is
found whole wherever it stands. Units with equal bytes in different documents stay in the document with the smallest id,
then with the smallest text hash; within one document the first copy stays (and lines that a later copy shares with the
first one). Every line that a repeated unit covers goes; some copy of each line always stays.

Units are met by the two 64-bit hashes of each of their lines. Bytes are compared once a line: where two different lines
share both hashes, their units are met by their bytes. Texts are shuffled twice, once by line and once by document; the
rest is light.

Defined results: a null text stays null; an empty text is unchanged; kept lines are joined as they stood; texts under one
doc_id are documents of their own, and so are texts without a doc_id, which come after all others; rows with the same
doc_id and text count as one document and each keeps its first copies; an empty table gives an empty result; extra columns
are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh, materialize, pick

LONG_WORDS = 50  # a line of so many words is a passage of its own
_NL = "\n"
_WORD = r"[^ \t\x0B\f\r]"
_UNIT = ["a1", "a2", "b1", "b2", "gap"]


def _lines(docs: DataFrame) -> DataFrame:
    keyed = pick(docs, ["doc_id", "text"]).filter("text IS NOT NULL")
    return keyed.select("doc_id", F.xxhash64("text").alias("row"), F.split("text", _NL, -1).alias("lines"))


def _hashes(line: Column) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")


def _units(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, end, and the key: the hashes of both lines and what stands between them)."""
    none = F.lit(-1)
    held = _lines(docs).withColumn("held", F.filter(F.transform("lines", lambda x, i: F.when(F.regexp_like(x, F.lit(_WORD)), i).otherwise(none)), lambda i: i >= 0))

    def mark(i: Column) -> Column:
        x = F.get("lines", i)
        # The shortest line of so many words: one character a word, one between two.
        long = (F.length(x) >= 2 * LONG_WORDS - 1) & (F.regexp_count(x, F.lit(_WORD + "+")) >= LONG_WORDS)
        return F.struct(i.alias("at"), *_hashes(x), long.alias("long"))

    marks = held.select("doc_id", "row", "lines", "held", F.transform("held", mark).alias("marks"))

    def pair(m: Column, k: Column) -> Column:
        n = F.get("marks", k + 1)
        between = n["at"] - m["at"] - 1
        gap = F.when(between > 0, F.concat(F.lit(_NL), F.array_join(F.slice("lines", m["at"] + 2, between), _NL))).when(between == 0, F.lit(""))
        # Two long lines are units of their own.
        return F.when(~(m["long"] & n["long"]), F.struct(m["at"].alias("at"), n["at"].alias("end"), m["h1"].alias("a1"), m["h2"].alias("a2"), n["h1"].alias("b1"), n["h2"].alias("b2"), gap.alias("gap")))

    zero = F.lit(0).cast("long")
    # What stands between two lines is white space, so the word can't be met there.
    single = lambda m: F.struct(m["at"].alias("at"), m["at"].alias("end"), m["h1"].alias("a1"), m["h2"].alias("a2"), zero.alias("b1"), zero.alias("b2"), F.lit("single").alias("gap"))
    pairs, singles = F.filter(F.transform("marks", pair), lambda u: u.isNotNull()), F.transform(F.filter("marks", lambda m: m["long"]), single)
    made = marks.select("doc_id", "row", "lines", "marks", pairs.alias("pairs"), singles.alias("singles"))
    return made.select("doc_id", "row", F.explode(F.concat("pairs", "singles")).alias("u")).select("doc_id", "row", "u.*")


def _clashes(docs: DataFrame) -> DataFrame:
    """(h1, h2) that two different lines share; as a rule none."""
    lines = _lines(docs).select(F.explode("lines").alias("line")).filter(F.regexp_like("line", F.lit(_WORD)))
    same = lines.select("line", *_hashes(F.col("line"))).groupBy("h1", "h2", "line").agg(F.lit(1).alias("one"))
    return same.groupBy("h1", "h2").agg(F.count("*").alias("texts")).filter("texts > 1").select("h1", "h2")


def _by_bytes(units: DataFrame, clashes: DataFrame, docs: DataFrame) -> DataFrame:
    """``units`` with their whole bytes in the key where a line of theirs shares its hashes with another."""
    for x in "ab":
        named = clashes.select(F.col("h1").alias(f"{x}1"), F.col("h2").alias(f"{x}2"), F.lit(True).alias(f"clash_{x}"))
        units = units.join(named.hint("merge"), [f"{x}1", f"{x}2"], "left")
    held = F.coalesce("clash_a", "clash_b", F.lit(False))
    texts = _lines(docs).dropDuplicates(["doc_id", "row"]).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "lines")
    told = units.filter(held).join(texts.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")))
    # A long line alone has no neighbour, and no pair starts and ends at one place, so the bytes tell them apart too.
    told = told.withColumn("gap", F.concat_ws(_NL, F.when(F.col("at") == F.col("end"), F.lit("single")).otherwise(F.lit("pair")), F.slice("lines", F.col("at") + 1, F.col("end") - F.col("at") + 1)))
    columns = ["doc_id", "row", "at", "end", *_UNIT]
    return units.filter(~held).select(*columns).union(told.select(*columns))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at): the lines to remove, by their place in their document; a line may be named more than once."""
    units = materialize(_units(docs), "line-units")
    clashes = materialize(_clashes(docs), "line-clashes")
    if not clashes.isEmpty():
        units = materialize(_by_bytes(units, clashes, docs), "line-units")
    # The smallest id is null where no text that holds the unit has one.
    shared = units.groupBy(*_UNIT).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    met = materialize(units.join(shared.hint("merge"), _UNIT), "met-units")
    elsewhere = met.filter("NOT doc_id <=> first").select("doc_id", "row", "at", "end")
    own = met.filter("doc_id <=> first")
    several = units.groupBy("doc_id").agg(F.min("row").alias("low"), F.max("row").alias("high")).filter("low < high")
    if not several.isEmpty():  # texts that share an id, or have none: the one with the smallest hash has the first copies
        heads = own.groupBy(*_UNIT).agg(F.min("row").alias("head"))
        own = materialize(own.join(heads.hint("merge"), _UNIT), "own-units")
        elsewhere = elsewhere.union(own.filter("row > head").select("doc_id", "row", "at", "end"))
        own = own.filter("row = head")
    # Copies inside one document: all but the first, less the lines of the first. The unit gives the id.
    lowest = own.groupBy("row", *_UNIT).agg(F.min("at").alias("low"), F.min("end").alias("low_end"), F.max("at").alias("high")).filter("high > low")
    again = own.join(lowest.hint("merge"), ["row", *_UNIT]).filter("at > low").select("doc_id", "row", F.greatest("at", F.col("low_end") + 1).alias("at"), "end")
    return elsewhere.union(again).filter("at <= end").select("doc_id", "row", F.explode(F.sequence("at", "end")).alias("at"))


def dedup_passages(docs: DataFrame, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with the lines of repeated units removed from ``text`` (and ``n_chars``, where there is one, counted anew).

    With ``drop_emptied``, documents of which no word is left go.
    """
    own = fresh(docs, "id", "row", "gone", "key", "all", "left", "new")
    id_, row, gone, key, every, left, new = own
    found = repeated_lines(docs).groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone"))
    found = materialize(found, "gone-lines").select(F.col("doc_id").alias(id_), F.col("row").alias(row), F.col("gone").alias(gone))
    # What goes grows with the corpus, so it is never broadcast: one plan at every size, and skewed parts can be split.
    joined = docs.withColumn(key, F.xxhash64("text")).join(found.hint("merge"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(row)), "left")
    cut = joined.withColumn(every, F.when(F.col(gone).isNotNull(), F.split("text", _NL, -1)))
    cut = cut.withColumn(left, F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(gone)))
    text = F.array_join(F.transform(F.col(left), lambda i: F.get(F.col(every), i)), _NL)
    # Referred to twice, so that no line's look-up splits the text anew.
    cut = cut.withColumn(new, F.when(F.col(every).isNotNull(), text).otherwise(F.col("text")))
    kept = cut.filter(F.col(gone).isNull() | F.regexp_like(new, F.lit(_WORD.replace("[^ ", "[^ \\n")))) if drop_emptied else cut
    out = {c: F.col(c) for c in docs.columns} | {"text": F.col(new)}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col(gone).isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return kept.select(*[c.alias(n) for n, c in out.items()])
