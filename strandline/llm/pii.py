"""Personal data spans, with Spark functions only: patterns propose, checksums confirm, context words adjust the score.

``split`` and ``regexp_extract_all`` scan a text with the same pattern, left to right and without overlap, so the pieces
between the matches and the matches themselves alternate; running sums of their lengths are the positions, in code
points. Running sums are folded in blocks, and context comes from the pieces, so that a text of many matches costs in
proportion to its length. Patterns use possessive repeats and look-behinds, so that each character is visited a bounded number of times
and the regular expression engine never recurses over a long run; both leave the matches as they are, because in each
pattern what follows a repeat can't start inside it.

Kinds, in order: the base kinds ``email ip card phone``, then the added kinds ``iban ssn secret``. Base spans are kept
whatever their score; an added span needs a score of ``KEEP`` or more.

Defined results: a null or empty text has no spans; rows repeated under one id give one row each; an empty table gives
an empty result; extra columns are ignored by ``find`` and kept by ``redact``; a text is never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fresh, pick

CONTEXT_CHARS = 40  # on each side, from the piece there, the match beyond it and the piece beyond that
KEEP = 0.5
_FOLD = 256  # items folded at a time: a fold copies what it has gathered at each step
_CUT = 1024  # code points of the slices that a text is rewritten from


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    needs: str  # a cheap test for texts that can hold it
    prior: float
    context: str  # nearby words that raise the score


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.8, r"mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", 0.6, r"\bip\b|host|server|address"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9]){13}", 0.6, r"card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.6, r"phone|call|tel\b|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", 0.6, r"iban|bank|account|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]-[0-9]{2}-[0-9]", 0.3, r"ssn|social|security|tax"),
    Kind("secret", r"(?i)(?<![a-z0-9_])(?:token|secret|password|passwd|api_?key)\s{0,3}[=:]\s{0,3}[\"'][^\"'\s]{8,200}[\"']", r"(?i)(?:token|secret|passw|api_?key)", 0.7, r"key|login|auth"),
)
BASE = ("email", "ip", "card", "phone")


def luhn(digits: Column) -> Column:
    """The Luhn test of a string of digits."""
    value = lambda i: F.ascii(F.substr(digits, i, F.lit(1))) - 48
    odd = lambda i: (F.length(digits) - i) % 2 == 1
    term = lambda i: F.when(odd(i), 2 * value(i) - F.when(value(i) > 4, 9).otherwise(0)).otherwise(value(i))
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda total, i: total + term(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """The ISO 7064 test: the first four characters go last, letters count 10 to 35, the number is 1 modulo 97."""
    bare = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4)))
    code = lambda i: F.ascii(F.substr(turned, i, F.lit(1)))
    step = lambda r, i: F.when(code(i) < 58, (r * 10 + code(i) - 48) % 97).otherwise((r * 100 + code(i) - 55) % 97)
    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind."""
    if kind == "ip":
        small = lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) > 3, F.lit(False)).otherwise(F.substr(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), F.lit(-3)) <= "255")
        return F.forall(F.split(match, r"\."), small)
    if kind == "card":
        return F.when(F.length(_digits(match)).between(14, 19), luhn(_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        return F.when(F.length(F.replace(match, F.lit(" "), F.lit(""))).between(15, 34), mod97(match)).otherwise(False)
    return F.lit(True)


NO_SPANS = "array<struct<start:int,end:int,kind:string,score:double>>"


def matches_of(kind: Kind, text: Column) -> Column:
    """All matches of a kind's pattern; texts that can't hold the kind are not scanned with it."""
    return F.when(F.regexp_like(text, F.lit(kind.needs)), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _before(items: Column, value, join) -> Column:
    """struct<at, seen>: ``seen`` is what ``join`` made of the values before each item, ``at`` what it made of all."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("seen"))
    return F.aggregate(items, start, lambda acc, x: F.struct(join(acc["at"], value(x)).alias("at"), F.concat(acc["seen"], F.array(acc["at"])).alias("seen")))


def _folded(items: Column, value, join) -> Column:
    """``items`` (a column, not empty) in blocks of ``_FOLD``, each folded by ``_before``."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / _FOLD).cast("int")), lambda b: F.slice(items, b * _FOLD + 1, _FOLD))
    return F.transform(blocks, lambda block: _before(block, value, join))


def _running(folded: Column, join) -> Column:
    """What stands before each item over all blocks."""
    return F.flatten(F.zip_with(folded, _before(folded, lambda w: w["at"], join)["seen"], lambda w, o: F.transform(w["seen"], lambda x: join(x, o))))


def _add(a: Column, b: Column) -> Column:
    return a + b


def spans_of(kind: Kind, matches: Column, between: Column, before: Column) -> Column:
    """array<struct<start, end, kind, score>> of the confirmed matches of one kind, in order.

    ``between`` are the pieces of the text around ``matches``, ``before`` the lengths of all that stands before each piece.
    """
    raw = F.zip_with(matches, before, lambda m, at: F.struct(m.alias("match"), at.alias("at")))
    raw = F.transform(raw, lambda x, i: F.struct((x["at"] + F.length(F.get(between, i))).alias("start"), x["match"].alias("match"), i.alias("i")))
    good = F.filter(raw, lambda x: confirmed(kind.name, x["match"]))
    piece = lambda array, i, side: F.coalesce(side(F.get(array, i), F.lit(CONTEXT_CHARS)), F.lit(""))

    def scored(x: Column) -> Column:
        i = x["i"]
        left = F.right(F.concat(piece(between, i - 1, F.right), piece(matches, i - 1, F.right), piece(between, i, F.right)), F.lit(CONTEXT_CHARS))
        right = F.left(F.concat(piece(between, i + 1, F.left), piece(matches, i + 1, F.left), piece(between, i + 2, F.left)), F.lit(CONTEXT_CHARS))
        near = F.lower(F.concat(left, F.lit(" "), right))
        score = F.lit(kind.prior) + F.when(F.regexp_like(near, F.lit(kind.context)), F.lit(0.3)).otherwise(F.lit(0.0))
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(x["match"])).alias("end"), F.lit(kind.name).alias("kind"), F.least(score, F.lit(1.0)).alias("score"))

    found = F.transform(good, scored)
    if kind.name not in BASE:
        found = F.filter(found, lambda x: x["score"] >= KEEP)
    return F.when(F.size(matches) > 0, found).otherwise(F.array().cast(NO_SPANS))


def _with_spans(docs: DataFrame, text: Column, mark: str) -> DataFrame:
    """``docs`` with one array of spans for each kind, named ``mark`` + kind. Each pattern runs once over a text.

    One projection a step: an array that a lambda looks into is a column of its own, or it would be made anew for each element.
    """
    step = lambda kind, letter: F.col(f"{mark}{letter}_{kind.name}")
    some = lambda kind: F.size(step(kind, "m")) > 0
    lengths = lambda k: F.zip_with(F.transform(step(k, "b"), lambda x: F.length(x)), F.transform(step(k, "m"), lambda x: F.length(x)), lambda gap, size: F.coalesce(gap, F.lit(0)) + F.coalesce(size, F.lit(0)))
    out = docs.withColumns({f"{mark}m_{k.name}": matches_of(k, text) for k in KINDS})
    out = out.withColumns({f"{mark}b_{k.name}": F.when(some(k), F.split(text, k.pattern, -1)) for k in KINDS})
    out = out.withColumns({f"{mark}l_{k.name}": F.when(some(k), lengths(k)) for k in KINDS})
    out = out.withColumns({f"{mark}f_{k.name}": F.when(some(k), _folded(step(k, "l"), lambda x: x, _add)) for k in KINDS})
    out = out.withColumns({f"{mark}r_{k.name}": F.when(some(k), F.slice(_running(step(k, "f"), _add), F.lit(1), F.size(step(k, "m")))) for k in KINDS})
    return out.withColumns({f"{mark}{k.name}": spans_of(k, step(k, "m"), step(k, "b"), step(k, "r")) for k in KINDS})


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, one array of spans for each kind): start and end are code points, end exclusive."""
    docs = pick(docs, ["doc_id", "text"]).select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return _with_spans(docs, F.col("_text"), "_pii_").select("doc_id", *[F.col(f"_pii_{k.name}").alias(k.name) for k in KINDS])


def joined(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of the spans of ``kinds``, by start, then kind in the order given, comma-joined."""
    def labelled(rank: int, kind: str) -> Column:
        said = lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string"))
        return F.transform(F.col(kind), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), said(x).alias("said")))

    ranked = F.flatten(F.array(*[labelled(i, k) for i, k in enumerate(kinds)]))
    return F.array_join(F.transform(F.array_sort(ranked), lambda x: x["said"]), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with its base and added spans replaced by ``[kind]``; spans that overlap go as one, named by the first of them."""
    (mark,) = fresh(docs, "_pii")
    while any(c.lower().startswith(mark.lower()) for c in docs.columns):
        mark += "_"
    every, folded, before, heads, slices = (F.col(f"{mark}{x}") for x in ("every", "folded", "before", "heads", "slices"))
    out = _with_spans(docs, F.coalesce(F.col("text"), F.lit("")), mark)
    out = out.withColumn(f"{mark}every", F.array_sort(F.flatten(F.array(*[F.col(f"{mark}{k.name}") for k in KINDS]))))
    out = out.withColumn(f"{mark}folded", F.when(F.size(every) > 0, _folded(every, lambda x: x["end"], F.greatest)))
    # The furthest end so far: a span that starts before it belongs to the one before.
    out = out.withColumn(f"{mark}before", _running(folded, F.greatest))
    held = F.zip_with(every, before, lambda x, at: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), at.alias("at")))
    out = out.withColumns({f"{mark}heads": F.filter(held, lambda x: x["start"] >= x["at"]), f"{mark}slices": F.when(F.size(every) > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CUT}}}"), F.lit(0)))})

    def part(a: Column, b: Column) -> Column:
        i, j = F.floor(a / _CUT).cast("int"), F.floor(b / _CUT).cast("int")
        one = lambda k: F.coalesce(F.get(slices, k), F.lit(""))
        several = F.concat(F.substr(one(i), a % _CUT + 1), F.array_join(F.slice(slices, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substr(one(j), F.lit(1), b % _CUT))
        return F.when(i == j, F.substr(one(i), a % _CUT + 1, b - a)).otherwise(several)

    said = F.transform(heads, lambda h: F.concat(part(h["at"], h["start"]), F.lit("["), h["kind"], F.lit("]")))
    rest = part(F.array_max(F.transform(every, lambda x: x["end"])), F.length("text"))
    return out.withColumn("text", F.when(F.size(every) > 0, F.concat(F.array_join(said, ""), rest)).otherwise(F.col("text"))).select(*docs.columns)
