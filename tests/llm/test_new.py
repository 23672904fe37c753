"""Fill-in-middle, collocations and the Jaccard join against brute force, on hostile texts and empty tables."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import oracle
import pytest
from brute import words
from pyspark.sql import functions as F

from strandline.llm import collocations as C
from strandline.llm import fim, jaccard_join, minhash, queries

SCHEMA = "doc_id long, text string, lang string, size string, key int"
TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def hostile(spark):
    """Null, empty and white texts, marker texts, long texts with and without white space, odd characters, repeats."""
    rng = random.Random(3)
    vocabulary = ["ab", "ÄÖ", "x" * 300, "𝕏𝕐", "the", "of", " no break", "a\x00b", "<P", "S>"]
    made = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    texts = [None, "", " ", "\n\t  ", "one", " one", "one ", "a<P>b", "a <S> b", "<M>", "<P", "é" * 5000, "z" * 9000, " " * 3000 + "w", "\r\n".join(["line"] * 2000), *made]
    texts += ["".join(rng.choice(["word ", "  ", "日本", "\n", "é"]) for _ in range(3000)) for _ in range(20)]
    rows = [(k, t, ["en", "de", None][k % 3], "clash", 1) for k, t in enumerate(texts)]
    rows += [(7, rows[7][1], "en", "again", 2), (7, "another text", "en", "again", 2), (None, "no id here at all", "en", None, None)]
    return spark.createDataFrame(rows, SCHEMA)


# ---- fill in the middle -------------------------------------------------------------------------------


def brute_fim(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    assert "".join(tokens) == text
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        form, pre, mid, out = "plain", None, None, text
    else:
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
        form = "spm" if h4 % 100 < 80 else "psm"
        pre, mid, out = len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, pre, mid, out


@pytest.mark.parametrize("frame", [1, 5, 1000, fim.FRAME])
def test_fim_at_any_frame_size(spark, hostile, frame):
    want = sorted((brute_fim(r.doc_id, r.text) for r in hostile.collect()), key=str)
    outputs = fim.fill_in_middle(hostile, frame)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = [tuple(r) for r in fim.digests(outputs).collect()]
    texts = Counter(((r.doc_id, r.text or "") for r in hostile.collect()))
    assert sorted((r[:6] for r in got), key=str) == sorted(((*w[:5], sha(w[5])) for w in want), key=str)
    assert Counter((r[0], r[6]) for r in got) == Counter({(d, sha(t)): n for (d, t), n in texts.items()})
    made = [(r.doc_id, r.form, r.output) for r in fim.texts(outputs).collect()]
    assert sorted(made, key=str) == sorted(((w[0], w[2], w[5]) for w in want), key=str)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fim_seeks_few_frames_and_finds_markers_across_frames():
    data = ("word " * 5000).encode()
    units, points, frames = fim.encode(data, 512)
    text = fim._Text(units, points, frames)
    opened = []
    text.unpack = lambda f, real=text.unpack: opened.append(f) or real(f)
    assert text.seek(2500)[2] == len("".join(TOKEN.findall(data.decode())[:2500])) and len(opened) <= 2
    pack = fim.zstandard.ZstdCompressor().compress
    for cut in range(1, 12):  # a marker may lie across frames of an output from elsewhere
        out = b"<P>ab<S>cd<M>ef"
        pieces = [pack(out[:cut]), pack(out[cut : cut + 1]), pack(out[cut + 1 :])]
        assert b"".join(fim.restore(pieces, "psm")) == b"abefcd"


# ---- collocations -------------------------------------------------------------------------------------


def brute_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    found = {}
    for (lang, w), a in f.items():
        if len(w) > 1:
            score, cut = min((1000 * a * n[lang] // (f[lang, w[:c]] * f[lang, w[c:]]), c) for c in range(1, len(w)))
            found[lang, w] = (lang, " ".join(w), a, f[lang, w[:cut]], f[lang, w[cut:]], n[lang], score)
    gone = {(lang, w[i : i + k]) for (lang, w), x in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if x[2] >= f[lang, w[i : i + k]]}
    out = []
    for lang in n:
        kept = sorted((x for k, x in found.items() if k[0] == lang and k not in gone), key=lambda x: (-x[6], -x[2], x[1].encode()))
        out += [(x[0], i, *x[1:]) for i, x in enumerate(kept[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,bits", [(2, 2000, 26), (3, 5, 6), (40, 2000, 20)])
def test_collocations(spark, hostile, least, top, bits):
    """Also with bit tables so small that they let nearly all through."""
    rng = random.Random(1)
    line = lambda: " ".join(rng.choices(["New", "york", "the", "a", "of", "é", "tab\tword", "in"], [5, 5, 9, 9, 4, 1, 1, 3], k=rng.randrange(1, 30)))
    docs = hostile.unionByName(spark.createDataFrame([(k, rng.choice(".,;:!?\n\r\x0b\x0c ").join(line() for _ in range(9)), rng.choice(["en", "fr", None]), "", 0) for k in range(80)], SCHEMA))
    got = sorted(map(tuple, C.collocations(docs, least, top, bits).collect()))
    want = brute_collocations([(r.lang, r.text) for r in docs.collect()], least, top)
    assert want and got == want


def test_collocation_scores_are_exact(spark):
    """Products past 64 bits, and a score that a float would round up."""
    big = 10**12 + 39
    rows = [("x", 0, "", 10**13 + 7), ("x", 1, "a", big), ("x", 1, "b", big + 2), ("x", 2, "a b", 10**12 - 11), ("x", 1, "c", 3), ("x", 2, "b c", 3)]
    found = spark.createDataFrame(rows, "lang string, k int, phrase string, f long")
    got = {r.phrase: r.score for r in C.scored(found).collect()}
    assert got == {"a b": 1000 * (10**12 - 11) * (10**13 + 7) // (big * (big + 2)), "b c": 1000 * 3 * (10**13 + 7) // ((big + 2) * 3)}


def test_ties_of_phrases_go_by_bytes(spark):
    rows = [("x", k, 2, 1, 1, 1, 9, 7) for k in ("b a", "\U0001f600 a", "￮ a", "a a")]
    ranked = C.first_of_each(spark.createDataFrame(rows, "lang string, phrase string, k int, a long, l long, r long, n long, score long"), 3).orderBy("rank").collect()
    assert [r.phrase for r in ranked] == ["a a", "b a", "￮ a"]


# ---- Jaccard join -------------------------------------------------------------------------------------


def shingles(text):
    w = words(lowered(text))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), d if not s else least.get(find(i))) for i, (d, s) in enumerate(zip((d for d, _ in rows), sets))), key=str)


def near(rng, text, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"edit{rng.randrange(9999)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def related(spark, hostile):
    """Chains of near copies at and around the bound, rotations with equal sets, a passage in common, all sizes."""
    rng = random.Random(11)
    texts = []
    for n in (4, 9, 11, 20, 33, 60, 150, 400, 1200):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
        texts += [base, base.upper(), base + " tail", *(near(rng, base, e) for e in (1, 1, 2, 3, 5, 9) if e < n)]
        chain = base
        for _ in range(4):
            chain = near(rng, chain, max(1, n // 70))
            texts.append(chain)
    texts += ["a b c a b c a", "b c a b c a b", "c a b c a", "a b c a"]
    passage = " ".join(f"p{k}" for k in range(120))
    texts += [f"{passage} {' '.join(f'q{k}_{i}' for i in range(rng.choice([2, 9, 14, 40, 100])))}" for k in range(60)]
    rows = [(1000 - k, t, "en", "", 0) for k, t in enumerate(texts)] + [(None, texts[0], "en", "", 0), (None, "lonely row", "en", "", 0)]
    return hostile.unionByName(spark.createDataFrame(rows, SCHEMA))


@pytest.mark.parametrize("bucket", [32, 1])
def test_jaccard_join_against_all_pairs(spark, related, monkeypatch, bucket):
    """With a bucket of 1 every shared signature is treated as a large one."""
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    got = sorted((tuple(r) for r in jaccard_join.jaccard_components(related).collect()), key=str)
    want = brute_components([(r.doc_id, r.text) for r in related.collect()])
    assert got == want and len({w[2] for w in want}) < len(want) - 60


def test_signatures_are_shuffled_once(spark, related, monkeypatch):
    """The signatures of a text are most of what the join moves: they aren't kept per set again, and one exchange serves."""
    plans, write = {}, jaccard_join.materialize

    def spy(df, label):
        plans[label] = (df.columns, df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(jaccard_join, "materialize", spy)
    assert jaccard_join.jaccard_components(related).count() == related.count()
    assert "values" not in plans["join-nodes"][0]
    assert plans["join-buckets"][1].count("Exchange hashpartitioning") == 1 and "join-met" not in plans


@pytest.mark.parametrize("similar", [60, 80, 90, 97])
def test_signatures_lose_no_pair(similar):
    """Sets at the least allowed similarity always share a signature, in one band or across two."""
    rng, lows = np.random.default_rng(similar), jaccard_join.bands(similar)
    assert all((b - 1) * similar <= 100 * a < b * similar for a, b in zip(lows[:80], lows[1:80]))
    met = 0
    for _ in range(400):
        n = int(rng.integers(1, 300))
        most = n * (100 - similar) // 100 + 1
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        out, more = min(n, int(rng.integers(0, most + 1))), int(rng.integers(0, most + 1))
        other = np.concatenate([base[out:], rng.integers(0, 1 << 63, more).astype(np.uint64)])
        both, union = n - out, n + more
        if 100 * both >= similar * union and (out or more):
            a, b = (np.unique(jaccard_join.signatures(np.unique(x), lows, similar)) for x in (base, other))
            assert len(np.intersect1d(a, b)), (n, out, more)
            met += 1
    assert met > 20


def test_signatures_are_selective(spark, data_dir):
    """Unrelated texts share none; the signatures of a set are in proportion to its size."""
    rng, lows = np.random.default_rng(0), jaccard_join.bands()
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in rng.integers(30, 3000, 60)]
    signed = [jaccard_join.signatures(s, lows) for s in sets]
    assert all(len(g) < 0.45 * len(s) + 10 for g, s in zip(signed, sets))
    every = np.concatenate([np.unique(g) for g in signed])
    assert len(every) - len(np.unique(every)) < 5


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_collocations", "op13_jaccard_join"])
def test_against_sql(spark, data_dir, name):
    got = queries.queries()[name](spark, data_dir).toPandas()
    oracle.assert_same(got, oracle.connect(data_dir).sql(queries.oracle_sql()[name]).df())
    assert len(got) > 0


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_collocations", "op13_jaccard_join"])
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.queries()[name](spark, str(tmp_path)).count() == 0


def test_bit_table(spark):
    keys = spark.range(1000).select(F.xxhash64("id").alias("key"))
    values = np.array([r.key for r in keys.collect()], np.int64).view(np.uint64)
    from strandline.llm.common import BitTable, bit_table

    table = bit_table(keys, 16)
    others = np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64)
    assert len(table) == 1 << 10 and BitTable.has(table, values).all() and BitTable.has(table, others).mean() < 0.05
    assert not bit_table(keys.filter("false"), 16).any()
