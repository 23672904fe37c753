"""Plain single-process versions of the contracts that the operators are held to."""

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]


def base_spans(text):
    found = [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for k, (name, p, ok) in enumerate(BASE) for m in re.finditer(p, text or "") if ok(m[0])]
    return ",".join(x[2] for x in sorted(found))


def substring_dedup(docs):
    """docs: {id: text} -> {id: (n_words, n_removed, sha)}"""
    split = {i: words(t) for i, t in docs.items()}
    first = {}
    for i in sorted(split):
        for k in range(len(split[i]) - 49):
            first.setdefault(tuple(split[i][k : k + 50]), i)
    out = {}
    for i, w in split.items():
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = True
        out[i] = len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()
    return out


def simhash(text, size=4):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, bits=4):
    """{id: fp} -> {id: smallest id reachable}"""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    arr = np.array([fps[i] for i in ids], np.uint64)
    for x, i in enumerate(ids):
        for y in np.flatnonzero(np.bitwise_count(arr[x + 1 :] ^ arr[x]) <= bits) + x + 1:
            a, b = find(i), find(ids[y])
            parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    at = {}
    for k in range(len(w) - 7):
        at.setdefault(tuple(w[k : k + 8]), []).append(k)
    covered = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    n = len(w)
    return n, sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
