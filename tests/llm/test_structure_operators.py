"""Periodic runs, the conversation trie and De Bruijn deduplication against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from covertile.llm import debruijn, periodic, trie

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, n_words long, runs string, k string, kept string"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def runs_of(w):
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        x = 0
        while x < n - q:
            y = x
            while y < n - q and w[y] == w[y + q]:
                y += 1
            size = y - x + q
            if y > x and size >= max(24, 3 * q) and not any(all(w[x + i] == w[x + i + r] for i in range(size - r)) for r in range(1, q)):
                out.append((x, size, q))
            x = max(y, x + 1)
    return sorted(out, key=lambda t: (t[0], t[2]))


def repetitive(rng, depth):
    base = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.choice([1, 2, 3, 5, 9]))] if depth == 0 or rng.random() < 0.5 else repetitive(rng, depth - 1)
    out = base * rng.randint(1, 9)
    if rng.random() < 0.4:
        out = out[: rng.randint(1, len(out))]
    if rng.random() < 0.3:
        out[rng.randrange(len(out))] = "z"
    return out[:400]


def digests(doc_id, w):
    found = runs_of(w)
    gone = {x for s, size, q in found for x in range(s + q, s + size)}
    top = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    return (doc_id, len(found), *top, 1000 * top[1] // top[2] if found else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


@pytest.fixture(scope="module")
def periodic_texts():
    rng = random.Random(3)
    texts = [None, "", " \t\n", "x", "é x\x0by\x0cz", " ".join(["a"] * 23), " ".join(["a"] * 24), "\t".join(["b", "a"] * 12), " ".join(["a"] * 3000), "A a " * 40]
    for _ in range(120):
        texts.append(" ".join(x for _ in range(rng.randint(0, 5)) for x in repetitive(rng, rng.randint(0, 3)))[:1500])
    texts.append(" ".join((["a"] * 30 + ["b"]) * 9))  # runs within runs
    # two runs with equal exponents
    texts.append(" ".join(list("abcd") * 8 + ["x"] + list("efgh") * 8))
    return texts


def test_runs_equal_brute_force(spark, periodic_texts):
    rows = [(i, t, 1, "r", "k", "x") for i, t in enumerate(periodic_texts)]
    rows += [rows[12], (None, periodic_texts[13], None, None, None, None)]
    got = periodic.report(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    want = [digests(r[0], re.findall(WORD, r[1] or "")) for r in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 100
    assert periodic.report(spark.createDataFrame([], SCHEMA)).count() == 0


def test_found_runs_keep_other_columns(spark, periodic_texts):
    rows = [(i, t, 1, "r", "k", "x") for i, t in enumerate(periodic_texts[:12])]
    got = {r.doc_id: r for r in periodic.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[6].kept == "x" and got[6].n_words == 24 and [tuple(r) for r in got[6].runs] == [(0, 24, 1)] and got[6].collapsed == "a"
    assert got[7].runs[0].period == 2 and got[7].collapsed == "b a" and not got[5].runs


def test_wavelet_successor():
    rng = np.random.default_rng(4)
    for n in (1, 2, 63, 64, 65, 300):
        values = rng.permutation(n)
        tree = periodic.Wavelet(values)
        lo = rng.integers(0, n, 200)
        hi = np.minimum(n, lo + rng.integers(0, n + 1, 200))
        x, upto = rng.integers(0, n + 2, 200), rng.integers(0, n + 2, 200)
        want = [min((v for v in values[a:b].tolist() if c <= v <= d), default=-1) for a, b, c, d in zip(lo, hi, x, upto, strict=True)]
        assert tree.successor(lo, hi, x, upto).tolist() == want


def test_planted_texts(spark):
    rows = [(i, " ".join(f"w{j}" for j in range(i % 57))) for i in range(300)] + [(None, "a b")]
    for r in periodic.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        w = [f"w{j}" for j in range((r.doc_id or 0) % 57)] if r.doc_id is not None else ["a", "b"]
        h = zlib.crc32(str(r.doc_id).encode()) if r.doc_id is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
        assert re.findall(WORD, r.text) == w


def trie_of(convs):
    members, kids, out = defaultdict(list), defaultdict(set), []
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
            if d:
                kids[tuple(s[: d - 1])].add(tuple(s[:d]))
    below = {}
    for k in sorted(members, key=len, reverse=True):
        words = len(re.findall(WORD, k[-1][1])) if k else 0
        below[k] = (sum(below[x][0] for x in kids[k]) or 1, sum(below[x][1] for x in kids[k]) + (len(members[k]) - 1) * words)
        ends = ",".join(str(c) for c in sorted(c for c in members[k] if len(convs[c]) == len(k)))
        out.append((min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), *below[k], sha(ends)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    rows = []
    for c in range(-20, 120):
        for t in range(rng.randint(0, 7)):
            rows.append((c, None if rng.random() < 0.05 else t, rng.choice(["user", None, "assistant"]), rng.choice(["hi there", "a b c", None, "xxx"]) if rng.random() < 0.8 else "same", "x"))
    rows += [(c, t, "user", f"same {t}", "x") for c in range(200, 240) for t in range(12)] + [(c, 0, "user", "same 0", "x") for c in range(240, 243)]
    rows += [(None, 1, "u", "x", "x"), (5, 3, "user", "again", "x"), (5, 3, "user", "again", "x")]
    rows += [(300, t, "u", f"w {t}", "x") for t in range(1500)]  # one long conversation
    convs = defaultdict(list)
    for c, t, role, text, _ in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, role or "", text or ""))
    return rows, {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}


@pytest.mark.parametrize("most", [4096, 20, 2])
def test_trie_equals_brute_force(spark, talk, most):
    df = spark.createDataFrame(talk[0], "conv_id long, turn long, role string, text string, n_convs string").repartition(3)
    assert sorted(map(tuple, trie.nodes(df, most=most).collect()), key=str) == trie_of(talk[1])


def test_trie_of_rebuilt_conversations(spark, talk):
    df = spark.createDataFrame(talk[0], "conv_id long, turn long, role string, text string, n_convs string")
    convs = {}
    for c, own in talk[1].items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = talk[1].get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    rows, ids = trie.rebuilt(df)
    assert sorted(map(tuple, trie.nodes(rows, ids, most=16).collect()), key=str) == trie_of(convs)
    assert any(not s for s in convs.values())
    assert trie.nodes(df.limit(0)).count() == 0


def window_dedup(rows):
    texts = [re.findall(WORD, r[1] or "") for r in rows]
    count = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = {x for i in range(len(w) - 34) if count[tuple(w[i : i + 35])] > 1 for x in range(i, i + 35)}
        out.append((r[0], len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return sorted(out, key=str)


@pytest.mark.parametrize(("seed", "limits"), [(1, {}), (2, {"group": 3}), (3, {"group": 0, "most": 50}), (4, {"most": 90})])
def test_debruijn_equals_brute_force(spark, seed, limits):
    rng = random.Random(seed)
    make = lambda n, v=tuple(f"w{i}" for i in range(300)): [rng.choice(v) for _ in range(n)]
    passages, base, cycle = [make(rng.randint(30, 90)) for _ in range(8)], make(200), make(120)
    texts = [None, "", " ", "a b", " ".join(base), " ".join(base), "\n".join(base), " ".join(base[:34]), " ".join(base[:35])]
    for _ in range(15):
        b = list(base)
        b[rng.randrange(200)] = "edit"
        if rng.random() < 0.5:
            b.insert(rng.randrange(200), "ins")
        texts.append(" ".join(b))
    for _ in range(25):
        t = make(rng.randint(0, 60))
        for _ in range(rng.randint(1, 4)):
            t += rng.choice(passages)[rng.randint(0, 10) :] + make(rng.randint(0, 5))
        texts.append(" ".join(t))
    texts += [" ".join(["a"] * rng.randint(30, 200)) for _ in range(3)] + [" ".join(["a", "b", "c"] * 60), " ".join(passages[0][:40] * 5), " ".join(make(800, "xy")), " ".join(make(50) + ["q"] * 80 + make(50))]
    texts += [" ".join(make(3000) + passages[1] + make(100) + passages[1]), " ".join(cycle * 3), " ".join(cycle * 2 + make(4))]
    rows = [(i, t, 1, "r", "k", "x") for i, t in enumerate(texts)]
    rows += [rows[30], (None, texts[31], None, None, None, None)]
    got = debruijn.report(spark.createDataFrame(rows, SCHEMA).repartition(3), **limits).collect()
    assert sorted(map(tuple, got), key=str) == window_dedup(rows)


def test_paths_join_pieces_and_cut_cycles(spark):
    # 1 -> 2 -> 3 (2 edges each), and a cycle 10 -> 11 -> 12 -> 10
    links = [(1, None, 2), (2, 1, 2), (3, 2, 2), (10, 12, 1), (11, 10, 1), (12, 11, 1), (20, None, 5)]
    got = {r.p: (r.path, r.base) for r in debruijn.paths(spark.createDataFrame(links, "p long, up long, n long")).collect()}
    assert got == {1: (1, 0), 2: (1, 2), 3: (1, 4), 10: (10, 0), 11: (10, 1), 12: (10, 2), 20: (20, 0)}


def test_debruijn_of_nothing(spark):
    assert debruijn.report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert debruijn.report(spark.createDataFrame([(1, "one text alone " * 3, 1, "r", "k", "x")], SCHEMA)).collect()[0].n_removed == 0
