"""The corpus pipeline: each stage's decisions take effect on all its predecessor kept."""

import base64
import re

import corpus_pipeline as p
import tiktoken
from pyspark.sql import functions as F

from covertile.llm import decontam, jaccard
from covertile.llm.common import saved


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for _, stage in p.STAGES:
        kept.append(saved(stage(spark, kept[-1], sf)))
    a, b, c, d, e, f = kept
    assert all(x.columns == docs.columns for x in kept[:-1])
    assert b.count() > 0.7 * a.count() and b.exceptAll(a).count() == 0
    groups = jaccard.join(b).toPandas()
    assert c.count() == groups["component_id"].nunique() == len({r.doc_id for r in c.collect()})
    hit = decontam.report(c, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("contaminated").count()
    assert d.count() == c.count() - hit
    assert e.count() == d.count() and e.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert f.count() == e.count() and "ids" in f.columns and "text" not in f.columns


def test_near_copies_share_four_fifths_of_five_words(spark, sf):
    def made(start, edits):
        w = [f"w{start + i}" for i in range(200)]
        for i in edits:
            w[i] = f"e{start + i}"
        return " ".join(w)

    # five edits far apart: 5-word Jaccard 171 / 221 (below 0.8); four: 176 / 216 (0.81) and 4-word 181 / 213 (below 0.85)
    texts = [made(0, []), made(0, [20, 60, 100, 140]), made(1000, []), made(1000, [20, 60, 100, 140, 180]), made(2000, [])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    words = [t.split(" ") for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in words]
    share = [[len(a & b) / len(a | b) for a in sets] for b in sets]
    assert 0.8 <= share[0][1] < 0.85 and 0.7 < share[2][3] < 0.8
    want = [i for i in range(len(texts)) if not any(share[i][j] >= 0.8 for j in range(i))]
    assert sorted(r.doc_id for r in p.keep_one_of_group(spark, docs, sf).collect()) == want == [0, 2, 3, 4]


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(30))
    rows = [
        (None, text("a")), (None, text("b")), (None, text("b")),  # no ids: a stays, one of the two b stays
        (None, text("c")), (5, text("c")), (4, text("c")),  # an id goes before none
        (6, text("d")), (6, text("d")), (6, text("d").upper()),  # a repeated row
        (7, text("e")), (7, text("f")), (3, text("f")),  # one id, two texts: e stays by itself, f goes to 3
        (8, text("g")), (8, text("h")),
        (None, None), (None, " "), (9, ""), (9, ""), (10, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in jaccard.representatives(docs, 5, 80).collect()]
    want = [(None, text("a")), (None, text("b")), (4, text("c")), (6, min(text("d"), text("d").upper())), (7, text("e")), (3, text("f")), (8, text("g")), (8, text("h")), (None, None), (None, " "), (9, ""), (10, None)]
    assert sorted(got, key=str) == sorted(want, key=str)
    single = docs.filter("text like 'a%' or text like 'g%' or text is null")
    assert sorted(r.doc_id or 0 for r in jaccard.representatives(single).collect()) == [0, 0, 8, 10]


def awkward(spark, sf):
    """Documents with columns that operators use inside, nulls, empties, repeated rows, a long text, a benchmark passage and secrets."""
    item = spark.read.parquet(f"{sf}/benchmark.parquet").filter("text is not null").orderBy("item_id").first().text
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    near = text("n").replace("n30", "other")
    texts = [None, "", " ", text("a"), text("a"), near, text("n"), text("b") + " " + item, "password = hunter22 " + text("c"), "é token=" + "a1" * 15 + " " + text("d"), text("long", 40_000), "short", "日本語" * 40]
    rows = [(i, t, None if i == 3 else "en", None if i == 8 else f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, text("q"), "en", "s", 5), (None, text("q"), "en", "s", 5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(["score", "predicted", "hits", "n_words", "matches", "secrets", "ids", "_t", "_k", "k", "n", "row", "t", "u", "cut", "_words0", "bits", "d"])))


def test_stages_keep_awkward_rows_and_columns(spark, sf):
    docs = awkward(spark, sf)
    now = docs
    for name, stage in p.STAGES[:-1]:
        before, now = now, saved(stage(spark, now, sf))
        assert now.columns == docs.columns, name
        extra = [c for c in docs.columns if c not in ("text", "n_chars")]
        assert now.select(*extra).exceptAll(before.select(*extra)).count() == 0, name
        none = stage(spark, docs.limit(0), sf)
        assert none.count() == 0 and none.columns == docs.columns, name
    last = p.STAGES[-1][1]
    out = last(spark, now, sf)
    assert out.columns == [c for c in docs.columns if c != "text"] + ["ids_"] and out.count() == now.count()
    assert last(spark, docs.limit(0), sf).count() == 0


def test_the_whole_equals_brute_force(spark, sf):
    """All stages but the trained one, which has a test of its own, computed again in plain Python."""
    import public_tokenizers

    docs = awkward(spark, sf)
    kept = saved(p.drop_toxic(spark, docs, sf))
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    shingles = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        shingles.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            same = a == b and rows[i][0] == rows[j][0] is not None if not a or not b else 10 * len(a & b) >= 8 * len(a | b)
            if same:
                up[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r)
    stay = [min(g, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")) for g in groups.values()]
    bench = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for t in bench:
        w = word.findall(lower(t))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in windows}
    clean = []
    for d, t in stay:
        w = word.findall(lower(t))
        if not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1)):
            clean.append((d, t))

    def redacted(t):
        hits = []
        for q, least, flags in ((r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, re.I | re.A), (r"AKIA[A-Z0-9]{16,}", 0, 0), (r"[0-9a-f]{24,}", 0, 0)):
            hits += [(m.start(), m.end()) for m in re.finditer(q, t, flags) if not least or len(m[2]) >= least]
        out, at = "", 0
        for a, b in sorted(hits):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, b)
        return out + t[at:]

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((str(d), ref.encode_ordinary(redacted(t or ""))) for d, t in clean)
    now = kept
    for _, stage in p.STAGES[1:]:
        now = saved(stage(spark, now, sf))
    assert sorted((str(r.doc_id), list(r.ids_)) for r in now.collect()) == want
    assert len(rows) > len(stay) > len(clean) > 5
