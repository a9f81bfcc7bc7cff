"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Base kinds (fixed patterns): ``assign``, ``access`` and ``hex``. Further candidate kinds (``CANDIDATES``) are shapes that
are secrets only if they belong to few owners: each candidate's SHA-256 is counted over the whole corpus by distinct
repositories (documents) and owners (sources). A value held by at most ``max_owners`` owners is live-looking, one held by
more is a widely copied example. Live-looking further candidates become spans too; base spans always stay.

Positions are code points, ends exclusive; the span of a match is the whole match. Cases: null texts have no spans and
give the digest of an empty string; a null source is an owner of its own; repeated rows get equal results, and count once
by (doc_id, text); a null doc_id is kept; ties of spans go by start, then kind; an empty table gives an empty result. Texts are
scanned whole, once: only ids, spans and digests are kept for the counts. ``report`` reads doc_id, source and text only; ``redact`` keeps
all columns, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covertile.llm.common import lookup, saved

#: Fixed patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Shapes that the method adds: private key headers, vendor prefixes, signed web tokens.
CANDIDATES = {
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+",
    "vendor": r"\b(?:gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|AIza)[A-Za-z0-9_-]{16,}+",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
}
KINDS = ["assign", "access", "hex", *CANDIDATES]
BASE = 3


def _spans(text: Column, pattern: str, kind: int, value_group: int, least: int) -> Column:
    """array<struct(start, kind, end, value)>: what lies between the matches gives their places."""
    p = F.lit(pattern)
    gaps = F.transform(F.split(text, pattern, -1), lambda s: F.length(s).cast("long"))
    rows = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, p, 0).alias("hit"), F.regexp_extract_all(text, p, value_group).alias("value"))
    named = F.transform(rows, lambda r: F.struct(r["gap"].alias("gap"), r["hit"].alias("hit"), r["value"].alias("value")))
    # a running position over the pieces; the last piece has no match
    walked = F.aggregate(
        named,
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>").alias("out")),
        lambda acc, r: F.when(
            r["hit"].isNotNull(),
            F.struct(
                (acc["at"] + r["gap"] + F.length(r["hit"])).alias("at"),
                F.concat(acc["out"], F.array(F.struct((acc["at"] + r["gap"]).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + r["gap"] + F.length(r["hit"])).alias("end"), r["value"].alias("value")))).alias("out"),
            ),
        ).otherwise(acc),
        lambda acc: acc["out"],
    )
    kept = F.filter(walked, lambda s: F.length(s["value"]) >= least) if least else walked
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    return F.when(F.rlike(text, p), kept).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` without its text, with ``_t`` (a hash of the text), ``_base`` and ``_more`` (arrays of spans). No shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(_spans(text, ASSIGN, 0, 2, 6), _spans(text, ACCESS, 1, 0, 0), _spans(text, HEX, 2, 0, 0))
    more = F.concat(*(_spans(text, p, BASE + i, 0, 0) for i, p in enumerate(CANDIDATES.values())))
    slim = F.transform(F.array_sort(base), lambda s: s.withField("value", F.sha2(s["value"], 256)))
    slim_more = F.transform(F.array_sort(more), lambda s: s.withField("value", F.sha2(s["value"], 256)))
    return docs.withColumns({"_t": F.xxhash64(F.md5(text), F.length(text)), "_base": slim, "_more": slim_more}).drop("text")


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners) over all candidates: partial counts by (value, repository, owner) come first."""
    each = found.select("doc_id", "source", F.explode(F.concat("_base", "_more")).alias("s")).select(F.col("s.value").alias("value"), "doc_id", "source")
    once = each.groupBy("value", "source", "doc_id").agg(F.lit(1).alias("one"))
    by_owner = once.groupBy("value", "source").agg(F.count("one").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def _text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def scan(docs: DataFrame, max_owners: int = 2) -> DataFrame:
    """(doc_id, t, base, secrets, live, n_live, n_example) of ``docs`` (doc_id, source, text); t is a hash of the text.

    ``base`` and ``secrets`` are arrays of start, kind, end: base spans, and these with live-looking further spans; ``live`` are the live-looking
    ones of all kinds. Texts are read once; what was found is a table of ids, spans and digests.
    """
    found = saved(candidates(docs.select("doc_id", "source", "text")).withColumnRenamed("_t", "t"))
    keyed = found.filter((F.size("_base") > 0) | (F.size("_more") > 0))
    counts = ownership(keyed)
    each = keyed.select("doc_id", "t", "_base", "_more").dropDuplicates(["doc_id", "t"]).select("doc_id", "t", F.explode(F.concat("_base", "_more")).alias("s")).select("doc_id", "t", "s", F.col("s.value").alias("value"))
    # a value that a third of all documents hold is looked up without a shuffle by it
    judged = lookup(each, saved(counts.select("value", "n_repos", "n_owners")), "value", "n_repos").withColumn("ok", F.col("n_owners") <= max_owners)
    at = F.struct("s.start", "s.kind", "s.end")
    own = judged.groupBy(F.col("doc_id").alias("_d"), F.col("t").alias("_u")).agg(F.collect_list(F.when(F.col("ok"), at)).alias("_live"), F.count_if("ok").alias("n_live"), F.count_if(~F.col("ok")).alias("n_example"))
    out = found.join(own, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("t") == F.col("_u")), "left")
    none = F.array().cast(SPANS)
    live = F.array_sort(F.coalesce("_live", none))
    base = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    out = out.withColumns({"base": base, "live": live})
    more = F.filter("live", lambda s: s["kind"] >= BASE)
    return out.select("doc_id", "t", "base", F.array_sort(F.concat("base", more)).alias("secrets"), "live", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_example", F.lit(0)).alias("n_example"))


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, with ``live``: the spans that belong to few owners; the others are widely copied examples."""
    s = scan(docs)
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return s.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.col("secrets")).alias("spans"), _text(F.col("live")).alias("live"), "n_live", "n_example")


def redact(docs: DataFrame, mark: str = "[SECRET]", max_owners: int = 2) -> DataFrame:
    """``docs`` with every secret span replaced by ``mark`` (overlapping spans by one) and n_chars brought up to date.

    The spans come back by (doc_id, hash of the text), so the texts meet them in one join. Rows travel as one struct, so no
    column of theirs can clash with what is joined.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).withColumn("u", F.xxhash64(F.md5(text), F.length(text)))
    hits = scan(docs, max_owners).filter(F.size("secrets") > 0).dropDuplicates(["doc_id", "t"]).select("doc_id", "t", "secrets")
    out = rows.join(hits, F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("u") == F.col("t")), "left")
    whole = F.col("row.text")
    cut = F.aggregate(
        "secrets",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark)).alias("out"))
        ),
        lambda a: F.concat(a["out"], F.substring(whole, (a["at"] + 1).cast("int"), F.lit(2147483647))),
    )
    hit = F.col("secrets").isNotNull()
    out = out.withColumn("cut", F.when(hit, cut))
    made = {"text": F.when(hit, F.col("cut")).otherwise(whole), "n_chars": F.when(hit, F.length("cut").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(made[c].alias(c) if made.get(c) is not None else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


#: DuckDB: the base spans by the same split-and-match rule. No further candidate kind occurs with an owner count to decide on
#: unless its pattern matches, so those columns come from the same counts.
def oracle() -> str:
    kinds = {
        "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        "access": (r"AKIA[A-Z0-9]{16,}", 0, 0),
        "hex": (r"[0-9a-f]{24,}", 0, 0),
        "pem": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}", 0, 0),
        "vendor": (r"\b(?:gh[pousr]_|glpat-|xox[abprs]-|sk-|sk_live_|AIza)[A-Za-z0-9_-]{16,}", 0, 0),
        "jwt": (r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    }
    parts = []
    for k, (name, (p, group, least)) in enumerate(kinds.items()):
        parts.append(f"""
  select doc_id, source, {k} as kind, '{name}' as name, gap_end - len(hit) as start, gap_end as stop, value from (
    select doc_id, source, hit, value, i,
           sum(len(gap) + len(hit)) over (partition by doc_id order by i) as gap_end
    from (select doc_id, source, unnest(regexp_extract_all(t, '{p}', 0)) as hit, unnest(regexp_extract_all(t, '{p}', {group})) as value,
                 unnest(string_split_regex(t, '{p}')[:len(regexp_extract_all(t, '{p}', 0))]) as gap,
                 generate_subscripts(regexp_extract_all(t, '{p}', 0), 1) as i
          from d where regexp_matches(t, '{p}')))
  where len(value) >= {least}""")
    return f"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
s as ({' union all '.join(parts)}),
o as (select value, count(distinct coalesce(source, chr(1))) as n_owners from s group by value),
l as (select s.*, n_owners <= 2 as live from s join o using (value)),
g as (select doc_id, count(*) filter (kind = 0) as n_assign, count(*) filter (kind = 1) as n_access, count(*) filter (kind = 2) as n_hex,
        string_agg(name || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) filter (kind < 3) as base,
        string_agg(name || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) filter (kind < 3 or live) as spans,
        string_agg(name || ':' || start::bigint || ':' || stop::bigint, ',' order by start, kind) filter (live) as live,
        count(*) filter (live) as n_live, count(*) filter (not live) as n_example from l group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(g.live, '') as live, coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example
from d left join g using (doc_id)"""
