"""The registered queries of the library on the driver's tables, and the SQL that says what each returns.

Numbers with a fraction are rounded to six digits in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covertile import functions as fn
from covertile.operators import assign, calibrate, classify, evidence, explore, intervals, mask, matching, metrics, payload, reads, registry, robust, scoring, segment, summaries, tiling
from covertile.params import Params
from covertile.plans import mapping as mp
from covertile.plans.tables import saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits, never a negative zero."""
    return df.select(*((F.round(F.col(f.name), 6) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields))


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(expr: str) -> str:
    return f"(round({expr}, 6) + 0.0)"


# what the mapping of the driver's tables is in SQL
_W = mp.LENGTH // mp.N
READS = f"""
lines as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) as read, c_mktsegment as sample, r_name as grp, l_returnflag as flag, l_linestatus as component,
  date_diff('day', date '1995-01-01', l_shipdate::date) * 1000 + l_orderkey % 1000 as start, l_quantity::bigint as q, round(l_discount * 1000)::int as mapq, round(l_tax * 100)::bigint as tax
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
  join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
kinds as (select *, {mp.event_sql()} as kind from lines),
roles as (select *, case when flag = 'R' or (kind = 'swap' and component = 'F') then 'donor' else 'recipient' end as role from kinds),
ali as (select read, sample, grp, role, component, grp || '_' || role || '_' || component as chr_id, start, start + case when kind in ('less', 'both') and role = 'recipient' then 1
  when kind in ('more', 'both') and component = 'F' and role = 'donor' then 6 * q else q end as stop, mapq, tax from roles),
pieces as (select *, greatest(start, iid * {_W}) as cs, least(stop, (iid + 1) * {_W}) as ce from (
  select *, unnest(generate_series(((start + 1) * {mp.N} - 1) // {mp.LENGTH}, (stop * {mp.N} - 1) // {mp.LENGTH})) as iid from ali where stop > start)),
cnt as (select sample, chr_id, iid, count(distinct read) as "count", count(distinct read) filter (mapq >= 30) as mapq_high from pieces group by all),
cov as (select sample, chr_id, iid, sum(greatest(0, ce - greatest(cs, coalesce(far, cs))))::bigint as covered from (
  select *, max(ce) over (partition by sample, chr_id, iid order by cs, ce rows between unbounded preceding and 1 preceding) as far from pieces) group by all)"""
METRICS = (
    READS
    + f""",
win as (select r_name || '_' || role || '_' || component as chr_id, r_name as grp, role, component, iid from region cross join (values ('donor'), ('recipient')) as a(role) cross join (values ('F'), ('O')) as b(component) cross join (select unnest(generate_series(0, {mp.N - 1})) as iid)),
tax as (select chr_id, ((start + 1) * {mp.N} - 1) // {mp.LENGTH} as iid, sum(tax) / count(*) / 100 as gc from ali group by all),
m0 as (select s.sample, w.*, w.iid * {_W} as start, (w.iid + 1) * {_W} as stop, {_W} as length, coalesce(c."count", 0) as "count", coalesce(c.mapq_high, 0) as mapq_high, coalesce(v.covered, 0) as covered, tax.gc
  from win w cross join (select distinct c_mktsegment as sample from customer) s left join cnt c using (sample, chr_id, iid) left join cov v using (sample, chr_id, iid) left join tax using (chr_id, iid)),
m as (select *, covered / length as breadth, case when "count" > 0 then mapq_high / "count" end as mapq_high_fraction, -ln(greatest(1 - covered / length, 1e-12)) as lambda_breadth, "count" * {mp.READ} / length as lambda_count from m0)"""
)


def scores_sql(how: str = "max", metric: str = "breadth", score: str = "ratio") -> str:
    d = {"breadth": "lambda_breadth", "count": "lambda_count", "combined": "sqrt((lambda_breadth + 1e-4) * (lambda_count + 1e-4))"}[metric]
    donor = {"max": "b.d", "mean": "mean_d", "sum": "sum_d"}[how]
    name = "b.component" if how == "max" else "case when n_donor = 1 then one end"
    value = "ln(donor_mean + 1e-4) - ln(recipient_mean + 1e-4)" if score == "ratio" else "ln(donor_mean + 1e-4)"
    return (
        METRICS
        + f""",
rec as (select sample, grp, iid, avg({d}) as recipient_mean, count(distinct component) as n_recipient, avg(gc) as gc_recipient, avg(mapq_high_fraction) as mapq_recipient from m where role = 'recipient' group by all),
don as (select m.sample, m.grp, m.iid, component, gc, mapq_high_fraction, {d} as d, rec.* exclude (sample, grp, iid), ln({d} + 1e-4) - ln(recipient_mean + 1e-4) as delta from m join rec using (sample, grp, iid) where role = 'donor'),
agg as (select sample, grp, iid, recipient_mean, n_recipient, gc_recipient, mapq_recipient, avg(d) as mean_d, sum(d) as sum_d, count(distinct component) as n_donor, count(*) filter (delta > 0.5) as supported_donors, avg(gc) as gc_donor, avg(mapq_high_fraction) as mapq_donor, min(component) as one from don group by all),
b as (select * from (select *, row_number() over (partition by sample, grp, iid order by delta desc, component) as r from don) where r = 1),
s0 as (select agg.*, {donor} as donor_mean, {name} as donor_component from agg join b using (sample, grp, iid)),
s as (select *, {value} as score, ln(donor_mean + 1e-4) as log_donor, ln(recipient_mean + 1e-4) as log_recipient, ln(donor_mean + recipient_mean + 1e-4) as log_total,
  coalesce((mapq_donor + mapq_recipient) / 2, mapq_donor, mapq_recipient) as mapq_high_fraction from s0)"""
    )


SCORES = scores_sql()


def _spread_sql(role: str) -> str:
    return f"""
{role}_l as (select *, ln(lambda_breadth + 1e-4) as l from m where role = '{role}'), {role}_c as (select *, l - median(l) over (partition by sample, grp, component) as v from {role}_l),
{role}_s as (select sample, grp, iid, case when count(v) >= 2 then max(v) - min(v) else 0 end as {role}_spread from {role}_c group by all)"""


RESIDUALS = (
    SCORES
    + ","
    + _spread_sql("donor")
    + ","
    + _spread_sql("recipient")
    + """,
res as (select *, log_donor - median(log_donor) over (partition by sample, grp) as donor_residual, log_recipient - median(log_recipient) over (partition by sample, grp) as recipient_residual,
  log_total - median(log_total) over (partition by sample, grp) as total_residual from s join donor_s using (sample, grp, iid) join recipient_s using (sample, grp, iid))"""
)
CALLS = (
    RESIDUALS
    + f""",
isl as (select *, iid - row_number() over (partition by sample, grp order by iid) as i from res where score > {mp.LIMIT}),
seg as (select sample, grp, min(iid) as start_iid, max(iid) as end_iid, count(*) as n_windows, avg(score) as score_mean, avg(donor_residual) as donor_residual, avg(recipient_residual) as recipient_residual, avg(donor_spread) as donor_spread,
  avg(recipient_spread) as recipient_spread, avg(total_residual) as total_residual, avg(supported_donors) as supported_donors, avg(mapq_high_fraction) as mapq_high_fraction from isl group by sample, grp, i),
wid as (select *, sample || '_' || grp || '_' || start_iid || '_' || end_iid as call_id, start_iid * 5200000 as start_bp, (end_iid + 1) * 5200000 as end_bp, (end_iid + 1 - start_iid) * 5200000 as width_bp from seg),
bin as (select *, case when width_bp >= 100e6 then 4 when width_bp >= 50e6 then 3 when width_bp >= 25e6 then 2 when width_bp >= 10e6 then 1 when width_bp >= 5e6 then 0 end as bin from wid),
calls as (select *, case bin when 0 then '5-10' when 1 then '10-25' when 2 then '25-50' when 3 then '50-100' when 4 then '>100' end as length_bin, coalesce(score_mean > (array[{", ".join(map(str, mp.PARAMS.floors_multi))}])[bin + 1], false) as pass from bin)"""
)


def classified_sql(source: str) -> str:
    """The rules of classes over ``source``, calls with their six cutoffs."""
    return f""",
sig as (select *, coalesce(donor_residual > donor_mod, false) as gain, coalesce(recipient_residual < loss_mod, false) as loss, coalesce(recipient_residual > abs(loss_mod), false) as rgain,
  coalesce(total_residual > total_mod, false) as tgain, coalesce(total_residual < -total_mod, false) as tloss from {source}),
c0 as (select *, case when gain and loss then 'substitution' when gain and rgain then 'complex' when gain then 'addition' when loss then 'deletion' else 'other' end as class0,
  case when gain and (loss or rgain) then 'donor+recipient' when gain then 'donor' when loss or rgain then 'recipient' else 'none' end as evidence0,
  (gain and loss and (tgain or tloss)) or (gain and not loss and tloss) or (not gain and loss and tgain) or (gain and rgain) as compound from sig),
c1 as (select *, case when compound then 'complex' else class0 end as class, case when compound and gain and loss then 'donor+recipient; total imbalance' when compound then 'total imbalance' else evidence0 end as evidence,
  case when total_residual is null then null when tgain then 'gain' when tloss then 'loss' else 'neutral' end as total_evidence,
  -- each later rule overrides the ones before it
  case when gain and not loss and not compound then 'gain' when not gain and loss and not compound then 'loss' when compound then 'compound' when class0 = 'other' and tloss then 'loss' when class0 = 'other' and tgain then 'gain'
    when class0 = 'complex' then 'compound' when tgain or tloss then 'compound' when gain and loss then 'balanced' else 'neutral' end as copy_state,
  case when greatest(coalesce(donor_spread, 0), coalesce(recipient_spread, 0)) > 2 or coalesce(supported_donors, 0) > 1 then 'heterogeneous' else 'consistent' end as component_status,
  case when mapq_high_fraction < 0.5 then 'low' when mapq_high_fraction >= 0.5 then 'ok' end as mappability_status,
  coalesce((gain and loss and not compound and donor_residual >= donor_high and recipient_residual <= loss_mod and (total_residual is null or not (tgain or tloss)))
    or (gain and not loss and not compound and donor_residual >= donor_high and (total_residual is null or total_residual >= 0))
    or (not gain and loss and not compound and recipient_residual <= loss_high and (total_residual is null or total_residual <= -total_high)), false) as high_ok from c0),
c2 as (select *, case when donor_residual is null or recipient_residual is null then 'low' when pass and high_ok then 'high' when compound or gain or loss then 'moderate' else 'low' end as conf0 from c1),
c3 as (select *, case when class = 'other' and (tgain or tloss) then 'ambiguous' when compound then 'needs_review' when not pass then 'needs_review' when conf0 = 'high' then 'confident' when conf0 = 'moderate' then 'ambiguous' else 'needs_review' end as status0,
  conf0 = 'high' and (component_status = 'heterogeneous' or coalesce(mappability_status = 'low', false)) as down from c2),
k as (select *, case when down then 'moderate' else conf0 end as class_confidence, case when down and status0 = 'confident' then 'ambiguous' else status0 end as class_status,
  case when pass and donor_residual >= 1 then 'high' when donor_residual >= 0.5 then 'moderate' else 'low' end as confidence from c3)"""


DEFAULT_CUTS = ", pc as (select *, 0.5 as donor_mod, 1.0 as donor_high, -0.5 as loss_mod, -1.0 as loss_high, 0.5 as total_mod, 1.0 as total_high from calls)"
CLASSIFIED = CALLS + DEFAULT_CUTS + classified_sql("pc")


def classified(spark: SparkSession, sf_dir: str, scores: DataFrame | None = None) -> DataFrame:
    return classify.classify(mp.call_rows(spark, sf_dir, scores), mp.PARAMS)


@query("""select s_suppkey as chr_id, iid, iid * (1000 + s_suppkey % 977) // 20 as start, (iid + 1) * (1000 + s_suppkey % 977) // 20 as stop
from supplier cross join (select unnest(generate_series(0, 19)) as iid)""")
def tile_exact_n(spark, sf_dir):
    """Every supplier as a contig of its own length, tiled by 20 windows."""
    c = mp.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chr_id"), (1000 + F.col("s_suppkey") % 977).alias("length"))
    return tiling.tile(c, 20).select("chr_id", "iid", "start", "stop")


@query(f'with {READS} select sample, chr_id, iid, "count", mapq_high from cnt')
def window_counts(spark, sf_dir):
    return reads.count_windows(mp.pieces(spark, sf_dir), read="read_key").select("sample", "chr_id", "iid", "count", "mapq_high")


@query(f"with {READS} select sample, chr_id, iid, covered from cov")
def window_coverage(spark, sf_dir):
    return reads.union_length(mp.pieces(spark, sf_dir), ["sample", "chr_id", "iid"])


@query("""with p as (select o_orderstatus as chr_id, floor(o_totalprice)::bigint as pos, count(*) as k from orders group by all),
r as (select p_partkey as range_id, case p_size % 3 when 0 then 'F' when 1 then 'O' else 'P' end as chr_id, floor(p_retailprice * 100)::bigint as start, floor(p_retailprice * 100)::bigint + 500 + p_size as stop from part)
select r.range_id, r.start, r.stop, coalesce(sum(k), 0)::bigint as n from r left join p on r.chr_id = p.chr_id and p.pos >= r.start and p.pos < r.stop group by all""")
def count_ranges(spark, sf_dir):
    """Orders whose price lies in each part's price range, by status."""
    points = mp.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("chr_id"), F.floor("o_totalprice").alias("pos"))
    p = mp.table(spark, sf_dir, "part")
    status = F.when(F.col("p_size") % 3 == 0, "F").when(F.col("p_size") % 3 == 1, "O").otherwise("P")
    lo = F.floor(F.col("p_retailprice") * 100)
    return reads.count_ranges(points, p.select(F.col("p_partkey").alias("range_id"), status.alias("chr_id"), lo.alias("start"), (lo + 500 + F.col("p_size")).alias("stop"))).select("range_id", "start", "stop", "n")


@query(f"""with {METRICS} select sample, chr_id, iid, "count", mapq_high, covered, {r6("gc")} as gc, {r6("breadth")} as breadth, {r6("mapq_high_fraction")} as mapq_high_fraction, {r6("lambda_breadth")} as lambda_breadth, {r6("lambda_count")} as lambda_count from m""")
def window_metrics(spark, sf_dir):
    return mp.metric_rows(spark, sf_dir).select("sample", "chr_id", "iid", "count", "mapq_high", "covered", "gc", "breadth", "mapq_high_fraction", "lambda_breadth", "lambda_count")


@query(f"""with {METRICS} select sample, grp, role, component, count(*) as n_windows, count(distinct chr_id) as n_contigs, sum("count")::bigint as reads, {r6("avg(breadth)")} as mean_breadth, {r6("median(breadth)")} as median_breadth, {r6("stddev_samp(breadth)")} as sd_breadth, {r6("avg(lambda_count)")} as mean_lambda_count from m group by all""")
def metrics_summary(spark, sf_dir):
    return summaries.metrics_summary(mp.metric_rows(spark, sf_dir))


@query(f"""with {METRICS} select sample, chr_id, count(*) as n_windows, sum("count")::bigint as reads, sum(covered)::bigint as covered, {r6("avg(breadth)")} as mean_breadth, {r6("max(breadth)")} as max_breadth, {r6("avg(mapq_high_fraction)")} as mean_mapq_high, {r6("avg(gc)")} as mean_gc from m group by all""")
def contig_summary(spark, sf_dir):
    return summaries.contig_summary(mp.metric_rows(spark, sf_dir))


PAIR = ["sample", "grp", "iid", "score", "donor_mean", "recipient_mean", "donor_component", "n_donor", "n_recipient", "supported_donors", "mapq_high_fraction", "log_total"]
PAIR_SQL = f"sample, grp, iid, {r6('score')} as score, {r6('donor_mean')} as donor_mean, {r6('recipient_mean')} as recipient_mean, donor_component, n_donor, n_recipient, supported_donors, {r6('mapq_high_fraction')} as mapq_high_fraction, {r6('log_total')} as log_total"


def _pairs(name: str, params: Params, sql: str) -> None:
    def f(spark, sf_dir):
        return mp.score_rows(mp.metric_rows(spark, sf_dir), params).select(*PAIR)

    f.__name__ = name
    query(f"with {sql} select {PAIR_SQL} from s")(f)


_pairs("pair_scores_max", mp.PARAMS, SCORES)
_pairs("pair_scores_mean", Params(donor_aggregation="mean"), scores_sql("mean"))
_pairs("pair_scores_sum", Params(donor_aggregation="sum"), scores_sql("sum"))
_pairs("donor_only", Params(score_type="donor"), scores_sql(score="donor"))
_pairs("combined_depth", Params(metric="combined"), scores_sql(metric="combined"))


@query(f"""with {METRICS}, l as (select *, ln(lambda_breadth + 1e-4) as l from m where role = 'donor'), c as (select *, l - median(l) over (partition by sample, grp, component) as v from l)
select sample, grp, iid, {r6("case when count(v) >= 2 then max(v) - min(v) else 0 end")} as donor_spread from c group by all""")
def component_spread(spark, sf_dir):
    return scoring.spread(mp.metric_rows(spark, sf_dir), "donor", mp.PARAMS)


@query(f"with {SCORES} select grp, iid, {r6('avg((score > 0.5)::int)')} as f from s group by all")
def recurrence_fraction(spark, sf_dir):
    return mask.recurrence(mp.score_rows(mp.metric_rows(spark, sf_dir)))


def em_sql(source: str, by: str = "one") -> str:
    """The two-component mixture of each group of ``source`` (by, x, n) as ``em`` (by, w1, m1, s1, w2, m2, s2), by iteration."""
    dens = lambda k: f"w{k} * exp(-0.5 * ((x - m{k}) / s{k}) ** 2) / (s{k} * sqrt(2 * pi()))"
    return f""",
ev as materialized (select {by} as g, x, n from {source}),
it(i, g, w1, m1, s1, w2, m2, s2, done) as (
  select 0, g, 0.8::double, 0.02::double, 0.05::double, 0.2::double, 0.75::double, 0.15::double, sum(n) < 2 from ev group by g
  union all
  select i + 1, g, nw1, nm1, greatest(ns1, 1e-6), nw2, nm2, greatest(ns2, 1e-6), greatest(abs(nw1 - w1), abs(nw2 - w2), abs(nm1 - m1), abs(nm2 - m2), abs(ns1 - s1), abs(ns2 - s2)) < 1e-8
  from (select i, g, w1, m1, s1, w2, m2, s2, any_value(nw1) as nw1, any_value(nw2) as nw2, any_value(nm1) as nm1, any_value(nm2) as nm2,
               sqrt(sum(q1 * (x - nm1) ** 2) / greatest(sum(q1), 1e-12)) as ns1, sqrt(sum(q2 * (x - nm2) ** 2) / greatest(sum(q2), 1e-12)) as ns2
        from (select *, sum(q1) over (partition by g) / sum(n) over (partition by g) as nw1, sum(q2) over (partition by g) / sum(n) over (partition by g) as nw2,
                     sum(q1 * x) over (partition by g) / greatest(sum(q1) over (partition by g), 1e-12) as nm1, sum(q2 * x) over (partition by g) / greatest(sum(q2) over (partition by g), 1e-12) as nm2
              from (select *, n * (1 - p) as q1, n * p as q2 from (select it.*, x, n, {dens(2)} / ({dens(1)} + {dens(2)} + 1e-300) as p from it join ev using (g) where not done and i < 200)))
        group by i, g, w1, m1, s1, w2, m2, s2)),
em as (select g, case when m1 <= m2 then w1 else w2 end as w1, least(m1, m2) as m1, case when m1 <= m2 then s1 else s2 end as s1, case when m1 <= m2 then w2 else w1 end as w2, greatest(m1, m2) as m2, case when m1 <= m2 then s2 else s1 end as s2
  from it qualify row_number() over (partition by g order by i desc) = 1)"""


def _posterior(x: str) -> str:
    d = lambda k: f"em.w{k} * exp(-0.5 * (({x} - em.m{k}) / em.s{k}) ** 2) / (em.s{k} * sqrt(2 * pi()))"
    return f"{d(2)} / ({d(1)} + {d(2)} + 1e-300)"


MASKED = SCORES + """, rf as (select grp, iid, avg((score > 0.5)::int) as f from s group by all), rc as (select 1 as one, f as x, count(*)::double as n from rf group by f)""" + em_sql("rc")
MASKED += f""", mk as (select grp, iid, f, {_posterior("f")} as posterior from rf, em), mask as (select *, coalesce(posterior > 0.5 and f > 0.5 + 1e-9, false) as mask from mk)"""


@query(f"with recursive {MASKED} select grp, iid, iid * {_W} as start, (iid + 1) * {_W} as stop, {r6('f')} as f, {r6('posterior')} as posterior, mask, 'cohort' as source from mask")
def recurrence_mask(spark, sf_dir):
    """Masked windows by one mixture of all recurrences."""
    m = mp.metric_rows(spark, sf_dir)
    return mask.recurrence_mask(mp.score_rows(m), m)


@query(f"with recursive {MASKED} select s.sample, s.grp, s.iid, {r6('case when not mask then score end')} as score, mask as masked from s join mask using (grp, iid)")
def masked_scores(spark, sf_dir):
    """Scores with those of masked windows taken away."""
    m = mp.metric_rows(spark, sf_dir)
    s = mp.score_rows(m)
    return mask.apply_mask(s, mask.recurrence_mask(s, m)).select("sample", "grp", "iid", "score", "masked")


@query(f"with recursive {MASKED} select grp, count(*) as n_windows, count(*) filter (mask) as n_masked, {r6('avg(mask::int)')} as masked_fraction, {r6('avg(f) filter (mask)')} as mean_f, {r6('avg(posterior) filter (mask)')} as mean_posterior, case when bool_or(mask) then 'cohort' else '' end as sources from mask group by grp")
def masks_summary(spark, sf_dir):
    m = mp.metric_rows(spark, sf_dir)
    return summaries.masks_summary(mask.recurrence_mask(mp.score_rows(m), m))


@query(f"with recursive {MASKED} select {r6('min(f)')} as threshold from mask where mask")
def mask_threshold(spark, sf_dir):
    m = mp.metric_rows(spark, sf_dir)
    return mask.mask_threshold(mask.recurrence_mask(mp.score_rows(m), m))


@query(f"""with {SCORES}, a as (select sample, grp, iid, log_donor - median(log_donor) over (partition by grp, iid) as v from s)
select sample, grp, iid, {r6("v - median(v) over (partition by sample)")} as log_donor from a""")
def median_polish_sweep(spark, sf_dir):
    """One sweep: windows' medians, then samples'."""
    s = mp.score_rows(mp.metric_rows(spark, sf_dir)).select("sample", "grp", "iid", "log_donor")
    return robust.polish_sweep(s, ["grp", "iid"], "sample", "log_donor").select("sample", "grp", "iid", "log_donor")


@query(f"""with recursive {SCORES}, p(it, sample, grp, iid, v) as (select 0, sample, grp, iid, log_donor from s union all
  select it + 1, sample, grp, iid, a - median(a) over (partition by sample) from (select *, v - median(v) over (partition by grp, iid) as a from p) where it < 30)
select sample, grp, iid, (round(v, 4) + 0.0) as log_donor from p where it = 30""")
def median_polish(spark, sf_dir):
    """Sweeps until no residual moves (here to four digits)."""
    s = mp.score_rows(mp.metric_rows(spark, sf_dir)).select("sample", "grp", "iid", "log_donor")
    return robust.median_polish(s, ["grp", "iid"], "sample", "log_donor", tol=1e-12).withColumn("log_donor", F.round("log_donor", 4) + F.lit(0.0))


def _spline_sql(source: str, y: str, x: str) -> str:
    """``fit`` (source's columns, residual): y less its natural cubic spline on x by sample; columns are made orthogonal one after another."""
    d = lambda k: f"(greatest(x - t{k}, 0) ** 3 - greatest(x - t3, 0) ** 3) / (t3 - t{k})"
    on = lambda a, b: f"sum({a} * {b}) filter (kept) over w"
    return f""",
gv as (select *, {y} as y, {x} as x, coalesce({y} <= quantile_cont(case when {x} is not null then {y} end, 0.9) over (partition by sample) and {x} is not null, false) as kept from {source}),
gk as (select sample, quantile_cont(x, 0.0) as t0, quantile_cont(x, 1 / 3) as t1, quantile_cont(x, 2 / 3) as t2, quantile_cont(x, 1.0) as t3 from gv where kept group by sample),
gb as (select *, x as b1, {d(0)} - {d(2)} as b2, {d(1)} - {d(2)} as b3 from gv join gk using (sample)),
g1 as (select *, b1 - avg(b1) filter (kept) over w as c1, b2 - avg(b2) filter (kept) over w as m2, b3 - avg(b3) filter (kept) over w as m3 from gb window w as (partition by sample)),
g2 as (select *, m2 - c1 * {on("c1", "m2")} / {on("c1", "c1")} as c2, m3 - c1 * {on("c1", "m3")} / {on("c1", "c1")} as n3 from g1 window w as (partition by sample)),
g3 as (select *, n3 - c2 * {on("c2", "n3")} / {on("c2", "c2")} as c3 from g2 window w as (partition by sample)),
g4 as (select *, y - avg(y) filter (kept) over w - c1 * {on("c1", "y")} / {on("c1", "c1")} - c2 * {on("c2", "y")} / {on("c2", "c2")} - c3 * {on("c3", "y")} / {on("c3", "c3")} as e from g3 window w as (partition by sample)),
fit as (select *, e - median(e) over (partition by sample) as residual from g4)"""


@query(f"with {SCORES}{_spline_sql('s', 'log_donor', 'gc_donor')} select sample, grp, iid, (round(residual, 4) + 0.0) as residual from fit")
def gc_regression(spark, sf_dir):
    """Residuals of a natural spline of donor depth on the windows' mean tax, per sample."""
    s = mp.score_rows(mp.metric_rows(spark, sf_dir)).select("sample", "grp", "iid", "log_donor", "gc_donor")
    return robust.gc_regression(s, ["sample"], "log_donor", ["gc_donor"]).select("sample", "grp", "iid", (F.round("residual", 4) + F.lit(0.0)).alias("residual"))


@query(f"""with {RESIDUALS}, i0 as (select *, iid - row_number() over (partition by sample, grp order by iid) as i from res where score > {mp.LIMIT}),
sg as (select sample, grp, min(iid) as start_iid, max(iid) as end_iid, count(*) as n, avg(score) as v from i0 group by sample, grp, i),
ps as (select sample, grp, iid, sum(score) over w as s, count(score) over w as c from res window w as (partition by sample, grp order by iid rows between unbounded preceding and current row)),
l as (select *, v > 0.5 as pos, lag(end_iid) over w as pe, lag(v > 0.5) over w as pp from sg window w as (partition by sample, grp order by start_iid)),
g as (select l.*, coalesce((b.s - a.s) / nullif(b.c - a.c, 0), 0) as gm from l left join ps a on a.sample = l.sample and a.grp = l.grp and a.iid = l.pe left join ps b on b.sample = l.sample and b.grp = l.grp and b.iid = l.start_iid - 1),
j as (select *, sum(case when coalesce(pos and pp and start_iid - pe - 1 <= 10 and gm > -1, false) then 0 else 1 end) over (partition by sample, grp order by start_iid) as i from g)
select sample, grp, min(start_iid) as start_iid, max(end_iid) as end_iid, count(*) as n_merged, {r6("sum(v * n) / sum(n)")} as score_mean, case when count(*) > 1 then max(end_iid) - min(start_iid) + 1 else sum(n)::bigint end as n_windows from j group by sample, grp, i""")
def gap_merge(spark, sf_dir):
    """Stretches over the limit as segments, joined over gaps of ten windows whose mean exceeds -1."""
    s = mp.residual_rows(mp.metric_rows(spark, sf_dir))
    segs = mp.run_segments(s).select("sample", "grp", "start_iid", "end_iid", "n_windows", "score_mean")
    return intervals.gap_merge(segs, s.select("sample", "grp", "iid", "score"), ["sample", "grp"], 10, -1.0, 0.5)


@query("""with e as (select event_type, user_id, floor(epoch(ts))::bigint as s, floor(epoch(ts))::bigint + 1 + floor(abs(value))::bigint * 60 as e from events where value is not null),
w as (select *, max(e) over (partition by event_type, user_id order by s, e rows between unbounded preceding and 1 preceding) as far from e),
i as (select *, sum(case when s > far then 1 else 0 end) over (partition by event_type, user_id order by s, e rows between unbounded preceding and current row) as i from w)
select event_type, user_id, min(s) as start, max(e) as stop, count(*) as n from i group by event_type, user_id, i""")
def interval_union(spark, sf_dir):
    """Events as intervals of as many minutes as their value, united by type and user."""
    start = F.unix_timestamp("ts")
    e = mp.table(spark, sf_dir, "events").filter("value is not null").select("event_type", "user_id", start.alias("start"), (start + 1 + F.floor(F.abs("value")) * 60).alias("stop"))
    return intervals.merge(e, ["event_type", "user_id"], "start", "stop")


@query("""with e as (select event_type, date_diff('day', date '2000-01-01', ts::date) * 24 + hour(ts) as h from events), d as (select event_type, h, count(*) as n from e group by all),
r as (select *, h - row_number() over (partition by event_type order by h) as i from d where n > 1),
run as (select event_type, min(h) as a, max(h) as b, count(*) as k from r group by event_type, i)
select event_type, a as run_start, b as run_stop, k as run_width from run""")
def run_extension(spark, sf_dir):
    """Stretches of consecutive hours with more than one event, by type."""
    h = (F.datediff(F.to_date("ts"), F.lit("2000-01-01").cast("date")) * 24 + F.hour("ts")).cast("long")
    d = mp.table(spark, sf_dir, "events").select("event_type", h.alias("h")).groupBy("event_type", "h").agg(F.count(F.lit(1)).alias("n"))
    return intervals.runs(d, ["event_type"], "h", F.col("n") > 1)


@query(f"""with {RESIDUALS}, rr as (select sample, grp, iid, iid - row_number() over (partition by sample, grp order by iid) as i from res where donor_residual > 0),
runs as (select sample, grp, min(iid) as a, max(iid) as b from rr group by sample, grp, i),
i2 as (select sample, grp, iid, iid - row_number() over (partition by sample, grp order by iid) as i from res where score > {mp.LIMIT}), c as (select sample, grp, min(iid) as start_iid, max(iid) as end_iid from i2 group by sample, grp, i)
select c.*, coalesce(p.a, start_iid) as ext_start, coalesce(q.b, end_iid) as ext_stop, p.a is not null or q.b is not null or r.a is not null as run_found
from c left join runs p on p.sample = c.sample and p.grp = c.grp and start_iid - 1 between p.a and p.b left join runs q on q.sample = c.sample and q.grp = c.grp and end_iid + 1 between q.a and q.b left join runs r on r.sample = c.sample and r.grp = c.grp and start_iid between r.a and r.b""")
def call_extension(spark, sf_dir):
    """Calls extended by the stretches of donor gain that hold their neighbours."""
    s = mp.residual_rows(mp.metric_rows(spark, sf_dir))
    calls = mp.run_segments(s).select("sample", "grp", "start_iid", "end_iid")
    run = intervals.runs(s, ["sample", "grp"], "iid", F.col("donor_residual") > 0)
    return intervals.extend(calls, run, ["sample", "grp"])


@query("""with c as (select o_custkey as k, date_diff('day', date '1995-01-01', o_orderdate::date) as pos, o_orderkey from orders), x as (select o_custkey as k, date_diff('day', date '1995-01-01', o_orderdate::date) as s, date_diff('day', date '1995-01-01', o_orderdate::date) + 30 as e from orders where o_orderstatus = 'F'),
w as (select *, max(e) over (partition by k order by s, e rows between unbounded preceding and 1 preceding) as far from x), i as (select *, sum(case when s > far then 1 else 0 end) over (partition by k order by s, e rows between unbounded preceding and current row) as i from w),
u as (select k, min(s) as s, max(e) as e from i group by k, i)
select c.k, c.o_orderkey, c.pos, coalesce(sum(greatest(0, least(c.pos, u.e) - u.s)), 0)::bigint as removed, (c.pos - coalesce(sum(greatest(0, least(c.pos, u.e) - u.s)), 0))::bigint as kept_pos from c left join u on u.k = c.k and u.s < c.pos group by c.k, c.o_orderkey, c.pos""")
def compressed_positions(spark, sf_dir):
    """Order days of each customer after the 30 days from each finished order are cut out."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    o = mp.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), day.alias("pos"), "o_orderkey", "o_orderstatus")
    cuts = o.filter("o_orderstatus = 'F'").select("k", F.col("pos").alias("start"), (F.col("pos") + 30).alias("stop"))
    return intervals.removed_before(o.drop("o_orderstatus"), cuts, ["k"])


@query()
def segments(spark, sf_dir):
    """Circular binary segmentation of every (sample, group) profile."""
    return segment.segments(mp.score_rows(mp.metric_rows(spark, sf_dir)), mp.PARAMS)


#: Steps of the planted profiles: group, first window, last window + 1, height; the rest of a profile is at 0.
STEPS = [("1", 60, 110, 60.0), ("2", 30, 70, -60.0), ("2", 150, 175, 60.0)]
_STEPS = ", ".join(f"('{g}', {a}, {b}, {h})" for g, a, b, h in STEPS)


@query(f"""with st(grp, a, b, h) as (values {_STEPS}), w as (select distinct l_linestatus as sample, (l_orderkey % 3)::varchar as grp, (l_orderkey // 3) % 250 as iid from lineitem),
l as (select w.*, coalesce(a, -1) as step from w left join st on st.grp = w.grp and iid >= a and iid < b), c as (select *, lag(step) over (partition by sample, grp order by iid) as before from l),
k as (select *, sum(case when before is null or before <> step then 1 else 0 end) over (partition by sample, grp order by iid rows unbounded preceding) as k from c)
select sample, grp, min(iid) as start_iid, max(iid) as end_iid, count(*) as n_windows from k group by sample, grp, k""")
def segment_steps(spark, sf_dir):
    """Change points of profiles with planted steps: mean quantities of order lines by window, with steps of several standard deviations."""
    li = mp.table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("sample"), (F.col("l_orderkey") % 3).cast("string").alias("grp"), F.expr("(l_orderkey div 3) % 250").alias("iid"), "l_quantity")
    step = F.lit(0.0)
    for g, a, b, h in STEPS:
        step = F.when((F.col("grp") == g) & (F.col("iid") >= a) & (F.col("iid") < b), h).otherwise(step)
    scores = li.groupBy("sample", "grp", "iid").agg(F.avg("l_quantity").alias("score")).withColumn("score", F.col("score") + step)
    return segment.segments(scores, mp.PARAMS).select("sample", "grp", "start_iid", "end_iid", "n_windows")


@query(f"with {CALLS} select sample, grp, start_iid, end_iid, width_bp, bin, length_bin, {r6('score_mean')} as score_mean, pass from calls")
def length_bins(spark, sf_dir):
    return mp.call_rows(spark, sf_dir).select("sample", "grp", "start_iid", "end_iid", "width_bp", "bin", "length_bin", "score_mean", "pass")


_FLOORS = ", ".join(f"({k}, '{label}', {f})" for k, (label, f) in enumerate(zip(calibrate.bin_labels(mp.PARAMS.bins_mb), mp.PARAMS.floors_multi, strict=True)))


@query(f"""with {CALLS}, p as (select bin, score_mean from calls where bin is not null), q as (select bin, quantile_cont(score_mean, 0.95) as q, count(*) as n_control from p group by bin),
z as (select bin, n_control, case when n_control >= 5 then quantile_cont(score_mean, 0.99) end as q99 from p join q using (bin) where score_mean <= q group by bin, n_control)
select 'multi' as mode, b.bin, length_bin, coalesce(n_control, 0) as n_control, {r6("q99")} as q99, {r6("greatest(f, q99)")} as threshold, {r6("0.01")} as fdr
from (values {_FLOORS}) as b(bin, length_bin, f) left join z using (bin)""")
def null_quantile_controls(spark, sf_dir):
    """Thresholds with every sample as a control."""
    c = mp.call_rows(spark, sf_dir)
    return calibrate.calibration(c, mp.PARAMS, "multi", c.select("sample"))


_OWN = CALLS + """, pool as (select bin, score_mean as x from calls where bin is not null union all select -1, score_mean from calls where score_mean is not null), pn as (select bin, x, count(*)::double as n from pool group by all)""" + em_sql("pn", "bin")
_OWN += f""", po as (select pool.bin, x, {_posterior("x")} < 0.5 as nul from pool join em on em.g = pool.bin),
pq as (select bin, count(*) as n, case when count(*) >= 5 and count(*) filter (nul) >= 5 then quantile_cont(x, 0.99) filter (nul) end as q from po group by bin),
pt as (select b.bin, b.length_bin, b.f, coalesce(n, 0) as n, coalesce(q, (select q from pq where bin = -1)) as q99 from (values {_FLOORS}) as b(bin, length_bin, f) left join pq using (bin))"""


@query(f"with recursive {_OWN} select 'multi' as mode, bin, length_bin, n as n_control, {r6('q99')} as q99, {r6('greatest(f, q99)')} as threshold, {r6('0.01')} as fdr from pt")
def null_quantile_own(spark, sf_dir):
    """Thresholds from the calls themselves, by mixtures."""
    return calibrate.calibration(saved(mp.call_rows(spark, sf_dir)), mp.PARAMS, "multi")


_FLOORS_SINGLE = ", ".join(f"({k}, '{label}', {f})" for k, (label, f) in enumerate(zip(calibrate.bin_labels(mp.PARAMS.bins_mb), mp.PARAMS.floors_single, strict=True)))
_Z99 = robust.normal_quantile(0.99, 0.0, 1.0)
_SINGLE = CALLS + """, pool as (select bin, score_mean as x from calls where bin is not null and score_mean is not null union all select -1, score_mean from calls where score_mean is not null), pn as (select bin, avg(x) as x, count(*)::double as n from pool group by bin, floor(x * 4096))""" + em_sql("pn", "bin")
_SINGLE += f""", po as (select pool.bin, x, least(m1, m2) as mu, case when m1 <= m2 then s1 else s2 end as sd, {_posterior("x")} < 0.5 as nul from pool join em on em.g = pool.bin),
pq as (select bin, count(*) as n, case when count(*) >= 5 then case when count(*) filter (nul) >= 5 then quantile_cont(x, 0.99) filter (nul) else mu + {_Z99} * sd end end as q from po group by bin, mu, sd),
pt as (select b.bin, b.length_bin, b.f, coalesce(n, 0) as n, coalesce(q, (select q from pq where bin = -1)) as q99 from (values {_FLOORS_SINGLE}) as b(bin, length_bin, f) left join pq using (bin))"""


@query(f"with recursive {_SINGLE} select 'single' as mode, bin, length_bin, n as n_control, {r6('q99')} as q99, {r6('greatest(f, q99)')} as threshold, {r6('0.01')} as fdr from pt")
def null_quantile_single(spark, sf_dir):
    """Thresholds as of a single sample: few values of the lower component take its normal quantile."""
    return calibrate.calibration(saved(mp.call_rows(spark, sf_dir)), mp.PARAMS, "single")


#: Samples that stand for controls.
CONTROLS = ("BUILDING", "FURNITURE", "HOUSEHOLD")


def _measured_sql(where: str, group: str) -> str:
    q = lambda c, p: f"quantile_cont({c}, {p}) filter ({where})"
    n = lambda c: f"count({c}) filter ({where})"
    ok = f"{n('donor_residual')} >= 5 and {n('recipient_residual')} >= 5"
    t = n("total_residual") + " >= 5"
    cut = {
        "donor_mod": f"greatest(0.5, {q('donor_residual', 0.95)})", "donor_high": f"greatest(1.0, {q('donor_residual', 0.95)}, {q('donor_residual', 0.99)})", "loss_mod": f"least(-0.5, {q('recipient_residual', 0.05)})",
        "loss_high": f"least(-1.0, {q('recipient_residual', 0.05)}, {q('recipient_residual', 0.01)})", "total_mod": f"case when {t} then greatest(0.5, {q('abs(total_residual)', 0.95)}) else 0.5 end",
        "total_high": f"case when {t} then greatest(1.0, {q('abs(total_residual)', 0.95)}, {q('abs(total_residual)', 0.99)}) else 1.0 end",
    }
    return f"select {group} as bin, {n('donor_residual')} as n, {ok} as ok, " + ", ".join(f"{c} as {k}" for k, c in cut.items()) + " from pool"


_SIX = ["donor_mod", "donor_high", "loss_mod", "loss_high", "total_mod", "total_high"]
_NEST = {
    "donor_mod": "greatest(0.5, b_donor_mod)", "donor_high": "greatest(1.0, 0.5, b_donor_mod, b_donor_high)", "loss_mod": "least(-0.5, b_loss_mod)", "loss_high": "least(-1.0, -0.5, b_loss_mod, b_loss_high)",
    "total_mod": "greatest(0.5, b_total_mod)", "total_high": "greatest(1.0, 0.5, b_total_mod, b_total_high)",
}
CUTS = (
    CALLS
    + f""", pool as (select *, sample in {CONTROLS} as control, coalesce(bin, -1) as b from calls),
loc as ({_measured_sql("control", "b")} group by b), glo as ({_measured_sql("control", "0")}), every as ({_measured_sql("true", "0")}),
whole as (select {", ".join(f"case when glo.ok then glo.{k} when every.ok then every.{k} else {d} end as g_{k}" for k, d in zip(_SIX, (0.5, 1.0, -0.5, -1.0, 0.5, 1.0), strict=True))} from glo, every),
bl as (select loc.*, whole.*, {", ".join(f"case when n >= 100 then {k} else n / (n + 20) * {k} + (1 - n / (n + 20)) * g_{k} end as b_{k}" for k in _SIX)} from loc, whole),
cuts as (select bin, case when ok then n else 0 end as n_control, {", ".join(f"case when ok then {_NEST[k]} else g_{k} end as {k}" for k in _SIX)} from bl)"""
)


def _controls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in CONTROLS], "sample string")


@query(f"with {CUTS} select 'multi' as mode, bin, n_control, {', '.join(r6(k) + f' as {k}' for k in _SIX)} from cuts")
def class_cutoffs(spark, sf_dir):
    """Cutoffs with three samples as controls."""
    return calibrate.cutoffs(saved(mp.call_rows(spark, sf_dir)), mp.PARAMS, _controls(spark))


CLASS_COLUMNS = ["sample", "grp", "start_iid", "end_iid", "pass", "class", "evidence", "total_evidence", "class_confidence", "class_status", "confidence", "copy_state", "compound", "component_status", "mappability_status"]


@query(f"with {CLASSIFIED} select {', '.join(CLASS_COLUMNS)} from k")
def classify_calls(spark, sf_dir):
    return classified(spark, sf_dir).select(*CLASS_COLUMNS)


@query(f"with {CUTS}, pc as (select calls.*, {', '.join(_SIX)} from calls join cuts on coalesce(calls.bin, -1) = cuts.bin){classified_sql('pc')} select {', '.join(CLASS_COLUMNS)} from k")
def classify_with_controls(spark, sf_dir):
    """Classes by the cutoffs of three control samples."""
    calls = saved(mp.call_rows(spark, sf_dir))
    return classify.classify(calls, mp.PARAMS, calibrate.cutoffs(calls, mp.PARAMS, _controls(spark))).select(*CLASS_COLUMNS)


def _calls_by(by: str) -> None:
    def f(spark, sf_dir):
        return summaries.calls_by(classified(spark, sf_dir), by)

    f.__name__ = f"calls_by_{by}"
    query(f"""with {CLASSIFIED} select sample, {by}, count(*) as n_calls, count(*) filter (pass) as n_pass, count(*) filter (class_confidence = 'high') as n_high, sum(width_bp)::bigint as total_bp, {r6("median(width_bp)")} as median_bp, {r6("avg(score_mean)")} as mean_score from k group by all""")(f)


for _by in ("class", "class_status", "copy_state", "grp"):
    _calls_by(_by)


@query(f"""with {CLASSIFIED} select class, count(*) as n, {r6("count(*) / sum(count(*)) over ()")} as share, coalesce(list_position(['substitution', 'addition', 'deletion', 'complex', 'other'], class), 6)::int as ord from k group by class""")
def class_totals(spark, sf_dir):
    return summaries.class_totals(classified(spark, sf_dir))


_COUNTS = ", ".join([*(f"count(*) filter (class = '{c}') as n_{c}" for c in summaries.CLASS_ORDER), *(f"count(*) filter (class_status = '{c}') as n_{c}" for c in ("confident", "ambiguous", "needs_review"))])
_ZERO = ", ".join(f"coalesce({c}, 0)::bigint as {c}" for c in ["n_calls", "n_pass", *(f"n_{c}" for c in summaries.CLASS_ORDER), "n_confident", "n_ambiguous", "n_needs_review", "groups_with_calls", "call_bp"])


@query(f"""with {CLASSIFIED}, r as (select sample, sum("count")::bigint as reads, sum("count") filter (role = 'donor')::bigint as donor_reads, sum("count") filter (role = 'recipient')::bigint as recipient_reads, count(*) as n_windows, count(distinct grp) as n_groups, avg(breadth) as mean_breadth, sum(length) as bp from m group by sample),
c as (select sample, count(*) as n_calls, count(*) filter (pass) as n_pass, {_COUNTS}, count(distinct grp) as groups_with_calls, sum(width_bp)::bigint as call_bp, max(width_bp) as max_call_bp, median(width_bp) as median_call_bp from k group by sample)
select sample, reads, donor_reads, recipient_reads, n_windows, n_groups, {r6("mean_breadth")} as mean_breadth, {_ZERO}, max_call_bp, {r6("median_call_bp")} as median_call_bp, {r6("reads / n_windows")} as reads_per_window, {r6("donor_reads / reads")} as donor_share,
  {r6("case when coalesce(n_calls, 0) > 0 then n_pass / n_calls end")} as pass_rate, {r6("coalesce(n_calls, 0) / n_groups")} as calls_per_group, {r6("coalesce(call_bp, 0) / bp")} as call_share from r left join c using (sample)""")
def cohort_summary(spark, sf_dir):
    m = mp.metric_rows(spark, sf_dir)
    return summaries.cohort_summary(m, classified(spark, sf_dir, mp.residual_rows(m)))


@query(f"with {CLASSIFIED} select sample, grp, start_iid, end_iid, class, class_status from k where pass and class in ('addition', 'substitution', 'other') and width_bp >= 5000000")
def explorer_filter(spark, sf_dir):
    c = classified(spark, sf_dir).withColumns({"recipient_assignment": F.lit("assigned"), "recipient_group": F.lit(None).cast("string")})
    return explore.explorer_filter(c, pass_only=True, classes=["addition", "substitution", "other"], min_width=5_000_000).select("sample", "grp", "start_iid", "end_iid", "class", "class_status")


@query(f"with {CLASSIFIED} select sample, grp, start_iid, end_iid, class from k where pass and class_status = 'confident'")
def confident_calls(spark, sf_dir):
    return explore.confident(classified(spark, sf_dir)).select("sample", "grp", "start_iid", "end_iid", "class")


@query(f"with {CLASSIFIED} select sample, grp, start_iid, end_iid, class from k where not (pass and class_status = 'confident')")
def review_calls(spark, sf_dir):
    return explore.review(classified(spark, sf_dir)).select("sample", "grp", "start_iid", "end_iid", "class")


@query(f"""with {CALLS}, i as (select *, unnest(generate_series(start_iid, end_iid)) as iid from calls), j as (select i.sample, i.grp, start_iid, end_iid, m.component, m.chr_id, s.score + ln(lambda_breadth + 1e-4) - ln(donor_mean + 1e-4) as v from i join s on s.sample = i.sample and s.grp = i.grp and s.iid = i.iid join m on m.sample = i.sample and m.grp = i.grp and m.iid = i.iid where m.role = 'donor'),
a as (select sample || '_' || grp || '_' || start_iid || '_' || end_iid as call_id, component, avg(v) as score_mean, median(v) as score_median, max(v) as score_max, avg((v > 0.5)::int) as supported_fraction, count(v) as n_windows, count(distinct chr_id) as n_contigs from j group by all)
select call_id, component, {r6("score_mean")} as score_mean, {r6("score_median")} as score_median, {r6("score_max")} as score_max, {r6("supported_fraction")} as supported_fraction, n_windows, n_contigs, supported_fraction >= 0.5 as supported, rank() over (partition by call_id order by score_mean desc)::int as "rank" from a""")
def component_evidence(spark, sf_dir):
    m = mp.metric_rows(spark, sf_dir)
    s = mp.residual_rows(m)
    return evidence.component_evidence(mp.run_segments(s), m, s, mp.PARAMS)


LAGS = ", ".join(f"sum(d * d{k}) as p{k}" for k in range(1, 11))
LAGC = ", ".join(f"lag(d, {k}) over (partition by sample, grp, start_iid order by iid) as d{k}" for k in range(1, 11))
RHO = " + ".join(f"coalesce(p{k}, 0)" for k in range(1, 11))


@query(f"""with {CALLS}, i as (select sample, grp, start_iid, unnest(generate_series(start_iid, end_iid)) as iid from calls), j as (select i.*, s.score as x, s.score - avg(s.score) over (partition by i.sample, i.grp, start_iid) as d from i join s using (sample, grp, iid)), l as (select *, {LAGC} from j),
a as (select sample, grp, start_iid, count(*) as n, avg(x) as mean, coalesce(stddev_samp(x), 0) as sd, sum(d * d) as v, {LAGS} from l group by all), e as (select *, case when n < 4 or sd = 0 then n::double else least(n, greatest(1.0, n / greatest(1.0, 1 + 2 * ({RHO}) / v))) end as n_eff from a),
f as (select *, case when n < 2 then 0 else sd / sqrt(n_eff) end as se from e)
select sample, grp, start_iid, n, {r6("mean")} as mean, {r6("se")} as se, {r6("mean - 1.645 * se")} as lower, {r6("case when se > 0 then mean / se end")} as z, {r6("n_eff")} as n_eff from f""")
def interval_stats(spark, sf_dir):
    """Mean, standard error and lower bound of the score inside calls."""
    s = mp.residual_rows(mp.metric_rows(spark, sf_dir))
    inside = mp.run_segments(s).select("sample", "grp", "start_iid", F.explode(F.sequence("start_iid", "end_iid")).alias("iid")).join(s.select("sample", "grp", "iid", "score"), ["sample", "grp", "iid"])
    return assign.interval_stats(inside, ["sample", "grp", "start_iid"], "score")


#: Recipient windows with what assignment reads: depletion against the median of the samples instead of a whole polish, so that SQL can say it.
DEPLETION = (
    CUTS
    + f""", dp as (select sample, chr_id, grp, iid, breadth, mapq_high_fraction, {mp.LENGTH} as contig_length, median(ln(lambda_breadth + 1e-6)) over (partition by chr_id, iid) - ln(lambda_breadth + 1e-6) as depletion,
  1 - exp(-median(lambda_breadth) over (partition by chr_id, iid)) as expected_breadth from m where role = 'recipient'),
prof as (select chr_id, grp, iid, median(depletion) as dep, coalesce(stddev_samp(depletion), 0) as spread from dp group by all),
names as (select chr_id, grp as chr_grp, row_number() over (order by chr_id) as j from (select distinct chr_id, grp from prof)),
wd as (select distinct grp, end_iid - start_iid + 1 as width from calls),
pl0 as (select wd.grp, width, b, names.*, ((b - 1) * 37 + (j - 1) * 101) % ({mp.N} - width + 1) as f from wd cross join names cross join (select unnest(generate_series(1, 64)) as b)),
pl as (select p.grp, p.width, p.b, p.chr_id, p.chr_grp = p.grp as same, avg(dep) - 1.645 * avg(spread) / sqrt(count(*)) + max(case when p.chr_grp = p.grp then 1.0 else 0.0 end) as value
  from pl0 p join prof on prof.chr_id = p.chr_id and prof.iid >= f and prof.iid < f + p.width group by all)"""
)


def _depletion(m: DataFrame) -> DataFrame:
    w = Window.partitionBy("chr_id", "iid")
    r = m.filter("role = 'recipient'").withColumn("_l", F.log(F.col("lambda_breadth") + 1e-6))
    r = r.withColumns({"depletion": F.median("_l").over(w) - F.col("_l"), "expected_breadth": 1 - F.exp(-F.median("lambda_breadth").over(w)), "masked": F.lit(False), "contig_length": F.lit(mp.LENGTH).cast("long")})
    return saved(r.select("sample", "chr_id", "grp", "iid", "breadth", "mapq_high_fraction", "contig_length", "depletion", "expected_breadth", "masked"))


def _for_assignment(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Calls, depletions, class cutoffs and null thresholds."""
    m = mp.metric_rows(spark, sf_dir)
    r = _depletion(m)
    calls = saved(mp.call_rows(spark, sf_dir, mp.residual_rows(m)))
    cuts = saved(calibrate.cutoffs(calls, mp.PARAMS, _controls(spark)))
    calls = saved(classify.classify(calls, mp.PARAMS, cuts))
    return calls, r, cuts, saved(assign.null_thresholds(calls, assign.null_profile(r), mp.N))


@query(f"with {DEPLETION} select chr_id, grp, iid, {r6('dep')} as dep, {r6('spread')} as spread from prof")
def null_profile(spark, sf_dir):
    """Depletion of recipient windows over the samples: median and deviation."""
    return assign.null_profile(_depletion(mp.metric_rows(spark, sf_dir)))


@query(f"with {DEPLETION} select grp, width::int as width, b::int as permutation, chr_id, same, {r6('value')} as value from pl")
def null_placement(spark, sf_dir):
    """The width of every call of a group placed 64 times on every recipient contig, by the fixed rule."""
    m = mp.metric_rows(spark, sf_dir)
    calls = mp.call_rows(spark, sf_dir, mp.residual_rows(m))
    widths = calls.select("grp", (F.col("end_iid") - F.col("start_iid") + 1).alias("width"))
    return assign.null_placements(widths, saved(assign.null_profile(_depletion(m))), mp.N).withColumn("width", F.col("width").cast("int"))


NULLS = (
    DEPLETION
    + """, bb as (select grp, width, b, max(value) as best, list_reverse_sort(list(value))[2] as second, max(value) filter (same) as own, max(value) filter (not same) as other from pl group by all),
nw as (select grp, width, count(best) as n_null, quantile_cont(best, 0.95) as min_depletion, quantile_cont(best, 0.99) as strong_depletion, greatest(0, quantile_cont(best - second, 0.95)) as assignment_margin,
  greatest(0, quantile_cont(other - own, 0.99)) as cross_margin, (select greatest(0.5, quantile_cont(dep, 0.95)) from prof) as run_threshold from bb group by all having count(best) >= 20),
nc as (select coalesce(bin, -1) as bin, nw.* from calls join nw on nw.grp = calls.grp and nw.width = end_iid - start_iid + 1),
"""
    + "nb as (select bin, count(*) as k, sum(n_null)::bigint as n_null, " + ", ".join(f"median({t}) as {t}" for t in assign.THRESHOLDS) + " from nc group by bin), ng as (select " + ", ".join(f"median({t}) as g_{t}" for t in assign.THRESHOLDS) + " from nc),"
    + "nt as (select bin, n_null, " + ", ".join(f"k / (k + 20) * {t} + (1 - k / (k + 20)) * g_{t} as {t}" for t in assign.THRESHOLDS) + " from nb, ng)"
)


@query(f"with {NULLS} select 'multi' as mode, bin, n_null, {', '.join(r6(t) + f' as {t}' for t in assign.THRESHOLDS)} from nt")
def null_thresholds(spark, sf_dir):
    """What random placement reaches, by length bin."""
    return _for_assignment(spark, sf_dir)[3]


_CAND = ["call_id", "chr_id", "n", "mean", "lower", "run_found", "run_start_iid", "run_end_iid", "donor_fraction", "run_fraction", "overlap", "width_penalty", "reliable", "strong", "score"]


@query(f"""with {NULLS}, ins as (select call_id, calls.sample, calls.grp as cg, start_iid, end_iid, start_bp, end_bp, width_bp, nt.*, dp.* exclude (sample) from calls join nt on nt.bin = coalesce(calls.bin, -1) join dp on dp.sample = calls.sample and dp.iid between start_iid and end_iid),
dd as (select *, depletion - avg(depletion) over (partition by call_id, chr_id) as d from ins), ll as (select *, {", ".join(f"lag(d, {k}) over (partition by call_id, chr_id order by iid) as d{k}" for k in range(1, 11))} from dd),
st as (select call_id, sample, chr_id, grp, cg, start_iid, end_iid, start_bp, end_bp, width_bp, min_depletion, strong_depletion, run_threshold, count(*) as n, avg(depletion) as mean, coalesce(stddev_samp(depletion), 0) as sd, sum(d * d) as v, {LAGS}, avg(expected_breadth) as eb, bool_or(depletion > run_threshold) as run_found from ll group by all),
ef as (select *, case when n < 4 or sd = 0 then n::double else least(n, greatest(1.0, n / greatest(1.0, 1 + 2 * ({RHO}) / v))) end as ne from st),
lo as (select *, mean - 1.645 * case when n < 2 then 0 else sd / sqrt(ne) end as lower from ef),
rr as (select distinct run_threshold as t, dp.sample, dp.chr_id, dp.iid, dp.iid - row_number() over (partition by run_threshold, dp.sample, dp.chr_id order by dp.iid) as i from (select distinct run_threshold from nt) join dp on depletion > run_threshold),
rs as (select t, sample, chr_id, min(iid) as a, max(iid) as b from rr group by t, sample, chr_id, i),
ex as (select lo.*, case when run_found then coalesce(p.a, start_iid) else start_iid end as run_start_iid, case when run_found then coalesce(q.b, end_iid) else end_iid end as run_end_iid from lo
  left join rs p on p.t = run_threshold and p.sample = lo.sample and p.chr_id = lo.chr_id and start_iid - 1 between p.a and p.b left join rs q on q.t = run_threshold and q.sample = lo.sample and q.chr_id = lo.chr_id and end_iid + 1 between q.a and q.b),
ty as (select sample, median(breadth) as typical from dp group by sample),
fr as (select ex.*, typical, width_bp / {mp.GROUP_BP} as df, (run_end_iid + 1 - run_start_iid) / {mp.N} as rf, start_bp / {mp.GROUP_BP} as ds, end_bp / {mp.GROUP_BP} as de from ex join ty using (sample)),
pn as (select *, case when df >= 0.95 and rf >= 0.95 then 0 when df >= 0.95 or rf >= 0.95 then -8 else -2 * abs(ln(df / rf)) end as width_penalty, greatest(0, ds - 1 / {mp.N}) as d0, least(1, de + 1 / {mp.N}) as d1, greatest(0, run_start_iid / {mp.N} - 1 / {mp.N}) as r0, least(1, (run_end_iid + 1) / {mp.N} + 1 / {mp.N}) as r1,
  eb >= greatest(0.001, 0.1 * typical) and lower >= min_depletion and not (df >= 0.95 and rf < 0.95) as reliable from fr),
cd as (select *, df as donor_fraction, rf as run_fraction, greatest(0, least(d1, r1) - greatest(d0, r0)) / greatest(d1 - d0, r1 - r0) as overlap, reliable and run_found and eb >= 0.002 and lower >= strong_depletion as strong, case when reliable then lower + (grp = cg)::int + width_penalty else -1e6 end as score from pn)
select {", ".join(r6(c) + f" as {c}" if c in ("mean", "lower", "donor_fraction", "run_fraction", "overlap", "width_penalty", "score") else c for c in _CAND)} from cd""")
def host_candidates(spark, sf_dir):
    """Calls against all recipient contigs of their samples, with the null's thresholds."""
    calls, r, cuts, null = _for_assignment(spark, sf_dir)
    return assign.candidates(assign.with_thresholds(calls, mp.PARAMS, null, cuts), r, mp.N, mp.PARAMS).select(*_CAND)


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, r, cuts, null = _for_assignment(spark, sf_dir)
    return assign.assign_hosts(calls, r, mp.N, mp.PARAMS, null, cuts)


@query("""with e as (select l_linestatus || l_linenumber as sample, l_partkey as call, l_returnflag as contig, sum(l_quantity) as gain from lineitem where l_returnflag in ('A', 'R') group by all),
t as (select * from e qualify row_number() over (partition by sample, contig order by gain desc, call) <= 2),
p as (select a.sample, 2 as n, a.gain + r.gain as total from t a join t r on a.sample = r.sample and a.contig = 'A' and r.contig = 'R' and a.call <> r.call union all select sample, 1, gain from t)
select sample, max_by(n, total) as n_hosts, max(total) as total from p group by sample""")
def host_matching(spark, sf_dir):
    """The best one-to-one matching of parts and two return flags by quantity; two rights make it small enough for SQL."""
    li = mp.table(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'R')")
    edges = saved(li.groupBy(F.concat("l_linestatus", F.col("l_linenumber").cast("string")).alias("sample"), F.col("l_partkey").alias("left"), F.col("l_returnflag").alias("right")).agg(F.sum("l_quantity").alias("gain")))
    got = matching.best_matching(edges, ["sample"])
    return got.join(edges, ["sample", "left", "right"]).groupBy("sample").agg(F.count(F.lit(1)).alias("n_hosts"), F.sum("gain").alias("total"))


@query()
def assign_hosts(spark, sf_dir):
    """Calls with their host contigs (grouped-map matching)."""
    return _assigned(spark, sf_dir).select("call_id", "class", "class_status", "copy_state", "recipient_assignment", "recipient_chr", "assignment_score", "assignment_margin", "assignment_weight", "runner_up")


@query()
def alternatives(spark, sf_dir):
    """Assigned calls that have a runner-up."""
    return explore.alternatives(_assigned(spark, sf_dir)).select("call_id", "recipient_chr", "runner_up", "runner_up_score", "assignment_margin")


@query("""with recursive o0 as (select o_custkey as k, o_orderkey, date_diff('day', date '1995-01-01', o_orderdate::date) as s, o_totalprice as w from orders),
o1 as (select *, row_number() over (partition by k order by s, w) as i from o0), o as (select *, (select count(*) from o1 p where p.k = o1.k and p.s + 29 < o1.s) as before from o1),
best(k, i, b) as (select distinct k, 0::bigint, [0.0::double] from o union all select o.k, o.i, list_append(b, case when o.w > 0 then greatest(o.w + b[before + 1], b[o.i]) else b[o.i] end) from best join o on o.k = best.k and o.i = best.i + 1),
full_ as (select k, b, i as n from best qualify i = max(i) over (partition by k)),
back(k, i, taken) as (select k, n, 0::bigint from full_ union all select o.k, case when o.w > 0 and o.w + f.b[before + 1] >= f.b[o.i] then before else o.i - 1 end, case when o.w > 0 and o.w + f.b[before + 1] >= f.b[o.i] then o.i else 0 end from back join o on o.k = back.k and o.i = back.i join full_ f on f.k = o.k)
select o.k, o_orderkey, s as start, s + 29 as "end", w as weight from o join (select k, taken from back where taken > 0) t on t.k = o.k and t.taken = o.i""")
def select_non_overlapping(spark, sf_dir):
    """Of each customer's orders as 30-day intervals, those that don't overlap and are worth most."""
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long")
    o = mp.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", day.alias("start"), (day + 29).alias("end"), F.col("o_totalprice").alias("weight"))
    return intervals.select_non_overlapping(o, ["k"], "start", "end", "weight")


@query(f"""with a as (select n_regionkey as assembly, n_name as id, 1000 + n_nationkey as length from nation), h as (select n_name as name, 1000 + n_nationkey + case when count(*) % 2 = 0 then 0 else 1 end as l from supplier join nation on s_nationkey = n_nationkey group by n_name, n_nationkey)
select assembly, count(*) as n_targets, count(*) filter (l = length) as n_matched, count(*) filter (l is null) as n_missing, count(*) filter (l <> length) as n_mismatch, {r6("count(*) filter (l = length) / count(*)")} as score, count(*) filter (l = length) = count(*) as exact from a left join h on id = name group by assembly""")
def header_match(spark, sf_dir):
    """Nations as contigs of their regions against the nations of suppliers, some of another length."""
    n, header = _nations(spark, sf_dir)
    return registry.header_match(header, n.select(F.col("species").alias("assembly"), "id", "length"))


def _nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = mp.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("species"), F.col("n_name").alias("id"), (1000 + F.col("n_nationkey")).cast("long").alias("length"), "n_nationkey")
    s = mp.table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("id").alias("name"), F.col("length").alias("_b")).agg(F.count(F.lit(1)).alias("c"))
    return n.drop("n_nationkey"), s.select("name", (F.col("_b") + F.col("c") % 2).alias("length"))


@query(f"""with a as (select n_regionkey as sp, n_name as id, 1000 + n_nationkey as length from nation), h as (select n_name as name, 1000 + n_nationkey + count(*) % 2 as l from supplier join nation on s_nationkey = n_nationkey group by n_name, n_nationkey),
s as (select sp, count(*) as t, count(*) filter (l = length) as k from a left join h on id = name group by sp having count(l) > 0)
select r.sp as recipient, d.sp as donor, r.t + d.t as n_targets, r.k + d.k as n_matched, {r6("(r.k + d.k) / (r.t + d.t)")} as score, r.k + d.k = r.t + d.t as exact from s r join s d on r.sp <> d.sp""")
def species_pairs(spark, sf_dir):
    n, header = _nations(spark, sf_dir)
    return registry.species_pairs(header, n)


@query("""with p as (select p_partkey, p_brand || ' ' || p_size as name, regexp_extract_all(p_brand || ' ' || p_size, '(\\d+|\\D+)') as t from part)
select p_partkey, name, array_to_string([case when regexp_matches(x, '^\\d+$') then lpad(regexp_replace(x, '^0+([0-9])', '\\1'), 20, '0') else lower(x) end for x in t], chr(1)) as key from p""")
def natural_sort(spark, sf_dir):
    """Parts by brand and size with the key that sorts digit runs as numbers."""
    p = mp.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("name"))
    return p.withColumn("key", fn.natural_key("name")).orderBy(*fn.natural_order("name"))


@query("""select g, row_number() over (order by try_cast(g as int) nulls last, g)::int as ord from (select distinct case when p_size % 2 = 0 then p_size::varchar else p_brand end as g from part)""")
def group_order(spark, sf_dir):
    g = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    d = mp.table(spark, sf_dir, "part").select(g.alias("g")).distinct()
    return d.withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*fn.group_order("g"))))


@query(f"""with {CALLS}, hb as (select sample, grp, iid * 40 // {mp.N} as bin, avg(score) as score from s group by all), i as (select distinct sample, grp, unnest(generate_series(start_iid, end_iid)) as iid from calls)
select hb.sample, hb.grp, bin, {r6("score")} as score from hb where exists (select 1 from i where i.sample = hb.sample and i.grp = hb.grp and i.iid = floor((bin + 0.5) * {mp.N} / 40))""")
def heatmap_bins(spark, sf_dir):
    s = mp.residual_rows(mp.metric_rows(spark, sf_dir))
    return intervals.heat_bins(s.select("sample", "grp", "iid", "score"), mp.run_segments(s), ["sample", "grp"], mp.N, 40)


@query(f"""with {METRICS} select grp, role, count(breadth) as n, {", ".join(r6(f"quantile_cont(breadth, {p})") + f" as {k}" for p, k in ((0.005, "low"), (0.25, "q1"), (0.5, "median"), (0.75, "q3"), (0.995, "high")))} from m group by all""")
def box_stats(spark, sf_dir):
    return summaries.box_stats(mp.metric_rows(spark, sf_dir), ["grp", "role"], "breadth")


@query(f"""with {SCORES} select sample, grp, count(*) as n_windows, count(score) as n_finite, {r6("avg(score)")} as mean_score, {r6("median(score)")} as median_score, {r6("stddev_samp(score)")} as sd_score, {r6("max(score)")} as max_score, count(*) filter (score > 0.5) as n_positive from s group by all""")
def scores_summary(spark, sf_dir):
    return summaries.scores_summary(mp.score_rows(mp.metric_rows(spark, sf_dir)))


@query(f"with {SCORES} select {r6('greatest(0.5, quantile_cont(abs(score), 0.99))')} as score_limit from s")
def display_limit(spark, sf_dir):
    return summaries.display_limit(mp.score_rows(mp.metric_rows(spark, sf_dir)))


@query(f"""with {METRICS}, c as (select sample, chr_id, avg(breadth) as b from m group by all), t as (select *, median(b) over (partition by sample) as t from c) select sample, chr_id, {r6("b")} as mean_breadth from t where b < 0.9 and b < 1.0 * t""")
def thin_contigs(spark, sf_dir):
    """Contigs below the sample's typical breadth."""
    return metrics.deleted_contigs(mp.metric_rows(spark, sf_dir), 0.9, 1.0)


@query(f"""with {CLASSIFIED}, u as (select sample, grp, sum(width_bp) as covered, min(start_bp) as f from k where pass and class in ('addition', 'substitution', 'complex') group by all) select sample, grp, covered::bigint as covered, {r6("covered / 260000000")} as share from u where covered / 260000000 >= 0.2""")
def covered_groups(spark, sf_dir):
    """Groups of which passing gains cover a fifth."""
    lengths = mp.group_lengths(spark, sf_dir)
    return payload.covered_groups(classified(spark, sf_dir), lengths, 0.2, None)


@query("""with d as (select doc_id, ((length(text) % 40) + 5)::varchar || 'M' || ((doc_id % 7) + 1)::varchar || 'D' || ((doc_id % 11) + 3)::varchar || 'M' || ((doc_id % 5) + 1)::varchar || 'N' || '20M3S' as cigar, n_chars as pos, length(text) % 40 + 5 as a, doc_id % 7 + 1 as d, doc_id % 11 + 3 as b, doc_id % 5 + 1 as n from documents)
select doc_id, cigar, pos as s, pos + a as e from d union all select doc_id, cigar, pos + a + d, pos + a + d + b from d union all select doc_id, cigar, pos + a + d + b + n, pos + a + d + b + n + 20 from d""")
def cigar_blocks(spark, sf_dir):
    """Blocks of alignments whose operations follow from each document's length and number."""
    d = mp.table(spark, sf_dir, "documents")
    n = lambda c: c.cast("string")
    cigar = F.concat(n(F.length("text") % 40 + 5), F.lit("M"), n(F.col("doc_id") % 7 + 1), F.lit("D"), n(F.col("doc_id") % 11 + 3), F.lit("M"), n(F.col("doc_id") % 5 + 1), F.lit("N20M3S"))
    d = d.select("doc_id", cigar.alias("cigar"), F.col("n_chars").alias("pos"))
    return d.withColumn("b", F.explode(fn.cigar_blocks("cigar", "pos"))).select("doc_id", "cigar", F.col("b.s").alias("s"), F.col("b.e").alias("e"))


@query("""with d as (select doc_id, text, length(text) as l from documents where length(text) >= 10), w as (select doc_id, text, l, unnest(generate_series(0, 9)) as iid from d), s as (select doc_id, iid, upper(substr(text, (iid * l // 10 + 1)::int, ((iid + 1) * l // 10 - iid * l // 10)::int)) as b from w)
select doc_id as chr_id, iid, (round(length(regexp_replace(b, '[^GC]', '', 'g'))::float / length(b)::float, 6) + 0.0)::double as gc from s""")
def window_gc(spark, sf_dir):
    """G and C in ten windows of each text, with the texts as sequences."""
    d = mp.table(spark, sf_dir, "documents").filter(F.length("text") >= 10)
    c = d.select(F.col("doc_id").alias("chr_id"), F.length("text").cast("long").alias("length"))
    return metrics.base_composition(d.select(F.col("doc_id").alias("chr_id"), F.lit(0).cast("long").alias("offset"), F.col("text").alias("bases")), c, 10)


@query(f"""with {CLASSIFIED}, sc as (select sample, grp, string_agg(coalesce(round(score, 3)::decimal(12, 3)::varchar, ''), ',' order by iid) as scores from res group by all),
ca as (select sample, grp, string_agg(start_iid || '-' || end_iid || ':' || class || ':' || class_status, ',' order by start_iid) as calls from k group by all)
select sample, grp, {mp.N} as n_windows, scores, calls from sc left join ca using (sample, grp)""")
def chromosome_records(spark, sf_dir):
    """Scores and calls nested by sample and group, here as text."""
    s = mp.residual_rows(mp.metric_rows(spark, sf_dir))
    r = payload.records(s, classified(spark, sf_dir, s), mp.N)
    text = F.transform("scores", lambda x: F.coalesce(F.round(x, 3).cast("decimal(12,3)").cast("string"), F.lit("")))
    calls = F.transform("calls", lambda c: F.concat(c["start_iid"].cast("string"), F.lit("-"), c["end_iid"].cast("string"), F.lit(":"), c["class"], F.lit(":"), c["class_status"]))
    return r.select("sample", "grp", "n_windows", F.array_join(text, ",").alias("scores"), F.array_join(calls, ",").alias("calls"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads to cohort summary: metrics, pair scores, gap merge, classes, one row per sample."""
    return QUERIES["cohort_summary"](spark, sf_dir)
