"""Registered queries of ingest, checks, resolution, read side and exports, on the driver's tables, with their SQL.

Alignment and header text comes from order lines, nations, suppliers and parts, written as tab-separated lines and parsed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covertile import functions as fn
from covertile import schemas
from covertile.operators import assign, classify, evidence, explore, intervals, metrics, payload, reads, registry, robust, scoring, summaries, tiling
from covertile.plans import mapping as mp
from covertile.plans.queries import CALLS, CLASSIFIED, MASKED, METRICS, RESIDUALS, SCORES, classified, query, r6
from covertile.plans.tables import saved, scratch
from covertile.sources import ranges, readers, writers

_W = mp.LENGTH // mp.N


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return mp.table(spark, sf_dir, name)


def _line(*fields: str | Column) -> Column:
    return F.concat_ws("\t", *(F.lit(f) if isinstance(f, str) else f for f in fields))


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# ---- alignments

SAM = """sam as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as qname, case when l_returnflag = 'A' and l_linenumber = 1 then 1024 when l_linestatus = 'F' then 16 else 0 end as flag,
  'chr' || l_suppkey % 7 as rname, date_diff('day', date '1995-01-01', l_shipdate::date) * 1000 + l_orderkey % 1000 as pos, round(l_discount * 1000)::int as mapq, l_quantity::bigint as q, 'rg' || l_linenumber as rg from lineitem)"""


def sam_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, value): order lines as alignment lines."""
    li = _table(spark, sf_dir, "lineitem")
    pos = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")).cast("long") * 1000 + F.col("l_orderkey") % 1000
    flag = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), 1024).when(F.col("l_linestatus") == "F", 16).otherwise(0)
    name = F.concat_ws("-", *(_text(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")))
    value = _line(name, _text(flag), F.concat(F.lit("chr"), _text(F.col("l_suppkey") % 7)), _text(pos + 1), _text(F.round(F.col("l_discount") * 1000).cast("int")), F.concat(_text(F.col("l_quantity").cast("long")), F.lit("M")), "*", "0", "0", "*", "*", F.concat(F.lit("RG:Z:rg"), _text("l_linenumber")))
    return li.select(F.lit("lines.sam").alias("path"), value.alias("value"))


@query(f"with {SAM} select qname, flag, rname, pos, mapq, q || 'M' as cigar, rg from sam where mapq >= 20 and flag & 1796 = 0")
def sam_alignments(spark, sf_dir):
    """Alignment lines parsed, then without duplicates and low qualities."""
    return reads.passing(readers.alignments(sam_text(spark, sf_dir)), 20).select("qname", "flag", "rname", "pos", "mapq", "cigar", "rg")


@query(f"with {SAM} select qname, flag, rname, pos, mapq, q || 'M' as cigar, rg from sam where rname in ('chr2', 'chr5')")
def contig_reads(spark, sf_dir):
    """Alignment lines of two contigs from sorted files, of which only the contigs' byte ranges are opened."""
    folder = scratch(spark)
    names = spark.range(7).select(F.concat(F.lit("chr"), _text("id")).alias("name"), F.lit(mp.LENGTH).alias("length"), F.col("id").alias("ord"))
    writers.write_alignments(sam_text(spark, sf_dir), names, folder)
    lines = ranges.on_contigs(spark, folder).filter(F.col("rname").isin("chr2", "chr5"))
    return readers.alignments(lines).select("qname", "flag", "rname", "pos", "mapq", "cigar", "rg")


@query("""with d as (select doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as s from documents where text is not null), l as (select doc_id, s, length(s) as l from d where length(s) >= 10),
w as (select *, unnest(generate_series(0, 9)) as iid from l), p as (select doc_id, iid, substr(s, (iid * l // 10 + 1)::int, ((iid + 1) * l // 10 - iid * l // 10)::int) as b from w)
select 'd' || doc_id as chr_id, iid, round((length(regexp_replace(b, '[^GC]', '', 'g'))::float / length(b)::float)::double, 6) as gc from p""")
def sequence_gc(spark, sf_dir):
    """G and C in ten windows of sequences that were written as FASTA, in lines of 60, and read again."""
    folder = scratch(spark)
    d = _table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), _text("doc_id")).alias("chr_id"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s")).filter("length(s) >= 10")
    d.select(F.concat(F.lit(">"), "chr_id", F.lit("\n"), F.regexp_replace("s", "(.{60})(?=.)", "$1\n")).alias("value")).write.text(folder)
    lines = saved(readers.fasta(spark, folder))
    lengths = lines.groupBy("chr_id").agg(F.sum(F.length("bases")).cast("long").alias("length"))
    return metrics.base_composition(lines, lengths, 10)


@query(f"with {SAM} select rname as chr_id, case when flag & 16 <> 0 then pos + q - 1 else pos end as pos, count(*) as n from sam where mapq >= 20 and flag & 2308 = 0 group by all")
def five_prime_ends(spark, sf_dir):
    """Reads by contig and 5' end."""
    return reads.five_prime(reads.passing(readers.alignments(sam_text(spark, sf_dir)), 20, reads.RANGE_MASK)).groupBy("chr_id", "pos").agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {SAM}, e as (select rname as chr_id, case when flag & 16 <> 0 then pos + q - 1 else pos end as pos from sam where mapq >= 20 and flag & 2308 = 0),
r as (select p_partkey as range_id, 'chr' || p_size % 7 as chr_id, floor(p_retailprice * 1000)::bigint as start, floor(p_retailprice * 1000)::bigint + 20000 as stop from part)
select r.*, coalesce(n, 0) as n from r left join (select range_id, count(*) as n from r join e on r.chr_id = e.chr_id and e.pos >= r.start and e.pos < r.stop group by range_id) using (range_id)""")
def count_reads(spark, sf_dir):
    """Reads whose 5' end lies in ranges made of parts."""
    lo = F.floor(F.col("p_retailprice") * 1000)
    r = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("range_id"), F.concat(F.lit("chr"), _text(F.col("p_size") % 7)).alias("chr_id"), lo.alias("start"), (lo + 20_000).alias("stop"))
    return reads.count_reads(readers.alignments(sam_text(spark, sf_dir)), r).select("range_id", "chr_id", "start", "stop", "n")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header lines of read groups: one for each line number, a sample for each of three."""
    g = _table(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    return g.select(F.lit("lines.sam").alias("path"), _line("@RG", F.concat(F.lit("ID:rg"), _text("l_linenumber")), F.when(F.col("l_linenumber") < 7, F.concat(F.lit("SM:S"), _text(F.col("l_linenumber") % 3)))).alias("value"))


@query(f"with {SAM} select case when rg = 'rg7' then 'lines' else 'S' || replace(rg, 'rg', '')::int % 3 end as sample, count(*) as reads, sum(q)::bigint as bases from sam where case when rg = 'rg7' then 'lines' else 'S' || replace(rg, 'rg', '')::int % 3 end <> 'S2' group by all")
def reads_by_sample(spark, sf_dir):
    """Reads with the samples of their read groups; a group without a sample takes the file's name; one sample is not asked for."""
    g = readers.read_groups(_groups(spark, sf_dir)).select("rg", "sample", (F.col("sample") != "S2").alias("requested"))
    r = reads.with_sample(readers.alignments(sam_text(spark, sf_dir)), g)
    return r.groupBy("sample").agg(F.count(F.lit(1)).alias("reads"), F.sum(fn.aligned_bases("cigar")).alias("bases"))


@query("select distinct 'lines.sam' as path, case when l_linenumber = 7 then 'lines' else 'S' || l_linenumber % 3 end as sample, (select count(distinct case when l_linenumber = 7 then 'lines' else 'S' || l_linenumber % 3 end) from lineitem) as n_samples, null::varchar as warning from lineitem")
def sample_catalogue(spark, sf_dir):
    """A file as a row for each of its samples."""
    files = _groups(spark, sf_dir).select("path").distinct()
    return readers.sample_catalogue(files, readers.read_groups(_groups(spark, sf_dir)))


def _first_reads() -> str:
    return "select sample, stop - start as read_length from (select *, row_number() over (partition by sample order by chr_id, iid, start, read) as r from pieces) where r = 1"


@query(f"with {METRICS} {_first_reads()}")
def read_length(spark, sf_dir):
    """The length of each sample's first read, by contig, window and position."""
    p = mp.pieces(spark, sf_dir).withColumns({"aligned": F.col("stop") - F.col("start"), "ord": F.col("chr_id"), "read_pos": F.col("start")})
    return reads.read_length(p)


@query("select s_name as name, 1000 + s_nationkey as length from supplier")
def header_targets(spark, sf_dir):
    """Suppliers as @SQ lines, parsed."""
    s = _table(spark, sf_dir, "supplier")
    lines = s.select(F.lit("a.sam").alias("path"), _line("@SQ", F.concat(F.lit("SN:"), "s_name"), F.concat(F.lit("LN:"), _text(1000 + F.col("s_nationkey")))).alias("value"))
    return readers.header_targets(lines).select("name", "length")


@query("select 'n' || s_nationkey as name, count(*) as times from supplier group by s_nationkey having count(*) > 1")
def duplicate_targets(spark, sf_dir):
    s = _table(spark, sf_dir, "supplier")
    lines = s.select(F.lit("a.sam").alias("path"), _line("@SQ", F.concat(F.lit("SN:n"), _text("s_nationkey")), "LN:5").alias("value"))
    return readers.duplicate_targets(readers.header_targets(lines)).select("name", "times")


@query("select p_partkey::varchar as id, p_brand as name, p_size::varchar as version, 'make: ' || p_type as command from part")
def header_programs(spark, sf_dir):
    """Parts as @PG lines, parsed; values may hold colons."""
    p = _table(spark, sf_dir, "part")
    lines = p.select(F.lit("a.sam").alias("path"), _line("@PG", F.concat(F.lit("ID:"), _text("p_partkey")), F.concat(F.lit("PN:"), "p_brand"), F.concat(F.lit("VN:"), _text("p_size")), F.concat(F.lit("CL:make: "), "p_type")).alias("value"))
    return readers.programs(lines).select("id", "name", "version", "command")


# ---- contig lists and registry

LISTS = """cl as (select 'l' || s_nationkey as list, s_suppkey as ord, case when s_suppkey % 9 = 0 then 'shared' else s_name end as name, case when s_suppkey % 11 = 0 then 0 else 1000 + s_suppkey end as length from supplier),
lists as (select *, coalesce(sum(length) over (partition by list order by ord rows between unbounded preceding and 1 preceding), 0) + case when ord % 10 = 3 then 1 else 0 end as "offset" from cl)"""


def _lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    c = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("l"), _text("s_nationkey")).alias("list"), k.alias("ord"), F.when(k % 9 == 0, "shared").otherwise(F.col("s_name")).alias("name"), F.when(k % 11 == 0, 0).otherwise(1000 + k).alias("length"))
    before = F.coalesce(F.sum("length").over(Window.partitionBy("list").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return c.withColumn("offset", before + F.when(F.col("ord") % 10 == 3, 1).otherwise(0))


@query(f"""with {LISTS}, w as (select *, coalesce(sum(length) over (partition by list order by ord rows between unbounded preceding and 1 preceding), 0) as want, count(*) over (partition by list, name) as times from lists)
select list, 'duplicate' as rule, name as key from w where times > 1 union all select list, 'length', name from w where not length > 0 union all select list, 'offset', name from w where "offset" <> want""")
def contig_list_rules(spark, sf_dir):
    """Rows of contig lists that break a rule; the lists are suppliers, some spoilt."""
    return tiling.offset_violations(_lists(spark, sf_dir))


@query(f"with {LISTS} select name, count(distinct list) as lists from lists group by name having count(distinct list) > 1")
def names_in_several_lists(spark, sf_dir):
    return tiling.shared_between_lists(_lists(spark, sf_dir))


@query(f"""with {LISTS}, a as (select list, count(*) as n, sum(length) as b from lists group by list), mf as (select 'l' || n_nationkey as list, (select count(*) from supplier where s_nationkey = n_nationkey) + n_nationkey % 2 as num, (select sum(length) from lists where list = 'l' || n_nationkey) as total from nation)
select coalesce(a.list, mf.list) as list, 'num_contigs' as rule from a full join mf on a.list = mf.list where n is distinct from num union all select coalesce(a.list, mf.list), 'total_bases' from a full join mf on a.list = mf.list where b is distinct from total""")
def list_totals(spark, sf_dir):
    """Lists that differ from their manifest; every second nation's manifest counts one contig too many."""
    c = saved(_lists(spark, sf_dir))
    have = c.groupBy("list").agg(F.count(F.lit(1)).alias("k"), F.sum("length").alias("total_bases"))
    m = _table(spark, sf_dir, "nation").select(F.concat(F.lit("l"), _text("n_nationkey")).alias("list"), (F.col("n_nationkey") % 2).alias("odd")).join(have, "list", "left")
    return readers.totals(c, m.select("list", (F.coalesce("k", F.lit(0)) + F.col("odd")).alias("num_contigs"), "total_bases"))


CONTIGS = """ct as (select r_name as species, n_name as id, n_name || (n_nationkey % 4) as name, case when n_nationkey % 2 = 0 then 'A' else 'B' end as component, case when n_nationkey % 3 = 0 then null else 'g' || n_nationkey % 5 end as grp,
  case when n_nationkey % 5 = 0 then null else n_nationkey % 3 + 1.0 end::double as copy_number, (1000 + n_nationkey)::bigint as length from nation join region on n_regionkey = r_regionkey)"""


def _contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("species"), F.col("n_name").alias("id"), F.concat("n_name", _text(n % 4)).alias("name"), F.when(n % 2 == 0, "A").otherwise("B").alias("component"), F.when(n % 3 != 0, F.concat(F.lit("g"), _text(n % 5))).alias("grp"),
        F.when(n % 5 != 0, (n % 3 + 1.0)).cast("double").alias("copy_number"), (1000 + n).cast("long").alias("length"),
    )


TARGETS = CONTIGS + """, tg as (select *  replace (coalesce(grp, regexp_extract(name, '([0-9]+)', 1)) as grp, coalesce(copy_number, 2.0) as copy_number), case species when 'EUROPE' then 'recipient' else 'donor' end as role,
  row_number() over (partition by species order by id) + case species when 'EUROPE' then 0 else 1073741824 end as ord from ct where species in ('EUROPE', 'ASIA'))"""


@query(f"with {TARGETS} select id, role, grp, component, copy_number, length, ord from tg")
def species_targets(spark, sf_dir):
    """The contigs of a species pair, with group, role and order; checked for shared contigs and lengths."""
    return registry.resolve_pair(_contigs(spark, sf_dir), "EUROPE", "ASIA", 1, 10_000).select("id", "role", "grp", "component", "copy_number", "length", "ord")


@query(f"with {TARGETS}, rp as (select grp, id as recipient_id from tg where role = 'recipient' qualify row_number() over (partition by grp order by ord) = 1) select tg.grp, tg.id as donor_id, recipient_id from tg join rp using (grp) where role = 'donor'")
def group_pairs(spark, sf_dir):
    return tiling.pair_groups(tiling.targets(_contigs(spark, sf_dir), "EUROPE", "ASIA")).select("grp", "donor_id", "recipient_id")


@query(f"with {TARGETS} select id, case role when 'donor' then 'no recipient in group' else 'no donor in group' end as reason from tg where not exists (select 1 from tg o where o.grp = tg.grp and o.role <> tg.role)")
def unpaired_contigs(spark, sf_dir):
    return tiling.unpaired(tiling.targets(_contigs(spark, sf_dir), "EUROPE", "ASIA"))


@query(f"with {CONTIGS} select species, count(*) as n_contigs, count(distinct grp) as n_groups, sum(length)::bigint as total_length, string_agg(distinct component, ';' order by component) as components from ct group by species")
def species_catalogue(spark, sf_dir):
    return tiling.catalogue(_contigs(spark, sf_dir))


@query(f"with {CONTIGS} select species, component, 'copy_number' as rule from ct group by all having count(distinct copy_number) > 1 union all select distinct species, component, 'group' from (select species, component, grp from ct group by all having count(*) > 1)")
def inconsistent_contigs(spark, sf_dir):
    return tiling.inconsistent(_contigs(spark, sf_dir))


REFERENCE = "rf as (select n_name as id, 1000 + n_nationkey + count(*) % 2 as ref_length from customer join nation on c_nationkey = n_nationkey where n_nationkey % 7 <> 3 group by n_name, n_nationkey)"


def _reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "nation").filter("n_nationkey % 7 <> 3")
    c = _table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "n_nationkey").agg(F.count(F.lit(1)).alias("k"))
    return c.select(F.col("n_name").alias("id"), (1000 + F.col("n_nationkey") + F.col("k") % 2).alias("length"))


@query(f"with {CONTIGS}, {REFERENCE} select id, case when ref_length is null then 'missing' else 'mismatch' end as reason from ct left join rf using (id) where ref_length is null or ref_length <> length")
def length_violations(spark, sf_dir):
    """Contigs that a reference lacks or has in another length."""
    return tiling.attach_lengths(_contigs(spark, sf_dir), _reference(spark, sf_dir))[1]


@query(f"with {CONTIGS} select id, species, 'l_' || species as source from ct")
def routed_contigs(spark, sf_dir):
    """The composition source of each contig."""
    c = _contigs(spark, sf_dir)
    return tiling.route(c.select("id", "species"), c.select(F.col("id").alias("name"), F.concat(F.lit("l_"), "species").alias("list")))


@query("select r as resolution, count(*) as n_contigs, sum(case when l >= r then r else 0 end)::bigint as n_windows, count(*) filter (l < r) as n_short from (select s_suppkey % 6000 + 1 as l from supplier) cross join (values (100), (1000), (5000)) as v(r) group by r")
def resolution_report(spark, sf_dir):
    return tiling.too_short(_table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 6000 + 1).alias("length")), [100, 1000, 5000])


def _header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contigs(spark, sf_dir).filter("species in ('EUROPE', 'ASIA')").select(F.col("id").alias("name"), "length")


@query(f"with {CONTIGS} select species as assembly, count(*) as n_targets, 1.0::double as score, true as found from ct where species in ('EUROPE', 'ASIA') group by species order by count(*) desc, species limit 1")
def most_specific_assembly(spark, sf_dir):
    """The exact match with most targets; one species more is a subset of it, so there is no tie."""
    c = _contigs(spark, sf_dir)
    reg = c.select(F.col("species").alias("assembly"), "id", "length")
    one = reg.filter("assembly = 'EUROPE'").withColumn("_n", F.row_number().over(Window.partitionBy("assembly").orderBy("id"))).filter("_n = 1")
    m = registry.header_match(_header(spark, sf_dir), reg.filter("assembly <> 'EUROPE'").unionByName(one.drop("_n").withColumn("assembly", F.lit("part of EUROPE"))))
    return registry.most_specific(m)


@query(f"with {CONTIGS}, s as (select species, count(*) as t from ct where species in ('EUROPE', 'ASIA') group by species) select r.species as recipient, d.species as donor, r.t + d.t as n_targets, r.t + d.t as n_matched, 1.0::double as score, true as exact from s r join s d on r.species = 'ASIA' and d.species = 'EUROPE'")
def chosen_pair(spark, sf_dir):
    """The exact pair of the present donor."""
    return registry.choose_pair(registry.species_pairs(_header(spark, sf_dir), _contigs(spark, sf_dir).select("species", "id", "length")), donor="EUROPE")


@query("""with rk as (select c_custkey as row_id, n_name as name, case when c_custkey % 3 = 0 then 'NO ' || n_name else n_name end as id, c_nationkey % 5 as grp from customer join nation on c_nationkey = n_nationkey),
t as (select n_name as id, n_name as name, n_nationkey % 5 as grp, n_regionkey as value from nation where n_nationkey % 4 <> 1),
h as (select row_id, value, 0 as level from rk join (select distinct id, value from t) x using (id) union all select row_id, value, 1 from rk join (select distinct name, grp, value from t) x using (name, grp) union all select row_id, value, 2 from rk join (select distinct grp, value from t) x using (grp)),
b as (select distinct row_id, value, level from h qualify level = min(level) over (partition by row_id)) select rk.*, b.value, b.level from rk left join b using (row_id)""")
def resolved_keys(spark, sf_dir):
    """Customers by id, else name and group, else group; ties give several rows."""
    n = _table(spark, sf_dir, "nation")
    rows = _table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("row_id"), F.col("n_name").alias("name"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("NO "), "n_name")).otherwise(F.col("n_name")).alias("id"), (F.col("c_nationkey") % 5).alias("grp"))
    t = n.filter("n_nationkey % 4 <> 1").select(F.col("n_name").alias("id"), F.col("n_name").alias("name"), (F.col("n_nationkey") % 5).alias("grp"), F.col("n_regionkey").alias("value"))
    return registry.resolve_key(rows, t, [["id"], ["name", "grp"], ["grp"]], "value")


# ---- checks of inputs and metrics

@query("select rule, value from (select count(*) as n, sum(floor(o_totalprice))::bigint as b from orders), lateral (select 'files' as rule, n as value where n > 1 union all select 'bytes', b where b > 1000)")
def preflight_limits(spark, sf_dir):
    """Orders as inputs: too many, and too large."""
    return readers.preflight_limits(_table(spark, sf_dir, "orders").select(F.floor("o_totalprice").alias("bytes")), 1, 1000)


@query("select o_orderkey::varchar as path, o_orderpriority as own, o_orderstatus as sample_source, o_totalprice as file_size from orders")
def input_provenance(spark, sf_dir):
    """Inputs with what their run says about them, by path."""
    o = _table(spark, sf_dir, "orders")
    inputs = o.select(_text("o_orderkey").alias("path"), F.col("o_orderpriority").alias("own"))
    return readers.input_rows(inputs, o.select(_text("o_orderkey").alias("path"), F.lit("other").alias("own"), F.col("o_orderstatus").alias("sample_source"), F.col("o_totalprice").alias("file_size")))


_RULES = {
    "name": "chr_id is null or sample is null", "window": "not iid between 0 and 20", "coordinates": "start < 0 or stop <= start", "count": "\"count\" < 0 or mapq_high > \"count\"", "covered": "covered < 0 or covered > length", "gc": "not gc between 0 and 1",
}


@query("with v as (select l_orderkey::varchar as sample, nullif(l_linestatus, 'F') as chr_id, l_linenumber * 4 as iid, l_partkey % 3 - 1 as start, l_partkey % 4 as stop, l_linenumber - 2 as \"count\", 1 as mapq_high, l_quantity::bigint as covered, 45 as length, l_discount * 11 as gc from lineitem) " + " union all ".join(f"select '{k}' as rule, sample, chr_id, iid from v where {c}" for k, c in _RULES.items()))
def metric_violations(spark, sf_dir):
    """Order lines as metrics, most of them spoilt."""
    li = _table(spark, sf_dir, "lineitem")
    v = li.select(_text("l_orderkey").alias("sample"), F.nullif("l_linestatus", F.lit("F")).alias("chr_id"), (F.col("l_linenumber") * 4).alias("iid"), (F.col("l_partkey") % 3 - 1).alias("start"), (F.col("l_partkey") % 4).alias("stop"), (F.col("l_linenumber") - 2).alias("count"), F.lit(1).alias("mapq_high"), F.col("l_quantity").cast("long").alias("covered"), F.lit(45).alias("length"), (F.col("l_discount") * 11).alias("gc"))
    return metrics.violations(v, 21)


@query(f"with {METRICS}, a as (select sample, role, sum(\"count\")::bigint as reads, count(*) as windows from m group by all) select *, case when reads <= 0 then 'no reads' else 'few reads' end as warning from a where reads < 40 * windows")
def coverage_warnings(spark, sf_dir):
    """Sides with fewer than 40 reads a window."""
    return metrics.coverage_warnings(mp.metric_rows(spark, sf_dir), 40.0)


@query(f"with {METRICS} select component, case component when 'F' then 0.0 else 2.0 end::double as copies from m where role = 'recipient' group by component")
def composition(spark, sf_dir):
    return scoring.composition(mp.metric_rows(spark, sf_dir), {"F": 0.0})


@query(f"with {METRICS} select m.sample, m.grp, m.iid, {r6('avg(lambda_breadth)')} as recipient_mean, count(*) as n_recipient from m where role = 'recipient' and component = 'O' group by all")
def recipient_of_composition(spark, sf_dir):
    """Recipient depths without the component whose copy number is set to zero."""
    m = mp.metric_rows(spark, sf_dir)
    return scoring.recipient_side(m, mp.PARAMS, scoring.composition(m, {"F": 0.0})).select("sample", "grp", "iid", "recipient_mean", "n_recipient")


@query(f"with {SCORES} select sample, grp, iid, iid * {_W} as start, (iid + 1) * {_W} as stop from s")
def group_coordinates(spark, sf_dir):
    m = mp.metric_rows(spark, sf_dir)
    return scoring.group_coordinates(mp.score_rows(m), m, mp.N).select("sample", "grp", "iid", "start", "stop")


POLISHED = METRICS + """, rl as (select sample, chr_id, iid, ln(greatest(lambda_breadth, 0) + 1e-6) as y, 1 - exp(-median(lambda_breadth) over (partition by chr_id, iid)) as expected_breadth from m where role = 'recipient'),
pp(it, sample, chr_id, iid, expected_breadth, v) as (select 0, sample, chr_id, iid, expected_breadth, y from rl union all select it + 1, sample, chr_id, iid, expected_breadth, a - median(a) over (partition by sample) from (select *, v - median(v) over (partition by chr_id, iid) as a from pp) where it < 30)"""


@query(f"with recursive {POLISHED} select sample, chr_id, iid, (round(-v, 3) + 0.0) as depletion, {r6('expected_breadth')} as expected_breadth, false as masked from pp where it = 30")
def recipient_residuals(spark, sf_dir):
    """Recipient windows' depletion, polished over the samples (here to three digits)."""
    r = assign.recipient_residuals(mp.metric_rows(spark, sf_dir), mp.PARAMS)
    return r.select("sample", "chr_id", "iid", (F.round("depletion", 3) + F.lit(0.0)).alias("depletion"), "expected_breadth", "masked")


# ---- the read side of calls

#: Calls with made-up hosts: the class says the label, the next group is the host's.
HOSTED = CLASSIFIED + """, ho as (select *, case class when 'deletion' then 'cross_group' when 'complex' then 'no_recipient_loss' else 'assigned' end as recipient_assignment, case when class = 'deletion' then grp || '+' end as recipient_group from k)"""


def _hosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classified(spark, sf_dir)
    return c.withColumns({"recipient_assignment": F.when(F.col("class") == "deletion", "cross_group").when(F.col("class") == "complex", "no_recipient_loss").otherwise("assigned"), "recipient_group": F.when(F.col("class") == "deletion", F.concat("grp", F.lit("+")))})


@query(f"with {HOSTED} select call_id, case when recipient_assignment = 'cross_group' then recipient_group else grp end as display_group, recipient_assignment = 'no_recipient_loss' as unplaced from ho")
def display_groups(spark, sf_dir):
    return explore.display_group(_hosted(spark, sf_dir)).select("call_id", "display_group", explore.unplaced().alias("unplaced"))


@query(f"with {HOSTED} select call_id from ho where (grp in ('ASIA', 'EUROPE+') or recipient_group in ('ASIA', 'EUROPE+')) and copy_state in ('gain', 'loss') and class_confidence in ('high', 'moderate') and class_status <> 'needs_review' and recipient_assignment <> 'no_recipient_loss'")
def explorer_choices(spark, sf_dir):
    """Calls by group, copy state, confidence and status, placed ones only."""
    c = explore.explorer_filter(_hosted(spark, sf_dir), groups=["ASIA", "EUROPE+"], copy_states=["gain", "loss"], confidences=["high", "moderate"], statuses=["confident", "ambiguous"], show_unplaced=False)
    return c.select("call_id")


@query(f"with {HOSTED} select call_id, class from ho where grp in (select r_name from region where r_regionkey < 2)")
def rendered_calls(spark, sf_dir):
    """Calls whose id is in another table."""
    c = saved(_hosted(spark, sf_dir))
    few = c.join(_table(spark, sf_dir, "region").filter("r_regionkey < 2").select(F.col("r_name").alias("grp")), "grp", "left_semi").select("call_id")
    return explore.rendered(c, few).select("call_id", "class")


@query(f"with {CALLS} select call_id, {r6('start_bp / 260000000')} as start_frac, {r6('end_bp / 260000000')} as end_frac from calls")
def call_fractions(spark, sf_dir):
    return payload.fractions(mp.call_rows(spark, sf_dir), mp.group_lengths(spark, sf_dir), mp.N).select("call_id", "start_frac", "end_frac")


@query(f"with {CLASSIFIED} select call_id, evidence like '%donor%' as donor, evidence like '%recipient%' as recipient from k")
def evidence_flags(spark, sf_dir):
    return classified(spark, sf_dir).select("call_id", classify.donor_supported().alias("donor"), classify.recipient_supported().alias("recipient"))


@query(f"with {CALLS} select call_id from calls where pass and start_iid = 0 and width_bp / 260000000 >= 0.1")
def full_chromosomes(spark, sf_dir):
    """Passing calls from the start that cover a tenth of their group; lengths of groups that a table lacks come from another."""
    lengths = mp.group_lengths(spark, sf_dir)
    c = mp.call_rows(spark, sf_dir).withColumn("class", F.lit("addition"))
    return explore.full_chromosome(c, lengths.filter("grp <> 'ASIA'"), 0.1, lengths).select("call_id")


@query(f"""with {CALLS}, dc as (select call_id, donor_component, count(*) as n from calls join s on s.sample = calls.sample and s.grp = calls.grp and s.iid between start_iid and end_iid group by all)
select call_id, donor_component from dc qualify row_number() over (partition by call_id order by n desc, donor_component) = 1""")
def dominant_component(spark, sf_dir):
    s = mp.residual_rows(mp.metric_rows(spark, sf_dir))
    return evidence.dominant_component(mp.call_rows(spark, sf_dir, s), s).select("call_id", "donor_component")


@query(f"with {CLASSIFIED}, sw as (select sample, count(*) as n_windows, avg((score is null)::int) as masked_fraction from res group by sample) select sample, n_windows, {r6('masked_fraction')} as masked_fraction, coalesce(n_calls, 0) as n_calls, coalesce(n_high, 0) as n_high_confidence from sw left join (select sample, count(*) as n_calls, count(*) filter (class_confidence = 'high') as n_high from k group by sample) using (sample)")
def run_counters(spark, sf_dir):
    s = mp.residual_rows(mp.metric_rows(spark, sf_dir))
    return summaries.run_counters(s, classified(spark, sf_dir, s))


@query(f"with {RESIDUALS} select sample, grp, iid, side, {r6('residual')} as residual from (unpivot (select sample, grp, iid, donor_residual, recipient_residual, total_residual from res) on donor_residual, recipient_residual, total_residual into name side value residual)")
def residual_long(spark, sf_dir):
    return summaries.residual_long(mp.residual_rows(mp.metric_rows(spark, sf_dir)), ["donor_residual", "recipient_residual", "total_residual"])


@query("""with r as (select distinct c_mktsegment as sample, n_name as grp from customer join nation on c_nationkey = n_nationkey where n_regionkey < 3), d as (select distinct c_mktsegment as sample, n_name as grp from customer join nation on c_nationkey = n_nationkey where n_nationkey % 2 = 0),
w as (select distinct c_mktsegment as sample, n_name as grp from customer join nation on c_nationkey = n_nationkey where n_nationkey % 3 = 0), p as (select distinct c_mktsegment as sample, n_name as grp from customer join nation on c_nationkey = n_nationkey where n_nationkey > 10)
select sample, grp, 'deleted' as state from (select * from r intersect select * from d) union all select sample, grp, 'added' from w union all select sample, grp, 'partial' from (select * from p except select * from w)""")
def chromosome_states(spark, sf_dir):
    """Deleted, whole and partial groups by set operations."""
    c = saved(_table(spark, sf_dir, "customer").join(F.broadcast(_table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("sample"), F.col("n_name").alias("grp"), "n_regionkey", "n_nationkey").distinct())
    return payload.states(c.filter("n_regionkey < 3"), c.filter("n_nationkey % 2 = 0"), c.filter("n_nationkey % 3 = 0"), c.filter("n_nationkey > 10"))


@query("""with it as (select distinct c_mktsegment as sample, case n_nationkey % 4 when 3 then 'added' when 2 then 'unplaced' else 'recipient' end as kind, n_nationkey::varchar as grp, case when n_nationkey % 8 = 3 then (n_nationkey - 3)::varchar end as replaces from customer join nation on c_nationkey = n_nationkey),
an as (select distinct sample, grp, dense_rank() over (partition by sample order by grp::int) as a from it where kind = 'recipient'), j as (select it.*, a + case when kind = 'recipient' or replaces is not null then 0.0 when kind = 'added' then 0.5 else 0.6 end as p from it left join an on an.sample = it.sample and an.grp = coalesce(replaces, it.grp))
select sample, kind, grp, replaces, row_number() over (partition by sample order by p nulls last, grp, kind)::int as position from j""")
def display_order(spark, sf_dir):
    """Recipients in order of numbers, donors after or in place of them."""
    k = F.col("c_nationkey")
    it = _table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("sample"), F.when(k % 4 == 3, "added").when(k % 4 == 2, "unplaced").otherwise("recipient").alias("kind"), _text(k).alias("grp"), F.when(k % 8 == 3, _text(k - 3)).alias("replaces")).distinct()
    return payload.ordered(it)


@query("""with p as (select c_custkey as k, o_orderkey, (date_diff('day', date '1995-01-01', o_orderdate::date) * 24)::bigint as pos from orders join customer on o_custkey = c_custkey), x as (select o_custkey as k, date_diff('day', date '1995-01-01', o_orderdate::date) * 24 as s from orders where o_orderstatus = 'F'),
c as (select k, s, max(s + 240) over (partition by k order by s rows between unbounded preceding and 1 preceding) as far from x), i as (select *, sum(case when s > far then 1 else 0 end) over (partition by k order by s rows unbounded preceding) as i from c), u as (select k, min(s) as s, max(s) + 240 as e from i group by k, i),
cum as (select *, coalesce(sum(e - s) over (partition by k order by s rows between unbounded preceding and 1 preceding), 0) as before from u)
select p.k, o_orderkey, (pos + coalesce(max(before + e - s) filter (s - before <= pos), 0))::bigint as original from p left join cum on cum.k = p.k group by p.k, o_orderkey, pos""")
def restored_positions(spark, sf_dir):
    """Order hours of each customer as positions after cuts, moved back to where they were before."""
    hour = F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).cast("long") * 24
    o = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", hour.alias("kept_pos"), "o_orderstatus")
    cuts = o.filter("o_orderstatus = 'F'").select("k", F.col("kept_pos").alias("start"), (F.col("kept_pos") + 240).alias("stop"))
    return intervals.restored(o.drop("o_orderstatus"), cuts, ["k"]).select("k", "o_orderkey", "original")


# ---- exports

EXPORT = CLASSIFIED + f""", xp as (select *, grp || '_donor_F' as donor_chr, grp || '_recipient_F' as recipient_chr, start_iid * {_W} as a, (end_iid + 1) * {_W} as b from k)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.tile(mp.contigs(spark, sf_dir), mp.N)


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).withColumns({"recipient_assignment": F.when(F.col("class") == "complex", "no_recipient_loss").otherwise("assigned"), "donor_component": F.lit("F"), **{c: F.lit(None).cast(t) for c, t in (("recipient_chr", "string"), ("recipient_start_iid", "long"), ("recipient_end_iid", "long"))}})


_HOSTLESS = "class = 'complex'"


@query(f"""with {EXPORT} select sample, donor_chr as chr_id_don, a as start_don, b as stop_don, case when not {_HOSTLESS} then recipient_chr end as chr_id_rec, case when not {_HOSTLESS} then a end as start_rec, case when not {_HOSTLESS} then b end as stop_rec, width_bp, {r6('score_mean')} as score_mean, class, class_status, copy_state, "pass", 'cbs' as method, mode_ as mode, (select count(*) from (values {", ".join(f"({i})" for i in range(len(writers.BEDPE_COLUMNS)))})) as n_columns
from (select *, 'multi' as mode_ from xp)""")
def bedpe(spark, sf_dir):
    """Donor and recipient intervals of calls, as exported; the export has 48 columns."""
    b = writers.bedpe(_exported(spark, sf_dir), _windows(spark, sf_dir))
    names = ["sample", "chr_id.don", "start.don", "stop.don", "chr_id.rec", "start.rec", "stop.rec", "width_bp", "score_mean", "class", "class_status", "copy_state", "pass", "method", "mode"]
    return b.select(*(F.col(f"`{c}`").alias(c.replace(".", "_")) for c in names), F.lit(len(b.columns)).cast("long").alias("n_columns"))


@query(f"with {EXPORT} select concat_ws(chr(9), donor_chr, a, b, class || '|' || class_status || '|' || case when pass then 'pass' else 'fail' end, '0', '.') as line from xp union all select concat_ws(chr(9), recipient_chr, a, b, class || '|' || class_status || '|' || case when pass then 'pass' else 'fail' end, '0', '.') from xp where not {_HOSTLESS}")
def bed_tracks(spark, sf_dir):
    rows = saved(writers.interval_rows(_exported(spark, sf_dir), _windows(spark, sf_dir)))
    return writers.bed(rows, 1).unionByName(writers.bed(rows, 2))


@query(f"with recursive {MASKED} select concat_ws(chr(9), 'group_' || grp, iid * {_W}, (iid + 1) * {_W}, 'mask', greatest(0, least(1000, round_even(posterior * 1000, 0)))::int, '.') as line from mask where mask")
def mask_bed(spark, sf_dir):
    from covertile.operators import mask

    m = mp.metric_rows(spark, sf_dir)
    k = mask.recurrence_mask(mp.score_rows(m), m)
    return writers.mask_bed(k.drop("start", "stop"), k.select("grp", "iid", "start", "stop"))


@query(f"with {METRICS} select sample, chr_id, start, stop, {r6('breadth')} as breadth from m")
def breadth_bedgraph(spark, sf_dir):
    """Breadth with six decimals, as text and back."""
    return writers.bedgraph(mp.metric_rows(spark, sf_dir)).withColumn("breadth", F.col("breadth").cast("double"))


@query(f"with {SCORES} select sample as sample_name, grp as chromosome_group, iid as window_index, {r6('score')} as introgression_score, {r6('donor_mean')} as mean_donor_coverage from s")
def exported_scores(spark, sf_dir):
    """Scores under their export names."""
    s = mp.score_rows(mp.metric_rows(spark, sf_dir))
    out = s.withColumnsRenamed({k: v for k, v in writers.QC_NAMES["scores"].items() if k in s.columns})
    return out.select("sample_name", "chromosome_group", "window_index", "introgression_score", "mean_donor_coverage")


@query("""with f as (select distinct p_name as sample, trim(regexp_replace(p_name, '[^A-Za-z0-9._-]+', '-', 'g'), '-.') as f from part), n as (select sample, case when f = '' then 'sample' else f end as f from f), r as (select *, row_number() over (partition by lower(f) order by sample) + case when lower(f) in ('run', 'qc') then 1 else 0 end as n from n),
m as (select *, f || '-' || n as m from r) select sample, case when n = 1 then f when exists (select 1 from r o where o.n = 1 and lower(o.f) = lower(m.m)) then m || '-' else m end as folder from m""")
def sample_folders(spark, sf_dir):
    """Parts' names as folders."""
    return writers.sample_folders(_table(spark, sf_dir, "part").select(F.col("p_name").alias("sample")))


@query(f"with {CLASSIFIED} select call_id, sample, grp, mode, start_iid, n_windows, {r6('score_mean')} as score_mean, class, null::varchar as runner_up from (select *, 'multi' as mode from k)")
def conformed_calls(spark, sf_dir):
    """Calls brought to their declared schema, missing columns as NULL."""
    return schemas.conform(classified(spark, sf_dir), schemas.CALLS).select("call_id", "sample", "grp", "mode", "start_iid", "n_windows", "score_mean", "class", "runner_up")


@query(f"with {CLASSIFIED} select sample, grp, class, copy_state, class_status, start_bp, end_bp, width_bp, pass from k")
def brief_calls(spark, sf_dir):
    """The columns that a table of calls shows at first."""
    return writers.brief_calls(classified(spark, sf_dir))


@query(f"""with {METRICS}, t as (select sample, sum("count") as n from m group by sample)
select count(*) as samples, count(*) filter (n <= 0) as empty_samples, min(sample) filter (n <= 0) as first_empty from t""")
def run_coverage(spark, sf_dir):
    """The guard of the whole run: samples, and those without a read."""
    return metrics.run_coverage(mp.metric_rows(spark, sf_dir))


@query(f"with {METRICS} select sample, median(b) as b from (select sample, grp, {r6('avg(breadth)')} as b from m group by all) group by sample")
def typical_breadth(spark, sf_dir):
    """Each sample's median group breadth."""
    g = mp.metric_rows(spark, sf_dir).groupBy("sample", "grp").agg(F.round(F.avg("breadth"), 6).alias("b"))
    return g.groupBy("sample").agg(F.median("b").alias("b"))


@query(f"with {RESIDUALS} select sample, grp, iid, {r6('v - median(v) over (partition by sample, grp)')} as donor_mean from (select sample, grp, iid, ln(donor_mean + 1e-4) as v from res)")
def median_centred(spark, sf_dir):
    s = mp.score_rows(mp.metric_rows(spark, sf_dir)).withColumn("donor_mean", F.log(F.col("donor_mean") + 1e-4))
    return robust.median_centred(s, ["sample", "grp"], "donor_mean").select("sample", "grp", "iid", "donor_mean")


@query("select o_orderkey, case when v >= 1e6 then printf('%.1f Mb', v / 1e6) when v >= 1e3 then printf('%.1f kb', v / 1e3) else printf('%.0f bp', v) end as width, regexp_replace(o_orderpriority, '[^0-9]', '', 'g') as first from (select *, floor(o_totalprice)::bigint * 10 + 3 as v from orders)")
def text_of_numbers(spark, sf_dir):
    """Prices as lengths in words (whole numbers that end on 3, so none is halfway), and the first number of a priority."""
    o = _table(spark, sf_dir, "orders").withColumn("v", F.floor("o_totalprice") * 10 + 3)
    return o.select("o_orderkey", fn.bp_text("v").alias("width"), fn.first_number("o_orderpriority").alias("first"))


@query("""select l_orderkey, l_linenumber, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '+0000' as started_at, epoch(l_shipdate) - epoch(o_orderdate) as duration_secs from lineitem join orders on l_orderkey = o_orderkey""")
def run_times(spark, sf_dir):
    """Order and shipping time of each line as a run's start and duration."""
    j = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select("l_orderkey", "l_linenumber", fn.iso_text(F.col("o_orderdate").cast("timestamp")).alias("started_at"), fn.seconds_between("o_orderdate", "l_shipdate").alias("duration_secs"))


@query("""with t as (select l_orderkey, l_linenumber, l_discount, l_discount - 0.05 as d, case when l_linenumber % 3 = 0 then null else l_orderkey * 10 + 3 end as a, case when l_linenumber % 5 = 0 then null else l_orderkey * 1000 + 103 end as b from lineitem),
w as (select *, case when a >= 1e6 then printf('%.1f Mb', a / 1e6) when a >= 1e3 then printf('%.1f kb', a / 1e3) else printf('%.0f bp', a::double) end as wa, case when b >= 1e6 then printf('%.1f Mb', b / 1e6) when b >= 1e3 then printf('%.1f kb', b / 1e3) else printf('%.0f bp', b::double) end as wb from t)
select l_orderkey, l_linenumber, printf('%.0f', round(100 * l_discount)) || '%' as share, case when d > 0 then '+' else '' end || printf('%.3f', d) as shift,
  case when a is not null and b is not null then wa || ' – ' || wb when a is not null then 'from ' || wa when b is not null then 'to ' || wb else '' end as span from w""")
def text_of_calls(spark, sf_dir):
    """Fractions, signed differences and spans in words; no number is halfway."""
    t = _table(spark, sf_dir, "lineitem").withColumns({"a": F.when(F.col("l_linenumber") % 3 != 0, F.col("l_orderkey") * 10 + 3), "b": F.when(F.col("l_linenumber") % 5 != 0, F.col("l_orderkey") * 1000 + 103)})
    return t.select("l_orderkey", "l_linenumber", fn.percent_text("l_discount").alias("share"), fn.signed_text(F.col("l_discount") - 0.05, 3).alias("shift"), fn.span_text("a", "b").alias("span"))
