"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertile.llm import ann, bpe, chat, debruijn, decontam, jaccard, langid, periodic, secrets, sharding, substrings, toxicity, trie
from covertile.llm.common import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    prototypes = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), prototypes)


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 100 == 0), k=10)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels.filter(~held_out(F.col("doc_id")))))
    return toxicity.score(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"), 40)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), path, public_tokenizers.PATTERN)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("longest")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(_table(spark, sf_dir, "documents"))


def op10_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select cast(-7 as bigint) as conv_id, turn, role, '{said}' as text from values (cast(0 as bigint), 'user'), (cast(1 as bigint), 'assistant') as t(turn, role)")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.report(rows.unionByName(extra))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(periodic.planted(_table(spark, sf_dir, "documents")))


def op12_burst_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, conversations = trie.rebuilt(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie.nodes(rows, conversations)


def op13_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return debruijn.report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_collision_counting": op2_collision_counting,
    "op3_secret_scan": op3_secret_scan,
    "op4_toxicity": op4_toxicity,
    "op5_virtual_slots": op5_virtual_slots,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_decontamination": op8_decontamination,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_reply_trees": op10_reply_trees,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_burst_trie": op12_burst_trie,
    "op13_debruijn_dedup": op13_debruijn_dedup,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Equal texts are one: their sets, or their windows, are made once.
JACCARD_SQL = rf"""
with recursive t as (select {_LOWER} as t, min(doc_id) as d from documents group by 1),
w as (select t, d, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from t),
sh as (select distinct d, unnest(case when len(w) = 0 then [] when len(w) < 4 then [hash(array_to_string(w, ' '), len(w))] else [hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3], 4) for i in generate_series(1, len(w) - 3)] end) as s from w),
n as (select d, count(*) as n from sh group by d),
e as (select d, s, n from sh join n using (d)),
p as (select a.d as a, b.d as b, a.n as an, b.n as bn, count(*) as c from e a join e b on a.s = b.s and a.d < b.d and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by all),
l as materialized (select a, b from p where 100 * c >= 85 * (an + bn - c) union select b, a from p where 100 * c >= 85 * (an + bn - c)),
r(d, c) as (select d, d from n union select l.b, r.c from r join l on l.a = r.d),
c as (select d, min(c) as c from r group by d)
select doc_id, coalesce(n, 0) as n_shingles, coalesce(c.c, doc_id) as component_id from documents join t on t.t = {_LOWER} left join n using (d) left join c using (d)"""
DECONTAMINATION_SQL = rf"""
with t as (select {_LOWER} as t from documents group by 1), w as (select t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from t),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(10, len(w)) as size, unnest(case when len(w) = 0 then [] when len(w) < 10 then [array_to_string(w, ' ')] else [array_to_string(w[i:i + 9], ' ') for i in generate_series(1, len(w) - 9)] end) as win from b),
spots as (select t, size, unnest(generate_series(1, len(w) - size + 1)) as i, w from w cross join (select distinct size from win) where len(w) >= size),
hit as (select spots.t, i, spots.size, item_id from spots join win on win.size = spots.size and win.win = array_to_string(spots.w[i:i + spots.size - 1], ' ')),
words as (select t, count(distinct p) as n_hit from (select t, unnest(generate_series(i, i + size - 1)) as p from hit) group by t),
items as (select t, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct t, item_id::varchar as item_id from hit) group by t)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from documents join w on w.t = {_LOWER} left join words on words.t = w.t left join items on items.t = w.t"""

#: Bytes as two hexadecimal digits each; strings of 200 bytes by their hashes.
SUBSTRINGS_SQL = """
with h as (select row_number() over () as id, t, k, hex(encode(t)) as h from (select coalesce(text, '') as t, count(*) as k from documents group by 1)),
p as (select id, k, i, hash(substr(h, 2 * i + 1, 400)) as f from (select id, k, h, unnest(generate_series(0, len(h) // 2 - 200)) as i from h where len(h) >= 400)),
rep as (select f from p group by f having sum(k) > 1),
c as (select id, i, lag(i) over (partition by id order by i) as before from p semi join rep using (f)),
isl as (select id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by id order by i rows unbounded preceding) as n from c),
r as (select id, min(i) as a, max(i) + 200 as b from isl group by id, n),
x as (select *, coalesce(lag(b) over (partition by id order by a), 0) as pb from r),
kept as (select x.id, sum(b - a)::bigint as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * pb + 1, 2 * (a - pb)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as kh from x join h using (id) group by x.id)
select doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kh, h))) as kept_sha256
from documents join h on h.t = coalesce(text, '') left join kept using (id)"""

#: A node is the list of its turns; its subtree are the nodes whose lists begin with it. DuckDB has no crc32, so h is its usual polynomial, bit by bit.
TRIE_SQL = rf"""
with recursive t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
ids as (select distinct conv_id from t),
crc(conv_id, bytes, c) as (
  select conv_id, conv_id::varchar, 4294967295::bigint from ids
  union all
  select conv_id, bytes[2:], list_reduce([xor(c, ascii(bytes[1])::bigint)] || generate_series(1, 8), lambda a, i: case when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end) from crc where bytes <> ''),
h as (select conv_id, xor(c, 4294967295) % 4 as h from crc where bytes = ''),
r as (select conv_id, pos, role, text from t join h using (conv_id) where pos > h
      union all select h.conv_id, pos, role, text from h join t on t.conv_id = h.conv_id - h.conv_id % 20 and pos <= h),
s as (select conv_id, coalesce(list(md5(len(role) || ':' || role || text) order by pos) filter (pos is not null), []) as seq,
             coalesce(list(len(regexp_extract_all(text, '[^ 	-
]+')) order by pos) filter (pos is not null), []) as words
      from ids left join r using (conv_id) group by conv_id),
p as (select conv_id, len(seq) as size, words, seq, unnest(generate_series(0, len(seq))) as depth from s),
k as (select array_to_string(seq[1:depth], '') as key, case when depth > 0 then array_to_string(seq[1:depth - 1], '') end as up, depth, min(conv_id) as conv_id, count(*) as n_convs,
             case when depth > 0 then max(words[depth]) else 0 end as w, max(seq[1:depth]) as seq, string_agg(conv_id::varchar, ',' order by conv_id) filter (size = depth) as ends
      from p group by 1, 2, 3),
c as (select up, count(*) as n_children from k where depth > 0 group by up),
a as (select array_to_string(seq[1:d], '') as key, sum((n_convs - 1) * w)::bigint as saved_tokens, count(*) filter (n_children is null) as n_leaves
      from (select k.*, n_children, unnest(generate_series(0, depth)) as d from k left join c on c.up = k.key) group by 1)
select k.conv_id, k.depth, above.conv_id as parent_conv_id, k.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, sha256(coalesce(k.ends, '')) as ends_sha256
from k join a using (key) left join c on c.up = k.key left join k above on k.depth > 0 and above.key = k.up"""

#: Windows by their hashes; equal texts are one.
WINDOWS_SQL = r"""
with t as (select row_number() over () as id, w, count(*) as k from (select regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents) group by w),
p as (select id, k, i, hash(array_to_string(w[i:i + 34], ' ')) as f from (select id, k, w, unnest(generate_series(1, len(w) - 34)) as i from t where len(w) >= 35)),
rep as (select f from p group by f having sum(k) > 1),
c as (select distinct id, unnest(generate_series(i, i + 34)) as pos from p semi join rep using (f)),
u as (select id, w[pos] as x, pos from (select id, w, unnest(generate_series(1, len(w))) as pos from t semi join c using (id))),
kept as (select id, count(c.pos) as n, coalesce(string_agg(x, ' ' order by pos) filter (c.pos is null), '') as keep from u left join c using (id, pos) group by id),
r as (select w, n, keep from t join kept using (id))
select doc_id, len(d.w)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(keep, array_to_string(d.w, ' '))) as kept_sha256
from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents) d left join r on r.w = d.w"""

ORACLE_SQL = {
    "op13_debruijn_dedup": WINDOWS_SQL,
    "op12_burst_trie": TRIE_SQL,
    "op9_suffix_dedup": SUBSTRINGS_SQL,
    "op6_ngram_jaccard": JACCARD_SQL,
    "op8_decontamination": DECONTAMINATION_SQL,
    "op3_secret_scan": secrets.oracle(),
    "op10_reply_trees": """
with c as (select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(11 + len(regexp_replace(replace(replace(role, '%', '%25'), '|>', '%7C>'), '<(\\\\*)\\|', '<\\1\\\\|', 'g'))
              + len(regexp_replace(text, '<(\\\\*)\\|', '<\\1\\\\|', 'g')))::bigint as formatted_chars
from c group by conv_id""",
}
