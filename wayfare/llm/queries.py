"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm.decontamination import decontaminate
from wayfare.llm.licenses import scan
from wayfare.llm.neardup import near_duplicates
from wayfare.llm.negatives import hard_negatives
from wayfare.llm.packing import pack_documents
from wayfare.llm.quality import MEASURES, RULES, ledger, mask, passes, POLICIES
from wayfare.llm.pii import with_surrogates
from wayfare.llm.resampling import importance_resample
from wayfare.llm.suffix_dedup import dedup_substrings
from wayfare.llm.token_index import token_index
from wayfare.llm.tokens import vocabulary
from wayfare.llm.toxicity import toxicity
from wayfare.llm.vector_dedup import vector_duplicates
from wayfare.llm.warc import archive


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(), end_id=0, capacity=2048)


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(table(spark, sf_dir, "documents"))
    named = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *named, (~passes("base")).alias("base_failed"), passes("v1").alias("kept"), "failures")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), length=50)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"), least=0)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity(docs, table(spark, sf_dir, "labels")).drop("text")


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = F.aggregate(F.map_values("pii_counts"), F.lit(0), lambda a, x: a + x).cast("long")
    kinds = F.array_join(F.array_sort(F.map_keys("pii_counts")), ",")
    return rows.select("doc_id", "text", count.alias("n_entities"), kinds.alias("entity_types"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), every=100, positives=5, negatives=5, band=(80, 100), scale=256)


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), share=10, least=20, seed="2024", longest=1, buckets=10_000)


def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_duplicates(table(spark, sf_dir, "embeddings"), least=0.98)


_ALL = (
    op1_token_index, op2_license_scan, op3_best_fit_packing, op4_quality_ledger, op5_suffix_dedup, op6_warc,
    op7_minhash_dedup, op8_toxicity_chain, op9_pii_surrogates, op10_decontaminate,
    op11_hard_negatives, op12_importance_resample, op13_vector_dedup,
)
QUERIES = {f.__name__: f for f in _ALL}

_FAILURES = " + ".join(f"case when {cond} then {1 << k} else 0 end" for k, (_, cond) in enumerate(RULES))

_OP4 = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from d),
g as (select r, i, case when i <= len(ws) - 4 then array_to_string(ws[i : i + 4], ' ') end as g
      from (select r, ws, unnest(range(1, len(ws) + 1)) as i from w)),
c as (select r, i, case when g is null then 0 else count(*) over (partition by r, g) end as n from g),
rep as (select r, count(*) as n from (select r, max(n) over (partition by r order by i rows between 4 preceding and current row) as m from c) where m >= 2 group by r),
l as (select r, count(*) as n_lines, count(*) - count(distinct line) as dup
      from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
m as (select doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, coalesce(l.n_lines, 0) as n_lines, coalesce(dup, 0) as n_dup_lines,
        coalesce(rep.n, 0) as n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper,
        length(regexp_replace(text, '[^A-Za-z]', '', 'g')) as n_letters
      from w left join rep using (r) left join l using (r)),
f as (select *, {_FAILURES} as failures from m)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  failures & {mask(POLICIES["v1"])} = 0 as kept, cast(failures as bigint) as failures
from f"""

_OP7 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, array_to_string(w[i : i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) as i from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 75 * (x.n + y.n - common)),
r as (select doc_id as id, doc_id as seen from n union select r.id, e.b from r join e on e.a = r.seen),
c as (select id, min(seen) as component from r group by id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(component, d.doc_id) as component_id, coalesce(component, d.doc_id) = d.doc_id as kept
from d left join n using (doc_id) left join c on c.id = d.doc_id"""

_OP10 = r"""
with lo as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
it as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item_id, least(13, len(w)) as n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') as g
        from (select item_id, w, unnest(range(1, greatest(len(w) - 12, least(len(w), 1)) + 1)) as i from it)),
pos as (select r, w, unnest(range(1, len(w) + 1)) as i from lo),
hit as (select p.r, p.i, win.n, win.item_id from (select p.r, p.i, s.n, array_to_string(p.w[p.i : p.i + s.n - 1], ' ') as g
        from pos p cross join (select distinct n from win) s where p.i + s.n - 1 <= len(p.w)) p join win on win.n = p.n and win.g = p.g),
cov as (select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + n)) as j from hit) group by r),
ids as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items from (select distinct r, cast(item_id as varchar) as item_id from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from lo left join cov using (r) left join ids using (r)"""

_OP6 = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, html, strlen(html) as n, upper(sha1(html)) as hex from p),
g as (select html, max(page_id) as original from p group by html),
d as (select page_id, html, n, list_aggregate(list_transform(range(0, 8), lambda k: list_aggregate(list_transform(range(0, 4),
        lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast('0x' || substr(hex, cast(5 * k + 1 as bigint), 5) as bigint) >> (15 - 5 * j)) & 31), 1)), 'string_agg', '')), 'string_agg', '') as digest from s)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when page_id = original then 'response' else 'revisit' end as record_type, case when page_id <> original then original end as refers_to
from d join g using (html)"""

_OP11 = """
with v as (select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * cast(x as double))) as q
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.r as a, b.r as b, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.q, b.q) as bigint) as score
      from v a join v b on a.r <> b.r where a.vec_id % 100 = 0),
p as (select * from s where same qualify row_number() over (partition by a order by score desc, vec_id) <= 5),
n as (select p.anchor_id, p.vec_id as positive_id, row_number() over (partition by p.a, p.b order by s.score desc, s.vec_id) as rank,
        s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
      from p join s on s.a = p.a and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5"""

_OP12 = r"""
with recursive steps as (select 0 as k, i, i as v from range(256) t(i) union all
             select k + 1, i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from steps where k < 8),
crc as (select list(v order by i) as tab from steps where k = 8),
low as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
aim as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
dw as (select r, unnest(ws) as w from low),
tw as (select unnest(ws) as w from aim),
voc as (select w, hex(encode(w)) as x from (select w from dw union select w from tw)),
b as (select w, xor(list_reduce(list_concat([4294967295], list_transform(range(0, cast(length(x) / 2 as bigint)), lambda i: cast('0x' || substr(x, cast(2 * i + 1 as bigint), 2) as bigint))),
        lambda c, y: xor(c >> 8, tab[cast(xor(c, y) & 255 as bigint) + 1])), 4294967295) % 10000 as bucket from voc cross join crc),
s as (select bucket, count(*) as n from dw join b using (w) group by bucket),
t as (select bucket, count(*) as n from tw join b using (w) group by bucket),
size as (select (select count(*) from dw) as s, (select count(*) from tw) as t),
gain as (select bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (size.s + 10000)::double / ((coalesce(s.n, 0) + 1)::double * (size.t + 10000)::double))) as bigint) as gain
         from s full join t using (bucket) cross join size),
m as (select r, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight from dw join b using (w) join gain using (bucket) group by r),
f as (select r, doc_id, len(ws) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
      from low left join m using (r)),
o as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as total from f)
select doc_id, cast(n_features as bigint) as n_features, weight, score,
  cast(case when n_features >= 20 and place <= (10 * total) // 100 then place end as bigint) as rank from o"""

_OP13 = """
with recursive v as (select row_number() over () as r, vec_id, label, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.r as a, b.r as b, b.vec_id from ok a join ok b on a.label = b.label and a.r <> b.r where list_cosine_similarity(a.e, b.e) >= 0.98),
seen as (select r, r as at, vec_id from v union select seen.r, links.b, links.vec_id from seen join links on links.a = seen.at),
c as (select r, min(vec_id) as component_id from seen group by r),
n as (select a as r, count(*) as n from links group by a)
select v.vec_id, cast(coalesce(n.n, 0) as bigint) as n_links, component_id, vec_id = component_id as kept from v join c using (r) left join n using (r)"""

ORACLES = {
    "op4_quality_ledger": _OP4, "op6_warc": _OP6, "op7_minhash_dedup": _OP7, "op10_decontaminate": _OP10,
    "op11_hard_negatives": _OP11, "op12_importance_resample": _OP12, "op13_vector_dedup": _OP13,
}
