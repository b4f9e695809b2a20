"""The queries opN_* and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digests, format_chats
from .common import table, written
from .decontamination import overlaps
from .embedding_dedup import near_vectors
from .fill_middle import digests as middle_digests
from .fill_middle import fill_middle
from .filter_audit import audit
from .html_extract import extract
from .jaccard_join import jaccard_join
from .language_id import fold, identify, learn
from .lm_score import lm_score
from .mixing import mix
from .norm_topk import norm_topk
from .quality_rules import scored, statistics, train
from .token_output import token_output

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op9_token_output")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


_REACHED = """
r as (select a as node, a as seen from g union select r.node, g.b from r join g on g.a = r.seen), m as (select node, min(seen) as component from r group by 1)"""

_JACCARD_SQL = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as ws from documents
), k as (
  select doc_id, ws, array_to_string(ws, ' ') as key from w where len(ws) > 0
), c as (
  select key, min(doc_id) as class_id, count(distinct doc_id) as copies, any_value(ws) as ws from k group by key
), h as (
  select class_id, unnest(list_distinct(case when len(ws) < 5 then [key] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end)) as shingle from c
), n as (
  select class_id, count(*) as size from h group by 1
), p as (
  select x.class_id as a, y.class_id as b, count(*) as common from h x join h y on x.shingle = y.shingle and x.class_id < y.class_id group by 1, 2
), e as (
  select a, b from p join n x on x.class_id = a join n y on y.class_id = b where common >= 0.8 * (x.size + y.size - common)
), g as (
  select a, b from e union all select b, a from e
), {_REACHED}, l as (
  select g.a as class_id, sum(copies) as links from g join c on c.class_id = g.b group by 1
)
select d.doc_id, coalesce(c.class_id, d.doc_id) as class_id, coalesce(copies, 1)::bigint as n_copies, coalesce(copies - 1 + coalesce(links, 0), 0)::bigint as n_links,
  coalesce(component, c.class_id, d.doc_id) as component_id, d.doc_id = coalesce(component, c.class_id, d.doc_id) as kept
from documents d left join k using (doc_id) left join c using (key) left join l on l.class_id = c.class_id left join m on m.node = c.class_id
"""


@query("op7_jaccard_join", _JACCARD_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = F.coalesce(fold(F.col("doc_id"), 5), F.lit(0))
    known = learn(docs.where(remainder != 0).select("text", "lang"))
    return identify(docs.select("doc_id", (remainder == 0).alias("held_out"), "text"), known).drop("text")


@query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = written(docs.select("doc_id", *[c.alias(k) for k, c in statistics(F.col("text")).items()]), "statistics")
    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    known = measured.where(~held_out).join(labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("label")), "doc_id")
    rules, intercept = train(known, "label")
    return scored(measured.withColumn("held_out", held_out), rules, intercept).select("doc_id", "held_out", "score", "predicted")


_VECTORS_SQL = f"""
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), u as (
  select vec_id, label, x, sqrt(list_dot_product(x, x)) as length from v
), g as (
  select p.vec_id as a, q.vec_id as b from u p join u q on p.label = q.label and p.vec_id <> q.vec_id and list_dot_product(p.x, q.x) / (p.length * q.length) >= 0.98
), {_REACHED}, l as (
  select a, count(*) as links from g group by 1
)
select vec_id, coalesce(links, 0)::bigint as n_links, coalesce(component, vec_id) as component_id, vec_id = coalesce(component, vec_id) as kept
from embeddings left join l on l.a = vec_id left join m on m.node = vec_id
"""


@query("op8_embedding_dedup", _VECTORS_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


_CHAT_SQL = """
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as t from conversations
  union all select -1, k, r, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) x(k, r)
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' order by turn)) as turns_sha256,
  coalesce(sum(length(t)) filter (where role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(t, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(24 + length(role) + len(regexp_extract_all(role, '[\\\\\\n|]')) + length(t) + len(regexp_extract_all(t, '<\\\\*\\|')))::bigint as formatted_chars
from c group by conv_id
"""


@query("op1_chat_format", _CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    # a row is one whole message, told from repeated turns by what it says
    events = rows.select("conv_id", F.col("turn").alias("seq"), F.concat_ws("\x1f", F.col("turn").cast("string"), F.monotonically_increasing_id().cast("string")).alias("message"), F.lit("message").alias("kind"), "role", "text")
    return digests(format_chats(events))


@query("op2_html_extract")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@query("op4_lm_score")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))


_AUDIT_SQL = """
with w as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents
), f as (
  select doc_id, part, len(ws) < 200 as a, 100 * len(list_distinct(ws)) < 50 * len(ws) as b,
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(doc_id > min(doc_id) over (partition by t), false) as e
  from w
), l as (
  select doc_id, bool_or(coalesce(quality, 0) = 1) as good, bool_or(coalesce(toxic, 0) = 1) as toxic from labels group by doc_id
), cells as (
  select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as bits, count(*) as n,
    count(*) filter (where good) as good, count(*) filter (where toxic) as toxic
  from f left join l using (doc_id) group by all
), names as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as k, unnest([1, 2, 4, 8, 16]) as bit
), orders as (
  select p.k || q.k || r.k || s.k || t.k as filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] as bits
  from names p, names q, names r, names s, names t where len(list_distinct([p.k, q.k, r.k, s.k, t.k])) = 5
), steps as (
  select filter_order, step, bits[step] as own, coalesce(list_sum(bits[1:step - 1]), 0)::int as before
  from orders, unnest([1, 2, 3, 4, 5]) as u(step)
), out as (
  select part, filter_order, step, own,
    coalesce(sum(n) filter (where bits & (before | own) = 0), 0) as kept,
    coalesce(sum(n) filter (where bits & own > 0 and bits & before = 0), 0) as removed,
    coalesce(sum(n) filter (where bits & own > 0 and bits & before > 0), 0) as redundant,
    coalesce(sum(n) filter (where bits = own), 0) as unique_fails,
    coalesce(sum(good) filter (where bits & own > 0 and bits & before = 0), 0) as good_lost,
    coalesce(sum(toxic) filter (where bits & own > 0 and bits & before = 0), 0) as toxic_lost
  from cells, steps group by all
)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, own))::bigint as shapley
from out
"""


@query("op11_filter_audit", _AUDIT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_TOPK_SQL = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as z from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""


@query("op12_norm_topk", _TOPK_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


_MIDDLE_SQL = """
with t as (
  select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(doc_id::varchar, '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as units from documents
), u as (
  select *, len(units) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from t
), f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain'
      when h4 % 100 < 80 then 'spm' else 'psm' end as form from u
), p as (
  select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from f
)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""


@query("op13_fill_middle", _MIDDLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle_digests(fill_middle(table(spark, sf_dir, "documents")))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
