"""Metering, retrieval and relational queries over the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metering as M
from ..operators import relational as R
from ..operators import retrieval as V
from .registry import query, table


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as usage: signups stand for processed papers, errors for failures, the rest for successes."""
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "signup", "processed").otherwise("success")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("event_type").alias("feature"), kind.alias("kind"), F.floor("value").cast("long").alias("tokens"), M.guarded_number(F.col("props"), "$.k").alias("pages")
    )


_USAGE = """select event_id, user_id, ts, event_type as feature,
  case event_type when 'error' then 'failure' when 'signup' then 'processed' else 'success' end as kind,
  cast(floor(value) as bigint) as tokens, cast(json_extract_string(props, '$.k') as bigint) as pages from events"""


@query(
    "a4_usage_summary",
    f"""with u as ({_USAGE}), e as (select * from u where ts >= timestamp '2024-01-10' and ts < timestamp '2024-01-25'),
f as (select feature, count(*) n from e group by 1)
select count(*) as events, count(*) filter (where kind = 'success') as succeeded, count(*) filter (where kind = 'failure') as failed,
 case when count(*) = count(tokens) then coalesce(cast(sum(tokens) as bigint), 0) end as tokens,
 count(*) filter (where kind = 'processed') as papers_processed,
 case when count(*) filter (where kind = 'processed') = count(pages) filter (where kind = 'processed')
  then coalesce(cast(sum(pages) filter (where kind = 'processed') as bigint), 0) end as pages,
 (select '{{' || string_agg('"' || feature || '":' || n, ',' order by feature) || '}}' from f) as features from e""",
)
def a4_usage_summary(spark, sf_dir):
    e = usage_events(spark, sf_dir)
    return M.usage_summary(e.where(M.in_range(F.col("ts"), "2024-01-10", "2024-01-25")))


@query("a6_feature_breakdown", "select event_type as feature, count(*) as n from events group by 1")
def a6_feature_breakdown(spark, sf_dir):
    return M.feature_breakdown(usage_events(spark, sf_dir))


@query(
    "a8_monthly_allowance",
    f"""with u as (select user_id, strftime(ts, '%Y-%m') as month, count(*) filter (where kind = 'success') as requests, cast(coalesce(sum(tokens), 0) as bigint) as tokens from ({_USAGE}) group by 1, 2),
p as (select *, cast(least(100, floor(requests * 100.0::double / 60)) as integer) as request_percent, cast(least(100, floor(tokens * 100.0::double / 4000)) as integer) as token_percent from u)
select user_id, month, requests, tokens, request_percent, token_percent, greatest(request_percent, token_percent) as percent,
 not (requests >= 60 or tokens >= 4000) as allowed, case when requests >= 60 then 'requests' when tokens >= 4000 then 'tokens' end as reason from p""",
)
def a8_monthly_allowance(spark, sf_dir):
    return M.allowance(usage_events(spark, sf_dir), 60, 4000)


@query(
    "a9_storage_summary",
    """with u as (select source as owner, count(*) as files, cast(sum(coalesce(n_chars, 0)) as bigint) as used from documents group by 1),
p as (select *, cast(greatest(0, 120000 - used) as bigint) as free, cast(least(100, floor(used * 100.0::double / 120000)) as integer) as percent from u)
select *, case when percent >= 100 then 'exhausted' when percent >= 80 then 'warning' else 'ok' end as state from p""",
)
def a9_storage_summary(spark, sf_dir):
    return M.storage_summary(table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("n_chars").alias("bytes")), 120_000)


@query(
    "a12_completion_status",
    """with f as (select d.source as paper, d.lang as field, case when l.quality = 0 then 'failed' else 'extracted' end as state, l.toxic as claim, 0 as current from documents d join labels l using (doc_id)),
c as (select paper, count(distinct field) as fields, count(*) filter (where state = 'failed') as failed, count(*) filter (where claim is distinct from current) as stale from f group by 1)
select *, case when fields = 4 and failed = 0 and stale = 0 then 'complete' else 'partial' end as status from c""",
)
def a12_completion_status(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    state = F.when(F.col("quality") == 0, "failed").otherwise("extracted")
    return M.completion_status(rows.select(F.col("source").alias("paper"), F.col("lang").alias("field"), state.alias("state"), F.col("toxic").alias("claim"), F.lit(0).alias("current")), 4)


@query(
    "m8_month_bounds",
    "select event_id, date_trunc('month', ts)::timestamp as month_start, (date_trunc('month', ts) + interval 1 month)::timestamp as month_end from events",
)
def m8_month_bounds(spark, sf_dir):
    start, end = M.month_bounds(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", start.alias("month_start"), end.alias("month_end"))


@query("w15_backoff", "select attempt, cast(least(300, 5 * pow(2, attempt - 1)) as bigint) as delay from (select unnest(range(1, 12)) as attempt)")
def w15_backoff(spark, sf_dir):
    return spark.range(1, 12).select(F.col("id").alias("attempt"), M.backoff(F.col("id"), 5, 300).alias("delay"))


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("paper_id"), F.col("vec_id").alias("chunk_index"), "embedding")


def _request(chunks: DataFrame, **how) -> V.SearchRequest:
    first = chunks.where(V.valid_vector(F.col("embedding"), 64)).orderBy("chunk_index").select("embedding").first()
    return V.SearchRequest([float(x) for x in first[0]], **how)


_TOP = """with q as (select list_transform(embedding, lambda x: x::double) as qv from embeddings order by vec_id limit 1),
s as (select label as paper_id, vec_id as chunk_index, list_transform(embedding, lambda x: x::double) as v from embeddings),
d as (select paper_id, chunk_index, 1 - list_inner_product(v, qv) / (sqrt(list_inner_product(v, v)) * sqrt(list_inner_product(qv, qv))) as distance from s, q),
t as (select * from d {where} order by distance, paper_id, chunk_index {limit})
select paper_id, chunk_index, round(1 - distance, 9) as similarity, row_number() over (order by distance, paper_id, chunk_index) as rank from t"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("paper_id", "chunk_index", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long").alias("rank"))


@query("k1_cosine_topk", _TOP.format(where="", limit="limit 10"))
def k1_cosine_topk(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return _ranked(V.top_k(chunks, _request(chunks, k=10)))


@query("k1_cosine_topk_scoped", _TOP.format(where="where paper_id in (1, 3, 5)", limit="limit 25"))
def k1_cosine_topk_scoped(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    scope = spark.createDataFrame([(1,), (3,), (5,)], "paper_id int")
    return _ranked(V.top_k(chunks.join(scope, "paper_id", "left_semi"), _request(chunks, k=25)))


@query("v8_min_similarity", _TOP.format(where="where 1 - distance >= 0.2", limit="limit 50"))
def v8_min_similarity(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return _ranked(V.top_k(chunks, _request(chunks, k=99, min_similarity=0.2)))


def library(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """orders as papers, customers as projects' people, so that every join of the search path has rows."""
    orders = table(spark, sf_dir, "orders")
    papers = orders.select(F.col("o_orderkey").alias("paper_id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "ready").otherwise("failed").alias("status"), F.col("o_orderdate").alias("completed_at"))
    jobs = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("paper_id"), F.when(F.col("o_orderkey") % 7 == 0, "failed").when(F.col("o_orderkey") % 7 == 1, "embedding").otherwise("complete").alias("status"), F.when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_orderdate")).alias("source_completed_at"))
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 13 <> 0")
    return {"papers": papers, "jobs": jobs, "chunks": lines.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("chunk_index"), F.col("l_partkey").alias("section_id"))}


@query(
    "st11_coverage_states",
    """with p as (select o_orderkey as paper_id, case when o_orderstatus in ('F', 'O') then 'ready' else 'failed' end as status, o_orderdate as completed_at from orders),
j as (select o_orderkey as paper_id, case o_orderkey % 7 when 0 then 'failed' when 1 then 'embedding' else 'complete' end as job, case when o_orderkey % 11 <> 0 then o_orderdate end as g from orders where o_orderkey % 5 <> 0),
c as (select l_orderkey as paper_id, count(*) as n from lineitem where l_orderkey % 13 <> 0 group by 1)
select p.paper_id, coalesce(n, 0) as chunks, case when status = 'failed' then 'processing_failed' when status <> 'ready' then 'not_processed' when coalesce(n, 0) = 0 then 'no_text'
 when job is null then 'not_indexed' when g is distinct from completed_at then 'outdated' when job = 'complete' then 'searchable' when job = 'failed' then 'index_failed' else 'indexing' end as state
from p left join j using (paper_id) left join c using (paper_id)""",
)
def st11_coverage_states(spark, sf_dir):
    x = library(spark, sf_dir)
    return V.coverage(x["papers"], x["jobs"], x["chunks"])


@query(
    "f12_searchable_chunks",
    """select o_orderkey as paper_id, l_linenumber as chunk_index, p_partkey as section_id, p_brand as section_title from orders join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey
where o_orderstatus in ('F', 'O') and o_orderkey % 5 <> 0 and o_orderkey % 7 not in (0, 1) and o_orderkey % 11 <> 0 and l_orderkey % 13 <> 0 and p_size % 5 <> 0 and o_custkey % 3 = 0""",
)
def f12_searchable_chunks(spark, sf_dir):
    x = library(spark, sf_dir)
    sections = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("section_id"), F.col("p_brand").alias("section_title"), F.when(F.col("p_size") % 5 == 0, "references").otherwise("results").alias("section_type"))
    chunks = x["chunks"].withColumn("chunk_id", F.concat_ws("-", "paper_id", "chunk_index"))
    vectors = chunks.select("chunk_id", F.lit("h").alias("content_hash"), F.array(F.lit(1.0)).alias("embedding"))
    scope = x["papers"].where("owner % 3 = 0").select("paper_id")
    return V.searchable(x["papers"], x["jobs"], chunks, sections, vectors.dropDuplicates(["chunk_id"]), scope).select("paper_id", "chunk_index", "section_id", "section_title")


@query(
    "f14_membership_semi",
    """select o_orderkey as paper_id, o_custkey as owner from orders where o_custkey = 7 or o_orderkey in
 (select l_orderkey from lineitem where l_suppkey in (select s_suppkey from supplier where s_nationkey in (select c_nationkey from customer where c_custkey = 7)))""",
)
def f14_membership_semi(spark, sf_dir):
    papers = library(spark, sf_dir)["papers"].select("paper_id", "owner")
    links = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("paper_id"), F.col("s_nationkey").alias("project_id"))
    members = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_custkey").alias("user_id"), F.lit("VIEWER").alias("role"))
    return R.visible_papers(papers, links, members, 7)


@query("j4_anti_no_orders", "select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def j4_anti_no_orders(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query(
    "j6_one_row_cross",
    "select b.*, c.customers from (select count(*) as orders, max(o_orderdate) as last_order from orders) b cross join (select count(*) as customers from customer) c",
)
def j6_one_row_cross(spark, sf_dir):
    one = table(spark, sf_dir, "orders").agg(F.count("*").alias("orders"), F.max("o_orderdate").alias("last_order"))
    return one.crossJoin(table(spark, sf_dir, "customer").agg(F.count("*").alias("customers")))


@query(
    "j7_update_from",
    "select c_custkey, case when s_acctbal is not null and s_acctbal <> c_acctbal then s_acctbal else c_acctbal end as balance, coalesce(s_acctbal <> c_acctbal, false) as changed from customer left join supplier on s_suppkey = c_custkey",
)
def j7_update_from(spark, sf_dir):
    j = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    changed = F.coalesce(F.col("s_acctbal") != F.col("c_acctbal"), F.lit(False))
    return j.select("c_custkey", F.when(changed, F.col("s_acctbal")).otherwise(F.col("c_acctbal")).alias("balance"), changed.alias("changed"))


@query("j8_collaborators", 'select distinct a.s_suppkey as "user", b.s_suppkey as other from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey')
def j8_collaborators(spark, sf_dir):
    return R.collaborators(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("user_id")))


@query(
    "j9_correlated_count",
    "select c_custkey, (select count(*) from orders where o_custkey = c_custkey) as orders from customer",
)
def j9_correlated_count(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@query(
    "j12_link_arrays",
    "select l_orderkey as paper_id, array_to_string(list_sort(list(distinct l_suppkey)), ',') as projects, count(distinct l_suppkey) as n from lineitem group by 1",
)
def j12_link_arrays(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("paper_id")).agg(F.array_sort(F.collect_set("l_suppkey")).alias("ids")).select("paper_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("projects"), F.size("ids").cast("long").alias("n"))


_SPANS = "select l_orderkey as k, l_linenumber as item, cast(l_quantity * 10 as bigint) as s, cast(l_quantity * 10 + l_linenumber * 25 as bigint) as e from lineitem"


@query("j13_overlap_join", f"with t as ({_SPANS}) select a.k, a.item as a, a.s as a_start, a.e as a_end, b.item as b, b.s as b_start, b.e as b_end from t a join t b on a.k = b.k and a.item < b.item and a.s < b.e and b.s < a.e")
def j13_overlap_join(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("item"), (F.col("l_quantity") * 10).cast("long").alias("s"), (F.col("l_quantity") * 10 + F.col("l_linenumber") * 25).cast("long").alias("e"))
    return R.overlapping(t, "k", "s", "e", "item", 100)


_PAGE_OF = """with t as (select doc_id, length(text) // 2 as off, text from documents where text is not null)
select doc_id, off, cast(1 + off - length(replace(left(text, off), chr(10), '')) as integer) as page from t"""


@query("j14_offset_to_page", _PAGE_OF)
@query("j14_offset_to_page_whole", _PAGE_OF)
def j14_offset_to_page(spark, sf_dir):
    """Texts of any length: the lines up to an offset are counted in one linear pass."""
    docs = table(spark, sf_dir, "documents").where("text is not null").withColumn("off", F.floor(F.length("text") / 2))
    before = F.substring(F.col("text"), F.lit(1), F.col("off").cast("int"))
    return docs.select("doc_id", "off", F.size(F.split(before, "\n")).alias("page"))


@query(
    "j17_newest_unconflicted",
    """with r as (select *, max(date_trunc('day', ts)) over (partition by user_id, event_type) as m from events)
select user_id, event_type, m as newest_at, min(props) as content from r where date_trunc('day', ts) = m group by 1, 2, 3 having count(distinct props) = 1""",
)
def j17_newest_unconflicted(spark, sf_dir):
    return R.newest_unconflicted(table(spark, sf_dir, "events").withColumn("day", F.date_trunc("DAY", "ts")), ["user_id", "event_type"], "day", F.col("props"))


@query(
    "j18_newest_tiebreak",
    "select user_id, event_type, props from (select *, row_number() over (partition by user_id, event_type order by date_trunc('day', ts) desc, props) as r from events) where r = 1",
)
def j18_newest_tiebreak(spark, sf_dir):
    return R.newest(table(spark, sf_dir, "events").withColumn("day", F.date_trunc("DAY", "ts")), ["user_id", "event_type"], "day", F.col("props")).select("user_id", "event_type", "props")


@query("f4_text_search", "select p_partkey, p_name from part where lower(concat_ws(' ', p_name, p_brand, p_type)) like '%brand#1%'")
def f4_text_search(spark, sf_dir):
    return R.text_search(table(spark, sf_dir, "part"), ["p_name", "p_brand", "p_type"], " Brand#1 ").select("p_partkey", "p_name")


@query("k3_feed", "select event_id, ts, event_type from events order by ts desc, event_id desc limit 30")
def k3_feed(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(30).select("event_id", "ts", "event_type")


_NULLS_LAST = "select o_orderkey, case when o_orderkey % 3 = 0 then null else o_orderdate end as due from orders order by due asc nulls last, o_orderkey"


@query("k5_nulls_last", _NULLS_LAST)
@query("k5_nulls_last_whole", _NULLS_LAST)
def k5_nulls_last(spark, sf_dir):
    due = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", due.alias("due")).orderBy(F.col("due").asc_nulls_last(), "o_orderkey")


@query("x1_exact_dedupe", "select source, sha256(text) as content_hash, min(doc_id) as first, count(*) as copies from documents group by 1, 2")
def x1_exact_dedupe(spark, sf_dir):
    return R.exact_duplicates(table(spark, sf_dir, "documents"), "source", "text", "doc_id")


@query(
    "v3_incremental_plan",
    """with c as (select doc_id as chunk_id, sha256('Title: ' || source || chr(10) || 'Section: ' || lang || chr(10) || chr(10) || text) as content_hash from documents),
s as (select doc_id as chunk_id, case when doc_id % 5 = 0 then 'old' else sha256('Title: ' || source || chr(10) || 'Section: ' || lang || chr(10) || chr(10) || text) end as stored_hash from documents where doc_id % 3 <> 0)
select chunk_id, content_hash, case when content_hash = stored_hash then 'reuse' when stored_hash is null then 'embed' else 'replace' end as action from c left join s using (chunk_id)""",
)
def v3_incremental_plan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), V.embedding_input(F.col("source"), F.col("lang"), F.col("text")).alias("input"))
    stored = docs.where("chunk_id % 3 <> 0").select("chunk_id", F.when(F.col("chunk_id") % 5 == 0, "old").otherwise(F.sha2("input", 256)).alias("content_hash"))
    return V.incremental_plan(docs, stored).select("chunk_id", "content_hash", "action")


@query(
    "w9_rolling_window",
    "select event_id, count(*) over w as in_window, cast(sum(cast(floor(value) as bigint)) over w as bigint) as amount_in_window from events window w as (partition by user_id order by ts range between interval 86400 seconds preceding and current row)",
)
def w9_rolling_window(spark, sf_dir):
    return R.rolling_use(usage_events(spark, sf_dir), "user_id", "ts", 86400, "tokens").select("event_id", "in_window", "amount_in_window")


@query(
    "w2_islands",
    """with n as (select *, row_number() over (partition by user_id order by event_id) as rn from events), h as (select user_id, event_id, rn - row_number() over (partition by user_id order by event_id) as g from n where event_type <> 'view')
select user_id, min(event_id) as first, max(event_id) as last, count(*) as n from h group by user_id, g having count(*) >= 3""",
)
def w2_islands(spark, sf_dir):
    return R.islands(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") != "view")


@query("w4_forward_fill", "select conv_id, turn, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn) as asked from conversations")
def w4_forward_fill(spark, sf_dir):
    return R.forward_fill(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.when(F.col("role") == "user", F.col("turn"))).select("conv_id", "turn", F.col("filled").alias("asked"))


@query("w13_first_use_numbering", "select l_orderkey as k, l_suppkey as item, min(l_linenumber) as first, cast(row_number() over (partition by l_orderkey order by min(l_linenumber), l_suppkey) as integer) as number from lineitem group by 1, 2")
def w13_first_use_numbering(spark, sf_dir):
    return R.first_use_numbers(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("item")), "k", "position", "item")


@query(
    "w14_round_robin",
    """with r as (select user_id as k, event_type as g, event_id as o, row_number() over (partition by user_id, event_type order by event_id) as round, min(event_id) over (partition by user_id, event_type) as f from events)
select k, g, o, cast(round as integer) as round, cast(row_number() over (partition by k order by round, f, g) as integer) as place from r""",
)
def w14_round_robin(spark, sf_dir):
    return R.round_robin(table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_type").alias("g"), F.col("event_id").alias("o")), "k", "g", ["o"])


@query("w12_batches", """with recursive d as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id, n_chars) as k from documents),
s as (select distinct source, cast(0 as bigint) as k, cast(null as bigint) as doc_id, cast(0 as bigint) as n_chars, 0 as n, cast(0 as bigint) as total, 0 as batch from d
 union all select d.source, d.k, d.doc_id, d.n_chars, case when f then 1 else n + 1 end, case when f then d.n_chars else total + d.n_chars end, case when f then batch + 1 else batch end from (select s.source as src, s.k as sk, s.n, s.total, s.batch, d.*, s.n > 0 and (s.n + 1 > 8 or s.total + d.n_chars > 12000) as f from s join d on d.source is not distinct from s.source and d.k = s.k + 1) d)
select source, doc_id, n_chars, batch from s where k > 0""")
def w12_batches(spark, sf_dir):
    return V.batches(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], "n_chars", 8, 12_000)


@query("w11_token_estimator", """with recursive d as (select source, n_chars, len(string_split(text, ' ')) as tokens, row_number() over (partition by source order by doc_id, n_chars) as k from documents where text is not null and n_chars > 0),
s as (select distinct source, cast(0 as bigint) as k, 0.0::double as e from d union all select d.source, d.k, case when d.k = 1 then d.n_chars::double / d.tokens else s.e * (1 - 0.3::double) + 0.3::double * (d.n_chars::double / d.tokens) end from s join d on d.source is not distinct from s.source and d.k = s.k + 1)
select source, round(least(4.0::double, greatest(2.5::double, 0.9::double * arg_max(e, k))), 9) as chars_per_token from s group by 1""")
def w11_token_estimator(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    seen = docs.select("source", "doc_id", F.col("n_chars").alias("chars"), F.size(F.split("text", " ")).alias("tokens"))
    return V.estimates(seen, "source", ["doc_id", "chars"]).select("source", F.round("chars_per_token", 9).alias("chars_per_token"))


@query("v10_token_estimate", "select doc_id, cast(ceil(n_chars / 3.0) as bigint) as tokens from documents")
def v10_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", V.token_estimate(F.col("n_chars")).alias("tokens"))


@query("v4_valid_vectors", "select vec_id, len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 as valid from embeddings")
def v4_valid_vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.valid_vector(F.col("embedding"), 64).alias("valid"))


@query("a19_mode_label", "with c as (select source as k, lang, count(*) as n from documents group by 1, 2) select k, lang as label, n from (select *, row_number() over (partition by k order by n desc, length(lang) desc, lang) as r from c) where r = 1")
def a19_mode_label(spark, sf_dir):
    return R.mode_label(table(spark, sf_dir, "documents").select(F.col("source").alias("k"), "lang"), "k", "lang")


@query(
    "a24_concentration",
    """with n as (select l_orderkey as draft, l_suppkey as paper, count(*) as n from lineitem group by 1, 2), t as (select draft, cast(sum(n) as bigint) as total, count(*) as papers from n group by 1)
select draft, paper, n, total from n join t using (draft) where papers >= 2 and total >= 3 and n * 2 > total""",
)
def a24_concentration(spark, sf_dir):
    return R.concentration(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.col("l_suppkey").alias("paper")), "draft", "paper")


@query("a18_shared_having", "select l_partkey as term, count(distinct l_orderkey) as papers from lineitem group by 1 having count(distinct l_orderkey) >= 2")
def a18_shared_having(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("term")).agg(F.countDistinct("l_orderkey").alias("papers")).where("papers >= 2")


@query("a20_two_level_max", "select user_id, cast(coalesce(max(n), 0) as bigint) as most from (select user_id, event_type, count(distinct cast(ts as date)) as n from events group by 1, 2) group by 1")
def a20_two_level_max(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.countDistinct(F.to_date("ts")).alias("n")).groupBy("user_id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"))


@query("a25_ordered_sets", "select user_id, array_to_string(list_sort(list(distinct event_type)), ',') as kinds from events group by 1")
def a25_ordered_sets(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("a26_presence_last", "select user_id, max_by(event_type, (ts, event_id)) as state from events group by 1")
def a26_presence_last(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("a27_any_active", "select user_id, bool_or(event_type = 'purchase') as active, count(*) filter (where event_type = 'error') as attention from events group by 1")
def a27_any_active(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("active"), F.count(F.when(F.col("event_type") == "error", 1)).alias("attention"))


@query("k2_fifo_pick", "select source, arg_min(doc_id, (n_chars, doc_id)) as picked from documents group by 1")
def k2_fifo_pick(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("picked"))


@query("k9_first_three", "select l_orderkey, l_linenumber, cast(r as integer) as r from (select *, row_number() over (partition by l_orderkey order by l_linenumber) as r from lineitem) where r <= 3")
def k9_first_three(spark, sf_dir):
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).where("r <= 3")


@query("e8_matrix_pivot", "select user_id, count(*) filter (where event_type = 'click') as click, count(*) filter (where event_type = 'error') as error, count(*) filter (where event_type = 'purchase') as purchase, count(*) filter (where event_type = 'signup') as signup, count(*) filter (where event_type = 'view') as view from events group by 1")
def e8_matrix_pivot(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", kinds).agg(F.count("event_id")).na.fill(0, kinds)


@query("x3_set_difference", "with a as (select distinct l_partkey k from lineitem where l_quantity = 7), r as (select distinct l_partkey k from lineitem where l_quantity = 8) select k, 'missing' as side from a where k not in (select k from r) union all select k, 'unexpected' from r where k not in (select k from a)")
def x3_set_difference(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    a, r = (lines.where(F.col("l_quantity") == q).select(F.col("l_partkey").alias("k")).distinct() for q in (7, 8))
    return a.join(r, "k", "left_anti").withColumn("side", F.lit("missing")).union(r.join(a, "k", "left_anti").withColumn("side", F.lit("unexpected")))


@query("snk2_idempotent_append", "select user_id, cast(floor(value) as bigint) as v, min(event_id) as event_id from events where event_id % 2 = 1 and (user_id, cast(floor(value) as bigint)) not in (select user_id, cast(floor(value) as bigint) from events where event_id % 2 = 0) group by 1, 2")
def snk2_idempotent_append(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor("value").cast("long").alias("v"))
    return R.insert_new(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id", "v"], "event_id").select("user_id", "v", "event_id")
