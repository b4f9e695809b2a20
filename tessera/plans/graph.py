"""Research map and gap queries: parts as claims of fifty papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..session import held
from .registry import query, table

_KINDS = ["concept", "methodology", "dataset"]


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as claims(kind, paper_id, item, text) with names, function words and clause marks; a small file of many rows is dealt over the tasks."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("The "), "p_name", F.when(k % 2 == 0, " of ").otherwise(", and "), F.initcap("p_type"), F.lit(" model ("), "p_brand", F.when(k % 3 == 0, ") using C++ 4").otherwise(") BERT results; iPhone"))
    return table(spark, sf_dir, "part").select(F.element_at(F.array(*map(F.lit, _KINDS)), (k % 3 + 1).cast("int")).alias("kind"), (k % 50).alias("paper_id"), k.alias("item"), text.alias("text")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item")


def _list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


_TEXT = "'The ' || p_name || case when p_partkey % 2 = 0 then ' of ' else ', and ' end || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' model (' || p_brand || case when p_partkey % 3 = 0 then ') using C++ 4' else ') BERT results; iPhone' end"
_CANDIDATES = f"""select kind, paper_id, item, key, arg_min(phrase, (run, pos, words)) as phrase, min(words) as words from (
 with c as (select ['concept', 'methodology', 'dataset'][p_partkey % 3 + 1] as kind, p_partkey % 50 as paper_id, p_partkey as item, {_TEXT} as text from part),
 r as (select kind, paper_id, item, unnest(string_split_regex(text, '[,;:.!?()]')) as part, generate_subscripts(string_split_regex(text, '[,;:.!?()]'), 1) as run from c),
 t as (select kind, paper_id, item, run, unnest(regexp_extract_all(part, '[\\p{{L}}\\p{{N}}]+(?:[+#]+)?')) as w, generate_subscripts(regexp_extract_all(part, '[\\p{{L}}\\p{{N}}]+(?:[+#]+)?'), 1) as pos from r),
 f as (select *, lower(w) as n, list_contains({_list(G.STOP)}, lower(w)) as stop, list_contains({_list(G.GENERIC)}, lower(w)) as generic, list_contains({_list(G.WEAK)}, lower(w)) as weak, regexp_matches(w, '^[0-9]+$') as num, length(w) >= 2 or regexp_matches(w, '[+#]') as long,
  regexp_matches(w, '[+#]') or (length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 2 and (regexp_matches(regexp_replace(w, '[^A-Za-z]', '', 'g'), '^[A-Z]+$') or regexp_matches(substr(w, 2), '[A-Z]'))) as named from t),
 x as (select a.kind, a.paper_id, a.item, a.run, a.pos, s.k as words, list(b.w order by b.pos) as ws, list(b.n order by b.pos) as ns, bool_or(not b.stop and not b.generic and not b.weak and not b.num and b.long) as said,
  bool_or(b.pos = a.pos and (b.stop or b.generic or b.num or not b.long)) as bad_first, bool_or(b.pos = a.pos + s.k - 1 and (b.stop or b.generic or not (b.num or b.long))) as bad_last, bool_or(b.pos > a.pos and b.pos < a.pos + s.k - 1 and b.stop and b.n <> 'of') as bad_inner, bool_or(b.named) as named
  from f a, range(1, 5) s(k), f b where a.item = b.item and a.run = b.run and b.pos between a.pos and a.pos + s.k - 1 group by all having count(*) = s.k)
 select kind, paper_id, item, run, pos, words, array_to_string(ns, ' ') as key, replace(array_to_string(ws, ' '), 'Brand# ', 'Brand#') as phrase from x where said and not bad_first and not bad_last and not bad_inner and (words > 1 or named)) group by 1, 2, 3, 4"""


@query("g1_candidates", f"select paper_id, item, key, phrase, cast(words as integer) as words from ({_CANDIDATES})")
def g1_candidates(spark, sf_dir):
    return G.candidates(claims(spark, sf_dir)).select("paper_id", "item", "key", "phrase", "words")


_SHARED = f"""with t as ({_CANDIDATES}), s as (select kind, key, count(distinct paper_id) as papers, list_sort(list(distinct (paper_id, item))) as claim_set from t group by 1, 2 having count(distinct paper_id) >= 2),
l as (select kind, key, phrase from (select kind, key, phrase, row_number() over (partition by kind, key order by count(*) desc, length(phrase) desc, phrase) as r from t group by 1, 2, 3) where r = 1),
g as (select distinct a.kind, a.key from s a join s b on a.kind = b.kind and a.key <> b.key and contains(' ' || b.key || ' ', ' ' || a.key || ' ') and a.claim_set = b.claim_set),
sh as (select s.kind, s.key, l.phrase as label, papers, cast(len(claim_set) as integer) as claims, g.key is null as kept from s join l using (kind, key) left join g using (kind, key))"""


@query("g2_shared_terms", f"{_SHARED} select * from sh")
def g2_shared_terms(spark, sf_dir):
    return G.shared_terms(_terms(spark, sf_dir))


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate terms, found once for all that reads them."""
    return held(G.candidates(claims(spark, sf_dir)).select("kind", "paper_id", "item", "key", "phrase"), "terms")


@query("g7_unshared", f"select kind, count(*) filter (where papers < 2) as unshared from (select kind, key, count(distinct paper_id) as papers from ({_CANDIDATES}) group by 1, 2) group by 1")
def g7_unshared(spark, sf_dir):
    return G.unshared(G.candidates(claims(spark, sf_dir)))


def edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    terms = _terms(spark, sf_dir)
    shared = held(G.shared_terms(terms), "shared")
    return G.term_edges(terms, shared), shared


_EDGES = f"{_SHARED}, e as (select t.kind, t.key, paper_id, string_agg(distinct item || '=' || phrase, ',' order by item || '=' || phrase) as evidence from t join sh on t.kind = sh.kind and t.key = sh.key and kept group by 1, 2, 3)"


@query("g4_term_edges", f"{_EDGES} select case kind when 'concept' then 'paper_has_concept' when 'methodology' then 'paper_uses_methodology' else 'paper_uses_dataset' end as type, kind, key, paper_id, evidence from e")
def g4_term_edges(spark, sf_dir):
    shown = F.array_join(F.array_sort(F.transform("evidence", lambda e: F.concat_ws("=", e["item"].cast("string"), e["phrase"]))), ",")
    return edges(spark, sf_dir)[0].withColumn("evidence", shown)


@query("g5_findings", "select p_partkey % 50 as paper_id, p_partkey as item, 'finding:' || (p_partkey % 50) || ':' || p_partkey as finding_id from part where p_size % 4 <> 0")
def g5_findings(spark, sf_dir):
    text = F.when(F.col("p_size") % 4 == 0, " \t ").otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("paper_id"), F.lit("findings").alias("field_key"), F.col("p_partkey").alias("item"), text.alias("text"))
    return G.findings(rows).select("paper_id", "item", "finding_id")


_PAPERS = "select k as paper_id, ['extracted', 'out_of_date', 'queued', 'not_extracted', 'partial'][k % 5 + 1] as status, k % 5 = 1 as stale from range(60) r(k)"


def papers(spark: SparkSession) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ["extracted", "out_of_date", "queued", "not_extracted", "partial"])), (F.col("id") % 5 + 1).cast("int"))
    return spark.range(60).select(F.col("id").alias("paper_id"), status.alias("status"), (F.col("id") % 5 == 1).alias("stale"))


@query("g6_paper_nodes", f"{_EDGES} select p.*, p.paper_id in (select paper_id from e) as contributes from ({_PAPERS}) p")
def g6_paper_nodes(spark, sf_dir):
    return G.paper_nodes(papers(spark), edges(spark, sf_dir)[0])


@query("a16_map_summary", f"""{_EDGES} select count(*) as total_papers, count(*) filter (where paper_id in (select paper_id from e)) as contributing_papers, count(*) filter (where status = 'extracted') as current_papers, count(*) filter (where status = 'out_of_date') as stale_papers, count(*) filter (where status = 'queued') as active_papers,
 count(*) filter (where status = 'not_extracted') as unextracted_papers, count(*) filter (where status = 'partial') as incomplete_papers, (select count(*) from sh where kept and kind = 'concept') as shared_concept, (select count(*) from sh where kept and kind = 'methodology') as shared_methodology, (select count(*) from sh where kept and kind = 'dataset') as shared_dataset, (select count(*) from part where p_size % 4 <> 0) as findings from ({_PAPERS})""")
def a16_map_summary(spark, sf_dir):
    e, shared = edges(spark, sf_dir)
    return G.map_summary(G.paper_nodes(papers(spark), e), shared, g5_findings(spark, sf_dir))


@query("g8_adjacency", f"{_EDGES} select paper_id, kind, string_agg(key, '|' order by key) as terms from e group by 1, 2")
def g8_adjacency(spark, sf_dir):
    return G.adjacency(edges(spark, sf_dir)[0]).withColumn("terms", F.array_join("terms", "|"))


_TITLED = "select k as paper_id, case when k % 6 = 0 then 'Model ' else 'Study ' end || k as title, k % 5 = 1 as stale from range(45) r(k)"


@query("f5_term_index", f"""{_EDGES}, p as ({_TITLED}), n as (select kind, key, cast(e.paper_id as varchar) as id, coalesce(title, cast(e.paper_id as varchar)) as title, coalesce(stale, false) as stale from (select distinct kind, key, paper_id from e) e left join p using (paper_id)),
 o as (select kind, key, string_agg(id, ',' order by title, id) as paper_ids, bool_or(stale) as stale, bool_or(contains(lower(title), 'model')) as titled from n group by 1, 2)
 select 'search' as asked, kind, key, label, papers, paper_ids, stale from o join sh using (kind, key) where kept and (contains(lower(label), 'model') or titled) and kind = 'concept'
 union all select 'current', kind, key, label, papers, paper_ids, stale from o join sh using (kind, key) where kept and not stale""")
def f5_term_index(spark, sf_dir):
    e, shared = edges(spark, sf_dir)
    k = F.col("id")
    titled = spark.range(45).select(k.alias("paper_id"), F.concat(F.when(k % 6 == 0, "Model ").otherwise("Study "), k.cast("string")).alias("title"), (k % 5 == 1).alias("stale"))
    asked = G.term_index(shared, e, titled, " Model ", "concept").withColumn("asked", F.lit("search"))
    return asked.unionByName(G.term_index(shared, e, titled, hide_stale=True).withColumn("asked", F.lit("current"))).withColumn("paper_ids", F.array_join("paper_ids", ","))


_GRAPH = """with p as (select c_custkey // 10 as scope, c_custkey as paper_id, c_name as title, c_acctbal < 0 as stale, c_mktsegment as place, ['extracted', 'queued', 'odd'][c_custkey % 3 + 1] as status from customer where c_custkey % 4 <> 0),
e as (select distinct c_custkey // 10 as scope, 'term:' || c_mktsegment as term_id, 'concept' as kind, lower(c_mktsegment) as label, length(c_mktsegment) as place, c_custkey as paper_id from customer),
f as (select c_custkey // 10 as scope, c_custkey as paper_id, 'finding:' || c_custkey || ':' || o_orderkey as finding_id, o_totalprice as place, o_orderpriority || repeat(' words', cast(o_orderkey % 12 as integer)) as text from orders join customer on c_custkey = o_custkey where o_orderkey % 3 = 0),
v as (select e.* from e join p using (scope, paper_id)), g as (select f.* from f join p using (scope, paper_id)),
c as (select scope, count(*) as n from (select distinct scope, 'p' || paper_id as node from p union select scope, 't' || term_id from v union select scope, 'f' || finding_id from g) group by 1),
d as (select scope from c where n <= 40), r as (select p.*, (row_number() over (partition by scope order by place, paper_id) - 1 - (count(*) over (partition by scope) - 1) / 2.0) * 220 as x from p join d using (scope)),
t as (select scope, term_id, kind, label, place, bool_or(stale) as stale, count(distinct paper_id) as paper_count from (select v.*, p.stale from v join p using (scope, paper_id) join d using (scope)) group by 1, 2, 3, 4, 5),
tx as (select *, (row_number() over (partition by scope order by place, term_id) - 1 - (count(*) over (partition by scope) - 1) / 2.0) * 220 as x from t),
l as (select g.*, r.stale, r.x + (row_number() over (partition by scope, paper_id order by g.place, finding_id) - 1 - (count(*) over (partition by scope, paper_id) - 1) / 2.0) * 140 as x from g join r using (scope, paper_id))"""


@query("g9_layout", f"""{_GRAPH} select scope, 'graph-paper:' || paper_id as id, 'paper' as kind, cast(x as double) as x, cast(220 as double) as y, title as label, stale, case status when 'extracted' then 'Extracted' when 'queued' then 'Queued' end as status_label, cast(null as bigint) as paper_count from r
 union all select scope, term_id, kind, cast(x as double), 40, label, stale, null, paper_count from tx union all select scope, 'graph-' || finding_id, 'finding', cast(x as double), 420, case when length(text) > 60 then rtrim(text[1:60]) || '…' else text end, stale, null, null from l""")
def g9_layout(spark, sf_dir):
    return G.graph_view(*pictured(spark, sf_dir), most=40)[1]


@query("g9_graph_edges", f"""{_GRAPH} select scope, term_id || '->graph-paper:' || paper_id as id, kind, term_id as source, 'graph-paper:' || paper_id as target from v join d using (scope) union all select scope, 'graph-paper:' || paper_id || '->graph-' || finding_id, 'finding', 'graph-paper:' || paper_id, 'graph-' || finding_id from l
 union all select distinct p.scope, case when n > 40 then 'too_large' else 'graph' end, 'state', cast(n as varchar), null from p join c on p.scope = c.scope union all select distinct scope, 'empty', 'state', '0', null from e where scope not in (select scope from p)""")
def g9_graph_edges(spark, sf_dir):
    states, _, links = G.graph_view(*pictured(spark, sf_dir), most=40)
    return links.unionByName(states.select("scope", F.col("state").alias("id"), F.lit("state").alias("kind"), F.col("node_count").cast("string").alias("source"), F.lit(None).cast("string").alias("target")))


def pictured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ten customers a scope as papers, three in four of them visible, their segments as terms and their orders as findings."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    scope, paper = F.floor(F.col("c_custkey") / 10).alias("scope"), F.col("c_custkey").alias("paper_id")
    status = F.element_at(F.array(*map(F.lit, ["extracted", "queued", "odd"])), (F.col("c_custkey") % 3 + 1).cast("int"))
    shown = c.where("c_custkey % 4 <> 0").select(scope, paper, F.col("c_name").alias("title"), (F.col("c_acctbal") < 0).alias("stale"), status.alias("status"), F.col("c_mktsegment").alias("place"))
    entries = c.select(scope, F.concat(F.lit("term:"), "c_mktsegment").alias("term_id"), F.lit("concept").alias("kind"), F.lower("c_mktsegment").alias("label"), F.length("c_mktsegment").alias("place"), paper)
    text = F.concat(F.col("o_orderpriority"), F.repeat(F.lit(" words"), (F.col("o_orderkey") % 12).cast("int")))
    found = o.where("o_orderkey % 3 = 0").join(c, F.col("o_custkey") == F.col("c_custkey")).select(scope, paper, F.concat_ws(":", F.lit("finding"), F.col("c_custkey").cast("string"), F.col("o_orderkey").cast("string")).alias("finding_id"), F.col("o_totalprice").alias("place"), text.alias("text"))
    return shown, entries, found


@query("g10_neighbourhood", "with e as (select l_suppkey as a, l_suppkey + l_linenumber as b from lineitem), w as (select a, b from e union all select b, a from e) select distinct a as node, b as neighbour from w where a % 3 = 0")
def g10_neighbourhood(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("b"))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().where("node % 3 = 0")
    return G.neighbourhood(e, nodes)


@query("g11_relationships", f"{_EDGES} select kind, key, paper_id from e where (kind, key) in (select (kind, key) from e group by kind, key having count(distinct paper_id) >= 2)")
def g11_relationships(spark, sf_dir):
    return G.relationships(edges(spark, sf_dir)[0])


# Statements by turns: field, text, action (null: none or several), targets.
_STATEMENTS = [
    ("limitations", "The approach is limited to English language models.", "scope_restriction", "language_model"), ("limitations", "We cannot parse the table structure of scanned pages.", "inability", "table_structure"), ("limitations", "It is not limited to language models.", None, ""),
    ("future_work", "We plan to integrate large models in table recognition.", "integrate", "language_model"), ("future_work", "We plan to integrate large models soon.", "integrate", ""), ("future_work", "Build and evaluate cell content readers.", None, ""), ("future_work", "Evaluate cell-content readers on TSR", "evaluate", "table_content,table_structure"), ("limitations", "Results lack alpha beta coverage of coastal towns.", "missing_capability", ""),
]


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda i, k: F.element_at(F.array(*[F.lit(x[i]) for x in _STATEMENTS]), (k % len(_STATEMENTS) + 1).cast("int"))
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((k % 40).alias("paper_id"), pick(0, k).alias("field_key"), k.alias("item"), pick(1, k).alias("text"))
    return rows.join(held(rows.select("text").distinct().withColumn("statement", G.statement_key(F.col("text"))), "texts"), "text")


def _sql_pick(i: int) -> str:
    return "[" + ", ".join("null" if x[i] is None else "'" + x[i].replace("'", "''") + "'" for x in _STATEMENTS) + f"][o_orderkey % {len(_STATEMENTS)} + 1]"


_SIGNED = f"select o_orderkey % 40 as paper_id, {_sql_pick(0)} as field_key, o_orderkey as item, regexp_replace(lower({_sql_pick(1)}), '\\.$', '') as statement, {_sql_pick(2)} as action, {_sql_pick(3)} as targets from orders"


@query("g13_signatures", f"select paper_id, field_key, item, action, targets from ({_SIGNED}) where action is not null")
def g13_signatures(spark, sf_dir):
    return G.signatures(statements(spark, sf_dir)).select("paper_id", "field_key", "item", "action", F.array_join("targets", ",").alias("targets"))


@query("g12_gap_statements", """with f as (select user_id as paper_id, case when event_id % 2 = 0 then 'limitations' when event_id % 7 = 1 then 'findings' else 'future_work' end as field_key, date_trunc('day', ts) as d, case when event_id % 5 = 0 then 'failed' else 'extracted' end as state, event_id % 11 = 0 as malformed, event_type as item from events),
m as (select *, max(d) over (partition by paper_id, field_key) as m from f where field_key <> 'findings'), g as (select paper_id, field_key, count(distinct (state, malformed, item)) as versions, min(state) as state, bool_or(malformed) as malformed, min(item) as item from m where d = m group by 1, 2)
select paper_id, field_key, 0 as item, item as statement from g where versions = 1 and state = 'extracted' and not malformed""")
def g12_gap_statements(spark, sf_dir):
    n = F.col("event_id")
    field = F.when(n % 2 == 0, "limitations").when(n % 7 == 1, "findings").otherwise("future_work")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("paper_id"), field.alias("field_key"), F.date_trunc("DAY", "ts").alias("updated_at"), F.when(n % 5 == 0, "failed").otherwise("extracted").alias("state"), (n % 11 == 0).alias("malformed"), F.array(F.concat(F.initcap("event_type"), F.lit("."))).alias("items"))
    return G.gap_statements(rows).select("paper_id", "field_key", "item", "statement")


def _related(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two terms that papers have by their number; the second stands in the last statement."""
    rows = spark.range(40).select(F.col("id").alias("paper_id"))
    return rows.where("paper_id % 4 < 2").select(F.lit("concept").alias("kind"), F.lit("gamma").alias("key"), "paper_id").union(rows.where("paper_id % 3 = 0").select(F.lit("dataset"), F.lit("alpha beta"), "paper_id"))


@query("g14_specific", f"select paper_id, field_key, item, 'dataset' as kind, 'alpha beta' as key from ({_SIGNED}) where paper_id % 3 = 0 and contains(statement, 'alpha beta')")
def g14_specific(spark, sf_dir):
    return G.specific(statements(spark, sf_dir), _related(spark, sf_dir))


_GAPS = f"""with s as ({_SIGNED}), r as (select 'concept' as kind, 'gamma' as key, k as paper_id from range(40) t(k) where k % 4 < 2 union all select 'dataset', 'alpha beta', k from range(40) t(k) where k % 3 = 0),
w as (select s.*, r.kind, r.key from s join r using (paper_id) where action is not null), t as (select kind, key, field_key, action, 'target:' || unnest(string_split(targets, ',')) as match, paper_id, item from w where targets <> ''
 union all select kind, key, field_key, action, 'statement:' || statement, paper_id, item from w where targets = '' and key = 'alpha beta' and contains(statement, 'alpha beta')),
g as (select kind, key, field_key, action, match, list_sort(list(distinct cast(paper_id as varchar))) as paper_ids, count(distinct (paper_id, item)) as evidence, bool_or(paper_id % 7 = 0) as stale from t group by 1, 2, 3, 4, 5 having count(distinct paper_id) >= 2),
x as (select field_key, action, match, paper_ids, array_to_string(list_sort(list('term:' || kind || ':' || key)), ',') as related_terms, max(evidence) as evidence, bool_or(stale) as stale from g group by 1, 2, 3, 4)"""


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, related = statements(spark, sf_dir), _related(spark, sf_dir)
    stale = spark.range(40).select(F.col("id").alias("paper_id"), (F.col("id") % 7 == 0).alias("stale"))
    return G.gap_candidates(G.signatures(rows), related, G.specific(rows, related), stale)


@query("g15_gap_candidates", f"{_GAPS} select field_key, action, match, array_to_string(paper_ids, ',') as paper_ids, related_terms, evidence, stale from x")
def g15_gap_candidates(spark, sf_dir):
    return gaps(spark, sf_dir).select("field_key", "action", "match", F.array_join("paper_ids", ",").alias("paper_ids"), F.array_join("related_terms", ",").alias("related_terms"), "evidence", "stale")


# Headings and explanations as the field, action and target of the statements above make them.
_VIEW = f"""{_GAPS}, v as (select field_key, case field_key when 'limitations' then 'recurring_limitation' else 'future_research_opportunity' end as type, case field_key when 'limitations' then 'Recurring limitation' else 'Future research opportunity' end as type_label,
 case match when 'target:language_model' then 'Language-model ' || a when 'target:table_structure' then 'Table-structure ' || a when 'target:table_content' then 'Table-content ' || a else case field_key when 'limitations' then 'Potential recurring limitation in this corpus' else 'Potential future research opportunity in this corpus' end end as heading,
 case match when 'target:language_model' then 'These directly related papers describe a matching ' || f || ' involving ' || a || ' and language models.' when 'target:table_structure' then 'These directly related papers describe a matching ' || f || ' involving ' || a || ' and table structure.' when 'target:table_content' then 'These directly related papers describe a matching ' || f || ' involving ' || a || ' and table content.' else 'These directly related papers contain the same explicit ' || f || ' statement.' end
 || '|' || case related_terms when 'term:concept:gamma' then 'Research Map relationship: Gamma rays' when 'term:dataset:alpha beta' then 'Research Map relationship: Related corpus term' else 'Research Map relationship: Gamma rays|Research Map relationship: Related corpus term' end as explanations, cast(len(paper_ids) as integer) as papers, evidence, stale
 from (select *, replace(case action when 'integrate' then 'integration' when 'evaluate' then 'evaluation' else action end, '_', ' ') as a, case field_key when 'limitations' then 'limitation' else 'future-work direction' end as f from x))"""


def gap_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.createDataFrame([("term:concept:gamma", "Gamma rays"), ("term:dataset:alpha beta", "")], "term_id string, label string")
    return G.gap_view(gaps(spark, sf_dir), labels)


@query("g17_gap_view", f"{_VIEW} select * from v")
def g17_gap_view(spark, sf_dir):
    return gap_views(spark, sf_dir).select("field_key", "type", "type_label", "heading", F.array_join("explanations", "|").alias("explanations"), "papers", "evidence", "stale")


@query("f7_gap_filter", f"{_VIEW} select 'current' as asked, heading, papers from v where type = 'recurring_limitation' and not stale union all select 'stale', heading, papers from v where stale union all select 'all', heading, papers from v where type = 'future_research_opportunity'")
def f7_gap_filter(spark, sf_dir):
    views, out = gap_views(spark, sf_dir), None
    for asked, rows in (("current", G.gap_filter(views, "recurring_limitation", "current")), ("stale", G.gap_filter(views, status="stale")), ("all", G.gap_filter(views, "future_research_opportunity"))):
        rows = rows.select(F.lit(asked).alias("asked"), "heading", "papers")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("a29_gap_types", f"{_VIEW} select stale, string_agg(distinct type, ',' order by type) as types from v group by 1")
def a29_gap_types(spark, sf_dir):
    return G.gap_types(gap_views(spark, sf_dir), "stale").withColumn("types", F.array_join("types", ","))


@query("a17_gap_summary", f"{_GAPS} select (select count(*) from x) as gaps, (select count(distinct p) from (select unnest(paper_ids) as p from x)) as papers, (select count(*) from x where stale) as stale")
def a17_gap_summary(spark, sf_dir):
    g = gaps(spark, sf_dir)
    papers = g.select(F.explode("paper_ids").alias("p")).agg(F.countDistinct("p").alias("papers"))
    return g.agg(F.count("*").alias("gaps"), F.count_if("stale").alias("stale")).crossJoin(papers).select("gaps", "papers", "stale")
