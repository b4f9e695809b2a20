"""Evidence queries: lines of orders as hits and claims, customers as papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import shapes as S
from .citations import _FIELDS, _PAPERS, workspace
from .registry import query, table


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as ranked hits of an order's question, some blank or without text, section or end, some overlapping."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", n.alias("rank"))  # texts are made of what is ranked, not ranked themselves
    start = (F.col("l_quantity") * 10).cast("int")
    q = F.col("l_quantity").cast("int")
    content = F.when(q % 11 == 0, " \n ").when(q % 13 == 0, F.lit(None).cast("string")).otherwise(F.repeat(F.lit("x"), q * 20))
    section = F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey") % 2)
    end = F.when(q % 7 != 0, start + F.col("l_linenumber") * 100)
    return rows.select(F.col("l_orderkey").alias("request"), "rank", section.alias("section_id"), start.alias("char_start"), end.alias("char_end"), content.alias("content"), F.col("l_suppkey").alias("paper_id"), F.col("l_partkey").alias("chunk_id"))


_HITS = """select l_orderkey as request, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as rank, case when l_suppkey % 5 <> 0 then l_suppkey % 2 end as section_id, cast(l_quantity * 10 as integer) as a, case when cast(l_quantity as integer) % 7 <> 0 then cast(l_quantity * 10 as integer) + l_linenumber * 100 end as b,
 case when cast(l_quantity as integer) % 11 = 0 or cast(l_quantity as integer) % 13 = 0 then 0 else cast(l_quantity as integer) * 20 end as size, l_suppkey as paper_id, l_partkey as chunk_id from lineitem"""


@query("e1_chat_evidence", f"""with recursive h as (select * from ({_HITS}) where rank <= 8),
s as (select distinct request, 0 as pos, cast([] as struct(sec bigint, a integer, b integer)[]) as kept, 0 as used, true as open, false as took from h
 union all select request, rank, case when take then list_append(kept, {{'sec': section_id, 'a': a, 'b': b}}) else kept end, case when take then used + size else used end, open and not (offered and not take), take
 from (select h.*, kept, used, open, offered, offered and used + size <= 3000 as take from (select h.request, h.rank, h.section_id, h.a, h.b, h.size, s.kept, s.used, s.open, s.open and h.size > 0 and len(list_filter(s.kept, lambda k: k.sec is not distinct from h.section_id and coalesce(k.a < h.b and h.a < k.b, false))) = 0 as offered from s join h on h.request = s.request and h.rank = s.pos + 1) h))
select request, 'S' || row_number() over (partition by request order by pos) as evidence_id, cast(pos as integer) as rank from s where took""")
def e1_chat_evidence(spark, sf_dir):
    return E.chat_evidence(hits(spark, sf_dir), budget=3000).select("request", "evidence_id", "rank")


_TYPES = sorted({t for types, _ in E.ROUTING.values() for t in types} | set(E.UNROUTED) | {"other"})
_HEADS = ["2.1 Data Collection:", "IV. Experimental Set-up", "Our approach and aims", "Threats to  Validity", "Conclusions", "misaimed notes", "Keywords", ""]
_PLAIN = ["data collection", "experimental set up", "our approach and aims", "threats to validity", "conclusions", "misaimed notes", "keywords", ""]


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs) + "]"


def _route_sql() -> str:
    rows = []
    for k, (field, (types, titles)) in enumerate(E.ROUTING.items()):
        rows.append(f"select p, {k} as k, '{field}' as field, case when list_contains({_sql_list(types)}, t) then list_position({_sql_list(types)}, t) - 1 when t = 'other' and len(list_filter({_sql_list(titles)}, lambda x: contains(' ' || h || ' ', ' ' || x || ' '))) > 0 then 100 when t <> 'other' and list_contains({_sql_list(titles)}, h) then 100 end as pr from s")
    return f"with s as (select p_partkey as p, {_sql_list(_TYPES)}[p_partkey % {len(_TYPES)} + 1] as t, {_sql_list(_PLAIN)}[p_size % {len(_PLAIN)} + 1] as h from part), r as ({' union all '.join(rows)}) select s.p as p_partkey, coalesce(string_agg(field || ':' || pr, ',' order by k) filter (where pr is not null and not list_contains({_sql_list(E.UNROUTED)}, t)), '') as fields from s join r using (p) group by 1"


@query("e2_routing", _route_sql())
def e2_routing(spark, sf_dir):
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    fed = E.route(pick(_TYPES, F.col("p_partkey") % len(_TYPES)), pick(_HEADS, F.col("p_size") % len(_HEADS)))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(fed, lambda x: F.concat_ws(":", x["field"], x["priority"].cast("string"))), ",").alias("fields"))


# A line's hit as a chunk of its order's paper, each chunk in some of the fields; sizes of 4,000 and more never fit.
_FED = "(paper_id * 7 + chunk_id * 3 + f * 5) % 3 = 0"
_PACKET = f"""with recursive h as (select request as paper_id, rank as chunk_id, size * case when request % 9 = 0 then 8 else 1 end as size from ({_HITS})), c as (select h.*, cast(f as integer) as f from h, range(7) t(f) where size > 0 and {_FED}),
q as (select paper_id, list({{'f': f, 'c': chunk_id, 'size': size}} order by chunk_id % 2, chunk_id) as cands from c group by 1),
s as (select paper_id, 0 as step, cast([] as bigint[]) as taken, 0 as used, 0 as idle from q
 union all select paper_id, step + 1, case when pick is null then taken else list_append(taken, pick.c) end, used + coalesce(pick.size, 0), case when pick is null then idle + 1 else 0 end
 from (select s.*, list_filter(cands, lambda x: x.f = s.step % 7 and x.size <= 4000 and s.used + x.size <= 2500 and not list_contains(s.taken, x.c))[1] as pick from s join q using (paper_id) where s.idle < 7 and len(s.taken) < 40)),
t as (select paper_id, arg_max(taken, step) as taken from s group by 1), i as (select paper_id, unnest(list_sort(taken)) as chunk_id, generate_subscripts(taken, 1) as n from t),
p as (select paper_id, 'E' || n as evidence_id, chunk_id, string_agg(['objective', 'methodology', 'dataset', 'findings', 'limitations', 'future_work', 'concepts'][f + 1], ',' order by f) as fields from i join c using (paper_id, chunk_id) group by 1, 2, 3)"""


def packet_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("content") * F.when(F.col("request") % 9 == 0, 8).otherwise(1)
    rows = hits(spark, sf_dir).where(F.col("content").rlike(r"\S")).select(F.col("request").alias("paper_id"), F.col("rank").cast("long").alias("chunk_id"), F.col("rank").alias("chunk_index"), size.alias("size"))
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, E.FIELDS))).alias("f", "field"))  # sizes alone, not texts, are repeated by field
    return rows.where(_FED).withColumn("priority", (F.col("chunk_id") % 2).cast("int")).drop("f")


@query("e3_packet", f"{_PACKET} select * from p")
def e3_packet(spark, sf_dir):
    return E.evidence_packet(packet_candidates(spark, sf_dir), budget=2500)


@query("e3_packet_facts", f"{_PACKET}, r as (select paper_id, count(distinct chunk_id) as routed from c group by 1) select r.paper_id, count(distinct chunk_id) as items, array_to_string(list_filter(['objective', 'methodology', 'dataset', 'findings', 'limitations', 'future_work', 'concepts'], lambda f: not contains(',' || coalesce(string_agg(fields, ','), '') || ',', ',' || f || ',')), ',') as empty_fields, routed - count(distinct chunk_id) as dropped_chunks from r left join p using (paper_id) group by r.paper_id, routed")
def e3_packet_facts(spark, sf_dir):
    rows = packet_candidates(spark, sf_dir)
    return E.packet_facts(rows, E.evidence_packet(rows, budget=2500)).withColumn("empty_fields", F.array_join("empty_fields", ","))


@query("e4_validate_extraction", """with c as (select l_orderkey as paper_id, ['objective', 'methodology', 'dataset', 'findings', 'limitations', 'future_work', 'concepts'][l_linenumber] as field, l_linenumber as k, l_suppkey % 2 as item, l_partkey as ord, 'E' || (cast(l_quantity as integer) % 9) as evidence_id from lineitem where l_linenumber <= 7),
p as (select distinct l_orderkey as paper_id, 'E' || (cast(l_quantity as integer) % 9) as evidence_id from lineitem where l_tax < 0.07),
r as (select c.*, case when p.paper_id is null then 'unknown_id' when evidence_id = 'E3' and field = 'methodology' then 'not_eligible_for_field' when row_number() over (partition by c.paper_id, field, item, evidence_id order by ord) > 1 then 'duplicate_id' end as reason from c left join p using (paper_id, evidence_id))
select paper_id, arg_min('field=' || field || ' item=' || item || ' ' || reason, (k, item, ord)) filter (where reason is not null) as error from r group by 1""")
def e4_validate_extraction(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    eid = F.concat(F.lit("E"), (F.col("l_quantity").cast("int") % 9).cast("string"))
    cited = lines.where("l_linenumber <= 7").select(F.col("l_orderkey").alias("paper_id"), F.element_at(F.array(*map(F.lit, E.FIELDS)), F.col("l_linenumber")).alias("field"), (F.col("l_suppkey") % 2).alias("item"), F.col("l_partkey").alias("ord"), eid.alias("evidence_id"))
    every, fewer = F.array(*map(F.lit, E.FIELDS)), F.array(*[F.lit(f) for f in E.FIELDS if f != "methodology"])
    packet = lines.where("l_tax < 0.07").select(F.col("l_orderkey").alias("paper_id"), eid.alias("evidence_id")).distinct().withColumn("fields", F.when(F.col("evidence_id") == "E3", fewer).otherwise(every))
    return E.validate_extraction(cited, packet)


# Lines of an order as the fields of a model's output, each fault told by what the line holds.
_OUTPUT = """with recursive n as (select l_orderkey as paper, l_linenumber - 1 as k, cast(min(l_quantity) as integer) as q, min(l_suppkey) as s, min(l_partkey) as p, min(l_tax) as tax, min(l_discount) as d from lineitem group by 1, 2),
f as (select o_orderkey as paper, cast(k as integer) as k, ['objective', 'methodology', 'dataset', 'findings', 'limitations', 'future_work', 'concepts'][k + 1] as name from orders, range(7) t(k) where exists (select 1 from lineitem where l_orderkey = o_orderkey)),
i as (select f.paper, f.k, name, unnest(list_filter([
 case when n.paper is not null and tax = 0.08 then 'fields.' || name || '.state invalid_value' end, case when n.paper is not null and d = 0.1 then 'fields.' || name || '.items invalid_type' end,
 case when n.paper is not null and d <> 0.1 and q = 1 then 'fields.' || name || '.items.0.text too_small' end, case when n.paper is not null and d <> 0.1 and q > 45 then 'fields.' || name || '.items.0.text too_big' end,
 case when n.paper is not null and d <> 0.1 and s % 9 > 0 and p % 20 = 0 then 'fields.' || name || '.items.0.evidence_ids.0 invalid_format' end,
 case when n.paper is not null and d <> 0.1 and s % 9 = 0 then 'fields.' || name || '.items.0.evidence_ids too_small' end, case when n.paper is not null and d <> 0.1 and s % 9 > 5 then 'fields.' || name || '.items.0.evidence_ids too_big' end,
 case when n.paper is null and f.paper % 37 = 0 then 'fields.' || name || ' custom' end], lambda x: x is not null)) as issue, unnest(range(10)) as z from f left join n on n.paper = f.paper and n.k = f.k),
j as (select paper, list(issue order by k, z) as xs from i where issue is not null group by 1), g as (select distinct paper from f),
x as (select g.paper, list_concat(coalesce(xs, []), case when g.paper % 31 = 0 then ['fields unrecognized_keys'] else [] end) as xs from g left join j using (paper)),
c as (select paper, k, unnest(range(0, s % 9)) as ord from n where s % 9 > 0), b as (select paper, arg_min('field=' || name || ' item=0 unknown_id', (k, ord)) as detail from c join f using (paper, k) where ord + 1 > 1 + paper % 5 group by 1)
select x.paper as paper_id, case when len(xs) > 0 then 'invalid_output' when detail is not null then 'invalid_citation' end as error,
 case when len(xs) > 0 then ('schema_validation ' || array_to_string(xs[1:5], ', ') || case when len(xs) > 5 then ' (+' || (len(xs) - 5) || ' more)' else '' end)[1:300] when detail is not null then 'citation ' || detail end as diagnostic from x left join b using (paper)"""


@query("e4_output_shapes", _OUTPUT)
def e4_output_shapes(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "paper_id").repartition("paper_id")
    lines = rows.groupBy("paper_id", F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p"), F.min("l_tax").alias("tax"), F.min("l_discount").alias("d"))
    packed = lines.groupBy("paper_id").agg(F.collect_list(F.struct("n", "q", "s", "p", "tax", "d")).alias("xs"))

    def told(x: Column) -> Column:
        ids = F.transform(F.slice(F.array(*map(F.lit, range(1, 9))), 1, (x["s"] % 9).cast("int")), lambda k: F.when((k == 1) & (x["p"] % 20 == 0), "X1").otherwise(F.concat(F.lit("E"), k.cast("string"))))
        text = F.when(x["q"] == 1, " \t").otherwise(F.repeat(F.lit("x"), x["q"] * 11))
        one = F.struct(F.when(x["tax"] == 0.08, "maybe").otherwise("extracted").alias("state"), F.when(x["d"] != 0.1, F.array(F.struct(text.alias("text"), ids.alias("evidence_ids")))).alias("items"))
        return F.struct(F.element_at(F.array(*map(F.lit, E.FIELDS)), x["n"]), F.to_json(one))

    # the outputs are written out once the lines of a paper are together
    filled = packed.select("paper_id", F.map_from_entries(F.transform("xs", told)).alias("m"))
    empty = F.when(F.col("paper_id") % 37 == 0, '{"state":"extracted","items":[]}').otherwise('{"items":[],"state":"not_reported"}')
    fields = F.concat_ws(",", *[F.concat(F.lit(f'"{f}":'), F.coalesce(F.try_element_at("m", F.lit(f)), empty)) for f in reversed(E.FIELDS)], F.when(F.col("paper_id") % 31 == 0, '"extra":1'))
    outputs = filled.select("paper_id", F.concat(F.lit('{"fields":{'), fields, F.lit("}}")).alias("output"))
    packet = rows.select("paper_id").distinct().select("paper_id", F.explode(F.sequence(F.lit(1), (F.col("paper_id") % 5 + 1).cast("int"))).alias("k")).select("paper_id", F.concat(F.lit("E"), F.col("k").cast("string")).alias("evidence_id"), F.array(*map(F.lit, E.FIELDS)).alias("fields"))
    return S.checked_extractions(outputs, packet)


_VALUES = ['{"items":[{"text":"a"},{"text":"b c"}]}', '{"items":[{"text":" "},{"text":"x"}]}', '{"items":[{"text":5},{"text":"y"}]}', '{"items":"none"}', '["items"]', '{"items":[]}', "not json", '{"items":["z",{"text":"w"}]}']  # noqa: E501


@query("e5_field_value", f"""with v as (select event_id, {_sql_list(_VALUES)}[event_id % 8 + 1] as v from events), j as (select *, case when json_valid(v) and json_type(v, '$.items') = 'ARRAY' then cast(json_extract(v, '$.items') as json[]) end as e from v),
t as (select *, list_transform(e, lambda x: case when json_type(x, '$.text') = 'VARCHAR' and trim(json_extract_string(x, '$.text')) <> '' then json_extract_string(x, '$.text') end) as t from j)
select event_id, array_to_string(list_filter(coalesce(t, []), lambda x: x is not null), '|') as items, e is null or len(list_filter(t, lambda x: x is null)) > 0 as malformed from t""")
def e5_field_value(spark, sf_dir):
    value = F.element_at(F.array(*map(F.lit, _VALUES)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", E.parse_field(value).alias("p")).select("event_id", F.array_join("p.items", "|").alias("items"), "p.malformed")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    papers, fields = workspace(spark, sf_dir)
    extraction = F.when(F.col("paper_id") % 13 == 0, "running").otherwise(F.col("matrix_status"))
    return E.matrix_rows(papers.select("paper_id", "status"), papers.where("matrix_status is not null").select("paper_id", extraction.alias("extraction"), F.col("matrix_stale").alias("stale")), fields.select("paper_id", "field_key", "state", "items"))


_STATUS = "case when status <> 'ready' then 'waiting' when matrix_status is null then 'not_extracted' when paper_id % 13 = 0 then 'extracting' when matrix_status = 'complete' and matrix_stale then 'out_of_date' when matrix_status = 'complete' then 'extracted' else matrix_status end"


@query("e8_matrix_rows", f"""with p as ({_PAPERS}), d as ({_FIELDS}), c as (select paper_id, field_key, case when state in ('failed', 'not_reported') then state else 'extracted:' || items[1] || '+0' end as shown from d)
select p.paper_id, {_STATUS} as status, """ + ", ".join(f"coalesce(max(shown) filter (where field_key = '{f}'), 'missing') as {f}" for f in E.FIELDS) + " from p left join c using (paper_id) group by all")
def e8_matrix_rows(spark, sf_dir):
    shown = lambda f: F.when(F.col(f"{f}.kind") == "extracted", F.concat(F.lit("extracted:"), F.col(f"{f}.first"), F.lit("+"), F.col(f"{f}.more").cast("string"))).otherwise(F.col(f"{f}.kind"))
    return matrix(spark, sf_dir).select("paper_id", "status", *[shown(f).alias(f) for f in E.FIELDS])


@query("a15_matrix_summary", f"select count(*) as total, count(*) filter (where s = 'extracted') as current, count(*) filter (where s in ('queued', 'extracting')) as active, count(*) filter (where s in ('out_of_date', 'partial', 'failed')) as attention from (select {_STATUS} as s from ({_PAPERS}))")
def a15_matrix_summary(spark, sf_dir):
    return matrix(spark, sf_dir).agg(*E.matrix_summary(F.col("status")))


@query("j15_claim_sources", """with c as (select distinct l_orderkey as paper_id, l_linenumber as item from lineitem), s as (select *, row_number() over (partition by l_orderkey, l_linenumber % 4 order by l_partkey, l_suppkey) as n from lineitem where l_linenumber <> 2)
select c.paper_id, c.item, coalesce(string_agg(cast(l_suppkey as varchar), ',' order by n), '') as chunks from c left join s on l_orderkey = c.paper_id and l_linenumber % 4 = c.item and n <= 3 group by 1, 2""")
def j15_claim_sources(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("field_key", F.lit("findings"))
    claims = lines.select(F.col("l_orderkey").alias("paper_id"), "field_key", F.col("l_linenumber").alias("item")).distinct()
    sources = lines.where("l_linenumber <> 2").select(F.col("l_orderkey").alias("paper_id"), "field_key", (F.col("l_linenumber") % 4).alias("item"), F.col("l_partkey").alias("ord"), F.col("l_suppkey").alias("chunk_id"))
    return E.claim_sources(claims, sources).select("paper_id", "item", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"))


@query("e11_writer_packet", f"""with recursive h as (select request, paper_id, chunk_id, min((lpad(cast(rank as varchar), 6, '0'), size)) as c from ({_HITS}) group by 1, 2, 3),
u as (select request, paper_id, '["chunk","' || paper_id || '","' || chunk_id || '"]' as identity, c[1] as sort_key, c[2] as size from h),
o as (select *, row_number() over (partition by request, paper_id order by sort_key, identity) as turn from u), f as (select request, paper_id, row_number() over (partition by request order by sort_key, paper_id) as paper_rank from o where turn = 1),
x as (select o.*, paper_rank, row_number() over (partition by request order by turn, paper_rank) as pos from o join f using (request, paper_id) where paper_rank <= 5 and size > 0),
s as (select distinct request, cast(0 as bigint) as pos, 0 as n, 0 as used, false as took, '' as identity, cast(0 as bigint) as paper_id from x
 union all select x.request, x.pos, s.n + cast(s.n < 4 and s.used + x.size <= 2000 as integer), s.used + case when s.n < 4 and s.used + x.size <= 2000 then x.size else 0 end, s.n < 4 and s.used + x.size <= 2000, x.identity, x.paper_id from s join x on x.request = s.request and x.pos = s.pos + 1)
select request, 'W' || n as evidence_id, paper_id, identity from s where took""")
def e11_writer_packet(spark, sf_dir):
    return E.writer_packet(E.semantic_candidates(hits(spark, sf_dir)), most=4, budget=2000)


@query("e10_matrix_candidates", f"""with p as ({_PAPERS}), d as ({_FIELDS}), m as (select * from (values ('compare_studies', 'objective', 0), ('compare_studies', 'methodology', 1), ('compare_studies', 'dataset', 2), ('compare_studies', 'findings', 3), ('methodology_summary', 'methodology', 0), ('methodology_summary', 'dataset', 1), ('findings_synthesis', 'findings', 0), ('limitations_future_work', 'limitations', 0), ('limitations_future_work', 'future_work', 1)) t(mode, field_key, o)),
v as (select paper_id, version from p, range(1, 3) r(version) where matrix_status in ('complete', 'partial') and not matrix_stale and (version = 1 or paper_id % 4 = 0))
select p.scope as request, p.paper_id, '["extraction_claim","' || p.paper_id || '",' || version || ',"' || d.field_key || '",0]' as identity, '["paper ' || p.paper_id % 50 || '","' || p.paper_id || '","' || lpad(cast(o as varchar), 2, '0') || '","000"]' as sort_key, d.field_key, case version when 1 then trim(d.items[1]) else 'newer' end as text
from p join m on m.mode = ['compare_studies', 'methodology_summary', 'findings_synthesis', 'limitations_future_work'][p.scope % 4 + 1] join d on d.paper_id = p.paper_id and d.field_key = m.field_key join v on v.paper_id = p.paper_id
where p.status = 'ready' and d.state = 'extracted' and not d.malformed and (p.paper_id + o) % 3 <> 0 and (version = 2 or trim(d.items[1]) <> '')""")
def e10_matrix_candidates(spark, sf_dir):
    papers, fields = workspace(spark, sf_dir)
    mode = F.element_at(F.array(*map(F.lit, ["compare_studies", "methodology_summary", "findings_synthesis", "limitations_future_work"])), F.col("scope") % 4 + 1)
    requests = papers.select(F.col("scope").alias("request"), mode.alias("mode"), "paper_id")
    of = papers.where("matrix_status is not null").select("paper_id", F.col("matrix_status").alias("extraction"), F.col("matrix_stale").alias("stale"))
    # every fourth paper has a second version, and fields of a version that no overview knows
    overviews = of.withColumn("schema_version", F.lit(1)).union(of.where("paper_id % 4 = 0").withColumn("schema_version", F.lit(2)))
    told = fields.withColumn("updated_at", F.lit(1)).select("paper_id", "field_key", "updated_at", "state", "malformed", "items")
    versions = told.withColumn("schema_version", F.lit(1)).unionByName(told.withColumn("items", F.array(F.lit(" newer "))).withColumn("schema_version", F.lit(2))).unionByName(told.withColumn("schema_version", F.lit(3)))
    sources = fields.join(requests, "paper_id").join(spark.createDataFrame([(m, f, k) for m, fs in E.MODE_FIELDS.items() for k, f in enumerate(fs)], "mode string, field_key string, o int"), ["mode", "field_key"]).where((F.col("paper_id") + F.col("o")) % 3 != 0).select("paper_id", "field_key", F.lit(0).alias("item"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("schema_version"))
    titled = papers.select("paper_id", F.concat(F.lit("PAPER "), (F.col("paper_id") % 50).cast("string")).alias("title"), "status")
    return E.matrix_candidates(requests, titled, overviews, versions, sources)


@query("e12_sufficiency", """with c as (select o_orderkey, ['literature_synthesis', 'compare_studies', 'methodology_summary', 'findings_synthesis'][o_orderkey % 4 + 1] as mode, count(l_orderkey) as items, count(distinct l_suppkey) as papers, count(*) filter (where l_linenumber = 2) as methodology, count(distinct l_suppkey) filter (where l_tax < 0.05) as comparable from orders left join lineitem on l_orderkey = o_orderkey and l_quantity > 25 group by 1)
select o_orderkey, case when items = 0 then case when o_orderkey % 3 = 0 then 'stale_only' else 'no_evidence' end when case mode when 'methodology_summary' then methodology > 0 when 'compare_studies' then comparable >= 2 else papers >= 2 end then 'ready' else 'insufficient_evidence' end as status from c""")
def e12_sufficiency(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 25")
    counts = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_orderkey").alias("items"), F.countDistinct("l_suppkey").alias("papers"), F.count_if(F.col("l_linenumber") == 2).alias("methodology"), F.countDistinct(F.when(F.col("l_tax") < 0.05, F.col("l_suppkey"))).alias("comparable"))
    mode = F.element_at(F.array(*map(F.lit, ["literature_synthesis", "compare_studies", "methodology_summary", "findings_synthesis"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    items = F.col("items")
    stale = F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)
    return counts.select("o_orderkey", E.sufficiency(mode, items, stale, items, F.col("papers"), F.col("methodology"), F.col("comparable"), F.col("comparable")).alias("status"))


@query("e13_claim_packet", """with s as (select l_orderkey as claim, cast((l_linenumber - 1) // 4 as integer) as ord, l_linenumber, l_partkey, l_suppkey, l_extendedprice, case when l_linenumber % 2 = 0 then 0 else cast(l_quantity as integer) * 30 end as n, case when l_suppkey % 3 = 0 then 0 else 7 end as m from lineitem),
t as (select *, case when n > 1200 then 1200 when n > 0 then n when m > 0 then m end as size, row_number() over (partition by claim, ord order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place from s),
u as (select *, row_number() over (partition by claim, ord order by size is null, place) as k from t), e as (select claim, ord, sum(size + 10) filter (where k <= 3) as body, count(size) filter (where k <= 3) as lines from u group by 1, 2),
l as (select claim, ord, case when lines > 0 then body + lines - 1 + case when claim % 2 = 0 then 27 else 0 end end as size from e),
w as (select claim, bool_or(size is null) as lacking, sum(size) as total from l group by 1)
select claim, ord, case when not lacking and total <= 4000 then 'C' || row_number() over (partition by claim order by ord) end as evidence_id, case when not lacking and total <= 4000 then cast(size as integer) end as size, case when lacking then 'no_usable_source' when total > 4000 then 'evidence_budget_exceeded' else 'ready' end as status from l join w using (claim)""")
def e13_claim_packet(spark, sf_dir):
    n = F.col("l_linenumber")
    one = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("claim"), F.floor((n - 1) / 4).cast("int").alias("ord")).agg(F.array_sort(F.collect_list(one)).alias("s"))
    # texts are made of a citation's lines once they are together
    content = lambda x: F.when(x["l_linenumber"] % 2 != 0, F.repeat(F.lit("y"), x["q"] * 30))
    sources = F.transform("s", lambda x: F.struct(F.when(x["l_suppkey"] % 3 != 0, "excerpt").alias("excerpt"), content(x).alias("content")))
    cites = rows.select("claim", "ord", F.when(F.col("claim") % 2 == 0, "the claim").otherwise("").alias("claim_text"), sources.alias("sources"))
    return E.claim_packet(cites, budget=4000).select("claim", "ord", "evidence_id", "size", "status")


_SEGMENTS = "select l_orderkey as request, l_linenumber as n, case when l_partkey % 8 <> 0 then ['S' || (l_partkey % 6), 'S' || (l_suppkey % 6), 'S' || (l_partkey % 6)] end as cited, case when l_suppkey % 9 = 0 then ' ' when l_partkey % 10 <> 3 then 't' || l_linenumber end as t from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)"


@query("e14_answer_validation", f"""with s as (select request, n, t, list_filter(cited, lambda c: c in ('S1', 'S2', 'S4')) as v from ({_SEGMENTS})), k as (select request, string_agg(t || ':' || array_to_string(case when len(v) > 1 and v[2] <> v[1] then [v[1], v[2]] else [v[1]] end, ','), ' ' order by n) as answer from s where len(v) > 0 and trim(t) <> '' group by 1)
select o.request, answer from (select distinct request from s) o left join k using (request)""")
def e14_answer_validation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("x"))
    p, s = F.concat(F.lit("S"), (F.col("x.l_partkey") % 6).cast("string")), F.concat(F.lit("S"), (F.col("x.l_suppkey") % 6).cast("string"))
    text = F.when(F.col("x.l_suppkey") % 9 == 0, " ").when(F.col("x.l_partkey") % 10 != 3, F.concat(F.lit("t"), F.col("l_linenumber").cast("string")))
    one = F.struct("l_linenumber", text.alias("text"), F.when(F.col("x.l_partkey") % 8 != 0, F.array(p, s, p)).alias("citations"))
    rows = lines.groupBy(F.col("l_orderkey").alias("request")).agg(F.array_sort(F.collect_list(one)).alias("segments"))
    answer = E.validate_answer(F.col("segments"), F.array(*map(F.lit, ["S1", "S2", "S4"])))
    return rows.select("request", F.array_join(F.transform(answer, lambda x: F.concat_ws(":", x["text"], F.array_join(x["citations"], ","))), " ").alias("answer"))


@query("e18_answer_limits", f"with s as (select request, count(*) as n, sum(400 * n) as total, max(400 * n) as longest, bool_or(n = request % 11 or n = request % 13 or n = request % 17) as odd from ({_SEGMENTS}) group by 1) select request, n <= 12 and longest <= 1500 and total <= 6000 and not odd as good from s")
def e18_answer_limits(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n, key = F.col("l_linenumber"), F.col("l_orderkey")
    cites = F.when(n != key % 11, F.array(F.lit("S1"), F.when(n != key % 17, "S2")))
    one = F.struct(F.when(n != key % 13, F.concat(F.lit(" "), F.repeat(F.lit("z"), n * 400))).alias("text"), cites.alias("citations"))
    return lines.groupBy(F.col("l_orderkey").alias("request")).agg(F.collect_list(one).alias("segments")).select("request", E.answer_in_limits(F.col("segments")).alias("good"))


@query("e15_draft_validation", """with u as (select l_orderkey as draft, cast((l_linenumber - 1) // 2 as integer) as paragraph, l_linenumber as place, 'W' || (l_partkey % 5 + 1) as c1, 'W' || (l_suppkey % 7 + 1) as c2, l_quantity = 13 as marked, l_quantity = 17 as textless, l_quantity = 19 as citeless, cast(l_quantity as integer) * 9 as size from (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
k as (select distinct draft, 'W' || r as id from u, range(1, 7) t(r) where r <= 5 or draft % 2 = 0), b as (select u.*, citeless or c1 = c2 or a.id is null or c.id is null as bad from u left join k a on a.draft = u.draft and a.id = c1 left join k c on c.draft = u.draft and c.id = c2),
n as (select *, row_number() over (partition by draft order by paragraph, place) as number from b), w as (select draft, bool_or(bad) as cite, bool_or(marked or textless) as content, sum(case when textless then 0 else size end + case when marked then 6 else 0 end) as size, count(*) as n, max(paragraph) as last, string_agg('U' || number || ':' || least(c1, c2) || ',' || greatest(c1, c2), ' ' order by number) as units from n group by 1),
e as (select *, case when cite then 'invalid_citation' when content or size > 4000 then 'invalid_content' when n > 10 then 'invalid_output' end as error from w) select draft, error, case when error is null then units end as units from e""")
def e15_draft_validation(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_partkey", "l_suppkey", "l_quantity"), F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("x"))
    wid = lambda c, m: F.concat(F.lit("W"), (F.col(c) % m + 1).cast("string"))
    text = F.concat(F.repeat(F.lit("t"), F.col("x.l_quantity").cast("int") * 9), F.when(F.col("x.l_quantity") == 13, " [W12]").otherwise(""))
    told, cited = F.when(F.col("x.l_quantity") != 17, text), F.when(F.col("x.l_quantity") != 19, F.array(wid("x.l_partkey", 5), wid("x.l_suppkey", 7)))
    units = lines.select(F.col("l_orderkey").alias("draft"), F.floor((F.col("l_linenumber") - 1) / 2).cast("int").alias("paragraph"), F.col("l_linenumber").alias("place"), told.alias("text"), cited.alias("citations"))
    ids = units.select("draft").distinct().select("draft", F.explode(F.sequence(F.lit(1), F.when(F.col("draft") % 2 == 0, 6).otherwise(5))).alias("r"))
    return E.validate_draft(units, ids.select("draft", F.concat(F.lit("W"), F.col("r").cast("string")).alias("evidence_id")))


_CHECKS = [
    # overall, supports, ids, claim, fragments, texts, whether it holds
    ("supported", ["supported"], ["C1"], "A b c", [], ["fine"], True), ("supported", ["partially_supported"], ["C1"], "A b c", [], ["fine"], False), ("supported", ["partially_supported", "partially_supported"], ["C1", "C2"], "A b c", [], ["fine"], True),
    ("partially_supported", ["partially_supported"], ["C1"], "A b c", ["B  C"], ["fine"], True), ("partially_supported", ["partially_supported"], ["C1"], "A b c", ["a b c"], ["fine"], False), ("unsupported", ["unsupported"], ["C1"], "A b c", ["d"], ["fine"], False),
    ("unsupported", ["unsupported"], ["C1"], "A b c", ["a"], ["see **this**"], False), ("insufficient_evidence", ["unsupported"], ["C1"], "A b c", [], ["as W12 says"], False), ("insufficient_evidence", ["unsupported"], ["C1"], "A b c", [], ["fine"], True),
    ("unsupported", ["unsupported", "unsupported"], ["C1", "C1"], "A b c", ["a"], ["fine"], False), ("unsupported", ["unsupported"], ["C1"], "A b c", ["b", "B"], ["fine"], False), ("supported", ["supported"], ["C1"], "A b c", ["b"], ["fine"], False),
    ("supported", ["supported"], ["C1"], None, [], ["fine"], False), ("supported", ["supported"], ["C1"], "A b c", [], [None], False), (None, ["unsupported"], ["C1"], "A b c", [], ["fine"], False), ("supported", ["supported", None], ["C1", "C2"], "A b c", [], ["fine"], False),
]


@query("e17_assessment", f"select o_orderkey, {_sql_list([x[-1] for x in _CHECKS])}[o_orderkey % {len(_CHECKS)} + 1] = 'True' as valid from orders")
def e17_assessment(spark, sf_dir):
    texts = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    cases = F.array(*[F.struct(F.lit(o).alias("overall"), texts(s).alias("supports"), texts(i).alias("ids"), F.array(*[F.lit(f"C{k + 1}") for k in range(len(i))]).alias("expected"), F.lit(c).alias("claim"), texts(f).alias("fragments"), texts(t).alias("texts")) for o, s, i, c, f, t, _ in _CHECKS])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.element_at(cases, (F.col("o_orderkey") % len(_CHECKS) + 1).cast("int")).alias("x"))
    return E.valid_assessments(rows.select("o_orderkey", "x.*")).select("o_orderkey", "valid")


@query("e19_prompt", """with l as (select distinct on (l_orderkey, l_linenumber) * from lineitem order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
select l_orderkey as request, '<<<EVIDENCE n' || l_orderkey || '>>>' || chr(10) || string_agg('[S' || l_linenumber || '] ' || l_returnflag || ' | pages ' || l_partkey || chr(10) || l_linestatus, chr(10) || chr(10) order by l_linenumber) || chr(10) || '<<<END n' || l_orderkey || '>>>' as prompt from l group by 1""")
def e19_prompt(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min_by(F.struct("l_partkey", "l_returnflag", "l_linestatus"), F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("x"))
    rows = lines.select(F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("place"), F.concat(F.lit("S"), F.col("l_linenumber").cast("string")).alias("evidence_id"), F.col("x.l_returnflag").alias("title"), F.col("x.l_partkey").cast("string").alias("pages"), F.col("x.l_linestatus").alias("content"))
    return E.prompt(rows, F.concat(F.lit("n"), F.col("request").cast("string")))
