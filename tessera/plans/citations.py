"""Citation and inspection queries: parts as papers, orders as drafts that cite them line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import citations as C
from ..operators import relational as R
from .registry import dealt, query, table


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as untidy citation metadata: blank titles, odd years, DOIs and addresses in several shapes."""
    k = F.col("p_partkey")
    names = F.split("p_name", " ")
    doi = F.when(k % 4 == 0, F.concat(F.lit("https://doi.org/10.1234/Part."), k.cast("string"))).when(k % 4 == 1, F.concat(F.lit(" DOI: 10."), (k % 3000).cast("string"), F.lit("/x"))).when(k % 4 == 2, "10.1234/has space")
    url = F.when(k % 5 == 0, F.concat(F.lit("HTTPS://Example.ORG:443/p/"), k.cast("string"))).when(k % 5 == 1, "http://user@example.org/").when(k % 5 == 2, "ftp://example.org/x").when(k % 5 == 3, F.concat(F.lit("http://example.org?q="), k.cast("string")))
    authors = F.slice(F.concat(names, F.array(F.lit("  "), F.concat(F.lit(" "), "p_brand", F.lit("\t  Jr ")))), 1, (k % 6).cast("int"))
    return dealt(spark, sf_dir, "part").select(
        k.alias("paper_id"), F.when(k % 7 == 0, " \n ").otherwise(F.concat(F.lit("  On\t"), "p_name", F.lit(" \n again "))).alias("title"), authors.alias("authors"), (F.lit(990) + k).cast("int").alias("publication_year"),
        F.when(k % 3 == 0, F.col("p_type")).alias("container_title"), F.when(k % 2 == 0, F.col("p_brand")).alias("publisher"), doi.alias("doi"), url.alias("url"), F.when(k % 3 == 1, F.col("p_size").cast("string")).alias("volume"), F.when(k % 8 == 1, "4").alias("issue"), F.when(k % 3 == 2, "1–9").alias("pages"),
    )


_RAW = """select p_partkey as k, case when k % 7 = 0 then '' else 'On ' || p_name || ' again' end as title, p_brand, string_split(p_name, ' ') as w,
 list_filter(list_transform(list_slice(list_concat(w, ['  ', ' ' || p_brand || ' Jr ']), 1, k % 6), lambda a: trim(a)), lambda a: a <> '') as authors,
 case when 990 + k between 1000 and 3000 then cast(990 + k as integer) end as year, case when k % 3 = 0 then p_type end as container, case when k % 2 = 0 then p_brand end as publisher,
 case k % 4 when 0 then '10.1234/part.' || k when 1 then case when k % 3000 >= 1000 then '10.' || (k % 3000) || '/x' end end as doi,
 case k % 5 when 0 then 'https://example.org/p/' || k when 3 then 'http://example.org/?q=' || k end as url,
 case when k % 3 = 1 then cast(p_size as varchar) end as volume, case when k % 8 = 1 then '4' end as issue, case when k % 3 = 2 then '1–9' end as pages from part"""
_AUTHORS = "case len(authors) when 0 then '' when 1 then authors[1] when 2 then authors[1] || ' and ' || authors[2] else array_to_string(authors[:-2], ', ') || ', and ' || authors[-1] end"


@query("c1_normalize_metadata", f"select k as paper_id, title, array_to_string(authors, '|') as authors, year as publication_year, container as container_title, publisher, volume, issue, pages, doi, url from ({_RAW})")
def c1_normalize_metadata(spark, sf_dir):
    return C.normalize_metadata(metadata(spark, sf_dir)).withColumn("authors", F.array_join("authors", "|"))


@query("c3_url_form", """select p_partkey as k, case p_partkey % 8 when 0 then 'http://p' || p_partkey || '.example.com/a/' || replace(p_name, ' ', '%20') || '?q=%27' || p_size || '%27' when 1 then 'http://0.0.' || (p_partkey // 256 % 256) || '.' || (p_partkey % 256) || '/' when 2 then case when 65000 + p_partkey % 1000 <= 65535 then 'https://h:' || (65000 + p_partkey % 1000) || '/x/' end
 when 3 then null when 4 then 'http://xn--bcher-kva.de/%C3%BC#' || replace(p_name, ' ', '%20') when 5 then 'http://[2001:db8::' || lower(printf('%x', (p_partkey % 65000 + 1)::bigint)) || ']/' when 6 then 'https://' || lower(replace(p_brand, '#', '-')) || '/' when 7 then null end as url from part""")
def c3_url_form(spark, sf_dir):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    raw = (
        F.when(k % 8 == 0, F.concat(F.lit("HTTP://P"), s(k), F.lit(".Example.COM:80/a/./b/../"), "p_name", F.lit("?q='"), s(F.col("p_size")), F.lit("'")))
        .when(k % 8 == 1, F.concat(F.lit("http:"), s(k % 65536))).when(k % 8 == 2, F.concat(F.lit("https://h:0"), s(65000 + k % 1000), F.lit("\\y\\..\\x\\"))).when(k % 8 == 3, F.concat(F.lit("https://user@h/"), "p_name"))
        .when(k % 8 == 4, F.concat(F.lit("http://Bücher.de/ü#"), "p_name")).when(k % 8 == 5, F.concat(F.lit("http://[2001:0DB8:0:0:0:0:0:"), F.hex(k % 65000 + 1), F.lit("]"))).when(k % 8 == 6, F.concat(F.lit("https://"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit(":443"))).otherwise(F.concat(F.lit("ftp://"), "p_name"))
    )
    return dealt(spark, sf_dir, "part").select(k.alias("k"), C.normalize_url(raw).alias("url"))


@query("c2_doi_c3_url", f"select k as paper_id, doi, url from ({_RAW})")
def c2_doi_c3_url(spark, sf_dir):
    rows = metadata(spark, sf_dir)
    return rows.select("paper_id", C.normalize_doi(F.col("doi")).alias("doi"), C.normalize_url(F.col("url")).alias("url"))


@query("c4_completeness", f"select k as paper_id, array_to_string(list_filter([case when title = '' then 'title' end, case when len(authors) = 0 then 'authors' end, case when year is null then 'publicationYear' end], lambda x: x is not null), ',') as missing from ({_RAW})")
def c4_completeness(spark, sf_dir):
    m = C.normalize_metadata(metadata(spark, sf_dir))
    return m.select("paper_id", F.array_join(C.missing_fields(F.col("title"), F.col("authors"), F.col("publication_year")), ",").alias("missing"))


@query("c5_author_list", f"select k as paper_id, {_AUTHORS} as authors from ({_RAW})")
def c5_author_list(spark, sf_dir):
    return C.normalize_metadata(metadata(spark, sf_dir)).select("paper_id", C.author_list(F.col("authors")).alias("authors"))


_REFERENCE = f"""with r as ({_RAW}), t as (select *, {_AUTHORS} as who, list_filter([container, 'vol. ' || volume, 'no. ' || issue, 'pp. ' || pages, publisher, cast(year as varchar)], lambda x: x is not null) as more from r),
n as (select *, case when title <> '' then concat_ws(', ', nullif(who, ''), '“' || title || case when len(more) > 0 then ',”' else '.”' end) else who end as named from t),
b as (select *, case when len(more) > 0 then concat_ws(' ', nullif(named, ''), array_to_string(more, ', ') || '.') when named <> '' and not ends_with(named, '.”') then named || '.' else named end as body from n)
select k, concat_ws(' ', '[' || {{number}} || ']', nullif(body, ''), coalesce('https://doi.org/' || doi, url)) as line from b"""


@query("c6_references", f"select k as paper_id, line as reference from ({_REFERENCE.format(number='k')})")
def c6_references(spark, sf_dir):
    return C.normalize_metadata(metadata(spark, sf_dir)).select("paper_id", C.reference(F.col("paper_id")).alias("reference"))


def cites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as citations of drafts: evidence ids of a unit (two lines a unit) in order."""
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.floor((n - 1) / 2).cast("int").alias("unit"), n.alias("ord"), F.concat(F.lit("W"), n.cast("string")).alias("evidence_id"), F.col("l_partkey").alias("paper_id"))


_CITES = "select l_orderkey as draft, cast((l_linenumber - 1) // 2 as integer) as unit, l_linenumber as ord, 'W' || l_linenumber as evidence_id, l_partkey as paper_id from lineitem"
_NUMBERED = f"select draft, paper_id, row_number() over (partition by draft order by min(ord), paper_id) as number from ({_CITES}) group by 1, 2"


def numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_use_numbers(cites(spark, sf_dir), "draft", "ord", "paper_id").select("draft", "paper_id", "number")


@query("c7_markers", f"select draft, string_agg('[' || number || ']', ' ' order by number) as markers from ({_NUMBERED}) group by 1")
def c7_markers(spark, sf_dir):
    return numbered(spark, sf_dir).groupBy("draft").agg(C.markers(F.array_sort(F.collect_list("number"))).alias("markers"))


@query("c7_reference_list", f"""with n as ({_NUMBERED}), l as (select draft, number, coalesce(replace(line, '[@]', '[' || number || ']'), '[' || number || ']') as line from n left join ({_REFERENCE.format(number="'@'")}) on k = paper_id and k % 9 <> 0)
select draft, string_agg(line, chr(10) order by number) as "references" from l group by 1""")
def c7_reference_list(spark, sf_dir):
    known = C.normalize_metadata(metadata(spark, sf_dir).where("paper_id % 9 <> 0"))
    return C.reference_list(numbered(spark, sf_dir), known)


@query("c9_attached_references", f"""with n as ({_NUMBERED}), r as (select * from ({_RAW}) where k % 9 <> 0)
select draft, cast(number as integer) as number, paper_id, case when k is null then coalesce(p_name, '') else title end as title, case when k is null then '' else array_to_string(authors, '|') end as authors, year as publication_year, k is null as is_fallback
from n left join r on k = paper_id left join (select p_partkey, p_name from part where p_partkey % 2 = 0) on p_partkey = paper_id""")
def c9_attached_references(spark, sf_dir):
    known = C.normalize_metadata(metadata(spark, sf_dir).where("paper_id % 9 <> 0"))
    titles = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("paper_id"), F.col("p_name").alias("title"))
    return C.attached_references(numbered(spark, sf_dir), known, titles).withColumn("authors", F.array_join("authors", "|"))


@query("c10_valid_update", f"""select k as paper_id, case when len(list_distinct(list_transform(authors, lambda a: lower(a)))) < len(authors) then 'duplicate_author'
 when k % 4 in (1, 2) and doi is null then 'invalid_doi' when k % 5 in (1, 2) then 'invalid_url' end as error from ({_RAW})""")
def c10_valid_update(spark, sf_dir):
    return C.valid_update(metadata(spark, sf_dir))


@query("c11_unit_citations", f"""with c as ({_CITES}), n as ({_NUMBERED}), g as (select draft, unit, number, min(ord) as first, string_agg(evidence_id, ',' order by ord) as evidence_ids from (select distinct * from c) join n using (draft, paper_id) group by 1, 2, 3)
select draft, unit, cast(number as integer) as number, evidence_ids, cast(row_number() over (partition by draft, unit order by first, number) as integer) as place from g""")
def c11_unit_citations(spark, sf_dir):
    return C.unit_citations(cites(spark, sf_dir), numbered(spark, sf_dir)).withColumn("evidence_ids", F.array_join("evidence_ids", ","))


_PAPERS = """select c_nationkey as scope, c_custkey as paper_id, ['failed', 'uploaded', 'ready', 'ready', 'ready'][c_custkey % 5 + 1] as status,
 ['searchable', 'not_indexed', 'index_stale', 'indexing'][c_custkey % 4 + 1] as coverage, case when c_custkey % 6 > 0 then ['complete', 'partial', 'failed'][c_custkey % 3 + 1] end as matrix_status, c_custkey % 7 = 0 as matrix_stale,
 case when c_acctbal < 0 then ['title'] else [] end as missing from customer"""
_FIELDS = """select o_custkey as paper_id, ['objective', 'methodology', 'dataset', 'findings', 'limitations', 'future_work', 'concepts'][k + 1] as field_key, ['extracted', 'extracted', 'not_reported', 'failed'][(o_custkey + k) % 4 + 1] as state,
 (o_custkey + k) % 9 = 0 as malformed, [case when (o_custkey + k) % 5 = 0 then ' ' else 'text' end] as items from (select distinct o_custkey from orders), range(6) r(k) where (o_custkey + k) % 8 <> 0"""


def workspace(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """customers as papers of their nation, and matrix fields of those that have orders."""
    k = F.col("c_custkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at + 1).cast("int"))
    papers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scope"), k.alias("paper_id"), pick(["failed", "uploaded", "ready", "ready", "ready"], k % 5).alias("status"), pick(["searchable", "not_indexed", "index_stale", "indexing"], k % 4).alias("coverage"), F.when(k % 6 > 0, pick(["complete", "partial", "failed"], k % 3)).alias("matrix_status"), (k % 7 == 0).alias("matrix_stale"), F.when(F.col("c_acctbal") < 0, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>")).alias("missing"))
    o = F.col("o_custkey") + F.col("k")
    fields = table(spark, sf_dir, "orders").select("o_custkey").distinct().select("o_custkey", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).where(o % 8 != 0)
    fields = fields.select(F.col("o_custkey").alias("paper_id"), pick(C.FIELDS, F.col("k")).alias("field_key"), pick(["extracted", "extracted", "not_reported", "failed"], o % 4).alias("state"), (o % 9 == 0).alias("malformed"), F.array(F.when(o % 5 == 0, " ").otherwise("text")).alias("items"))
    return papers, fields


_FINISH = "select scope, finding_id, kind, severity, papers, cast(row_number() over (partition by scope order by case severity when 'significant' then 0 when 'attention' then 1 else 2 end, finding_id) as integer) as place from f"


@query("q1_workspace", f"""with p as ({_PAPERS}), d as ({_FIELDS}), keys as (select unnest(['objective', 'methodology', 'dataset', 'findings', 'limitations', 'future_work', 'concepts']) as field_key),
m as (select p.scope, p.paper_id, keys.field_key, d.state, d.malformed, d.items from p cross join keys left join d on d.paper_id = p.paper_id and d.field_key = keys.field_key where matrix_status is not null),
r as (select scope, paper_id, 'processing-failed' as s, 'processing_failed' as kind, 'significant' as severity from p where status = 'failed'
 union all select scope, paper_id, 'processing-incomplete', 'processing_incomplete', 'info' from p where status = 'uploaded'
 union all select scope, paper_id, 'search-' || coverage, 'search_' || coverage, case coverage when 'indexing' then 'info' else 'attention' end from p where coverage <> 'searchable'
 union all select scope, paper_id, 'matrix-missing', 'matrix_missing', 'attention' from p where status = 'ready' and matrix_status is null
 union all select scope, paper_id, 'matrix-stale', 'matrix_stale', 'attention' from p where matrix_status is not null and matrix_stale
 union all select scope, paper_id, 'matrix-failed', 'matrix_failed', 'significant' from p where matrix_status = 'failed'
 union all select scope, paper_id, 'matrix-partial', 'matrix_partial', 'attention' from p where matrix_status = 'partial'
 union all select scope, paper_id, 'citation-metadata-incomplete', 'citation_metadata_incomplete', 'info' from p where len(missing) > 0
 union all select scope, paper_id, 'matrix-field-' || field_key || '-unusable', 'matrix_field_unusable', 'attention' from m where state is null or state = 'failed' or malformed or (state = 'extracted' and trim(items[1]) = '')
 union all select scope, paper_id, 'matrix-field-' || field_key || '-not-reported', 'matrix_field_not_reported', 'info' from m where state = 'not_reported' and not malformed),
u as (select scope, string_agg(case when ok then cast(paper_id as varchar) end, ',' order by cast(paper_id as varchar)) as ids, count(*) filter (where ok) as n from
 (select scope, paper_id, status = 'ready' and not matrix_stale and matrix_status in ('complete', 'partial') and paper_id in (select paper_id from d where state = 'extracted' and not malformed and trim(items[1]) <> '') as ok from p) group by 1),
f as (select scope, 'workspace:' || s || ':' || paper_id as finding_id, kind, severity, cast(paper_id as varchar) as papers from r
 union all select scope, 'workspace:limited-matrix-coverage', 'limited_matrix_coverage', 'info', coalesce(ids, '') from u where n < 2) {_FINISH}""")
def q1_workspace(spark, sf_dir):
    return C.inspect_workspace(*workspace(spark, sf_dir)).select("scope", "finding_id", "kind", "severity", F.array_join("papers", ",").alias("papers"), "place")


_RESULTS = "select l_orderkey as draft, cast((l_linenumber - 1) // 2 as integer) as unit, l_linenumber as seq, case when l_tax > 0.06 then 'failed' else 'validated' end as status, ['supported', 'unsupported', 'partially_supported', 'insufficient_evidence'][cast(l_quantity as integer) % 4 + 1] as support from lineitem"


def assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    said = F.element_at(F.array(*map(F.lit, ["supported", "unsupported", "partially_supported", "insufficient_evidence"])), (F.col("l_quantity").cast("int") % 4 + 1))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("draft"), F.floor((n - 1) / 2).cast("int").alias("unit"), n.alias("seq"), F.when(F.col("l_tax") > 0.06, "failed").otherwise("validated").alias("status"), said.alias("support"))


@query("q3_assessment_state", f"select draft, unit, arg_max(support, (seq, support)) as support from ({_RESULTS}) where status = 'validated' group by 1, 2")
def q3_assessment_state(spark, sf_dir):
    return C.assessment_state(assessments(spark, sf_dir))


@query("q2_draft", f"""with c as ({_CITES}), s as (select draft, unit, arg_max(support, (seq, support)) as support from ({_RESULTS}) where status = 'validated' group by 1, 2), u as (select distinct draft, unit from c),
p as (select draft, unit, string_agg(distinct cast(paper_id as varchar), ',' order by cast(paper_id as varchar)) as papers from c group by 1, 2),
n as (select draft, paper_id, count(*) as n from c group by 1, 2), t as (select draft, sum(n) as total, count(*) as distinct_, arg_max(cast(paper_id as varchar), n) as top, max(n) as most, string_agg(cast(paper_id as varchar), ',' order by cast(paper_id as varchar)) as every from n group by 1),
f as (select draft as scope, 'draft:unit-' || unit || '-' || coalesce(support, 'unchecked') as finding_id, 'claim_' || coalesce(support, 'unchecked') as kind, case when support is null then 'info' when support = 'unsupported' then 'significant' else 'attention' end as severity, case when support is null then '' else papers end as papers
 from u left join s using (draft, unit) left join p using (draft, unit) where support is null or support <> 'supported'
 union all select draft, 'draft:single-cited-paper', 'single_cited_paper', 'info', every from t where distinct_ = 1
 union all select draft, 'draft:citation-concentration', 'citation_concentration', 'info', top from t where distinct_ >= 2 and total >= 3 and most * 2 > total
 union all select draft, 'draft:reference-' || paper_id || '-incomplete', 'cited_reference_incomplete', 'attention', cast(paper_id as varchar) from n where paper_id % 7 = 0) {_FINISH}""")
def q2_draft(spark, sf_dir):
    c = cites(spark, sf_dir)
    units = c.select("draft", "unit").distinct().join(C.assessment_state(assessments(spark, sf_dir)), ["draft", "unit"], "left")
    missing = F.when(F.col("paper_id") % 7 == 0, F.array(F.lit("title"))).otherwise(F.array().cast("array<string>"))
    references = c.select("draft", "paper_id").distinct().withColumn("missing", missing)
    return C.inspect_draft(units, c, references).select("scope", "finding_id", "kind", "severity", F.array_join("papers", ",").alias("papers"), "place")
