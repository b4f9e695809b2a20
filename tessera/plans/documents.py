"""Text, document and fact queries. Reports are rendered from orders, so that sections, tables and facts have known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..session import held
from .registry import dealt, query, table

_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _replaced(sql: str, *pairs: tuple[str, str]) -> str:
    """SQL that replaces patterns one after another."""
    for pattern, by in pairs:
        sql = f"regexp_replace({sql}, '{pattern}', {by}, 'g')"
    return sql


_LIGATURES = "text"
for _code, _plain in ((64256, "ff"), (64257, "fi"), (64258, "fl"), (64259, "ffi"), (64260, "ffl")):
    _LIGATURES = f"replace({_LIGATURES}, chr({_code}), '{_plain}')"
_CLEAN = _replaced(_replaced(_LIGATURES, (r"\r\n?", "chr(10)"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "''"), (r"\x{00A0}", "' '"), (r"[ \t]+", "' '"), (r" *\n *", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)")), (f"^{_WS}+|{_WS}+$", "''"))


@query("n1_normalize_text", f"select doc_id, sha256({_CLEAN}) as normal from documents")
def n1_normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.col("text")), 256).alias("normal"))


_POSSESSIVE = _replaced("nfc_normalize(text)", ("[''’]s([^A-Za-z0-9_]|$)", r"'\1'"), (r"(\p{L})[''’](\p{L})", r"'\1\2'"), (r"(\p{L})[''’](\p{L})", r"'\1\2'"))


@query("n7_statement_key", f"select doc_id, sha256(regexp_replace(trim(regexp_replace(lower({_POSSESSIVE}), '{_WS}+', ' ', 'g')), '\\.$', '')) as statement from documents")
def n7_statement_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.statement_key(F.col("text")), 256).alias("statement"))


@query(
    "n6_normalize_phrase",
    r"select p_partkey, regexp_replace(array_to_string(regexp_extract_all(lower('The ' || p_name || ' 3.5 C++'), '\p{N}+(?:\.\p{N}+)+|[\p{L}\p{N}\p{M}]+(?:[+#]+)?'), ' '), '^(?:(?:a|an|the)(?: |$))+', '') as phrase from part",
)
def n6_normalize_phrase(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_phrase(F.concat(F.lit("The "), "p_name", F.lit(" 3.5 C++"))).alias("phrase"))


_MARKERS = rf"(?i)\[{_WS}*S{_WS}*[0-9]+(?:{_WS}*[,;]{_WS}*S?{_WS}*[0-9]+)*{_WS}*\]"


@query("n9_sanitize_evidence", f"select doc_id, sha256({_replaced("nfc_normalize(text || ' [S1; s2] end [ S3 ]')", (r"[\x00-\x08\x0B-\x1F\x7F-\x9F]|\p{Cf}", "''"), (_MARKERS, "'[citation removed]'"))}) as safe from documents")
def n9_sanitize_evidence(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.sanitize_evidence(F.concat("text", F.lit(" [S1; s2] end [ S3 ]"))), 256).alias("safe"))


_REDACTED = _replaced("text || ' Bearer ab.c-d pa-0123456789abcdef01 eyJa.b-c.d_e sb_secret_xyz'", (r"(?i)Bearer\s+[\w.~+/=-]+", "'[redacted]'"), (r"eyJ[\w-]+\.[\w-]+\.[\w-]+", "'[redacted]'"), (r"sb_(?:secret|publishable)_[\w-]+", "'[redacted]'"), (r"(^|[^A-Za-z0-9_])pa-[A-Za-z0-9_-]{16,}", r"'\1[redacted]'"))


@query("n15_redact", f"select doc_id, sha256({_REDACTED}) as redacted from documents")
def n15_redact(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.redact(F.concat("text", F.lit(" Bearer ab.c-d pa-0123456789abcdef01 eyJa.b-c.d_e sb_secret_xyz"))), 256).alias("redacted"))


@query(
    "n18_derive_excerpt",
    """with t as (select doc_id, text, left(text, 400) as head from documents), p as (select *, length(head) - instr(reverse(head), ' ') as cut from t)
select doc_id, case when length(text) <= 400 then text when instr(head, ' ') > 0 and cut >= 200 then left(text, cut) else head end as excerpt from p""",
)
def n18_derive_excerpt(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.derive_excerpt(F.col("text")).alias("excerpt"))


@query("n19_ellipsis", "select doc_id, case when length(text) > 60 then left(text, 60) || '…' else text end as shown from documents")
def n19_ellipsis(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.ellipsis(F.col("text"), 60).alias("shown"))


@query("d1_text_gate", f"select doc_id, length(regexp_replace(text, '{_WS}+', '', 'g')) >= 50 as has_text from documents")
def d1_text_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.has_text(F.col("text")).alias("has_text"))


def line_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as papers whose lines are pages."""
    pages = F.transform(F.split("text", "\n"), lambda t, i: F.struct((i + 1).alias("pageNumber"), t.alias("text")))
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("paper_id"), pages.alias("pages"))


_PAGES = f"(select cast(doc_id as varchar) as paper_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as page_number from documents where text is not null)"
_PROFILE = f"select paper_id, page_number, length(regexp_replace(line, '{_WS}+', '', 'g')) as char_count from {_PAGES}"


@query("d2_page_profiles", f"select paper_id, cast(page_number as integer) as page_number, cast(char_count as integer) as char_count, char_count < 40 as likely_scanned, case when char_count < 40 then 'required' else 'not_required' end as ocr_status from ({_PROFILE})")
def d2_page_profiles(spark, sf_dir):
    return D.page_profiles(line_papers(spark, sf_dir))


@query("d3_extraction_quality", f"select paper_id, case when avg((char_count < 40)::integer) >= 0.6 then 'poor' when avg((char_count < 40)::integer) > 0 then 'partial' when avg(char_count) < 120 then 'sparse' else 'good' end as quality from ({_PROFILE}) group by 1")
def d3_extraction_quality(spark, sf_dir):
    return D.extraction_quality(D.page_profiles(line_papers(spark, sf_dir)))


# Parts of lines, put together by the numbers of parts.
_LEADS = ["", "1. ", "2.3 ", "IV. ", "a) ", "  12 "]
_HEADS = ["Introduction", "Related  Work", "MATERIALS AND METHODS", "Findings", "Discussion", "limitations and future work", "Concluding remarks", "Works Cited", "Acknowledgements", "Appendix B2", "Background and motivation", "Plain line of text", "Methodology of results", "", "Conclusions and future directions of the whole long programme of work"]
_ENDS = ["", ":", ".", " ", "?"]


def _sql_list(xs) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


_LINE = f"{_sql_list(_LEADS)}[p_partkey % {len(_LEADS)} + 1] || {_sql_list(_HEADS)}[p_partkey // 6 % {len(_HEADS)} + 1] || {_sql_list(_ENDS)}[p_partkey // 90 % {len(_ENDS)} + 1]"
_NAME = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(t, '^(?:[0-9]+(?:\.[0-9]+)*\.?|[IVXL]+\.)\s+', ''), '[:.]$', ''), '\s+', ' ', 'g')))"


@query("d5_heading_type", f"with l as (select p_partkey, trim({_LINE}) as t from part), n as (select *, {_NAME} as n from l) select p_partkey, case when length(t) not between 1 and 60 then null " + " ".join(f"when regexp_matches(n, '^(?:{pattern})$') then '{kind}'" for kind, pattern in D.HEADINGS) + " end as section_type from n")
def d5_heading_type(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda xs, at: F.element_at(F.array(*map(F.lit, xs)), (at % len(xs) + 1).cast("int"))
    line = F.concat(pick(_LEADS, k), pick(_HEADS, F.floor(k / 6)), pick(_ENDS, F.floor(k / 90)))
    return table(spark, sf_dir, "part").select("p_partkey", D.heading_type(line).alias("section_type"))


# Phrases that the rules look for, and ones that they must not take; a text has those that its number's bits say.
_PHRASES = ["the Annual Report", "fiscal year 1996", "market size", "policy brief", "case studies", "technical report", "we surveyed", "balance sheets", "Balance Sheet", "abstract"]


def _rule_sql() -> str:
    text = " || ' ' || ".join(f"case when (o_orderkey >> {k}) & 1 = 1 then '{p}' else 'x' end" for k, p in enumerate(_PHRASES))
    kinds = list(dict.fromkeys(k for k, _, _ in D.RULES))
    score = lambda kind: " + ".join("case when regexp_matches(h, '" + pattern.format(b="(?:^|[^a-z0-9_])", a="(?:$|[^a-z0-9_])").replace("'", "''") + f"') then {w} else 0 end" for k, pattern, w in D.RULES if k == kind)
    columns = ", ".join(f"{score(k)} as s{i}" for i, k in enumerate(kinds))
    every = "[" + ", ".join(f"s{i}" for i in range(len(kinds))) + "]"
    return f"""with t as (select o_orderkey, lower({text}) as h from orders), s as (select o_orderkey, {columns} from t), b as (select o_orderkey, list_max({every}) as best, list_sum({every}) as total, list_position({every}, list_max({every})) as place from s)
select o_orderkey, case when total = 0 then 'general_report' when best / total < {D.LEAST_CONFIDENCE} then 'unknown' else {_sql_list(kinds)}[place] end as document_type, case when total = 0 then 0.0::double else best / total end as confidence from b"""


@query("d4_classify", _rule_sql())
def d4_classify(spark, sf_dir):
    k = F.col("o_orderkey")
    said = F.concat_ws(" ", *[F.when(F.shiftright(k, i).bitwiseAND(F.lit(1)) == 1, p).otherwise("x") for i, p in enumerate(_PHRASES)])
    return dealt(spark, sf_dir, "orders").select("o_orderkey", D.classify(said, F.array().cast("array<string>")).alias("c")).select("o_orderkey", "c.document_type", "c.confidence")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """papers(paper_id, pages): each order as a report of two pages, its lines as a table on the second."""
    row = F.concat(F.lit("Q"), F.col("l_linenumber").cast("string"), F.lit(" 2024\t$"), F.col("l_quantity").cast("int").cast("string"), F.lit(".50\t$"), F.col("l_linenumber").cast("string"), F.lit(".25"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", row.alias("row")))).alias("rows"))
    orders = table(spark, sf_dir, "orders").join(rows, "o_orderkey", "left")
    first = F.concat(F.lit("Introduction\nIn FY"), F.year("o_orderdate").cast("string"), F.lit(" total revenue was $"), F.floor("o_totalprice").cast("string"), F.lit(".5 million.\n\nMethods\nPlain words about "), F.lower("o_orderpriority"), F.lit("."))
    second = F.array_join(F.concat(F.array(F.lit("Table 1: Lines"), F.lit("Quarter\tRevenue\tNet income")), F.coalesce(F.transform("rows", lambda r: r["row"]), F.array().cast("array<string>"))), "\n")
    page = lambda n, t: F.struct(F.lit(n).alias("pageNumber"), t.alias("text"))
    return orders.select(F.col("o_orderkey").cast("string").alias("paper_id"), F.array(page(1, first), page(2, second)).alias("pages"))


@query(
    "d7_sections",
    """select cast(o_orderkey as varchar) as paper_id, cast(p as integer) as position, case p when 0 then 'Introduction' else 'Methods' end as title, case p when 0 then 'introduction' else 'methods' end as section_type,
 1 as page_start, cast(p + 1 as integer) as page_end from orders, range(2) r(p)""",
)
def d7_sections(spark, sf_dir):
    return D.sections(held(D.normalized(reports(spark, sf_dir)), "papers")).select("paper_id", "position", "title", "section_type", "page_start", "page_end")


_TABLED = "(select l_orderkey, count(*) as n from lineitem where l_orderkey in (select o_orderkey from orders) group by 1 having count(*) >= 2)"


@query("d11_tables", f"select cast(l_orderkey as varchar) as paper_id, 0 as table_index, 2 as page, 'Table 1: Lines' as caption, 'Quarter|Revenue|Net income' as headers, cast(n as integer) as n_rows, 1.0::double as confidence from {_TABLED}")
def d11_tables(spark, sf_dir):
    return D.tables(reports(spark, sf_dir)).select("paper_id", "table_index", "page", "caption", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows"), "confidence")


@query("d12_prose_facts", "select cast(o_orderkey as varchar) as paper_id, 'revenue' as metric, (floor(o_totalprice) + 0.5) * 1000000.0::double as value, 'million' as unit, 'USD' as currency, 'FY' || year(o_orderdate) as period, 0.7::double as confidence, 1 as page_number from orders")
def d12_prose_facts(spark, sf_dir):
    return D.prose_facts(D.normalized(reports(spark, sf_dir))).select("paper_id", "metric", "value", "unit", "currency", "period", "confidence", "page_number")


_PERIOD = "case when l_linenumber <= 4 then 'Q' || l_linenumber || ' 2024' else '2024' end"


@query(
    "d13_table_facts",
    f"""with t as (select l.* from lineitem l join {_TABLED} using (l_orderkey))
select cast(l_orderkey as varchar) as paper_id, 'revenue' as metric, floor(l_quantity) + 0.5::double as value, 'USD' as currency, {_PERIOD} as period, 2 as page_number, 0 as table_index from t
union all select cast(l_orderkey as varchar), 'net_income', l_linenumber + 0.25::double, 'USD', {_PERIOD}, 2, 0 from t""",
)
def d13_table_facts(spark, sf_dir):
    return D.table_facts(D.tables(reports(spark, sf_dir))).select("paper_id", "metric", "value", "currency", "period", "page_number", "table_index")


@query(
    "snk5_persistence_rows",
    f"""select cast(o_orderkey as varchar) as paper_id, k.source_kind, cast(case k.source_kind when 'text' then 2 when 'table' then 1 else 1 + 2 * coalesce(n, 0) end as bigint) as n
from orders left join {_TABLED} on l_orderkey = o_orderkey, (values ('text'), ('table'), ('fact')) k(source_kind) where k.source_kind <> 'table' or n is not null""",
)
def snk5_persistence_rows(spark, sf_dir):
    return D.persistence_rows(reports(spark, sf_dir))["chunks"].groupBy("paper_id", "source_kind").agg(F.count("*").alias("n"))


@query("d9_chunks")
def d9_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.col("doc_id").cast("string").alias("paper_id"), F.lit(0).alias("position"), "text", F.lit(0).cast("long").alias("char_start"))
    return D.chunks(rows).select("paper_id", "chunk_index", "char_start", "char_end", F.sha2("text", 256).alias("content_hash"))


_TITLES = ["Introduction", "Methods", "Results", "Discussion", "Conclusion"]
_VARIED = """with h as (select o_orderkey as k, unnest(range(5)) as i from orders), c as (select k, i, row_number() over (partition by k order by i) as n, 1 + ((k >> i) & 1) + (k + i) % 2 as pages from h where ((k % 31 + 1) >> i) & 1 = 1),
s as (select *, coalesce(sum(pages) over (partition by k order by n rows between unbounded preceding and 1 preceding), 0) + 1 as first, sum(pages) over (partition by k order by n) + 1 as next, count(*) over (partition by k) as m from c)"""


def _parts(spark: SparkSession) -> int:
    """Over how many tasks the few bytes of a table are dealt before each of its rows becomes a paper."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """papers(paper_id, pages): a choice of numbered sections, each over one to three pages, all under a header and over a footer.

    Numbers are arabic or roman; a section that goes on repeats its heading as a running header on every third paper. A page is null, and another blank.
    """
    k = F.col("k")
    chosen = F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: F.getbit(k % 31 + 1, i) == 1)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).repartition(_parts(spark), "k").withColumn("chosen", chosen)
    number = lambda n: F.when(k % 2 == 0, n.cast("string")).otherwise(F.element_at(F.array(*map(F.lit, ["I", "II", "III", "IV", "V"])), n))
    title = lambda i, n: F.concat(number(n), F.lit(". "), F.element_at(F.array(*map(F.lit, _TITLES)), i + 1))
    pages = lambda i: (1 + F.getbit(k, i) + (k + i) % 2).cast("int")
    each = F.flatten(F.transform("chosen", lambda i, at: F.transform(F.sequence(F.lit(1), pages(i)), lambda p: F.when((p == 1) | (k % 3 == 0), F.concat(title(i, at + 1), F.lit("\n"))).otherwise(""))))
    text = lambda lead, p: F.concat(F.lit("Journal of Tests, vol. "), (k % 9).cast("string"), F.lit("\n"), lead, F.lit("Plain words of page number "), (p + 1).cast("string"), F.lit(" say little.\nMore words of it follow here, in lower case.\nPage "), (p + 1).cast("string"))
    paged = F.transform(each, lambda lead, p: F.struct((p + 1).alias("pageNumber"), text(lead, p).alias("text")))
    odd = F.array(F.struct(F.lit(90).alias("pageNumber"), F.lit(None).cast("string").alias("text")), F.struct(F.lit(91).alias("pageNumber"), F.lit(" \n ").alias("text")))
    return rows.select(k.cast("string").alias("paper_id"), F.concat(odd, F.reverse(paged)).alias("pages"))


@query("d7_varied_sections", f"""{_VARIED}, l as (select k, max(next) - 1 as last from s group by 1)
select cast(k as varchar) as paper_id, cast(0 as integer) as position, 'Front matter' as title, 'other' as section_type, 1 as page_start, 1 as page_end from l
union all select cast(k as varchar), cast(n as integer), case when k % 2 = 0 then cast(n as varchar) else ['I', 'II', 'III', 'IV', 'V'][n] end || '. ' || {_sql_list(_TITLES)}[i + 1], lower({_sql_list(_TITLES)}[i + 1]), cast(first as integer), cast(case when n = m then last else next end as integer) from s join l using (k)""")
def d7_varied_sections(spark, sf_dir):
    return D.sections(held(D.normalized(varied(spark, sf_dir)), "papers")).select("paper_id", "position", "title", "section_type", "page_start", "page_end")


# Lines of an order as ragged rows, parted into two runs by the line whose quantity is the least; a run of three or more is a table.
_RAGGED = """with l as (select l_orderkey as k, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as n, l_linenumber as line, l_partkey as p, cast(l_quantity as integer) as q from lineitem),
g as (select *, count(*) filter (where q % 5 = 0) over (partition by k order by n) as run from l), c as (select k, run, n, p, 2 + p % 3 as width from g where q % 5 <> 0), r as (select k, run, min(n) as a, count(*) as size, arg_min(p, n) as p, arg_min(width, n) as head from c group by 1, 2 having count(*) >= 3),
w as (select k, run, width, count(*) as n from c group by 1, 2, 3), m as (select k, run, max(n) as n from w group by 1, 2)"""


@query("d11_ragged_tables", f"""{_RAGGED} select cast(k as varchar) as paper_id, cast(row_number() over (partition by k order by a) - 1 as integer) as table_index, 1 as page, case when run > 0 then 'Break ' || run when k % 2 = 0 then 'Table of ' || k end as caption, array_to_string(list_transform(range(head), lambda z: 'c' || (p + z)), '|') as headers, cast(size - 1 as integer) as n_rows, round(n / size, 2) as confidence from r join m using (k, run)""")
def d11_ragged_tables(spark, sf_dir):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(order)).alias("xs"))
    cells = lambda x: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), 1 + x["l_partkey"] % 3), lambda z: F.concat(F.lit("c"), (x["l_partkey"] + z).cast("string"))), " \t")
    told = F.transform("xs", lambda x, i: F.when(x["q"] % 5 == 0, F.concat(F.lit("\nBreak "), F.size(F.filter(F.slice("xs", 1, i + 1), lambda y: y["q"] % 5 == 0)).cast("string"), F.lit("\n"))).otherwise(cells(x)))
    lead = F.when(F.col("k") % 2 == 0, F.concat(F.lit("Table of "), F.col("k").cast("string"))).otherwise(F.repeat(F.lit("long "), 50))
    page = F.struct(F.lit(1).alias("pageNumber"), F.array_join(F.concat(F.array(lead), told), "\n").alias("text"))
    found = D.tables(rows.select(F.col("k").cast("string").alias("paper_id"), F.array(page).alias("pages")))
    return found.select("paper_id", "table_index", "page", "caption", F.array_join("headers", "|").alias("headers"), F.size("rows").alias("n_rows"), "confidence")


# Paragraphs of known lengths, some longer than a chunk and so cut in their three sentences; the longest runs of units are followed by pointers.
_UNITS = """l as (select l_orderkey as paper, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice) as place, cast(l_quantity as integer) as q from lineitem),
p as (select *, case when q > 40 then 3 * q * 6 + 2 else q * 8 end as size from l), o as (select *, sum(size + 2) over (partition by paper order by place) - size - 2 as pos from p),
u as (select paper, row_number() over (partition by paper order by place, z) as k, pos + z * (q * 6 + 1) as s, pos + z * (q * 6 + 1) + q * 6 as e from o, range(3) r(z) where q > 40),
w as (select paper, place, pos, pos + size as e from o where q <= 40), v as (select paper, row_number() over (partition by paper order by s) as k, cast(s as bigint) as s, cast(e as bigint) as e from (select paper, s, e from u union all select paper, pos, e from w)),
j as (select a.paper, a.k as i, a.s, max(b.k) as j from v a join v b on b.paper = a.paper and b.k >= a.k and (b.k = a.k or b.e - a.s <= 600) group by 1, 2, 3), x as (select j.*, v.e from j join v on v.paper = j.paper and v.k = j.j),
y as (select x.paper, x.i, x.s, x.j, x.e, coalesce(min(v.k), x.j + 1) as next from x left join v on v.paper = x.paper and v.k > x.i and v.k <= x.j and x.e - v.s <= 250 group by 1, 2, 3, 4, 5), m as (select paper, max(k) as last from v group by 1)"""


@query("d9_packing", f"with recursive {_UNITS}, c as (select y.*, 0 as n from y where i = 1 union all select y.*, c.n + 1 from c join m using (paper) join y on y.paper = c.paper and y.i = c.next where c.j < m.last) select cast(paper as varchar) as paper_id, n as chunk_index, s as char_start, e as char_end, cast(e - s as integer) as char_count from c")
def d9_packing(spark, sf_dir):
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q"))
    one = lambda q: F.concat(F.lit("S"), F.repeat(F.lit("x"), q * 6 - 2), F.lit("."))
    said = lambda x: F.when(x["q"] > 40, F.concat_ws(" ", one(x["q"]), one(x["q"]), one(x["q"]))).otherwise(F.repeat(F.lit("y"), x["q"] * 8))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("paper_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), said), "\n\n").alias("text"))
    return D.chunks(rows.withColumns({"position": F.lit(0), "char_start": F.lit(0)}), 600, 250).select("paper_id", "chunk_index", "char_start", "char_end", "char_count")


@query("d19_page_ranges", "select o_orderkey, case when o_orderkey % 3 = 0 then 'p. ' || o_orderkey else 'pp. ' || o_orderkey || '–' || (o_orderkey + o_orderkey % 3) end as pages, case when o_orderkey % 3 = 0 then cast(o_orderkey as varchar) else o_orderkey || '-' || (o_orderkey + o_orderkey % 3) end as prompt_pages from orders")
def d19_page_ranges(spark, sf_dir):
    start, end = F.col("o_orderkey"), F.col("o_orderkey") + F.col("o_orderkey") % 3
    return table(spark, sf_dir, "orders").select("o_orderkey", T.page_range(start, end).alias("pages"), T.prompt_pages(start, end).alias("prompt_pages"))
