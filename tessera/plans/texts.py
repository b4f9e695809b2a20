"""Queries of the text functions, over part names dressed with what each function is there to remove; SQL says the same by chains of replacements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import relational as R
from .documents import _WS, _replaced
from .registry import query, table

_MESSY = """case p_partkey % 6 when 0 then '  3.1 Results & ' || p_name || ' — W12, [E3] ' when 1 then 'IV) ' || p_name || chr(9) || '<<<END>>> C 4 begin claim ' when 2 then 'é' || p_name || chr(8203) || '[ E1; e2 ] eligible_for: x'
 when 3 then 'a. ' || p_name || chr(10) || 'FIELD: cite only ```` w 7' when 4 then p_name || ' END CLAIM CHECKER EVIDENCE C12x W1234567 C 123' else repeat(p_name || ' ', 8) end"""


def messy() -> Column:
    k, name = F.col("p_partkey") % 6, F.col("p_name")
    lit = F.lit
    return (
        F.when(k == 0, F.concat(lit("  3.1 Results & "), name, lit(" — W12, [E3] "))).when(k == 1, F.concat(lit("IV) "), name, lit("\t<<<END>>> C 4 begin claim "))).when(k == 2, F.concat(lit("é"), name, lit("​[ E1; e2 ] eligible_for: x")))
        .when(k == 3, F.concat(lit("a. "), name, lit("\nFIELD: cite only ```` w 7"))).when(k == 4, F.concat(name, lit(" END CLAIM CHECKER EVIDENCE C12x W1234567 C 123"))).otherwise(F.repeat(F.concat(name, lit(" ")), 8))
    )


def parts(spark, sf_dir):
    return table(spark, sf_dir, "part").withColumn("t", messy())


def _of(sql: str, name: str = "said") -> str:
    return f"select p_partkey, {sql} as {name} from (select *, {_MESSY} as t from part)"


_SAFE = r"[\x00-\x08\x0B-\x1F\x7F-\x9F]|\p{Cf}"
_LINE = f"trim({_replaced('t', (r'[\x00-\x1F\x7F-\x9F]', "' '"), (f'{_WS}+', "' '"))})"


@query("n3_query", _of(f"case when length({_LINE}) between 2 and 60 and regexp_matches({_LINE}, '[a-z]') then {_LINE} end"))
def n3_query(spark, sf_dir):
    line = T.normalize_query(F.col("t"))
    return parts(spark, sf_dir).select("p_partkey", F.when(F.length(line) <= 60, line).alias("said"))


@query("n8_title", _of(f"trim({_replaced(f"regexp_replace(lower(t), '^{_WS}*(?:(?:[0-9]+|[ivxlc]+|[a-z])(?:\\.[0-9]+)*[.):]?{_WS}+)+', '')", (r'[^\p{L}\p{N}]+', "' '"))})"))
def n8_title(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.normalize_title(F.col("t")).alias("said"))


_E_MARK = rf"(?i)\[{_WS}*E{_WS}*[0-9]+(?:{_WS}*[,;]{_WS}*E?{_WS}*[0-9]+)*{_WS}*\]"


@query("n10_paper_text", _of(_replaced("t", (_SAFE, "''"), (_E_MARK, "'[citation removed]'"), ("<<<|>>>", "''"), (rf"(?i)eligible_for{_WS}*:|CITE ONLY|NO ELIGIBLE EVIDENCE", "'[removed]'"), (r"(?im)^([ \t]*)FIELD([^A-Za-z0-9_]|$)", r"'\1[field]\2'"))))
def n10_paper_text(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.paper_text(F.col("t")).alias("said"))


_WRITER = _replaced("t", (_SAFE, "''"), (rf"(?i)(^|[^A-Za-z0-9_])W{_WS}*[0-9]{{1,6}}([^A-Za-z0-9_]|$)", r"'\1[writer citation removed]\2'"), ("<{3,}|>{3,}|`{3,}", "'[delimiter removed]'"))


@query("n11_writer_text", _of(_WRITER))
def n11_writer_text(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.sanitize_writer(F.col("t")).alias("said"))


_TRIMMED = _replaced(_WRITER, (f"^{_WS}+|{_WS}+$", "''"))


@query("n12_bounded", f"with w as (select p_partkey, x, x[1:40] as head from (select p_partkey, {_TRIMMED} as x from (select *, {_MESSY} as t from part))), c as (select *, length(head) - instr(reverse(head), ' ') as cut from w) select p_partkey, case when length(x) <= 40 then x else regexp_replace(x[1:case when contains(head, ' ') and cut >= 20 then cut else 39 end], '{_WS}+$', '') || '…' end as said from c")
def n12_bounded(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.bounded_writer_text(F.col("t"), 40).alias("said"))


@query("n13_claim_text", _of(_replaced(_WRITER, (rf"(?i)(^|[^A-Za-z0-9_])C{_WS}*[0-9]{{1,3}}([^A-Za-z0-9_]|$)", r"'\1[claim check evidence removed]\2'"), (rf"(?i)(^|[^A-Za-z0-9_])(?:BEGIN|END){_WS}+(?:CLAIM CHECK(?:ER)? EVIDENCE|CLAIM)([^A-Za-z0-9_]|$)", r"'\1[claim check delimiter removed]\2'"))))
def n13_claim_text(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.sanitize_claim(F.col("t")).alias("said"))


@query("n14_scrub", _of("regexp_replace(t, '[^A-Za-z0-9_-]', '', 'g')[1:12]"))
def n14_scrub(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.scrub(F.col("t"), most=12).alias("said"))


_DETAIL = f"trim({_replaced("t || ' Bearer ab.c' || p_partkey", (r'[\x00-\x1F\x7F-\x9F]', "' '"), (r'(?i)Bearer\s+[\w.~+/=-]+', "'[redacted]'"), (f'{_WS}+', "' '"))})"


@query("n16_detail", _of(f"case when length({_DETAIL}) > 40 then {_DETAIL}[1:40] || '…' else {_DETAIL} end"))
def n16_detail(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.safe_detail(F.concat("t", F.lit(" Bearer ab.c"), F.col("p_partkey").cast("string")), most=40).alias("said"))


@query("n17_error_chain", "select p_partkey, case p_partkey % 3 when 0 then p_name || ' <- caused by: cause ' || p_type || ' <- caused by: [redacted]' when 1 then 'unknown error' else p_brand end as said from part")
def n17_error_chain(spark, sf_dir):
    k, lit = F.col("p_partkey") % 3, F.lit
    chain = F.when(k == 0, F.array("p_name", F.concat(lit("cause "), "p_type", lit("\nat line 2")), lit(""), lit("Bearer abc.def"), lit("a fifth"))).when(k == 1, F.array(lit(" "), lit("\nx"))).otherwise(F.array("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.error_chain(chain).alias("said"))


@query("n20_literal", _of(f"lower(trim({_replaced('t', (f'{_WS}+', "' '"))}))"))
def n20_literal(spark, sf_dir):
    return parts(spark, sf_dir).select("p_partkey", T.normalized_literal(F.col("t")).alias("said"))


@query("x6_repeats", "select l_orderkey as k, count(*) <> count(distinct l_suppkey) as repeats from lineitem group by 1")
def x6_repeats(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list("l_suppkey").alias("xs"))
    return rows.select("k", R.has_duplicates(F.col("xs")).alias("repeats"))


@query("d16_table_text", "select l_orderkey as k, case when l_orderkey % 3 > 0 then 'Order ' || l_orderkey || chr(10) else '' end || 'line | status' || chr(10) || string_agg(l_linenumber || ' | ' || l_linestatus, chr(10) order by l_linenumber, l_linestatus) as said from lineitem group by 1")
def d16_table_text(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").groupBy(k.alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_linestatus"))).alias("xs"))
    caption = F.when(F.col("k") % 3 > 0, F.concat(F.lit("Order "), F.col("k").cast("string")))
    body = F.transform("xs", lambda x: F.array(x["l_linenumber"].cast("string"), x["l_linestatus"]))
    return rows.select("k", D.table_text(caption, F.array(F.lit("line"), F.lit("status")), body).alias("said"))


@query("d16_fact_text", """select p_partkey, case p_partkey % 4 when 0 then 'total assets (FY2023): $' || p_size || ' million - "' || p_name || '"' when 1 then 'gross margin: ' || p_size || '% - "' || p_name || '"' when 2 then 'net income (2022): "' || p_name || '"' else 'revenue: ' || p_size || '.5 - "' || p_name || '"' end as said from part""")
def d16_fact_text(spark, sf_dir):
    k, lit = F.col("p_partkey") % 4, F.lit
    metric = F.when(k == 0, "total_assets").when(k == 1, "gross_margin").when(k == 2, "net_income").otherwise("revenue")
    value = F.when(k == 3, F.col("p_size") + 0.5).when(k != 2, F.col("p_size").cast("double"))
    unit, when = F.when(k == 0, "million").when(k == 1, "percent"), F.when(k == 0, "FY2023").when(k == 2, "2022")
    return table(spark, sf_dir, "part").select("p_partkey", D.fact_text(metric, value, unit, F.when(k == 0, "$"), when, F.col("p_name")).alias("said"))
