"""Queries that take all rows: no length or number of rows is cut."""

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import citations as C
from tessera.operators import documents as D
from tessera.operators import evidence as E
from tessera.operators import graph as G
from tessera.operators import relational as R
from tessera.operators import shapes as S
from tessera.plans import QUERIES
from tessera.plans.evidence import packet_candidates
from tessera.plans.registry import dealt
from tessera.plans.streams import fed
from tessera.session import shared_dir


def test_offset_to_page_of_long_texts(spark, tmp_path):
    texts = ["", "a", "a\nb", "\n\n\n\n", "é\n" * 4000, "x" * 7000, ("line of words\n" * 900) + "y" * 9000]
    rows = [*enumerate(texts), (len(texts), None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.off, r.page) for r in QUERIES["j14_offset_to_page_whole"](spark, str(tmp_path)).collect()}
    assert got == {k: (len(t) // 2, 1 + t[: len(t) // 2].count("\n")) for k, t in enumerate(texts)}


def test_nulls_come_last_and_all_rows_stay(spark, tmp_path):
    day = datetime(2024, 1, 1)
    spark.createDataFrame([(k, day) for k in range(20_000)], "o_orderkey long, o_orderdate timestamp").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["k5_nulls_last_whole"](spark, str(tmp_path)).collect()
    assert [r.o_orderkey for r in got] == sorted(range(20_000), key=lambda k: (k % 3 == 0, k))
    assert sum(r.due is None for r in got) == 6667


def test_shared_terms_hold_no_sets_of_claims(spark):
    rows = [("k", p, i, key, key) for p in range(2) for i in range(3) for key in ("a b", "a", "b")]  # a stands wherever "a b" does
    rows += [("k", 0, 9, "b", "B"), ("k", 0, 0, "a", "a"), ("k", 7, 1, "c d", "c d"), ("k", 8, 1, "c d", "c d"), ("k", 7, 2, "c", "c"), ("k", 8, 1, "c", "c"), ("k", 9, 1, "z", "z")]
    shared = G.shared_terms(spark.createDataFrame(rows, "kind string, paper_id long, item long, key string, phrase string"))
    got = {r.key: (r.label, r.papers, r.claims, r.kept) for r in shared.collect()}
    assert got == {"a b": ("a b", 2, 6, True), "a": ("a", 2, 6, False), "b": ("b", 2, 7, True), "c d": ("c d", 2, 2, True), "c": ("c", 2, 2, True)}
    # a term of many claims in one row went to the driver with a broadcast
    assert "collect_set" not in shared._jdf.queryExecution().optimizedPlan().toString()


def sets_gathered(spark, name):
    """How often a query's plan gathers sets, of claims or else; sets of claims went to the driver with a broadcast."""
    return QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().count("collect_set")


def test_shared_terms_gather_no_sets(spark):
    assert sets_gathered(spark, "g2_shared_terms") == 0


def test_relationships_gather_evidence_alone(spark):
    assert sets_gathered(spark, "g11_relationships") <= 2  # evidence, for terms and for those of two papers


def test_edges_gather_evidence_alone(spark):
    assert sets_gathered(spark, "g4_term_edges") <= 1


def test_a_term_index_gathers_no_sets(spark):
    assert sets_gathered(spark, "f5_term_index") == 0


def test_paper_nodes_gather_no_sets(spark):
    assert sets_gathered(spark, "g6_paper_nodes") == 0


def test_sizes_round_halves_to_even_as_sql_does(spark, tmp_path):
    rows = [(2, 2.5), (8, 3.5), (14, -2.5), (3, 0.45)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.k: r["size"] for r in QUERIES["m6_scalars"](spark, str(tmp_path)).collect()}
    assert got == {2: "2 B", 8: "4 B", 14: "0 MB", 3: "4 B"}


def test_sections_find_headings_once(spark):
    docs = spark.createDataFrame([("a", "Front words\n\n1. Introduction\nText", [0], [1]), ("b", "no headings", [0], [4]), ("c", "Methods:\nx", [0], [2])], "paper_id string, text string, page_starts array<int>, page_numbers array<int>")
    found = D.sections(docs)
    got = sorted((r.paper_id, r.position, r.title, r.section_type, r.text) for r in found.collect())
    assert got == [("a", 0, "Front matter", "other", "Front words"), ("a", 1, "1. Introduction", "introduction", "Text"), ("b", 0, "Full text", "other", "no headings"), ("c", 0, "Methods", "methods", "x")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_pairs_are_made_once_and_not_held(spark):
    rows = [("p", 1), ("p", 2), ("p", 2), ("q", 1), ("q", 2), ("q", 3), ("r", 4), (None, 1), ("r", None), ("s", 5), ("s", 4)]
    pairs = R.collaborators(spark.createDataFrame(rows, "project_id string, user_id long"))
    want = [(1, 2), (1, 3), (2, 3), (4, 5)]
    assert sorted(tuple(r) for r in pairs.collect()) == sorted([*want, *((b, a) for a, b in want)])
    # a distinct over all pairs held them in the tasks' memory
    assert not pairs._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")


def test_scopes_are_counted_by_rows(spark):
    asked = spark.createDataFrame([(1, "a", 7), (1, "a", 7), (1, "a", 8), (2, "b", 7), (3, None, 7), (4, "a", None)], "k long, n string, id long")
    allowed = spark.createDataFrame([("a", 7), ("a", 7), ("b", 9)], "n string, id long")
    got = R.scope_counts(asked, allowed, "k", "n", "id")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 1), (2, 1, 0), (3, 1, 0), (4, 0, 0)]


def test_a_part_of_many_files_is_one_batch(spark):
    batches = []
    start = lambda rows: rows.writeStream.foreachBatch(lambda b, k: batches.append(b.count())).option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
    at = f"{shared_dir(spark)}/fed-{uuid.uuid4().hex}"
    fed(spark, [spark.range(30).repartition(3), spark.range(4).repartition(2)], "numbers", start)
    assert batches == [30, 4]  # files were batches, so each part went through one task


def test_rows_of_a_small_file_are_dealt(spark):
    assert dealt(spark, "/root/testdata/sf0.001", "part").rdd.getNumPartitions() == 4


def test_equal_statements_are_read_once(spark):
    rows = spark.createDataFrame([(p, "limitations", 0, "results lack coverage of towns") for p in range(3)], "paper_id long, field_key string, item int, statement string")
    signed = G.signatures(rows)
    assert [(r.action, r.targets) for r in signed.collect()] == [("missing_capability", [])] * 3
    # a filter worked the signature out again, seven times over, for each row
    assert signed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 2


def test_a_claim_moves_sizes_where_no_texts_are_asked_for(spark):
    rows = [(1, 0, "said", [("x", "one"), ("two", None), ("", " "), ("y", "three"), ("z", "four")]), (1, 1, "", [("e", None)]), (2, 0, "", [(None, None)]), (3, 0, None, [])]
    cites = spark.createDataFrame(rows, "claim int, ord int, claim_text string, sources array<struct<excerpt: string, content: string>>")
    packet = E.claim_packet(cites)
    got = {(r.claim, r.ord): (r.evidence_id, r.text, r.status) for r in packet.collect()}
    text = "Extracted claim: said\nSource 1: one\nSource 2: two\nSource 3: three"
    assert got == {(1, 0): ("C1", text, "ready"), (1, 1): ("C2", "Source 1: e", "ready"), (2, 0): (None, None, "no_usable_source"), (3, 0): (None, None, "no_usable_source")}
    sizes = packet.select("claim", "ord", "size")
    assert {(r.claim, r.ord): r["size"] for r in sizes.collect()} == {(1, 0): len(text), (1, 1): 11, (2, 0): None, (3, 0): None}
    assert "collect_list" not in sizes._jdf.queryExecution().optimizedPlan().toString()


def test_an_output_is_checked_once(spark):
    outputs = spark.createDataFrame([(1, '{"fields":{}}'), (2, "none")], "paper_id int, output string")
    packet = spark.createDataFrame([], "paper_id int, evidence_id string, fields array<string>")
    checked = S.checked_extractions(outputs, packet)
    assert {r.paper_id: r.error for r in checked.collect()} == {1: "invalid_output", 2: "invalid_output"}
    assert "parse_json" not in checked._jdf.queryExecution().optimizedPlan().toString()


def test_the_least_text_of_an_identity_counts_without_its_texts(spark):
    rows = [(1, 1, "a", "1", "b"), (1, 1, "a", "1", "aaaa"), (1, 1, "a", "0", "cc"), (1, 2, "d", "1", "zz"), (1, 2, "d", "1", "yyy"), (1, 3, "e", "2", None), (1, 3, "e", "2", "x"), (1, 4, "f", "3", "")]
    rows = spark.createDataFrame(rows, "request int, paper_id int, identity string, sort_key string, text string")
    # cc, the text of the least sort key, takes two; of zz and yyy the lesser takes three, so that a budget of four leaves it out
    for budget, want in ((4, [("W1", 1, "a")]), (5, [("W1", 1, "a"), ("W2", 2, "d")])):
        packet = E.writer_packet(rows, budget=budget)
        assert sorted(tuple(r)[1:] for r in packet.collect()) == want
    assert "text" not in E.writer_packet(rows.where("identity = 'a'"))._jdf.queryExecution().optimizedPlan().toString()


def test_texts_are_made_after_hits_are_ranked(spark):
    plan = packet_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("repeat(x") < plan.index("Window [")
    assert plan.index("Generate") < plan.index("repeat(x")  # a text was held for each of the fields


def test_texts_of_papers_are_found_once(spark):
    page = [(1, "Introduction\nWords of it.")]
    papers = spark.createDataFrame([("a", page)], "paper_id string, pages array<struct<pageNumber: int, text: string>>")
    chunks = D.persistence_rows(papers)["chunks"]
    assert [(r.source_kind, r.text) for r in chunks.collect()] == [("text", "Words of it.")]
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # headings were found by each reader


def test_findings_of_a_draft_are_put_in_order_once(spark):
    found = spark.createDataFrame([("s", "f", "k", "info", ["p"], ["u"]), ("s", "f", "l", "significant", ["q"], []), ("s", "a", "k", "info", [], [])], "scope string, finding_id string, kind string, severity string, papers array<string>, units array<string>")
    rows = C.ordered_findings(found)
    assert sorted((r.place, r.finding_id, r.kind, r.papers) for r in rows.collect()) == [(1, "f", "l", ["q"]), (2, "a", "k", [])]
    assert "max_by" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_every_event_holds_claim_texts(spark, tmp_path):
    spark.createDataFrame([(4, 1, "view"), (8, 1, "view"), (12, 2, "click")], "event_id long, user_id long, event_type string").withColumn("ts", F.timestamp_seconds("event_id").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["j20_claim_texts"](spark, str(tmp_path)).collect()
    # events whose number is divisible by four held no items, and took no part
    assert sorted((r.paper_id, r.item, r.text) for r in rows) == [(p, i, f"t{v}:{i}" if i < 2 else "") for p, v in ((1, 2), (2, 0)) for i in range(6)]


# A text for every form that a rule's pattern takes.
_SAID = [
    "Consolidated Statements of", "consolidated statement of", "consolidated balance sheet", "income statement", "balance sheet", "cash flow statement", "statement of cash flows", "net income", "total assets", "total liabilities", "gross margin", "operating expense", "operating expenses", "10-K", "form 10-k",
    "annual report", "letter to our shareholders", "letter to shareholders", "fiscal year 1999", "department of", "ministry of", "office of the inspector general", "government accountability office", "federal register", "policy brief", "policy paper", "policy framework", "policy recommendation", "policy recommendations",
    "regulatory impact", "white paper", "market research", "market size", "market share", "market forecast", "competitive landscape", "industry report", "a thesis submitted", "a dissertation submitted", "in partial fulfillment of the requirements", "doctor of philosophy", "master's thesis", "masters thesis", "case study", "case studies",
    "survey results", "survey methodology", "survey respondents", "we surveyed", "questionnaire", "technical report", "architecture diagram", "implementation details", "doi: 10.1234/", "DOI:10.123456789/", "abstract", "introduction", "related work", "methodology", "conclusion", "peer-reviewed", "peer reviewed", "conference on", "proceedings of",
]


def test_each_rule_looks_at_a_text_once(spark):
    rows = spark.createDataFrame([(x,) for x in [*_SAID, *(f"x{x}y" for x in _SAID), "no such words"]], "t string")
    told = rows.select("t", D.classify(F.col("t"), F.array().cast("array<string>")).alias("c")).select("t", "c.document_type", "c.confidence")
    # a pattern was matched once for each thing that is said of the scores
    assert told._jdf.queryExecution().optimizedPlan().toString().upper().count("RLIKE") == len(D.RULES)
    matched = {r.t for r in told.where("document_type <> 'general_report'").collect()}
    assert matched == set(_SAID)


def test_headings_are_found_within_their_paper(spark):
    pages = ["Journal\nABSTRACT\nSaid here\n\n1. Wide Scope\nwords\nmore\n2", "Journal\n\nRelated  Work\nold\n\n2 Next Part\nwords\n3. not A Title\nlast\n9"]
    docs = D.normalized(spark.createDataFrame([("a", [(k + 1, t) for k, t in enumerate(pages)]), ("b", [(1, "words")]), ("c", None)], "paper_id string, pages array<struct<pageNumber: int, text: string>>"))
    found = D.headings(docs)
    text = docs.where("paper_id = 'a'").first().text
    got = sorted((r.line_start, r.title, r.section_type, text[r.line_start : r.body_start]) for r in found.collect())
    assert [x[1:] for x in got] == [("ABSTRACT", "abstract", "ABSTRACT\n"), ("1. Wide Scope", "other", "1. Wide Scope\n"), ("Related  Work", "related_work", "Related  Work\n"), ("2 Next Part", "other", "2 Next Part\n")]
    # every line was shuffled for its offset, and candidates again for their order
    assert "Exchange" not in D.sections(docs)._jdf.queryExecution().executedPlan().toString()
