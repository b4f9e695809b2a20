"""Shapes of JSON, locators and dry runs against literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import library as L
from tessera.operators import shapes as S

GOOD = '{"state":"extracted","items":[{"text":"a","evidence_ids":["E1"]}]}'


def output(**fields):
    told = {f: GOOD for f in S.FIELDS} | fields
    return '{"fields":{' + ",".join(f'"{k}":{v}' for k, v in told.items() if v is not None) + "}}"


CASES = {
    output(): "", "not json": "(root) invalid_json", None: "(root) invalid_json", "[]": "(root) invalid_type", "{}": "fields invalid_type", '{"fields":null}': "fields invalid_type",
    output(objective=None): "fields.objective invalid_type", output(extra="1"): "fields unrecognized_keys", output(dataset='{"state":"odd","items":[]}'): "fields.dataset.state invalid_value",
    output(concepts='{"state":"not_reported","items":[{"text":"a","evidence_ids":["E1"]}]}'): "fields.concepts custom", output(findings='{"state":"extracted","items":[]}'): "fields.findings custom",
    output(findings='{"state":5,"items":{}}'): "fields.findings.state invalid_value, fields.findings.items invalid_type",
    output(findings='{"state":"extracted","items":[{"text":" ","evidence_ids":[]},{"text":3,"evidence_ids":["E1","e1",4],"x":1}]}'): "fields.findings.items.0.text too_small, fields.findings.items.0.evidence_ids too_small, fields.findings.items.1.text invalid_type, fields.findings.items.1.evidence_ids.1 invalid_format, fields.findings.items.1.evidence_ids.2 invalid_type (+1 more)",
    output(findings='{"state":"extracted","items":[' + ",".join(['{"text":"a","evidence_ids":["E1"]}'] * 4) + "]}"): "fields.findings.items too_big",
    output(findings='{"state":"extracted","items":[{"text":"' + "x" * 501 + '","evidence_ids":["E1"]}]}'): "fields.findings.items.0.text too_big",
}


def test_extractions_have_a_shape(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(CASES)], "k int, output string")
    got = {r.k: r.said for r in df.select("k", F.coalesce(S.shown_issues(S.issues(F.col("output"), S.EXTRACTION)), F.lit("")).alias("said")).collect()}
    assert got == dict(enumerate(CASES.values()))


def test_extractions_cite_their_packet(spark):
    item = lambda *ids: '{"state":"extracted","items":[{"text":"a","evidence_ids":[' + ",".join(f'"{i}"' for i in ids) + "]}]}"
    outputs = [(1, output()), (2, output(dataset=item("E1", "E2"))), (3, output(dataset=item("E2"))), (4, output(methodology=item("E1", "E1"))), (5, output(objective=item("E9"), dataset=item("E8"))), (6, "{")]
    packet = spark.createDataFrame([(p, e, f) for p in range(1, 7) for e, f in (("E1", S.FIELDS), ("E2", ["findings"]))], "paper_id int, evidence_id string, fields array<string>")
    got = {r.paper_id: (r.error, r.diagnostic) for r in S.checked_extractions(spark.createDataFrame(outputs, "paper_id int, output string"), packet).collect()}
    assert got == {
        1: (None, None), 2: ("invalid_citation", "citation field=dataset item=0 not_eligible_for_field"), 3: ("invalid_citation", "citation field=dataset item=0 not_eligible_for_field"),
        4: ("invalid_citation", "citation field=methodology item=0 duplicate_id"), 5: ("invalid_citation", "citation field=objective item=0 unknown_id"), 6: ("invalid_output", "schema_validation (root) invalid_json"),
    }


def test_search_requests(spark):
    one, two = "6f9619ff-8b86-4011-b42d-00cf4fc964ff", "6F9619FF-8B86-4011-B42D-00CF4FC964FE"
    cases = {
        '{"query":"ab","scope":{"type":"library"}}': "", '{"query":" a\\u0000 ","scope":{"type":"library"},"limit":50,"minSimilarity":null,"more":1}': "query too_small",
        '{"query":"--","scope":{"type":"project","projectId":"' + two + '"}}': "query invalid_format", '{"query":"ab","scope":{"type":"project","projectId":"x"},"limit":0}': "scope.projectId invalid_format, limit too_small",
        '{"query":"ab","scope":{"type":"papers","paperIds":[]},"limit":1.5,"minSimilarity":2}': "scope.paperIds too_small, limit invalid_type, minSimilarity too_big",
        '{"query":"ab","scope":{"type":"papers","paperIds":["' + one + '",1]},"limit":null,"includeReferences":"yes"}': "scope.paperIds.1 invalid_type, limit invalid_type, includeReferences invalid_type",
        '{"query":5,"scope":{"type":"odd"}}': "query invalid_type, scope.type invalid_union", '{"query":"' + "a" * 1001 + '","scope":[]}': "query too_big, scope invalid_type", '{"query":"' + "é" * 20_001 + '","scope":{"type":"library"}}': "query too_big",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, body string")
    got = {r.k: r.said for r in df.select("k", F.coalesce(S.shown_issues(S.search_issues(F.col("body"))), F.lit("")).alias("said")).collect()}
    assert got == dict(enumerate(cases.values()))


def test_diagnostics_hold_no_content(spark):
    df = spark.createDataFrame([("a b<c>", -1, 7, 1 << 60)], "m string, x long, y long, z long")
    said = S.safe_diagnostic(F.lit("truncated"), detail=F.lit(""), model=F.col("m"), finish=F.lit(None).cast("string"), counts={"prompt_tokens": F.col("x"), "total_tokens": F.col("y"), "reasoning_tokens": F.col("z")})
    assert df.select(said.alias("s")).first().s == "truncated; model=a?b?c?; total_tokens=7"
    assert len(df.select(S.safe_diagnostic(F.lit("x" * 400)).alias("s")).first().s) == 300
    kinds = spark.sql("select try_parse_json(j) as v from values ('{}'), ('[1]'), ('\"a\"'), ('1'), ('1.5'), ('1e3'), ('true'), ('null'), (null) t(j)").select(S.kind_of(F.col("v")).alias("k"))
    assert [r.k for r in kinds.collect()] == ["object", "array", "string", "number", "number", "number", "boolean", "null", "undefined"]


@pytest.fixture(scope="module")
def world(spark):
    d = spark.createDataFrame
    papers = d([(r, p, "processing" if p == 4 else "ready") for r in range(20) for p in (1, 2, 4)], "request int, paper_id int, status string")
    return {
        "papers": papers, "requests": d([(r, r != 10, r != 11) for r in range(20)] + [(20, None, True)], "request int, signed_in boolean, in_project boolean"),
        "chunks": d([(1, 1, 1, "some text"), (2, 1, 1, " ​ "), (3, 2, 3, "other")], "chunk_id int, paper_id int, section_id int, text string"), "sections": d([(1, 1), (3, 2)], "section_id int, paper_id int"),
        "overviews": d([(1, 1, "complete", False), (1, 2, "complete", True), (1, 3, "running", False), (2, 1, "partial", False)], "paper_id int, schema_version int, extraction string, stale boolean"),
        "fields": d([(1, 1, "findings", "extracted", False, ["a", " ", "c"]), (1, 1, "dataset", "failed", False, ["a"]), (2, 1, "findings", "extracted", True, ["a"])], "paper_id int, schema_version int, field_key string, state string, malformed boolean, items array<string>"),
        "sources": d([(1, 1, "findings", 0, 2, 9), (1, 1, "findings", 0, 1, 8), (1, 1, "findings", 1, 1, 8)], "paper_id int, schema_version int, field_key string, item int, ord int, chunk_id int"),
    }


def test_locators_resolve_all_or_nothing(spark, world):
    chunk = lambda r, place, paper, c, s: (r, place, "chunk", paper, c, s, None, None, None)
    claim = lambda r, place, paper, version, key, item: (r, place, "extraction_claim", paper, None, None, version, key, item)
    locators = [
        chunk(0, 0, 1, 1, 1), claim(0, 1, 1, 1, "findings", 0), chunk(1, 0, 1, 9, 1), chunk(2, 0, 1, 2, 1), chunk(3, 0, 1, 3, 3), claim(4, 0, 1, 2, "findings", 0), claim(5, 0, 1, 3, "findings", 0), claim(6, 0, 1, 1, "concepts", 0),
        claim(7, 0, 1, 1, "dataset", 0), claim(8, 0, 1, 1, "findings", 1), claim(9, 0, 1, 1, "findings", 2), chunk(10, 0, 1, 1, 1), chunk(11, 0, 1, 1, 1), claim(12, 0, 1, 2, "findings", 0), chunk(12, 1, 7, 1, 1), chunk(13, 0, 4, 1, 1), chunk(13, 1, 7, 1, 1),
        chunk(14, 0, 1, 1, 1), chunk(14, 1, 1, 2, 1), claim(14, 2, 1, 2, "findings", 0), claim(15, 0, 2, 1, "findings", 0), claim(16, 0, 1, 1, "findings", 7), chunk(17, 0, 1, 1, None), chunk(20, 0, 1, 1, 1),
    ]
    df = spark.createDataFrame(locators, "request int, place int, kind string, paper_id int, chunk_id int, section_id int, schema_version int, field_key string, item int")
    got = {r.request: (r.error, r.evidence) for r in L.resolve_requests(df, world).collect()}
    errors = {k: v[0] for k, v in got.items()}
    want = {1: "not_found", 2: "unusable", 3: "not_found", 4: "stale", 5: "not_found", 6: "not_found", 7: "unusable", 8: "unusable", 9: "unusable", 10: "unauthenticated", 11: "scope_not_found", 12: "scope_not_found", 13: "paper_not_ready", 14: "unusable", 15: "unusable", 16: "unusable", 17: "not_found", 20: "unauthenticated"}
    assert errors == {k: want.get(k) for k in range(21)}
    assert [(e.place, e.text, e.chunks) for e in got[0][1]] == [(0, "some text", [1]), (1, "a", [8, 9])] and got[18][1] == []
    assert all(v[1] is None for v in got.values() if v[0])


def slow_pacing(amounts, most, tokens, window, took):
    """The limiter as it is described: wait for the oldest request that blocks, then for enough tokens to pass out of the window."""
    clock, events = 0.0, []
    for n in amounts:
        events = [e for e in events if e[0] > clock - window]
        wait, used = 0.0, sum(e[1] for e in events)
        if len(events) >= most:
            wait = max(wait, events[len(events) - most][0] + window - clock)
        if used + n > tokens:
            for at, m in events:
                used -= m
                if used + n <= tokens:
                    wait = max(wait, at + window - clock)
                    break
        clock += wait
        events.append((clock, n))
        clock += took
    return clock


def test_dry_runs_fill_and_pace_requests(spark):
    sizes = {1: [9_000, 3_000, 100, 12_000, 11_999, 1, 5], 2: [30] * 90, 3: [6_000] * 12, 4: []}
    chunks = [(p, 1000 * p + k, k, "x" * n) for p, ns in sizes.items() for k, n in enumerate(ns)] + [(4, 4000, 0, None), (5, 5000, 0, "kept")]
    df = spark.createDataFrame(chunks, "paper_id int, chunk_id int, place int, input string")
    import hashlib

    stored = spark.createDataFrame([(5000, hashlib.sha256(b"kept").hexdigest()), (4000, "old")], "chunk_id int, content_hash string")
    got = {r.paper_id: r for r in L.dry_run(df, stored).collect()}
    for p, ns in {**sizes, 4: [0], 5: []}.items():
        batches = []
        for n in ns:
            t = math.ceil(n / 3)
            if batches and len(batches[-1]) < 32 and sum(math.ceil(m / 3) for m in batches[-1]) + t <= 4_000:
                batches[-1].append(n)
            else:
                batches.append([n])
        amounts = [math.ceil(sum(b) / 3) for b in batches]
        r = got[p]
        assert (r.total, r.reusable, r.pending, r.requests, r.tokens) == (len(ns) + (p == 5), int(p == 5), len(ns), len(batches), sum(amounts))
        assert r.seconds == pytest.approx(slow_pacing(amounts, 3, 8_500, 61, 1) if ns else 0.0)
