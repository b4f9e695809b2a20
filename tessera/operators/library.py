"""Views of a library and its drafts, locators, model envelopes and pacing (D10, D18, D20, F6, F7, F13, F18, F19, J16, J20, J22, A28 to A30, SNK6, SNK7, ST29 to ST31, VC8, VC9, W9, W10)."""

from __future__ import annotations

from collections import deque
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bounded_writer_text, collapse, js_trim
from .collaboration import EDITORS
from .ordered import fold_sorted

# By kind of failure what is stored, and what a reader is told.
FAILURES = {
    "invalid_pdf": ("The file could not be read as a PDF.", "The file could not be read as a valid PDF. It may be damaged or not a real PDF."),
    "encrypted_pdf": ("The PDF is password-protected.", "This PDF is password-protected. Remove the password and add the paper again."),
    "no_extractable_text": ("No text could be extracted. The PDF may be a scan of images.", "No text could be extracted. This PDF may contain scanned or image-only pages, so there is no text layer to read. Try a text-based version of the paper."),
    "extraction_failed": ("Text extraction failed unexpectedly.", "Something unexpected went wrong while reading this document."),
    "timeout": ("Processing took too long and was stopped.", "The document took too long to process and was stopped."),
    "storage_error": ("The PDF file could not be downloaded from storage.", "The PDF could not be retrieved for processing. This is usually temporary."),
    "persistence_error": ("The extracted text could not be saved.", "The extracted text could not be saved. This is usually temporary."),
    "interrupted": ("Processing was interrupted repeatedly and was stopped.", "Processing was interrupted several times and was stopped. This is usually temporary."),
}
UNKNOWN_FAILURE = "The document could not be processed."


def chunk_pages(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks(paper_id, char_start, char_end, ...) with the pages on which they start and end, by docs(paper_id, page_starts, page_numbers)."""
    at = lambda c: F.element_at("page_numbers", F.greatest(F.size(F.filter("page_starts", lambda s: s <= c)), F.lit(1)))
    rows = chunks.join(docs.select("paper_id", "page_starts", "page_numbers").where(F.size("page_starts") > 0), "paper_id", "left")
    return rows.select(*chunks.columns, at(F.col("char_start")).alias("page_start"), at(F.greatest("char_start", F.col("char_end") - 1)).alias("page_end"))


def outline(sections: DataFrame) -> DataFrame:
    """sections(paper_id, position, title, section_type) in order; a label that says what the title does is left out."""
    label = F.replace("section_type", F.lit("_"), F.lit(" "))
    same = F.lower(js_trim("title")) == F.lower(label)
    return sections.select("paper_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("position")).alias("place"), "title", F.when(~same, label).alias("label"))


def stored_failure(kind: Column) -> Column:
    """The message that a kind of failure is stored as; kinds that are not known are told as extraction_failed."""
    said = F.create_map(*[F.lit(x) for k, (stored, _) in FAILURES.items() for x in (k, stored)])
    return F.coalesce(F.try_element_at(said, kind), F.lit(FAILURES["extraction_failed"][0]))


def describe_failure(message: Column) -> Column:
    """Struct of kind, explanation and detail of a stored message; one that is not known stands as it is in detail, an empty one does not."""
    said = js_trim(F.coalesce(message, F.lit("")))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, (stored, _) in FAILURES.items() for x in (stored, k)]), said), F.lit("unknown"))
    told = F.try_element_at(F.create_map(*[F.lit(x) for k, (_, shown) in FAILURES.items() for x in (k, shown)]), kind)
    return F.struct(kind.alias("kind"), F.coalesce(told, F.lit(UNKNOWN_FAILURE)).alias("explanation"), F.when((kind == "unknown") & (said != ""), said).alias("detail"))


def optional(column: Column, wanted: object | None) -> Column:
    """a predicate that holds for all rows if nothing is asked."""
    return F.lit(True) if wanted is None else column == F.lit(wanted)


def in_progress(status: Column) -> Column:
    """F18."""
    return F.coalesce(status.isin("uploaded", "processing"), F.lit(False))


def active_since(updated: Column, now: Column, days: int = 7) -> Column:
    """less than so many days ago."""
    return F.coalesce(updated > now - F.expr(f"interval {days} days"), F.lit(False))


# What resolving needs, by name: requests(request, signed_in, in_project), papers(request, paper_id, status) of the request's project,
# chunks(chunk_id, paper_id, section_id, text), sections(section_id, paper_id), overviews(paper_id, schema_version, extraction, stale),
# fields(paper_id, schema_version, field_key, state, malformed, items), sources(paper_id, schema_version, field_key, item, ord, chunk_id).
def resolve_requests(locators: DataFrame, given: Mapping[str, DataFrame], source_chars: int = 1_200, claim_chars: int = 500) -> DataFrame:
    """Each request's locators as evidence, or its error and nothing: (request, error, evidence).

    locators(request, place, kind, paper_id, chunk_id, section_id, schema_version, field_key, item), kind chunk or extraction_claim.
    Errors rank by what is asked first: unauthenticated, then the project (scope_not_found), then every locator's paper in order
    (scope_not_found, paper_not_ready), then every locator's evidence in order: a chunk of that paper and section (not_found) with
    text left (unusable); or a claim whose extraction is stale, not there (not_found), malformed, blank or without a source
    (unusable). evidence is an array of (place, kind, paper_id, text, chunks) in order. A request without locators has an empty one,
    a null is not there, and of several field rows of a claim the least counts.
    """
    keys = ["request", "place"]
    papers = given["papers"].groupBy("request", "paper_id").agg(F.min("status").alias("paper_status"))
    rows = locators.join(papers, ["request", "paper_id"], "left")
    sections = given["sections"].select("section_id", F.col("paper_id").alias("section_paper")).distinct()
    chunks = given["chunks"].groupBy("chunk_id").agg(F.min(F.struct("paper_id", "section_id", "text")).alias("c")).select("chunk_id", F.col("c.paper_id").alias("chunk_paper"), F.col("c.section_id").alias("chunk_section"), "c.text")
    direct = rows.where("kind = 'chunk'").join(chunks, "chunk_id", "left").join(sections, F.col("section_paper").eqNullSafe(F.col("paper_id")) & (sections["section_id"] == rows["section_id"]), "left").drop(sections["section_id"])
    held = (F.col("chunk_paper") == F.col("paper_id")) & (F.col("chunk_section") == F.col("section_id")) & F.col("section_paper").isNotNull()
    said = F.coalesce(bounded_writer_text(F.col("text"), source_chars), F.lit(""))
    direct = direct.select(*keys, "kind", "paper_id", "paper_status", F.when(~F.coalesce(held, F.lit(False)), "not_found").when(said == "", "unusable").alias("fault"), said.alias("said"), F.array(F.col("chunk_id")).alias("found"))

    claim = ["paper_id", "schema_version", "field_key"]
    current = F.bool_or(F.coalesce(~F.col("stale") & F.col("extraction").isin("complete", "partial"), F.lit(False)))
    overviews = given["overviews"].groupBy("paper_id", "schema_version").agg(F.bool_or("stale").alias("any_stale"), current.alias("current"))
    fields = given["fields"].groupBy(*claim).agg(F.min(F.struct("state", "malformed", "items")).alias("f"))
    sources = given["sources"].groupBy(*claim, "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "chunk_id"))), lambda x: x["chunk_id"]).alias("found"))
    claims = rows.where("kind = 'extraction_claim'").join(overviews, ["paper_id", "schema_version"], "left").join(fields, claim, "left").join(sources, [*claim, "item"], "left")
    text = js_trim(F.get("f.items", F.col("item")))
    unusable = ~F.coalesce((F.col("f.state") == "extracted") & ~F.col("f.malformed") & (text != "") & (F.size("found") > 0), F.lit(False))
    fault = F.when(F.col("any_stale"), "stale").when(~F.coalesce("current", F.lit(False)) | F.col("f").isNull(), "not_found").when(unusable, "unusable")
    claims = claims.select(*keys, "kind", "paper_id", "paper_status", fault.alias("fault"), bounded_writer_text(text, claim_chars).alias("said"), "found")

    every = direct.unionByName(claims)
    first = F.when(F.col("paper_status").isNull(), "scope_not_found").when(F.col("paper_status") != "ready", "paper_not_ready")
    told = every.groupBy("request").agg(
        F.min_by(first, F.when(first.isNotNull(), F.col("place"))).alias("of_paper"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("place"))).alias("of_evidence"),
        F.array_sort(F.collect_list(F.struct("place", "kind", "paper_id", F.col("said").alias("text"), F.col("found").alias("chunks")))).alias("evidence"),
    )
    asked = given["requests"].join(told, "request", "left")
    error = F.when(~F.coalesce("signed_in", F.lit(False)), "unauthenticated").when(~F.coalesce("in_project", F.lit(False)), "scope_not_found").otherwise(F.coalesce("of_paper", "of_evidence"))
    kind = told.schema["evidence"].dataType
    return asked.select("request", error.alias("error"), F.when(error.isNull(), F.coalesce("evidence", F.array().cast(kind))).alias("evidence"))


def claim_texts(wanted: DataFrame, fields: DataFrame) -> DataFrame:
    """wanted(paper_id, field_key, item) with the text that stands at that item of fields(paper_id, field_key, updated_at, items); '' where there is none.

    Of several rows of a field that hold the item the newest counts, ties by content.
    """
    items = fields.select("paper_id", "field_key", "updated_at", F.posexplode("items").alias("item", "text"))
    told = items.groupBy("paper_id", "field_key", "item").agg(F.max_by("text", F.struct("updated_at", "text")).alias("text"))
    return wanted.join(told, ["paper_id", "field_key", "item"], "left").select("paper_id", "field_key", "item", F.coalesce("text", F.lit("")).alias("text"))


def gap_claim_texts(wanted: DataFrame, fields: DataFrame) -> DataFrame:
    """wanted(paper_id, field_key, item) with the claim of the newest row of fields(..., updated_at, state, malformed, items).

    Where rows as new differ, the row is not extracted or malformed, or no such item has text, a fixed text says so.
    """
    from .graph import NO_CLAIM
    from .relational import newest_unconflicted

    kind = "struct<state: string, malformed: boolean, items: array<string>>"
    told = newest_unconflicted(fields, ["paper_id", "field_key"], "updated_at", F.to_json(F.struct("state", "malformed", "items"), {"ignoreNullFields": "false"})).select("paper_id", "field_key", F.from_json("content", kind).alias("c"))
    text = F.when((F.col("c.state") == "extracted") & ~F.col("c.malformed"), F.nullif(F.get("c.items", F.col("item")), F.lit("")))
    return wanted.join(told, ["paper_id", "field_key"], "left").select("paper_id", "field_key", "item", F.coalesce(text, F.lit(NO_CLAIM)).alias("text"))


def draft_copy(paragraphs: DataFrame, references: DataFrame) -> DataFrame:
    """SNK6: drafts as plain text: title, paragraphs a blank line apart, and their references, if any, under a heading.

    paragraphs(draft, title, place, text), references(draft, references).
    """
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n\n")
    rows = paragraphs.groupBy("draft").agg(F.min("title").alias("title"), body.alias("body")).join(references, "draft", "left")
    return rows.select("draft", F.concat_ws("\n\n", F.nullif("title", F.lit("")), "body", F.concat(F.lit("References\n"), F.nullif("references", F.lit("")))).alias("text"))


def deletions(rows: DataFrame, objects: DataFrame, doomed: DataFrame, key: str) -> DataFrame:
    """SNK7: what is left to delete of doomed keys, objects first: a row goes only once its object has, so that a retry finds both."""
    there = objects.select(key).distinct().withColumn("has_object", F.lit(True))
    left = rows.select(key).join(doomed.select(key).distinct(), key, "left_semi").distinct().join(there, key, "left")
    return left.select(key, F.when(F.col("has_object"), "object").otherwise("row").alias("next"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """Requests, billed tokens (null if any is unknown) and waiting of runs(run, requests, tokens, waited)."""
    known = F.count("tokens") == F.count("*")
    return jobs.groupBy("run").agg(F.sum("requests").alias("requests"), F.when(known, F.sum("tokens")).alias("tokens"), F.sum("waited").alias("waited"))


def dry_run(chunks: DataFrame, stored: DataFrame, items: int = 32, request_tokens: int = 4_000, requests: int = 3, minute_tokens: int = 8_500, window: float = 61.0, took: float = 1.0) -> DataFrame:
    """What indexing a paper would take: its chunks in all, those whose vector is kept and those to embed, and of these requests, tokens and paced seconds.

    chunks(paper_id, chunk_id, place, input), stored(chunk_id, content_hash). Chunks fill requests in order; a request has the tokens of
    its characters and takes some time, and starts as soon as the requests and tokens of the window allow. A null input is empty.
    """
    from .retrieval import batches, incremental_plan, token_estimate

    plan = incremental_plan(chunks.withColumn("input", F.coalesce("input", F.lit(""))), stored)
    counts = plan.groupBy("paper_id").agg(F.count("*").alias("total"), F.count_if(F.col("action") == "reuse").alias("reusable"))
    chars = F.length("input").cast("long")
    pending = plan.where("action <> 'reuse'").select("paper_id", "place", "chunk_id", chars.alias("chars"), token_estimate(chars).alias("size"))
    filled = batches(pending, "paper_id", ["place", "chunk_id"], "size", items, request_tokens)
    asked = filled.groupBy("paper_id", "batch").agg(token_estimate(F.sum("chars")).alias("amount"), F.count("*").alias("chunks"))
    paced = admissions(asked.select(F.col("paper_id").cast("string").alias("key"), F.col("batch").alias("seq"), F.lit(0.0).alias("asked"), "amount"), requests, minute_tokens, window, took)
    ends = paced.groupBy("key").agg((F.max("at") + took).alias("seconds"))
    sums = asked.groupBy("paper_id").agg(F.sum("chunks").alias("pending"), F.count("*").alias("requests"), F.sum("amount").alias("tokens"))
    rows = counts.join(sums, "paper_id", "left").join(ends, F.col("paper_id").cast("string") == F.col("key"), "left").drop("key")
    return rows.na.fill(0, ["pending", "requests", "tokens"]).na.fill(0.0, ["seconds"])


def in_flight(requests: DataFrame, running: DataFrame, key: str) -> DataFrame:
    """ST29: one request of each key that is not running."""
    return requests.select(key).distinct().join(running.select(key), key, "left_anti")


def logged(entries: DataFrame, members: DataFrame) -> DataFrame:
    """ST30: manual activity(project_id, user_id, ...) of members who may edit."""
    return entries.join(members.where(F.col("role").isin(*EDITORS)).select("project_id", "user_id"), ["project_id", "user_id"], "left_semi")


def seeded(projects: DataFrame, members: DataFrame) -> DataFrame:
    """ST31: the owner's membership of projects(project_id, owner) that lack it."""
    owners = projects.select("project_id", F.col("owner").alias("user_id"))
    return owners.join(members, ["project_id", "user_id"], "left_anti").withColumn("role", F.lit("OWNER"))


def envelope(status: Column, body: Column) -> Column:
    """VC8: struct of outcome, content and tokens of a model's HTTP answer: its class of status, a cut-off answer, content that is no JSON object, and counts that are whole numbers."""
    choice = F.get_json_object(body, "$.choices[0].message.content")
    kind = F.schema_of_variant(F.try_parse_json(choice))
    outcome = (
        F.when(status == 429, "rate_limited").when(status.isin(401, 403), "unauthorized").when(status >= 500, "unavailable").when(status != 200, "rejected")
        .when(F.get_json_object(body, "$.choices[0].finish_reason") == "length", "truncated").when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "ok").otherwise("invalid_output")
    )
    count = F.get_json_object(body, "$.usage.total_tokens")
    return F.struct(outcome.alias("outcome"), F.when(outcome == "ok", choice).alias("content"), F.when(count.rlike("^[0-9]{1,15}$"), count.cast("long")).alias("tokens"))


@dataclass(frozen=True)
class WorkerConfig:
    """VC9: settings of a worker within their ranges (seconds and counts)."""

    poll: float = 10
    timeout: float = 120
    stale: float = 900
    attempts: int = 3
    request_tokens: int = 4_000
    minute_tokens: int = 10_000

    def __post_init__(self):
        ranges = {"poll": (1, 300), "timeout": (10, 600), "stale": (60, 86_400), "attempts": (1, 10), "request_tokens": (100, 120_000), "minute_tokens": (100, 10_000_000)}
        for name, (low, high) in ranges.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} lies between {low} and {high}")
        if self.stale < 2 * self.timeout:
            raise ValueError("stale is at least twice the timeout")
        if self.request_tokens > self.minute_tokens:
            raise ValueError("one request fits into a minute's tokens")


def admissions(requests: DataFrame, most: int = 3, tokens: int = 8_500, window: float = 61.0, took: float = 0.0) -> DataFrame:
    """requests(key, seq, asked, amount) with the earliest time at which each may go, once those before it took their time.

    Within any window there are at most so many requests and tokens; a request above the tokens goes alone.
    """

    def step(state: deque, row: tuple) -> tuple[deque, tuple]:
        key, seq, asked, amount = row
        now = max(asked, state[-1][0] + took if state else asked)
        recent = deque((t, n) for t, n in state if t > now - window)
        while recent and (len(recent) >= most or sum(n for _, n in recent) + amount > tokens):
            now = max(now, recent.popleft()[0] + window)
            recent = deque((t, n) for t, n in recent if t > now - window)
        recent.append((now, amount))
        return recent, (key, seq, float(now))

    kept = requests.select(F.col("key").cast("string"), F.col("seq").cast("long"), F.col("asked").cast("double"), F.col("amount").cast("long"))
    return fold_sorted(kept, ["key"], ["seq"], deque, step, "key string, seq long, at double")
