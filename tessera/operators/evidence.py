"""Evidence sets, the evidence matrix, writer and claim-check packets, and checks of what models answer.

Packets are folds over a bounded number of candidates of a request in order, as column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, bounded, bounded_writer_text, js_trim, normalize_title, normalized_literal, sanitize_claim, sanitize_evidence
from ..session import held

# The matrix fields in their order.
FIELDS = ["objective", "methodology", "dataset", "findings", "limitations", "future_work", "concepts"]
# By field the section types that feed it, most relevant first, and headings that do.
ROUTING = {
    "objective": (["abstract", "introduction"], ["objective", "objectives", "aim", "aims", "research questions", "problem statement"]),
    "methodology": (["methods"], ["methodology", "method", "methods", "experimental", "experimental setup", "experiments", "setup", "approach", "proposed method", "procedure"]),
    "dataset": (["methods"], ["dataset", "datasets", "data", "data collection", "participants", "sample", "materials", "materials and methods", "corpus"]),
    "findings": (["results", "discussion"], ["findings", "results", "evaluation", "experimental results"]),
    "limitations": (["limitations", "discussion"], ["limitation", "limitations", "threats to validity", "caveats"]),
    "future_work": (["conclusion", "limitations"], ["future work", "future directions", "future research", "conclusions"]),
    "concepts": (["abstract", "introduction", "background", "related_work"], ["keywords", "preliminaries", "background"]),
}
UNROUTED = ["references", "acknowledgments", "appendix"]
# The matrix fields that each writing mode draws on.
MODE_FIELDS = {"compare_studies": FIELDS[:4], "methodology_summary": ["methodology", "dataset"], "findings_synthesis": ["findings"], "limitations_future_work": ["limitations", "future_work"]}


# --- E1, K10: evidence for an answer -------------------------------------------------------------------
def chat_evidence(hits: DataFrame, most: int = 8, budget: int = 24_000) -> DataFrame:
    """(request, evidence_id, rank, content) of hits(request, rank, section_id, char_start, char_end, content).

    The first hits of a request in order, without those that overlap one kept before in their section and
    empty ones; the first that would break the budget ends the set. A null content is empty, sections that are
    both null are one section, and a hit without both ends overlaps nothing.
    """
    first = hits.withColumn("place", F.row_number().over(Window.partitionBy("request").orderBy("rank"))).where(F.col("place") <= most)
    clean = first.withColumn("content", F.coalesce(js_trim(sanitize_evidence(F.col("content"))), F.lit(""))).withColumn("size", F.length("content"))
    packed = clean.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("rank", "section_id", "char_start", "char_end", "size", "content"))).alias("hits"))
    kind = packed.schema["hits"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("used"), F.lit(True).alias("open"))

    def step(a: Column, h: Column) -> Column:
        apart = ~F.exists(a["kept"], lambda k: k["section_id"].eqNullSafe(h["section_id"]) & F.coalesce((k["char_start"] < h["char_end"]) & (h["char_start"] < k["char_end"]), F.lit(False)))
        offered = a["open"] & apart & (h["size"] > 0)
        fits = a["used"] + h["size"] <= budget
        takes = offered & fits
        return F.struct(F.when(takes, F.concat(a["kept"], F.array(h))).otherwise(a["kept"]).alias("kept"), F.when(takes, a["used"] + h["size"]).otherwise(a["used"]).alias("used"), (a["open"] & ~(offered & ~fits)).alias("open"))

    kept = packed.select("request", F.posexplode(F.aggregate("hits", start, step, lambda a: a["kept"])).alias("n", "h"))
    return kept.select("request", F.concat(F.lit("S"), (F.col("n") + 1).cast("string")).alias("evidence_id"), "h.rank", "h.content")


# --- E2, E3: what feeds a matrix field ------------------------------------------------------------------
def route(section_type: Column, title: Column) -> Column:
    """Array of (field, priority) that a section feeds: the place of its type, or 100 where only its heading tells."""
    plain = normalize_title(title)
    padded = F.concat(F.lit(" "), plain, F.lit(" "))
    out = []
    for field, (types, titles) in ROUTING.items():
        named = F.when(section_type == "other", (plain != "") & padded.rlike(" (?:" + "|".join(titles) + ") ")).otherwise(plain.isin(*titles))
        place = F.when(section_type.isin(*types), F.array_position(F.array(*map(F.lit, types)), section_type).cast("int") - 1).when(named, 100)
        out.append(F.when(place.isNotNull(), F.struct(F.lit(field).alias("field"), place.alias("priority"))))
    fed = F.filter(F.array(*out), lambda x: x.isNotNull())
    return F.when(~section_type.isin(*UNROUTED), fed).otherwise(F.filter(fed, lambda x: F.lit(False)))


def evidence_packet(candidates: DataFrame, most: int = 40, budget: int = 24_000, largest: int = 4_000) -> DataFrame:
    """(paper_id, evidence_id, chunk_id, fields) from candidates(paper_id, chunk_id, chunk_index, field, priority, size).

    Fields take turns in their order, each the next chunk of its queue that is not taken yet and fits; a chunk that does not fit
    is passed for good, and so is one without a size. A round that adds nothing, or enough items, ends it. Ids
    follow document order. A paper's sizes are folded in one row, without its texts.
    """

    kinds = dict(candidates.select("paper_id", "chunk_id").dtypes)

    def taken_of(cands: Iterator[tuple]) -> list[tuple]:
        """(chunk, fields) of one paper's packet in document order."""
        place, size, of = {}, {}, {}
        for chunk, index, field, priority, chars in cands:
            place[chunk], size[chunk] = (index, chunk), chars
            of.setdefault(field, {})[chunk] = priority
        queues = [iter(sorted((c for c in fed if size[c] is not None and size[c] <= largest), key=lambda c, fed=fed: (fed[c], place[c]))) for fed in (of[f] for f in FIELDS if f in of)]
        taken: set = set()
        used, added = 0, True
        while added and len(taken) < most:
            added = False
            for queue in queues:
                chunk = next((c for c in queue if c not in taken and used + size[c] <= budget), None) if len(taken) < most else None
                if chunk is not None:
                    taken.add(chunk)
                    used, added = used + size[chunk], True
        return [(c, ",".join(f for f in FIELDS if c in of.get(f, ()))) for c in sorted(taken, key=place.get)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cands = batch.column(1)
            flat = zip(*(c.to_pylist() for c in cands.flatten().flatten()), strict=True)  # all papers' candidates, a list a column
            rows = [(paper, f"E{k + 1}", chunk, fields) for paper, n in zip(batch.column(0).to_pylist(), cands.value_lengths().to_pylist(), strict=True) for k, (chunk, fields) in enumerate(taken_of(islice(flat, n)))]
            types = [batch.schema.field(0).type, pa.string(), batch.schema.field(1).type.value_type.field("chunk_id").type, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["paper_id", "evidence_id", "chunk_id", "fields"])

    packed = candidates.groupBy("paper_id").agg(F.collect_list(F.struct("chunk_id", "chunk_index", "field", "priority", "size")).alias("cands"))
    return packed.mapInArrow(fold, f"paper_id {kinds['paper_id']}, evidence_id string, chunk_id {kinds['chunk_id']}, fields string")


def packet_facts(candidates: DataFrame, packet: DataFrame) -> DataFrame:
    """A paper's items, the fields that none of them feeds, in order, and how many of its routed chunks were left out."""
    routed = candidates.groupBy("paper_id").agg(F.count_distinct("chunk_id").alias("routed"))
    fed = F.array_distinct(F.flatten(F.collect_list(F.split("fields", ","))))
    kept = packet.groupBy("paper_id").agg(F.count("*").alias("items"), fed.alias("fed"))
    rows = routed.join(kept, "paper_id", "left")
    fed = F.coalesce("fed", F.array().cast("array<string>"))
    empty = F.filter(F.array(*map(F.lit, FIELDS)), lambda f: ~F.array_contains(fed, f))
    items = F.coalesce("items", F.lit(0))
    return rows.select("paper_id", items.alias("items"), empty.alias("empty_fields"), (F.col("routed") - items).alias("dropped_chunks"))


# --- E4 to E8, A15: the matrix -----------------------------------------------------------------------------
def validate_extraction(cited: DataFrame, packet: DataFrame) -> DataFrame:
    """A paper's first bad citation, by field, item and place; one rejects everything, a null error nothing.

    cited(paper_id, field, item, ord, evidence_id), packet(paper_id, evidence_id, fields).
    """
    seen = F.row_number().over(Window.partitionBy("paper_id", "field", "item", "evidence_id").orderBy("ord"))
    met = cited.withColumn("seen", seen).join(packet.withColumn("known", F.lit(True)), ["paper_id", "evidence_id"], "left")
    reason = F.when(F.col("known").isNull(), "unknown_id").when(~F.array_contains("fields", F.col("field")), "not_eligible_for_field").when(F.col("seen") > 1, "duplicate_id")
    detail = F.concat(F.lit("field="), F.col("field"), F.lit(" item="), F.col("item").cast("string"), F.lit(" "), reason)
    order = F.struct(F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")), "item", "ord")
    return met.groupBy("paper_id").agg(F.min_by(F.when(reason.isNotNull(), detail), F.when(reason.isNotNull(), order)).alias("error"))


def parse_field(value: Column) -> Column:
    """E5: struct of items and malformed of a stored field {"items": [{"text": ...}]}; whatever else stands there is left out and told."""
    entries = F.try_variant_get(F.try_parse_json(value), "$.items", "array<variant>")
    text = lambda x: F.when(F.schema_of_variant(F.try_variant_get(x, "$.text", "variant")) == "STRING", F.try_variant_get(x, "$.text", "string"))
    texts = F.transform(entries, text)
    good = F.filter(texts, lambda t: js_trim(t) != "")
    none = F.array().cast("array<string>")
    return F.struct(F.coalesce(good, none).alias("items"), (entries.isNull() | (F.size(good) < F.size(texts))).alias("malformed"))


def extraction_status(paper: Column, extraction: Column, stale: Column) -> Column:
    """The status of a paper's extraction from its own status, the extraction's (null: none) and whether that is stale."""
    told = F.when(extraction == "pending", "queued").when(extraction == "running", "extracting").when((extraction == "complete") & stale, "out_of_date").when(extraction == "complete", "extracted").otherwise(extraction)
    return F.when(paper != "ready", "waiting").when(extraction.isNull(), "not_extracted").otherwise(told)


def cell(state: Column, items: Column) -> Column:
    """What a matrix cell shows: struct of kind, first item and how many more; a null state is a missing field."""
    n = F.size(items)
    kind = F.when(state.isNull(), "missing").when(state.isin("failed", "not_reported"), state).when(n == 0, "malformed").otherwise("extracted")
    shown = kind == "extracted"
    return F.struct(kind.alias("kind"), F.when(shown, F.get(items, F.lit(0))).alias("first"), F.when(shown, n - 1).alias("more"))


def matrix_rows(papers: DataFrame, overviews: DataFrame, fields: DataFrame) -> DataFrame:
    """A row a paper with its status and a cell a field; extraction data add and remove no rows.

    papers(paper_id, status), overviews(paper_id, extraction, stale), fields(paper_id, field_key, state, items).
    """
    cells = fields.withColumn("cell", cell(F.col("state"), F.col("items"))).groupBy("paper_id").pivot("field_key", FIELDS).agg(F.first("cell"))
    rows = papers.join(overviews, "paper_id", "left").join(cells, "paper_id", "left")
    missing = cell(F.lit(None).cast("string"), F.array().cast("array<string>"))
    return rows.select("paper_id", extraction_status(F.col("status"), F.col("extraction"), F.coalesce("stale", F.lit(False))).alias("status"), *[F.coalesce(F.col(f), missing).alias(f) for f in FIELDS])


def matrix_summary(status: Column) -> list[Column]:
    """Total, current, active and attention of matrix rows."""
    return [F.count("*").alias("total"), F.count_if(status == "extracted").alias("current"), F.count_if(status.isin("queued", "extracting")).alias("active"), F.count_if(status.isin("out_of_date", "partial", "failed")).alias("attention")]


def claim_sources(claims: DataFrame, sources: DataFrame, most: int = 3) -> DataFrame:
    """claims(paper_id, field_key, item) with their first sources(paper_id, field_key, item, ord, chunk_id) by place; a claim without any has none."""
    rank = F.row_number().over(Window.partitionBy("paper_id", "field_key", "item").orderBy("ord", "chunk_id"))
    first = sources.withColumn("n", rank).where(F.col("n") <= most).groupBy("paper_id", "field_key", "item").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunks"))
    rows = claims.join(first, ["paper_id", "field_key", "item"], "left")
    return rows.withColumn("chunks", F.coalesce("chunks", F.array().cast(first.schema["chunks"].dataType)))


# --- E9 to E12: writing ---------------------------------------------------------------------------------------
def semantic_candidates(hits: DataFrame) -> DataFrame:
    """hits(request, rank, paper_id, chunk_id, content) as candidates in order of rank; their identity is the chunk."""
    return hits.select("request", "paper_id", F.to_json(F.array(F.lit("chunk"), F.col("paper_id").cast("string"), F.col("chunk_id").cast("string"))).alias("identity"), F.lpad(F.col("rank").cast("string"), 6, "0").alias("sort_key"), js_trim(sanitize_evidence(F.col("content"))).alias("text"))


def matrix_candidates(requests: DataFrame, papers: DataFrame, overviews: DataFrame, fields: DataFrame, sources: DataFrame, stale: bool = False) -> DataFrame:
    """Claims of the fields that a request's mode draws on, from ready papers whose extraction is current, with a source.

    requests(request, mode, paper_id), papers(paper_id, title, status), overviews(paper_id, schema_version, extraction, stale),
    fields(paper_id, schema_version, field_key, updated_at, state, malformed, items), of which the newest of a version counts unless
    rows as new differ, and sources(paper_id, schema_version, field_key, item). A claim is told by its paper, schema version, field and
    item, so that those of two versions stay two; candidates go by title, paper, field and item. A blank claim is none.
    """
    from .relational import newest_unconflicted

    wanted = requests.join(F.broadcast(requests.sparkSession.createDataFrame([(m, f, k) for m, fs in MODE_FIELDS.items() for k, f in enumerate(fs)], "mode string, field_key string, field_order int")), "mode")
    current = overviews.where(F.col("extraction").isin("complete", "partial") & (F.col("stale") == stale)).select("paper_id", "schema_version").distinct()
    live = papers.where("status = 'ready'").select("paper_id", "title").join(current, "paper_id")
    claim = ["paper_id", "schema_version", "field_key"]
    told = newest_unconflicted(fields, claim, "updated_at", F.to_json(F.struct("state", "malformed", "items")))
    kind = "struct<state: string, malformed: boolean, items: array<string>>"
    claims = told.select(*claim, F.from_json("content", kind).alias("c")).where("c.state = 'extracted' and not c.malformed").select(*claim, F.posexplode("c.items").alias("item", "said"))
    claims = claims.join(sources.select(*claim, "item").distinct(), [*claim, "item"], "left_semi")
    rows = wanted.join(live, "paper_id").join(claims, claim)
    text, paper, item = bounded_writer_text(F.col("said"), 500), F.col("paper_id").cast("string"), F.col("item").cast("string")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    identity = F.concat(F.lit('["extraction_claim",'), quoted(paper), F.lit(","), F.col("schema_version").cast("string"), F.lit(","), quoted(F.col("field_key")), F.lit(","), item, F.lit("]"))
    order = F.to_json(F.array(F.lower("title"), paper, F.lpad(F.col("field_order").cast("string"), 2, "0"), F.lpad(item, 3, "0")))
    return rows.select("request", "paper_id", identity.alias("identity"), order.alias("sort_key"), "field_key", text.alias("text")).where("text <> ''")


def writer_packet(candidates: DataFrame, papers: int = 5, most: int = 12, budget: int = 18_000) -> DataFrame:
    """(request, evidence_id, paper_id, identity) of candidates(request, paper_id, identity, sort_key, text).

    An identity counts once, by its least sort key and text. The first papers by their first candidate take turns; an empty text,
    or one that would break the budget, is passed, and later ones may still fit.
    """
    key = ["request", "paper_id", "identity"]
    # texts are told by their sizes, and looked at only where an identity has several under its least sort key; a null text is the least of all
    size = F.coalesce(F.length("text"), F.lit(-1)).alias("size")
    sized = candidates.select(*key, "sort_key", size).groupBy(*key, "sort_key").agg(F.min("size").alias("least"), F.max("size").alias("largest"))
    unique = held(sized.groupBy(*key).agg(F.min(F.struct("sort_key", "least", "largest")).alias("c")).select(*key, "c.*"), "identities").withColumnRenamed("least", "size")
    tied = unique.where("size >= 0 and size < largest").select(*[F.col(c).alias(f"_{c}") for c in (*key, "sort_key")])
    if not tied.isEmpty():
        met = candidates.join(tied, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*key, "sort_key")]), "left_semi")
        least = met.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.length(F.min("text")).alias("said"))
        unique = unique.join(least, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]), "left").select(*key, "sort_key", F.coalesce("said", "size").alias("size"))
    # a request's rows meet once: its papers take turns in the order of their first candidates
    of_paper = Window.partitionBy("request", "paper_id")
    offered = unique.where("request is not null and paper_id is not null").select(*key, "sort_key", "size").repartition("request").withColumn("turn", F.row_number().over(of_paper.orderBy("sort_key", "identity"))).withColumn("first", F.struct(F.first("sort_key").over(of_paper.orderBy("sort_key", "identity")).alias("sort_key"), "paper_id"))
    rows = offered.withColumn("paper_rank", F.dense_rank().over(Window.partitionBy("request").orderBy("first"))).where((F.col("paper_rank") <= papers) & (F.col("size") > 0))
    packed = rows.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("turn", "paper_rank", "size", "paper_id", "identity"))).alias("xs"))
    kind = packed.schema["xs"].dataType.simpleString()
    start = F.struct(F.array().cast(kind).alias("kept"), F.lit(0).alias("used"))

    def step(a: Column, x: Column) -> Column:
        takes = (F.size(a["kept"]) < most) & (a["used"] + x["size"] <= budget)
        return F.struct(F.when(takes, F.concat(a["kept"], F.array(x))).otherwise(a["kept"]).alias("kept"), F.when(takes, a["used"] + x["size"]).otherwise(a["used"]).alias("used"))

    out = packed.select("request", F.posexplode(F.aggregate("xs", start, step, lambda a: a["kept"])).alias("n", "x"))
    return out.select("request", F.concat(F.lit("W"), (F.col("n") + 1).cast("string")).alias("evidence_id"), "x.paper_id", "x.identity")


def sufficiency(mode: Column, current: Column, stale: Column, items: Column, papers: Column, methodology: Column, comparable: Column, packed_comparable: Column) -> Column:
    """Ready, or why a request abstains, from counts: current and stale candidates, items and papers of the packet, its methodology claims, and papers comparable in candidates and in the packet."""
    enough = F.when(mode == "methodology_summary", methodology > 0).when(mode == "compare_studies", (comparable >= 2) & (packed_comparable >= 2)).otherwise(papers >= 2)
    return F.when(current == 0, F.when(stale > 0, "stale_only").otherwise("no_evidence")).when(items == 0, "no_evidence").when(enough, "ready").otherwise("insufficient_evidence")


# --- E13, E17: claim checks --------------------------------------------------------------------------------------
def claim_packet(cites: DataFrame, most: int = 3, source_chars: int = 1_200, budget: int = 10_000) -> DataFrame:
    """(claim, ord, evidence_id, text, size, status) of cites(claim, ord, claim_text, sources), an array of (excerpt, content).

    A citation has its first usable sources, each cut to a length; one without any, or too much text in
    all, makes the whole claim abstain, which the status says. What is counted and put in order are sizes, so that whoever
    asks for no texts moves none.
    """
    cut = lambda c: bounded(sanitize_claim(c), source_chars)
    filled = lambda c: F.element_at(F.transform(F.array(c), lambda t: F.when(t != "", t)), 1)
    shown = F.explode_outer(F.expr("transform(sources, (s, i) -> struct(i as place, s.excerpt as excerpt, s.content as content))"))
    claim = F.when(F.col("claim_text") != "", F.concat(F.lit("Extracted claim: "), bounded(sanitize_claim(F.col("claim_text")), 500)))
    told = cites.select("claim", "ord", claim.alias("claim_line"), shown.alias("s")).select("claim", "ord", "claim_line", "s.place", F.coalesce(filled(cut(F.col("s.content"))), filled(cut(F.col("s.excerpt")))).alias("said"))
    # all of a claim in one place, once
    rows = told.withColumn("chars", F.length("said")).repartition("claim").withColumn("n", F.row_number().over(Window.partitionBy("claim", "ord").orderBy(F.col("chars").isNull(), "place")))
    usable = (F.col("n") <= most) & F.col("chars").isNotNull()
    lead = F.concat(F.lit("Source "), F.col("n").cast("string"), F.lit(": "))
    lines = F.transform(F.array_sort(F.collect_list(F.when(usable, F.struct("n", F.concat(lead, F.col("said")).alias("line"))))), lambda x: x["line"])
    each = rows.groupBy("claim", "ord", "claim_line").agg(F.sum(F.when(usable, F.length(lead) + F.col("chars") + 1)).alias("chars"), lines.alias("lines"))
    text = F.when(F.col("chars").isNotNull(), F.concat_ws("\n", "claim_line", F.array_join("lines", "\n")))
    size = (F.col("chars") - 1 + F.coalesce(F.length("claim_line") + 1, F.lit(0))).cast("int")
    whole = Window.partitionBy("claim")
    each = each.select("claim", "ord", text.alias("text"), size.alias("size")).withColumns({"lacking": F.bool_or(F.col("size").isNull()).over(whole), "total": F.sum("size").over(whole), "number": F.row_number().over(whole.orderBy("ord"))})
    status = F.when(F.col("lacking"), "no_usable_source").when(F.col("total") > budget, "evidence_budget_exceeded").otherwise("ready")
    ready = lambda c: F.when(status == "ready", c)
    return each.select("claim", "ord", ready(F.concat(F.lit("C"), F.col("number").cast("string"))).alias("evidence_id"), ready(F.col("text")).alias("text"), ready(F.col("size")).alias("size"), status.alias("status"))


# Markup and writer ids that checked text must not hold.
_MARKUP = r"</?[A-Za-z][^>]*>|```|(?m:^)\s{0,3}(?:#{1,6}\s|[-*+]\s|[0-9]+\.\s)|\[[^\]]+\]\([^)]+\)|\*\*|__"
_WRITER_ID = r"(?i)(?<![A-Za-z0-9_])W[0-9]{1,3}(?![A-Za-z0-9_])"


def plain_text(c: Column) -> Column:
    return ~c.rlike(_MARKUP) & ~c.rlike(_WRITER_ID)


def valid_assessments(rows: DataFrame) -> DataFrame:
    """rows(overall, supports, ids, expected, claim, fragments, texts, ...) with valid: whether an assessment holds as a whole.

    It has the ids asked for, each once, plain texts, fragments of the claim, each once, and supports that agree with the overall one.
    What is null, or holds a null, does not hold.
    """
    joined = F.array_join(F.transform("fragments", lambda f: F.regexp_replace(f, f"{WS}+", " ")), "\x1e")
    told = rows.withColumn("whole", normalized_literal(F.col("claim"))).withColumn("parts", F.when(F.size("fragments") > 0, F.transform(F.split(normalized_literal(joined), "\x1e"), F.trim)).otherwise(F.array().cast("array<string>")))
    same = (F.size("ids") == F.size("expected")) & (F.size(F.array_distinct("ids")) == F.size("ids")) & (F.size(F.array_except("ids", "expected")) == 0)
    plain = F.forall(F.concat("texts", "fragments"), plain_text)
    inside = (F.size(F.array_distinct("parts")) == F.size("parts")) & F.forall("parts", lambda f: (f != "") & F.col("whole").contains(f))
    some, has = F.size("parts") > 0, F.array_contains("supports", "supported")
    halves = F.size(F.filter("supports", lambda s: s == "partially_supported"))
    overall = F.col("overall")
    agree = F.when(overall == "supported", ~some & (has | (halves >= 2))).when(overall == "partially_supported", some & ~has & (halves > 0) & ~F.array_contains("parts", F.col("whole"))).when(overall == "unsupported", some & ~has).otherwise(~has)
    whole = overall.isNotNull() & F.col("claim").isNotNull() & ~F.exists("supports", lambda s: s.isNull())
    return told.withColumn("valid", F.coalesce(whole & same & plain & inside & agree, F.lit(False))).drop("whole", "parts")


# --- E14 to E16, E18: answers and drafts ---------------------------------------------------------------------------
def answer_in_limits(segments: Column) -> Column:
    """Array of (text, citations) within the limits of an answer; null segments, texts and citations are not."""
    text = lambda s: F.length(js_trim(s["text"]))
    each = F.forall(segments, lambda s: text(s).between(1, 1500) & (F.size(s["citations"]) <= 8) & F.forall(s["citations"], lambda c: c.rlike("^S[0-9]{1,3}$")))
    return F.coalesce((F.size(segments) <= 12) & each & (F.aggregate(segments, F.lit(0), lambda a, s: a + text(s)) <= 6000), F.lit(False))


def validate_answer(segments: Column, known: Column) -> Column:
    """Segments with the known ids they cite, each once in order; those without any, or without text, go, and with no segment left the answer is null."""
    kept = F.transform(segments, lambda s: F.struct(s["text"].alias("text"), F.filter(F.array_distinct(s["citations"]), lambda c: F.array_contains(known, c)).alias("citations")))
    kept = F.filter(kept, lambda s: F.coalesce((F.size(s["citations"]) > 0) & (js_trim(s["text"]) != ""), F.lit(False)))
    return F.when(F.size(kept) > 0, kept)


# Fixed value: what looks like a citation inside a text.
_TEXT_CITATION = r"(?i)(?:\[\s*)?(?<![A-Za-z0-9_])W[0-9]{1,3}(?![A-Za-z0-9_])(?:\s*\])?|\[\s*[0-9]{1,3}(?:\s*,\s*[0-9]{1,3})*\s*\]"


def validate_draft(units: DataFrame, packet: DataFrame) -> DataFrame:
    """Each draft's error, null if all of it holds, and its units with citations in packet order.

    units(draft, paragraph, place, text, citations), packet(draft, evidence_id). Nothing is mended: limits of
    paragraphs, units, lengths and citations first, then marks in texts and ids that are unknown or cited twice.
    A null text is empty, null citations are none and a null id is unknown, so that each is an error.
    """
    ids = packet.groupBy("draft").agg(F.collect_set("evidence_id").alias("known"))
    none = F.array().cast("array<string>")
    rows = units.withColumns({"text": F.coalesce(js_trim("text"), F.lit("")), "citations": F.coalesce("citations", none)}).join(ids, "draft", "left").withColumn("known", F.coalesce("known", none))
    size, n = F.length("text"), F.size("citations")
    bad_cite = (n > 4) | (n < 1) | (F.size(F.array_distinct("citations")) < n) | (F.size(F.array_except("citations", "known")) > 0)
    bad_text = ~size.between(1, 450) | F.col("text").rlike(_TEXT_CITATION)
    by_number = F.array_sort(F.transform("citations", lambda c: F.struct(F.substring(c, 2, 9).try_cast("int").alias("n"), c.alias("id"))))
    number = F.row_number().over(Window.partitionBy("draft").orderBy("paragraph", "place"))
    told = rows.select("draft", "paragraph", F.concat(F.lit("U"), number.cast("string")).alias("unit_id"), number.alias("number"), F.array_join(F.transform(by_number, lambda x: x["id"]), ",").alias("ids"), bad_cite.alias("bad_cite"), bad_text.alias("bad_text"), size.alias("size"))
    many = told.groupBy("draft", "paragraph").agg(F.count("*").alias("n")).groupBy("draft").agg(((F.count("*") > 4) | (F.max("n") > 3)).alias("shape"))
    whole = told.groupBy("draft").agg(F.bool_or("bad_cite").alias("cite"), F.bool_or("bad_text").alias("text"), F.sum("size").alias("size"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.concat_ws(":", "unit_id", "ids").alias("u")))), lambda x: x["u"]), " ").alias("units"))
    error = F.when(F.col("cite"), "invalid_citation").when(F.col("text") | (F.col("size") > 4000), "invalid_content").when(F.col("shape") | (F.col("n") > 10), "invalid_output")
    return whole.join(many, "draft").select("draft", error.alias("error"), F.when(error.isNull(), F.col("units")).alias("units"))


# --- E19: prompts ----------------------------------------------------------------------------------------------------
def prompt(evidence: DataFrame, nonce: Column, ask: Sequence[str] = ("request",)) -> DataFrame:
    """A request's evidence(request, place, evidence_id, title, pages, content) as one text between delimiters that carry the nonce."""
    lead = F.concat(F.lit("["), F.col("evidence_id"), F.lit("] "), F.concat_ws(" | ", "title", F.concat(F.lit("pages "), F.col("pages"))))
    block = F.concat(lead, F.lit("\n"), F.col("content"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", block.alias("block")))), lambda x: x["block"])
    mark = lambda word: F.concat(F.lit(f"<<<{word} "), nonce, F.lit(">>>"))
    return evidence.groupBy(*ask).agg(lines.alias("lines")).select(*ask, F.concat_ws("\n", mark("EVIDENCE"), F.array_join("lines", "\n\n"), mark("END")).alias("prompt"))
