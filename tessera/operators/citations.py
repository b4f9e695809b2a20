"""Bibliographic metadata, references and citation markers (C1 to C12), and inspection findings (Q1 to Q3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import UNSAFE, WS, collapse, js_trim, nfkc
from ..functions.urls import web_address

# Longest texts of the fields, most authors, and the years that count.
LIMITS = {"title": 500, "container_title": 500, "publisher": 300, "doi": 255, "url": 2048, "volume": 50, "issue": 50, "pages": 100}
MOST_AUTHORS, AUTHOR_CHARS = 50, 200
YEARS = (1000, 3000)
DOI_PREFIX = r"(?i)^(?:doi:\s*|https?://(?:dx\.)?doi\.org/)"
DOI_SHAPE = r"(?i)^10\.[0-9]{4,9}/[A-Z0-9][A-Z0-9._;()/:+-]*$"


def _cleaned(plain: Column, most: int) -> Column:
    """One trimmed line of NFKC text, cut to a length; null if nothing is left."""
    out = js_trim(F.left(collapse(F.regexp_replace(plain, UNSAFE, "")), F.lit(most)))
    return F.when(out != "", out)


def normalize_doi(plain: Column) -> Column:
    """A DOI in lower case without what leads to it; null for other shapes."""
    bare = js_trim(F.regexp_replace(_cleaned(plain, LIMITS["doi"]), DOI_PREFIX, ""))
    return F.when(bare.rlike(DOI_SHAPE), F.lower(bare))


def normalize_url(plain: Column) -> Column:
    """A web address in its standard form, see web_address; null for what is none, and for one that gets too long."""
    out = web_address(_cleaned(plain, LIMITS["url"]))
    return F.when(F.length(out) <= LIMITS["url"], out)


def normalize_metadata(papers: DataFrame) -> DataFrame:
    """papers(paper_id, title, authors, publication_year, container_title, publisher, doi, url, volume, issue, pages) within their limits.

    Texts are NFKC on one line; blank ones are null, but a missing title is empty. At most fifty authors count,
    blank ones among them not; a year outside the range is null.
    """
    names = ["title", *(k for k in LIMITS if k not in ("title", "doi", "url"))]
    # one pass of the NFKC function for each column, over the authors as one text
    told = papers.select("paper_id", F.col("publication_year").alias("year"), *[nfkc(F.col(c).cast("string")).alias(c) for c in [*names, "doi", "url"]], nfkc(F.array_join(F.transform(F.slice("authors", 1, MOST_AUTHORS), lambda a: F.regexp_replace(a, r"\p{Cc}", " ")), "\x1e")).alias("author_text"))
    authors = F.filter(F.transform(F.split("author_text", "\x1e"), lambda a: _cleaned(a, AUTHOR_CHARS)), lambda a: a.isNotNull())
    year = F.when(F.col("year").between(*YEARS), F.col("year"))
    title = F.coalesce(_cleaned(F.col("title"), LIMITS["title"]), F.lit(""))
    rest = [_cleaned(F.col(c), LIMITS[c]).alias(c) for c in names[1:]]
    return told.select("paper_id", title.alias("title"), F.coalesce(authors, F.array().cast("array<string>")).alias("authors"), year.alias("publication_year"), *rest, normalize_doi(F.col("doi")).alias("doi"), normalize_url(F.col("url")).alias("url"))


def missing_fields(title: Column, authors: Column, year: Column) -> Column:
    """C4: the important fields that normalised metadata lack; none says that they are complete enough."""
    said = F.array(F.when(title == "", "title"), F.when(F.size(authors) == 0, "authors"), F.when(year.isNull(), "publicationYear"))
    return F.filter(said, lambda x: x.isNotNull())


def author_list(authors: Column) -> Column:
    """`A`, `A and B`, `A, B, and C`."""
    n = F.size(authors)
    many = F.concat(F.array_join(F.slice(authors, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(", and "), F.element_at(authors, -1))
    return F.when(n == 0, "").when(n <= 2, F.array_join(authors, " and ")).otherwise(many)


def reference(number: Column) -> Column:
    """The numbered reference of normalised metadata, by the columns of normalize_metadata."""
    said = lambda name, lead="": F.when(F.col(name).isNotNull(), F.concat(F.lit(lead), F.col(name).cast("string")))
    trailing = F.filter(F.array(said("container_title"), said("volume", "vol. "), said("issue", "no. "), said("pages", "pp. "), said("publisher"), said("publication_year")), lambda x: x.isNotNull())
    more = F.size(trailing) > 0
    who = author_list(F.col("authors"))
    named = F.when(F.col("title") != "", F.concat(F.when(who != "", F.concat(who, F.lit(", "))).otherwise(""), F.lit("“"), F.col("title"), F.when(more, ",”").otherwise(".”"))).otherwise(who)
    body = F.when(more, F.concat(named, F.when(named != "", " ").otherwise(""), F.array_join(trailing, ", "), F.lit("."))).when((named != "") & ~named.endswith(".”"), F.concat(named, F.lit("."))).otherwise(named)
    link = F.coalesce(F.concat(F.lit("https://doi.org/"), F.col("doi")), F.col("url"))
    return F.concat_ws(" ", F.concat(F.lit("["), number.cast("string"), F.lit("]")), F.when(body != "", body), link)


def markers(numbers: Column) -> Column:
    """`[1] [2]`."""
    return F.array_join(F.transform(numbers, lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), " ")


def reference_list(numbered: DataFrame, metadata: DataFrame) -> DataFrame:
    """Each draft's references in order, a line each; papers without metadata keep their number.

    numbered(draft, paper_id, number), metadata as normalize_metadata gives it.
    """
    rows = numbered.join(metadata, "paper_id", "left").withColumn("title", F.coalesce("title", F.lit(""))).withColumn("authors", F.coalesce("authors", F.array().cast("array<string>")))
    lines = rows.select("draft", "number", reference(F.col("number")).alias("line"))
    sorted_ = F.array_sort(F.collect_list(F.struct("number", "line")))
    return lines.groupBy("draft").agg(F.array_join(F.transform(sorted_, lambda x: x["line"]), "\n").alias("references"))


def attached_references(numbered: DataFrame, metadata: DataFrame, titles: DataFrame) -> DataFrame:
    """Draft, number, paper_id and metadata of each reference; a paper without them has its cited title alone."""
    known = numbered.join(metadata.withColumn("known", F.lit(True)), "paper_id", "left").join(titles.select("paper_id", F.col("title").alias("cited_title")), "paper_id", "left")
    fallback = F.col("known").isNull()
    return known.select("draft", "number", "paper_id", F.when(fallback, F.coalesce("cited_title", F.lit(""))).otherwise(F.col("title")).alias("title"), F.when(fallback, F.array().cast("array<string>")).otherwise(F.col("authors")).alias("authors"), "publication_year", fallback.alias("is_fallback"))


def valid_update(papers: DataFrame) -> DataFrame:
    """What an update of citation metadata lacks: authors named twice in any case, a DOI or address that says something but has no valid form."""
    made = normalize_metadata(papers).select("paper_id", "authors", F.col("doi").alias("good_doi"), F.col("url").alias("good_url"))
    rows = papers.select("paper_id", js_trim("doi").alias("doi"), js_trim("url").alias("url")).join(made, "paper_id")
    lower = F.transform("authors", lambda a: F.lower(a))
    error = F.when(F.size(F.array_distinct(lower)) < F.size(lower), "duplicate_author").when((F.col("doi") != "") & F.col("good_doi").isNull(), "invalid_doi").when((F.col("url") != "") & F.col("good_url").isNull(), "invalid_url")
    return rows.select("paper_id", error.alias("error"))


def unit_citations(cites: DataFrame, numbered: DataFrame) -> DataFrame:
    """C11: cites(draft, unit, ord, evidence_id, paper_id) of a unit by the paper's number, with every evidence id in order."""
    rows = cites.join(numbered, ["draft", "paper_id"]).groupBy("draft", "unit", "number").agg(F.min("ord").alias("first"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"])).alias("evidence_ids"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("draft", "unit").orderBy("first", "number"))).drop("first")


# --- Q1 to Q3: inspection -----------------------------------------------------------------------------
# Order of severities, states of search that call for a finding, and the matrix fields.
SEVERITY = {"significant": 0, "attention": 1, "info": 2}
SEARCH = {"not_indexed": "attention", "index_failed": "attention", "index_stale": "attention", "index_pending": "info", "indexing": "info"}
FIELDS = ["objective", "methodology", "dataset", "findings", "limitations", "future_work", "concepts"]


def ordered_findings(found: DataFrame) -> DataFrame:
    """findings(scope, finding_id, kind, severity, papers, units), one for each id, with their place by severity and id."""
    unique = found.groupBy("scope", "finding_id").agg(F.max(F.struct("severity", "kind", "papers", "units")).alias("f")).select("scope", "finding_id", "f.kind", "f.severity", "f.papers", "f.units")
    rank = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[F.col("severity")]
    return unique.withColumn("place", F.row_number().over(Window.partitionBy("scope").orderBy(rank, "finding_id")))


def usable_field(state: Column, malformed: Column, items: Column) -> Column:
    return (state == "extracted") & ~malformed & F.exists(items, lambda t: js_trim(t) != "")


def inspect_workspace(papers: DataFrame, fields: DataFrame, scope: str = "scope") -> DataFrame:
    """Q1: findings about the papers of each scope.

    papers(scope, paper_id, status, coverage, matrix_status, matrix_stale, missing), where a null matrix_status
    says that there is no extraction and missing lists absent citation fields; fields(paper_id, field_key, state,
    malformed, items). Each rule is a column over a paper, or over a paper and one of the fixed fields.
    """
    finding = lambda cond, suffix, kind, severity: F.when(cond, F.struct(suffix.alias("suffix"), kind.alias("kind"), severity.alias("severity")))
    text = F.lit
    coverage = F.col("coverage")
    matrix = F.col("matrix_status")
    search = F.create_map(*[F.lit(x) for kv in SEARCH.items() for x in kv])
    rules = [
        finding(F.col("status") == "failed", text("processing-failed"), text("processing_failed"), text("significant")),
        finding(F.col("status").isin("uploaded", "processing"), text("processing-incomplete"), text("processing_incomplete"), text("info")),
        finding(coverage.isin(*SEARCH), F.concat(text("search-"), coverage), F.concat(text("search_"), coverage), F.try_element_at(search, coverage)),
        finding((F.col("status") == "ready") & matrix.isNull(), text("matrix-missing"), text("matrix_missing"), text("attention")),
        finding(matrix.isNotNull() & F.col("matrix_stale"), text("matrix-stale"), text("matrix_stale"), text("attention")),
        finding(matrix == "failed", text("matrix-failed"), text("matrix_failed"), text("significant")),
        finding(matrix == "partial", text("matrix-partial"), text("matrix_partial"), text("attention")),
        finding(F.size("missing") > 0, text("citation-metadata-incomplete"), text("citation_metadata_incomplete"), text("info")),
    ]
    told = papers.dropDuplicates(["scope", "paper_id"])
    by_paper = told.select("scope", "paper_id", F.explode(F.filter(F.array(*rules), lambda r: r.isNotNull())).alias("r"))
    asked = told.where("matrix_status is not null").select("scope", "paper_id", F.explode(F.array(*map(F.lit, FIELDS))).alias("field_key"))
    met = asked.join(fields, ["paper_id", "field_key"], "left")
    unusable = F.col("state").isNull() | (F.col("state") == "failed") | F.col("malformed") | ((F.col("state") == "extracted") & ~usable_field(F.col("state"), F.col("malformed"), F.col("items")))
    field_rule = F.coalesce(
        finding(unusable, F.concat(text("matrix-field-"), F.col("field_key"), text("-unusable")), text("matrix_field_unusable"), text("attention")),
        finding(F.col("state") == "not_reported", F.concat(text("matrix-field-"), F.col("field_key"), text("-not-reported")), text("matrix_field_not_reported"), text("info")),
    )
    by_field = met.select("scope", "paper_id", field_rule.alias("r")).where("r is not null")
    each = by_paper.unionByName(by_field).select("scope", F.concat(text("workspace:"), F.col("r.suffix"), text(":"), F.col("paper_id").cast("string")).alias("finding_id"), F.col("r.kind").alias("kind"), F.col("r.severity").alias("severity"), F.array(F.col("paper_id").cast("string")).alias("papers"))
    good = fields.where(usable_field(F.col("state"), F.col("malformed"), F.col("items"))).select("paper_id").distinct().withColumn("good", F.lit(True))
    usable = (F.col("status") == "ready") & ~F.col("matrix_stale") & matrix.isin("complete", "partial") & F.col("good")
    whole = told.join(good, "paper_id", "left").groupBy("scope").agg(F.array_sort(F.collect_list(F.when(F.coalesce(usable, F.lit(False)), F.col("paper_id").cast("string")))).alias("papers"))
    few = whole.where(F.size("papers") < 2).select("scope", text("workspace:limited-matrix-coverage").alias("finding_id"), text("limited_matrix_coverage").alias("kind"), text("info").alias("severity"), "papers")
    return ordered_findings(each.unionByName(few).withColumn("units", F.array().cast("array<string>")))


def inspect_draft(units: DataFrame, cites: DataFrame, references: DataFrame) -> DataFrame:
    """Q2: findings about each draft, in its order.

    units(draft, unit, support), where a null support is unchecked; cites(draft, unit, paper_id), one row a citation;
    references(draft, paper_id, missing).
    """
    text = F.lit
    # Severities of what a check may say.
    weak = F.create_map(*[text(x) for kv in {"unsupported": "significant", "partially_supported": "attention", "insufficient_evidence": "attention"}.items() for x in kv])
    papers = cites.groupBy("draft", "unit").agg(F.array_sort(F.collect_set(F.col("paper_id").cast("string"))).alias("papers"))
    none = F.array().cast("array<string>")
    said = units.where("support is null or support <> 'supported'").join(papers, ["draft", "unit"], "left")
    unit = F.col("unit").cast("string")
    checked = F.col("support").isNotNull()
    by_unit = said.select("draft", F.concat(text("draft:unit-"), unit, text("-"), F.coalesce("support", text("unchecked"))).alias("finding_id"), F.concat(text("claim_"), F.coalesce("support", text("unchecked"))).alias("kind"), F.coalesce(F.try_element_at(weak, F.col("support")), text("info")).alias("severity"), F.when(checked, F.coalesce("papers", none)).otherwise(none).alias("papers"), F.array(unit).alias("units"))
    counts = cites.groupBy("draft", "paper_id").agg(F.count("*").alias("n"))
    total = counts.groupBy("draft").agg(F.sum("n").alias("total"), F.count("*").alias("distinct"), F.max_by(F.col("paper_id").cast("string"), F.col("n")).alias("top"), F.max("n").alias("most"))
    whole = lambda cond, name, severity, papers: total.where(cond).select("draft", text(f"draft:{name}").alias("finding_id"), text(name.replace("-", "_")).alias("kind"), text(severity).alias("severity"), papers.alias("papers"), none.alias("units"))
    single = whole("distinct = 1", "single-cited-paper", "info", F.array_compact(F.array("top")))  # the only one
    dense = whole("distinct >= 2 and total >= 3 and most * 2 > total", "citation-concentration", "info", F.array("top"))
    lacking = references.where(F.size("missing") > 0).select("draft", F.concat(text("draft:reference-"), F.col("paper_id").cast("string"), text("-incomplete")).alias("finding_id"), text("cited_reference_incomplete").alias("kind"), text("attention").alias("severity"), F.array(F.col("paper_id").cast("string")).alias("papers"), none.alias("units"))
    return ordered_findings(by_unit.unionByName(single).unionByName(dense).unionByName(lacking).withColumnRenamed("draft", "scope"))


def assessment_state(results: DataFrame) -> DataFrame:
    """Q3: the latest validated support of each unit, the greatest of several at once; results(draft, unit, seq, status, support) that failed say nothing."""
    return results.where("status = 'validated'").groupBy("draft", "unit").agg(F.max_by("support", F.struct("seq", "support")).alias("support"))
