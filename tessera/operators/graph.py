"""The research map and its gaps: candidate terms, shared terms, findings, relationships and claim signatures.

Everything is rows: claims(paper_id, field_key, item, text) become candidate terms by array expressions, and
the rest is joins and groupings on them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, canonical_text, collapse, normalize_phrase, statement_key
from ..session import held

MOST_WORDS = 4
_PARTS = rf"{TOKEN}|(?:(?!{TOKEN})[\s\S])+"  # tokens and what stands between them
# Words that are never part of a term, that are too vague for its edge, and that are too weak alone.
STOP = """a an the and or but nor of in on at to for from by with without within into onto over under between among through
during before after above below up down out off again further then once here there when where why how all any both each few
more most other some such no not only own same so than too very can will just should now is are was were be been being have has
had having do does did doing this that these those i we you he she it they them their our your its his her my me us who whom
which what whose as if while because until about against also however thus therefore via per et al e g etc may might must shall
would could whether either neither yet still even much many several various one two three first second third""".split()
GENERIC = """paper papers study studies work works result results approach approaches novel new proposed propose proposes present
presents show shows shown demonstrate demonstrates demonstrated improve improves improved improvement introduce introduces
introduced author authors research based use uses used using apply applied applies achieve achieves achieved obtain obtained
different general standard existing recent effective efficient significant significantly better best high higher large larger
small important main key way ways case cases example examples step steps overall various simple""".split()
WEAK = """model models method methods system systems framework frameworks technique techniques task tasks data performance
analysis training evaluation experiment experiments experimental problem problems algorithm algorithms process processes set
sets number type types dataset datasets""".split()
VAGUE = """future further research work opportunity opportunities limitation limitations limited coverage explore exploring
investigate investigating evaluate evaluating extend extending test testing develop developing compare comparing lack lacks
requires required needed potential possible additional broader extensive insufficient restricted unable""".split()
# Fields by kind of term, and edges by kind.
TERM_FIELD = {"concept": "concepts", "methodology": "methodology", "dataset": "dataset"}
EDGE = {"concept": "paper_has_concept", "methodology": "paper_uses_methodology", "dataset": "paper_uses_dataset"}
# Reviewed aliases of actions, targets and contexts.
ACTIONS = {
    "future_work": {"integrate": ["integrate", "integrating", "incorporate", "incorporating"], "evaluate": ["evaluate"], "build": ["build", "building"]},
    "limitations": {"scope_restriction": ["limited", "restricted"], "missing_capability": ["lack", "lacks"], "inability": ["cannot", "unable"], "insufficiency": ["insufficient"]},
}
TARGETS = {"language_model": ["language model", "language models"], "table_content": ["table content", "content recognition", "cell content", "l ocr"], "table_structure": ["table structure", "table structure recognition", "structure recognition", "tsr"]}
GUARDED = {"language_model": ["large model", "large models"]}
CONTEXT = ["table recognition", "table understanding"]


def _tokens(parts: Column) -> Column:
    """Of the tokens and gaps of a text the tokens with what a phrase asks of each: array of struct(text, norm, gap, breaks, stop, generic, weak, number, long, name)."""
    is_token = lambda p: p.rlike(rf"^(?:{TOKEN})$")
    placed = F.transform(parts, lambda p, i: F.struct(p.alias("text"), is_token(p).alias("token"), F.when(i > 0, F.get(parts, i - 1)).otherwise("").alias("gap")))
    found = F.filter(placed, lambda p: p["token"])

    def told(p: Column) -> Column:
        norm = F.lower(p["text"])
        gap = F.when(is_token(p["gap"]), "").otherwise(p["gap"])
        letters = F.regexp_replace(p["text"], r"\P{L}", "")
        upper = letters.rlike(r"\p{Lu}")
        # an acronym, or a capital after the first place
        name = (F.length(letters) >= 2) & upper & (letters.rlike(r"^\p{Lu}+$") | F.substring(p["text"], 2, 10_000).rlike(r"\p{Lu}"))
        symbol = norm.rlike("[+#]")
        return F.struct(
            p["text"].alias("text"), norm.alias("norm"), gap.alias("gap"), gap.rlike(r"[,;:.!?()\[\]{}\"“”‘’…—–]").alias("breaks"), norm.isin(*STOP).alias("stop"), norm.isin(*GENERIC).alias("generic"),
            norm.isin(*WEAK).alias("weak"), norm.rlike(r"^[\p{N}.]+$").alias("number"), ((F.length(norm) >= 2) | symbol).alias("long"), (name | symbol).alias("name"),
        )

    return F.transform(found, told)


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is worked out once however often it stands in use."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _windows(tokens: Column, n: int) -> Column:
    """Runs of n tokens that may be a term, as struct(key, start, words, phrase)."""
    count = F.size(tokens)
    starts = F.when(count >= n, F.sequence(F.lit(1), F.greatest(count - n + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def told(run: Column, i: Column) -> Column:
        first, last = F.get(run, F.lit(0)), F.get(run, F.lit(n - 1))
        edge = ~first["stop"] & ~first["generic"] & ~first["number"] & first["long"] & ~last["stop"] & ~last["generic"] & (last["number"] | last["long"])
        joined = ~F.exists(F.slice(run, 2, n), lambda t: t["breaks"]) if n > 1 else F.lit(True)
        inner = F.forall(F.slice(run, 2, max(n - 2, 0)), lambda t: ~t["stop"] | (t["norm"] == "of"))
        said = F.exists(run, lambda t: ~t["stop"] & ~t["generic"] & ~t["weak"] & ~t["number"] & t["long"])
        alone = first["name"] if n == 1 else F.lit(True)
        phrase = F.concat(first["text"], F.array_join(F.transform(F.slice(run, 2, max(n - 1, 0)), lambda t: F.concat(t["gap"], t["text"])), ""))
        good = edge & joined & inner & said & alone
        term = F.struct(F.array_join(F.transform(run, lambda t: t["norm"]), " ").alias("key"), i.alias("start"), F.lit(n).alias("words"), phrase.alias("phrase"))
        return F.when(good, term)  # nothing is put together for a run that is none

    return F.filter(F.transform(starts, lambda i: _bound(F.slice(tokens, i, n), lambda run: told(run, i))), lambda w: w.isNotNull())


def candidates(claims: DataFrame, text: str = "text") -> DataFrame:
    """Claims with key, phrase and words of each candidate term in text, once a key with its first wording.

    Runs of up to four tokens that no clause mark parts; no function words but an inner "of", no vague words at the edges, a
    meaningful word among them, and a single token only if it looks like a name. A null text has none.
    """
    rows = claims.withColumn("claim_text", canonical_text(F.col(text))).withColumn("claim_parts", F.regexp_extract_all("claim_text", F.lit(_PARTS), F.lit(0)))
    rows = rows.withColumn("claim_tokens", _tokens(F.col("claim_parts")))
    every = F.array_sort(F.concat(*[_windows(F.col("claim_tokens"), n) for n in range(1, MOST_WORDS + 1)]))  # by key, then by place
    first = _bound(every, lambda terms: F.filter(terms, lambda w, i: (i == 0) | (F.get(terms, i - 1)["key"] != w["key"])))
    return rows.select(*claims.columns, F.explode(first).alias("w")).select(*claims.columns, "w.key", "w.phrase", "w.words")


def shared_terms(terms: DataFrame, least: int = 2) -> DataFrame:
    """(kind, key, label, papers, claims, kept) of terms(kind, paper_id, item, key, phrase) in papers enough.

    The label is the commonest wording, the longer, then the lesser of equals. A term is not kept where a longer one
    that contains it has the same claims; only sub-phrases of shared terms are looked up.
    """
    claim = ["paper", "item"]
    each = terms.select("kind", "key", F.col("paper_id").cast("string").alias("paper"), F.col("item").cast("long").alias("item")).distinct()
    # sets of claims are told apart by their size and 128 bits, so that a common term is one short row
    of_paper = each.groupBy("kind", "key", "paper").agg(F.count("*").alias("n"), F.sum(F.xxhash64(*claim).cast("decimal(38,0)")).alias("sum"), F.bit_xor(F.xxhash64(F.lit("claim"), *claim)).alias("xor"))
    same = F.struct(F.sum("n").alias("n"), F.sum("sum").cast("string").alias("sum"), F.bit_xor("xor").alias("xor"))
    papers = of_paper.groupBy("kind", "key").agg(F.count("paper").alias("papers"), same.alias("claim_set")).where(F.col("papers") >= least)
    forms = terms.groupBy("kind", "key", "phrase").agg(F.count("*").alias("n")).groupBy("kind", "key").agg(F.min(F.struct((-F.col("n")).alias("n"), (-F.length("phrase")).alias("l"), "phrase")).alias("best"))
    shared = papers.join(forms, ["kind", "key"]).select("kind", "key", F.col("best.phrase").alias("label"), "papers", F.col("claim_set.n").cast("int").alias("claims"), "claim_set")
    words = F.split("key", " ")
    n = F.size(words)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))))
    longer = shared.where(F.size(words) > 1).select("kind", F.explode(F.array_distinct(parts)).alias("key"), F.col("claim_set").alias("whole"))
    gone = shared.join(longer, ["kind", "key"]).where(F.col("claim_set") == F.col("whole")).select("kind", "key").distinct().withColumn("gone", F.lit(True))
    return shared.join(gone, ["kind", "key"], "left").select("kind", "key", "label", "papers", "claims", F.col("gone").isNull().alias("kept"))


def unshared(terms: DataFrame) -> DataFrame:
    """How many candidate terms of each kind only one paper has."""
    return terms.groupBy("kind", "key").agg(F.countDistinct("paper_id").alias("papers")).groupBy("kind").agg(F.count_if(F.col("papers") < 2).alias("unshared"))


def term_edges(terms: DataFrame, shared: DataFrame) -> DataFrame:
    """An edge from each paper to each kept term with its evidence (item and wording) in order."""
    kept = shared.where("kept").select("kind", "key")
    name = F.create_map(*[F.lit(x) for kv in EDGE.items() for x in kv])
    evidence = F.array_sort(F.collect_set(F.struct("item", "phrase")))
    return terms.join(kept, ["kind", "key"]).groupBy("kind", "key", "paper_id").agg(evidence.alias("evidence")).select(name[F.col("kind")].alias("type"), "kind", "key", "paper_id", "evidence")


def findings(claims: DataFrame) -> DataFrame:
    """A finding node and its edge for each item that says something; never merged across papers."""
    paper, item = F.col("paper_id").cast("string"), F.col("item").cast("string")
    said = claims.where((F.col("field_key") == "findings") & (collapse(F.col("text")) != ""))
    return said.select("paper_id", "item", "text", F.concat_ws(":", F.lit("finding"), paper, item).alias("finding_id"))


def paper_nodes(papers: DataFrame, edges: DataFrame) -> DataFrame:
    """papers(paper_id, status, stale) with whether any edge(paper_id) starts there."""
    return papers.join(edges.select("paper_id").distinct().withColumn("contributes", F.lit(True)), "paper_id", "left").withColumn("contributes", F.coalesce("contributes", F.lit(False)))


def map_summary(nodes: DataFrame, shared: DataFrame, found: DataFrame) -> DataFrame:
    """The counters of a map: papers by state, kept terms by kind, findings. One row, of one-row relations."""
    s = F.col("status")
    p = nodes.agg(F.count("*").alias("total_papers"), F.count_if("contributes").alias("contributing_papers"), F.count_if(s == "extracted").alias("current_papers"), F.count_if(s == "out_of_date").alias("stale_papers"), F.count_if(s.isin("queued", "extracting")).alias("active_papers"), F.count_if(s == "not_extracted").alias("unextracted_papers"), F.count_if(s.isin("partial", "failed")).alias("incomplete_papers"))
    t = shared.where("kept").agg(*[F.count_if(F.col("kind") == k).alias(f"shared_{k}") for k in EDGE])
    return p.crossJoin(t).crossJoin(found.agg(F.count("*").alias("findings")))


def adjacency(edges: DataFrame) -> DataFrame:
    """Each paper's terms by kind, in order."""
    return edges.groupBy("paper_id", "kind").agg(F.array_sort(F.collect_set("key")).alias("terms"))


def term_index(shared: DataFrame, edges: DataFrame, papers: DataFrame, wanted: str = "", kind: str | None = None, hide_stale: bool = False) -> DataFrame:
    """kept terms with their papers(paper_id, title, stale) by title, by kind, by part of their own label or of any paper's title.

    A term is stale as soon as one of its papers is, and hide_stale leaves it out. A paper that is not among
    papers goes by its id and is not stale.
    """
    key = F.col("paper_id").cast("string")
    named = edges.select("kind", "key", "paper_id").distinct().join(papers.select("paper_id", "title", "stale"), "paper_id", "left")
    one = F.struct(F.coalesce("title", key).alias("title"), key.alias("paper_id"), F.coalesce("stale", F.lit(False)).alias("stale"))
    of = named.groupBy("kind", "key").agg(F.array_sort(F.collect_list(one)).alias("of_papers"), F.bool_or(F.coalesce("stale", F.lit(False))).alias("stale"))
    rows = shared.where("kept").join(of, ["kind", "key"])
    rows = rows if kind is None else rows.where(F.col("kind") == kind)
    rows = rows.where(~F.col("stale")) if hide_stale else rows
    said = wanted.strip().lower()
    if said:
        rows = rows.where(F.contains(F.lower("label"), F.lit(said)) | F.exists("of_papers", lambda x: F.contains(F.lower(x["title"]), F.lit(said))))
    return rows.select("kind", "key", "label", "papers", F.transform("of_papers", lambda x: x["paper_id"]).alias("paper_ids"), "stale")


# The rows and steps of the picture, how much of a finding it shows, and what it calls a paper's state.
X_STEP, FINDING_X_STEP = 220.0, 140.0
PAPER_Y, TERM_Y, FINDING_Y = 220.0, 40.0, 420.0
SHOWN_CHARS = 60
STATUS_LABELS = {
    "waiting": "Waiting for processing", "not_extracted": "Not extracted", "queued": "Queued", "extracting": "Extracting…", "extracted": "Extracted", "out_of_date": "Out of date", "partial": "Partial", "failed": "Extraction failed",
}


def graph_view(papers: DataFrame, entries: DataFrame, findings: DataFrame, most: int = 150) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The picture of each scope as (states, nodes, edges): visible papers in a centred row, shared terms above, each paper's findings below it.

    papers(scope, paper_id, title, stale, status, place), those that a filter left; entries(scope, term_id, kind, label, place, paper_id), a
    row a pair; findings(scope, paper_id, finding_id, place, text). Pairs and findings of papers that are not visible are left out, and
    with them terms that keep no paper. A scope of more than so many nodes is too_large, one without papers empty; neither has nodes.
    Places that are null or equal go by id.
    """
    ours = papers.select("scope", "paper_id").distinct()
    pairs = entries.join(ours, ["scope", "paper_id"], "left_semi")
    told = findings.join(ours, ["scope", "paper_id"], "left_semi")
    every = papers.select("scope", F.concat(F.lit("p"), F.col("paper_id").cast("string")).alias("node")).union(pairs.select("scope", F.concat(F.lit("t"), "term_id"))).union(told.select("scope", F.concat(F.lit("f"), "finding_id")))
    sizes = every.groupBy("scope").agg(F.count_distinct("node").alias("node_count"))
    scopes = papers.select("scope").union(entries.select("scope")).union(findings.select("scope")).distinct()
    n = F.coalesce("node_count", F.lit(0))
    states = scopes.join(sizes, "scope", "left").select("scope", n.alias("node_count"), F.when(n == 0, "empty").when(n > most, "too_large").otherwise("graph").alias("state"))
    drawn = states.where("state = 'graph'").select("scope")  # from here on a scope has few rows

    def placed(rows: DataFrame, group: list[str], key: str, step: float) -> DataFrame:
        """rows with x, centred in order of place and key."""
        w = Window.partitionBy(*group)
        return rows.withColumn("x", (F.row_number().over(w.orderBy(F.col("place").asc_nulls_last(), key)) - 1 - (F.count("*").over(w) - 1) / 2) * step)

    row = placed(papers.dropDuplicates(["scope", "paper_id"]).join(drawn, "scope", "left_semi"), ["scope"], "paper_id", X_STEP)
    pid = F.concat(F.lit("graph-paper:"), F.col("paper_id").cast("string"))
    label = F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv]), F.col("status"))
    none = F.lit(None)
    stale = F.coalesce("stale", F.lit(False))
    nodes = row.select("scope", pid.alias("id"), F.lit("paper").alias("kind"), "x", F.lit(PAPER_Y).alias("y"), F.col("title").alias("label"), stale.alias("stale"), label.alias("status_label"), none.cast("long").alias("paper_count"))
    met = pairs.join(drawn, "scope", "left_semi").select("scope", "term_id", "kind", "label", "place", "paper_id").distinct().join(row.select("scope", "paper_id", stale.alias("stale")), ["scope", "paper_id"])
    terms = met.groupBy("scope", "term_id").agg(F.min("kind").alias("kind"), F.min("label").alias("label"), F.min("place").alias("place"), F.bool_or("stale").alias("stale"), F.count_distinct("paper_id").alias("paper_count"))
    terms = placed(terms, ["scope"], "term_id", X_STEP)
    nodes = nodes.unionByName(terms.select("scope", F.col("term_id").alias("id"), "kind", "x", F.lit(TERM_Y).alias("y"), "label", "stale", none.cast("string").alias("status_label"), "paper_count"))
    leaves = placed(told.join(drawn, "scope", "left_semi").select("scope", "paper_id", "finding_id", "place", "text").dropDuplicates(["scope", "finding_id"]), ["scope", "paper_id"], "finding_id", FINDING_X_STEP)
    leaves = leaves.join(row.select("scope", "paper_id", F.col("x").alias("base"), stale.alias("stale")), ["scope", "paper_id"])
    short = F.when(F.length("text") > SHOWN_CHARS, F.concat(F.rtrim(F.left("text", F.lit(SHOWN_CHARS))), F.lit("…"))).otherwise(F.col("text"))
    fid = F.concat(F.lit("graph-"), "finding_id")
    nodes = nodes.unionByName(leaves.select("scope", fid.alias("id"), F.lit("finding").alias("kind"), (F.col("base") + F.col("x")).alias("x"), F.lit(FINDING_Y).alias("y"), short.alias("label"), "stale", none.cast("string").alias("status_label"), none.cast("long").alias("paper_count")))
    edge = lambda rows, kind, a, b: rows.select("scope", F.concat(a, F.lit("->"), b).alias("id"), kind.alias("kind"), a.alias("source"), b.alias("target"))
    links = edge(met, F.col("kind"), F.col("term_id"), pid).unionByName(edge(leaves, F.lit("finding"), pid, fid)).distinct()
    return states, nodes, links


def neighbourhood(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each of nodes(node) the nodes one edge(a, b) away, itself left out."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return both.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").where("a <> b").distinct().select(F.col("a").alias("node"), F.col("b").alias("neighbour"))


# --- G11 to G16: gaps ---------------------------------------------------------------------------------------
def relationships(edges: DataFrame) -> DataFrame:
    """(kind, key, paper_id) of terms that edges of their own type, with evidence, tie to two papers or more."""
    name = F.create_map(*[F.lit(x) for kv in EDGE.items() for x in kv])
    typed = edges.where((F.col("type") == name[F.col("kind")]) & F.exists("evidence", lambda e: e["item"] >= 0)).select("kind", "key", "paper_id").distinct()
    many = typed.groupBy("kind", "key").agg(F.count("*").alias("n")).where("n >= 2").select("kind", "key")
    return typed.join(many, ["kind", "key"], "left_semi")


def gap_statements(fields: DataFrame) -> DataFrame:
    """statements(paper_id, field_key, item, text, statement) of limitations and future work.

    fields(paper_id, field_key, updated_at, state, malformed, items): the newest row counts, unless rows as new say otherwise.
    """
    from .relational import newest_unconflicted

    rows = fields.where(F.col("field_key").isin(*ACTIONS))
    told = newest_unconflicted(rows, ["paper_id", "field_key"], "updated_at", F.to_json(F.struct("state", "malformed", "items")))
    newest = told.select("paper_id", "field_key", F.from_json("content", "struct<state: string, malformed: boolean, items: array<string>>").alias("c")).where("c.state = 'extracted' and not c.malformed")
    items = newest.select("paper_id", "field_key", F.posexplode("c.items").alias("item", "text"))
    return items.withColumn("statement", statement_key(F.col("text"))).where("statement <> ''")


def _has(padded: Column, aliases: list[str]) -> Column:
    return padded.rlike(" (?:" + "|".join(aliases) + ") ") if aliases else F.lit(False)


def signatures(statements: DataFrame) -> DataFrame:
    """Statements with one action family and the target families they name; others, and those that negate, are left out.

    Aliases are whole words of the normalised phrase; an ambiguous one counts only where the context is named too.
    """
    none = ~F.col("statement").rlike(r"(?<![A-Za-z0-9_])(?:no|not|never)(?![A-Za-z0-9_])")

    def told(padded: Column) -> Column:
        acts = F.array(*[F.when((F.col("field_key") == f) & _has(padded, aliases), family) for f, families in ACTIONS.items() for family, aliases in families.items()])
        context = _has(padded, CONTEXT)
        targets = F.filter(F.array(*[F.when(_has(padded, aliases) | (_has(padded, GUARDED.get(family, [])) & context), family) for family, aliases in sorted(TARGETS.items())]), lambda x: x.isNotNull())
        return F.struct(F.filter(acts, lambda x: x.isNotNull()).alias("acts"), targets.alias("targets"), context.alias("in_context"))

    # as the rows of an array, so that a filter on them is not worked out before and for each alias again
    padded = F.when(none, F.concat(F.lit(" "), normalize_phrase(F.col("statement")), F.lit(" ")))
    each = F.filter(F.transform(F.array(padded), told), lambda x: none & (F.size(x["acts"]) == 1))
    once = held(statements.select("field_key", "statement").distinct(), "statements")  # equal statements of a field are read once
    signed = once.select("field_key", "statement", F.explode(each).alias("x")).select("field_key", "statement", F.element_at("x.acts", 1).alias("action"), "x.targets", "x.in_context")
    return statements.join(signed, ["field_key", "statement"]).select(*statements.columns, "action", "targets", "in_context")


def specific(statements: DataFrame, terms: DataFrame) -> DataFrame:
    """(paper_id, field_key, item, kind, key) of statements that name a term(kind, key, paper_id) of their paper and say something more.

    A statement is specific to a term if it has six words or more and another candidate phrase of two words or more, none
    of them of the term or vague.
    """
    phrases = statements.select("statement").distinct().withColumn("phrase_text", normalize_phrase(F.col("statement")))
    named = statements.join(phrases, "statement").join(terms.select("paper_id", "kind", "key"), "paper_id").where(F.concat(F.lit(" "), "phrase_text", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("key"), F.lit(" "))) & (F.size(F.split("phrase_text", " ")) >= 6))
    # phrases are looked for once in each text that names a term, however many statements are equal
    pairs = named.select("statement", "key").distinct()
    said = candidates(pairs.select("statement").distinct(), "statement").where("words >= 2").select("statement", F.split("key", " ").alias("said"))
    plain = said.where(~F.exists("said", lambda w: w.isin(*VAGUE)))
    met = pairs.join(plain, "statement").where(~F.arrays_overlap("said", F.split("key", " "))).select("statement", "key").distinct()
    return named.join(met, ["statement", "key"], "left_semi").select("paper_id", "field_key", "item", "kind", "key").distinct()


def gap_candidates(signed: DataFrame, related: DataFrame, anchors: DataFrame, papers: DataFrame, least: int = 2) -> DataFrame:
    """(gap_id, field_key, action, match, paper_ids, related_terms, evidence, stale) from signatures within direct relationships.

    signed as signatures gives it, related(kind, key, paper_id), anchors as specific gives it, papers(paper_id, stale). A signature counts if it
    names a target or is anchored. A gap is one field, action and target within one term's papers, two of them at least; equal
    statements anchored by one term make a gap only where they name no target. Terms that give the same gap are merged.
    """
    place = ["paper_id", "field_key", "item"]
    within = signed.join(related, "paper_id").select(*place, "kind", "key", "statement", "action", "targets")
    by_target = within.select(*place, "kind", "key", "action", F.explode(F.transform("targets", lambda t: F.concat(F.lit("target:"), t))).alias("match"))
    anchored = within.join(anchors, [*place, "kind", "key"], "left_semi")
    common = ["kind", "key", "field_key", "action", "statement"]
    targeted = anchored.where(F.size("targets") > 0).select(common).distinct()
    by_statement = anchored.where(F.size("targets") == 0).join(targeted, common, "left_anti").select(*place, "kind", "key", "action", F.concat(F.lit("statement:"), F.col("statement")).alias("match"))
    every = by_target.unionByName(by_statement).join(papers.select("paper_id", "stale"), "paper_id")
    paper = F.col("paper_id").cast("string")
    one = ["kind", "key", "field_key", "action", "match"]
    of_paper = every.groupBy(*one, "paper_id").agg(F.count_distinct("item").alias("evidence"), F.bool_or("stale").alias("stale"))
    groups = of_paper.groupBy(*one).agg(F.array_sort(F.collect_set(paper)).alias("paper_ids"), F.sum("evidence").alias("evidence"), F.bool_or("stale").alias("stale")).where(F.size("paper_ids") >= least)
    gap = groups.withColumn("gap_id", F.to_json(F.struct("field_key", "action", "match", "paper_ids")))
    return gap.groupBy("gap_id", "field_key", "action", "match", "paper_ids").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.lit("term"), "kind", "key"))).alias("related_terms"), F.max("evidence").alias("evidence"), F.bool_or("stale").alias("stale"))


# What gaps, their types, actions and targets are called.
GAP_TYPES = {"limitations": "recurring_limitation", "future_work": "future_research_opportunity"}
GAP_TYPE_LABELS = {"recurring_limitation": "Recurring limitation", "future_research_opportunity": "Future research opportunity"}
GAP_TITLES = {"limitations": "Potential recurring limitation in this corpus", "future_work": "Potential future research opportunity in this corpus"}
GAP_DIRECTIONS = {"limitations": "limitation", "future_work": "future-work direction"}
ACTION_NAMES = {"integrate": "integration", "evaluate": "evaluation", "build": "build", "scope_restriction": "scope restriction", "missing_capability": "missing capability", "inability": "inability", "insufficiency": "insufficiency"}
TARGET_HEADINGS = {"language_model": "Language-model", "table_structure": "Table-structure", "table_content": "Table-content"}
TARGET_NAMES = {"language_model": "language models", "table_structure": "table structure", "table_content": "table content"}
NO_CLAIM = "Extracted claim unavailable."


def _called(names: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key)


def gap_view(gaps: DataFrame, terms: DataFrame) -> DataFrame:
    """Gaps as gap_candidates gives them, with type, heading and explanations, by terms(term_id, label).

    A gap of one target is headed by target and action, one of equal statements by its field. What it rests on comes first, then
    its terms in order; a term without a label is called `Related corpus term`.
    """
    by_target = F.startswith("match", F.lit("target:"))
    target = F.substring_index("match", ":", -1)
    field, action = F.col("field_key"), _called(ACTION_NAMES, F.col("action"))
    lead = F.concat(F.lit("These directly related papers "), F.when(by_target, F.concat(F.lit("describe a matching "), _called(GAP_DIRECTIONS, field), F.lit(" involving "), action, F.lit(" and "), _called(TARGET_NAMES, target), F.lit("."))).otherwise(F.concat(F.lit("contain the same explicit "), _called(GAP_DIRECTIONS, field), F.lit(" statement."))))
    heading = F.when(by_target, F.concat_ws(" ", _called(TARGET_HEADINGS, target), action)).otherwise(_called(GAP_TITLES, field))
    named = gaps.select("gap_id", F.posexplode("related_terms").alias("n", "term_id")).join(terms.select("term_id", "label"), "term_id", "left")
    label = F.coalesce(F.nullif("label", F.lit("")), F.lit("Related corpus term"))
    labels = named.groupBy("gap_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", label.alias("label")))), lambda x: x["label"]).alias("related_labels"))
    rows = gaps.join(labels, "gap_id", "left").withColumn("related_labels", F.coalesce("related_labels", F.array().cast("array<string>")))
    why = F.concat(F.array(lead), F.transform("related_labels", lambda x: F.concat(F.lit("Research Map relationship: "), x)))
    kind = _called(GAP_TYPES, field)
    order = Window.partitionBy("field_key").orderBy("stale", F.size("paper_ids").desc(), "gap_id")
    return rows.select("gap_id", "field_key", kind.alias("type"), _called(GAP_TYPE_LABELS, kind).alias("type_label"), heading.alias("heading"), why.alias("explanations"), "related_labels", "paper_ids", F.size("paper_ids").alias("papers"), "evidence", "stale", F.row_number().over(order).alias("place"))


def gap_filter(views: DataFrame, kind: str = "all", status: str = "all") -> DataFrame:
    """views(type, stale) of one type, or all, that are current, stale or either."""
    if status not in ("all", "current", "stale"):
        raise ValueError(f"status is all, current or stale, not {status}")
    rows = views if kind == "all" else views.where(F.col("type") == kind)
    return rows if status == "all" else rows.where(F.col("stale") == (status == "stale"))


def gap_types(views: DataFrame, *by: str) -> DataFrame:
    """The types that there are, in order."""
    return views.groupBy(*by).agg(F.array_sort(F.collect_set("type")).alias("types"))
