"""Checks of JSON against declared shapes: what is wrong, and where, as column expressions over variants (E4, N21, N22, VC7).

A shape is data; `issues` turns it into one expression that walks a variant and gives an array of (path,
code), in the order of the shape: a value's own fields and items first, then its size, unknown keys and
last its rule, which is asked only where nothing else is wrong. Nothing of the values is in the result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import js_trim, query_line
from ..session import held
from .evidence import FIELDS, validate_extraction

_ISSUE = "array<struct<path: array<string>, code: string>>"
KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "BIGINT": "number", "DECIMAL": "number", "DOUBLE": "number", "FLOAT": "number"}

_KIND_MAP = "map(" + ", ".join(f"'{name}', '{kind}'" for name, kind in KINDS.items()) + ")"


def kind_of(v: Column) -> Column:
    """Object, array, string, number, boolean, null, or undefined for what is not there."""
    # the schema of an object or array is that of all it holds, so it is asked of plain values only
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    holds = lambda kind: F.try_variant_get(v, "$", kind).isNotNull()
    return F.when(v.isNull(), "undefined").when(holds("map<string, variant>"), "object").when(holds("array<variant>"), "array").otherwise(F.coalesce(F.try_element_at(F.expr(_KIND_MAP), name), F.lit("undefined")))


def _bound(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is worked out once however often it stands in use."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _none() -> Column:
    return F.expr(f"cast(array() as {_ISSUE})")


def _one(path: Column, code: str, wrong: Column) -> Column:
    return F.when(wrong, F.array(F.struct(path.alias("path"), F.lit(code).alias("code")))).otherwise(_none())


@dataclass(frozen=True)
class Shape:
    """A value of any kind."""

    kind: str = ""

    def issues(self, v: Column, path: Column) -> Column:
        return F.when(kind_of(v) != self.kind, _one(path, "invalid_type", F.lit(True))).otherwise(self.inner(v, path))

    def inner(self, v: Column, path: Column) -> Column:
        return _none()


@dataclass(frozen=True)
class Flag(Shape):
    kind: str = "boolean"


@dataclass(frozen=True)
class Text(Shape):
    """A text with so many characters that matches a pattern, once it is trimmed or otherwise made plain; or one of some options."""

    kind: str = "string"
    least: int = 0
    most: int | None = None
    pattern: str | None = None
    plain: Callable[[Column], Column] | None = None
    options: tuple[str, ...] | None = None

    def issues(self, v: Column, path: Column) -> Column:
        if self.options is not None:
            return _one(path, "invalid_value", (kind_of(v) != "string") | ~F.coalesce(F.try_variant_get(v, "$", "string").isin(*self.options), F.lit(False)))
        return Shape.issues(self, v, path)

    def inner(self, v: Column, path: Column) -> Column:
        text = F.try_variant_get(v, "$", "string")
        return _bound(self.plain(text) if self.plain else text, lambda t: self.sized(t, path))

    def sized(self, text: Column, path: Column) -> Column:
        out = [_one(path, "too_small", F.length(text) < self.least)]
        if self.most is not None:
            out.append(_one(path, "too_big", F.length(text) > self.most))
        if self.pattern is not None:
            out.append(_one(path, "invalid_format", ~text.rlike(self.pattern)))
        return F.concat(*out)


@dataclass(frozen=True)
class Number(Shape):
    kind: str = "number"
    low: float | None = None
    high: float | None = None
    whole: bool = False

    def inner(self, v: Column, path: Column) -> Column:
        x = F.try_variant_get(v, "$", "double")
        sized = [_one(path, "too_small", x < self.low) if self.low is not None else _none(), _one(path, "too_big", x > self.high) if self.high is not None else _none()]
        if not self.whole:
            return F.concat(*sized)
        return F.when(x != F.floor(x), _one(path, "invalid_type", F.lit(True))).otherwise(F.concat(*sized))


@dataclass(frozen=True)
class Items(Shape):
    kind: str = "array"
    of: Shape = field(default_factory=Shape)
    least: int = 0
    most: int | None = None

    def inner(self, v: Column, path: Column) -> Column:
        xs = F.try_variant_get(v, "$", "array<variant>")
        each = F.flatten(F.transform(xs, lambda x, i: self.of.issues(x, F.concat(path, F.array(i.cast("string"))))))
        out = [each, _one(path, "too_small", F.size(xs) < self.least)]
        if self.most is not None:
            out.append(_one(path, "too_big", F.size(xs) > self.most))
        return F.concat(*out)


@dataclass(frozen=True)
class Record(Shape):
    """An object with these fields, of which those in optional may be missing and those in nullish null too; a strict one has no others. rule is asked of its variant."""

    kind: str = "object"
    fields: Mapping[str, Shape] = field(default_factory=dict)
    optional: frozenset[str] = frozenset()
    nullish: frozenset[str] = frozenset()
    strict: bool = True
    rule: Callable[[Column], Column] | None = None

    def _field(self, name: str, shape: Shape, path: Column) -> Callable[[Column], Column]:
        left_out = ["undefined"] * (name in self.optional | self.nullish) + ["null"] * (name in self.nullish)

        def told(x: Column) -> Column:
            found = shape.issues(x, F.concat(path, F.array(F.lit(name))))
            return F.when(kind_of(x).isin(*left_out), _none()).otherwise(found) if left_out else found

        return told

    def inner(self, v: Column, path: Column) -> Column:
        out = []
        for name, shape in self.fields.items():
            out.append(_bound(F.try_variant_get(v, f"$.{name}", "variant"), self._field(name, shape, path)))
        if self.strict:
            keys = F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))
            out.append(_one(path, "unrecognized_keys", F.size(F.array_except(keys, F.array(*map(F.lit, self.fields)))) > 0))
        told = F.concat(*out) if out else _none()
        if self.rule is None:
            return told
        return _bound(told, lambda t: F.when(F.size(t) > 0, t).otherwise(_one(path, "custom", ~F.coalesce(self.rule(v), F.lit(False)))))


def issues(text: Column, shape: Shape) -> Column:
    """What is wrong with a JSON text: array of (path, code); a text that is null or no JSON has one issue, invalid_json, at the root."""
    root = F.array().cast("array<string>")
    return _bound(F.try_parse_json(text), lambda v: F.when(v.isNull(), _one(root, "invalid_json", F.lit(True))).otherwise(shape.issues(v, root)))


# --- N21, N22: content-free diagnostics --------------------------------------------------------------------------------
def _token(c: Column) -> Column:
    return F.left(F.regexp_replace(c, "[^A-Za-z0-9_]", "?"), F.lit(40))


def shown_issues(found: Column, most: int = 5) -> Column:
    """The first issues as `path code, ...` and how many more there are; null for none."""
    one = lambda x: F.concat_ws(" ", F.when(F.size(x["path"]) > 0, F.array_join(F.transform(x["path"], _token), ".")).otherwise("(root)"), _token(x["code"]))
    more = F.size(found) - most
    shown = F.concat(F.array_join(F.transform(F.slice(found, 1, most), one), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(" more)"))).otherwise(""))
    return F.when(F.size(found) > 0, shown)


def safe_diagnostic(category: Column, found: Column | None = None, detail: Column | None = None, model: Column | None = None, finish: Column | None = None, counts: Mapping[str, Column] | None = None, most: int = 300) -> Column:
    """Category, issues and detail, then `; name=value` of a provider's identifiers and counts, cut at so many characters.

    Identifiers keep 100 characters of their alphabet; a count that is null, negative or beyond 2^53 is left out, and so is what is null or empty.
    """
    identifier = lambda c: F.left(F.regexp_replace(F.nullif(c, F.lit("")), "[^A-Za-z0-9_.:/@-]", "?"), F.lit(100))
    lead = F.concat_ws(" ", category, *([shown_issues(found)] if found is not None else []), *([F.nullif(detail, F.lit(""))] if detail is not None else []))
    meta = [F.concat(F.lit(f"{name}="), identifier(c)) for name, c in (("model", model), ("finish_reason", finish)) if c is not None]
    meta += [F.when((n >= 0) & (n <= (1 << 53) - 1), F.concat(F.lit(f"{name}="), n.cast("long").cast("string"))) for name, n in (counts or {}).items()]
    return F.left(F.concat_ws("; ", lead, *meta), F.lit(most))


# --- E4: a model's extraction ----------------------------------------------------------------------------------------------
# How many items a field has, how long they are and how many ids they cite.
MOST_ITEMS, ITEM_CHARS, MOST_IDS = 3, 500, 5
_ITEM = Record(fields={"text": Text(least=1, most=ITEM_CHARS, plain=js_trim), "evidence_ids": Items(of=Text(pattern="^E[0-9]{1,3}$"), least=1, most=MOST_IDS)})


def _as_stated(v: Column) -> Column:
    n = F.size(F.try_variant_get(v, "$.items", "array<variant>"))
    return F.when(F.try_variant_get(v, "$.state", "string") == "extracted", n >= 1).otherwise(n == 0)


_FIELD = Record(fields={"state": Text(options=("extracted", "not_reported")), "items": Items(of=_ITEM, most=MOST_ITEMS)}, rule=_as_stated)
EXTRACTION = Record(fields={"fields": Record(fields={f: _FIELD for f in FIELDS})})
_PARSED = "struct<fields: map<string, struct<state: string, items: array<struct<text: string, evidence_ids: array<string>>>>>>"


def checked_extractions(outputs: DataFrame, packet: DataFrame) -> DataFrame:
    """outputs(paper_id, output) with error and diagnostic, null where all holds.

    An output that has not the shape of an extraction is an invalid_output, with its issues. One that has it is an invalid_citation if
    it cites an id that packet(paper_id, evidence_id, fields) lacks, or not for that field, or twice in an item; the first says why.
    Nothing is mended, and one fault refuses the whole.
    """
    told = outputs.select("paper_id", "output", issues(F.col("output"), EXTRACTION).alias("found"))
    # an output is looked at once: from here on its issues stand for it, or the ids that it cites
    ids = F.transform(F.map_entries(F.from_json("output", _PARSED)["fields"]), lambda f: F.struct(f["key"].alias("field"), F.transform(f["value"]["items"], lambda x: x["evidence_ids"]).alias("items")))
    told = held(told.select("paper_id", "found", F.when(F.size("found") == 0, ids).alias("cited")), "checked")
    parsed = told.where(F.size("found") == 0).select("paper_id", F.explode("cited").alias("f"))
    items = parsed.select("paper_id", "f.field", F.posexplode("f.items").alias("item", "x")).select("paper_id", "field", "item", F.posexplode("x").alias("ord", "evidence_id"))
    cited = validate_extraction(items, packet).where("error is not null").select("paper_id", F.col("error").alias("detail"))
    rows = told.join(cited, "paper_id", "left")
    bad = F.size("found") > 0
    error = F.when(bad, "invalid_output").when(F.col("detail").isNotNull(), "invalid_citation")
    said = F.when(bad, safe_diagnostic(F.lit("schema_validation"), F.col("found"))).when(F.col("detail").isNotNull(), safe_diagnostic(F.lit("citation"), detail=F.col("detail")))
    return rows.select("paper_id", error.alias("error"), said.alias("diagnostic"))


# --- VC7: a search request ---------------------------------------------------------------------------------------------------
_UUID = "^(?i)(?:[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}|00000000-0000-0000-0000-000000000000|ffffffff-ffff-ffff-ffff-ffffffffffff)$"


@dataclass(frozen=True)
class _Scope(Shape):
    """A library, a project by id, or one to fifty papers by id."""

    kind: str = "object"

    def inner(self, v: Column, path: Column) -> Column:
        said = F.try_variant_get(v, "$.type", "string")
        of = lambda fields: Record(fields=fields, strict=False).inner(v, path)
        unknown = _one(F.concat(path, F.array(F.lit("type"))), "invalid_union", F.lit(True))
        return F.when(said == "library", _none()).when(said == "project", of({"projectId": Text(pattern=_UUID)})).when(said == "papers", of({"paperIds": Items(of=Text(pattern=_UUID), least=1, most=50)})).otherwise(unknown)


SEARCH = Record(
    fields={"query": Text(most=20_000), "scope": _Scope(), "limit": Number(low=1, high=50, whole=True), "minSimilarity": Number(low=-1, high=1), "includeReferences": Flag()},
    optional=frozenset({"limit", "includeReferences"}), nullish=frozenset({"minSimilarity"}), strict=False,
)


def search_issues(body: Column) -> Column:
    """VC7: what is wrong with a search request: its shape, and a question that has 2 to 1,000 characters with a letter or digit once it is made plain."""
    said = F.try_variant_get(F.try_parse_json(body), "$.query", "variant")
    raw = F.try_variant_get(said, "$", "string")
    of_query = Text(least=2, most=1000, pattern=r"[\p{L}\p{N}]").sized(query_line(raw), F.array(F.lit("query")))
    checked = (kind_of(said) == "string") & (F.length(raw) <= 20_000)
    return F.concat(F.when(F.coalesce(checked, F.lit(False)), of_query).otherwise(_none()), issues(body, SEARCH))
