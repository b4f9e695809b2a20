"""Uploads and reads: file checks, names, scans and snapshots (SRC2 to SRC14, F1 to F3, F11, F17)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS, js_trim, nfkd
from ..session import held

MOST_BYTES = 50 << 20
# What a reader's error name stands for.
PDF_ERRORS = {"PasswordException": "encrypted_pdf", "InvalidPDFException": "invalid_pdf", "MissingPDFException": "invalid_pdf", "FormatError": "invalid_pdf"}


def files(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder in any store that Spark reads, as (path, size, content)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), "content")


def pdf_error(name: Column) -> Column:
    """SRC2."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PDF_ERRORS.items() for x in kv]), name), F.lit("extraction_failed"))


def has_header(content: Column, within: int = 1024) -> Column:
    """SRC4: whether the mark of a PDF starts within so many bytes."""
    return F.instr(F.decode(F.substring(content, 1, within + 5), "ISO-8859-1"), "%PDF-").between(1, within)


def upload_error(name: Column, mime: Column, content: Column) -> Column:
    """SRC5: why a file is refused, null if it is not: its name or type, no bytes, too many, another kind of content."""
    size = F.octet_length(content)
    named = F.lower(name).endswith(".pdf") & (F.coalesce(mime, F.lit("")).isin("", "application/pdf"))
    return F.when(~F.coalesce(named, F.lit(False)), "not_pdf").when(F.coalesce(size, F.lit(0)) == 0, "empty").when(size > MOST_BYTES, "too_large").when(F.hex(F.substring(content, 1, 5)) != "255044462D", "bad_header")


def safe_filename(name: Column) -> Column:
    """SRC7: ASCII letters, digits, dot, dash and underscore, the last 120 of them, ending in .pdf."""
    clean = F.right(F.regexp_replace(F.regexp_replace(nfkd(name), r"[^A-Za-z0-9_.-]+", "_"), r"^[._]+", ""), F.lit(120))
    return F.when(F.lower(clean).endswith(".pdf"), clean).otherwise(F.concat(clean, F.lit(".pdf")))


def title_of(name: Column) -> Column:
    """SRC8: a file name as a title of up to 200 characters."""
    title = F.left(js_trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), "_+", " "), f"{WS}+", " ")), F.lit(200))
    return F.when(title != "", title).otherwise("Untitled paper")


def scan(rows: DataFrame, columns: Sequence[str], allowed: Sequence[str] | None = None) -> DataFrame:
    """SRC9, F1, F2: the wanted columns, of those that may be seen; (old, new) pairs rename."""
    wanted = [(c, c) if isinstance(c, str) else tuple(c) for c in columns]
    hidden = [c for c, _ in wanted if allowed is not None and c not in allowed]
    if hidden:
        raise ValueError(f"columns not granted: {hidden}")
    return rows.select([F.col(c).alias(n) for c, n in wanted])


def lookup(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """SRC10, SRC11: a row for each of ids(key), null where there is none; a join takes any number of them, so no lists are cut in requests."""
    return ids.select(key).distinct().join(rows, key, "left")


def page(rows: DataFrame, order: Sequence[str], after: Sequence[object] | None = None, size: int = 500) -> DataFrame:
    """SRC12: the next rows in a stable order after a key; a bound on the key instead of an offset, so that no page reads what came before."""
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*[F.lit(x).cast(rows.schema[c].dataType) for c, x in zip(order, after, strict=True)]))
    return rows.orderBy(*order).limit(size)


def consistent_read(before: DataFrame, after: DataFrame, key: str, generation: str) -> DataFrame:
    """SRC13: keys whose generation is the same in two reads."""
    later = after.select(key, F.col(generation).alias("generation_after"))
    return before.join(later, key).where(F.col(generation).eqNullSafe(F.col("generation_after"))).drop("generation_after")


def settled_read(take: Callable[[], DataFrame], children: Callable[[DataFrame], DataFrame], key: str, generation: str, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """SRC13: children's rows with the generation that their key had before and after they were read, and the keys that never held still.

    take() reads key and generation afresh each time it is called, children(keys) the rows of some keys.
    A try keeps the keys whose generation is the same (null too) on both sides and reads the others
    again; a key that is gone in the meantime is left out. Every read is written, so that it happens once.
    """
    asked, rows = None, None
    for _ in range(tries):
        now = take().select(key, generation).distinct()
        before = held(now if asked is None else now.join(asked.select(key), key, "left_semi"), "generations")
        found = held(children(before.select(key)), "children")
        same = held(consistent_read(before, held(take().select(key, generation).distinct(), "generations"), key, generation), "settled")
        kept = found.join(same, key)
        rows = kept if rows is None else rows.unionByName(kept)
        asked = before.join(same, key, "left_anti")
        if not asked.head(1):
            break
    return rows, asked


def rows_of_json(rows: DataFrame, column: str, kind: str) -> DataFrame:
    """SRC14: the records of a JSON array column as rows; what is no array gives none, a missing field is null."""
    return rows.select(*[c for c in rows.columns if c != column], F.inline(F.from_json(column, f"array<{kind}>")))


def valid_rows(rows: DataFrame, required: Sequence[str], one_of: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """rows whose required texts say something and whose fixed-choice columns hold a known value; others are left out."""
    for c in required:
        rows = rows.where(js_trim(F.col(c).cast("string")) != "")
    for c, known in (one_of or {}).items():
        rows = rows.where(F.col(c).isin(*known))
    return rows


def verbatim(excerpt: Column, text: Column) -> Column:
    """whether an excerpt stands in a text as it is."""
    return (excerpt != "") & (F.instr(text, excerpt) > 0)
