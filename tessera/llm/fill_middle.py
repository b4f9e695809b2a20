"""Fill-in-middle transformation by one counted-quantifier match a text.

A text is cut into units: white space and the word after it, or white space at the end. regexp_count
says how many units there are; the row's own pattern `(unit{a}+)(unit{b-a}+)(rest)` then captures
prefix, middle and suffix in one match, and its replacement puts them in the order of the form. Both
counts are possessive, so that the matcher loops over the units of a text of any length without a
stack and never goes back. Every step is a column expression of one row: no shuffle, nothing gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The classes of a unit, and the marks.
UNIT = r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _words_of_hash(doc_id: Column, seed: int, n: int = 4) -> list[Column]:
    """The first n groups of 8 hex digits of sha256 of `seed:doc_id`, as integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(n)]


def fill_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """docs(doc_id, text) as doc_id, n, form, output: rate of 100 texts are rearranged, spm of 100 of these suffix first.

    A null text is empty; an empty text, and one that holds a mark, stay plain. A null doc_id hashes as
    no digits. Repeated rows give equal results; no other column is read, so names cannot clash.
    """
    text, unit = F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(UNIT)
    rows = docs.select("doc_id", text.alias("text"), *[h.alias(f"h{k + 1}") for k, h in enumerate(_words_of_hash(F.col("doc_id"), seed))])
    marked = F.contains(F.col("text"), F.lit(PREFIX)) | F.contains(F.col("text"), F.lit(SUFFIX)) | F.contains(F.col("text"), F.lit(MIDDLE))
    form = F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= rate), "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "h1", "h2", form.alias("form"), F.regexp_count("text", unit).cast("long").alias("n"))
    x, y = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    a, b = F.least(x, y).cast("string"), F.abs(x - y).cast("string")
    pattern = F.concat(F.lit("(?s)\\A("), unit, F.lit("{"), a, F.lit("}+)("), unit, F.lit("{"), b, F.lit("}+)(.*)\\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return rows.select("doc_id", "n", "form", output.alias("output"))


def restored(formed: DataFrame) -> DataFrame:
    """formed(form, output) with prefix, middle, suffix (null if plain) and text, rebuilt from output and form.

    A rearranged text holds no mark of its own, so that its output splits at exactly three.
    """
    parts = F.when(F.col("form") != "plain", F.split("output", "<[PSM]>", -1))
    rows = formed.withColumn("parts", parts)
    one, two, three = (F.col("parts")[k] for k in (1, 2, 3))
    spm = F.col("form") == "spm"
    rows = rows.withColumns({"prefix": F.when(spm, two).otherwise(one), "middle": three, "suffix": F.when(spm, one).otherwise(two)}).drop("parts")
    return rows.withColumn("text", F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("prefix", "middle", "suffix")))


def digests(formed: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of fill_middle's rows."""
    return restored(formed).select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("text", 256).alias("restored_sha256"),
    )
