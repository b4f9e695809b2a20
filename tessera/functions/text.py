"""Text normalisation and sanitising as column expressions.

Lengths and offsets count code points. White space is what ECMAScript's \\s holds, and word characters
and boundaries are ASCII, so that results do not hang on the JVM's idea of either.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of ECMAScript.
_SPACES = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
BEFORE, AFTER = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
UNSAFE = r"[\p{Cc}\p{Cf}&&[^\t\n]]"


def _normal(form: str):
    @F.arrow_udf(StringType())
    def normalised(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):  # all of these are ASCII
            return texts
        return pa.array([t if t is None else unicodedata.normalize(form, t) for t in texts.to_pylist()], pa.string())

    def apply(c: Column | str) -> Column:
        """Only texts with more than ASCII are sent to Python; what is ASCII is normal as it is."""
        c = F.col(c) if isinstance(c, str) else c
        odd = c.rlike(r"[^\x00-\x7F]")
        return F.when(odd, normalised(F.when(odd, c))).otherwise(c)

    return apply


nfc, nfkc, nfkd = _normal("NFC"), _normal("NFKC"), _normal("NFKD")


def _without_controls(normal, c: Column) -> Column:
    """Normal text without what UNSAFE names; plain ASCII is told by one quick look."""
    return F.when(c.rlike(r"[^\x20-\x7E\t\n]"), F.regexp_replace(normal(c), UNSAFE, "")).otherwise(c)


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is worked out once however often it stands in use."""
    return F.element_at(F.transform(F.array(c), use), 1)


def _where(c: Column, hint: str, change: Callable[[Column], Column]) -> Column:
    """change(c) for texts that hold a character of hint, without which a change finds nothing; one quick look tells."""
    return once(c, lambda x: F.when(x.rlike(f"[{hint}]"), change(x)).otherwise(x))


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def normalize_text(c: Column) -> Column:
    """Line ends, ligatures, controls, spaces and blank lines of extracted page text."""
    raw, c = c, F.regexp_replace(c, "\r\n?", "\n")
    # The five Latin ligatures.
    for ligature, plain in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl")):
        c = F.replace(c, F.lit(ligature), F.lit(plain))
    c = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    c = F.regexp_replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    c = F.regexp_replace(F.regexp_replace(c, " *\n *", "\n"), "\n{3,}", "\n\n")
    # most pages need none of it, as one pattern tells
    return js_trim(F.when(raw.rlike("[\\x00-\\x09\\x0B-\\x1F\\x7F\\u00A0\\uFB00-\\uFB04]|  | \n|\n |\n\n\n"), c).otherwise(raw))


def query_line(c: Column) -> Column:
    """A search text in NFC on one line."""
    return collapse(F.regexp_replace(nfc(c), r"\p{Cc}", " "))


def normalize_query(c: Column) -> Column:
    """A search text as query_line has it; null unless 2 to 1000 long with a letter or digit."""
    out = query_line(c)
    return F.when(F.length(out).between(2, 1000) & out.rlike(r"[\p{L}\p{N}]"), out)


def canonical_text(c: Column) -> Column:
    """NFKC without possessives and apostrophes within words."""
    c = F.regexp_replace(nfkc(c), f"['’]s{AFTER}", "")
    return F.regexp_replace(c, r"(?<=\p{L})['’](?=\p{L})", "")


TOKEN = r"\p{N}+(?:\.\p{N}+)+|[\p{L}\p{N}\p{M}]+(?:[+#]+)?"


def tokens(c: Column) -> Column:
    """Decimals and runs of letters and digits, lower case."""
    return F.regexp_extract_all(F.lower(canonical_text(c)), F.lit(TOKEN), F.lit(0))


def normalize_phrase(c: Column) -> Column:
    """Tokens one space apart without leading articles; empty if only an article is left."""
    joined = F.array_join(tokens(c), " ")
    return F.regexp_replace(joined, r"^(?:(?:a|an|the)(?: |$))+", "")


def statement_key(c: Column) -> Column:
    """A whole statement in canonical lower case without one final full stop."""
    return F.regexp_replace(collapse(F.lower(canonical_text(c))), r"\.$", "")


def normalize_title(c: Column) -> Column:
    """A heading without numbering and punctuation."""
    c = F.regexp_replace(F.lower(nfkc(c)), rf"^{WS}*(?:(?:[0-9]+|[ivxlc]+|[a-z])(?:\.[0-9]+)*[.):]?{WS}+)+", "")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def sanitize_evidence(c: Column) -> Column:
    """No controls, no text in the shape of a citation marker."""
    return F.regexp_replace(_without_controls(nfc, c), rf"(?i)\[{WS}*S{WS}*[0-9]+(?:{WS}*[,;]{WS}*S?{WS}*[0-9]+)*{WS}*\]", "[citation removed]")


def paper_text(c: Column) -> Column:
    """Paper text that can forge neither ids nor delimiters nor permissions."""
    c = F.regexp_replace(sanitize_evidence(c), rf"(?i)\[{WS}*E{WS}*[0-9]+(?:{WS}*[,;]{WS}*E?{WS}*[0-9]+)*{WS}*\]", "[citation removed]")
    c = F.regexp_replace(F.regexp_replace(c, "<<<|>>>", ""), rf"(?i)eligible_for{WS}*:|CITE ONLY|NO ELIGIBLE EVIDENCE", "[removed]")
    return F.regexp_replace(c, rf"(?im)^([ \t]*)FIELD{AFTER}", "$1[field]")


def sanitize_writer(c: Column) -> Column:
    """NFKC, no controls, writer ids or delimiters."""
    c = _where(_without_controls(nfkc, c), "Ww", lambda x: F.regexp_replace(x, rf"(?i){BEFORE}W{WS}*[0-9]{{1,6}}{AFTER}", "[writer citation removed]"))
    return _where(c, "<>`", lambda x: F.regexp_replace(x, "<{3,}|>{3,}|`{3,}", "[delimiter removed]"))


def sanitize_writer_line(c: Column, most: int) -> Column:
    return F.left(collapse(sanitize_writer(c)), F.lit(most))


def bounded(clean: Column, most: int) -> Column:
    """N12 on sanitised text: cut at the last space of the second half, else hard, with an ellipsis."""

    def told(clean: Column) -> Column:
        head = F.left(clean, F.lit(most))
        at = F.length(head) - F.instr(F.reverse(head), " ")  # code points before the last space
        end = F.when((F.instr(head, " ") > 0) & (at >= most // 2), at).otherwise(most - 1)
        return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.regexp_replace(F.left(clean, end), f"{WS}+$", ""), F.lit("…")))

    return once(js_trim(clean), told)


def bounded_writer_text(c: Column, most: int) -> Column:
    return bounded(sanitize_writer(c), most)


def sanitize_claim(c: Column) -> Column:
    """Writer text that can forge no claim-check id or delimiter."""
    c = _where(sanitize_writer(c), "Cc", lambda x: F.regexp_replace(x, rf"(?i){BEFORE}C{WS}*[0-9]{{1,3}}{AFTER}", "[claim check evidence removed]"))
    return _where(c, "Nn", lambda x: F.regexp_replace(x, rf"(?i){BEFORE}(?:BEGIN|END){WS}+(?:CLAIM CHECK(?:ER)? EVIDENCE|CLAIM){AFTER}", "[claim check delimiter removed]"))


def scrub(c: Column, keep: str = r"A-Za-z0-9_-", most: int = 100) -> Column:
    """Only characters of a class, cut to a length."""
    return F.left(F.regexp_replace(c, f"[^{keep}]", ""), F.lit(most))


# Shapes of credentials.
_SECRETS = (r"(?i)Bearer\s+[\w.~+/=-]+", r"eyJ[\w-]+\.[\w-]+\.[\w-]+", r"sb_(?:secret|publishable)_[\w-]+", rf"{BEFORE}pa-[A-Za-z0-9_-]{{16,}}")


def redact(c: Column, secrets: Sequence[str] = ()) -> Column:
    """Bearer tokens, JWTs, keys and given secrets of eight characters or more."""
    for secret in secrets:
        if len(secret) >= 8:
            c = F.replace(c, F.lit(secret), F.lit("[redacted]"))
    for pattern in _SECRETS:
        c = F.regexp_replace(c, pattern, "[redacted]")
    return c


def ellipsis(c: Column, most: int) -> Column:
    """The first characters with an ellipsis where more follow."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("…"))).otherwise(c)


def safe_detail(c: Column, secrets: Sequence[str] = (), most: int = 200) -> Column:
    """One redacted line of a provider's message."""
    return ellipsis(collapse(redact(F.regexp_replace(c, r"\p{Cc}", " "), secrets)), most)


def error_chain(parts: Column, secrets: Sequence[str] = (), most: int = 500) -> Column:
    """Up to four causes of an error, outermost first, as one redacted line."""
    first = F.transform(F.slice(parts, 1, 4), lambda p: F.trim(F.substring_index(p, "\n", 1)))
    text = F.array_join(F.filter(first, lambda p: p != ""), " <- caused by: ")
    return ellipsis(redact(F.when(text == "", "unknown error").otherwise(text), secrets), most)


def derive_excerpt(c: Column, most: int = 400, least: int = 200) -> Column:
    """A verbatim prefix, cut at a space if enough is kept."""
    head = F.left(c, F.lit(most))
    at = F.length(head) - F.instr(F.reverse(head), " ")
    return F.when(F.length(c) <= most, c).when((F.instr(head, " ") > 0) & (at >= least), F.left(c, at)).otherwise(head)


def normalized_literal(c: Column) -> Column:
    """Text for literal comparison."""
    return F.lower(collapse(nfkc(c)))


def page_range(start: Column, end: Column) -> Column:
    """`p. 3`, `pp. 3–5`, null without a start."""
    s, e = start.cast("string"), end.cast("string")
    return F.when(start.isNull(), None).when(end.isNull() | (start == end), F.concat(F.lit("p. "), s)).otherwise(F.concat(F.lit("pp. "), s, F.lit("–"), e))


def prompt_pages(start: Column, end: Column) -> Column:
    """`3`, `3-5` or `n/a`."""
    s, e = start.cast("string"), end.cast("string")
    return F.when(start.isNull(), "n/a").when(end.isNull() | (start == end), s).otherwise(F.concat(s, F.lit("-"), e))
