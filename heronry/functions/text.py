"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token and citation patterns whose results must agree with published ones.
TOKEN = "([a-z0-9]+)"
CITE = r"\\[A-Za-z]*[Cc]ite[A-Za-z]*\*?(?:\[[^\]]*\])*\{[^}]*\}"
MARKER = r"\[CITATION\]"
NUMERIC_CITES = r"\[\d+(?:\s*[,–-]\s*\d+)*\]"
THINK = r"(?s)<think>.*?(</think>|$)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """All runs of a-z and 0-9 of the lower-case text; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(TOKEN), 1)


def base_id(id_: Column | str) -> Column:
    """An id without its version suffix."""
    return F.regexp_replace(_col(id_), r"v\d+$", "")


def neutralise_citations(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), CITE, " [CITATION] ")


def citation_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(CITE))


def scrub(text: Column | str) -> Column:
    """A query without citation commands, markers and numeric citations, spaces collapsed."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(_col(text), CITE, " "), MARKER, " "), NUMERIC_CITES, " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def scrubbed_count(text: Column | str) -> Column:
    c = _col(text)
    return F.regexp_count(c, F.lit(CITE)) + F.regexp_count(c, F.lit(MARKER)) + F.regexp_count(c, F.lit(NUMERIC_CITES))


def context_tokens(text: Column | str) -> Column:
    """Words of two letters or more, commands left out."""
    return F.regexp_count(F.regexp_replace(_col(text), r"\\[A-Za-z]+\*?", " "), F.lit("[A-Za-z]{2,}"))


def normalised_title(text: Column | str) -> Column:
    return F.left(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", ""), F.lit(120))


def near_duplicate_key(text: Column | str) -> Column:
    return F.left(F.sha2(F.left(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", ""), F.lit(400)), 256), F.lit(16))


def title_in_text(title: Column | str, text: Column | str) -> Column:
    return (F.length(_col(title)) > 12) & F.contains(F.lower(_col(text)), F.lower(_col(title)))


def token_estimate(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4)).cast("int")


def strip_think(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), THINK, "")


def first_object(text: Column | str) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(_col(text), r"(?s)\{.*\}", 0)


def canonical_timestamp(value: Column | str) -> Column:
    """``YYYY-MM-DD HH:MM:SS`` of an ISO-like text, offset dropped, missing time as midnight; null for anything else."""
    v = F.trim(_col(value))
    at = lambda g: F.regexp_extract(v, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2}))?.*)?$", g)
    return F.when(at(1) != "", F.concat(at(1), F.lit(" "), F.when(at(2) == "", "00:00").otherwise(at(2)), F.lit(":"), F.when(at(3) == "", "00").otherwise(at(3))))


def date_number(value: Column | str) -> Column:
    """YYYYMMDD as a number; null where there is no date (what has no date is never legal)."""
    return F.date_format(F.left(_col(value), F.lit(10)).try_cast("date"), "yyyyMMdd").try_cast("int")


def clamp(value: Column | str, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.coalesce(F.least(F.greatest(_col(value).try_cast("double"), F.lit(lo)), F.lit(hi)), F.lit(lo))


def list_hash(ids: Column, separator: str = "|", digits: int = 16) -> Column:
    return F.left(F.sha2(F.concat_ws(separator, ids), 256), F.lit(digits))


def paragraph_number(value: Column | str) -> Column:
    """7 for 'p7', null for what is no number."""
    return F.regexp_replace(_col(value), "^p+", "").try_cast("int")


def error_class(error: Column | str) -> Column:
    """Class of an error text; the first that applies counts."""
    e = F.lower(_col(error))
    return (
        F.when(e.isNull() | (e == ""), "none").when(e.contains("timeout"), "timeout").when(e.contains("unknown"), "unknown_id")
        .when(e.contains("blocked"), "blocked").when(e.contains("budget"), "budget").when(e.contains("json") | e.contains("parse"), "malformed").otherwise("other")
    )


def mask_target(text: Column | str, target: Column | str) -> Column:
    """The citation command that holds the target key becomes [MASKED_CITATION], every other one [CITATION]."""
    t = _col(text)
    holds = F.concat(F.lit(r"\\[A-Za-z]*[Cc]ite[A-Za-z]*\*?(?:\[[^\]]*\])*\{[^}]*\b"), F.regexp_replace(_col(target), r"([^\w])", r"\\$1"), F.lit(r"\b[^}]*\}"))
    return F.regexp_replace(F.regexp_replace(t, holds, F.lit("[MASKED_CITATION]")), F.lit(CITE), F.lit("[CITATION]"))


def delexicalise(text: Column | str, title: Column | str) -> Column:
    """A text without mentions of a title, whatever their case."""
    return F.regexp_replace(_col(text), F.concat(F.lit(r"(?i)\Q"), _col(title), F.lit(r"\E")), F.lit("[TITLE]"))


def acronym(title: Column | str) -> Column:
    """Initials of the capitalised words of a title."""
    return F.array_join(F.regexp_extract_all(_col(title), F.lit(r"\b([A-Z])[A-Za-z]*"), 1), "")
