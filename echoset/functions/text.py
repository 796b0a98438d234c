"""Scalar text functions, all built-in Spark expressions (JVM side, codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour:
#   whitespace collapsed by normalize-space: space, tab, carriage return, line feed
#   preview length for log-style truncation: 20 characters, suffix "..."
XML_SPACE_RUNS = "[\\t\\r\\n][ \\t\\r\\n]*| [ \\t\\r\\n]+"  # a lone space stays as it is
NOT_XML_SPACE = "[^ \\t\\r\\n]"
PREVIEW_CHARS = 20
PREVIEW_SUFFIX = "..."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_space(c: Column | str) -> Column:
    """XPath normalize-space (X3): collapse runs of space/tab/CR/LF, trim ends.

    NBSP and other Unicode spaces are kept, like XPath.
    """
    return F.trim(F.regexp_replace(_col(c), XML_SPACE_RUNS, " "))


def has_text(c: Column | str) -> Column:
    """Whether anything is left by :func:`normalize_space`; stops at the first other character."""
    return F.rlike(_col(c), F.lit(NOT_XML_SPACE))


def xml_escape(c: Column | str) -> Column:
    """Escape the five XML special characters (F3), ampersand first."""
    x = F.replace(_col(c), F.lit("&"), F.lit("&amp;"))
    x = F.replace(x, F.lit("<"), F.lit("&lt;"))
    x = F.replace(x, F.lit(">"), F.lit("&gt;"))
    x = F.replace(x, F.lit('"'), F.lit("&quot;"))
    return F.replace(x, F.lit("'"), F.lit("&apos;"))


def truncate_text(c: Column | str, n: int = PREVIEW_CHARS) -> Column:
    """up to ``n`` characters unchanged, else the first ``n`` plus '...'."""
    x = _col(c)
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.substring(x, 1, n), F.lit(PREVIEW_SUFFIX)))


def preview(c: Column | str, n: int = PREVIEW_CHARS) -> Column:
    """first ``n`` characters, always followed by '...'."""
    return F.concat(F.substring(_col(c), 1, n), F.lit(PREVIEW_SUFFIX))


def word_split(c: Column | str) -> Column:
    """Split on runs of whitespace (Java ``\\s+``), keeping punctuation."""
    return F.split(_col(c), "\\s+")


def words(c: Column | str) -> Column:
    """Non-empty whitespace-separated words of the normalised text."""
    return F.filter(word_split(normalize_space(c)), lambda w: w != F.lit(""))
