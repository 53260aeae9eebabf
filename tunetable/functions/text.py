"""String functions (F1, F14, P1, P2, P3). Single Catalyst expressions, stream-safe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import col_of

# Whitespace class spelled out, so Java and RE2 engines agree on it.
WS = "[ \\t\\n\\r\\f\\x0B]+"


def normalise_text(text) -> Column:
    """Lowercase, collapse runs of whitespace to one blank, trim."""
    return F.trim(F.regexp_replace(F.lower(col_of(text)), WS, " "))


def redact_bracketed(text) -> Column:
    """Remove ``[...]`` spans; an unclosed bracket is left alone."""
    return F.regexp_replace(col_of(text), "\\[[^\\]]*\\]", "")


def rewrite_prefix(path, old: str, new: str, anywhere: bool = False) -> Column:
    """Replace a literal path prefix.

    Anchored (default): only a leading ``old`` is rewritten. ``anywhere=True``
    replaces every literal occurrence, like a global ``sed`` substitution.
    """
    c = col_of(path)
    if anywhere:
        return F.replace(c, F.lit(old), F.lit(new))
    return F.when(c.startswith(old),
                  F.concat(F.lit(new), F.substring(c, len(old) + 1, 2147483647))).otherwise(c)


def normalise_delimiter(line, old: str = "|", new: str = "\t") -> Column:
    """Change every separator, then drop one blank right after each new separator."""
    c = F.replace(col_of(line), F.lit(old), F.lit(new))
    return F.replace(c, F.lit(new + " "), F.lit(new))


def _py_quote(x: Column) -> Column:
    esc = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.concat(F.lit("'"), esc, F.lit("'"))


def merge_columns(quote, tags) -> Column:
    """``quote + " ->: " + str(list)`` with Python list printing (``['a', 'b']``, ``[]``).

    Null quote gives null. A quote mark inside an element is escaped with a
    backslash (Python would switch quote style instead).
    """
    inner = F.concat_ws(", ", F.transform(col_of(tags), _py_quote))
    return F.concat(col_of(quote), F.lit(" ->: ["), F.coalesce(inner, F.lit("")), F.lit("]"))


def manifest_line(path, text, sep: str = "|") -> Column:
    """Compose a manifest line ``path<sep>text`` with newlines in text made blanks."""
    return F.concat(col_of(path), F.lit(sep), F.replace(col_of(text), F.lit("\n"), F.lit(" ")))
