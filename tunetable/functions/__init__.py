"""Column functions: pure expressions (JVM-side) plus a few Arrow UDFs."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit_of(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def val_of(x) -> Column:
    """Column name, Column or Python value."""
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def let(values: dict, body) -> Column:
    """Evaluate ``values`` once per row and pass them to ``body`` as fields of one struct.

    Spark re-evaluates an expression at every place it is referenced, and
    inside a lambda (``transform``) once per element; binding through a
    one-element array keeps row-invariant work (an array, its length, a
    search) to one evaluation per row.
    """
    env = F.struct(*[v.alias(k) for k, v in values.items()])
    return F.transform(F.array(env), body)[0]


def keyed_hash(seed: int, *cols) -> Column:
    """60 uniform bits as a long: the first 15 hex digits of the md5 of
    ``seed|col|col|...``, which other SQL engines can compute too. A null
    column reads as a NUL character."""
    parts = [F.coalesce(col_of(c).cast("string"), F.lit("\0")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def idiv(a, b) -> Column:
    """Integer division truncating toward zero (SQL ``div``)."""
    return F.call_function("div", lit_of(a) if not isinstance(a, str) else F.col(a), lit_of(b))
