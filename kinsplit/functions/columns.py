"""Column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def present(column: Column) -> Column:
    """Neither null nor empty text."""
    return column.isNotNull() & (column.cast("string") != "")


def _shortest(column: Column, kind: T.DataType) -> Column:
    """The shortest digits that name a floating-point number, in Java's form.

    Before version 19 Java may print more of them (``5.903299999999999E20`` for 5.9033E20), so
    long texts give way to the first rounding that reads as the same number.
    """
    text, name, most = column.cast("string"), *(("double", 16) if isinstance(kind, T.DoubleType) else ("float", 8))
    rounded = [F.format_string(f"%.{n}e", column.cast("double") if name == "double" else text.cast("double")) for n in range(1, most)]
    shorter = F.get(F.filter(F.array(*rounded), lambda r: r.cast(name) == column), F.lit(0))
    digits = F.length(F.regexp_replace(F.regexp_replace(text, "E.*", ""), r"\D", ""))
    return F.when((digits >= most) & shorter.isNotNull(), F.regexp_replace(shorter, r"e\+?(-?)0*(\d+)$", "E$1$2")).otherwise(text)


def as_key(frame: DataFrame, name: str) -> Column:
    """A column as text; floating-point numbers lose a ``.0`` and are written without exponents.

    The digits are the shortest that name the number. Beyond 38 places before or after the
    point, where no decimal reaches, the exponent stays.
    """
    column, kind = F.col(f"`{name}`"), frame.schema[name].dataType
    text = column.cast("string")
    if not isinstance(kind, (T.DoubleType, T.FloatType)):
        return text
    text = _shortest(column, kind)
    size = F.abs(column)
    plain = F.when(size >= 1e18, text.try_cast("decimal(38,0)").cast("string")).when(size >= 1, text.try_cast("decimal(38,18)").cast("string")).otherwise(text.try_cast("decimal(38,37)").cast("string"))
    short = F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    exact = (column == 0) | (short != "0")  # else smaller than any decimal
    return F.when(exact & short.isNotNull(), F.when(column == 0, F.lit("0")).otherwise(short)).otherwise(text)


def pack(names: list[str]) -> Column:
    """A VARIANT object of these columns; missing values are left out."""
    if not names:
        return F.parse_json(F.lit("{}"))
    return F.parse_json(F.to_json(F.struct(*[F.col(f"`{n}`").alias(n) for n in names])))


def attribute(name: str, kind: str = "string", attrs: str = "attrs") -> Column:
    """An attribute of a node or edge; null if it is missing or not of that type."""
    return F.try_variant_get(F.col(attrs), f"$.{name}", kind)


def attribute_text(name: str, attrs: str = "attrs") -> Column:
    return F.expr(f"try_variant_get({attrs}, '$.{name}', 'string')")


def joined(ids: Column) -> Column:
    """Identifiers in bytewise order, separated by commas."""
    return F.array_join(F.array_sort(F.collect_set(ids)), ", ")


def first_ids(frame: DataFrame, column: str, limit: int = 20) -> tuple[list[str], int]:
    """The first ids of a column in order, at most ``limit``, and how many there are."""
    distinct = frame.select(F.col(f"`{column}`").cast("string").alias("id")).distinct()
    head = [r.id for r in distinct.orderBy("id").limit(limit + 1).collect()]
    return (head, len(head)) if len(head) <= limit else (head[:limit], distinct.count())


def listing(ids: list[str], total: int) -> str:
    return ", ".join(map(str, ids)) + (f" ... (+{total - len(ids)} more)" if total > len(ids) else "")
