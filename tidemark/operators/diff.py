"""Differences between two copies of a dataset, field by field."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, TimestampType

MAIN, COPY = 0, 1


def within(tolerance: float) -> str:
    """Rule for numbers: differ if exactly one is null or they are more than ``tolerance`` apart (NaN equals NaN)."""
    return f"NOT ((a IS NULL AND b IS NULL) OR coalesce(isnan(a) AND isnan(b), false) OR coalesce(a = b, false) OR coalesce(abs(a - b) <= {tolerance!r}D AND NOT isnan(a) AND NOT isnan(b), false))"


#: Rule for anything comparable: differ unless both are null or both are equal.
SAME = "NOT (a <=> b)"


def diff_copies(main: DataFrame, copy: DataFrame, *, keys: Mapping[str, Column | str], fields: Mapping[str, tuple[Column | str, str]]) -> DataFrame:
    """One row per key that a side lacks and per field whose value differs.

    ``keys`` names the key columns of the result and the expressions that make them on
    both sides; ``fields`` gives each compared field its expression and its rule, a SQL
    condition over ``a`` (main) and ``b`` (copy) that is true where they differ.
    The sides are tagged and put together, grouped once by key with one struct kept per
    side, and the structs are compared by a generated expression over the array of fields.
    The aggregation keeps one struct per side and key and combines before the shuffle, so
    a key with a third of all rows is no burden.

    Result: the keys, ``finding`` (``missing_in_copy``, ``missing_in_main`` or the field's
    name), ``main_value`` and ``copy_value`` (text; null for missing rows).

    Defined cases: null keys are a key like any other. Repeated rows of a side count once,
    the greatest by field values in the order given standing for the key. An empty side
    makes every key of the other missing there. Further columns are ignored, whatever
    their names.
    """
    key_names, field_names = list(keys), list(fields)
    col = lambda c: F.col(c) if isinstance(c, str) else c

    def tagged(df: DataFrame, side: int) -> DataFrame:
        record = F.struct(*(col(fields[f][0]).alias(f"f{i}") for i, f in enumerate(field_names)))
        return df.select(*(col(keys[k]).alias(f"k{i}") for i, k in enumerate(key_names)), F.lit(side).alias("side"), record.alias("rec"))

    both = tagged(main, MAIN).unionByName(tagged(copy, COPY))
    by_key = both.groupBy(*(f"k{i}" for i in range(len(key_names))))
    at = lambda side, c: F.when(F.col("side") == side, c)
    if len(field_names) == 1 and isinstance(both.schema["rec"].dataType[0].dataType, NumericType | BooleanType | DateType | TimestampType):
        # a struct's maximum must be found by sorting, that of one plain column is kept in a hash table; the struct is put together after it
        flat_max = [F.max(at(side, F.col(c))).alias(f"{c[:3]}{side}") for side in (MAIN, COPY) for c in ("rec.f0", "side")]
        grouped = by_key.agg(*flat_max).select("*", *(F.when(F.col(f"sid{side}").isNotNull(), F.struct(F.col(f"rec{side}").alias("f0"))).alias(n) for side, n in ((MAIN, "m"), (COPY, "c"))))
    else:
        grouped = by_key.agg(*(F.max(at(side, F.col("rec"))).alias(n) for side, n in ((MAIN, "m"), (COPY, "c"))))

    def entry(i: int, name: str) -> str:
        differs = _bind(fields[name][1], f"m.f{i}", f"c.f{i}")
        return f"named_struct('finding', '{name}', 'main_value', cast(m.f{i} AS string), 'copy_value', cast(c.f{i} AS string), 'differs', {differs})"

    missing = lambda what: f"array(named_struct('finding', '{what}', 'main_value', cast(null AS string), 'copy_value', cast(null AS string), 'differs', true))"
    compared = f"filter(array({', '.join(entry(i, f) for i, f in enumerate(field_names))}), x -> x.differs)"
    found = F.expr(f"CASE WHEN c IS NULL THEN {missing('missing_in_copy')} WHEN m IS NULL THEN {missing('missing_in_main')} ELSE {compared} END")
    flat = grouped.select(*(f"k{i}" for i in range(len(key_names))), F.explode(found).alias("d"))
    return flat.select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(key_names)), "d.finding", "d.main_value", "d.copy_value")


def _bind(rule: str, a: str, b: str) -> str:
    """The rule with its two names replaced by the two sides' fields."""
    return re.sub(r"\b([ab])\b(?!\s*\()", lambda m: a if m[1] == "a" else b, rule)


def summarise(found: DataFrame, by: Sequence[str] = ("dataset", "finding")) -> DataFrame:
    """How often each finding occurs."""
    return found.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
