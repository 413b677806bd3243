"""Three-valued conditions: expressions compiled to nullable booleans, and Kleene folds over groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from strataloom.functions.quantities import units
from strataloom.functions.text import normalized

APPLICABLE, NOT_APPLICABLE, UNKNOWN = "applicable", "not_applicable", "unknown"
_TOLERANCE = 1e-12
_COMPARE = {
    "lt": lambda a, b, same: (a < b) & ~same, "le": lambda a, b, same: (a < b) | same, "gt": lambda a, b, same: (a > b) & ~same,
    "ge": lambda a, b, same: (a > b) | same, "eq": lambda a, b, same: same, "ne": lambda a, b, same: ~same,
}


def state(truth: Column) -> Column:
    """A nullable boolean as applicable, not_applicable or unknown."""
    return F.when(truth.isNull(), UNKNOWN).when(truth, APPLICABLE).otherwise(NOT_APPLICABLE)


def kleene_all(truth: Column) -> Column:
    """Aggregate: false if any is false, else null if any is null, else true; null for an empty group."""
    return F.when(F.max(~truth), F.lit(False)).when(F.max(truth.isNull()), F.lit(None).cast("boolean")).when(F.count(F.lit(1)) > 0, F.lit(True))


def kleene_any(truth: Column) -> Column:
    """Aggregate: true if any is true, else null if any is null, else false; null for an empty group."""
    return F.when(F.max(truth), F.lit(True)).when(F.max(truth.isNull()), F.lit(None).cast("boolean")).when(F.count(F.lit(1)) > 0, F.lit(False))


def compile_condition(expression: Mapping | None, facts: Mapping[str, Mapping[str, Column]]) -> Column:
    """The truth of a condition over fact columns, null where it cannot be told.

    ``expression`` nests ``and``/``or`` (``items``) and ``not`` (``item``) over comparisons with ``parameter``, ``op``,
    ``value``, and either ``unit`` and ``location`` or, for equality of words, a ``vocabulary``. ``facts`` names the
    columns ``value, unit, location`` (numbers) or ``word`` of each parameter. A missing fact, an unknown unit, another
    dimension or another location gives null; two different words compare only if the vocabulary holds both.
    """
    nothing = F.lit(None).cast("boolean")
    if not isinstance(expression, Mapping):
        return nothing
    op = expression.get("op")
    if op in ("and", "or"):
        items = [compile_condition(item, facts) for item in expression.get("items") or []]
        if not items:
            return nothing
        out = items[0]
        for item in items[1:]:
            out = out & item if op == "and" else out | item
        return out
    if op == "not":
        return ~compile_condition(expression.get("item"), facts)
    fact, value = facts.get(expression.get("parameter") or ""), expression.get("value")
    if fact is None or value is None or op not in _COMPARE:
        return nothing
    if not expression.get("unit"):
        if op not in ("eq", "ne") or "word" not in fact or not isinstance(value, str):
            return nothing
        own, wanted = normalized(fact["word"]), normalized(F.lit(value))
        known = F.array(*(normalized(F.lit(w)) for w in expression.get("vocabulary") or [])) if expression.get("vocabulary") else F.array().cast("array<string>")
        same = F.when(own == wanted, True).when(F.array_contains(known, own) & F.array_contains(known, wanted), F.lit(False))
        return same if op == "eq" else ~same
    place = expression.get("location")
    if expression["unit"] not in units() or not place or "value" not in fact:
        return nothing
    dimension, factor = units()[expression["unit"]]
    if dimension == "temperature":
        scales = [(u, 1.0) for u, (d, f) in units().items() if d == dimension and f == factor]
        factor = "1"
    else:
        scales = [(u, float(f)) for u, (d, f) in units().items() if d == dimension]
    scale = F.create_map(*(F.lit(x) for pair in scales for x in pair))
    left, right = fact["value"] * scale[fact["unit"]], F.lit(float(value) * float(factor))
    same = F.abs(left - right) <= F.greatest(F.abs(left), F.abs(right)) * _TOLERANCE
    return F.when(fact["location"] == place, _COMPARE[op](left, right, same))
