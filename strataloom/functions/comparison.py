"""Single quantities: units with a baseline, whether a text holds a quantity, and a measured value against a limit."""

from __future__ import annotations

import re
from collections.abc import Mapping
from decimal import Decimal, InvalidOperation

from strataloom.functions.quantities import plain, read_quantities, to_common, units

#: Units that count multiples; a multiple of something named compares only with multiples of the same thing.
_TIMES = "倍"
_GUARD = r"(?![^\W㐀-鿿]|[/⁄^·⋅*²³]|[-+−]\d)"
_COMPARE = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b, "ne": lambda a, b: a != b}


def number(value: object) -> Decimal | None:
    """A finite decimal, or None for anything else (null, truth values, ranges, words)."""
    if value is None or isinstance(value, bool):
        return None
    try:
        out = Decimal(plain(str(value)).strip().replace("−", "-"))
    except InvalidOperation:
        return None
    return out if out.is_finite() else None


def common(value: Decimal, unit: str | None) -> tuple[str, Decimal] | None:
    """Dimension and value in the common unit; multiples are shares, or of a dimension of their baseline; None if unknown."""
    name = re.sub(r"\s+", "", plain(unit or ""))
    if name in units():
        return to_common(value, name)
    if name in ("1", _TIMES):
        return "share", value * 1_000_000
    return (f"multiple of {name[1:]}", value) if name.startswith(_TIMES) and len(name) > 1 else None


def quantity_in_text(value: object, unit: str | None, text: str | None) -> bool:
    """Whether a text states the quantity: in any unit of its dimension, as a multiple of its baseline, or letter for letter."""
    wanted, name = number(value), re.sub(r"\s+", "", plain(unit or ""))
    if wanted is None or not name or not text:
        return False
    target = common(wanted, name)
    if target and any(q.unit and to_common(q.value, q.unit) == target for q in read_quantities(text)):
        return True
    said, digits = re.sub(r"\s+", "", plain(text)), r"([-+]?(?:\d+(?:\.\d+)?|\.\d+))"
    forms = [rf"(?<![\d.]){digits}{re.escape(name)}{_GUARD}"]
    if name.startswith(_TIMES) and len(name) > 1:
        forms.append(rf"{re.escape(name[1:])}的?{digits}{_TIMES}")
    return any(number(found) == wanted for form in forms for found in re.findall(form, said))


def verdict(limit: Mapping, fact: Mapping | None, facts: int = 1, applicability: str = "applicable") -> tuple[str, str]:
    """(status, reason) of a measured value (``value, unit, target, location``) against a limit (also ``op, parameter``).

    satisfied, not_satisfied, not_applicable, or unknown with its reason. Values compare exactly in the common unit.
    ``facts`` is the number of measured values of the parameter; more than one decide nothing.
    """
    if applicability != "applicable":
        return ("not_applicable", "condition does not hold") if applicability == "not_applicable" else ("unknown", "condition open")
    same = lambda a, b: re.sub(r"\s+", "", plain(str(a or ""))).casefold() == re.sub(r"\s+", "", plain(str(b or ""))).casefold()
    if not limit.get("parameter") or not limit.get("target"):
        return "unknown", "no target or parameter"
    if fact is None or facts != 1:
        return "unknown", "no single fact"
    if not same(fact.get("target") or limit["target"], limit["target"]):
        return "unknown", "another target"
    if limit.get("location") and not same(fact.get("location"), limit["location"]):
        return "unknown", "another location"
    a, b = number(fact.get("value")), number(limit.get("value"))
    left, right = (None if v is None else common(v, x.get("unit")) for v, x in ((a, fact), (b, limit)))
    if limit.get("op") not in _COMPARE:
        return "unknown", "operator"
    if a is None or b is None:
        return "unknown", "no finite number"
    if left is None or right is None or left[0] != right[0]:
        return "unknown", "dimension"
    return ("satisfied" if _COMPARE[limit["op"]](left[1], right[1]) else "not_satisfied"), ""
