"""Limits in Chinese wording and measured values, with the units of the quantity table."""

from __future__ import annotations

import re
from decimal import Decimal
from typing import NamedTuple

from strataloom.functions.quantities import plain, read_quantities, to_common, units, usual
from strataloom.functions.text import LIMIT_WORDS

# Further wording of limits; without it, the word inside (高于 in 不高于) would turn the comparison round.
_WORDS = LIMIT_WORDS | {
    "不高于": "le", "不应高于": "le", "不得高于": "le", "不多于": "le", "小于等于": "le", "小于或等于": "le", "不应低于": "ge", "不得低于": "ge",
    "不少于": "ge", "不应少于": "ge", "不得少于": "ge", "大于等于": "ge", "大于或等于": "ge",
}
_LIMIT = re.compile("|".join(sorted(_WORDS, key=len, reverse=True)))
_OTHER = re.compile(r"\s*([0-9]+(?:[.][0-9]+)?)\s*([A-Za-zμΩ/°%‰][A-Za-zμΩ/°%‰0-9·^]*)?")
_TARGET = re.compile(r"([A-Z]+-[0-9]+)的([^0-9]+)$")
_FACT = re.compile(r"实测([A-Z]+-[0-9]+)的([^0-9:]+?):")
_END = re.compile(r"[。;\n]|$")


class Limit(NamedTuple):
    """A limit or (``op`` None) a measured value; unit is the usual spelling, or the printed one where the table has none."""

    op: str | None
    value: float
    unit: str | None
    dimension: str | None
    common: float | None
    tag: str | None
    parameter: str | None


def _made(op: str | None, value: Decimal, unit: str | None, tag: str | None, parameter: str | None) -> Limit:
    dimension = common = None
    if unit in units():
        dimension, exact = to_common(value, unit)
        common = float(exact)
    return Limit(op, float(value), unit and usual(unit), dimension, common, tag, parameter and re.sub(r"\s+", "", parameter))


def read_limits(text: str) -> tuple[list[Limit], list[Limit]]:
    """All limits of a text and all its measured values (实测 tag 的 parameter：value), in order of place.

    A unit that a sentence names for the values after it holds here too. Limits without any unit do not come out; a
    measured value without one, or with one outside the table, has no dimension. Several values of one dimension
    in a measurement, as of a range, come out one by one.
    """
    text = plain(text)
    words, said = list(_LIMIT.finditer(text)), list(_FACT.finditer(text))
    if not words and not said:
        return [], []
    found = [q for q in read_quantities(text) if q.unit]

    def at(place: int):
        return next((q for q in found if q.start >= place and not text[place : q.start].strip()), None)

    limits, facts = [], []
    for m in words:
        target = _TARGET.search(text, 0, m.start())
        tag, parameter = target.groups() if target else (None, None)
        q = at(m.end())
        if q:
            limits.append(_made(_WORDS[m[0]], q.value, q.unit, tag, parameter))
        elif (other := _OTHER.match(text, m.end())) and other[2]:
            limits.append(_made(_WORDS[m[0]], Decimal(other[1]), other[2], tag, parameter))
    for m in said:
        q = at(m.end())
        if q:
            end = _END.search(text, m.end()).start()
            facts += [_made(None, x.value, x.unit, *m.groups()) for x in found if q.start <= x.start < end and x.dimension == q.dimension]
        elif other := _OTHER.match(text, m.end()):
            facts.append(_made(None, Decimal(other[1]), other[2], *m.groups()))
    return limits, facts
