"""Evaluation texts leaking into training text: hash joins of template windows and a check of their slots.

A text is read as its stream of letters and digits, case folded and width folded. Two templates are made of it:

same width: every digit becomes the placeholder 0. It depends on nothing but the characters themselves, so any common
run of the streams is a common run of the templates wherever it starts; with windows of ``width`` characters of which
each stretch of ``reach - width + 1`` keeps its least hash, two streams that share ``reach`` characters always share
a kept window.

free width: numbers, unit signs after numbers and names (letters joined with digits) become one placeholder each, so
questions with other numbers, names or units of another length still meet.

Kept windows of corpus and items are joined by hash. A window that both hold fixes how the two texts lie over each
other; the common stretch is followed from there in both directions, and the slots in it decide: slots that are all
equal over ``reach`` characters make a verbatim leak, slots that map one to one onto each other a re-parameterised one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.skew import salted_join
from strataloom.session import durable

RUN = 40
WIDTH = 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
# Placeholders of the free-width template and the unit signs that follow a number.
NUMBER, NAME, UNIT = "\ue002", "\ue000", "\ue001"
_HELD = re.compile(f"[{NUMBER}{NAME}{UNIT}]")
UNITS = r"mpa|kpa|mm|cm|km|kg|°c|℃|bar|min|m|h|s|t|n|kn|%|‰|毫米|厘米|米|分钟|小时|兆帕|千帕|吨|公斤"
_SLOT = re.compile(
    r"(?P<name>(?<![a-z0-9])[a-z]{2,}[-‐‑]?\d+(?![a-z0-9]))|(?P<number>\d+(?:[.,]\d+)*)(?:\s?(?P<unit>(?:" + UNITS + r")(?![a-z])))?"
)


def stream(text: str) -> str:
    """Letters and digits of a text, width folded and case folded."""
    return "".join(filter(str.isalnum, unicodedata.normalize("NFKC", text).casefold()))


def free_template(text: str) -> tuple[str, list[str]]:
    """The stream with typed placeholders for numbers, names and units, and the values of its slots in order."""
    text, slots, out, at = unicodedata.normalize("NFKC", _HELD.sub(" ", text)).casefold(), [], [], 0
    for m in _SLOT.finditer(text):
        out.append("".join(filter(str.isalnum, text[at : m.start()])))
        if m["name"]:
            out.append(NAME)
            slots.append(re.sub(r"\W", "", m["name"]))
        else:
            out.append(NUMBER)
            slots.append(m["number"])
            if m["unit"]:
                out.append(UNIT)
                slots.append(m["unit"])
        at = m.end()
    out.append("".join(filter(str.isalnum, text[at:])))
    return "".join(out), slots


def _rolled(code: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit polynomial hash of every window, built from windows of doubling widths."""
    with np.errstate(over="ignore"):
        code = (code + np.uint64(0x51ED27)) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(29)
        out, have, base = None, 0, pow(_BASE, 1, 1 << 64)
        part, size = code, 1
        while size <= width:
            if width & size:
                out = part if out is None else out[: len(part) - have] * np.uint64(pow(base, size, 1 << 64)) + part[have:]
                have += size
            part = part[: len(part) - size] * np.uint64(pow(base, size, 1 << 64)) + part[size:]
            size *= 2
        out = out ^ (out >> np.uint64(31))
        out *= np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(32))


def _slid(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (maximum) of every stretch of ``width`` values, by doubling."""
    pick, out, size = (np.minimum if least else np.maximum), values, 1
    while size * 2 <= width:
        out = pick(out[: len(out) - size], out[size:])
        size *= 2
    return pick(out[: len(out) - (width - size)], out[width - size :]) if width > size else out


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


_NUMBER_UNIT = re.compile(r"\d+(?:[.,]\d+)*\s?(?:" + UNITS + r")(?![a-z])")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
_NAMES = re.compile(r"(?<![a-z0-9])[a-z]{2,}[-‐‑]?\d+(?![a-z0-9])")


def _streams(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The stream and the free-width template of all texts as code points, with ``gap`` zeros before each text."""
    # Placeholders that a text itself holds are read as spaces.
    joined = unicodedata.normalize("NFKC", _HELD.sub(" ", "\0".join(["", *(t.replace("\0", " ") for t in texts)]))).casefold()
    out = []
    for text in (joined, _NUMBER.sub(NUMBER, _NUMBER_UNIT.sub(NUMBER + UNIT, _NAMES.sub(NAME, joined)))):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        code = code[_alnum()[code] | (code == 0) | ((code >= 0xE000) & (code < 0xE003))]
        out.append(np.repeat(code, np.where(code == 0, gap, 1)) if gap > 1 else code)
    return out[0], out[1]


def kept_windows(texts: list[str], every: bool, width: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, family, place, hash) of the windows of the templates; all of them, or of each stretch the one of least hash.

    A stretch has ``reach - width + 1`` successive windows; a text with fewer windows keeps its least one. Family 0 is
    the same-width template, 1 the free-width one; places count the characters of the template.
    """
    stretch = reach - width + 1
    gap, at, family, places, found = width + stretch, [], [], [], []
    for k, code in enumerate(_streams(texts, gap)):
        starts = np.flatnonzero(code == 0)[::gap]
        code = np.concatenate([np.where((code >= 48) & (code <= 57), 48, code).astype(np.uint64), np.zeros(gap, np.uint64)])
        hashes = _rolled(code, width)
        inside = np.concatenate([[0], np.cumsum(code == 0)])
        valid = inside[width : width + len(hashes)] == inside[: len(hashes)]
        keep = valid
        if not every:
            hashes = np.where(valid, hashes, np.uint64(_MASK))
            low = _slid(hashes, stretch, least=True)
            keep = valid & (_slid(np.concatenate([np.zeros(stretch - 1, np.uint64), low, np.zeros(stretch - 1, np.uint64)]), stretch, least=False) == hashes)
        place = np.flatnonzero(keep)
        of = np.searchsorted(starts, place, side="right") - 1
        at.append(of)
        family.append(np.full(len(place), k, np.int32))
        places.append((place - starts[of] - gap).astype(np.int32))
        found.append(hashes[place].view(np.int64))
    return np.concatenate(at), np.concatenate(family), np.concatenate(places), np.concatenate(found)


def _windows(keys: list[str], every: bool, width: int, reach: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 512):
                part = batch.iloc[first : first + 512]
                at, family, place, found = kept_windows(list(part["text"]), every, width, reach)
                out = part[keys].iloc[at].reset_index(drop=True)
                out["family"], out["place"], out["h"] = family, place, found
                yield out

    return run


def windows(df: DataFrame, keys: list[str], every: bool = False, width: int = WIDTH, reach: int = RUN) -> DataFrame:
    """``keys, family, place, h``: hashes of template windows of ``df`` (``keys, text``); all or those kept by least hash."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return df.select(*keys, "text").where("text is not null").mapInPandas(_windows(keys, every, width, reach), f"{fields}, family int, place int, h bigint")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _overlay(a: np.ndarray, b: np.ndarray, shift: int) -> tuple[int, np.ndarray]:
    """Where in ``a`` the overlay of ``b`` at ``shift`` begins, and whether the characters are equal from there on."""
    lo, hi = max(0, shift), min(len(a), len(b) + shift)
    return lo, a[lo:hi] == b[lo - shift : hi - shift] if hi > lo else np.zeros(0, bool)


def _stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first, behind last) of the runs of true values of ``least`` or more."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], equal.astype(np.int8), [0]])))
    return [(int(i), int(j)) for i, j in zip(edge[::2], edge[1::2], strict=True) if j - i >= least]


def equal_run(a: np.ndarray, b: np.ndarray, shifts: Iterable[int], least: int) -> int:
    """Length of the longest run of equal characters of two streams (as codes) laid over each other, if ``least`` or more."""
    best = 0
    for shift in shifts:
        for i, j in _stretches(_overlay(a, b, shift)[1], max(least, best + 1)):
            best = max(best, j - i)
    return best


_PLACEHOLDERS = np.array([ord(NUMBER), ord(NAME), ord(UNIT)], dtype=np.uint32)


def same_question(a: tuple[np.ndarray, list[str]], b: tuple[np.ndarray, list[str]], shifts: Iterable[int], least: int) -> int:
    """Length of the longest stretch of two free-width templates (codes, slot values) with consistent slots, or 0.

    Slots are consistent if their values map one to one onto each other. A stretch counts if it has ``least`` characters
    or more, holds a slot whose values differ, and at least half of it is text and not placeholders.
    """
    best = 0
    slot_a, slot_b = (np.concatenate([[0], np.cumsum(np.isin(t, _PLACEHOLDERS))]) for t, _ in (a, b))
    for shift in shifts:
        lo, equal = _overlay(a[0], b[0], shift)
        for i, j in _stretches(equal, max(least, best + 1)):
            first, last = lo + i, lo + j
            ka, kb, n = slot_a[first], slot_b[first - shift], int(slot_a[last] - slot_a[first])
            places = first + np.flatnonzero(np.isin(a[0][first:last], _PLACEHOLDERS))
            pairs = list(zip(a[1][ka : ka + n], b[1][kb : kb + n], strict=True))
            start = first
            at, there, back, changed = 0, {}, {}, []
            for k in [*range(n), n]:
                end = int(places[k]) if k < n else last
                if end - start > max(best, least - 1) and any(changed) and 2 * (k - at) <= end - start:
                    best = end - start
                if k == n:
                    break
                x, y = pairs[k]
                while at < k and (there.get(x, y) != y or back.get(y, x) != x):
                    start = int(places[at]) + 1
                    at += 1
                    changed = changed[1:]
                    there, back = dict(pairs[at:k]), {v: u for u, v in pairs[at:k]}
                there[x], back[y] = y, x
                changed.append(x != y)
    return best


def _verdicts(least: int):
    @F.pandas_udf(T.StructType([T.StructField("run", T.IntegerType()), T.StructField("kind", T.StringType())]))
    def verdict(text: pd.Series, item: pd.Series, exact: pd.Series, loose: pd.Series) -> pd.DataFrame:
        names = list(dict.fromkeys([*text, *item]))
        read = {t: codes for t, *codes in zip(names, *(np.split(c, np.flatnonzero(c == 0))[1:] for c in _streams(names, 1)), strict=True)}
        rows = []
        for a, b, same, free in zip(text, item, exact, loose, strict=True):
            (x, fx), (y, fy) = read[a], read[b]
            run = equal_run(x[1:], y[1:], same, least) if len(same) else 0
            kind = "verbatim" if run else None
            if not run:
                far = [shift for shift in free if _stretches(_overlay(fx[1:], fy[1:], shift)[1], least)]
                run = same_question(*((_codes(t), slots) for t, slots in map(free_template, (a, b))), far, least) if far else 0
                kind = "reworded values" if run else None
            rows.append((run, kind))
        return pd.DataFrame(rows, columns=["run", "kind"])

    return verdict


def leaked(documents: DataFrame, items: DataFrame, run: int = RUN, width: int = WIDTH) -> DataFrame:
    """``doc_id, item_id, run, kind`` of every document that holds an item, fully or in part.

    ``documents`` has ``doc_id, text``, ``items`` has ``item_id, text``. kind is ``verbatim`` for an unbroken common
    run of ``run`` or more letters or digits (its length in ``run``), else ``reworded values`` for a passage of ``run``
    or more characters of the free-width template that equals part of the item but for numbers, names and units that
    are replaced one to one. Null and short texts leak nothing; equal items are all reported. The windows of the corpus
    meet the items' by a join on the hash: the items' side is broadcast only while its size stays under the session's
    threshold; candidates alone fetch the texts again, and an item that many documents hold is spread over tasks.
    """
    items = items.select("item_id", "text").where("text is not null and item_id is not null").distinct()
    wanted = durable(windows(items, ["item_id"], every=True, width=width, reach=run).withColumnRenamed("place", "item_place"))
    met = windows(documents.where("doc_id is not null"), ["doc_id"], width=width, reach=run).join(wanted, ["family", "h"])
    shift = F.col("place") - F.col("item_place")
    hit = met.groupBy("doc_id", "item_id").agg(F.collect_set(F.when(F.col("family") == 0, shift)).alias("exact"), F.collect_set(F.when(F.col("family") == 1, shift)).alias("loose"))
    hit = durable(hit)
    texts = documents.select("doc_id", "text").where("text is not null").join(hit.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    both = salted_join(hit.join(texts, "doc_id"), items.withColumnRenamed("text", "item"), ["item_id"], F.col("doc_id"))
    judged = both.select("doc_id", "item_id", _verdicts(run)("text", "item", "exact", "loose").alias("v")).where("v.kind is not null")
    return judged.groupBy("doc_id", "item_id").agg(F.max_by("v.run", F.struct(F.col("v.kind") == "verbatim", "v.run")).alias("run"), F.max("v.kind").alias("kind"))
