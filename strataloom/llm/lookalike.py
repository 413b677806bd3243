"""Visually identical text with different characters: one form per look.

Two layers. ``fold`` resolves what needs no context: width forms, composed accents, unit signs, radical forms, kinds of
space and hyphen, invisible characters. Look-alike letters need context: in tokens that mix scripts (and tokens that
consist of look-alikes of another script than their surroundings), the dominant script is determined and the other
letters are substituted, but only where the resulting word occurs in the vocabulary of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.skew import salted_join
from strataloom.session import durable

# Letters of Cyrillic and Greek that look like a Latin letter.
CYRILLIC = dict(zip("аеорсухіјѕһԁԛԝѵАВЕКМНОРСТУХІЈЅҮԌԜ", "aeopcyxijshdqwvABEKMHOPCTYXIJSYGW", strict=True))
GREEK = dict(zip("ονρχυικαΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳϹ", "ovpxuikaABEZHIKMNOPTYXcjC", strict=True))
# Characters without ink, dashes that print as a hyphen, area and volume signs, simplified radicals.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u3164\uffa0\ufeff\ufff9\ufffa\ufffb"
HYPHENS = "\u2010\u2011\u2012\u2013\u2212\u2043\ufe58\ufe63\uff0d"
SQUARED = {"㎟": "mm²", "㎠": "cm²", "㎡": "m²", "㎢": "km²", "㎣": "mm³", "㎤": "cm³", "㎥": "m³", "㎦": "km³", "㎧": "m/s", "㎨": "m/s²"}
RADICALS = dict(
    zip(
        "⺁⺄⺅⺇⺈⺉⺋⺌⺏⺐⺒⺓⺔⺖⺗⺙⺛⺞⺟⺠⺡⺢⺣⺤⺦⺨⺩⺫⺬⺭⺮⺯⺰⺱⺲⺶⺷⺸⺺⺻⺽⺾⺿⻀⻁⻂⻄⻅⻆⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻯⻰⻲",
        "厂乙亻几刀刂㔾小尣尢巳幺彑忄㣺攵旡歺母民氵氺灬爫丬犭王罒示礻竹糹纟罓罒羋羊䒑肀聿臼艹艹艹虎衤西见角讠贝车辶辶辶邑钅長镸长门阜阝雨青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾齐齿竜龙龟",
        strict=True,
    )
)
_TAKEN = {"<wide>", "<narrow>", "<small>", "<square>"}


@lru_cache(maxsize=1)
def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {}
    spans = [(0x2E80, 0x3000), (0x3300, 0x3400), (0xF900, 0xFB07), (0xFE50, 0xFE70), (0xFF00, 0xFFEF), (0x2100, 0x2150)]
    for lo, hi in spans:
        for code in range(lo, hi):
            kind = unicodedata.decomposition(chr(code)).split(" ")[0]
            if kind in _TAKEN or kind == "<compat>" and (code < 0x3000 and code >= 0x2E80 or code in (0x2103, 0x2109) or 0xFB00 <= code <= 0xFB06):
                table[code] = unicodedata.normalize("NFKC", chr(code))
    for char, to in (SQUARED | RADICALS | {"µ": "μ", "℃": "°C", "℉": "°F"}).items():
        table[ord(char)] = to
    for code in [*range(0x2000, 0x200B), 0xA0, 0x1680, 0x202F, 0x205F, 0x3000, 0x9]:
        table[code] = " "
    for code in [*map(ord, INVISIBLE), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE01F0), 0xD]:
        table[code] = None
    return table | {ord(c): "-" for c in HYPHENS}


_COMBINING = re.compile("[\u0300-\u036f\u0653-\u0655\u093c\u09bc\u0e4d\u3099\u309a\u1ab0-\u1aff\u20d0-\u20ff\uf900-\ufaff\u2126\u212a\u212b\u1100-\u11ff]")
_FOREIGN = re.compile("[\u0370-\u03bb\u03bd-\u03ff\u0400-\u052f]")
_TOKEN = re.compile("[A-Za-z\u00c0-\u024f\u0370-\u03ff\u0400-\u052f]+")
WORD = "[A-Za-z\u00c0-\u024f\u0370-\u03ff\u0400-\u052f]+"


def fold(text: str) -> str:
    """The form of a text that needs no context. Superscripts, case, digits and other marks stay."""
    if text.isascii() and "\t" not in text and "\r" not in text:
        return text
    text = text.translate(_table())
    if _COMBINING.search(text):
        text = unicodedata.normalize("NFC", text.replace("\u0e4d\u0e32", "\u0e33"))
    return text


def script(char: str) -> str:
    """L, G or C; empty for the micro sign, which belongs to units of every language."""
    if char == "μ":
        return ""
    return "C" if "Ѐ" <= char <= "ԯ" else "G" if "Ͱ" <= char <= "Ͽ" else "L"


@lru_cache(maxsize=1)
def _between() -> dict[str, dict[str, str]]:
    """For each script, its letter for every look-alike of another one."""
    to: dict[str, dict[str, str]] = {"L": CYRILLIC | GREEK, "C": {}, "G": {}}
    for name, own in (("C", CYRILLIC), ("G", GREEK)):
        for char, latin in own.items():
            to[name].setdefault(latin, char)
        to[name] |= {c: to[name][x] for c, x in (GREEK if name == "C" else CYRILLIC).items() if x in to[name]}
    return to


@lru_cache(maxsize=1)
def _ambiguous() -> frozenset[str]:
    return frozenset([*CYRILLIC, *GREEK, *CYRILLIC.values(), *GREEK.values()])


def _most(letters: str) -> str:
    counts = {s: sum(script(c) == s for c in letters) for s in "LCG"}
    return max("LCG", key=lambda s: counts[s]) if any(counts.values()) else ""


def suspects(text: str) -> list[tuple[str, str]]:
    """Tokens of a folded text that may hold foreign look-alikes, each with the script it should have."""
    if not _FOREIGN.search(text):
        return []
    out, around = {}, None
    for m in _TOKEN.finditer(text):
        token = m[0]
        scripts = {script(c) for c in token} - {""}
        foreign = scripts != {"L"} and all(c in _ambiguous() for c in token)
        if len(scripts) < 2 and not foreign:
            continue
        clear = _most("".join(c for c in token if c not in _ambiguous()))
        if not clear:
            if re.match(r"-?\d", text[m.end() : m.end() + 2]):
                clear = "L"
            else:
                if around is None:
                    around = _most("".join(c for c in text if c.isalpha() and c not in _ambiguous() and _TOKEN.match(c))) or "L"
                clear = around
        if scripts != {clear}:
            out[token] = clear
    return list(out.items())


def options(token: str, dominant: str) -> list[str]:
    """Single-script readings of a token, that of the dominant script first; empty where some letter has no look-alike."""
    found = []
    for name in [dominant, *(s for s in "LCG" if s != dominant)]:
        read = "".join(c if script(c) in ("", name) else _between()[name].get(c, "\0") for c in token)
        if "\0" not in read and read != token:
            found.append(read)
    return found


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        folded = [fold(t) for t in batch["text"]]
        doubt = [suspects(t) for t in folded]
        batch = batch.drop(columns="text")
        batch["folded"] = folded
        batch["tokens"] = [[t for t, _ in d] for d in doubt]
        batch["scripts"] = [[s for _, s in d] for d in doubt]
        yield batch


@F.pandas_udf(T.ArrayType(T.StringType()))
def _options(token: pd.Series, dominant: pd.Series) -> pd.Series:
    return pd.Series([options(t, d) for t, d in zip(token, dominant, strict=True)])


@F.pandas_udf(T.StringType())
def _replaced(text: pd.Series, old: pd.Series, new: pd.Series) -> pd.Series:
    def one(t: str, a: list[str], b: list[str]) -> str:
        to = dict(zip(a, b, strict=True))
        return _TOKEN.sub(lambda m: to.get(m[0], m[0]), t)

    return pd.Series([one(*row) for row in zip(text, old, new, strict=True)])


def vocabulary(texts: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """The words of ``wanted`` (``word``) that occur in the columns ``text``: each text is read, no list is collected."""
    words = None
    for df in texts:
        part = df.select(F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("word")).distinct()
        words = part if words is None else words.union(part)
    return wanted.join(words.distinct(), "word", "left_semi")


def canonical(df: DataFrame, keys: list[str], corpus: list[DataFrame] | None = None) -> DataFrame:
    """``keys``, ``raw`` (md5 of the text as given) and ``canonical`` for the rows of ``df`` with a text.

    ``corpus`` names the tables (column ``text``) whose words are the vocabulary; by default ``df`` itself. Null texts
    give no row, empty ones stay empty; repeated rows stay repeated. Only texts with suspect tokens are shuffled.
    """
    names = [f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema]
    rows = df.where("text is not null").select(*keys, F.md5("text").alias("raw"), "text")
    parts = durable(rows.mapInPandas(_folded, ", ".join([*names, "raw string", "folded string", "tokens array<string>", "scripts array<string>"])))
    doubtful = parts.where("size(tokens) > 0")
    pairs = doubtful.select(F.explode(F.arrays_zip("tokens", "scripts")).alias("p")).select("p.tokens", "p.scripts").distinct()
    choice = durable(pairs.select(F.col("tokens").alias("token"), F.col("scripts").alias("dominant"), F.posexplode(_options("tokens", "scripts")).alias("rank", "word")))
    known = vocabulary(corpus or [df.select("text")], choice.select("word").distinct())
    best = choice.join(known, "word").groupBy("token", "dominant").agg(F.min(F.struct("rank", "word")).alias("b")).select("token", "dominant", "b.word")
    spread = doubtful.select(*keys, "raw", F.explode(F.arrays_zip("tokens", "scripts")).alias("p")).select(*keys, "raw", F.col("p.tokens").alias("token"), F.col("p.scripts").alias("dominant"))
    fixed = spread.join(best, ["token", "dominant"]).distinct().groupBy(*keys, "raw").agg(F.collect_list(F.struct("token", "word")).alias("fix"))
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "raw"]]
    repaired = doubtful.alias("a").join(fixed.alias("b"), on, "left").select(*(F.col(f"a.{k}") for k in [*keys, "raw"]), "folded", "fix")
    changed = F.when(F.col("fix").isNull(), F.col("folded")).otherwise(_replaced("folded", F.coalesce("fix.token", F.array()), F.coalesce("fix.word", F.array())))
    return parts.where("size(tokens) = 0").select(*keys, "raw", F.col("folded").alias("canonical")).union(repaired.select(*keys, "raw", changed.alias("canonical")))


def alike_pairs(rows: DataFrame, group: str) -> DataFrame:
    """``group, id_a, id_b``: ids of equal ``look`` and different ``raw`` within a group; rows have ``group, id, raw, look``.

    Variants of a look are paired first and then expanded, so equal copies are never compared with each other. The
    rows of a look with many copies are spread over tasks on both sides.
    """
    variant = rows.select(group, "look", "raw").distinct()
    several = variant.groupBy(group, "look").agg(F.count("*").alias("n")).where("n > 1").select(group, "look")
    rows = durable(salted_join(rows.distinct(), several, [group, "look"], F.col("id"), "left_semi"))
    variant = durable(rows.select(group, "look", "raw").distinct())
    pair = variant.select(group, "look", F.col("raw").alias("raw_a")).join(variant.select(group, "look", F.col("raw").alias("raw_b")), [group, "look"]).where("raw_a < raw_b")
    left = rows.select(group, "look", F.col("raw").alias("raw_a"), F.col("id").alias("x"))
    right = rows.select(group, "look", F.col("raw").alias("raw_b"), F.col("id").alias("y"))
    one = salted_join(left, pair, [group, "look", "raw_a"], F.col("x"))
    full = salted_join(one, right, [group, "look", "raw_b"], F.col("x")).where("x <> y")
    return full.select(group, F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
