"""Noise in text from scanned pages: furniture, divided words and misread characters, and the repaired paragraphs.

Furniture is found by its repetition at the edges of pages. The running text is read once, into words and ideographs
between their neighbours; counts and skip-grams (a word with those at up to two places around it, an ideograph with its
two neighbours) are made over all scanned text. A skip-gram vector is a row of shifted positive pointwise mutual
information, the matrix that skip-gram training with negative sampling factorises.

Rare words: an edit between glyphs that are easily confused must lead to a far more frequent word, and the vectors of
the two must point the same way. Ideographs need no table of glyphs: where a far more frequent one stands between the
same neighbours and the written one is not at home beside either, the vector of all such places must point like the
frequent one and not like the written one elsewhere. How near is near enough is learned from held-out pairs: frequent
words and ideographs against a few of their own places, and against those of others; the held-out places then count
again in the vectors that decide.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.skew import SALTS, salted_join
from strataloom.session import durable

# Glyphs that recognition confuses (written form, printed form), and characters that stand for no glyph.
LATIN_GLYPHS = (
    ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("0", "o"), ("0", "O"), ("5", "s"), ("5", "S"), ("8", "B"), ("6", "b"), ("9", "g"),
    ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("ii", "ü"), ("vv", "w"), ("li", "h"),
    ("n", "u"), ("u", "n"), ("I", "l"), ("l", "I"), ("l", "t"), ("t", "f"), ("f", "t"), ("a", "o"), ("o", "a"), ("u", "ü"), ("a", "ä"), ("o", "ö"), ("B", "ß"), ("nn", "m"), ("in", "m"), ("ri", "n"),
    ("l", "i"), ("i", "l"), ("q", "g"), ("g", "q"), ("y", "v"), ("v", "y"), ("0", "D"), ("O", "0"), ("l", "1"), ("S", "5"), ("Z", "2"), ("E", "F"), ("F", "E"), ("O", "Q"), ("O", "D"), ("D", "O"), ("C", "G"), ("G", "C"),
)
NO_GLYPH = "■�□▪"
#: Placeholders before the first and behind the last piece of the running text of a unit.
START, END = "\u0002", "\u0003"
_DIGIT_LIKE = {"l": "1", "I": "1", "O": "0", "o": "0", "B": "8", "S": "5", "s": "5", "Z": "2", "z": "2", "!": "1", "|": "1", "b": "6", "g": "9", "q": "9", "i": "1"}
#: A form is rare beside another one if that is so many times as frequent.
RATIO = 10
#: One unit in so many is held out to learn how near vectors of one word are, from all words (ideographs) with as few
#: held-out places as a rare one has; the threshold where none teach it. Parts of the ring that pairs words with others.
HELD_OUT, FEW, COSINE, RING = 32, 6, 0.05, 4096
_HELD = "\u0001"

_HAN = "一-鿿"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKS = "-‐‑¬­"
_BREAK = re.compile(rf"([{_LETTERS}0-9!|{NO_GLYPH}]+)([{_MARKS}])\s*$")
_NEXT = re.compile(rf"\s*([{_LETTERS}0-9!|{NO_GLYPH}]+)")
_WORD = re.compile(rf"(?<![{_LETTERS}0-9!|-])[{_LETTERS}0-9!|]*[{_LETTERS}][{_LETTERS}0-9!|]*(?:-[{_LETTERS}0-9!|]+)*")
_CODE = re.compile(r"(?<![A-Za-z0-9])([A-Z0-9]{2,4})[-‐‑]\s?([0-9A-Za-z!|]{4,6})(?![A-Za-z0-9])")
_TAG_END, _TAG_START = re.compile(r"(?<![A-Za-z0-9])([A-Z0-9]{2,4})[-‐‑]\s*$"), re.compile(r"\s*([0-9A-Za-z!|]{4,6})(?![A-Za-z0-9])")
_AMOUNT = re.compile(r"(?<![A-Za-z0-9.,])([0-9lIOoSsBZ!|]+[.,][0-9lIOoSsBZ!|]+?)(?=\s?(?:[mk]?[mM][" + NO_GLYPH + r"m]|mm|m\b|kPa|MPa|%|℃|°|[）)，。,]|$))")
_PAGE = re.compile(r"^(?:[-–—·•\[(]\s*)?(?:page|seite|p\.|s\.|第|页)?\s*([0-9lIOoSsBZ!|" + NO_GLYPH + r"]{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})\s*(?:页)?(?:\s*[-–—·•\])])?$", re.I)
#: No page number is a longer line.
_PAGE_LENGTH = 40
_HEAD_NUMBER = re.compile(r"^\s*[0-9lIOoSB!|" + NO_GLYPH + r"]{1,4}\s{2,}|\s{2,}[0-9lIOoSB!|" + NO_GLYPH + r"]{1,4}\s*$")


def digits(text: str) -> str:
    """A number with letters that look like digits read as such."""
    return "".join(_DIGIT_LIKE.get(c, c) for c in text)


def page_mark(line: str) -> tuple[str, bool, int | None] | None:
    """(kind, misread, number) if a line holds nothing but what may be a page number; kind: plain, marked or roman."""
    m = _PAGE.match(line.strip())
    if not m:
        return None
    said = m[1]
    if re.fullmatch(r"[ivxlcIVXLC]+", said) and not re.fullmatch(r"[lI]{1,2}", said):
        return "roman", False, None
    read = digits(said)
    if not any(c.isdigit() for c in read):
        return None
    marked = line.strip() != said
    return ("marked" if marked else "plain"), read != said or any(c in NO_GLYPH for c in said), int(read) if read.isdigit() else None


def head_key(line: str) -> str:
    """A title without page number, spaces and case; digits that may be letters are folded."""
    line = _HEAD_NUMBER.sub("", line.strip())
    return re.sub(r"\s+", "", line).casefold()


def near(a: str, b: str) -> bool:
    """Equal up to substitutions or one inserted glyph in about an eighth of the characters."""
    if a == b:
        return True
    most = max(1, min(len(a), len(b)) // 8)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= most
    if abs(len(a) - len(b)) > most or min(len(a), len(b)) < 5:
        return False
    head = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    tail = next((i for i, (x, y) in enumerate(zip(a[::-1], b[::-1], strict=False)) if x != y), min(len(a), len(b)))
    return max(len(a), len(b)) - head - tail <= most + 1


def code_misread(letters: str, number: str) -> bool:
    """Whether a tag mixes letters and digits within a part, or has a sign that is neither."""
    return any(c.isdigit() for c in letters) and any(c.isalpha() for c in letters) or any(not c.isdigit() for c in number) and sum(c.isdigit() for c in number) >= 2


def body_parts(lines: list[str], furniture: list[bool]) -> list[tuple[int, str]]:
    """The lines of running text with their numbers (from 1)."""
    return [(i + 1, line) for i, (line, out) in enumerate(zip(lines, furniture, strict=True)) if not out and line.strip()]


def broken(parts: list[tuple[int, str]]) -> list[tuple[int, int, str, str, str]]:
    """(line, next line, first part, mark, second part) of words whose line ends with a dividing mark before letters."""
    out = []
    for (i, line), (j, after) in zip(parts, parts[1:], strict=False):
        m, n = _BREAK.search(line), _NEXT.match(after)
        tag = m and n and m[1].isupper() and sum(c.isdigit() for c in n[1]) >= 2
        if m and n and not tag and re.search(f"[{_LETTERS}]", m[1][-3:]) and (n[1][0].islower() or not n[1][0].isalnum() or len(n[1]) > 1 and n[1][1:].islower() and n[1][0] in "01!|5"):
            out.append((i, j, m[1], m[2], n[1]))
    return out


def words_of(parts: list[tuple[int, str]], cuts: list[tuple[int, int, str, str, str]]) -> list[tuple[int, int, int, str]]:
    """(line, next line, place of division, word) of the Latin words of running text in order, divided ones joined."""
    cut_end, cut_start = {c[0]: c for c in cuts}, {c[1] for c in cuts}
    out = []
    for i, line in parts:
        found = [m for m in _WORD.finditer(line)]
        if i in cut_end and found:
            found = [m for m in found if m.end() < len(line.rstrip()) - 1]
        if i in cut_start and found and not line[: found[0].start()].strip():
            found = found[1:]
        if found and (spans := [m.span() for m in _CODE.finditer(line)]):
            found = [m for m in found if not any(a <= m.start() < b for a, b in spans)]
        out += [(i, i, -1, m[0]) for m in found if not _SHORT_TAG(m[0])]
        if i in cut_end:
            _, j, a, _, b = cut_end[i]
            out.append((i, j, len(a), a + b))
    return out


_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9.,\-]*")
_SHORT_TAG = re.compile(r"[A-Z0-9]{2,4}").fullmatch
_UNREAD, _NO_NUMBER, _DIGIT = re.compile(f"[{NO_GLYPH}]"), re.compile(r"[^0-9.,]"), re.compile(r"\d")
_MAY_BE_AMOUNT = re.compile(r"[0-9lIOoSsBZ!|][.,][0-9lIOoSsBZ!|]")
_TAG = re.compile("[A-Z]{2}")
_OTHER = re.compile(rf"[^\W_A0{_HAN}]")
_ANY_HAN = re.compile(f"[{_HAN}]")


def han_windows(parts: list[tuple[int, str]]) -> tuple[list[int], list[str]]:
    """Lines of, and three characters around, every ideograph of running text; numbers, tags and both ends are single placeholders."""
    said, at = [START], [0]
    for i, line in parts:
        plain = _OTHER.sub("0", "".join(_RUN.sub(lambda m: "A" if _TAG.match(m[0]) else "0", line).split()))
        said.append(plain)
        at += [i] * len(plain)
    text = "".join([*said, END])
    places = [m.start() for m in _ANY_HAN.finditer(text)]
    return [at[k] for k in places], [text[k - 1 : k + 2] for k in places]


def misread_signs(parts: list[tuple[int, str]]) -> list[int]:
    """Lines with signs that stand for no glyph, tags or amounts that mix letters and digits, and tags unlike the page's main one."""
    out, codes, told = [], [_CODE.findall(line) for _, line in parts], Counter()
    for (i, line), here in zip(parts, codes, strict=True):
        told.update(c for c in here if not code_misread(*c))
        bad = _UNREAD.search(line) or any(code_misread(*c) for c in here)
        if bad or _MAY_BE_AMOUNT.search(line) and any(_NO_NUMBER.search(m[1]) and _DIGIT.search(digits(m[1])) for m in _AMOUNT.finditer(line)):
            out.append(i)
    if told:
        main, many = told.most_common(1)[0]
        for (i, _), here in zip(parts, codes, strict=True):
            for c in here:
                a, b = "".join(main), "".join(c)
                if c != main and many >= 3 * told[c] and len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1 and any(digits(x) == digits(y) for x, y in zip(a, b, strict=True) if x != y):
                    out.append(i)
    for (i, line), (j, after) in zip(parts, parts[1:], strict=False):
        m = _TAG_END.search(line) if line.rstrip()[-1:] in "-‐‑" else None
        n = _TAG_START.match(after) if m else None
        if m and n and sum(c.isdigit() for c in n[1]) >= 2:
            if re.search(r"[^0-9]", n[1]):
                out.append(j)
            if re.search(r"\d", m[1]) and re.search("[A-Z]", m[1]):
                out.append(i)
    return sorted(set(out))


_PARSED = (
    "id string, words array<string>, at array<int>, next_at array<int>, cut array<int>, tri array<string>, tri_at array<int>, "
    "breaks array<string>, break_at array<int>, signs array<int>"
)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _PARSED.split(", ")]
    for batch in batches:
        rows = []
        for key, lines, furniture in zip(batch["id"], batch["lines"], batch["furniture"], strict=True):
            parts = body_parts(list(lines), list(furniture))
            cuts = broken(parts)
            words = words_of(parts, cuts)
            tri_at, tri = han_windows(parts)
            breaks = [f"{mark}\t{a}\t{b}".lower() for _, _, a, mark, b in cuts]
            rows.append((key, [w.lower() for *_, w in words], *([w[k] for w in words] for k in range(3)), tri, tri_at, breaks, [c[0] for c in cuts], misread_signs(parts)))
        yield pd.DataFrame(rows, columns=names)


def glyph_edits(word: str, back: bool = False) -> list[str]:
    """Forms that one confusion of glyphs leads to (``back``: forms that it comes from)."""
    out = set()
    for pair in LATIN_GLYPHS:
        wrong, right = (x.lower() for x in (pair[::-1] if back else pair))
        at = word.find(wrong)
        while at >= 0:
            out.add(word[:at] + right + word[at + len(wrong) :])
            at = word.find(wrong, at + 1)
    return sorted(out - {word})


_edits = F.pandas_udf(lambda words: words.map(glyph_edits), T.ArrayType(T.StringType()))
_origins = F.pandas_udf(lambda words: words.map(lambda w: glyph_edits(w, back=True)), T.ArrayType(T.StringType()))


def _vectors(rows: DataFrame, marginals: DataFrame) -> DataFrame:
    """``a, b, v``: positive mutual information of skip-grams (``a, b, n``), unit length per ``a``; marginals: ``b, nb, total``."""
    left = rows.groupBy("a").agg(F.sum("n").alias("na"))
    kept = durable(rows.join(left, "a").join(marginals, "b").select("a", "b", F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))).alias("v")).where("v > 0"))
    norm = kept.groupBy("a").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return kept.join(norm, "a").select("a", "b", (F.col("v") / F.col("norm")).alias("v"))


def _marginals(events: DataFrame) -> DataFrame:
    per = events.groupBy("b").agg(F.sum("n").alias("nb"))
    return per.join(F.broadcast(per.agg(F.sum("nb").alias("total"))))


def _similar(pairs: DataFrame, vectors: DataFrame, salts: int = SALTS) -> DataFrame:
    """``rare, common, cosine`` of candidate pairs; 0 where the vectors share nothing. ``salts``: 1 if no common one has many."""
    pairs = pairs.select("rare", "common").distinct()
    left = pairs.join(vectors.select(F.col("a").alias("rare"), "b", F.col("v").alias("x")), "rare")
    right = vectors.join(pairs.select(F.col("common").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("common"), "b", F.col("v").alias("y"))
    met = salted_join(left, right, ["common", "b"], F.col("rare"), salts=salts).groupBy("rare", "common").agg(F.sum(F.col("x") * F.col("y")).alias("cosine"))
    return pairs.join(met, ["rare", "common"], "left").fillna(0.0, ["cosine"])


def best_threshold(same: Iterable[float] | dict[float, int], other: Iterable[float] | dict[float, int]) -> float:
    """The least cosine with the best mean of the shares kept of pairs of one word and rejected of pairs of two.

    Both are cosines or numbers of pairs by cosine.
    """
    same, other = Counter(same), Counter(other)
    if not same or not other:
        return COSINE
    at = sorted({round(x + more, 3) for x in [*same, *other] for more in (0, 0.001) if x > 0} | {COSINE})
    same_, other_ = ((keys := sorted(of), [0, *accumulate(of[x] for x in keys)]) for of in (same, other))
    below = lambda of, t: of[1][bisect_left(of[0], t)]
    return max(at, key=lambda t: ((same_[1][-1] - below(same_, t)) / same_[1][-1] + below(other_, t) / other_[1][-1], -t))


def _unheld(rows: DataFrame) -> DataFrame:
    """``a, b, n`` with the held-out places back among the others: what decides is made from all places."""
    return rows.groupBy(F.regexp_replace("a", _HELD, "").alias("a"), "b").agg(F.sum("n").alias("n"))


def learned_threshold(rows: DataFrame, marginals: DataFrame) -> float:
    """The cosine that tells places of one word from those of two, from its held-out vectors.

    ``rows`` has ``a, b, n`` of all vectors. Every word with at most ``FEW`` held-out places is compared with itself and
    with the next one in a ring of all of them; numbers of pairs by cosine (three digits, downwards) reach the driver.
    """
    held = rows.where(F.col("a").endswith(_HELD)).groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") <= 4 * FEW)
    held = held.select(F.col("a").alias("rare"), F.regexp_replace("a", _HELD, "").alias("common"))
    held = durable(held.join(rows.select(F.col("a").alias("common")).distinct(), "common", "left_semi").select("rare", "common"))
    vectors = durable(_vectors(rows.join(held.select(F.explode(F.array("rare", "common")).alias("a")), "a", "left_semi"), marginals))
    told = _similar(durable(held.union(_neighbours(held))), vectors, 1)
    own = F.regexp_replace("rare", _HELD, "") == F.col("common")
    told = told.groupBy(own.alias("own"), (F.floor(F.col("cosine") * 1000) / 1000).alias("cosine")).agg(F.count("*").alias("n")).collect()
    return best_threshold({r["cosine"]: r["n"] for r in told if r["own"]}, {r["cosine"]: r["n"] for r in told if not r["own"]})


def _neighbours(held: DataFrame) -> DataFrame:
    """``rare, common``: every held-out word with the next one in the order of hashes, the last of a part with the first of the next part."""
    order = F.struct(F.xxhash64("common").alias("h"), "common")
    rows = held.withColumns({"k": F.pmod(F.xxhash64("common"), F.lit(RING)), "o": order})
    parts = rows.groupBy("k").agg(F.min("o").alias("first")).select("k", F.lead("first.common").over(Window.orderBy("k")).alias("then"))
    follows = F.lead("common").over(Window.partitionBy("k").orderBy("o"))
    return rows.withColumn("next", follows).join(parts, "k").select("rare", F.coalesce("next", "then").alias("common")).where("common is not null")


def word_counts(parsed: DataFrame) -> DataFrame:
    """``a, n, plain``: every word with its number, and how often it stands undivided."""
    return parsed.select(F.explode(F.arrays_zip("words", "cut")).alias("x")).groupBy(F.col("x.words").alias("a")).agg(F.count("*").alias("n"), F.count_if(F.col("x.cut") < 0).alias("plain"))


def word_links(parsed: DataFrame, words: DataFrame, threshold: float | None = None) -> DataFrame:
    """``rare, common, cosine``: misread words with their reading.

    One confusion of glyphs is tried first, and two (words of six letters or more, or with signs that are no letters)
    where no single one leads anywhere; forward from the rare word and back from the frequent one, so no word is
    edited twice. ``threshold`` replaces the learned cosine.
    """
    common = words.where(F.col("n") >= RATIO).select(F.col("a").alias("common"), F.col("n").alias("many"))
    tried = durable(words.where("length(a) >= 2").select(F.col("a").alias("rare"), F.col("n").alias("few"), F.explode(_edits("a")).alias("mid")))
    enough = F.col("many") >= RATIO * F.col("few")
    once = durable(tried.join(common, tried["mid"] == common["common"]).where(enough).select("rare", "common", F.lit(1).alias("edits")))
    left = tried.where("length(rare) >= 6 or rare rlike '[0-9!|]'").join(once.select("rare").distinct(), "rare", "left_anti")
    twice = left.join(common.withColumn("mid", F.explode(_origins("common"))), "mid").where(enough & (F.col("rare") != F.col("common"))).select("rare", "common", F.lit(2).alias("edits"))
    pairs = durable(once.union(twice.distinct()))
    keys = pairs.select(F.col("rare").alias("a")).union(pairs.select("common")).distinct()
    held = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    ahead = lambda off: F.when(F.size("words") > off, F.zip_with(F.slice("words", F.lit(1), F.size("words") - off), F.slice("words", F.lit(off + 1), F.size("words") - off), lambda x, y: F.struct(x.alias("a"), y.alias("b"))))
    near = F.concat(ahead(1), F.coalesce(ahead(2), F.slice(ahead(1), 1, 0)))
    events = durable(parsed.select(held.alias("held"), F.explode(near).alias("p")).groupBy("held", "p.a", "p.b").agg(F.count("*").alias("n")))
    events = events.union(events.select("held", "b", "a", "n"))
    rows = events.join(keys, "a", "left_semi").join(common.select(F.col("common").alias("a"), F.lit(True).alias("often")), "a", "left")
    rows = durable(rows.groupBy(F.when(F.col("held") & F.col("often"), F.concat("a", F.lit(_HELD))).otherwise(F.col("a")).alias("a"), "b").agg(F.sum("n").alias("n")))
    marginals = durable(_marginals(events))
    least = learned_threshold(rows, marginals) if threshold is None else threshold
    vectors = durable(_vectors(_unheld(rows), marginals))
    alike = pairs.join(_similar(pairs, vectors), ["rare", "common"]).where(F.col("cosine") >= least)
    best = alike.groupBy("rare").agg(F.max(F.struct(-F.col("edits"), "cosine", "common")).alias("b"))
    return best.select("rare", "b.common", "b.cosine")


def han_links(parsed: DataFrame, threshold: float | None = None) -> DataFrame:
    """``key, to``: misread ideographs between their neighbours, with their reading.

    A place (two neighbours) speaks against an ideograph if another one stands there ``RATIO`` times as often and is as
    much more frequent beside either neighbour, counting the ideograph at other places only. Its vector over such
    places must be near that of the other one (``threshold`` replaces the learned cosine) and, by the same ratio,
    farther from its vector over the places where it is the most frequent one itself. One occurrence tells nothing; two
    are needed.
    Of several readings that fit a place, that of the nearest vector is taken.
    """
    han = durable(parsed.select(F.explode("tri").alias("a")).groupBy("a").agg(F.count("*").alias("n")).select(F.substring("a", 1, 1).alias("l"), F.substring("a", 2, 1).alias("c"), F.substring("a", 3, 1).alias("r"), "n"))
    top = han.groupBy("l", "r").agg(F.max(F.struct("n", "c")).alias("t")).select("l", "r", F.col("t.n").alias("many"), F.col("t.c").alias("m"))
    away = durable(han.join(top, ["l", "r"]).where("c <> m"))
    weak = away.where(F.col("many") >= RATIO * F.col("n"))
    before, behind = durable(han.groupBy("l", "c").agg(F.sum("n").alias("k"))), durable(han.groupBy("c", "r").agg(F.sum("n").alias("k")))
    odd = weak
    for side, on in ((before, "l"), (behind, "r")):
        odd = odd.join(side.select(on, "c", F.col("k").alias("own")), [on, "c"]).join(side.select(on, F.col("c").alias("m"), F.col("k").alias("other")), [on, "m"])
        odd = odd.where((F.col("own") - F.col("n")) * RATIO <= F.col("other")).drop("own", "other")
    odd = durable(odd.select("l", "c", "r", "n", "m"))
    held = F.pmod(F.xxhash64("l", "c", "r"), F.lit(HELD_OUT)) == 0
    named = han.join(odd.select("l", "c", "r", "m"), ["l", "c", "r"], "left").join(away.select("l", "c", "r", F.lit(True).alias("away")), ["l", "c", "r"], "left")
    name = F.when(F.col("m").isNotNull(), F.concat("c", F.lit(">"), "m")).when(F.col("away"), F.concat("c", F.lit("~"))).when(held, F.concat("c", F.lit(_HELD))).otherwise(F.col("c"))
    events = named.select(name.alias("a"), F.explode(F.array(F.concat(F.lit("<"), "l"), F.concat(F.lit(">"), "r"))).alias("b"), "n")
    events = durable(events.groupBy("a", "b").agg(F.sum("n").alias("n")))
    marginals = durable(_marginals(events))
    least = learned_threshold(events, marginals) if threshold is None else threshold
    vectors = durable(_vectors(_unheld(events), marginals))
    pair = odd.select("c", "m").distinct().select("c", "m", F.concat("c", F.lit(">"), "m").alias("rare"))
    near = _similar(pair.select("rare", F.col("m").alias("common")).union(pair.select("rare", "c")), vectors)
    told = pair.join(near.withColumnsRenamed({"common": "m", "cosine": "like"}), ["rare", "m"]).join(near.withColumnsRenamed({"common": "c", "cosine": "own"}), ["rare", "c"])
    told = durable(told.where((F.col("like") >= least) & (F.col("own") * RATIO <= F.col("like"))).select("c", F.col("m").alias("to"), "like"))
    fits = odd.join(told, "c").join(han.select("l", F.col("c").alias("to"), "r", F.col("n").alias("printed")), ["l", "to", "r"]).where(F.col("printed") >= RATIO * F.col("n"))
    found = durable(fits.groupBy("l", "c", "r", "n").agg(F.max(F.struct("like", "to")).alias("b")).select("l", "c", "r", "n", "b.to"))
    several = found.groupBy("c").agg(F.sum("n").alias("seen")).where("seen >= 2").select("c")
    return found.join(several, "c", "left_semi").select(F.concat("l", "c", "r").alias("key"), "to")


def links(parsed: DataFrame, words: DataFrame, threshold: float | None = None) -> DataFrame:
    """``kind, key, to``: misread words (kind word) and ideographs between their neighbours (kind han) with their reading."""
    by_word = word_links(parsed, words, threshold).select(F.lit("word").alias("kind"), F.col("rare").alias("key"), F.col("common").alias("to"))
    return by_word.union(han_links(parsed, threshold).select(F.lit("han"), "key", "to"))


def _first_change(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))



def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, doc, page, text in zip(batch["id"], batch["document_id"], batch["page"], batch["text"], strict=True):
            lines = text.split("\n")
            edge = {0, len(lines) - 1}
            for i, line in enumerate(lines):
                kind, misread, number = (page_mark(line) if len(line) <= _PAGE_LENGTH else None) or (None, False, None)
                title = head_key(line)
                short = 3 <= len(title) <= 80 and not re.search(r"[.。!！?？;；，,]$", line.strip()) and kind is None
                follows = lines[i + 1].lstrip()[:1] if i + 1 < len(lines) else ""
                row = (key, doc, None if pd.isna(page) else int(page), i + 1, i in edge, kind, misread, number, title if short else None, bool(short and i in edge and not follows.islower()))
                if kind or short:
                    rows.append(row)
        out = pd.DataFrame(rows, columns=["id", "document_id", "page", "line_no", "edge", "mark", "misread", "number", "title", "open"])
        for c in ("page", "number"):
            out[c] = out[c].astype("Int64")
        yield out


def furniture(units: DataFrame) -> DataFrame:
    """``id, line_no, defect, misread`` of running heads and page numbers of ``units`` (``id, document_id, page, text``)."""
    schema = "id string, document_id string, page int, line_no int, edge boolean, mark string, misread boolean, number int, title string, open boolean"
    marks = durable(units.mapInPandas(_marks, schema))
    plain = marks.where("mark = 'plain' and edge")
    shift = plain.where("number is not null and page is not null and not misread").groupBy("document_id", (F.col("number") - F.col("page")).alias("d")).agg(F.count("*").alias("n"))
    usual = shift.groupBy("document_id").agg(F.max(F.struct("n", -F.abs("d"), "d")).alias("u")).select("document_id", F.col("u.d").alias("shift"))
    fits = F.col("number").isNull() | F.col("page").isNull() | F.col("misread") | (F.col("number") - F.col("page") == F.coalesce("shift", F.lit(0)))
    numbers = marks.where("mark in ('marked', 'roman') and edge").select("id", "line_no", "misread").union(plain.join(usual, "document_id", "left").where(fits).select("id", "line_no", "misread"))
    pages = marks.where("title is not null").groupBy("document_id", "title").agg(
        F.countDistinct(F.when(F.col("open"), F.struct("page", "id"))).alias("pages"), F.count_if(F.col("open")).alias("open_n"), F.count("*").alias("n")
    )
    heads = durable(pages.where("pages >= 3 and open_n >= 0.8 * n").select("document_id", F.col("title").alias("head"), "pages"))
    candidates = marks.where("edge and title is not null").select("id", "line_no", "document_id", "title")
    exact = candidates.join(heads.withColumnRenamed("head", "title"), ["document_id", "title"]).select("id", "line_no", "document_id", "title", "pages")
    rest = candidates.join(exact.select("id", "line_no"), ["id", "line_no"], "left_anti")
    ends = lambda c: F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, 3)), F.concat(F.lit(">"), F.substring(c, -3, 3)), F.concat(F.lit("="), F.expr(f"substring({c}, int(length({c}) / 2), 2)"))))
    alike = F.pandas_udf(lambda a, b: pd.Series([near(x, y) for x, y in zip(a, b, strict=True)]), T.BooleanType())
    other = heads.withColumn("k", ends("head")).join(rest.withColumn("k", ends("title")), ["document_id", "k"]).where(alike("title", "head"))
    fuzzy = other.select("id", "line_no").distinct()
    # A head that differs from a far more frequent head of its book is that head misread.
    twin = heads.select("document_id", F.col("head").alias("title"), F.col("pages").alias("own")).withColumn("k", ends("title"))
    twin = twin.join(heads.withColumn("k", ends("head")), ["document_id", "k"]).where((F.col("pages") >= 3 * F.col("own")) & (F.col("head") != F.col("title"))).where(alike("title", "head"))
    odd = twin.select("document_id", "title").distinct().withColumn("odd", F.lit(True))
    exact = exact.join(odd, ["document_id", "title"], "left").select("id", "line_no", F.coalesce("odd", F.lit(False)).alias("misread"))
    head_rows = exact.union(fuzzy.withColumn("misread", F.lit(True))).withColumn("defect", F.lit("running_head"))
    return head_rows.select("id", "line_no", "defect", "misread").union(numbers.select("id", "line_no", F.lit("page_number"), "misread")).distinct()


def scanned_units(source_unit: DataFrame) -> DataFrame:
    """``id, document_id, page, text``: units read from scans (``text_origin`` ocr_text or null), repeated ones once."""
    chosen = source_unit.where("text is not null and id is not null and (text_origin = 'ocr_text' or text_origin is null)")
    return chosen.select("id", "document_id", F.col("locator.physical_page").alias("page"), "text").dropDuplicates(["id"])


def _with_lines(units: DataFrame, extras: DataFrame) -> DataFrame:
    out = extras.groupBy("id").agg(F.collect_set("line_no").alias("out"))
    lines = F.split("text", "\n")
    flags = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda i: F.coalesce(F.array_contains("out", i), F.lit(False)))
    return units.join(out, "id", "left").withColumn("lines", lines).select("id", "document_id", "page", "lines", flags.alias("furniture"))


def _divided(parsed: DataFrame, words: DataFrame) -> DataFrame:
    """``id, line_no, a, b`` of the dividing marks that only the line break brought in."""
    cuts = parsed.select("id", F.explode(F.arrays_zip("breaks", "break_at")).alias("x")).select("id", F.col("x.break_at").alias("line_no"), F.split("x.breaks", "\t").alias("p"))
    cuts = durable(cuts.select("id", "line_no", F.col("p")[1].alias("a"), F.col("p")[2].alias("b")))
    forms = cuts.select("a", "b").distinct().withColumns({"whole": F.concat("a", "b"), "own": F.concat_ws("-", "a", "b")})
    seen = durable(words.where("plain > 0").select(F.col("a").alias("w"), F.col("plain").alias("n")).join(forms.select(F.explode(F.array("whole", "own")).alias("w")).distinct(), "w", "left_semi"))
    forms = forms.join(seen.select(F.col("w").alias("whole"), F.col("n").alias("n_whole")), "whole", "left").join(seen.select(F.col("w").alias("own"), F.col("n").alias("n_own")), "own", "left")
    forms = forms.select("a", "b", F.coalesce("n_whole", F.lit(0)).alias("n_whole"), F.coalesce("n_own", F.lit(0)).alias("n_own"))
    return cuts.join(forms, ["a", "b"]).where("n_own = 0 or n_whole > n_own").select("id", "line_no", "a", "b")


def _analysed(source_unit: DataFrame, threshold: float | None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Furniture, lined units, parsed units, misread places with their reading, and divided words of all scanned units."""
    units = durable(scanned_units(source_unit))
    extras = durable(furniture(units))
    lined = durable(_with_lines(units, extras))
    parsed = durable(lined.select("id", "lines", "furniture").mapInPandas(_parse, _PARSED))
    words = durable(word_counts(parsed))
    table = durable(links(parsed, words, threshold))
    word = parsed.select("id", F.explode(F.arrays_zip("words", "at", "next_at", "cut")).alias("x")).select("id", F.lit("word").alias("kind"), F.col("x.words").alias("key"), F.col("x.at").alias("line_no"), "x.next_at", "x.cut")
    han = parsed.select("id", F.explode(F.arrays_zip("tri", "tri_at")).alias("x")).select("id", F.lit("han"), "x.tri", "x.tri_at", "x.tri_at", F.lit(-1))
    return extras, lined, parsed, durable(word.union(han).join(table, ["kind", "key"])), _divided(parsed, words)


def defects(source_unit: DataFrame, threshold: float | None = None) -> DataFrame:
    """``id, line_no, defect`` of all scanned units.

    Defects are running_head, page_number, broken_word and misread. Units without text and empty tables give nothing;
    a line of unreadable signs only is misread. ``threshold`` replaces the learned cosine of vectors (-1 asks for none).
    """
    extras, lined, parsed, found, cuts = _analysed(source_unit, threshold)
    change = F.pandas_udf(lambda a, b: pd.Series([_first_change(x, y) for x, y in zip(a, b, strict=True)], dtype="int32"), T.IntegerType())
    hit = found.select("id", F.when((F.col("cut") >= 0) & (change("key", "to") >= F.col("cut")), F.col("next_at")).otherwise(F.col("line_no")).alias("line_no"))
    unread = lined.select("id", F.posexplode("lines").alias("i", "line")).where(F.col("line").rlike(f"[{NO_GLYPH}]")).select("id", (F.col("i") + 1).alias("line_no"))
    misread = hit.union(parsed.select("id", F.explode("signs"))).union(extras.where("misread").select("id", "line_no")).union(unread)
    divided = cuts.select("id", "line_no", F.lit("broken_word").alias("defect"))
    return extras.select("id", "line_no", "defect").union(divided).union(misread.select("id", "line_no", F.lit("misread"))).distinct()


def _as_printed(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new[:1].upper() + new[1:] if old[:1].isupper() else new


def corrected_line(line: str, before: str, after: str, words: dict[str, str], signs: dict[str, str]) -> str:
    """A line with its misread words, ideographs, tags and amounts put right; unreadable signs stay."""
    if words:
        line = _WORD.sub(lambda m: _as_printed(words[m[0].lower()], m[0]) if m[0].lower() in words else m[0], line)
    for key, to in signs.items():
        left, char, right = key
        for i, c in enumerate(line):
            if c == char:
                a, b = (line[:i].rstrip() or before.rstrip())[-1:] or START, (line[i + 1 :].lstrip() or after.lstrip())[:1] or END
                if (left in "0A" or a == left) and (right in "0A" or b == right):
                    line = line[:i] + to + line[i + 1 :]
    line = _CODE.sub(lambda m: m[0][: m.start(2) - m.start()] + digits(m[2]) if code_misread(m[1], m[2]) else m[0], line)
    return _AMOUNT.sub(lambda m: digits(m[1]), line)


def reflowed(parts: list[tuple[int, str]], divided: set[int]) -> str:
    """Paragraphs of running text: divided words joined, ideographs set solid, other lines joined by a space.

    A paragraph ends where a line ends a sentence and is clearly shorter than the longest line of its page.
    """
    longest = max((len(t) for _, t in parts), default=0)
    paragraphs, text = [], ""
    for k, (i, line) in enumerate(parts):
        line = line.strip()
        previous = parts[k - 1] if k else None
        if previous is None:
            text = line
        elif previous[0] in divided:
            text = text.rstrip(_MARKS) + line
        elif re.search(rf"[A-Za-z0-9][{_MARKS}]$", text):
            text += line
        elif re.search(r"[.。!?！？]$", text) and len(previous[1]) < 0.85 * longest:
            paragraphs.append(text)
            text = line
        else:
            solid = re.search(f"[{_HAN}，。；：、！？]$", text) or re.match(f"[{_HAN}，。；：、！？]", line)
            text += line if solid else f" {line}"
    return "\n".join([*paragraphs, text]) if text else ""


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for lines, extra, fixes, cuts in zip(batch["lines"], batch["furniture"], batch["fixes"], batch["cuts"], strict=True):
            parts = body_parts(list(lines), list(extra))
            divided = set() if cuts is None else {int(c) for c in cuts}
            words, signs = {}, {}
            for f in [] if fixes is None else fixes:
                (words if f["kind"] == "word" else signs)[f["key"]] = f["to"]
            whole = {a + b: (a, b) for _, _, a, _, b in broken(parts)}
            joined = {w.lower(): words[w.lower()] for w in whole if w.lower() in words}
            done = [(i, corrected_line(t, parts[k - 1][1] if k else "", parts[k + 1][1] if k + 1 < len(parts) else "", words, signs)) for k, (i, t) in enumerate(parts)]
            text = reflowed(done, divided)
            out.append(_WORD.sub(lambda m, j=joined: _as_printed(j[m[0].lower()], m[0]) if m[0].lower() in j else m[0], text))
        yield pd.DataFrame({"id": batch["id"], "document_id": batch["document_id"], "page": batch["page"], "text": out})


def repaired(source_unit: DataFrame) -> DataFrame:
    """``id, document_id, page, text``: every scanned unit as continuous paragraphs without furniture.

    A unit that holds nothing but furniture has an empty text. Signs that stand for no glyph stay where no word tells.
    """
    _, lined, _, found, cuts = _analysed(source_unit, None)
    fixes = found.groupBy("id").agg(F.collect_set(F.struct("kind", "key", "to")).alias("fixes"))
    cut = cuts.groupBy("id").agg(F.collect_set("line_no").alias("cuts"))
    rows = lined.join(fixes, "id", "left").join(cut, "id", "left")
    return rows.mapInPandas(_repair, "id string, document_id string, page int, text string")
