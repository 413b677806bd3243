"""Sentence boundaries across languages and scripts: candidate marks classified by a maximum-entropy model.

A text is read line by line: headings, list lines and lead-ins that end their line with a colon are units of their own;
other lines run together. Candidates are sentence marks (a full stop, an ellipsis, exclamation and question marks of
every script), and, in scripts without marks, spaces and line breaks. The model has features of the neighbouring
tokens, their case, length, digits and script. It is trained on reliable boundaries of all texts: marks at line ends
are boundaries, stops before lower case or digits are none, and a token whose stop hardly ever ends a line is an
abbreviation. Quoted speech and brackets are kept whole by rule.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataloom.operators.skew import salted_join
from strataloom.session import durable

HASH = 1 << 17
#: At most so many distinct labelled contexts, those of least hash, train the model; counts cover all texts.
MAX_CONTEXTS = 20_000
#: A stop of a token seen this often is reliable if its share at line ends is outside the two bounds.
SEEN, RARELY, OFTEN = 4, 0.02, 0.12

# Marks, brackets and quotes, list markers.
STRONG = "。！？!?।॥؟۔‼⁇"
STOPS = "."
ELLIPSIS = "…"
QUOTES = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』", '"': '"', "‹": "›", "‚": "‘", "《": "》"}
BRACKETS = {"(": ")", "[": "]", "{": "}", "【": "】"}
_CLOSERS = set("".join(QUOTES.values()) + "".join(BRACKETS.values()))
_LIST = re.compile(r"\s*(?:\(\s?(?:\d{1,3}|[a-zA-Z])\s?\)|(?:\d{1,3}|[a-zA-Z])\)|\d{1,2}[.、](?!\d)|[①-⑳]|[-–—•·▪*]\s)")
_LIST_BARE = re.compile(r"\s*\d{1,2}\s+\D")
_HEADING = re.compile(r"\s*(?:\d+(?:\.\d+)+|第[一二三四五六七八九十百\d]+[章节条])\s+\S")
_TOKEN_BEFORE = re.compile(r"[^\s()\[\]{}«»“”„\"「」『』,;:!?。、]+$")
_NEXT_TOKEN = re.compile(r"\s*[(\[\"“„«「『‹]*\s?([^\s]{1,24})")
_CODE = re.compile(r"[A-Z]{2,}[-/]?\d")
_PLAIN = re.compile(r"(?<![^\s(])([^\W\d_]{1,6})(?=[\s,;:)])")
_UNSPACED = "ก-๛ກ-໿က-႟ក-៿"
_THAI = re.compile(f"[{_UNSPACED}]")


_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")


@lru_cache(maxsize=1)
def _folding() -> dict[int, str]:
    wide = {c: unicodedata.normalize("NFKC", chr(c))[0] for c in [*range(0xFF01, 0xFF61), *range(0xFFE0, 0xFFE7)]}
    return wide | {c: " " for c in [0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]} | {0xFF61: "。"}


def visible(text: str) -> tuple[str, list[int] | range]:
    """The text with one width-folded character per visible one, and the place of each in the text."""
    if text.isascii():
        return text, range(len(text))
    folded = text.translate(_folding())
    if not _HIDDEN.search(folded):
        return folded, range(len(folded))
    at = [i for i, c in enumerate(folded) if not _HIDDEN.match(c)]
    return "".join([folded[i] for i in at]), at


_PAIRS = re.compile("[" + re.escape("".join(dict.fromkeys("".join([*QUOTES, *QUOTES.values(), *BRACKETS, *BRACKETS.values()])))) + "]|\n(?=\n)")


def _inside(text: str) -> bytearray:
    """1 for places inside a closed pair of quotes or brackets, the closing sign itself excluded."""
    inside, open_at = bytearray(len(text)), []
    for m in _PAIRS.finditer(text):
        c, i = m[0], m.start()
        if c == "\n":
            open_at = []
        elif any(c in ends for _, ends in open_at):
            while c not in open_at[-1][1]:
                open_at.pop()
            start, _ = open_at.pop()
            inside[start + 1 : i] = b"\1" * (i - start - 1)
        elif c in QUOTES:
            open_at.append((i, QUOTES[c]))
        elif c in BRACKETS:
            open_at.append((i, BRACKETS[c]))
    return inside


def kind_of(token: str) -> str:
    """E end, # tag, 0 digit, U upper, l lower, H ideograph or kana, T script without spaces, A other letters, P other."""
    if not token:
        return "E"
    c = token[0]
    if _CODE.match(token):
        return "#"
    if c.isdigit():
        return "0"
    if "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿":
        return "H"
    if _THAI.match(c):
        return "T"
    return "U" if c.isupper() else "l" if c.islower() else "A" if c.isalpha() else "P"


#: Stands for every tag behind a mark; numbers there are written as 0, so that contexts repeat.
TAG = "AA-0"


def _token_after(text: str, at: int) -> str:
    m = _NEXT_TOKEN.match(text, at)
    if not m:
        return ""
    token = m[1]
    k = kind_of(token)
    if k == "H":
        return token[:2]
    if k == "T":
        return token[:12]
    if k == "#":
        return TAG
    if k == "0":
        token = re.sub(r"\d+(?:[.,]\d+)*", "0", token)
    return re.sub(r"[.,;:!?।]+$", "", token) or token


def _before(text: str, at: int, start: int) -> str:
    """The token before a mark; numbers as 0 with the word before them, short words after a number with a 0."""
    head = text[max(start, at - 40) : at].rstrip()
    m = _TOKEN_BEFORE.search(head)
    if not m:
        return ")" if head[-1:] in _CLOSERS and head else ""
    token = m[0]
    last = kind_of(token[-1])
    if last == "H":
        return "H"
    if last == "T":
        return token[-8:]
    if _CODE.match(token):
        return "#"
    if last != "0" and len(token) > 4 or any("㐀" <= c <= "鿿" for c in token):
        return re.sub(r"\d+(?:[.,]\d+)*", "0", token)
    token = re.sub(r"\d+(?:[.,]\d+)*", "0", token)
    w = re.search(r"(\S+)\s+$", head[: m.start()])
    if token == "0":
        return f"{w[1]} 0" if w and w[1].isalpha() else "0"
    return f"0 {token}" if w and w[1][-1].isdigit() and not token[0].isdigit() else token


def blocks(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the line groups of a visible text; kind: run (to be split) or unit."""
    out, at = [], 0
    previous, in_list = "", False
    for line in text.split("\n"):
        start, end = at, at + len(line)
        at = end + 1
        said = line.strip()
        if not said:
            previous, in_list = "", False
            continue
        ended = not previous or previous[-1] in STRONG + STOPS + ELLIPSIS + ";:；：" or previous[-1] in _CLOSERS and len(previous) > 1 and previous[-2] in STRONG + STOPS + ELLIPSIS
        colon = previous.endswith((":", "："))
        plain_heading = out and out[-1][2] == "heading"
        ended = ended or bool(plain_heading)
        item = bool(_LIST.match(line)) and (ended or in_list) or bool(_LIST_BARE.match(line)) and (colon or in_list and ended)
        heading = not item and bool(_HEADING.match(line)) and said[-1] not in STRONG + STOPS + ";；,，:：" and len(said) <= 90 and ended
        if item:
            out.append((start, end, "item"))
            in_list = True
        elif heading:
            out.append((start, end, "heading"))
            in_list = False
        elif out and out[-1][2] == "item" and not ended:
            out[-1] = (out[-1][0], end, "item")
        elif out and out[-1][2] == "run" and not previous.endswith((":", "：")) and previous:
            out[-1] = (out[-1][0], end, "run")
        else:
            out.append((start, end, "run"))
            in_list = False
        previous = said
    return out


_MARKS = re.compile(f"[{re.escape(STRONG + ELLIPSIS)}]|\\.(?!\\d)")
_ALL_MARKS = re.compile(f"[{re.escape(STRONG + ELLIPSIS + STOPS)}]+")
_GAPS = re.compile(f"(?<=[{_UNSPACED}0-9A-Za-z.)])[ \\n](?=[{_UNSPACED}A-Z])")


def candidates(text: str, start: int, end: int) -> list[tuple[int, str, str, str, str]]:
    """(place behind the mark and closing signs, mark, token before, separator, token after) of a run of lines.

    Only candidates outside quotes and brackets come out, or right at the end of a quote; what follows the closing
    sign decides about those. A stop before a digit is no candidate.
    """
    said = text[start:end]
    inside = _inside(said) if _PAIRS.search(said) else None
    held = (lambda p: inside[p - start]) if inside else (lambda p: 0)
    out, done = [], start
    for m in _MARKS.finditer(text, start, end):
        i = m.start()
        if i < done:
            continue
        j = min(_ALL_MARKS.match(text, i).end(), end)
        if text[j - 1] == "." and text[j : j + 1].isdigit() and j - i > 1:
            j -= 1
        run = text[i:j]
        mark = "…" if ELLIPSIS in run or run.count(".") >= 3 else next((x for x in run if x in STRONG), ".")
        k = j
        if inside:
            spaced = re.compile(r"\s+[»”]").match(text, j, end)
            if spaced and held(i):
                k = spaced.end()
            while k < end and text[k] in _CLOSERS and (held(k - 1) or k > j):
                k += 1
        done = max(j, k)
        if (k < end and held(k)) or (held(i) and k == j):
            continue
        rest = text[k:end].lstrip(" \t")
        sep = "end" if not rest.strip() else "line" if rest[0] == "\n" else "space" if text[k].isspace() else "none"
        token = _before(text, i, start) if mark in ".…" else ""
        out.append((k, ("q" if k > j and held(i) else "") + mark, token, sep, _token_after(text, k) if sep != "end" else ""))
    if _THAI.search(said):
        for m in _GAPS.finditer(text, start, end):
            i = m.start()
            if not held(i) and (_THAI.match(text[i + 1]) or m[0] == "\n") and _THAI.search(text, max(start, i - 12), i):
                out.append((i, " ", _before(text, i, start), "line" if m[0] == "\n" else "space", _token_after(text, i)))
        out.sort()
    return out


def features(mark: str, before: str, sep: str, after: str) -> list[str]:
    """Names of the features of a candidate."""
    k, b = kind_of(after), before.lower()
    short = str(min(len(before), 5))
    last = kind_of(before[-1:]) if before else "E"
    out = [f"m{mark}", f"s{mark}{sep}", f"k{mark}{k}", f"sk{mark}{sep}{k}", f"l{mark}{last}{short}", f"lk{mark}{last}{k}"]
    if mark in (".", "…", " "):
        out += [f"b{mark}{b}", f"a{after.lower()[:12]}", f"d{'.' in before}{mark}", f"ba{mark}{b[-4:]}{k}"]
        if mark == " ":
            out += [f"t3{after[:3]}", f"t5{after[:5]}", f"e3{before[-3:]}"]
    else:
        out += [f"a{after.lower()[:12]}", f"aq{mark}{after[:1]}"]
    return out


def _index(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode()) % HASH for n in names]


_GOES_ON = re.compile(r"[,，、;；:：)）]|[a-zа-яёà-öø-ÿ]|と|という|って|の|を|が|は|に|で|も")


def label(mark: str, before: str, sep: str, after: str, share: float | None, seen: int) -> int | None:
    """1 for a reliable boundary, 0 for a reliable non-boundary, None where only the model can tell."""
    k = kind_of(after)
    if sep == "end":
        return 1
    if mark.startswith("q"):
        return 0 if _GOES_ON.match(after) and not (mark[1] in STRONG and k == "U") else 1 if sep == "line" or k in "U#" or mark[1] in STRONG else None
    if mark in STRONG:
        return 0 if k == "P" and after[:1] in ",，、;；" else 1
    if mark == "…":
        return 0 if k == "l" or after[:1] in "但而却不可仍,，" else 1 if sep == "line" and k != "l" else None
    if mark == ".":
        if sep == "none":
            return 1 if k in "HT" or k in "#U" and (before == "H" or any("㐀" <= c <= "鿿" for c in before)) else 0
        if share is not None and seen >= SEEN and share <= RARELY:
            return 0
        if k in "l0" and sep == "space":
            return 0
        if sep == "line":
            return 0 if k == "l" else 1
        if share is not None and seen >= SEEN and share >= OFTEN and k in "U#HTA":
            return 1
        return 1 if k in "U#" and len(before) >= 4 and before.isalpha() else None
    last = before[-1:]
    if not _THAI.match(last) and not last == ".":
        return 0
    return None


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        n: Counter = Counter()
        for text in batch["text"]:
            s, _ = visible(text)
            if re.search("[a-zа-я]{3}", s):
                for word in _PLAIN.findall(s):
                    n["word", word, "", ""] += 1
            for start, end, kind in blocks(s):
                if kind != "run":
                    continue
                got = candidates(s, start, end)
                for place, mark, before, sep, after in got:
                    n[mark, before, sep, after] += 1
                    # What follows a strong mark in a script without spaces shows how its sentences begin.
                    if _THAI.match(after[:1]) and mark in STRONG:
                        n[" ", "^", "start", after] += 1
                m = re.match(r"\s*", s[start:end])
                first = _token_after(s, start + m.end())
                if _THAI.match(first[:1]):
                    n[" ", "^", "start", first] += 1
        yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["mark", "before", "sep", "after", "n"])


def train(rows: pd.DataFrame, rounds: int = 150, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a maximum-entropy model on hashed features, by full-batch gradient steps with adaptive rates."""
    index = [_index(features(m, b, s if s != "start" else "space", a)) for m, b, s, a in zip(rows["mark"], rows["before"], rows["sep"], rows["after"], strict=True)]
    width = max(map(len, index), default=1)
    x = np.zeros((len(index), width), dtype=np.int64)
    mask = np.zeros((len(index), width), dtype=np.float64)
    for i, row in enumerate(index):
        x[i, : len(row)], mask[i, : len(row)] = row, 1
    y, w = rows["y"].to_numpy(dtype=float), np.log1p(rows["n"].to_numpy(dtype=float))
    weights, seen = np.zeros(HASH), np.full(HASH, 1e-8)
    for _ in range(rounds if len(index) else 0):
        p = 1 / (1 + np.exp(-np.clip((weights[x] * mask).sum(1), -30, 30)))
        grad = np.bincount(x.ravel(), ((p - y) * w)[:, None].repeat(width, 1).ravel() * mask.ravel(), minlength=HASH) / max(1.0, w.sum()) * 50 + decay * weights
        seen += grad * grad
        weights -= rate * grad / np.sqrt(seen)
    return weights.astype(np.float32)


@F.pandas_udf(T.IntegerType())
def _labels(mark: pd.Series, before: pd.Series, sep: pd.Series, after: pd.Series, seen: pd.Series, last: pd.Series, bare: pd.Series, as_unit: pd.Series) -> pd.Series:
    out = []
    for m, b, s, a, k, at_end, alone, unit in zip(mark, before, sep, after, seen.fillna(0), last.fillna(0), bare.fillna(0), as_unit.fillna(0), strict=True):
        lettered = re.search(r"[^\W\d_]", b) and not re.search(r"[/²³%‰°]", b)
        # A token seen without a stop more often than with one is no abbreviation, however rarely it ends a line.
        share = None if not k or at_end <= RARELY * k and (alone > k or not lettered) else at_end / k
        # A token that elsewhere follows numbers is a unit; named alone before a tag, it ends its sentence.
        ends = s == "start" or m == "." and s == "space" and kind_of(a) == "#" and unit >= 2
        out.append(1 if ends else label(m, b, s, a, share, int(k)))
    return pd.Series(out, dtype="Int32")


def labelled(texts: DataFrame) -> DataFrame:
    """``mark, before, sep, after, n, y``: the contexts of all candidates of ``texts`` (``text``) that tell their label reliably.

    Contexts, stops per token, tokens without stop and tokens behind numbers are counted over all texts and joined.
    """
    counts = texts.where("text is not null").select("text").mapInPandas(_contexts, "mark string, before string, sep string, after string, n bigint")
    counts = durable(counts.groupBy("mark", "before", "sep", "after").agg(F.sum("n").alias("n")))
    bare = counts.where("mark = 'word'").select("before", F.col("n").alias("bare"))
    contexts = counts.where("mark <> 'word'")
    stops = contexts.where("mark = '.' and sep <> 'none'").groupBy("before").agg(F.sum("n").alias("seen"), F.sum(F.when(F.col("sep").isin("line", "end"), F.col("n")).otherwise(0)).alias("last"))
    units = stops.where("before rlike '^0 ?[^ 0]'").groupBy(F.regexp_replace("before", "^0 ?", "").alias("before")).agg(F.sum("seen").alias("as_unit"))
    told = stops.join(bare, "before", "full").join(units, "before", "full")
    rows = salted_join(contexts, told, ["before"], F.concat("after", "sep", "mark"), "left")
    rows = rows.withColumn("y", _labels("mark", "before", "sep", "after", "seen", "last", "bare", "as_unit"))
    return rows.where("y is not null").select("mark", "before", "sep", "after", "n", "y")


def fit(texts: DataFrame, most: int = MAX_CONTEXTS) -> np.ndarray:
    """The model of all texts (``text``): contexts are counted and labelled over all of them, and at most ``most`` train it.

    The contexts that train are those whose hash lies below a bound, which a count of all labelled contexts sets; no
    more rows than that reach the driver.
    """
    rows = durable(labelled(texts))
    number = rows.count()
    if number > most:
        rows = rows.where(F.pmod(F.xxhash64("mark", "before", "sep", "after"), F.lit(1 << 30)) < F.lit(int((1 << 30) * 0.98 * most / number)))
    return train(rows.toPandas().sort_values(["mark", "before", "sep", "after"]).head(most))


def spans(text: str, weights: np.ndarray, known: dict | None = None) -> list[tuple[int, int]]:
    """(first, behind last) character of every sentence of a text; ``known`` keeps verdicts on contexts seen before."""
    known = {} if known is None else known
    s, at = visible(text)
    cuts: list[tuple[int, int]] = []
    for start, end, kind in blocks(s):
        here = start
        if kind == "run":
            for place, mark, before, sep, after in candidates(s, start, end):
                if sep == "end":
                    continue
                if mark.startswith("q") and _GOES_ON.match(after) and not (mark[1] in STRONG and kind_of(after) == "U"):
                    continue
                if mark[0] in STRONG and after[:1] in ",，、;；":
                    continue
                context = (mark, before, sep, after)
                if context not in known:
                    score = float(weights[_index(features(*context))].sum())
                    known[context] = score > 0 or score == 0 and mark[-1] in STRONG
                if known[context]:
                    cuts.append((here, place))
                    here = place
        cuts.append((here, end))
    out = []
    for a, b in cuts:
        while a < b and s[a].isspace():
            a += 1
        while b > a and s[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((at[a], at[b - 1] + 1))
    return out


def sentences(df: DataFrame, keys: list[str], weights: np.ndarray | None = None) -> DataFrame:
    """``keys, start_char, end_char`` of every sentence of ``df`` (``keys, text``).

    Null texts and texts without visible characters have no sentence; repeated rows count once. Without ``weights``
    the model is trained on ``df`` itself.
    """
    rows = df.where("text is not null").select(*keys, "text").dropDuplicates(keys)
    model = fit(rows) if weights is None else weights

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            found = [spans(t, model, known) for t in batch["text"]]
            rows = batch[keys].loc[batch.index.repeat([len(f) for f in found])].reset_index(drop=True)
            flat = [x for f in found for x in f]
            rows["start_char"], rows["end_char"] = [a for a, _ in flat], [b for _, b in flat]
            yield rows

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    return rows.mapInPandas(cut, f"{fields}, start_char int, end_char int")
