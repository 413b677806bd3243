"""Reading quantities out of text: numbers, units and ranges in the notations of nine languages."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache
from typing import NamedTuple

# Spellings of units by dimension, with the factor to the common unit of the dimension
# (length µm, pressure Pa, time s, mass g, force N, slope µm/m, pressure_rate Pa/h, share parts per million).
_INCH, _FOOT, _LB, _KGF = "25400", "304800", "453.59237", "9.80665"
_PSI, _AT = "6894.757293168361", "98066.5"
SPELLINGS: dict[str, dict[str, str]] = {
    "length": {
        "1": "μm|µm|um|мкм|微米|micron|microns|micrometre|micrometres|micrometer|micrometers|Mikrometer|micromètre|micromètres|マイクロメートル|ミクロン|микрон|микрона|микронов|микрометр|микрометра|микрометров|माइक्रोमीटर|ไมครอน|ไมโครเมตร|ميكرومتر|ميكرون",
        "1000": "mm|MM|Mm|мм|毫米|millimetre|millimetres|millimeter|millimeters|Millimeter|millimètre|millimètres|ミリメートル|ミリ|миллиметр|миллиметра|миллиметров|मिमी|मि.मी.|मिलीमीटर|มม.|มม|มิลลิเมตร|مم|ملم|مليمتر",
        "10000": "cm|CM|см|厘米|公分|centimetre|centimetres|centimeter|centimeters|Zentimeter|centimètre|centimètres|センチメートル|センチ|сантиметр|сантиметра|сантиметров|सेमी|सेंटीमीटर|ซม.|ซม|เซนติเมตร|سم|سنتيمتر",
        "100000": "dm|дм|分米|Dezimeter|décimètre|décimètres",
        "1000000": "m|M|м|米|metre|metres|meter|meters|Meter|Metern|mètre|mètres|メートル|метр|метра|метров|मीटर|เมตร|ม.|م|متر",
        "1000000000": "km|км|千米|公里|kilometre|kilometres|kilometer|kilometers|Kilometer|kilomètre|kilomètres|キロメートル",
        _INCH: 'in|inch|inches|Zoll|英寸|吋|インチ|pouce|pouces|дюйм|дюйма|дюймов|इंच|นิ้ว|بوصة|"|″|in.',
        _FOOT: "ft|foot|feet|英尺|Fuß|pied|pieds|フィート|фут|фута|футов",
    },
    "pressure": {
        "1": "Pa|Па|帕斯卡|帕|pascal|pascals|Pascal|パスカル|паскаль|паскалей|पास्कल|ปาสกาล|باسكال",
        "100": "hPa|гПа|百帕|mbar|мбар|毫巴|ヘクトパスカル",
        "1000": "kPa|KPa|Kpa|KPA|кПа|千帕|kilopascal|kilopascals|Kilopascal|キロパスカル|килопаскаль|килопаскалей",
        "1000000": "MPa|Mpa|MPA|МПа|兆帕|megapascal|megapascals|Megapascal|mégapascal|mégapascals|メガパスカル|мегапаскаль|мегапаскалей",
        "100000": "bar|Bar|bars|бар|巴|バール",
        _AT: "kgf/cm2|kgf/cm^2|кгс/см2|公斤力/平方厘米|千克力/平方厘米|公斤/平方厘米|kg/cm2|at|公斤力每平方厘米|千克力每平方厘米",
        "101325": "atm|атм|标准大气压|大气压",
        _PSI: "psi|PSI|lbf/in2|lbf/in^2|lb/in2|磅/平方英寸|磅力/平方英寸|磅每平方英寸",
    },
    "time": {
        "1": "s|S|sec|secs|с|сек|秒|秒钟|second|seconds|Sekunde|Sekunden|seconde|secondes|секунда|секунды|секунд|सेकंड|วินาที|ثانية|ثوان",
        "0.001": "ms|мс|毫秒|millisecond|milliseconds",
        "60": "min|mins|мин|分|分钟|分間|minute|minutes|Minute|Minuten|минута|минуты|минут|मिनट|นาที|دقيقة|دقائق|min.",
        "3600": "h|H|hr|hrs|ч|小时|个小时|時間|hour|hours|Std|Std.|Stunde|Stunden|heure|heures|час|часа|часов|घंटे|घंटा|ชั่วโมง|ساعة|ساعات|钟头|个钟头",
        "86400": "d|D|天|日|昼夜|日間|day|days|Tag|Tage|Tagen|jour|jours|день|дня|дней|сут|сутки|суток|दिन|วัน|يوم|أيام",
        "604800": "周|星期|week|weeks|Woche|Wochen|semaine|semaines|週間|неделя|недели|недель",
    },
    "mass": {
        "1": "g|г|克|gram|grams|gramme|grammes|Gramm|グラム|грамм|грамма|граммов|ग्राम|กรัม|غرام|جرام",
        "0.001": "mg|мг|毫克|milligram|milligrams|Milligramm|milligramme|milligrammes|ミリグラム",
        "1000": "kg|KG|Kg|кг|千克|公斤|kilogram|kilograms|kilogramme|kilogrammes|Kilogramm|キログラム|キロ|килограмм|килограмма|килограммов|किग्रा|किलोग्राम|กก.|กก|กิโลกรัม|كغم|كجم|كيلوغرام",
        "1000000": "t|T|т|吨|公吨|tonne|tonnes|ton|tons|Tonne|Tonnen|トン|тонна|тонны|тонн|टन|ตัน|طن",
        _LB: "lb|lbs|磅|pound|pounds|Pfund|livre|livres|ポンド|фунт|фунта|фунтов",
    },
    "force": {
        "1": "N|Н|牛|牛顿|newton|newtons|Newton|ニュートン|ньютон|ньютона|ньютонов|न्यूटन|นิวตัน|نيوتن",
        "1000": "kN|KN|кН|千牛|千牛顿|kilonewton|kilonewtons|Kilonewton|キロニュートン|килоньютон|килоньютона|килоньютонов",
        "1000000": "MN|МН|兆牛",
        _KGF: "kgf|кгс|公斤力|千克力|kp|重量キログラム",
        "9806.65": "tf|тс|吨力",
        "4.4482216152605": "lbf|磅力",
    },
    "slope": {
        "1": "μm/m|µm/m|um/m|мкм/м|微米/米|微米每米",
        "1000": "mm/m|MM/m|мм/м|毫米/米|毫米每米|millimetres per metre|millimeters per meter|Millimeter pro Meter|millimètres par mètre|mm pro m|mm par m|mm per m",
        "10000": "cm/m|см/м|厘米/米|厘米每米|centimetres per metre|centimeters per meter|Zentimeter pro Meter|centimètres par mètre",
        "1000000": "m/m|м/м|米/米|米每米|metres per metre|meters per meter|Meter pro Meter|mètres par mètre|mm/mm",
        "83333.333333333333333": "in/ft",
    },
    "pressure_rate": {
        "1": "Pa/h|Па/ч|帕/小时|帕每小时|pascals per hour|Pascal pro Stunde|pascals par heure",
        "60": "Pa/min|Па/мин|帕/分|帕/分钟|帕每分钟",
        "3600": "Pa/s|Па/с|帕/秒|帕每秒",
        "1000": "kPa/h|KPa/h|кПа/ч|千帕/小时|千帕每小时|kilopascals per hour|Kilopascal pro Stunde",
        "60000": "kPa/min|KPa/min|кПа/мин|千帕/分|千帕/分钟|千帕每分钟|千帕每分",
        "3600000": "kPa/s|кПа/с|千帕/秒|千帕每秒",
        "1000000": "MPa/h|МПа/ч|兆帕/小时|兆帕每小时|megapascals per hour|Megapascal pro Stunde",
        "60000000": "MPa/min|МПа/мин|兆帕/分|兆帕/分钟|兆帕每分钟",
        "100000": "bar/h|бар/ч|巴/小时|巴每小时",
        "6000000": "bar/min|бар/мин|巴/分钟|巴每分钟",
    },
    "share": {
        "10000": "%|percent|per cent|Prozent|pour cent|процент|процента|процентов|パーセント|प्रतिशत|เปอร์เซ็นต์|بالمئة|pct|٪|百分比|百分数",
        "1000": "‰|per mille|per mil|Promille|pour mille|промилле|パーミル|permille|千分比",
        "1": "ppm|百万分之一",
    },
    "temperature": {
        "C": "°C|℃|°С|摄氏度|度(摄氏)|度|degrees Celsius|degree Celsius|degrees C|deg C|Grad Celsius|Grad C|degrés Celsius|degré Celsius|градус Цельсия|градуса Цельсия|градусов Цельсия|градусов|град. C|度C|डिग्री सेल्सियस|องศาเซลเซียส|درجة مئوية|摂氏度",
        "F": "°F|℉|华氏度|度(华氏)|degrees Fahrenheit|degree Fahrenheit|deg F|degrees F|Grad Fahrenheit|degrés Fahrenheit|градусов Фаренгейта|華氏度",
        "K": "K|К|开尔文|开|kelvin|kelvins|Kelvin|ケルビン|кельвин|кельвинов",
    },
}
COMMON_UNIT = {"length": "µm", "pressure": "Pa", "time": "s", "mass": "g", "force": "N", "slope": "µm/m", "pressure_rate": "Pa/h", "share": "ppm", "temperature": "m°C"}
# Words that name a unit for values elsewhere in the text, around the unit.
_HEADER_BEFORE = (
    "单位均为|单位为|单位：|单位:|单位是|单位|均以|以|単位は|単位：|単位:|数値は|Angaben in|Werte in|Alle Werte in|Angabe in|Einheit|Valeurs en|valeurs en|Unité|exprimées en|"
    "are in|given in|expressed in|readings in|Readings in|values in|Values in|unit is|Unit|units of|Значения в|значения в|даны в|указаны в|Единицы|Единица|в единицах|Данные в|Величины в"
)
_RANGE_WORDS = "~|～|〜|–|—|-|‐|−|至|到|から|to|and|bis|und|à|et|до|и|से|ถึง|إلى"
_SIDES = re.compile(r"左侧|右侧|左边|右边|左|右|links|rechts|left|right|gauche|droite|слева|справа")
# Chinese numerals.
_HAN_DIGIT = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
_HAN_TEN = {"十": 10, "百": 100, "千": 1000}
# Marks and letters that are no unit behind a Chinese numeral, and units that a one-character numeral makes another word with.
_HAN_NO_UNIT = ('"', "″", "in", "C", "F")
_HAN_PAIRS = {"度": "一两", "分": "零〇一二两三四五六七八九十百千半", "开": "零〇一二两三四五六七八九十百千半"}

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")


class Quantity(NamedTuple):
    """One value of a text; unit and dimension are None where the text names none.

    ``named`` tells that the unit does not stand with the value but is named by another sentence.
    """

    dimension: str | None
    unit: str | None
    value: Decimal
    phrase: str
    start: int
    named: bool = False


@lru_cache(maxsize=1)
def units() -> dict[str, tuple[str, str]]:
    """Spelling (NFKC) to (dimension, factor to the common unit or temperature scale)."""
    out: dict[str, tuple[str, str]] = {}
    for dimension, by_factor in SPELLINGS.items():
        for factor, names in by_factor.items():
            for name in names.split("|"):
                out.setdefault(unicodedata.normalize("NFKC", name), (dimension, factor))
    return out


@lru_cache(maxsize=1)
def _usual() -> dict[tuple[str, str], str]:
    return {(d, f): unicodedata.normalize("NFKC", names.split("|")[0]) for d, by_factor in SPELLINGS.items() for f, names in by_factor.items()}


def usual(unit: str) -> str:
    """The first spelling that the table gives for a unit; unknown units stay as they are."""
    return _usual()[units()[unit]] if unit in units() else unit


def to_common(value: Decimal, unit: str) -> tuple[str, Decimal]:
    """Dimension and value in its common unit."""
    dimension, factor = units()[unit]
    if dimension != "temperature":
        return dimension, value * Decimal(factor)
    celsius = value if factor == "C" else (value - 32) * 5 / 9 if factor == "F" else value - Decimal("273.15")
    return dimension, celsius * 1000


def rounded(value: Decimal) -> int:
    """Whole number, halves away from zero."""
    return int(value.quantize(Decimal(1), rounding=ROUND_HALF_UP))


def plain(text: str) -> str:
    """Width and compatibility forms resolved, invisible characters removed; exponents after a ten written with ^."""
    text = re.sub("10([⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+)", lambda m: "10^" + m[1].translate(_SUPER), _INVISIBLE.sub("", text))
    return unicodedata.normalize("NFKC", text)


@lru_cache(maxsize=1)
def _patterns() -> dict[str, re.Pattern]:
    letters = r"A-Za-zÀ-ÖØ-öø-ɏͰ-ϿЀ-ӿ"
    names = sorted(units(), key=len, reverse=True)
    spaced = "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in names)
    guard = rf"(?:(?<=[{letters}])(?![{letters}\d_^²³]|\s?[/·*^]\s?[{letters}一-鿿]|[-−]\d(?!\d|[.,]\d|\s?[{letters}一-鿿]))|(?<=[^{letters}])(?![/·^]))"
    unit = rf"(?:{spaced}){guard}(?!方|方米|/秒|/s\b|每秒)"
    exp = r"(?:[eE][+-]?\d+(?![\d.])|\s?[×xX*·]\s?10\^[+-]?\d+)?"
    point = rf"(?:\d{{1,3}}(?:,\d{{3}})+(?![\d])(?:\.\d+)?|\d{{1,3}}(?: \d{{3}})+(?!\d)(?:\.\d+)?|\d+(?:\.\d+)?|\.\d+){exp}"
    comma = rf"(?:\d{{1,3}}(?:[. ]\d{{3}})+(?!\d)(?:,\d+)?|\d+(?:,\d+)?|,\d+){exp}"
    head = r"(?P<pre>零下|负|minus |moins |минус |マイナス)?(?P<sign>[±+]|\+/-|[-−–](?=[\d.,]))?\s?"
    one, part = "[零〇一二两三四五六七八九]", "(?:点[零〇一二三四五六七八九]+)?"
    below = rf"(?:{one}?千(?:零?{one}百)?(?:零?{one}?十)?(?:零?{one})?|{one}?百(?:零?{one}?十)?(?:零?{one})?|{one}?十{one}?|{one}+)"
    han = rf"(?<![第零〇一二两三四五六七八九十百千万亿])(?P<han>(?:{below}万零?)?{below}{part}(?=\s?(?:{unit}))|{below}万(?=\s?(?:{unit}))|(?<![个前后上下大多])半(?=\s?(?:{unit}))|[零〇一二两三四五六七八九十百千]+{part})"
    out = {"unit": re.compile(unit)}
    for key, number in (("point", point), ("comma", comma)):
        out[key] = re.compile(rf"(?P<per>百分之|千分之)?{head}(?<![\d.,])(?P<num>{number})(?:\s?(?P<unit>{unit}))?")
    out["han"] = re.compile(rf"(?P<per>百分之|千分之)?(?P<pre>零下|负)?(?![百千]分之){han}(?:\s?(?P<unit>{unit}))?")
    out["mask"] = re.compile(
        r"[A-Za-zА-Яа-я]{1,6}/[A-Z]\s?\d+(?:\.\d+)*|[A-Z]{2,}(?:/[A-Z]+)?[-‐‑ ]?\d{3,}(?:[.-]\d+)*|\d+(?:\.\d+){2,}|第\s?\d+"
        r"|\b(?:clause|stage|item|No\.|Nr\.|Fig\.|Abb\.|Sec\.|step)\s?\d+(?:\.\d+)*|(?:图|表|条)\s?\d+(?:\.\d+)*"
    )
    out["header"] = re.compile(rf"(?:{_HEADER_BEFORE})\s?[:：]?\s?(?P<unit>{unit})")
    out["range"] = re.compile(rf"\s?(?:{_RANGE_WORDS})\s?")
    out["sentence"] = re.compile(r"[^。！？!?\n।؟]*?(?:[。！？!?\n।؟]+|\.(?=\s)|\.$|$)", re.S)
    return out


# Common words of languages that write a decimal comma (German, French) and of English, which writes a point.
_COMMA_WORDS = frozenset(
    "der die das den dem ein eine einer einem und oder für bei von mit nicht auf im zu zum zur ist sind wird werden bis nach laut über unter zwischen gilt"
    " le la les du de une et ou est sont pour dans sur par avec selon entre au aux à".split()
)
_POINT_WORDS = frozenset("the of and or shall must is are was were at from between with by not in to for be on it this that".split())
_POINT_SCRIPTS = re.compile(r"[一-鿿぀-ヿऀ-ॿ฀-๿؀-ۿ]")
_CYRILLIC = re.compile(r"[А-яЁё]{2}")
_LETTERS = re.compile(r"[^\W\d_]+")
#: Number of hashed words of a style model, and what a word, an accent and a separator of the text itself weigh.
STYLE_SIZE = 1 << 16
_WORD, _OWN = 1.0, 6.0
#: Separators that tell the decimal mark: one or two digits behind a comma (a point), or a mark of each kind.
COMMA_MARK = r"\d,\d{1,2}(?!\d)|\d,\d{4,}|\d[.]\d{3},\d"
POINT_MARK = r"\d[.]\d{1,2}(?![\d.])|\d[.]\d{4,}(?![\d.])|\d,\d{3}[.]\d"
_COMMA_MARK, _POINT_MARK = re.compile(COMMA_MARK), re.compile(POINT_MARK)


def style_bucket(word: str) -> int:
    """Place of a lower-case word in a style model (CRC-32, as the engine's own function gives it)."""
    return zlib.crc32(word.encode()) % STYLE_SIZE


def decimal_style(text: str, weights: Sequence[float] | None = None) -> str:
    """``comma`` or ``point``: the decimal mark of the language of a text.

    Scripts decide first (Cyrillic writes a comma; Chinese, Japanese, Hindi, Thai and Arabic a point). Texts in Latin
    letters are decided by the separators that tell it themselves, by common words, and by ``weights``, the log odds
    of words beside a comma learned from a corpus (``operators/units.py``). Without any sign it is ``point``.
    """
    if _POINT_SCRIPTS.search(text):
        return "point"
    if _CYRILLIC.search(text):
        return "comma"
    score = _OWN * (bool(_COMMA_MARK.search(text)) - bool(_POINT_MARK.search(text)))
    for word in {w.lower() for w in _LETTERS.findall(text)}:
        score += _WORD * ((word in _COMMA_WORDS or not word.isascii()) - (word in _POINT_WORDS))
        if weights is not None:
            score += float(weights[style_bucket(word)])
    return "comma" if score > 0 else "point"


def _number(text: str, style: str) -> Decimal:
    mantissa, _, power = re.sub(r"\s?[×xX*·]\s?10\^", "e", text).replace("E", "e").partition("e")
    mantissa = mantissa.replace(" ", "")
    mantissa = mantissa.replace(",", "") if style == "point" else mantissa.replace(".", "").replace(",", ".")
    return Decimal(mantissa + (f"e{power}" if power else ""))


def _han_number(text: str) -> Decimal:
    if text == "半":
        return Decimal("0.5")
    whole, _, part = text.partition("点")
    many, mark, whole = whole.rpartition("万")
    if mark:
        return _han_number(many) * 10000 + _han_number(f"{whole or '零'}{'点' if part else ''}{part}")
    if not any(c in _HAN_TEN for c in whole):
        total = int("".join(str(_HAN_DIGIT[c]) for c in whole))
    else:
        total, digit = 0, None
        for c in whole:
            if c in _HAN_DIGIT:
                digit = _HAN_DIGIT[c]
            else:
                total, digit = total + (1 if digit is None else digit) * _HAN_TEN[c], None
        total += digit or 0
    return Decimal(f"{total}.{''.join(str(_HAN_DIGIT[c]) for c in part)}" if part else total)


def _han_unit(han: str, unit: str, after: str) -> bool:
    """Whether a unit behind a Chinese numeral is one, and not part of another word (一度, 十分, 三分之一, 千帕)."""
    if unit in _HAN_NO_UNIT or han in _HAN_PAIRS.get(unit, "") or unit == "分" and after[:1] == "之":
        return False
    return units()[unit][0] == "time" or han not in ("百", "千")


_TAGS = re.compile("\u0001+|[A-Z]{1,8}[-‐‑]\\d+")
# Words that may follow a value without counting something by it.
_AFTER = re.compile(r"\s?(?:[,，、;；.。!！?？)）:：]|$|(?:on|at|in|to|and|or|und|oder|bis|et|ou|à|au|и|или|до|на|в)\s|(?:справа|слева|rechts|links|right|left)|[和与及至到でと])")


def read_quantities(text: str, weights: Sequence[float] | None = None) -> list[Quantity]:
    """Every quantity of a text in order of place.

    A unit named by a sentence without values of its own holds for the values without unit after it, until another
    sentence names one; values before the first such sentence take its unit (``named`` is true for all of these). In a
    range, the first value takes the unit of the second. Other values without any unit come out with unit None if no
    counted thing follows and words stand before them. Clause, standard and tag numbers, areas, volumes, speeds,
    frequencies and counts do not come out. ``weights`` is the model of ``decimal_style``.
    """
    text, p = plain(text), _patterns()
    style = decimal_style(text, weights)
    text = p["mask"].sub(lambda m: "\u0001" * len(m[0]), text)
    out: list[Quantity] = []
    header, first_header = None, None
    open_: list[int] = []
    for sentence in p["sentence"].finditer(text):
        said, base = sentence[0], sentence.start()
        if not said.strip():
            continue
        got: list[list] = []
        for m in p[style].finditer(said):
            got.append([m, m["unit"], _number(m["num"], style)])
        for m in p["han"].finditer(said):
            if m["per"] or m["unit"] and _han_unit(m["han"], m["unit"], said[m.end() :]):
                got.append([m, m["unit"], _han_number(m["han"])])
            elif not m["unit"] and (joint := p["range"].match(said, m.end())) and (end := p["han"].match(said, joint.end())) and end["unit"] and _han_unit(end["han"], end["unit"], said[end.end() :]):
                got.append([m, end["unit"], _han_number(m["han"])])
        got.sort(key=lambda g: g[0].start())
        naming = p["header"].search(said)
        if naming and not any(u for _, u, _ in got):
            header = naming["unit"]
            first_header = first_header or header
            got = [g for g in got if g[0].start() > naming.end()]
            if not got:
                continue
        sides = bool(_SIDES.search(said))
        for i, (m, unit, value) in enumerate(got):
            per = m["per"]
            if per:
                unit = "%" if per == "百分之" else "‰"
            ahead = got[i + 1] if i + 1 < len(got) else None
            between = said[m.end() : ahead[0].start()] if ahead else ""
            if unit is None and ahead and not ahead[0]["per"]:
                first = ahead[0]
                joint = between + (first["sign"] or "" if "sign" in first.groupdict() else "")
                if p["range"].fullmatch(joint) and joint.strip() and ahead[1]:
                    unit = ahead[1]
            if "sign" in m.groupdict() and m["sign"] in ("-", "−", "–") and i and not said[got[i - 1][0].end() : m.start()].strip():
                sign = 1
            else:
                minus = bool(m["pre"]) or ("sign" in m.groupdict() and m["sign"] in ("-", "−", "–"))
                sign = -1 if minus else 1
            phrase = re.sub(r"[^\w]|\d", "", _SIDES.sub("", _TAGS.split(said[: m.start()])[-1])).lower()
            if unit is not None:
                out.append(Quantity(units()[unit][0], unit, sign * value, phrase, base + m.start()))
                continue
            beside = not sides or _SIDES.search(said[max(0, m.start() - 14) : m.end() + 16])
            first = m.start("sign") if m.groupdict().get("sign") else m.start("num" if "num" in m.groupdict() else "han")
            if first and re.match(r"[A-Za-zÀ-ɏͰ-ӿ^]", said[first - 1]):
                continue
            ahead_of = said[: m.start()].strip()
            if _AFTER.match(said[m.end() :]) and beside and ahead_of and (header or phrase) and not ahead_of.endswith("\u0001"):
                if not header:
                    open_.append(len(out))
                out.append(Quantity(units()[header][0] if header else None, header, sign * value, phrase, base + m.start(), bool(header)))
    if first_header:
        for k in open_:
            out[k] = out[k]._replace(dimension=units()[first_header][0], unit=first_header, named=True)
    return out
