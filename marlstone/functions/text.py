"""Words, stems, CJK n-grams and term hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------- words

# Fixed values of the word rules: separators inside a word, inside a number, and characters that count as none.
_INFIX = "'&\u00b7\u05f4\u2027"
_DIGIT_INFIX = ",.;\u037e\u0589\u060d\u07f8\u2044\ufe10\ufe13\ufe14"
_APOSTROPHES = "\u2019\u201b"
_IGNORED = "\u200b\u200c\u200d\u2060\ufeff"

#: A word: letters, marks and digits, joined by a separator of words or, between two digits, of numbers; up to
#: three + or # may follow. Java and Python read it alike.
WORD = (
    r"(?:[\p{L}\p{N}\p{M}_]+(?:(?:(?<=\p{Nd})[" + _DIGIT_INFIX + r"](?=\p{Nd})|(?<!\p{Nd})[" + _INFIX + r"]|[" + _INFIX + r"](?!\p{Nd}))[\p{L}\p{N}\p{M}_]+)*)"
    r"(?:[+#]{1,3}(?![+#\p{L}\p{N}\p{M}_]))?"
)
_FOLD = str.maketrans(_APOSTROPHES, "''", _IGNORED)
#: For plain Latin columns, where other engines must cut alike.
ASCII_WORD = "[a-z0-9]+"
_WORD = regex.compile(WORD)


def words(text: Column, pattern: str = WORD) -> Column:
    """The lower-cased words of a text in order; empty for null."""
    text = F.translate(text, _APOSTROPHES + _IGNORED, "''") if pattern == WORD else text
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(f"({pattern})"), F.lit(1)), F.array().cast("array<string>"))


def words_of(text: str, pattern: str = WORD, lower: bool = True) -> list[str]:
    """The same on the driver."""
    text = text.translate(_FOLD) if pattern == WORD else text
    return regex.findall(f"(?:{pattern})", text.lower() if lower else text, flags=0 if lower else regex.IGNORECASE)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has_phrase(tokens: Column, phrase: list[str]) -> Column:
    """Whether the words stand next to each other in this order; words hold no spaces."""
    if not phrase:
        return F.lit(False)
    return F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")).contains(f" {' '.join(phrase)} ")


def has_near(tokens: Column, group: list[str], window: int) -> Column:
    """Whether all words stand in some run of ``window`` words; such a run can start at one of them."""
    if not group:
        return F.lit(False)
    want = F.array(*[F.lit(w) for w in dict.fromkeys(group)])

    def starts(t: Column, i: Column) -> Column:
        return F.array_contains(want, F.get(t, i - 1)) & (F.size(F.array_intersect(F.slice(t, i, window), want)) == F.size(want))

    return let(
        tokens,
        lambda t: F.forall(want, lambda w: F.array_contains(t, w)) & F.exists(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(t))), lambda i: starts(t, i)),
    )


# ---------------------------------------------------------------- English stems (Porter, "Snowball: English")

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", **{w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")},
}
_KEPT = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [
    ("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"), ("biliti", "ble"), ("lessli", "less"), ("tional", "tion"),
    ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"), ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"),
    ("anci", "ance"), ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("ogi", None), ("li", None),
]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("ative", None), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split(), key=len, reverse=True)


def _region(w: str, start: int) -> int:
    m = re.compile(rf"[{_V}][^{_V}]").search(w, start)
    return m.end() if m else len(w)


def _short_end(w: str) -> bool:
    return bool(re.search(rf"[^{_V}][{_V}][^{_V}wxY]$", w) or re.fullmatch(rf"[{_V}][^{_V}]", w))


@lru_cache(maxsize=100_000)
def stem_english(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) <= 2:
        return word
    w = word.removeprefix("'")
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = re.sub(rf"(^|[{_V}])y", r"\1Y", w)
    head = re.match("gener|commun|arsen", w)
    r1 = head.end() if head else _region(w, 0)
    r2 = _region(w, r1)
    w = re.sub(r"('s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    m = re.search("(eedly|ingly|edly|eed|ing|ed)$", w)
    if m and m[0] in ("eed", "eedly"):
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    elif m and re.search(f"[{_V}]", w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for suffix, new in _STEP2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1:
                if suffix == "ogi":
                    w = w[:-1] if w[:at].endswith("l") else w
                elif suffix == "li":
                    w = w[:at] if w[at - 1 : at] in tuple("cdeghkmnrt") else w
                else:
                    w = w[:at] + new
            break
    for suffix, new in _STEP3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (new is not None or at >= r2):
                w = w[:at] + (new or "")
            break
    for suffix in _STEP4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[:at].endswith(("s", "t"))):
                w = w[:at]
            break
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@F.pandas_udf(T.ArrayType(T.StringType()))
def stems(tokens: pd.Series) -> pd.Series:
    """The English stems of arrays of lower-case words, in order."""
    return tokens.map(lambda ws: None if ws is None else [stem_english(w) for w in ws])


# ---------------------------------------------------------------- CJK

_CJK = re.compile(
    "[\u2e80-\u2eff\u3000-\u30ff\u3100-\u31ff\u3200-\u4dff\u4e00-\u9fff\ua700-\ua71f\uac00-\ud7af\uf900-\ufaff\ufe30-\ufe4f\uff00-\uffef\U00020000-\U0002a6df\U0002f800-\U0002fa1f]"
)


def is_cjk(char: str) -> bool:
    return bool(_CJK.match(char))


def cjk_words(text: str) -> list[tuple[str, int]]:
    """Terms with positions: at a CJK character it alone and with the next one, at one position; other
    runs end at a space or at a CJK character, and the character that ends a run is used up. Terms of 32
    bytes or more are left out."""
    out, i, pos = [], 0, 0
    while i < len(text):
        pos += 1
        if is_cjk(text[i]):
            grams = [text[i]]
            if i + 1 < len(text) and is_cjk(text[i + 1]):
                grams.append(text[i : i + 2])
            i += 1
        else:
            j = i
            while j < len(text) and text[j] != " " and not is_cjk(text[j]):
                j += 1
            grams, i = [text[i:j]] if j > i else [], j + 1
        out += [(g.lower(), pos) for g in grams if len(g.encode()) < 32]
    return out


_TERM = T.ArrayType(
    T.StructType([T.StructField("term", T.StringType()), T.StructField("wdf", T.IntegerType()), T.StructField("positions", T.ArrayType(T.IntegerType()))])
)


def _terms(values, cjk: bool) -> list[dict]:
    found: dict[str, list[int]] = {}
    for v in values if values is not None else []:
        pairs = cjk_words(v) if cjk else [(w, i) for i, w in enumerate(_WORD.findall(v.translate(_FOLD).lower()), 1)]
        for term, pos in pairs:
            found.setdefault(term, []).append(pos)
    return [{"term": t, "wdf": len(p), "positions": sorted(set(p))} for t, p in sorted(found.items(), key=lambda x: x[0].encode())]


@F.pandas_udf(_TERM)
def text_terms(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Terms of arrays of texts; each value's positions start at 1."""
    for v in values:
        yield v.map(lambda x: _terms(x, False))


@F.pandas_udf(_TERM)
def cjk_terms(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield v.map(lambda x: _terms(x, True))


# ---------------------------------------------------------------- hashes and escapes


def _rolled(data: Column) -> Column:
    """A 32-bit hash of bytes: each step is 33 times the last one plus a byte, from 1."""
    byte = lambda i: F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(data)), F.lit(1).cast("long"), lambda h, i: (h * 33 + byte(i)).bitwiseAND(F.lit(0xFFFFFFFF)))


def hashed_term(term: Column, most: int) -> Column:
    """A term of more than ``most`` bytes keeps its first most - 6 bytes; the rest becomes 6 characters."""
    keep = most - 6 if most >= 6 else 0
    data = F.encode(term, "UTF-8")
    h = _rolled(F.substring(data, F.lit(keep + 1), F.octet_length(data)))
    part = lambda x, j: F.when(F.shiftright(x, 6 * j) > 0, F.chr(F.shiftright(x, 6 * j).bitwiseAND(F.lit(63)) + 33)).otherwise(" ")
    short = F.concat(F.decode(F.substring(data, F.lit(1), F.lit(keep)), "UTF-8"), let(h, lambda x: F.concat(*[part(x, j) for j in range(6)])))
    return F.when(F.octet_length(term) > most, short).otherwise(term)


def cut_term(term: Column, most: int) -> Column:
    """The first ``most`` bytes."""
    return F.when(F.octet_length(term) > most, F.decode(F.substring(F.encode(term, "UTF-8"), F.lit(1), F.lit(most)), "UTF-8")).otherwise(term)


def slot_number(name: str) -> int | None:
    """The number of a named slot; none for an empty name."""
    h = 1
    for b in name.encode():
        h = (h * 33 + b) & 0xFFFFFFFF
    return 0x10000000 + (h & 0xEFFFFFFF) if name else None


def hexed(text: str) -> str:
    """Bytes other than plain printable ones, and backslashes, as \\xHH."""
    return "".join(chr(b) if 0x20 <= b < 0x7F and b != 0x5C else f"\\x{b:02x}" for b in text.encode())


def truth(text: str | None) -> bool:
    """Whether a URL argument says yes."""
    return (text or "").lower() in ("1", "true", "yes", "on")
