"""PII replaced by keyed surrogates of the same type, format, script and gender.

Entities: e-mail addresses, phone, card, social security and bank account numbers, IPv4 addresses,
credentials (cloud key ids, values of password, secret, token or API key fields) and names: after a title or a "name" label, or a
listed first name with a capitalised word behind it,
with the other mentions of a full name in the same text.
A surrogate is made from the entity's canonical form and gets the mention's separators and case after it.
It is an encryption that keeps the format: a Feistel network numbers all entities of a shape anew, and the one that
follows in the new order is the surrogate, so each type and shape is permuted in a single cycle. The
same entity gets the same surrogate wherever it stands, two entities never share one, and none is its own, with
no table of entities to hold or to shuffle. Letters stay vowels or consonants of their script and case, digits
digits; an IPv4 address stays public, in its private range, or neither, a card or account number as valid as it was; a
listed first name comes from names of the same gender and script. A surrogate that fails its type's test is walked on
along the cycle. Entities of which no character can be replaced (``+@example.com``) get keyed letters or digits
of their type.

Checks: within a text, a surrogate that another entity of the type already has is walked on until it is free
(by construction none is; the check makes the result safe, and never fails). ``collisions`` audits a whole corpus.

Defined results: a null text stays null with no entities; a text without entities is returned as it is;
repeated rows get equal results; other columns are passed on.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches

KEY = "marlstone-surrogates"
TYPES = ("account", "card", "credential", "email", "ip", "name", "phone", "ssn")

_TITLES = {
    "mr": "m", "mister": "m", "herr": "m", "monsieur": "m", "sr": "m", "señor": "m", "don": "m", "sir": "m", "господин": "m",
    "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "mlle": "f", "sra": "f", "señora": "f", "doña": "f", "госпожа": "f",
    "dr": "", "prof": "",
}
FIRST_NAMES = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Peter Hans Karl Jürgen Stefan Pierre Jean Louis André José Carlos Miguel Juan".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Donna Michelle Carol Amanda Anna Ursula Ingrid Petra Marie Claire Hélène Sophie María Carmen Lucía Isabel".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел Виктор Юрий Борис Олег".split(),
    ("f", "cyrillic"): "Мария Анна Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Вера Нина".split(),
}
_GIVEN = {name.lower(): at for at, names in FIRST_NAMES.items() for name in names}

_CLASSES = ["0123456789"]
for _alphabet, _vowels in (
    ("abcdefghijklmnopqrstuvwxyz", "aeiou"),
    ("àáâãäåèéêëìíîïòóôõöùúûüýçñßœæø", "àáâãäåèéêëìíîïòóôõöùúûüýœæø"),
    ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "аеиоуыэюя"),
    ("ёєії", "ёєії"),
    ("αβγδεζηθικλμνξοπρσςτυφχψω", "αεηιουω"),
    ("άέήίόύώϊϋΐΰ", "άέήίόύώϊϋΐΰ"),
):
    _CLASSES += [k for v in (True, False) if (k := "".join(c for c in _alphabet if (c in _vowels) == v))]
_CLASS_OF = {c: k for k in _CLASSES for c in k}


@lru_cache(maxsize=4096)
def _class_of(c: str) -> str | None:
    """The characters that may stand for a lower-case one: its class, or for letters of other scripts those of
    the same kind in the same run of 128 code points."""
    if c in _CLASS_OF or not c.isalpha():
        return _CLASS_OF.get(c)
    kind = unicodedata.category(c)
    near = (chr(i) for i in range(ord(c) & ~127, (ord(c) | 127) + 1))
    return "".join(x for x in near if x not in _CLASS_OF and unicodedata.category(x) == kind and x.lower() == x and unicodedata.normalize("NFC", x) == x) or None


_HEX, _LETTERS = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"

#: Combining marks belong to words: a name may be written with them or without.
_WORD = r"[^\W\d_][\w\u0300-\u036f'’-]*"
#: What ends a phone number although digits follow a space: an address, a social security or a card number.
_OTHER = r"(?! (?:(?:\d{1,3}\.){3}\d|\d{3}-\d{2}-\d{4}(?!\d)|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d|\d{4}[ -]\d{6}[ -]\d{5}))"
_DETECT = [
    ("email", re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[\w-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])")),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)")),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("card", re.compile(r"(?<![\w.-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:" + _OTHER + r"[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])")),
]
_ACCOUNT = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_KEYID = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{12,20}(?!\w)")
_FIELD = re.compile(r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase)?|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth(?:orization)?)[\"']?\s{0,3}[=:]\s{0,3}(?:\"([^\"\n]{4,})\"|'([^'\n]{4,})'|([^\s\"',;]{4,}))")
_SHORT = "prof|mlle|mrs|mme|sra|mr|ms|dr|sr"  # may have a full stop
_TITLED = re.compile(rf"(?<!\w)(?:(?P<title>{'|'.join(sorted(map(re.escape, _TITLES), key=len, reverse=True))})\s{{1,2}}|(?P<short>{_SHORT})\.\s{{0,2}})(?P<name>{_WORD}(?:[ \t]{_WORD})?)", re.I)
_LABELLED = re.compile(rf"(?:(?i:my name is|name\s?[:=]|nombre\s?[:=]|nom\s?[:=]|vorname\s?[:=]))\s{{0,2}}(?P<name>{_WORD}(?:[ \t]{_WORD})?)")
_LISTED = re.compile(rf"(?:{'|'.join(sorted((n for names in FIRST_NAMES.values() for n in names), key=len, reverse=True))})[ \t]{_WORD}")
_POSSESSIVE = re.compile(r"(?<=\w\w)['’][sS]?$")
_DIGIT = re.compile(r"\d")
#: Country codes of telephone numbers; none begins another.
_COUNTRY = re.compile(r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def _luhn(digits: str) -> int:
    """What a last digit must be for these digits before it to make a valid number."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return -total % 10


#: The private ranges: first address, free bits.
_PRIVATE = ((10 << 24, 24), (0xAC10 << 16, 20), (0xC0A8 << 16, 16))


def _net(x: int) -> int:
    """0: a public address; 1: one of the private ranges; 2: any other."""
    if any(x >> bits == low >> bits for low, bits in _PRIVATE):
        return 1
    address = ipaddress.IPv4Address(x)
    return 0 if address.is_global and not address.is_multicast else 2


def _titled(word: str) -> bool:
    return word[:1].isupper()


def _whole(pattern: re.Pattern, text: str) -> Iterator[re.Match]:
    """Matches before which no word goes on. A pattern that begins with plain letters is found much faster than one
    that begins by looking behind."""
    m = pattern.search(text)
    while m:
        before = text[m.start() - 1 : m.start()]
        free = not before or not (before.isalnum() or before in "_'’-")
        if free:
            yield m
        m = pattern.search(text, m.end() if free else m.start() + 1)


def _name_of(name: str) -> str | None:
    """What of one or two words is a name: capitalised ones, or those of a script without capitals."""
    words = name.split()
    begins = _titled if _titled(words[0]) else (lambda w: unicodedata.category(w[0]) == "Lo")
    return None if not begins(words[0]) else name if len(words) == 1 or begins(words[1]) else words[0]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities as (start, end, type, gender), in the order of the text, none over another."""
    found = []
    digits = _DIGIT.search(text) is not None
    for kind, pattern in _DETECT:
        if ("@" in text) if kind == "email" else digits:
            found += [(m.start(), m.end(), kind, "") for m in pattern.finditer(text)]
    if digits:
        found += [(m.start(), m.end(), "account", "") for m in _ACCOUNT.finditer(text)]
    found += [(m.start(), m.end(), "credential", "") for m in _KEYID.finditer(text)]
    for m in _FIELD.finditer(text):
        k = next(k for k in (1, 2, 3) if m[k] is not None)
        value = m[k].rstrip(".") if k == 3 else m[k]
        if k < 3 or any(c.isdigit() for c in value):  # a bare word after a colon is prose
            found.append((m.start(k), m.start(k) + len(value), "credential", ""))
    for m in _TITLED.finditer(text):
        title = m["title"] or m["short"]
        if _titled(title) and not title.isupper() and (name := _name_of(m["name"])):
            found.append((m.start("name"), m.start("name") + len(name), "name", _TITLES.get(title.lower(), "")))
    for m in _LABELLED.finditer(text):
        if name := _name_of(m["name"]):
            found.append((m.start("name"), m.start("name") + len(name), "name", ""))
    names = [(a, a + len(_POSSESSIVE.sub("", text[a:b])), k, g) for a, b, k, g in found if k == "name"]
    found = [x for x in found if x[2] != "name"] + names
    for m in _whole(_LISTED, text):  # a listed first name before another name
        if all(map(_titled, m[0].split())) and not m[0].isupper():
            found.append((m.start(), m.start() + len(_POSSESSIVE.sub("", m[0])), "name", ""))
            names.append(found[-1])
    for words in {tuple(canonical("name", text[a:b]).split(" ")) for a, b, _, _ in names}:
        if len(words) > 1:  # a full name is found without its title, too
            mentions = re.finditer(rf"(?<!\w){r'\s{1,2}'.join(map(re.escape, words))}(?!\w)", text, re.I)
            found += [(m.start(), m.end(), "name", "") for m in mentions if _name_of(m[0]) == m[0]]
    rank = {k: i for i, k in enumerate(("credential", "email", "account", "ip", "ssn", "card", "phone", "name"))}
    out, at = [], 0
    for x in sorted(found, key=lambda x: (x[0], rank[x[2]], -x[1])):
        if x[0] >= at:
            out.append(x)
            at = x[1]
    return out


class Surrogates:
    """Keyed surrogates; equal keys give equal surrogates everywhere."""

    def __init__(self, key: str = KEY):
        self.key = hashlib.sha256(key.encode()).digest()

    # ---- numbers below a bound

    def _round(self, i: int, tweak: bytes, x: int, size: int) -> int:
        return int.from_bytes(hashlib.shake_256(self.key + bytes([i]) + tweak + b"\0" + x.to_bytes(size, "big")).digest(size), "big")

    def _order(self, x: int, bound: int, tweak: bytes, back: bool = False) -> int:
        """The place of x in the keyed order of the numbers below a bound (or what stands there)."""
        half = max(1, ((bound - 1).bit_length() + 1) // 2)
        mask, size = (1 << half) - 1, (half + 7) // 8
        while True:
            left, right = x >> half, x & mask
            if back:
                for i in reversed(range(8)):
                    left, right = right ^ self._round(i, tweak, left, size) & mask, left
            else:
                for i in range(8):
                    left, right = right, left ^ self._round(i, tweak, right, size) & mask
            x = left << half | right
            if x < bound:
                return x

    def _once(self, x: int, bound: int, tweak: bytes) -> int:
        """What follows x in the keyed order: never x itself where there are two numbers or more."""
        return self._order((self._order(x, bound, tweak) + 1) % bound, bound, tweak, back=True)

    def _shape(self, text: str, tweak: str, classes=None) -> str:
        """The text with each letter or digit of a known class replaced within its class, case kept."""
        lower = text.lower()
        if len(lower) != len(text):
            lower = text
        pick = classes or _class_of
        kinds = [pick(c) for c in lower]
        x, bound, shape = 0, 1, []
        for c, k in zip(lower, kinds, strict=True):
            shape.append(k[0] if k else c)
            if k:
                x, bound = x * len(k) + k.index(c), bound * len(k)
        if bound < 2:
            return text
        y = self._once(x, bound, f"{tweak}|{''.join(shape)}".encode())
        out, raised = [], text.isupper()
        for c, k in zip(reversed(text), reversed(kinds), strict=True):
            if k:
                y, d = divmod(y, len(k))
                c = k[d].upper() if c.isupper() or (raised and not c.isalpha()) else k[d]
            out.append(c)
        return "".join(reversed(out))

    # ---- types, from canonical entities to canonical surrogates

    def _email(self, s: str) -> str:
        local, _, domain = s.partition("@")
        *labels, top = domain.split(".")
        return f"{self._shape(local, 'local|' + domain)}@{'.'.join([*map(self._label, labels), top])}"

    def _label(self, label: str) -> str:
        """Only the reserved name stays, so no other may become it."""
        new = label
        while label != "example" and (new == label or new == "example"):
            new = self._shape(new, "label")
            if new == label:
                break
        return new

    def _ip(self, s: str) -> str:
        x = int(ipaddress.IPv4Address(s))
        for low, bits in _PRIVATE:
            if x >> bits == low >> bits:
                return str(ipaddress.IPv4Address(low + self._once(x - low, 1 << bits, b"ip%d" % low)))
        inner = _net(x)
        while True:
            x = self._once(x, 1 << 32, b"ip")
            if _net(x) == inner:
                return str(ipaddress.IPv4Address(x))

    def _card(self, s: str) -> str:
        body = s[0] + self._shape(s[1:-1], f"card{len(s)}{s[0]}")
        return body + str((int(s[-1]) - _luhn(s[:-1]) + _luhn(body)) % 10)

    def _phone(self, s: str) -> str:
        code = _COUNTRY.match(s)
        head = code[0] if code else ""
        return head + self._shape(s[len(head) :], f"phone{head}")

    def _ssn(self, s: str) -> str:
        real = lambda t: t[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000"
        t = self._shape(s, "ssn")
        while real(t) != real(s):
            t = self._shape(t, "ssn")
        return t

    def _account(self, s: str) -> str:
        value = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97
        body = self._shape(s[4:], "account" + s[:2], lambda c: _CLASSES[0] if c.isdigit() else "abcdefghijklmnopqrstuvwxyz")
        shift = int(s[2:4]) - (98 - value(s[:2] + "00" + s[4:]))
        check = (98 - value(s[:2] + "00" + body) + shift) % 100
        return f"{s[:2]}{check:02d}{body}"

    def _credential(self, s: str) -> str:
        head = s[:4] if s[:4] in ("AKIA", "ASIA") else ""
        rest = s[len(head) :]
        if head:
            return head + self._shape(rest, head, lambda c: "abcdefghijklmnopqrstuvwxyz0123456789" if c.isascii() and c.isalnum() else None)
        if all(c in _HEX for c in rest):
            return self._shape(rest, "hex", lambda c: _HEX)
        return self._shape(rest, "credential", lambda c: _CLASSES[0] if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.isascii() and c.isalpha() else _class_of(c))

    def _name(self, s: str) -> str:
        *given, last = s.split(" ")
        script = "cyrillic" if re.search("[а-я]", s) else "latin"
        return " ".join([self._word(x, f"given{script}") for x in given] + [self._word(last, "surname")])

    def _word(self, word: str, tweak: str) -> str:
        """A listed name's surrogate comes from its list, any other's stays off the lists."""
        at = _GIVEN.get(word)
        if at:
            names = [n.lower() for n in FIRST_NAMES[at]]
            return names[self._once(names.index(word), len(names), f"given{at}".encode())]
        word = self._shape(word, tweak)
        while word in _GIVEN:
            word = self._shape(word, tweak)
        return word

    def of(self, kind: str, entity: str, steps: int = 1) -> str:
        """The surrogate; with more steps, what follows it further on."""
        plain = new = canonical(kind, entity)
        for _ in range(steps):
            new = getattr(self, f"_{kind}")(new)
        if new == plain:
            new = self._fixed(kind, plain, steps)
        return _formatted(kind, entity, new)

    def _fixed(self, kind: str, plain: str, steps: int) -> str:
        """For entities without a character that can be replaced: 24 keyed ones of the type."""
        data = hmac.new(self.key, f"{kind}|{steps}|{plain}".encode(), "sha256").digest()
        if kind == "credential":
            return data.hex()[:24]
        letters = "".join(_LETTERS[b % len(_LETTERS)] for b in data[:24])
        return f"{letters}@{plain.partition('@')[2]}" if kind == "email" else letters


def _formatted(kind: str, entity: str, new: str) -> str:
    """A canonical surrogate with the separators, the case and the digits' script of the entity."""
    if kind in ("card", "phone", "ssn"):
        digits = iter(new.lstrip("+"))
        return "".join(chr(ord(c) - int(c) + int(next(digits))) if c.isdigit() else c for c in entity)
    if kind == "account":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in entity)
    if kind == "email":
        return _cased(entity, new)
    if kind == "name":
        words = iter(new.split(" "))
        return "".join(x if not x or x.isspace() else _cased(x, next(words)) for x in re.split(r"(\s+)", entity))
    return new


def _cased(word: str, new: str) -> str:
    upper = lambda c: c.upper() if c.upper().lower() == c else c
    if word.isupper() and len(word) > 1:
        return "".join(map(upper, new))
    if len(word) != len(new):
        return upper(new[:1]) + new[1:] if word[:1].isupper() else new
    return "".join(upper(c) if w.isupper() else c for w, c in zip(word, new, strict=True))


def canonical(kind: str, entity: str) -> str:
    """What makes two mentions the same entity: case and separators don't count."""
    if kind in ("card", "phone", "ssn"):
        return "".join(c if c == "+" else str(int(c)) for c in entity if c.isdigit() or c == "+")
    if kind == "account":
        return entity.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(p)) for p in entity.split("."))
    if kind == "credential":
        return entity
    if kind == "name":
        entity = " ".join(entity.split())
    return unicodedata.normalize("NFC", entity).lower()


def replaced(text: str, made: Surrogates, memo: dict | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and (type, start, end) of each in the new text."""
    out, spans, at, size = [], [], 0, 0
    back: dict[tuple[str, str], str] = {}
    for start, end, kind, _ in detect(text):
        entity = text[start:end]
        key = (kind, entity)
        new = memo.get(key) if memo is not None else None
        if new is None:
            new = made.of(kind, entity)
            if memo is not None and len(memo) < 50_000:
                memo[key] = new
        plain, steps = canonical(kind, entity), 1
        while back.setdefault((kind, canonical(kind, new)), plain) != plain:
            steps += 1
            new = made.of(kind, entity, steps)
        out += [text[at:start], new]
        size += start - at
        spans.append((kind, size, size + len(new)))
        size += len(new)
        at = end
    return "".join(out) + text[at:], spans


def _replace(key: str, digests: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, memo = Surrogates(key), {}
        for batch in batches:
            texts = batch.column("text")
            new, spans = [], []
            for scalar in texts:
                text = scalar.as_py()
                out, found = replaced(text, made, memo) if text else (None, [])
                new.append(out if found else None)
                if digests:
                    mark = lambda s: hmac.new(made.key, s.encode(), "sha256").hexdigest()[:32]
                    old = [(k, mark(canonical(k, text[a:b])), memo.get((k, text[a:b])) or made.of(k, text[a:b])) for a, b, k, _ in detect(text)] if found else []
                    found = [(k, o, mark(canonical(k, n))) for k, o, n in old]
                spans.append(found)
            if digests:
                rows = [x for s in spans for x in s]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["type", "entity", "surrogate"])
                continue
            text = pc.coalesce(pa.array(new, texts.type), texts)
            entity = pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
            found = pa.array([[{"type": k, "start": a, "end": b} for k, a, b in s] for s in spans], pa.list_(entity))
            rest = [(c, batch.column(c)) for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([v for _, v in rest] + [text, found], names=[c for c, _ in rest] + ["text", "entities"])

    return run


def anonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs(text, ...)`` with surrogates in text, and an array of their types and places, entities, which
    replaces a column of that name."""
    small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("text", "entities")]
    renamed = docs.select(*[docs[c] for c in names], docs["text"].cast("string").alias("text"))
    entity = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([renamed.schema[c] for c in names] + [T.StructField("text", T.StringType()), T.StructField("entities", entity)])
    return renamed.mapInArrow(_replace(key, False), schema)


def counted(docs: DataFrame, key: str = KEY) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: doc_id, the text with surrogates, n_entities, and how many
    of each type."""
    out = anonymised(docs.select("doc_id", "text"), key)
    types = F.transform("entities", lambda e: e["type"])
    n = [(F.size(types) - F.size(F.array_remove(types, t))).alias(f"n_{t}") for t in TYPES]
    return out.select("doc_id", "text", F.size("entities").alias("n_entities"), *n)


def collisions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """Surrogates (keyed digests) that stand for more than one entity of a corpus; none are expected."""
    small_batches(docs.sparkSession)
    pairs = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_replace(key, True), "type string, entity string, surrogate string")
    return pairs.distinct().groupBy("type", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def cleaned(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in text; n_chars, where there is one, follows the new text."""
    names = [c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)]
    out = anonymised(docs.toDF(*names), key)
    if "n_chars" in docs.columns:
        n = names[docs.columns.index("n_chars")]
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(n, F.when(F.col("text").isNull(), F.col(n)).otherwise(F.length("text")).cast(kind))
    return out.select(*names).toDF(*docs.columns)
