"""Personal data: detected entities get keyed surrogates of the same type, format, script and gender.

An entity is read as a number in a mixed base given by its format (a letter has as many choices as its alphabet, a digit
ten); the number is moved by a keyed permutation of that domain without fixed points, and written in the same format.
So, without any table of entities: the same entity gets the same surrogate in every document (coreference), different
entities of a format get different ones and entities of different formats differ in format (distinctness), and none stays.
anonymize() checks that over its whole table, by collisions().

Names are moved word by word, whatever title stands before them, so parts of a name agree with the whole; a name that a
title announces is replaced wherever its words stand in the same text, before and after.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import schema_with

KEY = b"strata surrogate key"
ROUNDS = 8
#: Characters of a value that are changed at once.
PIECE = 256

#: Letters change among their like, by script: vowels, frequent and seldom consonants, so a name stays one that can be said.
ALPHABETS = [
    "aeiou", "bdfglmnprst", "chjkqvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñ", "ßſĸ", "аеиоуыэюя", "бвгдзклмнпрст", "жйфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ",
]
#: Where the letters of these scripts are.
RANGES = [(0xC0, 0x180), (0x370, 0x400), (0x400, 0x530)]
_VOWELS = set("aeiouøæœıαεηιουωаеиоуыэюяіє")


def _other_alphabets() -> list[str]:
    """The small letters of RANGES that ALPHABETS lack, by script and whether their base is a vowel."""
    known, found = set("".join(ALPHABETS)), {}
    for low, high in RANGES:
        for c in map(chr, range(low, high)):
            if c.islower() and c not in known and len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c:
                found.setdefault((low, unicodedata.normalize("NFD", c)[0] in _VOWELS), []).append(c)
    return ["".join(own) for own in found.values()]


ALPHABETS += _other_alphabets()
ALPHABETS += [x.upper() for x in ALPHABETS if "ß" not in x] + ["0123456789"]
CLASS = {c: alphabet for alphabet in ALPHABETS for c in alphabet}
HEX = "0123456789abcdef"

#: Titles that announce a name.
TITLES = [
    "Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Sra", "Señora", "Doña", "Signora", "Г-жа",
    "Mr", "Mister", "Herr", "Monsieur", "Sr", "Señor", "Signor", "Г-н", "Dr", "Prof",
]
#: Last letters that mark a gender in a name; they stay, and no other becomes one of them.
MARKS = "aeаяαη" + "osйς"

_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_UPPER = "[A-Z" + "".join(c for low, high in RANGES for c in map(chr, range(low, high)) if c.isupper()) + "]"
_LOWER = "[a-z\u0300-\u036f" + "".join(c for low, high in RANGES for c in map(chr, range(low, high)) if c.islower()) + "]"
_NAME = rf"{_UPPER}{_LOWER}+(?:[-'’]{_UPPER}?{_LOWER}+)*"
PATTERNS = {
    "email": r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w-])",
    "secret": r"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9_/+.=-]{8,})",
    "phone": r"(?<![\w.+-])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?![\w-]|\.\d)|(?<![\w.+-])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\w-]|\.\d)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]|\.\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.-])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w-]|\.\d)",
    "card": r"(?<![\w.-])\d{4}(?P<gap>[ -]?)\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}(?![\w-]|\.\d)",
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])",
    "name": rf"\b(?P<title>{_TITLE})\.?[ \u00a0](?P<name>{_NAME}(?:[ \u00a0]{_NAME}){{0,2}})",
}
_FINDER = re.compile("|".join(f"(?P<k_{kind}>{p})" for kind, p in PATTERNS.items()))
#: A text without any of these has no entity.
_HINT = re.compile(rf"[0-9@]|(?i:secret|token|passw|key)|\b(?:{_TITLE})\b")
#: What parts the words of a name, and a word that may repeat one.
_BETWEEN = re.compile(r"([ \u00a0'’-])")
_WORD = re.compile(r"(?<!\w)[^\W\d_]{2,}(?!\w)")


@dataclass(frozen=True)
class Entity:
    kind: str
    start: int
    end: int
    value: str


def luhn(digits: str) -> int:
    """The check digit of digits."""
    doubled = [int(c) * 2 if k % 2 == 0 else int(c) for k, c in enumerate(reversed(digits))]
    return -sum(x - 9 if x > 9 else x for x in doubled) % 10


def iban_check(country: str, rest: str) -> str:
    """The two check digits of an international account number."""
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def entities(text: str | None) -> list[Entity]:
    """The entities of a text, from left to right, none inside another. Card numbers and accounts must have a right check.

    A name's words are entities wherever they stand by themselves, written as in the name or all in capitals.
    """
    if not text or not _HINT.search(text):
        return []
    out, at = [], 0
    while m := _FINDER.search(text, at):
        kind = next(k for k in PATTERNS if m[f"k_{k}"] is not None)
        group = kind if kind in ("secret", "name") else 0
        value, good = m[group], True
        if kind == "card":
            digits = re.sub(r"\D", "", value)
            good = 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1])
        elif kind == "phone":
            good = 7 <= len(re.sub(r"\D", "", value)) <= 15
        elif kind == "iban":
            plain = value.replace(" ", "")
            good = 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]
        elif kind == "secret":
            good = any(c.isdigit() for c in value) or len(value) >= 16
        if good:
            out.append(Entity(kind, m.start(group), m.end(group), value))
        at = max(m.end() if good else m.start() + 1, at + 1)
    return _with_mentions(text, out)


def _with_mentions(text: str, found: list[Entity]) -> list[Entity]:
    """The entities found, and the words between them that repeat a word of a name; neighbours are one entity."""
    words = {w for e in found if e.kind == "name" for w in _BETWEEN.split(e.value) if len(w) > 1 and w[0].isupper()}
    if not words:
        return found
    words |= {w.upper() for w in words}
    out, at = [], 0
    for e in [*found, None]:
        last = None
        for m in _WORD.finditer(text, at, e.start if e else len(text)):
            if m[0] not in words:
                continue
            if last and _BETWEEN.fullmatch(text, last.end, m.start()):
                out.pop()
                last = Entity("name", last.start, m.end(), text[last.start : m.end()])
            else:
                last = Entity("name", m.start(), m.end(), m[0])
            out.append(last)
        if e:
            out.append(e)
            at = e.end
    return out


def _half(key: bytes, tweak: bytes, round_: int, value: int, bits: int) -> int:
    seed = tweak + bytes([round_]) + value.to_bytes((bits + 7) // 8, "big")
    raw = b"".join(hashlib.blake2b(seed, key=key[:64], salt=k.to_bytes(16, "big")).digest() for k in range(bits // 512 + 1))
    return int.from_bytes(raw, "big") & ((1 << bits) - 1)


def _shuffle(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network, walked until it is within the domain."""
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    while True:
        left, right = value >> bits, value & mask
        if back:
            for k in reversed(range(ROUNDS)):
                left, right = right ^ _half(key, tweak, k, left, bits), left
        else:
            for k in range(ROUNDS):
                left, right = right, left ^ _half(key, tweak, k, right, bits)
        value = left << bits | right
        if value < size:
            return value


def derange(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of 0 .. size - 1 that moves every value (if there is more than one)."""
    if size < 2:
        return value
    step = 1 + int.from_bytes(hashlib.blake2b(tweak, key=key[:64], digest_size=32).digest(), "big") % (size - 1)
    return _shuffle((_shuffle(value, size, key, tweak) + step) % size, size, key, tweak, back=True)


def reformat(value: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """value with each character changed within its alphabet (an empty one: it stays), by a keyed derangement of all such values."""
    number = size = 0
    size = 1
    for c, alphabet in zip(value, alphabets):
        if alphabet:
            number = number * len(alphabet) + alphabet.index(c)
            size *= len(alphabet)
    number = derange(number, size, key, f"{tweak}|{'|'.join(alphabets)}".encode())
    out = []
    for c, alphabet in zip(reversed(value), reversed(alphabets)):
        if alphabet:
            number, at = divmod(number, len(alphabet))
            c = alphabet[at]
        out.append(c)
    return "".join(reversed(out))


def reformat_long(value: str, alphabets: list[str], key: bytes, tweak: str) -> str:
    """As reformat(), in time that grows with the length: PIECE characters at a time, each piece's permutation chosen by
    all that stands before it, so that different values still get different surrogates.
    """
    out, before = [], hashlib.blake2b(key=key[:64], digest_size=16)
    for at in range(0, len(value), PIECE):
        piece = value[at : at + PIECE]
        out.append(reformat(piece, alphabets[at : at + PIECE], key, tweak if at == 0 else f"{tweak}|{before.hexdigest()}"))
        before.update(piece.encode("utf-8", "surrogatepass"))
    return "".join(out)


def _classes(value: str, stay: set[int] = frozenset()) -> list[str]:
    return ["" if k in stay else CLASS.get(c, "") for k, c in enumerate(value)]


@functools.lru_cache(maxsize=100_000)
def surrogate(kind: str, value: str, key: bytes = KEY) -> str:
    """The replacement of an entity: a function of the key, the kind and the value alone.

    Upper and lower case of an e-mail address or secret are the same entity, written alike. Reserved domains
    (example.com, .org, .net), the last label of others, country codes, the first digit of a card, the exchange 555, private
    address ranges and gender-marking endings of names stay, and nothing else is changed into one of these marks; check
    digits are made right again.
    """
    value = unicodedata.normalize("NFC", value)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        labels = domain.split(".")
        fixed = 2 if ".".join(labels[-2:]).lower() in ("example.com", "example.org", "example.net") else 1
        folded = f"{local}@{domain}".lower()
        classes = _classes(folded, set(range(len(local), len(folded) if fixed == 2 else len(local) + 1)) | set(range(len(folded) - sum(map(len, labels[-fixed:])) - fixed, len(folded))))
        if not any(classes):
            return f"{hashlib.blake2b(folded.encode(), key=key[:64], digest_size=12).hexdigest()}@example.com"
        return _case_like(reformat(folded, classes, key, kind), value)
    if kind == "secret":
        if re.fullmatch(r"[0-9a-fA-F]+", value):
            moved = reformat_long(value.lower(), [HEX] * len(value), key, kind)
            return moved.upper() if value.upper() == value and value.lower() != value else moved
        return _walked(value, lambda x: reformat_long(x, _classes(x), key, kind), lambda x: re.fullmatch(r"[0-9a-fA-F]+", x))
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        number = int.from_bytes(bytes(octets), "big")
        for low, high in ((0x0A000000, 0x0B000000), (0x7F000000, 0x80000000), (0xAC100000, 0xAC200000), (0xC0A80000, 0xC0A90000)):
            if low <= number < high:
                moved = low + derange(number - low, high - low, key, f"ip{low}".encode())
                break
        else:
            moved = _public(number, key)
        return ".".join(str(x) for x in moved.to_bytes(4, "big"))
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        body = reformat(digits[:-1], ["", *_classes(digits[1:-1])], key, f"card{len(digits)}")
        return _fill(value, body + str(luhn(body)))
    if kind == "iban":
        plain = value.replace(" ", "")
        rest = reformat(plain[4:], ["0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in plain[4:]], key, f"iban{plain[:2]}")
        full = iter(plain[:2] + iban_check(plain[:2], rest) + rest)
        return "".join(c if c == " " else next(full) for c in value)
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        code = _code_length(digits) if value[0] == "+" else 0
        national = digits[code:]

        def nobodys(x: str) -> bool:  # the exchange of numbers that nobody has
            return len(x) == 10 and x[3:6] == "555"

        marked = nobodys(national)
        alphabets = ["" if marked and 3 <= k < 6 else "0123456789" for k in range(len(national))]
        # A number without a code is one of the country whose form it has, so both ways of writing it agree.
        moved = _walked(national, lambda x: reformat(x, alphabets, key, f"phone{digits[:code] or '1'}"), lambda x: nobodys(x) and not marked)
        return _fill(value, digits[:code] + moved)
    if kind == "name":
        return "".join(_name_word(w, key) for w in _BETWEEN.split(value))
    return reformat(value, _classes(value), key, kind)


#: Country codes of one digit and of two; the others have three.
CODES = ["1", "7", *(f"{a}{b}" for a, second in (("2", "07"), ("3", "0123469"), ("4", "013456789"), ("5", "12345678"), ("6", "0123456"), ("8", "12469"), ("9", "0123458")) for b in second)]


def _code_length(digits: str) -> int:
    """Digits of the country code that an international number begins with."""
    return next((n for n in (1, 2) if digits[:n] in CODES), 3)


def _walked(value: str, step: Callable[[str], str], outside: Callable[[str], object]) -> str:
    """step(value), a permutation, repeated until the result isn't outside: a permutation of those that aren't."""
    value = step(value)
    while outside(value):
        value = step(value)
    return value


def _name_word(word: str, key: bytes) -> str:
    """A word of a name in its own case; a small letter by itself, as after an apostrophe, stays."""
    if len(word) < 2 and not word.isupper():
        return word
    folded = word.lower()
    classes = _classes(folded)
    if any(classes[:-1]):
        # The last letter stays if it marks a gender; if not, it doesn't become one that does.
        classes[-1] = "" if folded[-1] in MARKS else "".join(c for c in classes[-1] if c not in MARKS)
    return _case_like(reformat(folded, classes, key, "name"), word)


#: Addresses that are in no private or loopback range: those below each bound, less the ranges passed.
_RANGES = [(0x0A000000, 0x0B000000), (0x7F000000, 0x80000000), (0xAC100000, 0xAC200000), (0xC0A80000, 0xC0A90000)]


def _public(number: int, key: bytes) -> int:
    size = (1 << 32) - sum(b - a for a, b in _RANGES)
    moved = derange(number - sum(b - a for a, b in _RANGES if b <= number), size, key, b"ip")
    for a, b in _RANGES:
        if moved >= a:
            moved += b - a
    return moved


def _fill(value: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in value)


def _case_like(text: str, model: str) -> str:
    return "".join(c.upper() if m.isupper() else c for c, m in zip(text, model)) if len(text) == len(model) else text


def replaced(text: str | None, key: bytes = KEY) -> tuple[str | None, list[tuple[Entity, str]]]:
    """The text with surrogates, and the entities with theirs. A null text stays null."""
    found = [(e, surrogate(e.kind, e.value, key)) for e in entities(text)]
    if not found:
        return text, []
    out, at = [], 0
    for e, s in found:
        out += [text[at : e.start], s]
        at = e.end
    return "".join([*out, text[at:]]), found


SPANS = "array<struct<kind:string,start:int,end:int,surrogate:string>>"


def anonymize(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text, then n_entities and entities: kind, place in the old text (characters), surrogate.
    Columns of docs with these two names are replaced.

    Documents are handled one by one where they lie; equal entities agree across documents by the key alone. Null and
    empty texts stay as they are. Before, the entities of the whole table are checked for collisions.

    Raises:
        ValueError: two entities have one surrogate.
    """
    if met := collisions(docs, key, text_col).select("kind", "n_values").head(1):
        raise ValueError(f"{met[0].n_values} entities of kind {met[0].kind} share a surrogate: use another key")
    columns = [c for c in docs.columns if c.lower() not in ("n_entities", "entities")]
    at = columns.index(text_col)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
    plain = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(columns)])
    names = [*plain.columns, "n_entities", "entities"]
    schema = schema_with(plain, plain.columns, f"n_entities int, entities {SPANS}")

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                done = [replaced(t.as_py(), key) for t in part.column(at)]
                arrays = list(part.columns)
                arrays[at] = pa.array([t for t, _ in done], pa.string())
                found = [[{"kind": e.kind, "start": e.start, "end": e.end, "surrogate": s} for e, s in own] for _, own in done]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([len(x) for x in found], pa.int32()), pa.array(found, spans)], names)

    out = plain.mapInArrow(change, schema)
    return out.select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(columns)], "n_entities", "entities")


def collisions(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, n_values) of surrogates that stand for more than one entity: none, unless the key is at fault.

    Entities are compared without case, spaces and dashes, names word by word, phone numbers and secrets as written;
    only they, not texts, are shuffled.
    """

    def pairs_of(e: Entity, s: str) -> Iterator[tuple[str, str, str]]:
        if e.kind == "name":
            yield from ((e.kind, new.lower(), old.lower()) for new, old in zip(_BETWEEN.split(s), _BETWEEN.split(e.value)))
        elif e.kind == "phone" or e.kind == "secret" and not re.fullmatch(r"[0-9a-fA-F]+", e.value):
            yield e.kind, s, e.value
        else:
            yield e.kind, re.sub(r"[\s-]", "", s.lower()), re.sub(r"[\s-]", "", e.value.lower())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {row for t in batch.column(0) for e, s in replaced(t.as_py(), key)[1] for row in pairs_of(e, s)}
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else ([], [], []))], ["kind", "surrogate", "value"])

    pairs = docs.select(text_col).mapInArrow(listed, "kind string, surrogate string, value string").distinct()
    return pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n_values")).filter("n_values > 1")
