"""Personal data replaced by keyed surrogates of the same kind and form.

Numbers, addresses and secrets are permuted by a keyed cipher over their own characters: letters stay letters of their
script and case, digits stay digits, separators stay where they are.  The permutation is one cycle through all values,
so distinct entities stay distinct, equal ones equal (in any letter case or spacing) with nothing shared between tasks,
and none is its own surrogate; check digits and ranges are kept by walking the cycle until the result is valid.  Names
are drawn by a keyed hash from syllables of their script with an ending of their gender; there two names could meet, so
the corpus' distinct names are counted (which decides on the number of syllables) and checked, and the later of two is
drawn again.

A name is found behind one or several titles, or as a given name of the list before capitalised words; its words are
then replaced wherever they stand capitalised in the same text, before or after.  Its gender is that of the given name,
whatever the title, so that a person has one surrogate; a given name that is not listed gets a form that fits both.
Surnames with one form for men and one for women keep both: a family's two forms get two forms of one surrogate.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import saved, slices

#: Names that are drawn again (they are broadcast): with more, names get another syllable.
REDRAWN = 100_000

# Characters that are permuted among themselves.
_ALPHABETS = [
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "αβγδεζηθικλμνξοπρστυφχψω",
]
_HEX = "0123456789abcdef"
_PLACE = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}

# Titles by gender, and the syllables and endings of surrogate names by script.
_TITLES = {"f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|г-жа|Κυρία|Κα", "m": "Mr|Herr|Monsieur|Señor|Sr|Господин|г-н|Κύριος|Κος", "u": "Dr|Prof|Mx"}
_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi vo".split(),
    "cyrillic": "ба бе би бо да де ди до га го ка ки ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си со та те ти то ва ве ви во".split(),
    "greek": "βα βε βι βο γα γε γι γο δα δε δι δο ζα ζε ζι ζο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
_ENDINGS = {"latin": {"f": "lina", "m": "lis", "u": "len", "surname": "rek"}, "cyrillic": {"f": "лина", "m": "лис", "u": "лен", "surname": "рек"}, "greek": {"f": "λινα", "m": "λις", "u": "λεν", "surname": "ρεκ"}}
# Endings of surnames of women and of men, by script (Greek ones without accents), and what the surrogate's form for women has behind the other.
_PAIRED = {
    "latin": [("ska", "ski"), ("cka", "cki"), ("dzka", "dzki"), ("ská", "ský"), ("cká", "cký"), ("ova", "ov"), ("eva", "ev")],
    "cyrillic": [("ская", "ский"), ("цкая", "цкий"), ("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ына", "ын")],
    "greek": [("πουλου", "πουλος"), ("ιδου", "ιδης"), ("αδου", "αδης"), ("ακη", "ακης")],
}
_FEMININE = {"latin": "a", "cyrillic": "а", "greek": "ου"}
# What makes a given name and a surname before it the name of a place or a body.
_PLACES = "Street|Road|Avenue|Boulevard|Square|Bridge|Airport|University|College|Hospital|Library|Museum|Stadium|Station|Institute|Foundation|Prize|Award"
# Given names by gender.
_GIVEN = {
    "f": (
        "Anna Maria Mary Jane Emma Laura Julia Sofia Elena Clara Marie Lucia Carmen Ingrid Anne Elizabeth Susan Jennifer Linda Patricia Barbara Margaret Sarah Karen Nancy Lisa Helen "
        "Sandra Catherine Emily Olivia Charlotte Sophie Claire Camille Juliette Isabel Ana Pilar Rosa Petra Ursula Monika Katharina Heike Giulia Chiara Francesca Fatima Aisha "
        "Priya Yuki Agnieszka Katarzyna Ольга Анна Мария Елена Наталья Татьяна Ирина Светлана Μαρία Ελένη Κατερίνα"
    ).split(),
    "m": (
        "John James Peter Paul Hans Karl Pierre Jean Juan Carlos Luis Michael David Thomas Robert William Richard Joseph Charles Daniel Matthew Anthony Steven Andrew Kenneth George "
        "Edward Brian Kevin Henry Arthur Oliver Jacques François Nicolas Antoine José Miguel Antonio Pablo Jürgen Wolfgang Klaus Stefan Andreas Marco Giovanni Luca Ahmed Mohammed "
        "Raj Hiroshi Łukasz Piotr Иван Пётр Сергей Алексей Дмитрий Андрей Михаил Владимир Νίκος Γιώργος Δημήτρης"
    ).split(),
}
_GENDER = {n.lower(): g for g, names in _GIVEN.items() for n in names}

_GAP = r"[^\w\n]{1,6}"
_WORD = r"[^\W\d_]+(?:[-'’](?!s\b)[^\W\d_]+)*"


def _any(words: list[str]) -> str:
    """A pattern of all words, parted by their first letters."""
    by: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        by.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items())


_TITLE_WORDS = [v for t in _TITLES.values() for n in t.split("|") for v in (n, n.upper())]
_GIVEN_WORDS = [v for names in _GIVEN.values() for n in names for v in (n, n.upper())]
_ALL_TITLES, _ALL_GIVEN = _any(_TITLE_WORDS), _any(_GIVEN_WORDS)
_UPPER = "[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and (c.isupper() or c.istitle())) + "]"
_CAPITAL = rf"{_UPPER}(?:{_WORD}|(?:[-'’](?!s\b)[^\W\d_]+)+)"
_NAME = rf"(?:{_CAPITAL}|{_UPPER}\.(?=[^\S\n]+{_UPPER}{_WORD}))"
#: Hebrew to Burmese, Hangul to Ethiopic, kana to Hangul: letters without case.
_CASELESS = "[\u05d0-\u109f\u1100-\u139f\u3040-\ud7ff]"
_BEHIND_TITLE = rf"(?:{_NAME}|{_CASELESS}[^\W\d_]*)"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
_DATE = rf"\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[./-]\d{{1,2}}[./-]\d{{4}}|\d{{1,2}}(?:st|nd|rd|th)? (?:{_MONTHS}),? \d{{4}}|(?:{_MONTHS}) \d{{1,2}},? \d{{4}}"
_GROUP = "[0-9A-Fa-f]{1,4}"
_STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Ct"
#: Patterns of entities in the order in which they are tried; the parts with a hint are left out of texts without it.
_PATTERNS = {
    "numbers": "|".join([
        r"(?P<email>\w[\w.%+-]*@(?:[^\W_][\w-]*\.)+[^\W_][\w-]*)",
        r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d))",
        rf"(?P<ip6>(?<![\w:.])(?:{_GROUP}:){{7}}{_GROUP}(?![\w:])|(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:{_GROUP}:){{2,6}}(?::{_GROUP}){{1,6}}(?![\w:]))",
        r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
        r"(?P<ssn>(?<!\d)\d{3}-\d{2}-\d{4}(?!\d))",
        rf"(?P<phone>(?<![\w+])\+\d{{1,3}}(?:{_GAP}\d{{2,4}}){{2,5}}(?!\d)|(?<![\w(])\(\d{{3}}\){_GAP}\d{{3}}{_GAP}\d{{4}}(?!\d)|(?<!\d)\d{{3}}[-.]\d{{3}}[-.]\d{{4}}(?!\d)|(?<![\w+])\+\d{{9,15}}(?!\d))",
        r"(?P<card>(?<!\w)\d(?:[ -]?\d){12,18}(?!\w))",
        r"(?i:\b(?:api[_-]?key|access[_-]?key|secret|token|passw(?:or)?d)\b)[^\w\n]{0,8}[:=][^\w\n]{0,8}(?P<secret>[A-Za-z0-9_+/.=-]{12,})",
        r"(?P<key>\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}))",
    ]),
    "papers": "|".join([
        rf"(?i:\b(?:date of birth|birth ?date|d\.?o\.?b\.?|born(?: on)?)\b\.?)[^\w\n]{{0,4}}(?P<birth>{_DATE})(?!\d)",
        r"(?i:\b(?:ssn|social security(?: (?:no|nr|number))?)\b\.?)[^\w\n]{0,4}(?P<spaced_ssn>\d{3} ?\d{2} ?\d{4})(?!\d)",
        r"(?i:\bpassport(?: (?:no|nr|number|id))?\b\.?)[^\w\n]{0,4}(?P<passport>(?=(?:[A-Z]*\d){4})[A-Z0-9]{6,10})\b",
    ]),
    "addresses": (
        rf"(?P<address>(?<![\w.,-])\d{{1,5}} {_UPPER}{_WORD}(?: {_UPPER}{_WORD})? (?:{_STREET})\b|\b{_UPPER}{_WORD}(?:straße|strasse|gasse|weg) \d{{1,4}}[a-z]?\b)"
    ),
    "names": "|".join([
        rf"(?P<title>\b(?:{_ALL_TITLES})\b(?:\.?[^\S\n]+(?:{_ALL_TITLES})\b)*)(?:\.?[^\S\n]+|\.?[^\S\n]*\n[^\S\n]*)(?P<name>{_BEHIND_TITLE}(?:[^\S\n]+{_BEHIND_TITLE}){{0,2}})",
        rf"(?P<untitled>\b(?:{_ALL_GIVEN})(?![^\S\n]+{_NAME}[^\S\n]+(?:{_PLACES})\b)(?:[^\S\n]+{_NAME}){{1,2}})",
    ]),
}
_LETTERS = re.compile(r"[^\W\d_]+")
_NAME_WORDS = frozenset(w for n in (*_TITLE_WORDS, *_GIVEN_WORDS) for w in _LETTERS.findall(n))
_STREET_WORDS = frozenset(_STREET.split("|"))
_STREET_ENDS = ("straße", "strasse", "gasse", "weg")
_DIGIT, _KEY = re.compile(r"[\d@]"), re.compile(r"gh[pousr]_|sk-|xox|eyJ")


@functools.cache
def _pattern(parts: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(_PATTERNS[p] for p in parts))


def entities(text: str) -> Iterator[re.Match]:
    """Matches of all patterns, leftmost first; patterns whose hint is not in the text cannot match and are not tried."""
    low = text.lower()
    parts = []
    digit = _DIGIT.search(text) is not None
    if digit or any(w in low for w in _ASSIGNED) or "AKIA" in text or _KEY.search(text):
        parts.append("numbers")
    if digit and any(w in low for w in ("birth", "born", "dob", "d.o", "passport", "ssn", "social security")):
        parts.append("papers")
    words = set(_LETTERS.findall(text))
    if digit and (not words.isdisjoint(_STREET_WORDS) or any(w in text for w in _STREET_ENDS)):
        parts.append("addresses")
    if not words.isdisjoint(_NAME_WORDS):
        parts.append("names")
    return _pattern(tuple(parts)).finditer(text) if parts else iter(())


_ASSIGNED = ("key", "secret", "token", "passw")


def _alphabet(c: str) -> str | None:
    """The letters that a lower-case or caseless letter is permuted among: a listed alphabet, else those of its kind in its block of 128."""
    if c in _PLACE:
        return _PLACE[c][0]
    if not c.isalpha():
        return None
    base, kind = ord(c) & ~127, unicodedata.category(c)
    return _block(base, kind)


@functools.cache
def _block(base: int, kind: str) -> str:
    return "".join(x for x in map(chr, range(base, base + 128)) if unicodedata.category(x) == kind and x not in _PLACE)


def base_form(kind: str, low: str, script: str | None) -> tuple[str, bool]:
    """The form for men of a lower-case surname, and whether the name is that for women; all other names are their own form.

    Greek surnames of such pairs lose their accents, as these move between the two forms.
    """
    plain = "".join(c for c in unicodedata.normalize("NFD", low) if not unicodedata.combining(c)) if script == "greek" else low
    for woman, man in _PAIRED.get(script, []) if kind == "surname" else []:
        if plain.endswith(woman) and len(plain) > len(woman) + 1:
            return plain[: -len(woman)] + man, True
        if script == "greek" and plain.endswith(man):
            return plain, False
    return low, False


def _script(word: str) -> str | None:
    name = unicodedata.name(word[0], "")
    return next((s for s in _ENDINGS if s.upper() in name), None)


def luhn(digits: str) -> bool:
    """Whether the last digit of a number is its check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    t = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in t)) % 97 == 1


@dataclass
class Surrogates:
    """The keyed maps.  ``again``: how many times a (kind, name) is drawn anew; ``length``: syllables of a drawn name."""

    key: bytes
    again: dict[tuple[str, str], int] = field(default_factory=dict)
    parts: dict[str, list[str]] = field(default_factory=lambda: _SYLLABLES)
    length: int = 4

    def __post_init__(self) -> None:
        self._digest = hashlib.blake2b(self.key).digest()  # a key may have any length

    def _numbers(self, tweak: bytes, n: int) -> list[int]:
        out: list[int] = []
        k = 0
        while len(out) < n:
            block = hashlib.blake2b(tweak + k.to_bytes(4, "big"), key=self._digest).digest()
            out += [int.from_bytes(block[i : i + 8], "big") for i in range(0, 64, 8)]
            k += 1
        return out[:n]

    def _cipher(self, form: bytes, values: list[int], radix: list[int], sign: int) -> list[int]:
        """A Feistel network over values of these radices, or its inverse."""
        half, values = len(values) // 2, list(values)
        for r in range(8)[::sign]:
            own, other = (range(half, len(values)), range(half)) if r % 2 == 0 else (range(half), range(half, len(values)))
            add = self._numbers(form + bytes([r]) + b",".join(str(values[i]).encode() for i in other), len(own))
            for i, a in zip(own, add, strict=True):
                values[i] = (values[i] + sign * a) % radix[i]
        return values

    def permute(self, kind: str, values: list[int], radix: list[int]) -> list[int]:
        """The next of all value lists of these radices in a keyed order: one cycle, so no list stays where it is."""
        form = f"{kind}|{','.join(map(str, radix))}|".encode()
        coded = self._cipher(form, values, radix, 1)
        for i, n in enumerate(radix):
            coded[i] = (coded[i] + 1) % n
            if coded[i]:
                break
        return self._cipher(form, coded, radix, -1)

    def _walk(self, kind: str, values: list[int], radix: list[int], valid=None) -> list[int]:
        """The next valid list on the cycle; it is the list itself only if no other is valid."""
        out = self.permute(kind, values, radix)
        while valid and out != values and not valid(out):
            out = self.permute(kind, out, radix)
        return out

    def characters(self, kind: str, text: str, alphabet: str | None = None, keep=lambda i: False, valid=None) -> str:
        """Permute the letters and digits of a text within their alphabets; case and all else stay."""
        low = text.lower()
        if len(low) != len(text):
            low = text
        letters = [(alphabet if c in alphabet else None) if alphabet else _alphabet(c) for c in low]
        at = [i for i, a in enumerate(letters) if a and not keep(i)]
        own = [(letters[i], letters[i].index(low[i])) for i in at]

        def build(values: list[int]) -> str:
            out = list(text)
            for i, (letters, _), v in zip(at, own, values, strict=True):
                c = letters[v]
                out[i] = c.upper() if text[i] != low[i] and len(c.upper()) == 1 else c
            return "".join(out)

        # capitals without a counterpart of one character stand as they are, so two forms could meet: walk on
        sound = lambda v: build(v) != text and (not valid or valid(build(v)))
        return build(self._walk(kind, [v for _, v in own], [len(a) for a, _ in own], sound)) if own else text

    def _digits(self, kind: str, text: str, keep: int = 0, valid=None) -> str:
        """Permute the digits of a text behind the first ``keep``, the same way in any spacing."""
        digits = re.sub(r"\D", "", text)
        new = digits[:keep] + self.characters(kind, digits[keep:], valid=(lambda t: valid(digits[:keep] + t)) if valid else None)
        it = iter(new)
        return "".join(next(it) if c.isdecimal() and c.isascii() else c for c in text)

    def syllables(self, kind: str, name: str, ending: str, script: str) -> str:
        """A drawn name: some syllables, then the ending; in the letter case of the original, which it never is."""
        low, woman = base_form(kind, name.lower(), script)
        draw, out = self.again.get((kind, low), 0), low
        while out == low:
            (number,) = self._numbers(f"{kind}|{script}|{draw}|{low}".encode(), 1)
            parts, out = self.parts[script], ""
            for _ in range(self.length):
                number, k = divmod(number, len(parts))
                out += parts[k]
            out, draw = out + ending, draw + (1 << 32)
        out += _FEMININE[script] if woman else ""
        return out.upper() if name.isupper() and len(name) > 1 else out.capitalize()

    def name_parts(self, title: str | None, name: str) -> list[tuple[str, str, str]]:
        """(kind, part, surrogate) of each word of a name; the last of several, or one behind a title, is the surname."""
        words = name.split()
        given = words[:-1] if len(words) > 1 or title else words
        out = []
        for w in words:
            kind = "initial" if w.endswith(".") else "surname" if len(out) >= len(given) else "given_" + _GENDER.get(w.lower(), "u")
            out.append((kind, w, self._name_word(kind, w)))
        return out

    def _name_word(self, kind: str, word: str) -> str:
        if kind == "initial":
            return self.characters(kind, word)
        script = _script(word)
        if script is None:  # of a script without syllables: letters of the same script
            return self.characters("letters", word)
        return self.syllables(kind, word, _ENDINGS[script][kind.removeprefix("given_")], script)

    def _mentions(self, text: str, known: dict[str, str]) -> Iterator[tuple[int, int, str]]:
        """Where words of known names (by kind) stand capitalised in a text, neighbours as one, and their surrogates."""
        for m in re.finditer(rf"(?<!\w){_CAPITAL}(?:[^\S\n]+{_CAPITAL})*", text):
            run: list[re.Match] = []
            for w in [*re.finditer(_WORD, m[0]), None]:
                if w is not None and w[0].lower() in known:
                    run.append(w)
                elif run:
                    a, b = run[0].start(), run[-1].end()
                    yield m.start() + a, m.start() + b, re.sub(_WORD, lambda x: self._name_word(known[x[0].lower()], x[0]), m[0][a:b])
                    run = []
        # names without case stand anywhere in a run, as such scripts need no spaces
        if caseless := sorted((w for w in known if re.match(_CASELESS, w) and len(w) > 1), key=len, reverse=True):
            for m in re.finditer("|".join(map(re.escape, caseless)), text):
                yield m.start(), m.end(), self._name_word(known[m[0]], m[0])

    def _date(self, text: str) -> str:
        """Another date in the same form; years stay within 1900 to 2029."""
        month = re.search(_MONTHS, text)

        def parts(t: str) -> tuple[int, int, int]:
            if month:
                day, year = (int(x) for x in re.findall(r"\d+", t))
                return year, 1 + _MONTHS.split("|").index(month[0]), day
            a, b, c = (int(x) for x in re.findall(r"\d+", t))
            return (a, b, c) if len(t.split("-")[0]) == 4 else (c, b, a)

        def dated(digits: str) -> bool:
            it = iter(digits)
            year, m, day = parts("".join(next(it) if c.isdecimal() else c for c in text))
            try:
                datetime.date(year, m, day)
            except ValueError:
                # 3/25/1980: the month may come first
                try:
                    datetime.date(year, day, m)
                except ValueError:
                    return False
            return 1900 <= year < 2030

        digits = re.sub(r"\D", "", text)
        year = digits[:4] if text[:4].isdecimal() else digits[-4:]
        rest = digits[4:] if text[:4].isdecimal() else digits[:-4]
        whole = (lambda y, r: y + r) if text[:4].isdecimal() else (lambda y, r: r + y)
        # the day and month, then the year: each is walked to a valid one by itself
        new = self.characters("day", rest, valid=lambda r: dated(whole("2000", r)))
        new_year = self.characters("year", year, valid=lambda y: dated(whole(y, new)))
        it = iter(whole(new_year, new))
        return "".join(next(it) if c.isdecimal() else c for c in text)

    def of(self, kind: str, text: str, title: str | None = None) -> str | None:
        """The surrogate of an entity, None if the text is none after all (a number without its check digit)."""
        if kind == "email":
            local, _, domain = text.rpartition("@")
            last = domain.rfind(".")
            return f"{self.characters('local', local)}@{self.characters('domain', domain[:last])}{domain[last:]}"
        if kind == "ip":
            old = [int(p) for p in text.split(".")]
            return ".".join(map(str, self._walk("ip", old, [256] * 4, lambda v: 0 < v[0] < 255)))
        if kind == "ip6":
            new = self.characters("ip6", text.lower(), _HEX)
            return new.upper() if text.isupper() else new
        if kind == "card":
            digits = re.sub(r"\D", "", text)
            return self._digits("card", text, 0, luhn) if luhn(digits) else None
        if kind == "iban":
            plain = text.replace(" ", "")
            if not _iban_ok(plain):
                return None
            new = plain[:2] + "00" + self.characters("iban", plain[4:].lower()).upper()  # another account, hence another number
            check = 98 - int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97
            it = iter(f"{new[:2]}{check:02d}{new[4:]}")
            return "".join(c if c == " " else next(it) for c in text)
        if kind == "ssn":
            return self._digits("ssn", text, 0, lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00")
        if kind == "phone":
            country = re.match(r"\+(\d{1,3})(?=\D)", text)
            return self._digits("phone", text, len(country[1]) if country else 0)
        if kind in ("secret", "key"):
            hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
            prefix = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|eyJ", text)
            front = len(prefix[0]) if prefix else 0
            if hexadecimal:  # lower case is permuted, so that either case has the same surrogate
                new = self.characters("hex", text.lower(), _HEX)
                return new.upper() if text.isupper() else new
            return text[:front] + self.characters("secret", text[front:])
        if kind == "birth":
            return self._date(text)
        if kind == "passport":
            return self.characters("passport", text)
        if kind == "address":
            parts = re.fullmatch(rf"(?:(?P<n>\d+) (?P<a>.+?) (?P<s>{_STREET})|(?P<b>.+?)(?P<t>straße|strasse|gasse|weg) (?P<m>\d+)(?P<x>[a-z]?))", text)
            number = parts["n"] or parts["m"]
            number = self.characters("house", number, valid=lambda t: t[0] != "0")
            named = " ".join(self._name_word("surname", w) for w in (parts["a"] or parts["b"]).split(" "))
            return f"{number} {named} {parts['s']}" if parts["n"] else f"{named}{parts['t']} {number}{parts['x']}"
        new = iter([s for _, _, s in self.name_parts(title, text)])
        return re.sub(r"\S+", lambda _: next(new), text)

    def replace(self, text: str) -> tuple[str, list[tuple[str, str, str]]]:
        """The text with surrogates, and the (kind, entity, surrogate) found in it, in order; then further mentions of its names, in order."""
        spans: list[tuple[int, int, str, str]] = []
        mentions: list[tuple[int, int, str, str]] = []
        known: dict[str, str] = {}
        for m in entities(text):
            found = {k: v for k, v in m.groupdict().items() if v is not None}
            group = next(k for k in found if k != "title")
            kind = {"untitled": "name", "spaced_ssn": "ssn"}.get(group, group)
            new = self.of(kind, m[group], found.get("title"))
            if new is None:
                continue
            spans.append((m.start(group), m.end(group), kind, new))
            if kind == "name":
                for part, word, _ in self.name_parts(found.get("title"), m[group]):
                    if part != "initial":
                        known.setdefault(word.lower(), part)
        if known:
            between = zip([0, *(e for _, e, _, _ in spans)], [*(b for b, _, _, _ in spans), len(text)], strict=True)
            mentions += [(a + b, a + e, "name", new) for a, z in between for b, e, new in self._mentions(text[a:z], known)]
        out, end = [], 0
        for a, z, _, new in sorted(spans + mentions):
            out += [text[end:a], new]
            end = z
        return "".join(out) + text[end:], [(kind, text[a:z], new) for a, z, kind, new in spans + mentions]


def drawn_names(docs: DataFrame, surrogates: Surrogates, text: str = "text") -> DataFrame:
    """The distinct (kind, name, surrogate) of all names in the corpus, surnames in their form for men."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows = set()
            for t in batch.column(text).to_pylist():
                for m in entities(t) if t else ():
                    found = m.groupdict()
                    if name := found.get("name") or found.get("untitled"):
                        words = {(kind, base_form(kind, part.lower(), _script(part))[0]) for kind, part, _ in surrogates.name_parts(found["title"], name) if kind != "initial"}
                        rows |= {(kind, base, surrogates._name_word(kind, base.capitalize()).lower()) for kind, base in words}
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*sorted(rows), strict=True)], names=["kind", "name", "surrogate"])

    return docs.select(text).mapInArrow(run, "kind string, name string, surrogate string").distinct()


def without_collisions(docs: DataFrame, key: bytes, text: str = "text", parts: dict[str, list[str]] | None = None) -> Surrogates:
    """Surrogates under which no two names of the corpus share one: of names that do, all but the first are drawn again.

    Names get so many syllables that of the corpus' n names n * n / (2 * 40 ** syllables), the expected number of those
    that meet, is small; only names that meet come to the driver, and if there are more than REDRAWN, names get longer.
    """
    surrogates = Surrogates(key, {}, parts or _SYLLABLES)
    known = saved(drawn_names(docs, surrogates, text).select("kind", "name"), "names")
    n = known.count()
    while not parts and n * n / (2 * 40**surrogates.length) > 1000:
        surrogates = Surrogates(key, {}, surrogates.parts, surrogates.length + 1)
    while True:
        shared = known.sparkSession.sparkContext.broadcast(surrogates)

        def draw(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, names = (batch.column(c).to_pylist() for c in ("kind", "name"))
                new = [shared.value._name_word(k, w.capitalize()).lower() for k, w in zip(kinds, names, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("name"), pa.array(new, pa.string())], names=["kind", "name", "surrogate"])

        drawn = known.mapInArrow(draw, "kind string, name string, surrogate string")
        order = Window.partitionBy("surrogate").orderBy("kind", "name")
        later = drawn.withColumn("n", F.row_number().over(order)).where("n > 1").select("kind", "name").limit(REDRAWN + 1).collect()
        shared.destroy()
        if not later:
            return surrogates
        again = dict(surrogates.again)
        for kind, name in later:
            again[kind, name] = again.get((kind, name), 0) + 1
        longer = len(again) > REDRAWN
        surrogates = Surrogates(key, {} if longer else again, surrogates.parts, surrogates.length + longer)


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text", kinds: str = "pii_kinds", count: str = "pii_count", parts: dict[str, list[str]] | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``, the sorted kinds found (comma-joined) and their number.

    Null and empty texts stay as they are with 0 entities; repeated rows change alike; texts of any length are searched
    whole; an empty table gives an empty one.  Columns of the names ``kinds`` and ``count`` are replaced, all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(without_collisions(docs, key, text, parts))
    keep = [c for c in docs.columns if c not in (kinds, count)]
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(kinds, T.StringType()), T.StructField(count, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            new, found = [], []
            for t in batch.column(text).to_pylist():
                changed, entities = (t, []) if not t else shared.value.replace(t)
                new.append(changed)
                found.append(entities)
            columns = [pa.array(new, pa.string()) if c == text else batch.column(c) for c in keep]
            names = pa.array([",".join(sorted({k for k, _, _ in f})) for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, names, pa.array([len(f) for f in found], pa.int64())], names=[*keep, kinds, count])

    return docs.mapInArrow(run, schema)
