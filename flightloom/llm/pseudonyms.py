"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation.

Numbers and dates that pass the check of their kind are mapped to others of the same format that pass it
too. The map of a kind is one permutation for a key, so equal values stay equal across documents and
different values stay different. Kinds, tried in this order at each place: email (local part of at most 64
characters; it and the domain but for its last label are mapped apart, so equal domains stay equal too), iban (mod 97; of a run of
groups the part of its country's length, else the longest that passes), date (calendar; one map whatever the order of day, month and
year, within the dates up to the 12th and those after it, as the order can be read from the latter only), ip (octets), ssn (area,
group, serial), phone (an exchange from 200 on, digits that aren't all one), card (13 to 19 digits, Luhn). Mapped values pass
the same checks. Where a check fails the value is left as it is, and other kinds are sought from the next character on.

The key is the caller's: who has it can undo the map. Patterns are bounded, so a text takes time in proportion to its length.

Defined results: a null text stays null with counts 0; an empty text stays empty; repeated rows are treated
each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from flightloom.llm._text import pieces, strings, tidy

ROUNDS = 10
KINDS = ("email", "iban", "date", "ip", "ssn", "phone", "card")

# The forms in which the kinds are written.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9][A-Za-z0-9-]{0,62}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,63}",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "date": r"(?<![0-9./-])(?:(?:1[0-9]|20)[0-9]{2}(?P<a>[-/.])[0-9]{2}(?P=a)[0-9]{2}|[0-9]{2}(?P<b>[-/.])[0-9]{2}(?P=b)(?:1[0-9]|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?P<c>[ -])[0-9]{6}(?P=c)[0-9]{5}|(?:[0-9]{4}[ -]){3}[0-9]{4}|[0-9]{13,19})(?![0-9A-Za-z])",
}
#: IBAN lengths of countries, which tell an IBAN from words or numbers after it.
LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21"
    " LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
FINDER = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
_HINT = re.compile(r"@|[0-9]{2}|[0-9]\.[0-9]")
FIRST_DAY, LAST_DAY = date(1000, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


class Permutation:
    """A keyed bijection of range(n) for any n: balanced Feistel network with cycle walking."""

    def __init__(self, key: bytes):
        self.key = key
        self.forward = lru_cache(1 << 16)(self._forward)

    def _round(self, tweak: bytes, i: int, half: int, width: int) -> int:
        size = (width + 7) // 8
        made = hashlib.blake2b(half.to_bytes(size, "big"), key=self.key[:64], digest_size=min(64, size), salt=i.to_bytes(2, "big"), person=hashlib.blake2b(tweak, digest_size=16).digest())
        return int.from_bytes(made.digest(), "big") & ((1 << width) - 1)

    def _once(self, x: int, width: int, tweak: bytes, back: bool) -> int:
        left, right = x >> width, x & ((1 << width) - 1)
        for i in range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, ROUNDS - 1 - i, left, width), left
            else:
                left, right = right, left ^ self._round(tweak, i, right, width)
        return left << width | right

    def _walk(self, x: int, n: int, tweak: bytes, back: bool) -> int:
        if n < 2:
            return x
        width = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, width, tweak, back)
            if x < n:
                return x

    def _forward(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, False)

    def backward(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, True)


def luhn(digits: str) -> int:
    """Remainder of the Luhn sum; 0 for valid numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _iban_part(value: str) -> str:
    """The leading groups of a match that are an IBAN; empty: none."""
    parts = [value[: m.end()] for m in re.finditer("[A-Z0-9]+", value)]
    sizes = [(len(part) - part.count(" "), part) for part in reversed(parts)]
    valid = [(size, part) for size, part in sizes if 15 <= size <= 34 and _mod97(part.replace(" ", "")) == 1]
    own = [part for size, part in valid if size == LENGTHS.get(value[:2])]
    return own[0] if own else valid[0][1] if valid else ""


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


class Pseudonymiser:
    """Finds and replaces the values of a text. A mapped value is found and valid again, so it can be undone."""

    def __init__(self, key: bytes, back: bool = False):
        made = Permutation(hmac.new(key, b"feistel", hashlib.sha256).digest())
        self.move = made.backward if back else made.forward

    def _mixed(self, text: str, tweak: bytes) -> str:
        """Permutes letters and digits of a text among those of the same classes."""
        sizes = [10 if c.isdigit() else 26 if c.isalpha() else 0 for c in text]
        n = x = 0
        n = 1
        for c, size in zip(text, sizes):
            if size:
                x = x * size + (ord(c) - 48 if size == 10 else _LETTERS.index(c.lower()))
                n *= size
        x, out = self.move(x, n, tweak + str(sizes).encode()), []
        for c, size in zip(reversed(text), reversed(sizes)):
            if not size:
                out.append(c)
                continue
            x, d = divmod(x, size)
            made = chr(48 + d) if size == 10 else _LETTERS[d]
            out.append(made.upper() if c.isupper() else made)
        return "".join(reversed(out))

    def email(self, value: str) -> str:
        name, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        return f"{self._mixed(name, b'email')}@{self._mixed(host, b'domain')}.{top}"

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
            return None
        body = self._mixed(plain[4:], b"iban" + plain[:2].encode())
        checked = f"{98 - _mod97(plain[:2] + '00' + body):02d}"
        it = iter(plain[:2] + checked + body)
        return "".join(c if c == " " else next(it) for c in value)

    def date(self, value: str) -> str | None:
        first = value[4] in "-/."
        parts = re.split("[-/.]", value)
        for month_first in (False, True):
            try:
                y, m, d = (int(parts[0]), int(parts[1]), int(parts[2])) if first else (int(parts[2]), int(parts[0 if month_first else 1]), int(parts[1 if month_first else 0]))
                day = date(y, m, d).toordinal()
            except ValueError:
                if first:
                    return None
                continue
            break
        else:
            return None
        late, new = d > 12, None
        while new is None or (new.day > 12) != late:
            day = FIRST_DAY + self.move(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date")
            new = date.fromordinal(day)
        y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        sep = value[4] if first else value[2]
        return sep.join((y, m, d) if first else (m, d, y) if month_first else (d, m, y))

    def ip(self, value: str) -> str | None:
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        made = self.move(int.from_bytes(bytes(octets), "big"), 1 << 32, b"ip")
        return ".".join(map(str, made.to_bytes(4, "big")))

    @staticmethod
    def _ssn_ok(digits: str) -> bool:
        return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"

    def ssn(self, value: str) -> str | None:
        digits = value.replace("-", "")
        if not self._ssn_ok(digits):
            return None
        while True:
            digits = f"{self.move(int(digits), 10**9, b'ssn'):09d}"
            if self._ssn_ok(digits):
                return _refill(value, digits)

    @staticmethod
    def _phone_ok(digits: str) -> bool:
        return digits[3] >= "2" and len(set(digits)) > 1

    def phone(self, value: str) -> str | None:
        digits = re.sub("[^0-9]", "", value)
        own = digits[-10:]
        if not self._phone_ok(own):
            return None
        while True:
            own = f"{self.move(int(own), 10**10, b'phone'):010d}"
            if self._phone_ok(own):
                return _refill(value, digits[:-10] + own)

    def card(self, value: str) -> str | None:
        digits = re.sub("[^0-9]", "", value)
        if luhn(digits):
            return None
        body = f"{self.move(int(digits[:-1]), 10 ** (len(digits) - 1), b'card' + bytes([len(digits)])):0{len(digits) - 1}d}"
        last = next(str(d) for d in range(10) if not luhn(body + str(d)))
        return _refill(value, body + last)

    def text(self, text: str | None) -> tuple[str | None, list[int]]:
        """The text with pseudonyms, and how many values of each kind it held."""
        counts = [0] * len(KINDS)
        if not text or not _HINT.search(text):
            return text, counts
        out, done, at = [], 0, 0
        while m := FINDER.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            value = _iban_part(m[0]) if kind == "iban" else m[0]
            made = getattr(self, kind)(value) if value else None
            if made is None:
                at = m.start() + 1
                continue
            counts[KINDS.index(kind)] += 1
            out += [text[done : m.start()], made]
            done = at = m.start() + len(value)
        return "".join([*out, text[done:]]), counts


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind> for every whole text."""

    def run(batches):
        made = Pseudonymiser(key)
        for batch in batches:
            size = strings(batch.column(1))
            for lo, hi in pieces(size):
                got = [made.text(t) for t in batch.column(1)[lo:hi].to_pylist()]
                counts = list(zip(*(c for _, c in got)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi].cast(pa.int64()), pa.array([t for t, _ in got], pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["doc_id", "text", *(f"n_{k}" for k in KINDS)])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
