"""Format-preserving pseudonyms for personal data.

Validated values (cards by their check digit, dates by the calendar, addresses by their
ranges, ...) are replaced by another valid value of the same format. The replacement is a
keyed permutation of that format, a Feistel network on two halves of the value's digits
and letters, so equal values get equal pseudonyms in all documents, different values
different ones, and who has the key can undo it.

Kinds: email (local part), phone, card (Luhn), ip (IPv4), ssn, iban (mod 97), date
(1900-2099, year-month-day, day.month.year, month/day/year or day/month/year), key
(access keys ``AKIA...``), secret (values of password, token, secret, api_key).

Defined cases: a null text stays null and an empty one empty; a value that fails its
validation is left alone; where kinds overlap the first in the text wins, then the
longer; rows are independent, so repeated rows and ids stay; a text of any length is read
whole. Every other column passes through.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shaped, small_batches
from .words import boxed

ROUNDS = 10
# halves of up to LONG / 2 places are below 2**113, so a draw of 256 bits is as good as uniform
LONG = 48
KINDS = ("email", "phone", "card", "ip", "ssn", "iban", "date", "key", "secret")
_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


# --- the permutation --------------------------------------------------------------------


class Feistel:
    """Keyed permutations of mixed-radix numbers."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key[:64], back

    def _draw(self, kind: str, n: int, half: int, radices: bytes) -> int:
        said = f"{kind}|{n}|{half}|".encode() + radices
        return int.from_bytes(hashlib.blake2b(said, key=self.key, digest_size=32).digest(), "big")

    def _steps(self, kind: str, n: int, half: np.ndarray, radices: np.ndarray) -> np.ndarray:
        """A draw below each of ``radices``, 64 bits each, from all of the other half."""
        said = f"{kind}|{n}|{len(half)}|{len(radices)}|".encode() + half.tobytes() + radices.tobytes()
        seed = hashlib.blake2b(said, key=self.key, digest_size=64).digest()
        drawn = np.frombuffer(hashlib.shake_256(seed).digest(8 * len(radices)), dtype="<u8")
        return (drawn % radices.astype(np.uint64)).astype(np.int64)

    def _long(self, kind: str, values: list[int], radices: list[int]) -> list[int]:
        """The network for values of any length: halves are added place by place."""
        cut = len(values) // 2
        v, r = np.array(values, dtype=np.int64), np.array(radices, dtype=np.int64)
        sides = [slice(0, cut), slice(cut, None)]
        for n in reversed(range(ROUNDS)) if self.back else range(ROUNDS):
            own, other = sides[n % 2], sides[1 - n % 2]
            step = self._steps(kind, n, v[other], r[own])
            v[own] = (v[own] - step if self.back else v[own] + step) % r[own]
        return v.tolist()

    def digits(self, kind: str, values: list[int], radices: list[int]) -> list[int]:
        """Permute ``values`` with values[i] < radices[i]."""
        if len(values) > LONG:
            return self._long(kind, values, radices)
        cut = len(values) // 2
        shape = ",".join(map(str, radices)).encode()
        left, a = _number(values[:cut], radices[:cut])
        right, b = _number(values[cut:], radices[cut:])
        rounds = range(ROUNDS)
        for n in reversed(rounds) if self.back else rounds:
            if n % 2 == 0:
                step = self._draw(kind, n, right, shape) % a
                left = (left - step if self.back else left + step) % a
            else:
                step = self._draw(kind, n, left, shape) % b
                right = (right - step if self.back else right + step) % b
        return _values(left, radices[:cut]) + _values(right, radices[cut:])

    def number(self, kind: str, value: int, size: int, valid=lambda v: True) -> int:
        """Permute the valid numbers below ``size`` by walking the cycle of a square."""
        side = max(1, int(size**0.5))
        side += side * side < size
        while True:
            high, low = self.digits(kind, list(divmod(value, side)), [side, side])
            value = high * side + low
            if value < size and valid(value):
                return value


def _number(values: list[int], radices: list[int]) -> tuple[int, int]:
    out, size = 0, 1
    for v, r in zip(values, radices):
        out, size = out * r + v, size * r
    return out, size


def _values(number: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        number, v = divmod(number, r)
        out.append(v)
    return out[::-1]


# --- formats ----------------------------------------------------------------------------


def _characters(f: Feistel, kind: str, text: str, hexadecimal: bool = False) -> str:
    """Digits to digits and ASCII letters to letters of their case; the rest stays."""
    last = 6 if hexadecimal else 26
    places, values, radices, bases = [], [], [], []
    for i, c in enumerate(text):
        base, radix = ("0", 10) if "0" <= c <= "9" else ("a", last) if "a" <= c <= "z" else ("A", last)
        if c.isascii() and c.isalnum():
            places.append(i)
            values.append(ord(c) - ord(base))
            radices.append(radix)
            bases.append(base)
    out = list(text)
    for i, v, base in zip(places, f.digits(kind, values, radices) if values else [], bases):
        out[i] = chr(ord(base) + v)
    return "".join(out)


def luhn_digit(payload: str) -> int:
    """The digit that makes payload + digit pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _card(f: Feistel, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
        return None
    body = [int(c) for c in digits[1:-1]]
    payload = digits[0] + "".join(map(str, f.digits("card", body, [10] * len(body))))
    return _refill(text, payload + str(luhn_digit(payload)))


def _phone(f: Feistel, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    plus = text.startswith("+")
    north = (not plus or digits.startswith("1")) and len(digits) == 10 + digits.startswith("1")
    if north and (len(digits) == 10 or digits[0] == "1"):
        own = digits[-10:]
        if own[0] not in "01" and own[3] not in "01":
            base = [2 if i in (0, 3) else 0 for i in range(10)]
            new = f.digits(
                "phone", [int(c) - b for c, b in zip(own, base)], [10 - b for b in base]
            )
            return _refill(text, digits[:-10] + "".join(str(v + b) for v, b in zip(new, base)))
    if not plus or not 8 <= len(digits) <= 15:
        return None
    own = [int(c) for c in digits[3:]]
    new = f.digits("phone", own, [10] * len(own))
    return _refill(text, digits[:3] + "".join(map(str, new)))


def _ip(f: Feistel, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if not 1 <= parts[0] <= 223 or max(parts) > 255:
        return None
    new = f.digits("ip", [parts[0] - 1, *parts[1:]], [223, 256, 256, 256])
    return ".".join(map(str, [new[0] + 1, *new[1:]]))


def _ssn(f: Feistel, text: str) -> str | None:
    area, group, serial = int(text[:3]), int(text[4:6]), int(text[7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    area -= 1 + (area > 666)  # 898 areas
    area, group, serial = f.digits("ssn", [area, group - 1, serial - 1], [898, 99, 9999])
    area += 1 + (area >= 665)
    return f"{area:03d}{text[3]}{group + 1:02d}{text[6]}{serial + 1:04d}"


def _iban(f: Feistel, text: str) -> str | None:
    plain = text.replace(" ", "")

    def rest(country: str, check: str, body: str) -> int:
        return int("".join(str(int(c, 36)) for c in body + country + check)) % 97

    country, check, body = plain[:2], plain[2:4], plain[4:]
    if rest(country, check, body) != 1:
        return None
    body = _characters(f, "iban", body)
    new = iter(f"{country}{98 - rest(country, '00', body):02d}{body}")
    return "".join(c if c == " " else next(new) for c in text)


def _date(f: Feistel, text: str) -> str | None:
    numbers = [int(n) for n in re.split(r"\D", text)]
    if "." in text:
        orders = ("dmy",)
    elif "-" in text:
        orders = ("ymd",)
    else:
        orders = ("mdy", "dmy")
    for order in orders:
        given = dict(zip(order, numbers))
        try:
            day = date(given["y"], given["m"], given["d"]).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        # a date that only reads as day/month stays one
        late = "/" in text and order == "dmy"
        new = date.fromordinal(
            _FIRST_DAY
            + f.number(
                f"date{late:d}",
                day,
                _DAYS,
                lambda v: not late or date.fromordinal(_FIRST_DAY + v).day > 12,
            )
        )
        put = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        marks = iter(re.findall(r"\D", text))
        return "".join(put[c] + next(marks, "") for c in order)
    return None


_NUMERIC = re.compile(
    r"""(?<![\w.+-])(?:
      (?P<ip>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?!\.?\d)
    | (?P<date>\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})
    | (?P<ssn>\d{3}([- ])\d{2}\4\d{4})
    | (?P<card>\d{13,19}|\d{4}([- ])\d{4}\6\d{4}\6\d{4}|\d{4}([- ])\d{6}\7\d{5})
    | (?P<phone>(?:\+?1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}
              |\+\d{1,3}(?:[ .-]?\(?\d{2,5}\)?){2,5})
    )(?![\w-])""",
    re.VERBOSE | re.ASCII,
)
_REGION = re.compile(r"[+(]?[+(]?\d[\d .\-/()]{6,}", re.ASCII)
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_LOCAL = _LETTERS | frozenset("._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", re.ASCII)
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA([0-9A-Z]{16})(?![A-Za-z0-9])", re.ASCII)
_SECRET = re.compile(
    r"(?i:password|passwd|token|secret|api_key)\s{0,3}[=:]\s{0,3}[\"']?([^\s\"']{6,})", re.ASCII
)
_IBAN = re.compile(
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    re.ASCII,
)
_BY_KIND = {"ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone, "iban": _iban}


def _local_parts(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the local parts of e-mail addresses, read outwards from each @."""
    low, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at)
        if domain:
            start = at
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            while start < at and text[start] not in _LETTERS:
                start += 1
            if start < at:
                yield start, at
                low = domain.end()
        at = text.find("@", at + 1)


def replacements(f: Feistel, text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, new) of every validated value, in order and apart."""
    found: list[tuple[int, int, str, str]] = []

    def note(start: int, end: int, kind: str) -> None:
        new = _BY_KIND[kind](f, text[start:end])
        if new is not None:
            found.append((start, end, kind, new))

    for region in _REGION.finditer(text):
        # to one character behind, so that what follows a value is seen
        for m in _NUMERIC.finditer(text, region.start(), min(len(text), region.end() + 1)):
            note(*m.span(), m.lastgroup if m.lastgroup in _BY_KIND else _group(m))
    for start, end in _local_parts(text):
        found.append((start, end, "email", _characters(f, "email", text[start:end])))
    if "AKIA" in text:
        for m in _KEY.finditer(text):
            found.append((*m.span(1), "key", _characters(f, "key", m[1])))
    for m in _SECRET.finditer(text) if _LIKELY.search(text) else ():
        is_hex = re.fullmatch(r"[0-9a-f]+", m[1]) is not None
        found.append((*m.span(1), "secret", _characters(f, "secret", m[1], is_hex)))
    for m in _IBAN.finditer(text):
        note(*m.span(), "iban")
    found.sort(key=lambda x: (x[0], -x[1]))
    apart, end = [], 0
    for x in found:
        if x[0] >= end:
            apart.append(x)
            end = x[1]
    return apart


_LIKELY = re.compile(r"[=:]")


def _group(m: re.Match) -> str:
    return next(k for k in _BY_KIND if k in m.re.groupindex and m[k] is not None)


def replace(f: Feistel, text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and (start, end, kind) of the values in the given text."""
    spans = replacements(f, text)
    if not spans:
        return text, []
    out, at = [], 0
    for start, end, _, new in spans:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), [x[:3] for x in spans]


# --- on DataFrames ----------------------------------------------------------------------

FOUND = "array<struct<start:int,end:int,kind:string>>"


@functools.lru_cache(maxsize=4)
def _feistel(key: bytes, back: bool) -> Feistel:
    return Feistel(key, back)


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """document STRUCT (a row of ``docs`` as given), text STRING (with pseudonyms),
    found ARRAY<STRUCT<start, end, kind>> (places in the given text).

    ``back`` undoes it with the same key.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(
        boxed(docs),
        F.col("text").cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = _feistel(key, back)
        item = pa.list_(
            pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
        )
        for batch in batches:
            done = [
                (None, []) if t is None else replace(f, t) for t in batch.column(1).to_pylist()
            ]
            found = [[dict(zip(("start", "end", "kind"), s)) for s in spans] for _, spans in done]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array(found, item)],
                names=["document", "text", "found"],
            )

    return rows.mapInArrow(run, shaped(rows, "document", f"text string, found {FOUND}"))


def pseudonymised_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """The documents with pseudonyms in ``text`` (and ``n_chars`` to match, if there is one)."""
    done = pseudonymise(docs, key)
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return done.select(
        *[new[c].alias(c) if c in new else F.col("document")[c].alias(c) for c in docs.columns]
    )
