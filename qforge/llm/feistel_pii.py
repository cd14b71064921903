"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern and kept only when they validate: card numbers by
length and Luhn sum or a plain group of 13-19 digits, IBANs by the mod-97
check, IP addresses by their octets, dates by the calendar, phone numbers and
national ids by their layout.  A value is turned into a number inside the set
of values of its format, permuted there by a keyed Feistel network (cycle
walking keeps the result in the set), and written back in the same layout:
separators, letter case and lengths stay, check digits are right again if
they were, dates stay dates.  A permutation is one-to-one, so equal values
get equal pseudonyms in every document and different values different ones.

A phone number is its country code (ITU prefixes; national layouts of ten
digits are of country 1) and national digits, a date its day, so one value in
two layouts has one pseudonym.  A number with trunk 0 has no known country
and is linked to its like only.  Dates keep their hundred years (1970-2069
and so on, which a two-digit year belongs to) and whether their day is above
12, so that they read in the same order.

Everything happens inside a row: no shuffle, no state.

Defined cases: a null text stays null with zero counts; text without a
finding is returned as it is; repeated rows give the same result; an empty
table gives no rows; other columns are kept by ``pseudonymize``.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KEY = b"replace-this-key"
KINDS = ("email", "iban", "secret", "ip", "date", "card", "ssn", "phone")
#: Month names by language, full and short.
_MONTHS = [x.split() for x in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre")]
_MONTH = "|".join(sorted({m for names in _MONTHS for m in names} | {"sept"}, key=lambda m: (-len(m), m)))
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b)"
    r"|(?P<secret>\b(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})\b)"
    r"|(?P<ip>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d))"
    r"|(?P<date>(?<!\d)(?:\d{4}(?P<s1>[-/.])\d{1,2}(?P=s1)\d{1,2}|\d{1,2}(?P<s2>[-/.])\d{1,2}(?P=s2)\d{4})(?!\d)"
    r"|(?<![\d./-])(?:\d{1,2}(?P<s3>[-/])\d{1,2}(?P=s3)\d{2}|\d{2}\.\d{2}\.\d{2})(?![\d/-]|\.\d)"
    rf"|(?<![\d.])\d{{1,2}}(?:st|nd|rd|th|\.)?[ -](?:of |de )?(?i:{_MONTH})\.?,?[ -](?:de )?\d{{4}}(?!\d)"
    rf"|\b(?i:{_MONTH})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}(?!\d))"
    r"|(?P<ssn>(?<![\d-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-]))"
    r"|(?P<phone>\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    r"|(?:\+|(?<![\d.])00(?=[1-9]\d{0,2}[ .-]))\d{1,3}[ .-]?(?:\(0\) ?)?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\d.]*\d)"
    r"|(?<![\d.+-])(?:1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])\d{3}[ .-]\d{4}(?![\d-]|\.\d)"
    r"|(?<![\d.+/-])(?=\(?0)(?=(?:[ ()/-]{0,3}\d){9,12}(?![ /-]?\d))(?:\(0\d{1,4}\) ?|0\d{1,4}[ /-])\d{2,8}(?:[ -]\d{2,4}){0,4}(?![\d/-]|\.\d))"
    r"|(?P<card>(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]))")
#: Alphabets that stay within themselves.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
              "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])),
              "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)])))
_CLASS = {c: a for a in _ALPHABETS for c in a}
#: ITU country codes of one and two digits; all others have three.
_SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 "
                         "65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def permute(value: int, size: int, key: bytes, tweak: bytes, rounds: int = 8) -> int:
    """Keyed permutation of 0..size-1: balanced Feistel on the next even bit width, walked into the range."""
    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    mask, nbytes = (1 << half) - 1, -(-half // 8)
    while True:
        left, right = value >> half, value & mask
        for i in range(rounds):
            mixed = hashlib.blake2b(right.to_bytes(nbytes, "big") + bytes([i]) + size.to_bytes(-(-size.bit_length() // 8), "big"),
                                    key=key, person=tweak[:16], digest_size=min(64, nbytes + 8)).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _characters(text: str, key: bytes, tweak: str, alphabets=None) -> str:
    """Permute the letters and digits of ``text``, each within its own alphabet."""
    own = [(alphabets or _CLASS).get(c) for c in text]
    value, size = 0, 1
    for c, a in zip(text, own):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    if size == 1:
        return text
    value, out = permute(value, size, key, tweak.encode()), []
    for c, a in zip(reversed(text), reversed(own)):
        if a:
            value, digit = divmod(value, len(a))
            c = a[digit]
        out.append(c)
    return "".join(reversed(out))


def _ssn(value: str, key: bytes) -> str:
    """Area 001-899 without 666, group 01-99, serial 0001-9999: valid numbers among themselves."""
    area, group, serial = map(int, value.split("-"))
    area -= 1 + (area > 666)
    new = permute((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, key, b"ssn")
    new, serial = divmod(new, 9999)
    area, group = divmod(new, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def luhn_digit(digits: str) -> str:
    """Check digit of ``digits``."""
    total = sum(int(d) if i % 2 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _card(value: str, key: bytes) -> str | None:
    digits = [c for c in value if c.isdigit()]
    if len(digits) != len([c for c in value if c not in " -"]) or not 13 <= len(digits) <= 19:
        return None
    plain = "".join(digits)
    if luhn_digit(plain[:-1]) == plain[-1]:
        new = _characters(plain[:-1], key, "card")
        new += luhn_digit(new)
    elif " " in value or "-" in value:
        return None  # groups of digits that are no card number
    else:
        new = _characters(plain, key, "number")
        while luhn_digit(new[:-1]) == new[-1]:  # stay among the numbers without a valid sum
            new = _characters(new, key, "number")
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in value)


def _iban(value: str, key: bytes) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    body = _characters(plain[4:], key, "iban")
    new = iter(f"{plain[:2]}{98 - _mod97(body + plain[:2] + '00'):02d}{body}")
    return "".join(c if c == " " else next(new) for c in value)


def _ip(value: str, key: bytes) -> str | None:
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255:
        return None
    new = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


@lru_cache(maxsize=128)
def _days(block: int, late: bool) -> array:
    """Ordinals of the days of a hundred years, those up to the 12th of a month or those after."""
    first, end = dt.date(max(1, 100 * block - 30), 1, 1).toordinal(), dt.date(min(9999, 100 * block + 69), 12, 31).toordinal()
    return array("l", (n for n in range(first, end + 1) if (dt.date.fromordinal(n).day > 12) == late))


def _permuted_day(year: int, month: int, day: int, key: bytes) -> dt.date | None:
    try:
        at = dt.date(year, month, day).toordinal()
    except ValueError:
        return None
    block, late = (year + 30) // 100, day > 12
    days = _days(block, late)
    return dt.date.fromordinal(days[permute(bisect_left(days, at), len(days), key, b"date%d%d" % (block, late))])


def _named_date(value: str, name: re.Match, key: bytes) -> str | None:
    """A date with the name of its month."""
    word = name.group()
    low = "sep" if word.lower() == "sept" else word.lower()
    number = {m.start(): m for m in re.finditer(r"\d+", value)}
    year, day = max(number), min(number)
    # names shared by languages: the language of the other words cannot be known, the first is taken
    names = next(x for x in _MONTHS if low in x)
    new = _permuted_day(int(number[year].group()), names.index(low) + 1, int(number[day].group()), key)
    if new is None:
        return None
    month = names[new.month - 1]
    month = month.upper() if word.isupper() else month.title() if word[0].isupper() else month
    text = f"{new.day:02d}" if number[day].group()[0] == "0" else str(new.day)
    end = number[day].end()
    suffix = re.match(r"st|nd|rd|th", value[end:])
    if suffix:
        text += "th" if 10 < new.day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(new.day % 10, "th")
        end += 2
    parts = sorted([(day, end, text), (*name.span(), month), (year, number[year].end(), f"{new.year:04d}")])
    out, at = "", 0
    for a, b, x in parts:
        out, at = out + value[at:a] + x, b
    return out + value[at:]


def _date(value: str, key: bytes) -> str | None:
    """Year first, else day first if that is a date, else month first."""
    if name := re.search(rf"(?i:{_MONTH})", value):
        return _named_date(value, name, key)
    sep = re.search(r"\D", value).group()
    given = value.split(sep)
    parts = [int(x) for x in given]
    for order in ((0, 1, 2),) if len(given[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        year, month, day = (parts[i] for i in order)
        if short := len(given[order[0]]) == 2:
            year += 2000 if year < 70 else 1900
        new = _permuted_day(year, month, day, key)
        if new is None:
            continue
        wide = 2 if all(len(given[i]) == 2 for i in order[1:]) else 1
        text = [f"{new.year % 100:02d}" if short else f"{new.year:04d}", f"{new.month:0{wide}d}", f"{new.day:0{wide}d}"]
        return sep.join(text[order.index(i)] for i in range(3))
    return None


def _phone(value: str, key: bytes) -> str | None:
    """Permute the national digits under their country code."""
    at = [i for i, c in enumerate(value) if c.isdigit()]
    digits = "".join(value[i] for i in at)
    if value[0] == "+" or digits.startswith("00"):
        skip = 0 if value[0] == "+" else 2
        n = next((n for n in (1, 2) if digits[skip:skip + n] in _SHORT_CODES), 3)
        code, skip = digits[skip:skip + n], skip + n
        if (trunk := value.find("(0)")) >= 0 and at[skip] == trunk + 1:
            skip += 1
    elif digits[0] == "0":
        code, skip = "", 1
    else:
        code, skip = "1", len(digits) - 10
    if skip >= len(digits):
        return None
    new = list(value)
    for i, c in zip(at[skip:], _characters(digits[skip:], key, f"phone{code}")):
        new[i] = c
    return "".join(new)


def _email(value: str, key: bytes) -> str:
    local, _, domain = value.rpartition("@")
    host, dot, top = domain.rpartition(".")
    return f"{_characters(local, key, 'local')}@{_characters(host, key, 'domain')}{dot}{top}"


_HEX = {c: a for a in ("0123456789abcdef",) for c in a}
_UPPER_HEX = {c: a for a in ("0123456789ABCDEF",) for c in a}
_REPLACE = {
    "email": _email, "iban": _iban, "ip": _ip, "date": _date, "card": _card,
    "secret": lambda v, k: _characters(v, k, "hex", _HEX if v == v.lower() else _UPPER_HEX),
    "ssn": _ssn,
    "phone": _phone,
}


def pseudonymize_text(text: str | None, key: bytes = KEY) -> tuple[str | None, dict[str, int]]:
    counts = dict.fromkeys(KINDS, 0)
    if not text:
        return text, counts

    def swap(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup in _REPLACE else next(k for k in KINDS if m.group(k) is not None)
        new = _REPLACE[kind](m.group(), key)
        if new is None:
            return m.group()
        counts[kind] += 1
        return new

    return _PATTERN.sub(swap, text), counts


_MAY_MATTER = re.compile(r"[\d@]")


def pseudonymize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bytes = KEY) -> DataFrame:
    """Per document: id, the text with pseudonyms, and how many values of each kind were replaced."""
    names = ["id", "t", *(f"n_{k}" for k in KINDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "t"):
            none = dict.fromkeys(KINDS, 0)
            found = [pseudonymize_text(t, key) if t and _MAY_MATTER.search(t) else (t, none)
                     for t in part.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array([f[0] for f in found], pa.string()),
                 *(pa.array([f[1][k] for f in found], pa.int64()) for k in KINDS)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, t string, " + ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, schema) \
        .withColumnsRenamed({"id": id_col, "t": text_col})
