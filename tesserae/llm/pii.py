"""Operator 1: personal data, replaced by format-preserving Feistel pseudonyms.

A found value is validated (Luhn, mod 97, octets, calendar), brought to one canonical form of its kind, read as
an integer of that form's domain, sent through a keyed Feistel permutation of it (cycle-walking keeps it inside)
and written back in the shape it was found in. So equal values get equal pseudonyms in all documents, whatever
their separators, without any table of values, and whoever holds the key can invert them. What doesn't validate
stays as it is.

Canonical forms. Card: its digits; the first one stays, the last is computed. Phone: country code by the table of
calling codes (it stays; ten digits without a plus are of country 1) and national digits; a trunk zero in
brackets is no digit of it; a first digit that isn't zero, and digits above one at the head of area and exchange
codes of country 1, stay so. IBAN: country and account; letters become letters, digits digits, check digits are
computed. Date: year, month and day, permuted among the dates whose month and day have as many digits and whose
day is above 12 or not alike: a date is one value whether written year first, day first, or month first with a
day above 12, padded or not, and its pseudonym is read the same way again. A date with slashes or dots is read
day first and, where that is no date, month first. Mail address: its letters and digits, local part and each
label of the domain by itself; case stays at its place; the last label stays. Secret: quoted tokens of 20
characters or more, lower-case hex runs of 32 or more, in blocks of BLOCK characters.

Scale: one narrow pass; no shuffle, no state; memory is one Arrow batch. Python, since the permutation works
on integers of up to 130 bits.

Defined cases: a null text stays null; empty and clean texts come back unchanged; null ids stay; very long texts
are searched whole; repeated rows are handled alike; an empty table gives no rows; an empty key is an error;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import sys
import warnings
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from .common import table

ROUNDS = 10
KEY_CONF = "spark.tesserae.pii.key"
#: Known to all, so it hides nothing: what the registered query takes, with a warning, where the session has no key.
PUBLIC_KEY = "change-me"
#: Symbols of a secret that are permuted together.
BLOCK = 64

#: Rarely met characters lead each search: a digit, a plus or a bracket; an at sign; a quote or long hex run.
NUMBERS = re.compile(r"[+(]?[0-9][0-9 ().\-/]*[0-9]")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+\-]+\Z")
EMAIL_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
SECRET = re.compile(r"""(?<=["'])[0-9A-Za-z_\-]{20,}+(?=["'])|(?<![0-9A-Za-z])[0-9a-f]{32,}+(?![0-9A-Za-z])""")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")
IPV4 = re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])")
CARD = re.compile(r"(?<![\w\-+])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![\w])")
PHONE = re.compile(r"(?<![\w+])(?:\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\+(?!1[ .\-(])[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[.\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4})(?!\w)")
SSN = re.compile(r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])")
ISO_DATE = re.compile(r"(?<![\w\-])([0-9]{4})-([0-9]{2})-([0-9]{2})(?![0-9]|-[0-9])")
YEAR_FIRST = re.compile(r"(?<![\w/])([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})(?![0-9]|/[0-9])")
DAY_MONTH = re.compile(r"(?<![\w/.])([0-9]{1,2})([/.])([0-9]{1,2})\2([0-9]{4})(?![0-9]|[/.][0-9])")
#: Countries by the length of their IBANs (ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# Calling codes of one and of two digits (ITU E.164); all others have three.
ONE_DIGIT = "1 7".split()
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
IBAN_LENGTH = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of 0..size-1, one for each kind."""

    def __init__(self, key: str):
        if not key:
            raise ValueError("pseudonyms need a key")
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self._dates: dict[tuple[int, int], list[int]] = {}

    def dates(self) -> dict[tuple[int, int], list[int]]:
        """The ordinals of all dates that may stand for one another."""
        if not self._dates:
            for n in range(FIRST_DAY, LAST_DAY + 1):
                self._dates.setdefault(_kind_of_date(datetime.date.fromordinal(n)), []).append(n)
        return self._dates

    def _pass(self, kind: str, half: int, value: int, order) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        for r in order:
            f = hashlib.blake2b(f"{kind}:{half}:{r}:{right}".encode(), key=self.key, digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        return (right << half) | left  # halves swapped, so that the reversed order inverts

    def permute(self, kind: str, size: int, value: int, inverse: bool = False) -> int:
        if size < 2:
            return value
        half = ((size - 1).bit_length() + 1) // 2
        order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
        while True:
            value = self._pass(f"{kind}/{size}", half, value, order)
            if value < size:
                return value

    def symbols(self, kind: str, text: str, alphabets: list[str], inverse: bool = False) -> str:
        """Permutes a string among those with a character of the same alphabet at each place."""
        n, size = 0, 1
        for c, x in zip(text, alphabets, strict=True):
            n, size = n * len(x) + x.index(c), size * len(x)
        n, out = self.permute(kind, size, n, inverse), []
        for x in reversed(alphabets):
            n, k = divmod(n, len(x))
            out.append(x[k])
        return "".join(reversed(out))

    def blocks(self, kind: str, text: str, alphabets: list[str], inverse: bool = False) -> str:
        """Like symbols, for texts of any length: each block by itself, by its place."""
        at = range(0, len(text), BLOCK)
        return "".join(self.symbols(f"{kind}{k}" if k else kind, text[k : k + BLOCK], alphabets[k : k + BLOCK], inverse) for k in at)

    def digits(self, kind: str, text: str, inverse: bool = False) -> str:
        return self.symbols(kind, text, [DIGITS] * len(text), inverse)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _reshape(shape: str, symbols: str) -> str:
    """The shape with its letters and digits replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


DIGITS, HEX, LETTERS = "0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz"


def card(f: Feistel, m: re.Match, inverse: bool = False) -> str | None:
    d = _digits(m[0])
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    payload = d[0] + f.digits("card", d[1:-1], inverse)
    return _reshape(m[0], payload + luhn_digit(payload))


def phone(f: Feistel, m: re.Match, inverse: bool = False) -> str | None:
    shape = m[0].replace("(0)", "(\0)", 1) if m[0][0] == "+" else m[0]
    d = _digits(shape)
    if not 9 <= len(d) <= 15:
        return None
    n = 0 if m[0][0] != "+" else 1 if d[0] in ONE_DIGIT else 2 if d[:2] in TWO_DIGITS else 3
    country, own = d[:n] or "1", d[n:]
    alphabets = [DIGITS] * len(own)
    for k in (0, 3) if country == "1" and len(own) == 10 else (0,):
        alphabets[k] = next(x for x in (("01", "23456789") if country == "1" else ("0", "123456789")) if own[k] in x)
    return _reshape(shape, d[:n] + f.symbols("phone" + country, own, alphabets, inverse)).replace("\0", "0")


def ssn(f: Feistel, m: re.Match, inverse: bool = False) -> str | None:
    area, group, serial = int(m[0][:3]), int(m[0][4:6]), int(m[0][7:])
    if not (0 < area < 900 and area != 666 and group and serial):
        return None
    area -= 1 + (area > 666)  # 0..897
    n = f.permute("ssn", 898 * 99 * 9999, (area * 99 + group - 1) * 9999 + serial - 1, inverse)
    n, serial = divmod(n, 9999)
    area, group = divmod(n, 99)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


def iban(f: Feistel, m: re.Match, inverse: bool = False) -> str | None:
    v = m[0].replace(" ", "")
    number = lambda country, bban, check: int("".join(str(int(c, 36)) for c in bban + country + check))
    if not 15 <= len(v) <= 34 or number(v[:2], v[4:], v[2:4]) % 97 != 1:
        return None
    bban = f.symbols("iban" + v[:2], v[4:], [DIGITS if c.isdigit() else LETTERS.upper() for c in v[4:]], inverse)
    return v[:2] + _reshape(m[0][2:], f"{98 - number(v[:2], bban, '00') % 97:02}" + bban)


def iban_ends(m: re.Match) -> list[int]:
    """Where the value may end, as capitals and digits in groups may follow it: at its country's length, else at the
    end of the match; for countries without a known length after any group, the last one first."""
    v = m[0]
    ends = [k for k in range(len(v), 14, -1) if k == len(v) or v[k] == " "]
    if (n := IBAN_LENGTH.get(v[:2])) is not None:
        ends = [*(k for k in ends if len(v[:k].replace(" ", "")) == n), len(v)]
    return [m.start() + k for k in ends]


def ipv4(f: Feistel, m: re.Match, inverse: bool = False) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    n = f.permute("ipv4", 1 << 32, int.from_bytes(bytes(parts), "big"), inverse)
    return ".".join(str(b) for b in n.to_bytes(4, "big"))


def _kind_of_date(day: datetime.date) -> tuple[int, int]:
    return int(day.month > 9), 0 if day.day < 10 else 1 if day.day < 13 else 2


def _date(f: Feistel, year: int, month: int, day: int, inverse: bool) -> datetime.date | None:
    try:
        d = datetime.date(year, month, day)
    except ValueError:
        return None
    if not FIRST_DAY <= d.toordinal() <= LAST_DAY:
        return None
    kind = _kind_of_date(d)
    days = f.dates()[kind]
    return datetime.date.fromordinal(days[f.permute(f"date{kind}", len(days), bisect.bisect_left(days, d.toordinal()), inverse)])


def year_first(f: Feistel, m: re.Match, inverse: bool = False) -> str | None:
    d = _date(f, int(m[1]), int(m[2]), int(m[3]), inverse)
    sign = m[0][4]
    return d and f"{d.year:04}{sign}{d.month:0{len(m[2])}}{sign}{d.day:0{len(m[3])}}"


def day_month(f: Feistel, m: re.Match, inverse: bool = False) -> str | None:
    a, b, year = int(m[1]), int(m[3]), int(m[4])
    if d := _date(f, year, b, a, inverse):
        return f"{d.day:0{len(m[1])}}{m[2]}{d.month:0{len(m[3])}}{m[2]}{d.year:04}"
    d = _date(f, year, a, b, inverse)  # b is above 12, else it were a date day first
    return d and f"{d.month:0{len(m[1])}}{m[2]}{d.day:0{len(m[3])}}{m[2]}{d.year:04}"


def secret(f: Feistel, m: re.Match, inverse: bool = False) -> str | None:
    """Tokens mix letters and digits; words in quotes don't."""
    v = m[0]
    if sum(c.isdigit() for c in v) < 4 or not any(c.isalpha() for c in v):
        return None
    if not v.strip(HEX):
        return f.blocks("hex", v, [HEX] * len(v), inverse)
    return _alnum(f, "secret", v, inverse)


def _alnum(f: Feistel, kind: str, text: str, inverse: bool) -> str:
    """Letters become letters, digits digits; case and other characters stay in place."""
    plain = [c for c in text.lower() if c.isalnum()]
    it = iter(f.blocks(kind, "".join(plain), [DIGITS if c.isdigit() else LETTERS for c in plain], inverse))
    return "".join((c2.upper() if c.isupper() else c2) if c.isalnum() and (c2 := next(it)) else c for c in text)


def email(f: Feistel, local: str, domain: str, inverse: bool = False) -> str:
    """Local part and domain are permuted apart, so one provider's addresses stay linked too; the last label stays."""
    names, _, top = domain.rpartition(".")
    return _alnum(f, "local", local, inverse) + "@" + ".".join(_alnum(f, "label", x, inverse) for x in names.split(".")) + "." + top


NUMERIC = (("ipv4", IPV4, ipv4), ("card", CARD, card), ("ssn", SSN, ssn), ("date", ISO_DATE, year_first), ("date", YEAR_FIRST, year_first), ("date", DAY_MONTH, day_month), ("phone", PHONE, phone))


def pseudonymise(text: str, f: Feistel, inverse: bool = False) -> tuple[str, Counter]:
    """The text with its personal data replaced, and how many values of each kind were."""
    spans: list[tuple[int, int, str, str]] = []
    taken = bytearray(0)

    def free(a: int, b: int) -> bool:
        return not any(taken[a:b])

    def add(a: int, b: int, kind: str, new: str) -> None:
        if not taken:
            taken.extend(bytes(len(text)))
        spans.append((a, b, kind, new))
        taken[a:b] = b"\1" * (b - a)

    at = text.find("@")
    while at >= 0:
        left, right = EMAIL_LOCAL.search(text, max(0, at - 64), at), EMAIL_DOMAIN.match(text, at + 1)
        if left and right and (local := left[0].lstrip(".-")):
            add(at - len(local), right.end(), "email", email(f, local, right[0], inverse))
        at = text.find("@", at + 1)
    for m in SECRET.finditer(text):
        if free(m.start(), m.end()) and (new := secret(f, m, inverse)):
            add(m.start(), m.end(), "secret", new)
    m = IBAN.search(text)
    while m:
        a, after = m.start(), m.start() + 1
        for b in iban_ends(m):
            if free(a, b) and (new := iban(f, IBAN.fullmatch(text, a, b), inverse)):
                add(a, b, "iban", new)
                after = b
                break
        m = IBAN.search(text, after)
    for chunk in NUMBERS.finditer(text):
        a, b = chunk.span()
        if b - a < 7:
            continue
        for kind, pattern, change in NUMERIC:
            for m in pattern.finditer(text, a, min(b + 2, len(text))):
                if free(m.start(), m.end()) and (new := change(f, m, inverse)):
                    add(m.start(), m.end(), kind, new)
    if not spans:
        return text, Counter()
    out, last = [], 0
    for a, b, _, new in sorted(spans):
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), Counter(k for _, _, k, _ in spans)


def pseudonyms(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", inverse: bool = False) -> DataFrame:
    """(id, text, n_found, kinds) for every row; kinds like `card:1,email:2`. inverse: back from pseudonyms, with the key."""

    f = Feistel(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, Counter()) if t is None else pseudonymise(t, f, inverse) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([sum(c.values()) for _, c in done], pa.int64()), pa.array([",".join(f"{k}:{n}" for k, n in sorted(c.items())) for _, c in done], pa.string())],
                names=[id_col, text_col, "n_found", "kinds"],
            )

    rows = docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias(text_col))
    return rows.mapInArrow(run, f"{id_col} long, {text_col} string, n_found long, kinds string")


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        warnings.warn(f"{KEY_CONF} isn't set: these pseudonyms can be inverted by anyone", stacklevel=2)
    return pseudonyms(table(spark, sf_dir, "documents"), key or PUBLIC_KEY)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
