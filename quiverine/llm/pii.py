"""Personal data under format-preserving pseudonyms.

Values are found by pattern, validated, and replaced by the image of a keyed
permutation of all values of their format: card numbers keep their issuer digit
and a right check digit, dates stay dates, addresses stay addresses. The
permutation is a Feistel network over the number of the value within its
format, which walks on while it leaves the format. So a value has one pseudonym
in every document, however it is punctuated or capitalised, two values never
share one, and the holder of the key can undo it (``unmask``).

Formats: e-mail addresses (the part before the @), telephone numbers of the
North American plan and, after + or 00 and a country code, of any other,
payment cards (Luhn), IBANs (modulus 97), social security
numbers, IPv4 addresses, calendar dates from 1900 to 2099, and secrets: access
key ids, and what follows password, token, secret or API key with an equals
sign or colon, if it is no word of prose: it must hold a digit, or change from
small letters to capitals twice. What does not validate is left alone. A North American number
written with the country code is masked whatever its digits; one without it is
a number only if neither area code nor exchange begins with 0 or 1.

The layout of a date is part of its format: year first, day first, or month
first where the second number can't be a month; and whether day and month have
one digit or two. One date has one pseudonym in all layouts with two digits
that begin with year or day, and one in each of the others.

Defined results: null text stays null and has no finds; text without finds is
unchanged. Where finds overlap the earlier in the list above wins. Repeated
rows are masked alike. A format of few values can map one to itself, as any
permutation may.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quiverine.llm.common import positional, read, steps

KINDS = ("email", "phone", "card", "iban", "ssn", "ip", "date", "secret")
ROUNDS = 10
#: Stands in for a secret that a deployment names; the key is a parameter of ``mask_documents``.
DEMO_KEY = b"not a secret: name your own"

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}")
_PHONE = re.compile(r"(?<![0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
#: Codes as E.164 gives them out; none begins another.
_COUNTRY = r"(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?:2[1-689]|3[578]|42|50|59|6[789]|8[0578]|9[679])[0-9])"
#: A group after a space that is an address, a date or a social security number by its layout belongs to no telephone number.
_OTHER = r"(?![0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\2[0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4})"
_ABROAD = re.compile(rf"(?<![A-Za-z0-9+])(?:\+|(?<![0-9][ ./-])00 ?(?=[0-9]{{1,3}}[ ./(-])){_COUNTRY}(?: ?\(0\))?(?:(?: {_OTHER}|[./-])?(?:\([0-9]{{1,5}}\)|[0-9]+(?![0-9]))){{1,8}}")
_TRUNK = re.compile(r"\(0\)")
#: Digits after the country code, where a plan fixes them; elsewhere E.164 bounds them.
_LENGTHS = {"1": (10, 10), "7": (10, 10), "31": (9, 9), "32": (8, 9), "33": (9, 9), "34": (9, 9), "41": (9, 9), "44": (9, 10), "45": (8, 8), "47": (8, 8), "48": (9, 9), "351": (9, 9)}
_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by country, as far as its plan is known here.
_IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG DE GB GE IE ME RS VA", 23: "AE GI IL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
    }.items()
    for country in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])")
_DATE = re.compile(r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([./])[0-9]{1,2}\1[0-9]{4})(?![0-9]|[./-][0-9])")
_KEY_ID = re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?i)(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{6,}=*)")
_DIGIT = re.compile(r"[0-9]")
_RISE = re.compile(r"[a-z][A-Z]")
_FIRST_DAY = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _FIRST_DAY).days


class Permutation:
    """A keyed permutation of the numbers below any size."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mix(self, tweak: bytes, number: int, value: int, below: int) -> int:
        size = (below.bit_length() + 7) // 8 + 8  # eight bytes more than needed, so that the remainder is even
        out, block = b"", 0
        while len(out) < size:
            data = b"%s|%d|%d|%d" % (tweak, number, block, value)
            out += hashlib.blake2b(data, key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:size], "big") % below

    def _once(self, value: int, tweak: bytes, a: int, b: int, back: bool) -> int:
        left, right = divmod(value, b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * self._mix(tweak, k, left, b)) % b
            else:
                left = (left + sign * self._mix(tweak, k, right, a)) % a
        return left * b + right

    def __call__(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        """The image of ``value`` below ``size``; with ``back`` its origin."""
        if size < 2:
            return value
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        tweak += b"|%d" % size
        while True:
            value = self._once(value, tweak, a, b, back)
            if value < size:
                return value


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _relayout(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c in "0123456789" else c for c in shape)


class Masker:
    """Finds and replaces; each ``_kind`` returns the pseudonym of a find, or None if it does not validate."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.permute, self.back = Permutation(key), back
        self.finders: list[tuple[str, Callable[[str], bool], re.Pattern, Callable[[str], str | None]]] = [
            ("email", lambda t: "@" in t, _EMAIL, self._email),
            ("phone", lambda t: True, _PHONE, self._phone),
            ("card", lambda t: True, _CARD, self._card),
            ("iban", lambda t: True, _IBAN, self._iban),
            ("ssn", lambda t: "-" in t, _SSN, self._ssn),
            ("ip", lambda t: "." in t, _IP, self._ip),
            ("date", lambda t: True, _DATE, self._date),
            ("secret", lambda t: "AKIA" in t or "ASIA" in t, _KEY_ID, self._key_id),
        ]

    def _number(self, value: int, size: int, kind: str) -> int:
        return self.permute(value, size, kind.encode(), self.back)

    def _letters(self, text: str, kind: str, alphabets: dict[str, str]) -> str:
        """Each character permuted within the alphabet that holds it.

        Case stays where it is; where letters and digits mix, all of a value is in capitals or none.
        """
        low = text.lower()
        capitals = text != low and text == text.upper()
        sets = [next((a for a in alphabets.values() if c in a), "") for c in low]
        value, size = 0, 1
        for c, own in zip(low, sets, strict=True):
            if own:
                value, size = value * len(own) + own.index(c), size * len(own)
        shape = "".join(own[:1] or c for c, own in zip(low, sets, strict=True))
        value = self._number(value, size, f"{kind}|{shape}")
        out = []
        for c, own in zip(reversed(text), reversed(sets), strict=True):
            if own:
                value, k = divmod(value, len(own))
                out.append(own[k].upper() if capitals or c.isupper() else own[k])
            else:
                out.append(c)
        return "".join(reversed(out))

    _PLAIN = {"letters": "abcdefghijklmnopqrstuvwxyz", "digits": "0123456789"}

    def _email(self, found: str) -> str:
        local, at, domain = found.rpartition("@")
        return self._letters(local, "email|" + domain.lower(), self._PLAIN) + at + domain

    def _phone(self, found: str) -> str | None:
        digits = "".join(_DIGIT.findall(found))
        lead, own = digits[:-10], digits[-10:]
        if own[0] in "01" or own[3] in "01":
            return _relayout(found, lead + self._unassigned(own)) if lead else None
        value = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
        value, line = divmod(self._number(value, 800 * 800 * 10_000, "phone"), 10_000)
        area, exchange = divmod(value, 800)
        return _relayout(found, f"{lead}{area + 200}{exchange + 200}{line:04d}")

    def _unassigned(self, own: str) -> str:
        """Ten digits whose area code or exchange begins with 0 or 1, permuted among all such."""
        area, exchange, line = int(own[:3]), int(own[3:6]), int(own[6:])
        low = 200 * 1000  # area codes below 200 with any exchange, then the others with exchanges below 200
        value = area * 1000 + exchange if area < 200 else low + (area - 200) * 200 + exchange
        value, line = divmod(self._number(value * 10_000 + line, (low + 800 * 200) * 10_000, "phone|unassigned"), 10_000)
        area, exchange = divmod(value, 1000) if value < low else divmod(value - low + 200 * 200, 200)
        return f"{area:03d}{exchange:03d}{line:04d}"

    def _abroad(self, m: re.Match) -> tuple[int, str] | None:
        """The longest whole groups of the match that are a number of its country; the rest stays."""
        text, country = m.group(), m.group(1)
        head = m.end(1) - m.start()
        trunk = _TRUNK.search(text, head)
        body = trunk.end() if trunk else head
        least, most = _LENGTHS.get(country, (5, 15 - len(country)))
        for end in range(len(text), body, -1):
            if text[end - 1] in "0123456789)" and text[end : end + 1] not in [*"0123456789)"]:
                digits = "".join(_DIGIT.findall(text[body:end]))
                if least <= len(digits) <= most:
                    if country == "1":
                        return end, text[:body] + self._phone("1" + text[body:end])[1:]
                    new = f"{self._number(int(digits), 10 ** len(digits), f'phone|{country}|{len(digits)}'):0{len(digits)}d}"
                    return end, text[:body] + _relayout(text[body:end], new)
        return None

    def _card(self, found: str) -> str | None:
        digits = "".join(_DIGIT.findall(found))
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        body = len(digits) - 2
        value = self._number(int(digits[1:-1]), 10**body, "card" + digits[0])
        own = f"{digits[0]}{value:0{body}d}"
        return _relayout(found, f"{own}{luhn(own)}")

    def _ibans(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, pseudonym): of each match the longest part that ends at a word border and validates.

        Capitals and digits beside a number belong to the match; a search goes
        on behind what validates, else one character on.
        """
        at = 0
        while m := _IBAN.search(text, at):
            at, found = m.start() + 1, m.group()
            cuts = [len(found), *(k for k in range(len(found) - 1, 14, -1) if found[k] == " ")]
            fixed = _IBAN_LENGTHS.get(found[:2])
            cuts.sort(key=lambda k: len(found[:k].replace(" ", "")) != fixed)  # its country's length first
            for k in cuts:
                if len(found[:k].replace(" ", "")) >= 15 and (new := self._iban(found[:k])):
                    yield m.start(), m.start() + k, new
                    at = m.start() + k
                    break

    def _iban(self, found: str) -> str | None:
        plain = found.replace(" ", "")
        as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if as_number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        own = self._letters(plain[4:], "iban" + plain[:2], self._PLAIN)
        new = iter(f"{plain[:2]}{98 - as_number(own + plain[:2] + '00') % 97:02d}{own}")
        return "".join(c if c == " " else next(new) for c in found)

    def _ssn(self, found: str) -> str | None:
        area, group, serial = map(int, found.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        value, serial = divmod(self._number(value, 898 * 99 * 9999, "ssn"), 9999)
        area, group = divmod(value, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _ip(self, found: str) -> str | None:
        parts = found.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        value = self._number(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def _date(self, found: str) -> str | None:
        parts = re.split(r"[./-]", found)
        try:
            if "-" in found:
                day = datetime.date.fromisoformat(found)
                return self._other_day(day, lambda d: True, "{0.year:04d}-{0.month:02d}-{0.day:02d}")
            a, b, year = map(int, parts)
            day_first = b <= 12
            day = datetime.date(year, b, a) if day_first else datetime.date(year, a, b)
        except ValueError:
            return None
        sep, names = found[len(parts[0])], ("day", "month") if day_first else ("month", "day")
        narrow = [name for name, part in zip(names, parts, strict=False) if len(part) == 1]
        if any(part[0] == "0" for part in parts[:2] if len(part) == 1):
            return None
        fits = lambda d: (day_first or d.day > 12) and all(getattr(d, name) < 10 for name in narrow)
        return self._other_day(day, fits, sep.join(f"{{0.{name}{'' if name in narrow else ':02d'}}}" for name in names) + sep + "{0.year:04d}")

    def _other_day(self, day: datetime.date, fits: Callable[[datetime.date], bool], layout: str) -> str | None:
        """The permutation walks on until a day fits the layout, so the days that do are permuted among themselves."""
        number = (day - _FIRST_DAY).days
        if not 0 <= number < _DAYS:
            return None
        while True:
            number = self._number(number, _DAYS, "date")
            new = _FIRST_DAY + datetime.timedelta(days=number)
            if fits(new):
                return layout.format(new)

    def _key_id(self, found: str) -> str:
        return found[:4] + self._letters(found[4:], "key id", {"all": self._PLAIN["letters"] + self._PLAIN["digits"]})

    @staticmethod
    def _secret_kind(found: str) -> str | None:
        """How a secret is permuted; None for what may be a word."""
        digits, letters = any(c in "0123456789" for c in found), any(c.isalpha() for c in found)
        if not digits:
            return "plain" if len(_RISE.findall(found)) > 1 else None
        if not letters:
            return "digits"
        own = set(found)
        return "hex" if own <= set("0123456789abcdef") or own <= set("0123456789ABCDEF") else "plain"

    def _secret(self, found: str) -> str | None:
        """Permuted among the secrets of its kind, walking on over others."""
        kind = self._secret_kind(found)
        if kind is None:
            return None
        new = found.lower() if kind == "hex" else found
        while True:
            new = self._letters(new, "hex", {"hex": "0123456789abcdef"}) if kind == "hex" else self._letters(new, "secret", self._PLAIN)
            if self._secret_kind(new) == kind:
                return new.upper() if kind == "hex" and found.isupper() else new

    def finds(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of every find, in order, without overlaps."""
        out: list[tuple[int, int, str, str]] = []
        taken = bytearray(len(text))  # the characters that belong to a find
        free = lambda a, b: taken.find(1, a, b) < 0

        def add(a: int, b: int, kind: str, own: str) -> None:
            out.append((a, b, kind, own))
            taken[a:b] = b"\1" * (b - a)

        digits = _DIGIT.search(text) is not None
        for kind, may, pattern, new in self.finders:
            if (digits or pattern in (_EMAIL, _KEY_ID)) and may(text):
                if pattern is _IBAN:
                    for a, b, own in self._ibans(text):
                        if free(a, b):
                            add(a, b, kind, own)
                    matches = ()
                else:
                    matches = pattern.finditer(text)
                for m in matches:
                    own = free(*m.span()) and new(m.group())
                    if own:
                        add(*m.span(), kind, own)
            lead = {_PHONE: "+", _IBAN: "00"}.get(pattern)  # groups of an IBAN can begin with 00
            if lead and digits and lead in text:
                for m in _ABROAD.finditer(text):
                    own = m.group().startswith(lead) and self._abroad(m)
                    if own and free(m.start(), m.start() + own[0]):
                        add(m.start(), m.start() + own[0], "phone", own[1])
        if "=" in text or ":" in text:
            for m in _SECRET.finditer(text):
                own = free(*m.span(1)) and self._secret(m.group(1))
                if own:
                    add(*m.span(1), "secret", own)
        return sorted(out)

    def mask(self, text: str) -> tuple[str, list[tuple[int, int, str, str]]]:
        """The text with its finds replaced, and the finds."""
        found = self.finds(text)
        if not found:
            return text, found
        out, at = [], 0
        for start, end, _, new in found:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), found


def unmask(text: str, key: bytes) -> str:
    """The text before ``mask`` with this key."""
    return Masker(key, back=True).mask(text)[0]


def mask_documents(docs: DataFrame, key: bytes = DEMO_KEY, finds: str | None = "__finds") -> DataFrame:
    """``docs``, all columns kept, with pseudonyms in ``text``; ``n_chars``, where the table has it, follows.

    A column called ``finds`` is added, unless that is None: an array of kind,
    start and length in the text as it was. The table may not have it already.
    """
    names = docs.columns
    if finds in names:
        raise ValueError(f"the table has a column {finds}; name another for the finds")
    rows, own_names, _, at_text = positional(docs)
    rows = rows.withColumn(own_names[at_text], F.col(own_names[at_text]).cast("string"))
    at_chars = names.index("n_chars") if "n_chars" in names else None
    finds_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masker = Masker(key)
        for batch in steps(batches):
            texts, columns = batch.column(at_text).to_pylist(), list(batch.columns)
            done = [(None, []) if t is None else masker.mask(t) for t in texts]
            columns[at_text] = pa.array([t for t, _ in done], pa.string())
            if at_chars is not None:
                old = columns[at_chars]
                columns[at_chars] = pa.array([len(t) if f else n for (t, f), n in zip(done, old.to_pylist(), strict=True)], old.type)
            found = pa.array([[{"kind": k, "start": a, "length": b - a} for a, b, k, _ in f] for _, f in done], finds_type)
            yield pa.RecordBatch.from_arrays([*columns, found], [*own_names, "finds"])

    find = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
    masked = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("finds", T.ArrayType(find))]))
    return masked.drop("finds").toDF(*names) if finds is None else masked.toDF(*names, finds)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``: doc_id, the masked text, the finds, and their number by kind."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    masked = mask_documents(docs)

    def number(kind: str) -> Column:
        return F.size(F.filter("__finds", lambda f: f["kind"] == kind)).alias(f"n_{kind}")

    return masked.select("doc_id", "text", *map(number, KINDS), F.size("__finds").alias("n_found"), F.sha2("text", 256).alias("text_sha256"))
