"""Operator 6: personal data replaced by format-preserving Feistel pseudonyms.

Candidates are found by patterns and validated (check digits, calendar dates, number ranges). A
value is a number below N in its format's domain; a keyed Feistel network over the smallest even
number of bits that holds N, walked until it lands below N again, permutes that domain. So
every pseudonym is a valid value of the same format, different values get different
pseudonyms, and equal values get equal ones in all documents, however they are written
(a card number with or without spaces, a date in any notation). Who holds the key can invert it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelkit.llm.common import id_and_text, parts_of

ROUNDS = 8
#: First days of the spans that dates are permuted within; the last one ends with the calendar.
SPANS = (("date before 1900", date.min.toordinal()), ("date", date(1900, 1, 1).toordinal()), ("date after 2099", date(2100, 1, 1).toordinal()))


#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
#: Country code of a phone number written without separators.
_COUNTRY = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-689]\d\d)")


class Feistel:
    """Keyed permutation of range(n) for every kind and n."""

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        self.key, self.rounds = key, rounds

    def _pass(self, kind: str, n: int, value: int, order) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        size, mask = (half + 7) // 8, (1 << half) - 1
        seed = hashlib.blake2b(f"{kind}:{n}".encode(), key=self.key[:64], digest_size=32).digest()
        value_ = value
        while True:
            left, right = value_ >> half, value_ & mask
            for r in order:
                digest = hashlib.blake2b(bytes([r]) + right.to_bytes(size, "big"), key=seed, digest_size=min(64, size + 8)).digest()
                left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
            value_ = right << half | left  # halves swapped, so the same steps in reverse order undo it
            if value_ < n:
                return value_

    def permute(self, kind: str, n: int, value: int) -> int:
        return self._pass(kind, n, value, range(self.rounds))

    def invert(self, kind: str, n: int, value: int) -> int:
        return self._pass(kind, n, value, range(self.rounds - 1, -1, -1))


def luhn_digit(payload: str) -> int:
    """The digit that makes payload + digit pass the Luhn check."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _into(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in form)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def card(text: str, move: Callable) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    while True:  # walk on past a number of one repeated digit, which would not count as valid
        payload = str(move(f"card{len(d)}", 10 ** (len(d) - 1), int(d[:-1]))).zfill(len(d) - 1)
        d = payload + str(luhn_digit(payload))
        if len(set(d)) > 1:
            return _into(text, d)


def _spell(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s))


def _is_iban(text: str) -> bool:
    flat = text.replace(" ", "")
    return 15 <= len(flat) <= 34 and _spell(flat[4:] + flat[:4]) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int:
    """Where the IBAN at ``start`` ends, ``start`` if there is none. Capitals that follow it match the
    pattern too, so its country's length is tried first, then the whole match and, for countries
    that are not in the list, every shorter end."""
    places = [i for i in range(start, end) if text[i] != " "]
    known = IBAN_LENGTHS.get(text[start : start + 2])
    for n in (known, len(places)) if known else range(len(places), 14, -1):
        if n <= len(places) and _is_iban(text[start : places[n - 1] + 1]):
            return places[n - 1] + 1
    return start


def iban(text: str, move: Callable) -> str | None:
    if not _is_iban(text):
        return None
    flat = text.replace(" ", "")
    body = characters("iban" + flat[:2], flat[4:], move)
    check = 98 - _spell(body + flat[:2] + "00") % 97
    it = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in text)


def ssn(text: str, move: Callable) -> str | None:
    area, group, serial = map(int, text.split("-"))
    valid = lambda a, g, s: a not in (0, 666) and a < 900 and g > 0 and s > 0
    if not valid(area, group, serial):
        return None
    while True:
        v = move("ssn", 10**9, area * 10**6 + group * 10**4 + serial)
        area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
        if valid(area, group, serial):
            return f"{area:03d}-{group:02d}-{serial:04d}"


def phone(text: str, move: Callable) -> str | None:
    """The country code stays; the national number is permuted: at least 7 digits (4 if nothing separates
    it from the code), at most 12, or 15 with the country code; for ten digits its area code
    keeps starting with 2 to 9."""
    spaced = re.match(r"\+\d{1,3}(?=[ .(-])", text)
    lead = spaced or _COUNTRY.match(text)
    code, rest = (text[: lead.end()], text[lead.end() :]) if lead else ("", text)
    d = _digits(rest)
    if not (7 if spaced or not lead else 4) <= len(d) <= (15 - len(_digits(code)) if text[0] == "+" else 12) or len(_digits(text)) < 7:
        return None
    strict = len(d) == 10 and d[0] > "1"
    while True:
        d = str(move(f"phone{code}/{len(d)}", 10 ** len(d), int(d))).zfill(len(d))
        if not strict or d[0] > "1":
            return code + _into(rest, d)


def ip(text: str, move: Callable) -> str | None:
    parts = [int(p) for p in text.split(".")]
    valid = lambda ps: max(ps) < 256 and 0 < ps[0] < 224
    if not valid(parts):
        return None
    v = int.from_bytes(bytes(parts), "big")
    while True:
        v = move("ip", 1 << 32, v)
        parts = list(v.to_bytes(4, "big"))
        if valid(parts):
            return ".".join(map(str, parts))


def characters(kind: str, text: str, move: Callable) -> str:
    """Every letter and digit replaced by one of its class (a-z, A-Z, 0-9); other characters stay."""
    radix = [10 if c in "0123456789" else 26 if c.isascii() and c.isalpha() else 1 for c in text]
    base = ["0" if c in "0123456789" else "a" if "a" <= c <= "z" else "A" for c in text]
    n, value = 1, 0
    for c, r, b in zip(text, radix, base):
        n *= r
        value = value * r + (ord(c) - ord(b) if r > 1 else 0)
    if n < 2:
        return text
    classes = "".join(b if r > 1 else c for c, r, b in zip(text, radix, base))
    value, out = move(f"{kind}:{classes}", n, value), []
    for c, r, b in zip(reversed(text), reversed(radix), reversed(base)):
        out.append(chr(ord(b) + value % r) if r > 1 else c)
        value //= r
    return "".join(reversed(out))


def email(text: str, move: Callable) -> str | None:
    local, _, domain = text.rpartition("@")
    return f"{characters('email@' + domain.lower(), local, move)}@{domain}"


def secret(text: str, move: Callable) -> str | None:
    return characters("secret", text, move)


def _moved_day(year: int, month: int, day: int, move: Callable, months=range(1, 13)) -> date | None:
    """The pseudonym of a day, in the same span and in one of ``months``, to which its own belongs."""
    try:
        at = date(year, month, day).toordinal()
    except ValueError:
        return None
    ends = [first for _, first in SPANS[1:]] + [date.max.toordinal() + 1]
    kind, first, end = next((k, f, e) for (k, f), e in zip(SPANS, ends) if f <= at < e)
    while True:
        at = first + move(kind, end - first, at - first)
        if date.fromordinal(at).month in months:
            return date.fromordinal(at)


def iso_date(text: str, move: Callable) -> str | None:
    d = _moved_day(int(text[:4]), int(text[5:7]), int(text[8:]), move)
    return d and f"{d.year:04d}{text[4]}{d.month:02d}{text[7]}{d.day:02d}"


def day_first(text: str, move: Callable) -> str | None:
    """d.m.y, or d/m/y where that is a date, else m/d/y."""
    a, b, y = map(int, re.split(r"[./]", text))
    mark = "/" if "/" in text else "."
    if d := _moved_day(y, b, a, move):
        return f"{d.day:02d}{mark}{d.month:02d}{mark}{d.year:04d}"
    if mark == "/" and (d := _moved_day(y, a, b, move)):
        return f"{d.month:02d}{mark}{d.day:02d}{mark}{d.year:04d}"
    return None


#: Month names by language, and the English short forms. Fixed values.
MONTHS = {
    "en": "January February March April May June July August September October November December",
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    "short": "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec",
}
_MONTHS = {form: [n.lower() for n in names.split()] for form, names in MONTHS.items()}
#: What a name is read as: its form and number. A name of several forms counts for the first.
_READ = {name: (form, i) for form, names in reversed(_MONTHS.items()) for i, name in enumerate(names, 1)}
_NAMES = "|".join(sorted(_READ, key=lambda n: (-len(n), n)))
_DAY_NAME = re.compile(rf"(?i)(?P<d>\d{{1,2}})(?P<o>st|nd|rd|th|er|\.)?(?P<a> (?:de |of )?)(?P<m>{_NAMES})(?P<b>\.?,? (?:de |del )?)(?P<y>\d{{4}})")
_NAME_DAY = re.compile(rf"(?i)(?P<m>{_NAMES})(?P<a>\.? )(?P<d>\d{{1,2}})(?P<o>st|nd|rd|th)?(?P<b>,? )(?P<y>\d{{4}})")


def _bare(pattern: re.Pattern) -> str:
    """The pattern without its flag and group names, to be part of another."""
    return "(?i:" + re.sub(r"\?P<\w+>", "?:", pattern.pattern.removeprefix("(?i)")) + ")"


def _ordinal(day: int, like: str) -> str:
    """The English ending of a day, where ``like`` is one; other marks stay."""
    if like.lower() not in ("st", "nd", "rd", "th"):
        return like
    end = "th" if 10 < day < 14 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")
    return end.upper() if like.isupper() else end


def month_name(text: str, move: Callable) -> str | None:
    """A day, a month's name and a year, in either order; the name stays in its language and case."""
    found = _DAY_NAME.fullmatch(text)
    name_first = found is None
    found = found or _NAME_DAY.fullmatch(text)
    name = found["m"]
    if name.lower() not in _READ or name not in (name.lower(), name.upper(), name.capitalize()):
        return None  # letters that only look alike, or a mix of cases that no pseudonym could keep
    form, month = _READ[name.lower()]
    # Only months whose names are read as this form, so that the pseudonym is read back as what it is.
    months = [i for i, n in enumerate(_MONTHS[form], 1) if _READ[n] == (form, i)]
    d = _moved_day(int(found["y"]), month, int(found["d"]), move, months)
    if d is None:
        return None
    new = _MONTHS[form][d.month - 1]
    new = new.upper() if name.isupper() else new.capitalize() if name[0].isupper() else new
    day = f"{d.day}{_ordinal(d.day, found['o'] or '')}"
    first, second = (new, day) if name_first else (day, new)
    return f"{first}{found['a']}{second}{found['b']}{d.year:04d}"


#: (kind, characters of which the text must hold one (#: any digit), pattern, pseudonym function), in order of precedence.
KINDS: tuple[tuple[str, str, re.Pattern, Callable], ...] = tuple(
    (kind, need, re.compile(pattern), change)
    for kind, need, pattern, change in (
        ("email", "@", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])", email),
        ("secret", "K", r"(?<=\bAKIA)[A-Z0-9]{16}(?![A-Za-z0-9])", secret),
        ("secret", "=:", r"""(?i)(?<![^\W_])(?:password|passwd|secret|api_?key|token)\s{0,3}[=:]\s{0,3}["']?(?P<value>[A-Za-z0-9_\-./+]{8,128})""", secret),
        ("ip", "#", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", ip),
        ("date", "#", r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{4}/\d{2}/\d{2}(?![\d/])", iso_date),
        ("date", "#", r"(?<![\d./])(?:\d{1,2}\.\d{1,2}\.\d{4}(?!\d)|\d{1,2}/\d{1,2}/\d{4}(?![\d/]))", day_first),
        ("date", "#", rf"\b(?:{_bare(_DAY_NAME)}|{_bare(_NAME_DAY)})\b", month_name),
        ("ssn", "#", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
        ("iban", "#", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
        ("card", "#", r"(?<![\d.+-])(?:\d{13,19}|(?:\d{4}[ -]){3}\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)", card),
        ("phone", "#", r"(?<![\d+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<!-)\d{3}[-.]\d{3}[-.]\d{4}(?![\d-]))", phone),
    )
)

_DIGIT = re.compile(r"[0-9]")


def pseudonymise(text: str, move: Callable) -> tuple[str, list[dict]]:
    """The text with pseudonyms in place, and what was found, by position: kind, start and end
    (characters of the input) and the pseudonym."""
    digit = _DIGIT.search(text) is not None
    taken: list[tuple[int, int, str, str]] = []
    for kind, need, pattern, change in KINDS:
        if not (digit if need == "#" else any(c in text for c in need)):
            continue
        at = 0
        while m := pattern.search(text, at):
            a, b = m.span("value") if "value" in pattern.groupindex else m.span()
            at = m.end()
            if kind == "iban":
                b = iban_end(text, a, b)
                at = max(b, a + 1)  # what follows the number may be the next one
                if a == b:
                    continue
            if any(a < y and x < b for x, y, _, _ in taken):
                continue
            new = change(text[a:b], move)
            if new is not None:
                taken.append((a, b, kind, new))
    taken.sort()
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [{"kind": k, "start": a, "end": b, "pseudonym": new} for a, b, k, new in taken]


_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())]))


def pseudonymise_documents(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (with pseudonyms), n_found, found.

    A null text becomes empty; texts without personal data are unchanged. Candidates that fail
    their check stay as they are. Repeated rows give equal results. An empty table gives an
    empty result. Nothing is shuffled, and no table of values is kept: the key links equal values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move = Feistel(key).permute
        for batch in parts_of(batches):
            done = [pseudonymise(t, move) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int32()), pa.array([f for _, f in done], _FOUND)],
                names=["doc_id", "text", "n_found", "found"],
            )

    return docs.select(*id_and_text(docs, id_col, text_col)).mapInArrow(
        run, "doc_id long, text string, n_found int, found array<struct<kind: string, start: long, end: long, pseudonym: string>>"
    )
