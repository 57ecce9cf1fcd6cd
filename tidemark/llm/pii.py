"""Format-preserving pseudonyms for personal data.

Values are found by pattern and validated (Luhn, calendar, octets, IBAN checksum, ...), then permuted within the values
of the same format by a keyed Feistel network with cycle walking: a card number becomes a card number with a right
check digit, a date a date, an address an address of the same shape. Within one key the map is one to one, so equal
values stay equal, in all documents, and whoever has the key can go back. Numbers written with other separators link, as
separators are no part of the value; so do telephone numbers of North America with and without +1, dates in the same order
with and without leading noughts, and mailboxes in capitals and small letters, whose case stays as it is written.

Found are: secrets of known prefix (AKIA, ASIA, ghp_ and its kin, sk-, xox.-) and hexadecimal ones of 32 digits and more;
mailboxes; IBANs; IPv4 and full or shortened IPv6 addresses; dates of the years 1900 to 2099 as numbers, year first or last,
with one separator; US social security numbers with dashes; payment cards; telephone numbers with + and a country code, or
of North America with an area code. Not found are values with nothing to tell them by: names, addresses in words, dates
with month names, national telephone numbers of other countries, social security numbers without dashes. Of a mailbox's
domain the last label stays, as do the domains of well-known providers and a "co.uk"-like ending.

A map over the rows. Null text stays null, with nothing found; empty text likewise stays empty; very long texts are searched
whole; repeated rows get the same pseudonyms, and ties cannot be; an empty table gives an empty result; other columns play
no part, whatever their names. A one-to-one map of a tiny format (a one-letter mailbox) may map a value to itself.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
import string
from collections.abc import Callable
from math import prod

from pyspark.sql import DataFrame

from .common import map_rows

ROUNDS = 8


class Feistel:
    """Keyed permutations of 0 .. size-1, one for each tweak (a kind and format) and size."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        n = (bits + 7) // 8
        digest = hashlib.blake2b(half.to_bytes(n, "big"), key=self.key, digest_size=n, salt=k.to_bytes(2, "big"), person=hashlib.blake2b(tweak, digest_size=16).digest())
        return int.from_bytes(digest.digest(), "big") & ((1 << bits) - 1)

    def _once(self, x: int, bits: int, tweak: bytes, back: bool) -> int:
        left, right, mask = x >> bits, x & ((1 << bits) - 1), (1 << bits) - 1
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ self._round(tweak, k, left, bits), left
            else:
                left, right = right, (left ^ self._round(tweak, k, right, bits)) & mask
        return left << bits | right

    def permute(self, x: int, size: int, tweak: bytes, valid: Callable[[int], bool] | None = None, back: bool = False) -> int:
        """Walks the cycle until it is inside the domain and valid again; x itself must be both, so it ends."""
        if size < 2:
            return x
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, bits, tweak, back)
            if x < size and (valid is None or valid(x)):
                return x


_CLASSES = (string.digits, string.ascii_lowercase, string.ascii_uppercase)


def permuted(feistel: Feistel, value: str, kind: str, classes=_CLASSES, valid: Callable[[str], bool] | None = None, back: bool = False) -> str:
    """value with each character of a class replaced by one of the same class, the rest in place."""
    alphabets = [next((c for c in classes if ch in c), "") for ch in value]
    sizes = [len(a) for a in alphabets if a]

    def number(text: str) -> int:
        x = 0
        for ch, a in zip(text, alphabets, strict=True):
            if a:
                x = x * len(a) + a.index(ch)
        return x

    def text(x: int) -> str:
        out = []
        for ch, a in zip(reversed(value), reversed(alphabets), strict=True):
            if a:
                x, r = divmod(x, len(a))
                ch = a[r]
            out.append(ch)
        return "".join(reversed(out))

    shape = kind + ":" + "".join(str(len(a)) + "," if a else ch for ch, a in zip(value, alphabets, strict=True))
    return text(feistel.permute(number(value), prod(sizes), shape.encode(), (lambda x: valid(text(x))) if valid else None, back))


def luhn(digits: str) -> int:
    """The check digit that belongs after digits."""
    total = 0
    for k, ch in enumerate(reversed(digits)):
        d = int(ch) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if ch.isdigit() else ch for ch in shape)


#: How the numbers of payment cards begin.
_ISSUED = re.compile("4|5[0-8]|2[2-7]|3[0-9]|6")


def _card(f: Feistel, m: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or not _ISSUED.match(digits):
        return None
    new = permuted(f, digits[:-1], "card", valid=lambda x: bool(_ISSUED.match(x)), back=back)
    return _refill(m, new + str(luhn(new)))


#: Country calling codes of one and two digits; all others have three.
ONE, TWO = "17", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _phone(f: Feistel, m: str, back: bool) -> str | None:
    """The country code stays, however it is set apart; a number without one is North American."""
    digits, head = re.sub(r"\D", "", m), 0
    if m[0] == "+":
        head = 1 if digits[0] in ONE else 2 if digits[:2] in TWO else 3
    country, own = digits[:head] or "1", digits[head:]
    if not 7 <= len(own) <= 15 - head:
        return None
    northern = country == "1" and len(own) == 10  # there, an area code from 2 on stays one, and others don't become one
    new = permuted(f, own, "phone+" + country, valid=(lambda x: (x[0] >= "2") == (own[0] >= "2")) if northern else None, back=back)
    return _refill(m, digits[:head] + new)


def _real_ssn(x: str) -> bool:
    return x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"


def _ssn(f: Feistel, m: str, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m)
    return _refill(m, permuted(f, digits, "ssn", valid=_real_ssn, back=back)) if _real_ssn(digits) else None


def _ip(f: Feistel, m: str, back: bool) -> str | None:
    octets = m.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, b"ip", back=back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ip6(f: Feistel, m: str, back: bool) -> str | None:
    """Written out in full, if it was, and otherwise in the shortest way; the first 16 bits stay, which tell what it is for."""
    try:
        x = int(ipaddress.IPv6Address(m))
    except ValueError:
        return None
    low = (1 << 112) - 1
    new = ipaddress.IPv6Address((x >> 112) << 112 | f.permute(x & low, 1 << 112, b"ip6", back=back))
    text = new.exploded if len(m) == 39 else new.compressed
    return text.upper() if m == m.upper() and m != m.lower() else text


_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def _date(f: Feistel, m: str, back: bool) -> str | None:
    """Year first, or day first, or, if the second number can't be a month, month first; years 1900 to 2099.

    The three orders are formats of their own. Day-first pseudonyms that would read the other way stay readable: the
    order is told by the month's place, so the walk only ends at dates that are read as they were written. If a day or
    month was written without a leading nought, so are the pseudonym's.
    """
    a, sep, b, other, c = re.match(r"(\d+)([-/.])(\d+)([-/.])(\d+)", m).groups()
    if sep != other:
        return None
    year_first = len(a) == 4
    day_first = not year_first and int(b) <= 12

    def read(y: int, mo: int, d: int) -> dt.date | None:
        try:
            return dt.date(y, mo, d)
        except ValueError:
            return None

    day = read(int(a), int(b), int(c)) if year_first else read(int(c), int(b), int(a)) if day_first else read(int(c), int(a), int(b))
    if day is None or not 1900 <= day.year <= 2099:
        return None
    valid = None if year_first or day_first else lambda x: dt.date.fromordinal(_FIRST + x).day > 12
    new = dt.date.fromordinal(_FIRST + f.permute(day.toordinal() - _FIRST, _DAYS, b"date" + (b"y" if year_first else b"d" if day_first else b"m"), valid, back))
    width = 1 if 1 in (len(x) for x in (a, b, c)) else 2
    mo, d = f"{new.month:0{width}d}", f"{new.day:0{width}d}"
    return f"{new.year}{sep}{mo}{sep}{d}" if year_first else f"{d}{sep}{mo}{sep}{new.year}" if day_first else f"{mo}{sep}{d}{sep}{new.year}"


def _iban_rest(x: str) -> int:
    return int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97


def _iban(f: Feistel, m: str, back: bool) -> str | None:
    flat = m.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _iban_rest(flat) != 1:
        return None
    body = permuted(f, flat[4:], "iban" + flat[:2], back=back)
    new = iter(flat[:2] + f"{98 - _iban_rest(flat[:2] + '00' + body):02d}" + body)
    return "".join(ch if ch == " " else next(new) for ch in m)


#: Domains of mail providers, which tell nothing of a person, and labels that a country's ending may begin with.
PROVIDERS = "gmail.com googlemail.com yahoo.com hotmail.com outlook.com live.com msn.com icloud.com aol.com gmx.net gmx.de web.de mail.ru yandex.ru qq.com 163.com proton.me protonmail.com example.com example.org example.net".split()
SECOND = "co com org net ac edu gov".split()


def _email(f: Feistel, m: str, back: bool) -> str | None:
    local, _, domain = m.rpartition("@")
    labels = domain.split(".")
    if not local or len(labels) < 2 or not labels[-1].isalpha() or len(labels[-1]) < 2:
        return None
    kept = 2 if ".".join(labels[-2:]).lower() in PROVIDERS or (len(labels) > 2 and len(labels[-1]) == 2 and labels[-2].lower() in SECOND) else 1
    hosts, ending = ".".join(labels[:-kept]), ".".join(labels[-kept:])
    cased = lambda new, was: "".join(x.upper() if w.isupper() else x for x, w in zip(new, was, strict=True))
    new = cased(permuted(f, local.lower(), "mail", back=back), local) + "@"
    return new + (cased(permuted(f, hosts.lower(), "host", back=back), hosts) + "." if hosts else "") + ending


_HEX = (string.digits + "abcdef", string.digits + "ABCDEF")


def _secret(f: Feistel, m: str, back: bool) -> str | None:
    if re.fullmatch(r"[0-9a-fA-F]+", m):
        if not re.search(r"\d", m) or not re.search(r"[a-fA-F]", m):
            return None
        return permuted(f, m, "hex", classes=(_HEX[m.upper() == m],), back=back)
    head = re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-", m)[0]
    return head + permuted(f, m[len(head) :], "key" + head, back=back)


#: (kind, pattern, pseudonym): earlier kinds take their text first. A pattern's edges keep it from cutting into a longer
#: word or number.
_L, _R = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
KINDS: list[tuple[str, re.Pattern, Callable]] = [
    ("secret", re.compile(_L + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,})" + _R), _secret),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}" + _R), _email),
    ("iban", re.compile(_L + r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)" + _R), _iban),
    ("ip", re.compile(r"(?<![A-Za-z0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![A-Za-z0-9]|\.\d)"), _ip),
    ("ip6", re.compile(r"(?<![A-Za-z0-9:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![A-Za-z0-9:]|\.\d)"), _ip6),
    ("date", re.compile(r"(?<![A-Za-z0-9./-])(?:(?:19|20)\d{2}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2(?:19|20)\d{2})(?![A-Za-z0-9]|[./-]\d)"), _date),
    ("ssn", re.compile(r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9]|-\d)"), _ssn),
    ("card", re.compile(r"(?<![A-Za-z0-9+])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5})(?![A-Za-z0-9])"), _card),
    ("phone", re.compile(r"(?<![A-Za-z0-9])(?:\+\d{8,15}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![A-Za-z0-9]|[.-]\d)"), _phone),
]


class Pseudonyms:
    """Replaces what it finds in a text; remembers values, as many occur again and again."""

    def __init__(self, key: bytes, remembered: int = 100_000):
        self.feistel, self.known, self.remembered = Feistel(key), {}, remembered

    def _new(self, kind: str, make: Callable, value: str) -> str | None:
        at = (kind, value)
        if at not in self.known:
            if len(self.known) >= self.remembered:
                self.known.clear()
            self.known[at] = make(self.feistel, value, False)
        return self.known[at]

    def __call__(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of what was found, in the old text."""
        if not text or not _HINT.search(text):
            return text, []
        found: list[tuple[int, int, str, str]] = []
        taken = bytearray(len(text))
        for kind, pattern, make in KINDS:
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                a, b = m.span()
                if 1 in taken[a:b]:
                    continue
                new = self._new(kind, make, m[0])
                if new is not None:
                    found.append((a, b, kind, new))
                    taken[a:b] = b"\1" * (b - a)
        if not found:
            return text, []
        found.sort()
        parts, at = [], 0
        for a, b, _, new in found:
            parts += [text[at:a], new]
            at = b
        return "".join([*parts, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


#: One of these is in whatever is found.
_HINT = re.compile("[0-9@]|::|AKIA|ASIA|gh[pousr]_|sk-|xox")


def pseudonymised(docs: DataFrame, key: bytes, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, text with pseudonyms, n_found and spans (kind, start, end in the old text)."""
    kind = docs.schema[doc].dataType.simpleString()

    def make():
        of = Pseudonyms(key)

        def run(keys, texts):
            both = [of(t) for t in texts]
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in both]
            return keys, [t for t, _ in both], [len(s) for _, s in both], spans

        return run

    return map_rows(docs, [doc, text], make, f"`{doc}` {kind}, text string, n_found bigint, spans array<struct<kind:string,start:int,end:int>>")
