"""Format-preserving pseudonyms for validated numbers, dates and addresses.

Candidates are found by pattern and kept only if they hold as what they look like: card numbers by
their check digit, account numbers modulo 97, dates by the calendar, network addresses by their
octets. The value behind the notation is permuted by a keyed Feistel network over exactly the
values of its kind (cycle-walking outside ones), then written back in the notation it was found in
with check digits made anew. The permutation depends on the key and the kind alone, so equal
values stay equal in every document and different ones stay different.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from crosswin.llm.tables import text_rows
from crosswin.llm.text import chunks

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
# fixed values: length of account numbers by country, all that are registered
ACCOUNT_LENGTHS = {x[:2]: int(x[2:]) for x in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30".split()}

TWO_DIGIT_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())  # fixed values: country codes


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """Keyed permutation of 0 .. size - 1: a balanced Feistel network, cycle-walked."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, octets = (1 << half) - 1, (half + 7) // 8
    tweak = f"{kind}|{size}".encode()
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            f = hashlib.blake2b(tweak + bytes([r]) + right.to_bytes(octets, "big"), key=key, digest_size=min(64, octets)).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def walk(value: int, size: int, key: bytes, kind: str, valid: Callable[[int], bool]) -> int:
    """The permutation among the valid values only."""
    while True:
        value = permute(value, size, key, kind)
        if valid(value):
            return value


def refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def luhn(payload: str) -> str:
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    payload = f"{permute(int(digits[:-1]), 10**n, key, 'card'):0{n}d}"
    return refill(text, payload + luhn(payload))


def social(text: str, key: bytes) -> str | None:
    def valid(v: int) -> bool:
        area, group, serial = v // 10**6, v // 10**4 % 100, v % 10**4
        return area not in (0, 666) and area < 900 and group > 0 and serial > 0

    value = int(re.sub(r"\D", "", text))
    return refill(text, f"{walk(value, 10**9, key, 'social', valid):09d}") if valid(value) else None


def phone(text: str, key: bytes) -> str | None:
    """The national number is permuted, the country code stays; a number without one counts as of +1."""
    digits = re.sub(r"\D", "", text)
    if not 8 <= len(digits) <= 15:
        return None
    code = ""
    if text.startswith("+"):
        code = digits[:1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_CODES else 3]
    national = digits[len(code):]
    new = permute(int(national), 10 ** len(national), key, f"phone{code or '1'}")
    return refill(text, f"{code}{new:0{len(national)}d}")


def is_private(v: int) -> bool:
    a, b = v >> 24, v >> 16 & 255
    return a in (0, 10, 127) or a >= 224 or (a, b) in ((192, 168), (169, 254)) or a == 172 and 16 <= b < 32


def network_address(text: str, key: bytes) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if any(o > 255 for o in octets) or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    value = int.from_bytes(bytes(octets), "big")
    new = walk(value, 1 << 32, key, "ip", lambda v: is_private(v) == is_private(value))
    return ".".join(str(o) for o in new.to_bytes(4, "big"))


def spelled(text: str, key: bytes, kind: str, alphabets: tuple[str, ...]) -> str:
    """Characters permuted together, each within its alphabet; others stay."""
    value, size, where = 0, 1, []
    for i, c in enumerate(text):
        for a in alphabets:
            if c in a:
                value, size = value * len(a) + a.index(c), size * len(a)
                where.append((i, a))
                break
    if size == 1:
        return text
    value, out = permute(value, size, key, kind), list(text)
    for i, a in reversed(where):
        value, k = divmod(value, len(a))
        out[i] = a[k]
    return "".join(out)


DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def mail(text: str, key: bytes) -> str | None:
    """The local part is permuted whatever its case; its case and the domain stay."""
    local, domain = text.rsplit("@", 1)
    new = spelled(local.lower(), key, "mail", (DIGITS, SMALL))
    return "".join(n.upper() if c.isupper() else n for c, n in zip(local, new)) + "@" + domain


def account(text: str, key: bytes) -> str | None:
    plain = re.sub(r"[ -]", "", text)
    if ACCOUNT_LENGTHS.get(plain[:2]) != len(plain):
        return None
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = spelled(plain[4:], key, "account" + plain[:2], (DIGITS, LARGE))
    new = plain[:2] + f"{98 - number(body + plain[:2] + '00') % 97:02d}" + body
    chars = iter(new)
    return "".join(c if c in " -" else next(chars) for c in text)


def secret(text: str, key: bytes) -> str | None:
    """The hexadecimal value of a credential assignment."""
    at = re.search(r"[0-9A-Fa-f]{24,}", text)
    upper = at.group().upper() == at.group()
    new = spelled(at.group().lower(), key, "secret", ("0123456789abcdef",))
    return text[:at.start()] + (new.upper() if upper else new) + text[at.end():]


def date(order: str) -> Callable[[str, bytes], str | None]:
    """Days of 1900 to 2099, as year, month and day in the given order."""

    def run(text: str, key: bytes) -> str | None:
        fields = dict(zip(order, map(int, re.findall(r"\d+", text))))
        try:
            day = datetime.date(fields["y"], fields["m"], fields["d"]).toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return re.sub(r"\d+", lambda m, f=iter(order): parts[next(f)], text)

    return run


# a kind's pattern, its test and replacement; what comes first takes the characters
EDGE, END = r"(?<![\w@.+-])", r"(?![\w@])"
ACCOUNT, CARD = r"[A-Z]{2}\d{2}(?:[ -]?[0-9A-Z]){11,30}(?!\w)", r"\d(?:[ -]?\d){12,18}" + END
KINDS: list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]] = [
    ("mail", re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9@])"), mail),
    ("secret", re.compile(r"(?i:token|secret|password|api[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?[0-9A-Fa-f]{24,128}(?![0-9A-Za-z])"), secret),
    ("account", re.compile(r"(?<!\w)" + ACCOUNT), account),
    ("ip", re.compile(EDGE + r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\w)"), network_address),
    ("date", re.compile(EDGE + r"\d{4}-\d{2}-\d{2}(?![\d-])"), date("ymd")),
    ("date", re.compile(EDGE + r"\d{4}/\d{2}/\d{2}(?![\d/])"), date("ymd")),
    ("date", re.compile(EDGE + r"\d{2}\.\d{2}\.\d{4}(?!\.?\d)"), date("dmy")),
    ("date", re.compile(EDGE + r"\d{2}/\d{2}/\d{4}(?![\d/])"), date("mdy")),
    ("social", re.compile(EDGE + r"\d{3}-\d{2}-\d{4}(?![\d-])"), social),
    ("card", re.compile(EDGE + CARD), card),
    ("phone", re.compile(r"(?<![\w@.+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}" + END), phone),
    ("phone", re.compile(r"(?<![\w@.+)(-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}" + END), phone),
]


# kinds whose candidates run on across blanks, and what may start inside one that failed
OPEN = {"account": re.compile(ACCOUNT), "card": re.compile(CARD), "phone": None}
BREAKS = re.compile(r"[ .-]+")


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of everything private in a text, in order, without overlaps.

    A candidate may have swallowed what stands after a number: if it fails, its prefixes up to each
    break are tried, the longest first, and then the search goes on after its first group.
    """
    taken: list[tuple[int, int, str, str]] = []
    free = bytearray(len(text))
    for kind, pattern, replace in KINDS:
        m = pattern.search(text)
        while m:
            a, b = m.span()
            breaks = list(BREAKS.finditer(text, a, b)) if kind in OPEN else []
            for end in (b, *(x.start() for x in reversed(breaks))):
                # the part before a break must hold as a candidate too
                part = m.group() if end == b else (p.group() if (p := pattern.match(text, a, end) or inside(kind, text, a, end)) and p.end() == end else None)
                new = replace(part, key) if part and not any(free[a:end]) else None
                if new is not None:
                    taken.append((a, end, kind, new))
                    free[a:end] = b"\1" * (end - a)
                    m = pattern.search(text, end)
                    break
            else:
                at = breaks[0].end() if breaks else b
                m = breaks and inside(kind, text, at, len(text)) or pattern.search(text, at)
    return sorted(taken)


def inside(kind: str, text: str, at: int, end: int) -> re.Match | None:
    """A candidate right after a break, whatever stands before it."""
    return OPEN[kind].match(text, at, end) if OPEN[kind] else None


FOUND = "array<struct<kind:string,start:int,length:int,pseudonym:string>>"


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, new_text, found), one row per document.

    Offsets in ``found`` count code points of the old text. Null texts stay null, texts without
    findings stay as they are. Repeated rows repeat, null doc_ids stay, an empty table gives none.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("pseudonym", pa.string())]))
        for batch in chunks(batches):
            texts, lists = [], []
            for text in batch.column("text").to_pylist():
                found = find(text, key) if text else []
                out, at = [], 0
                for a, b, _, new in found:
                    out += [text[at:a], new]
                    at = b
                texts.append("".join([*out, text[at:]]) if text else text)
                lists.append([{"kind": k, "start": a, "length": b - a, "pseudonym": n} for a, b, k, n in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(lists, kind)], ["doc_id", "new_text", "found"])

    rows = text_rows(docs)
    # every kind has a digit of some script, an @ or the name of a secret
    suspect = F.coalesce(F.col("text").rlike(r"[\p{Nd}@]|(?i:token|secret|password|api)"), F.lit(False))
    looked = rows.where(suspect).mapInArrow(run, f"doc_id bigint, new_text string, found {FOUND}")
    clean = rows.where(~suspect).select("doc_id", F.col("text").alias("new_text"), F.array().cast(FOUND).alias("found"))
    return looked.unionByName(clean)


def findings(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, kind, start, length, pseudonym), one row per finding. See pseudonymise."""
    return pseudonymise(docs, key).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
