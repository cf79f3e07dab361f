"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every kind has a pattern, a prior score, the points that a passed check adds, and words that speak for it
or against it within `NEAR` code points. Scores are whole points of 100. The base kinds (email, ip, card,
phone) are always listed, with their score; the others are listed from `LEAST_SCORE` points on:

    iban     length of its country, mod-97 remainder 1
    btc      base-58 address, double SHA-256 checksum
    nir      French social security number, mod-97 key
    steuer   German tax number, ISO 7064 mod 11,10
    dni      Spanish identity number, letter of the mod-23 table
    aba      American bank routing number, weighted mod 10
    ssn      American social security number, ranges that are given out (no checksum: needs a word nearby)

A proposal whose check fails is dropped, so mod-97 kinds need no context, weaker checks (one in 23, 10 or none)
do. Of other kinds, a proposal that overlaps a base span or a better one is dropped (higher score first, then
start, then order of kinds), so added spans never overlap.

One narrow pass over whole texts in batches of bounded bytes; a document's spans stay in its row.

Defined results: null text counts as empty; an empty text has no spans and the digest of the empty string;
repeated rows are scanned one by one, null ids are kept; spans are code points, end exclusive; other columns
of any name are left out (`scan`) or left as they are (`redact`); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from tillstream.llm.common import byte_batches, stored

NEAR = 48
LEAST_SCORE = 50
FOR, AGAINST = 35, 30

# The base patterns, in the order in which kinds are listed.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a match begins and ends with a whole run of digits
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Characters in an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28,
    "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28,
    "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15,
    "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20}
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Every second digit from the right counts twice, digit by digit; the sum ends in 0."""
    twice = sum(sum(divmod(2 * int(c), 10)) for c in number[-2::-2])
    return (twice + sum(int(c) for c in number[-1::-2])) % 10 == 0


def mod97(account: str) -> bool:
    """IBAN without spaces: country and key go to the end, letters count from 10, the remainder is 1."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def nir_key(text: str) -> bool:
    number = text.replace(" ", "").replace("2A", "19").replace("2B", "18")
    return 97 - int(number[:13]) % 97 == int(number[13:])


def iso_11_10(text: str) -> bool:
    """German tax number: one digit comes two or three times among the first ten, the eleventh is the check digit."""
    number = digits(text)
    if [n for n in Counter(number[:10]).values() if n > 1] not in ([2], [3]):
        return False
    product = 10
    for c in number[:10]:
        product = ((int(c) + product) % 10 or 10) * 2 % 11
    return (11 - product) % 10 == int(number[10])


def dni_letter(text: str) -> bool:
    number = text[:-1].rstrip("-")
    return DNI_LETTERS[int(number.translate(str.maketrans("XYZ", "012"))) % 23] == text[-1]


def routing(text: str) -> bool:
    """Weights 3, 7, 1; the first two digits name a district that exists."""
    district = int(text[:2])
    known = district <= 12 or 21 <= district <= 32 or 61 <= district <= 72 or district == 80
    return known and int(text) > 0 and sum(int(c) * w for c, w in zip(text, (3, 7, 1) * 3)) % 10 == 0


def base58check(text: str) -> bool:
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    if value >= 1 << 200:
        return False
    raw = value.to_bytes(25, "big")
    zeros = len(raw) - len(raw.lstrip(b"\0"))
    ones = len(text) - len(text.lstrip("1"))
    return zeros == ones and hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def given_out(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


class Kind(NamedTuple):
    name: str
    prior: int
    confirmed: int  # points of a passed check
    context: frozenset[str]  # words in lower case
    against: frozenset[str]
    pattern: re.Pattern | None = None  # none: a base kind, which `base_spans` finds
    check: Callable[[str], bool] | None = None


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


KINDS = (
    Kind("email", 60, 20, _words("email mail contact courriel correo write schreiben address adresse"), _words("example noreply")),
    Kind("ip", 35, 15, _words("ip address host server client login adresse dirección from via"), _words("version release v section chapter build")),
    Kind("card", 35, 35, _words("card credit visa mastercard amex payment karte kreditkarte carte tarjeta crédito cvv"),
         _words("order isbn serial tracking invoice bestellung commande pedido")),
    Kind("phone", 50, 10, _words("phone tel telephone call mobile fax telefon handy téléphone teléfono móvil"), _words("version build")),
    Kind("iban", 30, 50, _words("iban account bank bic swift konto compte cuenta"), frozenset(),
         re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])"), mod97),
    Kind("btc", 40, 50, _words("btc bitcoin wallet address"), frozenset(),
         re.compile(r"(?<![A-Za-z0-9])[13][1-9A-HJ-NP-Za-km-z]{25,34}(?![A-Za-z0-9])"), base58check),
    Kind("nir", 15, 40, _words("nir insee sécurité sociale sécu vitale immatriculation"), _words("isbn commande référence"),
         re.compile(r"(?<![0-9])[12]\x20?[0-9]{2}\x20?(?:0[1-9]|1[0-2]|[2-9][0-9])\x20?(?:[0-9]{2}|2[AB])\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{2}(?![0-9])"), nir_key),
    Kind("steuer", 5, 25, _words("steuer steueridentifikationsnummer steuernummer idnr identifikationsnummer finanzamt tin"), _words("bestellung rechnung"),
         re.compile(r"(?<![0-9])[1-9][0-9]\x20?[0-9]{3}\x20?[0-9]{3}\x20?[0-9]{3}(?![0-9])"), iso_11_10),
    Kind("dni", 15, 25, _words("dni nie nif identidad documento"), _words("pedido factura"),
         re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z](?![A-Za-z0-9])"), dni_letter),
    Kind("aba", 5, 20, _words("routing aba rtn bank wire transfer"), _words("order invoice zip"),
         re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])"), routing),
    Kind("ssn", 20, 10, _words("ssn social security taxpayer"), _words("part model serial order"),
         re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), given_out),
)
ORDER = {k.name: i for i, k in enumerate(KINDS)}
BASE = KINDS[:4]
ADDED = KINDS[4:]
_ANY = re.compile("[0-9@]")
_WORD = re.compile(r"[^\W\d_]+")
Span = tuple[int, int, int, int]  # start, end, order of the kind, score


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the pattern; each domain is met once and its local part read backwards, so long runs cost no more."""
    free = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            free = m.end()


def base_spans(text: str) -> Iterator[tuple[int, int, Kind]]:
    """(start, end, kind) of the base kinds, by kind as listed, then start."""
    email, ip, card, phone = BASE
    if "@" in text:
        yield from ((s, e, email) for s, e in emails(text))
    for m in IP.finditer(text) if "." in text else ():
        if all(len(p) <= 3 and int(p) <= 255 for p in (part.lstrip("0") or "0" for part in m.group().split("."))):
            yield m.start(), m.end(), ip
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(number := digits(m.group())) <= 19 and luhn(number):
            yield m.start(), m.end(), card
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= len(digits(m.group())) <= 15:
            yield m.start(), m.end(), phone


def account_end(text: str, start: int) -> int | None:
    """End of the account number of its country's length that starts here, single spaces allowed; none if it is cut or runs on."""
    left, at = IBAN_LENGTH.get(text[start:start + 2], 0), start
    while left:
        c = text[at:at + 1]
        if "0" <= c <= "9" or "A" <= c <= "Z":
            left -= 1
        elif c != " " or text[at - 1] == " ":
            return None
        at += 1
    return at if at > start and not text[at:at + 1].isalnum() else None


def score(text: str, start: int, end: int, kind: Kind) -> int:
    """Prior, points of the check (a span got here by passing it), whole words nearby; 0 to 100."""
    low, high = max(0, start - NEAR), min(len(text), end + NEAR)
    while 0 < low < start and text[low - 1].isalpha():
        low += 1
    while end < high < len(text) and text[high].isalpha():
        high -= 1
    near = {w.lower() for part in (text[low:start], text[end:high]) for w in _WORD.findall(part)}
    points = kind.prior + kind.confirmed + FOR * (not near.isdisjoint(kind.context)) - AGAINST * (not near.isdisjoint(kind.against))
    return min(100, max(0, points))


def _proposed(text: str) -> Iterator[Span]:
    """Confirmed proposals of the added kinds that reach the least score."""
    for kind in ADDED:
        for m in kind.pattern.finditer(text):
            start, end = m.span()
            if kind.name == "iban" and (end := account_end(text, start)) is None:
                continue
            if kind.check(text[start:end].replace(" ", "")) and (points := score(text, start, end, kind)) >= LEAST_SCORE:
                yield start, end, ORDER[kind.name], points


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each by kind as listed, then start."""
    if not _ANY.search(text):
        return [], []
    base = [(s, e, ORDER[k.name], score(text, s, e, k)) for s, e, k in base_spans(text)]
    proposed = sorted(_proposed(text), key=lambda p: (-p[3], p[0], p[2]))
    taken = bytearray(len(text) if proposed else 0)
    for start, end, _, _ in base if proposed else ():
        taken[start:end] = b"\1" * (end - start)
    added = []
    for span in proposed:
        start, end = span[:2]
        if 1 not in taken[start:end]:
            taken[start:end] = b"\1" * (end - start)
            added.append(span)
    return base, sorted(added, key=lambda p: (p[2], p[0]))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.int32()), ("base", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column("text").to_pylist():
            base, added = spans(text or "")
            found.append([{"kind": KINDS[k].name, "start": s, "end": e, "score": p, "base": listed is base}
                          for listed in (base, added) for s, e, k, p in listed])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])


def scan(docs: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """Per row of `docs`: doc_id, spans (array of kind, start, end, score, base) by kind as listed, then start."""
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.selectExpr("doc_id", "cast(text AS string) AS text").mapInArrow(
        _scan, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,score:int,base:boolean>>")
    with byte_batches(docs.sparkSession, batch_bytes):
        return stored(found)


def masked(text: str | None, least: int) -> str | None:
    """The text with each span of at least `least` points replaced by its kind; overlapping spans become one."""
    if text is None:
        return None
    out, free = [], 0
    for s, e, k, points in sorted(x for part in spans(text) for x in part):
        if points >= least and e > free:
            if s >= free:
                out += [text[free:s], f"<{KINDS[k].name.upper()}>"]
            free = e
    return "".join(out) + text[free:]


def redact(docs: DataFrame, least: int = LEAST_SCORE, batch_bytes: int = 4 << 20) -> DataFrame:
    """`docs` with personal data of at least `least` points masked in `text`; null texts and other columns stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            new = pa.array([masked(t, least) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), new)

    with byte_batches(docs.sparkSession, batch_bytes):
        return stored(docs.mapInArrow(run, docs.schema))
