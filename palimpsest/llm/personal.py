"""Personal data by anchor expansion.

One Aho-Corasick pass over a whole text finds anchors: at-signs, plus signs, digits, address schemes and cue words.
From each anchor a small deterministic parser grows left and right to the bounds of a candidate and checks it. An
anchor inside a candidate that was already taken, or refused, is passed over, so candidates of a kind never overlap
and are the leftmost ones, as one left-to-right scan with the kind's pattern would give.

Base kinds: ``email``, ``ip``, ``card``, ``phone``. Added kinds: ``url`` (a scheme, ``://`` and an authority),
``account`` (an identifier after a cue word of ``ACCOUNT_CUES``: a two-letter code with valid mod-97 check digits, in one
piece or in groups with single blanks or hyphens between, else one piece of 6 to 34 letters and digits with at least 4
digits, or groups of 2 to 5 digits, of 6 to 34 digits) and ``address`` (a house number before or after a
street cue of ``STREET_CUES`` or ``STREET_WORDS``; the latter, short or ambiguous, count as words of their own only, and
those of ``STREET_DOUBTFUL`` only beside a capitalised name; a name between cue and number ends with a capitalised word).
Cues are found whatever their case. Offsets are code points, ends exclusive. A null text is an empty one: no spans, counts 0. Repeated rows are
scanned each for itself; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
BASE = KINDS[:4]

# The shapes of the base kinds, schemes and cue words.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = "0123456789"
SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "s3", "ws", "wss", "git", "ldap")
AUTHORITY = re.compile(r"://[A-Za-z0-9._~%!$&'()*+,;=:@\[\]-]+(?:[/?#][^\s<>\"]*)?")
ACCOUNT_CUES = ("account", "acct", "iban", "konto", "kontonummer", "cuenta", "compte", "passport", "ssn")
# ASCII letters only: letters such as the dotted capital I fold into A-Z elsewhere, but are none in an account.
ACCOUNT = re.compile(r"(?ai)(?:[\s\xa0]*(?:number|no\.?|nr\.?|id|#))?[\s\xa0]*[:=#]?[\s\xa0]*([A-Z0-9][A-Z0-9-]{4,40}[A-Z0-9])")
GROUPED = re.compile(r"(?ai)(?:[\s\xa0]*(?:number|no\.?|nr\.?|id|#))?[\s\xa0]*[:=#]?[\s\xa0]*"
                     r"([A-Z]{2}[0-9]{2}(?:[\x20\xa0-]?[A-Z0-9]){10,30}|[0-9]{2,5}(?:[\x20\xa0-][0-9]{2,5}){1,16})(?!-?[A-Z0-9])")
# Characters of a code by country; elsewhere the longest end with valid check digits is taken.
CODE_LENGTHS = {pair[:2]: int(pair[2:]) for pair in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18"
    " FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21"
    " LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27"
    " ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}
STREET_CUES = ("street", "avenue", "road", "strasse", "straße", "rue", "calle", "boulevard")
STREET_WORDS = ("st", "ave", "rd", "blvd", "lane", "ln", "drive", "court", "square", "highway", "hwy", "str", "platz", "weg",
                "allee", "gasse", "avenida", "avda", "plaza", "paseo", "carrera", "via", "viale", "piazza", "corso",
                "place", "quai", "chemin", "impasse")
STREET_ENDS = ("str", "platz", "weg", "allee", "gasse")  # also the end of a longer word: Marktplatz
#: After these the house number follows; before them stands at most a number: via Roma 12, 12 via Roma.
STREET_FIRST = ("rue", "calle", "avenida", "avda", "plaza", "paseo", "carrera", "via", "viale", "piazza", "corso", "place",
                "quai", "chemin", "impasse", "avenue", "boulevard")
#: Also common words: they need a capitalised name beside them.
STREET_DOUBTFUL = ("st", "ave", "str", "lane", "drive", "court", "square", "weg", "plaza", "via", "corso", "place", "carrera",
                   "paseo", "quai", "impasse")
CAPITAL_BEFORE = re.compile(r"([^\W\d_]+)[.]? $")
HOUSE_BEFORE = re.compile(r"[0-9]{1,5}[A-Za-z]?,? (?:[^\W\d_]+\.? ){0,3}$")
NAMED_AFTER = re.compile(r"\.?(?: (?:[^\W\d_]|['’-])+){0,3} ((?:[^\W\d_]|['’-])+),? [0-9]{1,5}[A-Za-z]?\b")
HOUSE_AFTER = re.compile(r",? [0-9]{1,5}[A-Za-z]?\b")


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for mark in "@+" + DIGITS:
        found.add_word(mark, (mark if mark in "@+" else "0", 1))
    found.add_word("://", (":", 3))
    for kind, cues in (("w", STREET_WORDS), ("a", ACCOUNT_CUES), ("s", STREET_CUES)):
        for cue in cues:
            found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved.upper())) % 97 == 1


def _folded(text: str) -> str:
    """Lower case, code point for code point: letters whose lower case is longer stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def _grouped(text: str, at: int) -> tuple[int, int] | None:
    """Bounds of an identifier in groups: the longest end with valid check digits, or groups of digits alone."""
    match = GROUPED.match(text, at)
    if not match or match.start(1) == at:
        return None
    start, end = match.span(1)
    if text[start].isdigit():
        bare = re.sub(r"[\x20\xa0-]", "", text[start:end])
        return (start, end) if 6 <= len(bare) <= 34 else None
    length = CODE_LENGTHS.get(text[start:start + 2].upper())
    while end - start >= 14:
        bare = re.sub(r"[\x20\xa0-]", "", text[start:end])
        if length in (None, len(bare)) and 14 <= len(bare) <= 34 and not text[end:end + 1].isalnum() and text[end - 1].isalnum() and _mod97(bare):
            return start, end
        end -= 1
    return None


def _identifier(code: str) -> bool:
    bare = code.replace("-", "")
    if re.fullmatch(r"[A-Za-z]{2}[0-9]{2}[A-Za-z0-9]{10,30}", bare):
        return _mod97(bare)
    return 6 <= len(bare) <= 34 and sum(c.isdigit() for c in bare) >= 4


def spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind as its place in KINDS, end) of every span, by start and then kind."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    over = [0] * len(KINDS)  # where each kind may start again
    digits_seen = 0  # the run of digits before this was tried for ip and card
    for last, (anchor, length) in _automaton().iter(_folded(text)):
        at = last - length + 1
        if anchor == "0":
            if at >= over[1] and (at == over[1] or at >= digits_seen):
                if match := IP.match(text, at):
                    over[1] = match.end()
                    if all(int(part[-9:]) <= 255 and not part[:-9].strip("0") for part in match.group().split(".")):
                        found.append((at, 1, match.end()))
            if at >= over[2] and (at == over[2] or at >= digits_seen):
                if match := CARD.match(text, at):
                    over[2] = match.end()
                    bare = match.group().replace(" ", "").replace("-", "")
                    if 14 <= len(bare) <= 19 and luhn(bare):
                        found.append((at, 2, match.end()))
            if at >= digits_seen:
                digits_seen = _run_end(text, at)
        elif anchor == "@":
            if at >= over[0]:
                start = at
                while start > over[0] and text[start - 1] in LOCAL:
                    start -= 1
                if start < at and (match := DOMAIN.match(text, at)):
                    over[0] = match.end()
                    found.append((start, 0, match.end()))
        elif anchor == "+":
            if at >= over[3] and (match := PHONE.match(text, at)):
                over[3] = match.end()
                if 10 <= sum(c in DIGITS for c in match.group()) <= 15:
                    found.append((at, 3, match.end()))
        elif anchor == ":":
            start = at
            while start > over[4] and at - start < 5 and text[start - 1].isascii() and text[start - 1].isalnum():
                start -= 1
            if text[start:at].lower() in SCHEMES and (match := AUTHORITY.match(text, at)):
                over[4] = match.end()
                found.append((start, 4, match.end()))
        elif anchor == "a":
            if at >= over[5] and not text[at - 1:at].isalnum():
                if bounds := _grouped(text, last + 1):
                    over[5] = bounds[1]
                    found.append((bounds[0], 5, bounds[1]))
                elif match := ACCOUNT.match(text, last + 1):
                    if match.start(1) > last + 1 and _identifier(match[1]):
                        over[5] = match.end()
                        found.append((match.start(1), 5, match.end(1)))
        elif at >= over[6]:
            start, end = at, last + 1
            while end < len(text) and text[end].isalpha():
                end += 1
            while start > over[6] and text[start - 1].isalpha():
                start -= 1
            cue = _folded(text[at:last + 1])
            if anchor == "w" and (end > last + 1 or start < at and cue not in STREET_ENDS or text[start - 1:start].isdigit()):
                continue
            before = HOUSE_BEFORE.search(text, max(over[6], start - 80), start)
            if text[end:end + 1] == "." and len(cue) < 5:
                end += 1
            after = HOUSE_AFTER.match(text, end)
            if anchor == "w" and cue in STREET_DOUBTFUL and start == at:
                name = CAPITAL_BEFORE.search(text, max(0, start - 80), start)
                if not name or not name[1][0].isupper():
                    before = after = None
            if not after and not before and cue in STREET_FIRST and start == at:
                if (after := NAMED_AFTER.match(text, end)) and not after[1].lstrip("'’-")[:1].isupper():
                    after = None
            if before or after:
                start, end = before.start() if before else start, after.end() if after else end
                over[6] = end
                found.append((start, 6, end))
    found.sort()
    return found


def _run_end(text: str, at: int) -> int:
    end = at
    while end < len(text) and text[end] in DIGITS:
        end += 1
    return end


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


def find_personal(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``ident`` and ``found``, an array of (kind, start, end, value) by start, then kind."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "value": value[a:b]} for a, k, b in spans(value)]
                     for value in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], ["id", "found"])
    given = docs.select(docs[ident].alias("id"), docs[text].cast("string").alias("text"))
    out = given.mapInArrow(scan, f"id {given.schema['id'].dataType.simpleString()}, "
                                 "found array<struct<kind string, start bigint, end bigint, value string>>")
    return out.withColumnRenamed("id", ident)


