"""Personal data in whole texts, plain and disguised, with exact source offsets (operator 9).

Plain identifiers are the leftmost non-overlapping matches of one pattern for each kind; a match that
fails its check (parts over 255, digit count, Luhn) is dropped without a retry.

Disguised ones are found through transducers.  Each turns a text with offsets into another text with
offsets, where every character of the result carries the source range it came from:

1. homoglyphs: full-width forms, mathematical letters and digits, decimal digits of all other scripts, and
   Greek and Cyrillic lookalikes become ASCII;
2. spelled digits and ``plus``: runs of digit words (English, German, Spanish, French), set apart by blanks
   or hyphens, become digits without gaps;
3. at/dot disguises: a bracketed ``at`` or ``dot``, and unbracketed ones in the order name at host dot end,
   become ``@`` and ``.``; blanks around an ``@`` before a host go; a spelled dot between digits becomes ``.``.

The same detectors then run on the normalised text.  A span that covers something a transducer changed,
and lies in no plain span of its kind, is mapped back to source characters and added; it may reach beyond
a plain span that it overlaps.  Plain spans always stay as they are.  Offsets count code points, ends are exclusive.

Every search is linear in the text: patterns begin at a boundary and take runs whole, and at, dot and
bracket signs are found first, before what stands around them is looked at.

Defined cases: a null or empty text has no spans and stays as it is; all other columns pass untouched.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.storage import bounded

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is taken whole: no match of the plain pattern begins inside one.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    """What ``finditer`` of the pattern gives, in time linear in the text: each match holds exactly one @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _EMAIL_HOST.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, m.end() if m else 0))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_card(match: str) -> bool:
    digits = match if match.isdecimal() else _digits(match)
    return 16 <= len(digits) <= 19 and luhn(digits)


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    """The plain identifiers of each kind."""
    return {
        "email": _emails(text) if "@" in text else [],
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_small, m.groups()))],
        "card": [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _is_card(m.group())],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15] if "+" in text else [],
    }


# Letters that look like a Latin one.
_GREEK_CYRILLIC = dict(
    zip(
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικνορυχ" "АВЕЅІЈКМНОРСТУХаеѕіјкорсухһԁԛԝ",
        "ABEZHIKMNOPTYXaiknopux" "ABESIJKMHOPCTYXaesijkopcyxhdqw",
    )
)
# Words for digits, for the sign of a phone number, for @ and for a dot.
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
_AT, _DOT = "at|arroba|arobase", "dot|punkt|punto|point"
# Words that begin a phrase and no host.
_PLAIN = "the|a|an|this|that|my|your|his|her|its|our|their|some|any|each|one"

_UNIT = "|".join(sorted(map(re.escape, _SPELLED), key=len, reverse=True))
#: Signs of a number: whole words for digits, ``plus``, whole runs of digits.
_SIGN = re.compile(rf"(?<!\w)(?:plus|{_UNIT}|[0-9]++)(?!\w)", re.I)
_BRACKET_AT = re.compile(rf"[\[({{<]\s*+(?:{_AT}|@)\s*+[\])}}>]", re.I)
_BRACKET_DOT = re.compile(rf"[\[({{<]\s*+(?:{_DOT}|\.)\s*+[\])}}>]", re.I)
_SOME_AT = re.compile(rf"@|(?<= )(?:{_AT})(?= )", re.I)
_SOME_DOT = re.compile(rf"(?<= )(?:{_DOT})(?= )", re.I)
_HOST = re.compile(rf"(?!(?:{_PLAIN}) )[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?: ++(?:{_DOT}) ++[A-Za-z0-9-]++)++(?!\w)", re.I)
#: A name with its dots, read from its end backwards.
_EMAN = re.compile(rf"[A-Za-z0-9_%+-]++(?:(?:\.| ++(?:{'|'.join(w[::-1] for w in _DOT.split('|'))}) ++)[A-Za-z0-9_%+-]++)*+", re.I)
_DIGIT_DOT = re.compile(rf"(?<=[0-9]) *(?: (?:{_DOT}) )+ *(?=[0-9])", re.I)
#: A host of this kind ends in a label that begins with a letter, so that a price is none.
_SPACED_AT = re.compile(r"(?<=[A-Za-z0-9])(?: ++@ *+|@ ++)(?=(?:[A-Za-z0-9-]++\.)+[A-Za-z])")
_WORDED = re.compile(rf"(?<!\w)(?:{_UNIT})[ -]+(?:{_UNIT}|[0-9])|\s(?:{_DOT})\s", re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:{_AT}|@|{_DOT}|\.)\s*[\])}}>]", re.I)
_TRIGGERS = frozenset([*_SPELLED, *_DOT.split("|")])
_DECIMAL = "".join(c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd")
_STRANGE = re.compile(f"[Ͱ-ԯ⁰-ₜ①-⓿！-～\U0001d400-\U0001d7ff{_DECIMAL}]")
#: Without a character outside Latin and common punctuation, a text has none of these.
_FOREIGN = re.compile("[^\0-\u036f\u2000-\u206f]")


def _lookalike(c: str) -> str:
    if c in _GREEK_CYRILLIC:
        return _GREEK_CYRILLIC[c]
    d = unicodedata.digit(c, None)
    if d is not None:
        return str(d)
    plain = unicodedata.normalize("NFKC", c)
    return plain if len(plain) == 1 and plain.isascii() else c


class Mapped:
    """A text whose every character knows its source range and whether a transducer made it."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.made = np.zeros(len(text), bool)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ascending ranges; what replaces a range spans the source of all of it."""
        if not edits:
            return
        text, parts, at = [], [], 0
        for s, e, new in edits:
            text += [self.text[at:s], new]
            parts.append((self.start[at:s], self.end[at:s], self.made[at:s]))
            if new:
                n = len(new)
                lo, hi = np.full(n, self.start[s]), np.full(n, self.end[e - 1])
                if n == e - s:
                    lo, hi = self.start[s:e], self.end[s:e]
                parts.append((lo, hi, np.ones(n, bool)))
            at = e
        text.append(self.text[at:])
        parts.append((self.start[at:], self.end[at:], self.made[at:]))
        self.text = "".join(text)
        self.start, self.end, self.made = (np.concatenate(x) for x in zip(*parts))

    def homoglyphs(self) -> None:
        self.rewrite([(m.start(), m.end(), new) for m in _STRANGE.finditer(self.text) if (new := _lookalike(m.group())) != m.group()])

    def spelled_digits(self) -> None:
        """Runs of signs that blanks or hyphens set apart become digits without gaps, if one of them is a word."""
        edits, run = [], []

        def close() -> None:
            if any(t.lower() in _SPELLED for _, _, t in run):
                for k, (s, e, t) in enumerate(run):
                    if k and s > run[k - 1][1]:
                        edits.append((run[k - 1][1], s, ""))
                    if not t[0].isdecimal():
                        edits.append((s, e, _SPELLED.get(t.lower(), "+")))
            run.clear()

        for m in _SIGN.finditer(self.text):
            if run and (m.group().lower() == "plus" or self.text[run[-1][1] : m.start()].strip(" -")):
                close()
            run.append((m.start(), m.end(), m.group()))
        close()
        self.rewrite(edits)

    def _brackets(self, pattern: re.Pattern, new: str) -> None:
        """What the pattern finds becomes ``new``, with the white space around it."""
        text, edits, done = self.text, [], 0
        for m in pattern.finditer(text):
            s, e = m.span()
            while s > done and text[s - 1].isspace():
                s -= 1
            while e < len(text) and text[e].isspace():
                e += 1
            edits.append((s, e, new))
            done = e
        self.rewrite(edits)

    def _names_at_hosts(self) -> None:
        text, back, edits, done = self.text, self.text[::-1], [], 0
        for m in _SOME_AT.finditer(text):
            at, end = _blanks(text, m.start(), m.end(), done)
            if at < done:
                continue
            host = _HOST.match(text, end)
            name = host and _EMAN.match(back, len(text) - at, len(text) - done)
            if not name:
                continue
            for lo, hi in ((len(text) - name.end(), at), (end, host.end())):
                edits += [(*_blanks(text, d.start(), d.end(), lo), ".") for d in _SOME_DOT.finditer(text, lo, hi)]
                if lo < at and text[at:end] != "@":
                    edits.append((at, end, "@"))
            done = host.end()
        self.rewrite(edits)

    def at_and_dot(self) -> None:
        self._brackets(_BRACKET_AT, "@")
        self._brackets(_BRACKET_DOT, ".")
        self._names_at_hosts()
        self.rewrite([(m.start(), m.end(), "@") for m in _SPACED_AT.finditer(self.text)])
        self.rewrite([(m.start(), m.end(), ".") for m in _DIGIT_DOT.finditer(self.text)])


def _blanks(text: str, start: int, end: int, least: int) -> tuple[int, int]:
    """A span with the blanks on both sides of it."""
    while start > least and text[start - 1] == " ":
        start -= 1
    while end < len(text) and text[end] == " ":
        end += 1
    return start, end


def disguised(text: str, plain: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the normalised text shows, in source offsets."""
    none = {k: [] for k in KINDS}
    strange = not text.isascii() and _FOREIGN.search(text) and _STRANGE.search(text)
    if not strange:
        # most texts have no word of a disguise and end here
        worded = not _TRIGGERS.isdisjoint(text.lower().replace("-", " ").split()) and _WORDED.search(text)
        if not worded and not _BRACKETED.search(text) and not ("@" in text and _SPACED_AT.search(text)):
            return none
    m = Mapped(text)
    if strange:
        m.homoglyphs()
    m.spelled_digits()
    m.at_and_dot()
    if m.text == text:
        return none
    out = {}
    changed = np.concatenate([[0], np.cumsum(m.made)])
    for kind, spans in detect(m.text).items():
        out[kind] = []
        starts = [x for x, _ in plain[kind]]
        for s, e in spans:
            lo, hi = int(m.start[s]), int(m.end[e - 1])
            gaps = hi - lo != e - s
            # plain spans are disjoint: only the last that begins here or before can hold this one
            k = bisect_right(starts, lo) - 1
            if (changed[e] > changed[s] or gaps) and not (k >= 0 and hi <= plain[kind][k][1]):
                out[kind].append((lo, hi))
    return out


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(plain spans, all spans) by kind as listed, then start."""
    plain = detect(text)
    more = disguised(text, plain)
    return (
        [(k, s, e) for k in KINDS for s, e in plain[k]],
        [(k, s, e) for k in KINDS for s, e in sorted(plain[k] + more[k])],
    )


_SPANS = "array<struct<kind:string,start:long,end:long>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_pii(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """The carried columns (doc_id by default) of every row with ``base`` and ``spans``."""
    carry = carry or ["doc_id"]
    schema = T.StructType([docs.schema[c] for c in carry]).add("base", T.DataType.fromDDL(_SPANS)).add("spans", T.DataType.fromDDL(_SPANS))

    def run(batches):
        for b in batches:
            found = [find(t) if t else ([], []) for t in b.column(len(carry)).to_pylist()]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s)) for s in f[k]] for f in found], _ARROW) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], names=[*carry, "base", "spans"])

    return bounded(docs).select(*carry, F.col("text").alias("__text")).mapInArrow(run, schema)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (the union of overlapping ones) replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        elif e > at:
            out.append("")
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with their own columns, identifiers replaced in ``text``."""

    def run(batches):
        for b in batches:
            k = b.schema.names.index("text")
            texts = [redact_text(t, find(t)[1]) if t else t for t in b.column(k).to_pylist()]
            columns = list(b.columns)
            columns[k] = pa.array(texts, b.schema.types[k])
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return bounded(docs).mapInArrow(run, docs.schema)
