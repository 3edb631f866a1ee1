r"""Personal data: e-mail addresses, IP addresses, card and phone numbers, also in disguise.

:func:`detect` adds ``pii``, an array of (kind, start, end, plain), offsets in code
points of the text as it stands, end exclusive; :func:`redact` puts a mark in place of
each span.  Both are per-row: no shuffle, whole texts, time linear in a text's length.

Texts that hold nothing that any pattern or transducer starts from are told apart a column
at a time, by one regular expression without backtracking; only the others become Python strings.

Plain spans come from the text itself by four patterns.  For disguised ones a chain of
transducers rewrites the text and keeps, edit by edit, which source characters the
result came from: look-alike letters and digits of other scripts become
ASCII and invisible characters go; spelled digits in runs or next to digits become digits;
"at", "dot" and the signs themselves in brackets, and the words (each by itself) between the parts of an
address, become @ and full stops.  The patterns run over the result and their spans are mapped back to the
source.  A disguised span is added where it doesn't overlap a plain one, or holds those that it overlaps
and disguised characters beside them: of an address with one look-alike letter, the plain
pattern may have found a part.

Where a spoken "at" is an address's only disguise, as in "john at example.com", the host
has to end in letters of one case, and the word before it must not be one that ordinary
speech has there ("look at example.com").

Spans are ordered by kind (email, ip, card, phone), then start.  Defined results: null
and empty texts have none (a null text stays null in :func:`redact`); repeated rows are
each searched; other columns pass through and an existing ``pii`` column is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

# fixed values: letters of other scripts that look like ASCII ones, and invisible characters
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-", " ": " ", " ": " ", " ": " ", "　": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){2}\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The checksum of card numbers."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """By their @ signs: what stands before one decides the start, so no text takes quadratic time."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        floor = found.end() if found else at + 1
        at = text.find("@", floor)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans that the patterns find in a text as it stands."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _characters() -> dict[str, str]:
    table = dict(LOOK_ALIKES) | dict.fromkeys(INVISIBLE, "")
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
    for c in range(0x80, 0x1FC00):  # digits of every script
        if unicodedata.category(chr(c)) == "Nd":
            table.setdefault(chr(c), str(unicodedata.digit(chr(c))))
    return table


_CHARACTERS = _characters()
_DISGUISED = re.compile("[" + "".join(map(re.escape, sorted(_CHARACTERS))) + "]")
# what shows that characters beside a plain span are part of it
_WRITTEN = re.compile("[" + "".join(map(re.escape, sorted(_CHARACTERS))) + r"]|[\[({<]\x20?(?:at|dot|[@.])\x20?[\])}>]", re.IGNORECASE)
_NAME = "|".join(SPELLED)
_NUMBERS = re.compile(rf"(?i)(?<![^\W_])(?:{_NAME})(?:[\x20,.-]{{1,2}}(?:{_NAME}))*(?![^\W_])")
# whether a text has a run of names, or one with a digit before or behind it
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:{_NAME})[\x20,.-]{{1,2}}(?:[0-9]|(?:{_NAME})(?![^\W_]))|(?<=[0-9])[\x20,.-]{{1,2}}(?:{_NAME})(?![^\W_])")
_ONE_NAME = re.compile(f"(?i){_NAME}")
_GAP = re.compile(r"[\x20,.-]{1,2}")
_DIGIT_BEFORE = re.compile(r"[0-9]([\x20,.-]{1,2})\Z")
_DIGIT_BEHIND = re.compile(r"([\x20,.-]{1,2})[0-9]")
_BRACKETED = re.compile(r"(?i)\x20?[\[({<]\x20?(at|dot|[@.])\x20?[\])}>]\x20?")
_SPOKEN_IP = re.compile(r"(?i)(?<![0-9.])[0-9]{1,3}(?:(?:\x20dot\x20|\.)[0-9]{1,3}){3}(?![0-9])")
_OPENING = "[({<"
_SPOKEN = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}(?:\x20dot\x20[A-Za-z0-9._%+-]{1,64}){0,3})(\x20at\x20|@)"
    r"((?>[A-Za-z0-9-]++(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]++)+))(?![A-Za-z0-9._%+-]*+@)"
)
_DOT = re.compile(r"(?i)\x20dot\x20")

_LAST_LABEL = re.compile(r"(?:[a-z]{2,}|[A-Z]{2,})\Z")
#: Words that ordinary speech has before "at" and the name of a host.
ORDINARY = frozenset(
    "a about active all am an and anything are arrive arrived at available back based be been begin book browse but buy by check click code data date day details docs documentation documents download "
    "everything example file files find for found free from get go had has have he help her here him home hosted i image in info information is it join just last learn library link links list listed live located look looked looking "
    "made me meet met more news not now of off on one online only open or order out page pages paper photo photos pictures post posted project published read register released reviews see seen sell she shop sign site sold source "
    "start stay stayed still stuff tested that the them there these they things this those time to today tutorial up us use version video videos view visit was watch we website were what where which who with work worked working works write you".split()
)


class Normalised:
    """A rewritten text, and by its edits the source span that each of its characters stands for."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.steps: list[tuple[list[int], list[int], list[int], list[int]]] = []  # of each rewriting: where edits begin and end before and after it

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans (ordered, apart) by strings; what comes in stands for the whole span."""
        if not edits:
            return
        text, begin, end, at, n = [], [], [], 0, 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            n += a - at
            begin.append(n)
            n += len(new)
            end.append(n)
            at = b
        text.append(self.text[at:])
        self.text = "".join(text)
        self.steps.append(([e[0] for e in edits], [e[1] for e in edits], begin, end))

    def source(self, start: int, stop: int) -> tuple[int, int]:
        """The source span of a span (of one character at least) of the rewritten text."""
        last = stop - 1
        for first, behind, begin, end in reversed(self.steps):
            k = bisect_right(begin, start) - 1
            start = start if k < 0 else first[k] if start < end[k] else start - end[k] + behind[k]
            k = bisect_right(begin, last) - 1
            last = last if k < 0 else behind[k] - 1 if last < end[k] else last - end[k] + behind[k]
        return start, last + 1


def _look_alikes(n: Normalised) -> None:
    n.rewrite([(m.start(), m.end(), _CHARACTERS[m[0]]) for m in _DISGUISED.finditer(n.text)])


def _numbers(n: Normalised) -> None:
    edits = []
    for m in _NUMBERS.finditer(n.text):
        before, behind = _DIGIT_BEFORE.search(n.text, max(0, m.start() - 3), m.start()), _DIGIT_BEHIND.match(n.text, m.end())
        names = list(_ONE_NAME.finditer(n.text, *m.span()))
        if len(names) == 1 and not before and not behind:
            continue
        # what stands between digits and names stays if it is one sign, as in addresses and groups of digits
        if before and before[1] not in (" ", "-", "."):
            edits.append((*before.span(1), " "))
        for w in names:
            edits.append((w.start(), w.end(), SPELLED[w[0].lower()]))
            gap = _GAP.match(n.text, w.end(), m.end())
            if gap:
                edits.append((gap.start(), gap.end(), ""))
        if behind and behind[1] not in (" ", "-", "."):
            edits.append((*behind.span(1), " "))
    n.rewrite(edits)


def _address(n: Normalised, m: re.Match[str]) -> bool:
    """Whether what _SPOKEN found is an address, not speech about a host that is named as it is."""
    disguised = m[2] == "@" or _DOT.search(m[1]) or _DOT.search(m[3]) or any(b - a > 1 for a, b in (n.source(k, k + 1) for k in range(*m.span(3)) if n.text[k] == "."))
    return bool(disguised or _LAST_LABEL.search(m[3]) and not m[1].isdigit() and m[1].lower().rstrip(".-") not in ORDINARY)


def _signs(n: Normalised) -> None:
    sign = {"at": "@", "dot": ".", "@": "@", ".": "."}
    n.rewrite([(m.start(), m.end(), sign[m[1].lower()]) for m in _BRACKETED.finditer(n.text)])
    n.rewrite([(d.start(), d.end(), ".") for m in _SPOKEN_IP.finditer(n.text) for d in _DOT.finditer(n.text, *m.span())])
    edits = []
    for m in _SPOKEN.finditer(n.text):
        if _address(n, m):
            edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(n.text, *m.span(1))]
            edits.append((*m.span(2), "@"))
            edits += [(d.start(), d.end(), ".") for d in _DOT.finditer(n.text, *m.span(3))]
    n.rewrite([e for e in edits if n.text[e[0] : e[1]] != e[2]])


def disguised_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans, in the source, of what the patterns find in the rewritten text."""
    odd = not text.isascii() and _DISGUISED.search(text)
    low = text.lower()
    bracketed = any(b in text for b in _OPENING) and _BRACKETED.search(text)
    spoken = bracketed or ((" at " in low or " dot " in low) and (_SPOKEN.search(text) or _SPOKEN_IP.search(text)))
    if not (odd or spoken or _SPELLED.search(text)):
        return []
    n = Normalised(text)
    for step in (_look_alikes, _numbers, _signs):
        step(n)
    return [(k, *n.source(a, b)) for k, a, b in plain_spans(n.text)]


def spans(text: str | None) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, plain) of all spans, ordered by kind and start."""
    if not text:
        return []
    plain = plain_spans(text)
    out = [(*s, True) for s in plain]
    starts, ends = [], []  # of the stretches that plain spans cover
    for a, b in sorted(s[1:] for s in plain):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    for k, a, b in disguised_spans(text):
        first, behind = bisect_right(ends, a), bisect_left(starts, b)  # the stretches it overlaps
        if a < b and (first == behind or a <= starts[first] and ends[behind - 1] <= b and _WRITTEN.search(text[a : starts[first]] + text[ends[behind - 1] : b])):
            out.append((k, a, b, False))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], -s[2]))


def marked(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """The text with ``[EMAIL]`` and so on in place of its spans; overlapping ones share the first one's mark."""
    out, at = [], 0
    for k, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out.append(text[at:a] + f"[{k.upper()}]")
        at = max(at, b)
    return "".join(out) + text[at:]


# what any span begins with: of the plain patterns, and of what the transducers rewrite
_HINTS = (
    "@",
    r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    r"[0-9](?:[\x20-]?[0-9]){15}",
    r"\+[0-9]",
    "[" + "".join(map(re.escape, sorted(_CHARACTERS))) + "]",
    r"(?i:[\[({<]\x20?(?:at|dot|[@.])\x20?[\])}>])",
    r"(?i:\x20at\x20[A-Za-z0-9-]+(?:\.|\x20dot\x20)[A-Za-z0-9-]|\x20dot\x20)",
    rf"(?i:(?:{_NAME})[\x20,.-]{{1,2}}(?:[0-9]|{_NAME})|[0-9][\x20,.-]{{1,2}}(?:{_NAME}))",
)
HINT = "|".join(_HINTS)


def hinted(texts: pa.Array) -> list[int]:
    """The rows that may have spans; all others have none."""
    found = pc.fill_null(pc.match_substring_regex(texts, HINT), False)
    return pc.indices_nonzero(found).to_pylist()


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("plain", pa.bool_())])
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("plain", T.BooleanType())])
#: Rows turned into Python strings at once.
_ROWS = 256


def detect(df: DataFrame, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with ``pii``."""
    given = [c for c in df.columns if c.lower() != "pii"]
    keep = [c for c in given if keep_text or c != text]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("pii", T.ArrayType(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                texts = part.column(text)
                found: list[list[dict]] = [[] for _ in range(len(part))]
                for r in hinted(texts):
                    found[r] = [dict(zip(("kind", "start", "end", "plain"), s, strict=True)) for s in spans(texts[r].as_py())]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [pa.array(found, pa.list_(_SPAN))], [*keep, "pii"])

    return df.select(*given).mapInArrow(run, schema)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each span of its text replaced by a mark that names its kind."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                texts = part.column(text)
                if rows := hinted(texts):
                    new = texts.to_pylist()
                    for r in rows:
                        new[r] = marked(new[r], spans(new[r]))
                    part = part.set_column(names.index(text), text, pa.array(new, texts.type))
                yield part

    return df.mapInArrow(run, df.schema)
