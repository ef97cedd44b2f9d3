"""Personal data in texts, plain and disguised: transducers that keep offsets, detection, and spans in the source."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: Letters of other scripts that look like ASCII letters, script by script.
LOOKALIKES = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "ı": "i", "ɑ": "a", "ɡ": "g", "ʏ": "y", "ɩ": "i",
    "。": ".", "·": ".", "•": ".", "∙": ".", "−": "-", "⁃": "-", "∕": "/",
}
#: Digits spelled in English, German, French and Spanish, from 0 to 9.
SPELLED = {w: str(i) for words in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve") for i, w in enumerate(words.split())} | {"oh": "0", "nought": "0", "niner": "9", "zwo": "2", "fuenf": "5", "une": "1"}
#: Words for the signs of addresses and numbers.
SAID_DOT, SAID_AT, SAID_DASH, SAID_PLUS = ("dot", "point", "punkt", "punto"), ("at", "arroba", "arobase"), ("dash", "hyphen", "minus"), ("plus", "más")
#: What is said for a dot by those who say so for @. Other pairs of bare words are prose, as "at the point of".
SAID_TOGETHER = {"at": ("dot", "punkt"), "arobase": ("point",), "arroba": ("punto",)}
TIMES = {"double": 2, "triple": 3}

LOCAL, LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
DOMAIN = re.compile(rf"@{LABEL}+(?:\.{LABEL}+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


def luhn(digits: str) -> bool:
    """Whether the check digit is right: every second digit from the right is doubled, and the sum ends in 0."""
    doubled = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(d) if i % 2 == 0 else doubled[int(d)] for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain. The local part is what stands before the @, as far as the match before lets it."""
    done = seen = 0
    if "@" not in text:
        return
    for m in DOMAIN.finditer(text):
        at = m.start()
        before = text[max(done, text.rfind("@", seen, at) + 1) : at]
        n = len(before) - len(before.rstrip(_LOCAL_CHARS))
        seen = at
        if n:
            done = m.end()
            yield at - n, done


def detect(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in order of kind and start: leftmost matches of each kind that pass its test, without another try after one that doesn't. Time is linear in the text."""
    found = [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


class Transduced:
    """A text after transducers, with what each piece of it was in the source."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._steps: list[tuple[list[int], list[tuple[int, int, int, int]]]] = []

    def rewrite(self, changes: Iterable[tuple[int, int, str]]) -> None:
        """Replace parts of the text: (start, end, new text) of each, in order."""
        pieces, out, at, size = [], [], 0, 0  # pieces: (start after, end after, start before, end before)
        for start, end, new in changes:
            if self.text[start:end] == new:
                continue
            out += [self.text[at:start], new]
            size += start - at
            pieces.append((size, size + len(new), start, end))
            size, at = size + len(new), end
        if pieces:
            self.text = "".join([*out, self.text[at:]])
            self._steps.append(([p[0] for p in pieces], pieces))

    @property
    def changed(self) -> bool:
        return bool(self._steps)

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """What a span was in the source, and whether any of it was changed. Parts that were changed count whole."""
        changed = False
        for starts, pieces in reversed(self._steps):
            i = bisect_right(starts, start) - 1  # the last piece that begins at or before the span
            j = bisect_right(starts, end - 1) - 1
            while i >= 0 and i < len(pieces) - 1 and starts[i + 1] == starts[i] and pieces[i][1] <= start:
                i += 1
            inside = i >= 0 and pieces[i][0] <= start < pieces[i][1]
            changed |= inside or j > i
            start = pieces[i][2] if inside else start + (pieces[i][3] - pieces[i][1] if i >= 0 else 0)
            end = pieces[j][3] if j >= 0 and end <= pieces[j][1] else end + (pieces[j][3] - pieces[j][1] if j >= 0 else 0)
        return start, end, changed


@lru_cache(maxsize=4096)
def plain(c: str) -> str:
    """The ASCII character that a character stands for, '' for invisible ones, and the character itself for all others."""
    kind = unicodedata.category(c)
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    if kind in ("Cf", "Zs", "Pd"):
        return {"Cf": "", "Zs": " ", "Pd": "-"}[kind]
    same = unicodedata.normalize("NFKC", c)
    return LOOKALIKES.get(same, same if len(same) == 1 and same < "\x7f" else c)


def _any(words: Iterable[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


_GAP = r"[\s,;/()–-]{1,4}"
_DIGIT = rf"(?:(?:{_any(TIMES)})\s)?(?:{_any(SPELLED)})"
_UNIT = rf"(?:{_DIGIT}|[0-9]++)"
#: Digits with what may stand between them, and a plus.
SPOKEN = re.compile(rf"(?:(?<![^\W_])(?:{_any(SAID_PLUS)})\s{{1,4}}|\+\s{{0,4}})?(?<![^\W_]){_UNIT}(?:(?:{_GAP}(?:{_any((*SAID_DOT, *SAID_DASH))}){_GAP}|{_GAP}|\.){_UNIT})+(?![^\W_])", re.I)
SPOKEN_PARTS = re.compile(rf"((?:{_any(SAID_PLUS)}|\+)\s*)|({_DIGIT})|{_GAP}({_any(SAID_DOT)}){_GAP}|{_GAP}({_any(SAID_DASH)}){_GAP}|([0-9]+)|({_GAP})", re.I)
#: O, l, I and | among figures.
NUMERALS = re.compile(r"(?<![A-Za-z0-9|])(?=[OolI|]*[0-9])(?=[0-9]*[OolI|])[0-9OolI|]{2,}(?![A-Za-z0-9|])")
_OPEN, _CLOSE = r"\s{0,3}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,3}"
CODED_AT, CODED_DOT = ("&#64;", "&#x40;", "&commat;", "%40"), ("&#46;", "&#x2e;", "&period;", "%2e")
_AT = rf"{_OPEN}(?:{_any(SAID_AT)}|@){_CLOSE}|\s?(?:{_any(CODED_AT)})\s?|\s{{0,3}}@\s{{0,3}}"
_DOT = rf"(?:{_OPEN}(?:{_any(SAID_DOT)}|\.|,){_CLOSE}|\s?(?:{_any(CODED_DOT)})\s?|\s{{1,3}}(?:{_any(SAID_DOT)})\s{{1,3}})"
#: Plain and disguised @. A bare word counts only before a disguised dot, as "at" is a common word.
AT = re.compile(rf"(?:{_AT})|(?P<said>\s{{1,3}}(?:{_any(SAID_AT)})\s{{1,3}})", re.I)
_LABELS = rf"{LABEL}++(?:\.{LABEL}++)*+"
HOST = re.compile(rf"{_LABELS}(?:(?:{_DOT}|\s\.\s){_LABELS})*+", re.I)
DOT, DOT_BEFORE = re.compile(rf"{_DOT}|\s\.\s", re.I), re.compile(rf"{_DOT}\Z", re.I)
#: Longest disguise of a dot.
DOT_CHARS = 17
#: Dots between figures, in brackets or spelled.
FIGURES = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_NO_FIGURE = re.compile("[^0-9]+")
TOP_DOMAIN = re.compile(r"\.[A-Za-z]{2,24}$")
_IN_BRACKETS = re.compile(rf"[\[({{<]\s{{0,2}}(?:{_any((*SAID_AT, *SAID_DOT))}|[@.,])")


def speaks(low: str) -> bool:
    """Whether a spelled digit stands beside a digit, a sign or a multiple. low: the text in small letters."""
    for c in ",;/()–-.":
        low = low.replace(c, " ")
    words = low.split()
    if _SPELLED.isdisjoint(words):
        return False
    before = ""
    for w in words:
        if w in _SPELLED and (before in _SPOKEN_WORDS or before.isdigit()) or before in _SPELLED and (w in _SPOKEN_WORDS or w.isdigit()):
            return True
        before = w
    return False


_SPELLED = frozenset(SPELLED)
_SPOKEN_WORDS = _SPELLED.union(SAID_DOT, SAID_DASH, SAID_PLUS, TIMES)


def disguises(low: str) -> bool:
    """Whether any disguise of @ or a dot may be there, as a cheap test. low: the text in small letters."""
    return any(w in low for w in (*SAID_DOT, *CODED_AT, *CODED_DOT, "@ ", " @")) or _IN_BRACKETS.search(low) is not None


def _spoken(m: re.Match) -> list[tuple[int, int, str]]:
    """Figures for spelled digits, nothing for gaps between them, one space for gaps beside figures, and signs for their names; no change if no digit is spelled."""
    parts: list[tuple[int, int, str]] = []
    found = list(SPOKEN_PARTS.finditer(m[0]))
    for i, p in enumerate(found):
        a, b = m.start() + p.start(), m.start() + p.end()
        if p[1]:
            parts.append((a, b, "+"))
        elif p[2]:
            *times, word = p[2].lower().split()
            parts.append((a, b, SPELLED[word] * (TIMES[times[0]] if times else 1)))
        elif p[3] or p[4]:
            parts.append((a, b, "." if p[3] else "-"))
        elif p[6]:
            dash = "-" in p[6] or "–" in p[6]
            spelled = 0 < i < len(found) - 1 and found[i - 1][2] and found[i + 1][2]
            if spelled or p[6] not in (" ", "-", "(", ")", ") ", " (", ")-", "-("):
                parts.append((a, b, "-" if dash else "" if spelled else " "))
    return parts if any(p[2] for p in found) else []


def _said_together(at: str, dots: list[str]) -> bool:
    """Whether there is a disguised dot, and every one that is a bare word goes with the bare word for @."""
    said = [d for d in (d.strip().lower() for d in dots) if d in SAID_DOT]
    return bool(dots) and all(d in SAID_TOGETHER[at.strip().lower()] for d in said)


def addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """Changes that turn disguised addresses into plain ones: from each @, the local part to the left and the host to the right."""
    done = 0
    for m in AT.finditer(text):
        if m.start() < done:
            continue
        floor, done = done, m.end()
        host = HOST.match(text, m.end())
        dots = [(a, b, ".") for a, b in (d.span() for d in DOT.finditer(text, host.start(), host.end()))] if host else []
        if not host or not TOP_DOMAIN.search(DOT.sub(".", host[0])) or (m["said"] is not None and not _said_together(m["said"], [text[a:b] for a, b, _ in dots])):
            continue
        at, local = m.start(), []
        while True:
            start = at
            while at > floor and text[at - 1] in _LOCAL_CHARS:
                at -= 1
            dot = DOT_BEFORE.search(text, max(floor, at - DOT_CHARS), at) if at < start else None
            if not dot or dot.start() == floor or text[dot.start() - 1] not in _LOCAL_CHARS:
                break
            local.append((*dot.span(), "."))
            at = dot.start()
        if start > at or local:
            yield from reversed(local)
            yield (*m.span(), "@")
            yield from dots
            done = host.end()


def normalised(text: str) -> Transduced:
    """The text after all transducers: look-alikes, spelled and look-alike digits, disguised addresses and dots."""
    t = Transduced(text)
    if not text.isascii():
        odd = {c: p for c in set(text) if c > "\x7f" and (p := plain(c)) != c}
        if odd:
            t.rewrite((*m.span(), odd[m[0]]) for m in re.finditer("[" + "".join(map(re.escape, odd)) + "]", text))
    low = t.text.lower()
    if speaks(low):
        t.rewrite(p for m in SPOKEN.finditer(t.text) for p in _spoken(m))
    t.rewrite((*m.span(), m[0].translate(_FIGURES)) for m in NUMERALS.finditer(t.text))
    if disguises(low):
        t.rewrite(addresses(t.text))
        t.rewrite((m.start() + p.start(), m.start() + p.end(), ".") for m in FIGURES.finditer(t.text) for p in _NO_FIGURE.finditer(m[0]))
    return t


_FIGURES = str.maketrans("OolI|", "00111")


def spans(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the source as (kind, start, end): those of `detect`, and those that only show once it is normalised.

    An added span holds a changed part, and does not lie within a span of its kind that the source shows as it is.
    """
    if not text:
        return [], []
    base, t = detect(text), normalised(text)
    added = []
    if t.changed:
        starts = {k: [s[1] for s in base if s[0] == k] for k in KINDS}
        ends = {k: [s[2] for s in base if s[0] == k] for k in KINDS}
        for kind, a, b in detect(t.text):
            start, end, changed = t.source(a, b)
            i = bisect_right(starts[kind], start) - 1
            within = i >= 0 and end <= ends[kind][i]
            if changed and not within and (kind != "email" or TOP_DOMAIN.search(t.text[a:b])):
                added.append((kind, start, end))
    return base, added


def find(docs: DataFrame) -> DataFrame:
    """Personal data of every row of docs(doc_id, text): doc_id, spans (kind, start, end, plain, found; by kind as in KINDS, then start).

    start and end count code points of the source text, end exclusive; found is what the text has there. plain is
    true for spans that the source shows as they are, false for those that transducers brought to light. Whole texts
    are searched, in time linear in their length. Null and empty texts have no spans. Rows with null or repeated
    doc_id are rows of their own; other columns are ignored; an empty table gives no rows.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("plain", pa.bool_()), ("found", pa.string())]))

    def of(text: str | None) -> list[dict]:
        base, added = spans(text)
        rows = [(k, a, b, True) for k, a, b in base] + [(k, a, b, False) for k, a, b in added]
        return [{"kind": k, "start": a, "end": b, "plain": p, "found": text[a:b]} for k, a, b, p in sorted(rows, key=lambda r: (KINDS.index(r[0]), r[1], r[2]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([of(t.as_py()) for t in part.column(1)], kind)], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, plain: boolean, found: string>>")


def _listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """What `find` returns in numbers: doc_id, n_email, n_ip, n_card, n_phone (plain spans), base_sha256 (of the plain spans as kind:start:end, joined by commas), spans (all, likewise), n_added."""
    base = F.filter("spans", lambda s: s["plain"])
    counts = [F.size(F.array_compact(F.transform(base, lambda s: F.when(s["kind"] == k, 1)))).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"))


def mask(docs: DataFrame) -> DataFrame:
    """doc_id and text of every row of docs(doc_id, text), with each span replaced by its kind in angle brackets.

    Of spans that overlap, the one that begins first is replaced, the longest first where several begin at one place.
    Null texts stay null.
    """

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        out, at = [], 0
        for kind, a, b in sorted((s for part in spans(text) for s in part), key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{kind}>"]
                at = b
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([masked(t.as_py()) for t in batch.column(1)], pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")
