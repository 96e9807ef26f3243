"""Personal data in texts, found through disguises, with offsets of the original characters.

Plain identifiers are found in the source text. Then transducers rewrite disguises (homoglyphs, spelled digits, spelled or
bracketed at/dot), each output character remembering the source span it came from; identifiers found in the rewritten text
are mapped back and added where they cover a disguise. Spans are code points, end exclusive.

Defined results: a null text counts as empty and has no spans. Repeated rows give repeated results, each row on its own.
Whole texts are scanned, however long: no expression here backtracks over a run of characters more than once. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of the email pattern, from each @ outwards, so that long runs stay linear."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def _is_card(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_phone(found: str) -> bool:
    return 9 <= len(_NOT_DIGIT.sub("", found)) <= 15


def plain_spans(text: str) -> dict[str, list[Span]]:
    """Base spans by kind."""
    spans: dict[str, list[Span]] = {"email": _emails(text) if "@" in text else []}
    for kind, pattern, good in (("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone)):
        spans[kind] = [m.span() for m in pattern.finditer(text) if good(m.group())] if kind != "phone" or "+" in text else []
    return spans


# Characters that look like ASCII ones, and words for digits.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "А": "A", "В": "B", "С": "C", "Е": "E",
    "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "Α": "A", "Β": "B",
    "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ı": "i", "ℓ": "l", "․": ".", "。": ".", "﹒": ".", "·": ".", "‐": "-", "‑": "-", "–": "-", "−": "-",
}
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
ZERO_WIDTH = "­​‌‍⁠﻿"
# The fullwidth forms and mathematical-style digits follow the ASCII order, so a rule gives them.
_GLYPHS = dict(HOMOGLYPHS) | {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)} | {chr(b + d): str(d) for b in (0x0660, 0x06F0, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
_GLYPH_TABLE = str.maketrans(_GLYPHS)
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + ZERO_WIDTH + "]")

_DIGIT_WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPELLED = re.compile(rf"(?i)(?<![^\W_])(?:(?:{_DIGIT_WORD}|[0-9])[ ,.\-\t\r\n]{{1,2}}){{2,}}(?:{_DIGIT_WORD}|[0-9])(?![^\W_])")
_HAS_DIGIT_WORD = re.compile(rf"(?i)(?<![^\W_]){_DIGIT_WORD}[ ,.\-\t\r\n]{{1,2}}(?:{_DIGIT_WORD}|[0-9])(?![^\W_])")
_ONE_DIGIT = re.compile(rf"(?i){_DIGIT_WORD}")
_POINT_WORD = re.compile(r"(?i)(?<=[0-9])[ \t\r\n]{1,2}(?:dot|point)[ \t\r\n]{1,2}(?=[0-9])")
_PLUS_WORD = re.compile(r"(?i)(?<![^\W_])plus[ \t\r\n]{1,2}(?=[0-9])")
#: White space within a disguise: a line may break there.
_W = r"[ \t\r\n]"


def _bracketed(word: str, sign: str) -> str:
    """A word or sign in brackets of any kind, white space inside and around."""
    pairs = ((r"\(", r"\)", True), (r"\[", r"\]", True), (r"\{", r"\}", True), ("<", ">", False))
    return "|".join(f"{left}{_W}?{f'(?:{word}|{sign})' if signed else word}{_W}?{right}" for left, right, signed in pairs)


_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9._%+-])(?:{_W}{{0,2}}(?:{_bracketed('at', '@')}){_W}{{0,2}}|{_W}{{1,2}}(?:at|@){_W}{{1,2}}| @|@ |_at_|-at-)(?=[A-Za-z0-9])")
_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9-])(?:{_W}{{0,2}}(?:{_bracketed('dot', '[.]')}){_W}{{0,2}}|{_W}{{1,2}}(?:dot|\.){_W}{{1,2}}|_dot_|-dot-)(?=[A-Za-z0-9])")
#: An at is read as @ only if labels with real or disguised dots between follow it. Labels and dots give nothing back, so a match stays linear.
_HOST = rf"(?i)(?:(?>(?:(?!-dot-)[A-Za-z0-9-]){{1,63}})(?>_dot_|-dot-|{_W}{{0,2}}[\(\[{{<]?{_W}?(?:dot|\.){_W}?[\)\]}}>]?{_W}{{0,2}})){{1,126}}"
#: After a bare at, a plain dot with white space beside it ends a sentence.
_BARE_HOST = rf"(?i)(?:(?>(?:(?!-dot-)[A-Za-z0-9-]){{1,63}})(?>_dot_|-dot-|{_W}{{0,2}}[\(\[{{<]{_W}?(?:dot|\.){_W}?[\)\]}}>]{_W}{{0,2}}|{_W}{{1,2}}dot{_W}{{1,2}}|\.)){{1,126}}"
_SPELLED_HOST = rf"(?i)(?:(?>[A-Za-z0-9-]{{1,63}}){_W}{{1,2}}dot{_W}{{1,2}}){{1,126}}"
_AFTER_AT = re.compile(_HOST + r"[a-z]{2,63}(?![^\W_])")
# Endings of domains of four letters and more, which after a bare at count only if all dots are spelled, too.
_ENDINGS = (
    "tech online shop store site cloud email blog world live club group team agency digital media news systems solutions software studio design "
    "company network services support academy education institute foundation museum travel photography"
)
#: After a bare " at " the last label must look like a top-level domain, too, and not like the first word of a sentence.
_AFTER_BARE_AT = re.compile(
    _BARE_HOST + r"(?:(?-i:[a-z]{2,3}|[A-Z]{2,3})|info|example|name|mail|test|local|invalid)(?![^\W_])|" + _SPELLED_HOST.removeprefix("(?i)") + f"(?:{_ENDINGS.replace(' ', '|')})" + r"(?![^\W_])"
)
_NO_DOMAIN = re.compile(r"(?i)(?:the|a|an|this|that|these|those|our|my|your|his|her|its|their|any|each|some|no|one)(?![A-Za-z0-9-])")
_TRIGGER = re.compile(r"(?i)(?<![^\W_])(?:at|dot|@)(?![^\W_])| @|@ ")


class Transduced:
    """A rewritten text whose every character knows its source span."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, range(len(text)), range(1, len(text) + 1), []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace spans of the current text, in order and apart. An edit's characters all map to its whole source span."""
        if not edits:
            return
        out, starts, ends, last = [], [], [], 0
        for a, b, new in edits:
            out += (self.text[last:a], new)
            lo, hi = (self.starts[a], self.ends[b - 1]) if b > a else (0, 0)
            starts += [*self.starts[last:a], *[lo] * len(new)]
            ends += [*self.ends[last:a], *[hi] * len(new)]
            self.changed.append((lo, hi))
            last = b
        out.append(self.text[last:])
        starts += self.starts[last:]
        ends += self.ends[last:]
        self.text, self.starts, self.ends = "".join(out), starts, ends


def _homoglyphs(state: Transduced) -> None:
    state.rewrite([(*m.span(), m.group().translate(_GLYPH_TABLE).strip(ZERO_WIDTH)) for m in _GLYPH.finditer(state.text)])


def _spelled_digits(state: Transduced) -> None:
    edits = []
    for run in _SPELLED.finditer(state.text):
        if _ONE_DIGIT.search(run.group()):
            digits = _ONE_DIGIT.sub(lambda m: DIGIT_WORDS[m.group().lower()], run.group())
            edits.append((*run.span(), re.sub("[^0-9]", "", digits)))
    state.rewrite(edits)
    state.rewrite([(*m.span(), ".") for m in _POINT_WORD.finditer(state.text)])
    state.rewrite([(*m.span(), "+") for m in _PLUS_WORD.finditer(state.text)])


def _at_dot(state: Transduced) -> None:
    ats, bare_ats, shorter = [], set(), 0
    for m in _AT.finditer(state.text):
        bare = m.group().strip().lower() == "at"  # whatever white space stands around it
        if (_AFTER_BARE_AT if bare else _AFTER_AT).match(state.text, m.end()) and not (bare and _NO_DOMAIN.match(state.text, m.end())):
            ats.append((*m.span(), "@"))
            if bare:
                bare_ats.add(m.start() - shorter)  # where its @ will stand
            shorter += len(m.group()) - 1
    state.rewrite(ats)
    if "@" not in state.text:
        return
    dots, at, free = [], state.text.find("@"), 0
    while at >= 0:
        tail = (_AFTER_BARE_AT if at in bare_ats else _AFTER_AT).match(state.text, at + 1)
        if tail:
            dots += [(*m.span(), ".") for m in _DOT.finditer(state.text, max(at, free), tail.end()) if m.end() < tail.end()]
            free = tail.end()
        at = state.text.find("@", at + 1)
    state.rewrite(dots)


def disguised_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans found only after the transducers, as source spans that hold a disguise. One overlaps a base span of its kind only if it
    extends it: the base stays, and the whole is added."""
    wanted = (bool(_GLYPH.search(text)), bool(_HAS_DIGIT_WORD.search(text) or _POINT_WORD.search(text)), bool(_TRIGGER.search(text)) or ("@" in text and bool(_DOT.search(text))))
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not any(wanted):
        return found
    state = Transduced(text)
    for step, on in zip((_homoglyphs, _spelled_digits, _at_dot), wanted, strict=True):
        if on or (state.changed and step is not _homoglyphs):
            step(state)
    if not state.changed:
        return found
    edits = sorted(state.changed)
    edit_starts = [a for a, _ in edits]
    edit_ends = list(accumulate((b for _, b in edits), max))
    for kind, spans in plain_spans(state.text).items():
        taken = base[kind]
        starts = [s for s, _ in taken]
        for a, b in spans:
            lo, hi = state.starts[a], state.ends[b - 1]
            holds = bisect_right(edit_ends, lo) < bisect_left(edit_starts, hi)
            i = bisect_left(starts, hi)
            apart = i == 0 or taken[i - 1][1] <= lo
            if holds and (apart or _extends(state, (lo, hi), taken[i - 1])):
                found[kind].append((lo, hi))
    return found


def _extends(state: Transduced, span: Span, base: Span) -> bool:
    """Whether a span holds a base span and goes on beyond it with disguised letters or digits, so that the base is only a part."""
    before, after = bisect_left(state.starts, base[0]), bisect_left(state.starts, base[1])
    left = span[0] == base[0] or state.text[before - 1].isalnum()
    right = span[1] == base[1] or state.text[after].isalnum()
    return span[0] <= base[0] and base[1] <= span[1] and span != base and left and right


def _joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in sorted(spans[k]))


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and those spans with the ones that only the transducers show."""
    base = plain_spans(text)
    more = disguised_spans(text, base)
    return base, {k: base[k] + more[k] for k in KINDS}


def redact(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans count as the first of them."""
    _, spans = find(text)
    out, last = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if b > last:
            out += (text[last : max(last, a)], f"<{kind}>") if a >= last else ()
            last = b
    return "".join(out) + text[last:] if last else text


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text in texts_of(batch):
            base, spans = find(text)
            for c, k in zip(cols, KINDS, strict=False):
                c.append(len(spans[k]))
            cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            cols[5].append(_joined(spans))
        types = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in _SCHEMA.split(", ")])


def op5(docs: DataFrame) -> DataFrame:
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _digests, _SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in `text` and `n_chars` counted anew; null texts stay null."""
    clean = F.pandas_udf(lambda texts: texts.map(lambda t: t if t is None else redact(t)), "string")  # Spark bounds its batches by bytes
    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
