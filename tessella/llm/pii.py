"""Personal data with offsets, also behind disguises.

Base spans come from linear scanners that give what the stated patterns give, leftmost and non-overlapping per kind. For
disguised ones, transducers rewrite a text step by step (look-alike characters and invisible ones; written-out digits; at/dot
in words or brackets), each output character carrying the source range it came from. The same scanners run over the result, and a span
that holds at least one rewritten character is mapped back to source offsets; it is added unless it lies within a base span of its kind.
Offsets are code points, ends exclusive.

Defined cases: null is the empty text; several kinds may overlap; equal rows are judged alike. Masking takes the union of all spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructType

from tessella.llm.common import bounded_batches, texts_of, turn

#: Kinds in the order of reports, and the alphabets of the stated patterns.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def scan(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns."""
    out: list[Span] = []
    at = text.find("@")
    done = before = 0
    while at >= 0:
        if at >= done:
            m = DOMAIN.match(text, at + 1)
            head = text[max(done, before) : at]
            start = max(done, before) + len(head.rstrip(LOCAL))
            if m and start < at:
                out.append((start, m.end(), "email"))
                done = m.end()
        before = at + 1
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(int(p) <= 255 if len(p) < 9 else not p.strip("0") or len(p.lstrip("0")) < 4 and int(p.lstrip("0")) <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    return out


#: Look-alikes of ASCII letters (Cyrillic, Greek), and characters that show nothing.
LOOK_ALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνι" "，．﹒․。｡∙＠﹫＋﹢－‐‑‒–",
        "ABESIJKMHOPCTXYaesijopcxyhdqw" "ABEZHIKMNOPTYXaopvi" ",......@@++-----",
        strict=True,
    )
)
INVISIBLE = "­​‌‍⁠﻿᠎"
#: Ranges that stand for runs of ASCII: full-width forms, circled and mathematical digits, Arabic-Indic digits.
RUNS = ((0xFF10, 10, 48), (0xFF21, 26, 65), (0xFF41, 26, 97), (0x2460, 9, 49), (0x1D7CE, 10, 48), (0x1D7D8, 10, 48), (0x1D7E2, 10, 48), (0x1D7EC, 10, 48), (0x1D7F6, 10, 48), (0x0660, 10, 48), (0x06F0, 10, 48), (0x1D400, 26, 65), (0x1D41A, 26, 97), (0x1D5A0, 26, 65), (0x1D5BA, 26, 97), (0x1D670, 26, 65), (0x1D68A, 26, 97))
MAP = {ord(a): b for a, b in LOOK_ALIKES.items()} | {s + k: chr(to + k) for s, n, to in RUNS for k in range(n)}
ODD = re.compile("[" + "".join(map(re.escape, map(chr, MAP))) + INVISIBLE + "]")
INVISIBLES = re.compile(f"[{INVISIBLE}]+")

#: Written-out digits in the corpus's languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_word = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_times = "(?:(?:double|triple)[ -])?"
#: Four or more digits in a row, at least one of them a word; points and a plus may be words too.
SPELLED = re.compile(rf"(?<!\w)(?:(?:plus|\+)[ ,-]{{0,3}})?(?:{_times}{_word}|[0-9]+)(?:(?:[ ,./()-]{{1,3}}|[ ]?(?:point|dot|punkt|punto)[ ]?)(?:{_times}{_word}|[0-9]+)){{3,}}(?!\w)", re.I)
SPELLED_HINT = re.compile(rf"(?<!\w){_word}[ ,./()-]{{1,3}}(?:dot |point |punkt |punto )?{_times}(?:{_word}|[0-9])|\+[0-9][ ().0-9-]{{5,40}}[0-9][ ,./()-]{{1,3}}{_times}{_word}(?!\w)", re.I)
SPELLED_PART = re.compile(rf"({_times})({_word})(?!\w)|([0-9]+)|[ ]?(point|dot|punkt|punto)[ ]?|(plus)[ ]?|(.)", re.I)
#: At and dot in brackets, or as words between what could be a name and a domain.
BRACKETED = re.compile(r"[ ]{0,2}(?:[\[({<][ ]{0,2}(at|@|dot|\.|punkt|punto|arroba|point)[ ]{0,2}[\])}>])[ ]{0,2}", re.I)
AT_WORDS = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})([ ](?:at|arroba|@)[ ]|[ ]?@[ ]?)([A-Za-z0-9-]{1,63}(?:(?:[ ](?:dot|punkt|punto|point)[ ]|[ ]\.[ ]|\.)[A-Za-z0-9-]{1,63}){1,6})(?![A-Za-z0-9-])", re.I)
DOT_WORDS = re.compile(r"[ ](?:dot|punkt|punto|point|\.)[ ]", re.I)
WORD_DOTS = re.compile(r"[ ](?:dot|punkt|punto|point)[ ]", re.I)
AT_HINT = re.compile(r"[ ](?:at|arroba|@)[ ][A-Za-z0-9-]{1,63}(?:[ ](?:dot|punkt|punto|point|\.)[ ]|\.[A-Za-z0-9])|[ ]@|@[ ]|@[A-Za-z0-9-]{1,63}[ ](?:dot|punkt|punto|point)[ ]", re.I)
LIKELY_TLD = re.compile(r"[a-z]{2,24}$", re.I)


class Tape:
    """A text being rewritten. starts/ends give each character's source range, changed whether it was rewritten; absent while untouched."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends, self.changed = text, None, None, None

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace disjoint ordered ranges."""
        if not edits:
            return
        if self.starts is None:
            n = len(self.text)
            self.starts, self.ends, self.changed = list(range(n)), list(range(1, n + 1)), [False] * n
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text += (self.text[at:a], new)
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            if not new and changed:  # a removal marks the character before
                changed[-1] = True
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.starts, self.ends, self.changed = starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:]


def plain_characters(tape: Tape) -> None:
    if not tape.text.isascii() and ODD.search(tape.text):
        tape.rewrite([(m.start(), m.end(), MAP.get(ord(m[0]), "")) for m in ODD.finditer(tape.text)])


def _digits(run: str) -> str:
    out = []
    for times, word, digits, point, plus, other in SPELLED_PART.findall(run):
        if word:
            out.append(DIGIT_WORDS[word.lower()] * {"d": 2, "t": 3}.get(times[:1].lower(), 1))
        else:
            out.append(digits or ("." if point else "+" if plus else other if other in "+./()" else ""))
    return re.sub(r"^\+[ .]*", "+", "".join(out)).replace("/", "")


def spelled_digits(tape: Tape) -> None:
    if SPELLED_HINT.search(tape.text):
        found = [m for m in SPELLED.finditer(tape.text) if SPELLED_HINT.search(m[0])]
        tape.rewrite([(*m.span(), _digits(m[0])) for m in found])


def at_and_dot(tape: Tape) -> None:
    edits = []
    if any(c in tape.text for c in "[({<"):
        edits = [(*m.span(), "@" if m[1].lower() in ("at", "@", "arroba") else ".") for m in BRACKETED.finditer(tape.text)]
        tape.rewrite(edits)
    if AT_HINT.search(tape.text):
        edits = []
        for m in AT_WORDS.finditer(tape.text):
            spaced = m[2] != "@" or DOT_WORDS.search(m[3])
            words = m[2].strip().lower() != "@"
            tail = DOT_WORDS.split(m[3])[-1].rsplit(".", 1)[-1]
            if not spaced or not LIKELY_TLD.match(tail) or (words and not WORD_DOTS.search(m[3]) and tail.lower() not in COMMON_TLDS):
                continue
            if m[2] != "@":
                edits.append((*m.span(2), "@"))
            edits += [(m.start(3) + d.start(), m.start(3) + d.end(), ".") for d in DOT_WORDS.finditer(m[3])]
        tape.rewrite(edits)


#: Endings that are taken for a domain's after a plain "x at y.z".
COMMON_TLDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info")


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each by start, then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    base = sorted(scan(text), key=order)
    tape = Tape(text)
    for transducer in (plain_characters, spelled_digits, at_and_dot):
        transducer(tape)
    if tape.starts is None:
        return base, base
    more = []
    for a, b, kind in scan(tape.text):
        if any(tape.changed[a:b]):
            a, b = tape.starts[a], tape.ends[b - 1]
            if not any(k == kind and x <= a and b <= y for x, y, k in base):
                more.append((a, b, kind))
    return base, sorted({*base, *more}, key=order)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts by kind, base_sha256 and all spans of every text; n_all counts all spans."""

    def run(batches: Iterator):
        import pyarrow as pa

        turn("pii")
        for b in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            shas, spans, total = [], [], []
            for t in texts_of(b):
                base, found = find(t.decode())
                for column, kind in zip(counts, KINDS):
                    column.append(sum(s[2] == kind for s in base))
                shas.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(found))
                total.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(total, pa.int64())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_all"])

    bounded_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_all long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    out, at = [], 0
    for a, b, kind in find(text)[1]:
        if a >= at:
            out += (text[at:a], f"<{kind}>")
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with masked texts; null stays null, other columns and their order stay."""

    def run(batches: Iterator):
        import pyarrow as pa

        turn("pii")
        for b in batches:
            got = pa.array([None if t is None else mask(t) for t in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([got if n == text else b.column(n) for n in b.schema.names], names=b.schema.names)

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([f if f.name != text else type(f)(text, StringType()) for f in docs.schema]))
