"""Personal data in text, also where it is disguised: normalise with an offset map, detect, map the spans back.

Detectors for e-mail addresses, IPv4 addresses, payment cards and phone numbers run twice: over the text as it is, and
over a normal form made by three transducers (look-alike and invisible characters, spelled digits, at/dot disguises).
Each transducer notes for every character it emits the source span it stands for, so a span found in the normal form is
a span of source characters. Only spans that some transducer changed are added; spans of the plain text always stay.

Offsets are code points, the end exclusive. Defined results: a NULL or empty text has no spans; texts are read whole;
repeated rows give repeated rows; an empty table gives an empty table; other columns are carried only where asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censora.llm.frames import slices, with_fields

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: every domain behind an @, with the longest local part that no earlier match took."""
    taken, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        while m and start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if m and start < at:
            yield start, m.end()
            taken = m.end()
        at = text.find("@", max(at + 1, taken))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
            yield m.span()


def luhn(digits: str) -> bool:
    doubled = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                yield m.span()


DETECTORS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = dict(zip(KINDS, (emails, ips, cards, phones)))


class Mapped(NamedTuple):
    """A normal form: its text, and for each of its characters where the source span starts and ends, and if it was changed."""

    text: str
    starts: list[int]
    ends: list[int]
    changed: list[bool]

    def rewritten(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """``edits`` (start, end, new text; sorted, apart from each other): each new character stands for the whole old span."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            starts += self.starts[at:a] + [self.starts[a]] * len(new)
            ends += self.ends[at:a] + [self.ends[b - 1]] * len(new)
            changed += self.changed[at:a] + [True] * len(new)
            at = b
        return Mapped("".join([*text, self.text[at:]]), starts + self.starts[at:], ends + self.ends[at:], changed + self.changed[at:])


def _lookalikes() -> dict[str, str]:
    """Characters read as an ASCII one: compatibility forms by rule, letters of other scripts as listed; invisible ones vanish."""
    by_rule = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x2000, 0x20000) if not 0x3400 <= c < 0xF900}
    table = {c: n for c, n in by_rule.items() if len(n) == 1 and "!" <= n <= "~"}
    # Digits of every script.
    table |= {chr(c): str(unicodedata.decimal(chr(c))) for c in range(0x370, 0x20000) if unicodedata.decimal(chr(c), None) is not None}
    # Cyrillic and Greek letters that look like Latin ones.
    cyrillic, greek = "аАВеЕіІјЈКоОМНрРсСТуУхХѕЅԁԛԝһӏ", "ΑΒΕΖΗΙΚΜΝΟοΡΤΥΧ"
    table |= dict(zip(cyrillic, "aABeEiIjJKoOMHpPcCTyYxXsSdqwhl")) | dict(zip(greek, "ABEZHIKMNOoPTYX"))
    # Dashes, dots and spaces; characters without width.
    table |= dict.fromkeys("\u2010\u2011\u2012\u2013\u2212", "-") | dict.fromkeys("\u3002\u2024\uff61\u2022", ".")
    return table | dict.fromkeys("\xa0\u2007\u2009\u202f\u3000", " ") | dict.fromkeys("\xad\u200b\u200c\u200d\u2060\ufeff", "")


LOOKALIKES = _lookalikes()
# Where look-alikes can be: no other Latin letters than ASCII ones are among them.
_LOOKALIKE = re.compile("[\xa0\xad\u0370-\U0010ffff]")

# Digit words, and words said between digits.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
SIGN_WORDS = {"dot": ".", "point": ".", "punkt": ".", "punto": ".", "plus": "+", "dash": "-", "hyphen": "-"}
_SAID = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_SIGN = "|".join(SIGN_WORDS)
_GAP = r"[\x20\t,().-]{1,3}"
# Digit words and digits in a row, with signs said between them.
_RUN = re.compile(rf"(?<!\w)(?:plus{_GAP}|\+\x20?)?(?:{_SAID}|[0-9]++)(?:{_GAP}(?:(?:{_SIGN}){_GAP})?(?:{_SAID}|[0-9]++))+(?!\w)", re.I)
_TOKEN = re.compile(rf"{_SAID}|{_SIGN}|[0-9]+|\+", re.I)
# What tells such a run from one of digits alone.
_LETTER = re.compile(r"[^\W\d_]")

_OPEN, _SHUT = r"[\[({<]", r"[\])}>]"
_AT = re.compile(rf"\x20*{_OPEN}\x20*(?:at|@|arroba|arobase)\x20*{_SHUT}\x20*", re.I)
_DOT = re.compile(rf"\x20*{_OPEN}\x20*(?:dot|\.|punkt|punto|point)\x20*{_SHUT}\x20*", re.I)
_SPACED = re.compile(r"(?<=[A-Za-z0-9])\x20+@\x20*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@\x20+(?=[A-Za-z0-9])")
# Bare words count only together, in front of a common ending; "at" alone where the name before it is no plain word.
# The endings.
_ENDING = "com|org|net|edu|gov|info|biz|io|co|de|fr|es|uk|eu|us|ca|it|nl|ch|at|be|ai|app|dev|me"
_LABEL = r"[A-Za-z0-9-]+?"
_POINT, _SIGN_AT = r"(?:\.|[\x20_-]dot[\x20_-])", r"(?:[\x20_-]at[\x20_-]|@)"
_BARE = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9%+]+(?:(?:[._-]|[\x20_-]dot[\x20_-])[A-Za-z0-9%+]+)*?{_SIGN_AT}{_LABEL}(?:{_POINT}{_LABEL})*?{_POINT}(?:{_ENDING})(?![A-Za-z0-9-])", re.I)
# Where both signs are spoken any ending counts but these words, which are no top-level domains.
_NO_ENDING = "of|or|on|if|up|an|he|we|and|the|that|this|which|with|for|from|was|were|has|had|not|but|then|than|when|where"
_SPOKEN = re.compile(
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9%+]+(?:(?:[._-]|[\x20_-]dot[\x20_-])[A-Za-z0-9%+]+)*?[\x20_-]at[\x20_-]{_LABEL}(?:{_POINT}{_LABEL})*[\x20_-]dot[\x20_-]"
    rf"(?!(?:{_NO_ENDING})(?![A-Za-z0-9-]))[A-Za-z]{{2,}}(?![A-Za-z0-9-])",
    re.I,
)
_BARE_WORDS = re.compile(r"[\x20_-](at|dot)[\x20_-]", re.I)
_BARE_HINT = re.compile(r"[\x20_-]dot[\x20_-]")
_AT_NAME = re.compile(rf"(?<![A-Za-z0-9._%+-])(?=[A-Za-z0-9_]*[0-9._])[A-Za-z0-9][A-Za-z0-9._%+-]*(?P<at>\x20+at\x20+)[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:{_ENDING})(?![A-Za-z0-9-])", re.I)


def looks(form: Mapped) -> Mapped:
    """Homoglyphs, compatibility forms and digits of other scripts as ASCII; characters without width dropped."""
    return form.rewritten([(*m.span(), LOOKALIKES[m[0]]) for m in _LOOKALIKE.finditer(form.text) if m[0] in LOOKALIKES])


def runs(text: str) -> Iterator[re.Match]:
    """Runs that hold digit words or spoken signs."""
    return (m for m in _RUN.finditer(text) if _LETTER.search(m[0]))


def spelled(form: Mapped, close: bool) -> Mapped:
    """Runs that hold digit words or spoken signs as digits and signs: ``close`` together, or with the marks between the digits left."""
    edits = []
    for m in runs(form.text):
        tokens = list(_TOKEN.finditer(form.text, *m.span()))
        for k, token in enumerate(tokens):
            word = token[0].lower()
            new = DIGIT_WORDS.get(word) or SIGN_WORDS.get(word, word)
            # The gap before a token goes with it, so that digits become neighbours; a spoken sign takes the gaps beside it along in any case.
            after_sign = k > 0 and tokens[k - 1][0].lower() in SIGN_WORDS
            start = tokens[k - 1].end() if k and (close or after_sign or word in SIGN_WORDS) else token.start()
            if form.text[start : token.end()] != new:
                edits.append((start, token.end(), new))
    return form.rewritten(edits)


def signs(form: Mapped) -> Mapped:
    """Bracketed, spaced and spoken at and dot signs as the signs."""
    if any(c in form.text for c in "[({<"):
        edits = [(*m.span(), "@") for m in _AT.finditer(form.text)] + [(*m.span(), ".") for m in _DOT.finditer(form.text)]
        form = form.rewritten(sorted(edits))
    low = form.text.lower()
    if _BARE_HINT.search(low):
        found = {w.span(): w[1] for like in (_BARE, _SPOKEN) for m in like.finditer(form.text) for w in _BARE_WORDS.finditer(form.text, *m.span())}
        form = form.rewritten([(*span, "@" if word.lower() == "at" else ".") for span, word in sorted(found.items())])
    if " at " in low:
        form = form.rewritten([(*m.span("at"), "@") for m in _AT_NAME.finditer(form.text)])
    if "@" in form.text:
        form = form.rewritten([(*m.span(), "@") for m in _SPACED.finditer(form.text)])
    return form


def disguised(text: str) -> bool:
    """Whether any transducer has something to do; plain text costs this test alone."""
    low = f" {text.lower()}"
    return bool(
        (_LOOKALIKE.search(text) and not LOOKALIKES.keys().isdisjoint(text))
        or "dot" in low
        and _BARE_HINT.search(low)
        or any(c in text for c in "[({<")
        and (_AT.search(text) or _DOT.search(text))
        or "@" in text
        and (" @" in text or "@ " in text)
        or " at " in low
        and any(f".{e}" in low for e in _ENDING.split("|"))
        or next(runs(text), None)
    )


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool


def spans(text: str | None) -> list[Span]:
    """All spans by kind as listed, then start: those of the plain text, and the disguised ones that none of these covers."""
    if not text:
        return []
    has_digit = _DIGIT.search(text) is not None
    found = {kind: [(*s, True) for s in detect(text)] if kind == "email" or has_digit else [] for kind, detect in DETECTORS.items()}
    if disguised(text):
        form = looks(Mapped(text, list(range(len(text))), list(range(1, len(text) + 1)), [False] * len(text)))
        close, loose = spelled(form, True), spelled(form, False)
        for form in map(signs, (close, loose) if loose.text != close.text else (close,)):
            for kind, detect in DETECTORS.items():
                plain = list(found[kind])
                for a, b in detect(form.text):
                    start, end = form.starts[a], max(form.ends[a:b])
                    if (any(form.changed[a:b]) or end - start > b - a) and not any(s <= start and end <= e for s, e, _ in plain):
                        found[kind].append((start, end, False))
    return [Span(kind, *s) for kind in KINDS for s in sorted(found[kind])]


_DIGIT = re.compile(r"[0-9]")

SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find(df: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns and the text's ``spans``."""
    rows = df.select(*[df[c] for c in keep], df[text].cast("string").alias("_text"))

    def run(batches):
        for batch in slices(batches):
            found = [[s._asdict() for s in spans(t)] for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(found, _ARROW)], [*keep, "spans"])

    return rows.mapInArrow(run, with_fields(df.select(*[df[c] for c in keep]).schema, f"spans {SPANS}"))


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans by the first one's."""
    found = sorted((s.start, s.end, s.kind) for s in spans(text))
    if not found:
        return text
    out, at = [], 0
    for start, end, kind in found:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the personal data in ``text`` masked; all other columns as they are."""
    names = df.columns
    place = names.index(text)
    rows = df.withColumn(text, F.col(f"`{text}`").cast("string"))

    def run(batches):
        for batch in slices(batches):
            column = pa.array([masked(t) for t in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([column if i == place else c for i, c in enumerate(batch.columns)], names)

    return rows.mapInArrow(run, rows.schema)


def joined(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined in their order."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
