"""Personal data, also where it is disguised, with spans in the source text.

Identifiers are found twice: in the text as it stands (the base spans) and in a
normalised copy. The copy is written by transducers that replace a span of the
source by another string: look-alike letters and digits of other scripts by
ASCII, invisible characters by nothing, spelled digits by digits, and the
disguises of ``@`` and ``.`` by the signs. Each replacement keeps the source
span that it stands for, so a span found in the copy maps back to the source
characters that produced it. Base spans always stay; a span of the copy is
added where a replacement took part in it and no base span of its kind
overlaps.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.llm.common import small_batches, table, text_bytes, windows

KINDS = ("email", "ip", "card", "phone")

# -- base detectors ---------------------------------------------------------------------------------------------
# Each pattern starts where no match can have begun one character earlier, or at a rare sign, so that scanning
# stays linear in the text whatever it holds.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[^0-9]")


class Span(NamedTuple):
    kind: str
    start: int
    end: int


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"


def _run_start(text: str, at: int, floor: int, chars: str) -> int:
    """Start of the run of ``chars`` that ends before ``at``, in time proportional to the run."""
    start, step = at, 32
    while start > floor:
        low = max(floor, start - step)
        tail = text[low:start]
        own = len(tail) - len(tail.rstrip(chars))
        start -= own
        if own < len(tail):
            break
        step *= 2
    return start


def emails(text: str) -> Iterator[Span]:
    floor = at = 0
    while (at := text.find("@", at)) >= 0:
        start = _run_start(text, at, floor, _LOCAL)
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield Span("email", start, m.end())
            floor = at = m.end()
        else:
            at += 1
            floor = at  # no later match can reach across this sign


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Base spans: leftmost and non-overlapping within each kind."""
    found = list(emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(Span("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append(Span("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(_DIGIT.sub("", m[0])) <= 15:
            found.append(Span("phone", *m.span()))
    return found


# -- transducers ------------------------------------------------------------------------------------------------
#: Letters of Cyrillic and Greek that look like Latin ones.
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТХУаеѕіјорсухԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονικρυ",
        "ABESIJKMHOPCTXYaesijopcyxdqwhABEZHIKMNOPTYXovikpu",
        strict=True,
    )
)
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Names of the digits in the languages at hand.
_SPELLED = {
    **dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True)),
    **dict(zip("null eins zwei drei vier fünf sechs sieben acht neun".split(), "0123456789", strict=True)),
    **dict(zip("zéro un deux trois quatre cinq six sept huit neuf".split(), "0123456789", strict=True)),
    **dict(zip("cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "0123456789", strict=True)),
    "oh": "0",
}
_TIMES = {"double": 2, "triple": 3}
_FOREIGN = re.compile("[\u00ad\u0370-\u052f\u0660-\u0669\u06f0-\u06f9\u0966-\u096f\u200b-\u200d\u2060\ufeff\uff01-\uff5e]")
_NAMES = "|".join(sorted(_SPELLED, key=len, reverse=True))
_ONE = rf"(?:(?:double|triple)[ \t-]{{1,3}})?(?:{_NAMES})"
_SPOKEN = re.compile(
    rf"(?<!\w)(?:plus[ \t-]{{1,3}})?(?:(?:{_ONE}|[0-9]+)[ \t.,-]{{1,3}}){{2,}}(?:{_ONE}|[0-9]+)(?!\w)", re.IGNORECASE
)
_SPOKEN_WORD = re.compile(rf"(?<!\w)(?:plus[ \t-]{{1,3}}(?=\w)|{_ONE}(?!\w))", re.IGNORECASE)
_SPOKEN_HINT = re.compile(rf"(?<!\w)(?:{_NAMES})[ \t.,-]{{1,3}}(?:{_NAMES}|[0-9]+)(?!\w)")
_AT = r"(?:at|arroba|arobase)"
_DOT = r"(?:dot|punkt|punto|point)"
_BRACKETED = re.compile(rf"[\[({{<][ \t]*+(?:(?P<at>@|{_AT})|(?P<dot>\.|{_DOT}))[ \t]*+[\])}}>][ \t]*+", re.IGNORECASE)
#: An ``at``, and what has to stand behind one: a domain with a spelled dot.
_ANCHOR = re.compile(rf"[ \t]{_AT}(?=[ \t])|@", re.IGNORECASE)
_DOMAIN_SPELLED = re.compile(rf"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:[ \t]++{_DOT}[ \t]++[A-Za-z0-9-]++)+", re.IGNORECASE)
_GAP = re.compile(r"[ \t]*+")
_DOT_END = re.compile(rf"{_DOT}\Z", re.IGNORECASE)
_QUAD = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:[ \t]++{_DOT}[ \t]++[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_PLAIN_HINT = re.compile(r"[ \t](?:[dD][oO][tT]|[pP][uU][nN][kK][tT]|[pP][uU][nN][tT][oO]|[pP][oO][iI][nN][tT])[ \t]")
_SIGN = re.compile(rf"[ \t]++(?:(?P<at>{_AT})|(?P<dot>{_DOT}))[ \t]++", re.IGNORECASE)
#: Words that announce an address; behind one, a spelled at before a dotted domain is enough.
_LEADS = ("mail", "contact", "kontakt", "correo", "courriel", "contacto")
_LED = re.compile(
    rf"(?<!\w)(?:(?:e-?)?mail|contact|kontakt|correo|courriel|contacto)(?:[ \t]{{1,3}}(?:me|us|to|an|a|à))?:?[ \t]{{1,3}}"
    rf"[A-Za-z0-9._%+-]++(?P<at>[ \t]++{_AT}[ \t]++)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:(?<=\.[A-Za-z]{{2}})|(?<=\.[A-Za-z]{{3}})|(?<=\.[A-Za-z]{{4}}))(?!/)",
    re.IGNORECASE,
)
#: Signs with a space on either side.
_SPACED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?: @ |@)[A-Za-z0-9-]++(?:(?: \. |\.)[A-Za-z0-9-]++)+")
_SPACED_HINT = re.compile(r"[A-Za-z0-9_%+-] @ [A-Za-z0-9]|@[A-Za-z0-9.-]+ \. [A-Za-z0-9]")
#: Letters that stand for digits, in tokens of digits.
_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1"}
_MIXED = re.compile(r"[0-9][.()-]?[OoIl]|[OoIl][.()-]?[0-9]")
_DIGIT_LETTER, _LETTER_DIGIT = re.compile(r"[0-9][.()-]?[OoIl]"), re.compile(r"[OoIl][.()-]?[0-9]")
_MIXED_SIGNS = "0123456789OoIl.()+-"
_MIXED_REST = re.compile(r"[0-9OoIl.()+-]*+")


class Copy:
    """A normalised text and, for each replacement, where it stands in both texts."""

    def __init__(self, source: str) -> None:
        self.text = source
        self.starts: list[int] = []  # in the copy
        self.pieces: list[tuple[int, int, int, int]] = []  # copy start, copy end, source start, source end

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply non-overlapping, ordered edits of the copy; edits widen over earlier replacements they touch."""
        if not edits:
            return
        out, pieces, at, shift, old = [], [], 0, 0, iter([*self.pieces, (1 << 62, 1 << 62, 0, 0)])
        piece = next(old)
        for start, end, new in edits:
            first, last = self.back(start, end)
            while piece[1] <= start:
                pieces.append((piece[0] + shift, piece[1] + shift, *piece[2:]))
                piece = next(old)
            while piece[0] < end:
                piece = next(old)
            out += [self.text[at:start], new]
            pieces.append((start + shift, start + shift + len(new), first, last))
            shift += len(new) - (end - start)
            at = end
        while piece[0] < 1 << 62:
            pieces.append((piece[0] + shift, piece[1] + shift, *piece[2:]))
            piece = next(old)
        out.append(self.text[at:])
        self.text, self.pieces = "".join(out), pieces
        self.starts = [p[0] for p in pieces]

    def _source(self, at: int, is_end: bool) -> int:
        """Source position of a boundary; inside a replacement, its outer side."""
        i = bisect_right(self.starts, at - is_end) - 1
        if i < 0:
            return at
        start, end, first, last = self.pieces[i]
        if at < end or at == end and is_end and start < end:
            return last if is_end else first
        return last + at - end

    def back(self, start: int, end: int) -> tuple[int, int]:
        return self._source(start, False), self._source(end, True)

    def touched(self, start: int, end: int) -> bool:
        """Whether a replacement took part in this span of the copy."""
        i = bisect_right(self.starts, end - 1) - 1
        while i >= 0 and self.pieces[i][0] >= start:
            if self.pieces[i][1] <= end:
                return True
            i -= 1
        return i >= 0 and self.pieces[i][1] > start


def _ascii(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKES:
        return _LOOKALIKES[c]
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isascii():
        return folded
    return str(unicodedata.digit(c)) if c.isdigit() else c


def _spoken(words: str) -> str:
    """Digits of a spelled digit, also a doubled one; a sign otherwise."""
    first, *rest = re.split("[ \t-]+", words.lower().strip(" \t-"))
    if rest:
        return _SPELLED[rest[0]] * _TIMES[first]
    return _SPELLED.get(first, "+")


def _bracketed(text: str) -> Iterator[tuple[int, int, str]]:
    """Signs in brackets, with the blanks around them."""
    done = 0
    for m in _BRACKETED.finditer(text):
        yield _run_start(text, m.start(), done, " \t"), m.end(), "@" if m["at"] else "."
        done = m.end()


def _spelled_dot(text: str, start: int, floor: int) -> int | None:
    """Where the blanks before a spelled dot begin, if one stands before ``start``."""
    gap = _run_start(text, start, floor, " \t")
    if gap == start or not (m := _DOT_END.search(text[max(floor, gap - 5) : gap])):
        return None
    word = gap - len(m[0])
    before = _run_start(text, word, floor, " \t")
    return before if before < word else None


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with spelled dots, leftmost first.

    Each begins at an ``at`` with a domain behind it and is followed back over
    the words and spelled dots before it, so no stretch is walked twice however
    long its words are.
    """
    done = 0
    for sign in _ANCHOR.finditer(text):
        if sign.start() < done:
            continue
        begins = sign.end() if sign[0] == "@" else _GAP.match(text, sign.end()).end()  # type: ignore[union-attr]
        domain = _DOMAIN_SPELLED.match(text, begins)
        if domain is None:
            continue
        end = sign.start() if sign[0] == "@" else _run_start(text, sign.start() + 1, done, " \t")
        start = _run_start(text, end, done, _LOCAL)
        if start == end:
            continue
        while "." not in text[start:end] and (dot := _spelled_dot(text, start, done)) is not None:
            first = _run_start(text, dot, done, _LOCAL)
            if first == dot:
                break
            start, end = first, dot
        yield start, domain.end()
        done = domain.end()


def _mixed(text: str) -> Iterator[tuple[int, int, str]]:
    """Letters that stand for digits, in tokens that join the two."""
    done = 0
    for m in _MIXED.finditer(text):
        if m.start() < done:
            continue
        start, end = _run_start(text, m.start(), done, _MIXED_SIGNS), _MIXED_REST.match(text, m.end()).end()  # type: ignore[union-attr]
        if start and text[start - 1].isascii() and text[start - 1].isalnum():  # the token begins behind the first sign
            start = next((i + 1 for i in range(start, end) if text[i] in ".()+-"), end)
        done = end
        if start < end and not (end < len(text) and text[end].isascii() and text[end].isalnum()) and _MIXED.search(text, start, end):
            yield from ((i, i + 1, _LETTERS[text[i]]) for i in range(start, end) if text[i] in _LETTERS)


def normalise(text: str) -> Copy | None:
    """The normalised copy, or None where no transducer finds anything to replace."""
    copy = Copy(text)
    if not text.isascii() and _FOREIGN.search(text):
        changes = ((m.start(), m.end(), _ascii(m[0])) for m in _FOREIGN.finditer(text))
        copy.rewrite([x for x in changes if x[2] != text[x[0] : x[1]]])
    if _BRACKETED.search(copy.text):
        copy.rewrite(list(_bracketed(copy.text)))
    if _PLAIN_HINT.search(copy.text):
        edits, done = [], 0
        for start, end in sorted([*_spelled(copy.text), *(m.span() for m in _QUAD.finditer(copy.text))]):
            if start >= done:
                edits += [(*m.span(), "@" if m["at"] else ".") for m in _SIGN.finditer(copy.text, start, end)]
                done = end
        copy.rewrite(edits)
    if any(w in copy.text.lower() for w in _LEADS):
        copy.rewrite([(*m.span("at"), "@") for m in _LED.finditer(copy.text)])
    if "@" in copy.text and _SPACED_HINT.search(copy.text):
        spaced = ((m.start() + s.start(), m.start() + s.end(), s[0].strip()) for m in _SPACED.finditer(copy.text) for s in re.finditer(r" [@.] ", m[0]))
        copy.rewrite(list(spaced))
    if _DIGIT_LETTER.search(copy.text) or _LETTER_DIGIT.search(copy.text):
        copy.rewrite(list(_mixed(copy.text)))
    if _SPOKEN_HINT.search(copy.text.lower()):
        words = (w for run in _SPOKEN.finditer(copy.text) for w in _SPOKEN_WORD.finditer(copy.text, *run.span()))
        copy.rewrite([(*w.span(), _spoken(w[0])) for w in words])
    return copy if copy.pieces else None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each by kind as listed and then by start."""
    base = detect(text)
    copy, added = normalise(text), []
    if copy is not None:
        for kind in KINDS:
            own = sorted((s.start, s.end) for s in base if s.kind == kind)
            starts = [s for s, _ in own]
            for span in (s for s in detect(copy.text) if s.kind == kind and copy.touched(s.start, s.end)):
                start, end = copy.back(span.start, span.end)
                i = bisect_right(starts, end - 1) - 1
                if start < end and (i < 0 or own[i][1] <= start):
                    added.append(Span(kind, start, end))
    order = lambda s: (KINDS.index(s.kind), s.start, s.end)
    return sorted(base, key=order), sorted(set(added), key=order)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): every identifier as struct<kind, start, end, text, added>.

    Offsets count code points, the end is exclusive. Null and empty texts have
    no span; rows with null or repeated ids give a row each, and an empty table
    none. Texts are searched whole, in time proportional to their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string()), ("added", pa.bool_())]))
        for batch in windows(batches, "body"):
            rows = []
            for body in batch.column(1).to_pylist():
                text = body.decode("utf-8", "replace")
                base, added = find(text)
                rows.append(
                    [
                        {"kind": s.kind, "start": s.start, "end": s.end, "text": text[s.start : s.end], "added": new}
                        for own, new in ((base, False), (added, True))
                        for s in own
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("body"))
    return rows.mapInArrow(
        run, "doc_id long, spans array<struct<kind: string, start: long, end: long, text: string, added: boolean>>"
    )


def redact(text: str) -> str:
    """The text with every identifier, disguised or not, replaced by its kind in brackets."""
    out, at = [], 0
    for s in sorted((x for part in find(text) for x in part), key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def digest(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: counts by kind and digest of the base spans, all spans, and the number added, for every document."""
    found = scan(table(spark, sf_dir, "documents"))
    order = F.transform(
        "spans",
        lambda s: F.struct(
            F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["added"].alias("added")
        ),
    )
    found = found.select("doc_id", F.array_sort(order).alias("all"))
    base = F.filter("all", lambda s: ~s["added"])
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: s["added"])).cast("long").alias("n_added"),
    )
