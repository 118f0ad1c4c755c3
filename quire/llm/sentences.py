"""Sentence boundaries across languages and scripts.

Semi-Markov dynamic programming: a text is cut at blank lines into blocks; every end mark of a block, with what
closes on it, is a possible boundary, also behind abbreviations, in decimals, quotations and brackets (and, between
Thai letters, every blank). A span runs from any boundary to any later one, and its score joins

* its closing word with the word that opens the next span: a table of evidence by their kinds (EVIDENCE),
* the quotations and brackets that are torn at its two ends (TORN for each),
* an item number: a span of nothing else (BARE_NUMBER),
* its length (LENGTH_WEIGHT).

The best-scored sequence of spans wins, so a mark is a boundary only if the whole is better for it. No span is too
long or too far back: a start is left out only once a later one is ahead by more than any length can make up.

Defined results: null, empty and blank texts have no sentences; positions count code points from 0, the end
is exclusive; the sentences cover everything but blanks and line breaks; repeated rows each have theirs; a
quotation mark or bracket without its partner is an ordinary character; texts of any length are cut whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations that never end a sentence (titles, initials, "see", "born", Latin tags).
NEVER = frozenset(
    "Dr Prof St Mr Mrs Ms Jr Sr ed éd cf vgl av bzw ca z B u h J-C i.e e.g J R M A Mme Mlle "
    "م د ا أ ق ق.م ر ر.ک ک س ع ध डॉ प्रो पृ सं श्री".split()
)
#: Abbreviations that do not end a sentence before a number.
BEFORE_NUMBER = frozenset("no vol d pp p fol chap t Bd Nr S v Abb Kap fig art ص ج ط ت ف ख ०".split())
#: Abbreviations that end a sentence exactly if a capital opens the next.
BEFORE_CAPITAL = frozenset("etc U.S a.m p.m Inc Ltd Co usw".split())
#: Abbreviations of two parts, second part and first.
SECOND_OF_TWO = {"a": "u", "B": "z", "h": "d", "C": "J", "ex": "p", "هـ": "ا"}
#: Frequent German words, by which ordinals (a number and a period) are told from a number that ends a sentence.
GERMAN = frozenset("der die das und ist nicht den dem des ein eine von mit im zu sich auf als auch".split())

#: Evidence for a boundary by kind of the closing word and kind of what opens after it.
EVIDENCE = {
    "end mark": {"lower": 4.0, "upper": 4.0, "letter": 4.0, "digit": 4.0, "other": 4.0},
    "word": {"lower": -4.0, "upper": 4.0, "letter": 4.0, "digit": 4.0, "other": 4.0},
    "number": {"lower": -4.0, "upper": 2.0, "letter": 2.0, "digit": 2.0, "other": 2.0},
    "before number": {"lower": -4.0, "upper": 1.5, "letter": 1.5, "digit": -4.0, "other": 1.5},
    "before capital": {"lower": -4.0, "upper": 4.0, "letter": -4.0, "digit": -4.0, "other": 4.0},
    "no end": {"lower": -8.0, "upper": -8.0, "letter": -8.0, "digit": -8.0, "other": -8.0},
}
#: For each quotation or bracket that a span's start or end stands in.
TORN = -4.0
#: For a span that is an item number alone.
BARE_NUMBER = -8.0
#: For each factor of e by which a span is shorter or longer than USUAL, up to MOST.
LENGTH_WEIGHT, USUAL, MOST = -0.5, 80.0, 4.0

_OPEN = {"“": "”", "„": "“", "«": "»", "»": "«", "「": "」", "『": "』", '"': '"', "(": ")", "[": "]", "（": "）"}
_CLOSE = frozenset('”"»“«」』)]）’')
_QUOTES = frozenset("“„«»「『\"”」』")
_BLOCK = re.compile(r"\n[^\S\n]*\n\s*")
_MARK = re.compile(r"[.!?؟۔。！？｡।॥…]+")
_QUOTE = re.compile("[“”„«»「」『』\"()\\[\\]（）]")
_NOTE = re.compile(r"(?:\[\d{1,4}\]|\(\d{1,4}\)|[†‡¹²³⁴-⁹])+")
_TOKEN = re.compile(r"[^\s\"“”„«»「」『』()\[\]（），、：。！？؟،؛,;:!?]+")
_HAN_BEFORE = re.compile(".*[一-鿿]", re.DOTALL)
_THAI_LETTER = re.compile("[฀-๿]")
_THAI_BLANK = re.compile(r"(?<=\S)[^\S\n]+(?=\S)")
_GERMAN_WORD = re.compile(rf"\b(?:{'|'.join(sorted(GERMAN))})\b")
_WORD = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"\s|\Z")
_CJK_MARK = frozenset("。！？｡")
_QUESTION = frozenset("!?؟！？")
#: Code points on both sides of a number whose words tell its language, the nearest first, and the words that are enough to deny German.
NEAR, ENOUGH = (125, 250, 500, 1000), 40


def _thai(c: str) -> bool:
    return "฀" <= c <= "๿"


class _German:
    """Whether a number with a period is a German ordinal, by the words about it: in its block, else near it, else in the whole text."""

    def __init__(self, text: str) -> None:
        self.text, found = text, list(_GERMAN_WORD.finditer(text))
        self.places, self.words = [m.start() for m in found], [m.group() for m in found]
        self.anywhere = len(set(self.words)) >= 2

    def at(self, i: int, nxt: int, a: int, b: int) -> bool:
        """For the number before i, followed by the letter at nxt, in the block [a, b)."""
        if not self.anywhere or self.text[nxt].isalpha() and self.text[nxt] > "ɏ":  # no Latin letter
            return False
        for x, y in [(max(a, i - n), min(b, i + n)) for n in NEAR] + [(max(0, i - NEAR[-1]), i + NEAR[-1])]:
            if len(set(self.words[bisect_left(self.places, x) : bisect_left(self.places, y)])) >= 2:
                return True
            if len(_WORD.findall(self.text, x, y)) >= ENOUGH:
                return False
        return True


class _Pairs:
    """The quotations and brackets of a block that have both ends, and how many of them stand open at a place."""

    def __init__(self, text: str, a: int, b: int) -> None:
        pairs, stack = [], []
        for m in _QUOTE.finditer(text, a, b):
            c, i = m.group(), m.start()
            opens = i == a or text[i - 1].isspace() or text[i - 1] in _OPEN
            closes = i + 1 == b or text[i + 1].isspace()
            k = next((k for k in range(len(stack) - 1, -1, -1) if _OPEN[stack[k][0]] == c), -1)
            if k >= 0 and c == '"' and opens and not closes:
                k = -1  # the one before had no partner
                stack = [x for x in stack if x[0] != c]
            if k >= 0:
                pairs.append((stack[k][1], i, c in _QUOTES))
                del stack[k:]
            elif c in _OPEN and not (c == "“" and stack and stack[-1][0] == c):
                stack.append((c, i))
        self.partner = {close: start for start, close, _ in pairs}
        self.places, self.open, self.quotes, depth, quotes = [a], [0], [0], 0, 0
        for i, step, quote in sorted([(s, 1, q) for s, _, q in pairs] + [(e, -1, q) for _, e, q in pairs]):
            depth, quotes = depth + step, quotes + step * quote
            self.places.append(i + 1)
            self.open.append(depth)
            self.quotes.append(quotes)

    def at(self, i: int) -> int:
        return self.open[bisect_right(self.places, i) - 1]

    def quoted(self, i: int) -> bool:
        return self.quotes[bisect_right(self.places, i) - 1] > 0


def _opening(c: str) -> str:
    """Kind of what opens a span."""
    return "lower" if c.islower() else "upper" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "other"


def _split_abbreviation(word: str, text: str, at: int, a: int) -> bool | None:
    """Whether the word is the second part of an abbreviation of two; None if that tells nothing."""
    first = SECOND_OF_TWO.get(word)
    if first is None:
        return None
    before = text[max(a, at - 4) : at].rstrip()
    return True if before.endswith((first + ".", ".")) or word in ("B", "h", "C") else False if word == "هـ" else None


def _closing(text: str, at: int, word: str, start: int, nxt: int, blank: int, joined: bool, a: int) -> str:
    """Kind of the word (it starts at `start`) before the period at `at`; nxt: what opens after it, up to the blank at `blank`."""
    following = text[nxt]
    if _thai(text[at - 1]):
        return "no end"  # Thai ends sentences by blanks, its periods abbreviate
    if word.replace("٫", "").isdigit():
        return "no end" if joined and not following.isalpha() else "number"
    if joined:
        if not following.isalpha() or "." in word or not word:
            return "no end"
        inner = text.find(".", nxt + 1, blank)
        if following.isascii() or word[-1].isascii():
            alone = inner < 0 or not text[inner:blank].strip(".")
            return "word" if following.isupper() and alone and not (len(word) == 1 and word.isupper()) else "no end"
        if len(word) == 1 and word in NEVER or inner == nxt + 1:
            return "no end"
    two = _split_abbreviation(word, text, start, a)
    if two is not None:
        return "no end" if two else "end mark"
    tail = word.lstrip("-–")
    if tail in NEVER or len(tail) == 1 and tail.isupper():
        return "no end"
    return "before capital" if tail in BEFORE_CAPITAL else "before number" if tail in BEFORE_NUMBER else "word" if text[at] == "." else "end mark"


@dataclass
class Boundary:
    """A possible boundary: the span before ends at `end`, the next starts at `start`."""

    end: int
    start: int
    evidence: float
    #: Start of the number before the mark, for item numbers; -1 if there is none.
    number: int = -1


def _boundaries(text: str, a: int, b: int, pairs: _Pairs, german: _German) -> list[Boundary]:
    """Every possible boundary inside the block [a, b), with the evidence of its closing and opening words."""
    out, used, blank = [], a, a
    heads: list[int] | None = None
    for m in _MARK.finditer(text, a, b):
        at, mark = m.start(), m.group()
        if at < used:
            continue
        end, closed, quoted = m.end(), False, pairs.quoted(at)
        while end < b:  # what closes on the mark
            gap = end + (text[end].isspace() and end + 1 < b and text[end + 1] in "»”")
            if text[gap] in _CLOSE and (pairs.partner.get(gap, at) < at or gap == end and gap not in pairs.partner and not pairs.at(gap)):
                end, closed = gap + 1, True
                if not pairs.at(end):
                    break
            else:
                break
        note = _NOTE.match(text, end, b)
        used = end = note.end() if note else end
        if end >= b:
            break
        nxt = end
        while text[nxt].isspace():
            nxt += 1
        joined, last, number = nxt == end, mark[-1], -1
        if len(mark) > 1 and not mark.strip(".…") or "…" in mark or last in _QUESTION and quoted:
            kind = "no end"
        elif joined and last not in _CJK_MARK and (not text[nxt].isalpha() if closed or note else last not in ".۔" or text[nxt].isdigit()):
            kind = "no end"
        elif last not in ".۔" or closed or note and not quoted:
            kind = "end mark"
        else:
            if heads is None:
                heads, ends = zip(*[m.span() for m in _TOKEN.finditer(text, a, b)] or [(b, b)])
            k = bisect_left(ends, at)  # the token that reaches the mark
            start = heads[k] if k < len(heads) and heads[k] < at else at
            word = text[start:at]
            if word and word[-1].isascii() and (han := _HAN_BEFORE.match(word)):
                start += han.end()
                word = text[start:at]
            if blank <= nxt:
                blank = _BLANK.search(text, nxt, b).start()
            kind = _closing(text, at, word, start, nxt, blank, joined, a)
            if kind == "number":
                number = start
        evidence = EVIDENCE[kind][_opening(text[nxt])]
        if kind == "number" and evidence > 0 and german.at(at, nxt, a, b):
            evidence = EVIDENCE["no end"]["other"]  # an ordinal stands before its noun
        out.append(Boundary(end, nxt, evidence, number))
    if _THAI_LETTER.search(text, a, b):
        marked = {x.end for x in out}
        for m in _THAI_BLANK.finditer(text, a, b):
            i, j = m.span()
            x, y = text[i - 1], text[j]
            if i not in marked and (_thai(x) or _thai(y)):
                ends = not (x.isdigit() or y.isdigit()) and (_thai(x) or x in _CLOSE or x.isalpha())
                short = _thai(y) and 0 <= text.find(".", j, _BLANK.search(text, j, b).start() - 1)  # an abbreviation opens
                out.append(Boundary(i, j, EVIDENCE["word" if ends and not short else "no end"]["letter"]))
        out.sort(key=lambda x: x.end)
    return out


def _length(n: int) -> float:
    return LENGTH_WEIGHT * min(MOST, abs(math.log(n / USUAL)))


def _block(text: str, a: int, b: int, german: _German) -> list[tuple[int, int]]:
    """The best-scored sequence of spans of the block, which has no blanks at its ends."""
    pairs = _Pairs(text, a, b)
    cut = _boundaries(text, a, b, pairs, german)
    if not cut:
        return [(a, b)]
    cut.append(Boundary(b, b, 0.0))
    starts = [a, *[x.start for x in cut]]
    # best[i]: of all sequences up to start i, what tears at i included; a start is kept while a length can still bring it forward
    best, back, alive, top = [0.0], [0], [0], 0.0
    for j, x in enumerate(cut, 1):
        fixed = x.evidence + TORN * pairs.at(x.end)
        most, at = -math.inf, 0
        for i in alive:
            v = best[i] + fixed + _length(x.end - starts[i]) + (BARE_NUMBER if x.number == starts[i] else 0.0)
            if v > most:
                most, at = v, i
        best.append(most + TORN * pairs.at(x.start))
        back.append(at)
        # a start may lose to a later one only when that one's bare number is behind it
        reach = -LENGTH_WEIGHT * MOST + (0.0 if j == len(cut) or cut[j].number != x.start else -BARE_NUMBER)
        if best[j] > top + LENGTH_WEIGHT * MOST:
            alive = [i for i in alive if best[i] > best[j] - reach] + [j]
            top = max(top, best[j]) if reach <= -LENGTH_WEIGHT * MOST else top
    out, j = [], len(cut)
    while j:
        out.append((starts[back[j]], cut[j - 1].end))
        j = back[j]
    return out[::-1]


def marks_alone(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """What the evidence at each mark gives without the spans: for comparison with the joint solution."""
    cut = [x for x in _boundaries(text, a, b, _Pairs(text, a, b), _German(text)) if x.evidence > 0]
    return list(zip([a, *[x.start for x in cut]], [*[x.end for x in cut], b]))


def sentences(text: str | None) -> list[tuple[int, int]]:
    """Start and end of every sentence."""
    if not text or text.isspace():
        return []
    german = _German(text)
    out, a = [], 0
    for m in [*_BLOCK.finditer(text), None]:
        b = m.start() if m else len(text)
        s, e = a, b
        while s < e and text[s].isspace():
            s += 1
        while e > s and text[e - 1].isspace():
            e -= 1
        if s < e:
            out += _block(text, s, e, german)
        if m:
            a = m.end()
    return out


def split_sentences(df: DataFrame, key: str, text: str, units: bool = False) -> DataFrame:
    """key, start_pos, end_pos: one row per sentence; with units also number (from 1) and sentence.

    No shuffle: every text is cut where it lies.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    kind = rows.schema["key"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end, number, unit = [], [], [], [], []
            for r, t in enumerate(b.column(1).to_pylist()):
                for n, (s, e) in enumerate(sentences(t), 1):
                    row.append(r)
                    start.append(s)
                    end.append(e)
                    if units:
                        number.append(n)
                        unit.append(t[s:e])
            arrays = [b.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
            more = [pa.array(number, pa.int32()), pa.array(unit, pa.string())] if units else []
            yield pa.RecordBatch.from_arrays(arrays + more, ["key", "start_pos", "end_pos", "number", "sentence"][: 3 + len(more)])

    return rows.mapInArrow(cut, f"key {kind}, start_pos int, end_pos int" + ", number int, sentence string" * units).withColumnRenamed("key", key)
