"""Excerpts and parts of long texts: the functions that need sequential string work, as Arrow functions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arabic import INDEX_BECOME, INDEX_DROP, INDEX_LETTERS, exact_pattern

_MARKS = f"[{INDEX_DROP}]*"


@lru_cache(maxsize=256)
def _folded_pattern(terms: tuple[str, ...]) -> re.Pattern:
    """Finds folded terms in raw text: every letter stands for all that fold to it, marks may follow."""
    kin = {b: "".join(a for a, x in zip(INDEX_LETTERS, INDEX_BECOME) if x == b) for b in INDEX_BECOME}
    one = lambda t: "".join(f"[{re.escape(c)}{kin.get(c, '')}]{_MARKS}" for c in t)
    return re.compile("|".join(one(t) for t in sorted(terms, key=len, reverse=True)))


def _back(text: str, at: int, count: int) -> int:
    """Place of the count-th character before `at` that is not a dropped mark."""
    while count and at:
        at -= 1
        count -= text[at] not in INDEX_DROP
    return at


def _ahead(text: str, at: int, count: int) -> int:
    """Place after the count-th character from `at` that is not a dropped mark, its marks included."""
    while at < len(text) and (count or text[at] in INDEX_DROP):
        count -= text[at] not in INDEX_DROP
        at += 1
    return at


_TAG = re.compile("<[^<>]*(?:>|$)|^[^<>]*>")


def snippet(text: str | None, terms: list[str], around: int = 80) -> str:
    """The surroundings of the first match, all matches marked; empty without a match."""
    terms = tuple(t for t in terms or () if t)
    if not text or not terms:
        return ""
    find = _folded_pattern(terms)
    m = find.search(text)
    if not m:
        return ""
    a, b = _back(text, m.start(), around), _ahead(text, m.end(), around)
    cut = re.sub(r"\s+", " ", _TAG.sub("", text[a:b])).strip()
    if not cut:
        return ""
    spans: list[list[int]] = []
    for x in find.finditer(cut):
        if spans and x.start() <= spans[-1][1]:
            spans[-1][1] = x.end()
        else:
            spans.append([x.start(), x.end()])
    out, at = [], 0
    for s, e in spans:
        out += [cut[at:s], "<mark>", cut[s:e], "</mark>"]
        at = e
    return (("…" if a else "") + "".join(out) + cut[at:] + ("…" if b < len(text) else "")).strip()


@lru_cache(maxsize=256)
def _exact(needle: str, diacritics: bool, hamza: bool, digits: bool) -> re.Pattern:
    return re.compile(exact_pattern(needle, diacritics, hamza, digits))


def exact_snippet(text: str | None, needle: str, diacritics: bool = False, hamza: bool = False, digits: bool = False, around: int = 90) -> str:
    """The raw text around the first match at the chosen exactness; the head of the text without one."""
    clean = re.sub(r"\s+", " ", re.sub("<[^>]*>", " ", text or "")).strip()
    m = _exact(needle, diacritics, hamza, digits).search(clean) if needle else None
    if not m:
        return clean if len(clean) <= 2 * around else clean[: 2 * around].strip() + " …"
    a, b = max(0, m.start() - around), min(len(clean), m.end() + around)
    return ("… " if a else "") + clean[a:b].strip() + (" …" if b < len(clean) else "")


def split_parts(text: str, budget: int) -> list[str]:
    """Parts of at most `budget` characters (a cut may stand right behind that), cut at the last paragraph, line or blank of their second half, else hard.

    The breaks of all three kinds are found once, in one pass; each part then looks its cut up among them.
    """
    if budget <= 0 or len(text) <= budget:
        return [text]
    kinds = [[m.start() for m in re.finditer(f"(?={mark})", text)] for mark in ("\n\n", "\n", " ")]
    solid = [m.start() for m in re.finditer(r"(?<!\S)\S|\Z", text)]  # where a part may begin after blanks
    cuts, start = [], 0
    while len(text) - start > budget:
        low, high = start + budget // 2, start + budget
        last = [k[i - 1] for k in kinds if (i := bisect_right(k, high)) and k[i - 1] >= low]
        end = last[0] if last else high
        cuts.append((start, end))
        start = solid[bisect_left(solid, end)] if text[end].isspace() else end
    parts = [p for a, b in cuts if (p := text[a:b].strip())]
    return parts + [text[start:]] if start < len(text) else parts or [text]


def snippet_column(text: Column, terms: list[str]) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: snippet(t if isinstance(t, str) else None, terms)), "string")(text)


def exact_snippet_column(text: Column, needle: str, **flags: bool) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: exact_snippet(t if isinstance(t, str) else None, needle, **flags)), "string")(text)


def parts_column(text: Column, budget: int) -> Column:
    return F.pandas_udf(lambda s: s.map(lambda t: split_parts(t, budget) if isinstance(t, str) else None), "array<string>")(text)
