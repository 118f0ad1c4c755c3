"""Visually identical text with different characters: one skeleton per look.

Confusables skeleton: decompose, replace every character by the prototype of its look-alike class,
decompose again; originals with equal skeletons look the same.

What is folded: invisible characters (dropped), kinds of blank (one blank; those at the ends dropped),
width and joined forms, composed and decomposed marks and their order, letters and digits of the same
shape in another script or alphabet. What can be seen stays: vowel marks, hamza, letter endings, the
stretching stroke, accents, case, punctuation, mark-up, line breaks, the number of blanks.

Defined results: null gives null; empty, blank and invisible-only texts give the empty skeleton; texts of
any length are folded whole. In grouping, null and empty texts are no cases, repeated rows of a record are
one record, and a record stored in two forms makes no pair with itself.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialize

#: Look-alikes of Latin letters in Greek, Cyrillic, Armenian, Cherokee, Lisu and Coptic, prototype to look-alikes.
LATIN_LOOK_ALIKES = {
    "A": "ΑАᎪꓮ", "B": "ΒВᏴꓐ", "C": "СϹᏟꓚⲤ", "D": "Ꭰꓓ", "E": "ΕЕᎬꓰ", "F": "ꓝ", "G": "ԌᏀꓖ", "H": "ΗНᎻꓧⲎ", "I": "ΙІӀꓲⲒ", "J": "ЈͿᎫꓙ", "K": "ΚКᏦꓗⲔ", "L": "Ꮮꓡ", "M": "ΜМϺᎷꓟⲘ",
    "N": "ΝꓠⲚ", "O": "ΟОՕꓳⲞ", "P": "ΡРᏢꓑⲢ", "Q": "Ԛ", "R": "Ꮢꓣ", "S": "ЅՏᏚꓢ", "T": "ΤТᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙꓦ", "W": "ԜᏔꓪ", "X": "ΧХꓫⲬ", "Y": "ΥҮꓬⲨ", "Z": "ΖᏃꓜ",
    "a": "а", "c": "сϲⲥ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һհ", "i": "і", "j": "јϳ", "n": "ո", "o": "οоօⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕ", "u": "ս", "v": "νѵ", "w": "ԝ", "x": "х", "y": "уү",
}
#: Look-alikes of Greek letters in Cyrillic and Coptic.
GREEK_LOOK_ALIKES = {"Γ": "ГⲄ", "Π": "ПⲠ", "Φ": "ФⲪ", "Ψ": "ѰⲮ", "ψ": "ѱ"}
#: Latin letters whose small capital (of the phonetic alphabet) has the shape of the small letter.
SMALL_CAPITALS = "COSUVWXZ"
#: Arabic-script letters of one shape, prototype to look-alikes. The Farsi yeh follows its place in the word, see below.
ARABIC_LOOK_ALIKES = {"ك": "ک", "ه": "ہەھ"}
#: The extended Arabic digits that have the shape of the Arabic ones (4, 5 and 6 differ).
DIGIT_LOOK_ALIKES = {"٠": "۰", "١": "۱", "٢": "۲", "٣": "۳", "٧": "۷", "٨": "۸", "٩": "۹"}
#: Digits of one shape in Devanagari and Gujarati, and in Telugu and Kannada.
INDIC_LOOK_ALIKES = {"२": "૨", "३": "૩", "४": "૪", "८": "૮", "౧": "೧", "౨": "೨", "౯": "೯"}

_FORMS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>", "<noBreak>")
#: Format characters that leave a visible sign.
_VISIBLE_FORMAT = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD}
_INVISIBLE_OTHERS = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def _decomposed(c: str) -> str:
    """Canonical decomposition and those compatibility ones that keep the look."""
    rule = unicodedata.decomposition(c)
    if not rule:
        return c
    parts = rule.split()
    if parts[0].startswith("<"):
        word_sign = 0xFDF0 <= ord(c) <= 0xFDFD
        if not (parts[0] in _FORMS and not word_sign or parts[0] == "<compat>" and unicodedata.category(c)[0] == "L"):
            return c
        parts = parts[1:]
    return "".join(_decomposed(chr(int(p, 16))) for p in parts)


def _alphabet(c: str) -> str:
    return unicodedata.name(c, "").split(" ")[0].removeprefix("EXTENDED").removesuffix("-INDIC")


def look_alikes(path: str) -> dict[str, str]:
    """Look-alike to prototype, from a file in the format of the public confusables list (source ; target ; type # note).

    Kept are single letters and digits, beyond ASCII, whose prototype is a letter or digit of another script:
    what merely resembles within a script can be seen, and so do signs of punctuation.
    """
    out: dict[str, str] = {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            parts = [p.split() for p in line.split("#")[0].split(";")[:2]]
            if len(parts) == 2 and len(parts[0]) == len(parts[1]) == 1:
                source, target = (chr(int(p[0], 16)) for p in parts)
                kinds = {unicodedata.category(c)[0] + unicodedata.category(c)[1] * (unicodedata.category(c)[0] == "N") for c in (source, target)}
                if not source.isascii() and kinds in ({"L"}, {"Nd"}, {"L", "Nd"}) and _alphabet(source) != _alphabet(target):
                    out[source] = target
    return out


@lru_cache(maxsize=4)
def _table(confusables: str | None = None) -> tuple[dict[str, str], re.Pattern]:
    """Replacement of every character that has one after canonical decomposition, and a pattern that finds them."""
    proto = look_alikes(confusables) if confusables else {}
    proto |= {x: p for t in (LATIN_LOOK_ALIKES, GREEK_LOOK_ALIKES, ARABIC_LOOK_ALIKES, DIGIT_LOOK_ALIKES, INDIC_LOOK_ALIKES) for p, xs in t.items() for x in xs}
    for c in SMALL_CAPITALS:
        try:
            proto[unicodedata.lookup(f"LATIN LETTER SMALL CAPITAL {c}")] = c.lower()
        except KeyError:  # not every letter has one
            continue
    # a prototype may have a prototype in the other table
    proto = {x: proto.get(p, p) for x, p in proto.items()}
    out: dict[str, str] = {}
    for n in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= n < 0xD7A4 or 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        kind = unicodedata.category(c)
        if kind == "Cn":
            continue
        if kind == "Cf" and n not in _VISIBLE_FORMAT or n in _INVISIBLE_OTHERS:
            out[c] = ""
        elif kind == "Zs":
            out[c] = " "
        else:
            d = "".join(proto.get(x, x) for x in _decomposed(c))
            if d != unicodedata.normalize("NFD", c):
                out[c] = d
    out["\t"] = " "
    # ranges keep the pattern short
    runs: list[list[int]] = []
    for n in sorted(map(ord, out)):
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return out, re.compile("[" + "".join(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else "") for a, b in runs) + "]")


#: Text of these alone, decomposed, is its own skeleton but for blanks at the ends: most text, found fast.
_PLAIN = re.compile("[ -~\\r\\n\\u0600-\\u061b\\u061d-\\u0655\\u0660-\\u0669]*")
_YEH = re.compile("ی(?=([ً-ٰٟۖ-ۭ]*[ء-يٱ-ە])?)")


def skeleton(text: str | None, confusables: str | None = None) -> str | None:
    """The form under which texts that look the same are equal. confusables: a file for look_alikes(), beside the built-in table."""
    if text is None:
        return None
    if text.isascii():
        return text.replace("\t", " ").strip(" ") if "\t" in text else text.strip(" ")
    out = unicodedata.normalize("NFD", text)
    if not confusables and _PLAIN.fullmatch(out):
        return out.strip(" ")
    table, special = _table(confusables)
    if special.search(out):
        out = unicodedata.normalize("NFD", special.sub(lambda m: table[m.group()], out))
    if "ی" in out:
        # joined to a following letter the Farsi yeh has the dots of the Arabic one; at a word's end it has none
        out = _YEH.sub(lambda m: "ي" if m.group(1) else "ى", out)
    return out.strip(" ")


def _digests(batches: Iterator[pa.RecordBatch], confusables: str | None) -> Iterator[pa.RecordBatch]:
    """Replaces the text by digests of its skeleton and of itself; the text itself is not shuffled."""
    for b in batches:
        texts = b.column(b.num_columns - 1).to_pylist()
        skel = [blake2b(skeleton(t, confusables).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts]
        own = [blake2b(t.encode("utf-8", "surrogatepass"), digest_size=8).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(skel, pa.binary()), pa.array(own, pa.binary())], [*b.schema.names[:-1], "skel", "own"])


def digests(df: DataFrame, scope: list[str], record: str, text: str, confusables: str | None = None) -> DataFrame:
    """scope columns, record, skel, own: one row per distinct record and stored form, without null and empty texts.

    Written once, since the groups, their forms and their members are read from it in turn.
    """
    rows = df.select(*scope, record, F.col(text).alias("text__")).where("text__ <> ''")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return materialize(rows.mapInArrow(lambda it: _digests(it, confusables), f"{fields}, skel binary, own binary").distinct(), "digests")


def lookalike_groups(found: DataFrame, scope: list[str]) -> DataFrame:
    """Skeletons of a scope that are stored in two forms or more, with their numbers of records and forms."""
    per_form = found.groupBy(*scope, "skel", "own").agg(F.count("*").alias("n"))
    return per_form.groupBy(*scope, "skel").agg(F.sum("n").alias("n_records"), F.count("*").alias("n_forms")).where("n_forms > 1")


def lookalike_pairs(found: DataFrame, scope: list[str], record: str) -> DataFrame:
    """Pairs of records of one scope that look the same but are stored in different forms: id_a < id_b.

    Only forms are paired with forms; the records of two forms meet when the pair is known to be a case, so
    a text that a third of all rows hold in one form costs nothing.
    """
    mixed = found.groupBy(*scope, "skel").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo <> hi").select(*scope, "skel")
    members = found.join(mixed, [*scope, "skel"], "left_semi")
    forms = members.select(*scope, "skel", "own").distinct()
    other = forms.withColumnRenamed("own", "own_b")
    pairs = forms.withColumnRenamed("own", "own_a").join(other, [*scope, "skel"]).where("own_a < own_b")
    a = members.select(*scope, "skel", F.col("own").alias("own_a"), F.col(record).alias("ra"))
    b = members.select(*scope, "skel", F.col("own").alias("own_b"), F.col(record).alias("rb"))
    both = pairs.join(a, [*scope, "skel", "own_a"]).join(b, [*scope, "skel", "own_b"]).where("ra <> rb")
    return both.select(*scope, F.least("ra", "rb").alias("id_a"), F.greatest("ra", "rb").alias("id_b")).distinct()


def canonical(text: Column, confusables: str | None = None) -> Column:
    """Column form of skeleton()."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: skeleton(t, confusables) if isinstance(t, str) else None), "string")(text)
