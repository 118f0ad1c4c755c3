"""Several values packed in one field: one row per value, with its position.

Dictionary-guided segmentation. Known whole values are those that the data itself delimits beyond doubt
(entries in quotation marks that hold a separator) and those of an optional dictionary table, of any number
of pieces. Per Arrow batch a multi-pattern automaton over the known values marks every place in the raw
fields where one stands; quoted entries, links, known values and single pieces are then the segments from
which dynamic programming makes the cover of the field with the least cost, so a separator inside a known
value or a link is protected exactly if that cover is the better one.

The dictionary may grow with the data, so it is neither broadcast nor collected: a known value is brought to
the fields that hold its first two units next to each other (a hash join on their text), and the automaton of
a batch holds only those.

Defined results: a null field gives no rows; an empty or blank field, or one of separators only, gives no
rows; blank entries are dropped and not counted; equal entries are all kept; an opening quotation mark
without its closing mark is an ordinary character; a closing mark counts only before a separator or the
end; of covers with equal cost the one whose last segments are longer wins; repeated input rows are one
record; columns other than the keys are ignored, so clashing names are harmless.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.runtime import materialize

#: Separators seen between packed values.
SEPARATORS = ",;،؛|/&\t\r\n"
#: Quotation marks that enclose an entry, opening to closing.
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»"}

_URL = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s,;،؛|\"“”«»\[\]]*")
_SEP = re.compile("[" + re.escape(SEPARATORS) + "]")
_PLAIN = re.compile(r"\d+|" + _URL.pattern)
#: Cost of an entry: a single piece, and a link or known value over several.
PIECE, LINK, KNOWN = 1.0, 0.5, 0.5
#: A field without any of these holds numbers alone, and no known value.
_NAMES = r"[^\d\s,;،؛|/&]"


def _unbracket(value: str) -> tuple[int, int]:
    """Start and end of the field without blanks and without brackets around all of it."""
    a, b = 0, len(value)
    while a < b and value[a].isspace():
        a += 1
    while b > a and value[b - 1].isspace():
        b -= 1
    return (a + 1, b - 1) if b - a >= 2 and value[a] == "[" and value[b - 1] == "]" else (a, b)


def _closing(value: str, at: int, end: int) -> int:
    """Place of the mark that closes the quotation opened at `at`, or -1."""
    mark, i = QUOTES[value[at]], at + 1
    while (i := value.find(mark, i, end)) >= 0:
        if value.startswith(mark, i + 1) and i + 1 < end:
            i += 2
            continue
        j = i + 1
        while j < end and value[j].isspace() and value[j] not in SEPARATORS:
            j += 1
        if j == end or value[j] in SEPARATORS:
            return i
        i += 1
    return -1


def scan(value: str) -> tuple[list[tuple[int, int, bool]], list[tuple[int, int]]]:
    """The field cut at every separator outside quotation marks, (start, end, quoted), and the runs [i, j) of pieces that links join."""
    i, end = _unbracket(value)
    out, links, start, fresh = [], [], i, True
    while i < end:
        c = value[i]
        if c in SEPARATORS:
            out.append((start, i, False))
            start, fresh = i + 1, True
        elif fresh and c in QUOTES and (j := _closing(value, i, end)) >= 0:
            i = j + 1
            while i < end and value[i] not in SEPARATORS:
                i += 1
            out.append((start, i, True))
            start, fresh = i + 1, True
        elif c.isalpha() and (i == start or not value[i - 1].isalnum()) and (m := _URL.match(value, i, end)):
            first = links.pop()[0] if links and links[-1][1] > len(out) else len(out)
            for x in _SEP.finditer(value, i, m.end()):
                out.append((start, x.start(), False))
                start = x.end()
            links.append((first, len(out) + 1))
            i, fresh = m.end() - 1, False
        elif not c.isspace():
            fresh = False
        i += 1
    if start <= end and not (out and start > end):
        out.append((start, end, False))
    return out, links


def pieces(value: str) -> list[tuple[int, int, bool]]:
    """The units of a field: pieces that no separator outside quotation marks and links divides."""
    cut, links = scan(value)
    for i, j in reversed(links):
        cut[i:j] = [(cut[i][0], cut[j - 1][1], False)]
    return cut


def entry(text: str, quoted: bool) -> str:
    """An entry as stored: without blanks around it, enclosing marks, and doubled marks inside."""
    text = text.strip()
    if quoted and len(text) >= 2 and text[0] in QUOTES:
        mark = QUOTES[text[0]]
        text = text[1:-1].replace(mark * 2, mark).strip()
    return text


def _is_name(text: str) -> bool:
    """Whether a unit is more than a number or a link, which are values by themselves."""
    return bool(text) and _PLAIN.fullmatch(text) is None


def spans(value: str) -> list[str]:
    """Where a known value may begin: two adjacent unquoted units as one text; none in a field without names."""
    units = [(a, b, q, value[a:b].strip()) for a, b, q in pieces(value)]
    if not any(_is_name(t) for _, _, q, t in units if not q):
        return []
    return [value[a:d].strip() for (a, _, p, t), (_, d, q, _) in zip(units, units[1:]) if t and not p and not q]


def head(known: str) -> str | None:
    """The text by which a known value meets fields: its first two units, as they stand behind a separator; null if it has one, or no name."""
    inside = pieces("," + known)[1:]
    if len(inside) < 2 or inside[0][2] or inside[1][2] or not any(_is_name(known[a - 1 : b - 1].strip()) for a, b, _ in inside):
        return None
    return known[inside[0][0] - 1 : inside[1][1] - 1].strip()


def cover(value: str, places: set[tuple[int, int]]) -> list[str]:
    """The entries of the cheapest cover of the field; places: start and end of the known values that stand in it."""
    cut, links = scan(value)
    n = len(cut)
    edge = []
    for a, b, _ in cut:
        while a < b and value[a].isspace():
            a += 1
        while b > a and value[b - 1].isspace():
            b -= 1
        edge.append((a, b))
    longer: dict[int, list[tuple[int, float]]] = {}  # by last piece: first piece and cost of the segments of several
    for i, j in links:
        if j - i > 1:
            longer.setdefault(j, []).append((i, LINK))
    if places:
        first, last = {a: i for i, (a, b) in enumerate(edge) if a < b}, {b: i + 1 for i, (a, b) in enumerate(edge)}
        torn = [0]
        for _, _, q in cut:
            torn.append(torn[-1] + q)
        for a, b in places:
            i, j = first.get(a, n), last.get(b, 0)
            if i + 1 < j and torn[i] == torn[j]:
                longer.setdefault(j, []).append((i, KNOWN))
    if not longer:
        return [e for a, b, q in cut if (e := entry(value[a:b], q))]
    best, back = [0.0] * (n + 1), [0] * (n + 1)
    for j in range(1, n + 1):
        best[j], back[j] = best[j - 1] + (PIECE if edge[j - 1][0] < edge[j - 1][1] else 0.0), j - 1
        for i, cost in sorted(longer.get(j, ())):
            if best[i] + cost < best[j]:
                best[j], back[j] = best[i] + cost, i
    out, j = [], n
    while j:
        i = back[j]
        out.append(entry(value[cut[i][0] : cut[j - 1][1]], j - i == 1 and cut[i][2]))
        j = i
    return [e for e in reversed(out) if e]


def _segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    for batch in batches:
        values, known = batch.column("value").to_pylist(), batch.column("known").to_pylist()
        automaton = ahocorasick.Automaton()
        for word in {w for ws in known if ws for w in ws}:
            automaton.add_word(word, len(word))
        if len(automaton):
            automaton.make_automaton()
        rows, pos, items = [], [], []
        for r, (value, mine) in enumerate(zip(values, known)):
            places = {(e - n + 1, e + 1) for e, n in automaton.iter(value)} if mine else set()
            for p, item in enumerate(cover(value, places), 1):
                rows.append(r)
                pos.append(p)
                items.append(item)
        keys = [batch.column(i).take(pa.array(rows, pa.int32())) for i in range(batch.num_columns - 2)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(pos, pa.int32()), pa.array(items, pa.string())], [*batch.schema.names[:-2], "pos", "item"])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = [], []
        for i, value in zip(batch.column("vid").to_pylist(), batch.column("value").to_pylist()):
            for s in set(spans(value)):
                ids.append(i)
                out.append(s)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string())], ["vid", "head"])


def _known_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        span = batch.column("span").to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column("span"), pa.array([head(s) if s else None for s in span], pa.string())], ["span", "head"])


def _protected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {e for v in batch.column("value").to_pylist() for a, b, q in pieces(v) if q and _SEP.search(e := entry(v[a:b], True)) and not _PLAIN.fullmatch(e)}
        yield pa.RecordBatch.from_arrays([pa.array(sorted(out), pa.string())], ["span"])


def split_packed(df: DataFrame, keys: list[str], fields: list[str], dictionary: DataFrame | None = None) -> DataFrame:
    """One row per entry: keys, field, pos (from 1), item.

    dictionary: optional further known whole values, in its first column. Nothing is collected or broadcast by
    hand; shuffles carry only distinct field values, their pairs of units, and the known values.
    """
    long = None
    for f in fields:
        one = df.select(*keys, F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))
        long = one if long is None else long.unionByName(one)
    base = long.where("value is not null and trim(value) <> ''").distinct().withColumn("vid", F.md5(F.concat_ws("\x1f", "field", "value")))
    base = materialize(base, "packed")  # read three times: for the dictionary, the pairs of units, the cover
    values = base.select("vid", "value").where(F.col("value").rlike(_NAMES) & F.col("value").rlike(_SEP.pattern)).dropDuplicates(["vid"])
    dic = base.where(F.col("value").rlike("[\"“«']")).select("value").mapInArrow(_protected, "span string")
    if dictionary is not None:
        extra = dictionary.select(F.col(dictionary.columns[0]).cast("string").alias("span"))
        dic = dic.unionByName(extra.select(F.trim("span").alias("span")).where(F.col("span").rlike("[" + re.escape(SEPARATORS) + "]")))
    dic = dic.distinct().mapInArrow(_known_heads, "span string, head string").where("head is not null")
    known = values.mapInArrow(_heads, "vid string, head string").join(dic, "head").groupBy("vid").agg(F.collect_set("span").alias("known"))
    shape = T.StructType([*base.select(*keys, "field").schema.fields, T.StructField("pos", T.IntegerType()), T.StructField("item", T.StringType())])
    return base.join(known, "vid", "left").select(*keys, "field", "value", "known").mapInArrow(_segment, shape)
