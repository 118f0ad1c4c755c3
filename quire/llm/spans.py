"""Long exact spans shared between records, and how much of each record stands elsewhere too.

Relative Lempel-Ziv parsing (`relative_lz`), with the reference in blocks. A block indexes what stands around the
anchors of one hash range; the records' text there is factored greedily against the block, and the matches at factor
boundaries and inside long factors, extended to both sides and checked on the stored characters, are shared spans if
they have LENGTH code points. Factoring every record against every block would grow with the square of the
collection, so records are sent only to the blocks in which a long factor can exist: anchors are the minima of
hashed GRAM-grams over every window of LENGTH code points, and two records with a common span of LENGTH necessarily
share the anchor of each window in it. Nothing is sampled and no factor is lost.

Plan: one scan finds the anchors (vectorised); one shuffle of (hash, record, place) finds those of two
records or more, after a map-side step that settles anchors repeated within a batch, so a passage in a
third of all records sends one row per batch; only records with such anchors meet their text again; blocks
are sorted partitions read as a stream. An anchor of more than DIRECT places would be compared with itself over and
over: its places are told apart by the windows of LENGTH they stand in. One of more than GROUP_MAX places is not
gathered: its windows are joined one by one.

Defined results: null and short texts share nothing; spans lie within one field; a span repeated within
one record only is not shared; repeated rows of a record are one record; lengths count code points; records
with a null key are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.relative_lz import Block
from quire.runtime import materialize

#: Code points of a shared span, at least, and of an anchor.
LENGTH = 120
GRAM = 40
#: Places of one anchor that a task compares at once; beyond, places are split by window.
GROUP_MAX = 2000
#: Places of an anchor up to which it is parsed with its block, and code points of a block.
DIRECT = 24
BLOCK = 1 << 18
#: Code points that are hashed at once; longer texts are hashed in pieces that share a window less one.
CHARS = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, np.uint64(base), dtype=np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class _Tables:
    """Powers of the hash base and of its inverse, grown when needed."""

    n = 0
    up = down = np.zeros(0, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > cls.n:
            cls.n = max(n, 1 << 20)
            cls.up, cls.down = _powers(int(_BASE), cls.n), _powers(pow(int(_BASE), -1, 1 << 64), cls.n)
        return cls.up[:n], cls.down[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return x


def _sliding(x: np.ndarray, width: int, how: np.ufunc) -> np.ndarray:
    """how over x[i : i + width] for every i that has a whole window."""
    step, y = 1, x
    while step * 2 <= width:
        y = how(y[:-step], y[step:])
        step *= 2
    rest = width - step
    return how(y[: len(y) - rest], y[rest:]) if rest else y


def anchors(column: pa.Array, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and hash of every anchor of a string array whose values all have `length` code points or more."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    raw = column.buffers()[2][int(offsets[0]) : int(offsets[-1])].to_pybytes()
    heads = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(heads, dtype=np.int64)])
    edge = count[offsets - offsets[0]]
    c = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.uint64)
    n = len(c)
    up, down = _Tables.get(n + 1)
    c += np.uint64(0x51ED27)
    c *= np.uint64(0xD6E8FEB86659FD93)
    c ^= c >> np.uint64(32)
    c *= up[:n]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(c, out=total[1:])
    h = total[gram:] - total[:-gram]
    h *= down[: len(h)]
    h = _mix(h)
    low = _sliding(h, length - gram + 1, np.minimum)  # of the window that starts here
    valid = np.zeros(len(low), bool)
    for a, b in zip(edge[:-1], edge[1:]):
        valid[a : b - length + 1] = True
    low[~valid] = 0
    pad = np.zeros(length - gram, np.uint64)
    most = _sliding(np.concatenate([pad, low, pad]), length - gram + 1, np.maximum)
    at = np.flatnonzero((most[: len(h)] == h) & (most[: len(h)] != 0))
    row = np.searchsorted(edge, at, side="right") - 1
    return row, at - edge[row], h[at]


def _hashed(keys: pa.Array, column: pa.Array, length: int, gram: int, chars: int) -> Iterator[tuple]:
    """Keys, and row, place and hash of the anchors, of about `chars` code points at a time."""
    size = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    keys = keys.to_numpy()
    some, total = [], 0
    for i in np.flatnonzero(size >= length).tolist():
        if size[i] > chars:
            text = column[i].as_py()
            for s in range(0, len(text) - length + 1, chars):
                row, at, h = anchors(pa.array([text[s : s + chars + length - 1]]), length, gram)
                yield keys[i : i + 1], row, at + s, h
            continue
        some.append(i)
        total += size[i]
        if total > chars:
            yield keys[some], *anchors(column.take(pa.array(some)), length, gram)
            some, total = [], 0
    if some:
        yield keys[some], *anchors(column.take(pa.array(some)), length, gram)


def _found(batches: Iterator[pa.RecordBatch], length: int, gram: int, chars: int) -> Iterator[pa.RecordBatch]:
    """kind 0: an anchor that the batch holds in one record; 1: in two or more; 2: notice of 1 to the hash's block."""
    names = ["route", "hash", "key", "place", "kind"]
    for b in batches:
        hs, ks, ps = [], [], []
        for f in range(1, b.num_columns):
            for key, row, at, h in _hashed(b.column(0), b.column(f), length, gram, chars):
                hs.append(h.view(np.int64))
                ks.append(key[row])
                ps.append(at * (b.num_columns - 1) + (f - 1))
        if not hs:
            continue
        h, k, p = map(np.concatenate, (hs, ks, ps))
        order = np.argsort(h, kind="stable")
        h, k, p = h[order], k[order], p[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        known = np.minimum.reduceat(k, first) != np.maximum.reduceat(k, first)
        kind = np.repeat(known, np.diff(np.append(first, len(h)))).astype(np.int8)
        notice = first[known]
        route = np.where(kind == 1, k * 0x9E3779B1 + (p >> 3), h)
        out = [np.concatenate([x, y]) for x, y in ((route, h[notice]), (h, h[notice]), (k, k[notice]), (p, p[notice]), (kind, np.full(len(notice), 2, np.int8)))]
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64()), pa.array(out[4], pa.int8())], names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by hash, the rows of those that two records or more hold; in constant memory."""
    last, last_key, last_shared, held = None, None, False, []

    def rows(h: np.ndarray, k: np.ndarray, p: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(k), pa.array(p)], ["hash", "key", "place"])

    for b in batches:
        h, k, p, kind = (b.column(i).to_numpy() for i in range(1, 5))
        if not len(h):
            continue
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        lo, hi = np.minimum.reduceat(k, first), np.maximum.reduceat(k, first)
        shared = (lo != hi) | (np.maximum.reduceat(kind, first) > 0)
        if h[0] == last:
            shared[0] |= last_shared or last_key != lo[0]
            if shared[0]:
                for x in held:
                    yield rows(*x)
                held = []
        else:
            held = []
        size = np.diff(np.append(first, len(h)))
        take = np.repeat(shared, size) & (kind != 2)
        if take.any():
            yield rows(h[take], k[take], p[take])
        last, last_shared, last_key = h[-1], bool(shared[-1]), lo[-1]
        if not last_shared:
            own = slice(first[-1], None)
            held = [*(held if len(first) == 1 else []), (h[own], k[own], p[own])]
        else:
            held = []


def _contexts(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each shared place with what stands around it: a part of its block's text."""
    reach = length - gram
    for b in batches:
        fields = [b.column(i).to_pylist() for i in range(1, b.num_columns - 1)]
        out: list[list] = [[], [], [], [], [], []]
        for r, (key, hits) in enumerate(zip(b.column(0).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
            for hit in hits:
                at, f = divmod(hit["place"], len(fields))
                text = fields[f][r]
                if text is None or len(text) < at + gram:
                    continue
                start = max(0, at - reach)
                for x, v in zip(out, (hit["hash"], key, hit["place"], at - start, text[start : at + length], hit["hot"])):
                    x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_()))], ["hash", "key", "place", "lead", "around", "hot"])


def _parsed(members: list[tuple], groups: list[tuple[int, int]], length: int, gram: int) -> tuple[set, list]:
    """Factors of small groups, parsed in blocks of about BLOCK code points."""
    pairs, spans = set(), []
    held: list[int] = []
    size = 0
    for n, (s, e) in enumerate(groups, 1):
        held += range(s, e)
        size += sum(len(members[i][4]) for i in range(s, e))
        if size < BLOCK and n < len(groups):
            continue
        block = Block([(members[i][1], members[i][4]) for i in held])
        for i, j, start, end in block.shared(length):
            x, y = members[held[i]][1], members[held[j]][1]
            pairs.add((x, y) if x < y else (y, x))
            lead = members[held[i]][3]
            spans.append((held[i], lead - start, end - lead - gram))
        held, size = [], 0
    return pairs, spans


def _windows(around: str, lead: int, length: int, gram: int) -> Iterator[tuple[int, str]]:
    """Offset of the start before the anchor, and text, of every window of `length` that holds the anchor."""
    for s in range(max(0, lead + gram - length), min(lead, len(around) - length) + 1):
        yield lead - s, around[s : s + length]


def _classes(members: list[tuple], length: int, gram: int) -> tuple[set, list]:
    """Factors of a large group by classes of equal windows: work in proportion to places and true pairs."""
    pairs, spans, seen = set(), [], set()
    by: dict[tuple[int, str], list[int]] = {}
    for i, (_, _, _, lead, around) in enumerate(members):
        for w in _windows(around, lead, length, gram):
            by.setdefault(w, []).append(i)
    for (before, _), who in by.items():
        keys = sorted({members[i][1] for i in who})
        if len(keys) > 1:
            spans += [(i, before, length - gram - before) for i in who]
            if (mark := tuple(keys)) not in seen:
                seen.add(mark)
                pairs.update((x, y) for n, x in enumerate(keys) for y in keys[n + 1 :])
    return pairs, spans


def _factors(batches: Iterator[pa.RecordBatch], length: int, gram: int, want_spans: bool, fields: int, direct: int) -> Iterator[pa.RecordBatch]:
    """Streams a block sorted by hash; rows: a, b of a pair, or a, field, start, end of a factor."""
    held: list[tuple] = []

    def solve(members: list[tuple]) -> pa.RecordBatch:
        small, pairs, spans = [], set(), []
        s = 0
        for e in range(1, len(members) + 1):
            if e == len(members) or members[e][0] != members[s][0]:
                if 1 < e - s <= direct:
                    small.append((s, e))
                elif e - s > direct:
                    p, q = _classes(members[s:e], length, gram)
                    pairs |= p
                    spans += [(i + s, x, y) for i, x, y in q]
                s = e
        if small:
            p, q = _parsed(members, small, length, gram)
            pairs |= p
            spans += q
        if want_spans:
            cut = {(members[i][1], members[i][2] % fields, members[i][2] // fields - lf, members[i][2] // fields + gram + rt) for i, lf, rt in spans}
            cols = list(zip(*cut)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], ["a", "b", "s", "e"])
        cols = list(zip(*pairs)) or [(), ()]
        none = pa.nulls(len(pairs), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), none, none], ["a", "b", "s", "e"])

    for batch in batches:
        held += list(zip(*(c.to_pylist() for c in batch.columns[:5])))
        if len(held) < 4 * direct or held[0][0] == held[-1][0]:
            continue
        last = len(held)
        while held[last - 1][0] == held[-1][0]:
            last -= 1
        done, held = held[:last], held[last:]
        yield solve(done)
    if held:
        yield solve(held)


def _hot_windows(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key, place, mark = [], [], []
        for _, k, p, lead, around, _ in zip(*(c.to_pylist() for c in batch.columns)):
            for before, text in _windows(around, lead, length, gram):
                key.append(k)
                place.append(p)
                mark.append(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, salt=before.to_bytes(2, "little")).digest())
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(place, pa.int64()), pa.array(mark, pa.binary())], ["key", "place", "window"])


def _solved(df: DataFrame, key: str, fields: list[str], length: int, gram: int, group_max: int, direct: int, chars: int, want_spans: bool) -> DataFrame:
    n = len(fields)
    rows = df.select(F.col(key).cast("long").alias("key"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)]).where(F.col("key").isNotNull())
    rows = rows.where(F.greatest(*[F.coalesce(F.length(f"f{i}"), F.lit(0)) for i in range(n)], F.lit(0)) >= length)
    found = rows.mapInArrow(lambda it: _found(it, length, gram, chars), "route long, hash long, key long, place long, kind byte")
    shared = materialize(found.repartition("route").sortWithinPartitions("hash").mapInArrow(_shared, "hash long, key long, place long"), "anchors")
    hot = shared.groupBy("hash").count().where(F.col("count") > group_max).select("hash", F.lit(True).alias("hot"))
    any_hot = not hot.isEmpty()
    marked = shared.join(hot, "hash", "left").withColumn("hot", F.coalesce("hot", F.lit(False))) if any_hot else shared.withColumn("hot", F.lit(False))
    hits = marked.groupBy("key").agg(F.collect_set(F.struct("hash", "place", "hot")).alias("hits"))
    around = rows.join(hits.hint("shuffle_hash"), "key").select("key", *[f"f{i}" for i in range(n)], "hits").mapInArrow(lambda it: _contexts(it, length, gram), "hash long, key long, place long, lead int, around string, hot boolean")
    if any_hot:
        around = materialize(around, "around")
    block = around.where("not hot").repartition("hash").sortWithinPartitions("hash")
    out = block.mapInArrow(lambda it: _factors(it, length, gram, want_spans, n, direct), "a long, b long, s int, e int")
    if any_hot:
        w = around.where("hot").mapInArrow(lambda it: _hot_windows(it, length, gram), "key long, place long, window binary")
        if want_spans:
            two = w.groupBy("window").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("window")
            # the window's own start is not kept: the factor around the anchor is bounded by its windows
            out = out.unionByName(_hot_spans(around.where("hot"), two, length, gram, n))
        else:
            k = w.select("window", "key").distinct()
            pairs = k.withColumnRenamed("key", "a").join(k.withColumnRenamed("key", "b"), "window").where("a < b").select("a", "b").distinct()
            out = out.unionByName(pairs.select("a", "b", F.lit(None).cast("int").alias("s"), F.lit(None).cast("int").alias("e")))
    return out


def _hot_spans(around: DataFrame, shared_windows: DataFrame, length: int, gram: int, n: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, k, p, lead, text, _ in zip(*(c.to_pylist() for c in batch.columns)):
                for before, t in _windows(text, lead, length, gram):
                    s = p // n - before
                    rows.append((k, p % n, s, s + length, blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16, salt=before.to_bytes(2, "little")).digest()))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))], ["a", "b", "s", "e", "window"])

    return around.mapInArrow(each, "a long, b long, s int, e int, window binary").join(shared_windows, "window", "left_semi").select("a", "b", "s", "e")


def shared_pairs(df: DataFrame, key: str, fields: list[str], length: int = LENGTH, gram: int = GRAM, group_max: int = GROUP_MAX, direct: int = DIRECT, chars: int = CHARS) -> DataFrame:
    """a, b (a < b): keys of two records with a common span of `length` code points or more."""
    return _solved(df, key, fields, length, gram, group_max, direct, chars, False).select("a", "b").distinct()


def shared_amount(df: DataFrame, key: str, fields: list[str], length: int = LENGTH, gram: int = GRAM, group_max: int = GROUP_MAX, direct: int = DIRECT, chars: int = CHARS) -> DataFrame:
    """key, shared_chars, n_spans: code points of the record that stand in a span shared with another record."""
    spans = _solved(df, key, fields, length, gram, group_max, direct, chars, True).distinct()
    before = F.coalesce(F.max("e").over(Window.partitionBy("a", "b").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    new = spans.withColumn("before", before)
    return new.groupBy(F.col("a").alias("key")).agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "before"))).alias("shared_chars"), F.sum((F.col("s") > F.col("before")).cast("int")).alias("n_spans"))
