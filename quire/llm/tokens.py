"""Encoding of a whole collection with a public tokenizer.

Tree concatenation at three scales. A long unsplit piece of a text (letters, digits or signs that the split
pattern leaves whole) is halved down to leaves, and neighbouring halves are joined by encoding growing windows
around the join again until the window's first token is the left side's and its last token the right side's:
every pair of neighbouring tokens is then one that the encoder itself produces, which makes the whole equal to
encoding the piece at once. A long text is cut into parts that are encoded in parallel wherever they lie; parts
are joined in rounds, FAN of them by one task of a round: at each join the text is split anew from the last
certain boundary on the left until the splits of both sides coincide. Only tokens move from round to round: the
text about a join is decoded from them.

Defined results: null and empty texts have no tokens (an empty list); special tokens are ordinary text;
texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code points beyond which a text is cut, and code points of a part.
LONG = 1 << 16
PART = 1 << 14
#: Parts that one task of a round joins, and the bits of the greatest length of a text in a row.
FAN = 64
BITS = 31
#: Bytes of an unsplit piece beyond which it is halved; tokens of the first window on each side of a join.
PIECE = 64
WINDOW = 8
#: Tokens behind a part's first piece that are decoded at a join, to see where that piece ends.
AHEAD = 8


def default_vocabulary() -> str:
    """Place of the byte_bpe_50k rank file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(maxsize=4)
def encoder(path: str):  # noqa: ANN201
    """The tiktoken encoder of a rank file and the compiled split pattern, once per worker."""
    import public_tokenizers
    import regex
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), regex.compile(public_tokenizers.PATTERN)


def _solid(text: str, size: int) -> bool:
    """Whether an unsplit piece of more than `size` bytes may stand in the text: a run without blanks (one before it aside), or of blanks."""
    n = size // 4 + 1  # a code point has four bytes at most
    words = text.split()
    sizes = list(map(len, words))
    if max(sizes, default=0) >= n and any(len(w) >= n and len(w.encode("utf-8")) >= size for w in words):
        return True
    return len(text) - sum(sizes) >= len(words) - 1 + n - 1 and _blanks(n).search(text) is not None


@lru_cache(maxsize=4)
def _blanks(n: int) -> re.Pattern:
    return re.compile(rf"\s{{{n}}}")


@lru_cache(maxsize=4)
def _one_kind(n: int):  # noqa: ANN202
    """Finds n code points that the split pattern may leave in one piece."""
    import regex

    return regex.compile(rf"\p{{L}}{{{n}}}|\p{{N}}{{{n}}}|[^\s\p{{L}}\p{{N}}]{{{n}}}|\s{{{n}}}")


def halved(piece: str, path: str, size: int = PIECE) -> list[int]:
    """Tokens of one unsplit piece, as a tree of halves."""
    if len(piece) < 2 or len(piece.encode("utf-8")) <= size:
        return encoder(path)[0]._encode_single_piece(piece.encode("utf-8"))
    half = len(piece) // 2
    return join_pieces(halved(piece[:half], path, size), halved(piece[half:], path, size), path)


def encode_plain(text: str, path: str, size: int = PIECE) -> list[int]:
    """Tokens of a text: its long unsplit pieces by halves, what stands between them at once."""
    enc, split = encoder(path)
    if not _solid(text, size) or not _one_kind(size // 4 + 1).search(text):
        return enc.encode_ordinary(text)
    out, at, before = [], 0, 0
    for m in split.finditer(text):
        s, e = m.span()
        if (e - s) * 4 > size and len(text[s:e].encode("utf-8")) > size:
            # a blank piece before is encoded alone: at the end of a text it would join the blanks before it
            for x, y in ((at, before), (before, s)) if at < before and text[s - 1].isspace() else ((at, s),):
                out += enc.encode_ordinary(text[x:y])
            out += halved(text[s:e], path, size)
            at = e
        before = s
    return out + enc.encode_ordinary(text[at:]) if at < len(text) else out


@dataclass
class Part:
    """An encoded text: its tokens, the token count of its first piece, and that of its uncertain tail.

    A piece is uncertain if text that follows could change it: it reaches the end, or it starts with an
    apostrophe and the longest contraction would not fit.
    """

    ids: list[int]
    first_n: int
    last_n: int


def _uncertain(text: str, start: int, end: int) -> bool:
    return end == len(text) or text[start] == "'" and start + 3 > len(text)


def leaf(text: str, path: str) -> Part:
    _, split = encoder(path)
    end, last = 0, -1
    for m in split.finditer(text):
        end = end or m.end()
        if last < 0 and _uncertain(text, m.start(), m.end()):
            last = m.start()
    return Part(encode_plain(text, path), len(encode_plain(text[:end], path)), len(encode_plain(text[last:], path)))


def join_pieces(a: list[int], b: list[int], path: str) -> list[int]:
    """Tokens of one unsplit piece from those of its two halves."""
    enc, _ = encoder(path)
    w = WINDOW
    while True:
        i, j = max(0, len(a) - w), min(len(b), w)
        mid = enc._encode_single_piece(enc.decode_bytes(a[i:] + b[:j]))
        if (i == 0 or mid[0] == a[i]) and (j == len(b) or mid[-1] == b[j - 1]):
            return a[:i] + mid + b[j:]
        w *= 2


def _begin(b: Part, path: str) -> str | None:
    """The text of b's first piece and some tokens more; null if that is not known to be less than all."""
    enc, _ = encoder(path)
    raw = enc.decode_bytes(b.ids[: b.first_n + AHEAD])
    text = raw.decode("utf-8", "ignore")  # the last token may end inside a code point
    return text if b.first_n + AHEAD < len(b.ids) and raw.startswith(text.encode("utf-8")) else None


def concatenate(a: Part, b: Part, path: str) -> Part:
    """The encoding of the text of a, then that of b."""
    if not a.ids:
        return b
    if not b.ids:
        return a
    begin = _begin(b, path)
    joined = _join(a, b, begin, False, path) if begin is not None else None
    return joined or _join(a, b, encoder(path)[0].decode(b.ids), True, path)


def _join(a: Part, b: Part, right: str, whole: bool, path: str) -> Part | None:
    """concatenate() with what is known of b's text; null if more must be known."""
    enc, split = encoder(path)
    tail = enc.decode(a.ids[len(a.ids) - a.last_n :])
    text, m = tail + right, len(tail)
    first_end = len(enc.decode(b.ids[: b.first_n]))
    at, seen, dropped, fresh, spans = 0, 0, 0, [], []
    one_piece = split.match(tail).end() == m
    while True:
        end = split.match(text, at).end()
        if not whole and end + 3 > len(text):
            return None
        spans.append((at, end))
        taken = []
        while m + seen < end:
            nxt = split.match(right, seen).end() if seen else first_end
            if not whole and nxt + 3 > len(right):
                return None
            taken.append(len(encode_plain(right[seen:nxt], path)) if seen else b.first_n)
            seen = nxt
        if one_piece and at == 0 and m + seen == end and seen == first_end and len(taken) == 1:
            fresh.append(join_pieces(a.ids[len(a.ids) - a.last_n :], b.ids[: b.first_n], path))
        else:
            fresh.append(encode_plain(text[at:end], path))
        dropped += sum(taken)
        at = end
        if end >= m and m + seen == end:
            break
    rest = b.ids[dropped:]
    ids = a.ids[: len(a.ids) - a.last_n] + [t for f in fresh for t in f] + rest
    last = next((s for s, e in spans if whole and _uncertain(text, s, e)), -1)
    if last >= 0:
        last_n = sum(len(f) for (s, _), f in zip(spans, fresh) if s >= last) + len(rest)
    elif b.last_n <= len(rest):
        last_n = b.last_n
    elif not whole:
        return None
    else:
        last = at
        while not _uncertain(text, last, e := split.match(text, last).end()):
            last = e
        last_n = len(encode_plain(text[last:], path))
    return Part(ids, len(fresh[0]) if a.last_n == len(a.ids) else a.first_n, last_n)


def encode_tree(parts: list[Part], path: str) -> Part:
    """Joins neighbouring parts level by level."""
    while len(parts) > 1:
        parts = [concatenate(parts[i], parts[i + 1], path) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else Part([], 0, 0)


def encode_text(text: str | None, path: str, part: int = PART) -> list[int]:
    """Reference form of the distributed encoding, for one text."""
    return encode_tree([leaf(text[i : i + part], path) for i in range(0, len(text), part)], path).ids if text else []


def encode(df: DataFrame, key: str, text: str, vocabulary: str | None = None, carry: tuple[str, ...] = (), long: int = LONG, part: int = PART, fan: int = FAN, rounds: int | None = None) -> DataFrame:
    """key, the carried columns, and ids (a list of integers) of every row; rounds: as many as the longest possible text needs, if not given."""
    path = vocabulary or default_vocabulary()
    names = [f"c{i}" for i in range(len(carry) + 1)]
    rows = df.select(*[F.col(c).alias(n) for c, n in zip((key, *carry), names)], F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)

    ids_type = pa.list_(pa.int32())

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [encode_plain(t, path) if t else [] for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, ids_type)], [*names, "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [leaf(t, path) for t in b.column(b.num_columns - 1).to_pylist()]
            arrays = [pa.array([m.ids for m in made], ids_type), *[pa.array([getattr(m, n) for m in made], pa.int32()) for n in ("first_n", "last_n")]]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], [*b.schema.names[:-1], "ids", "first_n", "last_n"])

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        made = encode_tree([Part(*x) for x in zip(*(table.column(n).to_pylist() for n in ("ids", "first_n", "last_n")))], path)
        out = table.slice(0, 1).select([*names, "row", "node"]).rename_columns([*names, "row", "seq"])
        return out.append_column("ids", pa.array([made.ids], ids_type)).append_column("first_n", pa.array([made.first_n], pa.int32())).append_column("last_n", pa.array([made.last_n], pa.int32()))

    size = F.coalesce(F.length("text"), F.lit(0))
    plain = rows.where(size <= long).mapInArrow(short, f"{kinds}, ids array<int>")
    # equal keys of different rows stay apart by the row's own number
    cut = rows.where(size > long).withColumn("row", F.monotonically_increasing_id()).select(*names, "row", "text", F.posexplode(F.sequence(F.lit(1), F.length("text"), F.lit(part))).alias("seq", "start"))
    cut = cut.select(*names, "row", "seq", F.expr(f"substring(text, start, {part})").alias("text"))
    shape = f"{kinds}, row long, seq int, ids array<int>, first_n int, last_n int"
    parts = cut.repartition("row", "seq").mapInArrow(leaves, shape)
    for _ in range(max(1, math.ceil((BITS - math.log2(part)) / math.log2(fan))) if rounds is None else rounds):
        parts = parts.withColumn("node", F.floor(F.col("seq") / fan).cast("int")).groupBy("row", "node").applyInArrow(joined, shape)
    return plain.unionByName(parts.select(*names, "ids")).select(*[F.col(n).alias(c) for c, n in zip((key, *carry), names)], "ids")
