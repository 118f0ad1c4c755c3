"""Frequency of every distinct term: occurrences, records, and a mark on the too rare and too common.

Recursive radix spilling. Each map task combines its terms in a bounded table; the shuffle partitions the
combined terms by hash bits to disk; a reduce task whose partition is larger than a piece splits it further by the
next hash bits into spill files in the cluster's shared folder, and so on while a piece is too large; every
piece is aggregated by DuckDB under a memory limit. Before a split the part read so far is aggregated, so a
piece that is large only because a common term comes from very many map tasks shrinks instead of being split,
and the bits of the hash are never used up by it. Nothing larger than a piece and a half is ever held.

Defined results: null and empty texts or lists have no terms but count as records in the total; null and
empty terms are ignored; a term repeated in one record counts once in n_records; repeated rows are records
of their own; rare wins over common where a tiny table makes both true; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.runtime import shared_dir

#: Distinct terms a map task holds before it hands them on.
FLUSH = 200_000
#: Rows and bytes of a piece: its table should stay in a core's own cache. Larger pieces are split by RADIX hash bits.
PIECE_ROWS = 50_000
PIECE_BYTES = 2 << 20
RADIX = 4
MEMORY = "200MB"

_COUNTS = pa.schema([("term", pa.string()), ("n_occurrences", pa.int64()), ("n_records", pa.int64())])


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    occ: Counter = Counter()
    rec: Counter = Counter()

    def flush() -> pa.RecordBatch:
        terms = list(occ)
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([occ[t] for t in terms], pa.int64()), pa.array([rec[t] for t in terms], pa.int64())], schema=_COUNTS)
        occ.clear()
        rec.clear()
        return out

    for b in batches:
        lists = pa.types.is_list(b.schema.field(0).type)
        for value in b.column(0).to_pylist():
            if not value:
                continue
            terms = value if lists else value.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
            occ.update(terms)
            rec.update(set(terms))
            if len(occ) > FLUSH:
                for none in ("", None):
                    occ.pop(none, None)
                yield flush()
    for none in ("", None):
        occ.pop(none, None)
    if occ:
        yield flush()


def _duck(held: list[pa.RecordBatch], spill: str | None) -> list[pa.RecordBatch]:
    """The batches, one row per term. spill: a folder of the shared file system, null if DuckDB cannot write there: a piece fits its memory."""
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill or ""})
    try:
        con.register("piece", pa.RecordBatchReader.from_batches(_COUNTS, iter(held)))
        out = con.sql("select term, cast(sum(n_occurrences) as bigint) as n_occurrences, cast(sum(n_records) as bigint) as n_records from piece group by term").to_arrow_table()
    finally:
        con.close()
    return out.cast(_COUNTS).to_batches(max_chunksize=50_000)


def _size(held: list[pa.RecordBatch]) -> tuple[int, int]:
    return sum(b.num_rows for b in held), sum(b.nbytes for b in held)


def _radix(batches: Iterator[pa.RecordBatch], depth: int, store: fs.FileSystem, folder: str) -> Iterator[pa.RecordBatch]:
    """Aggregates the batches, splitting them by the next hash bits while they are too many."""
    spill = folder if isinstance(store, fs.LocalFileSystem) else None
    held: list[pa.RecordBatch] = []
    rows = size = 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows > PIECE_ROWS or size > PIECE_BYTES:
            held = _duck(held, spill)
            rows, size = _size(held)
            if (rows > PIECE_ROWS // 2 or size > PIECE_BYTES // 2) and RADIX * depth < 64:
                break
    else:
        if held:
            yield from _duck(held, spill)
        return
    from xxhash import xxh3_64_intdigest

    here = f"{folder}/{depth}-{uuid.uuid4().hex}"
    store.create_dir(here)
    streams = [store.open_output_stream(f"{here}/{i}.arrows") for i in range(1 << RADIX)]
    writers = [pa.ipc.new_stream(x, _COUNTS) for x in streams]

    def rest() -> Iterator[pa.RecordBatch]:
        yield from held
        held.clear()
        yield from batches

    for b in rest():
        digit = [(xxh3_64_intdigest(t) >> (RADIX * depth)) & ((1 << RADIX) - 1) for t in b.column(0).to_pylist()]
        where: list[list[int]] = [[] for _ in writers]
        for i, k in enumerate(digit):
            where[k].append(i)
        for f, w in zip(writers, where):
            if w:
                f.write_batch(b.take(pa.array(w, pa.int32())))
    for f, x in zip(writers, streams):
        f.close()
        x.close()
    for i in range(1 << RADIX):
        with store.open_input_stream(f"{here}/{i}.arrows") as x:
            yield from _radix(iter(pa.ipc.open_stream(x)), depth + 1, store, folder)
        store.delete_file(f"{here}/{i}.arrows")


def term_counts(df: DataFrame, field: str) -> DataFrame:
    """term, n_occurrences, n_records of a column of strings (pieces between U+0020, tab, CR, LF) or of lists."""
    spark = df.sparkSession
    scratch = shared_dir(spark)

    def aggregate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(scratch)
        folder = f"{root}/terms-{uuid.uuid4().hex}"
        store.create_dir(folder)
        try:
            yield from _radix((b.cast(_COUNTS) for b in batches), 0, store, folder)
        finally:
            store.delete_dir(folder)

    shape = "term string, n_occurrences long, n_records long"
    return df.select(F.col(field).alias("value")).mapInArrow(_combine, shape).repartition("term").mapInArrow(aggregate, shape)


def marked_terms(df: DataFrame, field: str, rare: int = 2, common_percent: int = 15) -> DataFrame:
    """term_counts with field and mark: rare (in at most `rare` records), common (in more than the percentage of all rows), or null."""
    total = df.count()
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") * 100 > F.lit(common_percent * total), "common")
    return term_counts(df, field).select(F.lit(field).alias("field"), "term", "n_occurrences", "n_records", mark.alias("mark"))
