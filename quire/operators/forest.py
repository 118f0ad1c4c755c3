"""Parent-child links to full hierarchies: root, depth, path and descendants of every node; loops reported.

Method: a deterministic hash of the node chooses splitters (about one in SPLIT). Every node walks to its
next splitter or root: first inside its cell (a bounded range of ids of one group, streamed from a sorted
partition), then, for walks that leave the cell, by pointer doubling that stops at splitters, a logarithm
of the gap in joins. The splitters alone form a reduced pointer graph, solved the same way over 1/SPLIT of
the rows, and exact paths are expanded from the legs between splitters. Nodes that walk into a loop
without a splitter are recognised by a repeated node in the walked leg; loops through splitters by a
repeated splitter in the reduced path. Only open walks are joined again, and each round is a written table.

No group of a tree is ever gathered: a cell holds at most CELL nodes, however large its group, and the
joins are on node keys, against those rows only that an open walk points at. A parent with very many children is one hot key of the left side only, which
adaptive skew joins split.

Defined results: a parent that is null, 0 or no node of its group makes a root; a node that is its own
parent stands in a loop; of several rows of one node the last by the order column counts (ties: the greater
parent); rows with a null group or id are no nodes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.runtime import materialize

#: One node in so many, about, is a splitter.
SPLIT = 16
#: Ids of a group that are walked together.
CELL = 1 << 15


def last_rows(df: DataFrame, group: str, node: str, parent: str, order: str) -> DataFrame:
    """One row per node, grp, id, parent: the last by `order`."""
    return (
        df.where(F.col(group).isNotNull() & F.col(node).isNotNull())
        .groupBy(F.col(group).cast("long").alias("grp"), F.col(node).cast("long").alias("id"))
        .agg(F.max(F.struct(F.col(order).alias("o"), F.col(parent).cast("long").alias("p"))).alias("last"))
        .select("grp", "id", F.col("last.p").alias("parent"))
    )


def _splits(node: str) -> Column:
    return F.pmod(F.xxhash64("g", node), F.lit(SPLIT)) == 0


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks inside the cells of a partition sorted by g and cell; rows: g, i, t, seg, loop, done.

    seg: the nodes above, nearest first, up to and with t, where the walk stands. Done walks stand at a
    stop, at a root, or in a loop.
    """

    def solve(rows: list[tuple], out: list[list]) -> None:
        up = {i: (t, stop) for _, i, _, t, stop in rows}
        for g, i, _, t, stop in rows:
            seg, loop, done, seen = [], False, t is None, {i}
            while not done:
                seg.append(t)
                if t in seen:
                    loop = done = True
                elif stop:
                    done = True
                elif t not in up:
                    break
                else:
                    nxt, stop = up[t]
                    if nxt is None:
                        done = True
                    else:
                        seen.add(t)
                        t = nxt
            for column, value in zip(out, (g, i, t, seg, loop, done)):
                column.append(value)

    def solved(rows: list[tuple]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], [], []]
        at = 0
        for n in range(1, len(rows) + 1):
            if n == len(rows) or rows[n][0] != rows[at][0] or rows[n][2] != rows[at][2]:
                solve(rows[at:n], out)
                at = n
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["g", "i", "t", "seg", "loop", "done"])

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns))
        last = len(held)
        while last and held[last - 1][0] == held[-1][0] and held[last - 1][2] == held[-1][2]:
            last -= 1
        yield solved(held[:last])
        held = held[last:]
    if held:
        yield solved(held)


def _walk(start: DataFrame, name: str, stops: bool) -> DataFrame:
    """start: g, i, t (null: root). Result: g, i, t, seg, loop. stops: whether splitters stop a walk."""
    cell = F.floor(F.col("i") / CELL)
    rows = start.select("g", "i", cell.alias("cell"), "t", (_splits("t") if stops else F.lit(False)).alias("stop"))
    rows = rows.withColumn("stop", F.coalesce("stop", F.lit(False)))
    walked = rows.repartition("g", "cell").sortWithinPartitions("g", "cell").mapInArrow(_cells, "g long, i long, t long, seg array<bigint>, loop boolean, done boolean")
    first = materialize(walked, f"{name}-0")
    closed, opened, k = [first.where("done")], first.where("not done"), 0
    if opened.isEmpty():
        return closed[0].drop("done")
    # a walk only ever meets rows that some open walk points at now: those further up are pointed at by these
    met = opened.select("g", F.col("t").alias("i")).distinct().withColumn("met", F.lit(True))
    ends = [materialize(closed[0].join(met.drop("met"), ["g", "i"], "left_semi"), f"{name}-ends")]
    opened = opened.join(met, ["g", "i"], "left").withColumn("met", F.coalesce("met", F.lit(False)))
    while True:
        k += 1
        rows = opened.where("met").drop("met")
        for e in ends:
            rows = rows.unionByName(e)
        up = rows.select("g", F.col("i").alias("t"), F.col("t").alias("next"), F.col("seg").alias("more"), F.col("loop").alias("up_loop"), F.col("done").alias("up_done"))
        seg = F.concat("seg", "more")
        repeat = (F.size(F.array_distinct(seg)) < F.size(seg)) | F.array_contains(seg, F.col("i"))
        new = opened.drop("done").join(up, ["g", "t"]).select("g", "i", F.coalesce("next", "t").alias("t"), seg.alias("seg"), (F.col("up_loop") | repeat).alias("loop"), (F.col("up_done") | repeat).alias("done"), "met")
        new = materialize(new, f"{name}-{k}")
        done = new.where("done")
        closed.append(done.drop("met"))
        opened = new.where("not done")
        if opened.isEmpty():
            break
        ends.append(done.where("met").drop("met"))
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.drop("done")


def resolve_forest(nodes: DataFrame) -> DataFrame:
    """nodes: grp, id, parent, one row each. Result: grp, id, in_loop, root, depth, path (root to node).

    root, depth and path are null for nodes that have no root.
    """
    keyed = nodes.select(F.col("grp").alias("g"), F.col("id").alias("i"), F.when(F.col("parent") != 0, F.col("parent")).alias("t"))
    there = keyed.select("g", F.col("i").alias("t"), F.lit(True).alias("there"))
    start = keyed.join(there, ["g", "t"], "left").select("g", "i", F.when(F.col("there"), F.col("t")).alias("t"))
    walked = _walk(start, "walk", True)
    # the reduced graph: splitters, each pointing at the next splitter or root; legs that fell in a loop end there
    legs = walked.where(_splits("i"))
    marked = legs.select("g", F.col("i").alias("t"), F.lit(True).alias("splits"))
    reduced = legs.where("not loop").select("g", "i", "t").join(marked, ["g", "t"], "left").select("g", "i", F.when(F.col("splits"), F.col("t")).alias("t"))
    solved = _walk(reduced.unionByName(legs.where("loop").select("g", "i", F.col("i").alias("t"))), "reduced", False)
    # a splitter's ancestors: the legs of itself and of every splitter above it, in order
    starts = solved.where("not loop").select("g", F.col("i").alias("top"), F.posexplode(F.concat(F.array("i"), "seg")).alias("pos", "i"))
    ancestors = starts.join(legs.select("g", "i", "seg"), ["g", "i"]).groupBy("g", F.col("top").alias("t")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "seg"))), lambda x: x["seg"])).alias("above"))
    lost = solved.where("loop").select("g", F.col("i").alias("t"), F.lit(None).cast("array<bigint>").alias("above"), F.lit(True).alias("up_loop"))
    above = lost.unionByName(ancestors.select("g", "t", "above", F.lit(False).alias("up_loop")))
    chain = F.concat(F.array("i"), F.col("seg"), F.coalesce("above", F.array().cast("array<bigint>")))
    looped = F.col("loop") | F.coalesce("up_loop", F.lit(False))
    out = walked.join(above, ["g", "t"], "left").select(F.col("g").alias("grp"), F.col("i").alias("id"), looped.alias("in_loop"), F.when(~looped, F.reverse(chain)).alias("path"))
    return out.select("grp", "id", "in_loop", F.col("path")[0].alias("root"), F.when(~F.col("in_loop"), F.size("path") - 1).alias("depth"), "path")


def descendants(resolved: DataFrame) -> DataFrame:
    """Every (ancestor, descendant, distance), distance at least 1, of the nodes that have a root."""
    return (
        resolved.where("not in_loop and depth > 0")
        .select("grp", F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
        .where("pos < depth")
        .select("grp", "ancestor", "descendant", (F.col("depth") - F.col("pos")).alias("distance"))
    )
