"""Session helpers: tables, the shared checkpoint folder, written intermediates."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables written so far: of the whole session, then of each open `dropping` block.
_written: list[list[tuple[SparkSession, str]]] = [[]]


def table(spark: SparkSession, sf_dir: str, name: str, spread: tuple[str, ...] = ()) -> DataFrame:
    """The parquet table `name` of a data folder.

    spread: for work that is heavy per row, the columns by which rows are spread where the stored layout
    (one small file) would leave more than half of the cores idle. Larger tables are read where they lie.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, *spread) if spread and df.rdd.getNumPartitions() * 2 <= cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir, as a URI with its scheme.

    Spark, pyarrow and DuckDB are all given this one form, so that none takes a bare path for a folder of its own
    machine. Only where the setting is absent and all executors are threads of this process (tests, a laptop) a
    folder of our own is used; on a cluster an absent setting is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="quire-")
        shared_dir.own = named
    path = context._jvm.org.apache.hadoop.fs.Path(named)
    uri = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def _drop(tables: list[tuple[SparkSession, str]]) -> None:
    while tables:
        spark, path = tables.pop()
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may be gone
            return


atexit.register(lambda: [_drop(tables) for tables in _written])


def register(spark: SparkSession, path: str) -> None:
    """A table that lives until the interpreter ends."""
    _written[0].append((spark, path))


@contextmanager
def dropping() -> Iterator[None]:
    """Drops the tables that are written inside the block when it ends: results must be collected or stored by then.

    For services that run queries all day; tables written outside stay until the interpreter ends.
    """
    mine: list[tuple[SparkSession, str]] = []
    _written.append(mine)
    try:
        yield
    finally:
        _written.remove(mine)
        _drop(mine)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage so that iterative plans stay small and a lost executor costs one stage, not the
    whole history. Parquet rather than checkpoint(): columnar, compressed, prunable.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    _written[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
