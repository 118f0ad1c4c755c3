import os
from types import SimpleNamespace

import pytest
from pyarrow import fs

from quire import runtime


def test_one_form_of_the_shared_folder(spark):
    """Spark's form is one that pyarrow takes for the same folder."""
    uri = runtime.shared_dir(spark)
    store, path = fs.FileSystem.from_uri(uri)
    assert uri.startswith("file:///") and isinstance(store, fs.LocalFileSystem) and os.path.isabs(path)


def test_cluster_without_shared_folder_is_an_error():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]", getConf=lambda: conf), conf=conf)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(cluster)


def test_tables_of_a_block_are_dropped(spark):
    here = fs.FileSystem.from_uri(runtime.shared_dir(spark))[1]
    kept = runtime.materialize(spark.range(3), "kept")
    with runtime.dropping():
        inner = runtime.materialize(spark.range(5), "inner")
        with runtime.dropping():
            runtime.materialize(spark.range(5), "nested")
        assert inner.count() == 5 and not [f for f in os.listdir(here) if f.startswith("quire-nested")]
    assert not [f for f in os.listdir(here) if f.startswith("quire-inner")] and kept.count() == 3
