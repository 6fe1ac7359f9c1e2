"""Written intermediate tables.

Iterative and multi-pass operators cut their lineage by writing a table to the folder that
all executors share, so a lost executor costs the recomputation of its running tasks only.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_roots: dict[str, str] = {}
#: Paths of the tables made by this process that are still there, by application.
_kept: dict[str, set[str]] = {}
#: The tables made inside a :func:`scratch` of this thread.
_inside = threading.local()


def shared_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where none is set, a session on one machine (a master ``local[...]``) gets a temporary folder;
    on a cluster that would be a different folder on each machine, so there it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        folder = tempfile.mkdtemp(prefix="simweave-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_roots[app] = "file://" + folder
    return _own_roots[app]


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, which Python reaches only through the JVM."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of what was written.

    The table goes when it is dropped, and at the latest when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/simweave/{name}-{uuid.uuid4().hex}"
    _kept.setdefault(spark.sparkContext.applicationId, set()).add(path)
    for made in getattr(_inside, "stack", []):
        made.append(path)
    df.write.parquet(path)
    place, files = _hadoop(spark, path)
    files.deleteOnExit(place)
    table = spark.read.schema(df.schema).parquet(path)
    table._simweave_path = path
    return table


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)
    files.cancelDeleteOnExit(place)
    _kept.get(spark.sparkContext.applicationId, set()).discard(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete the files behind tables made by :func:`written` that nothing will read again."""
    for table in tables:
        path = getattr(table, "_simweave_path", None)
        if path:
            _delete(table.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Every table that this thread writes inside is deleted at the end, when its results have been fetched or stored."""
    stack = _inside.stack = getattr(_inside, "stack", [])
    made: list[str] = []
    stack.append(made)
    try:
        yield
    finally:
        stack.remove(made)
        for path in made:
            if path in _kept.get(spark.sparkContext.applicationId, set()):
                _delete(spark, path)


def drop_all(spark: SparkSession) -> int:
    """Delete what this process has written and not dropped yet; returns the number of tables."""
    paths = list(_kept.get(spark.sparkContext.applicationId, set()))
    for path in paths:
        _delete(spark, path)
    return len(paths)
