"""Session helpers: table reading, shared scratch space and package shipping."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``; any path Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each context."""
    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    # Texts may be long: batches for Python workers are bounded by bytes, unless the session says otherwise.
    if spark.conf.get(ARROW_BYTES, None) in (None, "67108864", "67108864b", "64m", "64MB"):
        spark.conf.set(ARROW_BYTES, "4194304")
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(), "corpusloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.join("corpusloom", os.path.relpath(p, root)))
    sc.addPyFile(archive)
    _SHIPPED[sc] = True


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a local one only where that is unset and the session is local too."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + os.path.join(tempfile.gettempdir(), "corpusloom-scratch")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: a cut lineage that survives lost executors.

    The folder goes by ``release``, at the end of the ``scratch`` it was written in, or when the session's file system closes.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jpath, files = _path(spark, path)
    files.deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = (path,)
    if _OPEN:
        _OPEN[-1].append(out)
    return out


#: Tables written inside each open ``scratch``.
_OPEN: list[list[DataFrame]] = []


def _path(spark: SparkSession, path: str) -> tuple:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def release(*tables: DataFrame | None) -> None:
    """Delete scratch tables whose readers have all been written. Frames that ``materialize`` or ``hold`` didn't make are passed over."""
    for t in tables:
        for path in getattr(t, "_scratch", ()):
            jpath, files = _path(t.sparkSession, path)
            files.delete(jpath, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df``, never broadcast in a join: the size of a scratch table's compressed files says little of its rows."""
    return df.hint("merge")


def hold(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """``df``, to be released with the scratch tables that it is made of."""
    df._scratch = tuple(p for t in tables for p in getattr(t, "_scratch", ()))
    return df


@contextlib.contextmanager
def written() -> Iterator[list[DataFrame]]:
    """The list that it gives gets the scratch tables written inside."""
    _OPEN.append([])
    try:
        yield _OPEN[-1]
    finally:
        done = _OPEN.pop()
        if _OPEN:
            _OPEN[-1].extend(done)


@contextlib.contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Scratch tables written inside go at the end, but for those that the list it gives holds by then."""
    kept: list[DataFrame] = []
    with written() as tables:
        yield kept
    stay = {p for t in kept for p in getattr(t, "_scratch", ())}
    release(*(t for t in tables if not stay & set(t._scratch)))
