"""Session helpers shared by every part of the library: shipping code, shared storage, checkpoints."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import weakref
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()
_written: dict[int, tuple[weakref.ref, str]] = {}


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that Python stages import it anywhere."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="plumbline-")
    path = os.path.join(folder, "plumbline_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.join(os.path.basename(PACKAGE), os.path.relpath(full, PACKAGE)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-shared-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the application may have ended
        pass


@contextlib.contextmanager
def arrow_batches(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """While it holds, rows go to Python in batches of about so many bytes: a batch lies in an executor's memory several
    times over. For queries that run inside; what the session had comes back."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(n_bytes))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and outlives any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (weakref.ref(out, lambda _, key=id(out): _written.pop(key, None)), path)
    return out


def materialize_buckets(df: DataFrame, name: str, n: int, key: str) -> tuple[DataFrame, DataFrame]:
    """The same for a table whose files are buckets of a key: read by bucket, so that a join by the key does not shuffle it,
    and read as plain files."""
    spark = df.sparkSession
    own = f"{name}-{uuid.uuid4().hex}"
    path, table = f"{shared_dir(spark)}/{own}", own.replace("-", "_")
    df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    atexit.register(_remove, spark, path)
    by_bucket = spark.table(table)
    by_bucket.schema  # resolved here; the name is not needed any more, the files stay
    spark.sql(f"DROP TABLE {table}")
    return by_bucket, spark.read.schema(df.schema).parquet(path)


def discard(*written: DataFrame) -> None:
    """Delete tables of materialize that nothing will read again."""
    for df in written:
        held = _written.pop(id(df), None)
        if held:
            _remove(df.sparkSession, held[1])


def local_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder below the shared one, for stores that name and rename their files themselves. It needs a
    shared file system with a path; stores of objects can't rename."""
    top = shared_dir(spark)
    if not top.startswith(("file:", "/")):
        raise ValueError(f"{top} is not a folder with a path")
    path = os.path.join("/" + top.removeprefix("file:").lstrip("/"), f"{name}-{uuid.uuid4().hex}")
    atexit.register(_remove, spark, f"file://{path}")
    return path
