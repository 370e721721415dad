"""Session defaults, and shipping of this package to executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on every executor; done once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    where = Path(tempfile.mkdtemp(prefix="quarry-")) / "quarry_package.zip"
    with zipfile.ZipFile(where, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(where))
    _shipped.add(sc.applicationId)


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share, as spark.checkpoint.dir names it; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not named and not held.isDefined() and not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("on a cluster, spark.checkpoint.dir has to name a folder that all executors share")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="quarry-"))
    return named or spark.sparkContext._jsc.sc().getCheckpointDir().get()


def stamp(spark: SparkSession, *paths: str) -> str:
    """What the files at these paths are: their names, lengths and times of change, as a short digest; read by Spark's own file systems."""
    jvm, found = spark.sparkContext._jvm, []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        each = fs.listFiles(where, True)
        while each.hasNext():
            f = each.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:24]


_stored: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The folder that build(path) filled, in the shared folder; built once per application and name, which has to say what it was built from."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        path = f"{scratch_dir(spark).rstrip('/')}/quarry-stored-{name}-{uuid.uuid4().hex}"
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
        build(path)
        _stored[key] = path
    return _stored[key]


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut in the shared folder."""
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read from there; unlike cut(), it carries no constraints or sizes of the plan that made it, which grow from round to round."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/quarry-table-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def sparing(spark: SparkSession) -> Iterator[None]:
    """In here, the files of a shuffle go when the action that made them has ended, not when the driver next sweeps its memory."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def build(app: str = "quarry", cpus: str | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster's own settings win over these."""
    b = SparkSession.builder.appName(app).master(f"local[{cpus or os.environ.get('BENCH_CPUS', '8')}]")
    defaults = {"spark.sql.shuffle.partitions": "8", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.adaptive.enabled": "true", "spark.ui.showConsoleProgress": "false"}
    for k, v in (defaults | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
