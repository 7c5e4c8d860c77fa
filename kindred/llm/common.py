"""Small helpers that the operators of this package share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Session settings of these operators. Texts may be long, so Arrow batches are bounded by bytes too; shuffle
#: files go when the statement that made them ends, as what is read later is written by cut().
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    # What cut() writes is compressed: without this, tables many times the broadcast threshold would be broadcast.
    "spark.sql.sources.fileCompressionFactor": "6.0",
}

_shipped: set[str] = set()
_cuts: dict[str, SparkSession] = {}
_trims: dict[str, Callable[[], str | None]] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Make the settings and see to it that Python workers can import this package."""
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    top = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app not in _shipped and str(top) not in os.environ.get("PYTHONPATH", "").split(":"):
        to = Path(tempfile.mkdtemp()) / "kindred.zip"
        with zipfile.ZipFile(to, "w") as z:
            for p in (top / "kindred").rglob("*.py"):
                z.write(p, p.relative_to(top))
        spark.sparkContext.addPyFile(str(to))
    _shipped.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share. A local one is made only where all of Spark is one process and names none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='kindred-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends, lost executors cost nothing.

    The files go when the process that made them ends, or at once by drop()."""
    spark = prepare(df.sparkSession)
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    if not _cuts:
        atexit.register(_drop_all)
    _cuts[at] = spark
    trim(spark)
    out = spark.read.schema(df.schema).parquet(at)
    out._kindred_cut = at
    return out


def trim(spark: SparkSession) -> str | None:
    """Have the driver's C library give freed memory back to the machine.

    Every statement's compilers and codecs run in other threads of the driver's JVM, each of which has an arena of the C
    library, and what is freed there stays taken: hundreds of MB after some hundred statements. A JVM without such a command
    is left as it is."""
    app = spark.sparkContext.applicationId
    if app not in _trims:
        _trims[app] = _trimmer(spark)
    return _trims[app]()


def _trimmer(spark: SparkSession) -> Callable[[], str | None]:
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        (invoke,) = [m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke"]
        call = gateway.new_array(jvm.java.lang.Object, 4)
        call[0], call[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, call)
    except Exception:  # another JVM or C library
        return lambda: None
    return lambda: invoke.invoke(server, call)


def drop(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these very tables. Nothing that reads them may be run afterwards."""
    for df in tables:
        at = getattr(df, "_kindred_cut", None)
        if _cuts.pop(at, None) is not None:
            _delete(df.sparkSession, at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _drop_all() -> None:
    for at, spark in list(_cuts.items()):
        with contextlib.suppress(Exception):  # the session may have been stopped
            _delete(spark, at)


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z and nothing else."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks, case ignored."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name
