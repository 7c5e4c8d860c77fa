"""Stages on shared storage: tables that are written once and read again as long as what they are made from is the same."""

from __future__ import annotations

import atexit
import contextlib
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where all of Spark is one process.

    What is read later is written there, so from now on shuffle files go when the statement that made them ends."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='kindred-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Files:
    """A few file operations wherever Spark can reach."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def state(self, path: str) -> list[str]:
        """Name, length and time of change of each file at or below a path."""
        p, fs = self._at(path)
        out, it = [], fs.listFiles(p, True)
        while it.hasNext():
            s = it.next()
            out.append(f"{s.getPath()} {s.getLen()} {s.getModificationTime()}")
        return sorted(out)

    def read(self, path: str) -> bytes:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, path: str, data: bytes) -> None:
        p, fs = self._at(path)
        stream = fs.create(p, True)
        try:
            stream.write(data)
        finally:
            stream.close()

    def move(self, old: str, new: str) -> None:
        p, fs = self._at(old)
        to = self._at(new)[0]
        fs.mkdirs(to.getParent())
        if not fs.rename(p, to):
            raise OSError(f"{old} can't be moved to {new}")

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def digest(self, path: str, block: int = 1 << 22) -> str:
        """SHA-256 of a file's bytes, read a block at a time."""
        p, fs = self._at(path)
        h, left, stream = hashlib.sha256(), fs.getFileStatus(p).getLen(), fs.open(p)
        try:
            while left:
                n = min(block, left)
                h.update(bytes(stream.readNBytes(n)))
                left -= n
        finally:
            stream.close()
        return h.hexdigest()


def fingerprint(*parts: str) -> str:
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


@cache
def code_state() -> str:
    """A digest of the library's own code: stages of another version are made anew."""
    top = Path(__file__).resolve().parents[1]
    return fingerprint(*(x for d in ("functions", "operators", "sources", "plans") for p in sorted((top / d).glob("*.py")) for x in (p.name, p.read_text())))


_written: dict[str, SparkSession] = {}


def _clear() -> None:
    for at, spark in _written.items():
        with contextlib.suppress(Exception):  # the session may have been stopped
            Files(spark).delete(at)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, which ends its lineage. The files go when the process ends."""
    spark = df.sparkSession
    at = f"{shared_root(spark)}/written-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    if not _written:
        atexit.register(_clear)
    _written[at] = spark
    return spark.read.schema(df.schema).parquet(at)


def session_root(spark: SparkSession) -> str:
    """A folder of this session's own under the shared one; it goes when the process ends."""
    at = f"{shared_root(spark)}/kindred-{spark.sparkContext.applicationId}"
    if not _written:
        atexit.register(_clear)
    _written[at] = spark
    return at


class Store:
    """Stages by name under a folder, which one process at a time may write. A stage is done if its manifest, written last, has the fingerprint of what it
    would be made from now; else it is made beside the old one, moved into place, and what it replaces is deleted."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.files = spark, Files(spark)
        self.root = (root or f"{shared_root(spark)}/kindred-stages").rstrip("/")

    def manifest(self, name: str) -> dict:
        """What is known of a stage; empty if there is none or its manifest can't be read."""
        with contextlib.suppress(Exception):
            return json.loads(self.files.read(f"{self.root}/{name}/manifest.json"))
        return {}

    def table(self, name: str, parts: Iterable[str], make: Callable[[], DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
        """The stage `name`, made by `make` unless it is there, made from the same `parts`. `by`: columns that its folders go by."""
        print_ = fingerprint(code_state(), *parts)
        known = self.manifest(name)
        if known.get("fingerprint") != print_:
            fresh, place = make(), f"{print_[:16]}-{uuid.uuid4().hex[:8]}"
            beside = f"{self.root}/.new-{uuid.uuid4().hex}"
            writer = fresh.write.option("compression", "zstd")
            (writer.partitionBy(*by) if by else writer).parquet(beside)
            self.files.move(beside, f"{self.root}/{name}/{place}")
            known = {"fingerprint": print_, "at": place, "schema": fresh.schema.json()}
            self.files.write(f"{self.root}/{name}/manifest.json", json.dumps(known).encode())
            self.prune(name, {place, "manifest.json"})
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(known["schema"]))).parquet(f"{self.root}/{name}/{known['at']}")

    def prune(self, name: str, keep: set[str]) -> list[str]:
        """Delete what stands in a stage's folder and is not to be kept; the names deleted."""
        gone = [n for n in self.files.names(f"{self.root}/{name}") if n not in keep and not n.endswith(".crc")]
        for n in gone:
            self.files.delete(f"{self.root}/{name}/{n}")
        return gone

    def report(self, name: str, values: dict) -> dict:
        """Write a report of a stage as JSON; the values as they were given."""
        self.files.write(f"{self.root}/reports/{name}.json", json.dumps(values, indent=2, default=str).encode())
        return values

    def read_report(self, name: str) -> dict:
        return json.loads(self.files.read(f"{self.root}/reports/{name}.json"))
