"""A keyed table as an append-only log of versions: a commit writes only the rows it adds or changes.

    <path>/log/000000000007.json   one line: version, kind, folder, rows, added, seen, note
    <path>/data/<uuid>/            the rows of that commit, as Parquet

A version exists from the moment its log file has its name. The file is written under another
name and renamed without overwriting, so of two writers that started from one version one fails
(:class:`Conflict`) and starts again from the new state; what it wrote is named by no log file
and is never read. The rename is atomic on HDFS; a file system without atomic renames needs one
writer at a time. A reader takes the last snapshot and the commits after it, at most ``every``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ENTRY = "version long, kind string, folder string, rows long, added long, seen long, note string"


class Conflict(Exception):
    """Another writer has committed this version."""


class VersionLog:
    """``schema`` has a column ``key`` that is unique and never null. Kinds of commits: ``add`` (new keys),
    ``change`` (whole new rows of known keys), ``snapshot`` (the whole table as it stands)."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, every: int = 20) -> None:
        self.spark, self.path, self.every = spark, path.rstrip("/"), every
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def entries(self) -> DataFrame:
        """All commits, one row each; empty before the first."""
        try:
            return self.spark.read.schema(ENTRY).option("pathGlobFilter", "*.json").json(f"{self.path}/log")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], ENTRY)

    def version(self) -> int:
        return self.entries().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def _in_force(self, version: int) -> list[Row]:
        """The last snapshot up to a version and what follows it; about ``every`` rows."""
        upto = self.entries().filter(F.col("version") <= version)
        start = upto.filter("kind = 'snapshot'").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]
        return upto.filter(F.col("version") >= start).orderBy("version").collect()

    def _rows(self, found: Sequence[Row]) -> DataFrame:
        """The rows of some commits with the version that wrote them."""
        schema = StructType(list(self.schema)).add("_version", "long")
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{e.folder}" for e in found])

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version, by default the newest. Only changed keys are shuffled; where there are none,
        the commits are one scan."""
        version = self.version() if version is None else version
        found = self._in_force(version)
        changed = self._rows([e for e in found if e.kind == "change"])
        rows = self._rows([e for e in found if e.kind != "change"]).drop("_version")
        if all(e.kind != "change" for e in found):
            return rows
        value = F.max_by(F.struct(*[F.col(f"`{c}`") for c in self.schema.names]), "_version")
        last = changed.groupBy(F.col("key").alias("_k")).agg(value.alias("_row"))
        return rows.join(last.select("_k"), F.col("key") == F.col("_k"), "left_anti").unionByName(last.select("_row.*"))

    def existing(self, keys: DataFrame, version: int) -> DataFrame:
        """Which of ``keys`` (column key) are in the table: only its key column is read, and it is shuffled
        only where Spark finds the keys asked for too large to broadcast."""
        known = self._rows([e for e in self._in_force(version) if e.kind != "change"]).select("key")
        return known.join(keys.select(F.col("key").alias("_k")), F.col("key") == F.col("_k"), "left_semi")

    def write(self, rows: DataFrame, version: int) -> tuple[str, int]:
        """Rows for a version that is yet to be committed; gives their folder and number."""
        folder = uuid.uuid4().hex
        path = f"{self.path}/data/{folder}"
        rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self.schema], F.lit(version).cast("long").alias("_version")).write.parquet(path)
        return folder, self.spark.read.parquet(path).count()

    def commit(self, version: int, kind: str, folder: str, rows: int, added: int = 0, seen: int = 0, note: str = "") -> int:
        """Claims the version; :class:`Conflict` where it is taken."""
        entry = dict(version=version, kind=kind, folder=folder, rows=rows, added=added, seen=seen, note=note)
        if not claim(self.spark, f"{self.path}/log", f"{version:012d}.json", json.dumps(entry)):
            raise Conflict(f"version {version} is taken")
        return version

    def compact(self, force: bool = False) -> int | None:
        """A snapshot as the next version once ``every`` commits follow the last one; None where it is not due or
        another writer came first (the next commit tries again)."""
        version = self.version()
        if not version or (not force and len(self._in_force(version)) <= self.every):
            return None
        folder, n = self.write(self.read(version), version + 1)
        try:
            return self.commit(version + 1, "snapshot", folder, n)
        except Conflict:
            return None


def claim(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Makes a file with a text, unless there is one of that name; whole or not at all."""
    fs = spark._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target, draft = fs.Path(f"{folder}/{name}"), fs.Path(f"{folder}/_{uuid.uuid4().hex}")
    files = target.getFileSystem(conf)
    files.mkdirs(target.getParent())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not files.exists(target):
        context = fs.FileContext.getFileContext(target.toUri(), conf)
        keep = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(target), keep)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
    files.delete(draft, False)
    return False
