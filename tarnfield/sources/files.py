"""Text sources with declared schemas, ordered and versioned sinks, and atomic publication of small artifacts."""

from __future__ import annotations

import csv
import hashlib
import json
import os
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnfield.schema import check_header


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with exactly the declared header; malformed values fail."""
    check_header(spark.read.option("header", True).csv(path).columns, schema)
    return spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines; lines that do not parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ingest_csv(spark: SparkSession, sources: list[str], folder: str, schema: T.StructType) -> tuple[DataFrame, int]:
    """(all rows taken in so far, how many sources were skipped): each CSV source becomes a folder of its own, which counts
    once its success mark is there; a run that is repeated or was broken off goes on with the others. A source counts
    as the same by its path."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf, targets, skipped = spark.sparkContext._jsc.hadoopConfiguration(), [], 0
    for source in sources:
        target = f"{folder}/{hashlib.sha256(source.encode()).hexdigest()[:16]}"
        mark = fs_path(f"{target}/_SUCCESS")
        if mark.getFileSystem(conf).exists(mark):
            skipped += 1
        else:
            read_csv(spark, source, schema).write.mode("overwrite").parquet(target)
        targets.append(target)
    return spark.read.schema(schema).parquet(*targets), skipped


def with_renamed(df: DataFrame, choices: Mapping[str, Iterable[str]]) -> DataFrame:
    """Each name taken from the first of its candidate columns that exists; a name without one fails."""
    found = {}
    for name, candidates in choices.items():
        found[name] = next((c for c in candidates if c in df.columns), None)
        if found[name] is None:
            raise ValueError(f"no column for {name}")
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in found.items()))


def sample_rows(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """Repeatable Bernoulli sample of rows."""
    return df.sample(withReplacement=False, fraction=percent / 100, seed=seed)


def publish(files: Mapping[str, str | bytes]) -> None:
    """Write small artifacts so that either all of them appear complete or none changes."""
    made: list[tuple[str, str]] = []
    backups: list[tuple[str, str | None]] = []
    try:
        for path, data in files.items():
            tmp = f"{path}.tmp-{os.getpid()}"
            with open(tmp, "wb") as f:
                f.write(data.encode() if isinstance(data, str) else data)
                f.flush()
                os.fsync(f.fileno())
            made.append((tmp, path))
        for tmp, path in made:
            backup = f"{path}.old-{os.getpid()}" if os.path.exists(path) else None
            if backup:
                os.replace(path, backup)
            backups.append((path, backup))
            os.replace(tmp, path)
    except BaseException:
        for path, backup in reversed(backups):
            if backup:
                os.replace(backup, path)
            elif os.path.exists(path):
                os.remove(path)
        for tmp, _ in made:
            if os.path.exists(tmp):
                os.remove(tmp)
        raise
    for _, backup in backups:
        if backup:
            os.remove(backup)


def publish_rows(path: str, rows: list[dict]) -> None:
    """A small CSV, published atomically."""
    import io

    out = io.StringIO()
    writer = csv.DictWriter(out, list(rows[0]) if rows else [], lineterminator="\n")
    writer.writeheader()
    writer.writerows(rows)
    publish({path: out.getvalue()})


class VersionedTable:
    """A table as a folder of versions with a manifest; a new version is visible once the manifest names it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        os.makedirs(folder, exist_ok=True)

    @property
    def _manifest(self) -> str:
        return f"{self.folder}/manifest.json"

    @property
    def version(self) -> int:
        return json.load(open(self._manifest))["version"] if os.path.exists(self._manifest) else 0

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/v{version or self.version}")

    def write(self, df: DataFrame, order: list[str] | None = None) -> int:
        """Next version: the whole content (so reads of older ones go on undisturbed)."""
        n = self.version + 1
        out = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        out.write.mode("overwrite").parquet(f"{self.folder}/v{n}")
        publish({self._manifest: json.dumps({"version": n, "columns": df.columns, "digest": hashlib.sha256(str(df.schema).encode()).hexdigest()})})
        return n

    def mutate(self, *, insert: DataFrame | None = None, delete: str | None = None, update: dict[str, str] | None = None, where: str = "true", truncate: bool = False) -> int:
        """INSERT, DELETE, UPDATE or TRUNCATE as a new version."""
        now = self.read()
        if truncate:
            now = now.limit(0)
        if delete:
            now = now.where(~F.coalesce(F.expr(delete), F.lit(False)))
        if update:
            hit = F.coalesce(F.expr(where), F.lit(False))
            now = now.select(*(F.when(hit, F.expr(update[c])).otherwise(F.col(c)).cast(t).alias(c) if c in update else F.col(c) for c, t in now.dtypes))
        if insert is not None:
            now = now.unionByName(insert)
        return self.write(now)
