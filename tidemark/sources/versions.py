"""Versioned, immutable datasets of bars in a folder that all of a cluster reaches.

A version is built in a hidden folder and appears by one rename; readers never
see part of it. Bars lie by symbol. Next to them are the members (rows, first and
last bar), each file's SHA-256 digest, taken by tasks from the files as they
lie, and the splits. An accumulating build takes the last version's rows too,
new ones winning. The test split is locked: reading it must be allowed, and each
such read is recorded with its note in the dataset's ledger.
"""

from __future__ import annotations

import json
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("train", "validation", "test")


class Dataset:
    """The versions of one dataset below ``root``; ``train`` and ``validation`` are the last dates of these splits."""

    def __init__(self, spark: SparkSession, root: str, name: str, train: str = "1998-12-31", validation: str = "2000-06-30"):
        self.spark, self.name, self.folder = spark, name, f"{root.rstrip('/')}/{name}"
        self.ends = {"train": train, "validation": validation}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Numbers of the finished versions, in order."""
        fs, path = self._fs(self.folder)
        if not fs.exists(path):
            return []
        return sorted(int(m[1]) for s in fs.listStatus(path) if (m := re.fullmatch(r"v(\d+)", s.getPath().getName())))

    def resolve(self, version: int | None = None) -> str:
        """The folder of a version, by default the last."""
        known = self.versions()
        version = version if version is not None or not known else known[-1]
        if version not in known:
            raise LookupError(f"{self.name} has versions {known}, not {version}")
        return f"{self.folder}/v{version}"

    def build(self, bars: DataFrame, accumulate: bool = False) -> int:
        """Write the bars as a new version and return its number. Of rows of one symbol and time the last version's go first, else the one whose values sort highest stays."""
        known = self.versions()
        rows = bars.withColumn("_new", F.lit(1))
        if accumulate and known:
            rows = self.spark.read.parquet(f"{self.resolve()}/bars").select(bars.columns).withColumn("_new", F.lit(0)).unionByName(rows)
        values = F.struct("_new", *[c for c in bars.columns if c not in ("symbol", "time")])
        rows = rows.groupBy("symbol", "time").agg(F.max(values).alias("v")).select("symbol", "time", "v.*").drop("_new")
        part = f"{self.folder}/.{uuid.uuid4().hex}.partial"
        # a symbol's bars may be many files, cut by time, so that a long history is not one task
        spread = F.pmod(F.xxhash64(F.date_trunc("year", "time")), F.lit(16))
        rows.repartition("symbol", spread).sortWithinPartitions("symbol", "time").write.partitionBy("symbol").option("compression", "zstd").parquet(f"{part}/bars")
        built = self.spark.read.schema(rows.schema).parquet(f"{part}/bars")
        if built.isEmpty():
            fs, path = self._fs(part)
            fs.delete(path, True)
            raise ValueError("no rows to build from")
        members = built.groupBy(F.col("symbol").cast("string").alias("symbol")).agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("first_bar"), F.max("time").alias("last_bar"))
        members.write.parquet(f"{part}/members")
        self._digests(part).write.parquet(f"{part}/files")
        for number in range(known[-1] + 1 if known else 1, 1 << 30):
            fs, source = self._fs(part)
            target = self._fs(f"{self.folder}/v{number}")[1]
            if not fs.exists(target) and fs.rename(source, target):  # another build may have taken the number
                return number

    def _digests(self, folder: str) -> DataFrame:
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(f"{folder}/bars")
        return files.select(F.regexp_extract("path", r".*/bars/(.*)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))

    def verify(self, version: int | None = None) -> DataFrame:
        """(file, status): ok, changed, missing or added, for every file of a version or now in its folder."""
        folder = self.resolve(version)
        then = self.spark.read.parquet(f"{folder}/files").select("file", F.col("sha256").alias("was"))
        now = self._digests(folder).select("file", F.col("sha256").alias("is"))
        status = F.when(F.col("is").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("is") == F.col("was"), "ok").otherwise("changed")
        return then.join(now, "file", "full").select("file", status.alias("status"))

    def load(self, version: int | None = None, split: str | None = None, allow_test: bool = False, note: str = "") -> DataFrame:
        """The bars of a version: of a split, of several joined by +, or all."""
        folder, wanted = self.resolve(version), split.split("+") if split else list(SPLITS)
        if not set(wanted) <= set(SPLITS):
            raise ValueError(f"splits are {', '.join(SPLITS)}")
        if "test" in wanted:
            if not allow_test:
                raise PermissionError(f"the test split of {self.name} is held out; allow_test opens it and is recorded")
            self._record(folder, "+".join(wanted), note)
        bars = self.spark.read.parquet(f"{folder}/bars").withColumn("symbol", F.col("symbol").cast("string"))
        day, a, b = F.to_date("time"), F.lit(self.ends["train"]).cast("date"), F.lit(self.ends["validation"]).cast("date")
        inside = {"train": day <= a, "validation": (day > a) & (day <= b), "test": day > b}
        keep = F.lit(False)
        for s in wanted:
            keep = keep | inside[s]
        return bars.where(keep)

    def _record(self, folder: str, split: str, note: str) -> None:
        line = json.dumps({"at": int(time.time()), "version": folder.rsplit("/", 1)[-1], "split": split, "note": note})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.folder}/ledger")

    def ledger(self) -> DataFrame:
        """(at, version, split, note) of every read of the test split, in order."""
        fs, path = self._fs(f"{self.folder}/ledger")
        kind = "at long, version string, split string, note string"
        if not fs.exists(path):
            return self.spark.createDataFrame([], kind)
        lines = self.spark.read.text(f"{self.folder}/ledger")
        return lines.select(F.from_json("value", kind).alias("x")).select("x.*").orderBy("at", "note")
