"""A keyed table that stays as large as its live keys while batches are merged into it.

A version is a manifest: the folders that together hold the table, a merged base and the changes since. A batch writes a
folder of its own and then one manifest, whose creation is the swap; readers take the newest manifest. After ``deltas``
changes they are merged into a new base. A batch that is repeated changes nothing, a crash before the swap leaves the
old version, and its folders are overwritten when the batch comes again. Folders and manifests older than the newest
``kept`` versions are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class CurrentTable:
    """``merge`` reduces rows of several versions of a key to the newest; it must not depend on their order."""

    def __init__(self, path: str, merge: Callable[[DataFrame], DataFrame], deltas: int = 8, kept: int = 2):
        self.path, self.merge, self.deltas, self.kept = path.rstrip("/"), merge, deltas, kept

    def _files(self, spark: SparkSession):
        jvm = spark._jvm
        at = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        return at("").getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _numbers(self, spark: SparkSession) -> list[int]:
        """Numbers of the manifests; there are ``kept`` of them, and one more while a batch is written."""
        fs, at = self._files(spark)
        if not fs.exists(at("manifests")):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("_"))

    def manifest(self, spark: SparkSession, number: int | None = None) -> dict | None:
        """The newest manifest, or that of a number: its version, the batch that made it and its folders."""
        numbers = self._numbers(spark)
        if not numbers:
            return None
        row = spark.read.text(f"{self.path}/manifests/{numbers[-1] if number is None else number:020d}.json", wholetext=True).first()
        return json.loads(row["value"])

    def _commit(self, spark: SparkSession, manifest: dict) -> None:
        fs, at = self._files(spark)
        waiting, final = at(f"manifests/_{manifest['version']:020d}"), at(f"manifests/{manifest['version']:020d}.json")
        out = fs.create(waiting, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(waiting, final):
            raise RuntimeError(f"version {manifest['version']} of {self.path} is there already: another writer?")

    def _expire(self, spark: SparkSession) -> None:
        fs, at = self._files(spark)
        numbers = self._numbers(spark)
        held = {f for n in numbers[-self.kept :] for f in self.manifest(spark, n)["folders"]}
        for n in numbers[: -self.kept]:
            fs.delete(at(f"manifests/{n:020d}.json"), False)
        for status in fs.listStatus(at("data")):
            if status.getPath().getName() not in held:
                fs.delete(status.getPath(), True)

    def _read(self, spark: SparkSession, folders: list[str]) -> DataFrame:
        return spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])

    def read(self, spark: SparkSession) -> DataFrame:
        """The newest version, one row a key."""
        now = self.manifest(spark)
        if now is None:
            raise FileNotFoundError(f"no version of {self.path} yet")
        return self.merge(self._read(spark, now["folders"]))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge a batch; for ``foreachBatch``. Batches come in the order of their numbers."""
        spark = batch.sparkSession
        now = self.manifest(spark) or {"version": 0, "batch_id": -1, "folders": []}
        if batch_id <= now["batch_id"]:
            return
        folders = [*now["folders"], f"{batch_id:020d}-change"]
        self.merge(batch).write.mode("overwrite").parquet(f"{self.path}/data/{folders[-1]}")
        if len(folders) > self.deltas + 1:
            base = f"{batch_id:020d}-base"
            self.merge(self._read(spark, folders)).write.mode("overwrite").parquet(f"{self.path}/data/{base}")
            folders = [base]
        self._commit(spark, {"version": now["version"] + 1, "batch_id": batch_id, "folders": folders})
        self._expire(spark)
