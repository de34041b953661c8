"""Tables that change as a whole: readers see one version of all of them, the old or the new, never a mixture.

A version is a folder of Parquet tables. What makes it the current one is a small numbered manifest, written beside the
tables and renamed into place after all of them are complete; a rename that finds the number taken fails, so of two writers
one loses and changes nothing. A run that dies before the rename leaves a folder that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer made the next version first."""


class Versions:
    """The versions of the tables under a folder, in whatever store Spark reaches by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path))]
        return sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-") and n.removeprefix("manifest-").isdigit())

    def current(self) -> int:
        """The number of the current version, 0 if there is none."""
        return max(self._numbers(), default=0)

    def _manifest(self, number: int) -> dict:
        text = self.spark.read.text(f"{self.path}/manifest-{number}", wholetext=True).first()
        return json.loads(text[0])

    def tables(self, number: int | None = None) -> dict[str, DataFrame]:
        """All tables of one version, the current one if no number is given."""
        number = self.current() if number is None else number
        return {name: self.spark.read.parquet(f"{self.path}/{folder}") for name, folder in self._manifest(number).items()} if number else {}

    def commit(self, tables: dict[str, DataFrame], after: int | None = None) -> int:
        """Makes tables the next version, those not given staying as they are; after: the version that they were made from."""
        base = self.current() if after is None else after
        folder = f"data-{uuid.uuid4().hex}"
        made = dict(self._manifest(base)) if base else {}
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}/{name}")
            made[name] = f"{folder}/{name}"
        draft = self._at(f"{self.path}/{folder}/manifest")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(made).encode()))
        out.close()
        final = self._at(f"{self.path}/manifest-{base + 1}")
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise Conflict(f"version {base + 1} exists")
        return base + 1
