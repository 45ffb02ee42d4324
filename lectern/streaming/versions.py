"""A keyed table kept as a snapshot and the batches since, named by numbered manifests.

A manifest is a small JSON file: the snapshot's folder, the folders of later batches in order,
and the number of the last batch. Data is written first and named after, by putting a complete
manifest in its place under a number of its own; so readers, who take the highest number, always
see a whole version, and a run that dies before that leaves folders that nothing names. When
``most`` batches have come together they are merged into a new snapshot, without deleted rows.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ..operators.sync import latest

#: Batches that are merged, and manifests that stay for readers of older versions.
MOST, KEPT = 8, 3


class Versions:
    """``schema`` has the key ``path`` and ``action`` (a ``delete`` ends a row); ``version`` and ``batch`` are added."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, most: int = MOST):
        self.spark, self.folder, self.most = spark, folder.rstrip("/"), most
        self.schema = StructType([f for f in schema.fields if f.name not in ("version", "batch")]).add("version", LongType()).add("batch", LongType())
        self._at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._files = self._at("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The manifests that are there, by number."""
        if not self._files.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(self._at("manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, number: int | None = None) -> dict[str, Any]:
        numbers = self.numbers()
        if not numbers:
            return {"number": 0, "snapshot": None, "batches": [], "last": -1}
        said = self.spark.read.text(f"{self.folder}/manifests/{numbers[-1] if number is None else number:012}.json", wholetext=True).first()[0]
        return json.loads(said)

    def _name(self, manifest: dict[str, Any]) -> None:
        """Put a complete manifest in its place; the place of a number is taken once only."""
        text = json.dumps(manifest)
        hidden = f"manifests/.{uuid.uuid4().hex}"
        out = self._files.create(self._at(hidden), False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._files.rename(self._at(hidden), self._at(f"manifests/{manifest['number']:012}.json")):
            raise RuntimeError(f"version {manifest['number']} of {self.folder} has been written by another run")

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/{n}" for n in names])

    def rows(self, manifest: dict[str, Any] | None = None, only: DataFrame | None = None) -> DataFrame:
        """The newest row of each key in a version, without deleted ones. ``only`` (a table of ``path``) asks for some keys; others are not brought together."""
        manifest = manifest or self.manifest()
        parts = ([manifest["snapshot"]] if manifest["snapshot"] else []) + manifest["batches"]
        rows = self._read(parts)
        if only is not None:
            rows = rows.join(only.select("path").distinct(), "path", "left_semi")
        rows = rows if not manifest["batches"] else latest(rows, ["path"], F.col("batch"))
        return rows.where("action <> 'delete'")

    def add(self, batch: DataFrame, number: int) -> bool:
        """Add the rows of a batch (with ``version``). A batch whose number is not beyond the last one has been added before and is left out."""
        manifest = self.manifest()
        if number <= manifest["last"]:
            return False
        name = f"data/batch-{number}-{uuid.uuid4().hex}"
        batch.withColumn("batch", F.lit(number).cast("long")).select([f.name for f in self.schema.fields]).write.parquet(f"{self.folder}/{name}")
        self._name(manifest | {"number": manifest["number"] + 1, "batches": [*manifest["batches"], name], "last": number})
        if len(manifest["batches"]) + 1 >= self.most:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge the batches into a new snapshot, name it, and delete what no kept manifest names."""
        manifest = self.manifest()
        if manifest["batches"]:
            name = f"data/snapshot-{uuid.uuid4().hex}"
            self._write(manifest, name)
            self._name(manifest | {"number": manifest["number"] + 1, "snapshot": name, "batches": []})
        self.clean()

    def _write(self, manifest: dict[str, Any], name: str) -> None:
        self.rows(manifest).write.parquet(f"{self.folder}/{name}")

    def clean(self) -> None:
        """Delete manifests but the newest ``KEPT``, and data that these do not name. Only the one writer calls it."""
        numbers = self.numbers()
        for number in numbers[:-KEPT]:
            self._files.delete(self._at(f"manifests/{number:012}.json"), False)
        named: set[str] = set()
        for number in numbers[-KEPT:]:
            manifest = self.manifest(number)
            named |= {*manifest["batches"], manifest["snapshot"]}
        if self._files.exists(self._at("data")):
            for status in self._files.listStatus(self._at("data")):
                if f"data/{status.getPath().getName()}" not in named:
                    self._files.delete(status.getPath(), True)
