"""Step tables and the run manifest: what a run has written and where."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_SCHEMA = "run_id int, step string, ts timestamp, payload string, metadata string"


class StepStore:
    """One Parquet table per step below a root folder, and one manifest for all steps.

    The table is written before its manifest row, so a row in the manifest always refers to
    a complete table, and a table without one counts as not written.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, run_id: int, step: str) -> str:
        return f"{self.root}/steps/step={step}/run={run_id}"

    def save(
        self, run_id: int, step: str, table: DataFrame, metadata: dict | None = None, append: bool = False
    ) -> None:
        path = self._path(run_id, step)
        table.write.mode("append" if append else "overwrite").parquet(path)
        self.note(run_id, step, path, metadata)

    def note(self, run_id: int, step: str, payload: str | None, metadata: dict | None = None) -> None:
        """Append a manifest row."""
        row = (run_id, step, dt.datetime.now(), payload, json.dumps(metadata or {}))
        self.spark.createDataFrame([row], MANIFEST_SCHEMA).write.mode("append").parquet(f"{self.root}/manifest")

    def load(self, run_id: int, step: str) -> DataFrame | None:
        return self.spark.read.parquet(self._path(run_id, step)) if self.exists(run_id, step) else None

    def exists(self, run_id: int, step: str) -> bool:
        noted = self.manifest().where((F.col("run_id") == run_id) & (F.col("step") == step))
        return bool(noted.agg(F.max_by(F.col("payload").isNotNull(), "ts")).first()[0])

    def withdraw(self, run_id: int, step: str) -> None:
        """From now on the step counts as not written, until it is saved again."""
        if self.exists(run_id, step):
            self.note(run_id, step, None, {"withdrawn": True})

    def manifest(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST_SCHEMA).parquet(f"{self.root}/manifest")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST_SCHEMA)


def save_result(table: DataFrame, path: str) -> None:
    """A result for people: text for a single string column, JSON lines otherwise."""
    if [f.dataType.simpleString() for f in table.schema] == ["string"]:
        table.write.mode("overwrite").text(path)
    else:
        table.write.mode("overwrite").json(path, ignoreNullFields=False)
