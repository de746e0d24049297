"""Derived data kept by the content it was derived from."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class DerivedCache:
    """Rows derived from contents, in a folder that all executors share, by `key`: a digest of the content and of all that
    the derivation depends on beside it.

    A batch of new keys is written into a folder of its own and named in the manifest last, so one that dies halfway
    leaves no trace; what stands at the path is read anew at each call, whoever wrote it. One writer at a time: two may
    derive a key twice, and then the batch named first counts. Batches are not rewritten; `compact` joins them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batches(self) -> list[str]:
        try:
            rows = self.spark.read.schema("nth long, batch string, n_rows long").parquet(f"{self.path}/manifest").collect()  # a row for each batch
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        begins = max((r["nth"] for r in rows if r["n_rows"] < 0), default=-1)  # a compaction stands for all before it
        return [r["batch"] for r in sorted(rows, key=lambda r: r["nth"]) if r["nth"] >= begins]

    def _note(self, batch: str, n_rows: int) -> None:
        rows = self.spark.createDataFrame([(self._next(), batch, n_rows)], "nth long, batch string, n_rows long")
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def _next(self) -> int:
        try:
            return self.spark.read.schema("nth long, batch string, n_rows long").parquet(f"{self.path}/manifest").count()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0

    def held(self, schema: str) -> DataFrame:
        """All rows that are kept (key and the columns of `schema`)."""
        batches = self._batches()
        if not batches:
            return self.spark.createDataFrame([], f"key string, {schema}")
        return self.spark.read.schema(f"key string, {schema}").parquet(*[f"{self.path}/rows/{b}" for b in batches])

    def derive(self, inputs: DataFrame, function: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
        """The rows derived for every key of `inputs` (key, ...): those kept, and for other keys what `function` makes of
        their rows (key and the columns of `schema`, no row, one or several for a key), which is kept from now on.

        A key that `function` makes nothing of is not kept: it is tried again. Null keys are left out; inputs that share a
        key have the same content, and one of them is derived from.
        """
        wanted = inputs.where("key is not null").dropDuplicates(["key"])
        new = wanted.join(self.held(schema).select("key").distinct(), "key", "left_anti")
        batch = uuid.uuid4().hex
        function(new).select("key", *[c.strip().split()[0] for c in schema.split(", ")]).write.parquet(f"{self.path}/rows/{batch}")
        n = self.spark.read.parquet(f"{self.path}/rows/{batch}").count()
        if n:
            self._note(batch, n)
        return self.held(schema).join(wanted.select("key"), "key", "left_semi")

    def compact(self, schema: str) -> None:
        """Join all batches into one."""
        batch = uuid.uuid4().hex
        self.held(schema).write.parquet(f"{self.path}/rows/{batch}")
        self._note(batch, -1)


def content_key(content: str = "content", **depends_on: object):
    """The key of a content: its SHA-256 with all else the derivation depends on, by name."""
    rest = [F.lit(f"{k}={v}") for k, v in sorted(depends_on.items())]
    return F.sha2(F.concat_ws("|", F.sha2(F.col(content).cast("binary"), 256), *rest).cast("binary"), 256)
