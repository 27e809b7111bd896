"""The usage log with its partial aggregates beside it.

An append writes its events and their aggregates, both by day, and publishes them last by a commit row, so both always agree however
late events come. A period is answered from the aggregates of its days and the events of one hour.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope import schemas
from corpuscope.operators import rollups
from corpuscope.operators import usage as U
from corpuscope.sources.sinks import dealt


class UsageLog:
    TABLES = {"events": schemas.USAGE_EVENTS, "hours": rollups.COLUMNS}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _batches(self) -> DataFrame:
        try:
            return self.spark.read.schema("n BIGINT, batch STRING").option("basePath", f"{self.root}/commits").parquet(f"{self.root}/commits")
        except Exception as e:  # nothing appended yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "n BIGINT, batch STRING")

    def _read(self, name: str, batch: str | None = None) -> DataFrame:
        base = f"{self.root}/{name}"
        path = base if batch is None else f"{base}/batch={batch}"
        return self.spark.read.schema(f"{self.TABLES[name]}, day DATE, batch STRING").option("basePath", base).parquet(path)

    def append(self, events: DataFrame, batch: str | None = None) -> str:
        """Append usage events as one batch; a repeated batch replaces itself, or does nothing once it is committed."""
        batch = batch or uuid.uuid4().hex
        if not self._batches().filter(F.col("batch") == batch).isEmpty():
            return batch
        path = lambda name: f"{self.root}/{name}/batch={batch}"
        columns = [c.strip().split(" ")[0] for c in schemas.USAGE_EVENTS.split(",")]
        rows = events.select(*columns, F.to_date("ts").alias("day"))
        dealt(rows, "day").write.mode("overwrite").partitionBy("day").parquet(path("events"))
        hours = rollups.partials(self._read("events", batch)).withColumn("day", F.to_date("hour"))
        dealt(hours, "day").write.mode("overwrite").partitionBy("day").parquet(path("hours"))
        self.spark.range(1).select(F.col("id").alias("n")).coalesce(1).write.parquet(path("commits"))
        return batch

    def _committed(self, name: str) -> DataFrame:
        return self._read(name).join(self._batches().select("batch").distinct(), "batch", "left_semi")

    def events(self) -> DataFrame:
        return self._committed("events").drop("day", "batch")

    def partials(self, period: str | None, as_of: datetime | str) -> DataFrame:
        """Rows for the reports of ``rollups``: events later than the period's start, and those without a time."""
        start = U.window_start(period, as_of)
        first = F.date_trunc("hour", start)
        later = self._committed("hours").filter(((F.col("day") >= F.to_date(start)) & (F.col("hour") > first)) | F.col("day").isNull())
        edge = self._committed("events").filter((F.col("day") == F.to_date(start)) & (F.col("ts") > start) & (F.date_trunc("hour", "ts") == first))
        return later.drop("day", "batch").unionByName(rollups.partials(edge))
