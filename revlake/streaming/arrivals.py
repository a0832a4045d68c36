"""Comparisons of revision pairs as they arrive: an extension for standing jobs.

A streaming source announces pairs by name; each micro-batch compares the pairs it names and appends the results. Batch ids
make a batch that is run again replace what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.compare import compare
from ..settings import DEFAULTS, Settings
from ..sources.tables import RawTables


def compare_arrivals(arrivals: DataFrame, raw_path: str, out_path: str, checkpoint: str, settings: Settings = DEFAULTS, trigger: dict | None = None) -> StreamingQuery:
    """arrivals: a streaming DataFrame with pair_id. Writes changes and comparisons under out_path, partitioned by batch."""

    def batch(df: DataFrame, batch_id: int) -> None:
        pairs = sorted({r.pair_id for r in df.select("pair_id").distinct().toLocalIterator()})  # names of one micro-batch
        if not pairs:
            return
        result = compare(RawTables.read(df.sparkSession, raw_path, pairs), settings, strict=False)
        for name, table in (("changes", result.changes), ("comparisons", result.comparisons)):
            table.write.mode("overwrite").parquet(f"{out_path}/{name}/batch={batch_id}")

    return arrivals.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
