"""A stream of finished cases through the batch audit, a batch at a time.

An extension: each case comes whole (both sides in one row), so a batch needs nothing
from another, and a repeated batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.geometry import BOX
from ..operators.audit import audit

CASE = f"image_id long, findings array<struct<side:string,ord:int,finding:string,status:string,box:{BOX},span:string>>"


def audited_cases(cases: DataFrame) -> DataFrame:
    """The audit of each case; works on batches as on static tables."""
    return audit(cases.select("image_id", F.explode("findings").alias("f")).select("image_id", "f.*"), cases)


def start(cases: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit a stream of cases into Parquet, a folder for each batch."""

    def write(batch: DataFrame, number: int) -> None:
        audited_cases(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cases.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
