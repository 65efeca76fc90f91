"""Assessment over arriving data: an extension, the batch operators have no streaming counterpart to match.

Request logs arrive as a stream; budgets are kept per asset in state that holds two
numbers, and windows count classifications with a watermark for late rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import fixed
from ..functions.access import classify_access


def windowed_access(log: DataFrame, time_col: str = "ts", late: str = "10 minutes", width: str = "30 minutes") -> DataFrame:
    """Requests by window and classification; rows later than ``late`` are left out by the watermark."""
    found = log.withWatermark(time_col, late).withColumn("classification", classify_access(F.col("stage"), F.col("status_code"), F.lit(None).cast("string")))
    counted = found.groupBy(F.window(time_col, width), "classification").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    return counted.select(F.col("window.start").alias("start"), "classification", "n", "bytes")


def breach_stream(log: DataFrame, byte_cap: int = fixed.MAX_BYTES) -> DataFrame:
    """(``asset_id``, ``seq``, ``total_bytes``): emitted once per asset, when its bytes pass the cap.

    Rows of one trigger are taken in the order of ``seq``.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, done = state.get if state.exists else (0, False)
        rows = pd.concat(list(batches)).sort_values("seq")
        found = []
        if not done:
            running = rows["bytes"].fillna(0).astype("int64").cumsum() + total
            over = (running > byte_cap).to_numpy()
            total = int(running.iloc[-1])
            if over.any():
                at, done = int(over.argmax()), True
                found = [(key[0], int(rows["seq"].iloc[at]), int(running.iloc[at]))]
        state.update((total, done))
        yield pd.DataFrame(found, columns=["asset_id", "seq", "total_bytes"])

    grouped = log.select("asset_id", "seq", "bytes").groupBy("asset_id")
    return grouped.applyInPandasWithState(step, "asset_id string, seq long, total_bytes long", "total long, done boolean", "append", GroupStateTimeout.NoTimeout)


def assess_arrivals(variables: DataFrame, path: str, checkpoint: str):
    """Grade variables as their inventory files arrive; each micro-batch is written once."""
    from ..operators.sampling import assess_chunking

    def write(batch: DataFrame, number: int) -> None:
        assess_chunking(batch).select("asset_id", "ordinal", "name", "mb", "grade").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return variables.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
