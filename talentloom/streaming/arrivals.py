"""Running a stream into files.

The sink writes one folder per micro-batch and overwrites it on a retry, so a batch that
runs twice after a failure leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from talentloom.session import new_folder


def run_to_parquet(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], output_mode: str = "append", path: str | None = None
) -> str:
    """Run what is available now; `work` turns each micro-batch into rows for `path`."""
    root = path or new_folder(stream.sparkSession)

    def write(batch: DataFrame, epoch: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{root}/rows/epoch={epoch}")

    running = (
        stream.writeStream.outputMode(output_mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{root}/progress")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return f"{root}/rows"
