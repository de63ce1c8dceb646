"""Streams: queries over them are left as they are; indexes can follow what they write."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..dataset import SkipDataset


def refreshing_sink(dataset: SkipDataset, format: str = "parquet", every: int = 1, partition_by: list[str] | None = None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: append each batch to the dataset's path and refresh its index every
    so many batches. Files of batches in between are not indexed yet, and so always read."""

    def write(batch: DataFrame, batch_id: int) -> None:
        writer = batch.write.mode("append").format(format)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(dataset.uri)
        if batch_id % every == 0 and dataset.is_indexed():
            dataset.refresh_index(dataset.spark.read.format(format))

    return write
