"""Batches of rows through a Python function, with counts of successes and failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class BatchProcessor:
    """Runs ``fn`` on Arrow batches of at most ``batch_rows`` rows; a failing batch is counted, not raised.

    ``process`` gives one row a batch: (batch_rows, ok, error). Batches are run where their rows lie.
    """

    def __init__(self, batch_rows: int = 1000):
        self.batch_rows = max(1, batch_rows)

    def process(self, df: DataFrame, fn: Callable[[pa.RecordBatch], object]) -> DataFrame:
        size = self.batch_rows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, held = [], []

            def one(batch: pa.RecordBatch) -> tuple:
                try:
                    fn(batch)
                    return batch.num_rows, True, None
                except Exception as fault:
                    return batch.num_rows, False, f"{type(fault).__name__}: {fault}"

            waiting = 0
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    part = batch.slice(at, size - waiting)
                    held.append(part)
                    waiting += part.num_rows
                    at += part.num_rows
                    if waiting == size:
                        rows.append(one(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))
                        held, waiting = [], 0
            if held:
                rows.append(one(pa.Table.from_batches(held).combine_chunks().to_batches()[0]))
            if rows:
                n, ok, error = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(ok), pa.array(error, pa.string())], names=["batch_rows", "ok", "error"])

        return df.mapInArrow(run, "batch_rows bigint, ok boolean, error string")

    @staticmethod
    def summary(results: DataFrame) -> DataFrame:
        """(n_rows, n_success, n_error), in rows."""
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        return results.agg(total("batch_rows").alias("n_rows"), total(F.when(F.col("ok"), F.col("batch_rows"))).alias("n_success"), total(F.when(~F.col("ok"), F.col("batch_rows"))).alias("n_error"))
