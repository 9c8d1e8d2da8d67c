"""Tables laid out by batch, so that papers meet their batches and parts without moving."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Buckets of the tables that are joined by batch; all of them need the same number.
BUCKETS = 64


def bucketed(rows: DataFrame, name: str, path: str | None = None, key: str = "batch_id", buckets: int = BUCKETS) -> DataFrame:
    """Save ``rows`` as table ``name``, bucketed and sorted by ``key``, and read it back.

    Rows are dealt to the buckets before they are written, so a bucket is one file. Without ``path`` the table is
    in the warehouse.
    """
    writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return rows.sparkSession.table(name)
