"""Report files: written in the released order, and read back as they were written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyroom.operators.results import ordered_by_import

#: Quotes are doubled inside quoted cells; an empty text is quoted, a null is nothing.
_CSV = {"header": "true", "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
ROWS_PER_FILE = 1_000_000


def write_csv(report: DataFrame, path: str, order: list[str], quote_all: bool = False, rows_per_file: int = ROWS_PER_FILE) -> None:
    """CSV files with a header and CRLF line ends, ``rows_per_file`` rows each at most.

    The report is sorted by ranges of ``order``, so files in the order of their names have the rows in that order
    and no task holds more than a range.
    """
    writer = report.orderBy(*order).write.mode("overwrite").options(**_CSV)
    writer.option("quoteAll", quote_all).option("lineSep", "\r\n").option("maxRecordsPerFile", rows_per_file).csv(path)


def write_by_import(report: DataFrame, path: str) -> None:
    """One sorted folder per import, for reports too large for a global sort."""
    ordered_by_import(report).write.mode("overwrite").partitionBy("import_id").options(**_CSV).option("lineSep", "\r\n").csv(path)


def read_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The cells of written files as texts; line ends and quotes inside a cell are part of it."""
    # a cell of nothing is read as this value, so that a quoted empty text stays one
    return spark.read.options(**_CSV).option("multiLine", True).option("nullValue", "\x00").schema(", ".join(f"`{c}` STRING" for c in columns)).csv(path)
