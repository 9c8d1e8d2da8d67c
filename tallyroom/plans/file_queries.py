"""Queries that write files and read them back: released exports, and reference rows of JSON lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.plans import queries as Q
from tallyroom.sources import readers, scratch, writers


def _round_trip(name: str, of: str, columns: list[str], order: list[str], quote_all: bool = False) -> None:
    """Register a query that writes the report of query ``of`` and gives the cells of the files."""

    def run(spark: SparkSession, sf_dir: str, report: Callable[[SparkSession, str], DataFrame] = Q.QUERIES[of]) -> DataFrame:
        folder = scratch.new_folder(spark, name)
        writers.write_csv(report(spark, sf_dir).select(*columns), folder, order, quote_all, rows_per_file=5_000)
        return writers.read_csv(spark, folder, columns)

    Q._add(name, f"SELECT {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)} FROM ({Q.ORACLE_SQL[of]})", long=False)(run)


_SCORES = ["science", "mathematics", "mental_ability", "total", "correct", "blank"]
_round_trip("snk1_results_files", "snk1_export_results", ["batch_id", "student_number", *Q.FIELDS, *_SCORES, *(f"q{i}" for i in range(1, 26))], ["batch_id", "student_number"])
_round_trip("snk2_details_files", "snk2_export_student_details", ["batch_id", "student_number", "source_pages", "paper_id", *Q.FIELDS, *(f"{k}_status" for k in Q.FIELDS)], ["batch_id", "student_number"])
_DRAFT = ["import_id", "name", "school", "father_mobile", "mother_mobile", "marks", "grace", "details_status", "result_status"]
_round_trip("snk3_draft_files", "snk3_export_bulk_draft", _DRAFT, _DRAFT)
_RECORD = ["id", "name", "school", "father_phone", "mother_phone", "class_name", "marks", "status", "submitter_id", "created_at"]
_round_trip("snk4_records_files", "snk4_export_records", _RECORD, ["created_at", "id"], quote_all=True)


_FIELD = "(CASE o_orderkey % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'school' ELSE 'father_mobile' END)"
_BROKEN, _NUMBER, _NONE = "(o_orderkey % 13 = 0)", "(o_orderkey % 11 = 0)", "(o_orderkey % 7 = 0)"


def _lines(spark: SparkSession, sf_dir: str) -> str:
    """A folder of JSON lines, a reference for each order; some are cut off, some texts are numbers or null."""
    folder = scratch.new_folder(spark, "references")
    text = f"CASE WHEN {_NUMBER} THEN CAST(o_custkey AS STRING) WHEN {_NONE} THEN 'null' ELSE to_json(o_clerk_text) END"
    rows = Q._table(spark, sf_dir, "orders").withColumn("o_clerk_text", F.expr("concat('Clerk \"', o_custkey, '\"')"))
    text = text.replace("to_json(o_clerk_text)", "concat('\"', replace(o_clerk_text, '\"', '\\\\\"'), '\"')")
    line = F.concat(F.lit('{"student": "'), F.col("o_orderkey").cast("string"), F.lit('", "field": "'), F.expr(_FIELD), F.lit('", "text": '), F.expr(text), F.expr(f"CASE WHEN {_BROKEN} THEN '' ELSE '}}' END"))
    rows.select(line).write.text(folder)
    return folder


_READ = f"""lines AS (SELECT CASE WHEN NOT {_BROKEN} THEN CAST(o_orderkey AS VARCHAR) END AS student, CASE WHEN NOT {_BROKEN} THEN {_FIELD} END AS field,
 CASE WHEN NOT ({_BROKEN} OR {_NUMBER} OR {_NONE}) THEN 'Clerk "' || CAST(o_custkey AS VARCHAR) || '"' END AS text, CASE WHEN {_BROKEN} THEN 'no JSON' WHEN {_NUMBER} THEN 'text must be a string' END AS problem FROM orders)"""


@Q._add("src3_read_reference_rows", f"WITH {_READ} SELECT * FROM lines", long=False)
def read_reference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_reference_rows(spark, _lines(spark, sf_dir))
