"""Scores, results and released exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions import score as S
from tallyroom.functions.text import spreadsheet_safe
from tallyroom.schemas import FIELDS


def _ready() -> F.Column:
    return S.details_ready(F.col("fields"), F.col("field_review"), F.col("pairing_verified"))


def with_score(papers: DataFrame) -> DataFrame:
    """PRJ1: papers with a score struct; null where answers or key are invalid."""
    return papers.withColumn("score", S.score_answers(F.col("answers"), F.col("key")))


def outcomes(papers: DataFrame) -> DataFrame:
    """PRJ2: one row per answer with its outcome."""
    rows = papers.select("paper_id", F.posexplode(F.arrays_zip("answers", "key")).alias("q", "x"))
    return rows.select("paper_id", (F.col("q") + 1).alias("question"), F.col("x.answers").alias("answer"), S.question_outcome(F.col("x.answers"), F.col("x.key")).alias("outcome"))


def with_parts(papers: DataFrame, parts: DataFrame, import_id: int | None = None, how: str = "inner") -> DataFrame:
    """``papers`` with import_id and start_page of their batch's part (import_id, batch_id, start_page).

    A batch is in one part at most. ``import_id`` cuts the parts before they are joined. Where both tables are
    bucketed by batch_id (``sources.layout``) neither side moves.
    """
    chosen = parts if import_id is None else parts.filter(F.col("import_id") == import_id)
    bare = papers.drop("import_id", "start_page")
    return bare.join(chosen.select("batch_id", "import_id", "start_page"), "batch_id", how)


def bulk_results(papers: DataFrame, parts: DataFrame, import_id: int | None = None) -> DataFrame:
    """JN2: the students of one import, or of all, with PRJ7, in the order of their pages."""
    return result_rows(with_parts(papers, parts, import_id)).orderBy("import_id", "start_page", "idx")


def result_rows(papers: DataFrame) -> DataFrame:
    """PRJ7: marks, grace and states of papers that carry import_id and start_page; papers outside an import are left out."""
    rows = with_score(papers.filter("start_page IS NOT NULL"))
    marks, grace = S.result_marks(F.col("score.total"), S.needs_grace(F.col("answers"), F.col("details")))
    text = lambda k: F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit("")).alias(k)
    ready = _ready()
    return rows.select(
        "import_id",
        "start_page",
        "batch_id",
        "idx",
        "paper_id",
        *(text(k) for k in ("name", "school", "father_mobile", "mother_mobile")),
        marks.alias("marks"),
        grace.alias("grace"),
        F.when(ready, "Checked").otherwise("Not verified").alias("details_status"),
        F.when(ready & (F.col("status") == "approved"), "Approved").otherwise("Provisional").alias("result_status"),
    )


def ordered_by_import(rows: DataFrame) -> DataFrame:
    """Rows laid out for one sorted file part per import; no global sort."""
    return rows.repartition("import_id").sortWithinPartitions("import_id", "start_page", "idx")


def released_results(papers: DataFrame) -> DataFrame:
    """SNK1: approved and ready students, one row each, cells safe for spreadsheets."""
    rows = with_score(papers.filter("status = 'approved'")).filter(_ready())
    text = lambda k: spreadsheet_safe(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))).alias(k)
    return rows.select(
        "batch_id",
        (F.col("idx") + 1).alias("student_number"),
        *(text(k) for k in FIELDS),
        *(F.col(f"score.{k}").alias(k) for k in ("science", "mathematics", "mental_ability", "total", "correct", "blank")),
        *(spreadsheet_safe(F.get("answers", F.lit(i))).alias(f"q{i + 1}") for i in range(25)),
    )


def released_details(papers: DataFrame) -> DataFrame:
    """SNK2: decided student details, whatever the paper's status."""
    text = lambda k: spreadsheet_safe(F.coalesce(F.try_element_at("fields", F.lit(k)), F.lit(""))).alias(k)
    pages = F.concat_ws("-", (2 * F.col("idx") + 1).cast("string"), (2 * F.col("idx") + 2).cast("string"))
    return papers.filter(_ready()).select(
        "batch_id",
        (F.col("idx") + 1).alias("student_number"),
        pages.alias("source_pages"),
        "paper_id",
        *(text(k) for k in FIELDS),
        *(F.try_element_at("field_review", F.lit(k))["status"].alias(f"{k}_status") for k in FIELDS),
    )


def bulk_draft(papers: DataFrame, parts: DataFrame, import_id: int | None = None) -> DataFrame:
    """SNK3: all processed students of one import, or of all, without ids or answers, provisional ones included."""
    rows = bulk_results(papers, parts, import_id)
    safe = [spreadsheet_safe(F.col(k)).alias(k) for k in ("name", "school", "father_mobile", "mother_mobile")]
    return rows.select("import_id", *safe, "marks", "grace", "details_status", "result_status")
