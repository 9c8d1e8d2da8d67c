"""Review queue, progress, capacity and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions import score as S
from tallyroom.operators.results import with_parts

MIB = 1 << 20
RESERVED = 3 * MIB


def checks_required(papers: DataFrame) -> DataFrame:
    """PRJ4: paper_id, checks_required (0 once approved) and the status that is shown."""
    ready = S.details_ready(F.col("fields"), F.col("field_review"), F.col("pairing_verified"))
    n = F.size(S.open_questions(F.col("answers"), F.col("details"), F.col("answer_checks")))
    return papers.select(
        "paper_id",
        "batch_id",
        "idx",
        "status",
        F.when(F.col("status") == "approved", 0).otherwise(n).alias("checks_required"),
        F.when((F.col("status") == "approved") & ~ready, "review").otherwise(F.col("status")).alias("shown_status"),
    )


def pending_items(papers: DataFrame) -> DataFrame:
    """PRJ5 and PRJ6: what each paper still needs; approved and ready papers need nothing and are left out."""
    ready = S.details_ready(F.col("fields"), F.col("field_review"), F.col("pairing_verified"))
    rows = papers.withColumn("_ready", ready).filter(~((F.col("status") == "approved") & F.col("_ready")))
    student, first, second = S.source_position(F.col("start_page"), F.col("idx"))
    rows = rows.withColumn("answers_open", S.open_questions(F.col("answers"), F.col("details"), F.col("answer_checks")))
    return rows.select(
        "paper_id",
        student.alias("student"),
        first.alias("first_page"),
        second.alias("second_page"),
        "answers_open",
        S.open_fields(F.col("fields"), F.col("field_review")).alias("fields_open"),
        (~F.coalesce("pairing_verified", F.lit(False))).alias("pairing_required"),
        ((F.size("answers_open") == 0) & F.col("_ready")).alias("ready_for_approval"),
    )


def review_queue(papers: DataFrame, batches: DataFrame, exams: DataFrame, parts: DataFrame, offset: int, limit: int) -> DataFrame:
    """JN1 and TOP3: one page of papers that are not approved, in order of the batch's creation and the place in it; next_offset is null on the last page.

    The page is cut before anything is derived from the documents or looked up in ``parts``; a paper of no part
    has its place from the first page on.
    """
    if not 1 <= limit <= 50:
        raise ValueError("limit must be 1 to 50")
    rows = papers.filter("status <> 'approved'").join(batches.select("batch_id", "created", F.col("status").alias("batch_status")), "batch_id").join(exams, "exam_id")
    page = rows.orderBy("created", "batch_id", "idx", "paper_id").offset(offset).limit(limit + 1)
    order = Window.orderBy("created", "batch_id", "idx", "paper_id")  # over at most 51 rows
    page = page.withColumn("_n", F.row_number().over(order)).withColumn("_all", F.max("_n").over(Window.partitionBy()))
    page = with_parts(page.filter(F.col("_n") <= limit), parts, how="left")
    items = pending_items(page).join(page.select("paper_id", "batch_id", "exam_name", "_all"), "paper_id")
    return items.withColumn("next_offset", F.when(F.col("_all") > limit, F.lit(offset + limit))).drop("_all")


def keyset_page(papers: DataFrame, after: tuple[int, int] | None, limit: int) -> DataFrame:
    """TOP3 without an offset: the papers that are not approved after (batch_id, idx)."""
    rows = papers.filter("status <> 'approved'")
    if after:
        rows = rows.filter((F.col("batch_id") > after[0]) | ((F.col("batch_id") == after[0]) & (F.col("idx") > after[1])))
    return rows.orderBy("batch_id", "idx").limit(limit)


def batch_overview(papers: DataFrame, batches: DataFrame, exams: DataFrame) -> DataFrame:
    """JN3: batches with their exam and the number of approved and ready papers, 0 included."""
    ready = S.details_ready(F.col("fields"), F.col("field_review"), F.col("pairing_verified"))
    done = papers.filter("status = 'approved'").filter(ready).groupBy("batch_id").agg(F.count("*").alias("approved"))
    return batches.join(exams, "exam_id").join(done, "batch_id", "left").fillna(0, ["approved"])


def unprocessed(batches: DataFrame, papers: DataFrame) -> DataFrame:
    """JN4: (batch_id, idx) that a resumed batch still has to read."""
    slots = batches.filter("total > 0").select("batch_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1)).alias("idx"))
    return slots.join(papers.select("batch_id", "idx"), ["batch_id", "idx"], "left_anti")


def paper_context(papers: DataFrame, batches: DataFrame, exams: DataFrame, parts: DataFrame) -> DataFrame:
    """JN8: a paper with its batch, exam and place in the source; without a part the place counts from the first page."""
    papers = with_parts(papers, parts, how="left")
    student, first, second = S.source_position(F.col("start_page"), F.col("idx"))
    rows = papers.join(batches.select("batch_id", "total", F.col("status").alias("batch_status")), "batch_id").join(exams, "exam_id")
    return rows.select("paper_id", "batch_id", "exam_name", "batch_status", "total", student.alias("student"), first.alias("first_page"), second.alias("second_page"))


def status_counts(papers: DataFrame, batches: DataFrame) -> DataFrame:
    """AGG1: one row of desk counters."""
    a = papers.agg(
        F.count(F.when(F.col("status") != "approved", 1)).alias("awaiting_team"),
        F.count(F.when(F.col("status") == "approved", 1)).alias("approved"),
    )
    open_ = F.col("status").isin("queued", "processing", "failed")
    b = batches.agg(F.coalesce(F.sum(F.when(open_, F.greatest(F.lit(0), F.col("total") - F.col("done")))), F.lit(0)).alias("waiting_to_process"))
    return a.withColumn("_", F.lit(1)).join(b.withColumn("_", F.lit(1)), "_").drop("_")


def import_progress(imports: DataFrame, batches: DataFrame, exams: DataFrame, newest: int = 20) -> DataFrame:
    """AGG2: the newest imports (import_id, exam_id, pages, created) that have parts, with exam and sums of done and total.

    Imports are cut to the newest before anything is summed; exams are joined as their size allows.
    """
    parts = batches.filter("start_page IS NOT NULL")
    rows = imports.join(exams, "exam_id").join(parts.select("import_id").distinct(), "import_id", "left_semi")
    rows = rows.orderBy(F.desc("created"), F.desc("import_id")).limit(newest)
    sums = parts.join(F.broadcast(rows.select("import_id")), "import_id").groupBy("import_id").agg(F.sum("done").alias("done"), F.sum("total").alias("total"))
    return rows.join(sums, "import_id").select("import_id", "pages", "exam_name", "done", "total")


def space(files: DataFrame, batches: DataFrame) -> DataFrame:
    """One row: used bytes, pending students with each batch clipped at 0, and raw_pending without."""
    open_ = F.col("status").isin("queued", "processing", "failed")
    used = files.agg(F.coalesce(F.sum(F.coalesce("size", F.lit(0))), F.lit(0)).alias("used"))
    pending = batches.agg(
        F.coalesce(F.sum(F.when(open_, F.greatest(F.lit(0), F.col("total") - F.col("done")))), F.lit(0)).alias("pending"),
        F.coalesce(F.sum(F.when(open_, F.col("total") - F.col("done"))), F.lit(0)).alias("raw_pending"),
    )
    return used.withColumn("_", F.lit(1)).join(pending.withColumn("_", F.lit(1)), "_").drop("_")


def capacity(files: DataFrame, batches: DataFrame, budget: int, new_size: int, new_pages: int) -> DataFrame:
    """AGG3: used, reserved and available bytes, and whether one more import fits.

    The desk clips each batch's pending number at 0; intake does not.
    """
    row = space(files, batches)
    reserved = F.col("pending") * RESERVED
    return row.select(
        "used",
        reserved.alias("reserved"),
        F.greatest(F.lit(0).cast("long"), F.lit(budget) - F.col("used") - reserved).alias("available"),
        (F.col("used") + new_size + (F.lit(new_pages // 2) + F.col("raw_pending")) * RESERVED <= budget).alias("admitted"),
    )


def desk_totals(papers: DataFrame, batches: DataFrame, exams: DataFrame) -> DataFrame:
    """AGG12: totals over all batches."""
    rows = batch_overview(papers, batches, exams)
    return rows.agg(
        F.sum("total").alias("total"),
        F.sum("done").alias("done"),
        F.sum("approved").alias("approved"),
        (F.sum("done") - F.sum("approved")).alias("awaiting"),
        F.count_distinct("exam_id").alias("exams"),
    )


def batch_progress(papers: DataFrame, batches: DataFrame) -> DataFrame:
    """AGG13: stored papers of each batch, and ready once all are there."""
    stored = papers.groupBy("batch_id").agg(F.count("*").alias("stored"))
    rows = batches.select("batch_id", "total").join(stored, "batch_id", "left").fillna(0, ["stored"])
    return rows.withColumn("state", F.when(F.col("stored") >= F.col("total"), "ready").otherwise("processing"))


def next_exception(papers: DataFrame) -> DataFrame:
    """WIN3: for each paper the next one of its batch with open checks, from the start again after the end, never itself.

    Batches are small by rule (a part has at most 15 students).
    """
    rows = checks_required(papers)
    target = F.when((F.col("status") != "approved") & (F.col("checks_required") > 0), F.struct("idx", "paper_id"))
    w = Window.partitionBy("batch_id").orderBy("idx")
    after = F.first(target, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    before = F.first(target, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("paper_id", F.coalesce(after, before)["paper_id"].alias("next_paper"))


def next_batch(batches: DataFrame) -> DataFrame:
    """TOP2: the oldest queued batch."""
    return batches.filter("status = 'queued'").orderBy("created", "batch_id").limit(1)


def retry_failed(batches: DataFrame) -> DataFrame:
    """CHG8: failed and interrupted batches are queued again."""
    return batches.withColumn("status", F.when(F.col("status").isin("failed", "processing"), "queued").otherwise(F.col("status")))
