"""Exam configuration, file manifests, duplicate checks and intake plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.operators import desk
from tallyroom.schemas import FIELDS

MAX_PAGES, PART_PAGES, SMALL_PAGES = 6000, 30, 30
HEAD = 10_000


def _rect_ok(r: F.Column) -> F.Column:
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    x, y, w, h = (F.get(r, F.lit(i)) for i in range(4))
    inside = (x >= 0) & (y >= 0) & (w > 0) & (h > 0) & (x + w <= 1.001) & (y + h <= 1.001)
    return F.coalesce((F.size(r) == 4) & F.forall(r, fine) & inside, F.lit(False))


def config_problems(config: F.Column) -> F.Column:
    """VAL1: sorted violations of an exam configuration struct (key, mapping, fields)."""
    key, mapping, fields = config["key"], config["mapping"], config["fields"]
    names = F.array(*(F.lit(str(i)) for i in range(1, 26)))
    keys = F.coalesce(F.map_keys(mapping), F.array().cast("array<string>"))
    entries = F.coalesce(F.map_entries(mapping), F.array().cast("array<struct<key:string,value:struct<page:int,boxes:array<array<double>>>>>"))
    field_entries = F.coalesce(F.map_entries(fields), F.array().cast("array<struct<key:string,value:struct<page:int,box:array<double>>>>"))
    page = lambda q: F.when(q.try_cast("int") <= 10, 0).otherwise(1)
    checks = (
        ("key", ~F.coalesce((F.size(key) == 25) & F.forall(key, lambda k: F.coalesce(k.rlike("^[A-D]$"), F.lit(False))), F.lit(False))),
        ("questions", (F.size(keys) != 25) | (F.size(F.array_except(names, keys)) > 0)),
        ("page", F.exists(entries, lambda e: ~F.coalesce(e["value"]["page"] == page(e["key"]), F.lit(False)))),
        ("boxes", F.exists(entries, lambda e: ~F.coalesce(F.size(e["value"]["boxes"]) == 4, F.lit(False)))),
        ("rectangle", F.exists(entries, lambda e: F.exists(F.coalesce(e["value"]["boxes"], F.array().cast("array<array<double>>")), lambda r: ~_rect_ok(r)))),
        ("field", F.exists(field_entries, lambda e: ~e["key"].isin(*FIELDS) | ~F.coalesce(e["value"]["page"] == 0, F.lit(False)))),
        ("field rectangle", F.exists(field_entries, lambda e: ~_rect_ok(e["value"]["box"]))),
    )
    return F.filter(F.array(*(F.when(bad, F.lit(what)) for what, bad in checks)), lambda x: x.isNotNull())


def page_count_ok(pages: F.Column, small: bool = False) -> F.Column:
    """VAL4: an even number of pages from 2 to the limit."""
    return F.coalesce(pages.between(2, SMALL_PAGES if small else MAX_PAGES) & (pages % 2 == 0), F.lit(False))


def integrity_check(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """VAL6: (key, problem) of stored files (key, digest) that are missing, differ or are not listed in the scan's manifest."""
    a = manifest.select("key", F.col("digest").alias("expected"))
    b = files.select("key", F.col("digest").alias("actual"))
    rows = a.join(b, "key", "full_outer")
    problem = (
        F.when(F.col("actual").isNull(), "missing file")
        .when(F.col("expected").isNull(), "not listed")
        .when(F.col("actual") != F.col("expected"), "digest differs")
    )
    return rows.select("key", problem.alias("problem")).filter("problem IS NOT NULL")


def intake_dedupe(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """JN5: incoming files (file_id, exam_id, digest) with state new or duplicate and the import they repeat.

    Of equal files in one load the first by file_id is new; copies of a hot digest are pre-aggregated.
    """
    first = incoming.groupBy("exam_id", "digest").agg(F.min("file_id").alias("first_file"))
    known = stored.groupBy("exam_id", "digest").agg(F.min("import_id").alias("import_id"))
    rows = incoming.join(first, ["exam_id", "digest"]).join(known, ["exam_id", "digest"], "left")
    state = F.when(F.col("import_id").isNotNull() | (F.col("file_id") != F.col("first_file")), "duplicate").otherwise("new")
    return rows.select("file_id", "exam_id", "digest", state.alias("state"), "import_id", F.when(F.col("import_id").isNull(), F.col("first_file")).alias("first_file"))


def page_parts(files: DataFrame) -> DataFrame:
    """CHG7's parts: 30 pages each, with name and students."""
    rows = files.filter(page_count_ok(F.col("pages"))).select(
        "file_id", "stem", "pages", F.explode(F.sequence(F.lit(0), F.col("pages").cast("int") - 1, F.lit(PART_PAGES))).alias("start_page")
    )
    end = F.least(F.col("start_page") + PART_PAGES, F.col("pages").cast("int"))
    name = F.concat(F.col("stem"), F.lit(" · pages "), (F.col("start_page") + 1).cast("string"), F.lit("–"), end.cast("string"))
    return rows.select("file_id", "start_page", end.alias("end_page"), name.alias("name"), F.floor((end - F.col("start_page")) / 2).cast("int").alias("students"))


def admitted(candidates: DataFrame, free: int) -> DataFrame:
    """file_id of the files (file_id, need) that fit when they are taken in order of file_id, each from what is left.

    A file that doesn't fit is passed over. If all fit together one sum decides. Else the files that still can
    fit are read in order, HEAD at a time; the driver keeps the taken ids alone, of which there are at most
    ``free`` / RESERVED because each takes that much at least.
    """
    if (candidates.agg(F.sum("need").alias("n")).first()["n"] or 0) <= free:
        return candidates.select("file_id")
    taken, rows, last = [], candidates.select("file_id", "need"), None
    while True:
        left = rows.filter(F.col("need") <= free)
        left = left if last is None else left.filter(F.col("file_id") > last)
        head = left.orderBy("file_id").limit(HEAD).collect()
        for r in head:
            if r["need"] <= free:
                taken.append((r["file_id"],))
                free -= r["need"]
        if len(head) < HEAD:
            break
        last = head[-1]["file_id"]
    return candidates.sparkSession.createDataFrame(taken, candidates.select("file_id").schema)


def plan_intake(incoming: DataFrame, stored: DataFrame, files: DataFrame, batches: DataFrame, budget: int) -> tuple[DataFrame, DataFrame]:
    """CHG7: (parts of accepted files, refused files with a reason). A file is accepted or refused whole.

    Files are admitted one after the other by file_id: an accepted one takes its bytes and its students' evidence
    from the space that the next ones find.
    """
    rows = intake_dedupe(incoming, stored).join(incoming.select("file_id", F.substring("stem", 1, 90).alias("stem"), "pages", "size"), "file_id")
    now = desk.space(files, batches).first()
    reason = F.when(~page_count_ok(F.col("pages")), "page count").when(F.col("state") == "duplicate", "duplicate")
    rows = rows.withColumn("reason", reason).withColumn("need", F.col("size") + F.floor(F.col("pages") / 2) * desk.RESERVED)
    fit = admitted(rows.filter("reason IS NULL"), budget - now["used"] - now["raw_pending"] * desk.RESERVED)
    rows = rows.join(fit.withColumn("fits", F.lit(True)), "file_id", "left")
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("fits").isNull(), F.lit("no space"))))
    return page_parts(rows.filter("reason IS NULL")), rows.filter("reason IS NOT NULL").select("file_id", "reason")
