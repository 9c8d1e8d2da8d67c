"""Student records: validation, canonical schools, filters, statistics and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyroom.functions.text import school_key, spreadsheet_safe, stripped

#: The class names that a record may carry.
CLASSES = ("Nursery", "LKG", "UKG", *(str(i) for i in range(1, 13)), "Other")


def record_problems(name, school, father, mother, class_name, marks) -> F.Column:
    """VAL3: array of violations of one record; empty if it is valid."""
    digits = lambda c: F.length(F.regexp_replace(c, "[^0-9]", ""))
    text = lambda c: stripped(F.coalesce(c, F.lit("")))
    bad_phone = lambda c: (text(c) != "") & ~(text(c).rlike("^[+0-9\\s()\\-]+$") & digits(text(c)).between(7, 15))
    value = text(marks).try_cast("double")
    checks = (
        ("name", ~F.length(text(name)).between(1, 150)),
        ("school", ~F.length(text(school)).between(1, 200)),
        ("class", ~text(class_name).isin(*CLASSES)),
        ("father_phone", bad_phone(father)),
        ("mother_phone", bad_phone(mother)),
        ("phone", (text(father) == "") & (text(mother) == "")),
        ("marks", (text(marks) != "") & (value.isNull() | F.isnan(value) | value.isin(float("inf"), float("-inf")))),
    )
    return F.filter(F.array(*(F.when(bad, F.lit(what)) for what, bad in checks)), lambda x: x.isNotNull())


def validated(records: DataFrame) -> DataFrame:
    """Records with trimmed texts, marks as DECIMAL(10,2) (blank: null) and ``violations``."""
    c = F.col
    problems = record_problems(c("name"), c("school"), c("father_phone"), c("mother_phone"), c("class_name"), c("marks"))
    trimmed = {k: stripped(F.coalesce(k, F.lit(""))) for k in ("name", "school", "father_phone", "mother_phone", "class_name")}
    marks = stripped(F.col("marks")).try_cast("decimal(10,2)")
    return records.withColumn("violations", problems).withColumns(trimmed).withColumn("marks", marks)


def canonical_schools(records: DataFrame, known: DataFrame) -> DataFrame:
    """WIN2: (name_key, name): the known spelling, else the first by created_at and id; blanks have none.

    A popular school's rows never meet: minima are pre-aggregated.
    """
    rows = records.select(school_key(F.col("school")).alias("name_key"), F.trim(F.regexp_replace("school", "(?U)\\s+", " ")).alias("name"), "created_at", "id").filter("name_key <> ''")
    first = rows.groupBy("name_key").agg(F.min_by("name", F.struct("created_at", "id")).alias("name"))
    return known.select("name_key", "name").unionByName(first.join(known, "name_key", "left_anti"))


def school_list(schools: DataFrame) -> DataFrame:
    """DDP2: canonical names once each, by lower-cased name."""
    return schools.select("name").distinct().orderBy(F.lower("name"), "name")


def filtered(records: DataFrame, q: str = "", class_name: str = "", status: str = "", literal: bool = False) -> DataFrame:
    """FLT1: newest first. In ``q`` % and _ are wildcards unless ``literal``."""
    rows = records
    if class_name:
        rows = rows.filter(F.col("class_name") == class_name)
    if status:
        rows = rows.filter(F.col("status") == status)
    if q.strip():
        columns = ("name", "school", "father_phone", "mother_phone")
        one = lambda c: F.lower(c).contains(q.strip().lower()) if literal else F.col(c).ilike(f"%{q.strip()}%")
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(one(c), F.lit(False))
        rows = rows.filter(found)
    return rows.orderBy(F.desc("created_at"), F.desc("id"))


def scoped(records: DataFrame, role: str, submitter_id: int) -> DataFrame:
    """FLT2: owners see everything, submitters what they entered."""
    return records if role == "owner" else records.filter(F.col("submitter_id") == submitter_id)


def record_stats(records: DataFrame) -> DataFrame:
    """AGG11: one row of counts; schools are distinct without case."""
    return records.agg(
        F.count("*").alias("records"),
        F.count_distinct(F.lower("school")).alias("schools"),
        F.count(F.when(F.col("status") == "Reviewed", 1)).alias("reviewed"),
        F.count(F.when(F.col("status") == "New", 1)).alias("new"),
    )


#: What the activity log calls a saved new record, a changed one, and a refused change.
SUBMITTED, UPDATED, BLOCKED_EDIT = "Submitted student record", "Updated student record", "Blocked submitted-record edit"


def upserted(stored: DataFrame, incoming: DataFrame, schools: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """CHG5: (new state, rejected rows with a reason, activity events).

    New ids are inserted as New. Existing ids may be changed by owners only, go back to New and keep who
    created them and when. Invalid rows are refused; of several rows for one id the first by edit_id counts.
    ``incoming`` has the record's columns, role and edit_id. An event (id, edit_id, actor_id, event) stands for
    each saved row and each change that only the owner might make; invalid rows leave none.
    """
    checked = validated(incoming)
    old = stored.select("id", F.col("created_at").alias("_created"), F.col("submitter_id").alias("_submitter"), F.lit(True).alias("_old"))
    rows = checked.join(old, "id", "left")
    reason = F.when(F.size("violations") > 0, F.concat(F.lit("invalid: "), F.array_join("violations", ","))).when(
        F.col("_old") & (F.col("role") != "owner"), F.lit("only the owner may change it")
    )
    rows = rows.withColumn("reason", reason)
    rank = F.when(F.col("reason").isNull(), F.row_number().over(Window.partitionBy("id", F.col("reason").isNull()).orderBy("edit_id")))
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(rank > 1, F.lit("an earlier edit counts"))))
    blocked = F.col("reason") == "only the owner may change it"
    event = F.when(blocked, BLOCKED_EDIT).when(F.col("reason").isNull(), F.when(F.col("_old"), UPDATED).otherwise(SUBMITTED))
    events = rows.select("id", "edit_id", F.col("submitter_id").alias("actor_id"), event.alias("event")).filter("event IS NOT NULL")
    good = rows.filter("reason IS NULL").withColumn("name_key", school_key(F.col("school")))
    canonical = schools.select("name_key", F.col("name").alias("_school"))
    good = good.join(canonical, "name_key", "left").select(
        "id",
        "name",
        F.coalesce("_school", "school").alias("school"),
        "father_phone",
        "mother_phone",
        "class_name",
        "marks",
        F.coalesce("_submitter", "submitter_id").alias("submitter_id"),
        F.lit("New").alias("status"),
        F.coalesce("_created", "created_at").alias("created_at"),
    )
    state = stored.join(good.select("id"), "id", "left_anti").unionByName(good)
    return state, rows.filter("reason IS NOT NULL").select("id", "edit_id", "reason"), events


def reviewed(records: DataFrame, decisions: DataFrame, role: str) -> DataFrame:
    """CHG6: owners set the status New or Reviewed by id."""
    if role != "owner":
        return records
    wanted = decisions.filter(F.col("status").isin("New", "Reviewed")).groupBy("id").agg(F.max_by("status", "edit_id").alias("_wanted"))
    return records.join(wanted, "id", "left").withColumn("status", F.coalesce("_wanted", "status")).select(*records.columns)


def exported(records: DataFrame) -> DataFrame:
    """SNK4: the downloaded columns, cells safe for spreadsheets."""
    columns = ("name", "school", "father_phone", "mother_phone", "class_name", "marks", "status", "submitter_id", "created_at")
    return records.select("id", *(spreadsheet_safe(F.coalesce(F.col(c).cast("string"), F.lit("")), "records").alias(c) for c in columns))
