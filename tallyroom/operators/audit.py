"""Accuracy of machine readings against approved decisions, and identity and mark evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyroom.functions.text import identity_key, loose_key
from tallyroom.schemas import FIELDS, QUESTIONS

IDENTITY_FIELDS = ("name", "school", "father_mobile", "mother_mobile")
UNKNOWN_REASON = "Reason unavailable"


def _comparable(papers: DataFrame) -> DataFrame:
    return papers.filter("status = 'approved'").withColumn("_known", F.coalesce(F.size("detected_answers") == QUESTIONS, F.lit(False)))


def _state(before: F.Column, final: F.Column) -> F.Column:
    return F.when(before == "?", "unresolved").when(before == final, "matched").otherwise("different")


def audited_answers(papers: DataFrame) -> DataFrame:
    """One row per compared answer: paper_id, batch_id, question, machine, reviewed, state, reason."""
    rows = _comparable(papers).filter("_known")
    n = F.least(F.size("answers"), F.size("detected_answers"))
    pairs = F.arrays_zip(F.slice("detected_answers", 1, n).alias("machine"), F.slice("answers", 1, n).alias("reviewed"))
    rows = rows.select("paper_id", "batch_id", "details", F.posexplode(pairs).alias("q", "x"))
    reason = F.coalesce(F.get("details", F.col("q"))["reason"], F.lit(UNKNOWN_REASON))
    machine, reviewed = F.col("x.machine"), F.col("x.reviewed")
    return rows.select(
        "paper_id", "batch_id", (F.col("q") + 1).alias("question"), machine.alias("machine"), reviewed.alias("reviewed"), _state(machine, reviewed).alias("state"), reason.alias("reason")
    )


def _states() -> list[F.Column]:
    return [F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("matched", "unresolved", "different")]


def audit_answers(papers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """AGG4: totals of approved papers; answers of papers without a full machine reading are unavailable.

    Counts are taken inside each paper's arrays, so nothing is exploded.
    """
    rows = _comparable(papers)
    n = F.least(F.size("answers"), F.size("detected_answers"))
    states = F.zip_with(F.slice("detected_answers", 1, n), F.slice("answers", 1, n), _state)
    rows = rows.withColumn("_states", F.when(F.col("_known"), states).otherwise(F.array().cast("array<string>")))
    count = lambda s: F.coalesce(F.sum(F.size(F.filter("_states", lambda x: x == s))), F.lit(0)).alias(s)
    return rows.groupBy(*by).agg(
        F.count("*").alias("approved_students"),
        F.coalesce(F.sum(F.size("_states")), F.lit(0)).alias("total"),
        count("matched"),
        count("unresolved"),
        count("different"),
        F.coalesce(F.sum(F.when(~F.col("_known"), QUESTIONS).otherwise(0)), F.lit(0)).alias("unavailable"),
    )


def _every(papers: DataFrame, by: tuple[str, ...], name: str, values: F.Column) -> DataFrame:
    """Each group of approved papers (or the one group of all, without ``by``) with each of a few values."""
    groups = papers.filter("status = 'approved'").select(*by).distinct() if by else papers.sparkSession.range(1).select()
    return groups.select(*by, F.explode(values).alias(name))


def audit_questions(papers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """AGG5: states per question 1 to 25, zeros kept, and question 0 for all of them; for each group of ``by``."""
    counts = audited_answers(papers).groupBy(*by, "question").agg(*_states())
    sums = counts.groupBy(*by).agg(*(F.sum(s).alias(s) for s in ("matched", "unresolved", "different"))).withColumn("question", F.lit(0))
    every = _every(papers, by, "question", F.sequence(F.lit(0), F.lit(QUESTIONS)))
    return every.join(counts.unionByName(sums), [*by, "question"], "left").fillna(0, ["matched", "unresolved", "different"])


def audit_reasons(papers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """AGG6: answers that did not match, by reason; for each group of ``by``."""
    return audited_answers(papers).filter("state <> 'matched'").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def _field_states(papers: DataFrame) -> DataFrame:
    """Eight rows a paper: field and state (matched, different, blank_or_unreadable, or null if it does not count)."""
    rows = papers.filter("status = 'approved'").withColumn("field", F.explode(F.array(*(F.lit(k) for k in FIELDS))))
    review = F.try_element_at("field_review", F.col("field"))
    same = review["value"].eqNullSafe(F.try_element_at("fields", F.col("field")))
    suggested = F.coalesce(F.try_element_at("field_ocr", F.col("field"))["suggested"], F.lit(""))
    verified = F.when(loose_key(suggested) == loose_key(F.coalesce(review["value"], F.lit("None"))), "matched").otherwise("different")
    state = F.when(same & review["status"].isin("blank", "unreadable"), "blank_or_unreadable").when(same & (review["status"] == "verified"), verified)
    return rows.select("paper_id", "batch_id", "field", state.alias("state"))


def audit_fields(papers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """AGG7: states of each identity field, zeros kept; for each group of ``by``."""
    rows = _field_states(papers).groupBy(*by, "field").agg(
        F.count(F.when(F.col("state").isin("matched", "different"), 1)).alias("readable"),
        *(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("matched", "different", "blank_or_unreadable")),
    )
    every = _every(papers, by, "field", F.array(*(F.lit(k) for k in FIELDS)))
    return every.join(rows, [*by, "field"], "left").fillna(0, ["readable", "matched", "different", "blank_or_unreadable"])


def audit_students(papers: DataFrame) -> DataFrame:
    """AGG8: per approved student the answers that did not match and the differing fields, built row by row."""
    rows = _comparable(papers)
    places = F.sequence(F.lit(0), F.least(F.size("answers"), F.size("detected_answers")) - 1)

    def entry(i: F.Column) -> F.Column:
        before, final = F.get("detected_answers", i), F.get("answers", i)
        reason = F.coalesce(F.get("details", i)["reason"], F.lit(UNKNOWN_REASON))
        return F.struct((i + 1).alias("question"), before.alias("machine"), final.alias("reviewed"), _state(before, final).alias("state"), reason.alias("reason"))

    found = F.filter(F.transform(places, entry), lambda e: e["state"] != "matched")
    none = F.array().cast("array<struct<question:int,machine:string,reviewed:string,state:string,reason:string>>")

    def differs(k: F.Column) -> F.Column:
        review = F.try_element_at("field_review", k)
        suggested = F.coalesce(F.try_element_at("field_ocr", k)["suggested"], F.lit(""))
        same = review["value"].eqNullSafe(F.try_element_at("fields", k)) & (review["status"] == "verified")
        return F.coalesce(same & (loose_key(suggested) != loose_key(F.coalesce(review["value"], F.lit("None")))), F.lit(False))

    return rows.select(
        "paper_id",
        "batch_id",
        (F.col("idx") + 1).alias("student"),
        F.when(F.col("_known") & (F.size("answers") > 0), found).otherwise(none).alias("answers"),
        F.filter(F.array(*(F.lit(k) for k in FIELDS)), differs).alias("fields"),
    )


def reference_problems(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """VAL5: (student, field, problem) of rows that an evaluation would refuse."""
    both = references.withColumn("_kind", F.lit("reference")).unionByName(predictions.withColumn("_kind", F.lit("prediction")))
    unknown = both.filter(~F.col("field").isin(*IDENTITY_FIELDS)).select("student", "field", F.lit("unsupported field").alias("problem"))
    again = both.groupBy("student", "field", "_kind").count().filter("count > 1").select("student", "field", F.lit("duplicate entry").alias("problem"))
    empty = predictions.filter("text IS NULL").select("student", "field", F.lit("null prediction").alias("problem"))
    alone = predictions.join(references, ["student", "field"], "left_anti").select("student", "field", F.lit("no reference").alias("problem"))
    return unknown.unionAll(again).unionAll(empty).unionAll(alone).distinct()


def label_predictions(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """JN7: references with their predictions, missing ones marked."""
    p = predictions.select("student", "field", F.col("text").alias("predicted"), F.lit(True).alias("_there"))
    return references.join(p, ["student", "field"], "left").withColumn("missing", F.col("_there").isNull()).drop("_there")


def identity_report(references: DataFrame, predictions: DataFrame) -> DataFrame:
    """AGG9: exact identity evaluation of the four fields, all present."""
    rows = label_predictions(references.filter(F.col("field").isin(*IDENTITY_FIELDS)), predictions)
    seen = F.col("text").isNotNull()
    predicted = F.coalesce("predicted", F.lit(""))
    exact = seen & (identity_key(predicted, F.col("field")) == identity_key(F.col("text"), F.col("field")))
    filled, blank = seen & (F.col("text") != ""), seen & (F.col("text") == "")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    out = rows.groupBy("field").agg(
        count(seen, "evaluated"),
        count(~seen, "excluded_ambiguous"),
        count(seen & F.col("missing"), "missing_prediction"),
        count(exact, "exact"),
        count(filled, "filled"),
        count(filled & exact, "filled_exact"),
        count(filled & (predicted != "") & ~exact, "wrong_nonempty"),
        count(filled & (predicted == ""), "missed_filled"),
        count(blank, "blank"),
        count(blank & (predicted == ""), "blank_exact"),
        count(blank & (predicted != ""), "false_text_on_blank"),
    )
    names = references.sparkSession.createDataFrame([(k,) for k in IDENTITY_FIELDS], "field string")
    out = names.join(out, "field", "left").fillna(0)
    rate = lambda a, b, name: F.when(F.col(b) > 0, F.bround(F.col(a) / F.col(b), 4)).alias(name)
    return out.select("*", rate("exact", "evaluated", "exact_rate"), rate("filled_exact", "filled", "filled_exact_rate"))


def benchmark_answers(reads: DataFrame, reviewed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AGG10's rows, one for each answer of fresh reads (details of 25) that has a reviewed one, and refused references.

    A reference is refused if it isn't approved, hasn't 25 decided answers, or its paper has another one too; then
    none of the paper's references counts.
    """
    known = reviewed.groupBy("paper_id").agg(F.count("*").alias("times"), F.first("status").alias("status"), F.first("answers").alias("answers"))
    whole = F.coalesce(F.forall("answers", lambda a: F.coalesce(a != "?", F.lit(False))) & (F.size("answers") == QUESTIONS), F.lit(False))
    problem = F.when(F.col("times") > 1, "reviewed more than once").when(~F.coalesce(F.col("status") == "approved", F.lit(False)), "not approved").when(~whole, "not fully reviewed")
    known = known.withColumn("problem", problem)
    rows = reads.select("paper_id", "details").join(known.filter("problem IS NULL").select("paper_id", "answers"), "paper_id")
    rows = rows.select("paper_id", "details", F.posexplode("answers").alias("q", "reviewed"))
    detail = F.get("details", F.col("q"))
    detected = F.coalesce(detail["answer"], F.lit("?"))
    rows = rows.select(
        "paper_id",
        (F.col("q") + 1).alias("question"),
        detected.alias("detected"),
        "reviewed",
        _state(detected, F.col("reviewed")).alias("state"),
        detail["confidence"].alias("confidence"),
        detail["reason"].alias("reason"),
        detail["suggested_answer"].alias("suggestion"),
    )
    return rows, known.filter("problem IS NOT NULL").select("paper_id", "problem")


def mark_benchmark(reads: DataFrame, reviewed: DataFrame) -> DataFrame:
    """AGG10: one row of totals over ``benchmark_answers``."""
    rows, _ = benchmark_answers(reads, reviewed)
    strong = F.coalesce(F.col("confidence") == "strong", F.lit(False))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    return rows.agg(
        F.count("*").alias("questions"),
        *(count(F.col("state") == s, s) for s in ("matched", "unresolved", "different")),
        count(strong, "strong"),
        count(strong & (F.col("detected") != F.col("reviewed")), "strong_different"),
        count(F.coalesce(F.col("suggestion"), F.lit("")) != "", "suggestions"),
        count(F.col("suggestion") == F.col("reviewed"), "suggestion_matches"),
    )
