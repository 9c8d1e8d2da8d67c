"""Scores, checks and result rules of one paper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyroom.schemas import DECIDED, FIELDS, QUESTIONS

GRACE = 8
SECTIONS = (("science", 0, 10), ("mathematics", 10, 20), ("mental_ability", 20, 25))


def valid_answers(answers: Column, alphabet: str = "ABCD-?") -> Column:
    allowed = F.array(*(F.lit(x) for x in alphabet))
    whole = F.forall(answers, lambda a: F.coalesce(F.array_contains(allowed, a), F.lit(False)))
    return F.coalesce((F.size(answers) == QUESTIONS) & whole, F.lit(False))


def score_answers(answers: Column, key: Column) -> Column:
    """Four marks for each match, by section; null unless both have 25 entries and all letters are known."""
    match = F.zip_with(answers, key, lambda a, k: F.coalesce(a == k, F.lit(False)))
    hits = lambda xs: F.size(F.filter(xs, lambda m: m))
    parts = [(4 * hits(F.slice(match, lo + 1, hi - lo))).alias(name) for name, lo, hi in SECTIONS]
    count = lambda letter: F.size(F.filter(answers, lambda a: a == letter))
    both = valid_answers(answers) & (F.coalesce(F.size(key), F.lit(0)) == QUESTIONS)
    return F.when(
        both,
        F.struct(
            *parts,
            (4 * hits(match)).alias("total"),
            hits(match).alias("correct"),
            count("-").alias("blank"),
            count("?").alias("unresolved"),
        ),
    )


def question_outcome(answer: Column, key: Column) -> Column:
    return F.when(answer == key, "Correct").when(answer == "-", "Blank").otherwise("Incorrect")


def let(values: dict[str, Column], body: Callable[..., Column]) -> Column:
    """``body`` of the values, each of which is computed once however often the body names it."""
    row = F.struct(*(v.alias(k) for k, v in values.items()))
    return F.get(F.transform(F.array(row), lambda x: body(*(x[k] for k in values))), F.lit(0))


def details_ready(fields: Column, reviews: Column, pairing: Column) -> Column:
    """All eight fields decided for the very value that is stored, the name verified and the pages paired."""
    text = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))
    ready = F.coalesce(pairing, F.lit(False)) & (text("name") != "")
    for k in FIELDS:
        review = F.try_element_at(reviews, F.lit(k))
        ready = ready & F.coalesce(review["status"].isin(*DECIDED) & (review["value"] == text(k)), F.lit(False))
    return ready & F.coalesce(F.try_element_at(reviews, F.lit("name"))["status"] == "verified", F.lit(False))


def open_questions(answers: Column, details: Column, checks: Column) -> Column:
    """One-based numbers of answers that neither a matching check nor a strong equal reading supports."""

    def found(answers: Column, details: Column, checks: Column) -> Column:
        def is_open(i: Column) -> Column:
            answer, detail = F.get(answers, i), F.get(details, i)
            confirmed = F.try_element_at(checks, i.cast("string")) == answer
            strong = (detail["answer"] == answer) & (detail["confidence"] == "strong")
            return (answer == "?") | ~(F.coalesce(confirmed, F.lit(False)) | F.coalesce(strong, F.lit(False)))

        places = F.sequence(F.lit(0), F.size(answers) - 1)
        numbers = F.transform(F.filter(places, is_open), lambda i: i + 1)
        return F.when(F.size(answers) > 0, numbers).otherwise(F.array().cast("array<int>"))

    return let({"answers": answers, "details": details, "checks": checks}, found)


def open_fields(fields: Column, reviews: Column) -> Column:
    """Fields without a decision, or whose decision is for another value; missing equals missing."""
    names = F.array(*(F.lit(k) for k in FIELDS))

    def is_open(k: Column) -> Column:
        review = F.try_element_at(reviews, k)
        decided = F.coalesce(review["status"].isin(*DECIDED), F.lit(False))
        return ~decided | ~review["value"].eqNullSafe(F.try_element_at(fields, k))

    return F.filter(names, is_open)


def source_position(start_page: Column, idx: Column) -> tuple[Column, Column, Column]:
    """(student number, first page, second page) in the source file."""
    start = F.coalesce(start_page, F.lit(0))
    return F.floor(start / 2).cast("long") + idx + 1, start + 2 * idx + 1, start + 2 * idx + 2


def needs_grace(answers: Column, details: Column) -> Column:
    def found(answers: Column, reasons: Column) -> Column:
        def uncertain(i: Column) -> Column:
            reason = F.lower(F.get(reasons, i))
            return (F.get(answers, i) == "?") & F.coalesce(reason.contains("align") | reason.contains("registration"), F.lit(False))

        n = F.least(F.coalesce(F.size(answers), F.lit(0)), F.coalesce(F.size(reasons), F.lit(0)))
        return F.when(n > 0, F.exists(F.sequence(F.lit(0), n - 1), uncertain)).otherwise(F.lit(False))

    return let({"answers": answers, "reasons": details["reason"]}, found)


def result_marks(total: Column, grace: Column) -> tuple[Column, Column]:
    """(marks, grace): grace once, and never over 100."""
    base = F.greatest(F.lit(0), F.least(F.lit(100), total))
    given = F.when(grace, F.least(F.lit(GRACE), 100 - base)).otherwise(F.lit(0))
    return base + given, given


def summary_label(status: Column, total: Column, unresolved: Column) -> Column:
    return (
        F.when(status == "approved", F.concat(total.cast("string"), F.lit("/100")))
        .when(total == 0, F.lit("Pending review"))
        .when(unresolved > 0, F.lit("incomplete"))
        .otherwise(F.lit("Provisional"))
    )
