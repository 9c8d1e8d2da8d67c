"""Examination tables derived from the given tables, so that queries grow with them.

One rule for each value, written once in SQL that any engine accepts. Spark builds papers with nested
arrays and maps row by row; ``LONG`` has the same values as rows for reference SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyroom.schemas import FIELDS


def _div(x: str, n: int) -> str:
    return f"CAST(FLOOR(({x}) / {n}) AS BIGINT)"


def _letter(n: str) -> str:
    return f"SUBSTR('ABCD', CAST({n} AS INT) + 1, 1)"


BATCH = _div("o_orderkey", 15)
PAPERS = f"""SELECT p, cust, batch_no, idx, import_no, status, version, pairing, c_name, n_name,
 CASE WHEN batch_no % 10 < 6 THEN 0 ELSE batch_no % 5 END AS exam_no,
 CASE WHEN batch_no % 13 = 12 THEN NULL ELSE (batch_no % 20) * 30 END AS start_page
 FROM (SELECT o_orderkey AS p, o_custkey AS cust, {BATCH} AS batch_no, o_orderkey % 15 AS idx, {_div('o_orderkey', 300)} AS import_no,
  CASE WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'review' END AS status, 1 + o_orderkey % 3 AS version, o_orderkey % 4 <> 3 AS pairing,
  c_name, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey) o"""
KEY = _letter("(exam_no * 5 + q * 3) % 4")
_H = f"((p * 31 + q * 17 + {_div('p', 7)} * q) % 100)"
ANSWER = f"(CASE WHEN {_H} < 60 THEN {KEY} WHEN {_H} < 85 THEN {_letter(f'(exam_no * 5 + q * 3 + 1 + {_H} % 3) % 4')} WHEN {_H} < 93 OR status = 'approved' THEN '-' ELSE '?' END)"
_G = f"((p * 13 + q * 29 + {_div('p', 11)}) % 100)"
READ = f"(CASE WHEN {_G} < 70 THEN {ANSWER} WHEN {_G} < 90 THEN '?' ELSE {_letter(f'{_G} % 4')} END)"
CONFIDENCE = f"(CASE WHEN {_G} < 70 AND {_G} % 2 = 0 THEN 'strong' ELSE 'review' END)"
SUGGESTED = f"(CASE WHEN {_G} % 6 = 0 THEN {_letter(f'{_G} % 4')} END)"
#: Reason texts of the readers; two of them name alignment or registration.
REASONS = (
    "Single mark after brightness and local alignment correction; verify scan.",
    "Multiple marks or correction; review the scan.",
    "Faint, off-box or conflicting ink; review before scoring.",
    "No reliable mark found; confirm a blank from the scan.",
    "Readers disagree; check the scan.",
    "Original and locally aligned readings disagree.",
    "Possible mark beside the option text. Check for crossed-out choices before accepting.",
    "Page registration needs review.",
)
REASON = "(CASE (p + q * 3) % 8 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(REASONS)) + " END)"
HAS_DETAIL = "(p % 17 <> 0 OR q < 20)"
HAS_READS = "(p % 29 <> 0)"
HAS_CHECK = "((p + q) % 6 = 0)"
CHECK = f"(CASE WHEN (p + q) % 12 = 0 THEN CASE WHEN {ANSWER} = 'A' THEN 'B' ELSE 'A' END ELSE {ANSWER} END)"
OVERRIDDEN = "((p * 7 + q) % 19 = 0)"
_S = f"(({_div('p', 3)} + f * 5) % 23)"
FIELD_STATUS = f"(CASE WHEN {_S} = 0 THEN 'pending' WHEN {_S} = 1 THEN 'blank' WHEN {_S} = 2 THEN 'unreadable' ELSE 'verified' END)"
_RAW = (
    "(CASE f WHEN 0 THEN CASE WHEN p % 23 = 0 THEN '' ELSE c_name END WHEN 1 THEN n_name WHEN 2 THEN CAST(1 + p % 12 AS VARCHAR(20)) "
    f"WHEN 3 THEN {_letter('p % 3')} WHEN 4 THEN CONCAT('Taluka ', CAST(cust % 40 AS VARCHAR(20))) WHEN 5 THEN CONCAT('District ', CAST(cust % 9 AS VARCHAR(20))) "
    "WHEN 6 THEN SUBSTR(CAST(9000000000 + cust * 7 AS VARCHAR(20)), 1, CASE WHEN cust % 17 = 0 THEN 9 ELSE 10 END) "
    "ELSE CAST(8000000000 + cust * 3 AS VARCHAR(20)) END)"
)
FIELD_VALUE = f"(CASE WHEN {_S} = 1 OR {_S} = 2 THEN '' ELSE {_RAW} END)"
HAS_FIELD = "(f = 0 OR (p + f) % 41 <> 0)"
HAS_REVIEW = "((p + f) % 37 <> 0)"
REVIEW_VALUE = f"(CASE WHEN (p + f) % 31 = 0 THEN CONCAT({FIELD_VALUE}, 'x') ELSE {FIELD_VALUE} END)"
FIELD_SUGGESTED = f"(CASE WHEN (p * 3 + f) % 5 = 0 THEN CONCAT({FIELD_VALUE}, 'z') WHEN (p + f) % 4 = 0 THEN CONCAT(UPPER({FIELD_VALUE}), ' ') ELSE {FIELD_VALUE} END)"
_NAMES = "(CASE f " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(FIELDS)) + " END)"
BATCH_STATUS = "CASE batch_no % 10 WHEN 7 THEN 'queued' WHEN 8 THEN 'processing' WHEN 9 THEN 'failed' ELSE 'ready' END"
IS_STORED = "(batch_no % 10 < 7 OR idx < 9)"

#: The same tables as rows, for reference SQL: WITH clauses over the given tables.
LONG = f"""papers0 AS ({PAPERS}),
papers AS (SELECT * FROM papers0 WHERE {IS_STORED}),
answers AS (SELECT papers.*, q, {KEY} AS k, {ANSWER} AS answer, CASE WHEN {HAS_READS} THEN {READ} END AS detected,
 CASE WHEN {HAS_DETAIL} THEN {READ} END AS d_answer, CASE WHEN {HAS_DETAIL} THEN {CONFIDENCE} END AS confidence,
 CASE WHEN {HAS_DETAIL} THEN {REASON} END AS reason, CASE WHEN {HAS_DETAIL} THEN {SUGGESTED} END AS suggested,
 CASE WHEN {HAS_CHECK} THEN {CHECK} END AS chk, {OVERRIDDEN} AS overridden
 FROM papers CROSS JOIN (SELECT CAST(range AS BIGINT) AS q FROM range(25))),
fields AS (SELECT papers.*, f, {_NAMES} AS field, CASE WHEN {HAS_FIELD} THEN {FIELD_VALUE} END AS val,
 CASE WHEN {HAS_REVIEW} THEN {FIELD_STATUS} END AS rstatus, CASE WHEN {HAS_REVIEW} THEN {REVIEW_VALUE} END AS rvalue, {FIELD_SUGGESTED} AS fsuggested
 FROM papers CROSS JOIN (SELECT CAST(range AS BIGINT) AS f FROM range(8))),
ready AS (SELECT p, bool_and(pairing) AND bool_and(coalesce(rstatus IN ('verified', 'blank', 'unreadable') AND rvalue = coalesce(val, ''), false))
 AND bool_and(field <> 'name' OR (coalesce(val, '') <> '' AND coalesce(rstatus, '') = 'verified')) AS is_ready FROM fields GROUP BY p),
scores AS (SELECT p, CAST(4 * sum(CASE WHEN answer = k AND q < 10 THEN 1 ELSE 0 END) AS INT) AS science,
 CAST(4 * sum(CASE WHEN answer = k AND q >= 10 AND q < 20 THEN 1 ELSE 0 END) AS INT) AS mathematics,
 CAST(4 * sum(CASE WHEN answer = k AND q >= 20 THEN 1 ELSE 0 END) AS INT) AS mental_ability,
 CAST(4 * sum(CASE WHEN answer = k THEN 1 ELSE 0 END) AS INT) AS total, CAST(sum(CASE WHEN answer = k THEN 1 ELSE 0 END) AS INT) AS correct,
 CAST(sum(CASE WHEN answer = '-' THEN 1 ELSE 0 END) AS INT) AS blank, CAST(sum(CASE WHEN answer = '?' THEN 1 ELSE 0 END) AS INT) AS unresolved
 FROM answers GROUP BY p),
batches AS (SELECT batch_no, min(exam_no) AS exam_no, CAST(count(*) AS BIGINT) AS total, min(import_no) AS import_no, min(start_page) AS start_page,
 {BATCH_STATUS} AS status, CAST(count(CASE WHEN {IS_STORED} THEN 1 END) AS BIGINT) AS done FROM papers0 GROUP BY batch_no)"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All papers that the orders stand for, one flat row each."""
    for name in ("orders", "customer", "nation"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"tallyroom_{name}")
    sql = PAPERS
    for name in ("orders", "customer", "nation"):
        for before in ("FROM ", "JOIN "):
            sql = sql.replace(before + name + " ", f"{before}tallyroom_{name} ")
    return spark.sql(sql)


#: Papers for each task where a paper is much work: the tables it comes from are small, so their splits say little.
PAPERS_PER_TASK = 10_000


def spread(rows: DataFrame, sf_dir: str, per_task: int = PAPERS_PER_TASK) -> DataFrame:
    """Rows of ``base`` dealt to tasks by paper: one for each core at least, of about ``per_task`` papers at most."""
    spark = rows.sparkSession
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()  # of the files' footers
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-orders // per_task)), "p")


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``base`` for each answer (q, 0 to 24) of the stored papers: plain rows, so rules over them compile."""
    rows = spread(base(spark, sf_dir).filter(IS_STORED), sf_dir)
    return rows.withColumn("q", F.explode(F.expr("sequence(0L, 24L)")))


def _over(n: str, name: str, body: str) -> str:
    return f"transform(sequence(0L, {n}), {name} -> {body})"


def papers(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Stored papers with their documents as typed columns, and the key of their exam; ``dealt`` to tasks by ``spread``."""
    rows = base(spark, sf_dir).filter(IS_STORED)
    if dealt:
        rows = spread(rows, sf_dir)
    detail = f"named_struct('answer', {READ}, 'reason', {REASON}, 'confidence', {CONFIDENCE}, 'suggested_answer', {SUGGESTED})"
    names = "array(" + ", ".join(f"'{k}'" for k in FIELDS) + ")"

    def mapped(has: str, value: str) -> str:
        kept = f"filter(sequence(0L, 7L), f -> {has})"
        return f"map_from_arrays(transform({kept}, f -> {names}[CAST(f AS INT)]), transform({kept}, f -> {value}))"

    checked = f"filter(sequence(0L, 24L), q -> {HAS_CHECK})"
    return rows.select(
        F.col("p").alias("paper_id"),
        F.col("batch_no").alias("batch_id"),
        F.col("exam_no").alias("exam_id"),
        F.col("import_no").alias("import_id"),
        "idx",
        "start_page",
        "status",
        "version",
        F.expr(_over("24L", "q", ANSWER)).alias("answers"),
        F.expr(_over("24L", "q", KEY)).alias("key"),
        F.expr(f"CASE WHEN {HAS_READS} THEN {_over('24L', 'q', READ)} END").alias("detected_answers"),
        F.expr(f"transform(filter(sequence(0L, 24L), q -> {HAS_DETAIL}), q -> {detail})").alias("details"),
        F.expr(f"map_from_arrays(transform({checked}, q -> CAST(q AS STRING)), transform({checked}, q -> {CHECK}))").alias("answer_checks"),
        F.expr(f"transform(filter(sequence(0L, 24L), q -> {OVERRIDDEN}), q -> CAST(q AS INT))").alias("answer_overrides"),
        F.expr(mapped(HAS_FIELD, FIELD_VALUE)).alias("fields"),
        F.expr(mapped(HAS_REVIEW, f"named_struct('status', {FIELD_STATUS}, 'value', {REVIEW_VALUE})")).alias("field_review"),
        F.expr(mapped("f >= 0", f"named_struct('suggested', {FIELD_SUGGESTED})")).alias("field_ocr"),
        F.col("pairing").alias("pairing_verified"),
    )


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with their totals, states, and place in an import (start_page null: in none)."""
    rows = base(spark, sf_dir).groupBy("batch_no").agg(
        F.min("exam_no").alias("exam_id"),
        F.count("*").alias("total"),
        F.min("import_no").alias("import_id"),
        F.min("start_page").alias("start_page"),
        F.count(F.when(F.expr(IS_STORED), 1)).alias("done"),
    )
    return rows.select(F.col("batch_no").alias("batch_id"), "exam_id", "total", "done", F.expr(BATCH_STATUS).alias("status"), "import_id", "start_page")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of imports: (import_id, batch_id, start_page), one for each batch that came with an import."""
    rows = base(spark, sf_dir).filter("start_page IS NOT NULL")
    return rows.groupBy(F.col("batch_no").alias("batch_id")).agg(F.min("import_no").alias("import_id"), F.min("start_page").alias("start_page"))


#: Names of the five exams.
EXAM_NAMES = ("Scholarship", "Olympiad", "Aptitude", "Entrance", "Merit")


def exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exams that papers refer to."""
    names = F.array(*(F.lit(x) for x in EXAM_NAMES))
    rows = base(spark, sf_dir).select(F.col("exam_no").alias("exam_id")).distinct()
    return rows.select("exam_id", F.get(names, F.col("exam_id").cast("int")).alias("exam_name"))


EXAMS_SQL = "exams AS (SELECT DISTINCT exam_no, CASE exam_no " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(EXAM_NAMES)) + " END AS exam_name FROM papers0)"
