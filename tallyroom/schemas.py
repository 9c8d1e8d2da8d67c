"""Schemas of the paper document and the exam configuration, and the fixed lists that rules refer to."""

from __future__ import annotations

#: The identity fields of a paper, in display order.
FIELDS = ("name", "school", "class", "section", "taluka", "district", "father_mobile", "mother_mobile")
MOBILES = ("father_mobile", "mother_mobile")
DECIDED = ("verified", "blank", "unreadable")
QUESTIONS = 25

READ = "answer STRING, confidence STRING, reason STRING"
#: Measurements of one option: ink in the box, the checkbox at three contrast levels, the text beside it, stroke readings.
INK = "STRUCT<ratio: DOUBLE, pixels: INT, inside_pixels: INT, box_found: BOOLEAN>"
BOX = "STRUCT<pixels_by_threshold: ARRAY<INT>, registration_cost: DOUBLE, shift: ARRAY<INT>, search_limit: INT>"
OPTION = "STRUCT<v: ARRAY<INT>, cost: DOUBLE, shift: ARRAY<INT>, left: INT, limit: INT>"
STROKES = "ARRAY<STRUCT<answer: STRING, marks: ARRAY<STRUCT<option: INT, width: INT, height: INT, long: BOOLEAN>>>>"
REGISTRATION = "STRUCT<accepted: BOOLEAN, reason: STRING, p95_displacement: DOUBLE>"
EVIDENCE = f"evidence: ARRAY<{INK}>, checkbox_evidence: ARRAY<{BOX}>, option_evidence: ARRAY<{OPTION}>"
DETAIL = (
    f"answer: STRING, reason: STRING, confidence: STRING, suggested_answer: STRING, {EVIDENCE}, "
    f"second_resolution: STRUCT<answer: STRING, confidence: STRING, reason: STRING, checkbox_evidence: ARRAY<{BOX}>>, "
    "local_read: STRUCT<answer: STRING, confidence: STRING, reason: STRING>, "
    f"whole_option_color: ARRAY<ARRAY<INT>>, stroke_reads: {STROKES}, local_registration: {REGISTRATION}"
)
#: A page's measurements before any rule has looked at them: each question at first, at a second resolution, locally aligned.
MEASURED = (
    "width INT, second_width INT, scope STRING, fields MAP<STRING, STRING>, measures ARRAY<STRUCT<q: INT, box_x: ARRAY<DOUBLE>, "
    f"first: STRUCT<{EVIDENCE}>, second: STRUCT<{EVIDENCE}>, local: STRUCT<{EVIDENCE}>, whole_option_color: ARRAY<ARRAY<INT>>, "
    f"stroke_reads: {STROKES}, local_registration: {REGISTRATION}>>"
)
PAPER = (
    "answers ARRAY<STRING>, detected_answers ARRAY<STRING>, answer_overrides ARRAY<INT>, answer_checks MAP<STRING, STRING>, "
    f"details ARRAY<STRUCT<{DETAIL}>>, fields MAP<STRING, STRING>, "
    "field_ocr MAP<STRING, STRUCT<suggested: STRING, candidates: ARRAY<STRUCT<text: STRING, score: DOUBLE, method: STRING>>, state: STRING, reason: STRING, engine: STRING>>, field_review MAP<STRING, STRUCT<status: STRING, value: STRING>>, "
    "pairing_verified BOOLEAN, score STRUCT<science: INT, mathematics: INT, mental_ability: INT, total: INT, correct: INT, blank: INT, unresolved: INT>, "
    "flags ARRAY<STRING>, mark_reader_version INT, mark_reread_at DOUBLE, mark_reread_event BOOLEAN"
)
EXAM = (
    "key ARRAY<STRING>, mapping MAP<STRING, STRUCT<page: INT, boxes: ARRAY<ARRAY<DOUBLE>>>>, "
    "fields MAP<STRING, STRUCT<page: INT, box: ARRAY<DOUBLE>>>"
)
