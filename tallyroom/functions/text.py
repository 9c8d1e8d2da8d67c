"""Normalised text, identity keys and cell escaping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyroom.schemas import MOBILES

_WS = "(?U)\\s+"


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _WS, " "))


def digits_only_format(text: Column) -> Column:
    """A phone number without blanks, brackets and hyphens; letters stay as they are."""
    return F.regexp_replace(text, "(?U)[\\s()\\-]", "")


def normalise_text(text: Column, field: Column) -> Column:
    return F.when(field.isin(*MOBILES), digits_only_format(collapsed(text))).otherwise(collapsed(text))


def identity_key(text: Column, field: Column) -> Column:
    """What must be equal for two readings to agree."""
    return F.when(field.contains("mobile"), digits_only_format(text)).otherwise(loose_key(text))


def loose_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, _WS, ""))


def login_phone(text: Column) -> Column:
    """Ten digits from 6, 7, 8 or 9 on, with a leading 91 of twelve digits taken off; else null."""
    bare = F.regexp_replace(text, "(?U)[\\s()+\\-]", "")
    bare = F.when(F.length(bare).eqNullSafe(12) & bare.startswith("91"), F.substring(bare, 3, 10)).otherwise(bare)
    return F.when(bare.rlike("^[6-9][0-9]{9}$"), bare)


def school_key(name: Column) -> Column:
    return F.lower(collapsed(name))


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def clean_model_text(text: Column) -> Column:
    """A model's transcription: no code fences, markers for nothing as '', unusable text as null."""
    bare = stripped(F.regexp_replace(stripped(text), "(?iU)^```(?:text|markdown)?\\s*|\\s*```$", ""))
    return (
        F.when(F.upper(bare).isin("BLANK", "UNREADABLE", "UNKNOWN"), F.lit(""))
        .when((bare == "") | (F.length(bare) > 180) | bare.rlike("[\\n{}<>]"), F.lit(None).cast("string"))
        .otherwise(bare)
    )


def spreadsheet_safe(text: Column, mode: str = "papers") -> Column:
    """Cells that a spreadsheet would read as a formula get a leading apostrophe."""
    pattern = "^[=+\\-@\\t\\r]" if mode == "papers" else "^\\s*[=+@-]"
    return F.when(text.rlike(pattern), F.concat(F.lit("'"), text)).otherwise(text)
