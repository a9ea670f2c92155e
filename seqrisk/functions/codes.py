"""Predicates on medical code names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, UNK = "<PAD>", "<UNK>"
PAD_ID, UNK_ID = 0, 1

# Code families that are never, and that may be, a diagnosis.
NOT_DIAGNOSIS = [
    "LOINC", "RXNORM", "CPT4", "VISIT", "CARE_SITE", "DRUG", "MEDICATION", "PROCEDURE", "DEVICE",
    "LAB", "MEASUREMENT", "OBSERVATION_PERIOD", "PERSON/", "STATIC", "GENDER", "RACE", "ETHNICITY",
]
DIAGNOSIS = ["SNOMED", "CONDITION", "DIAG", "DIAGNOS", "ICD", "DX/"]
VISIT_PATTERN = r"^VISIT($|[/_:])"


def is_special(code: Column) -> Column:
    return F.upper(F.trim(code)).isin(PAD, UNK)


def is_diagnosis_name(code: Column) -> Column:
    """Name rule used when there is no code list: exclusions win over inclusions."""
    name = F.upper(F.trim(code))
    return (
        ~is_special(code)
        & ~name.rlike("|".join(NOT_DIAGNOSIS))
        & name.rlike("|".join(DIAGNOSIS))
    )


def is_visit_anchor(code: Column) -> Column:
    return F.upper(F.trim(code)).rlike(VISIT_PATTERN)
