"""Column expressions that screen record text against the guardrail rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns of the three text rules.
METADATA_LEAK = r"(?i)product_code\s*=|\bcell\s*[:=]|\bscenario\s*[:=]|rule_engine_sha|prompt_template_hash"
EXPEDITE_WORDING = r"(?i)\bexpedite[\s_-]?sale\b|\bexpedite\b[^.\n]{0,30}\bsale\b"
TRUNCATED_CSV_TAIL = r"\d{4}-\d{2}-\d{2}[ T]\d{2}:\s*$"


def violations(text: Column, artifact_type: Column) -> Column:
    """The rules that a text breaks, in order, as an array of their ids."""
    cut = F.regexp_replace(text, r"\s+$", "").rlike(TRUNCATED_CSV_TAIL)
    found = F.array(
        F.when(text.rlike(METADATA_LEAK), F.lit("GCC-EDGE-018")),
        F.when(text.rlike(EXPEDITE_WORDING), F.lit("GCC-EDGE-015")),
        F.when((artifact_type == "logger_csv") & cut, F.lit("GCC-EDGE-002")),
    )
    return F.filter(found, lambda x: x.isNotNull())


# What the reports say of each rule that a text breaks.
DETAILS = (
    ("GCC-EDGE-018", "artifact contains raw pipeline metadata (product_code=/cell/rule_engine_sha/prompt_template_hash) -- a decision-input leak vector, not observational text"),
    ("GCC-EDGE-015", "artifact proposes expedite_sale -- never an autonomous action under this pack"),
    ("GCC-EDGE-002", "logger_csv artifact ends mid-timestamp; the final record is incomplete"),
)


def detailed(rules: Column) -> Column:
    """Rule ids as structs (rule_id, detail), in the same order."""
    told = F.create_map(*(F.lit(x) for pair in DETAILS for x in pair))
    return F.transform(rules, lambda r: F.struct(r.alias("rule_id"), F.element_at(told, r).alias("detail")))


def screener_verdict(reply: Column) -> Column:
    said = F.upper(F.trim(reply))
    return F.when(said.isin("CONSISTENT", "INCONSISTENT", "LEAKS_LABEL"), said).otherwise("UNPARSEABLE")
