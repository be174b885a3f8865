"""Row-wise parsing of numbered dialogue lines. Stateless, so streams may pass too."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from dialogue_factors.config import FIELD_SEPARATOR, FIRST_LINE_NUMBER, PERSONA_MARKER
from dialogue_factors.functions.text import strip


def number_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """Strip, drop empty lines, split at the first space into `number` and `rest`.

    Lines without a space after stripping are dropped.
    """
    return (
        df.withColumn("_line", strip(line))
        .where(F.instr("_line", " ") > 0)
        .withColumn("number", F.substring_index("_line", " ", 1))
        .withColumn("rest", F.expr("substring(_line, instr(_line, ' ') + 1)"))
        .drop("_line")
    )


def is_persona(rest: str = "rest") -> Column:
    return F.col(rest).startswith(PERSONA_MARKER)


def mentions_persona(line: str = "line") -> Column:
    return F.col(line).contains(PERSONA_MARKER)


def persona_fact(rest: str = "rest") -> Column:
    """Persona text with every marker removed."""
    return strip(F.replace(F.col(rest), F.lit(PERSONA_MARKER), F.lit("")))


def persona_fact_between(line: str = "line") -> Column:
    """Persona text between the first and the second marker."""
    return strip(F.get(F.split(F.col(line), re.escape(PERSONA_MARKER), 3), F.lit(1)))


def dialogue_fields(rest: str = "rest") -> Column:
    return F.split(F.col(rest), FIELD_SEPARATOR)


def is_dialogue(rest: str = "rest", exactly_two: bool = False) -> Column:
    """A line with a tab; `exactly_two` refuses lines that carry further fields."""
    if exactly_two:
        return F.size(dialogue_fields(rest)) == 2
    return F.col(rest).contains(FIELD_SEPARATOR)


def classify_lines(numbered: DataFrame, exactly_two: bool = False) -> DataFrame:
    """Add what a line is and holds: start, persona fact, or the two sides of a turn."""
    persona = is_persona()
    dialogue = ~persona & is_dialogue(exactly_two=exactly_two)
    side = lambda i: F.when(dialogue, strip(F.get("_fields", F.lit(i))))
    # Split once, as a column of its own, for both sides of a turn.
    return numbered.withColumn("_fields", dialogue_fields()).select(
        *numbered.columns,
        (persona & (F.col("number") == FIRST_LINE_NUMBER)).alias("is_start"),
        persona.alias("is_persona"),
        dialogue.alias("is_dialogue"),
        F.when(persona, persona_fact()).alias("fact"),
        side(0).alias("said"),
        side(1).alias("reply"),
    )
