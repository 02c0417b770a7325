"""Counting, ordering and printing answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcq.plans.components import Component, variable_order


def answer_count(answers: DataFrame) -> DataFrame:
    """(answers long): how many; a query without free variables has one answer or none."""
    if answers.columns == ["satisfied"]:
        return answers.select(F.col("satisfied").cast("long").alias("answers"))
    return answers.agg(F.count("*").alias("answers"))


def first_answers(answers: DataFrame, n: int = 5, order: list[str] | None = None) -> DataFrame:
    """The first `n` by the given variables, then by the others, ascending: a top-n per task, never a full sort."""
    given = [v for v in order or [] if v in answers.columns]
    return answers.orderBy(*given, *[c for c in answers.columns if c not in given]).limit(n)


def print_order(components: list[Component]) -> list[str]:
    """The order of variables that answers are listed by."""
    return variable_order(components)


def format_answer(row) -> str:
    return "{" + ", ".join(f"?{k}={v}" for k, v in row.asDict().items()) + "}"
