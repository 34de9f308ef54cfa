"""Decision layer: risk dimensions as expressions, and budgets over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def blast_radius(n: Column) -> Column:
    """0 to 10 by the number of affected symbols, in pieces."""
    return (
        F.when(n == 0, 0.0).when(n <= 3, 2.0).when(n <= 10, 4 + 0.3 * (n - 4)).when(n <= 20, 6 + 0.2 * (n - 11)).when(n <= 50, 8 + 0.07 * (n - 21)).otherwise(10.0)
    )


def coupling(projects: Column) -> Column:
    return F.when(projects <= 1, 0.0).when(projects <= 3, 4.0).when(projects <= 10, 7.0).otherwise(9.0)


def breaking(risk: Column, sites: Column, private: Column) -> Column:
    """By the gravest risk, 1 or 2 more for over 10 or 20 call sites; private targets count two fifths, from 2 up."""
    base = F.when(risk == "high", 8.0).when(risk == "moderate", 6.0).when(risk == "low", 3.0).otherwise(0.0)
    score = F.least(base + F.when(sites > 20, 2.0).when(sites > 10, 1.0).otherwise(0.0), F.lit(10.0))
    return F.when(private & (score > 3), F.greatest(F.lit(2.0), score * 0.4)).otherwise(score)


def untested(targets: Column, callers: Column) -> Column:
    """10 without any tests, 0 with all targets and callers tested, which weigh 0.6 and 0.4."""
    return 10 * (1 - (0.6 * targets + 0.4 * callers))


def depth(dependencies: Column, levels: Column, long: Column) -> Column:
    """Half a point a dependency up to 5, 0.8 a level up to 3, one a long function up to 2."""
    return F.least(0.5 * dependencies, F.lit(5.0)) + F.least(0.8 * levels, F.lit(3.0)) + F.least(long, F.lit(2))


def rollback(*signals: Column) -> Column:
    """By the number of signals that are true: 0, 3, 5, 7, 8.5, then 9 and half a point each, at most 10."""
    n = sum((F.when(s, 1).otherwise(0) for s in signals), F.lit(0))
    return F.when(n == 0, 0.0).when(n == 1, 3.0).when(n == 2, 5.0).when(n == 3, 7.0).when(n == 4, 8.5).otherwise(F.least(9.0 + 0.5 * (n - 5), F.lit(10.0)))


def level(score: Column) -> Column:
    return F.when(score >= 7, "high").when(score >= 4, "medium").otherwise("low")


def overall(score: Column) -> Column:
    return F.when(score >= 8, "high").when(score >= 5, "moderate").when(score >= 2, "low").otherwise("safe")


def within_budget(rows: DataFrame, group: str, order: list, tokens: str, budget: int) -> DataFrame:
    """The first rows of each group, in ``order``, whose tokens fit ``budget`` together, with the running sum."""
    used = F.sum(tokens).over(W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("used", used).where(F.col("used") <= budget)
