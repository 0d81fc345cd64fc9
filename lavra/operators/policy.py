"""A policy as data: rules with a condition, a level, a precedence; evaluated as column expressions.

Rules are rows of Rule; which ones there are is the caller's matter. For every event the matched rules
form an ordered chain of evidence; the level is the most severe of those that are not contextual, and
the principal rule the first in precedence among the ones at that level. No join and no UDF is needed.

Edge cases: a condition that is null does not match; without a match the level is the lowest and the
principal rule a dash; the same rule may match twice under two entries.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEVERITY = {"Baixo": 1, "Médio": 2, "Alto": 3, "Crítico": 4, "REVISAR": 5}


@dataclass(frozen=True)
class Rule:
    id: str
    when: str  # a SQL condition on the event's columns
    level: str
    contextual: bool = False
    active: bool = True


def evaluate(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds achados (array<struct<regra, nivel, contextual>>), nivel, principal."""
    none = F.lit(None).cast("struct<contextual:boolean,menos:int,ordem:int,regra:string,nivel:string>")
    entries = [
        F.when(
            F.coalesce(F.expr(r.when), F.lit(False)),
            F.struct(F.lit(r.contextual).alias("contextual"), F.lit(-SEVERITY[r.level]).alias("menos"), F.lit(i).alias("ordem"), F.lit(r.id).alias("regra"), F.lit(r.level).alias("nivel")),
        ).otherwise(none)
        for i, r in enumerate(rules)
        if r.active
    ]
    # the sort key (contextual, -severity, precedence) comes first in the struct
    chain = F.array_sort(F.array_compact(F.array(*entries))) if entries else F.array().cast("array<struct<contextual:boolean,menos:int,ordem:int,regra:string,nivel:string>>")
    top = F.when(F.size("achados") > 0, F.get("achados", F.lit(0)))
    top = F.when(~top["contextual"], top)
    return events.withColumn("achados", chain).withColumns({"nivel": F.coalesce(top["nivel"], F.lit("Baixo")), "principal": F.coalesce(top["regra"], F.lit("—"))})


def chain(evaluated: DataFrame, key: str = "id") -> DataFrame:
    """<key>, posicao, regra, nivel, contextual: the evidence, one row per matched rule."""
    return evaluated.select(key, F.posexplode("achados").alias("p", "x")).select(key, (F.col("p") + 1).alias("posicao"), "x.regra", "x.nivel", "x.contextual")


def transitions(events: DataFrame, before: list[Rule], after: list[Rule]) -> DataFrame:
    """de, para, n: how levels change when the rules are replaced. Both are evaluated in the same pass."""
    a = evaluate(events, before).withColumnRenamed("nivel", "de").drop("achados", "principal")
    b = evaluate(a, after).withColumnRenamed("nivel", "para")
    return b.groupBy("de", "para").agg(F.count("*").alias("n"))


def overlay(rules: list[Rule], changes: dict[str, dict]) -> list[Rule]:
    """The same rules with some fields replaced: a candidate policy."""
    return [replace(r, **changes.get(r.id, {})) for r in rules]
