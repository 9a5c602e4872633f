"""The regression ruler: every layer's key figures as (tabela, metrica, chave, valor) text rows, to be compared before and after a rerun."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def measures(df: DataFrame, table: str, key: str | None, **metrics: str) -> DataFrame:
    """One pass over ``df``: each metric (name = SQL aggregate) by ``key`` or in all."""
    k = F.col(key).cast("string") if key else F.lit("-")
    g = df.groupBy(k.alias("chave")).agg(*[F.expr(sql).cast("string").alias(name) for name, sql in metrics.items()])
    rows = F.array(*[F.struct(F.lit(table).alias("tabela"), F.lit(m).alias("metrica"), F.coalesce("chave", F.lit("nulo")).alias("chave"), F.col(m).alias("valor")) for m in metrics])
    return g.select(F.explode(rows).alias("r")).select("r.*")


def ruler(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def drifted(before: DataFrame, after: DataFrame) -> DataFrame:
    """Measures whose value changed, or that only one side has."""
    k = ["tabela", "metrica", "chave"]
    return before.withColumnRenamed("valor", "antes").join(after.withColumnRenamed("valor", "depois"), k, "full").where(~F.col("antes").eqNullSafe(F.col("depois")))
