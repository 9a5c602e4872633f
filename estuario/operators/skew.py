"""Joins and aggregations that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from this share of the rows on, or from the share of one shuffle partition where there are more partitions than that.
HOT_SHARE = 1 / 256


def partitions(df: DataFrame) -> int:
    """The session's shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(df: DataFrame, key: str, share: float | None = None, salts: int | None = None) -> DataFrame:
    """The keys that hold at least ``share`` of the non-null rows, with the number of salts each needs: ``key``, _sais.

    By default a key is hot if it holds 1/256 of the rows, or more than an average shuffle partition where there are more partitions
    than 256; so there are at most max(256, partitions) rows. A key gets as many salts as it holds half partitions, so its parts are no
    larger than others, whatever the size of the data; ``salts`` fixes the number instead.
    Counted exactly, with map-side partial counts, over all rows. Nulls never match in an equi-join and are left out.
    """
    p = partitions(df)
    share = share if share is not None else min(HOT_SHARE, 1 / p)
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("_t")).scalar()
    need = F.lit(salts) if salts else F.greatest(F.lit(2), F.ceil(F.col("_n") * F.lit(2 * p) / total))
    return n.where(F.col("_n") >= total * F.lit(share)).select(key, need.cast("int").alias("_sais"))


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    *,
    salts: int | None = None,
    how: str = "left",
    spread: Column | None = None,
    share: float | None = None,
    hot_from: DataFrame | None = None,
    right_aggs: list[Column] | None = None,
) -> DataFrame:
    """Equi-join on ``key`` as a sort-merge join in which the rows of each hot key of ``left`` are spread over its salts (see :func:`hot_keys`).

    The rows of ``right`` that have a hot key are repeated once per salt of it. With ``right_aggs`` the right
    side is first reduced to one row per key, in the same exchange as the join. ``hot_from`` (a frame with ``key``) finds the hot
    keys where computing ``left`` twice would be dear. ``spread`` chooses the salt of a left row (default: a hash of the whole row).
    Null keys match nothing. ``how`` is left, inner, left_semi or left_anti. Empty inputs give an empty (or unmatched) result.
    """
    # bounded: at most max(256, shuffle partitions) rows
    h = F.broadcast(hot_keys(left if hot_from is None else hot_from, key, share, salts).select(F.col(key).alias("_hk"), "_sais"))
    spread = F.xxhash64(*left.columns) if spread is None else spread
    lt = left.join(h, F.col(key) == F.col("_hk"), "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_sais")).cast("int"), F.lit(0))).drop("_hk", "_sais")
    rt = right.join(h, F.col(key) == F.col("_hk"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_sais", F.lit(1)) - 1))).drop("_hk", "_sais")
    if right_aggs:
        rt = rt.where(F.col(key).isNotNull()).groupBy(key, "_salt").agg(*right_aggs)
    return lt.join(rt.hint("merge"), [key, "_salt"], how).drop("_salt")


@dataclass
class Side:
    """One input of :func:`eager_join_aggregate`: sums and distinct counts wanted of it, by output name."""

    df: DataFrame
    key: str
    rows: str
    sums: dict[str, str] = field(default_factory=dict)
    distincts: dict[str, str] = field(default_factory=dict)

    def compact(self) -> DataFrame:
        """One row per key: rows, sums, distinct counts.

        Spark plans the distinct counts in two phases, first by (key, value) and then by key, each with map-side partial
        aggregation; a key with a third of all rows therefore reaches the last exchange as a few partial rows per task.
        """
        aggs = [F.count(F.lit(1)).alias(self.rows)]
        aggs += [F.sum(F.col(c).cast("bigint")).alias(a) for a, c in self.sums.items()]
        aggs += [F.countDistinct(F.col(c)).alias(a) for a, c in self.distincts.items()]
        return self.df.where(F.col(self.key).isNotNull()).groupBy(F.col(self.key).alias("_key")).agg(*aggs)


def eager_join_aggregate(left: Side, right: Side, *, key: str, how: str = "left", pairs: str | None = None) -> DataFrame:
    """Per-key results over ``left JOIN right`` without ever forming the joined rows.

    Both sides are reduced to one compact row per key before they meet; the counts of the join are the products of the counts,
    the sums of one side are multiplied by the count of the other (``<sum>_join``), distinct counts carry over as they are.

    Rows with a null key belong to no group. Missing on a side counts as 0 rows and 0 distinct values with null sums; sums over nulls
    alone are null too; repeated rows count as often as they stand. Other columns, whatever their names, are never touched.
    """
    a, b = left.compact(), right.compact()
    out = a.join(b, "_key", how).withColumnRenamed("_key", key)
    for n in (left.rows, right.rows, *left.distincts, *right.distincts):
        out = out.withColumn(n, F.coalesce(F.col(n), F.lit(0)).cast("bigint"))
    if pairs:
        out = out.withColumn(pairs, F.col(left.rows) * F.col(right.rows))
        for s in left.sums:
            out = out.withColumn(f"{s}_{pairs}", F.col(s) * F.col(right.rows))
        for s in right.sums:
            out = out.withColumn(f"{s}_{pairs}", F.col(s) * F.col(left.rows))
    return out


def accounts(edges: DataFrame, mentions: DataFrame) -> DataFrame:
    """Per account that is a destination of an edge or of a mention: edges, weight, distinct sources, days, mentions, and the pairs
    edge x mention with their weight, as the join of both tables by account would have them."""
    e = edges.select("destino_conta_id", "origem_conta_id", "data", "peso")
    return eager_join_aggregate(
        Side(e, "destino_conta_id", "arestas", {"peso": "peso"}, {"origens": "origem_conta_id", "dias": "data"}),
        Side(mentions.select("conta_id"), "conta_id", "mencoes"),
        key="destino_conta_id",
        how="full",
        pairs="pares",
    )


def heavy_accounts(edges: DataFrame, share: float = 0.01) -> DataFrame:
    """Accounts that receive at least ``share`` of all rows of the edge table (rows without destination count in the total).

    Both sides of the comparison are compact states of :class:`Side`: the edges by account, and the whole table as one row, whose count every
    state is multiplied against. One row meets all of them as a scalar, so nothing is joined. Repeated rows count; an empty table gives no account.
    """
    e = edges.select("destino_conta_id", F.lit(0).alias("_tudo"))
    per, all_ = Side(e, "destino_conta_id", "arestas").compact(), Side(e, "_tudo", "linhas").compact()
    return per.where(F.col("arestas") >= all_.select("linhas").scalar() * F.lit(share)).select(F.col("_key").alias("destino_conta_id"))
