"""Table changes as pure functions of (target, source): nothing is written, the caller persists the result.

Plain Parquet has neither MERGE nor DELETE, and a table must not be overwritten while it is read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str], fill_null: list[str]) -> DataFrame:
    """Rows of both; where the key is in both, the target's, with the columns ``fill_null`` taken from the source where the target has null."""
    t, s = target.alias("t"), source.alias("s")
    on = reduce(lambda a, b: a & b, [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys])
    mine = F.col("t._in").isNotNull()

    def pick(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"t.{c}", f"s.{c}")
        theirs = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        return F.when(mine, F.coalesce(f"t.{c}", theirs) if c in fill_null else F.col(f"t.{c}")).otherwise(theirs)

    return target.withColumn("_in", F.lit(1)).alias("t").join(s, on, "full").select(*[pick(c).alias(c) for c in t.columns])


def insert_only(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The target and those source rows whose key it lacks."""
    return target.unionByName(source.join(target.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def replace_groups(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Delete and insert: the groups named in the source come from it alone, the others stay."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def keep_first(target: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``."""
    return target.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def delete_where(target: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(doomed.select(*keys), keys, "left_anti")


def update(target: DataFrame, **values: Column) -> DataFrame:
    """The whole table with the given columns set anew, in their own types."""
    kinds = dict(target.dtypes)
    return target.withColumns({c: v.cast(kinds[c]) for c, v in values.items()})


def quarantine(target: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, set aside): the first row per key in ``order``, and all others, to be written to a table of their own before the target is."""
    n = target.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return n.where("_n = 1").drop("_n"), n.where("_n > 1").drop("_n")


def described(df: DataFrame, comments: dict[str, str]) -> DataFrame:
    """The frame with column comments in the metadata of its fields, as a view's definition would carry them; columns without one stay as they are."""
    return df.select(*[F.col(c).alias(c, metadata={"comment": comments[c]}) if c in comments else F.col(c) for c in df.columns])


def create_view(df: DataFrame, name: str, comments: dict[str, str] | None = None) -> DataFrame:
    """Registers (or replaces) the frame as a view of the session, with column comments."""
    out = described(df, comments or {})
    out.createOrReplaceTempView(name)
    return out


def new_files(inventory: DataFrame, known: DataFrame, key: str = "sha256") -> DataFrame:
    """Files whose content is not known yet, whatever their name; one of several with equal content."""
    return keep_first(inventory.join(known.select(key), key, "left_anti"), [key], ["uri"])
