"""One surviving record per post, chosen field by field."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.skew import hot_keys

#: Trust in the sources where both fill a field; others, and unknown ones, come last.
PRIORITY = {"graphql": 2, "consolidado": 1}
#: The fields that count for completeness.
FILLED = ("autor_handle", "autor_id_nativo", "created_at", "texto", "idioma", "tipo_ref", "fonte", "stance_previa")
#: All fields of which the best value survives.
FIELDS = FILLED + ("ref_status_id", "ref_handle", "mencoes", "hashtags")
#: Counters of which the greatest usable value survives.
COUNTERS = ("likes", "retweets", "quotes", "respostas")


#: The decimal digits of all scripts and widths, by the rule of their Unicode value, and the wide full stop.
_DIGITS = [chr(c) for c in range(0x80, sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Nd"]
WIDE = "".join(_DIGITS) + "．"
NARROW = "".join(str(unicodedata.digit(c)) for c in _DIGITS) + "."


def native_number(c: Column) -> Column:
    """The native id meant: bare digits without leading zeros; null where it is null, blank or no number.

    White space of any kind, marks that cannot be seen and quotes are dropped, digits of any width become plain ones; ``.0`` and
    powers of ten are written out.
    """
    c = F.when(c.rlike(r"[^\x00-\x7F]"), F.translate(c, WIDE, NARROW)).otherwise(c)
    s = F.regexp_replace(c, r"[\s\p{Z}\p{Cf}\x{85}\"'`´‘’“”]+|^\+", "")
    whole = F.when(s.rlike(r"^\d+(\.0*)?$"), F.regexp_replace(F.regexp_replace(s, r"\.0*$", ""), r"^0+(?=\d)", ""))
    power = F.when(s.rlike(r"^\d+(\.\d+)?[eE]\+?\d+$"), s.try_cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, power)


def filled(c: str, kind: str) -> Column:
    """Neither null nor, for text, blank (only white space of any kind)."""
    return F.coalesce(~F.col(c).rlike(r"^[\s\p{Z}\x{85}]*$"), F.lit(False)) if kind == "string" else F.coalesce(F.array_size(c) > 0, F.lit(False)) if kind.startswith("array") else F.col(c).isNotNull()


#: Bits of the shared order key below the source priority: microseconds between the years 2600 before and 6500 after our era.
_TIME_BITS, _MOST = 58, 15


def _order(ranks: dict[str, int]) -> Column:
    """(source priority, atualizado_em) as one number, null dates first, so that no field carries a copy of both."""
    rank = F.lit(0)
    for name, n in ranks.items():
        rank = F.when(F.lower(F.trim("fonte")) == name, n).otherwise(rank)
    half = F.lit(1 << (_TIME_BITS - 1))
    time = F.coalesce(F.least(F.greatest(F.unix_micros(F.col("atualizado_em").cast("timestamp")), 1 - half), half - 1) + half, F.lit(0))
    return rank.cast("bigint") * F.lit(1 << _TIME_BITS) + time


def _reduced(rows: DataFrame, keys: list[str], fields: list[str], kinds: dict[str, str]) -> DataFrame:
    """The one aggregate of the method over rows that are partitioned by ``keys``: the maximum of a composite for every field.

    A repeated dedup_id counts once: rows are sorted by it, and only the first of each adds its capturas.
    """
    first = ~F.coalesce(F.lag("dedup_id").over(W.partitionBy(*keys).orderBy("dedup_id", F.desc("_capturas"))) == F.col("dedup_id"), F.lit(False))
    ok = lambda c: filled(c, kinds[c])
    best = F.struct(sum(ok(c).cast("int") for c in FILLED).alias("n"), "atualizado_em", (-F.col("dedup_id")).alias("d"))
    return rows.withColumn("_primeira", first).groupBy(*keys).agg(
        F.count_if(F.col("_primeira") & F.col("dedup_id").isNotNull()).alias("linhas"),
        F.sum(F.when(F.col("_primeira"), F.col("_capturas"))).alias("capturas"),
        F.max(best).alias("_best"),
        *[F.max(F.when(F.col(c) >= 0, F.struct(F.col(c).cast("bigint").alias("v")))).alias(f"_n_{c}") for c in COUNTERS],
        *[F.max(F.when(ok(c), F.struct(F.col("_ordem").alias("o"), F.col(c).alias("v")))).alias(f"_f_{c}") for c in fields],
    )


def survivors(df: DataFrame, *, priority: dict[str, int] | None = None) -> DataFrame:
    """One row per (caso_slug, native id): linhas (number of dedup_ids), capturas, counters, the best value of every field and dedup_id.

    Each field is the maximum of the composite (filled, source priority, atualizado_em, value), so fields of one survivor may come
    from different rows; ``dedup_id`` names the row with the most fields of :data:`FILLED`, then the latest, then the smallest.
    capturas is the sum over the dedup_ids, a counter the greatest value that is neither null nor negative (else null).

    The rows of a post meet in one exchange by (caso_slug, id) and one aggregate with all composites. Posts that hold more rows than
    an average partition are found by exact counts (a bounded list); their rows go to several partitions by dedup_id and the few
    partial survivors are merged, so a post with a third of all rows is the work of many tasks. At the end every survivor is checked to have
    at least as many filled fields as its best row.
    Rows with null, blank or unreadable id, or without a case, belong to no post. Null dates come before all others, ties go to the
    greater value, columns not named here are ignored, and an empty table gives an empty result. Priorities are 0 to 15.
    """
    kinds = dict(df.dtypes)
    ranks = priority or PRIORITY
    if any(not 0 <= n <= _MOST for n in ranks.values()):
        raise ValueError(f"priorities are 0 to {_MOST}")
    fields = [c for c in FIELDS if c in kinds]
    keys = ["caso_slug", "_id"]
    own = [c for c in dict.fromkeys((*fields, *COUNTERS, "dedup_id", "atualizado_em"))]
    base = df.select("caso_slug", native_number(F.col("id_nativo")).alias("_id"), F.col("capturas").cast("bigint").alias("_capturas"), _order(ranks).alias("_ordem"), *own)
    base = base.where(F.col("_id").isNotNull() & F.col("caso_slug").isNotNull())
    post = F.xxhash64(*keys)
    hot = hot_keys(base.select(post.alias("_post")), "_post").collect()  # bounded, see hot_keys
    if not hot:
        out = _reduced(base.repartition(*keys), keys, fields, kinds)
    else:
        h = F.broadcast(df.sparkSession.createDataFrame(hot, "_post bigint, _sais int"))
        marked = base.withColumn("_post", post)
        out = _reduced(marked.join(h, "_post", "left_anti").repartition(*keys), keys, fields, kinds)
        spread = marked.join(h, "_post").withColumn("_sal", F.pmod(F.xxhash64("dedup_id"), F.col("_sais")))
        parts = _reduced(spread.repartition(*keys, "_sal"), [*keys, "_sal"], fields, kinds)
        best = [c for c in parts.columns if c.startswith(("_best", "_n_", "_f_"))]
        out = out.unionByName(parts.groupBy(*keys).agg(F.sum("linhas").alias("linhas"), F.sum("capturas").alias("capturas"), *[F.max(c).alias(c) for c in best]))
    whole = sum(F.col(f"_f_{c}").isNotNull().cast("int") for c in FILLED) >= F.col("_best.n")
    chosen = F.when(whole, -F.col("_best.d")).otherwise(F.raise_error(F.lit("a survivor has fewer fields than its best row")).cast("bigint"))
    return out.select(
        "caso_slug", F.col("_id").alias("id_nativo"), "linhas", "capturas", *[F.col(f"_n_{c}.v").alias(c) for c in COUNTERS], *[F.col(f"_f_{c}.v").alias(c) for c in fields], chosen.alias("dedup_id")
    )
