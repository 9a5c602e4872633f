"""Bronze to silver: one schema, one row per post, accounts, posts, captures, mentions, hashtags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_to_null, clean_text, is_blank, reference_kind
from . import drift

COUNTERS = ("likes", "retweets", "quotes", "respostas")


def normalise(registro: DataFrame, arquivo: DataFrame) -> DataFrame:
    """All dialects in the 21 columns of the silver input: the one table of :mod:`drift` with case, source and derived reference kind."""
    files = arquivo.select("arquivo_id", "caso_slug").groupBy("arquivo_id").agg(F.min("caso_slug").alias("caso_slug"))
    return (
        drift.one_table(registro, arquivo, optional=False)
        .where(F.col("fonte").isNotNull())
        .join(files, "arquivo_id")
        .withColumn("tipo_ref", reference_kind(F.col("ref_status_id"), F.col("ref_handle"), F.coalesce("eh_quote", F.lit(False))))
        .drop("impressao", "extras")
    )


def deduplicate(norm: DataFrame) -> DataFrame:
    """One row per (caso_slug, id_nativo): attributes of the first capture by (arquivo_id, linha), greatest counters, number of captures.

    One aggregate with map-side partial results: a post with a third of all captures reaches the exchange as one row per task. Captures
    with equal (arquivo_id, linha) are taken by their other columns, so the result does not depend on the order of arrival.
    """
    keys = ["caso_slug", "id_nativo"]
    rest = [c for c in norm.columns if c not in (*keys, *COUNTERS, "arquivo_id", "linha")]
    g = norm.groupBy(*keys).agg(F.min(F.struct("arquivo_id", "linha", *rest)).alias("_p"), *[F.max(c).alias(c) for c in COUNTERS], F.count(F.lit(1)).alias("capturas"))
    return g.select(*keys, "_p.*", *COUNTERS, "capturas")


def promotable(dedup: DataFrame, gate: DataFrame, version: str) -> DataFrame:
    """Posts with an author whose case passed the gate of this pipeline version; with their cleaned text."""
    ok = gate.where(F.col("pode_promover") & (F.col("versao_pipeline") == version)).select("caso_slug")
    return dedup.where(~is_blank(F.col("autor_handle"))).join(ok, "caso_slug", "left_semi").withColumn("texto_limpo", clean_text(F.col("texto")))


def accounts(dedup: DataFrame) -> DataFrame:
    """Handle and greatest native id of all authors, mentioned accounts and reply targets."""
    author = dedup.select(F.lower("autor_handle").alias("handle"), F.col("autor_id_nativo").alias("id_nativo"))
    mention = dedup.select(F.explode("mencoes").alias("m")).select(F.lower("m.handle").alias("handle"), F.col("m.id_nativo").alias("id_nativo"))
    target = dedup.select(F.lower("ref_handle").alias("handle"), F.lit(None).cast("string").alias("id_nativo"))
    return author.unionByName(mention).unionByName(target).where(~is_blank(F.col("handle"))).groupBy("handle").agg(F.max("id_nativo").alias("id_nativo"))


def mention_pairs(dedup: DataFrame) -> DataFrame:
    """Distinct (caso_slug, id_nativo, handle) of mentions."""
    return dedup.select("caso_slug", "id_nativo", F.explode("mencoes").alias("m")).select("caso_slug", "id_nativo", F.lower("m.handle").alias("handle")).where(F.col("handle").isNotNull()).distinct()


def hashtag_pairs(dedup: DataFrame) -> DataFrame:
    """Distinct (caso_slug, id_nativo, hashtag)."""
    return dedup.select("caso_slug", "id_nativo", F.explode("hashtags").alias("hashtag")).where(~is_blank(F.col("hashtag"))).distinct()


def prior_labels(dedup: DataFrame) -> DataFrame:
    """Labels that came with the records."""
    return dedup.select("caso_slug", "id_nativo", blank_to_null(F.col("stance_previa")).alias("rotulo")).where(F.col("rotulo").isNotNull())
