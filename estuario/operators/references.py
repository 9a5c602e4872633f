"""References to records that do not exist, were deleted, or arrive after the record that refers to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import salted_join

#: White space of any kind (Java's \s is ASCII only).
BLANKS = r"[\s\p{Z}​﻿]+"


def native_key(c: Column) -> Column:
    """A native id as compared: without white space around and leading zeros; null for blank, zero and negative ones."""
    s = F.regexp_replace(c, rf"^{BLANKS}|{BLANKS}$", "")
    s = F.regexp_replace(s, r"^\+?0+", "")
    return F.when((s == "") | s.startswith("-"), F.lit(None)).otherwise(s)


def surrogate_key(c: Column) -> Column:
    """A surrogate id as compared; null for zero and negative ones."""
    return F.when(c > 0, c.cast("string"))


def broken_references(refs: DataFrame, parents: DataFrame, *, salts: int | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Each reference without a living parent at its time, with the reason.

    ``refs``: dominio, chave, tabela, coluna, registro_id, periodo, visto_em. ``parents``: dominio, chave, valido_de, apagada.
    Both streams are partitioned and sorted by (dominio, chave) and merged linearly (a sort-merge join); references to hot keys
    are spread by salt. A parent's validity interval starts at ``valido_de`` and is empty where it is deleted:
    no interval is ``ausente``, only empty ones ``apagada``, one that starts after ``visto_em`` ``tardia``.

    Null keys are no references. Several parents of one key count together: deleted only if all are, valid from the earliest.
    ``keys`` (dominio, chave of all references) finds the hot keys where computing ``refs`` twice would be dear.
    A null ``valido_de`` counts as always valid, a null ``visto_em`` as never too early. Repeated references come out once.
    """
    key = F.concat_ws(":", "dominio", "chave")
    r = refs.where(F.col("chave").isNotNull()).select(key.alias("_k"), "tabela", "coluna", "registro_id", "periodo", "visto_em")
    p = parents.where(F.col("chave").isNotNull()).select(key.alias("_k"), "valido_de", "apagada")
    aggs = [F.min(F.coalesce("valido_de", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("_de"), F.min(F.coalesce("apagada", F.lit(False))).alias("_apagada")]
    hot_from = None if keys is None else keys.select(key.alias("_k"))
    j = salted_join(r, p, "_k", salts=salts, spread=F.xxhash64("registro_id"), hot_from=hot_from, right_aggs=aggs)
    reason = F.when(F.col("_de").isNull(), "ausente").when(F.col("_apagada"), "apagada").when(F.col("_de") > F.col("visto_em"), "tardia")
    return j.withColumn("motivo", reason).where(F.col("motivo").isNotNull()).select("tabela", "coluna", "registro_id", "periodo", "motivo").distinct()


def orphan_references(mencao: DataFrame, postagem: DataFrame, conta: DataFrame, *, salts: int | None = None) -> DataFrame:
    """The broken references of mentions and posts: tabela, coluna, registro_id, periodo (UTC day of the post), motivo."""
    day = F.date_format("created_at", "yyyy-MM-dd")
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    post = postagem.select("postagem_id", day.alias("periodo"), ntz("carregada_em").alias("visto_em"), "id_nativo", "ref_conta_id", "ref_id_nativo", "situacao")
    m = salted_join(
        mencao.select("mencao_id", "postagem_id", "conta_id"),
        post.select("postagem_id", "periodo", "visto_em"),
        "postagem_id",
        salts=salts,
        spread=F.xxhash64("mencao_id"),
        right_aggs=[F.min(F.struct("visto_em", "periodo")).alias("_p")],
    ).select("mencao_id", "conta_id", "_p.periodo", "_p.visto_em")
    mkey, ckey, nkey = surrogate_key(F.col("conta_id")), surrogate_key(F.col("ref_conta_id")), native_key(F.col("ref_id_nativo"))
    one = lambda df, dom, k, tab, col, rid: df.select(F.lit(dom).alias("dominio"), k.alias("chave"), F.lit(tab).alias("tabela"), F.lit(col).alias("coluna"), F.col(rid).alias("registro_id"), "periodo", "visto_em")
    refs = one(m, "conta", mkey, "mencao", "conta_id", "mencao_id").unionByName(one(post, "conta", ckey, "postagem", "ref_conta_id", "postagem_id")).unionByName(one(post, "post", nkey, "postagem", "ref_id_nativo", "postagem_id"))
    bare = lambda df, dom, k: df.select(F.lit(dom).alias("dominio"), k.alias("chave")).where(F.col("chave").isNotNull())
    keys = bare(mencao, "conta", mkey).unionByName(bare(postagem, "conta", ckey)).unionByName(bare(postagem, "post", nkey))
    parents = conta.select(F.lit("conta").alias("dominio"), surrogate_key(F.col("conta_id")).alias("chave"), ntz("criado_em").alias("valido_de"), F.lit(False).alias("apagada")).unionByName(
        post.select(F.lit("post").alias("dominio"), native_key(F.col("id_nativo")).alias("chave"), F.col("visto_em").alias("valido_de"), (F.col("situacao") == "deletada").alias("apagada"))
    )
    return broken_references(refs, parents, salts=salts, keys=keys)


def orphan_counts(broken: DataFrame) -> DataFrame:
    """The report: broken references per table, field, day and reason."""
    return broken.groupBy("tabela", "coluna", "periodo", "motivo").agg(F.count(F.lit(1)).alias("referencias"))
