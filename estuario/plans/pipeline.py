"""The whole pipeline: bronze to silver, gate, star schema, published views, with one kept frame at the edge of each layer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml, gold, instants, qc, silver
from ..operators.skew import salted_join
from ..session import checkpoint


@dataclass(frozen=True)
class Params:
    version: str
    salt: str
    now: str


def run(spark: SparkSession, src: dict[str, DataFrame], params: Params, *, cases: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = checkpoint) -> dict[str, DataFrame]:
    """Every layer by name, from arquivo, registro and fuso_arquivo (and the accounts loaded so far).

    ``keep`` materialises the four frames that many others read: dated captures, gate, promoted posts, mention pairs. By default they go to
    the checkpoint folder; a caller may write and read back tables instead, or pass the frame through. All else is lazy, so Catalyst
    prunes what the caller does not write. Posts of cases that fail the gate are not promoted."""
    cases = cases if cases is not None else gold.cases(spark)
    norm = silver.normalise(src["registro"], src["arquivo"])
    dated = instants.to_instants(norm, src["fuso_arquivo"]).withColumn("created_at", F.timestamp_micros("instante_us").cast("timestamp_ntz")).drop("instante_us", "situacao", "fuso")
    dated = keep(dated)
    dedup = silver.deduplicate(dated)
    results = qc.battery(dated, dedup, src["arquivo"], params.version, params.now)
    gate = keep(qc.gate(results))
    promoted = silver.promotable(dedup, gate, params.version)
    accounts = silver.accounts(promoted)
    if "conta" in src:
        accounts = dml.upsert(src["conta"].select("handle", "id_nativo"), accounts, ["handle"], ["id_nativo"])
    account = accounts.withColumn("conta_id", F.xxhash64(F.lit("x"), "handle"))
    key = account.select("handle", "conta_id")
    # a few handles write, are answered and are mentioned most, so all three joins salt them
    post = promoted.withColumns({"postagem_id": F.xxhash64(F.lit("x"), "caso_slug", "id_nativo"), "_a": F.lower("autor_handle"), "_r": F.col("ref_handle")})
    post = salted_join(post, key.select(F.col("handle").alias("_a"), F.col("conta_id").alias("autor_conta_id")), "_a", spread=F.col("postagem_id"), hot_from=promoted.select(F.lower("autor_handle").alias("_a")))
    post = salted_join(post, key.select(F.col("handle").alias("_r"), F.col("conta_id").alias("ref_conta_id")), "_r", spread=F.col("postagem_id"), hot_from=promoted.select(F.col("ref_handle").alias("_r")))
    post = keep(post.drop("_a", "_r"))
    named = post.select("postagem_id", F.explode("mencoes").alias("m")).select("postagem_id", F.lower("m.handle").alias("handle"))
    pair = salted_join(named, key, "handle", how="inner", spread=F.col("postagem_id")).select("postagem_id", "conta_id").distinct()
    label = post.where(F.col("stance_previa").isNotNull()).select("postagem_id", F.col("stance_previa").alias("rotulo"), F.lit(params.version).alias("versao"))
    cal = gold.calendar(post, cases)
    pairs = keep(gold.mentions_of(post, pair))
    roles = gold.roles(post, pairs, cases)
    stanced = gold.labelled(post, label, params.version)
    edges = gold.edges(pairs, stanced, roles, cal)
    return {
        "qc_resultado": results, "gate": gate, "conta": account, "postagem": post, "mencao": pair, "classificacao": label,
        "captura": post.select("postagem_id", "likes", "retweets", "quotes", "respostas", "capturas"), "postagem_hashtag": silver.hashtag_pairs(promoted),
        "calendario_caso": cal, "dim_conta_papel": roles, "fato_atividade": gold.activity(stanced, post, cal), "fato_referencia": gold.references(stanced, cases, cal), "fato_rede": gold.network(pairs, cases),
        "grafo_arestas": edges, "v_grafo_arestas": gold.published_edges(edges, params.salt), "v_grafo_nos": gold.published_nodes(roles, stanced, params.salt),
    }
