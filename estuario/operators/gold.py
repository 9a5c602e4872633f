"""The star schema: calendar, roles, activity and reference facts, daily network, edges, published views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import pseudonym

# The cases with their trigger day and target account.
CASES = [
    ("farol_apagado", "2023-10-23", 2),
    ("jardim_suspenso", "2023-03-11", 1),
    ("ponte_de_vidro", "2024-03-10", 4),
    ("relogio_parado", "2024-10-24", 5),
]
PHASES = ("pre_crise", "estopim", "escalada", "pico", "declinio", "pos_rito")
UNLABELLED, UNKNOWN_KIND, NO_VERSION = "sem_rotulo", "desconhecido", "nenhuma"


def cases(spark: SparkSession) -> DataFrame:
    """A literal row source: caso, estopim, alvo_conta_id."""
    return spark.createDataFrame(CASES, "caso string, estopim string, alvo_conta_id bigint").withColumn("estopim", F.to_date("estopim"))


def calendar(posts: DataFrame, cases: DataFrame) -> DataFrame:
    """caso, data, dias_desde_estopim, fase, volume_postagens.

    The peak is the day of greatest volume on or after the trigger, the earliest on a tie. Phases by precedence: before the trigger,
    the trigger day, before the peak, the peak, at least a quarter of the peak's volume (cut to an integer), after.
    """
    v = posts.where(F.col("created_at").isNotNull()).groupBy(F.lower("caso_slug").alias("caso"), F.to_date("created_at").alias("data")).agg(F.count(F.lit(1)).alias("volume_postagens"))
    v = v.join(F.broadcast(cases.select("caso", "estopim")), "caso").withColumn("dias_desde_estopim", F.datediff("data", "estopim"))
    w = W.partitionBy("caso")
    best = F.max(F.when(F.col("dias_desde_estopim") >= 0, F.struct(F.col("volume_postagens").alias("v"), (-F.col("dias_desde_estopim")).alias("d")))).over(w)
    v = v.withColumn("_p", best)
    d, top = F.col("dias_desde_estopim"), -F.col("_p.d")
    fase = F.when(d < 0, "pre_crise").when(d == 0, "estopim").when(d < top, "escalada").when(d == top, "pico").when(F.col("volume_postagens") >= F.floor(F.col("_p.v") * 0.25), "declinio").otherwise("pos_rito")
    return v.select("caso", "data", "dias_desde_estopim", fase.alias("fase"), "volume_postagens")


def mentions_of(posts: DataFrame, mentions: DataFrame) -> DataFrame:
    """caso, data, postagem_id, origem, destino: distinct pairs post x account."""
    p = posts.select("postagem_id", F.col("caso_slug").alias("caso"), F.to_date("created_at").alias("data"), F.col("autor_conta_id").alias("origem"))
    return mentions.select("postagem_id", F.col("conta_id").alias("destino")).distinct().join(p, "postagem_id").select("caso", "data", "postagem_id", "origem", "destino")


def roles(posts: DataFrame, pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """caso, conta_id, papel_principal, n_postagens_caso, n_mencoes_recebidas_caso, primeiro_dia, ultimo_dia of authors and mentioned accounts.

    Both streams are stacked and aggregated once, instead of a union of keys joined back to two aggregates.
    """
    a = posts.select(F.col("caso_slug").alias("caso"), F.col("autor_conta_id").alias("conta_id"), F.to_date("created_at").alias("data"), F.lit(1).alias("p"), F.lit(0).alias("m"))
    b = pairs.select("caso", F.col("destino").alias("conta_id"), "data", F.lit(0).alias("p"), F.lit(1).alias("m"))
    g = a.unionByName(b).groupBy("caso", "conta_id").agg(F.sum("p").alias("n_postagens_caso"), F.sum("m").alias("n_mencoes_recebidas_caso"), F.min("data").alias("primeiro_dia"), F.max("data").alias("ultimo_dia"))
    g = g.join(F.broadcast(cases.select("caso", "alvo_conta_id")), "caso", "left")
    return g.select("caso", "conta_id", F.when(F.col("conta_id") == F.col("alvo_conta_id"), "alvo").otherwise("demais").alias("papel_principal"), "n_postagens_caso", "n_mencoes_recebidas_caso", "primeiro_dia", "ultimo_dia")


def labels(norm: DataFrame, posts: DataFrame, version: str = "v1") -> DataFrame:
    """postagem_id, rotulo, versao: the label delivered with a post, the alphabetically first where deliveries differ."""
    first = norm.where(F.trim("stance_previa") != "").groupBy("caso_slug", "id_nativo").agg(F.min("stance_previa").alias("rotulo"))
    return posts.select("postagem_id", "caso_slug", "id_nativo").join(first, ["caso_slug", "id_nativo"]).select("postagem_id", "rotulo", F.lit(version).alias("versao"))


def labelled(posts: DataFrame, labels: DataFrame, version: str = "v1") -> DataFrame:
    """The posts with stance of one label version; without a label the named sentinel. One version only, so that rows are never multiplied."""
    lab = labels.where(F.col("versao") == version).select("postagem_id", F.col("rotulo").alias("stance"), F.col("versao").alias("versao_classificacao"))
    return posts.select("postagem_id", F.col("caso_slug").alias("caso"), F.to_date("created_at").alias("data"), F.col("autor_conta_id").alias("autor"), "id_nativo", F.coalesce("tipo_ref", F.lit(UNKNOWN_KIND)).alias("tipo_ref"), "ref_conta_id").join(lab, "postagem_id", "left").fillna({"stance": UNLABELLED, "versao_classificacao": NO_VERSION})


def activity(stanced: DataFrame, captures: DataFrame, cal: DataFrame) -> DataFrame:
    """Posts, distinct authors and sums of each post's greatest counters by case, day, stance, reference kind and label version."""
    best = captures.groupBy(F.col("caso_slug").alias("caso"), "id_nativo").agg(*[F.max(c).cast("bigint").alias(c) for c in ("likes", "retweets", "quotes", "respostas")])
    j = stanced.join(best, ["caso", "id_nativo"], "left").groupBy("caso", "data", "stance", "tipo_ref", "versao_classificacao")
    g = j.agg(F.count(F.lit(1)).alias("n_postagens"), F.countDistinct("autor").alias("n_autores_distintos"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("likes", "retweets", "quotes", "respostas")])
    return g.join(cal.select("caso", "data", "dias_desde_estopim", "fase"), ["caso", "data"], "left")


def references(stanced: DataFrame, cases: DataFrame, cal: DataFrame) -> DataFrame:
    """Posts and authors by case, day, reference kind, addressee (alvo, terceiros, nao_se_aplica), stance and label version."""
    s = stanced.join(F.broadcast(cases.select("caso", "alvo_conta_id")), "caso", "left")
    to = F.when(F.col("tipo_ref") != "reply", "nao_se_aplica").when(F.col("ref_conta_id") == F.col("alvo_conta_id"), "alvo").otherwise("terceiros")
    g = s.withColumn("destinatario", to).groupBy("caso", "data", "tipo_ref", "destinatario", "stance", "versao_classificacao").agg(F.count(F.lit(1)).alias("n_postagens"), F.countDistinct("autor").alias("n_autores_distintos"))
    return g.join(cal.select("caso", "data", "dias_desde_estopim", "fase"), ["caso", "data"], "left")


def network(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Daily measures per case: nodes, edges, mentions, density, Gini and HHI of received mentions, in-degree centralisation, target share.

    Gini by ranks over all nodes, those with no mention included; centralisation on unweighted in-degree. Measures over one node are
    null. The ranks come from the histogram of mentions received (c nodes after r others have the ranks r + 1 ... r + c), which has few
    rows however many nodes a day has, so no task ever sorts the nodes of a day.
    """
    e = pairs.groupBy("caso", "data", "origem", "destino").agg(F.count(F.lit(1)).alias("peso"))
    nodes = e.select("caso", "data", F.explode(F.array(F.struct(F.col("origem").alias("no"), F.lit(0).alias("x"), F.lit(0).alias("g")), F.struct(F.col("destino").alias("no"), F.col("peso").alias("x"), F.lit(1).alias("g")))).alias("s"))
    n = nodes.groupBy("caso", "data", F.col("s.no").alias("no")).agg(F.sum("s.x").alias("x"), F.sum("s.g").alias("g")).join(F.broadcast(cases.select("caso", "alvo_conta_id")), "caso", "left")
    h = n.groupBy("caso", "data", "x").agg(F.count(F.lit(1)).alias("c"), F.sum("g").alias("g"), F.max("g").alias("mx"), F.sum(F.when(F.col("no") == F.col("alvo_conta_id"), F.col("x")).otherwise(0)).alias("xa"))
    r0 = F.sum("c").over(W.partitionBy("caso", "data").orderBy("x")) - F.col("c")
    dbl = lambda c: c.cast("double")
    h = h.withColumn("ranks", dbl(F.col("c")) * dbl(r0) + dbl(F.col("c")) * dbl(F.col("c") + 1) / 2)
    g = h.groupBy("caso", "data").agg(
        F.sum("c").alias("n_nos"), F.sum("g").alias("n_arestas"), F.sum(F.col("c") * F.col("x")).alias("n_mencoes"), F.sum(F.col("ranks") * F.col("x")).alias("ix"), F.sum(dbl(F.col("c")) * F.col("x") * F.col("x")).alias("x2"),
        (F.sum("c") * F.max("mx") - F.sum("g")).alias("falta"), F.sum("xa").alias("xa"),
    )
    N, S = dbl(F.col("n_nos")), dbl(F.col("n_mencoes"))
    r = lambda c: F.round(c, 9)
    z = lambda c: F.nullif(c, F.lit(0.0))
    return g.select(
        "caso", "data", "n_nos", "n_arestas", "n_mencoes",
        r(dbl(F.col("n_arestas")) / z(N * (N - 1))).alias("densidade"),
        r(F.lit(2.0) * F.col("ix") / z(N * S) - (N + 1) / N).alias("gini_mencoes_recebidas"),
        r(F.col("x2") / z(S * S)).alias("hhi_mencoes_recebidas"),
        r(dbl(F.col("falta")) / z((N - 1) * (N - 1))).alias("centralizacao_grau_entrada"),
        r(dbl(F.col("xa")) / z(S)).alias("isolamento_alvo"),
        F.lit(None).cast("double").alias("assortatividade_stance"),
    )


def modal(df: DataFrame, keys: list[str], value: str, alias: str) -> DataFrame:
    """The most frequent value per key, the alphabetically first on a tie."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_n"), value))).where("_i = 1").select(*keys, F.col(value).alias(alias))


def edges(pairs: DataFrame, stanced: DataFrame, roles: DataFrame, cal: DataFrame) -> DataFrame:
    """caso, data, origem_conta_id, destino_conta_id, peso, stance_origem (modal), papel_origem, papel_destino, dias_desde_estopim, fase."""
    s = pairs.join(stanced.select("postagem_id", "stance"), "postagem_id").groupBy("caso", "data", "origem", "destino", "stance").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("caso", "data", "origem", "destino")
    e = s.withColumns({"peso": F.sum("n").over(w), "_i": F.row_number().over(w.orderBy(F.desc("n"), "stance"))}).where("_i = 1")
    e = e.select("caso", "data", F.col("origem").alias("origem_conta_id"), F.col("destino").alias("destino_conta_id"), "peso", F.col("stance").alias("stance_origem"))
    role = roles.where("papel_principal = 'alvo'")  # one account per case
    for end in ("origem", "destino"):
        r = F.broadcast(role.select("caso", F.col("conta_id").alias(f"{end}_conta_id"), F.col("papel_principal").alias(f"papel_{end}")))
        e = e.join(r, ["caso", f"{end}_conta_id"], "left").fillna({f"papel_{end}": "demais"})
    return e.join(cal.select("caso", "data", "dias_desde_estopim", "fase"), ["caso", "data"], "left")


def reconciliation(posts: DataFrame, pairs: DataFrame, activity: DataFrame, network: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """verificacao, caso, esquerda, direita, confere: posts of the fact and of the source; mentions of the network, of the edges and of the
    source; edges of both; edges whose source is the target (none expected); pseudonyms and nodes of the public view.

    A side without rows counts as 0, so a case that is in one layer alone does not agree.
    """
    one = F.count(F.lit(1))
    per = lambda df, check, a, b: df.groupBy("caso").agg(a.cast("bigint").alias("esquerda"), b.cast("bigint").alias("direita")).withColumn("verificacao", F.lit(check))
    none = F.lit(0)
    p, m = posts.select(F.col("caso_slug").alias("caso")), pairs.select("caso")
    sides = [
        per(activity, "postagens", F.sum("n_postagens"), none), per(p, "postagens", none, one),
        per(network, "mencoes_rede", F.sum("n_mencoes"), none), per(m, "mencoes_rede", none, one),
        per(edges, "mencoes_arestas", F.sum("peso"), none), per(m, "mencoes_arestas", none, one),
        per(edges, "pares_arestas", one, none), per(network, "pares_arestas", none, F.sum("n_arestas")),
        per(edges, "alvo_como_origem", F.count_if(F.col("papel_origem") == "alvo"), none),
        per(nodes, "pseudonimo_unico", F.countDistinct("id"), one),
    ]
    both = sides[0]
    for s in sides[1:]:
        both = both.unionByName(s)
    g = both.groupBy("verificacao", "caso").agg(F.sum("esquerda").alias("esquerda"), F.sum("direita").alias("direita"))
    return g.withColumn("confere", F.col("esquerda") == F.col("direita"))


def published_edges(edges: DataFrame, salt: str) -> DataFrame:
    """The public edge view: pseudonyms instead of accounts, no text, no handle."""
    return edges.select("caso", "data", "dias_desde_estopim", "fase", pseudonym(F.col("origem_conta_id"), salt).alias("source"), pseudonym(F.col("destino_conta_id"), salt).alias("target"), F.col("peso").alias("weight"), "stance_origem", "papel_origem", "papel_destino")


def published_nodes(roles: DataFrame, stanced: DataFrame, salt: str) -> DataFrame:
    """The public node view: pseudonym, role, modal stance of authors or nao_autor, counts, days."""
    m = modal(stanced.select("caso", F.col("autor").alias("conta_id"), "stance"), ["caso", "conta_id"], "stance", "stance_modal")
    return roles.join(m, ["caso", "conta_id"], "left").select("caso", pseudonym(F.col("conta_id"), salt).alias("id"), F.col("papel_principal").alias("papel"), F.coalesce("stance_modal", F.lit("nao_autor")).alias("stance_modal"), "n_postagens_caso", "n_mencoes_recebidas_caso", "primeiro_dia", "ultimo_dia")
