"""The catalogue of analytical questions, on the star schema alone (no handle, no text).

Inputs: cal (calendar), roles, act (activity fact), ref (reference fact), net (daily network), ar (edge table), narr (narrative roles).
Shares are rounded to six digits; a ratio over nothing is null. Every arg-max breaks ties by the earlier day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ratio
from .gold import CASES, PHASES

# The narrative roles, and the declared roles of prominent accounts: account, first role, role after the turn, day of the turn.
NARRATIVE_ROLES = ("instituicao_legitimadora", "veiculo", "lider_acusacao", "acusador", "aliado_do_alvo", "aliado_afastado", "vitima_secundaria", "outro")
DECLARED = [
    (3, "instituicao_legitimadora", None, None),
    (6, "veiculo", None, None),
    (7, "aliado_do_alvo", "aliado_afastado", 2),
    (8, "acusador", "lider_acusacao", 1),
    (9, "vitima_secundaria", None, None),
    (10, "outro", None, None),
]
#: Days with fewer nodes, leaders' days with fewer mentions, are not read.
LEAST_NODES, LEAST_MENTIONS, LEADERS = 30, 10, 10
STANCES = ("acusador", "defensor", "neutro")
SERIES = ("parcela_alvo", "parcela_instituicao", "replies_alvo", "parcela_defensora", "likes_defesa", "mira_lideres")


def narrative_roles(spark: SparkSession) -> DataFrame:
    rows = [(c, *d) for c, *_ in CASES for d in DECLARED if d[0] not in {a for k, _, a in CASES if k == c}]
    return spark.createDataFrame(rows, "caso string, conta_id bigint, papel_inicial string, papel_final string, dia_virada int")


def _sum_if(cond: Column, value: str | Column = "peso") -> Column:
    return F.sum(F.when(cond, value if isinstance(value, Column) else F.col(value)).otherwise(0))


def _stance_mix(value: str = "peso") -> list[Column]:
    return [ratio(_sum_if(F.col("stance_origem") == s, value), F.sum(value)).alias(f"de_{s}") for s in STANCES]


def _with_total(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """One aggregate with subtotals: rows by (caso, fase, keys) and, as phase 'todas', by (caso, keys). One scan, one exchange."""
    every, rest = ["caso", "fase", *keys], ["caso", *keys]
    g = df.groupingSets([[F.col(c) for c in every], [F.col(c) for c in rest]], *[F.col(c) for c in every]).agg(F.grouping("fase").alias("_g"), *aggs)
    return g.withColumn("fase", F.when(F.col("_g") == 1, "todas").otherwise(F.col("fase"))).drop("_g")


def peak(cal: DataFrame) -> DataFrame:
    """caso, dia_pico, volume_pico: the day of greatest volume from the trigger on, the earliest on a tie (the trigger itself, maybe)."""
    best = F.max(F.struct(F.col("volume_postagens").alias("v"), (-F.col("dias_desde_estopim")).alias("d"))).alias("b")
    return cal.where("dias_desde_estopim >= 0").groupBy("caso").agg(best).select("caso", (-F.col("b.d")).alias("dia_pico"), F.col("b.v").alias("volume_pico"))


# -- P1, P2: duration and abruptness


def p1_day(cal: DataFrame) -> DataFrame:
    w = W.partitionBy("caso")
    peak = F.max(F.when(F.col("dias_desde_estopim") >= 0, F.col("volume_postagens"))).over(w)
    return cal.select("*", ratio(F.col("volume_postagens"), peak).alias("fracao_do_pico"), F.dayofweek("data").isin(1, 7).alias("fim_de_semana"))


def p1_summary(cal: DataFrame) -> DataFrame:
    pick = lambda fase, c: F.min(F.when(F.col("fase") == fase, F.col(c)))
    pre = F.col("fase") == "pre_crise"
    return cal.groupBy("caso").agg(
        F.min("data").alias("inicio_coleta"), F.max("data").alias("fim_coleta"), F.count(F.lit(1)).alias("dias_coletados"), F.count_if(pre).alias("dias_pre_crise"),
        F.round(F.avg(F.when(pre, F.col("volume_postagens"))), 6).alias("media_pre_crise"), pick("estopim", "volume_postagens").alias("volume_estopim"), pick("pico", "data").alias("data_pico"),
        pick("pico", "volume_postagens").alias("volume_pico"), pick("pos_rito", "data").alias("primeiro_pos_rito"), F.count_if(F.col("fase") == "pos_rito").alias("dias_pos_rito"), F.max("dias_desde_estopim").alias("ultimo_dia"),
    )


def p2_change(cal: DataFrame) -> DataFrame:
    """Day over day: relative change (undefined on the first two days) and change in points of the peak."""
    w = W.partitionBy("caso").orderBy("data")
    before = F.lag("volume_postagens").over(w)
    first = F.row_number().over(w) <= 2
    d = F.col("volume_postagens") - before
    c = cal.join(F.broadcast(peak(cal)), "caso", "left")  # one row per case
    return c.select("caso", "data", "dias_desde_estopim", "volume_postagens", F.when(~first, ratio(d, before)).alias("variacao"), F.round(ratio(d, F.col("volume_pico"), 9) * 100, 6).alias("pontos_do_pico"))


def p2_summary(cal: DataFrame) -> DataFrame:
    c = cal.join(F.broadcast(peak(cal)), "caso", "left")
    after = F.col("dias_desde_estopim") - F.col("dia_pico")
    falls = lambda part: F.min(F.when((after > 0) & (F.col("volume_postagens") < F.lit(part) * F.col("volume_pico")), after))
    pre = F.when(F.col("fase") == "pre_crise", F.col("volume_postagens"))
    top = F.max("volume_pico")
    return c.groupBy("caso").agg(
        F.min(F.when(after == 0, F.col("data"))).alias("data_pico"), F.max("dia_pico").alias("dias_estopim_ate_pico"), top.alias("volume_pico"),
        ratio(top, F.max(F.when(F.col("fase") == "estopim", F.col("volume_postagens")))).alias("razao_pico_estopim"),
        F.when(F.count(pre) >= 3, ratio(top, F.avg(pre))).alias("razao_pico_media_pre"),
        ratio(F.max(F.when(after == 1, F.col("volume_postagens"))), top).alias("fracao_dia_apos_pico"), falls(0.5).alias("dias_pico_ate_metade"), falls(0.25).alias("dias_pico_ate_quarto"),
    )


# -- P3: participation


def _top_of(h: DataFrame, keys: list[str], value: str, n: Column, parts: dict[str, float]) -> DataFrame:
    """Adds, per row of a histogram (value, c accounts), what its accounts give to the top ``part`` of n accounts, for each of ``parts``.

    Accounts with equal values are interchangeable, so the cut by count needs no rank of accounts: of each value it takes as many as
    are left to take. A histogram has few rows, where a case may have most of all accounts.
    """
    ahead = F.sum("c").over(W.partitionBy(*keys).orderBy(F.desc(value))) - F.col("c")
    h = h.withColumns({"_antes": ahead, "_n": n})
    return h.withColumns({name: F.greatest(F.lit(0), F.least("c", F.ceil(F.lit(p) * F.col("_n")) - F.col("_antes"))) * F.col(value) for name, p in parts.items()})


def p3_summary(roles: DataFrame) -> DataFrame:
    """Participation; cuts by count of accounts, not by percent rank, so ties do not swallow them."""
    v = F.col("n_postagens_caso")
    h = roles.groupBy("caso", "n_postagens_caso").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("papel_principal") == "alvo").alias("alvo"))
    authors = F.sum(F.when(v > 0, F.col("c")).otherwise(0))
    h = _top_of(h, ["caso"], "n_postagens_caso", authors.over(W.partitionBy("caso")), {"_t1": 0.01, "_t10": 0.10})
    one, posts = _sum_if(v == 1, "c"), F.sum(F.col("c") * v)
    return h.groupBy("caso").agg(
        F.sum("c").alias("contas_no_caso"), authors.alias("contas_autoras"), _sum_if(v == 0, "c").alias("contas_so_mencionadas"), F.sum("alvo").alias("alvos"), posts.alias("total_postagens"), ratio(posts, authors).alias("postagens_por_autora"),
        one.alias("autoras_com_1_postagem"), ratio(one, authors).alias("parcela_autoras_1_postagem"), F.max(v).alias("max_postagens_uma_conta"), ratio(F.sum("_t1"), posts).alias("parcela_top1pct_autoras"), ratio(F.sum("_t10"), posts).alias("parcela_top10pct_autoras"),
    )


def p3_new_accounts(roles: DataFrame, cal: DataFrame) -> DataFrame:
    n = roles.groupBy("caso", F.col("primeiro_dia").alias("data")).agg(F.count(F.lit(1)).alias("n"))
    run = W.partitionBy("caso").orderBy("data").rangeBetween(W.unboundedPreceding, 0)
    return cal.select("caso", "data").join(n, ["caso", "data"], "left").select("caso", "data", F.coalesce("n", F.lit(0)).alias("contas_novas"), F.coalesce(F.sum("n").over(run), F.lit(0)).alias("acumulado"))


# -- P4: contagion and narrative roles


def with_role(ar: DataFrame, narr: DataFrame) -> DataFrame:
    """The edges with the destination's role at the day: the target, else the declared role valid then, else demais."""
    a = ar.join(F.broadcast(narr.withColumnRenamed("conta_id", "destino_conta_id")), ["caso", "destino_conta_id"], "left")
    late = F.col("dias_desde_estopim") >= F.col("dia_virada")
    return a.withColumn("papel", F.when(F.col("papel_destino") == "alvo", "alvo").when(F.col("papel_inicial").isNull(), "demais").when(late, F.col("papel_final")).otherwise(F.col("papel_inicial")))


def p4_share(ar: DataFrame) -> DataFrame:
    """Share of a day's mentions by principal role of the destination."""
    g = ar.groupBy("caso", "data", "papel_destino").agg(F.sum("peso").alias("mencoes"), F.countDistinct("destino_conta_id").alias("contas"))
    return g.withColumn("parcela", ratio(F.col("mencoes"), F.sum("mencoes").over(W.partitionBy("caso", "data"))))


def p4_day(ar: DataFrame, narr: DataFrame) -> DataFrame:
    g = with_role(ar, narr).groupBy("caso", "data", "dias_desde_estopim", "fase", "papel").agg(F.sum("peso").alias("mencoes"), F.countDistinct("destino_conta_id").alias("contas"), *_stance_mix())
    day = F.sum("mencoes").over(W.partitionBy("caso", "data"))
    return g.withColumns({"mencoes_dia": day, "parcela_dia": ratio(F.col("mencoes"), day)})


def p4_role_summary(ar: DataFrame, narr: DataFrame, cal: DataFrame) -> DataFrame:
    """Per role: accounts, mentions, share, ratio to the target, own peak day and its lag behind the calendar's peak (computed, not assumed)."""
    a = with_role(ar, narr)
    total = a.groupBy("caso", "papel").agg(F.countDistinct("destino_conta_id").alias("contas"), F.sum("peso").alias("mencoes"))
    day = a.where("dias_desde_estopim IS NOT NULL").groupBy("caso", "papel", "dias_desde_estopim").agg(F.sum("peso").alias("m"))
    best = day.groupBy("caso", "papel").agg(F.max(F.struct("m", (-F.col("dias_desde_estopim")).alias("d"))).alias("b")).select("caso", "papel", (-F.col("b.d")).alias("dia_pico_papel"))
    top = peak(cal).select("caso", F.col("dia_pico").alias("_pico"))
    w = W.partitionBy("caso")
    t = total.withColumns({"parcela": ratio(F.col("mencoes"), F.sum("mencoes").over(w)), "razao_vs_alvo": ratio(F.col("mencoes"), F.max(F.when(F.col("papel") == "alvo", F.col("mencoes"))).over(w))})
    return t.join(best, ["caso", "papel"], "left").join(F.broadcast(top), "caso", "left").withColumn("defasagem", F.col("dia_pico_papel") - F.col("_pico")).drop("_pico")


def p4_phase(ar: DataFrame, narr: DataFrame) -> DataFrame:
    """Per phase and in all: mentions by role, most accounts on one day, stance mix weighted by mentions, share."""
    day = with_role(ar, narr).groupBy("caso", "data", "fase", "papel").agg(F.sum("peso").alias("mencoes"), F.countDistinct("destino_conta_id").alias("contas"), *[_sum_if(F.col("stance_origem") == s).alias(f"_{s}") for s in STANCES])
    g = _with_total(day, ["papel"], F.sum("mencoes").alias("mencoes"), F.max("contas").alias("contas"), *[ratio(F.sum(f"_{s}"), F.sum("mencoes")).alias(f"de_{s}") for s in STANCES])
    return g.withColumn("parcela", ratio(F.col("mencoes"), F.sum("mencoes").over(W.partitionBy("caso", "fase"))))


def p4_lag(ar: DataFrame, narr: DataFrame, net: DataFrame, act: DataFrame) -> DataFrame:
    """Peak day of each role among days with enough nodes, its lag behind the target's, and the accusing share of posts that day and the next."""
    ok = p4_day(ar, narr).join(net.where(F.col("n_nos") >= LEAST_NODES).select("caso", "data"), ["caso", "data"], "left_semi").where("dias_desde_estopim IS NOT NULL")
    w = W.partitionBy("caso", "papel").orderBy(F.desc("mencoes"), "dias_desde_estopim")
    peak = ok.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("caso", "papel", F.col("dias_desde_estopim").alias("dia_pico"), "mencoes", "parcela_dia", "de_acusador")
    of_target = F.max(F.when(F.col("papel") == "alvo", F.col("dia_pico"))).over(W.partitionBy("caso"))
    acc = act.where("dias_desde_estopim IS NOT NULL").groupBy("caso", "dias_desde_estopim").agg(ratio(_sum_if(F.col("stance") == "acusador", "n_postagens"), F.sum("n_postagens")).alias("a"))
    same = acc.select("caso", F.col("dias_desde_estopim").alias("dia_pico"), F.col("a").alias("acusacao_no_dia"))
    later = acc.select("caso", (F.col("dias_desde_estopim") - 1).alias("dia_pico"), F.col("a").alias("acusacao_dia_seguinte"))
    return peak.withColumn("defasagem_vs_alvo", F.col("dia_pico") - of_target).join(same, ["caso", "dia_pico"], "left").join(later, ["caso", "dia_pico"], "left")


def p4_overlap(ar: DataFrame, narr: DataFrame) -> DataFrame:
    """Of the accounts that accuse a role, how many accuse the target too: containment and Jaccard."""
    a = with_role(ar.where("stance_origem = 'acusador'"), narr).select("caso", "papel", "origem_conta_id").distinct()
    hit = F.max(F.when(F.col("papel") == "alvo", 1).otherwise(0)).over(W.partitionBy("caso", "origem_conta_id"))
    size = a.where("papel = 'alvo'").groupBy("caso").agg(F.count(F.lit(1)).alias("acusadores_do_alvo"))
    g = a.withColumn("_t", hit).where("papel <> 'alvo'").groupBy("caso", "papel").agg(F.count(F.lit(1)).alias("acusadores_do_papel"), F.sum("_t").alias("tambem_acusam_alvo"))
    both, n, m = F.col("tambem_acusam_alvo"), F.col("acusadores_do_papel"), F.col("acusadores_do_alvo")
    return g.join(F.broadcast(size), "caso").withColumns({"parcela": ratio(both, n), "jaccard": ratio(both, n + m - both)})


# -- P5, P6: concentration


def p5_series(net: DataFrame, cal: DataFrame) -> DataFrame:
    return net.join(cal.select("caso", "data", "dias_desde_estopim", "fase"), ["caso", "data"]).select(
        "caso", "data", "dias_desde_estopim", "fase", "gini_mencoes_recebidas", "hhi_mencoes_recebidas", "centralizacao_grau_entrada", "isolamento_alvo", (F.col("n_nos") >= LEAST_NODES).alias("dia_valido")
    )


def p5_summary(ar: DataFrame) -> DataFrame:
    """Concentration of received mentions per phase and in all, from the histogram of mentions per account."""
    got = _with_total(ar, ["destino_conta_id", "papel_destino"], F.sum("peso").alias("m"))
    h = got.groupBy("caso", "fase", "m").agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("papel_destino") == "alvo").alias("alvo"))
    keys = ["caso", "fase"]
    h = _top_of(h, keys, "m", F.sum("c").over(W.partitionBy(*keys)), {"_t1": 0.01, "_t5": 0.05, "_t10": 0.10})
    total = F.sum(F.col("c") * F.col("m"))
    return h.groupBy(*keys).agg(
        F.sum("c").alias("contas_mencionadas"), total.alias("mencoes"), ratio(F.sum(F.col("alvo") * F.col("m")), total).alias("parcela_alvo"), ratio(F.max("m"), total).alias("parcela_top1_conta"),
        *[ratio(F.sum(f"_t{p}"), total).alias(f"parcela_top{p}pct") for p in (1, 5, 10)], ratio(_sum_if(F.col("m") == 1, "c"), F.sum("c")).alias("parcela_contas_com_1_mencao"),
    )


def p6_summary(net: DataFrame, cal: DataFrame) -> DataFrame:
    """Peak days of volume and of each measure, lags and correlations, in two overlapping windows: all valid days, from the trigger on."""
    s = net.where(F.col("n_nos") >= LEAST_NODES).join(cal, ["caso", "data"]).withColumn("mencoes_alvo", F.round(F.col("n_mencoes") * F.col("isolamento_alvo"), 3))
    s = s.withColumn("janela", F.explode(F.when(F.col("dias_desde_estopim") >= 0, F.array(F.lit("todos"), F.lit("desde_estopim"))).otherwise(F.array(F.lit("todos")))))
    d = (-F.col("dias_desde_estopim")).alias("d")
    top = lambda c: -F.max(F.struct(F.col(c).alias("v"), d))["d"]
    named = {"volume": "volume_postagens", "mencoes_alvo": "mencoes_alvo", "isolamento": "isolamento_alvo", "centralizacao": "centralizacao_grau_entrada", "hhi": "hhi_mencoes_recebidas", "gini": "gini_mencoes_recebidas"}
    g = s.groupBy("caso", "janela").agg(
        *[top(c).alias(f"pico_{n}") for n, c in named.items()],
        F.round(F.corr("volume_postagens", "centralizacao_grau_entrada"), 6).alias("corr_volume_centralizacao"), F.round(F.corr("volume_postagens", "isolamento_alvo"), 6).alias("corr_volume_isolamento"), F.count(F.lit(1)).alias("dias"),
    )
    return g.withColumns({f"defasagem_{n}": F.col(f"pico_{n}") - F.col("pico_volume") for n in ("centralizacao", "isolamento", "mencoes_alvo")})


# -- P7: stance


def p7_day(act: DataFrame) -> DataFrame:
    g = act.groupBy("caso", "data", "stance").agg(F.sum("n_postagens").alias("postagens"))
    return g.withColumn("parcela", ratio(F.col("postagens"), F.sum("postagens").over(W.partitionBy("caso", "data"))))


def p7_phase(act: DataFrame) -> DataFrame:
    n = lambda s, c="n_postagens": _sum_if(F.col("stance") == s, c)
    return _with_total(
        act, [], F.sum("n_postagens").alias("postagens"), *[ratio(n(s), F.sum("n_postagens")).alias(f"parcela_{s}") for s in STANCES], ratio(n("defensor"), n("acusador")).alias("razao_defesa_acusacao"),
        *[ratio(n(s, "likes"), n(s)).alias(f"likes_por_post_{s}") for s in STANCES], ratio(n("defensor", "likes"), F.sum("likes")).alias("parcela_likes_defensor"),
    )


# -- P8: who speaks to whom


def p8_mix(ar: DataFrame) -> DataFrame:
    return ar.groupBy("caso", "fase", F.when(F.col("papel_destino") == "alvo", "alvo").otherwise("demais").alias("destino")).agg(F.sum("peso").alias("mencoes_destino"), *_stance_mix())


def _window_name() -> Column:
    return F.when(F.col("dias_desde_estopim") >= 0, "desde_estopim").otherwise("pre_crise")


def author_stance(ar: DataFrame) -> DataFrame:
    """caso, conta_id, stance_modal (by mentions sent, alphabetical on ties), mencoes_emitidas."""
    n = ar.groupBy("caso", F.col("origem_conta_id").alias("conta_id"), "stance_origem").agg(F.sum("peso").alias("p"))
    w = W.partitionBy("caso", "conta_id")
    return n.withColumns({"_i": F.row_number().over(w.orderBy(F.desc("p"), "stance_origem")), "mencoes_emitidas": F.sum("p").over(w)}).where("_i = 1").select("caso", "conta_id", F.col("stance_origem").alias("stance_modal"), "mencoes_emitidas")


def p8_matrix(ar: DataFrame) -> DataFrame:
    """Mixing matrix author to author: mentions, edges and share by stance of the source and modal stance of the destination."""
    # mentions are reduced to (account, source stance) before they meet the authors, so a hot account is one row per group
    to = ar.groupBy("caso", _window_name().alias("janela"), F.col("destino_conta_id").alias("conta_id"), "stance_origem").agg(F.sum("peso").alias("m"), F.count(F.lit(1)).alias("a"))
    g = to.join(author_stance(ar), ["caso", "conta_id"]).groupBy("caso", "janela", "stance_origem", F.col("stance_modal").alias("stance_destino")).agg(F.sum("m").alias("mencoes"), F.sum("a").alias("arestas"))
    return g.withColumn("e_ij", ratio(F.col("mencoes"), F.sum("mencoes").over(W.partitionBy("caso", "janela"))))


def newman(matrix: DataFrame, classes: tuple[str, ...], alias: str) -> DataFrame:
    """Directed assortativity r = (tr e - sum a_i b_i) / (1 - sum a_i b_i) over the given classes, with its two traces."""
    m = matrix.where(F.col("stance_origem").isin(*classes) & F.col("stance_destino").isin(*classes))
    n = m.groupBy("caso", "janela").agg(F.sum("mencoes").alias("n"), _sum_if(F.col("stance_origem") == F.col("stance_destino"), "mencoes").alias("t"))
    ends = m.select("caso", "janela", F.explode(F.array(F.struct(F.col("stance_origem").alias("s"), F.col("mencoes").alias("o"), F.lit(0).cast("bigint").alias("d")), F.struct(F.col("stance_destino").alias("s"), F.lit(0).cast("bigint").alias("o"), F.col("mencoes").alias("d")))).alias("x"))
    ab = ends.groupBy("caso", "janela", "x.s").agg(F.sum("x.o").alias("o"), F.sum("x.d").alias("d")).groupBy("caso", "janela").agg(F.sum(F.col("o").cast("double") * F.col("d")).alias("ab"))
    obs, exp = F.col("t") / F.col("n").cast("double"), F.col("ab") / (F.col("n").cast("double") * F.col("n"))
    return n.join(ab, ["caso", "janela"]).select("caso", "janela", F.col("n").alias(f"n{alias}"), F.round(obs, 6).alias(f"observada{alias}"), F.round(exp, 6).alias(f"esperada{alias}"), F.round((obs - exp) / F.nullif(1 - exp, F.lit(0.0)), 6).alias(f"r{alias}"))


def p8_newman(m: DataFrame) -> DataFrame:
    """Both coefficients from one mixing matrix (a few dozen rows, best kept before)."""
    return newman(m, STANCES, "").join(newman(m, STANCES[:2], "_sem_neutro"), ["caso", "janela"], "left")


def p8_to_authors(ar: DataFrame) -> DataFrame:
    """Share of mentions whose destination is itself an author."""
    to = ar.groupBy("caso", _window_name().alias("janela"), F.col("destino_conta_id").alias("conta_id")).agg(F.sum("peso").alias("m"), _sum_if(F.col("papel_destino") == "alvo").alias("alvo"))
    authors = ar.select("caso", F.col("origem_conta_id").alias("conta_id")).distinct().withColumn("_a", F.lit(1))
    g = to.join(authors, ["caso", "conta_id"], "left").groupBy("caso", "janela").agg(F.sum("m").alias("mencoes"), _sum_if(F.col("_a").isNotNull(), "m").alias("mencoes_destino_autor"), F.sum("alvo").alias("mencoes_ao_alvo"))
    return g.withColumn("parcela_destino_autor", ratio(F.col("mencoes_destino_autor"), F.col("mencoes")))


# -- P9: spoken to, spoken about


def p9_day(ref: DataFrame, net: DataFrame) -> DataFrame:
    g = ref.groupBy("caso", "data").agg(_sum_if(F.col("destinatario") == "alvo", "n_postagens").alias("replies_alvo"), F.sum("n_postagens").alias("postagens_dia"))
    return g.withColumn("parcela_replies_alvo", ratio(F.col("replies_alvo"), F.col("postagens_dia"))).join(net.select("caso", "data", "isolamento_alvo", "n_nos"), ["caso", "data"]).withColumn("nd", F.col("n_nos") < LEAST_NODES)


def p9_phase(ref: DataFrame, net: DataFrame, cal: DataFrame) -> DataFrame:
    to = lambda k: _sum_if(F.col("destinatario") == k, "n_postagens")
    a = ref.groupBy("caso", "fase").agg(F.sum("n_postagens").alias("postagens"), to("alvo").alias("replies_alvo"), to("terceiros").alias("replies_terceiros"))
    r6 = lambda f: F.round(f("isolamento_alvo"), 6)
    b = net.join(cal.select("caso", "data", "fase"), ["caso", "data"]).groupBy("caso", "fase").agg(r6(F.avg).alias("isolamento_medio"), r6(F.min).alias("isolamento_min"), r6(F.max).alias("isolamento_max"), F.count(F.lit(1)).alias("dias_fase"))
    p, x, y = F.col("postagens"), F.col("replies_alvo"), F.col("replies_terceiros")
    return a.join(b, ["caso", "fase"]).withColumns({"parcela_alvo": ratio(x, p), "parcela_terceiros": ratio(y, p), "razao_alvo_terceiros": ratio(x, y)})


# -- P10: leaders


def p10_most_mentioned(ar: DataFrame, roles: DataFrame, narr: DataFrame) -> DataFrame:
    w = W.partitionBy("caso").orderBy(F.desc("n_mencoes_recebidas_caso"), "conta_id")
    top = roles.where("papel_principal <> 'alvo'").withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= LEADERS)
    j = top.select("caso", "posicao", "conta_id", "n_mencoes_recebidas_caso", "n_postagens_caso").join(author_stance(ar), ["caso", "conta_id"], "left").join(narr, ["caso", "conta_id"], "left")
    return j.withColumns({"lider_regra": F.coalesce(F.col("stance_modal") == "acusador", F.lit(False)), "lider_narrativa": F.coalesce(F.col("papel_inicial").startswith("lider"), F.lit(False))})


def p10_leaders(ar: DataFrame, roles: DataFrame) -> DataFrame:
    """The ten non-target accounts that send most accusing mentions, with their rank by mentions received.

    The top ten are cut before the exchange; the rank is one more than the accounts with more mentions, from their histogram.
    """
    sent = ar.groupBy("caso", F.col("origem_conta_id").alias("conta_id")).agg(_sum_if(F.col("stance_origem") == "acusador").alias("mencoes_acusadoras"), F.sum("peso").alias("mencoes_emitidas"), F.countDistinct("data").alias("dias_ativos"))
    j = sent.join(roles.where("papel_principal <> 'alvo'").select("caso", "conta_id", "n_postagens_caso", "n_mencoes_recebidas_caso"), ["caso", "conta_id"])
    w = W.partitionBy("caso")
    h = j.groupBy("caso", "n_mencoes_recebidas_caso").agg(F.count(F.lit(1)).alias("c"))
    h = h.select("caso", "n_mencoes_recebidas_caso", (F.sum("c").over(w.orderBy(F.desc("n_mencoes_recebidas_caso"))) - F.col("c") + 1).cast("int").alias("posicao_recebidas"))
    top = j.withColumn("posicao", F.row_number().over(w.orderBy(F.desc("mencoes_acusadoras"), F.desc("mencoes_emitidas"), "conta_id"))).where((F.col("posicao") <= LEADERS) & (F.col("mencoes_acusadoras") > 0))
    return top.join(h, ["caso", "n_mencoes_recebidas_caso"]).withColumn("parcela_acusadora", ratio(F.col("mencoes_acusadoras"), F.col("mencoes_emitidas")))


def _poles(ar: DataFrame, leaders: DataFrame) -> DataFrame:
    lead = F.broadcast(leaders.select("caso", F.col("conta_id").alias("destino_conta_id"), F.lit(True).alias("_l")))  # ten per case
    return ar.join(lead, ["caso", "destino_conta_id"], "left").withColumns({"_l": F.coalesce("_l", F.lit(False)), "_t": F.col("papel_destino") == "alvo"})


def p10_pole_day(ar: DataFrame, leaders: DataFrame) -> DataFrame:
    g = _poles(ar, leaders).groupBy("caso", "data", "dias_desde_estopim", "fase")
    return g.agg(F.sum("peso").alias("mencoes"), ratio(_sum_if(F.col("_t")), F.sum("peso")).alias("parcela_alvo"), ratio(_sum_if(F.col("_l")), F.sum("peso")).alias("parcela_lideres"), ratio(F.max(F.when(F.col("_l"), F.col("peso")).otherwise(0)), F.sum("peso")).alias("maior_aresta_lider"))


def p10_pole_phase(ar: DataFrame, leaders: DataFrame) -> DataFrame:
    t, lead = _sum_if(F.col("_t")), _sum_if(F.col("_l"))
    return _poles(ar, leaders).groupBy("caso", "fase").agg(F.sum("peso").alias("mencoes"), ratio(t, F.sum("peso")).alias("parcela_alvo"), ratio(lead, F.sum("peso")).alias("parcela_lideres"), ratio(lead, t).alias("razao_lideres_alvo"))


def p10_tension(ar: DataFrame, leaders: DataFrame) -> DataFrame:
    """What each leader sends per phase, beside what it receives (either may be missing)."""
    who = F.broadcast(leaders.select("caso", "conta_id", F.concat(F.lit("L"), F.col("posicao")).alias("rotulo")))
    out = ar.withColumnRenamed("origem_conta_id", "conta_id").join(who, ["caso", "conta_id"]).groupBy("caso", "rotulo", "fase").agg(
        F.sum("peso").alias("emitidas"), F.countDistinct("data").alias("dias_ativos"), ratio(F.sum("peso"), F.countDistinct("data")).alias("por_dia"), F.countDistinct("destino_conta_id").alias("destinos"),
        ratio(_sum_if(F.col("papel_destino") == "alvo"), F.sum("peso")).alias("parcela_ao_alvo"), ratio(_sum_if(F.col("stance_origem") == "acusador"), F.sum("peso")).alias("parcela_acusadora"),
    )
    got = ar.withColumnRenamed("destino_conta_id", "conta_id").join(who, ["caso", "conta_id"]).groupBy("caso", "rotulo", "fase").agg(F.sum("peso").alias("recebidas"))
    none = F.lit("-")  # a null phase is a group of its own
    key = lambda d: d.withColumn("fase", F.coalesce("fase", none))
    return key(out).join(key(got), ["caso", "rotulo", "fase"], "full").withColumn("fase", F.nullif("fase", none)).fillna({"emitidas": 0, "recebidas": 0})


# -- P11: series, signatures, direction


def p11_series(net: DataFrame, cal: DataFrame, ar: DataFrame, narr: DataFrame, ref: DataFrame, act: DataFrame, leaders: DataFrame) -> DataFrame:
    """Six daily series from five facts, each aggregated before it is joined."""
    base = net.join(cal.select("caso", "data", "dias_desde_estopim", "fase"), ["caso", "data"]).select("caso", "data", "dias_desde_estopim", "fase", "n_nos", F.round("isolamento_alvo", 6).alias("parcela_alvo"))
    role = with_role(ar.withColumn("papel_destino", F.lit("-")), narr).groupBy("caso", "data").agg(ratio(_sum_if(F.col("papel") == "instituicao_legitimadora"), F.sum("peso")).alias("parcela_instituicao"))
    rep = ref.groupBy("caso", "data").agg(ratio(_sum_if(F.col("destinatario") == "alvo", "n_postagens"), F.sum("n_postagens")).alias("replies_alvo"))
    d = lambda c: ratio(_sum_if(F.col("stance") == "defensor", c), F.sum(c))
    defence = act.groupBy("caso", "data").agg(d("n_postagens").alias("parcela_defensora"), d("likes").alias("likes_defesa"))
    aim = ar.withColumnRenamed("origem_conta_id", "conta_id").join(F.broadcast(leaders.select("caso", "conta_id")), ["caso", "conta_id"], "left_semi")
    aim = aim.groupBy("caso", "data").agg(F.when(F.sum("peso") >= LEAST_MENTIONS, ratio(_sum_if(F.col("papel_destino") == "alvo"), F.sum("peso"))).alias("mira_lideres"), F.sum("peso").alias("mencoes_lideres"))
    for part in (role, rep, defence, aim):
        base = base.join(part, ["caso", "data"], "left")
    return base.withColumn("nd", F.col("n_nos") < LEAST_NODES)


#: Phases with fewer posts don't count for the range of replies.
LEAST_POSTS = 30


def p11_static(net: DataFrame, roles: DataFrame, series: DataFrame, newman: DataFrame, poles: DataFrame, answers: DataFrame) -> DataFrame:
    """The seven static signatures per case: median Gini (an observed value), share of authors with one post, greatest institutional share on
    a day, mean target share after the trigger, assortativity without neutral from the trigger on, leaders' greatest share in a phase,
    and the least and greatest replies to the target per reply to a third in phases after the trigger."""
    g = net.where(F.col("n_nos") >= LEAST_NODES).groupBy("caso").agg(F.percentile_approx("gini_mencoes_recebidas", 0.5, 1_000_000).alias("gini_mediano"))
    a = roles.where("n_postagens_caso > 0").groupBy("caso").agg(ratio(F.count_if(F.col("n_postagens_caso") == 1), F.count(F.lit(1))).alias("autoras_1_post"))
    s = series.where(~F.col("nd")).groupBy("caso").agg(F.max("parcela_instituicao").alias("instituicao_max"), F.round(F.avg(F.when(F.col("dias_desde_estopim") >= 0, F.col("parcela_alvo"))), 5).alias("alvo_medio"))
    n = newman.where("janela = 'desde_estopim'").select("caso", F.round("r_sem_neutro", 6).alias("newman_sem_neutro"))
    p = poles.groupBy("caso").agg(F.max("parcela_lideres").alias("lideres_max"))
    after = answers.where((F.col("fase") != PHASES[0]) & (F.col("postagens") >= LEAST_POSTS)).groupBy("caso")
    r = after.agg(F.min("razao_alvo_terceiros").alias("razao_replies_min"), F.max("razao_alvo_terceiros").alias("razao_replies_max"))
    out = g.join(a, "caso").join(s, "caso")
    for part in (n, p, r):
        out = out.join(part, "caso", "left")
    return out


def p11_direction(series: DataFrame, cal: DataFrame) -> DataFrame:
    """Per series and case: mean before the trigger, value at the peak of volume, mean of the decline, change in percentage points; long rows from one pass."""
    long = series.where(~F.col("nd")).join(F.broadcast(peak(cal)), "caso")
    long = long.select("caso", "fase", (F.col("dias_desde_estopim") == F.col("dia_pico")).alias("_p"), F.explode(F.array(*[F.struct(F.lit(s).alias("assinatura"), F.col(s).alias("v")) for s in SERIES])).alias("x")).select("caso", "fase", "_p", "x.*")
    at = lambda c: F.round(F.avg(F.when(c, F.col("v"))), 5)
    g = long.groupBy("assinatura", "caso").agg(at(F.col("fase") == "pre_crise").alias("pre_crise"), at(F.col("_p")).alias("pico"), at(F.col("fase") == "declinio").alias("declinio"))
    return g.withColumn("variacao_pp", F.round((F.col("declinio") - F.col("pico")) * 100, 3))


def p11_same_sign(direction: DataFrame) -> DataFrame:
    """The change of each series with the cases side by side, and whether all have one sign."""
    cases = [c for c, *_ in CASES]
    p = direction.groupBy("assinatura").pivot("caso", cases).agg(F.first("variacao_pp"))
    signs = F.array_distinct(F.filter(F.array(*[F.sign(c) for c in cases]), lambda x: x.isNotNull()))
    return p.withColumn("mesmo_sinal", F.size(signs) == 1)


def phase_rank(fase: Column) -> Column:
    """Position of a phase in the episode, the total last."""
    return F.array_position(F.array(*[F.lit(p) for p in (*PHASES, "todas")]), fase)
