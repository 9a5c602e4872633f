"""The quality battery: one aggregate per case for all indicators, then rows; and the gate that blocks promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .silver import COUNTERS

STANCES = ("acusador", "defensor", "neutro")
#: indicator -> (severity, column that holds its value, SQL condition of approval or None)
INDICATORS = {
    "qc_linhas_bronze": ("informa", "linhas", None),
    "qc_postagens_unicas": ("informa", "unicas", None),
    "qc_duplicatas_removidas": ("informa", "linhas - unicas", None),
    "qc_ids_duplicados": ("informa", "ids_dup", None),
    "qc_duplicatas_divergentes": ("alerta", "divergentes", "= 0"),
    "qc_id_fora_do_padrao": ("bloqueia", "id_ruim", "= 0"),
    "qc_descartadas_sem_autor": ("alerta", "sem_autor", "= 0"),
    "qc_pct_sem_autor": ("bloqueia", "100.0D * sem_autor / nullif(unicas, 0)", "<= 1.0D"),
    "qc_data_nao_parseada": ("bloqueia", "sem_data", "= 0"),
    "qc_fora_da_janela": ("alerta", "fora", "= 0"),
    "qc_data_no_futuro": ("bloqueia", "futuro", "= 0"),
    "qc_reply_sem_destino": ("bloqueia", "reply_solto", "= 0"),
    "qc_replies_reclassificados": ("informa", "replies", None),
    "qc_contador_negativo": ("bloqueia", "negativos", "= 0"),
    "qc_texto_vazio": ("alerta", "sem_texto", "= 0"),
    "qc_idioma_inesperado": ("alerta", "outro_idioma", "= 0"),
    "qc_mencoes_totais": ("informa", "mencoes", None),
    "qc_pct_mencoes_com_id": ("alerta", "100.0D * mencoes_id / nullif(mencoes, 0)", "= 100.0D"),
    "qc_cv_volume_diario": ("informa", "cv", None),
    "qc_com_stance_previa": ("informa", "com_stance", None),
    "qc_stance_previa_fora_do_dominio": ("bloqueia", "stance_ruim", "= 0"),
}

# What each indicator means, as stored with it; the others have none.
DETAILS = {
    "qc_linhas_bronze": "registros lidos da camada Bronze",
    "qc_duplicatas_removidas": "colapsadas por (caso, id_nativo)",
    "qc_ids_duplicados": "ids que aparecem mais de uma vez no bruto",
    "qc_duplicatas_divergentes": "mesmo id com contadores diferentes: capturas em momentos distintos da raspagem",
    "qc_id_fora_do_padrao": "id_nativo deve ser so digitos, 15 a 20",
    "qc_descartadas_sem_autor": "postagens sem handle de autor, descartadas na promocao",
    "qc_pct_sem_autor": "acima de 1 pct sem autor indica falha de coleta",
    "qc_data_nao_parseada": "created_at nulo apos conversao",
    "qc_fora_da_janela": "postagem fora do periodo declarado na coleta",
    "qc_reply_sem_destino": "reply precisa de ref_handle",
    "qc_replies_reclassificados": "respostas que o corpus rotulava como original e o pipeline corrigiu",
    "qc_idioma_inesperado": "postagem em idioma diferente do declarado apesar do filtro lang",
    "qc_mencoes_totais": "arestas do grafo de mencoes",
    "qc_pct_mencoes_com_id": "mencoes com id nativo resolvem CONTA sem heuristica de handle",
    "qc_cv_volume_diario": "coeficiente de variacao do volume diario",
    "qc_com_stance_previa": "rotulos de versao anterior, sem confianca registrada",
    "qc_stance_previa_fora_do_dominio": "stance deve ser acusador, defensor ou neutro",
}
#: The indicators taken after promotion: severity. Values and approval are computed in :func:`after_promotion`.
POST_INDICATORS = {"qc_texto_limpo_reproduz_oraculo": "bloqueia", "qc_classificacao_cobertura": "informa", "qc_classificacao_pct_neutro": "alerta", "qc_classificador_acuracia_teste": "alerta"}
#: A mark that label files put before a clean text.
IRONY = r"^\[IRONY\]\s*"
LEAST_NEUTRAL, LEAST_ACCURACY = 10.0, 0.70
ROW = ("caso_slug", "indicador", "valor", "severidade", "aprovado", "detalhe", "versao_pipeline", "verificado_em")


def battery(norm: DataFrame, dedup: DataFrame, periods: DataFrame, version: str, now: str) -> DataFrame:
    """caso_slug, indicador, valor, severidade, aprovado, detalhe, versao_pipeline, verificado_em (``now``): 21 rows per case.

    ``norm``: the captures with created_at as a timestamp; ``dedup``: one row per post; ``periods``: caso_slug, periodo_inicio,
    periodo_fim. All counters come from one aggregate per input instead of one scan per indicator. A post lies in the window if its day
    is in a period; periods are exploded to days, so this is an equi-join. Ratios over nothing are null, and null is not approved.
    """
    # bounded: the days of the collection per case
    days = periods.where("periodo_inicio IS NOT NULL AND periodo_fim >= periodo_inicio").select("caso_slug", F.explode(F.sequence("periodo_inicio", "periodo_fim")).alias("_dia")).distinct().withColumn("_ok", F.lit(1))
    n = lambda c: F.count_if(c)
    caps = norm.groupBy("caso_slug", "id_nativo").agg(F.count(F.lit(1)).alias("_c"), F.countDistinct(F.struct(*COUNTERS)).alias("_t"))
    a = caps.groupBy("caso_slug").agg(F.sum("_c").alias("linhas"), n(F.col("_c") > 1).alias("ids_dup"), n(F.col("_t") > 1).alias("divergentes"))
    p = dedup.withColumn("_dia", F.to_date("created_at")).join(F.broadcast(days), ["caso_slug", "_dia"], "left")
    stance = F.nullif(F.trim("stance_previa"), F.lit(""))
    b = p.groupBy("caso_slug").agg(
        F.count(F.lit(1)).alias("unicas"),
        n(F.coalesce(~F.col("id_nativo").rlike(r"^[0-9]{15,20}\z"), F.lit(True))).alias("id_ruim"),
        n(is_blank(F.col("autor_handle"))).alias("sem_autor"),
        n(F.col("created_at").isNull()).alias("sem_data"),
        n(F.col("created_at").isNotNull() & F.col("_ok").isNull()).alias("fora"),
        n(F.col("created_at") > F.lit(now).cast("timestamp_ntz")).alias("futuro"),
        n((F.col("tipo_ref") == "reply") & is_blank(F.col("ref_handle"))).alias("reply_solto"),
        n(F.col("tipo_ref") == "reply").alias("replies"),
        n(F.least(*COUNTERS) < 0).alias("negativos"),
        n(is_blank(F.col("texto"))).alias("sem_texto"),
        n(F.col("idioma").isNotNull() & (F.col("idioma") != "pt")).alias("outro_idioma"),
        F.sum(F.coalesce(F.array_size("mencoes"), F.lit(0)).cast("bigint")).alias("mencoes"),
        F.sum(F.coalesce(F.array_size(F.filter("mencoes", lambda m: m["id_nativo"].isNotNull())), F.lit(0)).cast("bigint")).alias("mencoes_id"),
        n(stance.isNotNull()).alias("com_stance"),
        n(stance.isNotNull() & ~stance.isin(*STANCES)).alias("stance_ruim"),
    )
    c = p.where("_dia IS NOT NULL").groupBy("caso_slug", "_dia").agg(F.count(F.lit(1)).alias("v")).groupBy("caso_slug").agg(F.round(F.stddev_samp("v") / F.avg("v"), 9).alias("cv"))
    wide = a.join(b, "caso_slug").join(c, "caso_slug", "left")
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("indicador"), F.round(F.expr(f"CAST({v} AS DOUBLE)"), 9).alias("valor"), F.lit(s).alias("severidade"), (F.expr(f"coalesce(CAST({v} AS DOUBLE) {ok}, false)") if ok else F.lit(True)).alias("aprovado"), F.lit(DETAILS.get(k)).cast("string").alias("detalhe"))
            for k, (s, v, ok) in INDICATORS.items()
        ]
    )
    return wide.select("caso_slug", F.explode(rows).alias("r")).select("caso_slug", "r.*", F.lit(version).alias("versao_pipeline"), F.lit(now).cast("timestamp_ntz").alias("verificado_em"))


def cleaning_pairs(oracle: DataFrame, posts: DataFrame) -> DataFrame:
    """Each labelled pair of the oracle (id, text, clean_text) with the stored post of that native id, the mark [IRONY] taken off:
    id, caso_slug (null: not stored), marcado, texto_igual, limpo_igual. Equality counts two nulls as equal."""
    p = posts.select(F.col("id_nativo").alias("_id"), "caso_slug", "texto", "texto_limpo")
    bare = F.trim(F.regexp_replace("clean_text", IRONY, ""))
    j = oracle.select(F.col("id").cast("string").alias("id"), "text", "clean_text").join(p, F.col("id") == F.col("_id"), "left")
    return j.select("id", "caso_slug", F.coalesce(F.col("clean_text").rlike(IRONY), F.lit(False)).alias("marcado"), F.col("texto").eqNullSafe(F.col("text")).alias("texto_igual"), F.col("texto_limpo").eqNullSafe(bare).alias("limpo_igual"))


def cleaning_summary(pairs: DataFrame) -> DataFrame:
    """Per case (null: not stored): pairs of the oracle, equal texts, marked pairs, equal clean texts."""
    n = lambda c: F.count_if(F.col(c))
    return pairs.groupBy("caso_slug").agg(F.count(F.lit(1)).alias("pares"), n("texto_igual").alias("textos_iguais"), n("marcado").alias("marcados"), n("limpo_igual").alias("limpos_iguais"))


def after_promotion(pairs: DataFrame, posts: DataFrame, labels: DataFrame, tested: DataFrame, model: str, version_of_model: str, version: str, now: str) -> DataFrame:
    """The four indicators of the stages after promotion, in the columns of :func:`battery`.

    ``pairs``: see :func:`cleaning_pairs`. ``labels``: postagem_id, modelo, versao, rotulo. ``tested``: caso_slug, verdade, previsto of a test split.
    Coverage is the share of posts with a label of this model and version, pct_neutro of labels that are neutral, accuracy that of the
    scorer on the test split; a case without labels, or without test rows, has no row of theirs. Several labels of one post, model and version count once each in coverage of 100 % at most.
    """
    mine = labels.where((F.col("modelo") == model) & (F.col("versao") == version_of_model)).select("postagem_id", "rotulo")
    share = lambda n, of: F.lit(100.0) * n / of
    one = F.lit(1)
    ok = F.count_if(F.col("limpo_igual"))
    text = F.concat(F.lit("pares do oraculo na Silver: "), F.count(one).cast("string"), F.lit("; texto_limpo identico a clean_text (sem o marcador [IRONY] do gabarito) em "), ok.cast("string"), F.lit("; pares com marcador [IRONY] no gabarito: "), F.count_if(F.col("marcado")).cast("string"))
    a = pairs.where(F.col("caso_slug").isNotNull()).groupBy("caso_slug").agg(F.lit("qc_texto_limpo_reproduz_oraculo").alias("indicador"), share(ok, F.count(one)).alias("valor"), (ok == F.count(one)).alias("aprovado"), text.alias("detalhe"))
    got = posts.select("postagem_id", "caso_slug").join(mine.groupBy("postagem_id").agg(F.count(one).alias("_n"), F.count_if(F.col("rotulo") == "neutro").alias("_neutros")), "postagem_id", "left")
    per = got.groupBy("caso_slug").agg(F.count(one).alias("t"), F.count("_n").alias("r"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum("_neutros"), F.lit(0)).alias("z"))
    neutral = share(F.col("z"), F.nullif(F.col("n"), F.lit(0)))
    b = per.select("caso_slug", F.explode(F.array(
        F.struct(F.lit("qc_classificacao_cobertura").alias("indicador"), share(F.col("r"), F.col("t")).alias("valor"), F.lit(True).alias("aprovado"), F.lit(f"postagens com rotulo de stance ({model} {version_of_model}); sem rotulo = texto_limpo vazio").alias("detalhe")),
        F.struct(F.lit("qc_classificacao_pct_neutro").alias("indicador"), neutral.alias("valor"), F.coalesce(neutral >= LEAST_NEUTRAL, F.lit(False)).alias("aprovado"), F.lit("abaixo de 10 pct de neutro sugere colapso de classe").alias("detalhe")),
    )).alias("x")).select("caso_slug", "x.*").where("valor IS NOT NULL")
    right = F.count_if(F.col("verdade") == F.col("previsto")) / F.count(one)
    c = tested.groupBy("caso_slug").agg(F.lit("qc_classificador_acuracia_teste").alias("indicador"), right.alias("valor"), (right >= LEAST_ACCURACY).alias("aprovado"), F.lit("acuracia do modelo no teste do gabarito").alias("detalhe"))
    severity = F.create_map(*[F.lit(x) for kv in POST_INDICATORS.items() for x in kv])
    out = a.unionByName(b).unionByName(c).withColumns({"valor": F.round(F.col("valor").cast("double"), 9), "severidade": severity[F.col("indicador")], "versao_pipeline": F.lit(version), "verificado_em": F.lit(now).cast("timestamp_ntz")})
    return out.select(*ROW)


def gate(results: DataFrame) -> DataFrame:
    """Per case and version: bloqueios, alertas, pode_promover."""
    failed = ~F.col("aprovado")
    g = results.groupBy("caso_slug", "versao_pipeline").agg(F.count_if(failed & (F.col("severidade") == "bloqueia")).alias("bloqueios"), F.count_if(failed & (F.col("severidade") == "alerta")).alias("alertas"))
    return g.withColumn("pode_promover", F.col("bloqueios") == 0)


def require(gates: DataFrame, case: str, version: str) -> None:
    """Stops the job unless the case passed this version's gate; a missing verdict is no pass."""
    ok = gates.where((F.col("caso_slug") == case) & (F.col("versao_pipeline") == version) & F.col("pode_promover")).limit(1).count()
    if not ok:
        raise RuntimeError(f"{case}: gate of version {version} is closed")
