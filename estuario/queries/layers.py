"""Queries of the pipeline's layers: silver, quality gate, table changes, star schema, published views."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import dml, gold, qc, silver
from ..session import table as T
from . import data_problems

#: A capture that breaks no blocking rule.
SOUND = r"""id_nativo RLIKE '^[0-9]{15,20}\\z' AND trim(autor_handle) <> '' AND created_at <= TIMESTAMP_NTZ '2024-10-30 00:00:00' AND (tipo_ref <> 'reply' OR trim(ref_handle) <> '')
    AND coalesce(likes, 0) >= 0 AND coalesce(retweets, 0) >= 0 AND coalesce(quotes, 0) >= 0 AND coalesce(respostas, 0) >= 0 AND coalesce(nullif(trim(stance_previa), ''), 'neutro') IN ('acusador', 'defensor', 'neutro')"""
VERSION, NOW, SALT = "v1", "2024-10-30 00:00:00", "sal de teste"


# -- silver


def c1_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = silver.normalise(T(spark, d, "registro"), T(spark, d, "arquivo"))
    return data_problems._flat(n).distinct()


def c2_tipo_ref(spark: SparkSession, d: str) -> DataFrame:
    return silver.normalise(T(spark, d, "registro"), T(spark, d, "arquivo")).select("arquivo_id", "linha", "tipo_ref").distinct()


def c3_dedup(spark: SparkSession, d: str) -> DataFrame:
    return silver.deduplicate(T(spark, d, "v_normalizado")).select("caso_slug", "id_nativo", "arquivo_id", "linha", "autor_handle", "created_at", "texto", "tipo_ref", "likes", "retweets", "quotes", "respostas", "capturas")


def c4_clean_text(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "postagem").select("postagem_id", clean_text(F.col("texto")).alias("limpo"))


def _caps(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "v_deduplicado").withColumns({"arquivo_id": F.col("dedup_id"), "linha": F.lit(0)}).drop("capturas")


def qc_battery(spark: SparkSession, d: str) -> DataFrame:
    caps = _caps(spark, d)
    return qc.battery(caps, silver.deduplicate(caps), T(spark, d, "arquivo"), VERSION, NOW)


def c9_gate(spark: SparkSession, d: str) -> DataFrame:
    return qc.gate(qc_battery(spark, d))


def c5_promotable(spark: SparkSession, d: str) -> DataFrame:
    """The posts of captures that keep every blocking rule, through the gate itself: the given data as they are fail it on purpose (see c5_gated)."""
    caps = _caps(spark, d).where(SOUND)
    dedup = silver.deduplicate(caps)
    gate = qc.gate(qc.battery(caps, dedup, T(spark, d, "arquivo"), VERSION, NOW))
    return silver.promotable(dedup, gate, VERSION).select("caso_slug", "id_nativo", "autor_handle")


def c5_gated(spark: SparkSession, d: str) -> DataFrame:
    """The posts that the gate itself lets through; none while every case has a blocking failure."""
    return silver.promotable(silver.deduplicate(_caps(spark, d)), c9_gate(spark, d), VERSION).select("caso_slug", "id_nativo", "autor_handle")


def c6_accounts(spark: SparkSession, d: str) -> DataFrame:
    return silver.accounts(silver.deduplicate(T(spark, d, "v_normalizado")))


def c7_mentions(spark: SparkSession, d: str) -> DataFrame:
    return silver.mention_pairs(T(spark, d, "v_normalizado"))


def c7_hashtags(spark: SparkSession, d: str) -> DataFrame:
    return silver.hashtag_pairs(T(spark, d, "v_normalizado"))


def c7_prior_labels(spark: SparkSession, d: str) -> DataFrame:
    return silver.prior_labels(T(spark, d, "v_normalizado")).distinct()


def k1_new_files(spark: SparkSession, d: str) -> DataFrame:
    a = T(spark, d, "arquivo")
    return dml.new_files(a.select("sha256", "uri"), a.where("fonte = 'graphql'").select("sha256"))


def k5_replace(spark: SparkSession, d: str) -> DataFrame:
    m = T(spark, d, "grafo_arestas").groupBy("caso", "data").agg(F.sum("peso").alias("peso"))
    return dml.replace_groups(m, m.where("caso = 'farol_apagado' AND data >= DATE'2023-10-23'").withColumn("peso", -F.col("peso")), ["caso"])


def k7_upsert(spark: SparkSession, d: str) -> DataFrame:
    target = T(spark, d, "conta").select(F.lower("handle").alias("handle"), "id_nativo").groupBy("handle").agg(F.max("id_nativo").alias("id_nativo"))
    return dml.upsert(target, c6_accounts(spark, d), ["handle"], ["id_nativo"])


def k8_insert_only(spark: SparkSession, d: str) -> DataFrame:
    p = T(spark, d, "postagem").select("id_nativo", "caso_slug")
    return dml.insert_only(p, T(spark, d, "v_normalizado").select("id_nativo", "caso_slug").distinct(), ["id_nativo"])


def k10_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return dml.keep_first(T(spark, d, "mencao"), ["postagem_id", "conta_id"], ["mencao_id"])


def k10_delete(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete_where(T(spark, d, "mencao"), T(spark, d, "postagem").where("situacao = 'deletada'"), ["postagem_id"])


# -- gold


class Gold:
    """The layer's frames over one data folder, each made once."""

    def __init__(self, spark: SparkSession, d: str):
        self.posts, self.mentions, self.norm = T(spark, d, "postagem"), T(spark, d, "mencao"), T(spark, d, "v_normalizado")
        self.cases = gold.cases(spark)
        self.edges_given = T(spark, d, "grafo_arestas").distinct()
        self.cal = gold.calendar(self.posts, self.cases)
        self.pairs = gold.mentions_of(self.posts, self.mentions)
        self.roles = gold.roles(self.posts, self.pairs, self.cases)
        self.stanced = gold.labelled(self.posts, gold.labels(self.norm, self.posts))

    @property
    def activity(self) -> DataFrame:
        return gold.activity(self.stanced, self.norm, self.cal)

    @property
    def references(self) -> DataFrame:
        return gold.references(self.stanced, self.cases, self.cal)

    @property
    def network(self) -> DataFrame:
        return gold.network(self.pairs, self.cases)

    @property
    def edges(self) -> DataFrame:
        return gold.edges(self.pairs, self.stanced, self.roles, self.cal)


@lru_cache(8)
def layer(spark: SparkSession, d: str) -> Gold:
    return Gold(spark, d)


def g1_calendar(spark, d):
    return layer(spark, d).cal


def g2_roles(spark, d):
    return layer(spark, d).roles


def g3_activity(spark, d):
    return layer(spark, d).activity


def g4_reference(spark, d):
    return layer(spark, d).references


def g5_network(spark, d):
    return layer(spark, d).network.drop("assortatividade_stance")


def g6_edges(spark, d):
    return layer(spark, d).edges


def g8_pseudonym(spark, d):
    return gold.published_edges(layer(spark, d).edges, SALT)


def g9_nodes(spark, d):
    g = layer(spark, d)
    return gold.published_nodes(g.roles, g.stanced, SALT)


def g10_reconcile(spark, d):
    """Cases and days where the activity and the reference fact disagree; none should be left."""
    g = layer(spark, d)
    a = g.activity.groupBy("caso", "data").agg(F.sum("n_postagens").alias("a"))
    b = g.references.groupBy("caso", "data").agg(F.sum("n_postagens").alias("b"))
    return a.join(b, ["caso", "data"], "full").where(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0)))


def g10_checks(spark, d):
    """The five reconciliations between layers per case: two sides and whether they agree."""
    g = layer(spark, d)
    return gold.reconciliation(g.posts, g.pairs, g.activity, g.network, g.edges, gold.published_nodes(g.roles, g.stanced, SALT))


def k9_update(spark: SparkSession, d: str) -> DataFrame:
    return dml.update(T(spark, d, "postagem").select("postagem_id", "texto", "texto_limpo"), texto_limpo=clean_text(F.col("texto"))).drop("texto")


def k11_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Both parts of the mentions: those kept and those set aside, each with its mark."""
    kept, aside = dml.quarantine(T(spark, d, "mencao"), ["postagem_id", "conta_id"], ["mencao_id"])
    return kept.withColumn("destino", F.lit("mantida")).unionByName(aside.withColumn("destino", F.lit("quarentena")))


def k13_view(spark: SparkSession, d: str) -> DataFrame:
    dml.create_view(T(spark, d, "postagem").select("caso_slug", "postagem_id", clean_text(F.col("texto")).alias("texto_limpo")), "v_texto_limpo", {"texto_limpo": "texto sem links, contas e hashtags"})
    return spark.sql("SELECT caso_slug, count(*) AS postagens, count(texto_limpo) AS com_texto, sum(length(texto_limpo)) AS caracteres FROM v_texto_limpo GROUP BY caso_slug")


def c8_required(spark: SparkSession, d: str) -> DataFrame:
    """Each case of the files (a handful) with what the blocking assertion says of it."""
    gate = c9_gate(spark, d).cache()
    out = []
    for (case,) in T(spark, d, "arquivo").select("caso_slug").distinct().collect():
        try:
            qc.require(gate, case, VERSION)
            out.append((case, True))
        except RuntimeError:
            out.append((case, False))
    gate.unpersist()
    return spark.createDataFrame(out, "caso_slug string, segue boolean")


QUERIES = {
    f.__name__: f
    for f in (
        g10_checks, k9_update, k11_quarantine, k13_view, c8_required,
        c1_normalize, c2_tipo_ref, c3_dedup, c4_clean_text, qc_battery, c9_gate, c5_promotable, c5_gated, c6_accounts, c7_mentions, c7_hashtags, c7_prior_labels, k1_new_files, k5_replace, k7_upsert, k8_insert_only,
        k10_keep_first, k10_delete, g1_calendar, g2_roles, g3_activity, g4_reference, g5_network, g6_edges, g8_pseudonym, g9_nodes, g10_reconcile,
    )
}

# -- the same in SQL

CASOS = "casos AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', DATE '{e}', CAST({a} AS BIGINT))" for c, e, a in gold.CASES) + ") t(caso, estopim, alvo))"
CAL = f"""{CASOS},
 vol AS (SELECT lower(caso_slug) AS caso, CAST(created_at AS DATE) AS data, count(*) AS volume_postagens FROM postagem WHERE created_at IS NOT NULL GROUP BY 1, 2),
 vd AS (SELECT vol.*, CAST(date_diff('day', estopim, data) AS INTEGER) AS dias_desde_estopim FROM vol JOIN casos USING (caso)),
 pico AS (SELECT caso, volume_postagens AS pv, dias_desde_estopim AS pd FROM (SELECT *, row_number() OVER (PARTITION BY caso ORDER BY volume_postagens DESC, data) AS n FROM vd WHERE dias_desde_estopim >= 0) WHERE n = 1),
 cal AS (SELECT caso, data, dias_desde_estopim, CASE WHEN dias_desde_estopim < 0 THEN 'pre_crise' WHEN dias_desde_estopim = 0 THEN 'estopim' WHEN dias_desde_estopim < pd THEN 'escalada' WHEN dias_desde_estopim = pd THEN 'pico'
    WHEN volume_postagens >= floor(pv * 0.25) THEN 'declinio' ELSE 'pos_rito' END AS fase, volume_postagens FROM vd LEFT JOIN pico USING (caso))"""
PARES = """pares AS (SELECT p.caso_slug AS caso, CAST(p.created_at AS DATE) AS data, postagem_id, p.autor_conta_id AS origem, m.conta_id AS destino
   FROM (SELECT DISTINCT postagem_id, conta_id FROM mencao) m JOIN postagem p USING (postagem_id))"""
PAPEL = f"""{PARES},
 todas AS (SELECT caso_slug AS caso, autor_conta_id AS conta_id, CAST(created_at AS DATE) AS data, 1 AS p, 0 AS m FROM postagem UNION ALL SELECT caso, destino, data, 0, 1 FROM pares),
 papel AS (SELECT t.caso, conta_id, CASE WHEN conta_id = any_value(alvo) THEN 'alvo' ELSE 'demais' END AS papel_principal, CAST(sum(p) AS BIGINT) AS n_postagens_caso, CAST(sum(m) AS BIGINT) AS n_mencoes_recebidas_caso,
    min(data) AS primeiro_dia, max(data) AS ultimo_dia FROM todas t LEFT JOIN casos USING (caso) GROUP BY t.caso, conta_id)"""
STANCE = """rot AS (SELECT caso_slug, id_nativo, min(stance_previa) AS rotulo FROM v_normalizado WHERE trim(stance_previa) <> '' GROUP BY 1, 2),
 st AS (SELECT postagem_id, p.caso_slug AS caso, CAST(created_at AS DATE) AS data, autor_conta_id AS autor, p.id_nativo, coalesce(tipo_ref, 'desconhecido') AS tipo_ref, ref_conta_id, coalesce(rotulo, 'sem_rotulo') AS stance, CASE WHEN rotulo IS NULL THEN 'nenhuma' ELSE 'v1' END AS versao_classificacao
   FROM postagem p LEFT JOIN rot ON rot.caso_slug = p.caso_slug AND rot.id_nativo = p.id_nativo)"""
ATIV = f"""{CAL}, {STANCE},
 cap AS (SELECT caso_slug AS caso, id_nativo, max(likes) AS likes, max(retweets) AS retweets, max(quotes) AS quotes, max(respostas) AS respostas FROM v_normalizado GROUP BY 1, 2),
 ativ AS (SELECT st.caso, st.data, stance, tipo_ref, versao_classificacao, count(*) AS n_postagens, count(DISTINCT autor) AS n_autores_distintos, CAST(coalesce(sum(likes), 0) AS BIGINT) AS likes, CAST(coalesce(sum(retweets), 0) AS BIGINT) AS retweets,
    CAST(coalesce(sum(quotes), 0) AS BIGINT) AS quotes, CAST(coalesce(sum(respostas), 0) AS BIGINT) AS respostas, any_value(dias_desde_estopim) AS dias_desde_estopim, any_value(fase) AS fase
   FROM st LEFT JOIN cap USING (caso, id_nativo) LEFT JOIN cal USING (caso, data) GROUP BY st.caso, st.data, stance, tipo_ref, versao_classificacao)"""
REFS = """refs AS (SELECT caso, data, tipo_ref, CASE WHEN tipo_ref <> 'reply' THEN 'nao_se_aplica' WHEN ref_conta_id = alvo THEN 'alvo' ELSE 'terceiros' END AS destinatario, stance, versao_classificacao,
    count(*) AS n_postagens, count(DISTINCT autor) AS n_autores_distintos, any_value(dias_desde_estopim) AS dias_desde_estopim, any_value(fase) AS fase
   FROM st LEFT JOIN casos USING (caso) LEFT JOIN cal USING (caso, data) GROUP BY ALL)"""
REDE = """ar AS (SELECT caso, data, origem, destino, count(*) AS peso FROM pares GROUP BY ALL),
 nos AS (SELECT caso, data, no, CAST(sum(x) AS BIGINT) AS x, CAST(sum(g) AS BIGINT) AS g FROM (SELECT caso, data, origem AS no, 0 AS x, 0 AS g FROM ar UNION ALL SELECT caso, data, destino, peso, 1 FROM ar) GROUP BY 1, 2, 3),
 nr AS (SELECT *, row_number() OVER (PARTITION BY caso, data ORDER BY x, no) AS i, max(g) OVER (PARTITION BY caso, data) AS mx FROM nos LEFT JOIN casos USING (caso)),
 ra AS (SELECT caso, data, count(*) AS n_nos, CAST(sum(g) AS BIGINT) AS n_arestas, CAST(sum(x) AS BIGINT) AS n_mencoes, CAST(sum(i * x) AS DOUBLE) AS ix, CAST(sum(x * x) AS DOUBLE) AS x2, CAST(sum(mx - g) AS DOUBLE) AS falta,
    CAST(sum(CASE WHEN no = alvo THEN x ELSE 0 END) AS DOUBLE) AS xa FROM nr GROUP BY 1, 2),
 rb AS (SELECT *, CAST(n_nos AS DOUBLE) AS n, CAST(n_mencoes AS DOUBLE) AS s FROM ra),
 rede AS (SELECT caso, data, n_nos, n_arestas, n_mencoes, round(n_arestas / nullif(n * (n - 1), 0), 9) AS densidade, round(2 * ix / nullif(n * s, 0) - (n + 1) / n, 9) AS gini_mencoes_recebidas, round(x2 / nullif(s * s, 0), 9) AS hhi_mencoes_recebidas,
    round(falta / nullif((n - 1) * (n - 1), 0), 9) AS centralizacao_grau_entrada, round(xa / nullif(s, 0), 9) AS isolamento_alvo FROM rb)"""
ARESTAS = """es AS (SELECT caso, pares.data, origem, destino, stance, count(*) AS n FROM pares JOIN (SELECT postagem_id, stance FROM st) USING (postagem_id) GROUP BY ALL),
 er AS (SELECT *, CAST(sum(n) OVER w AS BIGINT) AS peso, row_number() OVER (PARTITION BY caso, data, origem, destino ORDER BY n DESC, stance) AS i FROM es WINDOW w AS (PARTITION BY caso, data, origem, destino)),
 arestas AS (SELECT er.caso, er.data, origem AS origem_conta_id, destino AS destino_conta_id, peso, stance AS stance_origem, CASE WHEN origem = alvo THEN 'alvo' ELSE 'demais' END AS papel_origem,
    CASE WHEN destino = alvo THEN 'alvo' ELSE 'demais' END AS papel_destino, dias_desde_estopim, fase FROM er LEFT JOIN casos USING (caso) LEFT JOIN cal USING (caso, data) WHERE i = 1)"""
GOLD = f"WITH {ATIV}, {PAPEL}, {REFS}, {REDE}, {ARESTAS}"

_DEDUP = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caso_slug, id_nativo ORDER BY dedup_id) AS n_,
    max(likes) OVER w AS l_, max(retweets) OVER w AS r_, max(quotes) OVER w AS q_, max(respostas) OVER w AS s_ FROM v_deduplicado WINDOW w AS (PARTITION BY caso_slug, id_nativo)) WHERE n_ = 1)"""
_quoted = lambda v: "NULL" if v is None else f"'{v}'"
_QC = f"""WITH {_DEDUP},
 dias AS (SELECT DISTINCT caso_slug, CAST(unnest(generate_series(periodo_inicio, periodo_fim, INTERVAL 1 DAY)) AS DATE) AS dia FROM arquivo WHERE periodo_inicio IS NOT NULL AND periodo_fim >= periodo_inicio),
 caps AS (SELECT caso_slug, id_nativo, count(*) AS c, count(DISTINCT (likes, retweets, quotes, respostas)) AS t FROM v_deduplicado GROUP BY 1, 2),
 a AS (SELECT caso_slug, sum(c) AS linhas, sum(CAST(c > 1 AS INT)) AS ids_dup, sum(CAST(t > 1 AS INT)) AS divergentes FROM caps GROUP BY 1),
 p AS (SELECT d.*, CAST(created_at AS DATE) AS dia, dias.dia IS NOT NULL AS ok FROM d LEFT JOIN dias ON dias.caso_slug = d.caso_slug AND dias.dia = CAST(d.created_at AS DATE)),
 b AS (SELECT caso_slug, count(*) AS unicas, count(*) FILTER (id_nativo IS NULL OR NOT regexp_full_match(id_nativo, '[0-9]{{15,20}}')) AS id_ruim, count(*) FILTER (autor_handle IS NULL OR trim(autor_handle, ' ') = '') AS sem_autor,
    count(*) FILTER (created_at IS NULL) AS sem_data, count(*) FILTER (created_at IS NOT NULL AND NOT ok) AS fora, count(*) FILTER (created_at > TIMESTAMP '{NOW}') AS futuro,
    count(*) FILTER (tipo_ref = 'reply' AND (ref_handle IS NULL OR trim(ref_handle, ' ') = '')) AS reply_solto, count(*) FILTER (tipo_ref = 'reply') AS replies, count(*) FILTER (least(l_, r_, q_, s_) < 0) AS negativos,
    count(*) FILTER (texto IS NULL OR trim(texto, ' ') = '') AS sem_texto, count(*) FILTER (idioma <> 'pt') AS outro_idioma, coalesce(sum(len(mencoes)), 0) AS mencoes, coalesce(sum(len(list_filter(mencoes, lambda m: m.id_nativo IS NOT NULL))), 0) AS mencoes_id,
    count(*) FILTER (trim(stance_previa, ' ') <> '') AS com_stance, count(*) FILTER (trim(stance_previa, ' ') <> '' AND trim(stance_previa, ' ') NOT IN ('acusador', 'defensor', 'neutro')) AS stance_ruim FROM p GROUP BY 1),
 c AS (SELECT caso_slug, round(stddev_samp(v) / avg(v), 9) AS cv FROM (SELECT caso_slug, dia, count(*) AS v FROM p WHERE dia IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
 w AS (SELECT * FROM a JOIN b USING (caso_slug) LEFT JOIN c USING (caso_slug)),
 qc AS ({" UNION ALL ".join(f"SELECT caso_slug, '{k}' AS indicador, round(CAST({v.replace('0D', '0')} AS DOUBLE), 9) AS valor, '{s}' AS severidade, {f'coalesce(CAST({v.replace("0D", "0")} AS DOUBLE) {ok.replace("0D", "0")}, false)' if ok else 'true'} AS aprovado, CAST({_quoted(qc.DETAILS.get(k))} AS VARCHAR) AS detalhe, '{VERSION}' AS versao_pipeline, TIMESTAMP '{NOW}' AS verificado_em FROM w" for k, (s, v, ok) in qc.INDICATORS.items())}),
 gate AS (SELECT caso_slug, versao_pipeline, count(*) FILTER (NOT aprovado AND severidade = 'bloqueia') AS bloqueios, count(*) FILTER (NOT aprovado AND severidade = 'alerta') AS alertas FROM qc GROUP BY 1, 2)"""
_ACCOUNTS = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caso_slug, id_nativo ORDER BY arquivo_id, linha) AS n_ FROM v_normalizado) WHERE n_ = 1),
 h AS (SELECT lower(autor_handle) AS handle, autor_id_nativo AS id_nativo FROM d UNION ALL SELECT lower(m.handle), m.id_nativo FROM (SELECT unnest(mencoes) AS m FROM d) UNION ALL SELECT lower(ref_handle), NULL FROM d),
 contas AS (SELECT handle, max(id_nativo) AS id_nativo FROM h WHERE trim(handle) <> '' GROUP BY 1)"""
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(texto, '\p{Z}', ' ', 'g'), 'http\S+|www\S+|pic\.twitter\.com\S+', '', 'g'), '@([A-Za-z0-9_]{1,15})', ' ', 'g'), '#[\p{L}\p{N}_]+', ' ', 'g'), '\s+', ' ', 'g'))"
ORACLE = {
    "g10_checks": GOLD
    + f""", lados AS (
        SELECT 'postagens' AS verificacao, caso, CAST((SELECT sum(n_postagens) FROM ativ a WHERE a.caso = c.caso) AS BIGINT) AS esquerda, (SELECT count(*) FROM postagem WHERE caso_slug = c.caso) AS direita FROM casos c
        UNION ALL SELECT 'mencoes_rede', caso, (SELECT sum(n_mencoes) FROM rede a WHERE a.caso = c.caso), (SELECT count(*) FROM pares p WHERE p.caso = c.caso) FROM casos c
        UNION ALL SELECT 'mencoes_arestas', caso, (SELECT sum(peso) FROM arestas a WHERE a.caso = c.caso), (SELECT count(*) FROM pares p WHERE p.caso = c.caso) FROM casos c
        UNION ALL SELECT 'pares_arestas', caso, (SELECT count(*) FROM arestas a WHERE a.caso = c.caso), (SELECT sum(n_arestas) FROM rede p WHERE p.caso = c.caso) FROM casos c
        UNION ALL SELECT 'alvo_como_origem', caso, (SELECT count(*) FROM arestas a WHERE a.caso = c.caso AND origem_conta_id = c.alvo), 0 FROM casos c
        UNION ALL SELECT 'pseudonimo_unico', caso, (SELECT count(DISTINCT substr(sha256('{SALT}' || conta_id), 1, 10)) FROM papel a WHERE a.caso = c.caso), (SELECT count(DISTINCT conta_id) FROM papel p WHERE p.caso = c.caso) FROM casos c)
      SELECT verificacao, caso, CAST(coalesce(esquerda, 0) AS BIGINT) AS esquerda, CAST(coalesce(direita, 0) AS BIGINT) AS direita, coalesce(esquerda, 0) = coalesce(direita, 0) AS confere FROM lados""",
    "k9_update": f"SELECT postagem_id, {_CLEAN} AS texto_limpo FROM postagem",
    "k11_quarantine": "SELECT mencao_id, postagem_id, conta_id, CASE WHEN mencao_id = min(mencao_id) OVER (PARTITION BY postagem_id, conta_id) THEN 'mantida' ELSE 'quarentena' END AS destino FROM mencao",
    "k13_view": f"SELECT caso_slug, count(*) AS postagens, count(texto) AS com_texto, CAST(sum(length({_CLEAN})) AS BIGINT) AS caracteres FROM postagem GROUP BY 1",
    "c8_required": _QC + " SELECT caso_slug, bool_or(bloqueios = 0) AS segue FROM gate RIGHT JOIN (SELECT DISTINCT caso_slug FROM arquivo) USING (caso_slug) GROUP BY 1",
    "c1_normalize": data_problems._TABELA + " SELECT DISTINCT * EXCLUDE (extras), CASE WHEN ref_status_id IS NOT NULL OR ref_handle IS NOT NULL THEN 'reply' WHEN eh_quote THEN 'quote' ELSE 'original' END AS tipo_ref FROM t",
    "c2_tipo_ref": "SELECT DISTINCT arquivo_id, linha, CASE WHEN ref_status_id IS NOT NULL OR ref_handle IS NOT NULL THEN 'reply' WHEN eh_quote THEN 'quote' ELSE 'original' END AS tipo_ref FROM v_normalizado",
    "c3_dedup": """SELECT caso_slug, id_nativo, arquivo_id, linha, autor_handle, created_at, texto, tipo_ref, l_ AS likes, r_ AS retweets, q_ AS quotes, s_ AS respostas, c_ AS capturas FROM (
        SELECT *, row_number() OVER (PARTITION BY caso_slug, id_nativo ORDER BY arquivo_id, linha) AS n_, max(likes) OVER w AS l_, max(retweets) OVER w AS r_, max(quotes) OVER w AS q_, max(respostas) OVER w AS s_, count(*) OVER w AS c_
        FROM v_normalizado WINDOW w AS (PARTITION BY caso_slug, id_nativo)) WHERE n_ = 1""",
    "c4_clean_text": "SELECT postagem_id, texto_limpo AS limpo FROM postagem",  # the stored texts themselves
    "qc_battery": _QC + " SELECT * FROM qc",
    "c9_gate": _QC + " SELECT *, bloqueios = 0 AS pode_promover FROM gate",
    "c5_promotable": _QC.replace("FROM v_deduplicado", "FROM boas").replace("WITH ", f"WITH boas AS (SELECT * FROM v_deduplicado WHERE {SOUND.replace('TIMESTAMP_NTZ', 'TIMESTAMP').replace(r"id_nativo RLIKE '^[0-9]{15,20}\\z'", "regexp_full_match(id_nativo, '[0-9]{15,20}')").replace("trim(autor_handle)", "trim(autor_handle, ' ')").replace("trim(ref_handle)", "trim(ref_handle, ' ')").replace("trim(stance_previa)", "trim(stance_previa, ' ')")}), ", 1)
    + " SELECT caso_slug, id_nativo, autor_handle FROM d WHERE caso_slug IN (SELECT caso_slug FROM gate WHERE bloqueios = 0)",
    "c5_gated": _QC + " SELECT caso_slug, id_nativo, autor_handle FROM d WHERE trim(autor_handle, ' ') <> '' AND caso_slug IN (SELECT caso_slug FROM gate WHERE bloqueios = 0)",
    "c6_accounts": f"WITH {_ACCOUNTS} SELECT * FROM contas",
    "c7_mentions": "SELECT DISTINCT caso_slug, id_nativo, lower(m.handle) AS handle FROM (SELECT caso_slug, id_nativo, unnest(mencoes) AS m FROM v_normalizado) WHERE m.handle IS NOT NULL",
    "c7_hashtags": "SELECT DISTINCT caso_slug, id_nativo, hashtag FROM (SELECT caso_slug, id_nativo, unnest(hashtags) AS hashtag FROM v_normalizado) WHERE trim(hashtag) <> ''",
    "c7_prior_labels": "SELECT DISTINCT caso_slug, id_nativo, stance_previa AS rotulo FROM v_normalizado WHERE trim(stance_previa) <> ''",
    "k1_new_files": "SELECT sha256, min(uri) AS uri FROM arquivo WHERE sha256 NOT IN (SELECT sha256 FROM arquivo WHERE fonte = 'graphql') GROUP BY 1",
    "k5_replace": "WITH m AS (SELECT caso, data, CAST(sum(peso) AS BIGINT) AS peso FROM grafo_arestas GROUP BY 1, 2) SELECT * FROM m WHERE caso <> 'farol_apagado' UNION ALL SELECT caso, data, -peso FROM m WHERE caso = 'farol_apagado' AND data >= DATE '2023-10-23'",
    "k7_upsert": f"WITH {_ACCOUNTS}, t AS (SELECT lower(handle) AS handle, max(id_nativo) AS id_nativo FROM conta GROUP BY 1) SELECT coalesce(t.handle, c.handle) AS handle, coalesce(t.id_nativo, c.id_nativo) AS id_nativo FROM t FULL JOIN contas c ON t.handle = c.handle",
    "k8_insert_only": "SELECT id_nativo, caso_slug FROM postagem UNION ALL SELECT DISTINCT id_nativo, caso_slug FROM v_normalizado v WHERE NOT EXISTS (SELECT 1 FROM postagem p WHERE p.id_nativo = v.id_nativo)",
    "k10_keep_first": "SELECT min(mencao_id) AS mencao_id, postagem_id, conta_id FROM mencao GROUP BY postagem_id, conta_id",
    "k10_delete": "SELECT * FROM mencao WHERE postagem_id NOT IN (SELECT postagem_id FROM postagem WHERE situacao = 'deletada')",
    "g1_calendar": f"WITH {CAL} SELECT * FROM cal",
    "g2_roles": f"WITH {CASOS}, {PAPEL} SELECT * FROM papel",
    "g3_activity": f"WITH {ATIV} SELECT * FROM ativ",
    "g4_reference": f"WITH {ATIV}, {REFS} SELECT * FROM refs",
    "g5_network": f"WITH {CASOS}, {PARES}, {REDE} SELECT * FROM rede",
    "g6_edges": GOLD + " SELECT * FROM arestas",
    "g8_pseudonym": GOLD + f" SELECT caso, data, dias_desde_estopim, fase, 'n' || substr(sha256('{SALT}' || origem_conta_id), 1, 10) AS source, 'n' || substr(sha256('{SALT}' || destino_conta_id), 1, 10) AS target, peso AS weight, stance_origem, papel_origem, papel_destino FROM arestas",
    "g9_nodes": GOLD
    + f""", mo AS (SELECT caso, autor AS conta_id, stance AS stance_modal FROM (SELECT caso, autor, stance, row_number() OVER (PARTITION BY caso, autor ORDER BY q DESC, stance) AS i FROM (SELECT caso, autor, stance, count(*) AS q FROM st GROUP BY ALL)) WHERE i = 1)
       SELECT caso, 'n' || substr(sha256('{SALT}' || conta_id), 1, 10) AS id, papel_principal AS papel, coalesce(stance_modal, 'nao_autor') AS stance_modal, n_postagens_caso, n_mencoes_recebidas_caso, primeiro_dia, ultimo_dia FROM papel LEFT JOIN mo USING (caso, conta_id)""",
    "g10_reconcile": f"WITH {ATIV}, {REFS}, a AS (SELECT caso, data, CAST(sum(n_postagens) AS BIGINT) AS a FROM ativ GROUP BY 1, 2), b AS (SELECT caso, data, CAST(sum(n_postagens) AS BIGINT) AS b FROM refs GROUP BY 1, 2) SELECT caso, data, a, b FROM a FULL JOIN b USING (caso, data) WHERE coalesce(a, 0) <> coalesce(b, 0)",
}
