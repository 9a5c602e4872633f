"""Queries of labels, constraints, the regression ruler and the cleaning oracle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text, is_blank, ratio
from ..operators import constraints, gold, labels, qc, ruler, silver
from ..session import table as T
from .analysis import BASE, inputs
from .layers import _ACCOUNTS, _QC, ATIV, NOW, VERSION, layer, qc_battery

TABLES = ("arquivo", "registro", "postagem", "v_deduplicado")


def _tested(spark, d):
    """The posts with a delivered label as a test split: verdade is the label, previsto what the scorer says of the stored clean text."""
    g = layer(spark, d)
    truth = gold.labels(g.norm, g.posts).select("postagem_id", F.col("rotulo").alias("verdade"))
    posts = g.posts.select("postagem_id", "caso_slug", F.coalesce("texto_limpo", F.lit("")).alias("texto_limpo")).join(truth, "postagem_id")
    got = labels.score(posts, labels.lexicon_scorer, "lexico", "v1").select("postagem_id", F.col("rotulo").alias("previsto"))
    return posts.join(got, "postagem_id").select("caso_slug", "verdade", "previsto")


def l1_metrics(spark, d):
    return labels.metrics(_tested(spark, d))


def _labels(spark, d):
    g = layer(spark, d)
    return gold.labels(g.norm, g.posts).withColumn("modelo", F.lit("entregue"))


def l2_pending(spark, d):
    return labels.pending(layer(spark, d).posts, _labels(spark, d), "entregue", "v1").select("postagem_id")


def l3_score(spark, d):
    return labels.score(labels.pending(layer(spark, d).posts, _labels(spark, d), "lexico", "v1"), labels.lexicon_scorer, "lexico", "v1")


def l5_distribution(spark, d):
    return labels.distribution(layer(spark, d).stanced)


def k12_constraints(spark, d):
    return reduce(DataFrame.unionByName, [constraints.violations(T(spark, d, t), t) for t in TABLES])


def k12_unique_handles(spark, d):
    return constraints.not_unique(T(spark, d, "conta").withColumn("handle", F.lower("handle")), ["plataforma", "handle"])


def k12_unique_native(spark, d):
    return constraints.not_unique(T(spark, d, "conta"), ["plataforma", "id_nativo"], nulls_equal=False)


def v1_cleaning_oracle(spark, d):
    """Per case: how many stored clean texts equal the rule's result, null-safe."""
    p = T(spark, d, "postagem")
    same = clean_text(F.col("texto")).eqNullSafe(F.col("texto_limpo"))
    return p.groupBy("caso_slug").agg(F.count(F.lit(1)).alias("postagens"), F.count_if(same).alias("iguais"), ratio(F.count_if(same), F.count(F.lit(1))).alias("parcela"))


def _oracle_posts(spark, d):
    """(label pairs, posts): every post is a pair of the oracle, quotes with the mark [IRONY]; the posts carry the clean text as the rule makes it now."""
    p = T(spark, d, "postagem")
    mark = F.when(F.col("tipo_ref") == "quote", F.concat(F.lit("[IRONY] "), "texto_limpo")).otherwise(F.col("texto_limpo"))
    oracle = p.select(F.col("id_nativo").alias("id"), F.col("texto").alias("text"), mark.alias("clean_text"))
    return oracle, p.withColumn("texto_limpo", clean_text(F.col("texto")))


def v1_oracle_by_id(spark, d):
    """Test B: the materialised clean texts against the label pairs, joined by native id, per case."""
    return qc.cleaning_summary(qc.cleaning_pairs(*_oracle_posts(spark, d)))


def qc_after_promotion(spark, d):
    oracle, posts = _oracle_posts(spark, d)
    return qc.after_promotion(qc.cleaning_pairs(oracle, posts), posts, _labels(spark, d), _tested(spark, d), "entregue", "v1", VERSION, NOW)


def l5_confidence(spark, d):
    """Labels of the scorer per case with their mean confidence, over all posts with text."""
    g = layer(spark, d)
    got = labels.score(g.posts.where(~is_blank(F.col("texto_limpo"))), labels.lexicon_scorer, "lexico", "v1")
    return labels.distribution(got.join(g.posts.select("postagem_id", F.col("caso_slug").alias("caso")), "postagem_id").select("caso", F.col("rotulo").alias("stance"), "confianca"))


_SIX = lambda c, f: f"cast(cast({f}({c}) AS decimal(18,6)) AS string)"
_span = lambda c: f"concat(cast(min({c}) AS string), ' | ', cast(max({c}) AS string))"
_span6 = lambda c: f"concat({_SIX(c, 'min')}, ' | ', {_SIX(c, 'max')})"
#: Columns whose least and greatest values the ruler takes, by table; those in the second tuple are fractions.
DOMAINS = {
    "calendario_caso": (("data", "dias_desde_estopim", "volume_postagens"), ()),
    "dim_conta_papel": (("n_mencoes_recebidas_caso", "n_postagens_caso", "primeiro_dia", "ultimo_dia"), ()),
    "fato_atividade": (("likes", "n_autores_distintos", "n_postagens", "quotes", "respostas", "retweets"), ()),
    "fato_rede": (("n_arestas", "n_mencoes", "n_nos"), ("centralizacao_grau_entrada", "densidade", "gini_mencoes_recebidas", "hhi_mencoes_recebidas", "isolamento_alvo")),
    "fato_referencia": (("n_autores_distintos", "n_postagens"), ()),
    "grafo_arestas": (("peso",), ()),
    "papel_narrativo": (("dia_virada",), ()),
}


def v2_ruler(spark, d):
    """Row counts, sums, label counts, versions and value ranges of all tables, as text."""
    g, x = layer(spark, d), inputs(spark, d)
    caps, lab, res = g.norm.withColumn("caso", F.col("caso_slug")), _labels(spark, d).join(g.posts.select("postagem_id", "caso_slug"), "postagem_id"), qc_battery(spark, d)
    tables = {
        "conta": silver.accounts(silver.deduplicate(g.norm)), "postagem": g.posts, "captura": caps, "mencao": g.pairs, "postagem_hashtag": silver.hashtag_pairs(g.norm), "classificacao": lab, "qc_resultado": res,
        "calendario_caso": x.cal, "dim_conta_papel": x.roles, "fato_atividade": x.act, "fato_rede": x.net, "grafo_arestas": x.ar, "fato_referencia": x.ref, "papel_narrativo": x.narr,
    }
    m = ruler.measures
    both = lambda a, b: F.concat(a, F.lit(" / "), b)
    gate = qc.gate(res).withColumn("chave", both("caso_slug", "versao_pipeline"))
    out = [m(df, t, None, linhas="count(*)") for t, df in tables.items()]
    out += [
        m(x.act, "fato_atividade", "caso", soma_n_postagens="sum(n_postagens)"), m(x.ref, "fato_referencia", "caso", soma_n_postagens="sum(n_postagens)"),
        m(x.net, "fato_rede", "caso", soma_n_mencoes="sum(n_mencoes)", soma_n_arestas="sum(n_arestas)", linhas_por_caso="count(*)"),
        m(x.ar, "grafo_arestas", "caso", soma_peso="sum(peso)", pares_linhas="count(*)"), m(x.ar, "grafo_arestas", None, alvo_como_origem="count_if(papel_origem = 'alvo')"),
        m(g.pairs, "mencao", "caso", linhas_por_caso="count(*)"), m(caps, "captura", "caso", linhas_por_caso="count(*)"), m(g.posts, "postagem", "caso_slug", linhas_por_caso="count(*)", autores="count(DISTINCT autor_conta_id)"),
        m(lab.withColumn("chave", both("caso_slug", "rotulo")), "classificacao", "chave", rotulo_por_caso="count(*)"), m(lab, "classificacao", "versao", linhas_por_versao="count(*)"),
        m(x.act, "fato_atividade", "versao_classificacao", linhas_por_versao_classificacao="count(*)"), m(res.withColumn("chave", both("caso_slug", "versao_pipeline")), "qc_resultado", "chave", linhas_por_caso_versao="count(*)"),
        m(gate, "v_qc_portao", "chave", portao="concat(max(bloqueios), ' | ', max(alertas), ' | ', max(pode_promover))"),
    ]
    for t, (whole, parts) in DOMAINS.items():
        out.append(m(tables[t], t, None, **{f"min|max {c}": _span(c) for c in whole}, **{f"min|max {c}": _span6(c) for c in parts}))
    return ruler.ruler(out)


QUERIES = {f.__name__: f for f in (l1_metrics, l2_pending, l3_score, l5_distribution, k12_constraints, k12_unique_handles, k12_unique_native, v1_cleaning_oracle, v1_oracle_by_id, qc_after_promotion, l5_confidence, v2_ruler)}

_DUCK = {"sha256_formato": "regexp_full_match(sha256, '[0-9a-f]{64}')", "idioma_formato": "regexp_full_match(idioma, '[a-z]{2}')"}
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(texto, '\p{Z}', ' ', 'g'), 'http\S+|www\S+|pic\.twitter\.com\S+', '', 'g'), '@([A-Za-z0-9_]{1,15})', ' ', 'g'), '#[\p{L}\p{N}_]+', ' ', 'g'), '\s+', ' ', 'g'))"
_words = lambda k: "[" + ", ".join(f"'{w}'" for w in labels.LEXICON[k]) + "]"
_SCORED = f"""pal AS (SELECT postagem_id, caso_slug, texto_limpo, list_transform(regexp_split_to_array(lower(coalesce(texto_limpo, '')), '[\\s\\p{{Z}}]+'), lambda w: trim(w, '.,!?')) AS ws FROM postagem),
 conta_ AS (SELECT *, len(list_filter(ws, lambda w: list_contains({_words("acusador")}, w))) AS a, len(list_filter(ws, lambda w: list_contains({_words("defensor")}, w))) AS d FROM pal),
 pontos AS (SELECT postagem_id, caso_slug, texto_limpo, CASE WHEN a > d THEN 'acusador' WHEN d > a THEN 'defensor' ELSE 'neutro' END AS rotulo, CASE WHEN a + d = 0 THEN 1.0::DOUBLE WHEN a = d THEN 0.5::DOUBLE ELSE CAST(greatest(a, d) AS DOUBLE) / (a + d) END AS confianca FROM conta_)"""
_ENTREGUE = "rotulos AS (SELECT postagem_id, caso AS caso_slug, stance AS rotulo FROM st WHERE stance <> 'sem_rotulo')"
_B = f"""o AS (SELECT id_nativo AS id, texto AS text, CASE WHEN tipo_ref = 'quote' THEN '[IRONY] ' || texto_limpo ELSE texto_limpo END AS clean_text FROM postagem),
 b AS (SELECT o.id, p.caso_slug, coalesce(starts_with(clean_text, '[IRONY]'), false) AS marcado, p.texto IS NOT DISTINCT FROM text AS texto_igual, {_CLEAN} IS NOT DISTINCT FROM trim(regexp_replace(clean_text, '^\\[IRONY\\]\\s*', '')) AS limpo_igual FROM o LEFT JOIN postagem p ON p.id_nativo = o.id)"""
_m = lambda t, src, key, **ms: " UNION ALL ".join(f"SELECT '{t}' AS tabela, '{m}' AS metrica, coalesce(CAST({key} AS VARCHAR), 'nulo') AS chave, CAST({sql} AS VARCHAR) AS valor FROM {src} GROUP BY ALL" for m, sql in ms.items())
_SRC = {"conta": "contas", "postagem": "postagem", "captura": "cap_", "mencao": "pares", "postagem_hashtag": "tags", "classificacao": "rotulos", "qc_resultado": "qc", "calendario_caso": "cal", "dim_conta_papel": "papel", "fato_atividade": "ativ", "fato_rede": "rede", "grafo_arestas": "grafo", "fato_referencia": "refs", "papel_narrativo": "narr"}
ORACLE = {
    "l1_metrics": f"WITH {ATIV}, {_SCORED}, " + """t AS (SELECT st.postagem_id, stance AS verdade FROM st WHERE stance <> 'sem_rotulo'),
       p AS (SELECT verdade, rotulo AS previsto FROM t JOIN pontos USING (postagem_id)), c AS (SELECT verdade AS classe FROM p UNION SELECT previsto FROM p),
       n AS (SELECT classe, (SELECT count(*) FROM p WHERE verdade = classe) AS suporte, (SELECT count(*) FROM p WHERE previsto = classe) AS pr, (SELECT count(*) FROM p WHERE previsto = classe AND verdade = classe) AS ok FROM c)
       SELECT classe, suporte, coalesce(round(ok / nullif(CAST(pr AS DOUBLE), 0), 6), 0.0::DOUBLE) AS precisao, coalesce(round(ok / nullif(CAST(suporte AS DOUBLE), 0), 6), 0.0::DOUBLE) AS revocacao, coalesce(round(2 * ok / nullif(CAST(suporte + pr AS DOUBLE), 0), 6), 0.0::DOUBLE) AS f1,
         round(CAST(sum(ok) OVER () AS DOUBLE) / CAST(sum(suporte) OVER () AS DOUBLE), 6) AS acuracia FROM n""",
    "l2_pending": f"WITH {ATIV} SELECT postagem_id FROM postagem JOIN st USING (postagem_id) WHERE stance = 'sem_rotulo' AND trim(texto_limpo, ' ') <> ''",
    "l5_distribution": f"WITH {ATIV} SELECT caso, stance, n, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY caso) AS DOUBLE), 6) AS parcela FROM (SELECT caso, stance, count(*) AS n FROM st GROUP BY 1, 2)",
    "k12_constraints": " UNION ALL ".join(f"SELECT '{t}' AS tabela, '{c.name}' AS regra, count(*) FILTER (NOT coalesce({_DUCK.get(c.name, c.condition)}, true)) AS violacoes FROM {t}" for t in TABLES for c in constraints.CHECKS[t]),
    "k12_unique_handles": "SELECT plataforma, lower(handle) AS handle, count(*) AS ocorrencias FROM conta GROUP BY 1, 2 HAVING count(*) > 1",
    "k12_unique_native": "SELECT plataforma, id_nativo, count(*) AS ocorrencias FROM conta WHERE id_nativo IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "v1_cleaning_oracle": f"SELECT caso_slug, count(*) AS postagens, count(*) FILTER (e) AS iguais, round(CAST(count(*) FILTER (e) AS DOUBLE) / count(*), 6) AS parcela FROM (SELECT caso_slug, {_CLEAN} IS NOT DISTINCT FROM texto_limpo AS e FROM postagem) GROUP BY 1",
    "l3_score": f"WITH {ATIV}, {_SCORED} SELECT postagem_id, 'lexico' AS modelo, 'v1' AS versao, rotulo, confianca FROM pontos WHERE trim(texto_limpo, ' ') <> ''",
    "l5_confidence": f"""WITH {_SCORED} SELECT caso, stance, n, confianca_media, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY caso) AS DOUBLE), 6) AS parcela
       FROM (SELECT caso_slug AS caso, rotulo AS stance, count(*) AS n, round(avg(confianca), 6) AS confianca_media FROM pontos WHERE trim(texto_limpo, ' ') <> '' GROUP BY 1, 2)""",
    "v1_oracle_by_id": f"WITH {_B} SELECT caso_slug, count(*) AS pares, count(*) FILTER (texto_igual) AS textos_iguais, count(*) FILTER (marcado) AS marcados, count(*) FILTER (limpo_igual) AS limpos_iguais FROM b GROUP BY 1",
    "qc_after_promotion": f"""WITH {ATIV}, {_SCORED}, {_ENTREGUE}, {_B},
       x AS (SELECT caso_slug, 'qc_texto_limpo_reproduz_oraculo' AS indicador, 100.0::DOUBLE * count(*) FILTER (limpo_igual) / count(*) AS valor, 'bloqueia' AS severidade, bool_and(limpo_igual) AS aprovado,
           'pares do oraculo na Silver: ' || count(*) || '; texto_limpo identico a clean_text (sem o marcador [IRONY] do gabarito) em ' || count(*) FILTER (limpo_igual) || '; pares com marcador [IRONY] no gabarito: ' || count(*) FILTER (marcado) AS detalhe FROM b WHERE caso_slug IS NOT NULL GROUP BY 1
         UNION ALL SELECT p.caso_slug, 'qc_classificacao_cobertura', 100.0::DOUBLE * count(r.rotulo) / count(*), 'informa', true, 'postagens com rotulo de stance (entregue v1); sem rotulo = texto_limpo vazio' FROM postagem p LEFT JOIN rotulos r USING (postagem_id) GROUP BY 1
         UNION ALL SELECT caso_slug, 'qc_classificacao_pct_neutro', 100.0::DOUBLE * count(*) FILTER (rotulo = 'neutro') / count(*), 'alerta', 100.0::DOUBLE * count(*) FILTER (rotulo = 'neutro') / count(*) >= 10, 'abaixo de 10 pct de neutro sugere colapso de classe' FROM rotulos GROUP BY 1
         UNION ALL SELECT r.caso_slug, 'qc_classificador_acuracia_teste', CAST(count(*) FILTER (r.rotulo = p.rotulo) AS DOUBLE) / count(*), 'alerta', CAST(count(*) FILTER (r.rotulo = p.rotulo) AS DOUBLE) / count(*) >= 0.70, 'acuracia do modelo no teste do gabarito' FROM rotulos r JOIN pontos p USING (postagem_id) GROUP BY 1)
       SELECT caso_slug, indicador, round(valor, 9) AS valor, severidade, aprovado, detalhe, '{VERSION}' AS versao_pipeline, TIMESTAMP '{NOW}' AS verificado_em FROM x""",
    "v2_ruler": BASE + f", {_ENTREGUE}, " + _QC.removeprefix("WITH ").replace("d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caso_slug, id_nativo ORDER BY dedup_id)", "dd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY caso_slug, id_nativo ORDER BY dedup_id)", 1).replace("SELECT d.*, CAST(created_at AS DATE) AS dia, dias.dia IS NOT NULL AS ok FROM d LEFT JOIN dias ON dias.caso_slug = d.caso_slug AND dias.dia = CAST(d.created_at AS DATE)", "SELECT dd.*, CAST(created_at AS DATE) AS dia, dias.dia IS NOT NULL AS ok FROM dd LEFT JOIN dias ON dias.caso_slug = dd.caso_slug AND dias.dia = CAST(dd.created_at AS DATE)") + ", " + _ACCOUNTS
    + ", cap_ AS (SELECT *, caso_slug AS caso FROM v_normalizado), tags AS (SELECT DISTINCT caso_slug, id_nativo, hashtag FROM (SELECT caso_slug, id_nativo, unnest(hashtags) AS hashtag FROM v_normalizado) WHERE trim(hashtag) <> '') "
    + " UNION ALL ".join(
        [
            *[_m(t, src, "'-'", linhas="count(*)") for t, src in _SRC.items()],
            _m("fato_atividade", "ativ", "caso", soma_n_postagens="sum(n_postagens)"), _m("fato_referencia", "refs", "caso", soma_n_postagens="sum(n_postagens)"),
            _m("fato_rede", "rede", "caso", soma_n_mencoes="sum(n_mencoes)", soma_n_arestas="sum(n_arestas)", linhas_por_caso="count(*)"),
            _m("grafo_arestas", "grafo", "caso", soma_peso="sum(peso)", pares_linhas="count(*)"), _m("grafo_arestas", "grafo", "'-'", alvo_como_origem="count(*) FILTER (papel_origem = 'alvo')"),
            _m("mencao", "pares", "caso", linhas_por_caso="count(*)"), _m("captura", "cap_", "caso", linhas_por_caso="count(*)"), _m("postagem", "postagem", "caso_slug", linhas_por_caso="count(*)", autores="count(DISTINCT autor_conta_id)"),
            _m("classificacao", "rotulos", "caso_slug || ' / ' || rotulo", rotulo_por_caso="count(*)"), _m("classificacao", "rotulos", "'v1'", linhas_por_versao="count(*)"),
            _m("fato_atividade", "ativ", "versao_classificacao", linhas_por_versao_classificacao="count(*)"), _m("qc_resultado", "qc", "caso_slug || ' / ' || versao_pipeline", linhas_por_caso_versao="count(*)"),
            _m("v_qc_portao", "gate", "caso_slug || ' / ' || versao_pipeline", portao="max(bloqueios) || ' | ' || max(alertas) || ' | ' || CAST(max(bloqueios) = 0 AS VARCHAR)"),
            *[_m(t, _SRC[t], "'-'", **{f"min|max {c}": f"min({c}) || ' | ' || max({c})" for c in whole}, **{f"min|max {c}": f"CAST(min({c}) AS DECIMAL(18,6)) || ' | ' || CAST(max({c}) AS DECIMAL(18,6))" for c in parts}) for t, (whole, parts) in DOMAINS.items()],
        ]
    ),
}
