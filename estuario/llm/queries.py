"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint
from ..session import table as T
from . import lookalike, mixing, packing, reading, survivorship, tokens


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.survivors(T(spark, d, "v_deduplicado")).where("linhas > 1").select("caso_slug", "id_nativo", "capturas", "likes", "dedup_id")


def p1_sobreviventes(spark: SparkSession, d: str) -> DataFrame:
    """All fields; lists as text, mentions as id@handle, so that they can be compared."""
    pair = lambda m: F.concat(F.coalesce(m["id_nativo"], F.lit("?")), F.lit("@"), F.coalesce(m["handle"], F.lit("?")))
    return survivorship.survivors(T(spark, d, "v_deduplicado")).withColumns({"mencoes": F.array_join(F.transform("mencoes", pair), ","), "hashtags": F.array_join("hashtags", ",")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.same_reading(T(spark, d, "postagem"))


def p2_canonico(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.written(T(spark, d, "postagem"), "postagem_id", "texto", "texto_limpo")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.classes(T(spark, d, "postagem")).drop("leitura")


def p2_membros(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.membership(T(spark, d, "postagem"))


def p2_representantes(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.representative_pairs(T(spark, d, "postagem"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return checkpoint(tokens.count_tokens(T(spark, d, "documents")))


def p8_recipientes(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), T(spark, d, "capacidade"))


def p8_recipientes_refinados(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(_sizes(spark, d), T(spark, d, "capacidade"), refined=True)


def _both(spark: SparkSession, d: str, report: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    sizes, profiles = _sizes(spark, d), T(spark, d, "capacidade")
    return report(packing.pack(sizes, profiles), sizes).withColumn("classes", F.lit("harmonicas")).unionByName(report(packing.pack(sizes, profiles, refined=True), sizes).withColumn("classes", F.lit("refinadas")))


def p8_ocupacao(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, lambda packed, _: packing.report(packed))


def p8_conferencia(spark: SparkSession, d: str) -> DataFrame:
    """What the containers must hold, whatever the tokenizer: all documents with text, none over, none cut that fits, no token lost."""
    return _both(spark, d, packing.audit).drop("cortados")


def p9_mistura(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents")
    return mixing.mix(docs, mixing.rates(mixing.sized(docs), T(spark, d, "mistura_alvo")))


def p9_pesos(spark: SparkSession, d: str) -> DataFrame:
    sizes, targets = mixing.sized(T(spark, d, "documents")), T(spark, d, "mistura_alvo")
    return mixing.shares(sizes, targets, mixing.rates(sizes, targets))


def p9_conferencia(spark: SparkSession, d: str) -> DataFrame:
    """What the mixture must hold, whatever the tokenizer: documents with text per source, the cap kept, the tokens within one document (or 0.2 %) of the target."""
    g = p9_pesos(spark, d)
    near = F.abs(F.col("tokens") - F.col("tokens_alvo")) <= F.greatest("maior_documento", F.col("tokens_alvo") * 0.002)
    return g.select("source", "peso_alvo", "max_repeticoes", "documentos", (F.col("mais_copias") <= F.col("max_repeticoes")).alias("dentro_do_limite"), near.alias("perto_do_alvo"), "situacao")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = T(spark, d, "documents")
    return reading.score(docs, reading.fit(*reading.training_sample(docs, T(spark, d, "nivel_leitura"))))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("palavras >= 40 AND p_dificil >= 0.5").select("doc_id").distinct()


def p10_niveis(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d)


def p10_perfil(spark: SparkSession, d: str) -> DataFrame:
    return reading.profile(_scored(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_sobreviventes, p2_found, p2_canonico, p2_classes, p2_membros, p2_representantes, p8_recipientes, p8_recipientes_refinados, p8_ocupacao, p8_conferencia, p9_mistura, p9_pesos, p9_conferencia, p10_found, p10_niveis, p10_perfil)}

_BLANK = r"'^[\s\p{Z}\x{85}]*$'"
_TEXT = ("autor_handle", "autor_id_nativo", "texto", "idioma", "tipo_ref", "fonte", "stance_previa")
_P1 = rf"""
WITH u AS (SELECT *, nullif(ltrim(regexp_replace(regexp_replace(translate(id_nativo, '０１２３４５６７８９', '0123456789'), '[\s\p{{Z}}\x{{FEFF}}"]+', '', 'g'), '\.0*$', ''), '0'), '') AS id,
    {" + ".join(f"CASE WHEN {c} IS NULL OR regexp_full_match({c}, {_BLANK}) THEN 0 ELSE 1 END" for c in _TEXT)} + CASE WHEN created_at IS NULL THEN 0 ELSE 1 END AS cheios
  FROM v_deduplicado),
r AS (SELECT DISTINCT ON (caso_slug, id, dedup_id) * FROM u WHERE id IS NOT NULL AND caso_slug IS NOT NULL ORDER BY caso_slug, id, dedup_id),
o AS (SELECT *, row_number() OVER (PARTITION BY caso_slug, id ORDER BY cheios DESC, atualizado_em DESC NULLS LAST, dedup_id) AS n FROM r)
"""
_BEST = ", ".join(
    f"""CASE WHEN count(*) FILTER (b_{c}) > 0 THEN first({c} ORDER BY b_{c} DESC, rk DESC, atualizado_em DESC NULLS LAST, {c} DESC) END AS {c}""" for c in (*survivorship.FILLED, "ref_status_id", "ref_handle")
)
_LISTS = ", ".join(
    f"""CASE WHEN count(*) FILTER (len({c}) > 0) > 0 THEN first({text} ORDER BY len({c}) > 0 DESC NULLS LAST, rk DESC, atualizado_em DESC NULLS LAST, {c} DESC) END AS {c}"""
    for c, text in (("mencoes", "array_to_string(list_transform(mencoes, lambda m: coalesce(m.id_nativo, '?') || '@' || coalesce(m.handle, '?')), ',')"), ("hashtags", "array_to_string(hashtags, ',')"))
)
_FLAGS = ", ".join(
    f"{c} IS NOT NULL" + ("" if c == "created_at" else f" AND NOT regexp_full_match({c}, {_BLANK})") + f" AS b_{c}" for c in (*survivorship.FILLED, "ref_status_id", "ref_handle")
)
# The reading of a text, said anew for the SQL: character by character, from the characters met in the posts. A joiner counts only after a pictogram.
_DRAWN = ("абвАВЕКМНОРСТЅеорсухѕіјһӏԁΑΒΕΖΗΜΝΟΡΤΥνορɡ", "aбвABEKMHOPCTSeopcyxsijhldABEZHMNOPTYvopg")
_READ = """{n} AS (SELECT postagem_id, t, trim(regexp_replace(nfc_normalize(array_to_string(list_transform(range(1, length(t) + 1), lambda i: CASE
    WHEN u[i] BETWEEN 65281 AND 65374 THEN chr(u[i] - 65248) WHEN u[i] = 8230 THEN '...' WHEN u[i] IN (8208, 8209) THEN '-' WHEN u[i] = 64257 THEN 'fi' WHEN u[i] = 64258 THEN 'fl'
    WHEN u[i] = 8205 THEN CASE WHEN i > 1 AND (u[i - 1] BETWEEN 9000 AND 12000 OR u[i - 1] = 65039 OR u[i - 1] >= 126976) THEN chr(8205) ELSE '' END WHEN u[i] IN (173, 847, 6158, 8203, 8204, 8206, 8288, 65039, 65279) THEN '' WHEN u[i] IN (9, 160, 8239, 8287, 12288) OR u[i] BETWEEN 8192 AND 8202 THEN ' '
    ELSE translate(chr(u[i]), '""" + _DRAWN[0] + """', '""" + _DRAWN[1] + """') END), '')), ' +', ' ', 'g'), ' ') AS k
  FROM (SELECT postagem_id, {c} AS t, list_transform(range(1, length({c}) + 1), lambda i: unicode(substring({c}, i, 1))) AS u0, list_concat(u0, []) AS u FROM postagem WHERE {c} IS NOT NULL))"""
ORACLE = {
    "p1_sobreviventes": _P1
    + f""", b AS (SELECT *, {_FLAGS}, CASE lower(trim(fonte, ' ')) WHEN 'graphql' THEN 2 WHEN 'consolidado' THEN 1 ELSE 0 END AS rk FROM o)
         SELECT caso_slug, id AS id_nativo, count(*) AS linhas, CAST(sum(capturas) AS BIGINT) AS capturas, {", ".join(f"CAST(max(CASE WHEN {c} >= 0 THEN {c} END) AS BIGINT) AS {c}" for c in survivorship.COUNTERS)},
           {_BEST}, {_LISTS}, max(CASE WHEN n = 1 THEN dedup_id END) AS dedup_id FROM b GROUP BY caso_slug, id""",
    "p8_conferencia": """SELECT perfil, capacidade_tokens AS capacidade, (SELECT count(*) FROM documents WHERE length(text) > 0) AS documentos, 0::BIGINT AS cortados_sem_precisar, 0::BIGINT AS tokens_perdidos, 0::BIGINT AS excedidos, classes
         FROM capacidade, (VALUES ('harmonicas'), ('refinadas')) v(classes)""",
    "p9_conferencia": """SELECT a.source, peso_alvo, max_repeticoes, documentos, true AS dentro_do_limite, true AS perto_do_alvo, 'ok' AS situacao FROM mistura_alvo a
         JOIN (SELECT regexp_replace(regexp_replace(lower(source), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '[\\s\\p{Z}-]+', '_', 'g') AS source, count(*) AS documentos FROM documents WHERE length(text) > 0 GROUP BY 1) d USING (source)""",
    "p2_canonico": f"WITH {_READ.format(c='texto', n='a')}, {_READ.format(c='texto_limpo', n='b')} SELECT postagem_id, a.k AS texto, b.k AS texto_limpo FROM postagem LEFT JOIN a USING (postagem_id) LEFT JOIN b USING (postagem_id)",
    "p2_classes": f"""WITH {_READ.format(c="texto", n="a")} SELECT count(DISTINCT t) AS formas, count(*) AS registros, min(postagem_id) AS menor_postagem_id FROM a GROUP BY k HAVING count(DISTINCT t) > 1""",
    "p2_membros": f"""WITH {_READ.format(c="texto", n="a")}, f AS (SELECT k, t, min(postagem_id) AS representante, count(*) AS n FROM a GROUP BY ALL)
         SELECT postagem_id, classe, representante, formas, CAST(todos - n AS BIGINT) AS ligacoes FROM a JOIN f USING (k, t) JOIN (SELECT k, min(representante) AS classe, count(*) AS formas, sum(n) AS todos FROM f GROUP BY 1) USING (k) WHERE formas > 1""",
    "p2_representantes": f"""WITH {_READ.format(c="texto", n="a")}, f AS (SELECT k, t, min(postagem_id) AS r FROM a GROUP BY ALL) SELECT x.r AS postagem_id_a, y.r AS postagem_id_b FROM f x JOIN f y ON x.k = y.k AND x.r < y.r""",
    "p1_found": _P1
    + """SELECT caso_slug, id AS id_nativo, CAST(sum(capturas) AS BIGINT) AS capturas, CAST(max(CASE WHEN likes >= 0 THEN likes END) AS BIGINT) AS likes, max(CASE WHEN n = 1 THEN dedup_id END) AS dedup_id
         FROM o GROUP BY ALL HAVING count(*) > 1""",
    "p2_found": f"""WITH {_READ.format(c="texto", n="a")} SELECT x.postagem_id AS postagem_id_a, y.postagem_id AS postagem_id_b FROM a x JOIN a y ON x.k = y.k AND x.t <> y.t AND x.postagem_id < y.postagem_id""",
}
