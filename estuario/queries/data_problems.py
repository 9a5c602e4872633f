"""Queries of the general data problems: drift, instants, skew, nesting, references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, instants, nested, references, skew
from ..session import table as T


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.file_migrations(T(spark, d, "registro"), T(spark, d, "arquivo"))).select("arquivo_id", "caminho", "mudanca")


def p3_mudancas(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(drift.file_migrations(T(spark, d, "registro"), T(spark, d, "arquivo")))


def p3_versoes(spark: SparkSession, d: str) -> DataFrame:
    return drift.versions(T(spark, d, "registro"), T(spark, d, "arquivo"))


def _flat(df: DataFrame) -> DataFrame:
    """Lists as text, so that rows can be compared and made distinct: mentions as id@handle."""
    pair = lambda m: F.concat(F.coalesce(m["id_nativo"], F.lit("?")), F.lit("@"), F.coalesce(m["handle"], F.lit("?")))
    return df.withColumns({"mencoes": F.array_join(F.transform("mencoes", pair), ","), "hashtags": F.array_join("hashtags", ",")})


def p3_tabela(spark: SparkSession, d: str) -> DataFrame:
    """The one table without the fingerprint, distinct rows; extras as the sorted names of the new fields."""
    t = _flat(drift.one_table(T(spark, d, "registro"), T(spark, d, "arquivo"), optional=False)).drop("impressao")
    names = F.array_join(F.array_sort(F.map_keys(F.from_json("extras", "map<string,string>"))), ",")
    return t.withColumn("extras", F.coalesce(names, F.lit(""))).distinct()


def p3_tabela_completa(spark: SparkSession, d: str) -> DataFrame:
    """All columns of the one table, one row per record."""
    return drift.one_table(T(spark, d, "registro"), T(spark, d, "arquivo"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    r = T(spark, d, "v_normalizado").select("arquivo_id", "linha", "created_at")
    return instants.to_instants(r, T(spark, d, "fuso_arquivo")).where(F.col("instante_us").isNotNull()).select("arquivo_id", "linha", "instante_us").distinct()


def p4_situacoes(spark: SparkSession, d: str) -> DataFrame:
    r = T(spark, d, "v_normalizado").select("arquivo_id", "linha", "created_at")
    return instants.to_instants(r, T(spark, d, "fuso_arquivo")).groupBy("fuso", "situacao").agg(F.count(F.lit(1)).alias("registros"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_accounts(T(spark, d, "grafo_arestas"))


def p5_contas(spark: SparkSession, d: str) -> DataFrame:
    return skew.accounts(T(spark, d, "grafo_arestas"), T(spark, d, "mencao"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.mentions(T(spark, d, "registro"))


def p6_hashtags(spark: SparkSession, d: str) -> DataFrame:
    return nested.hashtags(T(spark, d, "registro"))


def p6_postagens(spark: SparkSession, d: str) -> DataFrame:
    return nested.posts(T(spark, d, "registro"))


def p6_pontes(spark: SparkSession, d: str) -> DataFrame:
    return nested.split(T(spark, d, "registro"))[0].withColumns({"pai": F.hex("pai"), "objeto": F.hex("objeto")})


def p6_objetos(spark: SparkSession, d: str) -> DataFrame:
    return nested.split(T(spark, d, "registro"))[1].withColumn("objeto", F.hex("objeto"))


def p6_tabela_mencoes(spark: SparkSession, d: str) -> DataFrame:
    return nested.mention_table(T(spark, d, "registro"))


def p6_tabela_hashtags(spark: SparkSession, d: str) -> DataFrame:
    return nested.hashtag_table(T(spark, d, "registro"))


def p6_tabela_postagens(spark: SparkSession, d: str) -> DataFrame:
    return nested.post_table(T(spark, d, "registro"))


def p6_conteudo_postagens(spark: SparkSession, d: str) -> DataFrame:
    """The same by what is in the posts, without their hashes."""
    return p6_tabela_postagens(spark, d).drop("objeto", "pai")


def p6_conteudo_mencoes(spark: SparkSession, d: str) -> DataFrame:
    return p6_tabela_mencoes(spark, d).drop("objeto", "pai")


def p6_ilegiveis(spark: SparkSession, d: str) -> DataFrame:
    return nested.unreadable(T(spark, d, "registro"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_references(T(spark, d, "mencao"), T(spark, d, "postagem"), T(spark, d, "conta"))


def p7_relatorio(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_counts(p7_found(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_mudancas, p3_versoes, p3_tabela, p3_tabela_completa, p4_found, p4_situacoes, p5_found, p5_contas, p6_found, p6_hashtags, p6_postagens, p6_pontes, p6_objetos, p6_tabela_mencoes, p6_tabela_hashtags, p6_tabela_postagens, p6_conteudo_postagens, p6_conteudo_mencoes, p6_ilegiveis, p7_found, p7_relatorio)}

_P7 = r"""
WITH post AS (
  SELECT postagem_id, strftime(created_at, '%Y-%m-%d') AS periodo, carregada_em AS visto_em, ref_conta_id, situacao,
         nullif(regexp_replace(regexp_replace(id_nativo, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^0+', ''), '') AS chave,
         nullif(regexp_replace(regexp_replace(ref_id_nativo, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g'), '^0+', ''), '') AS ref
  FROM postagem),
nativo AS (SELECT chave, bool_and(situacao = 'deletada') AS apagada, min(visto_em) AS de FROM post GROUP BY chave),
c AS (SELECT conta_id, min(criado_em) AS de FROM conta GROUP BY conta_id),
todas AS (
  SELECT 'mencao' AS tabela, 'conta_id' AS coluna, m.mencao_id AS registro_id, p.periodo,
         CASE WHEN c.conta_id IS NULL THEN 'ausente' WHEN c.de > p.visto_em THEN 'tardia' END AS motivo
  FROM mencao m LEFT JOIN post p USING (postagem_id) LEFT JOIN c ON c.conta_id = m.conta_id WHERE m.conta_id > 0
  UNION ALL
  SELECT 'postagem', 'ref_conta_id', p.postagem_id, p.periodo, CASE WHEN c.conta_id IS NULL THEN 'ausente' WHEN c.de > p.visto_em THEN 'tardia' END
  FROM post p LEFT JOIN c ON c.conta_id = p.ref_conta_id WHERE p.ref_conta_id > 0
  UNION ALL
  SELECT 'postagem', 'ref_id_nativo', p.postagem_id, p.periodo,
         CASE WHEN n.chave IS NULL THEN 'ausente' WHEN n.apagada THEN 'apagada' WHEN n.de > p.visto_em THEN 'tardia' END
  FROM post p LEFT JOIN nativo n ON n.chave = p.ref WHERE p.ref IS NOT NULL AND p.ref NOT LIKE '-%'),
achadas AS (SELECT DISTINCT * FROM todas WHERE motivo IS NOT NULL)
"""
_POSTS = r"""
WITH RECURSIVE p AS (
  SELECT arquivo_id, linha, 0 AS profundidade, CAST(payload AS JSON) AS j FROM registro
  UNION ALL
  SELECT arquivo_id, linha, profundidade + 1, q
  FROM (SELECT arquivo_id, linha, profundidade, coalesce(j->'$.quoted_status_result.result.tweet', j->'$.quoted_status_result.result', j->'$.quoted') AS q FROM p)
  WHERE json_type(q) = 'OBJECT' AND ((q->'$.legacy') IS NOT NULL OR (q->'$.id') IS NOT NULL))
"""
# the records in one shape, straight from the payloads: every key under the names met in the files
_LISTA = "CASE json_type({0}) WHEN 'ARRAY' THEN CAST({0} AS JSON[]) WHEN 'OBJECT' THEN [{0}] ELSE [] END"
_INT = lambda *ks: "CAST(try_cast(coalesce(" + ", ".join(f"p->>'$.{k}'" for k in ks) + ") AS DOUBLE) AS BIGINT)"
_TXT = lambda *ks: "coalesce(" + ", ".join(f"p->>'$.{k}'" for k in ks) + ")"
_NOVOS = {"geo": "p->'$.geo'", "lang": "p->'$.lang'", "possibly_sensitive": "p->'$.possibly_sensitive'", "views": "p->'$.views'"}, {"legacy.bookmark_count": "p->'$.bookmark_count'", "legacy.source_app": "p->'$.source_app'", "legacy.views": "p->'$.views'", "edit_control": "j->'$.edit_control'", "core.user_results.result.is_blue": "j->'$.core.user_results.result.is_blue'"}
_TABELA = rf"""
WITH f AS (SELECT arquivo_id, min(lower(trim(fonte))) AS fonte, min(caso_slug) AS caso_slug FROM arquivo GROUP BY 1),
 r AS (SELECT arquivo_id, linha, caso_slug, fonte, CAST(payload AS JSON) AS j FROM registro JOIN f USING (arquivo_id)),
 g AS (SELECT *, CASE fonte WHEN 'graphql' THEN j->'$.legacy' ELSE j END AS p FROM r),
 l AS (SELECT *, CASE fonte WHEN 'graphql' THEN p->'$.entities.user_mentions' ELSE p->'$.mentions' END AS m, CASE fonte WHEN 'graphql' THEN p->'$.entities.hashtags' ELSE p->'$.hashtags' END AS h,
    coalesce(p->'$.stance', p->'$.posicao') AS st, coalesce(p->'$.is_quote_status', p->'$.is_quote') AS qt FROM g),
 t AS (SELECT arquivo_id, linha, caso_slug, fonte, CASE fonte WHEN 'graphql' THEN p->>'$.id_str' ELSE p->>'$.id' END AS id_nativo,
    CASE fonte WHEN 'graphql' THEN coalesce(j->>'$.core.user_results.result.core.screen_name', j->>'$.core.user_results.result.core.username') ELSE {_TXT("user", "author")} END AS autor_handle,
    CASE fonte WHEN 'graphql' THEN coalesce(j->>'$.core.user_results.result.rest_id', j->>'$.core.user_results.result.user_id') END AS autor_id_nativo,
    {_TXT("created_at", "created_at_iso", "createdAtIso")} AS created_at, {_TXT("full_text", "text", "body")} AS texto, CASE fonte WHEN 'graphql' THEN p->>'$.lang' END AS idioma,
    nullif({_TXT("in_reply_to_status_id_str", "in_reply_to_status_id")}, '') AS ref_status_id, lower(nullif({_TXT("in_reply_to_screen_name", "reply_to_handle", "in_reply_to_user")}, '')) AS ref_handle,
    CASE WHEN qt->>'$' IN ('true', '1') THEN true WHEN qt->>'$' IN ('false', '0') THEN false END AS eh_quote,
    {_INT("favorite_count", "like_count", "likes")} AS likes, {_INT("retweet_count", "retweetCount")} AS retweets, {_INT("quote_count")} AS quotes, {_INT("reply_count", "replyCount")} AS respostas,
    array_to_string(list_transform(list_filter({_LISTA.format("m")}, lambda x: json_type(x) <> 'NULL'),
       lambda x: coalesce(x->>'$.id_str', '?') || '@' || coalesce(lower(coalesce(x->>'$.screen_name', x->>'$.username', x->>'$.handle')), '?')), ',') AS mencoes,
    array_to_string(CASE json_type(h) WHEN 'VARCHAR' THEN list_filter(string_split_regex(lower(h->>'$'), '[\s,;]+'), lambda x: x <> '')
       ELSE list_filter(list_transform({_LISTA.format("h")}, lambda x: lower(CASE json_type(x) WHEN 'OBJECT' THEN x->>'$.text' ELSE x->>'$' END)), lambda x: trim(x) <> '') END, ',') AS hashtags,
    CASE WHEN fonte = 'consolidado' THEN nullif(CASE json_type(st) WHEN 'OBJECT' THEN st->>'$.label' ELSE st->>'$' END, '') END AS stance_previa,
    array_to_string(list_sort(list_filter(CASE fonte WHEN 'graphql' THEN [{", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN '{k}' END" for k, v in _NOVOS[1].items())}]
       ELSE [{", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN '{k}' END" for k, v in _NOVOS[0].items())}, CASE WHEN json_type(m) = 'ARRAY' AND len(list_filter(CAST(m AS JSON[]), lambda x: (x->'$.verified') IS NOT NULL)) > 0 THEN 'mentions[].verified' END] END,
       lambda x: x IS NOT NULL)), ',') AS extras FROM l)
"""
# each base key: parent, path above it, key, names met later, JSON types; by fonte
_I, _V = "'BIGINT', 'UBIGINT'", "'VARCHAR'"
_RES = "j->'$.core.user_results.result'"
_BASES = {
    "graphql": [
        ("j", "", "core", (), "'OBJECT'"), ("j", "", "legacy", (), "'OBJECT'"), ("j->'$.core'", "core.", "user_results", (), "'OBJECT'"), ("j->'$.core.user_results'", "core.user_results.", "result", (), "'OBJECT'"),
        (_RES, "core.user_results.result.", "rest_id", ("user_id",), _V), (_RES, "core.user_results.result.", "core", (), "'OBJECT'"), (f"{_RES}->'$.core'", "core.user_results.result.core.", "screen_name", ("username", "handle"), _V),
        *[("j->'$.legacy'", "legacy.", k, n, t) for k, n, t in (
            ("id_str", (), _V), ("created_at", ("createdAt",), _V), ("full_text", ("text",), _V), ("lang", ("language",), _V), ("in_reply_to_status_id_str", (), _V), ("in_reply_to_screen_name", ("reply_to_handle",), _V), ("is_quote_status", (), "'BOOLEAN'"),
            ("favorite_count", ("like_count", "favoriteCount"), _I), ("retweet_count", ("retweetCount",), _I), ("quote_count", ("quoteCount",), _I), ("reply_count", ("replyCount",), _I), ("entities", (), "'OBJECT'"))],
        ("j->'$.legacy.entities'", "legacy.entities.", "user_mentions", (), "'ARRAY'"), ("j->'$.legacy.entities'", "legacy.entities.", "hashtags", (), "'ARRAY'"),
        ("m", "legacy.entities.user_mentions[].", "id_str", (), _V), ("m", "legacy.entities.user_mentions[].", "screen_name", ("username",), _V), ("h", "legacy.entities.hashtags[].", "text", (), _V),
    ],
    "consolidado": [
        *[("j", "", k, n, t) for k, n, t in (
            ("id", (), _V), ("user", ("author",), _V), ("text", ("body",), _V), ("created_at_iso", ("createdAtIso",), _V), ("in_reply_to_status_id", (), _V), ("in_reply_to_user", (), _V), ("stance", ("posicao",), _V), ("is_quote", (), "'BOOLEAN'"),
            ("like_count", ("likes", "likeCount"), _I), ("retweet_count", ("retweets", "retweetCount"), _I), ("quote_count", ("quoteCount",), _I), ("reply_count", ("replyCount",), _I), ("mentions", (), "'ARRAY'"), ("hashtags", (), "'ARRAY'"))],
        ("m", "mentions[].", "id_str", (), _V), ("m", "mentions[].", "username", ("handle",), _V),
    ],
}
_OPCIONAIS = "'quoted_status_result', 'legacy.entities.urls', 'legacy.place', 'quoted', 'media'"


def _p3_sql() -> str:
    out, parents = [], {}
    for fonte, keys in _BASES.items():
        for p, above, k, new, types in keys:
            src = {"m": "ms", "h": "hs"}.get(p, "rs")
            at = lambda key: f"({p})->'$.{key}'"  # noqa: E731, B023
            parents.setdefault((fonte, src, p, above), []).append((k, new))
            is_object = f"fonte = '{fonte}' AND json_type({p}) = 'OBJECT'"
            there = " OR ".join(f"({at(n)}) IS NOT NULL" for n in new) or "false"
            out.append(f"SELECT rid, arquivo_id, '{above}{k}' AS caminho, CASE WHEN {there} THEN 'renomeado' ELSE 'removido' END AS mudanca FROM {src} WHERE {is_object} AND ({at(k)}) IS NULL")
            value = f"coalesce({', '.join(at(n) for n in (k, *new))})"
            out.append(f"SELECT rid, arquivo_id, '{above}{k}', 'tipo' FROM {src} WHERE {is_object} AND json_type({value}) NOT IN ({types}, 'NULL')")
    for (fonte, src, p, above), keys in parents.items():
        known = ", ".join(f"'{k}'" for k, _ in keys)
        used = " OR ".join(f"(k = '{n}' AND ({p}->'$.{b}') IS NULL)" for b, new in keys for n in new) or "false"
        out.append(f"SELECT rid, arquivo_id, '{above}' || k, 'adicionado' FROM (SELECT *, unnest(json_keys({p})) AS k FROM {src} WHERE fonte = '{fonte}' AND json_type({p}) = 'OBJECT') WHERE k NOT IN ({known}) AND '{above}' || k NOT IN ({_OPCIONAIS}) AND NOT ({used})")
    out.append("SELECT rid, arquivo_id, CASE fonte WHEN 'graphql' THEN 'legacy.entities.hashtags[]' ELSE 'hashtags[]' END, 'tipo' FROM hs WHERE json_type(h) NOT IN (CASE fonte WHEN 'graphql' THEN 'OBJECT' ELSE 'VARCHAR' END, 'NULL')")
    out.append("SELECT rid, arquivo_id, CASE fonte WHEN 'graphql' THEN 'legacy.entities.user_mentions[]' ELSE 'mentions[]' END, 'tipo' FROM ms WHERE json_type(m) NOT IN ('OBJECT', 'NULL')")
    lists = lambda g, c: f"SELECT rid, arquivo_id, fonte, unnest(CAST(x AS JSON[])) AS {{0}} FROM (SELECT *, CASE fonte WHEN 'graphql' THEN j->'$.legacy.entities.{g}' ELSE j->'$.{c}' END AS x FROM rs) WHERE json_type(x) = 'ARRAY'"
    return f"""WITH f AS (SELECT arquivo_id, min(lower(trim(fonte))) AS fonte FROM arquivo GROUP BY 1), rs AS (SELECT row_number() OVER () AS rid, arquivo_id, fonte, CAST(payload AS JSON) AS j FROM registro JOIN f USING (arquivo_id)),
      ms AS ({lists("user_mentions", "mentions").format("m")}), hs AS ({lists("hashtags", "hashtags").format("h")}), c AS ({" UNION ALL ".join(out)})"""


_P3 = _p3_sql()
_MES = "s"
for _a, _b in zip("janeiro fevereiro março abril maio junho julho agosto setembro outubro novembro dezembro".split(), range(1, 13)):
    _MES = f"replace({_MES}, ' de {_a} de ', '/{_b}/')"
_ABREV = "regexp_replace(regexp_replace(s, '\\[.*\\]$', ''), ' ?(Z|UTC|GMT)$', '+0000')"
for _a, _m in instants.ABBREVIATIONS.items():
    if len(_a) > 2 and _a not in ("UTC", "GMT"):
        _ABREV = f"regexp_replace({_ABREV}, ' {_a}$', '{'-' if _m < 0 else '+'}{abs(_m) // 60:02d}00')"
_P4 = rf"""
WITH r AS (SELECT DISTINCT arquivo_id, linha, trim(created_at) AS s FROM v_normalizado),
 n AS (SELECT *, {_MES} AS m, {_ABREV} AS z FROM r),
 t AS (SELECT arquivo_id, linha, s,
   CASE WHEN regexp_full_match(s, '\d{{10}}') THEN CAST(s AS BIGINT) * 1000000 WHEN regexp_full_match(s, '\d{{13}}') THEN CAST(s AS BIGINT) * 1000 END AS epoca,
   CASE WHEN regexp_matches(z, '^\d{{4}}-') AND try_cast(left(z, 10) AS DATE) IS NULL THEN NULL ELSE epoch_us(try_strptime(z, ['%a %b %d %H:%M:%S %z %Y', '%Y-%m-%dT%H:%M:%S.%f%z', '%Y-%m-%dT%H:%M:%S%z', '%Y-%m-%d %H:%M:%S.%f%z', '%Y-%m-%d %H:%M:%S%z', '%a, %d %b %Y %H:%M:%S%z', '%Y%m%dT%H%M%S%z'])) END AS zonado,
   CASE WHEN regexp_full_match(s, '\d\d/\d\d/\d\d .*') THEN try_strptime(s, '%d/%m/%y %H:%M')
        ELSE try_strptime(m, ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M', '%d/%m/%Y %H:%M:%S', '%d/%m/%Y às %Hh%M', '%d/%m/%Y, %H:%M:%S', '%b %d, %Y %I:%M:%S %p']) END AS parede FROM n),
 f AS (SELECT t.*, timezone(fuso, parede) AS a, fuso FROM t LEFT JOIN fuso_arquivo USING (arquivo_id)),
 g AS (SELECT arquivo_id, linha, coalesce(epoca, zonado, epoch_us(CASE WHEN timezone(fuso, a - INTERVAL 1 HOUR) = parede THEN a - INTERVAL 1 HOUR ELSE a END)) AS instante_us FROM f)
"""
ORACLE = {
    "p4_found": _P4 + "SELECT DISTINCT arquivo_id, linha, instante_us FROM g WHERE instante_us IS NOT NULL",
    "p6_hashtags": _POSTS
    + r""", l AS (SELECT arquivo_id, linha, profundidade, coalesce(j->'$.legacy.entities.hashtags', j->'$.hashtags') AS m FROM p),
      e AS (SELECT arquivo_id, linha, profundidade, CASE WHEN json_type(m) = 'ARRAY' THEN list_transform(CAST(m AS JSON[]), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.text' ELSE x->>'$' END)
              WHEN json_type(m) = 'VARCHAR' THEN list_filter(string_split_regex(m->>'$', '[\s,;]+'), lambda x: x <> '') END AS a FROM l),
      x AS (SELECT arquivo_id, linha, profundidade, unnest(a) AS h, generate_subscripts(a, 1) - 1 AS posicao FROM e)
      SELECT DISTINCT arquivo_id, linha, profundidade, CAST(posicao AS INTEGER) AS posicao, lower(h) AS hashtag FROM x WHERE h IS NOT NULL""",
    "p3_found": _P3 + " SELECT DISTINCT arquivo_id, caminho, mudanca FROM c",
    "p3_mudancas": _P3 + " SELECT arquivo_id, caminho, mudanca, count(DISTINCT rid) AS registros FROM c GROUP BY ALL",
    "p3_tabela": _TABELA + " SELECT DISTINCT * EXCLUDE (caso_slug) FROM t",
    "p6_conteudo_postagens": _POSTS + " SELECT DISTINCT arquivo_id, linha, profundidade, " + ", ".join(
        f"coalesce({', '.join(f"j->>'$.{k}'" for k in ks)}) AS {n}" for n, ks in {
            "id_nativo": ("legacy.id_str", "id"), "autor_handle": ("core.user_results.result.core.screen_name", "core.user_results.result.core.username", "user", "author"), "created_at": ("legacy.created_at", "created_at_iso", "createdAtIso"),
            "texto": ("legacy.full_text", "legacy.text", "text", "body"), "likes": ("legacy.favorite_count", "legacy.like_count", "like_count", "likes")}.items()) + " FROM p",
    "p6_ilegiveis": "SELECT arquivo_id, linha, CASE WHEN payload IS NULL OR trim(payload) = '' THEN 'vazio' WHEN NOT json_valid(payload) THEN 'json' ELSE 'nao_objeto' END AS motivo FROM registro WHERE payload IS NULL OR NOT json_valid(payload) OR json_type(payload) <> 'OBJECT'",
    "p4_situacoes": _P4 + """, s AS (SELECT r.arquivo_id, r.linha, r.created_at, g.instante_us, t.epoca, t.zonado, t.parede, f.fuso FROM v_normalizado r JOIN t ON t.arquivo_id = r.arquivo_id AND t.linha = r.linha AND t.s IS NOT DISTINCT FROM trim(r.created_at)
        JOIN g ON g.arquivo_id = r.arquivo_id AND g.linha = r.linha LEFT JOIN fuso_arquivo f ON f.arquivo_id = r.arquivo_id)
      SELECT fuso, CASE WHEN epoca IS NOT NULL OR zonado IS NOT NULL THEN 'explicita' WHEN parede IS NULL THEN 'ilegivel' WHEN fuso IS NULL THEN 'sem_fuso' WHEN timezone(fuso, timezone(fuso, parede)) <> parede THEN 'inexistente'
        WHEN timezone(fuso, timezone(fuso, parede) - INTERVAL 1 HOUR) = parede OR timezone(fuso, timezone(fuso, parede) + INTERVAL 1 HOUR) = parede THEN 'ambigua' ELSE 'unica' END AS situacao, count(*) AS registros FROM s GROUP BY 1, 2""",
    "p5_found": "SELECT destino_conta_id FROM grafo_arestas WHERE destino_conta_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 0.01 * (SELECT count(*) FROM grafo_arestas)",
    "p5_contas": """
        WITH e AS (SELECT destino_conta_id, count(*) AS arestas, CAST(sum(peso) AS BIGINT) AS peso, count(DISTINCT origem_conta_id) AS origens, count(DISTINCT data) AS dias
                   FROM grafo_arestas WHERE destino_conta_id IS NOT NULL GROUP BY 1),
             m AS (SELECT conta_id, count(*) AS n FROM mencao GROUP BY 1)
        SELECT coalesce(destino_conta_id, conta_id) AS destino_conta_id, coalesce(arestas, 0) AS arestas, peso, coalesce(origens, 0) AS origens, coalesce(dias, 0) AS dias, coalesce(n, 0) AS mencoes,
               coalesce(arestas, 0) * coalesce(n, 0) AS pares, peso * coalesce(n, 0) AS peso_pares
        FROM e FULL JOIN m ON conta_id = destino_conta_id WHERE coalesce(destino_conta_id, conta_id) IS NOT NULL""",
    "p6_found": _POSTS
    + r""", l AS (SELECT arquivo_id, linha, profundidade, coalesce(j->'$.legacy.entities.user_mentions', j->'$.mentions') AS m FROM p),
      e AS (SELECT arquivo_id, linha, profundidade, CASE WHEN json_type(m) = 'ARRAY' THEN CAST(m AS JSON[]) WHEN json_type(m) = 'OBJECT' THEN [m] END AS a FROM l),
      x AS (SELECT arquivo_id, linha, profundidade, unnest(a) AS item, generate_subscripts(a, 1) - 1 AS posicao FROM e)
      SELECT DISTINCT arquivo_id, linha, profundidade, CAST(posicao AS INTEGER) AS posicao, lower(coalesce(item->>'$.screen_name', item->>'$.username', item->>'$.handle')) AS handle
      FROM x WHERE coalesce(item->>'$.screen_name', item->>'$.username', item->>'$.handle') IS NOT NULL""",
    "p6_conteudo_mencoes": _POSTS
    + r""", l AS (SELECT arquivo_id, linha, profundidade, coalesce(j->'$.legacy.entities.user_mentions', j->'$.mentions') AS m FROM p),
      e AS (SELECT arquivo_id, linha, profundidade, CASE WHEN json_type(m) = 'ARRAY' THEN CAST(m AS JSON[]) WHEN json_type(m) = 'OBJECT' THEN [m] END AS a FROM l),
      x AS (SELECT arquivo_id, linha, profundidade, unnest(a) AS item, generate_subscripts(a, 1) - 1 AS posicao FROM e)
      SELECT DISTINCT arquivo_id, linha, profundidade, CAST(posicao AS INTEGER) AS posicao, item->>'$.id_str' AS id_nativo, lower(coalesce(item->>'$.screen_name', item->>'$.username', item->>'$.handle')) AS handle FROM x WHERE json_type(item) <> 'NULL'""",
    "p7_found": _P7 + "SELECT * FROM achadas",
    "p7_relatorio": _P7 + "SELECT tabela, coluna, periodo, motivo, count(*) AS referencias FROM achadas GROUP BY ALL",
}
