"""The relational primitives: predicates, joins, aggregates, windows, sorts, set operations and scalar functions, one query each.

They are user-level SQL over the given tables. ``{name}`` is a table; where DuckDB says a thing differently the second text is given.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..session import table as T

# name: (Spark SQL, DuckDB SQL or None where both read the same)
SQL: dict[str, tuple[str, str | None]] = {
    # literal rows, parameters
    "s7_values": ("SELECT * FROM VALUES ('pre_crise', 1), ('estopim', 2), ('pico', 3) AS t(fase, ordem) UNION ALL SELECT 'total', 9", "SELECT * FROM (VALUES ('pre_crise', 1), ('estopim', 2), ('pico', 3)) t(fase, ordem) UNION ALL SELECT 'total', 9"),
    # projections and predicates
    "f1_star_plus": ("SELECT *, o_totalprice * 2 AS dobro FROM {orders}", None),
    "f2_searched_case": ("SELECT caso_slug, CAST(sum(CASE WHEN tipo_ref = 'reply' THEN CASE WHEN ref_conta_id IS NULL THEN 1 ELSE 2 END ELSE 0 END) AS BIGINT) AS soma FROM {postagem} GROUP BY caso_slug", None),
    "f3_rank_case": ("SELECT fase, CASE fase WHEN 'pre_crise' THEN 1 WHEN 'estopim' THEN 2 WHEN 'escalada' THEN 3 WHEN 'pico' THEN 4 WHEN 'declinio' THEN 5 ELSE 6 END AS ordem, count(*) AS n FROM {grafo_arestas} GROUP BY fase", None),
    "f4_in_list": ("SELECT postagem_id, idioma FROM {postagem} WHERE idioma IN ('es', 'en') OR situacao NOT IN ('ativa', 'suspensa')", None),
    "f5_between": ("SELECT data, count(*) AS n FROM {grafo_arestas} WHERE dias_desde_estopim BETWEEN -2 AND 2 GROUP BY data", None),
    "f6_rlike": ("SELECT conta_id, handle FROM {conta} WHERE handle RLIKE '^[a-m].*_[0-9]' AND NOT (id_nativo RLIKE '7$')", "SELECT conta_id, handle FROM {conta} WHERE regexp_matches(handle, '^[a-m].*_[0-9]') AND NOT regexp_matches(id_nativo, '7$')"),
    "f7_like": ("SELECT uri, formato FROM {arquivo} WHERE uri LIKE '%/graphql%' AND formato LIKE 'json%'", None),
    "f8_blank_or_null": ("SELECT caso_slug, count(*) AS n FROM {v_deduplicado} WHERE texto IS NULL OR trim(texto) = '' GROUP BY caso_slug", "SELECT caso_slug, count(*) AS n FROM {v_deduplicado} WHERE texto IS NULL OR trim(texto, ' ') = '' GROUP BY caso_slug"),
    "f9_null_safe_equal": ("SELECT a.postagem_id, a.texto <=> a.texto_limpo AS igual FROM {postagem} a", "SELECT a.postagem_id, a.texto IS NOT DISTINCT FROM a.texto_limpo AS igual FROM {postagem} a"),
    "f10_boolean_output": ("SELECT postagem_id, created_at < carregada_em AS antes, ref_conta_id > 100 AS grande FROM {postagem}", None),
    "f11_scalar_subquery": ("SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM {orders}) > 0 AS acima FROM {orders} WHERE o_totalprice > (SELECT min(o_totalprice) FROM {orders})", None),
    "f12_exists": ("SELECT c.conta_id FROM {conta} c WHERE EXISTS (SELECT 1 FROM {mencao} m WHERE m.conta_id = c.conta_id)", None),
    "f13_not_exists": ("SELECT c.conta_id FROM {conta} c WHERE NOT EXISTS (SELECT 1 FROM {postagem} p WHERE p.autor_conta_id = c.conta_id)", None),
    "f15_in_subquery": ("SELECT postagem_id FROM {postagem} WHERE ref_conta_id IN (SELECT conta_id FROM {conta} WHERE conta_id <= 40) AND postagem_id NOT IN (SELECT postagem_id FROM {mencao})", None),
    "f16_cte_chain": (
        "WITH p AS (SELECT caso_slug, autor_conta_id, count(*) AS n FROM {postagem} GROUP BY 1, 2), q AS (SELECT caso_slug, max(n) AS maior FROM p GROUP BY 1) SELECT p.caso_slug, p.autor_conta_id, p.n FROM p JOIN q ON q.caso_slug = p.caso_slug AND q.maior = p.n",
        None,
    ),
    "f17_derived_table": ("SELECT sum(n) AS total, count(*) AS grupos FROM (SELECT conta_id, count(*) AS n FROM {mencao} GROUP BY conta_id)", "SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS grupos FROM (SELECT conta_id, count(*) AS n FROM {mencao} GROUP BY conta_id)"),
    "f18_group_by_ordinal": ("SELECT situacao, tipo_ref AS tipo, count(*) AS n FROM {postagem} GROUP BY 1, tipo ORDER BY 3 DESC, 1", None),
    "f19_distinct": ("SELECT DISTINCT caso, origem_conta_id, stance_origem FROM {grafo_arestas}", None),
    "f20_explode": ("SELECT arquivo_id, linha, h AS hashtag FROM {v_normalizado} LATERAL VIEW explode(hashtags) x AS h", "SELECT arquivo_id, linha, unnest(hashtags) AS hashtag FROM {v_normalizado}"),
    "f21_typed_null": ("SELECT postagem_id, CAST(NULL AS STRING) AS nada, 'x' AS plataforma FROM {postagem}", "SELECT postagem_id, CAST(NULL AS VARCHAR) AS nada, 'x' AS plataforma FROM {postagem}"),
    # joins
    "j1_inner": ("SELECT p.postagem_id, c.handle FROM {postagem} p JOIN {conta} c ON c.conta_id = p.autor_conta_id", None),
    "j2_inner_two_keys": ("SELECT a.caso, a.data, count(*) AS n FROM {grafo_arestas} a JOIN (SELECT DISTINCT caso, data FROM {grafo_arestas} WHERE fase = 'pico') b ON b.caso = a.caso AND b.data = a.data GROUP BY a.caso, a.data", None),
    "j3_using": ("SELECT arquivo_id, fuso, fonte FROM {arquivo} JOIN {fuso_arquivo} USING (arquivo_id)", None),
    "j4_expression_key": ("SELECT v.linha, v.arquivo_id, c.conta_id FROM {v_normalizado} v JOIN {conta} c ON lower(c.handle) = lower(v.autor_handle)", None),
    "j5_constant_in_on": ("SELECT p.postagem_id, c.conta_id FROM {postagem} p LEFT JOIN {conta} c ON c.conta_id = p.ref_conta_id AND c.conta_id <= 40", None),
    "j6_star_fan_out": (
        "SELECT e.caso, o.n_name AS origem, d.n_name AS destino, sum(e.peso) AS peso FROM {grafo_arestas} e LEFT JOIN {nation} o ON o.n_nationkey = e.origem_conta_id % 25 LEFT JOIN {nation} d ON d.n_nationkey = e.destino_conta_id % 30 GROUP BY e.caso, o.n_name, d.n_name",
        "SELECT e.caso, o.n_name AS origem, d.n_name AS destino, CAST(sum(e.peso) AS BIGINT) AS peso FROM {grafo_arestas} e LEFT JOIN {nation} o ON o.n_nationkey = e.origem_conta_id % 25 LEFT JOIN {nation} d ON d.n_nationkey = e.destino_conta_id % 30 GROUP BY e.caso, o.n_name, d.n_name",
    ),
    "j7_left_is_null": ("SELECT count(*) AS sem_conta FROM {postagem} p LEFT JOIN {conta} c ON c.conta_id = p.autor_conta_id WHERE c.conta_id IS NULL", None),
    "j8_full_outer": (
        "SELECT coalesce(a.conta_id, b.conta_id) AS conta_id, coalesce(a.n, 0) AS mencoes, coalesce(b.n, 0) AS arestas FROM (SELECT conta_id, count(*) AS n FROM {mencao} GROUP BY 1) a FULL OUTER JOIN (SELECT destino_conta_id AS conta_id, count(*) AS n FROM {grafo_arestas} GROUP BY 1) b ON a.conta_id = b.conta_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)",
        None,
    ),
    "j9_left_anti": ("SELECT c.conta_id FROM {conta} c LEFT ANTI JOIN {grafo_arestas} g ON g.origem_conta_id = c.conta_id", "SELECT c.conta_id FROM {conta} c ANTI JOIN {grafo_arestas} g ON g.origem_conta_id = c.conta_id"),
    "j11_value_match": ("SELECT caso, data, n FROM (SELECT caso, data, n, max(n) OVER (PARTITION BY caso) AS m FROM (SELECT caso, data, count(*) AS n FROM {grafo_arestas} GROUP BY 1, 2)) WHERE n = m", None),
    "j12_multi_fact": (
        "WITH a AS (SELECT caso_slug AS caso, CAST(created_at AS DATE) AS data, count(*) AS posts FROM {postagem} GROUP BY 1, 2), b AS (SELECT caso, data, count(*) AS arestas FROM {grafo_arestas} GROUP BY 1, 2) SELECT a.caso, a.data, posts, arestas FROM a LEFT JOIN b ON b.caso = a.caso AND b.data = a.data",
        None,
    ),
    "j15_pre_aggregated": (
        "SELECT p.postagem_id, coalesce(m.n, 0) AS mencoes, coalesce(v.n, 0) AS capturas FROM {postagem} p LEFT JOIN (SELECT postagem_id, count(*) AS n FROM {mencao} GROUP BY 1) m ON m.postagem_id = p.postagem_id LEFT JOIN (SELECT id_nativo, count(*) AS n FROM {v_normalizado} GROUP BY 1) v ON v.id_nativo = p.id_nativo",
        None,
    ),
    # aggregates
    "a1_counts": ("SELECT caso_slug, count(*) AS linhas, count(texto) AS com_texto, count(CASE WHEN tipo_ref = 'reply' THEN 1 END) AS replies FROM {postagem} GROUP BY caso_slug", None),
    "a2_multi_distinct": ("SELECT l_returnflag, count(DISTINCT l_orderkey) AS pedidos, count(DISTINCT l_partkey) AS pecas, count(DISTINCT l_suppkey) AS fornecedores FROM {lineitem} GROUP BY l_returnflag", None),
    "a3_having_distinct": ("SELECT caso_slug, id_nativo, count(DISTINCT struct(likes, retweets)) AS versoes FROM {v_normalizado} GROUP BY caso_slug, id_nativo HAVING count(DISTINCT struct(likes, retweets)) > 1", "SELECT caso_slug, id_nativo, count(DISTINCT (likes, retweets)) AS versoes FROM {v_normalizado} GROUP BY caso_slug, id_nativo HAVING count(DISTINCT (likes, retweets)) > 1"),
    "a4_sum_distinct": ("SELECT caso_slug, sum(bytes) AS todos, sum(DISTINCT bytes) AS distintos FROM {arquivo} GROUP BY caso_slug", "SELECT caso_slug, CAST(sum(bytes) AS BIGINT) AS todos, CAST(sum(DISTINCT bytes) AS BIGINT) AS distintos FROM {arquivo} GROUP BY caso_slug"),
    "a5_min_max_case": ("SELECT caso, min(data) AS de, max(data) AS ate, max(CASE WHEN fase = 'pico' THEN peso END) AS maior_no_pico FROM {grafo_arestas} GROUP BY caso", None),
    "a6_avg_case": ("SELECT caso, round(avg(peso), 6) AS media, round(avg(CASE WHEN stance_origem = 'acusador' THEN peso END), 6) AS media_acusador FROM {grafo_arestas} GROUP BY caso", None),
    "a7_first_capture": (
        "SELECT caso_slug, id_nativo, p.texto, p.autor_handle FROM (SELECT caso_slug, id_nativo, min_by(struct(texto, autor_handle), struct(arquivo_id, linha)) AS p FROM {v_normalizado} GROUP BY caso_slug, id_nativo)",
        "SELECT caso_slug, id_nativo, texto, autor_handle FROM (SELECT *, row_number() OVER (PARTITION BY caso_slug, id_nativo ORDER BY arquivo_id, linha) AS n FROM {v_normalizado}) WHERE n = 1",
    ),
    "a8_arg_max": ("SELECT caso, max_by(data, struct(n, -datediff(data, DATE'2000-01-01'))) AS dia FROM (SELECT caso, data, count(*) AS n FROM {grafo_arestas} GROUP BY 1, 2) GROUP BY caso", "SELECT caso, data AS dia FROM (SELECT *, row_number() OVER (PARTITION BY caso ORDER BY n DESC, data) AS k FROM (SELECT caso, data, count(*) AS n FROM {grafo_arestas} GROUP BY 1, 2)) WHERE k = 1"),
    "a9_cv": ("SELECT caso, round(stddev_samp(n) / avg(n), 9) AS cv FROM (SELECT caso, data, count(*) AS n FROM {grafo_arestas} GROUP BY 1, 2) GROUP BY caso", None),
    "a10_corr": ("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM {lineitem} GROUP BY l_returnflag", None),
    "a11_median": ("SELECT l_returnflag, percentile_approx(l_quantity, 0.5, 1000000) AS mediana FROM {lineitem} GROUP BY l_returnflag", "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS mediana FROM {lineitem} GROUP BY l_returnflag"),
    "a12_having": ("SELECT autor_conta_id, count(*) AS n FROM {postagem} GROUP BY autor_conta_id HAVING count(*) >= 3", None),
    "a13_boolean": ("SELECT caso_slug, count(*) = 0 AS vazio, sum(CASE WHEN texto IS NULL THEN 1 ELSE 0 END) = 0 AS completo FROM {postagem} GROUP BY caso_slug", None),
    "a14_grouping_sets": (
        "SELECT caso, CASE WHEN grouping(stance_origem) = 1 THEN 'todas' ELSE stance_origem END AS stance, sum(peso) AS peso FROM {grafo_arestas} GROUP BY GROUPING SETS ((caso, stance_origem), (caso))",
        "SELECT caso, CASE WHEN grouping(stance_origem) = 1 THEN 'todas' ELSE stance_origem END AS stance, CAST(sum(peso) AS BIGINT) AS peso FROM {grafo_arestas} GROUP BY GROUPING SETS ((caso, stance_origem), (caso))",
    ),
    "a15_aggregate_of_aggregate": ("SELECT caso, max(n) AS maior, count(*) AS dias FROM (SELECT caso, data, count(DISTINCT origem_conta_id) AS n FROM {grafo_arestas} GROUP BY 1, 2) GROUP BY caso", None),
    "a16_global": ("SELECT count(*) AS n, (SELECT count(*) FROM {mencao}) - (SELECT count(*) FROM (SELECT DISTINCT postagem_id, conta_id FROM {mencao})) AS repetidas FROM {postagem}", None),
    "a17_weighted_mean": ("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS desconto FROM {lineitem} GROUP BY l_returnflag", None),
    "a18_pivot": (
        "SELECT * FROM (SELECT caso, stance_origem, peso FROM {grafo_arestas}) PIVOT (sum(peso) FOR stance_origem IN ('acusador', 'defensor', 'neutro'))",
        "SELECT caso, CAST(sum(peso) FILTER (stance_origem = 'acusador') AS BIGINT) AS acusador, CAST(sum(peso) FILTER (stance_origem = 'defensor') AS BIGINT) AS defensor, CAST(sum(peso) FILTER (stance_origem = 'neutro') AS BIGINT) AS neutro FROM {grafo_arestas} GROUP BY caso",
    ),
    # windows
    "w1_row_number": ("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS pos FROM {orders}", None),
    "w2_rank": ("SELECT caso, destino_conta_id, CAST(rank() OVER (PARTITION BY caso ORDER BY sum(peso) DESC) AS INT) AS posto FROM {grafo_arestas} GROUP BY caso, destino_conta_id", None),
    "w3_lag": ("SELECT caso, data, n - lag(n) OVER (PARTITION BY caso ORDER BY data) AS delta FROM (SELECT caso, data, count(*) AS n FROM {grafo_arestas} GROUP BY 1, 2)", None),
    "w4_partition_wide": ("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS maior FROM {orders}", None),
    "w5_conditional_max": ("SELECT caso, data, n, max(CASE WHEN data >= DATE '2023-10-23' THEN n END) OVER (PARTITION BY caso) AS pico FROM (SELECT caso, data, count(*) AS n FROM {grafo_arestas} GROUP BY 1, 2)", None),
    "w6_running_total": ("SELECT caso, data, sum(count(*)) OVER (PARTITION BY caso ORDER BY data) AS acumulado FROM {grafo_arestas} GROUP BY caso, data", "SELECT caso, data, CAST(sum(count(*)) OVER (PARTITION BY caso ORDER BY data) AS BIGINT) AS acumulado FROM {grafo_arestas} GROUP BY caso, data"),
    "w7_share": ("SELECT caso, data, round(CAST(sum(peso) AS DOUBLE) / sum(sum(peso)) OVER (PARTITION BY caso), 9) AS parcela FROM {grafo_arestas} GROUP BY caso, data", "SELECT caso, data, round(CAST(sum(peso) AS DOUBLE) / CAST(sum(sum(peso)) OVER (PARTITION BY caso) AS DOUBLE), 9) AS parcela FROM {grafo_arestas} GROUP BY caso, data"),
    "w8_mode": (
        "SELECT caso, origem_conta_id, stance_origem FROM (SELECT caso, origem_conta_id, stance_origem, row_number() OVER (PARTITION BY caso, origem_conta_id ORDER BY count(*) DESC, stance_origem) AS n FROM {grafo_arestas} GROUP BY caso, origem_conta_id, stance_origem) WHERE n = 1",
        "SELECT caso, origem_conta_id, stance_origem FROM (SELECT *, row_number() OVER (PARTITION BY caso, origem_conta_id ORDER BY c DESC, stance_origem) AS n FROM (SELECT caso, origem_conta_id, stance_origem, count(*) AS c FROM {grafo_arestas} GROUP BY 1, 2, 3)) WHERE n = 1",
    ),
    "w9_top_k": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {orders}) WHERE n <= 3", None),
    "w10_pct_cut": (
        "SELECT caso, count(*) AS contas, sum(p) AS peso FROM (SELECT caso, p, row_number() OVER (PARTITION BY caso ORDER BY p DESC, destino_conta_id) AS pos, count(*) OVER (PARTITION BY caso) AS n FROM (SELECT caso, destino_conta_id, sum(peso) AS p FROM {grafo_arestas} GROUP BY 1, 2)) WHERE pos <= ceil(0.1 * n) GROUP BY caso",
        "SELECT caso, count(*) AS contas, CAST(sum(p) AS BIGINT) AS peso FROM (SELECT caso, p, row_number() OVER (PARTITION BY caso ORDER BY p DESC, destino_conta_id) AS pos, count(*) OVER (PARTITION BY caso) AS n FROM (SELECT caso, destino_conta_id, sum(peso) AS p FROM {grafo_arestas} GROUP BY 1, 2)) WHERE pos <= ceil(0.1 * n) GROUP BY caso",
    ),
    # order, limit, set operations
    "o1_order_by": ("SELECT caso, fase, min(dias_desde_estopim) AS dia, count(*) AS n FROM {grafo_arestas} GROUP BY caso, fase ORDER BY caso, min(dias_desde_estopim), 4 DESC", None),
    "o2_limit": ("SELECT conta_id, count(*) AS n FROM {mencao} GROUP BY conta_id ORDER BY n DESC, conta_id LIMIT 20", None),
    "o4_drop_duplicates": ("SELECT conta_id, postagem_id FROM (SELECT conta_id, postagem_id, row_number() OVER (PARTITION BY conta_id ORDER BY postagem_id DESC) AS n FROM {mencao}) WHERE n = 1", "SELECT conta_id, max(postagem_id) AS postagem_id FROM {mencao} GROUP BY conta_id"),
    "u1_union_all": ("SELECT autor_conta_id AS conta_id, 'autor' AS como FROM {postagem} UNION ALL SELECT conta_id, 'mencao' FROM {mencao} UNION ALL SELECT origem_conta_id, 'origem' FROM {grafo_arestas}", None),
    "u2_union_distinct": ("SELECT origem_conta_id AS no FROM {grafo_arestas} UNION SELECT destino_conta_id FROM {grafo_arestas}", None),
    "u4_domain": ("SELECT DISTINCT idioma FROM {postagem} p WHERE idioma NOT IN ('pt', 'es', 'en')", None),
    # scalar functions
    "fn_json": (
        "SELECT arquivo_id, linha, get_json_object(payload, '$.legacy.id_str') AS id, get_json_object(payload, '$.legacy.entities.hashtags[0].text') AS primeira FROM {registro}",
        "SELECT arquivo_id, linha, payload ->> '$.legacy.id_str' AS id, payload ->> '$.legacy.entities.hashtags[0].text' AS primeira FROM {registro}",
    ),
    "fn_from_json": ("SELECT event_id, from_json(props, 'k BIGINT').k AS k FROM {events}", "SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS k FROM {events}"),
    "fn_higher_order": (
        "SELECT arquivo_id, linha, array_join(transform(mencoes, m -> coalesce(upper(m.handle), '?')), ',') AS quem, CAST(size(coalesce(hashtags, array())) AS BIGINT) AS n FROM {v_normalizado}",
        "SELECT arquivo_id, linha, array_to_string(list_transform(mencoes, lambda m: coalesce(upper(m.handle), '?')), ',') AS quem, len(coalesce(hashtags, [])) AS n FROM {v_normalizado}",
    ),
    "fn_string": ("SELECT postagem_id, lower(substring(id_nativo, 5)) AS fim, concat(caso_slug, '/', tipo_ref) AS junto, concat_ws('-', idioma, fonte) AS partes, replace(caso_slug, '_', ' ') AS nome FROM {postagem}", None),
    "fn_regex": (r"SELECT postagem_id, regexp_replace(texto, '[^\\p{L}\\p{N} ]+', '') AS letras FROM {postagem}", r"SELECT postagem_id, regexp_replace(texto, '[^\p{L}\p{N} ]+', '', 'g') AS letras FROM {postagem}"),
    "fn_hash": ("SELECT conta_id, sha2(handle, 256) AS h FROM {conta}", "SELECT conta_id, sha256(handle) AS h FROM {conta}"),
    "fn_date": (
        "SELECT postagem_id, CAST(created_at AS DATE) AS dia, datediff(CAST(carregada_em AS DATE), CAST(created_at AS DATE)) AS espera, date_sub(CAST(created_at AS DATE), 1) AS vespera, dayofweek(created_at) AS dia_semana FROM {postagem}",
        "SELECT postagem_id, CAST(created_at AS DATE) AS dia, CAST(date_diff('day', CAST(created_at AS DATE), CAST(carregada_em AS DATE)) AS INTEGER) AS espera, CAST(CAST(created_at AS DATE) - INTERVAL 1 DAY AS DATE) AS vespera, CAST(dayofweek(created_at) + 1 AS INTEGER) AS dia_semana FROM {postagem}",
    ),
    "fn_math": ("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS liquido, CAST(ceil(l_quantity / 7) AS BIGINT) AS caixas, power(l_tax, 2) AS quadrado, abs(l_discount - l_tax) AS diferenca, CAST(sign(l_discount - l_tax) AS INT) AS sinal FROM {lineitem}", None),
    "fn_null": ("SELECT dedup_id, coalesce(idioma, 'und') AS idioma, nullif(tipo_ref, '') AS tipo, least(likes, retweets) AS menor, greatest(likes, quotes) AS maior FROM {v_deduplicado}", None),
    "fn_cast": ("SELECT dedup_id, try_cast(id_nativo AS BIGINT) AS n, CAST(likes AS DOUBLE) AS d, CAST(capturas AS STRING) AS s, CAST(capturas > 1 AS INT) AS b FROM {v_deduplicado} WHERE id_nativo RLIKE '^[0-9]+\\\\z'", "SELECT dedup_id, try_cast(id_nativo AS BIGINT) AS n, CAST(likes AS DOUBLE) AS d, CAST(capturas AS VARCHAR) AS s, CAST(capturas > 1 AS INTEGER) AS b FROM {v_deduplicado} WHERE regexp_full_match(id_nativo, '[0-9]+')"),
}


def _tables(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def _braces(sql: str) -> str:
    """Only table names are placeholders; classes such as \\p{L} are not."""
    return re.sub(r"\{([LN])\}", r"{{\1}}", sql)


def _query(sql: str):
    names = [t for t in _tables(sql) if t not in ("L", "N")]
    return lambda spark, d: spark.sql(_braces(sql), **{t: T(spark, d, t) for t in names})


def f14_range_anti(spark, d):
    """Posts outside every collection period: the range is exploded to days, so the anti-join is an equi-join."""
    p = T(spark, d, "postagem").select("postagem_id", "caso_slug", F.to_date("created_at").alias("dia"))
    days = T(spark, d, "arquivo").where("periodo_inicio <= periodo_fim").select("caso_slug", F.explode(F.sequence("periodo_inicio", "periodo_fim")).alias("dia")).distinct()
    return p.join(days, ["caso_slug", "dia"], "left_anti")


def o3_sample(spark, d):
    return T(spark, d, "postagem").orderBy(F.rand(7)).limit(15)


def s12_catalogue(spark, d):
    """Columns and types of all tables in the folder, as the catalogue would list them; of nested types the outermost. Schemas alone are read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(d)
    found = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    names = sorted(n.removesuffix(".parquet") for n in found if n.endswith(".parquet"))
    rows = [(n, i, f.name, f.dataType.simpleString().partition("<")[0]) for n in names for i, f in enumerate(T(spark, d, n).schema.fields, 1)]
    return spark.createDataFrame(rows, "tabela string, posicao int, coluna string, tipo string")


def fn_assert(spark, d):
    """assert_true lets every row pass that keeps the rule; one that broke it would stop the query."""
    t = T(spark, d, "registro")
    return t.select("arquivo_id", "linha", F.assert_true(F.col("linha") > 0, F.lit("linha must be positive")).alias("_ok")).groupBy("arquivo_id").agg(F.count(F.lit(1)).alias("registros"), F.count("_ok").alias("avisos"))


def s13_parameters(spark, d):
    t = T(spark, d, "postagem")
    t.createOrReplaceTempView("_p_postagem")
    return spark.sql("SELECT postagem_id FROM _p_postagem WHERE caso_slug = :caso AND created_at >= :de", args={"caso": "farol_apagado", "de": "2023-10-25"})


QUERIES = {name: _query(a) for name, (a, _) in SQL.items()} | {f.__name__: f for f in (f14_range_anti, o3_sample, s12_catalogue, s13_parameters, fn_assert)}
_PLACE = re.compile(r"\{(?![LN]\})(\w+)\}")
ORACLE = {name: _PLACE.sub(r"\1", b or a) for name, (a, b) in SQL.items()} | {
    "f14_range_anti": "SELECT postagem_id, caso_slug, CAST(created_at AS DATE) AS dia FROM postagem p WHERE NOT EXISTS (SELECT 1 FROM arquivo a WHERE a.caso_slug = p.caso_slug AND CAST(p.created_at AS DATE) BETWEEN a.periodo_inicio AND a.periodo_fim)",
    "fn_assert": "SELECT arquivo_id, count(*) AS registros, 0::BIGINT AS avisos FROM registro GROUP BY 1",
    "s12_catalogue": """SELECT table_name AS tabela, CAST(ordinal_position AS INTEGER) AS posicao, column_name AS coluna, CASE WHEN data_type LIKE '%[]' THEN 'array' WHEN data_type LIKE 'STRUCT%' THEN 'struct' WHEN data_type = 'TIMESTAMP' THEN 'timestamp_ntz'
        WHEN data_type = 'VARCHAR' THEN 'string' WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type LIKE 'DECIMAL%' THEN lower(replace(data_type, ' ', '')) ELSE lower(data_type) END AS tipo
        FROM information_schema.columns WHERE table_schema = 'main' AND table_name NOT LIKE 'duckdb%' AND table_name NOT LIKE 'sqlite%' AND table_name NOT LIKE 'pragma%'""",
    "s13_parameters": "SELECT postagem_id FROM postagem WHERE caso_slug = 'farol_apagado' AND created_at >= TIMESTAMP '2023-10-25'",
}
