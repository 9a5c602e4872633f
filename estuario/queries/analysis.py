"""The analytical questions as queries, and the same in SQL. The edge table is read without the rows delivered twice."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, lru_cache

from pyspark.sql import DataFrame

from ..operators import analytics as an
from ..operators import gold
from ..session import keep
from .layers import ARESTAS, ATIV, PAPEL, REDE, REFS, layer


class Inputs:
    def __init__(self, spark, d):
        self.layer, self.narr = layer(spark, d), an.narrative_roles(spark)

    # each fact is written once at the layer's edge, when the first question asks for it
    cal = cached_property(lambda self: keep(self.layer.cal, "cal"))
    roles = cached_property(lambda self: keep(self.layer.roles, "papel"))
    act = cached_property(lambda self: keep(gold.activity(self.layer.stanced, self.layer.norm, self.cal), "atividade"))
    ref = cached_property(lambda self: keep(gold.references(self.layer.stanced, self.layer.cases, self.cal), "referencia"))
    net = cached_property(lambda self: keep(self.layer.network, "rede"))
    ar = cached_property(lambda self: keep(self.layer.edges_given, "arestas"))

    def prepare(self, names: list[str]) -> None:
        """Writes the facts that a question needs and that are not there yet, side by side, as none of them fills the cluster."""
        if {"act", "ref"} & set(names):
            self.cal  # noqa: B018
        todo = [n for n in names if n in ("cal", "roles", "act", "ref", "net", "ar") and n not in self.__dict__]
        with ThreadPoolExecutor(max(1, len(todo))) as pool:
            list(pool.map(lambda n: getattr(self, n), todo))

    leaders = cached_property(lambda self: keep(an.p10_leaders(self.ar, self.roles), "lideres"))
    matrix = cached_property(lambda self: keep(an.p8_matrix(self.ar), "matriz"))
    newman = cached_property(lambda self: keep(an.p8_newman(self.matrix), "newman"))
    poles = cached_property(lambda self: keep(an.p10_pole_phase(self.ar, self.leaders), "polos"))
    answers = cached_property(lambda self: keep(an.p9_phase(self.ref, self.net, self.cal), "respostas"))
    def _series(self) -> DataFrame:
        self.prepare(["cal", "roles", "act", "ref", "net", "ar"])
        return an.p11_series(self.net, self.cal, self.ar, self.narr, self.ref, self.act, self.leaders)

    series = cached_property(lambda self: keep(self._series(), "series"))


@lru_cache(8)
def inputs(spark, d) -> Inputs:
    return Inputs(spark, d)


_ARGS = {
    "ana_p1_dia": (an.p1_day, "cal"),
    "ana_p1_resumo": (an.p1_summary, "cal"),
    "ana_p2_variacao": (an.p2_change, "cal"),
    "ana_p2_resumo": (an.p2_summary, "cal"),
    "ana_p3_resumo": (an.p3_summary, "roles"),
    "ana_p3_novas": (an.p3_new_accounts, "roles cal"),
    "ana_p4_parcela": (an.p4_share, "ar"),
    "ana_p4_resumo": (an.p4_role_summary, "ar narr cal"),
    "ana_p4_dia": (an.p4_day, "ar narr"),
    "ana_p4_fase": (an.p4_phase, "ar narr"),
    "ana_p4_defasagem": (an.p4_lag, "ar narr net act"),
    "ana_p4_sobreposicao": (an.p4_overlap, "ar narr"),
    "ana_p5_serie": (an.p5_series, "net cal"),
    "ana_p5_resumo": (an.p5_summary, "ar"),
    "ana_p6_resumo": (an.p6_summary, "net cal"),
    "ana_p7_dia": (an.p7_day, "act"),
    "ana_p7_fase": (an.p7_phase, "act"),
    "ana_p8_mix": (an.p8_mix, "ar"),
    "ana_p8_matriz": (lambda m: m, "matrix"),
    "ana_p8_newman": (an.p8_newman, "matrix"),
    "ana_p8_autores": (an.p8_to_authors, "ar"),
    "ana_p9_dia": (an.p9_day, "ref net"),
    "ana_p9_fase": (an.p9_phase, "ref net cal"),
    "ana_p10_mencionadas": (an.p10_most_mentioned, "ar roles narr"),
    "ana_p10_lideres": (an.p10_leaders, "ar roles"),
    "ana_p10_polo_dia": (an.p10_pole_day, "ar leaders"),
    "ana_p10_polo_fase": (an.p10_pole_phase, "ar leaders"),
    "ana_p10_tensao": (an.p10_tension, "ar leaders"),
    "ana_p11_series": (lambda s: s, "series"),
    "ana_p11_estaticas": (an.p11_static, "net roles series newman poles answers"),
    "ana_p11_direcao": (an.p11_direction, "series cal"),
    "ana_p11_sinal": (lambda s, c: an.p11_same_sign(an.p11_direction(s, c)), "series cal"),
    "g7_papeis_narrativos": (lambda n: n, "narr"),
}


def _query(name):
    f, args = _ARGS[name]

    def query(spark, d):
        x = inputs(spark, d)
        x.prepare(args.split())
        return f(*[getattr(x, a) for a in args.split()])

    return query


QUERIES = {name: _query(name) for name in _ARGS}

_N = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_NARR = ", ".join(
    f"('{c}', CAST({d[0]} AS BIGINT), {_N(d[1])}, CAST({_N(d[2])} AS VARCHAR), CAST({_N(d[3])} AS INTEGER))" for c, *_ in gold.CASES for d in an.DECLARED if d[0] not in {a for k, _, a in gold.CASES if k == c}
)
_r = lambda a, b: f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 6)"
_s = lambda x: f"CAST(sum({x}) AS BIGINT)"
_mix = ", ".join(f"""{_r(f"sum(CASE WHEN stance_origem = '{s}' THEN peso ELSE 0 END)", "sum(peso)")} AS de_{s}""" for s in an.STANCES)
BASE = f"""WITH {ATIV}, {PAPEL}, {REFS}, {REDE}, {ARESTAS},
 narr AS (SELECT * FROM (VALUES {_NARR}) t(caso, conta_id, papel_inicial, papel_final, dia_virada)),
 grafo AS (SELECT DISTINCT * FROM grafo_arestas),
 gp AS (SELECT g.*, CASE WHEN papel_destino = 'alvo' THEN 'alvo' WHEN n.conta_id IS NULL THEN 'demais' WHEN g.dias_desde_estopim >= n.dia_virada THEN n.papel_final ELSE n.papel_inicial END AS papel,
    CASE WHEN n.conta_id IS NULL THEN 'demais' WHEN g.dias_desde_estopim >= n.dia_virada THEN n.papel_final ELSE n.papel_inicial END AS declarado
   FROM grafo g LEFT JOIN narr n ON n.caso = g.caso AND n.conta_id = g.destino_conta_id),
 pdia AS (SELECT caso, data, dias_desde_estopim, fase, papel, {_s("peso")} AS mencoes, count(DISTINCT destino_conta_id) AS contas, {_mix} FROM gp GROUP BY ALL),
 pd2 AS (SELECT *, CAST(sum(mencoes) OVER (PARTITION BY caso, data) AS BIGINT) AS mencoes_dia, {_r("mencoes", "sum(mencoes) OVER (PARTITION BY caso, data)")} AS parcela_dia FROM pdia),
 ma AS (SELECT caso, conta_id, stance_modal, mencoes_emitidas FROM (SELECT caso, origem_conta_id AS conta_id, stance_origem AS stance_modal, CAST(sum(p) OVER (PARTITION BY caso, origem_conta_id) AS BIGINT) AS mencoes_emitidas,
    row_number() OVER (PARTITION BY caso, origem_conta_id ORDER BY p DESC, stance_origem) AS i FROM (SELECT caso, origem_conta_id, stance_origem, sum(peso) AS p FROM grafo GROUP BY ALL)) WHERE i = 1),
 gj AS (SELECT *, CASE WHEN dias_desde_estopim >= 0 THEN 'desde_estopim' ELSE 'pre_crise' END AS janela FROM grafo),
 mz AS (SELECT gj.caso, janela, stance_origem, stance_modal AS stance_destino, {_s("peso")} AS mencoes, count(*) AS arestas FROM gj JOIN ma ON ma.caso = gj.caso AND ma.conta_id = destino_conta_id GROUP BY ALL),
 em AS (SELECT caso, origem_conta_id AS conta_id, {_s("CASE WHEN stance_origem = 'acusador' THEN peso ELSE 0 END")} AS mencoes_acusadoras, {_s("peso")} AS mencoes_emitidas, count(DISTINCT data) AS dias_ativos FROM grafo GROUP BY 1, 2),
 le AS (SELECT em.*, n_postagens_caso, n_mencoes_recebidas_caso, CAST(row_number() OVER (PARTITION BY caso ORDER BY mencoes_acusadoras DESC, em.mencoes_emitidas DESC, conta_id) AS INTEGER) AS posicao,
    CAST(rank() OVER (PARTITION BY caso ORDER BY n_mencoes_recebidas_caso DESC) AS INTEGER) AS posicao_recebidas FROM em JOIN papel USING (caso, conta_id) WHERE papel_principal <> 'alvo'),
 lid AS (SELECT *, {_r("mencoes_acusadoras", "mencoes_emitidas")} AS parcela_acusadora FROM le WHERE posicao <= 10 AND mencoes_acusadoras > 0),
 po AS (SELECT g.*, l.conta_id IS NOT NULL AS l, papel_destino = 'alvo' AS t FROM grafo g LEFT JOIN lid l ON l.caso = g.caso AND l.conta_id = g.destino_conta_id),
 se AS (SELECT r.caso, r.data, c.dias_desde_estopim, c.fase, n_nos, round(isolamento_alvo, 6) AS parcela_alvo, parcela_instituicao, replies_alvo, parcela_defensora, likes_defesa, mira_lideres, mencoes_lideres, n_nos < 30 AS nd
   FROM rede r JOIN cal c USING (caso, data)
   LEFT JOIN (SELECT caso, data, {_r("sum(CASE WHEN declarado = 'instituicao_legitimadora' THEN peso ELSE 0 END)", "sum(peso)")} AS parcela_instituicao FROM gp GROUP BY 1, 2) i USING (caso, data)
   LEFT JOIN (SELECT caso, data, {_r("sum(CASE WHEN destinatario = 'alvo' THEN n_postagens ELSE 0 END)", "sum(n_postagens)")} AS replies_alvo FROM refs GROUP BY 1, 2) f USING (caso, data)
   LEFT JOIN (SELECT caso, data, {_r("sum(CASE WHEN stance = 'defensor' THEN n_postagens ELSE 0 END)", "sum(n_postagens)")} AS parcela_defensora, {_r("sum(CASE WHEN stance = 'defensor' THEN likes ELSE 0 END)", "sum(likes)")} AS likes_defesa FROM ativ GROUP BY 1, 2) d USING (caso, data)
   LEFT JOIN (SELECT g.caso, g.data, CASE WHEN sum(peso) >= 10 THEN {_r("sum(CASE WHEN papel_destino = 'alvo' THEN peso ELSE 0 END)", "sum(peso)")} END AS mira_lideres, {_s("peso")} AS mencoes_lideres
     FROM grafo g JOIN lid l ON l.caso = g.caso AND l.conta_id = g.origem_conta_id GROUP BY 1, 2) m USING (caso, data)),
 longo AS (SELECT caso, fase, p, assinatura, v FROM (SELECT caso, fase, dias_desde_estopim = pd AS p, {", ".join(an.SERIES)} FROM se JOIN (SELECT caso, pd FROM pico) USING (caso) WHERE NOT nd) UNPIVOT INCLUDE NULLS (v FOR assinatura IN ({", ".join(an.SERIES)}))),
 di AS (SELECT assinatura, caso, round(avg(v) FILTER (fase = 'pre_crise'), 5) AS pre_crise, round(avg(v) FILTER (p), 5) AS pico, round(avg(v) FILTER (fase = 'declinio'), 5) AS declinio FROM longo GROUP BY 1, 2),
 dv AS (SELECT *, round((declinio - pico) * 100, 3) AS variacao_pp FROM di)
"""
_fases = lambda src, keys, cols: f"SELECT caso, fase, {keys}{cols} FROM {src} GROUP BY ALL UNION ALL SELECT caso, 'todas', {keys}{cols} FROM {src} GROUP BY ALL"
_n = lambda s, c: f"sum(CASE WHEN stance = '{s}' THEN {c} ELSE 0 END)"
_p7 = ", ".join(
    [f"{_s('n_postagens')} AS postagens", f"{_r(_n('defensor', 'n_postagens'), _n('acusador', 'n_postagens'))} AS razao_defesa_acusacao", f"{_r(_n('defensor', 'likes'), 'sum(likes)')} AS parcela_likes_defensor"]
    + [f"{_r(_n(s, 'n_postagens'), 'sum(n_postagens)')} AS parcela_{s}, {_r(_n(s, 'likes'), _n(s, 'n_postagens'))} AS likes_por_post_{s}" for s in an.STANCES]
)
_top5 = lambda cond: _r(f"sum(CASE WHEN {cond} THEN m ELSE 0 END)", "sum(m)")
_newman = lambda cls, a: f"""(SELECT x.caso, x.janela, x.n AS n{a}, round(x.t / x.n, 6) AS observada{a}, round(y.ab / (CAST(x.n AS DOUBLE) * x.n), 6) AS esperada{a},
   round((x.t / x.n - y.ab / (CAST(x.n AS DOUBLE) * x.n)) / nullif(1 - y.ab / (CAST(x.n AS DOUBLE) * x.n), 0), 6) AS r{a}
  FROM (SELECT caso, janela, {_s("mencoes")} AS n, CAST(sum(CASE WHEN stance_origem = stance_destino THEN mencoes ELSE 0 END) AS DOUBLE) AS t FROM mz WHERE stance_origem IN {cls} AND stance_destino IN {cls} GROUP BY 1, 2) x
  JOIN (SELECT caso, janela, sum(o * d) AS ab FROM (SELECT caso, janela, s, CAST(sum(o) AS DOUBLE) AS o, CAST(sum(d) AS DOUBLE) AS d FROM (
     SELECT caso, janela, stance_origem AS s, mencoes AS o, 0 AS d FROM mz WHERE stance_origem IN {cls} AND stance_destino IN {cls} UNION ALL
     SELECT caso, janela, stance_destino, 0, mencoes FROM mz WHERE stance_origem IN {cls} AND stance_destino IN {cls}) GROUP BY 1, 2, 3) GROUP BY 1, 2) y USING (caso, janela))"""  # noqa: E731
_P6 = {"volume": "volume_postagens", "mencoes_alvo": "mencoes_alvo", "isolamento": "isolamento_alvo", "centralizacao": "centralizacao_grau_entrada", "hhi": "hhi_mencoes_recebidas", "gini": "gini_mencoes_recebidas"}
_P6PK = ", ".join(f"max(CASE WHEN k_{n} = 1 THEN dias_desde_estopim END) AS pico_{n}" for n in _P6)
_P6RN = ", ".join(f"row_number() OVER (PARTITION BY caso, janela ORDER BY {c} DESC, dias_desde_estopim) AS k_{n}" for n, c in _P6.items())
_P9_FASE = f"""SELECT *, {_r("replies_alvo", "postagens")} AS parcela_alvo, {_r("replies_terceiros", "postagens")} AS parcela_terceiros, {_r("replies_alvo", "replies_terceiros")} AS razao_alvo_terceiros
       FROM (SELECT caso, fase, {_s("n_postagens")} AS postagens, {_s("CASE WHEN destinatario = 'alvo' THEN n_postagens ELSE 0 END")} AS replies_alvo, {_s("CASE WHEN destinatario = 'terceiros' THEN n_postagens ELSE 0 END")} AS replies_terceiros FROM refs GROUP BY 1, 2)
       JOIN (SELECT caso, fase, round(avg(isolamento_alvo), 6) AS isolamento_medio, round(min(isolamento_alvo), 6) AS isolamento_min, round(max(isolamento_alvo), 6) AS isolamento_max, count(*) AS dias_fase FROM rede JOIN cal USING (caso, data) GROUP BY 1, 2) USING (caso, fase)"""
SELECTS = {
    "ana_p1_dia": f"SELECT cal.*, {_r('volume_postagens', 'max(CASE WHEN dias_desde_estopim >= 0 THEN volume_postagens END) OVER (PARTITION BY caso)')} AS fracao_do_pico, isodow(data) >= 6 AS fim_de_semana FROM cal",
    "ana_p1_resumo": """SELECT caso, min(data) AS inicio_coleta, max(data) AS fim_coleta, count(*) AS dias_coletados, count(*) FILTER (fase = 'pre_crise') AS dias_pre_crise, round(avg(volume_postagens) FILTER (fase = 'pre_crise'), 6) AS media_pre_crise,
       min(volume_postagens) FILTER (fase = 'estopim') AS volume_estopim, min(data) FILTER (fase = 'pico') AS data_pico, min(volume_postagens) FILTER (fase = 'pico') AS volume_pico, min(data) FILTER (fase = 'pos_rito') AS primeiro_pos_rito,
       count(*) FILTER (fase = 'pos_rito') AS dias_pos_rito, max(dias_desde_estopim) AS ultimo_dia FROM cal GROUP BY 1""",
    "ana_p2_variacao": f"""SELECT caso, data, dias_desde_estopim, volume_postagens, CASE WHEN n > 2 THEN {_r("volume_postagens - b", "b")} END AS variacao, round(round(CAST(volume_postagens - b AS DOUBLE) / pk, 9) * 100, 6) AS pontos_do_pico
       FROM (SELECT *, lag(volume_postagens) OVER w AS b, row_number() OVER w AS n, pv AS pk FROM cal LEFT JOIN pico USING (caso) WINDOW w AS (PARTITION BY caso ORDER BY data))""",
    "ana_p2_resumo": f"""SELECT caso, min(data) FILTER (dias_desde_estopim = dp) AS data_pico, max(dp) AS dias_estopim_ate_pico, max(vp) AS volume_pico, {_r("max(vp)", "max(volume_postagens) FILTER (fase = 'estopim')")} AS razao_pico_estopim,
       CASE WHEN count(*) FILTER (fase = 'pre_crise') >= 3 THEN {_r("max(vp)", "avg(volume_postagens) FILTER (fase = 'pre_crise')")} END AS razao_pico_media_pre, {_r("max(volume_postagens) FILTER (dias_desde_estopim = dp + 1)", "max(vp)")} AS fracao_dia_apos_pico,
       min(dias_desde_estopim - dp) FILTER (dias_desde_estopim > dp AND volume_postagens < 0.5 * vp) AS dias_pico_ate_metade, min(dias_desde_estopim - dp) FILTER (dias_desde_estopim > dp AND volume_postagens < 0.25 * vp) AS dias_pico_ate_quarto
       FROM cal JOIN (SELECT caso, pd AS dp, pv AS vp FROM pico) USING (caso) GROUP BY 1""",
    "ana_p3_resumo": f"""SELECT caso, count(*) AS contas_no_caso, count(*) FILTER (n_postagens_caso > 0) AS contas_autoras, count(*) FILTER (n_postagens_caso = 0) AS contas_so_mencionadas, count(*) FILTER (papel_principal = 'alvo') AS alvos,
       {_s("n_postagens_caso")} AS total_postagens, {_r("sum(n_postagens_caso)", "count(*) FILTER (n_postagens_caso > 0)")} AS postagens_por_autora, count(*) FILTER (n_postagens_caso = 1) AS autoras_com_1_postagem,
       {_r("count(*) FILTER (n_postagens_caso = 1)", "count(*) FILTER (n_postagens_caso > 0)")} AS parcela_autoras_1_postagem, max(n_postagens_caso) AS max_postagens_uma_conta,
       {_r("sum(CASE WHEN pos <= ceil(0.01 * na) THEN n_postagens_caso ELSE 0 END)", "sum(n_postagens_caso)")} AS parcela_top1pct_autoras, {_r("sum(CASE WHEN pos <= ceil(0.10 * na) THEN n_postagens_caso ELSE 0 END)", "sum(n_postagens_caso)")} AS parcela_top10pct_autoras
       FROM (SELECT *, row_number() OVER (PARTITION BY caso ORDER BY n_postagens_caso DESC, conta_id) AS pos, count(*) FILTER (n_postagens_caso > 0) OVER (PARTITION BY caso) AS na FROM papel) GROUP BY 1""",
    "ana_p3_novas": "SELECT caso, data, coalesce(n, 0) AS contas_novas, CAST(coalesce(sum(n) OVER (PARTITION BY caso ORDER BY data), 0) AS BIGINT) AS acumulado FROM cal LEFT JOIN (SELECT caso, primeiro_dia AS data, count(*) AS n FROM papel GROUP BY 1, 2) USING (caso, data)",
    "ana_p4_parcela": f"SELECT *, {_r('mencoes', 'sum(mencoes) OVER (PARTITION BY caso, data)')} AS parcela FROM (SELECT caso, data, papel_destino, {_s('peso')} AS mencoes, count(DISTINCT destino_conta_id) AS contas FROM grafo GROUP BY ALL)",
    "ana_p4_resumo": f"""SELECT t.caso, t.papel, contas, t.mencoes, {_r("t.mencoes", "sum(t.mencoes) OVER (PARTITION BY t.caso)")} AS parcela, {_r("t.mencoes", "max(CASE WHEN t.papel = 'alvo' THEN t.mencoes END) OVER (PARTITION BY t.caso)")} AS razao_vs_alvo, b.dia AS dia_pico_papel, b.dia - pico.pd AS defasagem
       FROM (SELECT caso, papel, count(DISTINCT destino_conta_id) AS contas, {_s("peso")} AS mencoes FROM gp GROUP BY 1, 2) t
       LEFT JOIN (SELECT caso, papel, dias_desde_estopim AS dia FROM (SELECT *, row_number() OVER (PARTITION BY caso, papel ORDER BY m DESC, dias_desde_estopim) AS n FROM (SELECT caso, papel, dias_desde_estopim, sum(peso) AS m FROM gp WHERE dias_desde_estopim IS NOT NULL GROUP BY ALL)) WHERE n = 1) b
       ON b.caso = t.caso AND b.papel = t.papel LEFT JOIN pico ON pico.caso = t.caso""",
    "ana_p4_dia": "SELECT * FROM pd2",
    "ana_p4_fase": f""", pp AS (SELECT caso, data, fase, papel, peso, stance_origem, destino_conta_id FROM gp), pc AS (SELECT caso, data, fase, papel, count(DISTINCT destino_conta_id) AS c FROM gp GROUP BY ALL),
       u AS ({_fases("pp", "papel, ", f"{_s('peso')} AS mencoes, {_mix}")}), v AS ({_fases("pc", "papel, ", "max(c) AS contas")})
       SELECT u.caso, u.fase, u.papel, u.mencoes, v.contas, de_acusador, de_defensor, de_neutro, {_r("u.mencoes", "sum(u.mencoes) OVER (PARTITION BY u.caso, u.fase)")} AS parcela FROM u JOIN v ON u.caso = v.caso AND u.papel = v.papel AND u.fase IS NOT DISTINCT FROM v.fase""",
    "ana_p4_defasagem": f""", k AS (SELECT caso, papel, dias_desde_estopim AS dia_pico, mencoes, parcela_dia, de_acusador FROM (SELECT pd2.*, row_number() OVER (PARTITION BY caso, papel ORDER BY mencoes DESC, dias_desde_estopim) AS n
         FROM pd2 SEMI JOIN (SELECT caso, data FROM rede WHERE n_nos >= 30) USING (caso, data) WHERE dias_desde_estopim IS NOT NULL) WHERE n = 1),
       ac AS (SELECT caso, dias_desde_estopim AS dia, {_r("sum(CASE WHEN stance = 'acusador' THEN n_postagens ELSE 0 END)", "sum(n_postagens)")} AS a FROM ativ WHERE dias_desde_estopim IS NOT NULL GROUP BY 1, 2)
       SELECT k.*, dia_pico - max(CASE WHEN papel = 'alvo' THEN dia_pico END) OVER (PARTITION BY k.caso) AS defasagem_vs_alvo, x.a AS acusacao_no_dia, y.a AS acusacao_dia_seguinte
       FROM k LEFT JOIN ac x ON x.caso = k.caso AND x.dia = dia_pico LEFT JOIN ac y ON y.caso = k.caso AND y.dia = dia_pico + 1""",
    "ana_p4_sobreposicao": f""", a AS (SELECT DISTINCT caso, papel, origem_conta_id AS o FROM gp WHERE stance_origem = 'acusador'), t AS (SELECT caso, o FROM a WHERE papel = 'alvo'), n AS (SELECT caso, count(*) AS acusadores_do_alvo FROM t GROUP BY 1),
       x AS (SELECT a.caso, papel, count(*) AS acusadores_do_papel, {_s("CAST((a.caso, a.o) IN (SELECT (caso, o) FROM t) AS INTEGER)")} AS tambem_acusam_alvo FROM a WHERE papel <> 'alvo' GROUP BY 1, 2)
       SELECT x.*, acusadores_do_alvo, {_r("tambem_acusam_alvo", "acusadores_do_papel")} AS parcela, {_r("tambem_acusam_alvo", "(acusadores_do_papel + acusadores_do_alvo - tambem_acusam_alvo)")} AS jaccard FROM x JOIN n USING (caso)""",
    "ana_p5_serie": "SELECT caso, data, dias_desde_estopim, fase, gini_mencoes_recebidas, hhi_mencoes_recebidas, centralizacao_grau_entrada, isolamento_alvo, n_nos >= 30 AS dia_valido FROM rede JOIN cal USING (caso, data)",
    "ana_p5_resumo": f""", u AS ({_fases("grafo", "destino_conta_id, papel_destino, ", f"{_s('peso')} AS m")}),
       r AS (SELECT *, row_number() OVER (PARTITION BY caso, fase ORDER BY m DESC, destino_conta_id) AS pos, count(*) OVER (PARTITION BY caso, fase) AS n FROM u)
       SELECT caso, fase, count(*) AS contas_mencionadas, {_s("m")} AS mencoes, {_top5("papel_destino = 'alvo'")} AS parcela_alvo, {_top5("pos = 1")} AS parcela_top1_conta, {_top5("pos <= ceil(0.01 * n)")} AS parcela_top1pct, {_top5("pos <= ceil(0.05 * n)")} AS parcela_top5pct,
       {_top5("pos <= ceil(0.10 * n)")} AS parcela_top10pct, {_r("count(*) FILTER (m = 1)", "count(*)")} AS parcela_contas_com_1_mencao FROM r GROUP BY 1, 2""",
    "ana_p6_resumo": f""", v AS (SELECT rede.*, dias_desde_estopim, volume_postagens, round(n_mencoes * isolamento_alvo, 3) AS mencoes_alvo FROM rede JOIN cal USING (caso, data) WHERE n_nos >= 30),
       s AS (SELECT 'todos' AS janela, * FROM v UNION ALL SELECT 'desde_estopim', * FROM v WHERE dias_desde_estopim >= 0), t AS (SELECT *, {_P6RN} FROM s),
       g AS (SELECT caso, janela, {_P6PK}, round(corr(volume_postagens, centralizacao_grau_entrada), 6) AS corr_volume_centralizacao, round(corr(volume_postagens, isolamento_alvo), 6) AS corr_volume_isolamento, count(*) AS dias FROM t GROUP BY 1, 2)
       SELECT *, pico_centralizacao - pico_volume AS defasagem_centralizacao, pico_isolamento - pico_volume AS defasagem_isolamento, pico_mencoes_alvo - pico_volume AS defasagem_mencoes_alvo FROM g""",
    "ana_p7_dia": f"SELECT *, {_r('postagens', 'sum(postagens) OVER (PARTITION BY caso, data)')} AS parcela FROM (SELECT caso, data, stance, {_s('n_postagens')} AS postagens FROM ativ GROUP BY ALL)",
    "ana_p7_fase": _fases("ativ", "", _p7),
    "ana_p8_mix": f"SELECT caso, fase, CASE WHEN papel_destino = 'alvo' THEN 'alvo' ELSE 'demais' END AS destino, {_s('peso')} AS mencoes_destino, {_mix} FROM grafo GROUP BY ALL",
    "ana_p8_matriz": f"SELECT *, {_r('mencoes', 'sum(mencoes) OVER (PARTITION BY caso, janela)')} AS e_ij FROM mz",
    "ana_p8_newman": f"SELECT * FROM {_newman(an.STANCES, '')} LEFT JOIN {_newman(an.STANCES[:2], '_sem_neutro')} USING (caso, janela)",
    "ana_p8_autores": f"""SELECT caso, janela, mencoes, mencoes_destino_autor, mencoes_ao_alvo, {_r("mencoes_destino_autor", "mencoes")} AS parcela_destino_autor FROM (SELECT gj.caso, janela, {_s("peso")} AS mencoes, {_s("CASE WHEN o IS NOT NULL THEN peso ELSE 0 END")} AS mencoes_destino_autor,
       {_s("CASE WHEN papel_destino = 'alvo' THEN peso ELSE 0 END")} AS mencoes_ao_alvo FROM gj LEFT JOIN (SELECT DISTINCT caso, origem_conta_id AS o FROM grafo) a ON a.caso = gj.caso AND a.o = destino_conta_id GROUP BY 1, 2)""",
    "ana_p9_dia": f"""SELECT caso, data, replies_alvo, postagens_dia, {_r("replies_alvo", "postagens_dia")} AS parcela_replies_alvo, isolamento_alvo, n_nos, n_nos < 30 AS nd
       FROM (SELECT caso, data, {_s("CASE WHEN destinatario = 'alvo' THEN n_postagens ELSE 0 END")} AS replies_alvo, {_s("n_postagens")} AS postagens_dia FROM refs GROUP BY 1, 2) JOIN rede USING (caso, data)""",
    "ana_p9_fase": _P9_FASE,
    "ana_p10_mencionadas": """SELECT caso, CAST(posicao AS INTEGER) AS posicao, conta_id, n_mencoes_recebidas_caso, n_postagens_caso, stance_modal, mencoes_emitidas, papel_inicial, papel_final, dia_virada, coalesce(stance_modal = 'acusador', false) AS lider_regra, coalesce(papel_inicial LIKE 'lider%', false) AS lider_narrativa
       FROM (SELECT *, row_number() OVER (PARTITION BY caso ORDER BY n_mencoes_recebidas_caso DESC, conta_id) AS posicao FROM papel WHERE papel_principal <> 'alvo') LEFT JOIN ma USING (caso, conta_id) LEFT JOIN narr USING (caso, conta_id) WHERE posicao <= 10""",
    "ana_p10_lideres": "SELECT * FROM lid",
    "ana_p10_polo_dia": f"""SELECT caso, data, dias_desde_estopim, fase, {_s("peso")} AS mencoes, {_r("sum(CASE WHEN t THEN peso ELSE 0 END)", "sum(peso)")} AS parcela_alvo, {_r("sum(CASE WHEN l THEN peso ELSE 0 END)", "sum(peso)")} AS parcela_lideres,
       {_r("max(CASE WHEN l THEN peso ELSE 0 END)", "sum(peso)")} AS maior_aresta_lider FROM po GROUP BY ALL""",
    "ana_p10_polo_fase": f"""SELECT caso, fase, {_s("peso")} AS mencoes, {_r("sum(CASE WHEN t THEN peso ELSE 0 END)", "sum(peso)")} AS parcela_alvo, {_r("sum(CASE WHEN l THEN peso ELSE 0 END)", "sum(peso)")} AS parcela_lideres,
       {_r("sum(CASE WHEN l THEN peso ELSE 0 END)", "sum(CASE WHEN t THEN peso ELSE 0 END)")} AS razao_lideres_alvo FROM po GROUP BY ALL""",
    "ana_p10_tensao": f""", e AS (SELECT g.caso, 'L' || posicao AS rotulo, g.fase, {_s("peso")} AS emitidas, count(DISTINCT g.data) AS dias_ativos, {_r("sum(peso)", "count(DISTINCT g.data)")} AS por_dia, count(DISTINCT destino_conta_id) AS destinos,
         {_r("sum(CASE WHEN papel_destino = 'alvo' THEN peso ELSE 0 END)", "sum(peso)")} AS parcela_ao_alvo, {_r("sum(CASE WHEN stance_origem = 'acusador' THEN peso ELSE 0 END)", "sum(peso)")} AS parcela_acusadora FROM lid JOIN grafo g ON g.caso = lid.caso AND g.origem_conta_id = lid.conta_id GROUP BY 1, 2, 3),
       r AS (SELECT g.caso, 'L' || posicao AS rotulo, g.fase, {_s("peso")} AS recebidas FROM lid JOIN grafo g ON g.caso = lid.caso AND g.destino_conta_id = lid.conta_id GROUP BY 1, 2, 3)
       SELECT coalesce(e.caso, r.caso) AS caso, coalesce(e.rotulo, r.rotulo) AS rotulo, coalesce(e.fase, r.fase) AS fase, coalesce(emitidas, 0) AS emitidas, dias_ativos, por_dia, destinos, parcela_ao_alvo, parcela_acusadora, coalesce(recebidas, 0) AS recebidas
       FROM e FULL JOIN r ON e.caso = r.caso AND e.rotulo = r.rotulo AND e.fase IS NOT DISTINCT FROM r.fase""",
    "ana_p11_series": "SELECT * FROM se",
    "ana_p11_estaticas": f"""SELECT caso, gini_mediano, autoras_1_post, instituicao_max, alvo_medio, newman_sem_neutro, lideres_max, razao_replies_min, razao_replies_max FROM (SELECT caso, quantile_disc(gini_mencoes_recebidas, 0.5) AS gini_mediano FROM rede WHERE n_nos >= 30 GROUP BY 1)
       JOIN (SELECT caso, {_r("count(*) FILTER (n_postagens_caso = 1)", "count(*)")} AS autoras_1_post FROM papel WHERE n_postagens_caso > 0 GROUP BY 1) USING (caso)
       JOIN (SELECT caso, max(parcela_instituicao) AS instituicao_max, round(avg(parcela_alvo) FILTER (dias_desde_estopim >= 0), 5) AS alvo_medio FROM se WHERE NOT nd GROUP BY 1) USING (caso)
       LEFT JOIN (SELECT caso, r_sem_neutro AS newman_sem_neutro FROM {_newman(an.STANCES[:2], "_sem_neutro")} WHERE janela = 'desde_estopim') USING (caso)
       LEFT JOIN (SELECT caso, max(p) AS lideres_max FROM (SELECT caso, fase, {_r("sum(CASE WHEN l THEN peso ELSE 0 END)", "sum(peso)")} AS p FROM po GROUP BY 1, 2) GROUP BY 1) USING (caso)
       LEFT JOIN (SELECT caso, min(razao_alvo_terceiros) AS razao_replies_min, max(razao_alvo_terceiros) AS razao_replies_max FROM ({_P9_FASE}) WHERE fase <> 'pre_crise' AND postagens >= 30 GROUP BY 1) USING (caso)""",
    "ana_p11_direcao": "SELECT * FROM dv",
    "ana_p11_sinal": "SELECT assinatura, "
    + ", ".join(f"max(variacao_pp) FILTER (caso = '{c}') AS {c}" for c, *_ in gold.CASES)
    + ", count(DISTINCT sign(variacao_pp)) = 1 AS mesmo_sinal FROM dv GROUP BY 1",
    "g7_papeis_narrativos": "SELECT * FROM narr",
}
ORACLE = {k: BASE + v for k, v in SELECTS.items()}
