"""Declared integrity rules and their validators; storage enforces none of them.

Row rules are SQL conditions that must not be false (null passes, as in a CHECK); uniqueness and references are queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    name: str
    condition: str


# The vocabularies and formats of the model.
CHECKS: dict[str, tuple[Check, ...]] = {
    "arquivo": (
        Check("bytes_positivos", "bytes > 0"),
        Check("sha256_formato", "sha256 RLIKE '^[0-9a-f]{64}$'"),
        Check("formato_dominio", "formato IN ('json', 'jsonl')"),
        Check("periodo_ordenado", "periodo_fim >= periodo_inicio"),
    ),
    "registro": (Check("linha_positiva", "linha >= 1"), Check("payload_objeto", "payload LIKE '{%'")),
    "postagem": (
        Check("idioma_formato", "idioma RLIKE '^[a-z]{2}$'"),
        Check("tipo_ref_dominio", "tipo_ref IN ('original', 'reply', 'quote')"),
        Check("situacao_dominio", "situacao IN ('ativa', 'deletada', 'suspensa')"),
        Check("reply_com_destino", "tipo_ref <> 'reply' OR ref_conta_id IS NOT NULL"),
        Check("original_sem_referencia", "tipo_ref <> 'original' OR (ref_id_nativo IS NULL AND ref_conta_id IS NULL)"),
    ),
    "v_deduplicado": (
        Check("contadores_nao_negativos", "least(likes, retweets, quotes, respostas) >= 0"),
        Check("stance_dominio", "stance_previa IN ('acusador', 'defensor', 'neutro')"),
    ),
    "postagem_hashtag": (Check("hashtag_minuscula", "hashtag = lower(hashtag) AND trim(hashtag) <> ''"),),
    "classificacao": (Check("confianca_intervalo", "confianca BETWEEN 0 AND 1"), Check("rotulo_dominio", "rotulo IN ('acusador', 'defensor', 'neutro')")),
    "papel_narrativo": (Check("virada_completa", "(papel_final IS NULL) = (dia_virada IS NULL)"),),
    "qc_resultado": (Check("severidade_dominio", "severidade IN ('bloqueia', 'alerta', 'informa')"),),
    "captura": (Check("engajamento_derivado", "engajamento = likes + retweets + quotes + respostas"),),
    "lapide": (Check("lapide_datada", "situacao = 'ativa' OR removida_em IS NOT NULL"),),
    "contribuinte": (Check("consentimento_datado", "NOT consentiu OR consentiu_em IS NOT NULL"),),
    "auditoria": (Check("acao_dominio", "acao IN ('inserir', 'alterar', 'apagar', 'consultar', 'publicar')"),),
    "pais": (Check("pais_formato", "pais RLIKE '^[A-Z]{2}$'"),),
    "vinculo": (Check("vinculo_com_criterio", "ator_id IS NULL OR criterio IS NOT NULL"),),
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """tabela, regra, violacoes: all row rules of a table in one pass."""
    checks = CHECKS[table]
    one = df.agg(*[F.count_if(~F.coalesce(F.expr(c.condition), F.lit(True))).alias(c.name) for c in checks])
    return one.select(F.explode(F.array(*[F.struct(F.lit(table).alias("tabela"), F.lit(c.name).alias("regra"), F.col(c.name).alias("violacoes")) for c in checks])).alias("x")).select("x.*")


def not_unique(df: DataFrame, keys: list[str], *, nulls_equal: bool = True) -> DataFrame:
    """Keys that occur more than once. With ``nulls_equal`` null is a value; else keys with a null are not compared (a partial unique rule)."""
    d = df if nulls_equal else df.dropna(subset=keys)
    return d.groupBy(*keys).agg(F.count(F.lit(1)).alias("ocorrencias")).where("ocorrencias > 1")


def require_valid(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself, or an error that names the broken rules."""
    bad = [f"{r.regra} ({r.violacoes})" for r in violations(df, table).where("violacoes > 0").collect()]
    if bad:
        raise ValueError(f"{table}: {', '.join(bad)}")
    return df
