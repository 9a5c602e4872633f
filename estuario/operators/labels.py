"""Versioned labels: what is pending, batched scoring by a pluggable scorer, quality of a scorer, distribution."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_blank, ratio

#: Texts to (label, confidence) pairs.
Scorer = Callable[[list[str]], list[tuple[str, float]]]
# Words of the stand-in scorer.
LEXICON = {"acusador": ("negou", "denunciou", "culpou", "mentiu", "atacou", "criticou"), "defensor": ("defendeu", "apoiou", "elogiou", "salvou", "perdoou", "explicou")}


def lexicon_scorer(texts: list[str]) -> list[tuple[str, float]]:
    """A deterministic stand-in for a model: the stance with more of its words, neutro on a tie; confidence is its share."""
    out = []
    for t in texts:
        words = t.lower().split()
        n = {k: sum(w.strip(".,!?") in v for w in words) for k, v in LEXICON.items()}
        total = sum(n.values())
        best = max(n, key=lambda k: n[k])
        out.append((best, n[best] / total) if total and n[best] * 2 > total else ("neutro", 1.0 if not total else 0.5))
    return out


def pending(posts: DataFrame, labels: DataFrame, model: str, version: str) -> DataFrame:
    """Posts with text that have no label of this model and version; a rerun finds none, and labels are never overwritten."""
    done = labels.where((F.col("modelo") == model) & (F.col("versao") == version)).select("postagem_id")
    return posts.where(~is_blank(F.col("texto_limpo"))).select("postagem_id", "texto_limpo").join(done, "postagem_id", "left_anti")


def score(pending: DataFrame, scorer: Scorer, model: str, version: str) -> DataFrame:
    """postagem_id, modelo, versao, rotulo, confianca. Runs on the executors in Arrow batches; an empty input gives an empty frame with this schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = scorer(b.column(1).to_pylist())
            n = len(got)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model] * n, pa.string()), pa.array([version] * n, pa.string()), pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], names=["postagem_id", "modelo", "versao", "rotulo", "confianca"])

    return pending.select("postagem_id", "texto_limpo").mapInArrow(run, "postagem_id bigint, modelo string, versao string, rotulo string, confianca double")


def metrics(pairs: DataFrame) -> DataFrame:
    """Per class of (verdade, previsto): support, precision, recall, F1, and the accuracy over all; a ratio over nothing counts as 0."""
    n = pairs.groupBy("verdade", "previsto").agg(F.count(F.lit(1)).alias("n"))
    hit = F.col("verdade") == F.col("previsto")
    ends = n.select(F.explode(F.array(F.struct(F.col("verdade").alias("classe"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p"), F.when(hit, F.col("n")).otherwise(0).alias("h")), F.struct(F.col("previsto").alias("classe"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p"), F.lit(0).cast("bigint").alias("h")))).alias("x"))
    g = ends.groupBy("x.classe").agg(F.sum("x.t").alias("suporte"), F.sum("x.p").alias("previstos"), F.sum("x.h").alias("acertos"))
    all_ = W.partitionBy()  # a handful of classes
    z = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return g.select("classe", "suporte", z(F.col("acertos"), F.col("previstos")).alias("precisao"), z(F.col("acertos"), F.col("suporte")).alias("revocacao"), z(2 * F.col("acertos"), F.col("suporte") + F.col("previstos")).alias("f1"), ratio(F.sum("acertos").over(all_), F.sum("suporte").over(all_)).alias("acuracia"))


def distribution(labelled: DataFrame) -> DataFrame:
    """caso, stance, n, parcela of the case and, where labels carry a confianca, its mean."""
    mean = [F.round(F.avg("confianca"), 6).alias("confianca_media")] if "confianca" in labelled.columns else []
    g = labelled.groupBy("caso", "stance").agg(F.count(F.lit(1)).alias("n"), *mean)
    return g.withColumn("parcela", ratio(F.col("n"), F.sum("n").over(W.partitionBy("caso"))))
