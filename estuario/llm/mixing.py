"""Sources mixed to target shares of all tokens by hash-seeded Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

#: The table of targets is small by nature, and more rows than this are an error, never cut off.
MAX_SOURCES = 1000
#: By default the source that limits the mixture is taken at this part of its cap on average, so that its documents too are drawn.
FULL = 0.95
#: Rates tried at once while the realised tokens are brought to the target, and the rounds of it.
TRIED, ROUNDS = 24, 3


def source_name(c: Column) -> Column:
    """A loosely spelled source as compared: lower case, without blank ends, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"[\s\p{Z}-]+", "_")


def thresholds(rate: float, cap: int) -> list[float]:
    """P(N <= k) for k < cap of a Poisson N of mean ``rate``; an infinite rate takes every document ``cap`` times."""
    if math.isinf(rate):
        return [0.0] * cap
    p = total = math.exp(-rate)
    out = []
    for k in range(cap):
        out.append(total)
        p *= rate / (k + 1)
        total += p
    return out


def capped_mean(rate: float, cap: int) -> float:
    """E[min(N, cap)]."""
    return float(sum(1 - t for t in thresholds(rate, cap)))


def rate_for(mean: float, cap: int) -> float:
    """The rate at which E[min(N, cap)] is ``mean``."""
    if mean >= cap * (1 - 1e-9):
        return math.inf
    lo, hi = 0.0, 1.0
    while capped_mean(hi, cap) < mean:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if capped_mean(mid, cap) < mean else (lo, mid)
    return (lo + hi) / 2


def uniform(key: str, seed: int) -> Column:
    """A number in (0, 1) from the key alone, so the draw of a document never depends on partitions or retries."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key)), 11).cast("double") + 0.5) / F.lit(float(2**53))


def replicas(u: Column, steps: Column) -> Column:
    """The inverse of the Poisson distribution given by ``steps``."""
    return F.size(F.filter(steps, lambda t: t < u))


def _targets(df: DataFrame) -> list[tuple[str, float, int]]:
    """(source, weight, cap) per name as compared; of several targets for one name the weights are added and the least cap holds."""
    rows = df.select(source_name(F.col("source")), F.col("peso_alvo").cast("double"), F.col("max_repeticoes").cast("int")).where("peso_alvo > 0 AND max_repeticoes > 0 AND source IS NOT NULL").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    out: dict[str, tuple[str, float, int]] = {}
    for n, w, c in sorted(map(tuple, rows)):
        _, weight, cap = out.get(n, (n, 0.0, c))
        out[n] = (n, weight + w, min(cap, c))
    return sorted(out.values())


def rates(sizes: DataFrame, targets: DataFrame, *, key: str = "doc_id", total: int | None = None, seed: int = 17) -> list[tuple[str, float, int, float, int, int]]:
    """Per source with documents: (source, weight, cap, Poisson rate, tokens available, target tokens).

    ``sizes`` has key, source and tokens. ``total`` is the wanted size of the mixture, by default (and at most) the greatest at which no
    source needs more than FULL of its cap on average. Sources without documents can't be drawn: the others keep their
    weights among each other, and :func:`shares` reports the missing ones. The rate follows from the ratio of target to available tokens, then it is moved until the tokens
    realised by the documents' own draws meet the target; each round is one aggregate over all documents.
    """
    goal = _targets(targets)
    spark = sizes.sparkSession
    if not goal:
        return []
    s = sizes.select(key, "tokens", source_name(F.col("source")).alias("source")).where(F.col("source").isin([g[0] for g in goal]) & (F.col("tokens") > 0))
    have = {r[0]: r[1] for r in s.groupBy("source").agg(F.sum("tokens")).collect()}  # at most one row per target
    goal = [g for g in goal if have.get(g[0])]
    if not goal:
        return []
    most = min(have[n] * cap * FULL / w for n, w, cap in goal)
    size = min(total, most) if total else most
    want = {n: w * size for n, w, _ in goal}
    cap = {n: c for n, _, c in goal}
    rate = {n: rate_for(want[n] / have[n], cap[n]) for n in want}
    span = {n: (0.0, 3 * rate[n] + 1) for n in want if not math.isinf(rate[n])}
    u = uniform(key, seed)
    for _ in range(ROUNDS):
        tried = {n: [a + (b - a) * i / (TRIED - 1) for i in range(TRIED)] for n, (a, b) in span.items()}
        if not tried:
            break
        steps = spark.createDataFrame([(n, [thresholds(r, cap[n]) for r in rs]) for n, rs in tried.items()], "source string, _steps array<array<double>>")
        got = s.join(F.broadcast(steps), "source").groupBy("source").agg(*[F.sum(F.col("tokens") * replicas(u, F.col("_steps")[i])).alias(f"_{i}") for i in range(TRIED)]).collect()
        for row in got:
            n, sums = row[0], list(row)[1:]
            best = min(range(TRIED), key=lambda i: abs(sums[i] - want[n]))
            rate[n] = tried[n][best]
            over = next((i for i in range(TRIED) if sums[i] >= want[n]), TRIED - 1)
            span[n] = (tried[n][max(0, over - 1)], tried[n][over])
    return [(n, w, c, rate[n], have[n], round(want[n])) for n, w, c in goal]


def mix(docs: DataFrame, plan: list[tuple], *, key: str = "doc_id", seed: int = 17, keep: tuple[str, ...] = ("text",)) -> DataFrame:
    """The mixture, shuffled globally: ordem (its sort key), key, source, copia (0 ... cap - 1), and the columns ``keep``.

    Every document is repeated by its own Poisson draw; documents of other or unknown sources are not taken. Skewed sources need no
    care, as nothing is grouped; the one exchange sorts by a hash of document and copy.
    """
    steps = docs.sparkSession.createDataFrame([(n, thresholds(r, c)) for n, _, c, r, *_ in plan], "_source string, _steps array<double>")
    d = docs.select(key, source_name(F.col("source")).alias("_source"), *keep).join(F.broadcast(steps), "_source")
    n = replicas(uniform(key, seed), F.col("_steps"))
    d = d.withColumn("_n", n).where("_n > 0").withColumn("copia", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return d.select(F.xxhash64(F.lit(seed + 1), key, "copia").alias("ordem"), key, F.col("_source").alias("source"), "copia", *keep).orderBy("ordem", key, "copia")


def shares(sizes: DataFrame, targets: DataFrame, plan: list[tuple], *, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """Per target source: peso_alvo, max_repeticoes, documentos (with tokens) and tokens of the source, tokens in the mixture, peso_obtido, most copies
    of one document, tokens_alvo, tokens of the greatest document, and situacao: ok, or sem_documentos for a source that has none."""
    spark = sizes.sparkSession
    steps = spark.createDataFrame([(n, thresholds(r, c)) for n, _, c, r, *_ in plan], "source string, _steps array<double>")
    s = sizes.where("tokens > 0").select(key, "tokens", source_name(F.col("source")).alias("source")).join(F.broadcast(steps), "source").withColumn("_n", replicas(uniform(key, seed), F.col("_steps")))
    g = s.groupBy("source").agg(F.count(F.lit(1)).alias("documentos"), F.sum("tokens").alias("tokens_fonte"), F.sum(F.col("tokens") * F.col("_n")).alias("tokens"), F.max("_n").alias("mais_copias"), F.max("tokens").alias("maior_documento"))
    wanted = spark.createDataFrame(_targets(targets), "source string, peso_alvo double, max_repeticoes int")
    goal = spark.createDataFrame([(n, t) for n, _, _, _, _, t in plan], "source string, tokens_alvo bigint")
    g = wanted.join(g, "source", "left").join(F.broadcast(goal), "source", "left").withColumn("situacao", F.when(F.col("documentos").isNull(), "sem_documentos").otherwise("ok"))
    total = s.agg(F.sum(F.col("tokens") * F.col("_n"))).scalar()
    return g.withColumn("peso_obtido", F.round(F.coalesce(F.col("tokens"), F.lit(0)) / F.nullif(total, F.lit(0)), 6))


def sized(documents: DataFrame, **tokenizer) -> DataFrame:
    """doc_id, source, tokens of all documents, in the checkpoint folder, as the rates take several passes over them."""
    from .tokens import count_tokens

    return checkpoint(count_tokens(documents, "doc_id", "text", "source", **tokenizer))
