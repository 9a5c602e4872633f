"""Documents put into containers of fixed capacity: harmonic classes with a fixed document count per container.

The method proper has one class per reciprocal floor(capacity / size) = k, and every container holds k documents of one class. Its waste is
known: a document over half of the container is alone. ``refined`` classes divide the large sizes further and let a container take a
fixed count of several classes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpoint

#: With refined classes, sizes above capacity / FINE are classed in steps of capacity / STEPS, smaller ones by their reciprocal class alone.
FINE, STEPS = 8, 128
#: Most container profiles: the table of capacities is small by nature, and more rows than this are an error, never cut off.
MAX_PROFILES = 1000


def size_class(size: Column, capacity: Column, refined: bool = False) -> Column:
    """The reciprocal class k = floor(capacity / size): k documents of the class fit into a container, whatever their sizes.

    ``refined`` divides the classes with k < FINE further, into -step; at most 2 * sqrt(capacity) classes of either kind are in use by small sizes.
    """
    k = F.floor(capacity / size).cast("int")
    return F.when(k >= FINE, k).otherwise(-F.ceil(size * F.lit(STEPS) / capacity).cast("int")) if refined else k


@dataclass
class Run:
    """Documents first..last-1 of a class, ``each`` to a container, from container ``base`` on."""

    first: int
    last: int
    each: int
    base: int


def harmonic(classes: list[tuple[int, int, int]]) -> tuple[dict[int, list[Run]], int]:
    """The method proper: class k fills its own containers with k documents each; from (class, greatest size, documents), and the containers used."""
    runs, used = {}, 0
    for k, _, n in sorted(classes):
        runs[k] = [Run(0, n, k, used)]
        used += -(-n // k)
    return runs, used


def plan(capacity: int, classes: list[tuple[int, int, int]]) -> tuple[dict[int, list[Run]], int]:
    """The fixed document count of every class per container, from (class, greatest size, documents) alone; and the containers used.

    Classes are taken from the greatest size on. Each goes into the open containers whose free space it leaves least of, as many
    per container as surely fit (every document counted with the greatest size of its class), else into new ones, floor(capacity /
    greatest size) each. Containers with equal free space are handled as one range, so the work depends on the classes, not on the documents.
    """
    runs: dict[int, list[Run]] = {}
    free: list[tuple[int, int, int]] = []  # free space, first and last container
    used = 0
    for c, top, n in sorted(classes, key=lambda x: (-x[1], x[0])):
        done = 0
        while done < n:
            fit = [g for g in free if g[0] >= top]
            if fit:
                # the least rest, and of those the least space
                g = min(fit, key=lambda g: (g[0] % top, g[0], g[1]))
                free.remove(g)
            else:
                g = (capacity, used, used + -(-(n - done) // (capacity // top)))
                used = g[2]
            each = g[0] // top
            take = min(g[2] - g[1], -(-(n - done) // each))
            last = min(n, done + take * each)
            runs.setdefault(c, []).append(Run(done, last, each, g[1]))
            full = (last - done) // each
            if g[0] - each * top:
                free.append((g[0] - each * top, g[1], g[1] + full))
            if full < take:  # the last container has fewer
                free.append((g[0] - (last - done - full * each) * top, g[1] + full, g[1] + take))
            if g[1] + take < g[2]:
                free.append((g[0], g[1] + take, g[2]))
            free = [x for x in free if x[1] < x[2] and x[0]]
            done = last
    return runs, used


def pieces(sizes: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id") -> DataFrame:
    """perfil, capacidade, key, pedaco, tokens: a document within the capacity is one piece, a larger one is cut at every full capacity."""
    profiles = F.array(*[F.struct(F.lit(p).alias("perfil"), F.lit(c).alias("capacidade")) for p, c in capacities])
    s = sizes.where(F.col("tokens") > 0).select(key, "tokens", F.explode(profiles).alias("_p")).select(F.col("_p.perfil").alias("perfil"), F.col("_p.capacidade").alias("capacidade"), key, "tokens")
    n = F.ceil(F.col("tokens") / F.col("capacidade")).cast("int")
    return s.withColumn("pedaco", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("tokens", F.least("capacidade", F.col("tokens") - F.col("pedaco") * F.col("capacidade")))


def pack(sizes: DataFrame, profiles: DataFrame, *, key: str = "doc_id", shards: int | None = None, refined: bool = False) -> DataFrame:
    """Each document's container per profile: perfil, capacidade, recipiente, key, pedaco, tokens.

    By default each container holds documents of one reciprocal class; with ``refined`` containers are shared by classes according to a plan
    made from the class counts (see :func:`plan`), which leaves far less unused.
    ``sizes`` has key and tokens, ``profiles`` perfil and capacidade_tokens (at most :data:`MAX_PROFILES` rows; null, repeated and
    non-positive ones are left out). A document is cut only if it exceeds the capacity, into full pieces and a rest. Documents
    without tokens (null or empty text) need no container and do not appear.

    A class may hold a third of all rows: documents are ranked within (class, shard), shards being hash buckets, and the shards'
    counts are summed up before them; only the counts by class (a few hundred numbers) reach the driver, which numbers the containers of each
    class. Containers are then filled independently of each other.
    """
    caps = sorted({(r[0], r[1]) for r in profiles.where(F.col("perfil").isNotNull() & (F.col("capacidade_tokens") > 0)).select("perfil", "capacidade_tokens").distinct().limit(MAX_PROFILES + 1).collect()})
    if len(caps) > MAX_PROFILES:
        raise ValueError(f"more than {MAX_PROFILES} capacities")
    spark = sizes.sparkSession
    if not caps:
        return spark.createDataFrame([], f"perfil string, capacidade int, recipiente bigint, {key} {dict(sizes.dtypes)[key]}, pedaco int, tokens int")
    shards = shards or max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    items = pieces(sizes, caps, key).withColumns({"classe": size_class(F.col("tokens"), F.col("capacidade"), refined), "_shard": F.pmod(F.xxhash64(key, "pedaco"), F.lit(shards)).cast("int")})
    groups = ["perfil", "capacidade", "classe"]
    counts = checkpoint(items.groupBy(*groups, "_shard").agg(F.count(F.lit(1)).alias("n"), F.max("tokens").alias("maior")))
    by: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for p, c, k, top, n in counts.groupBy(*groups).agg(F.max("maior"), F.sum("n")).collect():
        by.setdefault((p, c), []).append((k, top, n))
    rows = [(p, c, k, [(r.first, r.last, r.each, r.base) for r in runs]) for (p, c), classes in by.items() for k, runs in (plan(c, classes) if refined else harmonic(classes))[0].items()]
    plans = spark.createDataFrame(rows, "perfil string, capacidade int, classe int, _runs array<struct<first:bigint,last:bigint,each:bigint,base:bigint>>")
    before = counts.select(*groups, "_shard", (F.sum("n").over(W.partitionBy(*groups).orderBy("_shard")) - F.col("n")).alias("_antes"))
    ranked = items.withColumn("_i", F.row_number().over(W.partitionBy(*groups, "_shard").orderBy(key, "pedaco")))
    # bounded: one row per profile and class
    j = ranked.join(before, [*groups, "_shard"]).join(F.broadcast(plans), groups).withColumn("_r", F.col("_antes") + F.col("_i") - 1)
    r = F.filter("_runs", lambda x: (x["first"] <= F.col("_r")) & (F.col("_r") < x["last"]))[0]
    return j.withColumn("_run", r).select("perfil", "capacidade", (F.col("_run.base") + F.floor((F.col("_r") - F.col("_run.first")) / F.col("_run.each"))).cast("bigint").alias("recipiente"), key, "pedaco", "tokens")


def report(packed: DataFrame) -> DataFrame:
    """Per profile: recipientes, tokens, minimo (containers that any packing needs) and ocupacao (tokens over capacity, 6 digits)."""
    bins = packed.groupBy("perfil", "capacidade", "recipiente").agg(F.sum("tokens").alias("t"))
    g = bins.groupBy("perfil", "capacidade").agg(F.count(F.lit(1)).alias("recipientes"), F.sum("t").alias("tokens"), F.max("t").alias("maior"))
    return g.select("perfil", "capacidade", "recipientes", "tokens", "maior", F.ceil(F.col("tokens") / F.col("capacidade")).alias("minimo"), F.round(F.col("tokens") / (F.col("recipientes") * F.col("capacidade")), 6).alias("ocupacao"))


def audit(packed: DataFrame, sizes: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Per profile, from the containers as filled: documentos, cortados (documents in several pieces), cortados_sem_precisar (of those, the ones
    that fit whole), excedidos (containers over their capacity), tokens_perdidos (tokens of documents less those of their pieces)."""
    d = packed.groupBy("perfil", "capacidade", key).agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).join(sizes.select(key, F.col("tokens").alias("_s")), key, "left")
    needless = (F.col("n") > 1) & (F.col("_s") <= F.col("capacidade"))
    a = d.groupBy("perfil", "capacidade").agg(F.count(F.lit(1)).alias("documentos"), F.count_if(F.col("n") > 1).alias("cortados"), F.count_if(needless).alias("cortados_sem_precisar"), F.sum(F.col("_s") - F.col("t")).alias("tokens_perdidos"))
    bins = packed.groupBy("perfil", "capacidade", "recipiente").agg(F.sum("tokens").alias("t"))
    return a.join(bins.groupBy("perfil", "capacidade").agg(F.count_if(F.col("t") > F.col("capacidade")).alias("excedidos")), ["perfil", "capacidade"])
