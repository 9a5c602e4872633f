"""Sources and sinks as queries: whole tables are written below the shared folder, read back by the library's readers, and compared in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dml, gold
from ..session import scratch
from ..session import table as T
from ..sources import bronze, sinks
from ..streaming import windows
from .layers import CAL, GOLD, SALT, layer


def _case_files(spark: SparkSession, d: str) -> str:
    """A folder with one small file per case."""
    path = scratch(spark, "casos")
    rows = T(spark, d, "arquivo").select("caso_slug").distinct().withColumn("value", F.concat(F.lit('{"caso":"'), "caso_slug", F.lit('"}')))
    rows.repartition("caso_slug").write.partitionBy("caso_slug").text(path)
    return path


def s2_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Size and SHA-256 of files, streamed by the executors."""
    return bronze.hashed(spark, _case_files(spark, d), "*.txt").select(F.regexp_extract("uri", "caso_slug=([^/]+)/", 1).alias("caso_slug"), "bytes", "sha256")


def s4_lines(spark: SparkSession, d: str) -> DataFrame:
    """All payloads as JSON lines, read and numbered again: how often each occurs; no line number is missing or twice."""
    path = scratch(spark, "linhas")
    T(spark, d, "registro").where("payload IS NOT NULL").select(F.col("payload").alias("value")).write.text(path)
    lines = bronze.read_lines(spark, path, "*.txt")
    whole = lines.groupBy("uri").agg(F.count(F.lit(1)).alias("n"), F.max("linha").alias("ultima"), F.countDistinct("linha").alias("distintas"))
    broken = whole.where("n <> ultima OR n <> distintas").agg(F.count(F.lit(1)).alias("b")).scalar()
    return lines.groupBy("payload").agg(F.count(F.lit(1)).alias("ocorrencias")).withColumn("numeracao_rompida", broken)


def s5_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label files written as JSON lines and read with their explicit schema: pairs and texts per case."""
    path = scratch(spark, "rotulos")
    T(spark, d, "postagem").select(F.col("id_nativo").alias("id"), F.col("caso_slug").alias("case"), F.col("texto").alias("text"), F.col("texto_limpo").alias("clean_text")).write.json(path)
    g = bronze.label_files(spark, path, "*.json").groupBy("case")
    return g.agg(F.count(F.lit(1)).alias("pares"), F.count("text").alias("com_texto"), F.sum(F.length("clean_text")).alias("caracteres"), F.count("stance").alias("com_stance"), (F.count(F.when(F.col("arquivo").endswith(".json"), 1)) == F.count(F.lit(1))).alias("com_arquivo"))


def s14_namespace(spark: SparkSession, d: str) -> DataFrame:
    """Tables chosen by explicit path: the same name in two places, without any session state."""
    path = scratch(spark, "espaco")
    T(spark, d, "conta").where("conta_id <= 40").write.parquet(f"{path}/conta.parquet")
    count = lambda folder, name: T(spark, folder, "conta").agg(F.lit(name).alias("espaco"), F.count(F.lit(1)).alias("contas"))
    return count(d, "dados").unionByName(count(path, "destaque"))


def _weights(spark: SparkSession, d: str) -> DataFrame:
    return T(spark, d, "grafo_arestas").groupBy("caso", "data").agg(F.sum("peso").alias("peso"))


def k3_append(spark: SparkSession, d: str) -> DataFrame:
    path, m = scratch(spark, "acrescenta"), _weights(spark, d)
    sinks.write_layer(m, path, replace=False)
    sinks.write_layer(m.withColumn("peso", -F.col("peso")), path, replace=False)
    return spark.read.parquet(path).select("caso", "data", "peso")


def k4_overwrite(spark: SparkSession, d: str) -> DataFrame:
    """A full refresh, then the replacement of one case: the partitions of the others stay."""
    path, m = scratch(spark, "sobrescreve"), _weights(spark, d)
    sinks.write_layer(m, path)
    sinks.write_layer(m.where("caso = 'farol_apagado'").withColumn("peso", F.col("peso") + 1), path)
    return spark.read.parquet(path).select("caso", "data", "peso")


def k2_register(spark: SparkSession, d: str) -> DataFrame:
    """Files registered by content: a second run over the same folder registers nothing."""
    path = _case_files(spark, d)
    files = bronze.hashed(spark, path, "*.txt").withColumn("arquivo_id", bronze.file_key(F.col("sha256")))
    again = dml.new_files(bronze.hashed(spark, path, "*.txt"), files.select("sha256"))
    return files.agg(F.count(F.lit(1)).alias("arquivos"), F.countDistinct("arquivo_id").alias("chaves"), F.min(F.col("arquivo_id") > 0).alias("positivas")).crossJoin(again.agg(F.count(F.lit(1)).alias("novos")))


def k15_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "csv")
    sinks.write_csv(layer(spark, d).cal, path, order=["caso", "data"])
    return spark.read.schema("caso string, data date, dias_desde_estopim int, fase string, volume_postagens bigint").option("header", True).csv(path)


def k17_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges and nodes written for graph tools and read back: rows, ends and weight per case."""
    path, g = scratch(spark, "grafo"), layer(spark, d)
    sinks.write_graph(gold.published_edges(g.edges, SALT), gold.published_nodes(g.roles, g.stanced, SALT), path)
    read = lambda name: spark.read.option("header", True).csv(f"{path}/{name}")
    e = read("arestas").groupBy("caso").agg(F.count(F.lit(1)).alias("arestas"), F.sum(F.col("Weight").cast("bigint")).alias("peso"), F.countDistinct("Source").alias("origens"))
    return e.join(read("nos").groupBy("caso").agg(F.countDistinct("Id").alias("nos")), "caso")


def k19_backup(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "copia")
    sinks.backup(spark, f"{d}/mencao.parquet", path)
    return spark.read.parquet(path)


def v3_folders(spark: SparkSession, d: str) -> DataFrame:
    """Folders compared by the bytes of their files: one with itself, and one with another of the same names and other contents."""
    a, b = _case_files(spark, d), scratch(spark, "outros")
    n = T(spark, d, "arquivo").select("caso_slug").distinct().count()
    spark.read.text(a).write.partitionBy("caso_slug").text(b)
    same, other = sinks.compare_folders(spark, a, a, "*.txt"), sinks.compare_folders(spark, a, b, "*.txt")
    count = lambda df, name: df.agg(F.lit(name).alias("com"), F.count(F.lit(1)).alias("diferentes"))
    # written by another job, the copies have names of their own: each side has n files that the other lacks
    return count(same, "si_mesma").unionByName(count(other.where(F.lit(n) > 0), "copia"))


def st_volumes(spark: SparkSession, d: str) -> DataFrame:
    """The stream over the event files, run until all that is there is read: events per day and kind."""
    schema = ", ".join(f"{n} {t}" for n, t in T(spark, d, "events").dtypes)
    path = scratch(spark, "fluxo")
    T(spark, d, "events").repartition(4, "event_id").write.parquet(f"{path}/eventos")
    s = windows.volumes(windows.arriving(spark, f"{path}/eventos", schema, files_per_batch=2), late="400 days")
    save = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/volumes")
    s.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/estado").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/volumes").select(F.to_date("inicio").alias("dia"), "event_type", "n")


QUERIES = {f.__name__: f for f in (s2_hashes, s4_lines, s5_labels, s14_namespace, k2_register, k3_append, k4_overwrite, k15_csv, k17_graph, k19_backup, v3_folders, st_volumes)}

_LINE = """'{"caso":"' || caso_slug || '"}' || chr(10)"""
_M = "m AS (SELECT caso, data, CAST(sum(peso) AS BIGINT) AS peso FROM grafo_arestas GROUP BY 1, 2)"
ORACLE = {
    "s2_hashes": f"SELECT DISTINCT caso_slug, CAST(strlen({_LINE}) AS BIGINT) AS bytes, sha256({_LINE}) AS sha256 FROM arquivo",
    "s4_lines": "SELECT trim(payload) AS payload, count(*) AS ocorrencias, 0::BIGINT AS numeracao_rompida FROM registro WHERE trim(payload) <> '' GROUP BY 1",
    "s5_labels": 'SELECT caso_slug AS "case", count(*) AS pares, count(texto) AS com_texto, CAST(sum(length(texto_limpo)) AS BIGINT) AS caracteres, 0::BIGINT AS com_stance, true AS com_arquivo FROM postagem GROUP BY 1',
    "s14_namespace": "SELECT 'dados' AS espaco, count(*) AS contas FROM conta UNION ALL SELECT 'destaque', count(*) FROM conta WHERE conta_id <= 40",
    "k2_register": "SELECT count(DISTINCT caso_slug) AS arquivos, count(DISTINCT caso_slug) AS chaves, true AS positivas, 0::BIGINT AS novos FROM arquivo",
    "k3_append": f"WITH {_M} SELECT * FROM m UNION ALL SELECT caso, data, -peso FROM m",
    "k4_overwrite": f"WITH {_M} SELECT caso, data, CASE WHEN caso = 'farol_apagado' THEN peso + 1 ELSE peso END AS peso FROM m",
    "k15_csv": f"WITH {CAL} SELECT * FROM cal",
    "k17_graph": GOLD + f""" SELECT caso, arestas, peso, origens, nos FROM (SELECT caso, count(*) AS arestas, CAST(sum(peso) AS BIGINT) AS peso, count(DISTINCT substr(sha256('{SALT}' || origem_conta_id), 1, 10)) AS origens FROM arestas GROUP BY 1)
       JOIN (SELECT caso, count(DISTINCT substr(sha256('{SALT}' || conta_id), 1, 10)) AS nos FROM papel GROUP BY 1) USING (caso)""",
    "k19_backup": "SELECT * FROM mencao",
    "v3_folders": "SELECT 'si_mesma' AS com, 0::BIGINT AS diferentes UNION ALL SELECT 'copia', 2 * count(DISTINCT caso_slug) FROM arquivo",
    "st_volumes": "SELECT CAST(ts AS DATE) AS dia, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
