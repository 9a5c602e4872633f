"""Raw files to bronze: inventory by content hash, two container formats, idempotent registration."""

from __future__ import annotations

import codecs
import hashlib
import json
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.dml import new_files

#: Characters of an address that stay as they are; readers leave letters of other scripts bare.
_PLAIN = "%/:?#[]@!$&'()*+,;=~"
FORMATS = ("json", "jsonl")


def file_key(sha256: Column) -> Column:
    """A positive bigint from the content hash: reruns give the same key, whatever the load order."""
    return F.conv(F.substring(sha256, 1, 15), 16, 10).cast("bigint")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        out = []
        for uri in batch.column(0).to_pylist():
            where, path = fs.FileSystem.from_uri(quote(uri, safe=_PLAIN))
            h = hashlib.sha256()
            with where.open_input_stream(path) as f:
                while block := f.read(1 << 20):
                    h.update(block)
            out.append(h.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["uri", "bytes", "sha256"])


def hashed(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """uri, bytes, sha256 of every file below ``folder`` whose name matches ``glob``, read in blocks of 1 MB by the executors.

    ``uri`` is the percent-encoded address that the readers give as well. A file is never held whole, whatever its size.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    return f.select(F.col("_metadata.file_path").alias("uri"), F.col("length").alias("bytes")).mapInArrow(_hashes, "uri string, bytes bigint, sha256 string")


def inventory(spark: SparkSession, folder: str, case: str, source: str) -> DataFrame:
    """One row per .json / .jsonl file below ``folder``: arquivo_id, caso_slug, fonte, uri, formato, sha256, bytes. Hashed by the executors.

    Fails if there is no such file, as an empty folder is a wrong path far more often than no data.
    """
    out = hashed(spark, folder, "*.{json,jsonl}").select(file_key(F.col("sha256")).alias("arquivo_id"), F.lit(case).alias("caso_slug"), F.lit(source).alias("fonte"), "uri", F.lower(F.element_at(F.split("uri", r"\."), -1)).alias("formato"), "sha256", "bytes")
    if out.isEmpty():
        raise FileNotFoundError(f"no .json or .jsonl file in {folder}")
    return out


class _Text:
    """A text stream as a JSON reader needs it: blanks skipped, one value decoded at a time; only the value at hand is held."""

    def __init__(self, stream, block: int = 1 << 20):
        self.stream, self.block, self.rest, self.at, self.end = stream, block, "", 0, False
        self.decoder, self.bytes = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")()

    def more(self) -> None:
        """Takes in the next block, or as much as is held where a long value needs more, so that it isn't tried too often."""
        got = self.stream.read(max(self.block, len(self.rest) - self.at))
        self.end = not got
        self.rest, self.at = self.rest[self.at :] + self.bytes.decode(got, self.end), 0

    def peek(self) -> str:
        """The next character that is no blank, empty at the end."""
        while True:
            while self.at < len(self.rest) and self.rest[self.at] in " \t\r\n":
                self.at += 1
            if self.at < len(self.rest) or self.end:
                return self.rest[self.at : self.at + 1]
            self.more()

    def take(self, wanted: str) -> None:
        if self.peek() != wanted:
            raise ValueError(f"{wanted} expected")
        self.at += 1

    def value(self) -> object:
        self.peek()
        while True:
            try:
                v, at = self.decoder.raw_decode(self.rest, self.at)
            except ValueError:
                if self.end:
                    raise
            else:
                if self.end or self.rest[at : at + 1] in tuple(" \t\r\n,:]}"):  # a number might go on in the next block
                    self.at = at
                    return v
            self.more()


def _members(text: _Text, close: str) -> Iterator[None]:
    """Steps through the members of an object or array up to ``close``."""
    if text.peek() == close:
        text.take(close)
        return
    while True:
        yield
        if text.peek() == close:
            text.take(close)
            return
        text.take(",")


def _container(stream) -> Iterator[tuple[str, object]]:
    """("metadata", object) and ("tweet", record) of one container, in the order of the file."""
    text = _Text(stream)
    text.take("{")
    for _ in _members(text, "}"):
        key = text.value()
        text.take(":")
        if key == "tweets" and text.peek() == "[":
            text.take("[")
            for _ in _members(text, "]"):
                yield "tweet", text.value()
        else:
            v = text.value()
            if key == "metadata" and isinstance(v, dict):
                yield "metadata", v


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 1 else pa.string()) for i, c in enumerate(cols)], names=["uri", "linha", "payload", "consulta", "desde", "ate"])

    for b in batches:
        for uri in b.column(0).to_pylist():
            where, path = fs.FileSystem.from_uri(quote(uri, safe=_PLAIN))
            meta, rows, n = None, [], 0
            text = lambda k: meta[k] if isinstance(meta.get(k), str) else None  # noqa: E731, B023
            try:
                with where.open_input_stream(path) as f:
                    for kind, v in _container(f):
                        if kind == "metadata":
                            meta = v
                            continue
                        if meta is None:  # it may stand behind the records
                            with where.open_input_stream(path) as g:
                                meta = next((x for k, x in _container(g) if k == "metadata"), {})
                        n += 1
                        rows.append((uri, n, json.dumps(v, ensure_ascii=False, separators=(",", ":")), text("query"), text("since"), text("until")))
                        if len(rows) == 1000:
                            yield batch(rows)
                            rows = []
            except (ValueError, RecursionError) as e:
                if n:
                    raise ValueError(f"{uri} breaks off after record {n}: {e}") from e
            yield batch(rows)


def read_container(spark: SparkSession, folder: str) -> DataFrame:
    """Whole-file JSON with ``metadata`` and ``tweets``: uri, linha (1-based), payload (compact), consulta, periodo_inicio, periodo_fim.

    The query text ends before " since:"; blank becomes null. An empty list, and a file that is no container, give no rows; a file that breaks
    off behind its first record is an error, as part of it must not pass for the whole. Files are read as streams, record by record, so
    their size is not bound by the memory of a task.
    """
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").load(folder)
    t = f.select(F.col("_metadata.file_path").alias("uri")).mapInArrow(_records, "uri string, linha int, payload string, consulta string, desde string, ate string")
    query = F.nullif(F.trim(F.element_at(F.split("consulta", " since:"), 1)), F.lit(""))
    return t.select("uri", "linha", "payload", query.alias("consulta"), F.col("desde").try_cast("date").alias("periodo_inicio"), F.col("ate").try_cast("date").alias("periodo_fim"))


def read_lines(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """JSON lines: uri, linha (1-based place among the non-blank lines of the file), payload (stripped).

    Lines are numbered within each file split and offset by the counts of the splits before it, so one huge file is read and
    numbered by many tasks.
    """
    t = spark.read.text(folder, pathGlobFilter=glob, recursiveFileLookup=True)
    t = t.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("o"), F.trim(F.regexp_replace("value", r"^[\s\x{FEFF}]+|\s+$", "")).alias("payload")).where("payload <> ''")
    n = t.groupBy("uri", "b").agg(F.count(F.lit(1)).alias("n"))
    before = n.select("uri", "b", (F.sum("n").over(W.partitionBy("uri").orderBy("b")) - F.col("n")).alias("antes"))
    t = t.withColumn("i", F.row_number().over(W.partitionBy("uri", "b").orderBy("o")))
    return t.join(before, ["uri", "b"]).select("uri", (F.col("antes") + F.col("i")).cast("int").alias("linha"), "payload")


def all_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of both containers: uri, linha, payload, and what the container says of its query."""
    return read_container(spark, folder).unionByName(read_lines(spark, folder), allowMissingColumns=True)


def without_records(spark: SparkSession, folder: str) -> DataFrame:
    """uri, bytes, sha256 of the files that hold no record, for being empty or no container: nothing is left out without a trace."""
    return hashed(spark, folder, "*.{json,jsonl}").join(all_records(spark, folder).select("uri"), "uri", "left_anti")


def label_files(spark: SparkSession, folder: str, glob: str = "*.jsonl", *, multiline: bool = False) -> DataFrame:
    """Label files (one JSON object a line, or with ``multiline`` one document a file): id, case, text, clean_text, stance as strings, and arquivo, the file's name."""
    t = spark.read.schema("id string, case string, text string, clean_text string, stance string").json(folder, pathGlobFilter=glob, multiLine=multiline, recursiveFileLookup=True)
    return t.select("*", F.col("_metadata.file_name").alias("arquivo"))


def ingest(spark: SparkSession, folder: str, case: str, source: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(arquivo, registro) of the files whose content ``known`` (with sha256) lacks; a rerun gives two empty frames.

    Both come from one pass each and share keys derived from the hash, so there is no half-registered file to compensate for.
    """
    files = new_files(inventory(spark, folder, case, source), known.select("sha256"))
    records = all_records(spark, folder)
    per_file = records.groupBy("uri").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("consulta", "periodo_inicio", "periodo_fim")])
    files = files.join(per_file, "uri")  # a file without records is not registered, see without_records
    return files, records.join(files.select("uri", "arquivo_id"), "uri").select("arquivo_id", "linha", "payload")
