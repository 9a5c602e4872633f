"""Sizes of documents in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import importlib.util
import sys
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder and name of the vocabulary; both are parameters of every operator that counts tokens.
FOLDER, VOCABULARY = "/opt/tokenizers", "byte_bpe_50k.tiktoken"
_encoders: dict[tuple[str, str], object] = {}


def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """A function from a list of texts to their token counts; the file's ending chooses the library. One per process."""
    if (folder, vocabulary) in _encoders:
        return _encoders[folder, vocabulary]
    path = Path(folder, vocabulary)
    if path.suffix == ".tiktoken":
        import tiktoken

        spec = importlib.util.spec_from_file_location("_vocabularies", Path(folder, "__init__.py"))
        module = importlib.util.module_from_spec(spec)
        sys.modules.setdefault("_vocabularies", module)
        spec.loader.exec_module(module)
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, path.open("rb"))}
        enc = tiktoken.Encoding(path.stem, pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})
        count = lambda texts: [len(enc.encode_ordinary(t)) for t in texts]
    elif path.suffix == ".model":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
        count = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    else:
        from tokenizers import Tokenizer

        tk = Tokenizer.from_file(str(path))
        tk.encode_special_tokens = True
        count = lambda texts: [len(x.ids) for x in tk.encode_batch(texts, add_special_tokens=False)]
    _encoders[folder, vocabulary] = count
    return count


def count_tokens(df: DataFrame, key: str = "doc_id", text: str = "text", *keep: str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key``, the columns ``keep`` and tokens (int) of the whole text; null and empty texts have 0. One row per row of ``df``."""
    s = df.select(key, *keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(folder, vocabulary)
        for batch in batches:
            n = count([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int32())], names=[*batch.schema.names[:-1], "tokens"])

    types = dict(s.dtypes)
    return s.mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in (key, *keep)) + ", tokens int")
