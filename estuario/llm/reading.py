"""Reading level of each document from the levels of its sentences."""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
#: At most this many labelled documents are fitted on, chosen by a hash of their id; and at most this many characters of them in all. Both are parameters of training_sample.
MAX_TRAINING, MAX_TRAINING_CHARS = 2000, 8_000_000
#: Buckets of the hashed features of each model, and character n-gram lengths.
BUCKETS, GRAMS = 1 << 17, (3, 4, 5)
#: Words whose scores a process keeps.
KNOWN_WORDS = 400_000

_NOISE = re.compile(r"<[^<>]{0,200}>|https?://\S+|www\.\S+|[@#]\w+|&\w{1,8};")
_PARTS = re.compile(r"[^\W\d_]+|[.!?;…\n]")
_STOP = frozenset(".!?;…\n")


def sentences(text: str) -> list[list[str]]:
    """Lower-case words by sentence, without markup, links and handles; sentences end at stops and line ends, however long they are."""
    out: list[list[str]] = [[]]
    for w in _PARTS.findall(_NOISE.sub(" ", text).lower()):
        if w not in _STOP:
            out[-1].append(w)
        elif out[-1]:
            out.append([])
    return out if out[-1] else out[:-1]


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS


def gram_buckets(word: str) -> list[int]:
    w = f"<{word}>".encode("utf-8", "surrogatepass")
    return [zlib.crc32(w[i : i + n], n) % BUCKETS for n in GRAMS for i in range(len(w) - n + 1)] or [zlib.crc32(w) % BUCKETS]


@dataclass
class Model:
    """Weights of the word and the character model (bucket x level), their biases, and the calibration of document levels."""

    word: np.ndarray
    gram: np.ndarray
    word_bias: np.ndarray
    gram_bias: np.ndarray
    calibration: np.ndarray  # threshold x (intercept, slopes)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class _Corpus:
    """Training sentences as flat arrays over a vocabulary: word of each token, sentence of each token, n-grams of each word."""

    def __init__(self, docs: list[tuple[list[list[str]], float]]):
        ids: dict[str, int] = {}
        tok, lengths, doc = [], [], []
        for d, (sents, _) in enumerate(docs):
            for s in sents:
                tok += [ids.setdefault(w, len(ids)) for w in s]
                lengths.append(len(s))
                doc.append(d)
        grams = [gram_buckets(w) for w in ids]
        self.tok, self.length, self.doc = np.array(tok), np.array(lengths), np.array(doc)
        self.word = np.array([word_bucket(w) for w in ids])
        self.gram, self.grams = np.array([g for x in grams for g in x]), np.array([len(x) for x in grams])
        self.y = np.array([y for _, y in docs])


def _fit_sentences(c: _Corpus, chosen: np.ndarray, by_gram: bool, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression with a ridge penalty, by adaptive full gradient steps, on the sentences ``chosen``.

    The features of a sentence are its words, or the character n-grams of its words, over the root of their number. Scores are formed
    per word of the vocabulary first, so a step costs one pass over the tokens for either model.
    """
    keep = np.repeat(chosen, c.length)
    tok, length, y = c.tok[keep], c.length[chosen], c.y[c.doc[chosen]]
    starts, owner = np.concatenate([[0], np.cumsum(length)[:-1]]), np.repeat(np.arange(len(length)), length)
    size = np.add.reduceat(c.grams[tok], starts) if by_gram else length
    share, weight = 1 / np.sqrt(size)[:, None], (length / 15)[:, None]
    lo = np.clip(np.floor(y), 1, LEVELS).astype(int)
    target = np.zeros((len(y), LEVELS))
    target[np.arange(len(y)), lo - 1] = 1 - (y - lo)
    target[np.arange(len(y)), np.minimum(lo, LEVELS - 1)] += y - lo
    cells = c.gram if by_gram else c.word
    cell_word = np.repeat(np.arange(len(c.grams)), c.grams if by_gram else 1)
    first = np.concatenate([[0], np.cumsum(c.grams)[:-1]])
    W, b = np.zeros((BUCKETS, LEVELS)), np.zeros(LEVELS)
    G, gb = np.full_like(W, 1e-8), np.full_like(b, 1e-8)
    for _ in range(steps):
        words = np.add.reduceat(W[cells], first) if by_gram else W[cells]
        z = np.add.reduceat(words[tok], starts) * share + b
        err = (_softmax(z) - target) * weight
        pull = err * share
        per_word = np.stack([np.bincount(tok, pull[owner, k], len(c.grams)) for k in range(LEVELS)], 1)
        g = np.stack([np.bincount(cells, per_word[cell_word, k], BUCKETS) for k in range(LEVELS)], 1) + ridge * W
        G += g * g
        W -= 0.3 * g / np.sqrt(G)
        e = err.sum(0)
        gb += e * e
        b -= 0.3 * e / np.sqrt(gb)
    return W, b


def _logistic(X: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the intercept is the first column and hardly penalised."""
    w = np.zeros(X.shape[1])
    pen = np.full(X.shape[1], ridge)
    pen[0] = 1e-3
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        H = (X * (p * (1 - p))[:, None]).T @ X + np.diag(pen)
        w -= np.linalg.solve(H, X.T @ (p - y) + pen * w)
    return w


def document_features(p: np.ndarray) -> np.ndarray:
    """(1, mean level, its square, log odds of the upper levels) of mean sentence distributions (document x level)."""
    mean = p @ np.arange(1, LEVELS + 1) - 3
    up = np.log((p[:, 3:].sum(1) + 0.02) / (p[:, :3].sum(1) + 0.02))
    return np.stack([np.ones(len(p)), mean, mean**2, up], 1)


class Scorer:
    """Scores documents with a model; keeps the scores of the words it has met."""

    def __init__(self, model: Model):
        self.m, self.ids, self.rows, self.table = model, {}, [], np.zeros((0, 2 * LEVELS))

    def _row(self, word: str) -> int:
        i = self.ids[word] = len(self.rows)
        g = gram_buckets(word)
        self.rows.append(np.concatenate([self.m.word[word_bucket(word)], self.m.gram[g].sum(0), [len(g)]]))
        return i

    def distributions(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(mean sentence distribution, number of sentences) of each text; no word gives the uniform one and 0 sentences."""
        if len(self.ids) > KNOWN_WORDS:
            self.ids, self.rows = {}, []
        words: list[int] = []
        lengths: list[int] = []
        count = np.zeros(len(texts), np.int64)
        get, row = self.ids.get, self._row
        for d, text in enumerate(texts):
            if text:
                for s in sentences(text):
                    words += [i if (i := get(w)) is not None else row(w) for w in s]
                    lengths.append(len(s))
                    count[d] += 1
        out = np.full((len(texts), LEVELS), 1 / LEVELS)
        if not lengths:
            return out, count
        table = np.array(self.rows)
        n = np.array(lengths)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        z = np.add.reduceat(table[np.array(words)], starts, axis=0)
        pw = _softmax(z[:, :LEVELS] / np.sqrt(n)[:, None] + self.m.word_bias)
        pg = _softmax(z[:, LEVELS : 2 * LEVELS] / np.sqrt(z[:, -1:]) + self.m.gram_bias)
        p = (pw + pg) / 2 * n[:, None]
        has = count > 0
        first = np.concatenate([[0], np.cumsum(count)[:-1]])[has]
        out[has] = np.add.reduceat(p, first, axis=0) / np.add.reduceat(n, first)[:, None]
        return out, count

    def difficulty(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(difficulty between 1 and 5, P(level >= 4)), from the calibrated thresholds."""
        q = 1 / (1 + np.exp(-np.clip(document_features(p) @ self.m.calibration.T, -30, 30)))
        return 1 + q.sum(1), q[:, 2]


def fit(texts: list[str], levels: list[float], *, ridge: float = 0.5, folds: int = 2, steps: int = 40) -> Model:
    """The model from labelled documents. Sentences take their document's label; the calibration is fitted on sentence
    distributions of documents that the sentence models had not seen (``folds`` parts)."""
    docs = [(sentences(t), y) for t, y in zip(texts, levels)]
    docs = [(s, y) for s, y in docs if s]
    empty = np.zeros((LEVELS - 1, 4))
    if not docs:
        flat = np.zeros((BUCKETS, LEVELS))
        return Model(flat, flat, np.zeros(LEVELS), np.zeros(LEVELS), empty)
    c = _Corpus(docs)

    def model(chosen: np.ndarray) -> Model:
        (ww, wb), (gw, gb) = (_fit_sentences(c, chosen, by_gram, ridge, steps) for by_gram in (False, True))
        return Model(ww, gw, wb, gb, empty)

    part = np.empty(len(docs), int)
    part[np.argsort(c.y, kind="stable")] = np.arange(len(docs)) % folds  # every part has all levels
    held, ys = [], []
    for k in range(folds if len(docs) >= folds else 0):
        s = Scorer(model(part[c.doc] != k))
        mine = np.flatnonzero(part == k)
        held.append(s.distributions([". ".join(" ".join(x) for x in docs[i][0]) for i in mine])[0])
        ys.append(c.y[mine])
    full = model(np.ones(len(c.doc), bool))
    if held:
        X, y = document_features(np.concatenate(held)), np.concatenate(ys)
        # a document whose labels average to t - 0.5 counts half
        full.calibration = np.stack([_logistic(X, np.clip(y - t + 1, 0, 1)) for t in range(2, LEVELS + 1)])
    return full


def training_sample(documents: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING, max_chars: int | None = None) -> tuple[list[str], list[float]]:
    """Texts and mean levels of at most ``limit`` labelled documents, chosen by a hash of the id; null and impossible levels are left out.

    The chosen texts together have at most ``max_chars`` characters (default MAX_TRAINING_CHARS): in the order of the hash, one that no longer fits is left
    out and the next ones are tried. Only ids and lengths reach the driver first, so the bound holds for the texts it gets.
    ValueError if there are documents but no text to fit on is left.
    """
    left = MAX_TRAINING_CHARS if max_chars is None else max_chars
    y = labels.where(F.col("nivel").between(1, LEVELS)).groupBy("doc_id").agg(F.avg("nivel").alias("nivel"))
    chosen = y.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(limit)
    # bounded: at most ``limit`` rows
    found = documents.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    sizes = found.select("doc_id", "_h", F.length("text").alias("n")).collect()
    kept = []
    for r in sorted(sizes, key=lambda r: (r["_h"], r.doc_id, r.n)):
        if r.n <= left:
            left -= r.n
            kept.append((r.doc_id, r.n))
    rows = []
    if kept:
        # by id and length, so that of several texts under one id only those that were counted come
        mine = documents.sparkSession.createDataFrame(sorted(set(kept)), "doc_id bigint, _n int")
        got = found.withColumn("_n", F.length("text")).join(F.broadcast(mine), ["doc_id", "_n"]).select("doc_id", "text", "nivel").collect()
        rows = sorted(got, key=lambda r: (r.doc_id, r.text))
    if not any(sentences(r.text) for r in rows) and not documents.isEmpty():
        raise ValueError(f"no labelled text with a sentence within {MAX_TRAINING_CHARS if max_chars is None else max_chars} characters to fit on")
    return [r.text for r in rows], [float(r.nivel) for r in rows]


_OUT = "doc_id bigint, palavras int, frases int, p1 double, p2 double, p3 double, p4 double, p5 double, dificuldade double, p_dificil double, nivel int"


def score(documents: DataFrame, model: Model) -> DataFrame:
    """Per document: palavras (by white space), frases, the mean sentence distribution p1 ... p5, dificuldade (1 to 5), p_dificil
    (level 4 or more) and nivel (dificuldade rounded). The whole text is read. Texts without a word have null results; repeated rows stay."""
    bc = documents.sparkSession.sparkContext.broadcast(pickle.dumps(Model(model.word.astype("f4"), model.gram.astype("f4"), model.word_bias, model.gram_bias, model.calibration)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(pickle.loads(bc.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            p, n = s.distributions(texts)
            hard, q = s.difficulty(p)
            none = n == 0
            num = lambda x, t=pa.float64(): pa.array(x, t, mask=none)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.split()) if t else 0 for t in texts], pa.int32()), pa.array(n, pa.int32()), *[num(p[:, i]) for i in range(LEVELS)], num(hard), num(q), num(np.clip(np.rint(hard), 1, LEVELS).astype("i4"), pa.int32())],
                names=[x.split()[0] for x in _OUT.split(", ")],
            )

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _OUT)


def profile(scored: DataFrame) -> DataFrame:
    """Documents and words per level (null: no words)."""
    return scored.groupBy("nivel").agg(F.count(F.lit(1)).alias("documentos"), F.sum("palavras").alias("palavras"))
