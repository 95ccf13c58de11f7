"""Quality by random-indexing word vectors pooled per document and a two-layer network with calibrated probabilities.

Every word has an index vector, a few entries of +1 and -1 that a hash of the word places. A word of the vocabulary also
has a context vector, the sum of the index vectors of its neighbours over the whole corpus. The vocabulary is the most
frequent words of the corpus, at most ``vocabulary`` of them: all words of all documents are counted, and it ends at a
count, so that no word is in for its spelling. Each task adds up its own matrix of context vectors, and the matrices are
summed slice by slice in two rounds; so what is sent to the tasks is as large for any corpus.

A document's vector is the mean of its words' index vectors and that of its vocabulary words' context vectors, besides the
roots of the shares of what pooling would lose: distinct words, words outside the vocabulary, in capitals, like the one before, lines like
an earlier one, and the document's length. Words are runs of letters and digits, lower-cased, and runs of marks. A bounded, documented
sample of labelled documents trains a two-layer numpy network; part of that sample is kept back to fit the temperature
that calibrates its probabilities.

Null and empty texts have a zero vector. Every row gives one row; without labels of both kinds all score 0.5.
Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, in_batches, labelled_sample, raw

DIMENSIONS, ENTRIES, SLICES, EXTRA = 64, 4, 8, 6
#: Words that a task counts before it hands its counts on; words of one sum; steps of a doubling of counts.
HELD_WORDS, RUN_WORDS, STEPS = 200_000, 100_000, 16
TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]++|[^\s0-9A-Za-z\x80-\xff]++")
CAPITALS = re.compile(rb"(?<![0-9A-Za-z\x80-\xff])(?=[0-9\x80-\xff]*+[A-Z])[0-9A-Z\x80-\xff]{2,}+(?![a-z])")
SUMS = "slice int, salt int, sums binary"


def tokens(text: bytes | None) -> list[bytes]:
    return TOKEN.findall(text.lower()) if text else []


def index_vectors(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each word's entries."""
    h = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)).astype(np.int64)[:, None]
    return (h >> 6 * np.arange(ENTRIES)) % DIMENSIONS, 1.0 - 2 * ((h >> 24 + np.arange(ENTRIES)) & 1)


def frequent_words(docs: DataFrame, most: int) -> list[bytes]:
    """The words of all documents that occur most often, ``most`` at most, by falling count."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        handed = lambda: pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in raw(batch.column(0)):
                counts.update(tokens(text))
                if len(counts) >= HELD_WORDS:
                    yield handed()
                    counts.clear()
        yield handed()

    counted = durable(in_batches(docs.select("text"), partial, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * STEPS)
    left, least = most, None
    for row in counted.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # some hundred levels
        left -= row["count"]
        if left < 0:
            break
        least = row["level"]
    if least is None:
        return []
    rows = counted.where(level >= least).collect()
    return [bytes(r["word"]) for r in sorted(rows, key=lambda r: (-r["n"], bytes(r["word"])))]


def context_matrix(docs: DataFrame, words: list[bytes], window: int) -> np.ndarray:
    """The context vectors of the vocabulary over all documents; slices are summed by task, then by slice."""
    size = -(-max(1, len(words)) // SLICES)
    held = docs.sparkSession.sparkContext.broadcast(words)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: k for k, w in enumerate(held.value)}
        total = np.zeros(size * SLICES * DIMENSIONS, np.float32)
        run: list[bytes] = []
        ends: list[int] = []

        def add() -> None:
            places, signs = index_vectors(run)
            of = np.fromiter(map(number.get, run, repeat(-1)), np.int64, len(run)) * DIMENSIONS
            text = np.repeat(np.arange(len(ends)), np.diff([0, *ends]))
            for step in range(1, min(window, len(run) - 1) + 1):
                near = text[step:] == text[:-step]  # nothing reaches across texts
                for word, by in ((np.arange(len(run) - step), np.arange(step, len(run))), (np.arange(step, len(run)), np.arange(len(run) - step))):
                    kept = near & (of[word] >= 0)
                    np.add.at(total, (of[word[kept]][:, None] + places[by[kept]]).reshape(-1), signs[by[kept]].reshape(-1).astype(np.float32))

        for batch in batches:
            for text in raw(batch.column(0)):
                found = tokens(text)
                # a long text goes in parts that share the window
                for at in range(0, len(found), RUN_WORDS):
                    run += found[at : at + RUN_WORDS]
                    ends.append(len(run))
                    if len(run) >= RUN_WORDS:
                        add()
                        run, ends = [], []
        if run:
            add()
        pack = zstandard.ZstdCompressor(level=1)
        blobs = [pack.compress(x.tobytes()) for x in total.reshape(SLICES, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId() % 16] * SLICES, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "salt", "sums"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        unpack, pack = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, salt, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                more = np.frombuffer(unpack.decompress(blob), np.float32)
                sums[part, salt] = sums[part, salt] + more if (part, salt) in sums else more
        if sums:
            keys = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in (0, 1)] + [pa.array([pack.compress(sums[k].tobytes()) for k in keys], pa.binary())], ["slice", "salt", "sums"])

    first = in_batches(docs.select("text"), partial, SUMS).repartition("slice", "salt").mapInArrow(add_up, SUMS)
    rows = first.withColumn("salt", F.lit(0)).repartition("slice").mapInArrow(add_up, SUMS).collect()
    out = np.zeros((SLICES, size * DIMENSIONS), np.float32)
    for row in rows:
        out[row["slice"]] += np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(row["sums"])), np.float32)
    return out.reshape(-1, DIMENSIONS)[: len(words)]


class Vectors:
    """The vocabulary's context vectors, each of unit length, and the pooling of a text's words."""

    def __init__(self, words: list[bytes], context: np.ndarray) -> None:
        self.words = words
        self.context = (context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.number: dict[bytes, int] = {}

    def __getstate__(self) -> dict:
        return {"words": self.words, "context": self.context, "number": {}}

    def pooled(self, texts: list[bytes | None]) -> np.ndarray:
        """The vector of each text."""
        if not self.number:
            self.number.update((w, k) for k, w in enumerate(self.words))
        out = np.zeros((len(texts), 2 * DIMENSIONS + EXTRA), np.float32)
        for row, text in zip(out, texts, strict=True):
            found = tokens(text)
            n = len(found)
            if not n:
                continue
            codes = np.fromiter(map(self.number.get, found, repeat(-1)), np.int64, n)
            for at in range(0, n, RUN_WORDS):
                places, signs = index_vectors(found[at : at + RUN_WORDS])
                row[:DIMENSIONS] += np.bincount(places.reshape(-1), signs.reshape(-1), DIMENSIONS)
                known = codes[at : at + RUN_WORDS]
                row[DIMENSIONS : 2 * DIMENSIONS] += self.context[known[known >= 0]].sum(axis=0)
            inside = int((codes >= 0).sum())
            row[:DIMENSIONS] /= n
            row[DIMENSIONS : 2 * DIMENSIONS] /= max(1, inside)
            lines = [x for x in text.split(b"\n") if not x.isspace() and x]
            again = sum(a == b for a, b in zip(found, found[1:], strict=False))
            shares = [len(set(found)) / n, 1 - inside / n, len(CAPITALS.findall(text)) / n, again / n, 1 - len(set(lines)) / max(1, len(lines))]
            row[2 * DIMENSIONS :] = *np.sqrt(shares), np.log1p(n) / 10
        return out


class Network:
    """Two layers over standardised inputs; ``temperature`` divides the output before the sigmoid."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, hidden: int = 24, epochs: int = 150) -> None:
        rng = np.random.default_rng(3)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        z = self.standard(x)
        shape = [(z.shape[1], hidden), (hidden,), (hidden,), ()]
        p = [rng.normal(0, 1 / max(1, s[0] if s else 1) ** 0.5, s) if k in (0, 2) else np.zeros(s) for k, s in enumerate(shape)]
        m, v = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]
        step = 0
        for _ in range(epochs):
            rng.shuffle(used)
            for at in range(0, len(used), 128):
                b = used[at : at + 128]
                h = np.tanh(z[b] @ p[0] + p[1])
                d = weight[b] * (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) / len(b)
                back = d[:, None] * p[2] * (1 - h * h)
                grads = [z[b].T @ back + 1e-3 * p[0], back.sum(axis=0), h.T @ d + 1e-3 * p[2], d.sum()]
                step += 1
                for k, g in enumerate(grads):
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(held):
            out, sign = self.raw(x[held]), np.where(y[held] > 0, 1, -1)
            losses = {t: (weight[held] * np.logaddexp(0, -np.clip(sign * out / t, -500, 500))).mean() for t in np.geomspace(0.3, 10, 60)}
            self.temperature = float(min(losses, key=losses.get))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature, -30, 30)))


def quality(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    *,
    per_class: int = 2500,
    vocabulary: int = 20_000,
    window: int = 2,
    label: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of each document.

    ``learn`` says, on ``labels``' doc_id, which labels may be learnt from; at most ``per_class`` documents of each label are
    the training sample, 48 M characters in all (:func:`.common.bounded_sample` says which), weighted back to the labels' own shares. ``vocabulary`` bounds the words with context vectors.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    words = frequent_words(source, vocabulary)
    vectors = Vectors(words, context_matrix(source, words, window))
    sample = sorted((r.doc_id, r.text, r.label) for r in labelled_sample(source, labels, label, learn, per_class).collect())
    share = labels.where(learn & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    y = np.array([r[2] for r in sample], float)
    network = None
    if 0 < y.sum() < len(y):
        weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
        network = Network(vectors.pooled([r[1].encode() for r in sample]).astype(np.float64), y, weight)
    held = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = held.value
        for batch in batches:
            if network is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = network(vectors.pooled(raw(batch.column(1))).astype(np.float64)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return in_batches(source, work, "doc_id long, score double")
