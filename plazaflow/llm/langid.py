"""Language by blended-spectrum n-gram presence kernels, Nyström landmarks and one-versus-rest kernel ridge regression.

A text is the set of its letter n-grams of lengths 1 to 3, lower-cased, white space and marks folded into one space. Two
texts' kernel is the number of common n-grams over the geometric mean of their counts. n-grams are themselves, as the code
points in one integer, so a long text has as many as it has and resembles no other for its length alone. A bounded,
documented sample of texts of each known language gives the landmarks and the regression.

The kernel against the landmarks needs only the n-grams that some landmark has. So a block of texts is a 0/1 matrix over
these, and its kernel values times the regression's weights are one matrix product with weights that were carried over
from landmarks to n-grams once: K(x) w = P(x) (Mᵀ w), save for the texts' norms.

A text that is null or has no letter is "und" with score 0; so is every text where nothing could be learnt. Every row
gives one row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_texts, in_batches

LONGEST = 3
#: Texts of one matrix product.
BLOCK = 64
#: Bits of a code point.
POINT = 21


def _folded() -> np.ndarray:
    table = np.full(0x2070, 32, np.uint32)
    for point in range(0x2070):
        if chr(point).isalpha():
            table[point] = ord(chr(point).lower()[0])
    return table


FOLDED = _folded()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


def grams(text: str) -> np.ndarray:
    """The sorted distinct n-grams of a text, each its code points in one integer."""
    points = np.frombuffer(f"\n{text}\n".encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(points < len(FOLDED), FOLDED[np.minimum(points, len(FOLDED) - 1)], points)
    codes = codes[~((codes == 32) & (np.r_[np.uint32(0), codes[:-1]] == 32))].astype(np.int64)
    parts, gram = [], np.zeros(len(codes), np.int64)
    for n in range(min(LONGEST, len(codes))):
        gram = (gram[: len(codes) - n] << POINT) | codes[n:]
        parts.append(gram)
    found = np.sort(np.concatenate(parts))
    return found[np.r_[True, found[1:] != found[:-1]]]


class Regression:
    """Kernel ridge regression on Nyström features, one value per language."""

    def __init__(self, texts: list[str], langs: list[str], landmarks: int, ridge: float) -> None:
        self.langs = sorted(set(langs))
        sets = [grams(t) for t in texts]
        by_lang = [[k for k, lang in enumerate(langs) if lang == name] for name in self.langs]
        marks = [k for rank in zip(*(m + [-1] * (len(texts) - len(m)) for m in by_lang), strict=True) for k in rank if k >= 0][:landmarks]
        self.known = np.unique(np.concatenate([sets[k] for k in marks]))
        sizes = np.array([len(sets[k]) for k in marks])
        self.marks = self.presences([sets[k] for k in marks]) / np.sqrt(sizes)[:, None]
        gram = self.kernel([sets[k] for k in marks])
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        kept = values > 1e-6 * values[-1]
        half = vectors[:, kept] / np.sqrt(values[kept])
        z = np.c_[self.kernel(sets) @ half, np.ones(len(sets))]
        y = np.where(np.array(langs)[:, None] == np.array(self.langs), 1.0, -1.0)
        weight = np.array([1 / len(by_lang[self.langs.index(lang)]) for lang in langs])[:, None]
        w = np.linalg.solve(z.T @ (z * weight) + ridge * np.eye(z.shape[1]), z.T @ (y * weight))
        self.alpha, self.offset = half @ w[:-1], w[-1]
        self.weights = (self.marks.T @ self.alpha).astype(np.float32)

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "known": self.known, "weights": self.weights, "offset": self.offset}

    def presences(self, sets: list[np.ndarray]) -> np.ndarray:
        """A 0/1 matrix of the landmarks' n-grams that each set has."""
        out = np.zeros((len(sets), len(self.known)), np.float32)
        for row, found in zip(out, sets, strict=True):
            at = np.minimum(np.searchsorted(self.known, found), len(self.known) - 1)
            row[at[self.known[at] == found]] = 1
        return out

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        """Kernel values of sets against the landmarks."""
        blocks = [self.presences(sets[k : k + BLOCK]) @ self.marks.T / np.sqrt([[len(s)] for s in sets[k : k + BLOCK]]) for k in range(0, len(sets), BLOCK)]
        return np.concatenate(blocks).astype(np.float64)

    def values(self, sets: list[np.ndarray]) -> np.ndarray:
        """Each set's value for every language."""
        return self.presences(sets) @ self.weights / np.sqrt([[len(s)] for s in sets]) + self.offset

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each text's best language, and its share of the softmax."""
        values = self.values([grams(t) for t in texts])
        shares = np.exp(4 * (values - values.max(axis=1, keepdims=True)))
        shares /= shares.sum(axis=1, keepdims=True)
        return values.argmax(axis=1), shares.max(axis=1)


def languages(
    docs: DataFrame,
    learn: Column,
    *,
    per_lang: int = 250,
    most_langs: int = 200,
    most_chars: int = 24_000_000,
    landmarks: int = 160,
    ridge: float = 1e-3,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of each document.

    ``learn`` says, on the documents' ``doc_id`` and ``lang``, which may be learnt from. The training sample is at most
    ``per_lang`` documents of each language, in the order of a hash of their ids, of the ``most_langs`` most frequent
    languages, and ``most_chars`` characters in all, an equal share a language; fewer of a language of which most rows repeat an id.
    A text of more than a twentieth of its language's share is not learnt from (it is scored whole, as all are).
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = source.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.coalesce(learn, F.lit(False)))
    named = known.where("text is not null").select("doc_id", "lang")
    frequent = named.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs)
    # by their hash about four times as many as are wanted are kept of each language before they are ranked
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(4.0 * per_lang * (1 << 30)) / F.col("count")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = named.join(F.broadcast(frequent), "lang").where(share).select("doc_id", "lang").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_lang).select("doc_id", "lang")
    rows = source.where("text is not null").join(F.broadcast(ids), ["doc_id", "lang"])
    one = rows.groupBy("doc_id", F.col("lang").alias("label")).agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = sorted((lang, doc_id, text) for doc_id, text, lang in bounded_texts(one, most_chars) if has_letter(text))
    model = Regression([t for _, _, t in sample], [lang for lang, _, _ in sample], landmarks, ridge) if sample else None
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores = ["und"] * len(texts), [0.0] * len(texts)
            todo = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
            for at in range(0, len(todo), BLOCK):
                block = todo[at : at + BLOCK]
                best, share = model([texts[k] for k in block])
                for k, b, s in zip(block, best.tolist(), share.tolist(), strict=True):
                    names[k], scores[k] = model.langs[b], s
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return in_batches(source.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double")
