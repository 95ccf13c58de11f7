"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two words by the four-letter subsequences that they share, gaps included: a subsequence that spans
``s`` letters weighs ``DECAY ** s``, up to ``SPAN`` letters. So a word with inserted or missing letters stays close to the
insult it hides. Marks inside a word are dropped and letters spelled out one by one are joined before the comparison.

Training takes a bounded, documented sample of labelled documents, cut into sentences; a sentence has its document's label.
As an insulting document also has harmless sentences, the machine learns from them as bags. In the first round every word
has its sentence's label. Then, in rounds, the machine of the round before names the sentence of each toxic document that
it finds most toxic, and that sentence's words above a margin, if several documents name them, are the toxic examples; the
words of clean sentences, frequent and hard ones, are the clean examples. The squared-hinge machine on Nyström features is
trained anew on these. Landmarks are words of both kinds. A document's score rests on its most toxic word and on how many
words exceed the margin, turned into a probability with the labels' own shares.

In the Nyström space a linear machine's value is a sum over a word's subsequences of one weight each; so scoring looks up
one table that is as large for any corpus, over whole texts.

Null, empty and wordless texts score as texts without any suspect word. Every row gives one row; repeated rows give equal
scores; a table without labels of both kinds scores 0 throughout. Other columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, labelled_sample, release

SPAN, DECAY, ORDER = 6, 0.6, 4
#: Offsets of a subsequence's later letters from its first.
SHAPES = [shape for shape in combinations(range(1, SPAN), ORDER - 1)]
#: Subsequences are told apart by a hash of so many bits.
BITS = 20
#: Texts are scored in runs of about so many characters, which bounds a task's memory.
RUN_CHARS = 200_000
SENTENCE = re.compile(r"[.!?\n]+")
MARK = 0x10FFFF


def _letters() -> np.ndarray:
    """Each character below 0x2070: a letter's lower case, 0 for white space, MARK for what is dropped within words."""
    table = np.full(0x2070, MARK, np.uint32)
    for point in range(0x2070):
        char = chr(point)
        if char.isspace():
            table[point] = 0
        elif char.isalpha():
            table[point] = ord(char.lower()[0])
    return table


LETTERS = _letters()


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, words parted by one 0, and the text of each place (a 0 belongs to the word after it)."""
    lengths = np.array([len(t) + 1 for t in texts])
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    found = np.where(points < len(LETTERS), LETTERS[np.minimum(points, len(LETTERS) - 1)], points)
    text = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    hard = np.zeros(len(found), bool)
    hard[np.cumsum(lengths) - 1] = True
    kept = found != MARK
    found, text, hard = found[kept], text[kept], hard[kept]
    # a run of single letters is one word: drop the spaces between them
    space = found == 0
    single = ~space & np.r_[True, space[:-1]] & np.r_[space[1:], True]
    between = space & np.r_[False, single[:-1]] & np.r_[single[1:], False] & ~hard
    # of several spaces the last stays, as the start of the word that follows
    last = space & np.r_[space[1:], True] & ~hard
    kept = ~(between | last)
    found, text = found[kept], text[kept]
    start = np.flatnonzero(np.r_[True, found[:-1] == 0]) if len(found) else np.zeros(0, np.int64)
    # each word's 0 is moved before it
    moved = np.insert(found, 0, 0)
    owner = np.insert(text, 0, text[0] if len(text) else 0)
    zero = np.flatnonzero(moved == 0)
    inner = zero[zero + 1 < len(moved)]
    owner[inner] = owner[inner + 1]
    del start
    return moved, owner


def subsequences(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each shape: positions at which a subsequence starts within a word, its code, and its weight."""
    zeros = np.cumsum(codes == 0, dtype=np.int32)
    n = len(codes)
    scaled = [codes * np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
    for last in range(ORDER - 1, SPAN):
        if n <= last:
            continue
        inside = np.flatnonzero(zeros[last - 1 : n - 1] == zeros[: n - last])
        ends = scaled[0][inside] ^ (scaled[3][inside + last])
        moved = {o: inside + o for o in range(1, last)}
        second = {o: scaled[1][moved[o]] for o in range(1, last - 1)}
        third = {o: scaled[2][moved[o]] for o in range(2, last)}
        for shape in SHAPES:
            if shape[-1] == last:
                code = (ends + second[shape[0]]) ^ (third[shape[1]] * np.uint32(0x9E3779B1))
                code ^= code >> np.uint32(15)
                code *= np.uint32(0x2C1B3C6D)
                yield inside, code >> np.uint32(32 - BITS), DECAY ** (last + 1)


def norms(lengths: np.ndarray) -> np.ndarray:
    """Self-kernel root of words by their length with both ends, as if no subsequence repeated."""
    total = np.zeros(len(lengths))
    for shape in SHAPES:
        total += np.maximum(0, lengths - shape[-1]) * DECAY ** (2 * (shape[-1] + 1))
    return np.sqrt(np.maximum(total, 1e-9))


def word_values(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Value of each word (the letters after each 0) by ``table``, and where its 0 stands."""
    at = np.flatnonzero(codes == 0)
    word = np.cumsum(codes == 0) - 1
    sums = np.zeros(len(at))
    for starts, code, weight in subsequences(codes):
        sums += weight * np.bincount(word[starts], table[code], minlength=len(at))
    lengths = np.diff(np.r_[at, len(codes) - 1])  # letters and the first end
    return (sums / norms(lengths + 1))[:-1], at[:-1]


def spell(codes: np.ndarray) -> str:
    return "".join(map(chr, codes.tolist()))


def sentence_words(texts: list[str]) -> list[list[list[str]]]:
    """Each text's sentences as lists of lower-cased words."""
    out: list[list[list[str]]] = []
    same: dict[str, str] = {}  # one object a word, however often it occurs
    for at in range(0, len(texts), 100):
        cut = [SENTENCE.split(t) for t in texts[at : at + 100]]
        codes, owner = classes([s for sentences in cut for s in sentences])
        bounds = np.flatnonzero(codes == 0)
        spelled = "".join(map(chr, codes.tolist())).split("\0")[1:]
        of: dict[int, list[str]] = {}
        for sentence, word in zip(owner[bounds].tolist(), spelled, strict=True):
            if word:
                of.setdefault(sentence, []).append(same.setdefault(word, word))
        number = 0
        for sentences in cut:
            out.append([of[k] for k in range(number, number + len(sentences)) if k in of])
            number += len(sentences)
    return out


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, code, weight over the word's norm) of all subsequences of ``words``, by word number."""
    codes = np.frombuffer(("\0" + "\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
    owner = np.cumsum(codes == 0) - 1
    scale = 1 / norms(np.array([len(w) + 2 for w in words]))
    parts = [(owner[s], c, w * scale[np.minimum(owner[s], len(words) - 1)]) for s, c, w in subsequences(codes)]
    numbers, code, weight = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(numbers, kind="stable")
    return numbers[order], code[order], weight[order]


class Kernel:
    """Kernel values against fixed landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        self.owner, self.code, self.weight = _features(landmarks)
        self.n = len(landmarks)
        known = np.unique(self.code)
        self.row = np.zeros(1 << BITS, np.int32)
        self.row[known] = np.arange(1, len(known) + 1)
        self.grid = np.zeros((len(known) + 1, self.n), np.float32)
        np.add.at(self.grid, (self.row[self.code], self.owner), self.weight)

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.n), np.float32)
        for at in range(0, len(words), 200):
            owner, code, weight = _features(words[at : at + 200])
            row = self.row[code]
            hit = row > 0
            owner, row, weight = owner[hit], row[hit], weight[hit].astype(np.float32)
            if len(owner):
                first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
                out[at + owner[first]] = np.add.reduceat(self.grid[row] * weight[:, None], first)
        return out

    def table(self, alpha: np.ndarray) -> np.ndarray:
        """Weight of each subsequence code for the function that weighs landmarks by ``alpha``."""
        return np.bincount(self.code, self.weight * alpha[self.owner], minlength=1 << BITS)


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 250) -> np.ndarray:
    """A linear machine (last entry: offset) by accelerated gradient steps on the weighted squared hinge loss."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    weight = weight / weight.sum()
    rate = 1 / (2 * np.linalg.norm(sum((x[k : k + 2000] * weight[k : k + 2000, None]).T @ x[k : k + 2000] for k in range(0, len(x), 2000)), 2) + 2 * ridge)
    w = ahead = np.zeros(x.shape[1])
    for step in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead.astype(np.float32)))
        grad = -2 * x.T @ (weight * y * slack).astype(np.float32) + 2 * ridge * np.r_[ahead[:-1], 0]
        new = ahead - rate * grad
        ahead, w = new + step / (step + 3) * (new - w), new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Coefficients of a logistic fit by Newton steps, offset last."""
    x = np.c_[x, np.ones(len(x))]
    weight = weight / weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), grad)
    return w


def _word_counts(parsed: list[list[list[str]]], labels: np.ndarray) -> tuple[Counter[str], Counter[str]]:
    """How many clean and toxic documents have each word; only between neighbours not seen yet, so copies of a document count once.

    Words are numbers in flat arrays, which are a few bytes a word.
    """
    number: defaultdict[str, int] = defaultdict(count(1).__next__)
    flat = np.fromiter((number[w] for sentences in parsed for s in sentences for w in (*s, "")), np.int64)
    sizes = [sum(len(s) + 1 for s in sentences) for sentences in parsed]
    doc = np.repeat(np.arange(len(parsed), dtype=np.int32), sizes)
    place = (np.r_[0, flat[:-1]] * 0x9E3779B97F4A7C1 ^ np.r_[flat[1:], 0] * 0x42B2AE3D27D4EB4F) * 2 + labels[doc]
    place = (place ^ (place >> 29)) * 0x165667B19E3779F9 ^ flat * 0x27D4EB2F165667C5
    names = list(number)
    long = np.array([False, *(len(w) > 2 for w in names)])
    kept = np.flatnonzero(long[flat])
    new = kept[np.unique(place[kept], return_index=True)[1]]
    pairs = np.unique(doc[new] * np.int64(len(names) + 1) + flat[new])
    of, word = pairs // (len(names) + 1), pairs % (len(names) + 1)
    tally = lambda y: np.bincount(word[labels[of] == y], minlength=len(names) + 1)
    return tuple(Counter({names[k - 1]: int(n) for k, n in enumerate(tally(y)) if n}) for y in (0, 1))


def _witnesses(parsed: list[list[list[str]]], labels: np.ndarray, value: dict[str, float], margin: float) -> Counter[str]:
    """In how many toxic documents each word is in the sentence that ``value`` finds most toxic, and at ``margin`` or the sentence's largest value."""
    out: Counter[str] = Counter()
    for sentences, label in zip(parsed, labels.tolist(), strict=True):
        if label and sentences:
            most, at = max((max((value.get(w, -9.0) for w in s), default=-9.0), k) for k, s in enumerate(sentences))
            if most > -9:
                out.update({w for w in sentences[at] if value.get(w, -9.0) >= min(most, margin)})
    return out


class Machine:
    """A squared-hinge machine on the Nyström features of landmarks: a weight of each subsequence code, and an offset."""

    def __init__(self, marks: list[str], words: list[str], y: np.ndarray, weight: np.ndarray) -> None:
        kernel = Kernel(marks)
        gram = kernel(marks).astype(np.float64)
        values, vectors = np.linalg.eigh((gram + gram.T) / 2)
        kept = values > 1e-4 * values[-1]
        half = vectors[:, kept] / np.sqrt(values[kept])
        w = squared_hinge(kernel(words) @ half.astype(np.float32), y, weight, ridge=1e-6)
        self.table, self.offset = kernel.table(half @ w[:-1]).astype(np.float32), float(w[-1])


def train(
    rows: list[tuple[int, str, int]], share: float, *, landmarks: int = 360, words_a_round: int = 8_000, rounds: int = 4, margin: float = 0.7, documents: int = 3
) -> dict | None:
    """The scoring model from (id, text, label) rows; ``share`` is the share of label 1 among all learning labels.

    A witness is kept if ``documents`` toxic documents have it, where any has. At most ``landmarks`` words are landmarks, and
    about ``words_a_round`` clean words are examples of a round, which bounds its matrices.
    """
    labels = np.array([r[2] for r in rows])
    if len(set(labels.tolist())) < 2:
        return None
    parsed = sentence_words([r[1] for r in rows])
    n1, n0 = int(labels.sum()), int((1 - labels).sum())
    in_clean, in_toxic = _word_counts(parsed, labels)
    words = sorted({*in_clean, *in_toxic})
    clean = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0]))]
    if not in_toxic or not clean:
        return None
    # the first round: words with their sentences' labels, those of unequal shares first
    toxic_share, clean_share = (np.array([c[w] for w in words]) / n for c, n in ((in_toxic, n1), (in_clean, n0)))
    gap = toxic_share - clean_share
    used = np.argsort(-np.abs(gap), kind="stable")[:words_a_round]
    first = [words[k] for k in np.argsort(-gap / np.sqrt(toxic_share + clean_share), kind="stable")[: landmarks * 2 // 3]]
    examples = 2 * [words[k] for k in used]
    y, weight = np.r_[np.ones(len(used)), -np.ones(len(used))], np.r_[toxic_share[used], clean_share[used]]
    marks = list(dict.fromkeys(first + clean[: landmarks // 3]))
    frequent = clean[: words_a_round // 2] + clean[:: max(1, 2 * len(clean) // words_a_round)]
    found: Counter[str] = Counter()
    for _ in range(rounds):
        machine = Machine(marks, examples, y, weight)
        value = dict(zip(words, (_values(words, machine.table) + machine.offset).tolist(), strict=True))
        found |= _witnesses(parsed, labels, value, margin)
        found = Counter({w: n for w, n in found.items() if n >= documents}) or found
        hard = sorted(clean, key=lambda w: -value[w])[: words_a_round // 2]
        positives = sorted(found, key=lambda w: (-found[w], w))
        negatives = list(dict.fromkeys(frequent + hard))
        examples = positives + negatives
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        weight = np.r_[np.array([found[w] for w in positives]) / (2 * found.total()), np.full(len(negatives), 0.5 / len(negatives))]
        marks = list(dict.fromkeys(positives[: landmarks * 2 // 3] + hard[: landmarks // 3]))
    machine = Machine(marks, examples, y, weight)
    model = {"table": machine.table, "offset": machine.offset, "fit": np.zeros(3)}
    raw = np.concatenate([document_values(model, [t[1] for t in rows[k : k + 200]])[0] for k in range(0, len(rows), 200)])
    model["fit"] = logistic(raw, labels, np.where(labels == 1, share / n1, (1 - share) / n0), ridge=1e-4)
    return model


def _values(words: list[str], table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(words))
    for at in range(0, len(words), 10_000):
        part = words[at : at + 10_000]
        owner, code, weight = _features(part)
        out[at : at + len(part)] = np.bincount(owner, table[code] * weight, minlength=len(part))[: len(part)]
    return out


def document_values(model: dict, texts: list[str]) -> tuple[np.ndarray, list[str]]:
    """Per text: its largest word value (clipped) and the log of the words over the margin; and that word."""
    codes, owner = classes(texts)
    values, at = word_values(codes, model["table"])
    values = np.clip(values + model["offset"], -1.5, 1.5)
    lengths = np.diff(np.r_[at, len(codes) - 1])
    text = owner[np.minimum(at + 1, len(owner) - 1)]
    values[lengths < 4] = -1.5  # fewer than three letters
    out = np.zeros((len(texts), 2))
    out[:, 0] = -1.5
    if len(values):
        np.maximum.at(out[:, 0], text, values)
        out[:, 1] = np.log1p(np.bincount(text, values > 0, minlength=len(texts)))
    worst = [""] * len(texts)
    order = np.lexsort((-at, values))
    for k in order[np.isin(order, np.flatnonzero(values == out[text, 0]))].tolist() if len(values) else ():
        if values[k] > -1.5:
            worst[text[k]] = spell(codes[at[k] + 1 : at[k] + lengths[k]])
    return out, worst


def fit(docs: DataFrame, labels: DataFrame, learn: Column, *, per_class: int = 2000, most_chars: int = 8_000_000, label: str = "toxic") -> dict | None:
    """The scoring model, learnt from at most ``per_class`` documents of each label, ``most_chars`` characters in all, among those that ``learn`` admits.

    ``learn`` is a condition on ``labels``' doc_id. The share of label 1 is counted over all admitted labels. A text of more
    than a twentieth of its label's half of ``most_chars`` is not learnt from (it is scored whole, as all are). One task
    trains, as the sample is bounded; only the model comes to the driver.
    """
    share = labels.where(learn & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    if share is None:
        return None

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        model = train(rows, float(share)) if rows else None
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    sample = labelled_sample(docs, labels, label, learn, per_class, most_chars)
    found = in_batches(sample.repartition(1), trained, "model binary").first()
    release(docs.sparkSession)
    return pickle.loads(found.model) if found else None


def score_texts(model: dict | None, texts: list[str | None]) -> tuple[list[float], list[str]]:
    """Score and deciding word of each text, computed in runs of bounded length."""
    texts = [t or "" for t in texts]
    if model is None:
        return [0.0] * len(texts), [""] * len(texts)
    scores: list[float] = []
    words: list[str] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= RUN_CHARS):
            size += len(texts[end])
            end += 1
        x, worst = document_values(model, texts[at:end])
        z = np.c_[x, np.ones(len(x))] @ model["fit"]
        scores += (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()
        words += worst
        at = end
    return scores, words


def toxicity(docs: DataFrame, model: dict | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and the lower-cased word that decides it, for each document."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, words = score_texts(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(words, pa.string())], ["doc_id", "score", "worst"])

    return in_batches(source, work, "doc_id long, score double, worst string")


def without_toxic(docs: DataFrame, model: dict | None, *, limit: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, less the rows whose text scores ``limit`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, _ = score_texts(held.value, batch.column(column).to_pylist())
            yield batch.take(pa.array([k for k, s in enumerate(scores) if s < limit], pa.int64()))

    return in_batches(docs, work, docs.schema)
