"""Best-fit packing of tokenized documents into fixed-length sequences by hierarchical residual packing.

Each task tokenizes its documents and packs their pieces best-fit, longest first, in blocks of bounded size. Bins with
next to no room left are emitted at once. The items of underfull bins travel on: a tree of ever fewer blocks packs them
again together with those of other blocks, until one block remains or another round no longer helps; then all is
emitted. Only piece lengths travel, never tokens.

Nulls and empty texts are documents with the closing id alone. A document longer than a sequence is cut into pieces of
which the first holds the remainder. Repeated rows are packed as often as they occur. Columns other than the id and the
text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, in_batches

# fixed value: the public pattern by which byte-level vocabularies of this kind split a text
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters other than these may be of different classes in the two libraries.
UNSAFE = re.compile(r"[^\t\n\r\x20-\x7e\xa1\xbf\xc0-\xd6\xd8-\xf6\xf8-ɏЀ-ҁҊ-ԯ‐-‧]")
#: Longer texts are encoded in runs, cut before a space between a word's end and a letter, where a split is certain.
RUN_CHARS = 1 << 20
CUT = re.compile(r"(?<=[A-Za-z0-9.,]) (?=[A-Za-z])")

OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32())] + [(c, pa.int64()) for c in ("start", "length", "ids_crc32", "sequence_id", "offset")])
_encoders: dict[tuple[str, str], Callable[[str], np.ndarray]] = {}


def runs(text: str) -> Iterator[str]:
    """``text`` in parts of about ``RUN_CHARS`` characters that the vocabulary's pattern splits as it does the whole."""
    at = 0
    while len(text) - at > RUN_CHARS:
        cut = CUT.search(text, at + RUN_CHARS)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encoder(tokenizer: str, ranks: str) -> Callable[[str], np.ndarray]:
    """Ids of a text by the vocabulary file ``tokenizer``, without its closing ids; ``ranks`` is the same vocabulary as merge ranks.

    Merging by rank gives the same ids many times faster. Texts with characters for which the two libraries' classes could
    differ go to the tokenizer, which is loaded for the first of them. Strings of special tokens are their ids, as the
    tokenizer has it. One encoder is kept in a worker; it holds the vocabulary and nothing of the texts.
    """
    if (tokenizer, ranks) in _encoders:
        return _encoders[tokenizer, ranks]
    import tiktoken

    with open(tokenizer, encoding="utf-8") as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    apart = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    merged = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={}).encode_ordinary
    loaded: list = []

    def slow(text: str) -> list[int]:
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(tokenizer))
        return loaded[0].encode(text, add_special_tokens=False).ids

    def encode(text: str) -> np.ndarray:
        parts = []
        for part in apart.split(text) if apart else (text,):
            if part in special:
                parts.append(np.array([special[part]], np.uint32))
            else:
                parts += [np.array(slow(run) if UNSAFE.search(run) else merged(run), np.uint32) for run in runs(part)]
        return np.concatenate(parts) if len(parts) > 1 else parts[0]

    return _encoders.setdefault((tokenizer, ranks), encode)


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Each item's bin and place, and each bin's free room, when items go in turn to the fullest bin that takes them."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms, room_of = 0, []
    bins, places = [], []
    for length in lengths:
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            into = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
        else:
            room, into = capacity, len(room_of)
            room_of.append(capacity)
        bins.append(into)
        places.append(capacity - room)
        room -= length
        room_of[into] = room
        if room:
            by_room[room].append(into)
            open_rooms |= 1 << room
    return bins, places, room_of


def _packed(rows: list[tuple], capacity: int, waste: int | None, first_id: int) -> tuple[pa.RecordBatch, int]:
    """Rows (doc_id, piece, start, length, crc) with bins; items of bins with more than ``waste`` room get none."""
    rows.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    bins, places, rooms = best_fit([r[3] for r in rows], capacity)
    done = [waste is None or room <= waste for room in rooms]
    columns = [pa.array([r[i] for r in rows], ARROW.field(i).type) for i in range(5)]
    columns.append(pa.array([first_id + b if done[b] else None for b in bins], pa.int64()))
    columns.append(pa.array([p if done[b] else None for b, p in zip(bins, places, strict=True)], pa.int64()))
    return pa.RecordBatch.from_arrays(columns, schema=ARROW), first_id + len(rooms)


def _first_id(level: int) -> int:
    return ((level << 22) + TaskContext.get().partitionId()) << 32


def pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than ``capacity``."""
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    ranks: str,
    *,
    sequence_length: int = 1024,
    closing_id: int = 2,
    block_rows: int = 32_768,
    nearly_full: int = 8,
    shrink: float = 0.9,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of each document, with its sequence and the place in it.

    ``block_rows`` bounds the pieces that a task packs together, ``nearly_full`` is the free room up to which a bin of an
    inner round is emitted. Rounds end when the remaining pieces fit one block, or a round settles less than
    ``1 - shrink`` of them.
    """

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id, rows = encoder(tokenizer, ranks), _first_id(0), []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(closing_id)).astype("<u4")
                for k, (at, n) in enumerate(pieces(len(ids), sequence_length)):
                    rows.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                if len(rows) >= block_rows:
                    out, next_id = _packed(rows, sequence_length, nearly_full, next_id)
                    rows = []
                    yield out
        if rows:
            yield _packed(rows, sequence_length, nearly_full, next_id)[0]

    def again(level: int, waste: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            next_id, rows = _first_id(level), []
            for batch in batches:
                rows += zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
                if len(rows) >= 2 * block_rows:
                    out, next_id = _packed(rows, sequence_length, waste, next_id)
                    rows = []
                    yield out
            if rows:
                yield _packed(rows, sequence_length, waste, next_id)[0]

        return work

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    level = durable(in_batches(source, first, OUT))
    settled = [level.where("sequence_id is not null")]
    rest = level.where("sequence_id is null")
    left, depth = rest.count(), 1
    while left:
        blocks = -(-left // block_rows)
        last = blocks == 1
        level = durable(in_batches(rest.repartition(blocks), again(depth, None if last else nearly_full), OUT))
        settled.append(level.where("sequence_id is not null"))
        rest = level.where("sequence_id is null")
        before, left = left, rest.count()
        depth += 1
        if left > shrink * before:
            settled.append(durable(rest.mapInArrow(again(depth, None), OUT)))
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def sequences(packed: DataFrame, docs: DataFrame, tokenizer: str, ranks: str, *, sequence_length: int = 1024, closing_id: int = 2) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids). Needs distinct, non-null document ids.

    Tokenizes again and shuffles each piece's ids once to its sequence; a sequence is at most ``sequence_length`` ids.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(closing_id))
                for k, (at, n) in enumerate(pieces(len(ids), sequence_length)):
                    for column, value in zip(out, (doc_id, k, ids[at : at + n].astype(np.int32)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.list_(pa.int32()))], ["doc_id", "piece", "ids"])

    tokens = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, ids array<int>")
    joined = packed.select("doc_id", "piece", "sequence_id", "offset").join(tokens, ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return joined.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
