"""Packing token sequences by minimum bin slack.

A document is its token ids and one end id. Whole windows of it are sequences of their own; what remains, shorter than a window,
is dealt evenly to packing groups of about ``GROUP_PIECES`` pieces, so no task sees more. A group is packed from its
histogram of lengths: the longest piece opens a window, then a bitset dynamic programme over the remaining lengths (a length
with count c enters as 1, 2, 4, ... copies) finds the multiset that comes closest to the free space; walking the
stored bitsets back gives how often each length is used, and the window is repeated while the counts last.

A document occurs in one place for each window it fills and one for its rest, so it is cut only at multiples of the window.
Null text is the end id alone. Repeated rows and equal or null ids are pieces like others: a piece is known by the row it came from,
not by its id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize
from .text import Words, slices, tokenizer_path, word_bpe

WINDOW = 2048
END = 1
GROUP_PIECES = 20_000
TOKENIZER = "word_bpe_49k.json"

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def with_end(flat: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents, each followed by the end id, and where each document ends."""
    ends = np.cumsum(tokens + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.dtype("<u4"))
    out[np.arange(len(flat)) + np.repeat(np.arange(len(tokens)), tokens)] = flat
    return out, ends


def _pieces(path: str, window: int):
    def cut(batches):
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        model = word_bpe(path)
        for part in slices(batches):
            words = Words(part.column("text"))
            flat, length = model.ids(words)
            sums = np.concatenate(([0], np.cumsum(length)))
            ids, ends = with_end(flat, sums[words.first[1:]] - sums[words.first[:-1]])
            view = memoryview(ids).cast("B")
            size = np.diff(np.concatenate(([0], ends)))
            begin = ends - size
            n = -(-size // window)
            doc = np.repeat(np.arange(len(size)), n)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * window
            length = np.minimum(window, size[doc] - start)
            at = begin[doc] + start
            crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist())]
            columns = [
                part.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                pa.array(size[doc]), pa.array(number + np.arange(len(doc))),
            ]
            number += len(doc)
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "piece"])

    return cut


def best_fill(counts: dict[int, int], room: int) -> tuple[dict[int, int], int]:
    """How often to use each length so that the sum comes closest to ``room``, and that sum."""
    reach, steps, full, mask = 1, [], 1 << room, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left and not reach & full:
            copies = min(copies, left)
            steps.append((reach, length, copies))
            reach |= (reach << (length * copies)) & mask
            left, copies = left - copies, copies * 2
        if reach & full:
            break
    total = at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for before, length, copies in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + copies
            at -= length * copies
    return used, total


def fill_windows(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each piece and its offset there."""
    places = [[] for _ in range(window + 1)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        places[lengths[i]].append(i)
    counts = {x: len(p) for x, p in enumerate(places) if p}
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    while counts:
        seed = max(counts)
        counts[seed] -= 1
        used, _ = best_fill({x: c for x, c in counts.items() if c}, window - seed)
        counts[seed] += 1
        used[seed] = used.get(seed, 0) + 1
        for _ in range(min(counts[x] // c for x, c in used.items())):
            at = 0
            for length in sorted(used, reverse=True):
                for _ in range(used[length]):
                    piece = places[length].pop()
                    sequence[piece], offset[piece] = n, at
                    at += length
                counts[length] -= used[length]
            n += 1
        counts = {x: c for x, c in counts.items() if c}
    return sequence, offset


def pack(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    groups = max(1, -(-docs.count() // group_pieces))
    pieces = rows.mapInArrow(_pieces(path, window), f"doc_id {kind}, {PIECE}, piece bigint")
    pieces = materialize(pieces, "pieces")
    whole, rest = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("piece")
        sequence, offset = fill_windows(group["length"].to_numpy(), window)
        number = group["group"].to_numpy().astype(np.int64) << 32
        out = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        return out.append_column("sequence_id", pa.array((number + sequence) * 2 + 1)).append_column("offset", pa.array(offset))

    dealt = rest.withColumn("group", F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("int"))
    placed = dealt.groupBy("group").applyInArrow(place, f"doc_id {kind}, {PIECE}, sequence_id bigint, offset bigint")
    alone = whole.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("piece") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return placed.unionByName(alone)
