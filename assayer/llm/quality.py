"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

The statistics come from the whole text by array operations. The trees are fitted on the driver from a bounded sample of
labelled rows (``MAX_TRAIN`` rows with the smallest hash of doc_id), then flattened into five arrays; a task walks all its
documents through a tree at once. Language, source, doc_id and labels are never inputs of a score.

Null text counts as empty; empty texts are scored like any other. Without labels every score is 0.5. Rows without doc_id
have remainder 0 (the checksum of the empty text) and are scored. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, slices, span_hashes

MAX_TRAIN = 20_000
BINS, DEPTH, TREES, RATE, RIDGE = 32, 4, 60, 0.15, 1.0

NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "symbol", "stop", "bang", "other_bytes", "blank",
    "distinct_words", "top_word", "lines", "distinct_lines", "long_words", "symbol_runs", "letters", "at_and_slash",
)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def _class(symbols: bytes) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[list(symbols)] = 1
    return table


UPPER = _class(bytes(range(65, 91)))
LETTER = _class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
DIGIT = _class(b"0123456789")
SYMBOL = _class(b"#$%&*+<=>[\\]^_`{|}~")
STOP = _class(b".,;:?")
BANG = _class(b"!")
OTHER = _class(bytes(range(128, 256)))
SPACE = _class(b" \t\n\r\x0b\x0c")
PLACE = _class(b"@/")


def features(column: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    words = Words(column)
    n, buffer = len(words.count), words.buffer
    begin, end = words.begins_of_text, words.ends_of_text
    size = np.maximum(end - begin, 1).astype(float)
    n_words = np.maximum(words.count, 1).astype(float)

    def share(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(buffer) + 1, np.int64)
        np.cumsum(table[buffer], out=sums[1:])
        return (sums[end] - sums[begin]) / size

    text, length = words.text, words.ends - words.starts
    keys, counts = _grouped(text, words.hash)
    distinct = np.bincount(keys, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, keys, counts)
    line_end = np.unique(np.concatenate((np.flatnonzero(buffer == 10), end)))
    line_end = line_end[line_end < len(buffer)]
    line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
    of = np.searchsorted(end, line_end)
    lines = np.bincount(of, minlength=n)
    line_keys, _ = _grouped(of, span_hashes(buffer.astype(np.uint64) + np.uint64(1), line_start, line_end))
    symbol = SYMBOL[buffer]
    runs = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum(symbol[1:] & symbol[:-1], out=runs[2:])
    return np.column_stack(
        (
            np.log1p(end - begin),
            np.log1p(words.count),
            np.bincount(text, length, n) / n_words,
            share(UPPER), share(DIGIT), share(SYMBOL), share(STOP), share(BANG), share(OTHER), share(SPACE),
            distinct / n_words,
            top / n_words,
            lines / size,
            np.bincount(line_keys, minlength=n) / np.maximum(lines, 1),
            np.bincount(text, length > 20, n) / n_words,
            (runs[end] - runs[begin]) / size,
            share(LETTER),
            share(PLACE),
        )
    )


def _grouped(group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct (group, key) the group and how often it occurs."""
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (k[1:] != k[:-1])))) if len(g) else np.empty(0, int)
    return g[new], np.diff(np.append(new, len(g)))


@dataclass
class Trees:
    """Trees in flat arrays: node i tests feature[i] <= cut[i] and goes to left[i] or left[i] + 1; leaves have feature -1."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                feature = self.feature[node]
                inner = feature >= 0
                step = self.left[node] + (x[rows, np.maximum(feature, 0)] > self.cut[node])
                node = np.where(inner, step, node)
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost log loss with depth-wise trees over quantile bins."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    feature, cut, left, value, roots = [], [], [], [], []

    def add(n: int = 1) -> int:
        for column, empty in ((feature, -1), (cut, 0.0), (left, 0), (value, 0.0)):
            column.extend([empty] * n)
        return len(feature) - n

    if 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
        total = np.full(len(y), base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-total))
            g, h = y - p, p * (1 - p)
            root = add()
            roots.append(root)
            where = np.full(len(y), root)
            level = [root]
            for _ in range(DEPTH):
                following = []
                for node in level:
                    rows = np.flatnonzero(where == node)
                    if len(rows) < 40:
                        continue
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = (1e-6, -1, 0)
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(e) + 1))[:-1]
                        gain = gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE)
                        gain[(hl < 1e-2) | (hs - hl < 1e-2)] = 0
                        k = int(gain.argmax())
                        if gain[k] > best[0]:
                            best = (gain[k], j, k)
                    if best[1] < 0:
                        continue
                    child = add(2)
                    feature[node], cut[node], left[node] = best[1], float(edges[best[1]][best[2]]), child
                    where[rows] = child + (binned[rows, best[1]] > best[2])
                    following += [child, child + 1]
                level = following
            for node in np.unique(where):
                rows = where == node
                value[node] = RATE * float(g[rows].sum() / (h[rows].sum() + RIDGE))
            total += np.array(value)[where]
    arrays = (np.array(feature, np.int64), np.array(cut), np.array(left, np.int64), np.array(value))
    return Trees(base, np.array(roots, np.int64), *arrays)


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Trees:
    """Fit on at most ``max_train`` labelled documents of the table that are not held out.

    A document of conflicting labels counts as each; of rows with one doc_id the one with the smallest features counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 3) != 1))
    known = known.select("doc_id", F.col("quality").alias("y")).distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def measure(batches):
        for part in slices(batches):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("y"), pa.FixedSizeListArray.from_arrays(x.ravel(), x.shape[1]).cast(pa.list_(pa.float64()))],
                ["doc_id", "y", "x"],
            )

    found = rows.mapInArrow(measure, "doc_id bigint, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).toPandas()
    found = found.sort_values(["doc_id", "y"])
    if not len(found):
        return fit(np.empty((0, len(NAMES))), np.empty(0))
    return fit(np.stack(found["x"].to_numpy()), found["y"].to_numpy(float))


def _scored(docs: DataFrame, model: Trees, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` as c0, c1, ..., whatever their names, with held_out, score and predicted."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    place = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    kept = [place[c] for c in keep]
    rows = rows.select(*kept, (remainder(F.col(place["doc_id"]), 3) == 1).alias("held_out"), F.col(place["text"]).alias("text"))

    def score(batches):
        for part in slices(batches, "text"):
            s = model.score(features(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                [*kept, "held_out", "score", "predicted"],
            )

    schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.schema if f.name in kept)
    return rows.mapInArrow(score, f"{schema}held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, model: Trees, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with held_out, score and predicted for every document; no row for an empty table."""
    return _scored(docs, model, list(keep)).toDF(*keep, "held_out", "score", "predicted")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier accepts, all columns kept, whatever their names; an empty table stays empty."""
    scored = _scored(docs, train(docs, labels), docs.columns)
    return scored.where("predicted = 1").drop("held_out", "score", "predicted").toDF(*docs.columns)
