"""Maximal periodic runs of words, by recompression.

The words of a slice of documents, each document fenced by symbols that occur nowhere else, are compressed level by level into a
run-length grammar: one level replaces every block of equal symbols by a symbol for (symbol, length), the next parts the symbols at
random in left and right ones and replaces every pair of a left one and a right one. The same words are compressed the same way wherever
they stand, but for a symbol at either end. So the longest common extension of two places, to the right or to the left,
is found by climbing the levels while the symbols agree and coming down again where they differ: a step or two a level, exact, for
arrays of places at once. No suffix array is built.

A run of period q and at least 2q words holds two neighbouring multiples of q. These harmonic-grid pairs, n/q for each q, whose words
agree are the candidates; the extensions to both sides give the run that a pair lies in. Of equal stretches the smallest period
stays, which is the smallest period of the stretch.

Null and blank texts have no words and no runs. Rows are treated one by one, so ties, repeated rows and rows without doc_id are
no special case. A text is never cut: memory grows with the longest document, some 200 bytes a word. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import Words, mix, ragged, slices

SLICE_BYTES = 1 << 20
LEAST_WORDS = 12
CHUNK = 1 << 17  # candidate pairs extended at once

#: Given doc_id and word counts of a slice: for each word of all documents, the number within its document of the word to put there.
Order = Callable[[pa.Array, np.ndarray], np.ndarray]


class Level:
    """Symbols of one level, and how they hang together with the level below (children) and above (parent)."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray | None = None):
        self.symbols = symbols
        self.first = first  # first child of each symbol; one more entry closes the last
        self.parent: np.ndarray | None = None
        self.blocks = False  # whether the step to the level above replaced blocks rather than pairs


def _grouped(level: Level, head: np.ndarray, blocks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Tie a level's symbols to parents that begin where ``head`` is set; returns first children and sizes."""
    level.parent = np.cumsum(head, dtype=np.int32) - 1
    level.blocks = blocks
    first = np.append(np.flatnonzero(head), len(head)).astype(np.int32)
    return first, np.diff(first)


def _renamed(symbols: np.ndarray, first: np.ndarray, size: np.ndarray, second: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
    """Parent symbols: the child's own where it is alone, else a new one for each (child, ``second``)."""
    out = symbols[first[:-1]].copy()
    many = np.flatnonzero(size > 1)
    rules = (out[many].astype(np.int64) << 32) | second[many]
    names, inverse = np.unique(rules, return_inverse=True)
    out[many] = fresh + inverse
    return out, fresh + len(names)


def grammar(symbols: np.ndarray, fences: int) -> list[Level]:
    """Levels over symbols 0..; those below ``fences`` are unique and never compressed. Ends when nothing but fences has a neighbour."""
    levels = [Level(symbols.astype(np.int32))]
    fresh = int(symbols.max()) + 1 if len(symbols) else 0
    turn = 0
    while True:
        level = levels[-1]
        s = level.symbols
        equal = s[1:] == s[:-1]
        if equal.any():
            first, size = _grouped(level, np.concatenate(([True], ~equal)), True)
            s, fresh = _renamed(s, first, size, size, fresh)
            level = Level(s, first)
            levels.append(level)
        inner = s >= fences
        if not (inner[1:] & inner[:-1]).any():
            return levels
        while True:  # a parting of the symbols that makes a pair at least
            turn += 1
            left = (mix(s.astype(np.uint64) + np.uint64(turn << 32)) & np.uint64(1)).astype(bool)
            near = inner[1:] & inner[:-1]
            ways = [near & left[:-1] & ~left[1:], near & ~left[:-1] & left[1:]]
            pair = max(ways, key=np.count_nonzero)
            if pair.any():
                break
        first, size = _grouped(level, np.concatenate(([True], ~pair)), False)
        second = s[np.minimum(first[:-1] + 1, len(s) - 1)].astype(np.int64)
        s, fresh = _renamed(s, first, size, second, fresh)
        levels.append(Level(s, first))


def _edge(level: Level, above: Level, a: np.ndarray, step: int) -> np.ndarray:
    """Distance in symbols from a place to the end, in the direction of ``step``, of its parent; the parent's whole size if it is at its start."""
    up = level.parent[a]
    return above.first[up + 1] - a if step > 0 else a - above.first[up] + 1


def _at_start(level: Level, above: Level, a: np.ndarray, step: int) -> np.ndarray:
    up = level.parent[a]
    return above.first[up] == a if step > 0 else above.first[up + 1] - 1 == a


def extend(levels: list[Level], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """How many symbols of level 0 agree from places a and b on, going right (step 1) or left (-1). Places a and b must differ."""
    begin = a
    a, b = a.astype(np.int64), b.astype(np.int64)
    fallen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    who = np.arange(len(a))
    for level, above in zip(levels, levels[1:]):
        start_a, start_b = _at_start(level, above, a, step), _at_start(level, above, b, step)
        move = ~(start_a & start_b)
        same = level.symbols[a] == level.symbols[b]
        go = np.flatnonzero(move & same)
        fits = np.ones(len(a), bool)
        fits[move & ~same] = False
        if len(go):
            if level.blocks:
                left_a, left_b = _edge(level, above, a[go], step), _edge(level, above, b[go], step)
                ahead = np.minimum(left_a, left_b)
                fits[go] = left_a == left_b
            else:
                ahead = 1
            a[go] += step * ahead
            b[go] += step * ahead
            if not level.blocks:
                fits[go] = level.symbols[a[go]] == level.symbols[b[go]]
        fallen.append((who[~fits], a[~fits], b[~fits]))
        who, a, b = who[fits], level.parent[a[fits]].astype(np.int64), level.parent[b[fits]].astype(np.int64)
    top = levels[-1].symbols
    while (go := np.flatnonzero(top[a] == top[b])).size:
        a[go] += step
        b[go] += step
    for below, above, (w, fa, fb) in zip(levels[-2::-1], levels[:0:-1], fallen[::-1]):
        # Symbols differ here: look at their first children, and go on below.
        side = 0 if step > 0 else 1
        a, b = above.first[a + side].astype(np.int64) - side, above.first[b + side].astype(np.int64) - side
        who, a, b = np.concatenate((who, w)), np.concatenate((a, fa)), np.concatenate((b, fb))
        go = np.flatnonzero(below.symbols[a] == below.symbols[b])
        while len(go):
            if below.blocks:
                ahead = np.minimum(_edge(below, above, a[go], step), _edge(below, above, b[go], step))
            else:
                ahead = 1
            a[go] += step * ahead
            b[go] += step * ahead
            go = go[below.symbols[a[go]] == below.symbols[b[go]]]
    out = np.empty(len(who), np.int64)
    out[who] = (a - begin[who]) * step
    return out


def _candidates(symbols: np.ndarray, reach: np.ndarray):
    """Chunks of (place, period): neighbouring multiples of a period whose symbols agree. ``reach[q]`` symbols belong to documents of 2q words or more."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0
    for q in range(1, len(reach)):
        grid = symbols[: reach[q] : q]
        hit = np.flatnonzero(grid[1:] == grid[:-1])
        if len(hit):
            parts.append((hit * q, np.full(len(hit), q)))
            total += len(hit)
        if total >= CHUNK or (q == len(reach) - 1 and total):
            at, period = (np.concatenate(x) for x in zip(*parts))
            parts, total = [], 0
            for k in range(0, len(at), CHUNK):
                yield at[k : k + CHUNK], period[k : k + CHUNK]


def runs(symbols: np.ndarray, count: np.ndarray, least: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start, length and smallest period of every run, by document and start; ``symbols`` holds the documents' words in turn."""
    empty = np.empty(0, np.int64)
    long = np.flatnonzero(count >= max(least, 2))
    if not len(long):
        return empty, empty, empty, empty
    # Longest first, so that for each period the documents that can have it come first.
    long = long[np.argsort(-count[long], kind="stable")]
    begin = np.cumsum(count) - count
    n = count[long]
    _, ids = np.unique(symbols[ragged(begin[long], n)], return_inverse=True)
    fences = len(long) + 1
    home = np.cumsum(n + 1) - n  # first word of each document among the fenced symbols
    fenced = np.empty(int(n.sum()) + fences, np.int64)
    fenced[np.concatenate(([0], home + n))] = np.arange(fences)
    fenced[ragged(home, n)] = ids + fences
    levels = grammar(fenced, fences)
    fenced = levels[0].symbols
    q = np.arange(int(n[0]) // 2 + 1)
    within = np.searchsorted(-n, -2 * q, "right")
    reach = np.where(within > 0, (home + n)[within - 1], 0)
    found = [np.empty((0, 3), np.int64)]
    for at, period in _candidates(fenced, reach):
        end = at + period + extend(levels, at, at + period, 1)
        start = at - extend(levels, at - 1, at + period - 1, -1)
        good = end - start >= np.maximum(least, 2 * period)
        found.append(np.column_stack((start, end, period))[good])
        if len(found) > 16:
            found = [_smallest(np.concatenate(found))]
    rows = _smallest(np.concatenate(found))
    doc = np.searchsorted(home, rows[:, 0], "right") - 1
    order = np.lexsort((rows[:, 2], rows[:, 0] - home[doc], long[doc]))
    rows, doc = rows[order], doc[order]
    return long[doc], rows[:, 0] - home[doc], rows[:, 1] - rows[:, 0], rows[:, 2]


def _smallest(rows: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period) with the same start and end, that with the smallest period."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def _process(least: int, order: Order | None):
    def process(batches):
        for part in slices(batches, limit=SLICE_BYTES):
            words = Words(part.column("text"))
            place = np.arange(len(words.starts))
            if order is not None:
                place = np.repeat(words.first[:-1], words.count) + order(part.column("doc_id"), words.count)
            doc, start, length, period = runs(words.hash[place], words.count, least)
            # Words that a run repeats: from its second period on.
            edges = np.zeros(len(place) + 1, np.int64)
            np.add.at(edges, words.first[doc] + start + period, 1)
            np.add.at(edges, words.first[doc] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(edges[:-1]) == 0)
            raw, at, ends = words.bytes, words.starts[place[kept]].tolist(), words.ends[place[kept]].tolist()
            cuts = np.searchsorted(kept, words.first).tolist()
            texts = [b" ".join([raw[s:e] for s, e in zip(at[a:b], ends[a:b])]) for a, b in zip(cuts, cuts[1:])]
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=part.num_rows)))).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], ["start", "length", "period"])
            columns = [part.column("doc_id"), pa.array(words.count.astype(np.int64)), pa.ListArray.from_arrays(offsets, spans), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return process


def collapse_runs(docs: DataFrame, least: int = LEAST_WORDS, order: Order | None = None) -> DataFrame:
    """Per document: doc_id, n_words, runs (start, length, period; by start, then period), collapsed (the words no run repeats).

    A run is a stretch of consecutive words with smallest period q and at least max(``least``, 2q) words that no neighbouring word
    extends. A word is dropped if a run contains it after the run's first q words. ``order`` may put other words of the
    document in each place first. No row moves: one pass, no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_process(least, order), schema)


def run_digests(collapsed: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), and digests of all runs and of the collapsed text."""
    # Greatest length first; ties go to the smallest start, then period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = collapsed.withColumn("_best", best)
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"),
        (-F.col("_best.period")).alias("period"),
        F.expr("_best.length * 1000 div -_best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
