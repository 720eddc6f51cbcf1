"""Removal of passages that repeat across documents, with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one document. Every word covered by a window that also starts in a document with a smaller
doc_id is removed. A window repeats where two suffixes of the corpus share their first 50 words, so it is an internal
node of that depth in the suffix tree of all documents; the tree is never built whole:

1.  Each window is filed under one of its suffixes, the one whose ``PREFIX``-word prefix has the least hash. Windows of a document with the
    same such suffix form a span, about 70 words long, that is known by its prefix and a hash of its words. Equal windows
    have equal prefixes, so only spans of one prefix can share a window.
2.  Prefixes that occur in one document only have no internal node and are dropped. Equal spans are one leaf with the smallest doc_id.
    A prefix with a single leaf is done: all its windows belong to that document.
3.  The words of the other leaves are fetched, one copy each, and dealt out by prefix to groups of about ``GROUP_WINDOWS``
    windows, which fit into memory. A group names the suffixes at depths 1, 2, 4, ... 32 and 50 by doubling: equal names at depth
    50 are an internal node of its subtree, and the smallest doc_id below the node owns the windows.
4.  A prefix with more than ``MAX_LEAVES`` leaves (a hot passage with very many surroundings) is lengthened to the whole 50 words: its windows
    are rows of an aggregation by window, which may be of any size.

Spans are judged on the input. Words are compared by 64-bit hashes, windows by sequences of these. Null text has no words; rows
with a null doc_id stay whole and remove nothing; rows with equal doc_id never remove each other's words. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize
from .text import Words, mix, ragged, slices, span_hashes

WINDOW, PREFIX = 50, 8
GROUP_WINDOWS = 400_000
MAX_LEAVES = 100_000


def spans_of(words: Words, window: int = WINDOW, prefix: int = PREFIX):
    """Document, first word (in the document), number of windows, prefix and content hash of every span."""
    h, count = words.hash, np.maximum(words.count - window + 1, 0)
    none = np.empty(0, np.int64)
    if not count.sum():
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    at = np.arange(len(h) - prefix + 1)
    key = span_hashes(h, at, at + prefix)
    reach = window - prefix + 1
    least, width = at, 1
    while width < reach:  # place of the least key among the next ``width`` prefixes, the first of equal ones
        step = min(width, reach - width)
        a, b = least[:-step], least[step:]
        least, width = np.where(key[a] <= key[b], a, b), width + step
    start = ragged(words.first[:-1], count)
    anchor, doc = least[start], np.repeat(np.arange(len(count)), count)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))))
    n = np.diff(np.append(new, len(start)))
    begin = start[new]
    content = span_hashes(h, begin, begin + n + window - 1)
    return doc[new], begin - words.first[doc[new]], n, key[anchor[new]], content


def _spans(window: int, prefix: int):
    def find(batches):
        for part in slices(batches):
            doc, at, n, key, content = spans_of(Words(part.column("text")), window, prefix)
            columns = [
                part.column("doc_id").take(pa.array(doc)), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)),
                pa.array(key.astype(np.int64)), pa.array(content.astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "at", "n", "prefix", "content"])

    return find


def _fetch(window: int):
    """The word hashes of wanted spans; a span whose words differ from its hash (another row of that id) is left out."""

    def fetch(batches):
        for part in slices(batches):
            words = Words(part.column("text"))
            h = words.hash
            wanted = part.column("wanted")
            size = np.diff(wanted.offsets.to_numpy())
            spans = wanted.flatten()
            at, n, content = (spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n", "content"))
            doc = np.repeat(np.arange(len(size)), size)
            begin, length = words.first[doc] + at, n + window - 1
            good = begin + length <= words.first[doc + 1]
            good[good] = span_hashes(h, begin[good], (begin + length)[good]).astype(np.int64) == content[good]
            raw = h.tobytes()
            blobs = [raw[8 * b : 8 * (b + m)] for b, m in zip(begin[good].tolist(), length[good].tolist())]
            columns = [
                part.column("doc_id").take(pa.array(doc[good])), spans.field("prefix").filter(pa.array(good)), pa.array(content[good]),
                pa.array(n[good].astype(np.int32)), pa.array(blobs, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "prefix", "content", "n", "words"])

    return fetch


def _named(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Number of each distinct pair."""
    return np.unique(first * (int(second.max()) + 1) + second, return_inverse=True)[1]


def _subtrees(window: int):
    def owners(group: pa.Table) -> pa.Table:
        """The windows of each leaf in runs with one owner: the smallest doc_id at their node."""
        n = group["n"].to_numpy().astype(np.int64)
        length = n + window - 1
        h = np.frombuffer(b"".join(group["words"].to_pylist()), np.uint64)
        name, depth = np.unique(h, return_inverse=True)[1], 1
        while depth < window:  # the last step overlaps, so the depth is exactly the window
            step = min(depth, window - depth)
            name, depth = _named(name[:-step], name[step:]), depth + step
        leaf_begin = np.cumsum(length) - length
        at = ragged(leaf_begin, n)  # windows that lie within their leaf
        node, leaf = name[at], np.repeat(np.arange(len(n)), n)
        doc = group["doc_id"].to_numpy()[leaf]
        smallest = np.full(int(node.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(smallest, node, doc)
        owner = smallest[node]
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (leaf[1:] != leaf[:-1]))))
        first = np.cumsum(n) - n
        return pa.table(
            {
                "prefix": group["prefix"].take(pa.array(leaf[new])),
                "content": group["content"].take(pa.array(leaf[new])),
                "off": pa.array((new - first[leaf[new]]).astype(np.int32)),
                "len": pa.array(np.diff(np.append(new, len(at))).astype(np.int32)),
                "owner": pa.array(owner[new]),
            }
        )

    return owners


def _windows(window: int):
    """One row for each window of a leaf, known by two hashes."""

    def cut(batches):
        for part in batches:
            for i in range(part.num_rows):
                h = np.frombuffer(part["words"][i].as_py(), np.uint64)
                at = np.arange(part["n"][i].as_py())
                one, two = span_hashes(h, at, at + window), span_hashes(mix(h ^ np.uint64(0x5DEECE66D)), at, at + window)
                same = [pa.array([part[c][i].as_py()] * len(at), pa.int64()) for c in ("doc_id", "prefix", "content")]
                columns = [*same, pa.array(at.astype(np.int32)), pa.array(one.astype(np.int64)), pa.array(two.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "prefix", "content", "off", "one", "two"])

    return cut


def _apply(window: int, with_text: bool):
    def remove(batches):
        for part in slices(batches):
            words = Words(part.column("text"))
            marks = part.column("marks")
            size = np.diff(marks.offsets.to_numpy()) * np.asarray(marks.is_valid())
            spans = marks.flatten()
            at, n, content, off, len_ = (
                spans.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n", "content", "off", "len")
            )
            doc = np.repeat(np.arange(len(size)), size)
            begin, end = words.first[doc] + at, words.first[doc] + at + n + window - 1
            good = end <= words.first[doc + 1]
            if good.any():
                good[good] = span_hashes(words.hash, begin[good], end[good]).astype(np.int64) == content[good]
            edge = np.zeros(len(words.starts) + 1, np.int64)
            np.add.at(edge, (begin + off)[good], 1)
            np.add.at(edge, (begin + off + len_ + window - 1)[good], -1)
            gone = np.cumsum(edge[:-1]) > 0
            sums = np.concatenate(([0], np.cumsum(gone)))
            removed = sums[words.first[1:]] - sums[words.first[:-1]]
            kept = []
            for i, r in enumerate(removed.tolist()):
                own = words.bytes[words.begins_of_text[i] : words.ends_of_text[i]].split()
                kept.append(b" ".join(compress(own, ~gone[words.first[i] : words.first[i + 1]]) if r else own))
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            columns = [part.column("doc_id"), pa.array(words.count), pa.array(removed), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array([x.decode("utf-8", "replace") for x in kept], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return remove


def repeat_marks(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, max_leaves: int = MAX_LEAVES, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """Runs of windows to remove: doc_id, at, n, content (the span they lie in), off, len."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    spans = rows.mapInArrow(_spans(window, prefix), "doc_id bigint, at int, n int, prefix bigint, content bigint")
    spans = materialize(spans, "spans")
    shared = spans.groupBy("prefix").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("prefix")
    spans = spans.join(materialize(shared, "shared"), "prefix", "left_semi")
    leaves = spans.groupBy("prefix", "content").agg(
        F.min(F.struct("doc_id", "at")).alias("first"), F.max("n").alias("n"), F.count("*").alias("copies")
    )
    leaves = materialize(leaves, "leaves")
    size = leaves.groupBy("prefix").agg(F.count("*").alias("leaves"))
    alone = leaves.where("copies > 1").join(size.where("leaves = 1"), "prefix", "left_semi").select(
        "prefix", "content", F.lit(0).alias("off"), F.col("n").alias("len"), F.col("first.doc_id").alias("owner")
    )
    several = materialize(size.where("leaves > 1"), "several")
    branching = leaves.join(several, "prefix").select("prefix", "content", "first.doc_id", "first.at", "n", "leaves")
    wanted = branching.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "prefix", "content")).alias("wanted"))
    contents = rows.join(wanted, "doc_id").mapInArrow(
        _fetch(window), "doc_id bigint, prefix bigint, content bigint, n int, words binary"
    )
    contents = materialize(contents.join(several, "prefix"), "contents")
    total = contents.where(F.col("leaves") <= max_leaves).agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-total // group_windows))
    runs = "prefix bigint, content bigint, off int, len int, owner bigint"
    dealt = contents.where(F.col("leaves") <= max_leaves).withColumn("group", F.pmod(F.xxhash64("prefix"), F.lit(groups)).cast("int"))
    small = dealt.groupBy("group").applyInArrow(_subtrees(window), runs)
    cut = contents.where(F.col("leaves") > max_leaves).mapInArrow(
        _windows(window), "doc_id bigint, prefix bigint, content bigint, off int, one bigint, two bigint"
    )
    node = cut.groupBy("one", "two").agg(F.min("doc_id").alias("owner"))
    large = cut.join(node, ["one", "two"]).select("prefix", "content", "off", F.lit(1).alias("len"), "owner")
    owned = materialize(alone.unionByName(small).unionByName(large), "owned")
    return spans.join(owned, ["prefix", "content"]).where(F.col("owner") < F.col("doc_id")).select("doc_id", "at", "n", "content", "off", "len")


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept_text."""
    marks = repeat_marks(docs, window, **sizes)
    marks = materialize(marks.groupBy("doc_id").agg(F.collect_list(F.struct("at", "n", "content", "off", "len")).alias("marks")), "marks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(marks, "doc_id", "left")
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text
    return rows.mapInArrow(_apply(window, with_text), schema)
