"""Token counts that follow edits.

A document is kept as a segment tree: its leaves hold ``LEAF_WORDS`` words each (pre-tokens of a tokenizer that splits at white space), a
node holds the characters and tokens below it. An edit replaces the characters from ``start`` to ``stop`` by ``insert``; its
place is found by going down the character sums. Only the words that the edit touches, and the word on either side that
it may join, are encoded again; the leaves involved get new counts and the sums above them are updated. The counts of all other
words are those found before.

Edits apply in order, offsets count characters of the text as the edits before left it and are cut to its length; a null
start, stop or insert counts as 0, start and the empty text. Null text counts as empty, null or no edits leave the count. Repeated
rows are counted each. Extra columns are ignored.

Trees can be kept: ``store_trees`` encodes each text once and writes its leaves, ``edit_trees`` applies a table of edits to them and
``tree_counts`` reads the totals. An edit is placed by the character counts of the leaves alone; only the leaves it touches are read with
their text, and only the words in it are encoded again. An edit joins the leaves it spans, a leaf that grows beyond two leaves is split.
Every row of the documents has its own tree; edits of a doc_id apply to each of its trees, those of no or an unknown doc_id to none. An
empty table gives no trees.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize
from .packing import TOKENIZER
from .text import WordIds, Words, slices, tokenizer_path, word_bpe

LEAF_WORDS = 32
WORD = re.compile("[^\x20\x09-\x0D]+")
EDITS = "array<struct<start:bigint,stop:bigint,insert:string>>"
GAP = 1 << 24  # numbers between stored leaves, room for splits
LEAF = "leaf bigint, n_chars bigint, n_words bigint, n_tokens bigint, text string, places binary"


class TokenTree:
    """Segment tree over the leaves of one text; ``sums[1]`` is the root, leaf i is ``sums[size + i]``."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, tokens: np.ndarray, model: WordIds):
        self.raw, self.model = raw, model
        self.word = starts, ends, tokens
        cut = starts[::LEAF_WORDS].copy() if len(starts) else np.zeros(1, np.int64)
        cut[0] = 0
        self.cut = np.append(cut, len(raw))
        self.changed: dict[int, tuple[str, list[tuple[int, int, int]]]] = {}
        self.encoded = 0
        codes = np.frombuffer(raw, np.uint8)
        chars = np.concatenate(([0], np.cumsum((codes & 0xC0) != 0x80)))
        total = np.concatenate(([0], np.cumsum(tokens)))
        first = np.minimum(np.arange(len(cut) + 1) * LEAF_WORDS, len(starts))
        self.first = first
        self._add_up(np.diff(chars[self.cut]), np.diff(total[first]))

    @classmethod
    def of_leaves(cls, chars: list[int], tokens: list[int], leaves: dict[int, tuple[str, list[tuple[int, int, int]]]], model: WordIds | None) -> TokenTree:
        """The tree of stored leaves, of which only ``leaves`` are here with their text and words."""
        tree = cls.__new__(cls)
        tree.model, tree.changed, tree.encoded = model, dict(leaves), 0
        tree._add_up(chars, tokens)
        return tree

    def _add_up(self, chars, tokens) -> None:
        self.leaves = len(chars)
        self.size = 1 << max(0, (self.leaves - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        leaf = self.sums[self.size : self.size + self.leaves]
        leaf[:, 0], leaf[:, 1] = chars, tokens
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    @property
    def characters(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf(self, i: int) -> tuple[str, list[tuple[int, int, int]]]:
        """Text of a leaf and the place and tokens of its words, in characters."""
        if i not in self.changed:
            raw = self.raw[self.cut[i] : self.cut[i + 1]]
            chars = np.cumsum((np.frombuffer(raw + b" ", np.uint8) & 0xC0) != 0x80) - 1
            a, b = self.first[i], self.first[i + 1]
            starts, ends, tokens = (x[a:b] for x in self.word)
            at = chars[starts - self.cut[i]].tolist(), chars[ends - self.cut[i]].tolist(), tokens.tolist()
            self.changed[i] = raw.decode("utf-8", "replace"), list(zip(*at))
        return self.changed[i]

    def locate(self, place: int) -> tuple[int, int]:
        """Leaf that holds a character, and its place there; the end of the text is in the last leaf with characters."""
        node = 1
        while node < self.size:
            node *= 2
            if place >= self.sums[node, 0] and self.sums[node + 1, 0]:
                place -= int(self.sums[node, 0])
                node += 1
        return node - self.size, place

    def _count(self, i: int, chars: int, tokens: int) -> None:
        node = self.size + i
        self.sums[node] = chars, tokens
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]

    def _set(self, i: int, text: str, words: list[tuple[int, int, int]]) -> None:
        self.changed[i] = text, words
        self._count(i, len(text), sum(w[2] for w in words))

    def span(self, start: int, stop: int) -> tuple[int, int, int, int, int]:
        """Start and stop cut to the text, the first leaf an edit touches, the place of its start there, and the last leaf."""
        start = min(max(start, 0), self.characters)
        stop = min(max(stop, start), self.characters)
        a, at = self.locate(max(start - 1, 0))  # the word before may join
        return start, stop, a, at + min(start, 1), self.locate(stop)[0]

    def touch(self, start: int, stop: int, insert: str) -> range:
        """The leaves that an edit touches; only the characters are counted anew."""
        start, stop, a, _, b = self.span(start, stop)
        chars = int(self.sums[self.size + a : self.size + b + 1, 0].sum())
        for i in range(a + 1, b + 1):
            self._count(i, 0, 0)
        self._count(a, chars - (stop - start) + len(insert), 0)
        return range(a, b + 1)

    def edit(self, start: int, stop: int, insert: str) -> None:
        start, stop, a, at, b = self.span(start, stop)
        text, words = "", []
        for i in range(a, b + 1):
            part, own = self.leaf(i)
            words += [(x + len(text), y + len(text), n) for x, y, n in own]
            text += part
        end = at + stop - start
        new = text[:at] + insert + text[end:]
        before = [w for w in words if w[1] < at]
        after = [w for w in words if w[0] > end]
        low = before[-1][1] if before else 0
        shift = len(insert) - (end - at)
        high = after[0][0] + shift if after else len(new)
        middle = list(WORD.finditer(new, low, high))
        self.encoded += len(middle)
        again = [(w.start(), w.end(), n) for w, n in zip(middle, self.model.count_few([w.group() for w in middle]))]
        self._set(a, new, before + again + [(x + shift, y + shift, t) for x, y, t in after])
        for i in range(a + 1, b + 1):
            self._set(i, "", [])


def _plain(edits: list[dict | None] | None) -> list[tuple[int, int, str]]:
    """Edits without nulls."""
    given = [(e, e["start"] or 0) for e in edits or () if e is not None]
    return [(start, start if e["stop"] is None else e["stop"], e["insert"] or "") for e, start in given]


def count_tokens(docs: DataFrame, edits: str | None = "edits", tokenizer: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` with n_words, n_tokens, n_edits, n_tokens_edited, n_chars_edited and n_encoded.

    ``edits`` names the column of edits of a row (see ``EDITS``). n_encoded counts the words encoded again.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)
    column = F.col(edits) if edits else F.lit(None)
    rows = docs.select(*keep, F.col("text").alias("__text"), column.cast(EDITS).alias("__edits"))
    names = ["n_words", "n_tokens", "n_edits", "n_tokens_edited", "n_chars_edited", "n_encoded"]

    def count(batches):
        model = word_bpe(path)
        for part in slices(batches, "__text"):
            words = Words(part.column("__text"))
            tokens = model.counts(words)
            out = []
            wanted = part.column("__edits").to_pylist()
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                begin, end = words.begins_of_text[i], words.ends_of_text[i]
                raw = words.bytes[begin:end]
                tree = TokenTree(raw, words.starts[a:b] - begin, words.ends[a:b] - begin, tokens[a:b], model)
                n = tree.tokens
                for e in _plain(wanted[i]):
                    tree.edit(*e)
                out.append((b - a, n, len(wanted[i] or ()), tree.tokens, tree.characters, tree.encoded))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *columns], [*keep, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(count, f"{schema}, " + ", ".join(f"{n} bigint" for n in names))


def _edits_by_document(edits: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("seq", "start", "stop", "insert")))
    return edits.groupBy("doc_id").agg(F.transform(ordered, lambda e: F.struct(e["start"], e["stop"], e["insert"])).cast(EDITS).alias("edits"))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Join a table of edits (doc_id, seq, start, stop, insert) to its documents as the column ``edits``."""
    return docs.join(_edits_by_document(edits), "doc_id", "left")


def _leaf_row(number: int, text: str, words: list[tuple[int, int, int]]) -> tuple:
    return number, len(text), len(words), sum(w[2] for w in words), text, np.array(words, "<i8").tobytes()


def _leaf_columns(rows: list[tuple]) -> list[pa.Array]:
    kinds = [*[pa.int64()] * 4, pa.string(), pa.binary()]
    return [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]


def store_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(tree, doc_id, leaf, n_chars, n_words, n_tokens, text, places): the leaves of the tree of every row of ``docs``, written and read back.

    ``leaf`` orders the leaves of a tree; ``places`` holds start, end and tokens of the words of a leaf.
    """
    path = tokenizer or tokenizer_path(TOKENIZER)

    def store(batches):
        model = word_bpe(path)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 33
        for part in slices(batches):
            words = Words(part.column("text"))
            tokens = model.counts(words)
            rows, of = [], []
            for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                begin, end = words.begins_of_text[i], words.ends_of_text[i]
                tree = TokenTree(words.bytes[begin:end], words.starts[a:b] - begin, words.ends[a:b] - begin, tokens[a:b], model)
                rows += [_leaf_row(j * GAP, *tree.leaf(j)) for j in range(tree.leaves)]
                of += [i] * tree.leaves
            columns = [pa.array(np.array(of, np.int64) + number), part.column("doc_id").take(pa.array(of, pa.int64()))]
            number += part.num_rows
            yield pa.RecordBatch.from_arrays([*columns, *_leaf_columns(rows)], ["tree", "doc_id", *(c.split()[0] for c in LEAF.split(", "))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return materialize(docs.select("doc_id", "text").mapInArrow(store, f"tree bigint, doc_id {kind}, {LEAF}"), "trees")


def _touched(batches):
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            tree = TokenTree.of_leaves([x["n_chars"] for x in row["shape"]], [0] * len(row["shape"]), {}, None)
            hit = sorted({i for e in _plain(row["edits"]) for i in tree.touch(*e)})
            rows += [(row["tree"], row["shape"][i]["leaf"]) for i in hit]
        trees, leaves = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(trees, pa.int64()), pa.array(leaves, pa.int64())], ["tree", "leaf"])


def _split(text: str, words: list[tuple[int, int, int]], low: int, high: int) -> list[tuple]:
    """A leaf as rows numbered from ``low`` and below ``high``; it stays whole while it is small or the numbers have no room."""
    n = -(-len(words) // LEAF_WORDS)
    if len(words) <= 2 * LEAF_WORDS or high - low < n:
        return [_leaf_row(low, text, words)]
    cut = [0, *(words[i][0] for i in range(LEAF_WORDS, len(words), LEAF_WORDS)), len(text)]
    step = (high - low) // n
    parts = [[(x - cut[i], y - cut[i], t) for x, y, t in words[i * LEAF_WORDS : (i + 1) * LEAF_WORDS]] for i in range(n)]
    return [_leaf_row(low + i * step, text[cut[i] : cut[i + 1]], part) for i, part in enumerate(parts)]


def edit_trees(trees: DataFrame, edits: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """The trees of ``store_trees`` after a table of edits (doc_id, seq, start, stop, insert), applied by seq."""
    path = tokenizer or tokenizer_path(TOKENIZER)
    by = materialize(_edits_by_document(edits.where("doc_id is not null")), "edits")
    leaves = trees.join(by.select("doc_id"), "doc_id", "left_semi").groupBy("tree").agg(
        F.min("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("leaf", "n_chars", "n_tokens"))).alias("shape")
    )
    shapes = materialize(leaves.join(by, "doc_id").select("tree", "shape", "edits"), "shapes")
    touched = materialize(shapes.mapInArrow(_touched, "tree bigint, leaf bigint"), "touched")
    schema = trees.select("tree", "doc_id", *(c.split()[0] for c in LEAF.split(", "))).schema

    def apply(read: pa.Table, shape: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if read.num_rows:
            wanted = shape.to_pylist()[0]
            numbers = [x["leaf"] for x in wanted["shape"]]
            at = {n: i for i, n in enumerate(numbers)}
            here = {at[r["leaf"]]: (r["text"], np.frombuffer(r["places"], "<i8").reshape(-1, 3).tolist()) for r in read.to_pylist()}
            tree = TokenTree.of_leaves([x["n_chars"] for x in wanted["shape"]], [x["n_tokens"] for x in wanted["shape"]], here, word_bpe(path))
            for e in _plain(wanted["edits"]):
                tree.edit(*e)
            ends = [*numbers[1:], numbers[-1] + GAP]
            rows = [r for i in sorted(here) if tree.changed[i][0] for r in _split(*tree.changed[i], numbers[i], ends[i])]
            if not tree.characters:
                rows = [_leaf_row(numbers[0], "", [])]
        first = [pa.array([read[c][0].as_py()] * len(rows) if rows else [], read.schema.field(c).type) for c in ("tree", "doc_id")]
        return pa.Table.from_arrays([*first, *_leaf_columns(rows)], names=schema.names)

    read = trees.join(touched, ["tree", "leaf"], "left_semi")
    new = read.groupBy("tree").cogroup(shapes.groupBy("tree")).applyInArrow(apply, schema)
    return materialize(trees.join(touched, ["tree", "leaf"], "left_anti").select(schema.names).union(new), "trees")


def tree_counts(trees: DataFrame) -> DataFrame:
    """doc_id, n_chars, n_words and n_tokens of every tree; no text is read."""
    sums = [F.sum(c).alias(c) for c in ("n_chars", "n_words", "n_tokens")]
    return trees.groupBy("tree").agg(F.min("doc_id").alias("doc_id"), *sums).select("doc_id", "n_chars", "n_words", "n_tokens")
