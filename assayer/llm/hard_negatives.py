"""Hard negatives: for each anchor and positive the best-scored rows of other labels inside a window below the positive's score.

Anchors are dealt to blocks of at most ``BLOCK`` by range of a sign code of their vectors, so near anchors meet, and each block
gets its minimum spanning tree (Prim). The other side is cut into shards of about ``SHARD_ROWS`` rows; a task holds one shard and walks
the trees of one block after the other. At a root all rows of the shard are scored. From an anchor to its child, the score of a row
moves by no more than the edge's length times the row's norm, so the parent's interval widened by that bounds the child's score; only rows
whose interval reaches into what is asked for are scored again, exactly. For positives that is all above the least of the best
lower bounds; for negatives the window, its lower end raised to the k-th best lower bound of rows that lie in it for certain. Best rows of
all shards are merged by anchor.

Components are scaled and rounded down to whole numbers; scores are their inner products. Bounds are widened by more than the rounding
of their arithmetic. Products that may pass 2**53 are computed with Python's integers and held within 64 bits.

Rows with a null label, a null vector, or a null or non-finite component take no part; zero and empty vectors do. Of vectors of different
length the missing components count as zero. Ties go to the smaller vec_id, rows without one last; such rows are never anchors. Each of
several equal rows is a candidate, and an anchor, of its own; an anchor is only left out of its own candidates. An empty table gives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import materialize

SHARD_ROWS = 16_384
BLOCK = 256
CODE_BITS = 16
SLACK = 1e-9  # share of the norms' product by which bounds are widened against rounding
EXACT = 2.0**53
LONG = 2**63 - 1


class Tree:
    """Minimum spanning tree of a block of vectors, parents before children."""

    def __init__(self, vectors: np.ndarray):
        n = len(vectors)
        norm = (vectors**2).sum(1)
        self.order = np.zeros(n, np.int64)
        self.parent = np.full(n, -1, np.int64)  # place of the parent in the order
        self.edge = np.zeros(n)
        # The root is the vector nearest to the mean, so the first edges are short.
        at = int(np.argmin(((vectors - vectors.mean(0)) ** 2).sum(1))) if n else 0
        near, of = np.full(n, np.inf), np.zeros(n, np.int64)
        out = np.zeros(n, bool)
        for place in range(n):
            self.order[place], out[at] = at, True
            if place:
                self.parent[place], self.edge[place] = of[at], np.sqrt(((vectors[at] - vectors[self.order[of[at]]]) ** 2).sum())
            away = norm + norm[at] - 2 * (vectors @ vectors[at])
            closer = away < near
            near[closer], of[closer] = away[closer], place
            at = int(np.argmin(np.where(out, np.inf, near)))


def _code(batches):
    """Rows with the signs of CODE_BITS fixed random projections: near vectors often share the code."""
    planes: dict[int, np.ndarray] = {}
    for batch in batches:
        codes = []
        for vector in batch.column("vector"):
            v = vector.values.to_numpy(zero_copy_only=False)
            if len(v) not in planes:
                planes[len(v)] = np.random.default_rng(len(v)).standard_normal((CODE_BITS, len(v)))
            codes.append(int(((planes[len(v)] @ v) > 0) @ (1 << np.arange(CODE_BITS))))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.int32())], [*batch.schema.names, "code"])


def padded(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors as rows of a matrix, with zeros for missing components, cut to ``dim`` if given."""
    size = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    wide = int(size.max()) if len(size) else 0
    if (size == wide).all():
        full = flat.reshape(len(size), wide)
    else:
        full = np.zeros((len(size), wide))
        full[np.arange(wide) < size[:, None]] = flat
    if dim is None or dim == wide:
        return full
    out = np.zeros((len(size), dim))
    out[:, : min(dim, wide)] = full[:, :dim]
    return out


def _plant(batches):
    """Cut the anchors of a partition into blocks and give each block its tree."""
    base = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = blocks = 0

    def planted(table: pa.Table):
        table = table.combine_chunks()
        tree = Tree(padded(table["vector"].chunk(0)))
        n = table.num_rows
        table = table.take(pa.array(tree.order)).select(["uid", "id", "label", "vector"])
        added = [pa.array(np.full(n, base + blocks)), pa.array(np.arange(n)), pa.array(tree.parent), pa.array(tree.edge)]
        for name, column in zip(("block", "place", "parent", "edge"), added):
            table = table.append_column(name, column)
        return table.to_batches()

    for batch in batches:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            fits = min(part.num_rows, BLOCK - size)
            held.append(part.slice(0, fits))
            size += fits
            if size == BLOCK:
                yield from planted(pa.Table.from_batches(held))
                blocks, held, size = blocks + 1, [], 0
            if fits < part.num_rows:
                held.append(part.slice(fits))
                size += part.num_rows - fits
    if held:
        yield from planted(pa.Table.from_batches(held))


class Shard:
    """Rows of one shard with their norms."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.uid = table["uid"].to_numpy()
        self.nameless = table["id"].is_null().to_numpy()
        self.id = np.where(self.nameless, 0, table["id"].fill_null(0).to_numpy())
        self.label = table["label"].to_numpy()
        column = table["vector"]
        self.vectors = padded(column.chunk(0) if column.num_chunks else pa.array([], column.type))
        self.norm = np.sqrt((self.vectors**2).sum(1))
        self.longest = float(self.norm.max()) if len(self.norm) else 0.0
        self.scored = 0

    def score(self, rows: np.ndarray | slice, vector: np.ndarray) -> np.ndarray:
        """Exact inner products as floats (below 2**53) or Python integers."""
        vectors = self.vectors[rows]
        self.scored += len(vectors)
        if self.longest * np.sqrt((vector**2).sum()) < EXACT / 2:
            return vectors @ vector
        whole = [int(x) for x in vector]
        return np.array([sum(int(x) * y for x, y in zip(row, whole)) for row in vectors.tolist()], object)

    def best(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in ``rows`` of the k first: higher scores, then smaller ids."""
        if scores.dtype != object and len(rows) > 4 * k:
            few = np.flatnonzero(scores >= -np.partition(-scores, k - 1)[k - 1])
        else:
            few = np.arange(len(rows))
        at = rows[few]
        order = np.lexsort((self.uid[at], self.id[at], self.nameless[at], -scores[few]))
        return few[order[:k]]


def search_block(shard: Shard, block: dict, wanted) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Walk a block's tree over a shard. ``wanted(shard, place, low, high)`` gives the rows to score, and a function that picks from them."""
    n = len(block["parent"])
    children = np.bincount(block["parent"][1:], minlength=n) if n > 1 else np.zeros(n, int)
    open_: dict[int, list] = {}
    out = []
    for place in range(n):
        vector = np.zeros(shard.vectors.shape[1])
        own = block["vectors"][place][: len(vector)]
        vector[: len(own)] = own
        size = np.sqrt((block["vectors"][place] ** 2).sum())
        parent = block["parent"][place]
        most = shard.norm * size * (1 + SLACK)
        if parent < 0:
            exact = shard.score(slice(None), vector)
            low = high = exact
        else:
            slack = shard.norm * (block["edge"][place] * (1 + SLACK) + SLACK * (size + block["size"][parent])) + SLACK
            low, high = np.maximum(open_[parent][0] - slack, -most), np.minimum(open_[parent][1] + slack, most)
            open_[parent][2] -= 1
            if not open_[parent][2]:
                del open_[parent]
        need, pick = wanted(shard, place, low, high)
        scores = exact[need] if parent < 0 else shard.score(need, vector)
        if children[place]:
            if scores.dtype == object and low.dtype != object:
                low, high = low.astype(object), high.astype(object)
            low, high = (low.copy(), high.copy()) if low is high else (low, high)
            low[need] = high[need] = scores
            open_[place] = [low, high, children[place]]
        out.extend(pick(need, scores))
    return out


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, minus infinity if there are fewer."""
    return np.partition(values, len(values) - k)[len(values) - k] if len(values) >= k else -np.inf


def _positives(block: dict, k: int):
    def wanted(shard: Shard, place: int, low: np.ndarray, high: np.ndarray):
        eligible = np.flatnonzero((shard.label == block["label"][place]) & (shard.uid != block["uid"][place]))
        need = eligible[high[eligible] >= _kth(low[eligible], k)]

        def pick(rows, scores):
            first = shard.best(rows, scores, k)
            return [(place, 0, rows[first], scores[first])] if len(first) else []

        return need, pick

    return wanted


def _negatives(block: dict, k: int, low_share: int, high_share: int):
    def wanted(shard: Shard, place: int, low: np.ndarray, high: np.ndarray):
        other = np.flatnonzero(shard.label != block["label"][place])
        lo, hi = low[other], high[other]
        reached = np.zeros(len(other), bool)
        windows = []
        for positive in block["positives"][place]:
            least, most = -(-low_share * positive // 100), high_share * positive // 100
            windows.append((least, most))
            if least <= most:
                inside = (lo >= least) & (hi <= most)
                reached |= (hi >= max(least, _kth(lo[inside], k))) & (lo <= most)
        need = other[reached]

        def pick(rows, scores):
            out = []
            for number, (least, most) in enumerate(windows):
                fits = np.flatnonzero((scores >= least) & (scores <= most))
                first = fits[shard.best(rows[fits], scores[fits], k)] if len(fits) else fits
                if len(first):
                    out.append((place, number, rows[first], scores[first]))
            return out

        return need, pick

    return wanted


FOUND = pa.schema([("anchor", pa.int64()), ("number", pa.int32()), ("uid", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("rescored", pa.int64())])
FOUND_DDL = "anchor bigint, number int, uid bigint, id bigint, score bigint, rescored bigint"


def _block(table: pa.Table) -> dict:
    table = table.combine_chunks()
    vectors = padded(table["vector"].chunk(0))
    return {
        "uid": table["uid"].to_numpy(), "label": table["label"].to_numpy(), "parent": table["parent"].to_numpy(), "edge": table["edge"].to_numpy(),
        "vectors": vectors, "size": np.sqrt((vectors**2).sum(1)), "positives": table["positives"].to_pylist(),
    }


def _walk(rule):
    """Go through rows sorted by shard, shards' own rows first, then block by block; one shard and one block are held."""

    def walk(batches):
        shard = None
        number = key = None
        held: list[pa.RecordBatch] = []

        def closed():
            nonlocal shard, held
            table, held = pa.Table.from_batches(held), []
            if key[1] < 0:
                shard = Shard(table)
                return
            if shard is None:
                return
            block = _block(table)
            before = shard.scored
            parts = search_block(shard, block, rule(block))
            if parts:
                n = [len(rows) for _, _, rows, _ in parts]
                rows = np.concatenate([rows for _, _, rows, _ in parts])
                scores = [max(-LONG, min(LONG, int(x))) for _, _, _, s in parts for x in s]
                columns = [
                    pa.array(np.repeat(block["uid"][[p for p, _, _, _ in parts]], n)), pa.array(np.repeat(np.array([k for _, k, _, _ in parts], np.int32), n)),
                    pa.array(shard.uid[rows]), pa.array(shard.id[rows], mask=shard.nameless[rows]), pa.array(scores, pa.int64()),
                    pa.array(np.append(shard.scored - before, np.zeros(len(rows) - 1, np.int64))),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema=FOUND)

        for batch in batches:
            shards, blocks = (batch.column(c).to_numpy() for c in ("shard", "block"))
            cuts = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                new = (int(shards[a]), int(blocks[a]))
                if new != key:
                    if key is not None:
                        yield from closed()
                    if new[0] != number:
                        number, shard = new[0], None
                    key = new
                held.append(batch.slice(a, b - a))
        if key is not None:
            yield from closed()

    # ``closed`` is a generator, so that it can hand over rows in between.
    return walk


def _search(rows: DataFrame, trees: DataFrame, shards: int, rule) -> DataFrame:
    """Meet every shard with every block of anchors; anchors are what is sent to each shard, in rows of their own."""
    none = {"block": F.lit(-1).cast("long"), "place": F.lit(0).cast("long"), "parent": F.lit(-1).cast("long"), "edge": F.lit(0.0)}
    none["positives"] = F.array().cast("array<bigint>")
    names = ["shard", *none, "uid", "id", "label", "vector"]
    candidates = rows.withColumns({"shard": F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"), **none}).select(*names)
    sent = trees.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(*names)
    dealt = candidates.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "block", "place")
    return dealt.mapInArrow(_walk(rule), FOUND_DDL)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.col("id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low_share: int = 30,
    high_share: int = 90,
    scale: int = 256,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over the columns vec_id, embedding, label.

    An anchor's positives are its best ``positives`` other rows of the same label; its hard negatives for one of them are the best
    ``negatives`` rows of other labels whose score is ``low_share`` to ``high_share`` percent of the positive's.
    """
    vector = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * scale).cast("double"))
    whole = F.forall(F.col("embedding").cast("array<double>"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole
    chosen = F.coalesce(is_anchor & F.col("vec_id").isNotNull(), F.lit(False))
    plain = rows.where(usable).select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), vector.alias("vector"), chosen.alias("chosen"))
    plain = materialize(plain.withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    shards = max(1, -(-plain.count() // shard_rows))
    rows = plain.drop("chosen")
    anchors = plain.where("chosen").drop("chosen")
    coded = materialize(anchors.mapInArrow(_code, "id bigint, label bigint, vector array<double>, uid bigint, code int"), "negatives-codes")
    parts = max(1, -(-coded.count() // (4 * BLOCK)))
    schema = "uid bigint, id bigint, label bigint, vector array<double>, block bigint, place bigint, parent bigint, edge double"
    trees = materialize(coded.repartitionByRange(parts, "code", "uid").mapInArrow(_plant, schema), "negatives-trees")

    plain_trees = trees.withColumn("positives", F.array().cast("array<bigint>"))
    found = _search(rows, plain_trees, shards, lambda block: _positives(block, positives))
    best = materialize(_first(found, ["anchor"], positives), "positives")
    # At most ``positives`` entries an anchor.
    windows = best.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("positives"))
    asked = trees.join(windows, trees["uid"] == windows["anchor"], "left").drop("anchor")
    asked = asked.withColumn("positives", F.coalesce("positives", F.array().cast("array<bigint>")))
    met = _search(rows, asked, shards, lambda block: _negatives(block, negatives, low_share, high_share))
    kept = _first(met, ["anchor", "number"], negatives)
    named = best.select("anchor", (F.col("rank") - 1).alias("number"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = named.join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    result = kept.select("anchor", "number", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return result.join(named, ["anchor", "number"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
