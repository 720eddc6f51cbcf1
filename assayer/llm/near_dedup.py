"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, verified by weighted Jaccard similarity.

A text is the multiset of its shingles of five words (ASCII lower case); a text of fewer words is one shingle, an empty one none. A
shingle weighs its count times its idf, the mean over its words of log(1 + n / df) with the words' document frequencies over
all documents. Frequencies below ``COMMON`` of the documents count as that share, so the table of the others has at most (words
of a document) / COMMON entries, however many documents there are; that table is broadcast.

Each text draws ``BANDS * ROWS`` samples; texts that agree on all samples of a band meet in its bucket. Equal texts are one node
from the start. A node is compared with the smallest node of each of its buckets. Rounds follow until every bucket is resolved: in a
bucket whose nodes links do not connect yet, the first nodes of its smallest classes lead, meet all nodes behind them, and leave;
each round has ``GROWTH`` times as many leaders. A pair is skipped only if links connect it already, if it was compared before, if
its nodes' similarities to the bucket's smallest node differ by more than a similar pair's can (one minus the similarity is a
metric), or if what either node shares with any open node at all is too little for the weight of both (``reaches``); a node for which
that holds with its whole bucket leaves it. So a bucket of near copies costs a comparison a node, and members of a family that are alike
but not similar, each by edits of its own, leave without being paired; n texts whose differences recur in other texts can still cost up to
n squared over two comparisons. The rounds elect and pair ids, and only the comparisons move texts. A comparison computes the exact
weighted Jaccard similarity of both texts; pairs of at least ``SIMILARITY`` are links, classes are the connected components. Texts
that share no bucket stay where they are: a Bloom filter of the others' nodes, of at most ``FILTER_BITS``, holds them back before
the shuffle, and an exact join follows. Beyond some eight million such nodes more texts shuffle.
What can be missed: a similar pair that meets in no bucket (1 in 1300 at a similarity of 0.8, fewer above).

Null text counts as empty, and all empty texts are one class. Rows without doc_id belong to classes like others; a class is named by its
smallest doc_id (null if it has none). Of repeated rows one is kept. Extra columns are ignored by ``near_groups``, kept by ``drop_near_copies``.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from ..sources.files import materialize
from .ship import small_batches
from .text import Words, mix, ragged, slices, span_hashes

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
BUCKET_NODES = 20_000
COMMON = 1e-3
GROWTH = 8
PARTS = 32
SLACK = 1e-3  # far above the rounding of weights
ROUNDING = 1e-6  # of a weight; far above that of sums
FILTER_SLOTS, FILTER_BITS = 16, 1 << 27
BITMAP_BITS = 8 * 4096  # bits of one bitmap of Spark's bitmap functions


class Weights:
    """Idf of words: those of the table, and one value for all rarer words."""

    def __init__(self, keys: np.ndarray, df: np.ndarray, n: int):
        order = np.argsort(keys)
        self.keys = keys[order]
        self.idf = np.log1p(max(n, 1) / np.maximum(df[order], 1))
        self.rare = float(np.log1p(1 / COMMON))

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(words), self.rare)
        at = np.minimum(np.searchsorted(self.keys, words), len(self.keys) - 1)
        return np.where(self.keys[at] == words, np.minimum(self.idf[at], self.rare), self.rare)


def shingle_sets(words: Words, weights: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, key and weight of the distinct shingles of all texts, in order of the texts."""
    n = np.where(words.count >= SHINGLE, words.count - SHINGLE + 1, np.minimum(words.count, 1))
    start = ragged(words.first[:-1], n)
    text = np.repeat(np.arange(len(n)), n)
    end = np.minimum(start + SHINGLE, words.first[1:][text])
    key = span_hashes(words.hash, start, end)
    idf = np.concatenate(([0.0], np.cumsum(weights(words.hash))))
    idf = (idf[end] - idf[start]) / np.maximum(end - start, 1)
    # One sort: the text's number above, the leading bits of the key below.
    order = np.argsort((text.astype(np.uint64) << np.uint64(44)) | (key >> np.uint64(20)))
    text, key, idf = text[order], key[order], idf[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (key[1:] != key[:-1])))) if len(key) else order
    # One rounding for all texts, so that a shingle weighs the same wherever it stands.
    return text[new], key[new], (np.diff(np.append(new, len(key))) * np.round(idf[new], 4)).astype(np.float32)


def _gamma_table(size: int = 1 << 16) -> np.ndarray:
    """Quantiles of the gamma distribution with shape 2, by bisection."""
    p = (np.arange(size) + 0.5) / size
    low, high = np.zeros(size), np.full(size, 60.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return low.astype(np.float32)


GAMMA = _gamma_table()
LOG_GAMMA = np.log(GAMMA)
UNIT = ((np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.float32)


def signatures(text: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Band keys of each text that has shingles (0 elsewhere): n rows of BANDS values."""
    out = np.zeros((n, BANDS), np.uint64)
    if not len(text):
        return out
    begin = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    owner, size = text[begin], np.diff(np.append(begin, len(text)))
    log_weight = np.log(weight)
    for k in range(BANDS * ROWS):
        x = (key ^ np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        bits = x.view(np.uint16).reshape(-1, 4)  # three numbers of 16 bits from one hash
        r, log_c, beta = GAMMA[bits[:, 3]], LOG_GAMMA[bits[:, 2]], UNIT[bits[:, 1]]
        t = np.floor(log_weight / r + beta)
        value = log_c - r * (t + 1 - beta)
        least = np.minimum.reduceat(value, begin)
        hit = np.flatnonzero(value == np.repeat(least, size))
        of = np.searchsorted(begin, hit, "right") - 1
        first = hit[np.concatenate(([True], of[1:] != of[:-1]))]
        sample = mix(key[first] ^ mix(t[first].astype(np.int64).astype(np.uint64) + np.uint64(k)))
        band = k // ROWS
        out[owner, band] = mix(out[owner, band] * np.uint64(3) + sample + np.uint64(band))
    return out


def _frequencies(batches):
    """Documents of each word in a task."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)

    for part in slices(batches):
        words = Words(part.column("text"), lower=True)
        order = np.argsort(words.hash, kind="stable")
        h, t = words.hash[order], words.text[order]
        once = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.empty(0, bool)
        parts.append(np.unique(h[once], return_counts=True))
        if len(parts) >= 4:
            parts = [merged()]
    if parts:
        keys, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))], ["word", "df"])


def word_weights(docs: DataFrame) -> Weights:
    n = docs.count()
    df = docs.select("text").mapInArrow(_frequencies, "word bigint, df bigint").groupBy("word").agg(F.sum("df").alias("df"))
    table = df.where(F.col("df") >= max(1.0, COMMON * n)).toPandas()
    return Weights(table["word"].to_numpy(np.int64).astype(np.uint64), table["df"].to_numpy(float), n)


def _node(words: Words) -> np.ndarray:
    """A text's words as one number."""
    return span_hashes(words.hash, words.first[:-1], words.first[1:]).astype(np.int64)


def _draw(weights: Weights):
    def draw(batches):
        for part in slices(batches):
            words = Words(part.column("text"), lower=True)
            bands = signatures(*shingle_sets(words, weights), len(words.count)).astype(np.int64)
            listed = pa.ListArray.from_arrays(np.arange(len(bands) + 1, dtype=np.int32) * BANDS, bands.ravel())
            empty = pa.array(words.count == 0)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_node(words)), listed, empty], ["doc_id", "node", "bands", "empty"])

    return draw


def node_filter(nodes: DataFrame, count: int) -> np.ndarray:
    """Bits of a Bloom filter of the nodes, two slots each, as bytes; at most FILTER_BITS bits."""
    bits = BITMAP_BITS
    while bits < min(FILTER_BITS, FILTER_SLOTS * count):
        bits *= 2
    slots = [x.bitwiseAND(bits - 1) for x in (F.col("node"), F.shiftright("node", 32))]
    slots = nodes.select(F.explode(F.array(*slots)).alias("slot"))
    blocks = slots.groupBy((F.col("slot") / BITMAP_BITS).cast("int").alias("block")).agg(
        F.bitmap_construct_agg(F.col("slot") % BITMAP_BITS).alias("bitmap")
    )
    out = np.zeros((bits // BITMAP_BITS, BITMAP_BITS // 8), np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["bitmap"], np.uint8)
    return out.ravel()


def _number_texts(wanted: np.ndarray):
    """Texts by node, without most of those whose node is not in the filter."""
    last = 8 * len(wanted) - 1

    def number(batches):
        for part in slices(batches):
            node = _node(Words(part.column("text"), lower=True))
            hit = np.ones(len(node), bool)
            for slot in (node & last, (node >> 32) & last):
                hit &= (wanted[slot >> 3] >> (slot & 7) & 1).astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(node[hit]), part.column("text").filter(pa.array(hit))], ["node", "text"])

    return number


def _shingles(weights: Weights):
    """Part, key and weight of the shingles of texts by node."""

    def shingles(batches):
        for part in slices(batches):
            text, key, weight = shingle_sets(Words(part.column("text"), lower=True), weights)
            node = part.column("node").to_numpy(zero_copy_only=False)[text]
            columns = [pa.array(x) for x in (node, (key % np.uint64(PARTS)).astype(np.int32), key.astype(np.int64), weight.astype(float))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "part", "key", "weight"])

    return shingles


def _part_weights(weights: Weights):
    """Weight of the shingles of each part, of texts by node."""

    def part_weights(batches):
        for part in slices(batches):
            text, key, weight = shingle_sets(Words(part.column("text"), lower=True), weights)
            at = text * PARTS + (key % np.uint64(PARTS)).astype(np.int64)
            sums = np.bincount(at, weight, part.num_rows * PARTS)
            listed = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * PARTS, sums)
            yield pa.RecordBatch.from_arrays([part.column("node"), listed], ["node", "weights"])

    return part_weights


def reaches(texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """(node, weight, shared, ceiling): what bounds a node's similarity to any other of ``texts``.

    Shingles that no other text has cannot be shared; ``shared`` is the weight of the rest, in ``PARTS`` parts by key. Two texts share at
    most the sum over the parts of the smaller weight, and similar texts share similarity / (1 + similarity) of both weights; so no
    text that weighs more than the ceiling is similar to the node's. One grouping by shingle, combined before its shuffle.
    """
    held = texts.mapInArrow(_shingles(weights), "node bigint, part int, key bigint, weight double")
    held = held.groupBy("key").agg(F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("node", "part", "weight")])
    own = held.where("n = 1").groupBy("node", "part").agg(F.sum("weight").alias("own"))
    own = own.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "own"))).alias("own"))
    rows = texts.mapInArrow(_part_weights(weights), "node bigint, weights array<double>").join(own, "node", "left")
    shared = F.transform("weights", lambda w, i: w - F.coalesce(F.col("own")[i], F.lit(0.0)))
    rows = rows.select("node", _total("weights").alias("weight"), shared.alias("shared"))
    return rows.withColumn("ceiling", (1 + 1 / similarity) * _total("shared") - (1 - ROUNDING) * F.col("weight"))


def _total(parts) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda total, x: total + x)


def _verify(weights: Weights, similarity: float):
    def verify(batches):
        for part in slices(batches, "text", "other_text"):
            a, b = (shingle_sets(Words(part.column(c), lower=True), weights) for c in ("text", "other_text"))
            n = part.num_rows
            text, key, weight = (np.concatenate(x) for x in zip(a, b))
            order = np.lexsort((key, text))
            text, key, weight = text[order], key[order], weight[order].astype(float)
            twice = np.flatnonzero((text[1:] == text[:-1]) & (key[1:] == key[:-1]))
            both = np.bincount(text[twice], np.minimum(weight[twice], weight[twice + 1]), n)
            either = np.bincount(text, weight, n) - both
            alike = both / np.where(either > 0, either, 1)
            good = pa.array(alike >= similarity - 1e-9)
            names = ["node", "leader"]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], good, pa.array(alike)], [*names, "linked", "similarity"])

    return verify


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node number reached over the edges (a, b); nodes without edges are left out.

    Each step moves every node to the least neighbour of its least neighbour; only the edges between the nodes that are then left go on,
    so an edge is joined again only as long as its component is not one node yet.
    """
    labels = None
    while True:
        down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = materialize(down.distinct(), "edges")
        if labels is not None and edges.isEmpty():
            return labels
        both = edges.union(edges.select("b", "a"))
        near = both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component"))
        step = near.join(near.toDF("component", "root"), "component").select("node", F.col("root").alias("component"))
        step = materialize(step, "steps")
        labels = step if labels is None else materialize(moved(labels, step), "labels")
        edges = edges.join(step.toDF("a", "to_a"), "a").join(step.toDF("b", "to_b"), "b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))


def moved(labels: DataFrame, step: DataFrame) -> DataFrame:
    """The labels after their components went where ``step`` has them go."""
    joined = labels.join(step.toDF("component", "next"), "component", "left")
    return joined.select("node", F.coalesce("next", "component").alias("component"))


def merged(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """The classes (node, component) after more edges (a, b), which are followed between whole classes; no older edge is needed."""
    for end in ("a", "b"):
        ends = edges.join(classes.toDF(end, "class"), end, "left")
        edges = ends.withColumn(end, F.coalesce("class", end)).drop("class")
    step = components(edges)
    return materialize(moved(classes, step).union(step.join(classes, "node", "left_anti")), "classes")


def linked_classes(docs: DataFrame, nodes: DataFrame, weights: Weights, similarity: float = SIMILARITY) -> DataFrame:
    """(node, component) of the nodes that verified pairs link, enough of them to connect each bucket's similar texts."""
    spark = docs.sparkSession
    nodes = nodes.where("not empty").select("node", "bands")
    one = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", F.xxhash64("band", "value").alias("key"))
    busy = one.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1").select("key", "leader")
    pairs = materialize(one.join(materialize(busy, "busy"), "key").select("node", "leader").distinct(), "pairs")
    wanted = materialize(pairs.select("node").distinct(), "wanted")
    n_wanted = wanted.count()
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.mapInArrow(_number_texts(node_filter(wanted, n_wanted)), "node bigint, text string")
    texts = texts.groupBy("node").agg(F.min("text").alias("text")).join(wanted, "node", "left_semi")
    table = f"near_texts_{uuid.uuid4().hex}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_wanted // BUCKET_NODES))
    # Laid out by node once, so that the comparisons do not shuffle the texts again.
    stored = texts.write.format("parquet").bucketBy(buckets, "node").option("path", scratch_dir(spark, "texts"))
    stored.saveAsTable(table)
    texts = spark.table(table)

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("node <> leader")
        # Leaders' texts are written apart: a hot leader then meets its nodes by a shuffle that Spark can split.
        leaders = pairs.select(F.col("leader").alias("node")).distinct()
        other = materialize(texts.join(leaders, "node", "left_semi").toDF("leader", "other_text"), "leader-texts")
        columns = pairs.join(texts, "node").join(other, "leader").select("node", "leader", "text", "other_text")
        return materialize(columns.mapInArrow(_verify(weights, similarity), "node bigint, leader bigint, linked boolean, similarity double"), "tested")

    def linked(rows: DataFrame) -> DataFrame:
        return rows.where("linked").select(F.col("node").alias("a"), F.col("leader").alias("b"))

    def unresolved(members: DataFrame) -> DataFrame:
        """The members of buckets that hold several classes."""
        members = materialize(members, "members")
        split = members.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low <> high").select("key")
        return members.join(materialize(split, "split"), "key", "left_semi")

    kept = ["key", "node", "similarity", "weight", "shared", "ceiling"]
    # First each node of a bucket with the smallest of all nodes there, often the same for many buckets.
    first = tested(pairs)
    classes = components(linked(first))
    done = first.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader"))
    # Then rounds over the nodes that have not led their bucket.
    members = one.join(busy, "key").join(first, ["node", "leader"]).select("key", "node", "similarity")
    leaders, bounds = 1, None
    while True:
        members = unresolved(members.join(classes, "node", "left").select(*members.columns, F.coalesce("component", "node").alias("class")))
        if bounds is None:
            bounds = materialize(reaches(texts.join(members.select("node").distinct(), "node", "left_semi"), weights, similarity), "reaches")
            members = members.join(bounds, "node")
        # Nodes that can be similar to none of their bucket leave it.
        least = members.groupBy("key").agg(F.min("weight").alias("least"), F.max("ceiling").alias("most"))
        members = members.join(materialize(least, "least"), "key").where("least <= ceiling and weight <= most").drop("least", "most")
        members = unresolved(members)
        sizes = materialize(members.groupBy("key", "class").agg(F.count("*").alias("n")), "sizes")
        place = F.struct("n", "class", "node").alias("place")
        members = materialize(members.join(sizes, ["key", "class"]).select(*kept, place), "open")
        if members.isEmpty():
            break
        leaders *= GROWTH
        first_places = F.row_number().over(Window.partitionBy("key").orderBy("place"))
        ahead = members.withColumn("rank", first_places).where(F.col("rank") <= leaders).drop("rank")
        ahead = materialize(ahead.toDF("key", *(f"leader_{c}" for c in ahead.columns[1:])).withColumnRenamed("leader_node", "leader"), "leaders")
        met = members.join(ahead, "key").where("place > leader_place and place.class <> leader_place.class")
        met = met.where(F.abs(F.col("similarity") - F.col("leader_similarity")) <= 1 - similarity + SLACK)
        most = _total(F.zip_with("shared", "leader_shared", lambda x, y: F.least(x, y)))
        met = met.where("weight <= leader_ceiling and leader_weight <= ceiling")
        met = met.where((1 + 1 / similarity) * most >= (1 - ROUNDING) * (F.col("weight") + F.col("leader_weight")))
        met = met.select(F.greatest("node", "leader").alias("node"), F.least("node", "leader").alias("leader")).distinct()
        new = tested(materialize(met.join(done, ["node", "leader"], "left_anti"), "pairs"))
        classes = merged(classes, linked(new))
        done = done.union(new.select("node", "leader"))
        members = members.join(ahead.select("key", F.col("leader").alias("node")), ["key", "node"], "left_anti").select(*kept)
    spark.sql(f"DROP TABLE {table}")
    return classes


def _classes(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (node, class) of all nodes that are linked to another."""
    small_batches(docs.sparkSession)
    weights = word_weights(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn = docs.select("doc_id", "text").mapInArrow(_draw(weights), f"doc_id {kind}, node bigint, bands array<bigint>, empty boolean")
    drawn = materialize(drawn, "drawn")
    nodes = drawn.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("bands").alias("bands"), F.min("empty").alias("empty"))
    return drawn.select("doc_id", "node"), linked_classes(docs, materialize(nodes, "nodes"), weights, similarity)


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept."""
    rows, classes = _classes(docs, similarity)
    same = rows.groupBy("doc_id", "node").agg(F.count("*").alias("copies")).join(classes, "node", "left")
    same = materialize(same.withColumn("class", F.coalesce("component", "node")), "same")
    size = same.groupBy("class").agg(
        F.min("doc_id").alias("class_id"), F.sum("copies").alias("class_size"),
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("first"),
    )
    joined = same.join(materialize(size, "sizes"), "class").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("node") == F.col("first.node"))
    return joined.select("doc_id", "class_id", "class_size", (first & (F.col("copy") == 1)).alias("kept"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, all columns kept: the one with the smallest doc_id. Only rows of classes shuffle whole."""
    rows, classes = _classes(docs, similarity)
    several = rows.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    busy = materialize(several.join(classes, "node", "full").withColumn("class", F.coalesce("component", "node")).select("node", "class"), "busy")
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text = names[docs.columns.index("text")]
    id_ = names[docs.columns.index("doc_id")]

    def number(batches):
        for part in slices(batches, text):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(_node(Words(part.column(text), lower=True)))], [*names, "node"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    numbered = plain.mapInArrow(number, f"{schema}, node bigint").join(busy, "node", "left")
    alone = numbered.where("class is null").select(*names)
    row = F.struct(*names)
    order = F.struct(F.col(id_).isNull(), F.col(id_), F.col("node"))
    first = numbered.where("class is not null").groupBy("class").agg(F.min_by(row, order).alias("row")).select("row.*")
    return alone.unionByName(first).toDF(*docs.columns)
