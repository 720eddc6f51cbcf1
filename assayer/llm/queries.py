"""Registered queries of the subpackage, over the whole tables, and SQL where it can state the result."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import (
    exact_dedup, hard_negatives, language, lm, mixing, near_dedup, neighbours, packing, periodic, quality, substring, token_counts, warc,
)
from .ship import ship

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(_table(spark, sf_dir, "documents"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"))


def example_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document that follow from its own columns: a replacement, a removal, and words added at the end."""
    n = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    third = F.floor(n / 3).cast("long")
    name = F.concat_ws(" ", "lang", "source")

    def edit(start, stop, insert):
        return F.struct(start.alias("start"), stop.alias("stop"), insert.alias("insert"))

    end = n + 1000
    edits = [edit(third, third + 12, F.concat(F.lit("x "), name)), edit(2 * third, 2 * third + 40, F.lit("")), edit(end, end, F.concat(F.lit(" from "), name))]
    return docs.withColumn("edits", F.array(*edits))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(example_edits(_table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.predict_language(docs, language.train(docs))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_weights(_table(spark, sf_dir, "documents")).select(
        "doc_id", "source", "lang", "topic", "tokens", "weight", "probability", "sampled"
    )


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"))


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_warc(_table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))
    return warc.page_records(archives)


def planted_order(doc_id: pa.Array, count: np.ndarray) -> np.ndarray:
    """Every tenth document, by crc32 of its id, repeats a stretch of its words to its end; the others keep their order."""
    places = []
    for name, n in zip(doc_id.to_pylist(), count.tolist()):
        i = np.arange(n)
        h = None if name is None else zlib.crc32(str(name).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            i = np.where(i < a, i, a + (i - a) % p)
        places.append(i)
    return np.concatenate([np.empty(0, np.int64), *places])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.collapse_runs(_table(spark, sf_dir, "documents"), order=planted_order))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Query]:
    own = (
        op1_lm_scoring, op2_near_dedup, op3_token_counts, op4_quality, op5_exact_dedup,
        op6_packing, op7_language, op8_mixing, op9_neighbours, op10_substring,
        op11_warc, op12_periodic_runs, op13_hard_negatives,
    )
    return {f.__name__: f for f in own}


EXACT_SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""


REPEATS_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
),
w AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM d),
g AS (
  SELECT r, doc_id, i, array_to_string(list(word) OVER ahead, ' ') AS span, count(*) OVER ahead AS n FROM w
  WINDOW ahead AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)
),
f AS (SELECT md5(span) AS span, min(doc_id) AS first FROM g WHERE n = 50 GROUP BY 1),
b AS (SELECT g.r, g.i FROM g JOIN f ON md5(g.span) = f.span WHERE g.n = 50 AND f.first < g.doc_id),
c AS (
  SELECT w.r, w.i, w.word, count(b.i) OVER (PARTITION BY w.r ORDER BY w.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0 AS covered
  FROM w LEFT JOIN b ON w.r = b.r AND w.i = b.i
),
k AS (
  SELECT r, count(*) FILTER (covered) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT covered) AS kept FROM c GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

# Five hexadecimal digits are four digits of base 32.
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INT), 5) AS BIGINT)) AS parts FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((parts[i // 4 + 1] >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM b
"""

NEGATIVES_SQL = """
WITH r AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
s AS (
  SELECT a.uid AS a, a.vec_id AS anchor_id, c.uid AS c, c.vec_id AS vec_id, a.label = c.label AS same,
    CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM r a, r c WHERE a.vec_id % 100 = 0 AND a.uid <> c.uid
),
p AS (
  SELECT a, anchor_id, vec_id AS positive_id, c AS positive, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, c) <= 5
),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.positive ORDER BY s.score DESC, s.vec_id NULLS LAST, s.c) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": EXACT_SQL, "op10_substring": REPEATS_SQL, "op11_warc": WARC_SQL, "op13_hard_negatives": NEGATIVES_SQL}
