"""Mixing sources to target weights by iterative proportional fitting (raking).

Tokens (words) are summed over all documents by source, language and topic. Raking finds weights of these cells that meet
the wanted share of each source, each language and each topic at once; a document is then kept with the probability of its
cell, calibrated so that the expected tokens are ``budget`` times all tokens. The draw is a hash of doc_id, so it is the same in
every run and for every copy of a row.

Every source, language and topic has a share of its own, however many there are. A cell table of at most ``LOCAL_CELLS`` cells and
``LOCAL_BYTES`` of names is raked on the driver and broadcast; a larger one stays distributed: the same rounds are aggregations and
joins of it, and the documents are joined with it by a shuffle.

Topics come from the text by the words of ``TOPICS``, the first topic that has one. A null source or language is a category of
its own, null text has no tokens and keeps the probability of its cell, a null doc_id is drawn as the empty id. Cells without
tokens get probability 1. Columns of the documents with the names of the results are replaced.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize

TOPICS = (
    ("legal", ("icense", "ICENSE", "opyright", "OPYRIGHT", "arranty", "ARRANTY")),
    ("technical", ("://", "password", "PASSWORD", "secret", "SECRET", "api_key", "API_KEY")),
    ("contact", ("@",)),
)
LOCAL_CELLS, LOCAL_BYTES = 100_000, 16 << 20
DIMENSIONS = ("source", "lang", "topic")
KEYS = [f"__{d}" for d in DIMENSIONS]
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS, CLOSE = 200, 1e-10


def topic_of(text: Column) -> Column:
    found = F.lit("general")
    for name, words in reversed(TOPICS):
        found = F.when(reduce(or_, [text.contains(w) for w in words]), name).otherwise(found)
    return found


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def draw(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the md5 of the id."""
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(tokens: np.ndarray, codes: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Weight of each cell so that weight x tokens meets the targets of every dimension in turn until all hold."""
    weight = np.ones(len(tokens))
    for _ in range(ROUNDS):
        worst = 0.0
        for d, target in enumerate(targets):
            have = np.bincount(codes[:, d], weight * tokens, len(target))
            factor = np.where(have > 0, target / np.where(have > 0, have, 1), 1.0)
            weight *= factor[codes[:, d]]
            worst = max(worst, float(np.abs(factor - 1).max()))
        if worst < CLOSE:
            break
    return weight


def calibrate(tokens: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities proportional to weight, at most 1, with sum(p * tokens) = budget * sum(tokens)."""
    p = np.ones(len(tokens))
    free = tokens > 0
    wanted = budget * tokens.sum()
    while free.any():
        left = wanted - tokens[~free].sum()
        mass = (weight[free] * tokens[free]).sum()
        scale = left / mass if mass else 0.0
        p[free] = scale * weight[free]
        over = free & (p >= 1)
        if not over.any():
            break
        p[over], free = 1.0, free & ~over
    return np.clip(p, 0, 1)


def _category(value: str | None) -> str:
    return "?" if value is None else f"={value}"


def _local_weights(cells: DataFrame, budget: float, targets: dict[str, dict[str | None, float]] | None) -> DataFrame:
    """Weight and probability of each cell, raked on the driver."""
    table = cells.toPandas().sort_values(KEYS).reset_index(drop=True)
    tokens = table["tokens"].to_numpy(float)
    codes, wanted = np.empty((len(table), len(DIMENSIONS)), np.int64), []
    for i, d in enumerate(DIMENSIONS):
        codes[:, i], names = pd.factorize(table[f"__{d}"], sort=True)
        have = np.bincount(codes[:, i], tokens, len(names))
        share = have ** POWERS[d] * (have > 0)
        if targets and d in targets:
            given = {_category(c): x for c, x in targets[d].items()}
            share = np.array([given.get(n, 0.0) for n in names]) * (have > 0)
        wanted.append(tokens.sum() * share / share.sum() if share.sum() else have)
    weight = rake(tokens, codes, wanted) if len(table) else np.empty(0)
    table["weight"], table["probability"] = weight, calibrate(tokens, weight, budget)
    kinds = ", ".join(f"{k} string" for k in KEYS)
    values = [tuple(r) for r in table[[*KEYS, "weight", "probability"]].itertuples(index=False)]
    return cells.sparkSession.createDataFrame(values, f"{kinds}, weight double, probability double")


def _wanted(cells: DataFrame, dimension: str, total: float, targets: dict[str, dict[str | None, float]] | None) -> DataFrame:
    """Wanted tokens of each category of a dimension."""
    key = f"__{dimension}"
    have = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("have"))
    share = F.pow("have", F.lit(POWERS[dimension]))
    if targets and dimension in targets:
        given = [(_category(c), float(x)) for c, x in targets[dimension].items()]
        have = have.join(cells.sparkSession.createDataFrame(given, f"{key} string, given double"), key, "left")
        share = F.coalesce("given", F.lit(0.0))
    shares = materialize(have.select(key, "have", F.when(F.col("have") > 0, share).otherwise(0.0).alias("share")), "shares")
    whole = shares.agg(F.sum("share")).first()[0]
    return shares.select(key, (F.col("share") * (total / whole) if whole else F.col("have")).alias("wanted"))


def _far_weights(cells: DataFrame, budget: float, targets: dict[str, dict[str | None, float]] | None) -> DataFrame:
    """As ``_local_weights``, by aggregations and joins of the cell table."""
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    wanted = {d: _wanted(cells, d, total, targets) for d in DIMENSIONS}
    cells = cells.select(*KEYS, "tokens", F.lit(1.0).alias("weight"))
    for _ in range(ROUNDS):
        cells = cells.withColumn("worst", F.lit(0.0))
        for d, target in wanted.items():
            have = cells.groupBy(f"__{d}").agg(F.sum(F.col("weight") * F.col("tokens")).alias("have"))
            factor = F.when(F.col("have") > 0, F.col("wanted") / F.col("have")).otherwise(1.0)
            factors = have.join(target, f"__{d}").select(f"__{d}", factor.alias("factor"))
            weight, worst = F.col("weight") * F.col("factor"), F.greatest("worst", F.abs(F.col("factor") - 1))
            cells = cells.join(factors, f"__{d}").select(*KEYS, "tokens", weight.alias("weight"), worst.alias("worst"))
            cells = materialize(cells, "raked")
        if (cells.agg(F.max("worst")).first()[0] or 0.0) < CLOSE:
            break
    # Capped are the cells with the largest weights, so one scale tells them.
    free = F.col("tokens") > 0
    while True:
        mass, capped, most = cells.agg(
            F.sum(F.when(free, F.col("weight") * F.col("tokens"))), F.sum(F.when(~free, F.col("tokens"))), F.max(F.when(free, F.col("weight")))
        ).first()
        scale = max(0.0, budget * total - (capped or 0)) / mass if mass else 0.0
        if most is None or scale * most < 1:
            break
        free = free & (F.col("weight") * F.lit(scale) < 1)
    probability = F.when(free, F.col("weight") * F.lit(scale)).otherwise(1.0)
    return cells.select(*KEYS, "weight", probability.alias("probability"))


def mixing_weights(
    docs: DataFrame, budget: float = 0.5, targets: dict[str, dict[str | None, float]] | None = None, local_cells: int = LOCAL_CELLS
) -> DataFrame:
    """The documents with topic, tokens, weight, probability and sampled.

    ``targets`` gives the wanted shares by dimension and category, None for null; a missing dimension gets shares by tokens ** ``POWERS``.
    """
    own = [c for c in docs.columns if c not in ("topic", "tokens", "weight", "probability", "sampled")]
    category = lambda c: F.concat(F.when(c.isNull(), "?").otherwise("="), F.coalesce(c, F.lit("")))
    rows = docs.select(*[F.col(f"`{c}`") for c in own])
    rows = rows.withColumns({"topic": topic_of(F.coalesce(F.col("text"), F.lit(""))), "tokens": token_count(F.col("text"))})
    keyed = rows.withColumns({f"__{d}": category(F.col(d)) for d in DIMENSIONS})
    cells = materialize(keyed.groupBy(*KEYS).agg(F.sum("tokens").alias("tokens")), "cells")
    n, size = cells.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.concat(*KEYS))), F.lit(0))).first()
    if n <= local_cells and size <= LOCAL_BYTES:
        weights = F.broadcast(_local_weights(cells, budget, targets))
    else:
        weights = materialize(_far_weights(cells, budget, targets), "weights")
    joined = keyed.join(weights, KEYS).drop(*KEYS)
    return joined.withColumn("sampled", draw(F.col("doc_id")) < F.col("probability"))


def sample_mixture(docs: DataFrame, budget: float = 0.5, targets: dict[str, dict[str | None, float]] | None = None) -> DataFrame:
    """The sampled documents with the columns they came with."""
    keep = {c: F.col(f"`{c}`").alias(f"__own_{c}") for c in docs.columns if c in ("topic", "tokens", "weight", "probability", "sampled")}
    mixed = mixing_weights(docs.select("*", *keep.values()), budget, targets).where("sampled")
    return mixed.select(*[F.col(f"`__own_{c}`").alias(c) if c in keep else F.col(f"`{c}`") for c in docs.columns])
