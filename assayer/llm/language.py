"""Language identification with bit-sliced Bloom filters of character trigrams.

Learning counts trigrams of letters (lower case, everything else a blank) by language over all documents that are not held
out. A trigram belongs to a language if it makes up ``MIN_SHARE`` of the language's trigrams and at least ``MIN_RATIO`` of
its largest share in any language; a language then has at most 1 / MIN_SHARE trigrams, so the filter is bounded. The filter is
an array of bit masks with one bit (slice) for each language: the masks at a trigram's slots, combined with AND, give all
languages that contain it. A language's hits in a document, corrected by the false positive rate of its slice, decide.

A document is ``und`` with score 0 if its text is null or has no letter, or if nothing was learned; ties go to the language
first in alphabetical order. Rows without doc_id have remainder 0. Language, source and doc_id are no inputs. Null or repeated rows
are treated like others; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import materialize
from .quality import remainder
from .text import mix, slices

MIN_SHARE = 2e-5
MIN_RATIO = 0.1
PROBES = 3
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Key of the trigram around every letter, and the letters of each text; texts follow each other."""
    texts = [(x or "").lower() for x in column.to_pylist()]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = is_letter()[codes]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    at = np.flatnonzero(letter)
    key = (codes[at - 1] << np.uint64(42)) | (codes[at] << np.uint64(21)) | codes[at + 1]
    end = np.cumsum(size + 1)  # place of the blank after each text
    return key, np.diff(np.searchsorted(at, np.concatenate(([0], end))))


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # slots x words of 64 languages
    false_positive: np.ndarray  # by language

    def slots(self, key: np.ndarray) -> list[np.ndarray]:
        h = mix(key)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)
        return [((low + np.uint64(p) * high) % np.uint64(len(self.masks))).astype(np.int64) for p in range(PROBES)]

    def decide(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        key, letters = trigrams(column)
        n = len(letters)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n)
        masks = None
        for slot in self.slots(key):
            found = self.masks[slot]
            masks = found if masks is None else masks & found
        edge = np.concatenate(([0], np.cumsum(letters)))
        share = np.empty((n, len(self.languages)))
        for j in range(len(self.languages)):
            bit = (masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)
            sums = np.concatenate(([0], np.cumsum(bit.astype(np.int64))))
            share[:, j] = (sums[edge[1:]] - sums[edge[:-1]]) / np.maximum(letters, 1)
        share = np.clip((share - self.false_positive) / (1 - self.false_positive), 0, 1)
        best, total = share.argmax(1), share.sum(1)
        score = np.where(total > 0, share.max(1) / np.where(total > 0, total, 1), 1 / len(self.languages))
        known = letters > 0
        return [self.languages[j] if k else UNKNOWN for j, k in zip(best, known)], np.where(known, score, 0.0)


def _count(batches):
    """Trigram counts by language of the rows of a task."""
    sums: dict[str, list] = {}
    for part in slices(batches):
        key, letters = trigrams(part.column("text"))
        lang = np.array(part.column("lang").to_pylist(), object)
        of = np.repeat(np.arange(len(lang)), letters)
        for name in set(lang.tolist()):
            keys, counts = np.unique(key[(lang == name)[of]], return_counts=True)
            known = sums.setdefault(name, [])
            known.append((keys, counts))
            if len(known) > 16:
                sums[name] = [_merged(known)]
    for name, parts in sums.items():
        keys, counts = _merged(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts.astype(np.int64))],
            ["lang", "gram", "n"],
        )


def _merged(parts) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def train(docs: DataFrame) -> LanguageFilter:
    """Learn the filter from text and lang of all documents that are not held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 3) != 1))
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, gram bigint, n bigint")
    counts = materialize(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    share = counts.join(total, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    found = share.where(F.col("share") >= MIN_SHARE).toPandas()
    found["most"] = found.groupby("gram")["share"].transform("max")
    found = found[found["share"] >= MIN_RATIO * found["most"]]
    languages = sorted(found["lang"].unique())
    size = 1 << 16
    while languages and size < 16 * found["lang"].value_counts().max():
        size *= 2
    masks = np.zeros((size, max(1, -(-len(languages) // 64))), np.uint64)
    out = LanguageFilter(languages, masks, np.zeros(len(languages)))
    for j, name in enumerate(languages):
        for slot in out.slots(found.loc[found["lang"] == name, "gram"].to_numpy(np.int64).astype(np.uint64)):
            masks[slot, j // 64] |= np.uint64(1) << np.uint64(j % 64)
        fill = ((masks[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1)).mean()
        out.false_positive[j] = min(fill**PROBES, 0.99)
    return out


def predict_language(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")

    def decide(batches):
        for part in slices(batches):
            names, score = model.decide(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(score)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(decide, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
