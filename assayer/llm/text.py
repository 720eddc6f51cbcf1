"""Words of whole texts as numpy arrays, and token ids by word.

A word is a run of bytes other than ``[\\x20\\x09-\\x0D]``. A batch of texts is cut into slices of a few megabytes; within a
slice every step is a handful of array operations, so no Python code runs per word. Words are known by a 64-bit hash.
"""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A slice and its last text stay under 2 MiB as a rule, so the arrays of a task stay under some 16 MB each.
SLICE_BYTES = 7 << 18
HASHED = 1 << 13  # words hashed at once: few enough that their bytes' codes stay in a core's cache

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finisher of the splitmix generator)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``codes[start:end]``: the same codes give the same hash, wherever they stand."""
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


class Words:
    """The words of the texts of one slice. ``first[i]`` is the index of the first word of text i."""

    def __init__(self, column: pa.Array, lower: bool = False):
        raw = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.bytes = b" ".join(raw) + b" "
        self.buffer = np.frombuffer(self.bytes, np.uint8)
        if lower:
            self.buffer = LOWER[self.buffer]
            self.bytes = self.buffer.tobytes()
        self.ends_of_text = np.cumsum(size + 1) - 1
        self.begins_of_text = self.ends_of_text - size
        blank = BLANK[self.buffer]
        before = np.concatenate(([True], blank[:-1]))
        self.starts = np.flatnonzero(before & ~blank)
        self.ends = np.flatnonzero(blank & ~before)
        self.first = np.append(np.searchsorted(self.starts, self.begins_of_text), len(self.starts))
        self.count = np.diff(self.first)
        self._hash: np.ndarray | None = None
        self._distinct: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            out = np.empty(len(self.starts), np.uint64)
            for i in range(0, len(out), HASHED):
                starts, ends = self.starts[i : i + HASHED], self.ends[i : i + HASHED]
                codes = _BYTE[self.buffer[starts[0] : ends[-1]]]
                out[i : i + HASHED] = span_hashes(codes, starts - starts[0], ends - starts[0])
            self._hash = out
        return self._hash

    @property
    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the distinct words, the first place of each, and for each word the number of its hash."""
        if self._distinct is None:
            order = np.argsort(self.hash)
            hashes = self.hash[order]
            new = np.append(True, hashes[1:] != hashes[:-1])[: len(hashes)]
            at = np.flatnonzero(new)
            inverse = np.empty(len(hashes), np.int64)
            inverse[order] = np.cumsum(new) - 1
            self._distinct = hashes[at], np.minimum.reduceat(order, at) if len(at) else order, inverse
        return self._distinct

    @property
    def text(self) -> np.ndarray:
        """Number of the text that each word stands in."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def spelled(self, index: np.ndarray) -> list[str]:
        """Some words as strings; each is read with the blank behind it, so one decoding serves all."""
        if not len(index):
            return []
        length = self.ends[index] - self.starts[index] + 1
        raw = self.buffer[ragged(self.starts[index], length)]
        raw[np.cumsum(length) - 1] = 32
        return raw[:-1].tobytes().decode("utf-8", "replace").split(" ")


def give_back() -> None:
    """Return freed memory to the machine: workers are reused from stage to stage, and the allocators keep what they once had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterable[pa.RecordBatch], *columns: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each part, those of all the columns together, have about ``limit`` bytes; a text is never cut."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False) for c in columns or ("text",))
        part = np.cumsum(size, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
        del batch, size, part
        give_back()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start, start+1, ...`` of every run, one run after the other."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


class WordIds:
    """Token ids of words under an encoder that treats each word alone.

    Words seen before are looked up by hash, so the encoder runs once for each word and worker. Beyond ``limit`` words the
    memory is emptied and filled again; that costs time, not correctness. ``encode`` gives the ids of all words in order, and how
    many each word has.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 1_500_000):
        self.encode, self.limit = encode, limit
        self.few: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.at = np.empty(0, np.int64)
        self.length = np.empty(0, np.int32)
        self.pool = np.empty(0, np.uint16)

    def _learn(self, keys: np.ndarray, spelled: list[str]) -> None:
        flat, length = self.encode(spelled)
        at = len(self.pool) + np.cumsum(length, dtype=np.int64) - length
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.at = np.insert(self.at, where, at)
        self.length = np.insert(self.length, where, length.astype(np.int32))
        self.pool = np.concatenate((self.pool, flat.astype(np.uint16)))

    def entries(self, words: Words) -> np.ndarray:
        """For each word the number of its entry."""
        keys, first, inverse = words.distinct
        if len(self.keys) + len(keys) > self.limit and len(self.keys):
            self.clear()
        at = np.searchsorted(self.keys, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != keys[inside]
        if new.any():
            self._learn(keys[new], words.spelled(first[new]))
            at = np.searchsorted(self.keys, keys)
        return at[inverse]

    def count_few(self, words: list[str]) -> list[int]:
        """Tokens of a handful of words, remembered apart from the arrays, which are dear to extend by a few."""
        new = [w for w in words if w not in self.few]
        if new:
            if len(self.few) > 200_000:
                self.few = {}
                new = words
            self.few.update(zip(new, self.encode(new)[1].tolist()))
        return [self.few[w] for w in words]

    def counts(self, words: Words) -> np.ndarray:
        """Tokens of each word."""
        entry = self.entries(words)  # may replace the arrays it indexes
        return self.length[entry].astype(np.int64)

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and how many each word has."""
        entry = self.entries(words)
        length = self.length[entry].astype(np.int64)
        return self.pool[ragged(self.at[entry], length)], length


def _in_line(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    length = np.fromiter(map(len, ids), np.int32, len(ids))
    return np.fromiter((x for word in ids for x in word), np.uint16, int(length.sum())), length


_encoders: dict[tuple[str, str], WordIds] = {}


def word_bpe(path: str) -> WordIds:
    """Ids of a tokenizer file that splits at white space and drops it; one per worker process."""
    if ("word", path) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        model.no_padding()
        model.no_truncation()
        _encoders["word", path] = WordIds(
            lambda words: _in_line([x.ids for x in model.encode_batch_fast(words, add_special_tokens=False)])
        )
    return _encoders["word", path]


def byte_bpe(path: str, pattern: str) -> WordIds:
    """Ids of a byte-level rank file for each word with one blank before it; one per worker process."""
    if ("byte", path) not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        model = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        begins = np.zeros(max(ranks.values()) + 1, bool)
        begins[[rank for piece, rank in ranks.items() if piece[:1] == b" "]] = True

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            flat = np.array(model.encode_ordinary(" " + " ".join(words)), np.int64)
            cuts = np.flatnonzero(begins[flat])
            if len(cuts) != len(words):  # a word of unusual white space: one call for each word
                return _in_line([model.encode_ordinary(" " + word) for word in words])
            return flat, np.diff(cuts, append=len(flat))

        _encoders["byte", path] = WordIds(encode)
    return _encoders["byte", path]


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
