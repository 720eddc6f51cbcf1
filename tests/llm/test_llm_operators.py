"""Operators against brute force on the smallest documents, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayer.llm import exact_dedup, language, lm, mixing, near_dedup, neighbours, packing, quality, substring, token_counts
from assayer.llm.queries import EXACT_SQL, example_edits
from assayer.llm.text import Words, byte_bpe


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


@pytest.fixture(scope="module")
def rows(documents):
    return documents.toPandas()


@pytest.fixture(scope="module")
def bpe():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_language_model_base_score_is_exact(documents, rows):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    words = {i: [*t.encode().translate(lower).split(), 0] for i, t in zip(rows.doc_id, rows.text)}
    count = Counter(w for i, own in words.items() if not held(i, 7, 2) for w in own)
    n, v = sum(count.values()), len(count)
    found = lm.score_documents(documents).toPandas()
    assert sorted(found.doc_id) == sorted(words)
    for r in found.itertuples():
        own = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)
        assert r.held_out == held(r.doc_id, 7, 2) and r.score < 0


def test_base_score_of_a_word_in_every_slice(shipped, monkeypatch):
    """One word is a third of all words; texts without words, of one word only, and of words that training lacks stand in many slices."""
    texts = ["The rare%d the x%d  THE tail" % (i, i % 7) for i in range(60)] + [None, "", " \n", "the", "the " * 5000, "RARE3 unseen"]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    cut = lm.slices
    monkeypatch.setattr(lm, "slices", lambda batches, limit=200: cut(batches, limit=min(limit, 200)))
    words = {i: [*(t or "").lower().split(), 0] for i, t in enumerate(texts)}
    count = Counter(w for i, own in words.items() if not held(i, 7, 2) for w in own)
    n, v = sum(count.values()), len(count)
    found = lm.score_documents(docs).toPandas()
    assert sorted(found.doc_id) == sorted(words)
    for r in found.itertuples():
        own = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(1)
    classes, within = lm._class_tables(rng.integers(0, 50, lm.PAD).astype(float), rng.random(lm.PAD) < 0.5)
    assert np.bincount(classes[: lm.PAD], np.exp(within[: lm.PAD]), lm.CLASSES) == pytest.approx(np.ones(lm.CLASSES), rel=1e-4)


def test_language_model_learns_from_every_window(documents, monkeypatch):
    import pyarrow as pa

    path, pattern = lm.tokenizer_path(lm.TOKENIZER), public_tokenizers.PATTERN
    some = documents.orderBy("doc_id").limit(40)
    model, _ = lm.train(some, path, pattern)
    batch = pa.RecordBatch.from_arrays([pa.array([r.text for r in some.select("text").collect()])], ["text"])
    _, ids, tokens = lm._ids(batch, path, pattern)
    used = []
    gradient = lm.Model.gradient
    monkeypatch.setattr(lm.Model, "gradient", lambda self, ids, rows, targets: used.append(len(ids)) or gradient(self, ids, rows, targets))
    assert model.descend(lm._windows([batch], path, pattern)) == sum(used) == len(lm.blocks_of(ids, tokens).inputs)


def _lm_model(rng, size=1.0):
    """A model with random tables of 50 ids, small enough for plain loops; ``size`` stretches its weights."""
    row = np.full(lm.PAD + 1, 50, np.int32)
    row[:50] = np.arange(50)
    weights = {k: (size * rng.normal(0, 0.3, s)).astype(np.float32) for k, s in lm.SHAPES.items()}
    classes = np.zeros(lm.PAD + 1, np.int64)
    classes[:50] = rng.integers(0, lm.CLASSES, 50)
    near = rng.normal(-4, 1, (51, lm.CLASSES)).astype(np.float32)
    embedding = rng.normal(0, 1, (51, lm.WIDTH)).astype(np.float32)
    none = np.empty(0, np.int64)
    begins = np.ones(lm.PAD + 1, bool)
    return lm.Model(classes, np.zeros(lm.PAD + 1, np.float32), row, near, np.ones_like(near), none, none.astype(np.float32), embedding, begins, none, weights)


def _lm_loss(model, ids, rows, targets):
    """Mean log loss of the classes, written out in double precision, query by query."""
    w = {k: x.astype(float) for k, x in model.weights.items()}
    losses = []
    for line, own, wanted in zip(ids, rows, targets):
        x = model.embedding[own].astype(float)
        for i in range(lm.BLOCK):
            if wanted[i] == lm.PAD:
                continue
            at = lm.BLOCK + i
            seen = [j for j in range(at + 1) if line[j] != lm.PAD]
            s = np.array([(x[at] @ w["q"]) @ (x[j] @ w["k"]) + w["far"][at - j] for j in seen])
            p = np.exp(s - s.max())
            logits = model.near[own[at]] + (p / p.sum()) @ (x[seen] @ w["v"]) @ w["out"]
            logits = np.clip(logits, -lm.BOUND, lm.BOUND)
            losses.append(np.log(np.exp(logits).sum()) - logits[model.classes[wanted[i]]])
    return np.mean(losses)


@pytest.mark.parametrize("size", [1.0, 6.0])
def test_language_model_attends_as_written_out(size):
    """Gradients agree with differences of the plain loss; with large weights the logits leave the range of plain exponentials."""
    rng = np.random.default_rng(3)
    model = _lm_model(rng, size)
    model.weights["out"] /= np.float32(size * size)  # keeps the classes off their bound
    ids = rng.integers(0, 50, (6, 2 * lm.BLOCK))
    targets = np.concatenate((ids[:, lm.BLOCK + 1 :], rng.integers(0, 50, (6, 1))), 1)
    ids[0, : lm.BLOCK] = lm.PAD
    ids[1, lm.BLOCK + 5 :], targets[1, 5:] = lm.PAD, lm.PAD
    rows = model.rows(ids)
    found = model.gradient(ids, rows, targets)
    for name, shape in lm.SHAPES.items():
        for _ in range(4):
            place = tuple(int(rng.integers(n)) for n in shape)
            kept, step, sides = model.weights[name].copy(), 1e-3, []
            for sign in (1, -1):
                model.weights[name] = kept.astype(float)
                model.weights[name][place] += sign * step
                sides.append(_lm_loss(model, ids, rows, targets))
            model.weights[name] = kept
            assert found[name][place] == pytest.approx((sides[0] - sides[1]) / (2 * step), rel=2e-2, abs=2e-4)


def test_places_of_numbers():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    asked = np.concatenate((keys[::3], rng.integers(-(1 << 62), 1 << 62, 5000)))
    hit, at = lm.Places(keys)(asked)
    assert hit.tolist() == np.flatnonzero(np.isin(asked, keys)).tolist() and (keys[at] == asked[hit]).all()
    assert all(len(x) == 0 for x in lm.Places(keys[:0])(asked))


def test_new_words_are_encoded_as_one_text():
    """The ids of all new words come as one array and equal those of each word alone; a word of unusual white space is no exception."""
    import base64

    import pyarrow as pa
    import tiktoken

    path, pattern = lm.tokenizer_path(lm.TOKENIZER), public_tokenizers.PATTERN
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["One two\tthree\n\nnaïve 日本語 x1y2z3 " + "ab" * 400, None, "", " \n", "a\u00a0b \u2003 \u3000c don't  end", "two one"]
    for own in (texts[:1], texts):
        words = Words(pa.array(own, pa.string()), lower=True)
        each = [w.decode() for t in own for w in (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
        assert words.spelled(np.arange(len(words.starts))) == each
        keys, first, inverse = words.distinct
        assert keys.tolist() == sorted(set(words.hash.tolist())) and (keys[inverse] == words.hash).all()
        assert first.tolist() == [words.hash.tolist().index(k) for k in keys.tolist()]
        flat, length = byte_bpe(path, pattern).encode(each)
        wanted = [plain.encode_ordinary(" " + w) for w in each]
        assert flat.tolist() == [i for ids in wanted for i in ids] and length.tolist() == [len(ids) for ids in wanted]
        ids, length = byte_bpe(path, pattern).ids(words)
        assert ids.tolist() == flat.tolist() and length.tolist() == [len(ids) for ids in wanted]
    assert Words(pa.array([None, ""], pa.string())).distinct[0].tolist() == []


def test_rows_are_looked_up_in_parts(monkeypatch):
    """States of words are found a part at a time, in parts that begin with a word, and are those of all ids at once."""
    rng = np.random.default_rng(5)
    model = _lm_model(rng)
    model.begins[:50] = rng.random(50) < 0.4
    lines = rng.integers(0, 50, (40, 2 * lm.BLOCK))
    lines[7:12] = np.flatnonzero(~model.begins)[0]  # a word longer than several parts
    on, states = lm.words_so_far(lines.ravel(), model.begins)
    model.states = np.unique(states)[::3]
    model.near = np.concatenate((model.near, np.zeros((len(model.states), lm.CLASSES), np.float32)))
    model.rest = np.ones_like(model.near)
    wanted = model.row[lines.ravel()]
    for i, state in zip(on, states):
        if state in model.states:
            wanted[i] = 51 + model.states.tolist().index(state)
    sizes, whole = [], lm.words_so_far
    monkeypatch.setattr(lm, "words_so_far", lambda ids, begins: sizes.append(len(ids)) or whole(ids, begins))
    monkeypatch.setattr(lm, "PART", 20)
    assert model.rows(lines).ravel().tolist() == wanted.tolist()
    assert len(sizes) > 20 and sum(sizes) == lines.size
    ids = rng.integers(0, 50, 90)
    monkeypatch.setattr(lm, "PART", 1000)
    whole_sum = model.inside(model.rows(ids), ids)
    monkeypatch.setattr(lm, "PART", 20)
    assert model.inside(model.rows(ids), ids).tolist() == whole_sum.tolist() and len(model.inside(ids[:0], ids[:0])) == 0


def test_common_words_are_not_joined(shipped, monkeypatch):
    """Words that make up more than their share are looked up in tasks; the others are sent once for all slices that go together."""
    texts = [" ".join([f"common{j}" for j in range(40)] * 3 + [f"rare{i % 9}"]) for i in range(120)]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    monkeypatch.setattr(lm, "MIN_SHARE", 5e-3)
    sent, kept = [], lm.materialize

    def counted(rows, name):
        out = kept(rows, name)
        if name == "words":
            sent.append(out.where("place >= 0").count())
        return out

    monkeypatch.setattr(lm, "materialize", counted)
    words = {i: [*t.split(), 0] for i, t in enumerate(texts)}
    count = Counter(w for i, own in words.items() if not held(i, 7, 2) for w in own)
    n, v = sum(count.values()), len(count)
    for r in lm.score_documents(docs).collect():
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words[r.doc_id]), rel=1e-9)
    assert sent == [9]


def test_near_groups_agree_with_all_pairs(documents, rows):
    shingles = {}
    for i, t in zip(rows.doc_id, rows.text):
        w = t.lower().split()
        shingles[i] = set(zip(*[w[j:] for j in range(5)])) if len(w) >= 5 else {tuple(w)}
    index, shared = defaultdict(list), Counter()
    for i, own in shingles.items():
        for s in own:
            shared.update((j, i) for j in index[s])
            index[s].append(i)
    alike = {p: n / (len(shingles[p[0]]) + len(shingles[p[1]]) - n) for p, n in shared.items()}
    found = near_dedup.near_groups(documents).toPandas().set_index("doc_id").class_id
    assert len(found) == len(rows)
    for (a, b), j in alike.items():  # idf moves the weighted similarity a little off the plain one
        if j >= 0.87:
            assert found[a] == found[b]
    linked = {i for p, j in alike.items() if j >= 0.7 for i in p}
    assert all(found[i] == i for i in shingles if i not in linked)


def test_near_groups_find_pairs_hidden_in_a_family(shipped):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(240)]

    def changed(words, n):
        words = list(words)
        for i in rng.choice(240, n, replace=False):
            words[i] = base[rng.integers(240)]
        return words

    forms = [changed(base, 4) for _ in range(400)]
    forms += [changed(forms[i], 4) for i in range(0, 400, 10)]
    docs = shipped.createDataFrame([(i, " ".join(w)) for i, w in enumerate(forms)], "doc_id bigint, text string")
    weights = near_dedup.word_weights(docs)
    import pyarrow as pa

    text, key, weight = near_dedup.shingle_sets(near_dedup.Words(pa.array([" ".join(w) for w in forms]), lower=True), weights)
    _, column = np.unique(key, return_inverse=True)
    table = np.zeros((len(forms), column.max() + 1))
    table[text, column] = weight
    label = np.arange(len(forms))
    for i, own in enumerate(table):
        alike = np.minimum(table, own).sum(1) / np.maximum(table, own).sum(1) >= near_dedup.SIMILARITY
        label[np.isin(label, label[alike])] = label[alike].min()
    wanted = [int(np.flatnonzero(label == x).min()) for x in label]
    found = near_dedup.near_groups(docs).toPandas().set_index("doc_id").class_id
    assert len(set(wanted)) > 100
    assert [found[i] for i in range(len(forms))] == wanted


def test_near_groups_compare_few_pairs_of_a_hub_family(shipped, monkeypatch):
    """Texts around one text, many too far from it to be similar: edits of their own, cut ends, and pairs hidden among the far ones."""
    import pyarrow as pa

    rng, n, fresh = np.random.default_rng(11), 700, iter(range(10**6))
    base = [f"w{i}" for i in range(150)]

    def changed(words, edits):
        words = list(words)
        for i in rng.choice(len(words), edits, replace=False):
            words[i] = f"own{next(fresh)}"
        return words

    forms = [changed(base, int(rng.integers(0, 7))) for _ in range(n)]
    forms += [changed(base, 3)[: int(rng.integers(110, 150))] for _ in range(60)]
    forms += [changed(forms[i], 1) for i in range(0, n, 14)]
    docs = shipped.createDataFrame([(i, " ".join(w)) for i, w in enumerate(forms)], "doc_id bigint, text string")
    text, key, weight = near_dedup.shingle_sets(
        near_dedup.Words(pa.array([" ".join(w) for w in forms]), lower=True), near_dedup.word_weights(docs)
    )
    total = np.bincount(text, weight, len(forms))
    _, column, times = np.unique(key, return_inverse=True, return_counts=True)
    held = times[column] > 1  # the others are shared by no two texts
    _, column = np.unique(key[held], return_inverse=True)
    table = np.zeros((len(forms), column.max() + 1))
    table[text[held], column] = weight[held]
    label = np.arange(len(forms))
    for i, own in enumerate(table):
        both = np.minimum(table, own).sum(1)
        alike = both / (total + total[i] - both) >= near_dedup.SIMILARITY
        alike[i] = True
        label[np.isin(label, label[alike])] = label[alike].min()
    wanted = [int(np.flatnonzero(label == x).min()) for x in label]
    compared, kept = [], near_dedup.materialize

    def counted(rows, name):
        rows = kept(rows, name)
        if name == "tested":
            compared.append(rows.count())
        return rows

    monkeypatch.setattr(near_dedup, "materialize", counted)
    found = near_dedup.near_groups(docs).toPandas().set_index("doc_id").class_id
    assert len(set(wanted)) > 100
    assert [found[i] for i in range(len(forms))] == wanted
    assert sum(compared[1:]) < 10 * len(forms), compared


def smallest_reached(edges):
    label = {x: x for e in edges for x in e}
    while True:
        low = [min(label[a], label[b]) for a, b in edges]
        if all(label[a] == label[b] for a, b in edges):
            return label
        for (a, b), x in zip(edges, low):
            label[a], label[b] = min(label[a], x), min(label[b], x)


def test_components_and_later_edges(spark):
    rng = np.random.default_rng(3)
    path = [int(x) for x in rng.permutation(200)]
    edges = list(zip(path, path[1:])) + [(1000, int(x)) for x in rng.integers(1001, 1100, 150)]
    edges += [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (120, 2)) if a != b]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    found = near_dedup.components(frame(edges + edges[:50]))
    assert {r.node: r.component for r in found.collect()} == smallest_reached(edges)
    for cut in (0, 150, len(edges)):
        later = near_dedup.merged(near_dedup.components(frame(edges[:cut])), frame(edges[cut:]))
        rows = later.collect()
        assert len({r.node for r in rows}) == len(rows)
        assert {r.node: r.component for r in rows} == smallest_reached(edges)


def test_each_link_of_a_family_is_followed_once(shipped, monkeypatch):
    """Links of earlier rounds are not joined again by the later ones: rounds grow with a family, its links with the family times the rounds."""
    rng, fresh = np.random.default_rng(2), iter(range(10**6))
    base = [f"w{i}" for i in range(150)]

    def changed(words, edits):
        words = list(words)
        for i in rng.choice(len(words), edits, replace=False):
            words[i] = f"own{next(fresh)}"
        return words

    forms = [changed(base, int(rng.integers(0, 7))) for _ in range(200)]
    forms += [changed(forms[i], 1) for i in range(0, 200, 4)]
    docs = shipped.createDataFrame([(i, " ".join(w)) for i, w in enumerate(forms)], "doc_id bigint, text string")
    given, linked, whole, kept = [], [], near_dedup.components, near_dedup.materialize

    def followed(edges):
        given.append(edges.count())
        return whole(edges)

    def counted(rows, name):
        rows = kept(rows, name)
        if name == "tested":
            linked.append(rows.where("linked").count())
        return rows

    monkeypatch.setattr(near_dedup, "components", followed)
    monkeypatch.setattr(near_dedup, "materialize", counted)
    near_dedup.near_groups(docs).collect()
    assert len(linked) > 1 and sum(given) == sum(linked)


def test_token_counts_before_and_after_edits(documents, rows, bpe):
    count = lambda t: len(bpe.encode(t, add_special_tokens=False).ids)
    found = token_counts.count_tokens(example_edits(documents)).toPandas().set_index("doc_id")
    for r in rows.itertuples():
        text, third = r.text, len(r.text) // 3
        text = text[:third] + f"x {r.lang} {r.source}" + text[third + 12 :]
        text = text[: 2 * third] + text[2 * third + 40 :] + f" from {r.lang} {r.source}"
        own = found.loc[r.doc_id]
        assert (own.n_tokens, own.n_tokens_edited, own.n_chars_edited) == (count(r.text), count(text), len(text))
        assert own.n_encoded <= 60


def test_quality_keeps_columns_of_any_name_and_learns_from_present_rows(documents, shipped, sf_dir):
    labels = shipped.read.parquet(f"{sf_dir}/labels.parquet")
    clash = documents.withColumns({c: F.lit("x") for c in ("held_out", "score", "predicted", "d", "e")})
    clash = clash.toDF(*documents.columns, "held_out", "score", "predicted", "__held", "a.b")
    kept = quality.drop_rejected(clash, labels)
    assert kept.columns == clash.columns
    wanted = quality.quality_scores(documents, quality.train(documents, labels)).where("predicted = 1").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(r.doc_id for r in wanted)
    # Labels of absent documents use up nothing of the sample, and repeated rows count once.
    absent = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 10**9))
    twice = quality.train(documents.union(documents), absent, max_train=40)
    once = quality.train(documents, labels, max_train=40)
    assert len(twice.value) == len(once.value) and (twice.value == once.value).all()


def test_quality_on_held_out_labels(documents, shipped, sf_dir):
    labels = shipped.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/labels.parquet")
    docs = shipped.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/documents.parquet")
    found = quality.quality_scores(docs, quality.train(docs, labels)).toPandas().merge(labels.toPandas(), on="doc_id")
    found = found[found.held_out]
    assert ((found.score >= 0.5) == (found.quality == 1)).mean() > 0.97
    assert (found.predicted == (found.score >= 0.5)).all()


def test_exact_groups_agree_with_sql(documents, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    wanted = con.execute(EXACT_SQL).df().sort_values("doc_id").reset_index(drop=True)
    for bits in (exact_dedup.MAX_FILTER_BITS, exact_dedup.BITMAP_BITS):
        found = exact_dedup.exact_groups(documents, bits).toPandas().sort_values("doc_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(found[wanted.columns], wanted, check_dtype=False)
    assert exact_dedup.drop_copies(documents).count() == wanted.kept.sum()


def test_packing_is_an_exact_round_trip(documents, rows, bpe):
    ids = {i: [*bpe.encode(t, add_special_tokens=False).ids, 1] for i, t in zip(rows.doc_id, rows.text)}
    found = packing.pack(documents).toPandas()
    for r in found.itertuples():
        piece = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (zlib.crc32(piece.tobytes()), len(piece), len(ids[r.doc_id])) == (r.ids_crc32, r.length, r.doc_tokens)
    assert found.length.sum() == sum(map(len, ids.values()))
    inside = found.sort_values(["sequence_id", "offset"])
    assert (inside.groupby("sequence_id").length.cumsum() - inside.length == inside.offset).all()
    size = found.groupby("sequence_id").length.sum()
    assert size.max() <= 2048 and 2048 * len(size) < 1.03 * size.sum() + 2048


def test_best_fill_finds_the_closest_sum():
    rng = np.random.default_rng(3)
    for _ in range(50):
        counts = {int(x): int(rng.integers(1, 4)) for x in rng.integers(1, 40, 5)}
        room = int(rng.integers(1, 120))
        sums = {0}
        for x, c in counts.items():
            sums = {s + x * k for s in sums for k in range(c + 1)}
        used, total = packing.best_fill(counts, room)
        assert total == max(s for s in sums if s <= room) == sum(x * k for x, k in used.items())
        assert all(k <= counts[x] for x, k in used.items())


def test_language_on_held_out_documents(documents, rows):
    found = language.predict_language(documents, language.train(documents)).toPandas().merge(rows[["doc_id", "lang"]], on="doc_id")
    assert (found[found.held_out].lang_pred == found[found.held_out].lang).mean() > 0.95


def test_raking_meets_all_marginals(documents):
    found = mixing.mixing_weights(documents, 0.5).toPandas()
    assert len(found) == documents.count()
    assert (found.probability * found.tokens).sum() == pytest.approx(0.5 * found.tokens.sum(), rel=1e-6)
    for d in mixing.DIMENSIONS:
        tokens = found.groupby(d).tokens.sum()
        wanted = tokens ** mixing.POWERS[d]
        have = (found.weight * found.tokens).groupby(found[d]).sum()
        assert (have / have.sum()).to_dict() == pytest.approx((wanted / wanted.sum()).to_dict(), rel=1e-6)


@pytest.mark.parametrize("local_cells", [mixing.LOCAL_CELLS, 0])
def test_raking_gives_every_source_its_own_share(shipped, local_cells):
    names = [None, "", "*", *[f"host{i}" for i in range(300)]]
    rows = [(10 * i + j, "word " * (1 + i * 7 % 11 + j), lang, name) for i, name in enumerate(names) for j, lang in enumerate(("en", "de"))]
    docs = shipped.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    targets = {None: 3.0, "": 2.0, "*": 5.0, **{f"host{i}": 1.0 + i % 4 for i in range(300)}}
    found = mixing.mixing_weights(docs, 0.3, {"source": targets}, local_cells=local_cells).toPandas()
    assert len(found) == len(rows)
    assert (found.probability * found.tokens).sum() == pytest.approx(0.3 * found.tokens.sum(), rel=1e-6)
    assert found.probability.between(0, 1).all()
    have = (found.weight * found.tokens).groupby(found.source.map(lambda x: "?" if pd.isna(x) else f"={x}")).sum()
    share = {"?" if n is None else f"={n}": x / sum(targets.values()) for n, x in targets.items()}
    assert (have / have.sum()).to_dict() == pytest.approx(share, rel=1e-6)
    tokens = found.groupby("lang").tokens.sum() ** mixing.POWERS["lang"]
    have = (found.weight * found.tokens).groupby(found.lang).sum()
    assert (have / have.sum()).to_dict() == pytest.approx((tokens / tokens.sum()).to_dict(), rel=1e-6)


@pytest.mark.parametrize("shard_rows, query_rows", [(4096, 16_384), (100, 16_384), (300, 2)])
def test_neighbours_agree_with_brute_force(shipped, sf_dir, shard_rows, query_rows):
    table = shipped.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = neighbours.nearest(table, shard_rows=shard_rows, query_rows=query_rows).toPandas().sort_values(["query_id", "rank"])
    p = table.toPandas()
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    assert set(found.query_id) == {i for i in ids if i % 100 == 0}
    for q, own in found.groupby("query_id"):
        away = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        away[ids == q] = np.inf
        assert own.vec_id.tolist() == ids[np.lexsort((ids, away))[:10]].tolist()


def test_neighbours_leave_out_odd_vectors(shipped):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [5.0, 0.0])]
    table = shipped.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    found = neighbours.nearest(table).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(1, 0.0), (2, 0.0), (7, 4.0)]
    assert neighbours.nearest(table.limit(0)).count() == 0


def brute_repeats(pairs, window=50):
    own, out = {}, {}
    words = [(i, (t or "").encode().split()) for i, t in pairs]
    for i, w in sorted((x for x in words if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(w) - window + 1):
            own.setdefault(tuple(w[p : p + window]), i)
    for i, w in words:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and own[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.setdefault(i, []).append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("sizes", [{}, {"max_leaves": 1}, {"group_windows": 2000}])
def test_repeats_agree_with_brute_force(documents, rows, sizes):
    wanted = brute_repeats(zip(rows.doc_id, rows.text))
    found = substring.remove_repeats(documents, **sizes).collect()
    assert {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in found} == wanted


def test_odd_rows_substring(odd_docs):
    wanted = brute_repeats([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    found = defaultdict(list)
    for r in substring.remove_repeats(odd_docs).collect():
        found[r.doc_id].append((r.n_words, r.n_removed, r.kept_sha256))
    assert found == wanted


def test_odd_rows_exact(odd_docs):
    found = exact_dedup.exact_groups(odd_docs).toPandas()
    assert len(found) == odd_docs.count()
    assert found.groupby("text_sha256").kept.sum().eq(1).all()
    assert found.groupby("text_sha256").size().eq(found.groupby("text_sha256").group_size.first()).all()
    once = exact_dedup.drop_copies(odd_docs)
    assert once.columns == odd_docs.columns and once.count() == found.kept.sum()


def test_odd_rows_near(odd_docs):
    found = near_dedup.near_groups(odd_docs).toPandas()
    assert len(found) == odd_docs.count() and found.groupby("class_id").kept.sum().eq(1).all()
    assert set(found[found.class_id == 1].doc_id.dropna()) == {1, 2, 3}
    once = near_dedup.drop_near_copies(odd_docs)
    assert once.columns == odd_docs.columns and once.count() == found.kept.sum()


def test_stored_trees_follow_edits(documents, shipped, bpe):
    """Three rounds of edits to stored leaves agree with texts edited and encoded anew; leaves that no edit touches are never written again."""
    texts = {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
    trees = token_counts.store_trees(documents)
    random = np.random.default_rng(3)
    inserts = ["", " ", "x", "new words here", "é\n日本 ", " ".join(f"grown{i}" for i in range(150)), None]
    for _ in range(3):
        rows = []
        for doc in list(texts)[::3]:
            for seq in range(4):
                n = len(texts[doc])
                start, stop = (int(x) for x in random.integers(-5, n + 20, 2))
                stop = min(stop, start + 400) if seq else stop
                insert = inserts[random.integers(len(inserts))]
                rows.append((doc, seq, start, stop, insert))
                a = min(max(start, 0), n)
                texts[doc] = texts[doc][:a] + (insert or "") + texts[doc][min(max(stop, a), n) :]
        rows += [(None, 0, 0, 5, "lost"), (-77, 0, 0, 5, "unknown")]
        edits = shipped.createDataFrame(rows, "doc_id bigint, seq int, start bigint, stop bigint, insert string")
        before, trees = trees, token_counts.edit_trees(trees, edits)
        untouched = before.join(edits.select("doc_id"), "doc_id", "left_anti")
        assert untouched.exceptAll(trees.select(untouched.columns)).count() == 0
        found = token_counts.tree_counts(trees).toPandas().set_index("doc_id")
        assert len(found) == len(texts)
        for doc, text in texts.items():
            words = re.findall("[^\x20\x09-\x0D]+", text)
            tokens = sum(len(e.ids) for e in bpe.encode_batch(words, add_special_tokens=False))
            assert tuple(found.loc[doc]) == (len(text), len(words), tokens)
    leaves = defaultdict(list)
    for r in trees.orderBy("tree", "leaf").collect():
        leaves[r.doc_id].append(r.text)
    assert {doc: "".join(own) for doc, own in leaves.items()} == texts
    assert trees.agg({"n_words": "max"}).first()[0] <= 2 * token_counts.LEAF_WORDS


def test_stored_trees_of_odd_rows(odd_docs, no_docs, shipped):
    edits = shipped.createDataFrame([(8, 0, None, None, "a "), (4, 0, 9, 3, "text"), (7, 0, 0, 10**9, ""), (None, 0, 0, 1, "")], "doc_id bigint, seq int, start bigint, stop bigint, insert string")
    trees = token_counts.store_trees(odd_docs)
    same = token_counts.edit_trees(trees, edits.limit(0))
    assert same.exceptAll(trees).count() == 0 and same.count() == trees.count()
    found = [tuple(r) for r in token_counts.tree_counts(token_counts.edit_trees(trees, edits)).collect()]
    assert len(found) == odd_docs.count()
    words = defaultdict(list)
    for doc, chars, n, _ in found:
        words[doc].append((chars, n))
    assert words[8] == [(12, 3), (12, 3)] and words[4] == [(4, 1)] and words[7] == [(0, 0)] and words[None][0][1] == 120
    empty = token_counts.store_trees(no_docs)
    assert token_counts.tree_counts(token_counts.edit_trees(empty, edits)).count() == 0


def test_odd_rows_elsewhere(odd_docs, shipped):
    n = odd_docs.count()
    labels = shipped.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (8, None, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.quality_scores(odd_docs, quality.train(odd_docs, labels)).count() == n
    assert quality.drop_rejected(odd_docs, labels).columns == odd_docs.columns
    found = language.predict_language(odd_docs, language.train(odd_docs)).toPandas().set_index("doc_id").lang_pred
    assert {found[i] for i in (4, 5, 6, 9)} == {"und"}
    assert mixing.mixing_weights(odd_docs).count() == n
    assert mixing.sample_mixture(odd_docs, 1.0).columns == odd_docs.columns
    assert packing.pack(odd_docs).where("doc_id = 4").collect()[0].length == 1
    assert token_counts.count_tokens(odd_docs, None).count() == n
    assert lm.score_documents(odd_docs).count() == n


def test_empty_tables(no_docs, shipped):
    labels = shipped.createDataFrame([], "doc_id bigint, quality int, toxic int")
    results = (
        quality.quality_scores(no_docs, quality.train(no_docs, labels)), language.predict_language(no_docs, language.train(no_docs)),
        exact_dedup.exact_groups(no_docs), exact_dedup.drop_copies(no_docs), near_dedup.near_groups(no_docs), near_dedup.drop_near_copies(no_docs),
        mixing.mixing_weights(no_docs), packing.pack(no_docs), token_counts.count_tokens(no_docs, None), substring.remove_repeats(no_docs),
        lm.score_documents(no_docs),
    )
    assert [r.count() for r in results] == [0] * len(results)
