"""WARC archives, periodic runs and hard negatives: against SQL, brute force and exact round trips, on the test tables and on odd rows."""

import gzip
import hashlib
import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.llm import hard_negatives, periodic, queries, warc
from assayer.session import scratch_dir

CLASH = ("kept", "score", "digest", "first", "id", "uid", "runs", "start", "archive", "record_type", "positives", "a.b", "text_sha256")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


# --- WARC ---------------------------------------------------------------------------------------------------------------

PAGES = "page_id bigint, url string, html string"
ODD_PAGES = [
    (5, "http://a/é x", "<p>same</p>"), (3, "http://b", "<p>same</p>"), (9, None, "<p>same</p>"), (9, None, "<p>same</p>"), (None, "http://n", "<p>same</p>"),
    (1, "http://e", None), (2, "bad\r\nurl: x", ""), (4, "http://crlf", "\r\n\r\nWARC/1.1\r\n\r\n"), (6, "http://u", "日本語 \u0000 ü"),
    (7, "http://long", "x" * 3_000_000), (None, None, "only here"), (8, "http://twice", "twice"), (8, "http://twice", "twice"),
]


def sql_rows(query, **frames):
    con = duckdb.connect()
    for name, df in frames.items():
        con.register(name, df.toArrow())
    return sorted(con.execute(query).fetchall(), key=repr)


def stored(pages, **options):
    return warc.write_warc(pages, scratch_dir(pages.sparkSession, "warc-test"), **options)


def test_warc_agrees_with_sql_on_odd_pages(shipped):
    pages = clashing(shipped.createDataFrame(ODD_PAGES, PAGES))
    found = warc.page_records(stored(pages))
    assert found.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    assert rows == sql_rows(queries.WARC_SQL, pages=pages)
    kinds = {(r[0], r[3], r[4]) for r in rows}
    assert {(3, "response", None), (5, "revisit", 3), (9, "revisit", 3), (None, "revisit", 3), (1, "response", None), (2, "revisit", 1)} <= kinds
    assert sorted(r[3] for r in rows if r[0] == 8) == ["response", "response"]


def test_warc_gives_back_payloads_and_other_columns(shipped):
    pages = shipped.createDataFrame(ODD_PAGES, PAGES)
    archives = stored(pages)
    rows = warc.read_warc(archives).where("record_type = 'response'").collect()
    payloads = {bytes(r["payload"]) for r in rows}
    assert payloads == {(html or "").encode() for _, _, html in ODD_PAGES}
    assert all(r["error"] is None and r["payload_bytes"] == len(r["payload"]) for r in rows)
    assert {r["uri"] for r in rows} >= {"http://b", "http://long", "http://crlf"}
    (bad,) = warc.read_warc(archives).where("page = '2'").collect()
    assert bad["uri"] == "bad%0D%0Aurl:%20x" and bad["refers_to_page"] == "1"
    assert archives.agg(F.sum("records")).first()[0] == len(ODD_PAGES)


def test_warc_has_one_member_per_record(shipped):
    pages = shipped.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(20)], PAGES).coalesce(1)
    (archive,) = stored(pages).collect()
    data = Path(archive["archive"].removeprefix("file://")).read_bytes()
    assert len(data) == archive["bytes"]
    whole, members = gzip.decompress(data), 0
    rest = data
    while rest:
        inflate = zlib.decompressobj(31)
        text = inflate.decompress(rest)
        assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n") and inflate.eof
        rest, members = inflate.unused_data, members + 1
    assert members == 21 and whole.count(b"WARC-Type: response") == 20 and whole.count(b"WARC-Type: warcinfo") == 1


def test_warc_rolls_archives_over(shipped):
    rng = random.Random(1)
    pages = shipped.createDataFrame([(i, "http://x", rng.randbytes(3000).hex()) for i in range(40)], PAGES).coalesce(1)
    archives = stored(pages, archive_bytes=20_000)
    assert archives.count() > 3 and archives.agg(F.max("bytes")).first()[0] < 25_000
    assert warc.page_records(archives).select("page_id").distinct().count() == 40


def test_warc_small_payloads_are_never_revisits(shipped):
    pages = shipped.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, "u", "abcdef"), (4, "u", "abcdef")], PAGES)
    found = {r["page_id"]: r["record_type"] for r in warc.page_records(stored(pages, least_bytes=5)).collect()}
    assert found == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_warc_of_no_pages(shipped):
    archives = stored(shipped.createDataFrame([], PAGES))
    assert archives.count() == 0 and warc.page_records(archives).collect() == []


def archive_of(tmp_path, *records):
    path = tmp_path / "broken.warc.gz"
    path.write_bytes(b"".join(records))
    return list(warc.read_archive(str(path)))


def good(page, body=b"<p>hello</p>"):
    return warc.page_record(page, "http://x", body, None, False, "2024-01-01T00:00:00Z")


def changed(data, old, new):
    whole = gzip.decompress(data)
    assert old in whole
    return gzip.compress(whole.replace(old, new))


def test_warc_reader_finds_damage(tmp_path):
    first, second = good("1"), good("2", b"<p>other</p>")
    cases = [
        (changed(first, b"hello", b"hullo"), "block digest differs"),
        (changed(first, b"</p>\r\n", b"</p>more\r\n"), "not as long"),
        (changed(first, b"WARC/1.1", b"WORC/1.1"), "version"),
        (changed(first, b"Content-Length", b"Content-Lungth"), "content length"),
        (gzip.compress(b"no header"), "without header"),
    ]
    for broken, message in cases:
        rows = archive_of(tmp_path, broken, second)
        assert message in rows[0]["error"] and rows[1]["error"] is None and rows[1]["page"] == "2"
    payload_wrong = changed(first, warc.base32_sha1(b"<p>hello</p>").encode(), warc.base32_sha1(b"x").encode())
    assert "payload digest differs" in archive_of(tmp_path, payload_wrong)[0]["error"]


def test_warc_reader_survives_broken_streams(tmp_path):
    first, second = good("1"), good("2", b"<p>other</p>" * 1000)
    rows = archive_of(tmp_path, first, second[:-20])
    assert rows[0]["error"] is None and "ends within" in rows[-1]["error"]
    torn = bytearray(second)
    torn[30:60] = bytes(30)
    rows = archive_of(tmp_path, first, bytes(torn), first)
    assert rows[0]["error"] is None and rows[1]["error"]
    assert "inflated" in archive_of(tmp_path, b"plain text, no gzip")[0]["error"]
    assert archive_of(tmp_path) == []


def test_warc_strict_reading_raises(shipped, tmp_path):
    path = tmp_path / "broken.warc.gz"
    path.write_bytes(good("1") + changed(good("2"), b"hello", b"hullo"))
    archives = shipped.createDataFrame([(str(path),)], "archive string")
    assert [r["error"] for r in warc.read_warc(archives, strict=False).collect()] == [None, "block digest differs"]
    with pytest.raises(Exception, match="block digest differs"):
        warc.read_warc(archives).collect()


# --- Periodic runs --------------------------------------------------------------------------------------------------------


def brute_runs(words, least=12):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((start, q, stop - start) for (start, stop), q in found.items())


def brute_digests(doc_id, text, plant=True):
    words = (text or "").encode().split()  # bytes split at [\x20\x09-\x0D] only
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if plant and h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, q, length in runs for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, q, length in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    best = max(runs, key=lambda r: (r[2], -r[0], -r[1]), default=None)
    four = (None,) * 4 if best is None else (best[0], best[2], best[1], 1000 * best[2] // best[1])
    return (doc_id, len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_equal_brute_force_on_small_alphabets():
    rng = random.Random(5)

    def words():
        n, k = rng.choice([0, 1, 5, 12, 13, 30, 60, 120, 200]), rng.choice([1, 2, 2, 3, 5, 50])
        out = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.choice([0, 1, 3]) if n > 4 else 0):
            a = rng.randrange(n)
            p, stop = 1 + rng.randrange(max(1, (n - a) // 3)), rng.randrange(a, n)
            for i in range(a + p, stop):
                out[i] = out[i - p]
        return out

    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 400:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    docs = [words() for _ in range(400)] + [fibonacci[1], [0] * 500, [0, 1] * 200 + [0]]
    for a in range(0, len(docs), 9):
        part = docs[a : a + 9]
        flat = np.array([w for d in part for w in d], np.uint64)
        found = [[] for _ in part]
        for doc, start, length, period in zip(*periodic.runs(flat, np.array([len(d) for d in part]))):
            found[doc].append((start, period, length))
        assert found == [brute_runs(d) for d in part]


def test_grammar_extensions_equal_plain_ones():
    rng = np.random.default_rng(3)
    symbols = np.concatenate(([0], rng.integers(2, 4, 300), np.tile(rng.integers(2, 9, 17), 12), np.full(50, 3), [1]))
    levels = periodic.grammar(symbols, 2)
    assert len(levels[-1].symbols) == 3  # the whole document is one symbol
    a = rng.integers(1, len(symbols) - 1, 3000)
    b = rng.integers(1, len(symbols) - 1, 3000)
    a, b = a[a != b], b[a != b]
    for step in (1, -1):
        expected = []
        for i, j in zip(a, b):
            n = 0
            while symbols[i + n * step] == symbols[j + n * step]:
                n += 1
            expected.append(n)
        assert periodic.extend(levels, a, b, step).tolist() == expected


def test_query_of_runs_equals_brute_force(shipped, sf_dir, documents):
    found = queries.op12_periodic_runs(shipped, sf_dir)
    expected = sorted(brute_digests(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    assert sorted(tuple(r) for r in found.collect()) == expected
    assert sum(r[1] for r in expected) > 20


def test_runs_of_odd_documents(odd_docs, no_docs):
    docs = odd_docs.withColumn("a.b", F.lit("x")).withColumn("runs", F.lit("x"))
    found = periodic.run_digests(periodic.collapse_runs(docs, order=queries.planted_order)).collect()
    expected = [brute_digests(r["doc_id"], r["text"]) for r in odd_docs.where("doc_id is null or doc_id <> 7").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in found if r["doc_id"] != 7), key=repr) == sorted(expected, key=repr)
    (hot,) = [r for r in found if r["doc_id"] == 7]
    assert (hot["n_runs"], hot["start"], hot["length"], hot["period"]) == (1, 0, 60_000, 1)
    assert periodic.collapse_runs(no_docs).collect() == []


def test_runs_come_with_spans_and_text(shipped):
    text = "a b " + "x y z " * 5 + "end"
    (row,) = periodic.collapse_runs(shipped.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in row["runs"]] == [(2, 15, 3)] and row["collapsed"] == "a b x y z end" and row["n_words"] == 18


# --- Hard negatives -------------------------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int"


def test_negatives_agree_with_sql_on_odd_rows(shipped):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(6).round(1)], int(rng.integers(0, 3))) for i in range(330)]
    rows += [(i, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0], i % 3) for i in range(330, 520)]  # a hot vector: ties by id
    rows += [(100, rows[100][1], rows[100][2]), (200, rows[200][1], 1), (7, rows[7][1], rows[7][2])]  # repeated rows and ids
    rows += [(600, None, 1), (700, [1.0] * 6, None), (800, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (900, [float("nan")] * 6, 1), (1000, [float("inf")] * 6, 1)]
    rows += [(1100, [0.0] * 6, 1), (None, [0.3] * 6, 1), (None, [0.2] * 6, 2)]
    frame = shipped.createDataFrame(rows, VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.hard_negatives(clashing(frame.withColumn("label", label)), F.col("vec_id") % 100 == 0, shard_rows=100)
    rows = sorted((tuple(r) for r in found.collect()), key=repr)
    assert rows == sql_rows(queries.NEGATIVES_SQL, embeddings=frame) and len(rows) > 100


def test_negatives_of_no_rows(shipped):
    assert hard_negatives.hard_negatives(shipped.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).collect() == []
    alone = shipped.createDataFrame([(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 2)], VECTORS)
    assert hard_negatives.hard_negatives(alone, F.col("vec_id") % 100 == 0).collect() == []


def test_negatives_of_large_components_are_exact(shipped):
    big = float(2**30)
    rows = [(0, [big, 1.0], 0), (1, [big, 2.0], 0), (2, [big / 2, 3.0], 1), (3, [big / 2, 4.0], 1), (4, [big * 2, 0.0], 1)]
    frame = shipped.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = hard_negatives.hard_negatives(frame, F.col("vec_id") == 0, scale=1).collect()
    score = [int(big) * int(v[0]) + int(v[1]) for _, v, _ in rows]
    assert sorted((r["rank"], r["negative_id"], r["negative_score"], r["positive_score"]) for r in found) == [(1, 3, score[3], score[1]), (2, 2, score[2], score[1])]


def test_tree_is_a_minimum_spanning_tree():
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((40, 5))
    tree = hard_negatives.Tree(vectors)
    assert sorted(tree.order) == list(range(40)) and (tree.parent[1:] < np.arange(1, 40)).all() and tree.parent[0] == -1
    edges = sorted((float(np.linalg.norm(vectors[i] - vectors[j])), i, j) for i in range(40) for j in range(i))
    home, total = list(range(40)), 0.0
    for length, i, j in edges:
        if home[i] != home[j]:
            total += length
            home = [home[j] if h == home[i] else h for h in home]
    assert tree.edge.sum() == pytest.approx(total)


def clustered_shard(rng, centres, spread, n=4000):
    vectors = np.floor(256 * (centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, centres.shape[1]))))
    flat = pa.array(vectors.ravel())
    listed = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * centres.shape[1], flat)
    columns = {"uid": pa.array(np.arange(n)), "id": pa.array(np.arange(n)), "label": pa.array(rng.integers(0, 4, n)), "vector": listed}
    return hard_negatives.Shard(pa.table(columns)), vectors


@pytest.mark.parametrize("spread, most", [(0.005, 0.2), (0.125, 1.0)])
def test_bounds_save_scores_where_anchors_are_near(spread, most):
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((4, 32)) / np.sqrt(32)
    shard, vectors = clustered_shard(rng, centres, spread)
    chosen = np.arange(0, 4000, 31)
    tree = hard_negatives.Tree(vectors[chosen])
    own = chosen[tree.order]
    block = {
        "uid": own, "label": shard.label[own], "parent": tree.parent, "edge": tree.edge, "vectors": vectors[own],
        "size": np.linalg.norm(vectors[own], axis=1), "positives": [[] for _ in own],
    }
    found = hard_negatives.search_block(shard, block, hard_negatives._positives(block, 5))
    scores = vectors[own] @ vectors.T
    for place, _, rows, best in found:
        eligible = np.flatnonzero((shard.label == block["label"][place]) & (np.arange(4000) != own[place]))
        order = eligible[np.lexsort((eligible, -scores[place, eligible]))][:5]
        assert rows.tolist() == order.tolist() and best.tolist() == scores[place, order].tolist()
    assert len(found) == len(own) and shard.scored <= most * scores.size
