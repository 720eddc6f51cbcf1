"""The corpus pipeline stage by stage, and its entry in the registry."""

import corpus_pipeline

import __spark_entry__ as spark_entry
from assayer.llm import exact_dedup, near_dedup
from assayer.sources.files import materialize


def test_stages_take_effect(documents, shipped, sf_dir):
    docs, sizes = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(shipped, docs, sf_dir), name)
        assert docs.columns == documents.columns
        sizes.append(docs.count())
        if name == "exact_dedup":
            assert exact_dedup.exact_groups(docs).where("not kept").isEmpty()
        if name == "near_dedup":
            assert near_dedup.near_groups(docs).where("class_size > 1").isEmpty()
    assert documents.count() > sizes[0] >= sizes[1] >= sizes[2] > sizes[3] > 0
    packed = corpus_pipeline.STAGES[-1][1](shipped, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_batches_of_texts_are_small(shipped, sf_dir):
    """After the first stage is set up, a partition reaches Python in batches of a bounded number of rows."""
    import pyarrow as pa

    from assayer.llm.ship import BATCH_CONF, BATCH_ROWS

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    kept = shipped.conf.get(BATCH_CONF)
    try:
        shipped.conf.set(BATCH_CONF, "10000")
        corpus_pipeline.keep_quality(shipped, shipped.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
        found = [r.n for r in shipped.range(0, 3500, 1, 1).mapInArrow(sizes, "n long").collect()]
    finally:
        shipped.conf.set(BATCH_CONF, kept)
    assert sum(found) == 3500 and max(found) <= BATCH_ROWS


def test_slices_count_all_texts_of_a_row():
    import pyarrow as pa

    from assayer.llm.text import slices

    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 40), pa.array(["b" * 100] * 39 + [None])], ["text", "other_text"])
    parts = [p.num_rows for p in slices([batch], "text", "other_text", limit=1000)]
    assert sum(parts) == 40 and max(parts) <= 11


def test_registered(shipped, sf_dir):
    names = spark_entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
