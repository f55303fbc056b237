"""What the pipeline's stages leave in, and send to, the Python workers that all of them share."""
import shutil

import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_text_operators import frame
from tidewatch.llm import bpe, common
from tidewatch.llm.queries import BYTE_BPE

KEYS = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES if k != "personal_data"])      # that one runs no Python
def test_batches_of_texts_are_small(spark, stage, tmp_path):
    before = {k: spark.conf.get(k) for k in KEYS}
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    try:
        dict(corpus_pipeline.STAGES)[stage](spark, frame(spark, []), str(tmp_path))
        for length, rows in ((1, 12_000), (50_000, 400)):
            got = spark.range(0, rows, 1, 1).selectExpr(f"repeat('x', {length}) as text").mapInArrow(sizes, "n long, size long").collect()
            assert sum(r["n"] for r in got) == rows and max(r["n"] for r in got) <= common.ARROW_ROWS
            assert max(r["size"] for r in got) <= 2 * common.ARROW_BYTES
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_workers_give_up_vocabulary_and_memos(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "vocabulary.json")
    shutil.copy(BYTE_BPE, path)
    monkeypatch.setattr(corpus_pipeline, "BYTE_BPE", path)

    def held(batches):
        yield from (pa.RecordBatch.from_arrays([pa.array([bpe.holds(path)])], ["held"]) for _ in batches)

    docs = frame(spark, [(k, f"some words {k}") for k in range(64)]).repartition(8)
    before = {k: spark.conf.get(k) for k in KEYS}
    try:
        got = {r["doc_id"]: r for r in corpus_pipeline.encode(spark, docs, "").collect()}
        again = spark.range(0, 64, 1, 8).mapInArrow(held, "held boolean").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(again) == 8 and not any(r["held"] for r in again)
    assert got == {r["doc_id"]: r for r in bpe.round_trip(docs, BYTE_BPE).collect()}
