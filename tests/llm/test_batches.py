"""Batches that the operators on texts hand to Python workers."""

import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[2]}:{os.environ.get('PYTHONPATH', '')}"

import pyarrow as pa
import pytest

from tablewright.functions.session import WORKER_BATCH, WORKER_BATCH_BYTES
from tablewright.llm.neardup import without_near_duplicates
from tablewright.llm.pieces import encode_texts

LONG = 4_000


@pytest.fixture
def unbounded(spark):
    before = spark.conf.get(WORKER_BATCH, None)
    spark.conf.unset(WORKER_BATCH)
    yield spark
    spark.conf.unset(WORKER_BATCH)
    if before is not None:
        spark.conf.set(WORKER_BATCH, before)


def texts_of(spark, rows):
    return spark.range(0, rows, 1, 1).selectExpr("id as doc_id", f"rpad(concat('w', id), {LONG}, concat(' v', id)) as text")


def sizes(df):
    """Rows and bytes of each batch that a worker gets in this session."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "b": [batch.nbytes]})

    return [(r.n, r.b) for r in df.mapInArrow(run, "n long, b long").collect()]


@pytest.mark.parametrize("operator", [encode_texts, without_near_duplicates])
def test_batches_of_long_texts_are_bounded(unbounded, operator):
    docs = texts_of(unbounded, 3_000)
    operator(docs)
    found = sizes(docs)
    assert sum(n for n, _ in found) == 3_000
    assert max(b for _, b in found) < WORKER_BATCH_BYTES + 2 * LONG + 1_000


def test_a_bound_of_the_session_stays(unbounded):
    unbounded.conf.set(WORKER_BATCH, "65536")
    encode_texts(texts_of(unbounded, 1))
    assert unbounded.conf.get(WORKER_BATCH) == "65536"


def test_rows_and_ids_do_not_depend_on_batches(unbounded):
    docs = texts_of(unbounded, 1_200)
    rows = lambda: sorted((r.doc_id, r.n_tokens, tuple(r.ids)) for r in encode_texts(docs).collect())
    bounded = rows()
    unbounded.conf.set(WORKER_BATCH, str(1 << 30))
    assert len(bounded) == 1_200 and rows() == bounded
