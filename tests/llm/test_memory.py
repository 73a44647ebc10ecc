"""What workers hold between batches, and how many rows they get at once."""

import pyarrow as pa

from millrace.llm import arrays, tokens
from millrace.llm.queries import TOKENIZER
from millrace.session import arrow_rows

from . import awkward

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_memory_is_released_between_batches(monkeypatch):
    calls = []
    monkeypatch.setattr(arrays, "release", lambda: calls.append(1))
    monkeypatch.setattr(arrays, "RELEASE", 3000)
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 600] * 5})
    assert sum(p.num_rows for p in arrays.pieces(iter([batch, batch]), most=1000)) == 10
    assert len(calls) == 3  # after each batch, and at the end


def test_jobs_get_few_rows_at_once(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    before = spark.conf.get(NAME)
    with arrow_rows(spark, 100):
        inside = [r.n for r in spark.range(0, 1000, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert max(inside) <= 100 and sum(inside) == 1000
    assert spark.conf.get(NAME) == before


def test_packing_leaves_the_session_as_it_is(spark, monkeypatch):
    """Rows are the same for batches of one row; a smaller number that the session has stays."""
    docs, before = awkward.frame(spark, 30), spark.conf.get(NAME)
    one = lambda: sorted(tuple(r)[:5] for r in tokens.packed_pieces(docs.coalesce(1), TOKENIZER).collect() if r.doc_id is not None)
    want = one()
    monkeypatch.setattr(tokens, "BATCH_ROWS", 1)
    assert one() == want and spark.conf.get(NAME) == before
