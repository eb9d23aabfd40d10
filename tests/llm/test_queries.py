"""The training-data queries agree with DuckDB on the smallest tables, or run."""

import pytest

from chronoweave.llm.oracles import ORACLES
from chronoweave.llm.queries import QUERIES
from tests.test_entry import SF, db, table  # noqa: F401


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_duckdb(spark, db, name):  # noqa: F811
    df = QUERIES[name](spark, SF)
    got = db.execute(ORACLES[name])
    columns = [c[0] for c in got.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.collect(), df.columns) == table(got.fetchall(), columns)


#: What must hold of the rows of queries that no statement expresses.
INVARIANTS = {
    "p2_assigned": lambda rows: len({(r.patient_id, r.index_hadm_id) for r in rows}) == len(rows) and len({(r.group_id, r.split) for r in rows}) == len({r.group_id for r in rows}),
    "p2_sizes": lambda rows: {r.split for r in rows} == {"train", "validation", "test"} and abs(sum(r.record_share for r in rows) - 1) < 1e-9,
    "p8_found": lambda rows: len(set(rows)) == len(rows) > 0,
    "p8_items": lambda rows: len(rows) == 240 and all(r.leaked == (r.n_documents > 0) for r in rows) and any(r.leaked for r in rows),
    "p9_mix": lambda rows: len({(r.slot, r.doc_id, r.repeat_no) for r in rows}) == len(rows) and all(r.n_tokens > 0 for r in rows),
    "p9_shares": lambda rows: len(rows) == 9 and all(r.drawn_tokens == r.planned_tokens for r in rows),
    "p10_found": lambda rows: len(set(rows)) == len(rows) > 0,
    "p10_restored": lambda rows: rows and all(r.restored is not None for r in rows),
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    """Executed as a whole; each has an invariant of its result."""
    assert INVARIANTS[name](QUERIES[name](spark, SF).collect())
