from datetime import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from loomgraph.plans import catalog

from .oracle import same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, small, name):
    same(spark, catalog.queries()[name], SQL[name], small)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reading_order_at_hour_edges_with_repeated_rows_and_nulls(spark, tmp_path):
    rows = [
        (0, "2024-01-01 09:59:59.7", 1, "signup"),
        (1, "2024-01-01 10:00:00.1", 1, "view"),
        (2, "2024-01-03 02:30:00", 1, "view"),  # 40 hours after 10, 41 after 9
        (2, "2024-01-03 02:30:00", 1, "view"),
        (3, "2024-01-01 10:20:00", 1, None),
        (4, None, 1, "signup"),
        (None, "2024-01-01 11:00:00", 1, "view"),
        (5, "1969-12-31 22:59:59.5", 2, "signup"),
        (6, "1969-12-31 23:10:00", 2, "view"),
    ]
    at = [None if r[1] is None else datetime.fromisoformat(r[1]) for r in rows]
    columns = {"event_id": pa.array([r[0] for r in rows], pa.int64()), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array([r[2] for r in rows], pa.int64()), "event_type": [r[3] for r in rows]}
    pq.write_table(pa.table(columns), tmp_path / "events.parquet")
    same(spark, catalog.queries()["reading_order_steps"], SQL["reading_order_steps"], str(tmp_path))
