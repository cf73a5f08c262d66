"""The nearest-neighbour join by cells, with more queries than are sent to all points."""

import duckdb

from cloudloom.jobs import neighbor_queries
from cloudloom.operators import neighbors

FOLDER = "/root/testdata/sf0.01"


def test_cells_equal_all_pairs(spark, monkeypatch):
    sent = []
    plain = neighbors._sent
    monkeypatch.setattr(neighbors, "_sent", lambda queries, *rest: sent.append(queries.count()) or plain(queries, *rest))
    got = neighbor_queries.QUERIES["knn_cells"](spark, FOLDER)
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{FOLDER}/events.parquet'")
    want = c.sql(neighbor_queries.SQL["knn_cells"])
    columns = ["point_id", "place", "neighbor_id", "d"]
    rows = lambda many, names: sorted((*[r[names.index(x)] for x in columns[:3]], round(r[names.index("d")], 8)) for r in many)
    assert sorted(got.columns) == sorted(want.columns) and rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)
    assert sum(sent) < 5_000  # of 10,000 queries
