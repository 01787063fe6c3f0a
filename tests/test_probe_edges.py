"""Pairs on the edges of the band, with parts of a second: the rows of the SQL."""

import duckdb
import pytest
from test_oracles import rows

from tierscope.plans.catalog import QUERIES
from tierscope.plans.oracles import SQL

#: Seconds from an anonymous row to its signed-in one, near an edge of a band.
EDGES = [edge + off for edge in (-172_800, -3_600, 300) for off in (-1, 0, 1)]
PARTS = [0, 300_000, 500_000, 600_000, 999_999]


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    """A panelist for each edge and parts of a second of its two rows, at an even and an odd second."""
    folder, user = str(tmp_path_factory.mktemp("edges")), 0
    c = duckdb.connect()
    c.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    for second in (0, 1):
        for edge in EDGES:
            for a in PARTS:
                for b in PARTS:
                    at = (1_704_974_400 + second) * 1_000_000
                    for event, us in ((8 * user, at + a), (8 * user + 1, at + edge * 1_000_000 + b)):
                        c.execute("INSERT INTO events VALUES (?, make_timestamp(?), ?, 'view', 1, ?)", [event, us, user, f'{{"k": {event % 7}}}'])
                    user += 1
    c.execute(f"COPY events TO '{folder}/events.parquet'")
    return c, folder


@pytest.mark.parametrize("name", ["probe_pairs_asof", "probe_pairs_two_days", "probe_rates", "probe_stats", "probe_check_stats", "decide", "verdict_lines", "stream_probe_pairs"])
def test_edges_of_the_band(spark, edges, name):
    c, folder = edges
    got, want = QUERIES[name](spark, folder).toPandas(), c.execute(SQL[name]).df()
    assert len(want) and rows(got) == rows(want)
