"""Registered queries against their oracle SQL in DuckDB. ALL_QUERIES=1 runs every one."""
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUICK = ["cor1_port_scan", "cor3_beaconing", "det3_conditions", "det6_run_all_detections", "nrm1_normalize_events", "nrm4_truncate_utf8", "scl4_canonical_ids", "flt1_list_events_page",
         "flt10_07_dns_tunnel", "ti2_event_match", "prv3_dns_trackers", "cov7_validate_tests", "tim2_merged_timeline", "kpi5_all_kpis", "kpi10_playbook_overall", "gov1_case_states",
         "snk7_keep_recent", "scr3_score_detections", "vec1_nearest", "src3_ids_lines", "src4_firewall_syslog", "src14_group_techniques", "grf5_first_edges"]
QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(value):
    if hasattr(value, "item"):
        value = value.item()
    return round(value, 6) if isinstance(value, float) else value


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_every_sql_has_a_query():
    assert not set(SQL) - set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_oracle(spark, con, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr(tuple(plain(dict(zip(names, row))[c]) for c in columns)) for row in result.fetchall())
    assert ours == theirs
