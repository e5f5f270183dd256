"""Queries over whole tables against plain loops."""

from collections import defaultdict

import pytest

import __spark_entry__ as entry
from sparkloom.operators import locks
from sparkloom.sources.tables import table


def test_lock_waits_of_all_orders(spark, sf):
    by = defaultdict(list)
    for o in table(spark, sf, "orders").collect():
        by[o.o_custkey].append((o.o_orderkey, o.o_orderpriority.startswith("1")))
    want = sorted((a, b, c) for c, rows in by.items() for a, x in rows for b, y in rows if a != b and (x or y))
    assert max(c for _, _, c in want) >= 50
    assert sorted(tuple(r) for r in entry.queries()["lock_waits"](spark, sf).select("waiter", "holder", "resource").collect()) == want


def test_overlaps_of_all_events(spark, sf):
    users = defaultdict(list)
    for e in table(spark, sf, "events").collect():
        users[e.event_id % 40].append(e.user_id)
    assert sum(map(len, users.values())) > 200
    files = {f: (min(u), max(u)) for f, u in users.items()}
    want = sorted((a, b) for a in files for b in files if a < 4 <= b and files[b][1] >= files[a][0] and files[b][0] <= files[a][1])
    assert sorted(tuple(r) for r in entry.queries()["overlap_join"](spark, sf).collect()) == want


@pytest.mark.parametrize("drop", [False, True])
def test_compaction_of_all_runs(spark, sf, drop):
    newest = {}
    for e in table(spark, sf, "events").orderBy("event_id").collect():
        newest[e.user_id] = (e.event_id, e.event_type == "error")
    assert {seq % 4 for seq, _ in newest.values()} == {0, 1, 2, 3}
    want = sorted((u, *v) for u, v in newest.items() if not (drop and v[1]))
    got = entry.queries()["lsm_compact_drop" if drop else "lsm_compact_keep"](spark, sf)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_long_chains_and_cycles(spark):
    chain = [(i, i + 1) for i in range(140)]
    assert locks.waiting(spark.createDataFrame(chain, "src long, dst long")).count() == 0
    ring = [(i, (i + 1) % 40) for i in range(40)] + [(0, 100), (100, 0), (100, 200), (200, 201)]
    got = {r.src: r.cycle_len for r in locks.cycles(spark.createDataFrame(ring, "src long, dst long")).collect()}
    assert got == {i: 40 for i in range(1, 40)} | {0: 2, 100: 2}
