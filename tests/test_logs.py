"""Write-ahead log, recovery, snapshots, locks, routing and suspicion on hand-made frames."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import bloom, checksum, identifiers, suspicion
from sparkloom.operators import locks, mvcc, recovery, routing
from sparkloom.sources import wal


def log(spark, rows):
    """rows: lsn, prev, tx, type, page, slot, before, after, undo_next."""
    return spark.createDataFrame([tuple(x.encode() if isinstance(x, str) and i in (6, 7) else x for i, x in enumerate(r)) for r in rows], wal.SCHEMA)


@pytest.fixture(scope="module")
def short(spark):
    return log(spark, [(1, 0, 1, "BEGIN", None, None, None, None, None), (2, 1, 1, "INSERT", 10, 0, None, "Tuple value 1", None), (3, 2, 1, "COMMIT", None, None, None, None, None)])


def damaged(path, change):
    files = [f for f in path.iterdir() if f.name.startswith("part-") and f.stat().st_size]
    for f in path.glob(".*.crc"):
        f.unlink()
    f = files[-1]
    f.write_bytes(change(f.read_bytes()))


def test_log_keeps_order(spark, short, tmp_path):
    wal.append(short.coalesce(1), str(tmp_path / "log"))
    got = wal.read(spark, str(tmp_path / "log")).orderBy("lsn").collect()
    assert [r.type for r in got] == ["BEGIN", "INSERT", "COMMIT"] and bytes(got[1].after_image) == b"Tuple value 1"


def test_corruption_in_the_middle_raises(spark, short, tmp_path):
    wal.append(short.coalesce(1), str(tmp_path / "log"))
    damaged(tmp_path / "log", lambda b: b[:20] + bytes([b[20] ^ 1]) + b[21:])
    for tolerate in (False, True):
        with pytest.raises(Exception, match="corrupt log record"):
            wal.read(spark, str(tmp_path / "log"), tolerate).collect()


def test_torn_tail(spark, short, tmp_path):
    wal.append(short.where("lsn = 1").coalesce(1), str(tmp_path / "log"))
    damaged(tmp_path / "log", lambda b: b + b"0123456789")
    assert wal.read(spark, str(tmp_path / "log"), tolerate_tail=True).count() == 1
    with pytest.raises(Exception, match="corrupt log record"):
        wal.read(spark, str(tmp_path / "log")).collect()


def test_only_the_last_segment_may_be_torn(spark, tmp_path):
    path, rows = tmp_path / "log", [(i, i - 1, 1, "UPDATE", 1, 0, "a", "b", None) for i in range(1, 7)]
    segments = []
    for lo, hi in ((1, 3), (4, 6)):
        before = set(path.glob("part-*")) if path.exists() else set()
        wal.append(log(spark, [r for r in rows if lo <= r[0] <= hi]).coalesce(1), str(path))
        segments += [f for f in path.glob("part-*") if f not in before and f.stat().st_size]
    for f in path.glob(".*.crc"):
        f.unlink()
    whole = [f.read_bytes() for f in segments]
    cut = lambda b: b[:-20]
    segments[1].write_bytes(cut(whole[1]))
    assert sorted(r.lsn for r in wal.read(spark, str(path), tolerate_tail=True).collect()) == [1, 2, 3, 4, 5]
    segments[0].write_bytes(cut(whole[0]))
    with pytest.raises(Exception, match="corrupt log record"):
        wal.read(spark, str(path), tolerate_tail=True).collect()
    segments[1].write_bytes(whole[1])
    with pytest.raises(Exception, match="corrupt log record"):
        wal.read(spark, str(path), tolerate_tail=True).collect()
    segments[0].write_bytes(whole[0])
    segments[1].write_bytes(b"12345")  # nothing good in it
    assert wal.read(spark, str(path), tolerate_tail=True).count() == 3


def test_segments_are_bounded_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wal, "SEGMENT", 10)
    wal.append(log(spark, [(i, i - 1, 1, "UPDATE", 1, 0, "a", "b", None) for i in range(1, 101)]).repartition(5), str(tmp_path / "log"))
    files = [f.read_text().splitlines() for f in (tmp_path / "log").glob("part-*") if f.stat().st_size]
    assert len(files) >= 10 and all(len(f) <= 10 for f in files)
    assert [r.lsn for r in wal.read(spark, str(tmp_path / "log")).orderBy("lsn").collect()] == list(range(1, 101))


def test_checkpoint_round_trip(spark, tmp_path):
    now = datetime.datetime(2026, 1, 2, 3, 4, 5)
    wal.save_checkpoint(spark, str(tmp_path / "cp"), 4096, now, {100: 500}, {42: 200})
    assert tuple(wal.load_checkpoint(spark, str(tmp_path / "cp")).first()) == (4096, now, {100: 500}, {42: 200})


def test_redo_of_a_committed_insert(spark):
    rows = log(spark, [(1, 0, 101, "BEGIN", None, None, None, None, None), (2, 1, 101, "INSERT", 5, 0, None, "row", None), (3, 2, 101, "COMMIT", None, None, None, None, None)])
    assert recovery.recovered(rows) == {"active": 0, "rolled_back": 0, "redone": 1, "undone": 0}
    assert bytes(recovery.redone(rows).first().image) == b"row"
    on_disk = spark.createDataFrame([(5, 2)], "page_id long, page_lsn long")
    assert recovery.redone(rows, on_disk).count() == 0 and recovery.dirty_pages(rows, on_disk).count() == 0


def test_undo_of_a_loser(spark):
    old = "Initial Valid Balance = $500"
    rows = log(spark, [(1, 0, 1, "INSERT", 5, 0, None, old, None), (2, 1, 1, "COMMIT", None, None, None, None, None), (3, 0, 202, "UPDATE", 5, 0, old, "bad", None)])
    assert recovery.recovered(rows) == {"active": 1, "rolled_back": 1, "redone": 2, "undone": 1}
    assert bytes(recovery.undone(rows).first().image).decode() == old
    assert recovery.compensation(rows).count() == 1


def test_undo_skips_what_is_compensated(spark):
    rows = log(
        spark,
        [
            (1, 0, 303, "BEGIN", None, None, None, None, None), (2, 1, 303, "INSERT", 5, 0, None, "a", None), (3, 2, 303, "UPDATE", 5, 0, "a", "b", None),
            (4, 3, 303, "UPDATE", 5, 0, "b", "c", None), (5, 4, 303, "CLR", 5, 0, None, "a", 2),
        ],
    )
    got = recovery.undone(rows).collect()
    assert len(got) == 1 and got[0].image is None and got[0].undone == 1


def test_raft_rules(spark):
    match = spark.createDataFrame([(1, n, i) for n, i in enumerate([9, 7, 5, 3, 1])] + [(2, 0, 4), (2, 1, 4), (2, 2, 0)], "group_id int, node_id int, match_index int")
    entries = spark.createDataFrame([(1, i, 1 if i < 5 else 2) for i in range(1, 10)] + [(2, i, 1) for i in range(1, 5)], "group_id int, index int, term int")
    got = {r.group_id: r.commit_index for r in recovery.commit_index(match, entries, F.lit(2)).collect()}
    assert got == {1: 5, 2: 0}
    follower = entries.where("group_id = 1 and index < 5").unionByName(spark.createDataFrame([(1, 5, 1)], "group_id int, index int, term int"))
    assert recovery.conflict_index(entries.where("group_id = 1"), follower).first().conflict_index == 5
    votes = spark.createDataFrame([(2, 1, 1, 9), (2, 5, 2, 5), (2, 4, 2, 5), (1, 9, 2, 1)], "t int, i int, ot int, oi int")
    assert [r.v for r in votes.select(recovery.up_to_date(F.col("t"), F.col("i"), F.col("ot"), F.col("oi")).alias("v")).collect()] == [True, True, False, False]


def test_two_phase_commit_resends(spark):
    rows = spark.createDataFrame([(1, "decided"), (1, "finished"), (2, "decided"), (3, "prepared")], "tx int, what string")
    got = {r.tx: (r.decision, r.resend) for r in recovery.outcomes(rows, "tx", F.col("what") == "decided", F.col("what") == "finished").collect()}
    assert got == {1: ("COMMIT", False), 2: ("COMMIT", True), 3: ("ABORT", False)}


def test_visibility(spark):
    rows = spark.createDataFrame([("own write", 50, None), ("own delete of another's", 1, 50), ("active writer", 7, None), ("active deleter", 1, 7), ("aborted writer", 8, None), ("aborted deleter", 1, 8), ("later", 99, None), ("deleted", 1, 2), ("bound", 10, None)], "v string, xmin long, xmax long")
    gone = spark.createDataFrame([(8,)], "tx long")
    got = {r.v for r in mvcc.visible(rows, mvcc.Snapshot(10, (7,), 50), gone).collect()}
    assert got == {"own write", "active deleter", "aborted deleter", "bound"}
    assert mvcc.vacuumed(rows, 5, gone).where("v = 'deleted'").count() == 0
    assert mvcc.vacuumed(rows, 100, gone).where("v = 'aborted deleter'").count() == 1


def test_isolation(spark):
    first, second = mvcc.Snapshot(1), mvcc.Snapshot(2)
    assert mvcc.statement_snapshots("READ COMMITTED", [first, second]) == [first, second]
    assert mvcc.statement_snapshots("SERIALIZABLE", [first, second]) == [first, first]
    reads = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "b", 1), (1, "b", 1), (2, "a", 1)], "tx int, key string, version int")
    writes = spark.createDataFrame([(1, "a"), (2, "b")], "tx int, key string")
    assert [tuple(r) for r in mvcc.non_repeatable_reads(reads).collect()] == [(1, "a")]
    assert [tuple(r) for r in mvcc.write_skews(reads, writes).collect()] == [(1, 2)]
    scans = spark.createDataFrame([(1, "p", 1, "a"), (1, "p", 2, "a"), (1, "p", 2, "b"), (2, "p", 1, "a"), (2, "p", 2, "a"), (3, "p", 1, "a")], "tx int, predicate string, scan int, key string")
    assert [tuple(r) for r in mvcc.phantoms(scans).collect()] == [(1, "p")]
    updates = spark.createDataFrame([(1, "a", 0, 1), (2, "a", 0, 2), (3, "a", 2, 3), (4, "b", 0, 4)], "tx int, key string, read_version int, version int")
    assert [tuple(r) for r in mvcc.lost_updates(updates).collect()] == [(2, "a", 1)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "src int, dst int")
    assert [r.pivot for r in mvcc.dangerous_structures(edges).collect()] == [2]


def test_locks_and_deadlocks(spark):
    m = {(r.held, r.req): r.ok for r in locks.matrix(spark).collect()}
    assert len(m) == 25 and all(m[a, b] == m[b, a] for a, b in m) and m["IS", "SIX"] and not m["IX", "SIX"]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")
    found = locks.cycles(edges)
    assert {r.src: r.cycle_len for r in found.collect()} == {1: 3, 2: 3, 3: 3, 5: 1}
    tx = spark.createDataFrame([(i, 10 - i, i) for i in range(1, 6)], "tx int, started int, work int")
    assert locks.victims(found, tx).first().tx == 1 and locks.victims(found, tx, "least work").first().tx == 1
    assert {(r.src, r.dst) for r in locks.waiting(edges).collect()} == {(1, 2), (2, 3), (3, 1), (5, 5)}
    assert locks.waiting(edges.where("src < 3")).count() == 0


def test_ring_is_balanced_and_moves_little(spark):
    keys = spark.range(20_000).toDF("k")
    five = {r.k: r.node_id for r in routing.by_ring(keys, "k", [1, 2, 3, 4, 5]).collect()}
    six = {r.k: r.node_id for r in routing.by_ring(keys, "k", [1, 2, 3, 4, 5, 6]).collect()}
    moved = [k for k in five if five[k] != six[k]]
    assert all(six[k] == 6 for k in moved) and 0.1 < len(moved) / 20_000 < 0.25
    assert max(list(five.values()).count(n) for n in range(1, 6)) < 5200
    places = sorted((r.position, r.node_id) for r in routing.ring(spark, [1, 2, 3, 4, 5]).collect())
    for r in keys.limit(500).select("k", F.xxhash64("k").alias("h")).collect():
        assert five[r.k] == next((n for p, n in places if p >= r.h), places[0][1])


def test_ranges_are_disjoint_and_split(spark):
    ranges = spark.createDataFrame([(0, 5), (5, 9), (8, 12)], "low int, high int")
    assert routing.disjoint(ranges).count() == 1 and routing.disjoint(ranges.where("low < 8")).count() == 0
    assert routing.split_key(spark.createDataFrame([(i,) for i in (5, 1, 3, 2)], "k int"), "k").first().k == 2
    assert routing.split_key(spark.createDataFrame([], "k int"), "k").count() == 0
    assert routing.oversized(spark.createDataFrame([(1, 1 << 27), (2, 5)], "partition_id int, size_bytes long")).count() == 1


def test_crc32c(spark):
    def slow(data):
        c = 0xFFFFFFFF
        for b in data:
            c ^= b
            for _ in range(8):
                c = c >> 1 ^ (checksum.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    rng = random.Random(42)
    values = [b"123456789", b"", *[rng.randbytes(n) for n in range(0, 4097, 170)]]
    got = checksum.crc32c_of(values).tolist()
    assert got[:2] == [0xE3069283, 0] and got == [slow(v) for v in values]
    df = spark.createDataFrame([(b"123456789",), (None,), (b"",)], "v binary")
    assert [r.c for r in df.select(checksum.crc32c(F.col("v")).alias("c")).collect()] == [0xE3069283, None, 0]


def test_bloom(spark):
    assert bloom.sizing(2000, 0.01) == (19171, 7) and bloom.sizing(0, 0.01) == (64, 30)
    keys = spark.range(2000).selectExpr("concat('present_key_', id) as k")
    f = bloom.from_bytes(bloom.to_bytes(bloom.build(keys, "k", 2000, 0.01)))
    assert all(f.mightContainString(f"present_key_{i}") for i in range(2000))
    assert sum(f.mightContainString(f"absent_key_{i}") for i in range(5000)) < 150
    data = bloom.hashes_of(keys, "k", 2000)
    asked = spark.range(7000).selectExpr("id", "case when id < 2000 then concat('present_key_', id) else concat('absent_key_', id) end as k")
    assert asked.where(~bloom.may_contain(data, F.col("k"))).where("id < 2000").count() == 0
    assert asked.where(bloom.may_contain(data, F.col("k"))).where("id >= 2000").count() < 150
    got = bloom.semi_join(asked, "k", keys.union(spark.createDataFrame([(None,)], "k string")), "k")
    assert "might_contain" in got._jdf.queryExecution().toString() and got.count() == 2000
    assert bloom.semi_join(asked, "k", keys.limit(0), "k").count() == 0


def test_phi(spark):
    df = spark.createDataFrame([(10.0, 10.0, 1.0), (15.0, 10.0, 1.0), (100.0, 10.0, 1.0), (11.0, 10.0, 0.0), (None, 1.0, 1.0)], "t double, m double, s double")
    got = [r.p for r in df.select(suspicion.phi(F.col("t"), F.col("m"), F.col("s")).alias("p")).collect()]
    assert got[0] == pytest.approx(math.log10(2)) and got[1] == pytest.approx(-math.log10(0.5 * math.erfc(5 / math.sqrt(2))))
    assert got[2] > 1700 and got[3] == math.inf and got[4] is None
    many = spark.createDataFrame([(x / 7, 0.0, 1.0) for x in range(-60, 200)], "t double, m double, s double")
    for r in many.withColumn("p", suspicion.phi(F.col("t"), F.col("m"), F.col("s"))).collect():
        assert r.p == pytest.approx(-math.log10(0.5 * math.erfc(r.t / math.sqrt(2))), abs=1e-6)


def test_identifiers(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 0), ((1 << 32) - 1, 0)], "p long, s int").withColumn("r", identifiers.record_id(F.col("p"), F.col("s")))
    got = [r.x for r in df.orderBy(F.asc_nulls_last("r.page_id"), "r").select(identifiers.shown("record", F.col("r")).alias("x")).collect()]
    assert got == ["RID(1:0)", "RID(1:1)", "RID(2:0)", None]
    shown = df.select(identifiers.shown("page", F.lit(1)).alias("p"), identifiers.shown("lsn", F.lit(100)).alias("l"), identifiers.shown("lsn", F.lit(0)).alias("z"), identifiers.shown("term", F.lit(0)).alias("t")).first()
    assert tuple(shown) == ("Page(1)", "LSN(100)", None, "Term(0)")
