"""A query for each operator, in the DataFrame API; sparkloom.oracle has the SQL that says what each must return."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom import oracle
from sparkloom.functions import bloom, checksum, suspicion
from sparkloom.operators import locks, mvcc, recovery, relational as R, routing, versioned as V
from sparkloom.oracle import ORACLE as _SQL
from sparkloom.plans import frontdoor, stats
from sparkloom.session import shared_dir, shipped
from sparkloom.sources import manifest
from sparkloom.sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as versions: the user is the key, the event's number its sequence, an error a delete."""
    e = table(spark, d, "events")
    return e.select("user_id", F.col("event_id").alias("seq"), "value", (F.col("event_type") == "error").alias("tomb"))


_KEYED = {"key": "user_id", "tombstone": "tomb"}


# --- relational


def scan_seq(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


_indexes: dict[tuple[str, str], DataFrame] = {}


def _index(spark, d):
    """The index of orders by their key, made once for each folder and application."""
    at = spark.sparkContext.applicationId, d
    if at not in _indexes:
        _indexes[at] = frontdoor.create_index(table(spark, d, "orders"), f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", "o_orderkey")
    return _indexes[at]


def index_point(spark, d):
    return frontdoor.index_lookup(_index(spark, d), "o_orderkey", 42).select("o_orderkey", "o_custkey", "o_totalprice")


def index_range(spark, d):
    return frontdoor.index_lookup(_index(spark, d), "o_orderkey", 100, 200).select("o_orderkey", "o_totalprice")


def filter_bool(spark, d):
    c = F.col
    kept = (c("l_quantity") > F.lit(18) + 2) & ((c("l_discount") < 0.05) | (c("l_returnflag") == "R")) & ~(c("l_linestatus") == "F")
    return table(spark, d, "lineitem").where(kept).select("l_orderkey", "l_linenumber", "l_quantity")


def filter_between(spark, d):
    return table(spark, d, "part").where(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


def project_expr(spark, d):
    return R.project(table(spark, d, "orders"), o_orderkey="o_orderkey", dbl_price=F.col("o_totalprice") * 2, next_cust=F.col("o_custkey") + 1)


def hash_join_inner(spark, d):
    return R.equi_join(table(spark, d, "customer"), table(spark, d, "orders"), {"c_custkey": "o_custkey"}).select("c_custkey", "o_orderkey", "o_totalprice")


def hash_join_left(spark, d):
    dear = table(spark, d, "orders").where("o_totalprice > 450000")
    return R.equi_join(table(spark, d, "customer"), dear, {"c_custkey": "o_custkey"}, "left").select("c_custkey", "o_orderkey")


def nested_loop_join(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    return R.theta_join(nation, region, nation.n_regionkey < region.r_regionkey).select("n_nationkey", "r_regionkey")


def hash_agg(spark, d):
    quantity = R.exact_sum(F.col("l_quantity")) / F.count("l_quantity")
    return R.aggregate(
        table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], cnt=F.count("*"), sum_price=R.exact_sum(F.col("l_extendedprice")),
        min_ship=F.min("l_shipdate"), max_qty=F.max("l_quantity"), avg_qty=quantity,
    )


def global_agg_empty(spark, d):
    return table(spark, d, "orders").where("o_orderkey < 0").agg(F.count("*").alias("cnt"), F.min("o_orderkey").alias("mn"), F.max("o_orderkey").alias("mx"))


def having(spark, d):
    return R.aggregate(table(spark, d, "orders"), ["o_custkey"], having=F.col("cnt") > 12, cnt=F.count("*"))


def topk_offset(spark, d):
    return R.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 10, 5)


def sort_all(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


def partial_final_agg(spark, d):
    parts = R.partial(table(spark, d, "lineitem"), ["l_returnflag"], F.col("l_orderkey") % 8, "l_quantity")
    return R.final(parts, ["l_returnflag"]).select("l_returnflag", F.col("total").alias("sum_qty"), F.col("n").alias("cnt"), F.col("mean").alias("avg_qty"))


def flagship(spark, d):
    lines = table(spark, d, "lineitem").where(F.col("l_quantity") > F.lit(18) + 2)
    orders, customers, nations = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    joined = R.equi_join(R.equi_join(R.equi_join(lines, orders, {"l_orderkey": "o_orderkey"}), customers, {"o_custkey": "c_custkey"}), nations, {"c_nationkey": "n_nationkey"})
    by_nation = R.aggregate(joined, ["n_name"], having=F.col("cnt") > 10, revenue=R.exact_sum(F.col("l_extendedprice")), cnt=F.count("*"))
    return R.top(by_nation, [F.desc("revenue"), F.asc("n_name")], 10)


def dml_insert(spark, d):
    return R.inserted(table(spark, d, "nation").select("n_nationkey", "n_name"), spark.createDataFrame([(99, "NEW")], "n_nationkey int, n_name string"))


def dml_update(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return R.updated(rows, F.col("c_mktsegment") == "AUTOMOBILE", c_acctbal=F.col("c_acctbal") + 100).drop("c_mktsegment")


def dml_delete(spark, d):
    return R.deleted(table(spark, d, "customer"), F.col("c_acctbal") < 0).select("c_custkey")


def sql_update(spark, d):
    text = "update customer set c_acctbal = c_acctbal + 100, c_name = concat(c_name, '*') where c_mktsegment = 'AUTOMOBILE' and c_acctbal > 0"
    return frontdoor.sql(spark, d, text).select("c_custkey", "c_acctbal", "c_name")


def sql_delete(spark, d):
    return frontdoor.sql(spark, d, "delete from customer where c_acctbal < 0").select("c_custkey")


def constraint_pk(spark, d):
    return R.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("count").alias("cnt"))


def constraint_fk(spark, d):
    return R.orphans(table(spark, d, "orders"), table(spark, d, "customer").where("c_acctbal >= 0"), "o_custkey", "c_custkey").select("o_orderkey")


# --- versions


def lsm_scan(spark, d):
    return V.scan(_events(spark, d), **_KEYED).select("user_id", "seq", "value")


def lsm_range(spark, d):
    return V.scan(_events(spark, d), 10, 50, **_KEYED).select("user_id", "seq", "value")


def lsm_get(spark, d):
    return V.get(_events(spark, d), 7, **_KEYED).select("user_id", "seq", "value")


def _runs(spark, d):
    """The events' four runs."""
    e = _events(spark, d)
    return V.merged([e.where(f"seq % 4 = {i}") for i in range(4)])


def lsm_compact_keep(spark, d):
    return V.compacted(_runs(spark, d), False, **_KEYED).select("user_id", "seq", "tomb")


def lsm_compact_drop(spark, d):
    return V.compacted(_runs(spark, d), True, **_KEYED).select("user_id", "seq", "tomb")


def lsm_entries(spark, d):
    """Entry order and size of binary keys."""
    e = _events(spark, d)
    rows = V.puts(e, F.col("user_id").cast("string"), F.col("value").cast("string"), F.col("seq"))
    out = V.ordered(rows).withColumn("bytes", V.entry_size().cast("long"))
    return out.select(F.col("key").cast("string").alias("k"), "seq", (F.col("bytes") - F.octet_length("value")).alias("key_bytes"))


def _described(spark, d, level: Column, number: Column):
    return manifest.described(table(spark, d, "events"), level, number, "user_id", F.length(F.col("user_id").cast("string")) + 9)


def _key(column: str) -> Column:
    return F.col(column).cast("string").cast("long").alias(column)


def lsm_manifest(spark, d):
    files = _described(spark, d, F.lit(0), F.col("event_id") % 4)
    return files.select(F.col("file_number").alias("file_no"), _key("smallest_key"), _key("largest_key"), "key_count")


def _levels(spark, d):
    """Four first-level runs, and the second level's runs by ranges of fifty users."""
    first = F.col("event_id") % 5
    return _described(spark, d, F.when(first < 4, 0).otherwise(1), F.when(first < 4, first + 1).otherwise(10 + F.floor(F.col("user_id") / 50)))


def lsm_level_stats(spark, d):
    return manifest.level_stats(_levels(spark, d)).select("level", "files", "bytes", _key("smallest_key"), _key("largest_key"))


def lsm_compaction_pick(spark, d):
    task = manifest.leveled(manifest.loaded(_levels(spark, d)))
    return spark.createDataFrame([(f.level, f.file_number, task.target, task.drop_tombstones) for f in task.inputs], "level int, file_number long, target int, drop_tombstones boolean")


def overlap_join(spark, d):
    """Which of the first four files of forty meet which of the others."""
    files = table(spark, d, "events").groupBy((F.col("event_id") % 40).alias("file_no")).agg(F.min("user_id").alias("lo"), F.max("user_id").alias("hi"))
    a, b = files.where("file_no < 4").alias("a"), files.where("file_no >= 4").alias("b")
    on = manifest.overlap(F.col("a.lo"), F.col("a.hi"), F.col("b.lo"), F.col("b.hi"))
    return R.theta_join(a, b, on).select(F.col("a.file_no").alias("src"), F.col("b.file_no").alias("dst"))


def bloom_semi(spark, d):
    cars = table(spark, d, "customer").where("c_mktsegment = 'AUTOMOBILE'")
    return bloom.semi_join(table(spark, d, "orders"), "o_custkey", cars, "c_custkey").select("o_orderkey")


# --- logs, versions, locks


def _log(spark, d):
    """Events as a log: the user is the transaction, purchase commits and error aborts."""
    kind = F.when(F.col("event_type") == "purchase", "COMMIT").when(F.col("event_type") == "error", "ABORT").otherwise("UPDATE")
    page = F.when(F.col("event_type").isin("click", "view"), F.col("user_id") % 16)
    return table(spark, d, "events").select(
        F.col("event_id").alias("lsn"), F.col("user_id").alias("tx_id"), kind.alias("type"), page.alias("page_id"), F.col("event_type").alias("slot"),
        F.col("value").cast("string").cast("binary").alias("after_image"),
    )


def wal_att(spark, d):
    return recovery.active_transactions(_log(spark, d))


def wal_dpt(spark, d):
    return recovery.dirty_pages(_log(spark, d))


def wal_redo(spark, d):
    return recovery.redone(_log(spark, d)).select("page_id", "slot", "page_lsn")


def wal_undo(spark, d):
    """What transactions without an end go back to."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type").isin("click", "view"), "UPDATE").when(F.col("event_type") == "purchase", "COMMIT").when(F.col("event_type") == "error", "ABORT").otherwise("OTHER")
    image = F.round(F.col("value") * 100).cast("long").cast("string")
    place = Window.partitionBy(F.col("user_id") % 16, "event_type").orderBy("event_id")
    log = e.select(
        F.col("event_id").alias("lsn"), F.col("user_id").alias("tx_id"), kind.alias("type"), (F.col("user_id") % 16).alias("page_id"), F.col("event_type").alias("slot"),
        F.lag(image).over(place).cast("binary").alias("before_image"), F.lit(None).cast("long").alias("undo_next_lsn"),
    )
    return recovery.undone(log).withColumn("image", F.col("image").cast("string"))


def two_pc(spark, d):
    return recovery.outcomes(table(spark, d, "events"), "user_id", F.col("event_type") == "purchase").withColumnRenamed("user_id", "tx_id")


def raft_commit(spark, d):
    """Groups of users: each node's last event is its match index, the group's log the events up to there."""
    e = table(spark, d, "events").withColumns({"group_id": F.col("user_id") % 10, "node_id": F.col("user_id") % 50})
    match = e.groupBy("group_id", "node_id").agg(F.max("event_id").alias("match_index"))
    return recovery.commit_index(match, e.select("group_id", F.col("event_id").alias("index"), (F.col("event_id") % 2).alias("term")), F.lit(1))


def _versions(spark, d):
    return mvcc.with_xmax(table(spark, d, "events").select("user_id", F.col("event_id").alias("xmin"), "value"), "user_id")


def mvcc_visible(spark, d):
    return mvcc.visible(_versions(spark, d), mvcc.Snapshot(5000, (4900, 4950, 4990))).select("user_id", "xmin", "value")


def vacuum(spark, d):
    return mvcc.vacuumed(_versions(spark, d), 5000).select("user_id", "xmin")


def first_committer(spark, d):
    writes = table(spark, d, "events").select("user_id", "event_id")
    return mvcc.first_committer_losers(writes, "user_id", F.col("event_id") - 20, F.col("event_id"), "event_id", width=20)


def ssi_pivots(spark, d):
    """Readers of each ten events against the writers of the next ten."""
    e = table(spark, d, "events")
    reads = e.where("event_type in ('click', 'view')").select(F.col("user_id").alias("src"), F.floor(F.col("event_id") / 10).alias("k"))
    writes = e.where("event_type = 'purchase'").select(F.col("user_id").alias("dst"), (F.floor(F.col("event_id") / 10) - 1).alias("k"))
    return mvcc.dangerous_structures(reads.join(writes, "k").where("src <> dst and src % 10 = dst % 10").select("src", "dst"))


def write_skew(spark, d):
    """Of users that read and write the same ten events."""
    e = table(spark, d, "events").select(F.col("user_id").alias("tx"), F.floor(F.col("event_id") / 10).alias("key"), "event_type")
    return mvcc.write_skews(e.where("event_type in ('click', 'view')").drop("event_type"), e.where("event_type = 'purchase'").drop("event_type"))


def lost_update(spark, d):
    """Writes of a user's row over the version of the same twenty events."""
    e = table(spark, d, "events")
    return mvcc.lost_updates(e.select(F.col("event_id").alias("tx"), F.col("user_id").alias("key"), F.floor(F.col("event_id") / 20).alias("read_version"), F.col("event_id").alias("version")))


def phantom(spark, d):
    """Each user scans each type of events in turns."""
    e = table(spark, d, "events")
    return mvcc.phantoms(e.select(F.col("user_id").alias("tx"), F.col("event_type").alias("predicate"), (F.col("event_id") % 2).alias("scan"), (F.col("event_id") % 3).alias("key")))


def lock_conflict(spark, d):
    asked = [("IS", "IS"), ("IS", "IX"), ("IS", "S"), ("IS", "SIX"), ("IS", "X"), ("IX", "IX"), ("IX", "S"), ("S", "S"), ("S", "SIX"), ("X", "X")]
    return spark.createDataFrame(asked, "held string, req string").join(F.broadcast(locks.matrix(spark).where("not ok")), ["held", "req"], "left_semi")


def lock_waits(spark, d):
    """Orders as requests for their customer: urgent ones exclusive, the others shared."""
    mode = F.when(F.col("o_orderpriority").startswith("1"), "X").otherwise("S")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("resource"), F.col("o_orderkey").alias("tx"), mode.alias("mode"))
    return locks.conflicts(rows, rows)


def deadlock_cycle(spark, d):
    n = table(spark, d, "nation")
    return locks.cycles(n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst")))


# --- routing and statistics


def route_range(spark, d):
    return table(spark, d, "orders").groupBy(routing.by_width(F.col("o_orderkey"), 4096).alias("partition_id")).agg(F.count("*").alias("cnt"))


def route_bounds(spark, d):
    return routing.by_range(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", [0, 1000, 5000, 12000]).groupBy("partition_id").agg(F.count("*").alias("cnt"))


def route_hash(spark, d):
    return table(spark, d, "orders").select("o_orderkey", routing.by_hash(F.col("o_orderkey"), 16).alias("partition_id"))


def ring_route(spark, d):
    return routing.by_ring(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", [1, 2, 3, 4, 5])


def split_key(spark, d):
    return routing.split_key(table(spark, d, "orders"), "o_orderkey")


def col_stats(spark, d):
    return stats.column_stats(table(spark, d, "orders"), "o_custkey")


def equi_depth(spark, d):
    return stats.equi_depth(table(spark, d, "orders"), "o_totalprice", "o_orderkey", 16)


def percentiles(spark, d):
    return stats.percentiles(table(spark, d, "events"), "event_type", "value", p50=0.5, p99=0.99)


def _beats(spark, d):
    return table(spark, d, "events").select("event_id", "user_id")


def phi_window(spark, d):
    return suspicion.moments(_beats(spark, d), "user_id", "event_id").select("event_id", F.col("gap").alias("gap_us"), F.col("n").alias("cnt"))


def phi_moments(spark, d):
    return suspicion.gaps(_beats(spark, d), "user_id", "event_id").groupBy("user_id").agg(F.count("gap").alias("n"), F.avg("gap").alias("mu"))


def phi_level(spark, d):
    m = suspicion.moments(_beats(spark, d), "user_id", "event_id")
    return m.select("event_id", F.round(suspicion.phi(F.col("gap"), F.col("mu"), F.col("sigma")), 6).alias("phi"), suspicion.suspected(F.col("gap"), F.col("n"), F.col("mu"), F.col("sigma"), 1000.0).alias("suspect"))


def crc32c(spark, d):
    return table(spark, d, "customer").select("c_custkey", checksum.crc32c(F.col("c_name")).alias("crc"))


def json_log(spark, d):
    """Structured log lines: a field out of JSON text."""
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k long").k.alias("k"))


_ALL = [
    scan_seq, index_point, index_range, filter_bool, filter_between, project_expr, hash_join_inner, hash_join_left, nested_loop_join, hash_agg,
    global_agg_empty, having, topk_offset, sort_all, partial_final_agg, flagship, dml_insert, dml_update, dml_delete, sql_update, sql_delete, constraint_pk,
    constraint_fk,
    lsm_scan, lsm_range, lsm_get, lsm_compact_keep, lsm_compact_drop, lsm_entries, lsm_manifest, lsm_level_stats, lsm_compaction_pick,
    overlap_join, bloom_semi,
    wal_att, wal_dpt, wal_redo, wal_undo, two_pc, raft_commit, mvcc_visible, vacuum, first_committer, ssi_pivots, write_skew, lost_update, phantom,
    lock_conflict, lock_waits, deadlock_cycle,
    route_range, route_bounds, route_hash, ring_route, split_key, col_stats, equi_depth, percentiles, phi_window, phi_moments, phi_level, crc32c, json_log,
]

QUERIES = {f.__name__: shipped(f) for f in _ALL}

ORACLE = _SQL | {
    "filter_between": "select p_partkey, p_size from part where p_size between 10 and 20",
    "sort_all": "select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey",
    "constraint_pk": "select l_orderkey, l_linenumber, count(*) as cnt from lineitem group by 1, 2 having count(*) > 1",
    "constraint_fk": "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0)",
    "lsm_entries": "select cast(user_id as varchar) as k, event_id as seq, cast(length(cast(user_id as varchar)) + 9 as bigint) as key_bytes from events",
    "wal_dpt": "select user_id % 16 as page_id, min(event_id) as rec_lsn from events where event_type in ('click','view') group by 1",
    "raft_commit": """
        with m as (select user_id % 10 as g, user_id % 50 as n, max(event_id) as i from events group by 1, 2),
        r as (select g, i, row_number() over (partition by g order by i desc) as rn, count(*) over (partition by g) as c from m),
        k as (select g, i from r where rn = c // 2 + 1)
        select k.g as group_id, coalesce(max(e.event_id), 0) as commit_index from k left join events e
            on e.user_id % 10 = k.g and e.event_id <= k.i and e.event_id % 2 = 1 group by 1""",
    "ssi_pivots": """
        with r as (select user_id as src, event_id // 10 as k from events where event_type in ('click', 'view')),
        w as (select user_id as dst, event_id // 10 - 1 as k from events where event_type = 'purchase'),
        e as (select src, dst from r join w using (k) where src <> dst and src % 10 = dst % 10)
        select distinct dst as pivot from e where dst in (select src from e)""",
    "write_skew": """
        with r as (select user_id as tx, event_id // 10 as k from events where event_type in ('click', 'view')),
        w as (select user_id as tx, event_id // 10 as k from events where event_type = 'purchase'),
        e as (select distinct r.tx as a, w.tx as b from r join w using (k) where r.tx <> w.tx)
        select e.a, e.b from e join e f on e.a = f.b and e.b = f.a where e.a < e.b""",
    "lost_update": """
        select tx, key, lost from (select event_id as tx, user_id as key, min(event_id) over (partition by user_id, event_id // 20) as lost from events)
        where tx > lost""",
    "phantom": """
        with s as (select distinct user_id as tx, event_type as predicate, event_id % 2 as scan, event_id % 3 as key from events),
        n as (select tx, predicate, count(distinct scan) as scans from s group by all),
        f as (select tx, predicate, key, count(*) as n from s group by all)
        select distinct tx, predicate from f join n using (tx, predicate) where n < scans""",
    "lock_waits": """
        with l as (select o_custkey as r, o_orderkey as tx, o_orderpriority like '1%' as x from orders)
        select a.tx as waiter, b.tx as holder, a.r as resource from l a join l b on a.r = b.r and a.tx <> b.tx and (a.x or b.x)""",
    "sql_update": """
        select c_custkey, case when c_mktsegment = 'AUTOMOBILE' and c_acctbal > 0 then c_acctbal + 100 else c_acctbal end as c_acctbal,
            case when c_mktsegment = 'AUTOMOBILE' and c_acctbal > 0 then c_name || '*' else c_name end as c_name from customer""",
    "sql_delete": "select c_custkey from customer where not (c_acctbal < 0)",
    "wal_undo": """
        with l as (select event_id as lsn, user_id as tx, user_id % 16 as page_id, event_type as slot,
            lag(cast(cast(round(value * 100) as bigint) as varchar)) over (partition by user_id % 16, event_type order by event_id) as image
            from events),
        losers as (select user_id as tx from events group by 1 having max(case when event_type in ('purchase', 'error') then event_id else -1 end) < max(event_id)),
        mine as (select * from l where tx in (select tx from losers) and slot in ('click', 'view')),
        first as (select page_id, slot, min(lsn) as lsn, count(*) as undone from mine group by all)
        select m.page_id, m.slot, m.tx as tx_id, m.image, f.undone from first f join mine m using (page_id, slot, lsn)""",
    "lsm_compact_keep": oracle.ORACLE["lsm_compact_keep"].replace(" where seq % 4 < 2", ""),
    "lsm_compact_drop": oracle.ORACLE["lsm_compact_drop"].replace(" where seq % 4 < 2", ""),
    "overlap_join": oracle.ORACLE["overlap_join"].replace(" where event_id < 200", ""),
    "lsm_level_stats": """
        with v as (select case when event_id % 5 < 4 then 0 else 1 end as level, case when event_id % 5 < 4 then event_id % 5 + 1 else 10 + user_id // 50 end as f, user_id as u from events)
        select cast(level as integer) as level, count(distinct f) as files, cast(sum(length(cast(u as varchar)) + 9) as bigint) as bytes, min(u) as smallest_key, max(u) as largest_key from v group by 1""",
    "lsm_compaction_pick": """
        with v as (select case when event_id % 5 < 4 then 0 else 1 end as level, case when event_id % 5 < 4 then event_id % 5 + 1 else 10 + user_id // 50 end as f, user_id as u from events),
        files as (select cast(level as integer) as level, f as file_number, min(u) as lo, max(u) as hi from v group by 1, 2),
        first as (select min(lo) as lo, max(hi) as hi, count(*) as n from files where level = 0)
        select level, file_number, 1 as target, true as drop_tombstones from files, first
        where n >= 4 and (level = 0 or (files.hi >= first.lo and files.lo <= first.hi))""",
    "route_hash": f"""
        with h as ({oracle.hashed("select o_orderkey as k, 42::uhugeint as seed from orders", "o_orderkey", "k")})
        select o_orderkey, ((h % 16) + 16) % 16 as partition_id from h""",
    "ring_route": f"""
        with nodes as (select n as node_id, v from range(1, 6) a(n), range(256) b(v)),
        named as ({oracle.hashed(f"select node_id, v, node_id as k, {oracle.RING}::uhugeint as seed from nodes", "node_id, v", "k")}),
        placed as ({oracle.hashed("select node_id, v as k, (case when h < 0 then h::hugeint + 18446744073709551616::hugeint else h end)::uhugeint as seed from named", "node_id", "k", small=True)}),
        ring as (select h as position, node_id from placed),
        keys as ({oracle.hashed("select o_orderkey as k, 42::uhugeint as seed from orders", "o_orderkey", "k")})
        select o_orderkey, coalesce(r.node_id, (select arg_min(node_id, position) from ring)) as node_id
        from keys asof left join ring r on keys.h <= r.position""",
    "crc32c": f"""
        with t as (select [{', '.join(map(str, oracle.crc_table()))}]::ubigint[] as t),
        b as (select c_custkey, list_prepend(4294967295::ubigint, list_transform(range(1, length(c_name) + 1), lambda i: ord(substr(c_name, i, 1))::ubigint)) as b from customer)
        select c_custkey, cast(xor(list_reduce(b, lambda c, x: xor(c >> 8, t[cast(xor(c & 255, x) + 1 as bigint)])), 4294967295::ubigint) as bigint) as crc from b, t""",
    "phi_level": f"""
        with g as (select event_id, user_id, event_id - lag(event_id) over (partition by user_id order by event_id) as gap from events),
        m as (select event_id, gap, count(gap) over w as n, avg(gap) over w as mu, stddev_pop(gap) over w as sigma from g
            window w as (partition by user_id order by event_id rows between 999 preceding and current row)),
        z as (select *, (gap - mu) / (sigma * sqrt(2)) as x, 1.0 / (1.0 + abs((gap - mu) / (sigma * sqrt(2))) * 0.5) as u from m),
        e as (select *, ln(u) - x * x + ({oracle.polynomial(suspicion.ERFC, "u")}) as l from z),
        p as (select event_id, gap, n, case when gap is null then null when sigma > 0 then -(case when x >= 0 then l - ln(2) else ln(1.0 - exp(l) * 0.5) end) / ln(10)
            when gap > mu then 'infinity'::double else 0.0 end as phi from e)
        select event_id, round(phi, 6) as phi, case when n < 10 then gap > 1000 else phi > 8 end as suspect from p""",
    "route_bounds": "select cast(case when o_orderkey < 0 then -1 when o_orderkey < 1000 then 0 when o_orderkey < 5000 then 1 when o_orderkey < 12000 then 2 else 3 end as bigint) as partition_id, count(*) as cnt from orders group by 1",
    "json_log": "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events",
}
