"""What each query must return, as DuckDB SQL over the same tables."""

ORACLE = {
    "scan_seq": """select n_nationkey,n_name,n_regionkey from nation""",
    "index_point": """select o_orderkey,o_custkey,o_totalprice from orders where o_orderkey = 42""",
    "index_range": """select o_orderkey,o_totalprice from orders where o_orderkey >= 100 and o_orderkey < 200""",
    "filter_bool": """select l_orderkey,l_linenumber,l_quantity from lineitem where l_quantity > 18 + 2 and (l_discount < 0.05 or l_returnflag = 'R') and not (l_linestatus = 'F')""",
    "project_expr": """select o_orderkey, o_totalprice * 2 as dbl_price, o_custkey + 1 as next_cust from orders""",
    "hash_join_inner": """select c_custkey,o_orderkey,o_totalprice from customer join orders on c_custkey = o_custkey""",
    "hash_join_left": """select c_custkey,o_orderkey from customer left join (select * from orders where o_totalprice > 450000) o on c_custkey = o_custkey""",
    "nested_loop_join": """select n_nationkey,r_regionkey from nation join region on n_regionkey < r_regionkey""",
    "hash_agg": """select l_returnflag,l_linestatus,count(*) as cnt,cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as sum_price,min(l_shipdate) as min_ship,max(l_quantity) as max_qty,cast(sum(cast(l_quantity as decimal(18,2))) as double)/count(l_quantity) as avg_qty from lineitem group by l_returnflag,l_linestatus""",
    "global_agg_empty": """select count(*) as cnt, min(o_orderkey) as mn, max(o_orderkey) as mx from orders where o_orderkey < 0""",
    "having": """select o_custkey,count(*) as cnt from orders group by o_custkey having count(*) > 12""",
    "topk_offset": """select o_orderkey,o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 10 offset 5""",
    "flagship": """select n_name, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue, count(*) as cnt from lineitem join orders on l_orderkey=o_orderkey join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey where l_quantity > 18+2 group by n_name having count(*) > 10 order by revenue desc, n_name limit 10""",
    "lsm_scan": """select user_id,seq,value from (select *, row_number() over (partition by user_id order by seq desc) as rn from (select user_id, event_id as seq, event_type, value, event_type='error' as tomb from events) v) x where rn = 1 and not tomb""",
    "lsm_range": """select user_id,seq,value from (select *, row_number() over (partition by user_id order by seq desc) as rn from (select user_id, event_id as seq, event_type, value, event_type='error' as tomb from events) v where user_id >= 10 and user_id < 50) x where rn = 1 and not tomb""",
    "lsm_compact_keep": """select user_id,seq,tomb from (select *, row_number() over (partition by user_id order by seq desc) as rn from (select user_id, event_id as seq, event_type, value, event_type='error' as tomb from events) v where seq % 4 < 2) x where rn = 1""",
    "lsm_manifest": """select event_id % 4 as file_no, min(user_id) as smallest_key, max(user_id) as largest_key, count(*) as key_count from events group by event_id % 4""",
    "bloom_semi": """select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'AUTOMOBILE')""",
    "wal_att": """select user_id as tx_id, max(event_id) as last_lsn from events group by user_id having max(case when event_type in ('purchase','error') then event_id else -1 end) < max(event_id)""",
    "wal_redo": """select user_id % 16 as page_id, event_type as slot, max(event_id) as page_lsn from events where event_type in ('click','view') group by user_id % 16, event_type""",
    "mvcc_visible": """select user_id, xmin, value from (select user_id, event_id as xmin, lead(event_id) over (partition by user_id order by event_id) as xmax, value from events) v where xmin <= 5000 and xmin not in (4900,4950,4990) and (xmax is null or xmax > 5000 or xmax in (4900,4950,4990))""",
    "lock_conflict": """with m(held,req,ok) as (values ('IS','IS',true),('IS','IX',true),('IS','S',true),('IS','SIX',true),('IS','X',false),('IX','IX',true),('IX','S',false),('S','S',true),('S','SIX',false),('X','X',false)) select held,req from m where not ok""",
    "deadlock_cycle": """with recursive w(src,dst,d) as (select n_nationkey, (n_nationkey*7+3) % 25, 1 from nation union all select w.src, (w.dst*7+3) % 25, d+1 from w where w.d < 25 and w.src <> w.dst) select src, min(d) as cycle_len from w where src = dst group by src""",
    "route_range": """select cast(floor(o_orderkey / 4096.0) as bigint) as partition_id, count(*) as cnt from orders group by 1""",
    "col_stats": """select count(*) as n_rows, count(distinct o_custkey) as ndv, min(o_custkey) as mn, max(o_custkey) as mx from orders""",
    "equi_depth": """select cast(b as bigint) as b, min(o_totalprice) as lo, max(o_totalprice) as hi, count(*) as cnt from (select o_totalprice, ntile(16) over (order by o_totalprice, o_orderkey) as b from orders) t group by b""",
    "phi_window": """select event_id, cast(gap_us as bigint) as gap_us, cnt from (select event_id, gap_us, count(gap_us) over (partition by user_id order by event_id rows between 999 preceding and current row) as cnt from (select event_id,user_id, event_id - lag(event_id) over (partition by user_id order by event_id) as gap_us from events) a) b""",
    "first_committer": """select a.event_id as loser, min(b.event_id) as winner from events a join events b on a.user_id=b.user_id and b.event_id < a.event_id and a.event_id - b.event_id < 20 group by a.event_id""",
    "dml_update": """select c_custkey, case when c_mktsegment='AUTOMOBILE' then c_acctbal + 100 else c_acctbal end as c_acctbal from customer""",
    "dml_delete": """select c_custkey from customer where not (c_acctbal < 0)""",
    "dml_insert": """select n_nationkey,n_name from nation union all select 99 as n_nationkey, 'NEW' as n_name""",
    "lsm_get": """select user_id,seq,value from (select *, row_number() over (partition by user_id order by seq desc) as rn from (select user_id, event_id as seq, event_type, value, event_type='error' as tomb from events) v where user_id = 7) x where rn = 1 and not tomb""",
    "lsm_compact_drop": """select user_id,seq,tomb from (select *, row_number() over (partition by user_id order by seq desc) as rn from (select user_id, event_id as seq, event_type, value, event_type='error' as tomb from events) v where seq % 4 < 2) x where rn = 1 and not tomb""",
    "partial_final_agg": """select l_returnflag, cast(sum(ps) as double) as sum_qty, cast(sum(pc) as bigint) as cnt, cast(sum(ps) as double)/cast(sum(pc) as bigint) as avg_qty from (select l_returnflag, l_orderkey % 8 as shard, sum(cast(l_quantity as decimal(18,2))) as ps, count(l_quantity) as pc from lineitem group by l_returnflag, l_orderkey % 8) p group by l_returnflag""",
    "phi_moments": """select user_id, count(gap) as n, avg(gap) as mu from (select user_id, event_id - lag(event_id) over (partition by user_id order by event_id) as gap from events) g group by user_id""",
    "vacuum": """select user_id, xmin from (select user_id, event_id as xmin, lead(event_id) over (partition by user_id order by event_id) as xmax from events) v where xmax is null or xmax >= 5000""",
    "split_key": """select o_orderkey from (select o_orderkey, row_number() over (order by o_orderkey) as rn, count(*) over () as n from orders) t where rn = (n + 1) // 2""",
    "two_pc": """select user_id as tx_id, case when max(case when event_type='purchase' then 1 else 0 end)=1 then 'COMMIT' else 'ABORT' end as decision from events group by user_id""",
    "overlap_join": """with f as (select event_id % 40 as file_no, min(user_id) as lo, max(user_id) as hi from events where event_id < 200 group by event_id % 40) select a.file_no as src, b.file_no as dst from f a join f b on b.hi >= a.lo and b.lo <= a.hi and a.file_no < 4 and b.file_no >= 4""",
    "percentiles": """select event_type, quantile_cont(value,0.5) as p50, quantile_cont(value,0.99) as p99 from events group by 1""",
}


# --- what DuckDB lacks, written out

#: The constants of 64-bit xxHash. Fixed values.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)

#: That hash of the text "ring" with seed 42, which starts the hashes of a ring's places.
RING = 10803535679872668612


def hashed(rows: str, keep: str, key: str, small: bool = False) -> str:
    """SQL that adds h, the 64-bit xxHash (signed) of a key of 64 bits, or of 32 (small). rows: a select with the key (0 or
    more) and seed, as a number of 128 bits."""
    p1, p2, p3, p4, p5 = (f"{p}::uhugeint" for p in PRIMES)
    mod = f"{1 << 64}::uhugeint"

    def turned(x: str, n: int) -> str:
        return f"((({x}) * {1 << n}::uhugeint) % {mod} + ({x}) // {1 << (64 - n)}::uhugeint)"

    def xor(a: str, b: str) -> str:
        return f"xor(({a})::ubigint, ({b})::ubigint)::uhugeint"

    if small:
        mixed, turn = f"(({key}::uhugeint) * {p1}) % {mod}", (23, p2, p3)
    else:
        mixed, turn = f"({turned(f'(({key}::uhugeint) * {p2}) % {mod}', 31)} * {p1}) % {mod}", (27, p1, p4)
    steps = [
        xor(f"(seed + {p5} + {4 if small else 8}::uhugeint) % {mod}", mixed), f"({turned('a', turn[0])} * {turn[1]} + {turn[2]}) % {mod}",
        f"({xor('a', f'a // {1 << 33}::uhugeint')} * {p2}) % {mod}", f"({xor('a', f'a // {1 << 29}::uhugeint')} * {p3}) % {mod}", xor("a", f"a // {1 << 32}::uhugeint"),
    ]
    names = [c.strip() for c in keep.split(",")]
    inner = ", ".join(f"{key} as {c}" if c == "o_orderkey" else c for c in names)
    sql = f"select {inner}, {steps[0]} as a from ({rows})"
    for step in steps[1:]:
        sql = f"select {keep}, {step} as a from ({sql})"
    return f"select {keep}, (case when a >= {1 << 63}::uhugeint then a::hugeint - {1 << 64}::hugeint else a::hugeint end)::bigint as h from ({sql})"


def crc_table() -> list[int]:
    """A byte's remainders for the checksum, by the rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        out.append(c)
    return out


def polynomial(coefficients: tuple[float, ...], x: str) -> str:
    """SQL of a polynomial, coefficients from the constant up."""
    sql = f"{coefficients[-1]!r}::double"
    for c in coefficients[-2::-1]:
        sql = f"{c!r}::double + {x} * ({sql})"
    return sql
