"""What those of the queries that SQL can express must return, as DuckDB SQL over the same tables."""

from __future__ import annotations

from . import quality_rules as rules

#: Fixed by the contracts.
WORD = r"[^\x20\x09-\x0D]"


def lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality() -> str:
    """Measures of each text, failures by source, the prior of each rule by moments, and the verdicts."""
    names = {"base_failed": "base_failed", "fail_symbols": "fail_symbols", "fail_lines": "fail_lines", "any_failed": "(base_failed or fail_symbols or fail_lines)"}
    failed = ", ".join(f"count(*) filter (where {f})::double as f_{r}" for r, f in names.items())
    means = ", ".join(f"sum(f_{r}) / sum(n) as mean_{r}, sum(f_{r} * f_{r} / n) as spread_{r}" for r in names)

    def weight(r: str) -> str:
        mean = f"mean_{r}"
        own = f"((spread_{r} - docs * {mean} * {mean}) / ({mean} * (1 - {mean})) - (hosts - 1))"
        likeness = f"case when {mean} > 0 and {mean} < 1 and hosts > 1 and docs > hosts then {own} / (docs - squares / docs - (hosts - 1)) end"
        return f"coalesce((select greatest(1.0, 1 / x - 1) from (select {likeness} as x) where x > 0), docs) as weight_{r}"

    rates = ", ".join(f"(f_{r} + weight_{r} * mean_{r}) / (n + weight_{r}) as rate_{r}" for r in names)
    return f"""
        with t as (select row_number() over () as r, doc_id, source, coalesce(text, '') as text from documents),
        w as (select *, regexp_extract_all(text, '{WORD}+') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as lines from t),
        windows as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x from (select r, w, unnest(range(1, len(w) - 1)) as i from w)),
        twice as (select r, unnest([i, i + 1, i + 2]) as i from (select r, i, count(*) over (partition by r, x) as c from windows) where c > 1),
        repeated as (select r, count(distinct i) as n_repeat_words from twice group by r),
        m as (
            select w.r, doc_id, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                len(regexp_extract_all(text, '{rules.SYMBOLS}'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
                coalesce(n_repeat_words, 0)::bigint as n_repeat_words
            from w left join repeated on w.r = repeated.r),
        f as (
            select *, n_words < {rules.MIN_WORDS} or 100 * n_repeat_words > {rules.MAX_REPEAT_PERCENT} * n_words as base_failed,
                100 * n_symbols > {rules.MAX_SYMBOL_PERCENT} * n_words as fail_symbols, 100 * n_dup_lines > {rules.MAX_DUP_LINE_PERCENT} * n_words as fail_lines
            from m),
        hosts as (select source, count(*)::double as n, {failed} from f where source is not null group by source),
        everywhere as (select count(*) as hosts, sum(n) as docs, sum(n * n) as squares, {means} from hosts),
        priors as (select *, {", ".join(weight(r) for r in names)} from everywhere),
        shrunk as (select source, {rates} from hosts, priors)
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_symbols, fail_lines,
            not base_failed and not (fail_symbols and coalesce(rate_fail_symbols >= {rules.SOFT_RATE}, true))
            and not (fail_lines and coalesce(rate_fail_lines >= {rules.SOFT_RATE}, true)) and not coalesce(rate_any_failed >= {rules.HOST_RATE}, false) as kept
        from f left join shrunk on f.source = shrunk.source"""


def archives() -> str:
    """Digests, the last page of each payload, and the dates and addresses that the query makes up."""
    uri = "array_to_string(list_transform(regexp_extract_all(hex(encode(url)), '..'), lambda b: case when b between '21' and '7E' then chr(('0x' || b)::int) else '%' || b end), '')"
    five = ", ".join(f"substr(bits, {5 * i + 1}, 5)" for i in range(32))
    return f"""
        with p as (
            select page_id, url, coalesce(html, '') as html, unhex(sha1(coalesce(html, '')))::bit::varchar as bits, coalesce(page_id, 0) % 86400 as second from pages),
        d as (select *, array_to_string(list_transform([{five}], lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
                + list_sum(list_transform(range(5), lambda i: substr(x, i + 1, 1)::int * (16 >> i::int)))::int, 1)), '') as digest from p),
        last as (select digest, max(page_id) as last from d group by digest)
        select page_id, octet_length(encode(html))::bigint as payload_bytes, d.digest as payload_digest,
            case when page_id < last or page_id is null and last is not null then 'revisit' else 'response' end as record_type,
            case when page_id < last or page_id is null then last end as refers_to, case when url not in ('', '-') then {uri} end as uri,
            printf('2026-01-01T%02d:%02d:%02dZ', second // 3600 % 24, second // 60 % 60, second % 60) as date,
            printf('10.%d.%d.%d', second // 65536 % 256, second // 256 % 256, second % 256) as ip
        from d join last on d.digest = last.digest"""


def near_copies(n: int = 4, percent: int = 85) -> str:
    """Sets of shingles, links by their counts in common, and the least doc_id that links reach."""
    window = " || ' ' || ".join(f"w[p + {j}]" for j in range(n))
    return f"""
        with recursive t as (select doc_id, regexp_extract_all({lowered("coalesce(text, '')")}, '{WORD}+') as w from documents),
        s as (
            select distinct doc_id, {window} as x from (select doc_id, w, unnest(range(1, len(w) - {n - 2})) as p from t where len(w) >= {n})
            union all select doc_id, array_to_string(w, ' ') from t where len(w) between 1 and {n - 1}),
        sizes as (select doc_id, count(*) as c from s group by doc_id),
        pairs as (select a.doc_id as u, b.doc_id as v, count(*) as i from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
        links as (select u, v from pairs join sizes a on u = a.doc_id join sizes b on v = b.doc_id where 100 * i >= {percent} * (a.c + b.c - i)),
        reached(doc_id, found) as (select doc_id, doc_id from t union select reached.doc_id, v from reached join links on found = u)
        select t.doc_id, coalesce(any_value(c), 0)::bigint as n_shingles, min(found) as component_id
        from t join reached on t.doc_id = reached.doc_id left join sizes on t.doc_id = sizes.doc_id group by t.doc_id"""
