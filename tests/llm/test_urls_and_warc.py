import gzip
import hashlib
import io
import zlib
from base64 import b32encode
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import url_filter as uf
from sparkloom.llm import warc
from sparkloom.llm.queries import URL_RULES
from sparkloom.sources.tables import table

URLS = [
    None, "", "no scheme/en/1", "http://", "HTTP://A.Example.COM/en/7x?q#f", "x://example.com/en/71", "x://com/en/", "x://.com/en/", "x://a.net/de/8",
    "x://example.net/de/8/", "x://example.net/de/9", "x://example.net", "x://b.org?/es/", "x://b.org/es/#a", "x://notexample.com/en/7", "x://a://b.com/en/",
    "x://spam-farm.example.org/", "x://www.casino-win.example.org/es/1", "x://com/en", "x://\u00c4.com/en/\n\n7", "x://b.org/es/", "x://b.org/es/",
]


def judged(url, listed=()):
    rest = (url or "").split("://", 1)
    cut = lambda s, stops: s[: min([s.find(c) for c in stops if c in s], default=len(s))]
    host, path = ("", "") if len(rest) < 2 else (cut(rest[1], "/?#"), cut(rest[1][len(cut(rest[1], "/?#")) :], "?#"))
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = []
    for verdict, rule in URL_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return host, path, *(max(fits)[1:] if fits else (None, "block" if host and host + path in listed else "allow"))


@pytest.mark.parametrize("max_bits", [uf.MAX_BITS, 1])
def test_urls(spark, max_bits):
    """By the cascade, and by a join where the list exceeds max_bits."""
    urls = [*URLS, "x://long.example/" + "a" * 500_000]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, verdict string").withColumns({"row": F.lit(1), "key": F.lit(2)})
    keys = ["com/en/7", "example.com/en/7", "spam-farm.example.org/", "spam-farm.example.org/", "www.casino-win.example.org/es/1", None, "", "unseen/", "long.example/" + "a" * 500_000]
    listed = spark.createDataFrame([(k,) for k in keys], "url string")
    out = uf.judge(pages, URL_RULES, listed, max_bits=max_bits)
    assert out.columns == ["page_id", "url", "row", "key", "host", "path", "rule", "verdict"]
    assert [tuple(r)[4:] for r in out.orderBy("page_id").collect()] == [judged(u, keys) for u in urls]
    assert uf.judge(pages.limit(0), URL_RULES, listed, max_bits=max_bits).count() == 0
    assert {r.verdict for r in uf.judge(pages, []).collect()} == {"allow"}
    assert [tuple(r)[4:] for r in uf.judge(pages, URL_RULES, max_bits=max_bits).orderBy("page_id").collect()] == [judged(u) for u in urls]


def test_copying_pages(spark):
    rows = [(1, "x://a/1", "same"), (2, "x://b/1", "same"), (3, "x://c/1", "same"), (4, "x://d/1", "own"), (5, "x://d/1?q", "own"), (6, None, "same"), (7, "x://e/", ""), (8, "x://f/", ""), (9, "x://g/", None), (9, "x://g/", "two"), (None, "x://h/", "two")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(0), "n": F.lit(0)})
    assert sorted(r.key for r in uf.copying(pages).collect()) == ["a/1", "b/1"]
    assert uf.copying(pages.limit(0)).count() == 0


def test_native(spark, sf):
    from sparkloom.plans.frontdoor import explained

    pages = table(spark, sf, "pages")
    plans = explained(uf.judge(pages, URL_RULES, uf.copying(pages))), explained(uf.copying(pages))
    assert not any(word in plan for plan in plans for word in ("Python", "Arrow", "Pandas"))
    assert "Join" not in plans[0] and "Exchange" not in plans[0]  # the cascade is part of the scan's projection


@pytest.mark.parametrize(("n_in", "n_out"), [(0, 50), (1, 5000), (300, 3000), (500, 0)])
def test_cascade_is_exact(spark, n_in, n_out):
    keys = spark.range(n_in + n_out).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < n_in).alias("in"))
    listed = keys.where("in").select("key")
    cascade = uf.Cascade.build(listed.union(listed).union(spark.createDataFrame([(None,)], "key string")), keys.select("key"))
    assert keys.where(cascade.contains(F.col("key")) != F.col("in")).count() == 0
    assert keys.limit(1).where(cascade.contains(F.lit(None).cast("string"))).count() == 0
    if n_in == 300:
        assert len(cascade.levels) > 1
    assert n_in < 2 or uf.Cascade.build(listed, keys.select("key"), max_bits=64) is None


def test_arc_versions():
    for version in (1, 2):
        first = warc.arc_record(version, "http://a b/\n", "1.2.3.4", "20260102030405", b"HTTP/1.1 200 OK\r\n\r\nbody\n\n", "f", 0)
        second = warc.arc_record(version, "", "0.0.0.0", "2026", b"", "f", 0, "text/plain")
        block, one, two = warc.read_arc(warc.arc_header(version, "f", "20260101000000") + first + second)
        assert block.get("URL") == "filedesc://f" and one.get("URL") == "http://a%20b/%0A" and one.content.endswith(b"body\n\n")
        assert two.get("URL") == "-" and two.content == b""
        assert one.get("Result-code") == ("-" if version == 1 else "200")
        made = b"".join(warc.to_warc(r) for r in (block, one, two))
        records = list(warc.read_warc(io.BytesIO(made)))
        assert [h["warc-type"] for h, _ in records] == ["warcinfo", "response", "resource"]
        assert records[1][0]["warc-date"] == "2026-01-02T03:04:05Z" and records[2][0]["warc-date"] == "2026-01-01T00:00:00Z"
        assert records[1][0]["warc-payload-digest"] == "sha1:" + b32encode(hashlib.sha1(b"body\n\n").digest()).decode()
        assert records[1][0]["warc-ip-address"] == "1.2.3.4" and records[1][1] == one.content


def test_broken_archives():
    good = warc.arc_header(1, "f", "20260101000000") + warc.arc_record(1, "http://a/", "0.0.0.0", "20260101000000", b"12345", "f", 0)
    for bad in (good[:-1], good.replace(b" 5\n", b" five\n"), good.replace(b"0.0.0.0 20260101000000 text/html", b"text/html")):
        with pytest.raises(ValueError):
            list(warc.read_arc(bad))
    made = warc.to_warc(list(warc.read_arc(good))[1])
    with pytest.raises(ValueError):
        list(warc.read_warc(io.BytesIO(made[:-10])))


def test_keys_in_identifiers():
    for key in (0, 1, -1, 2**63 - 1, -(2**63), 123456789):
        made = warc.key_id(key)
        assert made.version == 8 and warc.id_key(f"<urn:uuid:{made}>") == key
    assert warc.id_key("urn:uuid:00000000-0000-4000-8000-000000000000") is None


def test_round_trip(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (9, "http://x/ y", "same"), (3, "u", None), (4, "u", ""), (5, "u", "\u00e9\r\n\r\nWARC/1.0\r\n"), (6, "u", "x" * 300_000), (7, "u", "dup"), (7, "u", "dup"), (None, "u", "same"), (None, "u", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"key": F.lit(0), "refers_to": F.lit(0), "payload": F.lit("p")})
    got = warc.round_trip(pages).collect()
    last = defaultdict(list)
    for k, _, h in rows:
        last[h or ""].append(k)
    want = []
    for k, _, h in rows:
        b = (h or "").encode()
        known = [x for x in last[h or ""] if x is not None]
        top = max(known) if known and len(last[h or ""]) > 1 else None
        to = top if top is not None and (k is None or k < top) else None
        want.append((k, len(b), b32encode(hashlib.sha1(b).digest()).decode(), "response" if to is None else "revisit", to))
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, want))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_target_uris_are_ascii(spark):
    pages = spark.createDataFrame([(1, "http://h/\u00e9 x~", "a"), (2, "-", "b"), (3, "", "c")], "page_id long, url string, html string")
    assert {r.page_id: r.uri for r in warc.round_trip(pages).collect()} == {1: "http://h/%C3%A9%20x~", 2: None, 3: None}


def test_small_payloads_are_not_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(pages, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_archives_hold_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    pages = spark.createDataFrame([(1, "http://h/", "<p>\u00e9</p>"), (2, "http://i/", "<p>\u00e9</p>")], "page_id long, url string, html string").coalesce(1)
    warc.archived(pages, str(tmp_path / "a"), date=F.concat(F.lit("2026010203040"), "page_id"), ip=F.concat(F.lit("10.0.0."), "page_id"))
    assert len(list((tmp_path / "a").glob("part-*"))) == 2  # a file is closed at FILE_BYTES
    arcs = {r.key: r for r in warc.read_arcs(spark, str(tmp_path / "a")).where("nth > 0").collect()}
    assert len(arcs[1].fields) == 5 and len(arcs[2].fields) == 10 and arcs[1].fields["Archive-date"] == "20260102030401"
    warc.convert(spark, str(tmp_path / "a"), str(tmp_path / "w"))
    got = {r.key: r for r in warc.read_archives(spark, str(tmp_path / "w")).where("record_type <> 'warcinfo'").collect()}
    assert bytes(got[2].payload).decode() == "<p>\u00e9</p>" and got[1].payload is None and got[1].refers_to == 2 and got[1].uri == "http://h/"
    assert got[1].date == "2026-01-02T03:04:01Z" and got[2].ip == "10.0.0.2"
    members, of = 0, b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    while of:  # each record is a gzip member of its own
        d = zlib.decompressobj(31)
        assert d.decompress(of).count(b"WARC/1.0\r\n") == 1
        members, of = members + 1, d.unused_data
    assert members == 4


def test_legacy_folder(spark, tmp_path):
    """Files of both versions, plain, gzipped as a whole and by record, of other software: no keys, other dates."""
    def file(version, n):
        body = [b"HTTP/1.0 200 OK\r\n\r\nsame", b"HTTP/1.0 200 OK\r\n\r\nown %d" % n, b"no head %d" % n]
        return [warc.arc_header(version, f"f{n}", "19990101")] + [warc.arc_record(version, f"http://h{n}/{i}", "9.8.7.6", "199902030405", b, f"f{n}", 0) for i, b in enumerate(body)]

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(b"".join(file(1, 1)))
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(b"".join(file(2, 2))))
    (tmp_path / "in" / "c.arc.gz").write_bytes(b"".join(map(gzip.compress, file(2, 3))))
    warc.convert(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    got = warc.read_archives(spark, str(tmp_path / "out")).collect()
    assert sorted(r.record_type for r in got) == ["resource"] * 3 + ["response"] * 6 + ["warcinfo"] * 3
    docs = [r for r in got if r.record_type != "warcinfo"]
    assert {r.uri for r in docs} == {f"http://h{n}/{i}" for n in (1, 2, 3) for i in (0, 1, 2)} and {(r.date, r.ip) for r in docs} == {("1999-02-03T04:05:00Z", "9.8.7.6")}
    assert {bytes(r.payload) for r in docs} == {b"same", *(b"own %d" % n for n in (1, 2, 3)), *(b"no head %d" % n for n in (1, 2, 3))}
    (tmp_path / "in" / "d.arc").write_bytes(b"".join(file(1, 4))[:-1])
    with pytest.raises(Exception, match="declared"):
        warc.read_arcs(spark, str(tmp_path / "in")).count()


def test_files_end_in_a_zero():
    for n in (0, 5, 1 << 24, (1 << 24) + 7):
        made = warc._ending_in_zero(warc._member(bytes(n)))
        assert made.endswith(b"\0") and len(gzip.decompress(made)) == n
