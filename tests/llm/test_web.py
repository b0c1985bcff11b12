"""WARC archives and URL filters."""

import base64
import hashlib
import random

from tripwise.llm import url_filter, warc
from tripwise.session import scratch_path

PAGES = [
    (1, "http://a.example/1", "<p>one</p>"), (2, "http://a.example/2", "<p>one</p>"), (3, None, None), (4, "http://b.example", ""),
    (5, "x\r\ny", "WARC/1.1\r\n\r\n\u00e9"), (None, "http://c.example", "<p>one</p>"), (7, "http://d.example", "z" * 200_000),
    (8, "http://e.example", "\u00e9"), (8, "http://e.example", "\u00e9"), (0, "http://z.example", "\u00e9"), (9, "u", "twice"), (9, "u", "twice"),
]


def archive(spark, rows, **more):
    path = scratch_path(spark, "warc")
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as record", "2 as first", "'s' as sha256")
    warc.write_archive(df, path, **more)
    return path


def test_records_come_back(spark):
    path = archive(spark, PAGES)
    got = sorted(warc.read_index(spark, path).collect(), key=lambda r: (r["page_id"] is None, r["page_id"]))
    want = []
    for page, _, html in sorted(PAGES, key=lambda r: (r[0] is None, r[0])):
        data = (html or "").encode()
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page == first else "revisit", None if page == first else first))
    assert [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got] == want
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in PAGES})
    for r in warc.read_records(spark, path).collect():
        header, payload = bytes(r["header"]), bytes(r["payload"])
        assert header.startswith(b"WARC/1.1\r\n") and header.endswith(b"\r\n\r\n") and bytes(r["bytes"]) == header + payload + b"\r\n\r\n"


def test_small_payloads_are_responses(spark):
    path = archive(spark, PAGES, min_revisit_bytes=5)
    got = {(r["page_id"], r["record_type"]) for r in warc.read_index(spark, path).collect()}
    assert (8, "response") in got and (2, "revisit") in got and (4, "response") in got and (None, "revisit") in got


def test_files_go_round(spark):
    path, out = archive(spark, PAGES), scratch_path(spark, "files")
    for compression in ("gzip", "none"):
        warc.export_files(spark, path, f"{out}-{compression}", compression)
        got = sorted((bytes(r["header"]), bytes(r["payload"])) for r in warc.import_files(spark, f"{out}-{compression}").collect())
        assert got == sorted((bytes(r["header"]), bytes(r["payload"])) for r in warc.read_records(spark, path).collect())


def test_a_damaged_payload_is_found(spark):
    import pytest

    path = archive(spark, PAGES)
    headers = spark.read.parquet(f"{path}/headers")
    broken = scratch_path(spark, "warc")
    headers.write.parquet(f"{broken}/headers")
    spark.read.parquet(f"{path}/payloads").selectExpr("sha256", "concat(payload, cast('!' as binary)) as payload").write.parquet(f"{broken}/payloads")
    with pytest.raises(Exception, match="damaged record"):
        warc.read_index(spark, broken).collect()


def test_an_empty_archive(spark):
    assert warc.read_index(spark, archive(spark, [])).count() == 0


def judge(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fit = [r for r in rules if r.host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_urls(spark):
    rules = [url_filter.Rule("allow", "com", "/"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
             url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "")]
    rng = random.Random(2)
    urls = [None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.COM/en/x?y=://z", "a://b://c/d", "http://xcom/", "http://.com/",
            "http://a..net", "http://example.com?/en/", "http://example.com/EN/", "http://\u00c9.net/es/", "x" * 50_000, "http://" + "a." * 20_000 + "net/es/"]
    urls += ["http://" + ".".join(rng.choice(("www", "example", "com", "net", "org")) for _ in range(rng.randrange(1, 5))) + rng.choice(("", "/", "/en/1", "/es/", "/e")) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").selectExpr("*", "'old' as rule", "1 as key", "2 as word")
    got = url_filter.filter_urls(df, rules)
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(df.limit(0), rules).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(df, []).collect()} == {"allow"}


def test_the_cascade_is_exact(spark):
    """Every key of the universe, with filters so small that several levels are needed."""
    keys = [f"k{i}" for i in range(4000)]
    universe = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    listed = keys[::9] + ["beyond the universe", None]
    cascade = url_filter.build_cascade(spark, listed, universe)
    got = {r["key"] for r in universe.where("key is not null").where(cascade.contains(universe["key"])).collect()}
    assert got == set(keys[::9]) and len(cascade.levels) >= 3
    assert not url_filter.build_cascade(spark, [], universe).levels
