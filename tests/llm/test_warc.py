"""Archives and their index: round trips, revisits and lookups."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from saltmarsh.llm import warc

SCHEMA = "page_id long, url string, html string"


def some_pages(n=400):
    rng = random.Random(1)
    bodies = [f"<html>{'x' * rng.randrange(2000)} {k} żółć \r\n\r\n</html>" for k in range(120)] + ["", None]
    hosts = ["a.example.com", "b.example.com:8080", "example.com", "10.0.0.1", "Ünï.example.org", "[::1]"]
    rows = [
        (rng.randrange(10**12), f"https://{rng.choice(hosts)}/{rng.choice(['', 'a b', 'p?q=1#f', 'é', 'x' * 300])}{rng.randrange(50)}", rng.choice(bodies))
        for _ in range(n)
    ]
    rows += [(7, "mailto:x@example.com", "m"), (8, "", "e"), (9, "with\r\nbreak\tand %20", "m"), ((1 << 62) + 1, None, "n")]
    rows += [(None, None, None), (None, None, None), (None, "http://z.example/", "nul"), (5, "http://z.example/", "nul"), (6, None, "q"), (6, None, "q")]
    return rows


def expected(rows, least=0):
    def order(k):
        page, url, _ = rows[k]
        return page is None, page or 0, url is None, url or "", k

    out, groups = [], {}
    for k, (_, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append(k)
    for html, own in groups.items():
        data = html.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min(own, key=order)
        for k in own:
            revisit = k != first and len(data) >= least
            out.append((rows[k][0], len(data), digest, "revisit" if revisit else "response", rows[first][0] if revisit else None))
    return sorted(out, key=str)


def rows_of(found):
    return sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()], key=str)


SMALL = warc.Settings(file_bytes=3000, part_bytes=20_000, block_lines=7, shard_lines=60, lookups=30)


@pytest.mark.parametrize("settings", [warc.Settings(), SMALL, warc.Settings(min_revisit_bytes=500)])
def test_round_trip(spark, settings):
    rows = some_pages()
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", key string, payload string").repartition(7)
    index, root = warc.archive(pages, settings=settings)
    assert rows_of(warc.resolved(index, root)) == expected(rows, settings.min_revisit_bytes)
    records = warc.scan(index, root, payload=True).collect()
    assert len({r.key for r in records}) == len(records) == len(rows)
    texts = {html or "" for _, _, html in rows}
    assert {bytes(r.payload).decode() for r in records if r.record_type == "response"} == texts
    if settings is SMALL:
        assert len(index.shards) > 3


def test_lookups(spark):
    rows = some_pages() + [(k, "http://hot.example.com/", f"v{k}") for k in range(1000, 1200)]
    index, root = warc.archive(spark.createDataFrame(rows, SCHEMA), settings=SMALL)
    urls = ["http://hot.example.com/", "https://a.example.com/p?q=1#f3", "http://none.example.com/", "with\r\nbreak\tand %20", ""]
    keys = spark.createDataFrame([(u,) for u in urls], "url string").select(warc.url_key(warc.uri(F.col("url"))).alias("wanted"))
    found = warc.lookup(index, root, keys.unionByName(keys), payload=True).collect()
    want = sorted(str(p) for p, u, _ in rows if u in urls or u is None)
    assert sorted(str(r.page_id) for r in found) == want
    # One record by its whole key.
    one = spark.createDataFrame([(found[0].key,)], "wanted string")
    assert [r.page_id for r in warc.lookup(index, root, one).collect()] == [found[0].page_id]


def test_url_keys(spark):
    cases = {
        "https://User@WWW.Example.com:8080/A?b#c": "com,example,www:8080)/A?b#c", "http://10.0.0.1/x": "10.0.0.1)/x",
        "http://[::1]:80/": "[::1]:80)/", "about:blank": "about:blank", "http://x y.com/a\nb": "com,x%20y)/a%0Ab", "http://a.b": "b,a)",
    }
    df = spark.createDataFrame(list(cases.items()), "url string, want string")
    for r in df.select("want", warc.url_key(warc.uri(F.col("url"))).alias("key")).collect():
        assert r.key == r.want
    assert spark.range(1).select(warc.url_key(F.lit(None).cast("string"))).first()[0] == ""


def test_empty_and_broken(spark):
    index, root = warc.archive(spark.createDataFrame([], SCHEMA))
    assert warc.resolved(index, root).count() == 0 and index.shards == ()
    with pytest.raises(ValueError):
        key = "com)/ 00000000-0000-4000-8000-000000000000"
        data = warc.member({"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{key[-36:]}>", "WARC-Payload-Digest": "sha1:A"}, b"H\r\n\r\nx")
        warc.record_row(key, {"digest": "A"}, data, False)


def test_warc_layout():
    data = warc.member({"WARC-Type": "warcinfo"}, b"a: b\r\n")
    import gzip

    assert gzip.decompress(data) == b"WARC/1.1\r\nWARC-Type: warcinfo\r\nContent-Length: 6\r\n\r\na: b\r\n\r\n\r\n"
