import gzip
import hashlib

from flowprep.llm import warc
from flowprep.llm.files import open_input

PAGES = "page_id bigint, url string, html string"


def pages(spark):
    rows = [(i, f"http://h{i % 7}.example.com/p/{i}", f"<p>{i % 5}" + "é" * 100) for i in range(60)]
    rows += [(100 + i, "http://hot.example.com/", f"hot {i}") for i in range(50)]
    rows += [(200, None, None), (201, "", ""), (None, "http://a.b/", "z" * 200), (202, "http://a.b/", "z" * 200), (203, "x\ny", "q" * 99),
             (204, "x\ny", "q" * 99), (205, "http://big.example", "w" * 3_000_000), (206, "https://U:p@Www.Big.Example:443/A?b#c", "w" * 3_000_000)]
    return rows + [rows[0], (300, "http://t.example/a\tb", "tab")]


def expected(rows):
    first = {}
    for p, _, h in rows:
        if p is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, p), p)
    out = []
    for p, _, h in rows:
        raw, f = (h or "").encode(), first.get(h, p)
        out.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "response" if p == f else "revisit", None if p == f else f))
    return sorted(out, key=str)


def test_round_trip_over_the_index(spark):
    rows = pages(spark)
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'x' AS key", "1 AS digest", "2 AS offset", "3 AS archive")
    manifest, root = warc.archive_pages(df.repartition(5), block_lines=4)
    got = warc.read_captures(manifest.select("key", "page_id"), root).collect()
    found = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str)
    assert found == expected(rows)
    texts = {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"}
    assert (0, ("<p>0" + "é" * 100).encode()) in texts and (200, b"") in texts
    # one lookup: all captures of a key, over several blocks; a key that is not there
    index = warc.Index(root)
    assert [c[1] for c in index.find("com,example,hot)/")] == list(range(100, 150))
    assert index.find("com,example,hot)/", 120)[0][1] == 120
    assert index.find("com,example,hot)/none") == [] and index.find("zzz") == []


def test_archives_are_read_by_a_plain_reader(spark, tmp_path):
    manifest, _ = warc.archive_pages(spark.createDataFrame(pages(spark), PAGES))
    total = 0
    for r in manifest.select("archive").distinct().collect():
        data = gzip.open(open_input(r.archive)).read()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\nWARC-Type: ")
            size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
            assert rest[size:size + 4] == b"\r\n\r\n"
            data, total = rest[size + 4:], total + 1
    assert total == len(pages(spark))


def test_url_keys(spark):
    urls = {"https://U:p@Www.Big.Example:443/A?b#c": "example,big,www)/A?b", "http://a.b": "b,a)/", "a.b?x": "b,a)/?x", "": "", None: ""}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.k for r in df.withColumn("k", warc.url_key(df.url)).collect()} == urls


def test_no_pages(spark):
    manifest, root = warc.archive_pages(spark.createDataFrame([], PAGES))
    assert manifest.count() == 0 and root == []
    assert warc.read_captures(manifest.select("key", "page_id"), root).count() == 0
