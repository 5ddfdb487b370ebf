import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from quarry.llm.warc import derivatives, derive, op9_warc_derivatives, read_warcs, record, records, response, responses
from tests.conftest import SF


def sha(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_derivatives_are_linked(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    df = spark.createDataFrame(list(pages.values()))
    source = {r.key: bytes(r.data) for r in responses(df).collect()}
    rows = derivatives(responses(df)).collect()
    assert len(rows) == 2 * len(pages) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        (headers, block), = records(bytes(r.record))
        h = dict(headers)
        (own, body), = records(source[r.key])
        payload = body.partition(b"\r\n\r\n")[2]
        assert payload.decode() == pages[r.key].html
        assert h["WARC-Type"] == r.record_type and h["WARC-Record-ID"] == r.record_id
        assert h["WARC-Refers-To"] == dict(own)["WARC-Record-ID"] == r.refers_to and h["WARC-Target-URI"] == pages[r.key].url
        assert h["WARC-Block-Digest"] == sha(block) == r.block_digest and r.content_length == len(block)
        assert r.source_digest == sha(payload) == dict(own)["WARC-Payload-Digest"]
        if r.record_type == "metadata":
            f = dict(x.split(": ", 1) for x in block.decode().strip().split("\r\n"))
            assert f["source-http-content-type"] == "text/html; charset=utf-8" and f["source-digest-valid"] == "true" and f["source-warc-record-id"] == r.refers_to
        else:
            assert b"<article>" not in block and b"track(" not in block
        assert r.concurrent_to in {x.record_id for x in rows if x.key == r.key and x.record_type != r.record_type}
    assert sorted(r.record_id for r in op9_warc_derivatives(spark, SF).collect()) == sorted(r.record_id for r in rows)


def test_files_and_edges(spark, tmp_path):
    a, b = response("http://x/", "<p>é one</p>", "1"), response(None, None, "2")
    other = record([("WARC-Type", "request"), ("WARC-Record-ID", "<urn:uuid:1>")], b"GET / HTTP/1.1\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(a + other + b)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(a) + gzip.compress(b[:-40]))
    every = derivatives(read_warcs(spark, str(tmp_path))).collect()
    got = [r for r in every if r.record_type != "issue"]
    assert len(every) == 7 and len(got) == 6
    texts = [bytes(r.record).split(b"\r\n\r\n", 1)[1].strip().decode() for r in got if r.record_type == "conversion"]
    assert sorted(texts) == ["", "é one", "é one"]
    assert derive([("WARC-Type", "response")], b"") == [] and list(records(b"junk")) == []
    rows = [(None, None, None, 1), (1, "u", "<p>x", 2), (1, "u", "<p>x", 2), (2, "u\r\nInjected: 1", "z " * 100_000, 3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record int")
    out = derivatives(responses(df)).collect()
    assert len(out) == 8 and all(b"\r\nInjected" not in bytes(r.record) for r in out)
    assert derivatives(responses(df.limit(0))).count() == 0


def test_equal_addresses_with_other_content_have_other_ids(spark):
    df = spark.createDataFrame([(1, "http://x/", "<p>one</p>"), (1, "http://x/", "<p>two</p>"), (1, "http://x/", "<p>two</p>")], "page_id long, url string, html string")
    rows = derivatives(responses(df.withColumn("data", F.lit(1)).withColumn("key", F.lit("x")))).collect()
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 4


def test_broken_records_are_reported_and_the_rest_is_read(spark):
    good = [response(f"http://x/{i}", f"<p>text {i}</p>", str(i)) for i in range(3)]
    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:9>\r\nContent-Length: nine\r\n\r\nlost\r\n\r\n"
    cut = good[2][:-40]
    df = spark.createDataFrame([(1, bytearray(good[0] + bad + good[1])), (2, bytearray(cut)), (3, bytearray(b"no warc")), (4, None), (5, bytearray(gzip.compress(good[0]) + gzip.compress(good[1])[:-9]))], "key long, data binary")
    got = sorted((r.key, r.record_type, r.refers_to if r.record_type == "issue" else "") for r in derivatives(df).collect())
    two = lambda k: [(k, "conversion", ""), (k, "metadata", "")]
    assert [x for x in got if x[0] == 1] == sorted(two(1) + two(1) + [(1, "issue", "<urn:uuid:9>")])
    assert [x[:2] for x in got if x[0] == 2] == [(2, "issue")] and not [x for x in got if x[0] in (3, 4)]
    assert [x for x in got if x[0] == 5][:2] == two(5)[:1] * 2 or ("conversion" in {x[1] for x in got if x[0] == 5})


def uris(data):
    return [dict(h).get("WARC-Target-URI") if b is not None else None for h, b in records(data)]


def test_damaged_compression_loses_no_other_record():
    whole = [response(f"http://x/{i}", f"<p>{hashlib.sha256(str(i).encode()).hexdigest() * 9}</p>", str(i)) for i in range(6)]
    zipped = [gzip.compress(w) for w in whole]
    want = [f"http://x/{i}" for i in range(6)]
    hurt = bytearray(zipped[2])
    hurt[len(hurt) // 2 : len(hurt) // 2 + 20] = b"\xff" * 20
    assert uris(b"".join(zipped)) == want and uris(b"".join(zipped) + b"\0" * 512) == want
    assert uris(b"".join([*zipped[:2], bytes(hurt), *zipped[3:]])) == [*want[:2], None, *want[3:]]
    assert uris(zipped[0] + b"junk" + b"".join(zipped[1:])) == [want[0], None, *want[1:]]
    assert uris(b"".join(zipped)[:-30]) == [*want[:5], None]
    assert uris(b"".join([bytes(hurt), bytes(hurt), *zipped[3:]])) == [None, *want[3:]]  # one damage
    one = gzip.compress(b"".join(whole))
    assert uris(one) == want and uris(one[: len(one) // 2] + b"".join(zipped))[-6:] == want
    # a record across members, as block-wise writers make it
    data = b"".join(whole)
    assert uris(b"".join(gzip.compress(data[k : k + 500]) for k in range(0, len(data), 500))) == want
    assert uris(b"\x1f\x8b") == [None] and uris(b"") == []


def test_bodies_are_decoded():
    page = "<p>é text</p>".encode()
    packed = gzip.compress(page)
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(packed[i : i + 7]), packed[i : i + 7]) for i in range(0, len(packed), 7)) + b"0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunks
    conversion, metadata = derive([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], block)
    assert conversion["record"].endswith("é text".encode() + b"\r\n\r\n") and conversion["source_digest"] == sha(chunks)
