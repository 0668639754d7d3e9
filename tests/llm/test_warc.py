import io

import pytest
import zstandard

from cloudgauge.llm import warc
from cloudgauge.llm.common import fresh_dir


def archive(records, dictionary=b"", packed=False):
    content = zstandard.compress(dictionary) if packed else dictionary
    encoder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return (warc.skippable(content) if dictionary else b"") + b"".join(map(encoder.compress, records))


def record(k, payload, kind="response", to=None):
    return warc.record_bytes(kind, k, "http://a/\r\nb", to, payload, warc.base32_sha1(payload))


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("dictionary", [b"", b"a dictionary of raw content " * 20])
def test_round_trip(dictionary, packed):
    payloads = [b"", b"x" * 300_000, "é\r\n\r\n".encode()]
    data = archive([warc.info_bytes(), *(record(k, p) for k, p in enumerate(payloads)), record(9, payloads[1], "revisit", 1)], dictionary, packed)
    got = list(warc.read_archive(io.BytesIO(data)))
    assert [(r.page_id, r.payload, r.kind) for r in got[:3]] == [(k, p, "response") for k, p in enumerate(payloads)]
    assert (got[3].kind, got[3].refers_to, got[3].payload, got[3].payload_bytes, got[3].payload_digest) == ("revisit", 1, b"", 300_000, warc.base32_sha1(payloads[1]))


def test_faults():
    good = record(1, b"hello")
    for bad in (good[:-1], good.replace(b"hello", b"hullo"), good.replace(b"WARC/1.1", b"NARC/1.1"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"Content-Length: 5", b"Content-Length: 6")):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(archive([bad]))))
    whole = archive([good], b"some dictionary " * 30)
    for bad in (whole[:-3], whole[:20], whole + b"tail", whole[8 + 480 :]):
        with pytest.raises(warc.ArchiveError):
            list(warc.read_archive(io.BytesIO(bad)))


def run(spark, rows, least=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    done = warc.write_archives(pages.repartition(3), fresh_dir(spark, "t"), least=least).cache()
    out = warc.read_archives(done)
    return sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]).decode()) for r in out.collect()), key=str)


def test_revisits_nulls_and_repeats(spark):
    rows = [(5, "u", "same", 1), (3, None, "same", 1), (4, "u", None, 1), (9, "u", "", 1), (7, "u", "own", 1), (None, "u", "same", 1), (7, "u", "own", 1)]
    want = sorted([(3, 4, "response", None, "same"), (5, 4, "revisit", 3, None), (None, 4, "revisit", 3, None), (4, 0, "response", None, ""), (9, 0, "revisit", 4, None), (7, 3, "response", None, "own"), (7, 3, "response", None, "own")], key=str)
    assert run(spark, rows) == want


def test_small_payloads_are_all_responses(spark):
    assert [r[2] for r in run(spark, [(1, "u", "ab", 0), (2, "u", "ab", 0), (3, "u", "abc", 0), (4, "u", "abc", 0)], least=3)] == ["response", "response", "response", "revisit"]


def test_empty(spark):
    assert run(spark, []) == []


def test_optional_fields():
    whole = record(7, b"hello")
    digest = f"WARC-Payload-Digest: sha1:{warc.base32_sha1(b'hello')}\r\n".encode()
    block = b"HTTP/1.1 200 OK\r\nServer: caf\xe9\r\n\r\nhello"
    plain = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    for data, page in ((whole.replace(digest, b""), 7), (plain, None)):
        r = warc.parse(data)
        assert (r.kind, r.page_id, r.payload, r.payload_bytes, r.payload_digest) == ("response", page, b"hello", 5, warc.base32_sha1(b"hello"))
    with pytest.raises(warc.ArchiveError):
        warc.parse(whole.replace(b"http://a/ b", b"http://\xff/b"))
    with pytest.raises(warc.ArchiveError):
        warc.parse(whole.replace(digest, b"WARC-Payload-Digest: sha1:AAAA\r\n"))


def test_null_ids_have_records_of_their_own():
    assert record(None, b"same") != record(None, b"same")


def test_hot_payloads_are_dealt_and_agree(spark):
    rows = [(k, f"u{k}", "hot" if k % 3 else f"p{k // 30}", 0) for k in range(300)] + [(None, "u", "hot", 0), (1, "u", "hot", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = [warc.write_archives(pages, fresh_dir(spark, "t"), most=most) for most in (100_000, 0)]
        plans = [f._jdf.queryExecution().executedPlan().toString() for f in found]
        kept = [f.cache() for f in found]
        got = [sorted((r["page_id"], r["record_type"], r["refers_to"], r["payload"]) for r in warc.read_archives(f).collect() if r["page_id"] is not None) for f in kept]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "hashpartitioning" not in plans[0] and "_salt" in plans[1]
    assert got[0] == got[1] and sum(r[1] == "response" for r in got[0]) == 12


def test_very_long_payloads_go_through_the_writer(spark):
    html = "é<p>" * 3_000_000
    assert run(spark, [(1, "u", html, 0), (2, "u", html, 0)]) == [(1, 15_000_000, "response", None, html), (2, 15_000_000, "revisit", 1, None)]
