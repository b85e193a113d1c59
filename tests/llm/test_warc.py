import gzip
import hashlib

from rankloom.llm import warc


def rows(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string, file string").repartition(3)


def test_round_trip_and_revisits(spark):
    big, other = "é" * 600, "x" * 1000
    data = [(1, "http://a/", big, "f"), (2, "http://b/", big, "f"), (3, None, big, "f"), (4, "u", other, "f"), (5, "u\r\nX: y", "small", "f"), (6, "u", "small", "f"), (7, "u", None, "f"), (8, "u", "WARC/1.1\r\n\r\n" * 200, "f"), (None, "u", "y" * 2000, "f")]
    got = {r.page_id: r for r in warc.digests(warc.deduplicate(warc.write_archives(rows(spark, data)))).collect()}
    assert len(got) == len(data)
    for i, _, html, _ in data:
        payload = (html or "").encode()
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))


def test_archives_are_plain_warc(spark):
    manifest = warc.write_archives(rows(spark, [(1, "http://a/", "hello", "f")]))
    file = manifest.first()["file"]
    raw = gzip.open(file.removeprefix("file:")).read()
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"\r\n\r\nhello\r\n\r\n")
    assert sum(r["records"] for r in manifest.collect()) == 1


def test_repeated_ids_keep_one_response(spark):
    got = warc.digests(warc.deduplicate(warc.write_archives(rows(spark, [(9, "u", "z" * 1500, "f")] * 3)))).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"] and {r.refers_to for r in got} == {9, None}


def test_archived_revisits_are_resolved_again(spark):
    once = warc.deduplicate(warc.write_archives(rows(spark, [(1, "u", "z" * 1500, "f"), (2, "u", "z" * 1500, "f")])))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.digests(warc.deduplicate(once)).collect()}
    assert got == {1: ("revisit", 2), 2: ("response", None)}


def test_empty(spark):
    assert warc.digests(warc.deduplicate(warc.write_archives(rows(spark, [])))).count() == 0
