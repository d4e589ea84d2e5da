import hashlib

import pytest

from tessel.llm import warc


def test_arc_versions_cut_by_declared_length():
    bodies = [b"", b"plain", warc.HTTP + b"line\nhttp://x 0.0.0.0 1 text/html 5\nmore", b"\n\n\r\n\r\n"]
    for version in (1, 2):
        got = list(warc.arc_records(warc.arc_file([("http://a b/é", x) for x in bodies], version)))
        assert [r.body for r in got] == bodies and {r.version for r in got} == {version} and got[0].url == "http://a%20b/%C3%A9"
    with pytest.raises(ValueError, match="declares"):
        list(warc.arc_records(warc.arc_file([("u", b"12345")], 1)[:-2]))


def test_dates_addresses_and_ids_follow_the_arc_lines():
    """Files as others write them: each record's own date and address, in both versions."""
    made = []
    for version in (1, 2):
        block = f"{version} 0 other\n{warc.FIELDS[version]}\n".encode()
        data = b"filedesc://x 1.2.3.4 19970301000000 text/plain " + (b"200 - - 0 x.arc " if version == 2 else b"") + b"%d\n" % len(block) + block
        for i, (date, ip) in enumerate([("19961231235959", "10.0.0.1"), ("20040229120000", "192.168.7.9"), ("19961231235959", "::1")]):
            body = warc.HTTP + b"page %d" % i
            more = b" 200 abc - 77 x.arc" if version == 2 else b""
            data += b"\nhttp://h/%d %s %s text/html%s %d\n" % (i, ip.encode(), date.encode(), more, len(body)) + body
        got = list(warc.arc_records(data))
        assert [(r.date, r.ip, r.version) for r in got] == [("19961231235959", "10.0.0.1", version), ("20040229120000", "192.168.7.9", version), ("19961231235959", "::1", version)]
        made += [warc.warc_record(r, j) for j, r in enumerate(got)]
    heads = [dict(line.split(": ", 1) for line in m.split(warc.END, 1)[0].decode().split("\r\n")[1:]) for m in made]
    assert [h["WARC-Date"] for h in heads[:3]] == ["1996-12-31T23:59:59Z", "2004-02-29T12:00:00Z", "1996-12-31T23:59:59Z"]
    assert [h["WARC-IP-Address"] for h in heads[:3]] == ["10.0.0.1", "192.168.7.9", "::1"]
    assert len({h["WARC-Record-ID"] for h in heads[:3]}) == 3 and [h["WARC-Record-ID"] for h in heads[:3]] == [h["WARC-Record-ID"] for h in heads[3:]]
    assert [h["WARC-Payload-Digest"] for h in heads[:3]] == ["sha256:" + hashlib.sha256(b"page %d" % i).hexdigest() for i in range(3)]


@pytest.mark.parametrize("n", [1, 3, 100])
def test_stream_cuts_by_content_length(n):
    records = [warc.warc_record(warc.ArcRecord(1, "u", "0.0.0.0", warc.DATE, "t", "", warc.HTTP + p), i) for i, p in enumerate([b"a\r\n\r\nWARC/1.1\r\n\r\n", b"", b"\r\n\r\n", b"x\r\n"])]
    data = b"".join(r + warc.END for r in records)
    stream = warc.WarcStream()
    got = [b for i in range(0, len(data), n) for _, b in stream.feed(data[i : i + n])]
    assert got == [r.split(warc.END, 1)[1] for r in records] and not any(stream.held)


def test_round_trip_with_nulls_copies_and_separators(spark):
    big, small = "B" * 150, "s" * 50
    rows = [(5, "http://e", big, 1), (2, "http://b x", big, 1), (9, None, big, 1), (3, "u", small, 1), (4, "u", small, 1), (6, "u", None, 1), (7, "u", "", 1), (8, "u", "é\r\n\r\nWARC/1.1\r\n\r\n" * 20, 1), (None, "u", big, 1), (10, "u", "end\r\n", 1), (2, "http://b x", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    got = warc.round_trip(pages).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    seen = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key)
    expected = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        revisit = h == big and i != 2
        expected.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", 2 if revisit else None))
    assert seen == sorted(expected, key=key)
    assert {r.payload for r in got if r.page_id == 8} == {("é\r\n\r\nWARC/1.1\r\n\r\n" * 20).encode()}


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
