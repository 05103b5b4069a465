import gzip
import hashlib

from ledgerlight.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, refers_to string"


def run(spark, tmp_path, rows):
    folder = f"file://{tmp_path}/archive"
    out = warc.deduplicated_archives(spark.createDataFrame(rows, SCHEMA), folder)
    return sorted(map(tuple, out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok").collect()), key=repr)


def test_against_brute_force(spark, tmp_path):
    big, other, umlaut = "a\r\n\r\n" * 300, "b" * 999, "ü" * 500
    rows = [(1, "http://x/1", big, "x", "y"), (5, "http://x/5?q=ä b\r\nWARC-Type: fake", big, None, None), (3, None, big, None, None),
            (2, "u", other, None, None), (4, "u", other, None, None), (6, "u", None, None, None), (7, "u", "", None, None),
            (8, "u", umlaut, None, None), (9, "u", umlaut, None, None), (9, "u", umlaut, None, None), (None, "u", umlaut, None, None)]
    want = []
    for page, _, html, *_ in rows:
        payload = (html or "").encode()
        last = max(p for p, _, h, *_ in rows if (h or "").encode() == payload and p is not None)
        again = len(payload) >= 1000 and page != last
        want.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None, True))
    assert run(spark, tmp_path, rows) == sorted(want, key=repr)


def test_files_are_plain_warc(spark, tmp_path):
    text = "<html>" + "z" * 2000
    run(spark, tmp_path, [(1, "http://x/1", text, None, None), (2, "http://x/2", text, None, None)])
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "archive").glob("part-*")))
    assert data.count(b"WARC/1.1\r\n") == 2 and data.count(text.encode()) == 1
    assert data.count(b"WARC-Type: revisit") == 1 and b"WARC-Refers-To: <urn:uuid:" in data and data.endswith(b"\r\n\r\n")


def test_empty_table_and_all_null_ids(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
    text = "n" * 1500
    got = run(spark, tmp_path / "more", [(None, "u", text, None, None), (None, "u", text, None, None)])
    assert [r[3] for r in got] == ["response", "response"]


def test_many_members_in_one_file():
    """Time in proportion to the file: 20,000 members of about 1.5 KB, with the empty ones between."""
    import os
    import time
    bodies = [os.urandom(1500) for _ in range(50)]
    short = b"".join(gzip.compress(b, mtime=0) + warc.BETWEEN.encode("latin-1") for b in bodies * 40)
    start = time.process_time()
    assert sum(1 for _ in warc.inflated(short)) == 2_000
    few = time.process_time() - start
    start = time.process_time()
    assert [m for i, m in enumerate(warc.inflated(short * 10)) if i < 50] == bodies
    assert time.process_time() - start < 25 * few + 1


def test_long_members_and_broken_files():
    import pytest
    text = b"long " * 2_000_000
    assert list(warc.inflated(gzip.compress(text) + gzip.compress(b"") + gzip.compress(b"x"))) == [text, b"x"]
    with pytest.raises(ValueError):
        list(warc.inflated(gzip.compress(text)[:-9]))


def test_long_payload_and_one_id_with_two_payloads(spark, tmp_path):
    """Equal payloads meet by content, whatever their ids; of one id's two payloads each stands for itself."""
    long, other = "long ä" * 500_000, "o" * 1200
    rows = [(1, "u", long, None, None), (2, "u", long, None, None), (2, "u", other, None, None), (3, "u", other, None, None)]
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    want = [(1, len(long.encode()), sha(long), "revisit", 2, True), (2, len(long.encode()), sha(long), "response", None, True),
            (2, 1200, sha(other), "revisit", 3, True), (3, 1200, sha(other), "response", None, True)]
    assert run(spark, tmp_path, rows) == sorted(want, key=repr)
