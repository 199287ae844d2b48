"""Archives: the query against SQL, odd pages, and damage of every kind against what must survive it."""

import gzip
import sys
import time

import edge_rows

sys.path.insert(0, edge_rows.__file__.rsplit("/", 2)[0])

from oracle import check  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sheetlens.llm import warc as W  # noqa: E402
from sheetlens.llm.queries import ORACLE_SQL, op13_warc, pages_in_archives  # noqa: E402

NOW = "2024-01-01T00:00:00Z"


def test_query_equals_its_sql(spark, sf01, tmp_path):
    assert check(op13_warc(spark, sf01), ORACLE_SQL["op13_warc"], sf01, tmp_path) > 0


def test_gaps_of_the_query(spark, sf01):
    """The query's torn writes are found, logged, and cost no page."""
    rows = pages_in_archives(spark, sf01).collect()
    gaps = [r for r in rows if r.gap]
    assert len(rows) - len(gaps) == 250
    assert 0 < len(gaps) < 60
    for r in gaps:  # each gap ends where a whole record begins
        assert any(x.path == r.path and x.start == r.stop for x in rows if not x.gap)


PAGES = [
    (1, "http://a.example/ä b\r\nx", "<p>same</p>"), (5, "http://b.example", "<p>same</p>"), (3, None, "<p>same</p>"), (2, "u", None), (9, "u", ""), (4, "u", "é日本 \U0001f600\r\n\r\nWARC/1.1\r\n"),
    (7, "u", "long " * 300_000), (8, "u", "twice"), (8, "v", "twice"), (None, "u", "no id"), (None, "u", "no id"), (None, "u", "<p>same</p>"), (6, "u", "WARC/1.0\r\n\x1f\x8b\x08 not a record"),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, `row` int")


def want(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data] if len(data) >= least else [page]
        head = max((p for p in same if p is not None), default=None)
        out.append((page, len(data), W.base32_sha1(data), head, len(same)))
    return out


def test_odd_pages(spark, tmp_path):
    for n, (least, compress) in enumerate(((0, True), (0, False), (5, True), (12, False))):
        folder = f"file://{tmp_path}/{n}"
        W.write_archives(frame(spark, PAGES), folder, NOW, least=least, compress=compress, archive_bytes=1000, torn=F.col("page_id") % 2 == 1)
        rows = W.read_archives(spark, folder).withColumns({"page": W.page_of(F.col("record_id")), "of": W.page_of(F.col("refers_to"))}).collect()
        records = [r for r in rows if not r.gap]
        assert {r.gap is None for r in rows} == {True, False}
        assert sorted(((r.page, r.payload_bytes, r.payload_digest) for r in records), key=str) == sorted(((p, k, d) for p, k, d, _, _ in want(PAGES, least)), key=str)
        texts = {h or "" for _, _, h in PAGES}
        heads = {}
        for page, _, digest, head, same in want(PAGES, least):
            if same > 1:
                heads[digest] = (head, same)
        for r in records:
            head, _ = heads.get(r.payload_digest, (r.page, 1))
            if r.record_type == "response":
                assert r.page == head and r.payload.decode() in texts and r.of is None
            else:
                assert r.payload_digest in heads and r.of == head
        for digest, (_, same) in heads.items():
            assert sorted(r.record_type for r in records if r.payload_digest == digest) == ["response"] + ["revisit"] * (same - 1)
    assert W.archived_pages(frame(spark, []), NOW).count() == 0


def test_files_are_standard(spark, tmp_path):
    W.write_archives(frame(spark, PAGES[:6]), f"file://{tmp_path}/z", NOW)
    texts = [gzip.decompress(p.read_bytes()) for p in (tmp_path / "z").glob("part-*")]
    assert sum(t.count(b"WARC/1.1\r\nWARC-Type: re") for t in texts) == 6
    assert all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts if t)


def archive(n, compress):
    one = lambda i: W.record_bytes("response", f"<urn:page:{i}:0>", NOW, "http://x.example", f"page {i} ".encode() * 50, None)
    return [W.gzip_member(one(i)) if compress else one(i) for i in range(n)]


def ids(data):
    return [r["fields"]["warc-record-id"].split(":")[2] for _, _, r, _ in W.salvaged(data) if r], [(a, b) for a, b, r, _ in W.salvaged(data) if not r]


def test_damage(spark):
    for compress in (True, False):
        parts = archive(6, compress)
        ends = [sum(map(len, parts[: i + 1])) for i in range(6)]
        whole = b"".join(parts)
        assert ids(whole) == ([*"012345"], [])
        # any one byte changed, anywhere in the third record: that record goes, no other; some bytes of headers no check covers
        for at in range(ends[1], ends[2], 7):
            hurt = whole[:at] + bytes([whole[at] ^ 0x55]) + whole[at + 1 :]
            got, gaps = ids(hurt)
            assert [i for n, i in enumerate(got) if n != 2 or len(got) < 6] == [*"01345"]
            if len(got) < 6:
                assert got == [*"01345"] and gaps == [(ends[1], ends[2])], at
        # bytes lost: from inside the second to inside the third
        got, gaps = ids(whole[: ends[0] + 30] + whole[ends[1] + 20 :])
        assert got == [*"0345"] and len(gaps) == 1 and gaps[0][0] == ends[0]
        # junk between, in front and behind, false marks too
        junk = b"\0\x1f\x8b\x08\0\0WARC/1.1\r\nContent-Length: 5\r\n\r\nabc WARC/1.1"
        got, gaps = ids(junk + b"".join(p + junk for p in parts))
        assert got == [*"012345"] and len(gaps) == 7 and all(b - a == len(junk) for a, b in gaps)
        # cut off at the end
        got, gaps = ids(whole[:-5])
        assert got == [*"01234"] and gaps == [(ends[4], len(whole) - 5)]
        assert ids(b"") == ([], []) and ids(junk) == ([], [(0, len(junk))])


def test_members_of_many_records(spark):
    parts = archive(5, False)
    inside = W.gzip_member(b"".join([*parts[:2], parts[2][:-9], *parts[3:]]))
    got, gaps = ids(inside)
    assert got == [*"0134"] and gaps == [(0, len(inside))]
    (why,) = [w for _, _, _, w in W.salvaged(inside) if w]
    assert why.startswith("in the member, bytes ")
    assert ids(W.gzip_member(b"no record") + W.gzip_member(parts[0])) == (["0"], [(0, len(W.gzip_member(b"no record")))])


def test_search_is_linear():
    data = b"\x1f\x8b\x08" * 100_000 + archive(1, True)[0]
    began = time.perf_counter()
    assert ids(data)[0] == ["0"]
    assert time.perf_counter() - began < 30
