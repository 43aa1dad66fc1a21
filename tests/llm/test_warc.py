import hashlib
import io
import random
import zlib

from strandline.llm import queries, warc


def test_every_record_once_whatever_the_ranges():
    draw = random.Random(1)
    raws = [warc._record(k, "http://x/" + "y" * draw.randint(0, 9), "".join(draw.choices("ab<>é", k=draw.randint(0, 3000))), "response", None) for k in range(40)]
    members = []
    for k, raw in enumerate(list(raws)):  # stored blocks show the magic bytes of false members inside
        members.append(warc._member(raw))
        if k % 9 == 0:
            false = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: 60\r\n\r\n" + (warc.MAGIC + b"\0") * 15 + b"\r\n\r\n"
            z = zlib.compressobj(0, zlib.DEFLATED, 31)
            members.append(z.compress(false) + z.flush())
            raws.append(false)
    data = b"".join(members)
    for size in (100, 997, 5000, len(data) + 5):
        found = [r for start in range(0, len(data), size) for r in warc.records_from(io.BytesIO(data), start, min(start + size, len(data)))]
        assert len({at for at, _ in found}) == len(found) == len(members)
        assert sorted(r for _, r in found) == sorted(raws)


def test_written_and_read(spark):
    big, other = "<p>é" * 400, "<p>o" * 300
    rows = [(1, "u", big), (2, "u", big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, None, None), (6, "u", ""), (7, "u", other), (None, "u", other), (9, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    files = warc.write_archives(warc.plan_records(pages), warc.archive_folder(spark), file_bytes=400)
    records = warc.read_archives(spark, files, split_bytes=150).filter("record_type != 'warcinfo'").collect()
    assert len(records) == len(rows) and all(r.intact for r in records)
    revisits = {r.record_id: r for r in records if r.record_type == "revisit"}
    assert set(revisits) == {"<urn:x-page:1>", "<urn:x-page:2>"} and {r.refers_to for r in revisits.values()} == {"<urn:x-page:9>"}
    assert all(r.payload_bytes == len(big.encode()) and r.payload_digest == hashlib.sha1(big.encode()).hexdigest() and r.payload is None for r in revisits.values())
    held = {(r.record_id, bytes(r.payload).decode()) for r in records if r.record_type == "response" and "page" in r.record_id}
    assert ("<urn:x-page:5>", "") in held and ("<urn:x-page:7>", other) in held and ("<urn:x-page:9>", big) in held


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    files = warc.write_archives(warc.plan_records(none), warc.archive_folder(spark))
    assert warc.read_archives(spark, files).count() == 0


def test_damaged_archives(spark, tmp_path):
    """A member cut off, one with a flipped byte, one with a bad length: the others are read."""
    members = [warc._member(warc._record(k, "u", f"<p>{k}" * 400, "response", None)) for k in range(6)]
    bad = b"WARC/1.1\r\nWARC-Type: metadata\r\nContent-Length: many\r\n\r\nx\r\n\r\n"
    broken = bytearray(members[2])
    broken[len(broken) // 2] ^= 255
    data = members[0] + members[1] + bytes(broken) + members[3] + warc._member(bad) + members[4] + members[5][:-9]
    (tmp_path / "a.warc.gz").write_bytes(data)
    files = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", len(data))], "file string, bytes long")
    for size in (1 << 20, 90):
        out = warc.read_archives(spark, files, split_bytes=size).collect()
        assert sorted(r.record_id for r in out if r.intact) == [f"<urn:x-page:{k}>" for k in (0, 1, 3, 4)]
        assert [r.record_type for r in out if not r.intact and r.record_type] == ["metadata"]
        assert sum(not r.intact and r.record_type is None for r in out) == 2


def test_query_equals_its_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{small}/pages.parquet'")
    got = queries.op7_warc(spark, small)
    order = sorted(got.columns)
    want = con.sql(queries.oracle_sql()["op7_warc"])
    at = [want.columns.index(c) for c in order]
    assert sorted(repr(tuple(r[c] for c in order)) for r in got.collect()) == sorted(repr(tuple(r[k] for k in at)) for r in want.fetchall())
