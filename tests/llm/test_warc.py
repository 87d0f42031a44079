import base64
import gzip
import hashlib
import io

from larkspur.llm import warc


def _pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "a", 1) for i, u, h in rows], "page_id long, url string, html string, sha1 string, refers_to int")


def _expected(rows):
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = best.get(h or "")
        first = i is None or to == i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else to))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/ b", "same"), (5, None, "same"), (3, "u", "same"), (3, "u", "same"), (7, "v", None), (8, "w", ""), (None, "n", "same"), (9, "é", "<p>é\r\n\r\n</p>" * 20_000)]
    found = warc.round_trip(_pages(spark, *rows), str(tmp_path / "w")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=repr) == _expected(rows)
    assert {r.page_id: r.payload for r in found if r.record_type == "response" and r.page_id == 9} == {9: ("<p>é\r\n\r\n</p>" * 20_000).encode()}
    # every member is a gzip file of its own
    for r in found:
        data = (tmp_path / "w/members" / r.file).read_bytes()[r.offset :]
        assert gzip.decompress(data).startswith(b"WARC/1.1") and warc.zlib.decompressobj(31).decompress(data).count(b"WARC/1.1") == 1
    assert not (tmp_path / "w/stream").exists()


def test_empty_and_small_buffers(spark, tmp_path, monkeypatch):
    assert warc.round_trip(_pages(spark), str(tmp_path / "e")).count() == 0
    monkeypatch.setattr(warc, "BUFFER", 7)
    data = b"".join(gzip.compress(warc.make_record(i, "u", b"x" * 100 * i, warc.digest(b""), None)) for i in range(4))
    blocks = [b for _, _, b in warc.Records(warc.Inflated(io.BytesIO(data)))]
    assert [b.partition(b"\r\n\r\n")[2] for b in blocks] == [b"x" * 100 * i for i in range(4)]


def test_sample_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=repr) == _expected([(r.page_id, r.url, r.html) for r in pages.collect()])


def test_work_is_dealt(spark, tmp_path):
    """A task a stream, and runs of records to every core, also where adaptive execution would merge small partitions."""
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    rows = [(i, "u", f"{i} " * 50) for i in range(600)]
    folder = str(tmp_path / "w")
    warc.write_archive(_pages(spark, *rows).repartition(12), folder)
    index = warc.index_of(spark, folder)
    assert len(list((tmp_path / "w/index").glob("*.parquet"))) == 12 and index.select("file").distinct().count() == 12
    sizes = [n for n in warc.dealt(index).rdd.glom().map(len).collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * 600 / len(sizes)
    many = warc.dealt(index, 1 + index.agg({"length": "sum"}).first()[0] // 40)
    assert many.rdd.getNumPartitions() == 40 and many.count() == 600
    assert warc.read_members(index, folder).count() == 600
