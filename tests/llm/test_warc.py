import base64
import glob
import hashlib

import pytest
from pyspark.sql import functions as F

from tallyloom.llm import warc

ROWS = [(1, "http://a/ b\r\n", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 70_000), (None, "u", "<p>x</p>"), (6, "u", "y"), (6, "u", "y"), (7, "u", "<p>x</p>")]


def test_query(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int")
    out = warc.op7_warc(pages).collect()
    assert len(out) == len(ROWS)
    for r in out:
        html = next((h or "") for i, _, h in ROWS if i == r.page_id)
        ids = [i for i, _, h in ROWS if (h or "") == html and i is not None]
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == max(ids) else ("revisit", max(ids)))
    assert warc.op7_warc(pages.limit(0)).count() == 0


def test_least_bytes(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    assert warc.classified(pages, least_bytes=5).filter("revisit").count() == 3


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    archives = warc.write_archives(warc.classified(pages), warc.dictionary_of(pages))
    warc.save_archives(archives, f"{tmp_path}/archives")
    files = glob.glob(f"{tmp_path}/archives/part-*")
    assert files and all(open(f, "rb").read().endswith(warc.FILE_END) for f in files)
    back = warc.read_archives(warc.open_archives(spark, f"{tmp_path}/archives"))
    assert back.count() == len(ROWS)
    assert back.filter("error is not null").count() == 0
    assert bytes(back.filter("page_id = 5").first().payload) == ("é" * 70_000).encode()
    assert back.filter("page_id = 1").first().url == "http://a/%20b%0D%0A"


def test_broken_archives(spark):
    record = warc.record_bytes(1, "u", b"payload", None, False)
    import zstandard

    frame = zstandard.ZstdCompressor().compress(record)
    good = warc.skippable(b"") + frame
    cases = {"good": good, "none": b"", "plain": b"WARC/1.1", "cut": good[:-4], "junk": good + b"xyz", "length": warc.skippable(b"") + zstandard.ZstdCompressor().compress(record[:-1]), "digest": warc.skippable(b"") + zstandard.ZstdCompressor().compress(record.replace(b"payload", b"Payload"))}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "path string, content binary")
    got = {}
    for r in warc.read_archives(df).collect():
        got.setdefault(r.path, []).append(r.error is None)
    assert got == {"good": [True], "none": [False], "plain": [False], "cut": [False], "junk": [True, False], "length": [False], "digest": [False]}
    with pytest.raises(ValueError, match="skippable"):
        list(warc.frames(frame))


def test_compressed_dictionary():
    import zstandard

    raw = b"a dictionary of raw content " * 20
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    record = warc.record_bytes(9, None, b"p", 4, True)
    data = warc.skippable(zstandard.ZstdCompressor().compress(raw)) + packer.compress(record)
    assert warc.parse_record(next(iter(warc.frames(data))))["refers_to"] == 4


def test_a_revisit_must_have_its_response(spark):
    rows = [(1, "response", "A", None), (2, "revisit", "A", 1), (3, "revisit", "B", 1), (4, "revisit", "A", 9), (5, "response", "B", None)]
    df = spark.createDataFrame(rows, "page_id long, record_type string, payload_digest string, refers_to long")
    assert sorted((r.page_id, r.refers_to) for r in warc.unproved(df).collect()) == [(3, 1), (4, 9)]


def test_the_sample_is_small_however_many_partitions(spark):
    """Hardly more pages than the dictionary takes pass the bound, whatever the number of rows and partitions."""
    pages = spark.range(20_000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>page "), "id").alias("html")).repartition(16)
    assert warc.dictionary_of(pages) == warc.dictionary_of(pages.repartition(3))
    bound = int(4 * warc.SAMPLE_PAGES / 20_000 * (2**63 - 1))
    assert warc.SAMPLE_PAGES < pages.filter(F.abs(F.xxhash64("page_id", "url")) <= bound).count() < 6 * warc.SAMPLE_PAGES
