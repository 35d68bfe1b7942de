import base64
import hashlib

import pytest
import zstandard
from pyspark.sql import Row, functions as F

from quantloom.llm import queries, warc
from quantloom.llm.common import store

SCHEMA = "page_id bigint, url string, html string, n int, sha string"


def expected(rows, least=0):
    groups = {}
    for r in rows:
        b = (r.html or "").encode()
        groups.setdefault(b, []).append(r.page_id)
    out = []
    for r in rows:
        b = (r.html or "").encode()
        ids = [i for i in groups[b] if i is not None]
        first = min(ids) if ids and len(b) >= least and len(groups[b]) > 1 else None
        again = first is not None and r.page_id != first
        out.append((r.page_id, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def columns(df):
    return sorted([tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=repr)


def test_query_over_whole_table(spark, sf_dir):
    out = queries.op1_warc(spark, sf_dir)
    assert columns(out) == expected(spark.read.parquet(f"{sf_dir}/pages.parquet").collect())
    assert out.filter("record_type = 'response' and not digest_ok").count() == 0


@pytest.mark.parametrize("least", [0, 10])
def test_odd_rows_and_small_archives(spark, least):
    rows = [Row(page_id=i, url=f"http://h/{i % 3} \n", html=h, n=1, sha="x") for i, h in enumerate(
        [None, "", "same", "same", "é" * 20, "é" * 20, "z" * 500_000, "z" * 500_000, "Content-Length: 3\r\n\r\nabc", "same"])]
    rows += [rows[2], Row(page_id=None, url=None, html="same", n=1, sha="x"), Row(page_id=None, url=None, html="other", n=1, sha="x")]
    archive = warc.Archive(archive_bytes=200, min_revisit_bytes=least)
    folder, made = warc.write_archives(spark.createDataFrame(rows, SCHEMA), archive)
    out = warc.read_archives(made, folder)
    assert columns(out) == expected(rows, least)
    kept = {r.page_id: bytes(r.payload) for r in out.filter("payload is not null and page_id is not null").collect()}
    assert all(kept[r.page_id] == (r.html or "").encode() for r in rows if r.page_id in kept)
    assert made.count() > 3 and made.agg(F.sum("records")).first()[0] == len(rows)


def test_dictionary_leads_every_archive_and_records_stand_alone(spark, sf_dir):
    folder, made = warc.write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    fs, path = store(folder)
    for r in made.collect():
        data = fs.open_input_file(f"{path}/{r.file}").read()
        assert int.from_bytes(data[:4], "little") == warc.DICTIONARY_FRAME
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdCompressionDict(data[8:8 + size])
        assert d.dict_id() != 0
        at = data.rindex(b"\x28\xb5\x2f\xfd")  # the last record, without those before it
        assert zstandard.ZstdDecompressor(dict_data=d).decompress(data[at:]).startswith(b"WARC/1.1\r\n")


def test_empty_table(spark):
    folder, made = warc.write_archives(spark.createDataFrame([], SCHEMA))
    assert made.count() == 0 and warc.read_archives(made, folder).count() == 0
