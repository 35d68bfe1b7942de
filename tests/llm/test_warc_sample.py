from quantloom.llm import warc


def test_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """Rows without id and url, repeats of one row, and payloads larger than a sample's share."""
    rows = [(None, None, f"{i} " + "n" * 300) for i in range(1000)] + [(1, "http://h/1", "same" * 100)] * 1000 + [(2, "http://h/2", "long" * 5000)]
    seen = []
    monkeypatch.setattr(warc, "train", lambda samples, archive: seen.append(samples) or b"")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    warc.write_archives(pages, warc.Archive(sample_bytes=1 << 16))
    assert len(seen[0]) > 20 and sum(map(len, seen[0])) <= 3 * (1 << 16) and len(set(seen[0])) == len(seen[0])
    warc.write_archives(pages, warc.Archive(sample_bytes=4 << 16))
    assert sum(b"longlong" in x for x in seen[1]) <= 1
    warc.write_archives(pages.filter("page_id = 2"), warc.Archive(sample_bytes=1 << 14))
    assert len(seen[2]) == 1 and len(seen[2][0]) <= 1 << 11
