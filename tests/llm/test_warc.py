import gzip
import hashlib
import zlib

from pyspark.sql import functions as F

from sluice.llm import queries
from sluice.llm import warc as W

from .helpers import rows_of

SCHEMA = "page_id long, url string, html string"


def brute(pages):
    out = []
    for page, _, html in pages:
        raw = (html or "").encode()
        same = [p for p, _, h in pages if p is not None and (h or "").encode() == raw]
        refers = max(same) if same and page is not None and len(raw) >= 1000 and max(same) != page else None
        out.append((str(page), len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


def view(df):
    return sorted(((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=repr)


PAGES = [
    (1, "http://a/?q=1 2", "x" * 1000), (2, "http://b", "x" * 1000), (9, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""),
    (7, "u\r\nWARC-Type: evil", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 5\r\n" * 60), (None, "n", "x" * 1000), (8, "é", "é" * 600), (10, "é%41", "é" * 600), (11, "u", "<p>🙂</p>" * 90_000),
]


def test_round_trip(spark):
    pages = spark.createDataFrame(PAGES, SCHEMA)
    got = W.round_trip(pages)
    assert view(got) == brute(PAGES)
    urls = {r["page_id"]: r["url"] for r in got.collect()}
    assert all(urls[p] == (u or "") for p, u, _ in PAGES)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in got.where("record_type = 'response'").collect()}
    assert all(texts[p] == (h or "") for p, _, h in PAGES if p in texts)


def test_query(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert view(queries.QUERIES["op7_warc"](spark, sf)) == brute(pages)


def test_normalised_members_and_index(spark):
    records = [W.record(i, "u", b"p" * i, "d", None) for i in range(1, 200)]
    whole = gzip.compress(b"".join(records))
    out, index = W.normalised(whole, step=97)
    assert [e["record_id"] for e in index] == [W.record_id(i) for i in range(1, 200)]
    for e, raw in zip(index, records, strict=True):
        assert zlib.decompress(out[e["offset"] : e["offset"] + e["length"]], 31) == raw
    assert sum(e["length"] for e in index) == len(out)
    again, _ = W.normalised(out)  # a normalised archive is many members: the same comes out
    assert again == out


def test_broken_archives_are_refused():
    import pytest

    with pytest.raises(ValueError):
        W.normalised(gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\n\r\n"))
    with pytest.raises(ValueError):
        W.normalised(gzip.compress(W.record(1, "u", b"abc", "d", None)[:-6]))


def test_files(spark, tmp_path):
    archives = W.normalise(W.write_archives(W.plan_records(spark.createDataFrame(PAGES, SCHEMA))))
    files = W.export_files(archives, f"file://{tmp_path}/warc").collect()
    assert files
    back = W.read_archives(W.normalise(W.read_files(spark, f"file://{tmp_path}/warc/*.warc.gz")))
    assert view(back) == brute(PAGES)


def test_edges(spark):
    pages = spark.createDataFrame([(1, "a", "y" * 2000), (1, "a", "y" * 2000), (0, "b", "y" * 2000)], SCHEMA)
    got = view(W.round_trip(pages))
    assert [r[3] for r in got] == ["revisit", "response", "response"]
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = pages.select("*", *(F.lit("z").alias(c) for c in ("digest", "payload", "kept", "refers_to", "_p", "n")))
    assert view(W.round_trip(wide)) == got
    assert rows_of(pages)
