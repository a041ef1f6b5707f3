import base64
import gzip
import hashlib
import io
import json
import os
import zlib

from pyspark.sql import functions as F

from bazaar.llm import warc as W
from bazaar.llm.common import shared_folder

PAGES = [(3, "http://a/é?x\r\ny", "<p>é</p>"), (1, "http://b", "same"), (2, "http://c", "same"), (9, None, "same"), (4, "http://d", None), (5, "http://e", ""),
         (6, "http://f", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (7, "http://g", "x" * 300_000), (None, "http://h", "same"), (1, "http://b", "same"), (None, "u", "lonely")]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def round_trip(spark, rows, min_bytes=0):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).withColumn("sha1", F.lit("clash")).withColumn("path", F.lit(1))
    folder = shared_folder(spark, "test")
    whole = W.write_monolithic(W.with_revisits(pages, min_bytes), f"{folder}/whole")
    index = W.normalise(whole, f"{folder}/members")
    return whole, index, W.read_members(index, payload=True).collect()


def test_round_trip(spark):
    whole, index, got = round_trip(spark, PAGES)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = []
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in PAGES:
        top = first.get(h or "")
        revisit = top is not None and i != top
        want.append((str(i) if i is not None else None, digest(h), "revisit" if revisit else "response", str(top) if revisit else None, len((h or "").encode()), None if revisit else (h or "").encode()))
    assert sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to, r.payload_bytes, None if r.payload is None else bytes(r.payload)) for r in got), key=key) == sorted(want, key=key)
    for f in whole.collect():  # monolithic: one member
        z = zlib.decompressobj(31)
        z.decompress(open(f.path.removeprefix("file:"), "rb").read())
        assert z.eof and not z.unused_data
    for path in {r.path for r in index.collect()}:
        local = path.removeprefix("file:")
        data, lines = open(local, "rb").read(), [json.loads(x) for x in open(local + ".idx")]
        assert sum(x["length"] for x in lines) == len(data) == os.path.getsize(local)
        for x in lines:
            member = gzip.decompress(data[x["offset"]:x["offset"] + x["length"]])
            assert member.startswith(b"WARC/1.1\r\n") and x["id"].encode() in member


def test_small_payloads_are_no_revisits(spark):
    _, _, got = round_trip(spark, [(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long enough"), (4, "d", "long enough")], min_bytes=5)
    assert {(r.page_id, r.record_type) for r in got} == {("1", "response"), ("2", "response"), ("3", "response"), ("4", "revisit")}


def test_empty_table(spark):
    assert round_trip(spark, [])[2] == []


def test_streams_in_small_chunks():
    records = [W.record(str(i), "u", os.urandom(i * 37), digest("x"), None, False) for i in range(20)]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        for size in (1, 7, 4096):
            out = io.BytesIO()
            got = list(W.normalise_stream(W.inflate(data[i:i + size] for i in range(0, len(data), size)), out.write))
            assert [gzip.decompress(out.getvalue()[a:a + n]) for a, n, _ in got] == records


def test_ids_with_spaces_and_controls_come_back(spark):
    ids = ["a b", " lead", "100%", "%20", "é\n", "x\ty", "plain", ""]
    pages = spark.createDataFrame([(i, "u", f"<p>{k // 2}</p>") for k, i in enumerate(ids)], "page_id string, url string, html string")
    folder = shared_folder(spark, "test")
    got = W.read_members(W.normalise(W.write_monolithic(W.with_revisits(pages), f"{folder}/whole"), f"{folder}/members")).collect()
    assert sorted(r.page_id for r in got) == sorted(ids)
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {min(ids[k], ids[k + 1]) for k in range(0, len(ids), 2)}
