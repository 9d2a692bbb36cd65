"""WARC archives: whole round trip, planted damage, foreign archives, odd rows."""

import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from tesselar.llm import warc

LONG = "<p>" + "lorem ipsum " * 200_000 + "</p>"
PAGES = [
    (5, "http://a/x y\r\nz", "<p>same</p>" * 40),
    (3, "http://b", "<p>same</p>" * 40),
    (3, "http://b2", "<p>same</p>" * 40),
    (None, "http://c", "<p>same</p>" * 40),
    (7, None, "short"),
    (8, "http://d", "short"),
    (9, "http://e", None),
    (10, "http://f", ""),
    (11, "http://g", "\r\n\r\nünïcode \x00" * 30),
    (12, "http://h", LONG),
    (13, "http://h", LONG),
    (None, "http://i", "<b>nobody</b>" * 20),
    (None, "http://i", "<b>nobody</b>" * 20),
]


def brute(pages):
    first, out = {}, []
    for key, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 100 and key is not None:
            first[data] = min(key, first.get(data, key))
    for key, _, html in pages:
        data = (html or "").encode()
        again = data in first and first[data] != key
        out.append((key, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[data] if again else None))
    return sorted(out, key=str)


def written(spark, tmp_path, rows, name="a"):
    path = f"file://{tmp_path}/{name}"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("key", "hash", "size", "first", "type")})
    warc.write_archives(pages.repartition(3), path)
    return path, warc.read_archives(spark, path)


def key_of(uri):
    text = uri[len("<urn:page:") : -1]
    return int(text) if text else None


def test_round_trip(spark, tmp_path):
    path, records = written(spark, tmp_path, PAGES)
    rows = records.collect()
    assert all(r["fault"] is None for r in rows)
    got = [(key_of(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to"] and key_of(r["refers_to"])) for r in rows]
    assert sorted(got, key=str) == brute(PAGES)
    for r in rows:
        if r["type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    assert {r["target"] for r in rows if key_of(r["record_id"]) == 5} == {"http://a/x%20y%0D%0Az"}
    warc.write_archives(spark.createDataFrame([(99, "u", "later")], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == len(PAGES) + 1  # appended; nothing hidden is left
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith("_")]


def test_empty_table(spark, tmp_path):
    assert written(spark, tmp_path, [])[1].count() == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    rows = spark.range(100).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") == 77, F.raise_error(F.lit("planted")).cast("string")).otherwise("text").alias("html"))
    with pytest.raises(Exception, match="planted"):
        warc.write_archives(rows, path)
    assert not list((tmp_path / "f").glob("*.warc.zst"))


def pack(records, dictionary=b"", magic=warc.DICTIONARY_MAGIC):
    pressed = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return warc.leading_frame(dictionary) + b"".join(pressed.compress(r) for r in records)


def good(i, kind="response", payload=b"x" * 200):
    return warc.record_of(kind, i, "http://u", payload, len(payload), hashlib.sha256(payload).hexdigest(), 0 if kind == "revisit" else None)


def test_dictionary_and_frames():
    r = random.Random(1)
    payloads = [" ".join(r.choice(("alpha", "beta", "gamma", "delta")) for _ in range(80)).encode() for _ in range(200)]
    records = [good(i, payload=p) for i, p in enumerate(payloads)]
    dictionary = zstandard.train_dictionary(4096, records).as_bytes()
    data = pack(records, dictionary)
    rows = list(warc.records_of("a", data))
    assert [x["payload"] for x in rows] == payloads and len(data) < len(pack(records))
    plain = warc.DICTIONARY_MAGIC.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary
    assert [x["payload"] for x in warc.records_of("a", plain + data[len(warc.leading_frame(dictionary)) :])] == payloads
    assert all("fault" in x for x in warc.records_of("a", data[len(warc.leading_frame(dictionary)) :]))  # no dictionary: every frame fails alone


@pytest.mark.parametrize(
    "change, fault",
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9"), "version"),
        (lambda r: r.replace(b"WARC-Date: ", b"X-Date: "), "missing: warc-date"),
        (lambda r: r.replace(b"x" * 200, b"x" * 199), "Content-Length"),
        (lambda r: r[:-2], "Content-Length"),
        (lambda r: r + b"\r\n", "Content-Length"),
        (lambda r: r.replace(b"xxx", b"xyx", 1), "digest"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: response"), "twice"),
        (lambda r: r.replace(b"\r\n\r\n", b"\r\n"), "headers don't end"),
        (lambda r: r.replace(b"Content-Type: app", b"Content-Type app"), "without a name"),
        (lambda r: b"", "version"),
    ],
)
def test_faulty_record_among_sound_ones(change, fault):
    rows = list(warc.records_of("a", pack([good(1), change(good(2)), good(3)])))
    assert len(rows) == 3 and fault in rows[1]["fault"] and not rows[0].get("fault") and not rows[2].get("fault")


def test_damaged_bytes():
    whole = pack([good(1), good(2), good(3)])
    ends = [e for _, _, e in warc.frames_of(memoryview(whole))]
    hurt = bytearray(whole)
    hurt[ends[1] - 6] ^= 0xFF
    rows = list(warc.records_of("a", bytes(hurt)))
    assert [bool(x.get("fault")) for x in rows] == [False, True, False]
    cut = list(warc.records_of("a", whole[: ends[2] - 5]))
    assert [bool(x.get("fault")) for x in cut] == [False, False, True] and "cut off" in cut[2]["fault"]
    assert "no frame begins" in list(warc.records_of("a", whole + b"junk here"))[3]["fault"]
    skip = (0x184D2A53).to_bytes(4, "little") + (3).to_bytes(4, "little") + b"abc"
    assert len(list(warc.records_of("a", whole[: ends[0]] + skip + whole[ends[0] :]))) == 3


def test_foreign_records():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Type: text/plain;\r\n charset=x\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    row = next(warc.records_of("a", pack([info])))
    assert row["payload"] == b"abcd" and row["type"] == "warcinfo" and not row.get("fault")
    assert "refers to nothing" in next(warc.records_of("a", pack([good(1, "revisit").replace(b"WARC-Refers-To", b"X")])))["fault"]
