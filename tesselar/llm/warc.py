"""WARC archives compressed by Zstandard: one frame a record, the dictionary in front.

`write_archives` is a Spark sink: tasks write .warc.zst files of about ARCHIVE_BYTES under names of their own into a hidden folder,
and the driver moves them once all tasks are through, so a task that is tried again or lost leaves no record behind.
Each file opens with a skippable frame that holds the dictionary, itself compressed; then come frames with one record each.
`read_archives` reads files with Spark's binaryFile source and walks them frame by frame. It takes the dictionary from the leading skippable frame, finds each frame's end from
its block headers (so that a damaged frame doesn't hide the next one), decodes it and validates version,
mandatory headers, lengths and digests. What is wrong is said in the column fault; a faulty record is a row like any other.

The first record of equal payloads is a response; the others are revisits that name it and hold no payload. Which is first is found
by aggregating digests before anything is written; so a payload that a third of all pages share sends one row a task.

Edge cases: a null payload counts as empty; an empty one is a response without payload bytes; long payloads are one record each (a payload is held in memory, at most 2 GB);
of pages with equal payload and the same smallest id all are responses; a null id is never first, and revisits if some id is; repeated rows get a record each;
an empty table writes no archive and gives no rows; a null URL leaves the target out; line breaks in a URL are escaped; extra columns are ignored.
The dictionary is trained on at most SAMPLE payloads, cut to SAMPLE_BYTES; it alters sizes only, and is left out where the sample is too small to train on.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .common import hinted, stage, staging_dir, table

#: Shorter payloads are never revisits.
LEAST_PAYLOAD = 100
#: An archive is closed once it has so many bytes.
ARCHIVE_BYTES = 16 << 20
LEVEL = 3
SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 16 << 10, 32 << 10
#: Fixed values of the two formats.
DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSIONS = ("WARC/1.0", "WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
NAME, END = "{}-{:05d}.warc.zst", b"\r\n\r\n"
RECORDS = "archive string, at long, record_id string, type string, target string, refers_to string, payload_bytes long, payload_digest string, payload binary, fault string"
ARROW = pa.schema([("archive", pa.string()), ("at", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("target", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("fault", pa.string())])
#: Payload bytes that a batch of the reader holds before it is handed on.
BATCH_BYTES = 8 << 20


def uri_of(key: str | int | None) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def record_of(kind: str, key: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP header alone."""
    block = HTTP.format(size).encode() + (payload if kind == "response" else b"")
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": uri_of(key),
        "WARC-Date": DATE,
        "WARC-Target-URI": url and re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Block-Digest": "sha256:" + hashlib.sha256(block).hexdigest(),
        "WARC-Payload-Digest": "sha256:" + digest,
        "WARC-Profile": PROFILE if kind == "revisit" else None,
        "WARC-Refers-To": uri_of(refers_to) if kind == "revisit" else None,
        "Content-Length": str(len(block)),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"{VERSIONS[-1]}\r\n{head}\r\n".encode() + block + END


def leading_frame(dictionary: bytes) -> bytes:
    """The skippable frame that holds the dictionary, compressed."""
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor(level=19, write_content_size=True).compress(dictionary)
    return DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed


@dataclass
class Written(WriterCommitMessage):
    names: list


class ArchiveWriter(DataSourceArrowWriter):
    """Writes records to a hidden folder of the target; `commit` moves the files of the tasks that ended well."""

    def __init__(self, path: str, dictionary: bytes):
        self.path, self.dictionary, self.job = path.rstrip("/"), dictionary, uuid.uuid4().hex

    def place(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = self.place()
        hidden = f"{root}/_writing-{self.job}"
        files.create_dir(hidden)
        name, names, out = uuid.uuid4().hex, [], None
        pressed = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(self.dictionary) if self.dictionary else None, write_checksum=True, write_content_size=True)
        lead = leading_frame(self.dictionary)
        size = 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    names.append(NAME.format(name, len(names)))
                    out, size = files.open_output_stream(f"{hidden}/{names[-1]}", compression=None), len(lead)
                    out.write(lead)
                frame = pressed.compress(record_of(row["type"], row["key"], row["url"], row["payload"], row["size"], row["digest"], row["refers_to"]))
                out.write(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        files, root = self.place()
        for name in (n for m in messages if m is not None for n in m.names):
            files.move(f"{root}/_writing-{self.job}/{name}", f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        files, root = self.place()
        if files.get_file_info(f"{root}/_writing-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/_writing-{self.job}")


class ArchiveSink(DataSource):
    """df.write.format("warc_zst"): options path and dictionary (in hex)."""

    @classmethod
    def name(cls) -> str:
        return "warc_zst"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], bytes.fromhex(self.options.get("dictionary", "")))


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the records of a bounded sample of pages (key, url, p); empty where there is too little to train on."""
    rows = pages.where(F.length("p") > 0).select("key", "url", F.substring("p", 1, SAMPLE_BYTES).alias("p")).limit(SAMPLE).collect()
    records = [record_of("response", r["key"], r["url"], bytes(r["p"]), len(r["p"]), hashlib.sha256(r["p"]).hexdigest(), None) for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records).as_bytes() if len(records) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def with_records(pages: DataFrame, key: str, url: str, payload: Column) -> DataFrame:
    """key, url, payload, size, digest, type and refers_to of each page's record."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "hash": F.unhex(F.sha2("payload", 256))})
    groups = rows.where(F.col("size") >= LEAST_PAYLOAD).groupBy("hash").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    groups = stage(groups.where("n > 1").select("hash", "first"), "equal-payloads")
    rows = rows.join(hinted(groups), "hash", "left")
    again = F.col("first").isNotNull() & ~F.col("key").eqNullSafe(F.col("first"))
    kind = F.when(again, "revisit").otherwise("response")
    return rows.select("key", "url", F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"), "size", F.lower(F.hex("hash")).alias("digest"), kind.alias("type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Add one record per page to the archives in a folder that all executors share."""
    spark = pages.sparkSession
    payload = F.encode(F.col(html), "UTF-8")
    dictionary = train_dictionary(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), payload.alias("p")))
    spark.dataSource.register(ArchiveSink)
    files, root = fs.FileSystem.from_uri(path)
    files.create_dir(root)
    with_records(pages, key, url, payload).write.format("warc_zst").option("path", path).option("dictionary", dictionary.hex()).mode("append").save()


class Damaged(ValueError):
    """Bytes that can't be what the format says."""


def frames_of(data: memoryview) -> Iterator[tuple[int, int, int]]:
    """Magic number, start and end of each frame, from frame and block headers alone."""
    at = 0
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPABLE:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        elif magic == FRAME_MAGIC:
            try:
                end = at + zstandard.frame_header_size(data[at : at + 18])
                checked = zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
            except zstandard.ZstdError as e:
                raise Damaged(f"{at}: frame header: {e}") from None
            last = False
            while not last:
                if end + 3 > len(data):
                    raise Damaged(f"{at}: the frame is cut off")
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                if kind == 3:
                    raise Damaged(f"{at}: reserved block type")
                end += 3 + (1 if kind == 1 else size)
            end += 4 * checked
        else:
            raise Damaged(f"{at}: no frame begins here")
        if end > len(data):
            raise Damaged(f"{at}: the frame is cut off")
        yield magic, at, end
        at = end


def dictionary_of(frame: bytes | memoryview) -> zstandard.ZstdCompressionDict:
    """The dictionary in a skippable frame, plain or compressed."""
    body = bytes(frame[8:])
    if body[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
    return zstandard.ZstdCompressionDict(body)


def headers_of(lines: list[bytes]) -> dict[str, str]:
    """Named fields; names in lower case, folded lines joined, the first of repeated names kept."""
    found: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in (b" ", b"\t") and last:
            found[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon or not name.strip():
            raise Damaged(f"header line without a name: {name[:40]!r}")
        last = name.strip().lower()
        if last in found and last in MANDATORY:
            raise Damaged(f"{last} is given twice")
        found.setdefault(last, value.strip())
    return found


def whole_number(text: str | None, what: str) -> int:
    if not re.fullmatch(r"[0-9]{1,18}", text or ""):
        raise Damaged(f"{what} is not a length: {text!r}")
    return int(text)


def checked(claimed: str | None, data: bytes, what: str) -> None:
    if claimed and claimed.lower().startswith("sha256:") and claimed[7:].lower() != hashlib.sha256(data).hexdigest():
        raise Damaged(f"{what} does not fit its digest")


def parsed(record: bytes) -> dict:
    """The fields of one record; Damaged if anything about it is wrong."""
    head, gap, rest = record.partition(END)
    first, *lines = head.split(b"\r\n")
    if first.decode("ascii", "replace") not in VERSIONS:
        raise Damaged(f"version: {first[:20]!r}")
    if not gap:
        raise Damaged("headers don't end")
    headers = headers_of(lines)
    if missing := [m for m in MANDATORY if not headers.get(m)]:
        raise Damaged(f"missing: {', '.join(missing)}")
    size = whole_number(headers["content-length"], "Content-Length")
    if len(rest) != size + len(END) or rest[size:] != END:
        raise Damaged(f"Content-Length is {size}, the block has {len(rest) - len(END)} bytes")
    block, kind = rest[:size], headers["warc-type"]
    checked(headers.get("warc-block-digest"), block, "the block")
    payload, length, digest = block, size, None
    if headers.get("content-type", "").startswith("application/http"):
        head, gap, payload = block.partition(END)
        if not gap:
            raise Damaged("HTTP headers don't end")
        said = headers_of(head.split(b"\r\n")[1:]).get("content-length")
        length = len(payload) if said is None else whole_number(said, "HTTP Content-Length")
    claimed = headers.get("warc-payload-digest")
    if kind == "revisit":
        if not headers.get("warc-refers-to"):
            raise Damaged("a revisit that refers to nothing")
        if payload:
            raise Damaged("a revisit with a payload")
        payload, digest = None, (claimed or "").partition(":")[2] or None
    else:
        if length != len(payload):
            raise Damaged(f"HTTP Content-Length is {length}, the payload has {len(payload)} bytes")
        checked(claimed, payload, "the payload")
        digest = hashlib.sha256(payload).hexdigest()
    return {"record_id": headers["warc-record-id"], "type": kind, "target": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"), "payload_bytes": length, "payload_digest": digest, "payload": payload}


def records_of(archive: str, data: bytes) -> Iterator[dict]:
    """A row for each record of an archive, and one for what can't be walked any further."""
    view, inflate, first = memoryview(data), zstandard.ZstdDecompressor(), True
    try:
        for magic, start, end in frames_of(view):
            if magic in SKIPPABLE:
                if first and magic == DICTIONARY_MAGIC:
                    try:
                        inflate = zstandard.ZstdDecompressor(dict_data=dictionary_of(view[start:end]))
                    except zstandard.ZstdError as e:
                        raise Damaged(f"dictionary: {e}") from None
            else:
                try:
                    row = parsed(inflate.decompressobj().decompress(view[start:end]))
                except (Damaged, zstandard.ZstdError) as e:
                    row = {"fault": str(e)}
                yield row | {"archive": archive, "at": start}
            first = False
    except Damaged as e:
        yield {"archive": archive, "at": None, "fault": str(e)}


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all *.warc.zst files in a folder: archive, at (byte), record_id, type, target, refers_to, payload_bytes, payload_digest, payload, fault."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"]):
                rows, held = [], 0
                for row in records_of(archive.as_py(), data.as_py()):
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += len(row.get("payload") or b"") + 300
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select("path", "content").mapInArrow(run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages are written to the shared folder and read back; a faulty record stops the query."""
    path = f"{staging_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), path)
    id_of = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(-?[0-9]*)>$", 1), F.lit("")).cast("long")
    sound = F.when(F.col("fault").isNotNull(), F.raise_error(F.concat(F.lit("faulty record: "), "fault")).cast("string")).otherwise(F.col("type"))
    return read_archives(spark, path, payloads=False).select(id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), id_of("refers_to").alias("refers_to"))


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_PAYLOAD} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to FROM f
"""
