r"""WARC: Zstandard archives, one frame a record, with the dictionary in a leading skippable frame.

`write_archives` packs rows into archives of about ARCHIVE_BYTES of payload: a skippable frame (magic 0x184D2A5D)
that holds the dictionary, itself compressed, then a frame for each record. The dictionary is trained on the archive's
first DICTIONARY_SAMPLE bytes of payload; small archives have none. Archives are rows (archive, content), so that any store
Spark writes can hold them; `read_archives` takes such rows, or those of `spark.read.format("binaryFile")`.

Records of equal payloads of at least REVISIT_LEAST bytes: that of the smallest id is a response, the others are
revisits, which have the response's HTTP headers and no payload. The smallest id of a digest is found by a
pre-aggregated group and a join that adaptive execution can split, so no group of copies is gathered.

The reader finds frames by their block headers, decodes each by itself, and checks the version line, the mandatory
headers, Content-Length against the block, the record's end, and digests; a record that fails has `error` set and its
neighbours are read all the same. Null payload counts as empty; null url has no WARC-Target-URI; rows of null id are
written as responses with null id. Repeated rows are written each, under record ids of their own; of rows with equal id and
payload, all are alike and none revisits itself: they are responses. Payloads of any length are one record; a table without
rows gives no archives. Of further columns none is read, so their names don't matter.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import Scratch, apart, bit_table, map_batches

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
ARCHIVE_BYTES, DICTIONARY_SAMPLE, DICTIONARY_BYTES = 4 << 20, 1 << 20, 16 << 10
REVISIT_LEAST = 100
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string, archive string, number long"


def record(page: object, url: str | None, payload: bytes, digest: str, size: int, refers_to: object, number: str = "0") -> bytes:
    """The bytes of one WARC/1.1 record. `number` tells the records of one page apart."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}?{number}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """An archive: the dictionary's skippable frame, if one could be trained, and a frame for each record."""
    import zstandard

    sample, size = [], 0
    for r in records:
        if size >= DICTIONARY_SAMPLE:
            break
        sample.append(r)
        size += len(r)
    out, trained = [], None
    if len(sample) >= 8 and size >= 8 * DICTIONARY_BYTES:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample)
        except zstandard.ZstdError:  # samples too alike or too few: the archive goes without
            trained = None
    if trained is not None:
        packed = zstandard.ZstdCompressor(level=3).compress(trained.as_bytes())
        out.append(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
    else:
        out.append(struct.pack("<II", SKIPPABLE, 0))
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True) if trained is not None else zstandard.ZstdCompressor(level=3, write_checksum=True)
    out += [packer.compress(r) for r in records]
    return b"".join(out)


def frames(content: bytes) -> Iterator[tuple[bool, int, int]]:
    """(skippable, start, end) of each frame, found by headers alone."""
    at = 0
    while at < len(content):
        if len(content) - at < 8:
            raise ValueError(f"{len(content) - at} stray bytes at the end")
        magic, size = struct.unpack_from("<II", content, at)
        if 0x184D2A50 <= magic <= 0x184D2A5F:
            if at + 8 + size > len(content):
                raise ValueError("the skippable frame is cut off")
            yield True, at, at + 8 + size
            at += 8 + size
            continue
        if magic != FRAME:
            raise ValueError(f"no frame at byte {at}")
        descriptor = content[at + 4]
        single, checksum = descriptor >> 5 & 1, descriptor >> 2 & 1
        end = at + 5 + (not single) + (0, 1, 2, 4)[descriptor & 3] + (single, 2, 4, 8)[descriptor >> 6]
        last = False
        while not last:
            if end + 3 > len(content):
                raise ValueError("the frame is cut off")
            head = int.from_bytes(content[end : end + 3], "little")
            last, kind, size = bool(head & 1), head >> 1 & 3, head >> 3
            if kind == 3:
                raise ValueError("a reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * checksum
        if end > len(content):
            raise ValueError("the frame is cut off")
        yield False, at, end
        at = end


def parse(data: bytes) -> dict:
    """Fields of a record; `error` says what is wrong with it."""
    out: dict = dict.fromkeys(("record_id", "record_type", "target_uri", "refers_to", "payload_bytes", "payload_digest", "payload", "error"))
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    named = lambda k: fields[k][10:-1] if fields.get(k, "").startswith("<urn:page:") else None
    out |= {"record_id": (named("warc-record-id") or "").rpartition("?")[0] if named("warc-record-id") is not None else None, "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "refers_to": named("warc-refers-to")}
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        return out | {"error": "no WARC version line"}
    if missing:
        return out | {"error": "missing " + ", ".join(missing)}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "Content-Length does not fit the block"}
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
        return out | {"error": "the block digest differs"}
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = [x.split(b":")[1].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
    out["payload_digest"] = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None
    out["payload_bytes"] = int(sizes[0]) if sizes and sizes[0].isdigit() else len(payload)
    if out["record_type"] == "revisit":
        return out
    if len(payload) != out["payload_bytes"]:
        return out | {"error": "the HTTP length differs"}
    digest = hashlib.sha256(payload).hexdigest()
    if out["payload_digest"] not in (None, digest):
        return out | {"error": "the payload digest differs"}
    return out | {"payload": payload, "payload_digest": digest}


def records(content: bytes) -> Iterator[dict]:
    """Every record of an archive, one frame each; a broken archive ends with a row of `error`."""
    import zstandard

    unpack, first, number = zstandard.ZstdDecompressor(), True, 0
    try:
        for skippable, start, end in frames(content):
            if skippable:
                if first and struct.unpack_from("<I", content, start)[0] == SKIPPABLE and end - start > 8:
                    held = content[start + 8 : end]
                    if held[:4] == struct.pack("<I", FRAME):
                        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                    unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
                first = False
                continue
            first = False
            try:
                found = parse(unpack.decompressobj().decompress(content[start:end]))
            except zstandard.ZstdError as e:
                found = parse(b"") | {"error": f"frame {number}: {e}"}
            yield found | {"number": number}
            number += 1
    except (ValueError, IndexError, struct.error, zstandard.ZstdError) as e:
        yield parse(b"") | {"error": str(e), "number": number}


def with_revisits(df: DataFrame, page: str = "page_id", payload: str = "html") -> DataFrame:
    """Adds __payload (binary), __bytes, __digest and __refers (the smallest id of the digest, for revisits).

    Digests that come again are found from digests and ids alone; only rows that may have one of these meet their least id,
    all others pass with their payloads where they lie.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.withColumn("__payload", F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8"))
    rows = rows.withColumn("__bytes", F.octet_length("__payload").cast("long")).withColumn("__digest", F.sha2("__payload", 256))
    least = rows.where(F.col("__bytes") >= REVISIT_LEAST).groupBy(F.col("__digest").alias("__d")).agg(F.min(page).alias("__least"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    least = scratch.save(least, "least")
    field = bit_table(least.select(F.xxhash64("__d")), scratch, "field")
    near, rest = apart(rows, F.xxhash64("__digest"), field)
    met = near.join(least, (F.col("__digest") == F.col("__d")) & (F.col("__bytes") >= REVISIT_LEAST), "left").drop("__d")
    met = met.withColumn("__refers", F.when(F.col("__least") < F.col(page), F.col("__least"))).drop("__least")
    return met.unionByName(rest.withColumn("__refers", F.lit(None).cast(df.schema[page].dataType)))


def write_archives(df: DataFrame, page: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(archive, content): the input's rows as archives, each made by one task from rows that lie together."""
    rows = with_revisits(df.select(*dict.fromkeys((page, url, payload))), page, payload).select(F.col(page).cast("string").alias("page"), F.col(url).alias("url"), F.when(F.col("__refers").isNull(), F.col("__payload")).alias("payload"), "__digest", "__bytes", F.col("__refers").cast("string").alias("refers"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, task, n = [], 0, TaskContext.get().partitionId(), 0

        def full() -> pa.RecordBatch:
            content = archive(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha256(content).hexdigest()[:24] + ".warc.zst"]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page_, url_, body, digest, length, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n += 1
                held.append(record(page_, url_, body or b"", digest, length, refers, f"{task}-{n}"))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield full()
                    size = 0
        if held:
            yield full()

    return map_batches(rows, pack, "archive string, content binary")


def read_archives(archives: DataFrame, content: str = "content", name: str = "archive", payloads: bool = True) -> DataFrame:
    """A row for each record (RECORD), with its archive and place; without payloads only their digests leave the worker."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for k in range(batch.num_rows):
                where, body = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                held, size = [], 0
                for r in records(body):
                    size += len(r["payload"] or b"")
                    held.append([r[c] if c != "archive" else where for c in names] if payloads else [None if c == "payload" else where if c == "archive" else r[c] for c in names])
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return map_batches(archives.select(F.col(name).alias("archive"), F.col(content).alias("content")), unpack, RECORD)
