"""WARC archives as seekable Zstandard bundles.

A bundle is one Zstandard stream of independent frames, each holding some WARC records, then a skippable frame
with the bundle's index, closed by a skippable frame with the seek table (compressed and decompressed size of
every frame; magic numbers of the seekable format; the index counts as a frame of nothing). The index maps a record to its bundle, frame and offset inside the decompressed frame, so one record
is read by decompressing one frame.

Bundles are bounded in size and written by Spark's own writer as rows (bundle, records, data) into the
shared folder: the commit protocol makes writing safe against lost and repeated tasks, on any store. A row
group holds about one bundle and bundle names rise with their place, so ``fetch`` reads the bundles of the
pages it is asked for and no others. ``export`` puts bundles into plain files; ``file_index`` and ``read_at`` find and read one record of
such a file. A payload is kept once: of records with equal
payloads of ``least`` bytes or more, that with the smallest page_id is the response, the others are revisits
that name it. A response's block is an HTTP response with the payload as its body. Pages carry no time, so
WARC-Date is a parameter of ``write``.

Defined cases: null html is an empty payload; a null url is an empty target URI; a null page_id is written
with a record id made from the digest and reads back as null, and never is the response that others refer to (equal payloads with
null ids only are all responses); repeated rows (equal id and payload) of at least ``least`` bytes: one is
the response, the others revisit their own id; an empty table gives an empty archive; other columns are
not archived.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, new_dir, table, tidy

FRAME_BYTES, BUNDLE_BYTES, LEAST, DATE = 1 << 18, 4 << 20, 100, "2000-01-01T00:00:00Z"
_SKIP, _SKIP_INDEX, _SEEK = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
_FIELDS = ("page_id", "frame", "offset", "length")
_HEAD = "page_id long, target_uri string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def classify(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to to (page_id, url, html)."""
    payload = F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b""))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    base = base.select("page_id", "target_uri", "payload", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    # digests that occur once need no partner: only the others' small rows meet, and the join is planned by their written size
    copies = keep(
        base.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
        .groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"), F.count(F.when(F.col("page_id").isNotNull(), 1)).alias("named"))
        .where((F.col("n") > 1) & F.col("first").isNotNull()).select("payload_digest", "first")
    )
    met = base.join(copies, "payload_digest", "left")
    # of rows that repeat the first id, one is the response; only such rows are counted
    own = F.col("page_id") == F.col("first")
    again = keep(met.where(own).groupBy("payload_digest").agg(F.count("*").alias("k")).where("k > 1").select("payload_digest", F.lit(True).alias("several")))
    met = met.join(again, "payload_digest", "left")
    several = F.coalesce("several", F.lit(False)) & F.coalesce(own, F.lit(False))
    plain = met.where(~several).withColumn("revisit", F.col("first").isNotNull() & (F.col("page_id").isNull() | ~own))
    # such rows are counted by target and dealt out again, so thousands of them are one row of an aggregate
    rank = F.row_number().over(Window.partitionBy("payload_digest").orderBy("target_uri"))
    counted = met.where(several).groupBy("page_id", "payload_digest", "target_uri", "first", "payload_bytes").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
    doubled = counted.withColumn("rank", rank).withColumn("i", F.explode(F.expr("sequence(1L, n)"))).withColumn("revisit", ~((F.col("rank") == 1) & (F.col("i") == 1)))
    cols = ["page_id", "target_uri", "payload", "payload_bytes", "payload_digest", "first", "revisit"]
    both = plain.select(cols).unionByName(doubled.select(cols))
    kept = F.when(~F.col("revisit"), F.col("payload"))  # a revisit has no block
    return both.select("page_id", "target_uri", kept.alias("payload"), "payload_bytes", "payload_digest", F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), F.when(F.col("revisit"), F.col("first")).alias("refers_to"))


_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def _record(date, page_id, uri, payload, n, digest, kind, refers) -> bytes:
    body = _HTTP % n + payload if kind == "response" else b""
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:sha256:{digest}"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {(uri or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n}",
        "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def payload_of(block: bytes) -> bytes:
    """The body of a record's HTTP response; nothing for a revisit's empty block."""
    return block[block.index(b"\r\n\r\n") + 4 :] if block else b""


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable footer frame for frames of (compressed, decompressed) sizes."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, _SEEK)
    return struct.pack("<II", _SKIP, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of every frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != _SEEK:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
        out.append((at, c, d))
        at += c
    return out


def frame(data: bytes, number: int) -> bytes:
    import zstandard

    start, c, d = read_seek_table(data)[number]
    return zstandard.ZstdDecompressor().decompress(data[start : start + c], max_output_size=max(d, 1))


def index_frame(records: list[dict]) -> bytes:
    """The skippable frame that holds a bundle's index."""
    import zstandard

    body = zstandard.ZstdCompressor().compress(json.dumps([[r[k] for k in _FIELDS] for r in records]).encode())
    return struct.pack("<II", _SKIP_INDEX, len(body)) + body


def _table_of(file) -> list[tuple[int, int, int]]:
    end = file.seek(0, 2)
    file.seek(end - 9)
    n = struct.unpack("<IBI", file.read(9))[0]
    file.seek(end - 9 - 8 * n)
    return read_seek_table(file.read())


def file_index(file) -> list[dict]:
    """page_id, frame, offset and length of every record of a seekable binary file, from its index."""
    import zstandard

    start, c, _ = _table_of(file)[-1]
    file.seek(start + 8)
    return [dict(zip(_FIELDS, r, strict=True)) for r in json.loads(zstandard.ZstdDecompressor().decompress(file.read(c - 8)))]


def read_at(file, number: int, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record of a seekable binary file: its footer and one frame are read, nothing else."""
    import zstandard

    start, c, d = _table_of(file)[number]
    file.seek(start)
    head, body, _ = parse(zstandard.ZstdDecompressor().decompress(file.read(c), max_output_size=max(d, 1)), at)
    return head, payload_of(body)


def parse(block: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, body and end of the record that begins at an offset of a decompressed frame."""
    stop = block.index(b"\r\n\r\n", at)
    lines = block[at:stop].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    return head, block[stop + 4 : stop + 4 + n], stop + 8 + n


def _pack(frame_bytes: int, bundle_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        z, part, made = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), 0
        frames, sizes, index, block, done = [], [], [], bytearray(), 0

        def close_frame():
            nonlocal block, done
            if block:
                packed = z.compress(bytes(block))
                frames.append(packed)
                sizes.append((len(packed), len(block)))
                done += len(packed)
                block = bytearray()

        def close_bundle():
            nonlocal done, made
            close_frame()
            made += 1
            last = index_frame(index)
            data = b"".join([*frames, last, seek_table([*sizes, (len(last), 0)])])
            row = pa.RecordBatch.from_pylist([{"bundle": f"{part:08d}-{made:08d}", "records": list(index), "data": data}], schema=_SCHEMA)
            frames.clear(), sizes.clear(), index.clear()
            done = 0
            return row

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rec = _record(date, *row)
                if block and len(block) + len(rec) > frame_bytes:
                    close_frame()
                index.append({"page_id": row[0], "frame": len(frames), "offset": len(block), "length": len(rec)})
                block += rec
                if done + len(block) // 2 > bundle_bytes:
                    yield close_bundle()
        if index:
            yield close_bundle()

    return run


_ENTRY = pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_SCHEMA = pa.schema([("bundle", pa.string()), ("records", pa.list_(_ENTRY)), ("data", pa.binary())])
BUNDLES = "bundle string, records array<struct<page_id: long, frame: int, offset: long, length: long>>, data binary"


def write(pages: DataFrame, path: str, least: int = LEAST, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE) -> None:
    """Archives (page_id, url, html) under path, a folder of any store."""
    packed = classify(pages, least).mapInArrow(tidy(_pack(frame_bytes, bundle_bytes, date)), BUNDLES)
    # a row group a bundle, so that one can be read without the others
    packed.write.option("compression", "none").option("parquet.block.size", bundle_bytes // 2).option("parquet.block.size.row.check.min", 1).parquet(path)


def bundles(spark, path: str) -> DataFrame:
    return spark.read.schema(BUNDLES).parquet(path)


def index(spark, path: str) -> DataFrame:
    """(page_id, bundle, frame, offset, length): where each record lies."""
    return bundles(spark, path).select("bundle", F.explode("records").alias("r")).select("r.page_id", "bundle", "r.frame", "r.offset", "r.length")


def fetch(spark, path: str, page_ids: list[int]) -> DataFrame:
    """(page_id, record_type, payload) of a few pages: one frame of one bundle is decompressed for each."""
    want = index(spark, path).where(F.col("page_id").isin(*page_ids))
    names = [r.bundle for r in want.select("bundle").distinct().collect()]  # few: those that hold the pages asked for
    data = bundles(spark, path).where(F.col("bundle").isin(*names)).select("bundle", "data")  # row groups of other bundles are skipped
    rows = want.join(data, "bundle").select("page_id", "frame", "offset", "data")

    def run(batches):
        for b in batches:
            out = []
            for page_id, number, at, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                head, body, _ = parse(frame(data, number), at)
                out.append({"page_id": page_id, "record_type": head["WARC-Type"], "payload": payload_of(body)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload", pa.binary())]))

    return rows.mapInArrow(tidy(run), "page_id long, record_type string, payload binary")


def read(spark, path: str) -> DataFrame:
    """Every record of an archive, from its bytes: headers, digest and length of what is stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for b in batches:
            for data in b.column(0):
                data, out = data.as_py(), []
                for number in range(len(read_seek_table(data)) - 1):  # the last is the index
                    block, at = frame(data, number), 0
                    while at < len(block):
                        head, body, at = parse(block, at)
                        body = payload_of(body)
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(head["X-Payload-Length"])):
                            raise ValueError(f"record {head.get('WARC-Record-ID')} is damaged")
                        ref = lambda k: int(head[k][10:-1]) if head.get(k, "").startswith("<urn:page:") else None
                        out.append((ref("WARC-Record-ID"), head["WARC-Target-URI"], body, int(head["X-Payload-Length"]), digest, kind, ref("WARC-Refers-To")))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    return bundles(spark, path).select("data").mapInArrow(tidy(run, 4), _HEAD)


_TYPES = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
_NAMES = ["page_id", "target_uri", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def export(spark, path: str, folder: str) -> int:
    """Copies bundles to plain files <bundle>.warc.zst, each with its index and seek table inside.

    The tasks write them, so folder has to be one that all executors see; a file appears under its name when it is complete.
    """

    def run(batches):
        import os

        os.makedirs(folder, exist_ok=True)
        for b in batches:
            for name, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                part = os.path.join(folder, f".{name}.{os.getpid()}")
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, os.path.join(folder, f"{name}.warc.zst"))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    done = bundles(spark, path).select("bundle", "data").mapInArrow(tidy(run, 4), "n long")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def op4_warc(spark, sf_dir: str) -> DataFrame:
    path = new_dir(spark)
    write(table(spark, sf_dir, "pages"), path)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM q
"""
