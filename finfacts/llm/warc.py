"""WARC archives with a two-level capture index.

Archives are ``.warc.gz`` files: runs of gzip members, one a record, so a record can be read by its byte range. The index
sorts captures by reversed-host URL key into zlib blocks; a sparse directory holds each block's first key. A look-up
goes from the boundaries of the index's range partitions to a partition's directory, to one block, to one line, to a
byte range, and reads only that range of the file.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from finfacts.llm.common import Scratch, batch_rows, ship

_CAPTURE = pa.struct([("surt", pa.string()), ("page_id", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("type", pa.string())])
_ARCHIVES = "archive string, captures array<struct<surt:string,page_id:bigint,at:bigint,size:bigint,type:string>>"
_RECORDS = "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def surt(url: str | None) -> str:
    """Reversed-host key: ``http://m.a.com:80/x?y#z`` gives ``com,a,m:80)/x?y``; a null gives the empty key.

    Scheme, user and fragment are dropped, the host is lower-cased; without ``://`` the text itself is the key.
    """
    if not url:
        return ""
    m = re.match(r"[^:/?#]*://([^/?#]*)([^#]*)", url, re.S)
    if not m:
        return url
    host, _, port = m[1].rpartition("@")[2].lower().partition(":")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (m[2] or "/")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(kind: str, page_id, place: str, url: str | None, payload: bytes, digest: str, refers: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{page_id}:{place}>", f"WARC-Date: {date}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="".join(map(chr, range(33, 127))).replace("%", "")))
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Type, page, URL, payload, full payload size, digest and referred page of a record."""
    from urllib.parse import unquote

    head, _, rest = raw.partition(b"\r\n\r\n")
    h = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    page = h["WARC-Record-ID"][1:-1].split(":")[2]
    refers = h["WARC-Refers-To"][1:-1].split(":")[2] if "WARC-Refers-To" in h else None
    return {"page_id": None if page == "None" else int(page), "url": unquote(h["WARC-Target-URI"]) if "WARC-Target-URI" in h else None,
            "payload": payload if h["WARC-Type"] == "response" else None, "payload_bytes": size,
            "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha1:"), "record_type": h["WARC-Type"],
            "refers_to": None if refers in (None, "None") else int(refers)}


def _file_system(uri: str):
    """The file system of a folder and the folder's path in it, as pyarrow knows them (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, scratch: Scratch, min_revisit: int = 0, max_archive: int = 8 << 20,
                   date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, str]:
    """Writes one record a row of ``pages`` (page_id, url, html); returns (archive, captures) rows and the files' folder.

    Rows of equal payloads (SHA-1) of at least ``min_revisit`` bytes share one response, that of the smallest
    page_id (null last); it is found by a partial aggregation, and the join back lets AQE split a hot payload. What a
    row becomes depends on its own columns only, never on row numbers, so any order of the input gives the same records;
    rows that tie on the smallest page_id are all responses. A file closes at ``max_archive`` bytes of records (one
    larger record stays whole). A task that is run again writes other files, and only those that the table names count.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("payload_key", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")))
    first = rows.groupBy("payload_key").agg(F.min("page_id").alias("first"))            # null only where all ids are
    known = rows.join(first, "payload_key").withColumn("record_type", F.when(
        (F.coalesce(F.octet_length("html"), F.lit(0)) < min_revisit) | F.col("page_id").eqNullSafe(F.col("first")), "response").otherwise("revisit"))
    known = known.select("page_id", "url", "html", "record_type", F.col("first").alias("refers"))
    folder = scratch.folder("files")

    def pack(batches):
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        attempt, part, number, blob, captures = uuid.uuid4().hex[:8], TaskContext.get().partitionId(), 0, bytearray(), []

        def close():
            nonlocal number, blob, captures
            name = f"{part:06d}-{number:05d}-{attempt}.warc.gz"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(bytes(blob))
            row = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([captures], pa.list_(_CAPTURE))], names=["archive", "captures"])
            number, blob, captures = number + 1, bytearray(), []
            return row

        for b in batch_rows(batches, 4 << 20):
            for r in b.to_pylist():
                payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                raw = _record(r["record_type"], r["page_id"], f"{part}-{number}-{len(captures)}", r["url"], payload, base32_sha1(payload), r["refers"], date)
                zip_ = zlib.compressobj(3, zlib.DEFLATED, 31)
                member = zip_.compress(raw) + zip_.flush()
                captures.append({"surt": surt(r["url"]), "page_id": r["page_id"], "at": len(blob), "size": len(member), "type": r["record_type"]})
                blob += member
                if len(blob) >= max_archive:
                    yield close()
        if captures:
            yield close()

    return scratch.write(known.mapInArrow(pack, _ARCHIVES), "archives"), folder


def write_index(archives: DataFrame, scratch: Scratch, lines_per_block: int = 3000) -> DataFrame:
    """Captures sorted by (key, page) into blocks: part, number, first_surt, first_page, lines, block (zlib of JSON lines)."""
    c = archives.select("archive", F.explode("captures").alias("c")).select("c.*", "archive")
    c = c.withColumn("page", F.coalesce("page_id", F.lit(-1 << 63))).select("surt", "page", "archive", "at", "size")
    ordered = c.repartitionByRange("surt", "page", "archive", "at").sortWithinPartitions("surt", "page", "archive", "at")

    def pack(batches):
        part, number, lines, first = TaskContext.get().partitionId(), 0, [], None
        names = ["part", "number", "first_surt", "first_page", "lines", "block"]

        def close():
            body = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"), 6)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([first[0]]),
                                               pa.array([first[1]], pa.int64()), pa.array([len(lines)], pa.int32()), pa.array([body], pa.binary())], names=names)

        for b in batches:
            for r in zip(*(x.to_pylist() for x in b.columns)):
                first = first or r
                lines.append(json.dumps(r))
                if len(lines) >= lines_per_block:
                    yield close()
                    number, lines, first = number + 1, [], None
        if lines:
            yield close()

    return scratch.write(ordered.mapInArrow(pack, "part int, number int, first_surt string, first_page bigint, lines int, block binary"), "index")


def _order(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")        # Spark compares strings by their UTF-8 bytes


def look_up(requests: DataFrame, index: DataFrame) -> DataFrame:
    """(surt, page, archive, at, size) of every capture of each distinct request (surt, page).

    The boundaries of the index's range partitions (one key a partition) go to all tasks; each request is sent to
    the partition that may hold it. There its directory and blocks meet the requests, directory and block are
    searched by bisection, and only blocks that a request falls into are decompressed.
    """
    spark = index.sparkSession
    bounds = sorted((r[0], _order(r[1]), r[2]) for r in index.groupBy("part").agg(F.min(F.struct("first_surt", "first_page")).alias("k")).select("part", "k.*").collect())
    edges = spark.sparkContext.broadcast(([k[1:] for k in bounds], [k[0] for k in bounds]))

    def send(batches):
        firsts, parts = edges.value
        for b in batches:
            s, p = b.column(0).to_pylist(), b.column(1).to_pylist()
            out = []
            for i, (x, page) in enumerate(zip(s, p)):
                key = (_order(x), page)
                hi = bisect.bisect_right(firsts, key)       # equal keys may span partitions: every one that can hold it
                lo = max(0, bisect.bisect_left(firsts, key) - 1)
                out += [(i, parts[j]) for j in range(lo, hi)]
            at = pa.array([i for i, _ in out], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([k for _, k in out], pa.int32())], names=["surt", "page", "part"])

    def search(wanted: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("number")
        directory = [(_order(s), p) for s, p in zip(blocks["first_surt"], blocks["first_page"])]
        packed, opened, out = list(blocks["block"]), {}, []
        keys = sorted(zip(map(_order, wanted["surt"]), wanted["page"]))
        for key in keys:
            for j in range(max(0, bisect.bisect_left(directory, key) - 1), bisect.bisect_right(directory, key)):
                if j not in opened:
                    lines = [json.loads(x) for x in zlib.decompress(packed[j]).decode("utf-8", "surrogatepass").split("\n")]
                    opened = {j: ([(_order(x[0]), x[1]) for x in lines], lines)}     # requests are sorted: earlier blocks are done
                order, lines = opened[j]
                out += lines[bisect.bisect_left(order, key):bisect.bisect_right(order, key)]
        return pd.DataFrame(out, columns=["surt", "page", "archive", "at", "size"])

    sent = requests.select("surt", "page").distinct().mapInArrow(send, "surt string, page bigint, part int")
    return sent.groupBy("part").cogroup(index.groupBy("part")).applyInPandas(search, "surt string, page bigint, archive string, at bigint, size bigint")


def read_captures(found: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The records at the byte ranges of ``found``; a response whose payload doesn't match its digest fails the job.

    Ranges are sent around, archives aren't: a task opens each file that its ranges lie in and reads those bytes. The
    number of ``tasks`` is given, as rows of ranges are too small to tell how much is read.
    """
    ranges = found.select("archive", "at", "size").repartition(tasks, "archive").sortWithinPartitions("archive", "at")

    def read(batches):
        fs, root = _file_system(folder)
        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)

        last, file, rows, held = None, None, [], 0
        for b in batches:
            for archive, at, size in zip(*(c.to_pylist() for c in b.columns)):
                if archive != last:
                    if file is not None:
                        file.close()
                    last, file = archive, fs.open_input_file(f"{root}/{archive}")
                file.seek(at)
                rows.append(parse_record(zlib.decompress(file.read(size), 31)))
                payload = rows[-1]["payload"]
                if payload is not None and base32_sha1(payload) != rows[-1]["payload_digest"]:
                    raise ValueError(f"damaged record of page {rows[-1]['page_id']}")
                held += len(payload or b"")
                if held > 8 << 20 or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, held = [], 0
        if file is not None:
            file.close()
        if rows:
            yield batch(rows)

    return ranges.mapInArrow(read, _RECORDS)


def archive_round_trip(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as WARC archives, indexes them and reads every page back through the index.

    One row a page: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.
    A null html is an empty payload, a null url the empty key (and null again). Repeated page ids keep their rows;
    rows that tie on the smallest page_id are all responses. A null id is larger than any other, so it is a response only
    where no other has its payload. An empty table gives none; other columns aren't read.
    """
    spark = pages.sparkSession
    ship(spark)
    scratch = Scratch(spark, "warc")
    archives, folder = write_archives(pages, scratch, min_revisit)
    index = write_index(archives, scratch)

    def keys(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in b.column(0).to_pylist()], pa.string()), b.column(1)], names=["surt", "page"])

    wanted = pages.select(F.col("url").cast("string"), F.coalesce(F.col("page_id").cast("long"), F.lit(-1 << 63)).alias("page"))
    return read_captures(look_up(wanted.mapInArrow(keys, "surt string, page bigint"), index), folder, -(-archives.count() // 2) or 1)
