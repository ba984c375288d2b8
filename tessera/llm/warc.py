"""WARC archives: a writer, and a sequential reader of one gzip member per record.

The reader decompresses as bytes come in and never holds more than one record: zlib tells where a member
ends, Content-Length frames the block inside it, and block and payload digests are checked.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that the reader asks for at a time.
READ = 1 << 16


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, uri: str | None, payload: bytes, size: int, payload_digest: str, refers_to: str | None, date: str, level: int) -> bytes:
    """One record as one gzip member.  A revisit holds the HTTP head only; size is the full payload's."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packed.compress(("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + packed.flush()


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, each as it ends."""
    left = b""
    while True:
        left = left or stream.read(READ)
        if not left:
            return
        one, parts = zlib.decompressobj(31), []
        while not one.eof:
            if not left:
                left = stream.read(READ)
                if not left:
                    raise ValueError("the archive ends inside a gzip member")
            parts.append(one.decompress(left))
            left = one.unused_data
        yield b"".join(parts)


def fields(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def parse(member: bytes) -> dict:
    """A record's fields, and whether its digests hold."""
    at = member.find(b"\r\n\r\n")
    if at < 0 or not member.startswith(b"WARC/"):
        raise ValueError("no WARC head")
    head = fields(member[:at].decode("utf-8").split("\r\n")[1:])
    size = int(head["content-length"])
    block = member[at + 4 : at + 4 + size]
    if len(block) != size or member[at + 4 + size :] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {size} doesn't frame the block of {head.get('warc-record-id')}")
    cut = block.find(b"\r\n\r\n")
    http = fields(block[:cut].decode("latin-1").split("\r\n")[1:])
    payload, kind = block[cut + 4 :], head["warc-type"]
    said = head["warc-payload-digest"].partition(":")[2]
    whole = kind != "revisit"
    ok = head["warc-block-digest"].partition(":")[2] == digest(block) and (not whole or (digest(payload) == said and len(payload) == int(http["content-length"])))
    name = lambda x: x and x.strip("<>")
    return {"record_id": name(head["warc-record-id"]), "record_type": kind, "target_uri": head.get("warc-target-uri"), "refers_to": name(head.get("warc-refers-to")), "payload_digest": said, "payload_bytes": int(http["content-length"]), "digest_ok": ok, "payload": payload if whole else None}


#: Payload bytes that one task writes to one archive, and the most tables that Spark deals rows to by default.
ARCHIVE_BYTES, MOST_BUCKETS = 256 << 20, 100_000


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-zA-Z][\w+.-]*:", uri) else f"file://{uri}")


def _writer(folder: str, date: str, level: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name, part = f"part-{task.partitionId():06d}.warc.gz", f"_{task.partitionId():06d}-{task.taskAttemptId()}.tmp"
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        records = 0
        with system.open_output_stream(f"{path}/{part}", compression=None) as out:
            for batch in batches:
                for r in batch.to_pylist():
                    own = f"urn:page:{'none' if r['page_id'] is None else r['page_id']}:{r['digest']}"
                    first = r["record_type"] == "response"
                    out.write(record(r["record_type"], own if first else f"{own}:{task.partitionId()}-{records}", r["url"], r["payload"] if first else b"", r["size"], r["digest"], None if first else f"urn:page:{'none' if r['top'] is None else r['top']}:{r['digest']}", date, level))
                    records += 1
        # an attempt's whole file takes the place of an earlier one's; not every store moves on to a file that is there
        if system.get_file_info(f"{path}/{name}").is_file:
            system.delete_file(f"{path}/{name}")
        system.move(f"{path}/{part}", f"{path}/{name}")
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [records]})

    return run


def write_warc(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", level: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write a record per row to part-*.warc.gz in a shared folder; returns how many.

    Of rows with equal payloads of at least least_bytes, that with the largest id (nulls are smallest; of
    repeated rows one) becomes the response and the others revisit it.  Null html is an empty payload.
    """
    C.prepare(df.sparkSession)
    system, path = _filesystem(folder)
    system.create_dir(path, recursive=True)
    sent = typed_records(df, id_col, url_col, html_col, least_bytes, archive_bytes)
    return sent.mapInArrow(_based(_writer(folder, date, level)), "name string, records long").agg(F.sum("records")).first()[0] or 0


#: Rows whose decisions come to them in one piece.
TOGETHER = 4096


def typed_records(df: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Each row as a response, with its payload, or as a revisit of its payload's largest id.

    No payload is shuffled: rows are written once with their digests, dealt by their place, and what the digests decide
    comes to them there, one list for each TOGETHER rows.  There are as many tasks as payloads of archive_bytes, or as
    shuffle partitions if those are more.
    """
    spark = df.sparkSession
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload").cast("bigint"), "row": F.monotonically_increasing_id()})
    total = rows.agg(F.sum(F.octet_length("payload").cast("bigint"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(C.slots(spark), -(-total // archive_bytes)))
    rows = C.bucketed(rows.withColumn("place", F.expr(f"row DIV {TOGETHER}")), "pages", ["place"], buckets)
    each = rows.select("row", "place", "page_id", "digest", "size")
    # of a digest's rows, the first of those with the largest id
    best = F.max(F.struct("page_id", (-F.col("row")).alias("row")))
    tops = each.filter(F.col("size") >= least_bytes).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("weight"))
    tops = C.written(tops.filter("weight > 1").select("digest", "weight", F.col("best.page_id").alias("top"), (-F.col("best.row")).alias("top_row")), "digests")
    copies = C.join_to(each.select("row", "digest"), tops, "digest", int(tops.agg(F.sum("weight")).first()[0] or 0))
    revisits = copies.filter("row != top_row").select("row", "top")
    lists = revisits.groupBy(F.expr(f"row DIV {TOGETHER}").alias("place")).agg(F.map_from_entries(F.collect_list(F.struct("row", F.struct("top").alias("to")))).alias("revisits"))
    typed = rows.join(lists, "place", "left").withColumn("to", F.element_at("revisits", F.col("row")))
    first = F.col("to").isNull()
    return typed.select("page_id", "url", F.when(first, F.col("payload")).alias("payload"), "digest", "size", F.col("to.top").alias("top"), F.when(first, "response").otherwise("revisit").alias("record_type"))


def _based(write):
    """SHA-1 from the hexadecimal digits that Spark gives to base32."""

    def run(batches):
        def changed():
            for b in batches:
                i = b.schema.get_field_index("digest")
                yield b.set_column(i, "digest", pa.array([base64.b32encode(bytes.fromhex(x)).decode() for x in b.column(i).to_pylist()], pa.string()))

        yield from write(changed())

    return run


def _reader(payloads: bool):
    def run(batches):
        names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "digest_ok"] + ["payload"] * payloads
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                system, path = _filesystem(uri)
                rows, held = [], 0
                with system.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        r = parse(member)
                        rows.append(tuple(r[k] for k in names))
                        held += 500 + payloads * len(member)
                        if held > 8 << 20:
                            yield _rows(names, rows)
                            rows, held = [], 0
                yield _rows(names, rows)

    return run


def _rows(names, rows):
    kinds = {"payload_bytes": pa.int64(), "digest_ok": pa.bool_(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names)


def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """A row per record of the folder's *.warc.gz: record_id, record_type, target_uri, refers_to,
    payload_digest, payload_bytes, digest_ok and, if asked for, payload (null for revisits).

    Spark lists the files; each is read by one task as a stream.  Malformed records raise.
    """
    C.prepare(spark)
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    kinds = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, digest_ok boolean"
    return paths.mapInArrow(_reader(payloads), kinds + ", payload binary" * payloads)


def round_trip(df: DataFrame, folder: str | None = None, **named) -> DataFrame:
    """Write df's pages and read the archives back: page_id, payload_bytes, payload_digest, record_type,
    refers_to.  An empty table gives an empty result; other columns of df are ignored."""
    spark = df.sparkSession
    folder = folder or C.shared_dir(spark, "warc")
    write_warc(df, folder, **named)
    found = read_warc(spark, folder, payloads=False)
    page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) AS bigint)")
    checked = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("digest of "), "record_id")))
    return found.select(page("record_id").alias("page_id"), "payload_bytes", checked.alias("payload_digest"), "record_type", F.when(F.col("record_type") == "revisit", page("refers_to")).alias("refers_to"))
