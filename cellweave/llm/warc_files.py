"""WARC archives written in deterministic shards and read back.

1. Equal payloads are found by their SHA-256 and length, from digests alone. Payloads
   that hold more than a thousandth of all records (a thousand of them at most) meet
   their records by a broadcast, the others by a join, so no key fills a task.
2. Records are dealt by ranges of ids, one range a task, and sorted by id; decisions
   travel to the same ranges. Ranges are cut at a sample of ids that depends on the
   ids and sizes only, so the same records give the same files, byte for byte,
   however the input was partitioned and however many machines write.
3. A task writes its records one by one, each a gzip member of its own, and begins a
   new file when the compressed size reaches ``file_bytes``. Headers, record ids and
   digests are made anew.
4. Files are written under temporary names that no two attempts share. What Spark
   keeps of a task's rows names the files of the attempt that counts; these are
   renamed, the manifest is put in place by one rename, and the temporary folder
   with whatever lost attempts left in it goes. Without a manifest there is no archive.

Files are opened through Arrow's file systems, so the folder may be any URI that Arrow
knows (``file://``, ``hdfs://``, ``s3://``, ``gs://``).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import discard, map_arrow, materialize, row_runs, shared_dir, table

#: Payloads below this size are never revisits.
REVISIT_BYTES = 1000
#: Bytes of payload in a range of ids, as long as there are no more than MOST_RANGES; compressed size at which a file ends.
RANGE_BYTES, MOST_RANGES = 16_000_000, 100_000
FILE_BYTES = 256_000_000
#: Ids that the sample holds for each range, on average.
SAMPLED = 32
#: Payloads with more than one in so many of all records are broadcast: so many at most.
HOT_SHARE = 1000
READ_BYTES = 1 << 20

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_WRITTEN = "bucket int, seq int, temporary string, file string, bytes long, records long, first_id long, last_id long, sha256 string"
_WRITTEN_KINDS = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
_READ_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def _place(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return arrow_fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else re.sub(r"^(\w+):/", r"\1:///", uri))


# Records ------------------------------------------------------------------------------------------


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode("ascii")


def record_id(page_id: int | None, payload_sha1: bytes, copy: int = 0) -> str:
    """Name of the record of one page; ``copy`` counts records of equal id and payload."""
    seed = hashlib.sha1(repr((page_id, payload_sha1.hex(), copy)).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = [VERSION] + [f"{k}: {v}".encode() for k, v in fields if v is not None] + [b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, copy: int = 0) -> bytes:
    """A response record, or with ``refers_to`` a revisit record that holds the HTTP header without its payload.

    White space and control characters of the URL are percent-encoded, so that no URL adds a header.
    """
    digest, revisit = hashlib.sha1(payload).digest(), refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block += b"" if revisit else payload
    uri = None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", record_id(refers_to, digest) if revisit else None),
        ("WARC-Block-Digest", _sha1(hashlib.sha1(block).digest())),
        ("WARC-Payload-Digest", _sha1(digest)),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(fields, block)


def info_record(name: str, date: str) -> bytes:
    """The warcinfo record that opens a file."""
    block = b"software: cellweave\r\nformat: WARC File Format 1.1\r\n"
    seed = hashlib.sha1(f"{name} {date}".encode()).digest()
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(bytes=seed[:16], version=5)}>"),
        ("WARC-Date", date),
        ("WARC-Filename", name),
        ("WARC-Block-Digest", _sha1(hashlib.sha1(block).digest())),
        ("Content-Type", "application/warc-fields"),
    ]
    return _record(fields, block)


def packed(record: bytes, level: int = 6) -> bytes:
    """A gzip member with no time in it."""
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


def members(stream) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, one held at a time."""
    rest = b""
    while True:
        if not rest:
            rest = stream.read(READ_BYTES)
            if not rest:
                return
        open_, out = zlib.decompressobj(31), []
        while not open_.eof:
            if not rest:
                rest = stream.read(READ_BYTES)
                if not rest:
                    raise ValueError("an archive ends within a record")
            out.append(open_.decompress(rest))
            rest = open_.unused_data if open_.eof else b""
        yield b"".join(out)


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record; its length and block digest are checked."""
    head, found, body = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or not lines[0].startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    block = body[:n]
    if len(block) != n or body[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} has another length than its header says")
    if "warc-block-digest" in fields and _sha1(hashlib.sha1(block).digest()) != fields["warc-block-digest"]:
        raise ValueError(f"record {fields.get('warc-record-id')} has another block digest than its header says")
    return fields, block


# Writing ------------------------------------------------------------------------------------------


def _range_bounds(sized: DataFrame, total: int) -> np.ndarray:
    """Ids that cut the records into ranges of about equal bytes, ascending; a function of ids and sizes alone.

    An id is in the sample with a chance that grows with its payload; SAMPLED ids stand
    for a range, so the driver gets SAMPLED * MOST_RANGES numbers at most, about.
    """
    ranges = min(MOST_RANGES, -(-total // RANGE_BYTES))
    if ranges <= 1:
        return np.zeros(0, np.int64)
    unit = max(1, total // (ranges * SAMPLED))
    picked = sized.where("page_id is not null").where(F.pmod(F.xxhash64("page_id"), F.lit(unit)) < F.col("n_bytes")).select("page_id")
    ids = np.sort(picked.toArrow().column(0).to_numpy())
    return np.unique(ids[SAMPLED - 1 :: SAMPLED])


def _bucket(bounds: np.ndarray):
    """Number of bounds below the id, looked up in two steps; null ids stand in the first range."""
    if not len(bounds):
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda found: F.size(F.filter(found, lambda b: b < F.col("page_id")))
    passed = F.greatest(below(F.lit(bounds[::step])) - 1, F.lit(0)) * step
    return F.coalesce(passed + below(F.slice(F.lit(bounds), passed + 1, F.lit(step))), F.lit(0))


def revisits(sized: DataFrame, total: int) -> DataFrame:
    """``page_id, key, refers_to`` of records whose payload a record with a larger id holds too.

    ``sized`` has page_id, key (null where the payload is never a revisit) and n_bytes;
    ``total`` counts its rows. Null ids refer to nothing and nothing refers to them.
    """
    usable = sized.where("key is not null and page_id is not null").select("page_id", "key")
    several = materialize(usable.groupBy("key").agg(F.max("page_id").alias("top"), F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).where("top > least"), "payloads")
    # At most HOT_SHARE payloads can each have more than 1 / HOT_SHARE of the records.
    limit = total // HOT_SHARE
    hot = F.broadcast(several.where(F.col("n") > limit).select("key", "top"))
    rest = several.where(F.col("n") <= limit).select("key", "top")
    met = usable.join(hot, "key").unionByName(usable.join(hot, "key", "left_anti").join(rest, "key"))
    return met.where("page_id < top").select("page_id", "key", F.col("top").alias("refers_to"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
    least: int = REVISIT_BYTES,
) -> str:
    """Write one record for each row under ``path`` (a URI that driver and executors share) and commit it.

    Null texts are empty payloads, null URLs leave the header out. Of records with equal
    payloads of at least ``least`` bytes the one with the largest id is the response and
    those with smaller ids revisit it; rows that tie on that largest id are all
    responses. Rows with a null id come first, are responses and are never referred
    to. Repeated rows are all written. Rows of one id stay in one range. An empty input gives
    an archive without files. Other columns are ignored.

    A second archive at the same place is refused.
    """
    spark = pages.sparkSession
    files, root = _place(path)
    if files.get_file_info(f"{root}/manifest").type != arrow_fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive")
    temporary = f"{root}/_temporary-{uuid.uuid4().hex}"
    files.create_dir(temporary, recursive=True)

    payload = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    size = F.octet_length(payload)
    key = F.sha2(payload, 256)
    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), key.alias("key"))
    sized = materialize(pages.select(F.col(id_col).cast("long").alias("page_id"), F.when(size >= least, key).alias("key"), size.alias("n_bytes")), "sizes")
    whole = sized.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    bounds = _range_bounds(sized, whole["bytes"])
    refers = revisits(sized, whole["n"])

    none = lambda kind: F.lit(None).cast(kind)
    rows = refers.select("page_id", "key", F.lit(0).alias("kind"), "refers_to", none("string").alias("url"), none("binary").alias("payload"))
    rows = rows.unionByName(source.select("page_id", "key", F.lit(1).alias("kind"), none("long").alias("refers_to"), "url", "payload"))
    ranges = len(bounds) + 1
    dealt = rows.withColumn("bucket", _bucket(bounds)).repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "page_id", "key", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _place(path)
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        for row in _written(batches, store, temporary, attempt, date, file_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, _WRITTEN_KINDS, strict=True)], names=[x.split()[0] for x in _WRITTEN.split(", ")])

    written = materialize(map_arrow(dealt, write, _WRITTEN), "written")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _place(path)
        for batch in batches:
            for source_name, name, n in zip(*(batch.column(c).to_pylist() for c in ("temporary", "file", "bytes")), strict=True):
                _put(store, source_name, f"{root}/{name}", n)
            yield batch

    staged = f"{path}/_manifest-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = written.repartitionById(parts, F.pmod(F.xxhash64("bucket", "seq"), F.lit(parts)).cast("int"))
    map_arrow(spread, rename, _WRITTEN).drop("temporary").sortWithinPartitions("bucket", "seq").write.parquet(staged)
    files.move(_place(staged)[1], f"{root}/manifest")
    files.delete_dir(temporary)
    discard(written)
    discard(sized)
    return path


def _put(store: arrow_fs.FileSystem, source: str, target: str, size: int) -> None:
    """Rename a finished file; an attempt that finds it renamed already has nothing to do."""
    if store.get_file_info(source).type == arrow_fs.FileType.NotFound:
        if store.get_file_info(target).size != size:
            raise FileNotFoundError(f"neither {source} nor a whole {target} is there")
        return
    store.move(source, target)


def _written(batches: Iterator[pa.RecordBatch], store: arrow_fs.FileSystem, folder: str, attempt: str, date: str, file_bytes: int) -> Iterator[tuple]:
    """Write sorted rows of whole ranges; one row for each file."""
    out = None
    last, refers, copy = None, None, 0

    for part in (p for batch in batches for p in row_runs(batch, 5)):
        for page_id, key, kind, refers_to, url, payload, bucket in zip(*(part.column(i).to_pylist() for i in range(7)), strict=True):
            if (page_id, key) != last:
                last, refers, copy = (page_id, key), None, 0
            if kind == 0:
                refers = refers_to
                continue
            if out is not None and (bucket != out.bucket or out.size >= file_bytes):
                yield out.close()
                out = _File(store, folder, attempt, bucket, out.seq + 1 if bucket == out.bucket else 0, date)
            elif out is None:
                out = _File(store, folder, attempt, bucket, 0, date)
            out.add(page_id, page_record(page_id, url, payload, refers, date, copy))
            copy += 1
    if out is not None:
        yield out.close()


class _File:
    """One archive file under its temporary name."""

    def __init__(self, store, folder: str, attempt: str, bucket: int, seq: int, date: str):
        self.bucket, self.seq, self.size, self.records = bucket, seq, 0, 0
        self.name = f"pages-{bucket:06d}-{seq:05d}.warc.gz"
        self.temporary = f"{folder}/{self.name}.{attempt}"
        self.first = self.last = None
        self._digest = hashlib.sha256()
        self._stream = store.open_output_stream(self.temporary, compression=None)
        self._put(info_record(self.name, date))

    def _put(self, record: bytes) -> None:
        data = packed(record)
        self._stream.write(data)
        self._digest.update(data)
        self.size += len(data)

    def add(self, page_id: int | None, record: bytes) -> None:
        self._put(record)
        self.first = page_id if self.first is None else self.first
        self.last = page_id
        self.records += 1

    def close(self) -> tuple:
        self._stream.close()
        return self.bucket, self.seq, self.temporary, self.name, self.size, self.records, self.first, self.last, self._digest.hexdigest()


# Reading ------------------------------------------------------------------------------------------


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file of a committed archive: ``bucket, seq, file, bytes, records, first_id, last_id, sha256``."""
    return spark.read.parquet(f"{path}/manifest")


def page_row(fields: dict[str, str], block: bytes) -> tuple[tuple, bytes | None]:
    """Columns of ``read_warc`` and the payload (None for a revisit) of a response or revisit record.

    The payload digest of a response is computed from what was read and must be the header's.
    """
    head, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    said = fields["warc-payload-digest"]
    if revisit:
        http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
        n, payload = int(http[b"content-length"]), None
    else:
        n = len(payload)
        if _sha1(hashlib.sha1(payload).digest()) != said:
            raise ValueError(f"record {fields['warc-record-id']} has another payload digest than its header says")
    number = lambda name: int(fields[name]) if name in fields else None
    row = (number("x-page-id"), fields.get("warc-target-uri"), n, base64.b32decode(said.removeprefix("sha1:")).hex(), fields["warc-type"], number("x-refers-to-page-id"))
    return row, payload


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row for each response or revisit record of a committed archive, files spread over tasks.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` and, if asked for, ``payload`` (null
    for revisits). Lengths and digests are those of the full payload; every record's are checked.
    """
    schema = _READ + (", payload binary" if payloads else "")
    kinds = _READ_KINDS + ([pa.binary()] if payloads else [])
    names = [x.split()[0] for x in schema.split(", ")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(path)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        for name in (n for batch in batches for n in batch.column(0).to_pylist()):
            rows, held = [], 0
            with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for fields, block in map(parsed, members(stream)):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    row, payload = page_row(fields, block)
                    rows.append((*row, payload) if payloads else row)
                    held += 200 + (len(payload or b"") if payloads else 0)
                    if held > READ_BYTES:
                        yield pack(rows)
                        rows, held = [], 0
            if rows:
                yield pack(rows)

    files = manifest(spark, path).select("file", F.pmod(F.col("bucket") + F.col("seq"), F.lit(parts)).cast("int").alias("task"))
    return map_arrow(files.repartitionById(parts, F.col("task")).select("file"), read, schema)


def warc_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: every page written to archives and read back from them."""
    path = write_warc(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
