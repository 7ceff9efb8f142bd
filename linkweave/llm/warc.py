"""WARC archives: a writer with revisit records and a salvaging reader."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, written

#: Payloads smaller than this are always written in full.
MIN_REVISIT = 100
#: A file is closed once it holds this many bytes.
ROLL_AT = 64 << 20
_CHUNK = 1 << 20
#: A record's header block, and a whole record, may not be larger: the writer refuses such a page, to the reader it is damage.
MAX_RECORD = 1 << 30
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _named(page_id: int | None, digest: str) -> str:
    """The id of the response that revisits of a payload refer to."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}:{digest}')}>"


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None, own_id: str = "") -> bytes:
    """One record. A revisit has the HTTP head of the response, with the payload's length, and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if kind == "revisit" else head + payload
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {own_id or _named(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_named(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    out = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    if len(out) > MAX_RECORD:
        raise ValueError(f"page {page_id}: a record of {len(out)} bytes would not be read back; the limit is {MAX_RECORD}")
    return out


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with payload, payload_digest, record_type and refers_to.

    Of the pages with equal payloads of MIN_REVISIT bytes or more, the one with the smallest
    page_id is the response and the others revisit it; of rows that repeat that page_id, one is (the smallest url). A null html is an empty payload. A
    null page_id never becomes a response that others refer to unless it stands alone. Other columns are not read; an empty table has no records.
    Groups of equal payloads are reduced to their smallest id in each task before they move; payloads
    move once, to meet it, and a join splits groups that are too large for a task.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= MIN_REVISIT)
    each = large.groupBy("payload_digest", "page_id").agg(F.count("*").alias("n"))
    groups = each.groupBy("payload_digest").agg(F.sum("n").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("n").alias("rows"))).alias("m"))
    groups = written(groups.where("n > 1 and m.page_id is not null").select("payload_digest", F.col("m.page_id").alias("first"), F.col("m.rows").alias("rows")), "payload-groups")
    joined = rows.join(groups.hint("merge"), "payload_digest", "left")
    # Equal payloads are equal digests; small ones have no group.
    leads = F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    revisit = F.col("first").isNotNull() & ~(leads & (F.coalesce("rows", F.lit(1)) == 1))
    plan = lambda df, again: df.select("page_id", "url", "payload", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))
    if not groups.where("rows > 1").take(1):
        return plan(joined, revisit)
    # Rows that repeat the page_id of a response: equal ones are counted and made anew, one of them as the response.
    several = leads & (F.col("rows") > 1)
    counted = joined.where(several).groupBy("payload_digest", "page_id", "url", "first").agg(F.count("*").alias("n"), F.first("payload").alias("payload"))
    least = counted.groupBy(F.col("payload_digest").alias("of")).agg(F.min(F.struct(F.col("url").isNotNull().alias("some"), F.col("url").alias("url"))).alias("least"))
    counted = counted.join(least, F.col("payload_digest") == F.col("of")).withColumn("is_first", F.col("url").eqNullSafe(F.col("least.url")))
    again = counted.select("page_id", "url", "payload", "payload_digest", "first", "is_first", F.explode(F.expr("sequence(1L, n)")).alias("ordinal"))
    return plan(joined.where(~several), revisit).unionByName(plan(again, ~(F.col("is_first") & (F.col("ordinal") == 1))))


def write_archives(records: DataFrame, path: str, compress: bool = True) -> DataFrame:
    """Write planned records below ``path``; returns the manifest (file, records, bytes).

    Each task streams its rows into files of about ROLL_AT bytes under names of its own.
    A file counts only once the manifest, which Spark's committer writes, names it: files
    of lost or repeated tasks are never read.
    """
    spark = records.sparkSession

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        out, name, n, size = None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"part-{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                # What others refer to has an id that follows from its page; any other record has one of its own.
                own = "" if row["record_type"] == "response" and len(row["payload"]) >= MIN_REVISIT else f"<urn:uuid:{uuid.uuid4()}>"
                data = _record(row["page_id"], row["url"], row["payload"], row["payload_digest"], row["record_type"], row["refers_to"], own)
                if compress:
                    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = gz.compress(data) + gz.flush()
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ROLL_AT:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"file": name, "records": n, "bytes": size}], schema)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "records": n, "bytes": size}], schema)

    schema = pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
    records.mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{path}/_manifest")
    return spark.read.schema("file string, records long, bytes long").parquet(f"{path}/_manifest")


class _Source:
    """A window over a byte stream: ``data`` starts at offset ``at``."""

    def __init__(self, stream):
        self.stream, self.data, self.at, self.done = stream, bytearray(), 0, False

    def fill(self, size: int) -> bool:
        """Read on until ``size`` bytes are there; False if the stream ends before."""
        while len(self.data) < size and not self.done:
            more = self.stream.read(_CHUNK)
            self.done = not more
            self.data += more
        return len(self.data) >= size

    def ends(self, size: int) -> bool:
        """Whether a record of ``size`` bytes would end with its mark, looked up ahead where the stream can seek."""
        if len(self.data) >= size + 4 or self.done or not self.stream.seekable():
            return True
        back = self.stream.tell()
        try:
            self.stream.seek(self.at + size)
            mark = self.stream.read(4)
        finally:
            self.stream.seek(back)
        return bytes(mark) == b"\r\n\r\n"

    def skip(self, size: int) -> None:
        del self.data[:size]
        self.at += size


def _parse_head(head: bytes) -> dict[str, str]:
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return fields


def _checked(fields: dict[str, str], block: bytes) -> str | None:
    """What is wrong with a record, if anything."""
    claim = fields.get("warc-block-digest", "")
    if claim.startswith("sha1:") and claim[5:] != base64.b32encode(hashlib.sha1(block).digest()).decode():
        return "block digest differs"
    return None


def _plain_record(data: bytes | bytearray, source: _Source | None = None):
    """(fields, block, size) of the record at the start, or a reason. With ``source``, data is read as needed."""
    need = lambda n: source.fill(n) if source else len(data) >= n
    look = source.data if source else data
    need(10)
    if not _VERSION.match(look):
        return "no version line"
    end = look.find(b"\r\n\r\n", 0, MAX_RECORD)
    while end < 0 and source and not source.done and len(look) < MAX_RECORD:
        seen = len(look)
        source.fill(seen + 1)
        end = look.find(b"\r\n\r\n", max(0, seen - 3), MAX_RECORD)
    if end < 0:
        return "header has no end"
    fields = _parse_head(bytes(look[:end]))
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,12}", length) or int(length) > MAX_RECORD:
        return "bad Content-Length"
    size = end + 4 + int(length)
    # A damaged length must not make the reader take in what isn't a record.
    if source and not source.ends(size):
        return "record does not end where its length says"
    if not need(size + 4) and not need(size):
        return "record is cut off"
    block = bytes(look[end + 4 : size])
    if bytes(look[size : size + 4]) != b"\r\n\r\n":
        return "record does not end where its length says"
    return _checked(fields, block) or (fields, block, size + 4)


def _member_record(source: _Source):
    """(fields, block, compressed size) of the gzip member at the start, or a reason."""
    gz, out, used = zlib.decompressobj(31), bytearray(), 0
    try:
        while not gz.eof:
            if used >= len(source.data) and not source.fill(used + 1):
                return "member is cut off"
            piece = bytes(source.data[used : used + _CHUNK])
            out += gz.decompress(piece, max(0, MAX_RECORD - len(out)) or 1)
            used += len(piece) - len(gz.unconsumed_tail) - len(gz.unused_data)
            if len(out) > MAX_RECORD:
                return "record is too large"
    except zlib.error as e:
        return f"member: {e}"
    found = _plain_record(out)
    if isinstance(found, str):
        return found
    return (found[0], found[1], used) if found[2] == len(out) else "member holds more than a record"


def salvage(stream) -> Iterator[tuple]:
    """Records and gaps of an archive: ("record", offset, fields, block) or ("gap", offset, size, reason).

    Gzip members and plain records may be mixed. Where a record fails its checks (structure,
    length, checksum of the member, digest of the block), the search goes on from the next
    byte to the next member that inflates to a sound record or the next version line that
    starts one; what lies between is one quarantined gap. An empty archive gives nothing.
    """
    source, gap_at, reason = _Source(stream), None, ""
    while source.fill(1):
        source.fill(16)
        found = _member_record(source) if source.data.startswith(_MEMBER) else _plain_record(source.data, source) if source.data.startswith(b"WARC/") else "no record starts here"
        if isinstance(found, str):
            if gap_at is None:
                gap_at, reason = source.at, found
            source.skip(1)
            while True:
                at = [i for i in (source.data.find(_MEMBER), source.data.find(b"WARC/1.")) if i >= 0]
                if at:
                    source.skip(min(at))
                    break
                source.skip(max(0, len(source.data) - 7 * (not source.done)))
                if source.done or not source.fill(len(source.data) + 1):
                    source.skip(len(source.data))
                    break
            continue
        if gap_at is not None:
            yield "gap", gap_at, source.at - gap_at, reason
            gap_at = None
        yield "record", source.at, found[0], found[1]
        source.skip(found[2])
    if gap_at is not None:
        yield "gap", gap_at, source.at - gap_at, reason


def _payload(fields: dict[str, str], block: bytes) -> tuple[bytes, int]:
    """The payload in a record's block, and the length of the full payload."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, _, body = block.partition(b"\r\n\r\n")
    length = _parse_head(head).get("content-length", "")
    return body, int(length) if length.isdigit() else len(body)


_READ = "file string, offset long, kind string, gap_bytes long, reason string, page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def read_archives(files: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the ``files`` (file) below ``path``, one row each.

    kind is record or gap; a gap has gap_bytes and a reason, and the rest null. Files are read as
    streams, so that memory is bound by the largest record. The payload's digest is
    computed where the payload is there, and taken from the header of a revisit.
    """

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_file(f"{root}/{name}") as stream:
                    for kind, offset, a, b in salvage(stream):
                        row = {"file": name, "offset": offset, "kind": kind}
                        if kind == "gap":
                            row |= {"gap_bytes": a, "reason": b}
                        else:
                            body, size = _payload(a, b)
                            revisit = a.get("warc-type") == "revisit"
                            number = lambda k: int(a[k]) if a.get(k) else None
                            row |= {"page_id": number("x-page-id"), "url": a.get("warc-target-uri"), "record_type": a.get("warc-type"), "refers_to": number("x-refers-to-page-id")}
                            row |= {"payload_digest": a.get("warc-payload-digest", "").removeprefix("sha256:") if revisit else hashlib.sha256(body).hexdigest(), "payload_bytes": size, "payload": body if payloads else None}
                            held += len(body)
                        rows.append(row)
                        if held > 8 << 20 or len(rows) >= 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _READ.split(", ")])
    n = files.sparkSession.sparkContext.defaultParallelism
    return files.select("file").repartition(n).mapInArrow(run, _READ)


def op4_warc(pages: DataFrame) -> DataFrame:
    """Write the pages as archives in the shared folder, and read these back."""
    spark: SparkSession = pages.sparkSession
    path = new_path(spark, "warc")
    files = write_archives(plan_records(pages), path)
    back = written(read_archives(files, path, payloads=False).where("kind = 'record'"), "records")
    planned, found = files.agg(F.sum("records")).first()[0] or 0, back.count()
    if planned != found:
        raise RuntimeError(f"{planned} records were written to {path}, {found} could be read back")
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
with p as (select page_id, url, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
g as (select *, count(*) over (partition by html) as copies, min(page_id) over (partition by html) as first,
        row_number() over (partition by html order by page_id nulls last, url nulls first) as place from p),
r as (select *, n >= {MIN_REVISIT} and copies > 1 and first is not null and place > 1 as revisit from g)
select page_id, n::bigint as payload_bytes, sha256(html) as payload_digest,
  case when revisit then 'revisit' else 'response' end as record_type, case when revisit then first end as refers_to from r"""
