"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files.

*Writing.* Of rows with equal payloads of at least ``min_revisit_bytes`` the one with the least id becomes a
``response``, the others ``revisit`` records that name it. Digests and ids decide this in a grouped minimum
before any payload moves. Every task writes archives of bounded size, one gzip member a record, and the
manifest (a table that Spark commits) names those that count, so failed attempts leave nothing behind.

*Reading.* Archives are planned as byte ranges. A range owns the records that start in it, and the bytes up to
the first valid record after it. Ranges of plain files begin where a pass over the headers alone finds records. A record
counts if its member inflates with a right checksum, the version
line and headers parse, the length fits and the payload has the stated digest. If not, the reader searches
for the next valid member (or, in plain files, version line), goes on there, and returns the bytes between
as a quarantined gap with a reason. Records pass in portions, so neither they nor their headers have a greatest length.
A revisit states what its response holds; ``resolve_revisits`` takes that from the response itself, if it was read.

Cases: a null payload is empty; a null id is written without one and refers to the response if there is one;
rows that repeat the least id are all responses; an empty table writes no archive; a payload beyond ``MOST_PAYLOAD``, which no
value of a table can hold, is null with a reason, its digest and length are given.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porespan.llm.archives import Bytes, filesystem, new_file
from porespan.llm.memory import frugal
from porespan.session import materialize

ARCHIVE_BYTES, RANGE_BYTES = 64 << 20, 16 << 20
#: Bytes of a portion of a record, tasks that read ranges at most, and bytes that a binary value can have.
PORTION, TASKS, MOST_PAYLOAD = 1 << 18, 20_000, (1 << 31) - (1 << 16)
DATE = "2024-01-01T00:00:00Z"
MAGIC, VERSION, BLANK = b"\x1f\x8b\x08", b"WARC/1.", b"\r\n\r\n"
FOUND = "path string, start long, stop long, kind string, reason string, record_type string, page_id long, uri string, payload_digest string, payload_bytes long, refers_to long"


# ---------------------------------------------------------------- writing


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, uri: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One record; ``digest`` is bare base32, ``first`` the id of the response that a revisit repeats."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def write_warc(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """Writes ``pages`` as archives below ``folder``; returns the manifest ``(path, records, bytes)``."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.encode(F.col(body_col), "UTF-8"), F.lit(b"")).alias("body"))
    rows = rows.withColumn("digest", F.sha1("body"))
    known = materialize(rows.select("id", "digest", F.octet_length("body").alias("n")), "digests").where(F.col("n") >= min_revisit_bytes)
    first = materialize(known.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("k")).where("k > 1").select("digest", "first"), "first")
    repeats = materialize(known.join(first, "digest").where("not (id <=> first)").select("id", "digest", "first").distinct(), "repeats")
    rows = rows.alias("r").join(repeats.alias("s"), F.expr("r.id <=> s.id and r.digest = s.digest"), "left").select("r.id", "r.url", "r.body", "r.digest", "s.first")
    filesystem(folder)[0].create_dir(filesystem(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        records = size = 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [records], "bytes": [size]})

        for batch in batches:
            for page_id, url, body, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    path, records, size = new_file(folder, ".warc.gz"), 0, 0
                    fs, name = filesystem(path)
                    out = fs.open_output_stream(name, compression=None)
                member = _gzip(record_bytes(page_id, url, body, base64.b32encode(bytes.fromhex(digest)).decode(), first))
                out.write(member)
                records, size = records + 1, size + len(member)
                if size >= archive_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    assert isinstance(spark, SparkSession)
    return materialize(rows.mapInArrow(frugal(run), "path string, records long, bytes long"), "manifest")


# ---------------------------------------------------------------- reading


class Broken(Exception):
    """Why bytes don't hold a valid record."""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise Broken("no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("bad header")
        fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise Broken("length differs")
    return fields


def parse_record(portion: Callable[[], bytes], hold: bool, alone: bool) -> tuple[dict, int]:
    """The fields of the record that ``portion`` gives piece by piece (nothing at the end), and its length.

    ``hold`` keeps the payload; ``alone``: nothing may follow the record. Raises ``Broken``.
    """
    held, taken = bytearray(), 0

    def more() -> bool:
        piece = portion()
        held.extend(piece)
        return bool(piece)

    while len(held) < len(VERSION) and more():
        pass
    if not held.startswith(VERSION):
        raise Broken("no version line")
    searched = 0
    while (cut := held.find(BLANK, max(0, searched - 3))) < 0:
        searched = len(held)
        if not more():
            raise Broken("bad header")
    fields = _fields(bytes(held[:cut]))
    del held[: cut + 4]
    left = int(fields["content-length"])
    taken = cut + 4 + left + 4
    sha, size, kept, searched = hashlib.sha1(), 0, [], 0
    front = bytearray() if fields.get("content-type", "").startswith("application/http") else None
    while left:
        if not held and not more():
            raise Broken("length differs")
        piece = bytes(held[:left])
        del held[: len(piece)]
        left -= len(piece)
        if front is not None:  # still in the HTTP headers
            front.extend(piece)
            cut = front.find(BLANK, max(0, searched - 3))
            searched = len(front)
            if cut < 0:
                continue
            piece, front = bytes(front[cut + 4 :]), None
        sha.update(piece)
        size += len(piece)
        if hold and size <= MOST_PAYLOAD:
            kept.append(piece)
    while len(held) < (5 if alone else 4) and more():
        pass
    if held[:4] != BLANK or (alone and len(held) > 4):
        raise Broken("length differs")
    kind, stated = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind != "revisit":
        own = base64.b32encode(sha.digest()).decode()
        if stated and stated != own:
            raise Broken("payload digest differs")
        stated = own
    number = lambda x: int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None
    whole = hold and kind != "revisit" and size <= MOST_PAYLOAD
    return {
        "kind": "record", "reason": "payload beyond a value's length" if hold and size > MOST_PAYLOAD else None, "record_type": kind, "page_id": number(fields.get("x-page-id")), "uri": fields.get("warc-target-uri"),
        "payload_digest": stated or None, "payload_bytes": number(fields.get("x-payload-length")) if kind == "revisit" else size, "refers_to": number(fields.get("x-refers-to-page-id")), "payload": b"".join(kept) if whole else None,
    }, taken


class Member:
    """The content of the gzip member at ``at``, in portions; ``pos`` is its end once all is read."""

    def __init__(self, src: Bytes, at: int):
        self.src, self.pos, self.inflate, self.block = src, at, zlib.decompressobj(31), b""

    def __call__(self) -> bytes:
        while not self.inflate.eof:
            self.block = self.block or self.src.get(self.pos, PORTION)
            if not self.block:
                raise Broken("truncated member")
            try:
                out = self.inflate.decompress(self.block, PORTION)
            except zlib.error as e:
                raise Broken("bad member") from e
            rest = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.pos += len(self.block) - len(rest)
            self.block = b"" if self.inflate.eof else rest
            if out:
                return out
        return b""


def _next_member(src: Bytes, at: int, stop: int) -> int:
    """The first position from ``at`` on, before ``stop``, of a member whose content starts with a version line; else -1."""
    while 0 <= (at := src.find(MAGIC, at)) < stop:
        try:
            content, first = Member(src, at), b""
            while len(first) < len(VERSION) and (piece := content()):
                first += piece
            if first.startswith(VERSION):
                return at
        except Broken:
            pass
        at += 1
    return -1


def _members(src: Bytes, start: int, stop: int, hold: bool) -> Iterator[dict]:
    """Records and gaps that the range owns in a file of gzip members."""
    at = 0 if start == 0 else _next_member(src, start, stop)
    if at < 0:
        return
    while at < min(stop, src.size):
        try:
            content = Member(src, at)
            found, _ = parse_record(content, hold, True)
            yield {"start": at, "stop": content.pos} | found
            at = content.pos
            if at < stop or at >= src.size or _next_member(src, at, at + 1) == at:
                continue
            broken, reason = at, "no member"
        except Broken as e:
            broken, reason = at, str(e)
        at = _next_member(src, broken + 1, src.size)
        yield {"start": broken, "stop": at if at >= 0 else src.size, "kind": "gap", "reason": reason}
        if at < 0:
            return


_FIELD = re.compile(rb"[!-~]+:[^\r\n]*")


def _head_end(src: Bytes, at: int) -> tuple[int, int]:
    """(end of the headers at ``at``, content length); (-1, 0) if no version line and headers with a length are there."""
    if not re.fullmatch(rb"WARC/1\.\d\r\n", src.get(at, 10)):
        return -1, 0
    pos, length = at + 10, -1
    while (end := src.find(b"\r\n", pos)) >= 0:
        if end == pos:
            return (end + 2, length) if length >= 0 else (-1, 0)
        line = src.get(pos, end - pos)
        if not _FIELD.fullmatch(line):
            return -1, 0
        name, _, value = line.partition(b":")
        if name.lower() == b"content-length" and value.strip().isdigit():
            length = int(value)
        pos = end + 2
    return -1, 0


def _next_version(src: Bytes, at: int, stop: int) -> int:
    """The first position from ``at`` on of a version line with headers that state a length; else ``stop``."""
    while 0 <= (at := src.find(VERSION, at)) < stop:
        if _head_end(src, at)[0] >= 0:
            return at
        at += 1
    return stop


def _plain_starts(src: Bytes, step: int) -> Iterator[int]:
    """Positions of records, ``step`` or more apart, by headers alone."""
    at = last = 0
    yield 0
    while at < src.size:
        close, length = _head_end(src, at)
        after = close + length + 4
        at = after if 0 <= close and after <= src.size else _next_version(src, at + 1, src.size)
        if at - last >= step and at < src.size:
            last = at
            yield at


def _plain(src: Bytes, start: int, stop: int, hold: bool) -> Iterator[dict]:
    """Records and gaps of a range of an uncompressed file; version lines inside payloads don't start records there."""
    at = start
    while at < stop:
        try:
            pos = at

            def portion() -> bytes:
                nonlocal pos
                piece = src.get(pos, min(PORTION, stop - pos))
                pos += len(piece)
                return piece

            found, taken = parse_record(portion, hold, False)
            yield {"start": at, "stop": at + taken} | found
            at += taken
        except Broken as e:
            after = _next_version(src, at + 1, stop)
            yield {"start": at, "stop": after, "kind": "gap", "reason": str(e)}
            at = after


def _plain_ranges(files: DataFrame, range_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, size in zip(b["path"].to_pylist(), b["bytes"].to_pylist(), strict=True):
                src = Bytes(path, window=1 << 16)
                starts = [*_plain_starts(src, range_bytes), size]
                src.close()
                yield pa.RecordBatch.from_pydict({"path": [path] * (len(starts) - 1), "start": starts[:-1], "stop": starts[1:]})

    return files.repartition("path").mapInArrow(frugal(run), "path string, start long, stop long")


def read_warc(manifest: DataFrame, with_payload: bool = True, range_bytes: int = RANGE_BYTES, tasks: int = TASKS) -> DataFrame:
    """Records (``kind`` 'record') and quarantined byte gaps ('gap') of the archives in ``manifest (path, bytes)``.

    Paths that end in ``.gz`` are files of gzip members and are cut into byte ranges, others are plain files. At most ``tasks``
    tasks read the ranges.
    """
    names = [x.split()[0] for x in FOUND.split(", ")] + (["payload"] if with_payload else [])
    schema = FOUND + (", payload binary" if with_payload else "")
    files = manifest.where("bytes > 0").select("path", "bytes")
    step = F.lit(range_bytes).cast("long")
    zipped = files.where(F.col("path").endswith(".gz")).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step))).select("path", "start", (F.col("start") + step).alias("stop"))
    ranges = zipped.unionByName(_plain_ranges(files.where(~F.col("path").endswith(".gz")), range_bytes))
    ranges = materialize(ranges, "ranges")
    ranges = ranges.repartition(min(tasks, max(1, ranges.count())), "path", "start")
    out = pa.schema([pa.field(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in schema.split(", "))])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, stop in zip(*(c.to_pylist() for c in b.columns), strict=True):
                src = Bytes(path)
                rows, held = [], 0
                read = _members if path.endswith(".gz") else _plain
                for r in read(src, start, stop, with_payload):
                    size = len(r.get("payload") or b"") if with_payload else 0
                    if rows and held + size > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                    rows.append(r | {"path": path})
                    held += size
                    if len(rows) >= 1000:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)
                src.close()

    return ranges.mapInArrow(frugal(run), schema)


def resolve_revisits(found: DataFrame) -> DataFrame:
    """``found`` with ``resolved``: whether a revisit's response was read, with the digest that the revisit states.

    A resolved revisit takes its payload's length from the response; other records are resolved by themselves. ``found`` is
    read three times, so write it first.
    """
    known = found.where("kind = 'record' and record_type = 'response'").groupBy(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    revisit = F.coalesce((F.col("kind") == "record") & (F.col("record_type") == "revisit"), F.lit(False))
    others = found.where(~revisit).withColumn("resolved", F.col("kind") == "record")
    again = found.where(revisit).join(known, (F.col("refers_to") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    again = again.withColumns({"payload_bytes": F.col("__bytes"), "resolved": F.col("__id").isNotNull()}).drop("__id", "__digest", "__bytes")
    return others.unionByName(again)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest ``(path, bytes)`` of all files below ``folder``, listed by Spark; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc*").load(folder)
    return found.select("path", F.col("length").alias("bytes"))
