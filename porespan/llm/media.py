"""Media columns: members of archive directories, read by a Spark data source and decoded in Arrow batches.

*Store.* ``write_media`` stores payloads as 8-bit mono WAV files (a ``note`` chunk keeps the unpadded length), as
members of zip archives of bounded size; Spark commits the manifest of those that count.

*Source.* ``spark.read.format("media_archive")`` plans byte ranges of the archives, several to a partition where there are
more than ``PARTITIONS``; a range owns the members
whose header starts in it, found in the archive's directory. Members stream out in Arrow batches of bounded
bytes. Each is read by its own offset and tried again on its own; one that stays broken becomes a row
with its error, and the others go on. ``media_features(strict=True)`` makes such a row fail its task, which Spark runs again.

Cases: a null payload is empty; payloads are padded with spaces to a positive multiple of ``UNIT``; a null id is
stored apart from any string; repeated rows are members of their own; an empty table writes no archive and reads as no
rows.
"""

from __future__ import annotations

import hashlib
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from porespan.llm.archives import filesystem, new_file
from porespan.llm.memory import frugal
from porespan.session import scratch_path

UNIT, RATE = 192, 8000
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 4 << 20
#: Partitions of a read at most, and how member names begin: with an id, or for a null one.
PARTITIONS, WITH_ID, NULL_ID = 20_000, "id=", "null"
MEMBERS = pa.schema([("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
FEATURES = "member string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


# ---------------------------------------------------------------- WAV


def padded(data: bytes) -> bytes:
    return data + b" " * (-len(data) % UNIT if data else UNIT)


def wav(payload: bytes, n_bytes: int) -> bytes:
    """8-bit mono samples; ``n_bytes`` of them are payload, the rest padding."""
    note = struct.pack("<4sIQ", b"note", 8, n_bytes)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * (len(payload) % 2)
    body = b"WAVE" + form + note + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def wav_samples(media: bytes) -> tuple[bytes, int]:
    """(samples, unpadded length) of a WAV file of 8-bit mono samples."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, chunks = 12, {}
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if at + 8 + size > len(media):
            raise ValueError("truncated WAV file")
        chunks[name] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if b"data" not in chunks or struct.unpack_from("<HHIIHH", chunks.get(b"fmt ", b"\0" * 16))[::5] != (1, 8):
        raise ValueError("not 8-bit samples")
    return chunks[b"data"], struct.unpack("<Q", chunks[b"note"])[0] if b"note" in chunks else len(chunks[b"data"])


def sample_features(samples: bytes) -> str:
    """Sum, energy and sign changes about the middle, and counts in eight equal ranges, of all samples."""
    x = np.frombuffer(samples, np.uint8)
    centred = x.astype(np.int64) - 128
    above = x >= 128
    bins = np.bincount(x >> 5, minlength=8)
    return f"sum={centred.sum()};energy={(centred * centred).sum()};crossings={int((above[1:] != above[:-1]).sum())};ranges={','.join(map(str, bins))}"


# ---------------------------------------------------------------- store


def write_media(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE_BYTES) -> str:
    """Stores each text's UTF-8 bytes as a member; returns the path of the manifest ``(path, members, bytes)``."""
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = z = name = None

        def closed() -> pa.RecordBatch:
            n = len(z.infolist())
            z.close()
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [name], "members": [n], "bytes": [size]})

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if z is None:
                    name = new_file(folder, ".zip")
                    fs, path = filesystem(name)
                    out = fs.open_output_stream(path, compression=None)
                    z = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                data = (text or "").encode()
                z.writestr(zipfile.ZipInfo(NULL_ID if key is None else f"{WITH_ID}{key}"), wav(padded(data), len(data)), zipfile.ZIP_DEFLATED, 1)
                if out.tell() >= archive_bytes:
                    yield closed()
                    z = None
        if z is not None:
            yield closed()

    manifest = scratch_path(docs.sparkSession, "media-manifest")
    docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(frugal(run), "path string, members long, bytes long").write.parquet(manifest)
    return manifest


# ---------------------------------------------------------------- source


class Ranges(InputPartition):
    """Byte ranges (path, start, stop) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["path"]
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batch_bytes", BATCH_BYTES))
        self.most = int(options.get("partitions", PARTITIONS))
        self.retries, self.pause = int(options.get("retries", 3)), float(options.get("pause", 0.2))

    def partitions(self) -> list[Ranges]:
        fs, path = filesystem(self.manifest)
        found = pq.read_table(path, columns=["path", "bytes"], filesystem=fs)
        step = max(self.range_bytes, -(-sum(found["bytes"].to_pylist()) // self.most))
        out, room = [Ranges([])], step
        for name, size in zip(found["path"].to_pylist(), found["bytes"].to_pylist(), strict=True):
            for at in range(0, size, step):
                take = min(step, size - at)
                if take > room and out[-1].ranges:
                    out.append(Ranges([]))
                    room = step
                out[-1].ranges.append((name, at, at + take))
                room -= take
        return out

    def _member(self, path: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """The bytes of one member, read at its offset through a handle of its own on every further try."""
        error = None
        for attempt in range(self.retries):
            try:
                if attempt == 0:
                    return archive.read(info), None
                fs, name = filesystem(path)
                with fs.open_input_file(name) as f, zipfile.ZipFile(f) as z:
                    return z.read(info), None
            except (OSError, zipfile.BadZipFile, zlib.error, EOFError) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(self.pause * attempt)
        return None, error

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for name, start, stop in partition.ranges:
            fs, path = filesystem(name)
            with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                for info in archive.infolist():
                    if not start <= info.header_offset < stop:
                        continue
                    media, error = self._member(name, archive, info)
                    rows.append({"member": info.filename, "offset": info.header_offset, "media": media, "error": error})
                    held += len(media or b"")
                    if held >= self.batch_bytes:
                        yield pa.RecordBatch.from_pylist(rows, schema=MEMBERS)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=MEMBERS)


class MediaArchives(DataSource):
    """``spark.read.format("media_archive").load(manifest)``; options range_bytes, batch_bytes, partitions, retries, pause."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, offset bigint, media binary, error string"

    def reader(self, schema) -> MediaReader:
        return MediaReader(self.options)


def read_media(spark, manifest: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archive").options(**{k: str(v) for k, v in options.items()}).load(manifest)


def member_features(members: DataFrame) -> DataFrame:
    """Decoded payloads' figures, a row for each member; ``error`` says why there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            rows = []
            for member, media, error in zip(batch["member"].to_pylist(), batch["media"].to_pylist(), batch["error"].to_pylist(), strict=True):
                row = dict.fromkeys(names) | {"member": member, "error": error}
                if media is not None:
                    try:
                        samples, n = wav_samples(media)
                        row |= {
                            "n_bytes": n, "payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-16:]),
                            "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": sample_features(samples),
                        }
                    except (ValueError, struct.error) as e:
                        row["error"] = str(e)
                rows.append(row)
            kinds = {"long": pa.int64(), "string": pa.string()}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, kinds[k]) for n, k in (x.split() for x in FEATURES.split(", "))]))

    return members.select("member", "media", "error").mapInArrow(frugal(run), FEATURES)


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, strict: bool = False) -> DataFrame:
    """Stores all texts, reads the archives back and returns ``doc_id`` with the members' figures.

    ``strict``: a member that can't be read or decoded is an error; else its row says why it has no figures.
    """
    spark = docs.sparkSession
    manifest = write_media(docs, folder or scratch_path(spark, "media"), id_col, text_col)
    found = member_features(read_media(spark, manifest))
    if strict:
        why = F.concat(F.lit("a media member doesn't read back: "), F.col("member"), F.lit(", "), F.col("error"))
        found = found.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(why).cast("boolean")))
    key = F.when(F.col("member").startswith(WITH_ID), F.expr(f"substring(member, {len(WITH_ID) + 1})")).cast(docs.schema[id_col].dataType)
    return found.select(key.alias("doc_id"), *[c for c in found.columns if c != "member"])
