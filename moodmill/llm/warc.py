"""WARC archives: writing, normalising to one gzip member per record, reading by index.

Archives travel as rows (archive, seq, data) of a stored table, so that Spark's own
committer guards them against lost executors; ``read_files`` takes archives from a folder
and ``write_files`` puts normalised ones into a folder that all executors share.
"""

from __future__ import annotations

import gzip
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from moodmill.runtime import materialize

#: Payloads below this size are stored again, never revisited.
REVISIT_BYTES = 1000
#: An archive is closed after so many bytes before compression.
ARCHIVE_BYTES = 32 << 20
#: Bytes inflated at a time.
PART_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIXED_DATE = "1970-01-01T00:00:00Z"

ARCHIVE = "archive string, seq long, data binary"
MEMBERS = (
    "archive string, offset long, length long, record_id string, record_type string, "
    "member binary"
)
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long"
)


def plan_records(pages: DataFrame) -> DataFrame:
    """Choose the response of every group of equal payloads; the others revisit it.

    A null html is an empty payload and a null url an empty one. Among equal rows of the
    largest page_id all are responses.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    large = F.octet_length("payload") >= REVISIT_BYTES
    repeated = (
        rows.where(large)
        .groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
        .where("n > 1")
        .drop("n")
    )
    joined = rows.withColumn("key", F.when(large, F.col("digest"))).join(
        repeated.withColumnRenamed("digest", "key"), "key", "left"
    )
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select(
        "page_id",
        "url",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.lower(F.hex("digest")).alias("digest"),
        F.when(revisit, F.col("kept")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def _name(page_id: int | None) -> str:
    return f"urn:page:{'' if page_id is None else page_id}"


def _page(name: str) -> int | None:
    number = name.strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def record(page_id, url, n_bytes, digest, refers_to, payload) -> bytes:
    """One WARC/1.1 record; a url is one line, so its control characters are quoted."""
    body = b"" if payload is None else bytes(payload)
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_name(page_id)}>",
        f"WARC-Date: {FIXED_DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        lines[2:2] = [f"WARC-Refers-To: <{_name(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of one gzip stream each, as stored rows (archive, seq, data), one per archive."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, held, packer = TaskContext.get().partitionId(), 0, 0, None
        ready: list[bytes] = []

        def closed() -> pd.DataFrame:
            name = f"{part:06d}-{number:06d}.warc.gz"
            data = b"".join([*ready, packer.flush()])
            return pd.DataFrame({"archive": [name], "seq": [0], "data": [data]})

        for batch in batches:
            ids = batch["page_id"].astype("Int64").astype(object).where(batch["page_id"].notna(), None)
            refers = batch["refers_to"].astype("Int64").astype(object)
            refers = refers.where(batch["refers_to"].notna(), None)
            for row in zip(
                ids, batch["url"], batch["payload_bytes"], batch["digest"], refers,
                batch["payload"], strict=True,
            ):
                packer = packer or zlib.compressobj(wbits=31)
                data = record(*row)
                held += len(data)
                ready.append(packer.compress(data))
                if held >= archive_bytes:
                    yield closed()
                    ready, packer, held = [], None, 0
                    number += 1
        if packer:
            yield closed()

    return materialize(records.mapInPandas(write, ARCHIVE), "archives")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Archives of any writer below ``folder``, as rows (archive, seq, data)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select(
            F.col("path").alias("archive"), F.lit(0).cast("long").alias("seq"),
            F.col("content").alias("data"),
        )
    )


class RecordSplitter:
    """Cuts an inflated stream into records by their Content-Length."""

    def __init__(self) -> None:
        self.buffer = bytearray()

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.buffer += data
        while True:
            while self.buffer[:1] in (b"\r", b"\n"):
                del self.buffer[:1]
            end = self.buffer.find(b"\r\n\r\n")
            if end < 0:
                return
            headers = parse_headers(bytes(self.buffer[:end]))
            whole = end + 4 + int(headers["content-length"]) + 4
            if len(self.buffer) < whole:
                return
            yield headers, bytes(self.buffer[:whole])
            del self.buffer[:whole]

    def close(self) -> None:
        if self.buffer:
            raise ValueError("the archive ends inside a record")


def parse_headers(head: bytes) -> dict[str, str]:
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def normalise(archives: DataFrame, in_parts: bool = False) -> DataFrame:
    """Every record as a gzip member of its own, at its offset in the rewritten archive.

    Each archive is streamed once, piece by piece, by the one task that has it; memory
    holds one record. ``in_parts``: an archive has several rows, to be brought together in
    the order of seq; else each row is an archive and nothing is shuffled. One that breaks off inside a record is an error. Rows:
    archive, offset, length, record_id, record_type, member; without ``member`` they are
    the sidecar index.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def streams():
            archive = None
            for batch in batches:
                for name, data in zip(batch["archive"], batch["data"], strict=True):
                    if name != archive and archive is not None:
                        yield archive, None
                    archive = name
                    yield archive, bytes(data)
            if archive is not None:
                yield archive, None

        out: list[tuple] = []
        held = 0
        unpacker, splitter, offset = zlib.decompressobj(wbits=31), RecordSplitter(), 0
        for archive, data in streams():
            if data is None:
                splitter.close()
                unpacker, splitter, offset = zlib.decompressobj(wbits=31), RecordSplitter(), 0
                continue
            while data:
                plain = unpacker.decompress(data, PART_BYTES)
                data = unpacker.unconsumed_tail
                if unpacker.eof:
                    data = unpacker.unused_data
                    unpacker = zlib.decompressobj(wbits=31)
                for headers, raw in splitter.feed(plain):
                    member = gzip.compress(raw, mtime=0)
                    out.append(
                        (
                            archive, offset, len(member),
                            headers.get("warc-record-id", "").strip("<>"),
                            headers.get("warc-type", ""), member,
                        )
                    )
                    offset += len(member)
                    held += len(member)
                if held >= 4 * PART_BYTES:
                    yield _frame(out, MEMBERS)
                    out, held = [], 0
        yield _frame(out, MEMBERS)

    if in_parts:
        archives = archives.repartition("archive").sortWithinPartitions("archive", "seq")
    return materialize(archives.mapInPandas(rewrite, MEMBERS), "members")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def sidecar(members: DataFrame) -> DataFrame:
    return members.drop("member")


def write_files(members: DataFrame, folder: str) -> DataFrame:
    """Rewritten archives and their indexes as files in a folder that all executors share.

    A file is written under another name and renamed, so a repeated task replaces it whole.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = []
        current, archive, spare, index = None, None, None, []

        def close() -> None:
            current.close()
            target = os.path.join(folder, os.path.basename(archive))
            os.replace(spare, target)
            with open(f"{spare}.idx", "w", encoding="utf-8") as file:
                file.writelines(f"{line}\n" for line in index)
            os.replace(f"{spare}.idx", f"{target}.idx")
            done.append((archive, target, len(index)))

        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.archive != archive:
                    if current:
                        close()
                    archive, index = row.archive, []
                    spare = os.path.join(folder, f".{uuid.uuid4().hex}")
                    current = open(spare, "wb")  # noqa: SIM115
                current.write(row.member)
                index.append(f"{row.record_id}\t{row.record_type}\t{row.offset}\t{row.length}")
        if current:
            close()
        yield _frame(done, "archive string, path string, records long")

    ordered = members.repartition("archive").sortWithinPartitions("archive", "offset")
    return ordered.mapInPandas(write, "archive string, path string, records long")


def read_records(members: DataFrame) -> DataFrame:
    """Each member read alone: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The digest and size of a response come from its payload and must agree with its
    headers; those of a revisit are the ones it carries.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for length, member in zip(batch["length"], batch["member"], strict=True):
                if len(member) != length:
                    raise ValueError("the index and the member differ in length")
                raw = gzip.decompress(member)
                head, _, rest = raw.partition(b"\r\n\r\n")
                headers = parse_headers(head)
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                size, refers = int(headers["x-payload-length"]), headers.get("warc-refers-to")
                if headers["warc-type"] == "response":
                    payload = rest[: int(headers["content-length"])]
                    if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
                        raise ValueError(f"damaged record {headers['warc-record-id']}")
                out.append(
                    (
                        _page(headers["warc-record-id"]), size, digest, headers["warc-type"],
                        _page(refers) if refers else None,
                    )
                )
            frame = _frame(out, RECORDS)
            yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    return members.mapInPandas(read, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write, normalise and read back ``pages``: one row per page; an empty table gives none."""
    return read_records(normalise(write_archives(plan_records(pages))))
