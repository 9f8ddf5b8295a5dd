"""WARC records in ZIP packages: written by tasks, read back by byte ranges without unpacking."""

from __future__ import annotations

import base64
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, tasks_for, written

#: Where a package has its archives and indexes, and the names of the two stored members that are written.
ARCHIVES, INDEXES = "archive/", "indexes/"
ARCHIVE, INDEX = f"{ARCHIVES}data.warc.gz", f"{INDEXES}index.cdxj"
#: What is read of a record.
RECORD = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload", "record_id", "url", "refers_to_id"]
#: Shorter payloads are never revisits.
LEAST_REVISIT = 100
#: Bytes of neighbouring records that one range read covers, unless a record is longer.
RANGE = 4 << 20
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


# ---- ZIP packages, read by ranges


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    packed: int
    header: int
    encrypted: bool = False


def _range(f, start: int, n: int) -> bytes:
    f.seek(start)
    out = f.read(n)
    if len(out) != n:
        raise ValueError(f"package ends at {start + len(out)}, before {start + n}")
    return out


def _is_end(f, tail: bytes, at: int, tail_at: int) -> bool:
    """Whether the end record at that place of the tail has a comment that ends with the file, and a directory where it says."""
    if at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        return False
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
        return True
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if not count:
        return length == 0 and start == tail_at + at
    return start + length <= tail_at + at and length >= 46 and _range(f, start, 4) == _CENTRAL or 0xFFFFFFFF in (length, start)


def directory(f, size: int) -> dict[str, Member]:
    """The central directory of a ZIP of `size` bytes, ZIP64 included, from reads at its end only."""
    tail_at = max(0, size - 65_557)
    tail = _range(f, tail_at, size - tail_at)
    at = tail.rfind(_EOCD)
    while at >= 0 and not _is_end(f, tail, at, tail_at):  # the signature may stand in the comment too
        at = tail.rfind(_EOCD, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR:
        (end64,) = struct.unpack_from("<Q", tail, at - 20 + 8)
        record = _range(f, end64, 56)
        if record[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, length, start = struct.unpack_from("<QQQ", record, 32)
    elif 0xFFFFFFFF in (length, start):
        raise ValueError("no ZIP64 locator")
    raw, p, out = _range(f, start, length), 0, {}
    for _ in range(count):
        if raw[p : p + 4] != _CENTRAL:
            raise ValueError(f"no directory entry at {start + p}")
        flags, method = struct.unpack_from("<HH", raw, p + 8)
        packed, full, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", raw, p + 20)
        (header,) = struct.unpack_from("<I", raw, p + 42)
        name = raw[p + 46 : p + 46 + n_name].decode("utf-8" if flags & 0x800 else "cp437")
        extra, q = raw[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while q + 4 <= len(extra):
            tag, n = struct.unpack_from("<HH", extra, q)
            if tag == 1:
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, q + 4))
                full = next(wide) if full == 0xFFFFFFFF else full
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            q += 4 + n
        out[name] = Member(name, method, full, packed, header, bool(flags & 1))
        p += 46 + n_name + n_extra + n_comment
    return out


def data_start(f, member: Member) -> int:
    """Where a member's bytes begin, behind its local header."""
    if member.encrypted:
        raise ValueError(f"{member.name} is encrypted")
    if member.method != zipfile.ZIP_STORED:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by ranges")
    head = _range(f, member.header, 30)
    if head[:4] != _LOCAL:
        raise ValueError(f"no local header at {member.header}")
    return member.header + 30 + sum(struct.unpack_from("<HH", head, 26))


# ---- WARC records


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzipped WARC record. A revisit has the response's headers but not its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (b"" if kind == "revisit" else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + made.flush()


class Headers(dict):
    """Header lines by name, in whatever case the name is asked for."""

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default: str | None = None) -> str | None:
        return super().get(name.lower(), default)


def _fields(head: bytes) -> Headers:
    """The lines behind the first; of repeated names the first counts, lines without a colon are none."""
    out = Headers()
    for line in head.decode("utf-8", "surrogatepass" if _is_text(head) else "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())  # names are kept in lower case
    return out


def _is_text(data: bytes) -> bool:
    try:
        data.decode("utf-8", "surrogatepass")
    except UnicodeDecodeError:
        return False
    return True


def unchunked(body: bytes) -> bytes:
    """An HTTP body without its chunks' lengths; one that ends within a chunk as far as it goes."""
    out, at = [], 0
    while (stop := body.find(b"\r\n", at)) >= 0:
        size = int(body[at:stop].partition(b";")[0].strip() or b"0", 16)
        if not size:
            break
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 4 + size
    return b"".join(out)


def parse(raw: bytes) -> dict:
    """A record, gzipped or not: its headers (`fields`), its payload (none in a revisit), and the length that it says its payload has.

    The payload is what follows the HTTP headers where the record is of HTTP, chunks put together, and else its whole block. The length is None
    where a revisit doesn't tell it.
    """
    whole = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    head, _, rest = whole.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("a record does not begin with its version")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    kind = fields["warc-type"]
    if not fields.get("content-type", "").startswith("application/http"):
        return {"fields": fields, "length": len(block) if kind != "revisit" else None, "payload": block if kind != "revisit" else None}
    top, _, payload = block.partition(b"\r\n\r\n")
    http = _fields(top)
    if "chunked" in http.get("transfer-encoding", "").lower():
        payload, said = unchunked(payload), None
    else:
        said = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    if kind == "revisit":
        return {"fields": fields, "length": said, "payload": None}
    return {"fields": fields, "length": len(payload) if said is None else said, "payload": payload}


def digest_of(fields: Headers, payload: bytes | None) -> str | None:
    """The payload's SHA-256, after a check against the digest that the record states; of a revisit what it states, without the name of SHA-256.

    Stated digests are in base 16 or 32; those of a hash that is not known here, and of payloads that were cut off, are not checked.
    """
    name, _, stated = fields.get("warc-payload-digest", "").partition(":")
    if payload is None:
        return stated.lower() if name == "sha256" and len(stated) == 64 else fields.get("warc-payload-digest")
    own = hashlib.sha256(payload).digest()
    if stated and name.replace("-", "") in ("sha256", "sha1", "sha512", "md5") and "warc-truncated" not in fields:
        found = own if name.replace("-", "") == "sha256" else hashlib.new(name.replace("-", ""), payload).digest()
        if stated.lower() not in (found.hex(), base64.b32encode(found).decode().lower(), base64.b32encode(found).decode().rstrip("=").lower()):
            raise ValueError("it does not match its digest")
    return own.hex()


def _page(urn: str | None) -> int | None:
    """The page_id that a record's id was made of; of ids made elsewhere none."""
    value = (urn or "").strip("<>").removeprefix("urn:page:")
    return int(value) if value.lstrip("-").isdigit() else None


def index_line(url: str | None, digest: str, offset: int, length: int) -> str:
    """A record's line in the index: the URL with its host reversed, the time, and where the record is."""
    plain = " ".join((url or "").split())
    host, slash, path = plain.partition("://")[2].partition("/")
    key = ",".join(reversed(host.lower().split("."))) + ")/" + path.lower() if host else plain.lower()
    fields = {"url": plain, "digest": f"sha256:{digest}", "length": str(length), "offset": str(offset), "filename": ARCHIVE[len(ARCHIVES) :]}
    return f"{key.replace(' ', '%20') or '-'} 19700101000000 {json.dumps(fields)}"


def gzip_ends(f, start: int, size: int, step: int = 1 << 20) -> Iterator[int]:
    """Lengths of the gzip members that follow each other in a stretch of a file, read bit by bit."""
    made, length, at, rest = zlib.decompressobj(31), 0, start, b""
    while at < start + size or rest:
        if not rest:
            rest = _range(f, at, min(step, start + size - at))
            at += len(rest)
        made.decompress(rest)
        length += len(rest) - len(made.unused_data)
        rest = made.unused_data
        if made.eof:
            yield length
            made, length = zlib.decompressobj(31), 0
    if length:
        raise ValueError("an archive ends within a record")


def plain_ends(f, start: int, size: int) -> Iterator[int]:
    """Lengths of the records of an archive that is not compressed, by the lengths that they state."""
    at = start
    while at < start + size:
        head, step = b"", 4096
        while b"\r\n\r\n" not in head:
            if at + len(head) >= start + size or len(head) > 1 << 24:
                raise ValueError("an archive ends within a record")
            head += _range(f, at + len(head), min(step, start + size - at - len(head)))
        top = head.partition(b"\r\n\r\n")[0]
        length = len(top) + 4 + int(_fields(top)["content-length"])
        end = _range(f, at + length, min(4, start + size - at - length))
        length += 4 if end == b"\r\n\r\n" else 0
        yield length
        at += length


# ---- Spark jobs


def write_packages(records: DataFrame, folder: str) -> DataFrame:
    """Writes each partition of (page_id, url, html, digest, record_type, refers_to) as one package into `folder`; returns their paths.

    A package has a name of its own for each attempt and counts only if its task returned the name, so lost or repeated tasks do no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        name, out, index, offset, n = f"{uuid.uuid4().hex}.wacz", None, [], 0, 0
        for b in batches:
            for x in b.itertuples(index=False):
                if out is None:
                    stream = store.open_output_stream(f"{base}/{name}")
                    package = zipfile.ZipFile(_Forward(stream), "w", zipfile.ZIP_STORED)
                    out = package.open(zipfile.ZipInfo(ARCHIVE), "w", force_zip64=True)
                page, refers = (None if pd.isna(v) else int(v) for v in (x.page_id, x.refers_to))
                raw = record(x.record_type, page, x.url, (x.html or "").encode("utf-8", "surrogatepass"), x.digest, refers)
                out.write(raw)
                index.append(index_line(x.url, x.digest, offset, len(raw)) + "\n")
                offset, n = offset + len(raw), n + 1
        if out is not None:
            out.close()
            with package.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as m:
                m.write("".join(sorted(index)).encode("utf-8", "surrogatepass"))
            package.close()
            stream.close()
            yield pd.DataFrame({"path": [f"{folder}/{name}"], "records": [n]})

    return written(records.mapInPandas(run, "path string, records long"), "packages")


class _Forward(io.RawIOBase):
    """A stream that only goes forward, for a writer that asks where it is."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        self.at += len(data)
        return len(data)

    def tell(self) -> int:
        return self.at

    def flush(self) -> None:
        pass


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path there."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme in ("s3a", "s3n"):  # Hadoop's names of one and the same store
        path = f"s3:{rest}"
    try:
        return fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError) as e:
        raise ValueError(f"tasks can't open files of scheme {scheme} by ranges here ({e}); set spark.checkpoint.dir to a store that they can") from e


def _open(path: str):
    store, inside = _store(path)
    return store.open_input_file(inside), store.get_file_info(inside).size


def _ranges(f, size: int) -> Iterator[tuple[int, list[int]]]:
    """Stretches of neighbouring records of all archives of a package: where each begins and its records' lengths.

    They come from the indexes; an archive, or what is left of one, that no index names is read through to find its records.
    """
    members = directory(f, size)
    lines: dict[str, set[tuple[int, int]]] = {}
    for m in members.values():
        if m.name.startswith(INDEXES) and m.name.lower().endswith(".cdxj"):
            for line in _range(f, data_start(f, m), m.size).decode("utf-8", "surrogatepass").splitlines():
                if "{" in line:  # else it is a line about the index itself
                    x = json.loads(line[line.index("{") :])
                    if {"filename", "offset", "length"} <= x.keys():
                        lines.setdefault(x["filename"].rpartition("/")[2], set()).add((int(x["offset"]), int(x["length"])))
    for m in members.values():
        if not m.name.startswith(ARCHIVES) or m.name.endswith("/"):
            continue
        if not m.name.lower().endswith((".warc.gz", ".warc")):
            raise ValueError(f"{m.name} is no archive that can be read here")
        ends = gzip_ends if m.name.lower().endswith(".gz") else plain_ends
        begin, at, group = data_start(f, m), 0, []
        known = sorted(lines.get(m.name.rpartition("/")[2], ()))
        gaps = []
        for offset, length in known:
            if offset > at:
                gaps.append((at, offset))
            at = max(at, offset + length)
        for lo, hi in [*gaps, *([(at, m.size)] if at < m.size else [])]:
            for length in ends(f, begin + lo, hi - lo):
                known.append((lo, length))
                lo += length
        start = 0
        for offset, length in sorted(known):
            if group and (offset != start + sum(group) or sum(group) + length > RANGE):
                yield begin + start, group
                group = []
            if not group:
                start = offset
            group.append(length)
        if group:
            yield begin + start, group


def read_packages(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Every record of the packages named in `path`: page_id, payload_bytes, payload_digest, record_type, refers_to, payload (null in revisits), record_id, url, refers_to_id.

    First each package's directory and indexes are read, which gives ranges of neighbouring records of all of its archives; these are dealt
    out anew and read, so a large package is read by many tasks. Archives may be gzipped record by record or plain, and hold records of any
    type; page_id and refers_to are null unless ids were made here. Payloads are checked against stated digests; bytes of theirs that are no
    UTF-8 come as U+FFFD. Damaged, encrypted or compressed packages, and members among the archives that are none, raise an error that
    names them; no paths give no rows.
    """

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path in b["path"]:
                f, size = _open(path)
                with f:
                    yield pd.DataFrame([(path, start, group) for start, group in _ranges(f, size)], columns=["path", "start", "lengths"])

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start, lengths in b.itertuples(index=False):
                f, _ = _open(path)
                with f:
                    raw = _range(f, start, int(sum(lengths)))
                rows, at = [], 0
                for n in lengths:
                    try:
                        r = parse(raw[at : at + n])
                        fields, payload = r["fields"], r["payload"]
                        digest = digest_of(fields, payload)
                        if payload is not None and len(payload) != r["length"] and "warc-truncated" not in fields:
                            raise ValueError("its payload has another length than it says")
                    except (ValueError, KeyError, zlib.error) as e:
                        raise ValueError(f"record at {start + at} of {path}: {e}") from e
                    at += n
                    text = None if payload is None else payload.decode("utf-8", "surrogatepass" if _is_text(payload) else "replace")
                    names = (fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"))
                    rows.append((_page(names[0]), r["length"], digest, fields["warc-type"], _page(names[2]), text, *names))
                out = pd.DataFrame(rows, columns=RECORD)
                yield out.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})

    found = paths.select("path").repartition(tasks_for(spark)).mapInPandas(ranges, "path string, start long, lengths array<long>")
    dealt = found.repartition(2 * tasks_for(spark))
    kinds = ("long", "long", "string", "string", "long", "string", "string", "string", "string")
    return dealt.mapInPandas(records, ", ".join(f"{c} {kind}" for c, kind in zip(RECORD, kinds, strict=True)))


def classified(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """pages (page_id, url, html) with digest, record_type and refers_to.

    Of equal payloads of at least `least` bytes, the smallest page_id is the response and others revisit it. A null html is an empty
    payload. Rows without page_id are responses, and equal rows of one page_id are so alike. Other columns are ignored.
    """
    hashed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    hashed = hashed.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = hashed.where(F.octet_length("html") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    again = F.col("first").isNotNull() & (F.col("page_id") != F.col("first"))
    return hashed.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to")
    )


def archived(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC records into ZIP packages in the shared folder and reads them back (see classified and read_packages)."""
    spark = pages.sparkSession
    return read_packages(spark, write_packages(classified(pages), fresh_path(spark, "warc"))).select(*RECORD[:6])
