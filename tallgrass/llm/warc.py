"""WARC archives: a writer that stores equal payloads once, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ready, shared_dir

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_READ = 1 << 16
_HELD = 1 << 24  # bytes of payloads of one member that are held rather than read again
_HEADER = 1 << 24  # bytes of a record's header; longer ones count as broken
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page} {digest}')}>"


def record(page: object, url: str | None, payload: bytes, digest: str, leader: object, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed; with a ``leader`` a revisit that holds no payload."""
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    head = [("WARC-Type", "revisit" if leader is not None else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date)]
    head += [("WARC-Target-URI", uri)] * bool(uri) + [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    head += [("X-Page-Id", str(page))] * (page is not None)
    if leader is not None:
        head += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(leader, digest)), ("X-Refers-To-Page-Id", str(leader))]
    block = _HTTP % len(payload) + (payload if leader is None else b"")
    head += [("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, roll: int = 1 << 26, date: str = "1970-01-01T00:00:00Z", compress: bool = True) -> DataFrame:
    """Write one record per row of ``df`` to archives in the shared folder; returns their stored list (path, records, bytes).

    Of rows with equal payloads of at least ``least`` bytes, that with the smallest key is the response
    and the others revisit it; rows that repeat the smallest key are responses too. A null key comes
    after all others, a null payload is empty. Each record is a gzip member of its own, so a reader can
    start at any of them; files end at about ``roll`` bytes. Files go straight to the shared folder under
    a name of the attempt's own, and only those of attempts that Spark accepted get into the list. An empty
    table gives an empty list.
    """
    spark = df.sparkSession
    ready(spark)
    root = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex[:12]}"
    payload = F.coalesce(F.col(html).cast("binary"), F.lit("").cast("binary"))
    rows = df.select(F.col(key).alias("page"), F.col(url).alias("url"), payload.alias("payload")).withColumn("told", F.sha1("payload"))
    shared = rows.where(F.octet_length("payload") >= least).groupBy("told").agg(F.min("page").alias("leader"), F.count("*").alias("n")).where("n > 1 and leader is not null").select(F.col("told").alias("of"), "leader")
    dealt = rows.join(shared, rows["told"] == shared["of"], "left").select("page", "url", "payload", F.when(~F.col("page").eqNullSafe(F.col("leader")), F.col("leader")).alias("leader"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(at, recursive=True)
        out, name, records, size, done = None, "", 0, 0, []
        for pdf in batches:
            for page, link, raw, leader in zip(pdf["page"], pdf["url"], pdf["payload"], pdf["leader"], strict=True):
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc" + ".gz" * compress, 0, 0
                    out = fs.open_output_stream(f"{at}/{name}", compression=None)
                data = record(None if pd.isna(page) else int(page), link, raw, sha1_base32(raw), None if pd.isna(leader) else int(leader), date)
                data = _member(data) if compress else data
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll:
                    out.close()
                    out = None
                    done.append((f"{root}/{name}", records, size))
        if out is not None:
            out.close()
            done.append((f"{root}/{name}", records, size))
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return materialize(dealt.mapInPandas(write, "path string, records long, bytes long"), "archives")


class Broken(Exception):
    """A record that fails a check."""


def parse(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and whole length of the record that ``data`` starts with; raises Broken."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/1.") or end < 0:
        raise Broken("no version line or header end")
    lines = data[:end].split(b"\r\n")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Broken("bad header line")
        headers[name.decode("latin-1").strip()] = value.strip().decode("utf-8", "replace")
    if not headers.get("Content-Length", "").isdigit() or "WARC-Type" not in headers:
        raise Broken("no length or type")
    length, start = int(headers["Content-Length"]), end + 4
    block = data[start : start + length]
    if len(block) < length or data[start + length : start + length + 4] != b"\r\n\r\n":
        raise Broken("block shorter or longer than its length")
    if (told := headers.get("WARC-Block-Digest")) and told.startswith("sha1:") and told[5:] != sha1_base32(block):
        raise Broken("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2] if block.startswith(b"HTTP/") else block
    told = headers.get("WARC-Payload-Digest", "")
    if headers["WARC-Type"] != "revisit" and told.startswith("sha1:") and told[5:] != sha1_base32(payload):
        raise Broken("payload digest differs")
    return headers, payload, start + length + 4


class _File:
    """Random access to a file by blocks, of which the last one is kept."""

    def __init__(self, source: object) -> None:
        self.source, self.size, self.block, self.at = source, source.size(), b"", -1

    def read(self, start: int, length: int) -> bytes:
        length = max(0, min(length, self.size - start))
        if self.at >= 0 and self.at <= start and start + length <= self.at + len(self.block):
            return self.block[start - self.at : start - self.at + length]
        self.source.seek(start)
        self.block, self.at = self.source.read(min(max(length, 16 * _READ), self.size - start)), start
        return self.block[:length]

    def find(self, what: tuple[bytes, ...], start: int) -> int:
        """The first place from ``start`` with one of ``what``, or the size."""
        longest = max(map(len, what))
        while start < self.size:
            block = self.read(start, _READ)
            if hits := [i for w in what if (i := block.find(w)) >= 0]:
                return start + min(hits)
            if start + len(block) >= self.size:
                break
            start += len(block) - longest + 1
        return self.size

    def inflate(self, start: int, fault: list[str]) -> Iterator[bytes]:
        """What the gzip member at ``start`` holds, in parts; its compressed length comes last, as the generator's value.

        A broken member gives all that comes out before its fault, which is put into ``fault``.
        """
        z, at, step = zlib.decompressobj(31), start, _READ
        while not z.eof:
            if not (block := self.read(at, step)):
                fault.append("member is cut off")
                return at - start
            before = z.copy() if step > 1 else z
            try:
                out = z.decompress(block)
            except zlib.error as e:
                if step == 1:
                    fault.append(f"member fails: {e}")
                    return at - start
                z, step = before, 1  # byte by byte, all that comes out before the fault
                continue
            at += len(block)
            if out:
                yield out
        return at - len(z.unused_data) - start


class _Member:
    """Access to an inflated member from front to back, as to a file; only the part that is asked for is held."""

    def __init__(self, file: _File, start: int) -> None:
        self.file, self.start, self.fault = file, start, []
        self.parts, self.data, self.at, self.size, self.length = file.inflate(start, self.fault), bytearray(), 0, 1 << 62, -1

    def _fill(self, end: int) -> None:
        while self.length < 0 and self.at + len(self.data) < end:
            try:
                self.data += next(self.parts)
            except StopIteration as e:
                self.length, self.size = e.value, self.at + len(self.data)

    def read(self, start: int, length: int) -> bytes:
        if start > self.at:
            while start > self.at + len(self.data) and self.length < 0:
                self.at, self.data = self.at + len(self.data), bytearray()
                self._fill(self.at + 1)
            del self.data[: start - self.at]
            self.at = start
        self._fill(start + length)
        return bytes(self.data[:length])

    def find(self, what: tuple[bytes, ...], start: int) -> int:
        longest = max(map(len, what))
        while True:
            block = self.read(start, _READ)
            if hits := [i for w in what if (i := block.find(w)) >= 0]:
                return start + min(hits)
            if len(block) < _READ:
                return start + len(block)
            start += len(block) - longest + 1

    def rest(self) -> None:
        """Go to the member's end."""
        while self.length < 0:
            self.at, self.data = self.at + len(self.data), bytearray()
            self._fill(self.at + 1)


def _record_at(source: _File | _Member, start: int) -> tuple[dict[str, str], bytes, int]:
    """The record at ``start``, read as far as its header and then its length say; raises Broken."""
    size = 1 << 12
    while True:
        data = source.read(start, size)
        end = data.find(b"\r\n\r\n")
        if end >= 0 or len(data) < size or not data.startswith(b"WARC/1."):
            break
        if size >= _HEADER:
            raise Broken(f"no header end within {_HEADER} bytes")
        size *= 4
    length = next((v for x in data[: max(end, 0)].split(b"\r\n") if x.lower().startswith(b"content-length:") and (v := x.split(b":", 1)[1].strip()).isdigit()), b"0")
    whole = max(end, 0) + 8 + int(length)
    return parse(data[:whole] if whole <= len(data) else source.read(start, whole))


def _told(headers: dict[str, str]) -> bool:
    """Whether a digest vouches for the record that passed its checks."""
    kinds = ("Block",) if headers["WARC-Type"] == "revisit" else ("Block", "Payload")
    return any(headers.get(f"WARC-{k}-Digest", "").startswith("sha1:") for k in kinds)


def _inside(member: _Member) -> Iterator[tuple[str, dict[str, str], bytes, int]]:
    """(fault, headers, payload, end) of the records and inner gaps of a member, up to its end or its break.

    After a fault the search goes on for the next version line in the inflated bytes.
    """
    at = 0
    while member.read(at, 1):
        try:
            headers, payload, used = _record_at(member, at)
        except Broken as e:
            after = member.find((b"WARC/1.",), at + 1)
            yield f"{e} (bytes {at} to {after} of the member's data)", {}, b"", after
            at = after
            continue
        at += used
        yield "", headers, payload, at


def salvage(source: object) -> Iterator[tuple[int, int, str, dict[str, str], bytes]]:
    """(offset, length, fault, headers, payload) of every record that passes its checks, and of every gap.

    After a failed check the search goes on one byte further, for the next gzip member that opens with a
    version line or the next version line itself; the bytes up to there are one gap with its fault. Inside
    a member it goes on in the inflated bytes: each inner gap has the member's offset and length, and its
    own bytes in its fault. A member that breaks off or fails its checksum yields the records before the
    fault that a digest vouches for (and, if it is just cut off, all but the last), then the search goes
    on. One record is in memory at a time; records without a digest wait, as numbers of bytes only, for
    the member's checksum, and are then read again.
    """
    file, at, gap, fault = _File(source), 0, -1, ""
    while at < file.size:
        found: Iterator[tuple[int, int, str, dict[str, str], bytes]] | list = []
        start, bad, length = file.read(at, 7), "", 0
        if start[:3] == b"\x1f\x8b\x08":
            good, length, bad, held = _survey(file, at)
            if good or not bad:
                found = _of_member(file, at, length, bad) if held is None else [(at, length, *x) for x in held]
        elif start == b"WARC/1.":
            try:
                headers, payload, length = _record_at(file, at)
                found = [(at, length, "", headers, payload)]
            except Broken as e:
                bad = str(e)
        else:
            bad = "neither a member nor a version line"
        if gap >= 0 and (found or not bad):
            yield gap, at - gap, fault, {}, b""
            gap = -1
        yield from found
        if bad:
            if gap < 0:
                gap, fault = at, bad
            at = file.find((b"\x1f\x8b\x08", b"WARC/1."), at + 1)
        else:
            at += length
    if gap >= 0:
        yield gap, file.size - gap, fault, {}, b""


def _survey(file: _File, start: int) -> tuple[bool, int, str, list | None]:
    """Whether the member at ``start`` holds a record that counts, its compressed length, its fault as a whole, and
    what it yields if that is whole and little enough to be held."""
    member, held, size, good, first = _Member(file, start), [], 0, False, ""
    for fault, headers, payload, _ in _inside(member):
        good, first = good or not fault, first or fault
        size += len(payload)
        if held is not None:
            held.append((fault, headers, payload))
            held = held if size <= _HELD else None
    member.rest()
    if member.fault:
        return any(not x[2] for x in _of_member(file, start, member.length, member.fault[0])), member.length, member.fault[0], None
    return good, member.length, "" if good else first, held


def _of_member(file: _File, start: int, length: int, broken: str) -> Iterator[tuple[int, int, str, dict[str, str], bytes]]:
    """The records of a member that count, and its inner gaps if it isn't ``broken`` as a whole.

    In a broken member the record at the break never counts, and those before it only if they have a
    digest or the member is just cut off.
    """
    member = _Member(file, start)
    for fault, headers, payload, end in _inside(member):
        if fault:
            if not broken:
                yield start, length, fault, {}, b""
        elif not broken or (member.read(end, 1) and (_told(headers) or "cut off" in broken)):
            yield start, length, "", headers, payload


def read_archives(files: DataFrame, path: str = "path", payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives in ``files``, a task for each file and one record in memory at a time.

    Columns: path, offset, length (bytes in the file), fault (null for a record; else why the bytes of
    this gap are quarantined), headers (map), payload (binary, null on demand), payload_bytes and
    payload_digest (of the payload as read; null for gaps). A file with nothing valid is one gap; an
    empty file gives no rows; null paths are left out; a path that is listed twice is read twice. The
    files are dealt over as many tasks as there are files, a number that adaptive execution leaves alone.
    """
    ready(files.sparkSession)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "offset", "length", "fault", "headers", "payload", "payload_bytes", "payload_digest"]
        for pdf in batches:
            for name in pdf["path"]:
                fs, at = pyarrow.fs.FileSystem.from_uri(name)
                rows, size = [], 0
                with fs.open_input_file(at) as source:
                    for offset, length, fault, headers, payload in salvage(source):
                        good = not fault
                        rows.append((name, offset, length, fault or None, headers, payload if payloads and good else None, len(payload) if good else None, sha1_base32(payload) if good else None))
                        size += len(payload) if payloads else 500
                        if size > 1 << 24:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=columns)

    names = files.select(F.col(path).alias("path")).where("path is not null")
    kind = "path string, offset long, length long, fault string, headers map<string,string>, payload binary, payload_bytes long, payload_digest string"
    return names.repartition(max(1, min(names.count(), 100_000))).mapInPandas(read, kind)


def op3_salvage_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back: what each record says and holds."""
    files = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    read = read_archives(files, payloads=False).where("fault is null")
    h = lambda name: F.try_element_at("headers", F.lit(name))
    revisit = h("WARC-Type") == "revisit"
    return read.select(
        h("X-Page-Id").cast("long").alias("page_id"),
        F.when(revisit, h("X-Payload-Length").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring(h("WARC-Payload-Digest"), 6, 32)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        h("WARC-Type").alias("record_type"),
        h("X-Refers-To-Page-Id").cast("long").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
l AS (SELECT h, min(page_id) AS leader FROM p GROUP BY h)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([32768, 1024, 32, 1],
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (5 * i + 1)::INT, 5))::BIGINT // k) % 32 + 1)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> leader THEN leader END AS refers_to
FROM p JOIN l USING (h)
"""
