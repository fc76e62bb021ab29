"""WARC archives: a writer, and a reader that salvages what damage leaves.

The writer puts each record in a gzip member of its own, or plain. The reader walks member by
member (or record by record); where a check fails it searches on for the next offset at which
a member decompresses to a version line, or for the next version line, takes up there, and logs
the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.common import Marks, drop_kept, filesystem, join_hot, keep, located, shared_dir, small

VERSION = b"WARC/1.1"
_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
_MAGIC = b"\x1f\x8b\x08"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def same_digest(told: str, block: bytes) -> bool:
    """Whether a labelled digest is that of the block: SHA-1 in base 32 or hexadecimal, in any case. Other
    algorithms aren't checked."""
    label, _, value = told.strip().partition(":")
    if label.strip().lower() not in ("sha1", "sha-1"):
        return True
    value = value.strip()
    return value.upper().rstrip("=") == digest32(block) or value.lower() == hashlib.sha1(block).hexdigest()


class Headers(dict):
    """Headers by name, in any case."""

    def __init__(self, pairs: Iterable[tuple[str, str]] = ()):
        super().__init__((k.lower(), v) for k, v in pairs)

    def __getitem__(self, name: str) -> str:
        return super().__getitem__(name.lower())

    def get(self, name: str, default=None):
        return super().get(name.lower(), default)

    def __contains__(self, name: object) -> bool:
        return super().__contains__(str(name).lower())


@dataclass
class Record:
    headers: Headers
    block: bytes
    start: int
    end: int

    @property
    def payload(self) -> bytes:
        """The HTTP body of a response, else the block."""
        if self.headers.get("Content-Type", "").lower().startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block

    def http(self, name: str) -> str | None:
        head = self.block.partition(b"\r\n\r\n")[0].decode("utf-8", "replace")
        return next((v.strip() for k, _, v in (x.partition(":") for x in head.split("\r\n")[1:]) if k.strip().lower() == name.lower()), None)


@dataclass
class Gap:
    start: int
    end: int
    why: str


class Damaged(ValueError):
    pass


def encode(headers: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(block))}.items())
    return VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def decode(data: bytes, at: int = 0) -> tuple[Headers, bytes, int]:
    """Headers, block and end of the record that begins at an offset; Damaged if it is none."""
    m = _LINE.match(data, at)
    if not m:
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", m.end() - 2)
    if stop < 0:
        raise Damaged("no end of headers")
    pairs = []
    for line in data[m.end() : stop].split(b"\r\n"):
        k, colon, v = line.partition(b":")
        if line and not colon:
            raise Damaged("not a header")
        if line:
            pairs.append((k.strip().decode("utf-8", "replace"), v.strip().decode("utf-8", "replace")))
    headers = Headers(pairs)
    length = headers.get("Content-Length", "")
    if not length.isdigit():
        raise Damaged("no length")
    begin = stop + 4
    end = begin + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("the block does not end where its length says")
    block = data[begin:end]
    told = headers.get("WARC-Block-Digest")
    if told and not same_digest(told, block):
        raise Damaged("block digest differs")
    return headers, block, end + 4


@dataclass
class Salvage:
    """Iterates over the intact records of an archive; gaps has what was quarantined.

    File is anything with read(size). Whole members are held one at a time. Headers may be of any
    length; a record above limit, more than a row of Spark can hold, is a gap.
    """

    file: object
    limit: int = 1 << 32
    chunk: int = 1 << 20
    gaps: list[Gap] = field(default_factory=list)

    def __iter__(self) -> Iterator[Record]:
        self._data, self._base, self._ended = b"", 0, False
        at = 0  # offset in the file
        lost, why = None, ""
        while True:
            self._forget(at)
            self._need(at - self._base + 16)
            if at - self._base >= len(self._data):
                break
            try:
                found, end, bad = self._member(at) if self._data.startswith(_MAGIC, at - self._base) else self._plain(at)
            except Damaged as e:
                if lost is None:
                    lost, why = at, str(e)
                at = self._next(at + 1)
                continue
            if lost is not None:
                self.gaps.append(Gap(lost, at, why))
                lost = None
            yield from found
            if bad:
                self.gaps.append(Gap(at, end, bad))
            at = end
        if lost is not None:
            self.gaps.append(Gap(lost, self._base + len(self._data), why))

    def _forget(self, at: int) -> None:
        if at - self._base > self.chunk:
            self._data = self._data[at - self._base :]
            self._base = at

    def _need(self, size: int) -> bool:
        """Whether size bytes from the base are there, read if need be."""
        while len(self._data) < size and not self._ended:
            more = self.file.read(max(self.chunk, len(self._data) // 2))
            self._ended = not more
            self._data += more
        return len(self._data) >= size

    def _member(self, at: int) -> tuple[list[Record], int, str]:
        """The records of a member, its end, and why the rest of it is lost, if it is."""
        z, out, pos = zlib.decompressobj(31), [], at - self._base
        size = 0
        try:
            while not z.eof:
                if not self._need(pos + 1):
                    raise Damaged("the file ends within a member")
                part = z.decompress(self._data[pos : pos + 65536], self.limit - size + 1)
                if not out and part and not part.startswith(b"WARC/1."[: len(part)]):
                    raise Damaged("the member holds no record")
                pos = min(len(self._data), pos + 65536)
                if z.unconsumed_tail:
                    pos -= len(z.unconsumed_tail)
                if part:
                    out.append(part)
                    size += len(part)
                if size > self.limit:
                    raise Damaged("the member is too large")
        except zlib.error as e:
            raise Damaged(f"bad member: {e}") from None
        pos -= len(z.unused_data)
        data = b"".join(out)
        found, inner, why = [], 0, ""
        while inner < len(data):
            try:
                headers, block, inner = decode(data, inner)
            except Damaged as e:
                if not found:
                    raise
                why = f"in a member of several records: {e}"
                break
            found.append(Record(headers, block, at, self._base + pos))
        if not found:
            raise Damaged("the member is empty")
        return found, self._base + pos, why

    def _plain(self, at: int) -> tuple[list[Record], int, str]:
        pos = at - self._base
        m = _LINE.match(self._data, pos)
        if not m:
            raise Damaged("no version line")
        seen = m.end() - 2
        while (stop := self._data.find(b"\r\n\r\n", seen)) < 0:
            # What isn't a header needn't be read to the file's end.
            if any(line and b":" not in line for line in self._data[m.end() :].split(b"\r\n")[:-1]):
                raise Damaged("not a header")
            seen = max(seen, len(self._data) - 3)
            if not self._need(len(self._data) + 1):
                raise Damaged("no end of headers")
        length = re.compile(rb"(?i)\r\ncontent-length[ \t]*:\s*(\d+)\s*\r\n").search(self._data, pos, stop + 2)
        if length:
            want = int(length[1])
            if want > self.limit:
                raise Damaged("the record is too large")
            self._need(stop + 4 + want + 4)
        headers, block, end = decode(self._data, pos)
        return [Record(headers, block, at, self._base + end)], self._base + end, ""

    def _next(self, at: int) -> int:
        """The next offset where a member or a version line begins, or the file's end."""
        while True:
            pos = max(0, at - self._base)
            line = _LINE.search(self._data, pos)
            found = [x for x in (self._data.find(_MAGIC, pos), line.start() if line else -1) if x >= 0]
            if found:
                return self._base + min(found)
            at = max(at, self._base + len(self._data) - 10)
            self._forget(at)
            if not self._need(len(self._data) + 1):
                return self._base + len(self._data)


def _open(path: str, mode: str):
    """Opens a file of any store that pyarrow knows; bare paths are local."""
    store, inner = filesystem(path)
    if mode == "r":
        return store.open_input_stream(inner, compression=None)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner, compression=None)


def write(records: DataFrame, folder: str, compress: bool = True, max_bytes: int = 256 << 20, torn: bool = False) -> DataFrame:
    """Archives of records with record_id, url, record_type, refers_to and html, written by the tasks
    that hold the rows; gives path, records, gaps and bytes of the files that count.

    Each attempt of a task writes files of its own, and the list, kept as a table, names those of
    the attempts that succeeded. A response has the HTTP head and the payload; a revisit has the
    head only, where Content-Length tells the payload's size. With torn, each archive begins with the front of
    its first record, as it stands after a writer was killed and went on in the same file; gaps counts these.
    """

    def run(batches):
        out, path, n, size = None, "", 0, 0
        told = lambda: pa.RecordBatch.from_pydict({"path": [path], "records": [n], "gaps": [int(torn)], "bytes": [size]})
        for batch in small(batches):
            for rid, url, kind, refers, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                if kind == "response":
                    block += payload
                headers = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x-page:{'' if rid is None else rid}>", "WARC-Date": "1970-01-01T00:00:00Z", "Content-Type": "application/http; msgtype=response"}
                headers["WARC-Target-URI"] = re.sub(r"[\r\n]", " ", url or "")
                headers["WARC-Block-Digest"], headers["WARC-Payload-Digest"] = f"sha1:{digest32(block)}", f"sha1:{digest32(payload)}"
                if kind == "revisit":
                    headers |= {"WARC-Refers-To": f"<urn:x-page:{refers}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                data = encode(headers, block)
                data = member(data) if compress else data
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc" + ".gz" * compress
                    out = _open(path, "w")
                    if torn:
                        out.write(data[: len(data) * 2 // 3])
                        size += len(data) * 2 // 3
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= max_bytes:
                    out.close()
                    yield told()
                    out, n, size = None, 0, 0
        if out is not None:
            out.close()
            yield told()

    columns = records.select(F.col("record_id").cast("long"), "url", "record_type", F.col("refers_to").cast("long"), "html")
    return keep(columns.mapInArrow(run, "path string, records long, gaps long, bytes long"), "archives")


_READ = "path string, start long, end long, record_type string, record_id string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, error string"


def read(paths: DataFrame, with_payload: bool = True, whole: bool = False) -> DataFrame:
    """A row for each intact record of the archives in the column path, and one with error for each gap.

    Archives are streamed; a task holds one record at a time. Payload digests are computed from
    what was read; those of revisits, which have no payload, are taken from their headers. With
    whole, an archive that hasn't as many gaps and records as its row in paths says fails.
    """

    def told(h: dict[str, str], name: str) -> str | None:
        m = re.fullmatch(r"<urn:x-page:(.*)>", h.get(name, ""))
        return (m[1] or None) if m else h.get(name)

    def run(batches):
        names = [x.split()[0] for x in _READ.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in _READ.split(", ")]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path, want, torn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, size, count = [], 0, 0
                with _open(path, "r") as f:
                    archive = Salvage(f)
                    for r in archive:
                        count += 1
                        h, kind, body = r.headers, r.headers.get("WARC-Type"), r.payload
                        if kind == "revisit":
                            length = r.http("Content-Length")
                            n, digest, body = int(length) if length and length.isdigit() else None, h.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None, None
                        else:
                            n, digest = len(body), digest32(body)
                        size += n if with_payload and body else 200
                        rows.append((path, r.start, r.end, kind, told(h, "WARC-Record-ID"), h.get("WARC-Target-URI"), told(h, "WARC-Refers-To"), n, digest, body if with_payload else None, None))
                        if size > 8 << 20 or len(rows) >= 4096:
                            yield pack(rows)
                            rows, size = [], 0
                    if whole and (len(archive.gaps) != torn or count != want):
                        raise ValueError(f"{path}: {count} of {want} records read, gaps: {[(g.start, g.end, g.why) for g in archive.gaps[:3]]}")
                    rows += [(path, g.start, g.end, *[None] * 7, g.why) for g in archive.gaps]
                if rows:
                    yield pack(rows)

    torn = F.col("gaps") if "gaps" in paths.columns else F.lit(0)
    return paths.select("path", (F.col("records") if whole else F.lit(None)).cast("long"), torn.cast("long")).mapInArrow(run, _READ)


def revisits(pages: DataFrame) -> DataFrame:
    """pages with record_id, record_type and refers_to: of the rows with equal payloads, that with
    the largest page_id is the response; the others, if they have an id, revisit it.

    Only digests and ids are shuffled; which row revisits which is looked up where the html is read.
    """
    names = [f"c{pages.columns.index(c)}" for c in ("page_id", "url", "html")]
    source = located(pages)
    source = source.select("file", "at", F.col(names[0]).cast("long").alias("record_id"), F.col(names[1]).alias("url"), F.col(names[2]).alias("html"))
    slim = keep(source.select("file", "at", "record_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("sha")), "digests")
    last = slim.groupBy("sha").agg(F.max("record_id").alias("last"), F.count("*").alias("n")).where("n > 1")
    again = join_hot(slim.where("record_id is not null"), last, "sha", "n", slim.count()).where("record_id < last")
    marks = Marks(again.select("file", "at", F.col("last").alias("value")), "revisits")
    drop_kept(slim)
    reader = marks.reader()

    def run(batches):
        pick = reader()
        for batch in small(batches):
            where, last = pick(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            refers = [None] * batch.num_rows
            for i, x in zip(where.tolist(), last.tolist(), strict=True):
                refers[i] = x
            kind = pa.array(["response" if x is None else "revisit" for x in refers], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), kind, pa.array(refers, pa.int64()), batch.column(4)], names=["record_id", "url", "record_type", "refers_to", "html"])

    return source.mapInArrow(run, "record_id long, url string, record_type string, refers_to long, html string")


def round_trip(pages: DataFrame, torn: bool = False) -> DataFrame:
    """Archives pages and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html: an empty payload. Null page_id: always a response. Repeated rows of the largest
    page_id of a payload: each is a response. An empty table gives an empty result. Extra columns
    are not archived. Very long pages are one record each, up to 4 GB. It fails if not all records that were
    written are read, or if gaps are found where nothing is torn. With torn, archives begin with a
    torn record, which the reader has to get over.
    """
    spark = pages.sparkSession
    archives = write(revisits(pages), f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}", torn=torn)
    n = max(1, min(archives.count(), 10_000))
    back = read(archives.repartition(n), with_payload=False, whole=True).where("error is null")
    return back.select(F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
