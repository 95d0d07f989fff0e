"""WARC archives as a Spark data source.

``spark.read.format("warc")`` plans its partitions from the archives' offset
files (which the writer leaves beside each archive) and so splits large archives
at record boundaries; an archive without one is a partition of its own.  Filters
on record type, id, target and the other header columns are pushed down: a
record's header is parsed first, and the block of a record that is not wanted is
passed over.  An archive is read in one direction through a buffer
(:class:`Plain`), so small records cost no request of their own, and what lies
beyond the buffer is passed over by a seek.  With ``payload`` set to ``false``
no payload is kept.

Paths go through ``pyarrow.fs``, so archives may lie in any store it knows.
Archives are written plain (``.warc``) or, with ``compression`` set to
``gzip``, as one gzip member for each record (``.warc.gz``), whose sizes the
offset file holds: the members of unwanted records are inflated up to the end of
the header and no further.  A ``.warc.gz`` of other origin has no such file, and
where a gzip member ends is known only after inflating it; its unwanted blocks
are inflated piece by piece, thrown away and never put together.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .shared import free_name, need, new_folder, save, without

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE = "application/http;msgtype=response"
SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, headers map<string,string>, payload binary"
WRITE_COLUMNS = ("record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload_length", "payload")
HEADER_OF = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
_WINDOW = 1 << 16
_HEAD_END = b"\r\n\r\n"
_MOVERS = 16  # files that a commit renames at a time
#: Digests with copies that are broadcast at most (some 100 bytes each), and the rows from which a digest counts as hot beyond that.
BROADCAST_ROWS, HOT_ROWS, SALTS = 200_000, 100_000, 256


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), path


def _one_line(value: str) -> str:
    return value.replace("\r", " ").replace("\n", " ")


def record_bytes(row: dict) -> bytes:
    """One record. A revisit holds the HTTP head of its payload, not the payload."""
    payload, revisit = row["payload"] or b"", row["record_type"] == "revisit"
    length = row["payload_length"] if row["payload_length"] is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [VERSION]
    for column, name in HEADER_OF.items():
        if row[column] is not None:
            value = _one_line(row[column])
            head.append(f"{name}: <{value}>" if name in ("WARC-Record-ID", "WARC-Refers-To") else f"{name}: {value}")
    if revisit:
        head.append(f"WARC-Profile: {REVISIT_PROFILE}")
    head += [f"Content-Type: {HTTP_TYPE}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields, continuation lines joined; names as written."""
    out: dict[str, str] = {}
    last = None
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            out[last] = value.strip()
    return out


@dataclass
class Part(InputPartition):
    path: str
    start: int = 0
    stop: int | None = None  # None: to the end of the archive
    sizes: tuple[int, ...] = ()  # of the gzip members from start on


@dataclass
class Done(WriterCommitMessage):
    files: list[str]


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool):
        return WarcWriter(self.options, overwrite)


class Source:
    """Bytes in one direction: ``more`` gives the next ones (none at the end), the rest looks ahead, takes and passes over."""

    def __init__(self) -> None:
        self.held, self.pos = b"", 0

    def more(self, least: int) -> bytes:
        raise NotImplementedError

    def pass_over(self, n: int) -> None:
        """Drops ``n`` bytes that are not held yet."""
        while n > 0 and (got := self.more(1)):
            if len(got) > n:
                self.held, self.pos = got, n
            n -= len(got)

    def _hold(self, n: int) -> None:
        have = len(self.held) - self.pos
        if have >= n:
            return
        parts = [self.held[self.pos :]]
        while have < n and (got := self.more(n - have)):
            parts.append(got)
            have += len(got)
        self.held, self.pos = b"".join(parts), 0

    def peek(self, n: int) -> bytes:
        self._hold(n)
        return self.held[self.pos : self.pos + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        if len(out) < n:
            raise ValueError("an archive ends inside a record")
        self.pos += n
        return out

    def skip(self, n: int) -> None:
        have = len(self.held) - self.pos
        if have >= n:
            self.pos += n
        else:
            self.held, self.pos = b"", 0
            self.pass_over(n - have)

    def head(self) -> bytes | None:
        """The next header without its empty line; None at the end."""
        while self.peek(2) == b"\r\n":  # more empty lines between records than the format asks for
            self.pos += 2
        look = _WINDOW
        while (end := self.held.find(_HEAD_END, self.pos)) < 0:
            before = len(self.held) - self.pos
            self._hold(max(look, before + 1))
            if len(self.held) - self.pos == before:
                if before:
                    raise ValueError("an archive ends inside a record's header")
                return None
            look *= 2
        out = self.held[self.pos : end]
        self.pos = end + 4
        return out


class Plain(Source):
    """A file from ``at`` on, read ahead in windows; what lies beyond the window is passed over by a seek."""

    def __init__(self, f, at: int = 0) -> None:
        super().__init__()
        self.f, self.next, self.size = f, at, f.size()
        f.seek(at)

    @property
    def at(self) -> int:
        return self.next - len(self.held) + self.pos

    def more(self, least: int) -> bytes:
        out = self.f.read(max(least, _WINDOW))
        self.next += len(out)
        return out

    def pass_over(self, n: int) -> None:
        self.next = min(self.size, self.next + n)
        self.f.seek(self.next)


class Held(Source):
    """Bytes in memory."""

    def __init__(self, data: bytes) -> None:
        super().__init__()
        self.held = data

    def more(self, least: int) -> bytes:
        return b""


class Inflated(Source):
    """What the gzip members of ``raw`` hold, inflated window by window."""

    def __init__(self, raw: Source) -> None:
        super().__init__()
        self.raw, self.z = raw, None

    def more(self, least: int) -> bytes:
        while True:
            data = b""
            if self.z is None or self.z.eof:
                data, self.z = self.z.unused_data if self.z else b"", None
            else:
                data = self.z.unconsumed_tail
            if not data:
                data = self.raw.peek(_WINDOW)
                self.raw.skip(len(data))
            if not data and self.z is None:
                return b""
            self.z = self.z or zlib.decompressobj(31)
            out = self.z.decompress(data, max(least, _WINDOW))
            if out:
                return out
            if not data and not self.z.eof:
                raise ValueError("an archive ends inside a gzip member")


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.split = int(options.get("split_bytes", 64 << 20))
        self.rules: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on header columns; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADER_OF and isinstance(f, EqualTo):
                self.rules.append((column, "is", (f.value,)))
            elif column in HEADER_OF and isinstance(f, In):
                self.rules.append((column, "is", tuple(f.value)))
            elif column in HEADER_OF and isinstance(f, StringStartsWith):
                self.rules.append((column, "starts", f.value))
            elif column in HEADER_OF and isinstance(f, IsNotNull):
                self.rules.append((column, "there", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        there = {f.path for f in files}
        out: list[InputPartition] = []
        for f in sorted(files, key=lambda f: f.path):
            if not f.path.endswith((".warc", ".warc.gz")) or not f.size:
                continue
            index = f"{f.path}.offsets"
            if index not in there:
                out.append(Part(f.path))
                continue
            sizes = [int(x) for x in fs.open_input_file(index).read().split()]
            start, at, first = 0, 0, 0
            for k, n in enumerate(sizes):
                at += n
                if at - start >= self.split or k == len(sizes) - 1:
                    out.append(Part(f.path, start, at, tuple(sizes[first : k + 1]) if f.path.endswith(".gz") else ()))
                    start, first = at, k + 1
        return out or [Part("")]

    def wanted(self, row: dict) -> bool:
        for column, how, value in self.rules:
            x = row[column]
            if x is None or how == "is" and x not in value or how == "starts" and not x.startswith(value):
                return False
        return True

    def read(self, part: Part) -> Iterator[tuple]:
        if not part.path:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(part.path) as f:
            raw = Plain(f, part.start)
            if part.sizes:
                yield from self._members(raw, part.sizes)
            elif part.path.endswith(".gz"):
                yield from self._records(Inflated(raw), None)
            else:
                yield from self._records(raw, part.stop)

    def _members(self, raw: Plain, sizes: tuple[int, ...]) -> Iterator[tuple]:
        """Of gzip members of known size, those of wanted records."""
        for n in sizes:
            z = zlib.decompressobj(31)
            start = z.decompress(raw.peek(min(n, _WINDOW)), 4096)
            while (end := start.find(_HEAD_END)) < 0 and z.unconsumed_tail:
                start += z.decompress(z.unconsumed_tail, 4096)
            if end >= 0 and not self.wanted(self._row(parse_head(start[:end]))):
                raw.skip(n)  # the rest stays compressed
            else:
                yield from self._records(Inflated(Held(raw.take(n))), None)

    def _records(self, source: Source, stop: int | None) -> Iterator[tuple]:
        """The wanted records of ``source`` that start before ``stop``."""
        while (stop is None or source.at < stop) and (head := source.head()) is not None:
            fields = parse_head(head)
            row, n = self._row(fields), int(fields["Content-Length"])
            if not self.wanted(row):
                source.skip(n + 4)
                continue
            whole = self.payload and row["record_type"] != "revisit"
            block = source.take(n) if whole else bytes(source.peek(min(n, _WINDOW)))
            source.skip(4 if whole else n + 4)
            yield self._with_block(row, fields, block, n)

    @staticmethod
    def _row(fields: dict[str, str]) -> dict:
        low = {k.lower(): v for k, v in fields.items()}
        row = {c: low.get(h.lower()) for c, h in HEADER_OF.items()}
        for c in ("record_id", "refers_to"):
            if row[c] is not None:
                row[c] = row[c].removeprefix("<").removesuffix(">")
        return row

    def _with_block(self, row: dict, fields: dict[str, str], block: bytes, n: int) -> tuple:
        start, length = 0, n
        if block.startswith(b"HTTP/") and (end := block.find(b"\r\n\r\n")) >= 0:
            start, length = end + 4, n - end - 4
            for line in block[:end].split(b"\r\n"):
                if line.lower().startswith(b"content-length:"):
                    length = int(line[15:])
        payload = block[start:n] if self.payload and row["record_type"] != "revisit" else None
        return (row["record_id"], row["record_type"], row["target_uri"], row["date"], row["refers_to"], row["payload_digest"], length, fields, payload)


class WarcWriter(DataSourceArrowWriter):
    """Each task writes archives under names of its own; the commit gives those of successful tasks their final names and removes what failed attempts left."""

    def __init__(self, options, overwrite: bool):
        self.path, self.gzip, self.job = options["path"], options.get("compression", "none") == "gzip", uuid.uuid4().hex[:12]
        fs, root = filesystem(self.path)
        if overwrite and fs.get_file_info(root).type != pafs.FileType.NotFound:
            fs.delete_dir_contents(root)
        fs.create_dir(root, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        fs, root = filesystem(self.path)
        name = f"{root.rstrip('/')}/part-{self.job}-{uuid.uuid4().hex}.warc{'.gz' if self.gzip else ''}"
        sizes: list[int] = []
        f = None
        for batch in iterator:
            for at in range(0, batch.num_rows, 256):
                for row in batch.slice(at, 256).select(list(WRITE_COLUMNS)).to_pylist():
                    f = f or fs.open_output_stream(f"{name}.tmp")
                    data = record_bytes(row)
                    if self.gzip:
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        data = z.compress(data) + z.flush()
                    f.write(data)
                    sizes.append(len(data))
        if f is None:
            return Done([])
        f.close()
        with fs.open_output_stream(f"{name}.offsets.tmp") as o:
            o.write("\n".join(map(str, sizes)).encode())
        return Done([name, f"{name}.offsets"])

    def commit(self, messages: list[Done | None]) -> None:
        fs, _ = filesystem(self.path)
        names = [n for m in messages if m for n in m.files]
        with ThreadPoolExecutor(_MOVERS) as pool:
            # the archive last: one that is there has its offsets
            for kind in (True, False):
                list(pool.map(lambda n: fs.move(f"{n}.tmp", n), [n for n in names if n.endswith(".offsets") is kind]))
        self._clear()

    def abort(self, messages: list[Done | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Removes this job's unfinished files, those of attempts that no message speaks of among them."""
        fs, root = filesystem(self.path)
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.base_name.startswith(f"part-{self.job}-") and f.base_name.endswith(".tmp"):
                fs.delete_file(f.path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "payload", digest_col: str = "digest", least_bytes: int = 100, broadcast_rows: int = BROADCAST_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Adds ``record_type, first_id``: of rows with equal payloads of ``least_bytes`` or more, the smallest id is a response and others revisit it.

    Payloads are equal if their digests are.  Repeated rows of the smallest id
    are all responses.  A null id revisits the smallest id, if there is one; if
    there is none, and for a null digest or payload, rows are responses.  An
    empty table gives an empty one.  Columns of ``pages`` named like an added
    one are replaced.

    Groups are found on ids, digests and lengths alone.  Only digests of several
    rows come back to the pages: up to ``broadcast_rows`` of them as a broadcast,
    so that no payload is shuffled, beyond by a join in which a digest of
    ``hot_rows`` rows or more is dealt over ``SALTS`` keys.  (There are at most
    a ``hot_rows``-th as many hot digests as rows; they are broadcast if they,
    too, are no more than ``broadcast_rows``, else no digest counts as hot.)
    """
    need(pages, id_col, payload_col, digest_col)
    pages = without(pages, "record_type", "first_id")
    key, first, salt, hot = (free_name(pages, n) for n in ("copied_digest", "smallest_id", "digest_salt", "hot_digest"))
    large = F.octet_length(payload_col) >= least_bytes
    found = pages.where(large & F.col(digest_col).isNotNull()).groupBy(F.col(digest_col).alias(key)).agg(F.min(id_col).alias(first), F.count(F.lit(1)).alias("n"))
    found = save(found.where("n > 1"), "copies")
    same = (F.col(digest_col) == F.col(key)) & large
    if found.count() <= broadcast_rows:
        out = pages.join(F.broadcast(found.drop("n")), same, "left")
    else:
        busy = found.where(F.col("n") >= hot_rows).select(F.col(key).alias(hot))
        if busy.count() > broadcast_rows:
            busy = busy.where("false")
        marked = pages.join(F.broadcast(busy), F.col(digest_col) == F.col(hot), "left")
        marked = marked.withColumn(salt, F.when(F.col(hot).isNotNull(), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).otherwise(0))
        every = F.when(F.col(hot).isNotNull(), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
        found = found.join(F.broadcast(busy), F.col(key) == F.col(hot), "left").select(key, first, F.explode(every).alias("dealt"))
        out = marked.join(found.hint("merge"), same & (F.col(salt) == F.col("dealt")), "left")
    again = F.col(first).isNotNull() & ~F.col(first).eqNullSafe(F.col(id_col))
    return out.select(*[F.col(f"`{c}`") for c in pages.columns], F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col(first)).alias("first_id"))


def write_archives(records: DataFrame, path: str | None = None, compression: str = "none") -> str:
    """Writes rows that hold ``WRITE_COLUMNS`` (others are ignored) and returns the folder."""
    need(records, *WRITE_COLUMNS)
    register(records.sparkSession)
    path = path or new_folder(records.sparkSession, "warc")
    records.select(*WRITE_COLUMNS).write.format("warc").option("compression", compression).mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
