"""WARC archives with a two-level capture index.

Writing.  Records go into gzip members of archive files in the shared folder,
one file a task; among records with equal payloads the one with the smallest id
is a response and the others are revisits of it.  The capture lines (key, id,
file, offset, length) come back as rows, so a file of a task that was run twice
is an orphan that nothing points to.

Index.  Lines are range-partitioned by key (the host reversed, then the rest of
the URL) and id, packed in compressed blocks of ``BLOCK_LINES`` lines, and a
sparse directory keeps the first and last key and the place of each block, in
key order.  A lookup searches the directory by bisection, reads that block with
one range read, searches its lines by bisection, and reads each record captured
under the key and id with another.  A task reads no more of the directory than
its keys span, a batch of them at a time.

Files are reached through pyarrow's file systems (file, hdfs, s3, gs by the
scheme of ``spark.checkpoint.dir``), so driver and executors share only that
folder.

Edge cases: null html is an empty payload; a null URL has the key of the empty
URL and no target; a null id sorts behind all others and comes back as null;
rows repeated under one URL and id are separate records, each read back, whether
their payloads are equal or not; of equal payloads all of the smallest id are
responses; texts of any length are whole; further columns are ignored, whatever
their names; an empty table gives no files and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.common import scratch

BLOCK_LINES = 512
LINES = "key string, nameless int, page_id long, file string, at long, length long"
DIRECTORY = "key string, nameless int, page_id long, last_key string, last_nameless int, last_id long, file string, at long, length long"
Capture = tuple[str, int, int]  # key, 1 for a null id, id or 0
OUT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def file_system(path: str):
    """The file system of a path or URI, and the path on it."""
    import pyarrow.fs as fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def url_key(url: Column) -> Column:
    """Reversed host, ")", then path and query: sorts a site's captures together."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(url, r"^[^:/?#]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    tail = F.regexp_replace(rest, r"^[^/?#]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def named(column: str) -> list[Column]:
    """nameless and page_id: a null id as 1 and 0."""
    return [F.col(column).isNull().cast("int").alias("nameless"), F.coalesce(F.col(column).cast("long"), F.lit(0)).alias("page_id")]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, unique: str = "") -> bytes:
    """One WARC record as a gzip member."""
    body = b"" if refers_to is not None else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}{unique}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        head += [f"X-Payload-Length: {len(payload)}"]
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and content of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length disagrees with its header")
    return headers, rest[:n]


def _name(kind: str) -> str:
    context = TaskContext.get()
    return f"{kind}-{context.partitionId():05d}-{uuid.uuid4().hex[:12]}"


def write_archives(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the records; the capture lines, read back from the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        name, out, at = f"{_name('part')}.warc.gz", None, 0
        for batch in batches:
            rows = []
            for key, nameless, page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    fs.create_dir(f"{base}/archive", recursive=True)
                    out = fs.open_output_stream(f"{base}/archive/{name}", compression=None)
                payload = html.encode()
                own = None if nameless else page_id
                refers_to = None if first == own or len(payload) < least else first
                # a response is named by its id, so that revisits can refer to it
                member = record(own, url, payload, digest_of(payload), refers_to, "" if refers_to is None else f":{name}:{at}")
                out.write(member)
                rows.append((key, nameless, page_id, f"archive/{name}", at, len(member)))
                at += len(member)
            yield _batch(rows, LINES)
        if out is not None:
            out.close()

    body = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(*named(id_col), F.col(url_col).alias("url"), body.alias("html"))
    # equal payloads: the same SHA-256; combined before the shuffle
    keyed = rows.withColumn("sha", F.sha2(F.col("html").cast("binary"), 256))
    firsts = keyed.groupBy("sha").agg(F.min(F.when(F.col("nameless") == 0, F.col("page_id"))).alias("first"))
    chosen = keyed.join(firsts, "sha").select(url_key(F.col("url")).alias("key"), "nameless", "page_id", "url", "html", "first")
    chosen.mapInArrow(run, LINES).write.parquet(f"{root}/lines")
    return pages.sparkSession.read.parquet(f"{root}/lines")


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ddl.split(", ")])
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _quoted(key: str) -> str:
    return key.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")


def write_index(lines: DataFrame, root: str) -> DataFrame:
    """Compressed blocks of sorted lines; the directory, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(root)
        name, out, at = f"{_name('cdx')}.gz", None, 0
        held: list[tuple] = []

        def block() -> tuple:
            nonlocal out, at
            if out is None:
                fs.create_dir(f"{base}/index", recursive=True)
                out = fs.open_output_stream(f"{base}/index/{name}", compression=None)
            data = zlib.compress("\n".join("\t".join((_quoted(k), *map(str, rest))) for k, *rest in held).encode(), 6)
            out.write(data)
            entry = (*held[0][:3], *held[-1][:3], f"index/{name}", at, len(data))
            at += len(data)
            held.clear()
            return entry

        for batch in batches:
            entries = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                if len(held) == BLOCK_LINES:
                    entries.append(block())
            yield _batch(entries, DIRECTORY)
        if held:
            yield _batch([block()], DIRECTORY)
        if out is not None:
            out.close()

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "nameless", "page_id"]
    ordered = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(run, DIRECTORY).write.parquet(f"{root}/directory")
    return lines.sparkSession.read.parquet(f"{root}/directory")


class Reader:
    """Lookups through the two levels; one lives in a task."""

    def __init__(self, root: str):
        self.fs, self.base = file_system(root)
        self.firsts: list[Capture] = []
        self.places: list[tuple[str, int, int]] = []
        self.files: dict[str, object] = {}
        self.block: tuple[tuple, list[Capture], list] = ((), [], [])

    def open(self, first: str = "", last: str | None = None) -> Reader:
        """Reads the part of the sparse directory whose blocks may hold keys from ``first`` to ``last``."""
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        wanted = pc.field("last_key") >= first
        if last is not None:
            wanted &= pc.field("key") <= last
        table = ds.dataset(f"{self.base}/directory", filesystem=self.fs, format="parquet").to_table(filter=wanted)
        entries = sorted(zip(*(table.column(c).to_pylist() for c in ("key", "nameless", "page_id", "file", "at", "length")), strict=True))
        self.firsts, self.places = [e[:3] for e in entries], [e[3:] for e in entries]
        return self

    def range(self, name: str, at: int, length: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.files[name].read_at(length, at)

    def lines(self, k: int) -> tuple[list[Capture], list]:
        """Captures and places of a block."""
        if self.block[0] != self.places[k]:
            rows = [x.split("\t") for x in zlib.decompress(self.range(*self.places[k])).decode().split("\n")]
            self.block = (self.places[k], [(_unquoted(x[0]), int(x[1]), int(x[2])) for x in rows], [(x[3], int(x[4]), int(x[5])) for x in rows])
        return self.block[1:]

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[dict[str, str], bytes]]:
        """The records captured under a key and id; they may go on in the next blocks."""
        wanted = (key, int(page_id is None), page_id or 0)
        k = max(0, bisect_left(self.firsts, wanted) - 1)
        while k < len(self.firsts) and self.firsts[k] <= wanted:
            captures, places = self.lines(k)
            for j in range(bisect_left(captures, wanted), bisect_right(captures, wanted)):
                yield parse(self.range(*places[j]))
            k += 1


def _unquoted(text: str) -> str:
    if "\\" not in text:
        return text
    out, k, plain = io.StringIO(), 0, {"t": "\t", "n": "\n", "r": "\r", "\\": "\\"}
    while k < len(text):
        if text[k] == "\\":
            k += 1
            out.write(plain[text[k]])
        else:
            out.write(text[k])
        k += 1
    return out.getvalue()


def captured(headers: dict[str, str], content: bytes) -> tuple[int, str, str, int | None]:
    """payload_bytes, payload_digest, record_type and refers_to of a record read back."""
    kind, told = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "revisit":
        return int(headers["x-payload-length"]), told, kind, int(headers["warc-refers-to"].rpartition(":")[2].rstrip(">"))
    if (real := digest_of(content)) != told:
        raise ValueError(f"a payload's digest is {real}, its header says {told}")
    return len(content), real, kind, None


def read_back(pages: DataFrame, root: str, *, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Every capture of the URLs and ids of ``pages``, looked up in the archives below ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(root)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0)
            reader.open(keys[0].as_py(), keys[batch.num_rows - 1].as_py())
            rows = []
            for key, nameless, page_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, found = None if nameless else page_id, 0
                for found, record in enumerate(reader.find(key, own), 1):
                    rows.append((own, *captured(*record)))
                    if len(rows) == 10_000:
                        yield _batch(rows, OUT)
                        rows = []
                if not found:
                    raise ValueError(f"page {own} isn't in the index")
            yield _batch(rows, OUT)

    order = ["key", "nameless", "page_id"]
    wanted = pages.select(url_key(F.col(url_col)).alias("key"), *named(id_col)).distinct()
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # in key order, so a task reads each block once
    return wanted.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, OUT)


def archive(pages: DataFrame, root: str | None = None, *, least: int = 0) -> DataFrame:
    """Writes the pages as WARC records, indexes them, and reads every one back."""
    root = root or scratch(pages.sparkSession, "warc")
    write_index(write_archives(pages, root, least=least), root)
    return read_back(pages, root)
