"""WARC writer with Zstandard dictionaries, and its reader.

An archive (.warc.zst) starts with a skippable frame that holds the dictionary; every record is a frame of its own,
compressed with that dictionary, so any record can be read alone. The dictionary is trained on all records of its
archive, be they few: a single record is enough. Archives are closed at ``archive_bytes`` of uncompressed records, which bounds a task's memory.

Payloads that occur more than once are archived once: the group of a payload is found by its SHA-256 (a salted join, so a
payload that makes up a third of the table is spread), one record of it is a response and the others are revisits that
refer to it. Archives are written to a folder that all executors share, first under the task attempt's own name and then
renamed, so a retried or speculative task leaves whole files only.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.common import cut, hidden, salt, salts, shared_dir

if TYPE_CHECKING:
    import zstandard

#: Magic number of the skippable frame for dictionaries, and of dictionaries themselves. Fixed values.
SKIPPABLE = 0x184D2A5D
DICTIONARY = b"\x37\xa4\x30\xec"

VERSION = "WARC/1.1"
DATE = "1970-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "pages")


def record_id(page: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def digest(payload: bytes) -> str:
    """Base32 of SHA-1, the usual digest of WARC records."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, page: object) -> str:
    if not url:
        return f"urn:page:{page}"
    return "".join(c if 0x21 <= ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page: object, url: str | None, payload: bytes, refers_to: object = None, revisit: bool = False) -> bytes:
    """One WARC record. A revisit holds the HTTP head only; both kinds state length and digest of the whole payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Target-URI", _uri(url, page)),
        ("WARC-Date", DATE),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("X-Page-Id", "" if page is None else str(page)),
        ("X-Payload-Length", str(len(payload))),
    ]
    if revisit:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-Id", "" if refers_to is None else str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION.encode() + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes | None]:
    """A record's fields and its payload (None for a revisit); raises ValueError if length or digest don't agree."""
    top, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != VERSION or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if fields["WARC-Type"] == "revisit":
        return fields, None
    payload = block.partition(b"\r\n\r\n")[2]
    if len(payload) != int(fields["X-Payload-Length"]) or "sha1:" + digest(payload) != fields["WARC-Payload-Digest"]:
        raise ValueError("payload and digest differ")
    return fields, payload


def train(records: Sequence[bytes], size: int) -> zstandard.ZstdCompressionDict:
    """A dictionary of at most ``size`` bytes, or 256, from all the records; records too few to train on are cut up and repeated."""
    import zstandard as z

    total = sum(map(len, records))
    if len(records) >= 8:
        with contextlib.suppress(z.ZstdError):
            return z.train_dictionary(max(256, min(size, total // 8)), records, k=256, d=8)
    pieces = [r[i : i + 64] for r in records for i in range(0, len(r), 64)]
    return z.train_dictionary(max(256, min(size, total // 2)), pieces * max(16, 1 + 4096 // max(1, total)), k=256, d=8)


def archive(records: Sequence[bytes], dictionary_bytes: int = 1 << 16, level: int = 3) -> bytes:
    """The records as one .warc.zst archive: the dictionary in a skippable frame, then a frame for each record. No records give no bytes."""
    import zstandard as z

    if not records:
        return b""
    trained = train(records, dictionary_bytes)
    data = z.ZstdCompressor(level=level).compress(trained.as_bytes())
    packer = z.ZstdCompressor(level=level, dict_data=trained)
    return b"".join([SKIPPABLE.to_bytes(4, "little") + len(data).to_bytes(4, "little") + data, *map(packer.compress, records)])


def records_of(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one by one; each is fed in windows, so that what follows it is hardly copied."""
    import zstandard as z

    known, at = None, 0
    if data[:4] == SKIPPABLE.to_bytes(4, "little"):
        at = 8 + int.from_bytes(data[4:8], "little")
        frame = data[8:at]
        known = z.ZstdCompressionDict(frame if frame[:4] == DICTIONARY else z.ZstdDecompressor().decompress(frame))
    view = memoryview(data)
    unpacker = z.ZstdDecompressor(dict_data=known) if known is not None else z.ZstdDecompressor()
    while at < len(data):
        one, parts, window = unpacker.decompressobj(), [], 1024
        while not one.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(view[at : at + window]))
            at += len(view[at : at + window]) - len(one.unused_data)
            window = min(2 * window, 1 << 20)
        yield b"".join(parts)


def with_referents(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """_page, _url, _html (never null), _keep (the id of the response of its group) and _revisit for each page."""
    base = hidden(pages, [id_col, url_col, html_col]).select(F.col(f"`{id_col}`").alias("_page"), F.col(f"`{url_col}`").alias("_url"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("_html"))
    base = base.withColumn("_h", F.sha2("_html", 256)).withColumn("_s", salt(salts(pages), F.col("_page"), F.col("_url")))
    groups = base.groupBy("_h", "_s").agg(F.max("_page").alias("_m"))
    groups = groups.select("_h", "_s", F.max("_m").over(Window.partitionBy("_h")).alias("_keep"))
    joined = base.join(groups, ["_h", "_s"])
    revisit = ~F.col("_page").eqNullSafe(F.col("_keep")) & (F.octet_length("_html") >= min_bytes)
    return joined.select("_page", "_url", "_html", "_keep", revisit.alias("_revisit"))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = 8 << 20) -> DataFrame:
    """Write the pages as archives into ``folder``; the manifest: path, n_records, n_bytes per archive.

    Null html is an empty payload. Of payloads of at least ``min_bytes`` bytes that are equal, the page with the largest
    id is the response (all rows with that id, if it is repeated) and the others are revisits; smaller payloads are all
    responses. Null ids are archived with an empty id, and are the response only where no page of the group has an id.
    A null or empty url becomes a urn. Ids may be of any type that has an order and a text without line ends. No pages give no archives.
    Extra columns are ignored.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        store.create_dir(root, recursive=True)
        count = 0

        def close(records: list[bytes]) -> pa.RecordBatch:
            nonlocal count
            name = f"{root}/pages-{task.partitionId():06d}-{count:04d}.warc.zst"
            count += 1
            own = f"{name}.{task.taskAttemptId()}.tmp"
            data = archive(records)
            with store.open_output_stream(own, compression=None) as f:
                f.write(data)
            store.move(own, name)
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": pa.array([len(records)], pa.int64()), "n_bytes": pa.array([len(data)], pa.int64())})

        records: list[bytes] = []
        held = 0
        for batch in batches:
            for page, url, html, keep, revisit in zip(*[c if i != 2 else c.cast(pa.binary()) for i, c in enumerate(batch.columns)], strict=True):
                records.append(record(page.as_py(), url.as_py(), html.as_py(), keep.as_py() if revisit.as_py() else None, revisit.as_py()))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield close(records)
                    records, held = [], 0
        if records:
            yield close(records)

    return cut(with_referents(pages, id_col, url_col, html_col, min_bytes).mapInArrow(write, "path string, n_records bigint, n_bytes bigint"))


def read_warc(manifest: DataFrame, folder: str, id_type: str = "bigint") -> DataFrame:
    """The records of the manifest's archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload.

    Ids are text in archives; ``id_type`` is the type that they get.
    """
    schema = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, url string, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as f:
                    data = f.read()
                yield table(map(parse, records_of(data)))

    def table(found: Iterable[tuple[dict[str, str], bytes | None]]) -> pa.RecordBatch:
        rows = [(f["X-Page-Id"] or None, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], f.get("X-Refers-To-Page-Id") or None, f["WARC-Target-URI"], p) for f, p in found]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    files = manifest.select("path")
    found = files.repartition(max(1, min(10_000, manifest.count())), "path").mapInArrow(read, schema)
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def new_folder(pages: DataFrame) -> str:
    """A fresh folder for archives in the shared folder."""
    return f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
