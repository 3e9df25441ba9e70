"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Each record is a gzip member of its own. A record's block is checked against WARC-Payload-Digest (or the digest of the
payload for revisits, which carry none). The reader goes from member to member; where a check fails (bad gzip member,
bad checksum, bad version line, header or digest) it searches the bytes for the next place that starts a valid record
- a gzip member that opens with a version line, or a bare version line in an uncompressed archive -, goes on there,
and reports the bytes between as a quarantined gap. Inside a member with several records it does the same, and what a
damaged member gives before the damage is kept.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.batches import filesystem, map_batches, partitions, shared_output
from webloom.session import written

VERSION = b"WARC/1.1"
GZIP_MAGIC = b"\x1f\x8b\x08"
# Fixed values of the WARC format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 32 << 20  # an archive is closed when it is larger
FEED_BYTES = 1 << 14
FLUSH_BYTES = 8 << 20  # payloads per batch of result rows


def digest(payload: bytes) -> str:
    """Base32 SHA-1, upper case, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{salt}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {v}".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def one_line(text: str | None) -> str:
    """A header value: line ends and other controls are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text or "")


class BadRecord(Exception):
    pass


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (lower-case names), block and end of the record at `at`; raises BadRecord.

    Lines are read one by one, so what is no record ends at its first line that is no header.
    """
    if not data.startswith((b"WARC/1.0\r\n", b"WARC/1.1\r\n"), at):
        raise BadRecord("no version line")
    headers, begin = {}, at + 10
    while (end := data.find(b"\r\n", begin)) != begin:
        line = data[begin:end] if end > 0 else b""
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("headers without an end" if end < 0 else "a header without a colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        begin = end + 2
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise BadRecord("no content length")
    begin += 2
    stop = begin + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("the block does not end where its length says")
    block = data[begin:stop]
    stated = headers.get("warc-payload-digest")
    if stated and headers.get("warc-type") != "revisit" and not agrees(stated, payload_of(headers, block)):
        raise BadRecord("the payload digest differs")
    return headers, block, stop + 4


def agrees(stated: str, payload: bytes) -> bool:
    """Whether a stated digest (`algorithm:value`, in base32 or hexadecimal) is that of the payload; one that cannot be
    computed here proves nothing and is accepted. A bare value is taken for SHA-1."""
    name, colon, value = stated.rpartition(":")
    name = name.strip().lower().replace("-", "") if colon else "sha1"
    if name not in hashlib.algorithms_guaranteed or name.startswith("shake"):
        return True
    found = hashlib.new(name, payload, usedforsecurity=False).digest()
    value = value.strip()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP headers, if it has some."""
    if headers.get("content-type", "").replace(" ", "").startswith("application/http;"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_member(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at `at` decompresses to, and its end; of a damaged one what precedes the damage, None and
    the reason."""
    unpack, parts, step = zlib.decompressobj(31), [], FEED_BYTES
    while not unpack.eof:
        if at >= len(data):
            return b"".join(parts), None, "the member is cut off"
        before, piece = unpack.copy(), data[at : at + step]
        try:
            parts.append(unpack.decompress(piece))
        except zlib.error as error:
            if step == 1:
                return b"".join(parts), None, str(error)
            unpack, step = before, 1  # byte by byte up to the damage
            continue
        at += len(piece)
    return b"".join(parts), at - len(unpack.unused_data), ""


def read_records(plain: bytes) -> Iterator[tuple[int, int, tuple[dict[str, str], bytes] | str]]:
    """What the content of a member holds, in order: start, end and (headers, block), or a reason where bytes are lost."""
    at, gap, why = 0, None, ""
    while at < len(plain):
        try:
            headers, block, end = parse(plain, at)
        except BadRecord as error:
            if gap is None:
                gap, why = at, str(error)
            at = plain.find(b"WARC/1.", at + 1)
            at = len(plain) if at < 0 else at
            continue
        if gap is not None:
            yield gap, at, why
            gap = None
        yield at, end, (headers, block)
        at = end
    if gap is not None:
        yield gap, len(plain), why


def next_start(data: bytes, at: int) -> int:
    """The next place from `at` that may start a record, or the end of the data."""
    places = [p for p in (data.find(GZIP_MAGIC, at), data.find(b"WARC/1.", at)) if p >= 0]
    return min(places, default=len(data))


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | None, bytes, str]]:
    """All that an archive holds, in order: ("record", start, end, headers, block, "") and quarantined
    ("gap", start, end, None, b"", reason).

    A valid place is one whose record passes all checks. Of a gzip member with several records, damaged ones are left out
    and the others kept; the member's place stands for all of them, and the reason says which bytes of its content are
    lost. Of a member that is cut off or fails its checksum the records before the damage are kept, and the gap spans from
    its start to the next valid place. Empty input gives nothing.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        found: list[tuple[int, int, tuple[dict[str, str], bytes] | str]] = []
        if data.startswith(GZIP_MAGIC, at):
            plain, end, reason = read_member(data, at)
            found = list(read_records(plain))
            if not any(isinstance(what, tuple) for _, _, what in found):
                end, reason = None, reason or (found[0][2] if found else "an empty member")
        else:
            try:
                headers, block, end = parse(data, at)
                found, reason = [(at, end, (headers, block))], ""
            except BadRecord as error:
                end, reason = None, str(error)
        records = [what for _, _, what in found if isinstance(what, tuple)]
        if gap is not None and (end is not None or records):
            yield "gap", gap, at, None, b"", why
            gap = None
        if end is None and gap is None:
            gap, why = at, reason
        for first, last, what in found if end is not None else ():
            if isinstance(what, str):
                yield "gap", at, end, None, b"", f"bytes {first} to {last} of the member: {what}"
            else:
                yield "record", at, end, *what, ""
        if end is None:
            for headers, block in records:
                yield "record", at, at, headers, block, ""
        at = next_start(data, at + 1) if end is None else end
    if gap is not None:
        yield "gap", gap, len(data), None, b"", why


def with_originals(rows: DataFrame, least: int) -> DataFrame:
    """`rows` (id, url, payload) and refers_to: the largest id among equal payloads of at least `least` bytes, null for
    itself. Digests alone are grouped and joined, pre-aggregated per task; payloads move once, by id.
    """
    keyed = rows.filter((F.octet_length("payload") >= least) & F.col("id").isNotNull())
    keyed = written(keyed.select("id", F.unhex(F.sha1("payload")).alias("key")), "warc-keys")
    last = keyed.groupBy("key").agg(F.max("id").alias("refers_to"))
    links = keyed.join(last, "key").filter(F.col("id") != F.col("refers_to"))
    links = links.groupBy("id", "key").agg(F.first("refers_to").alias("refers_to"))
    return (
        rows.withColumn("key", F.unhex(F.sha1("payload")))
        .join(links, ["id", "key"], "left")
        .select("id", "url", "payload", F.when(F.octet_length("payload") >= least, F.col("refers_to")).alias("refers_to"))
    )


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The WARC record of a page: a response with HTTP headers, or a revisit without a block."""
    sha = digest(payload)
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        headers.append(("Page-Id", str(page_id)))
    if refers_to is not None:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE),
            ("WARC-Refers-To", record_id(refers_to)),
            ("Refers-To-Page-Id", str(refers_to)),
        ]
        return record(headers, b"")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    headers.append(("Content-Type", "application/http;msgtype=response"))
    return record(headers, http.encode() + payload)


def write_archives(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
                   least_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write one record per row below the shared folder; returns the manifest (path, n_records, n_bytes).

    Of rows with equal payloads of at least `least_bytes` bytes the one with the largest id is a response, the others
    are revisits of it; smaller payloads are all responses. A null payload is empty; a row without an id is a response;
    repeated rows with the largest id are all responses. File names are new per attempt; the manifest names the files
    that count. An empty table gives an empty manifest.
    """
    folder = shared_output(pages.sparkSession, "warc")
    rows = pages.select(
        pages[id_col].cast("long").alias("id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"),
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sink, path, count, size = None, "", 0, 0
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("id", "url", "payload", "refers_to"))
            for key, url, payload, refers in zip(*columns):
                if sink is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    system, place = filesystem(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    sink, count, size = system.open_output_stream(place, compression=None), 0, 0
                data = member(page_record(key, url, payload.encode(), refers), level)
                sink.write(data)
                count, size = count + 1, size + len(data)
                if size >= ROLL_BYTES:
                    sink.close()
                    sink = None
                    yield {"path": [path], "n_records": [count], "n_bytes": [size]}
        if sink is not None:
            sink.close()
            yield {"path": [path], "n_records": [count], "n_bytes": [size]}

    schema = "path string, n_records long, n_bytes long"
    return written(map_batches(with_originals(rows, least_bytes), work, schema), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """All records and gaps of the archives named in `path`, one archive in memory at a time.

    Returns kind (record or gap), path, start, end (bytes of the archive), reason (of a gap), record_type, url,
    page_id, refers_to, payload_bytes, payload_digest (of the full payload; a revisit states both) and payload (null
    for revisits and gaps).
    """
    spread = manifest.select("path").repartition(max(1, partitions(manifest)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("kind", "path", "start", "end", "reason", "record_type", "url", "page_id", "refers_to",
                 "payload_bytes", "payload_digest", "payload")
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, place = filesystem(path)
                with system.open_input_stream(place, compression=None) as source:
                    data = source.read()
                out: dict[str, list] = {n: [] for n in names}
                held = 0
                for kind, start, end, headers, block, why in salvage(data):
                    row = dict.fromkeys(names) | {"kind": kind, "path": path, "start": start, "end": end}
                    if headers is None:
                        row["reason"] = why
                    else:
                        row |= {"record_type": headers.get("warc-type"), "url": headers.get("warc-target-uri")}
                        row |= {k: as_number(headers.get(h)) for k, h in (("page_id", "page-id"), ("refers_to", "refers-to-page-id"))}
                        if row["record_type"] == "revisit":
                            row["payload_bytes"] = as_number(headers.get("payload-length"))
                            row["payload_digest"] = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        else:
                            payload = payload_of(headers, block)
                            row |= {"payload_bytes": len(payload), "payload_digest": digest(payload)}
                            row["payload"] = payload
                            held += len(payload)
                    for n in names:
                        out[n].append(row[n])
                    if held >= FLUSH_BYTES:
                        yield out
                        out, held = {n: [] for n in names}, 0
                yield out

    schema = (
        "kind string, path string, start long, end long, reason string, record_type string, url string, page_id long, "
        "refers_to long, payload_bytes long, payload_digest string, payload binary"
    )
    return map_batches(spread, work, schema)


def as_number(text: str | None) -> int | None:
    return int(text) if text and text.removeprefix("-").isdigit() and text.isascii() else None
