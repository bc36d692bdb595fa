"""Operator 7, WARC archives: a writer with duplicate revisits and a salvage reader.

The writer makes each record a text and lets Spark's text writer end it with two line breaks, so archives go to any
store that Spark can write to. The reader checks each record's version line, length, end mark and digests; after a
failed check it searches for the next valid member or version line, recovers the records after it and reports the byte
gap as a quarantined row.

Plain archives of any size are read by ranges: Spark's text reader cuts them at version marks, so a task holds one record
and its neighbours, not the archive. A payload may hold version marks too, so pieces are put together again by the length
that a header gives, also across ranges; an archive in which a record that reaches into the next range holds whole
records in its payload is read again in order, as one stream. Archives of gzip members cannot be cut before they are inflated: a task takes
one such archive (2 GB at most, the limit of Spark's binary reader) and inflates it member by member.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.llm.common import batch, finished, materialise, new_path, read_table, written

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
MARK = b"WARC/1."
MOST_RECORD = 1 << 30  # bytes that a header may claim; Spark's rows end at 2 GB
LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
    return int(m[1]) if m else None


def record(page_id, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record without its end mark. A revisit keeps the HTTP header, which has the payload's length."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response"]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode("utf-8", "surrogatepass") + END + block


def warc_records(pages: DataFrame, least: int = 0) -> DataFrame:
    """(record string) per row of pages (page_id, url, html; null html: empty).

    Of rows whose payloads are equal and at least `least` bytes, that with the largest page_id is the response and the
    others are revisits to it (of repeated rows of that page_id each is a response); smaller payloads are all responses.
    Only digests are shuffled; pages are joined to the digests that occur more than once. A null page_id never is what
    others refer to unless all are null."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", F.when(F.octet_length(payload) >= least, F.sha1(payload.cast("binary"))).alias("sha"))
    copies = materialise(rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha", "last"), "copies")
    joined = rows.join(copies, "sha", "left").select("page_id", "url", "html", "last")
    schema = pa.schema([("value", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for page_id, url, html, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
                revisit = last is not None and page_id != last
                out.append(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), last, revisit))
            yield batch(schema, pa.array(out, pa.binary()).cast(pa.string()))

    return joined.mapInArrow(run, "value string")


def write_warc(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives of about FILE_BYTES or less in the folder `path`."""
    size = pages.agg(F.avg(F.octet_length(F.coalesce("html", F.lit("")))).alias("mean")).first().mean or 0
    warc_records(pages, least).write.option("lineSep", END.decode()).option("maxRecordsPerFile", max(1, int(FILE_BYTES / (size + 1_000)))).text(path)


def _parse(raw: bytes, at: int) -> tuple[dict, bytes, int] | None:
    """Headers, block and end of the record at a position, or None if a check fails."""
    m = LINE.match(raw, at)
    if not m:
        return None
    stop = raw.find(END, m.end() - 2)
    if stop < 0:
        return None
    head: dict[str, str] = {}
    for line in raw[m.end() : stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if line[:1] in (b" ", b"\t") or not colon:
            return None
        head.setdefault(name.decode("latin-1").strip().lower(), value.decode("utf-8", "replace").strip())
    length = head.get("content-length", "")
    if not length.isdigit() or int(length) > MOST_RECORD:
        return None
    begin = stop + len(END)
    end = begin + int(length)
    if raw[end : end + len(END)] != END:
        return None
    block = raw[begin:end]
    if (digest := head.get("warc-block-digest", "")).startswith("sha1:") and digest[5:] != base32_sha1(block):
        return None
    return head, block, end + len(END)


def salvage(raw: bytes, base: int = 0) -> Iterator[tuple[int, int, dict | None, bytes]]:
    """(start, end, headers or None for a quarantined gap, block) of all records of an archive, in order.

    Positions are those of the file; records of one gzip member share its position."""
    at, gap = 0, None
    while at < len(raw):
        got = None
        if raw.startswith(MEMBER, at):
            unzip, inner, to = zlib.decompressobj(31), [], at
            try:
                while not unzip.eof and to < len(raw):
                    inner.append(unzip.decompress(raw[to : to + 65_536]))
                    to += 65_536
                if unzip.eof:
                    stop = min(to, len(raw)) - len(unzip.unused_data)
                    got = [(at, stop, h, b) for _, _, h, b in salvage(b"".join(inner))]
            except zlib.error:
                pass
        elif found := _parse(raw, at):
            got = [(at, found[2], found[0], found[1])]
        if got:
            if gap is not None:
                yield base + gap, base + at, None, b""
                gap = None
            for start, end, head, block in got:
                yield base + start, base + end, head, block
            at = got[-1][1]
            continue
        if gap is None:
            gap = at
        line, member = LINE.search(raw, at + 1), raw.find(MEMBER, at + 1)
        at = min([x for x in (line.start() if line else -1, member) if x >= 0], default=len(raw))
    if gap is not None:
        yield base + gap, base + len(raw), None, b""


COLUMNS = "path string, start long, end long, status string, warc_type string, record_id string, refers_to string, target_uri string, payload binary, payload_bytes long, payload_digest string"


def http_payload(block: bytes) -> tuple[bytes, int | None]:
    """The body after the HTTP header, and the length that the header gives."""
    head, _, body = block.partition(END)
    m = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
    return body, int(m[1]) if m else None


def _needs(raw: bytes) -> int:
    """Bytes of the record that begins here, as its header claims; 0 if there is no header that may be valid."""
    m = LINE.match(raw)
    stop = raw.find(END, m.end() - 2) if m else -1
    if stop < 0:
        return 0
    length = re.search(rb"(?im)^content-length:[ \t]*(\d{1,12})[ \t]*\r?$", raw[:stop])
    return stop + 2 * len(END) + int(length[1]) if length and int(length[1]) <= MOST_RECORD else 0


def _row(head: dict | None, block: bytes, with_payload: bool) -> tuple:
    if head is None:
        return ("gap", *[None] * 7)
    body, length = http_payload(block) if "application/http" in head.get("content-type", "") else (block, len(block))
    kind, claimed = head.get("warc-type"), head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    own = base32_sha1(body) if kind != "revisit" else claimed
    return ("ok" if claimed in (None, own) else "digest", kind, head.get("warc-record-id"), head.get("warc-refers-to"), head.get("warc-target-uri"), body if with_payload and kind != "revisit" else None, len(body) if kind != "revisit" else length, own)


FIELDS = [("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("status", pa.string()), ("warc_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
RANGED = "path string, split long, place long, piece binary, start long, end long, " + COLUMNS.split(", ", 3)[3]
SIZE, OPEN, LOOSE = "size", "open", "loose"


def _in_range(with_payload: bool):
    """Pieces (path, split, bytes) between version marks, in file order -> rows of RANGED: records and gaps at positions
    relative to the range; pieces at either end that may belong to a neighbouring range (open, loose); and the range's
    size."""
    schema = pa.schema([("path", pa.string()), ("split", pa.int64()), ("place", pa.int64()), ("piece", pa.binary()), *FIELDS[1:]])

    def run(batches):
        now, at, number, first, out = None, 0, 0, True, []
        held, size, need = deque(), 0, None  # (position, bytes) that may still become one record, their size, what the first claims

        def settle():
            """Records of the held pieces: those complete go, and so does a first piece that cannot become one.

            What the first piece needs is found once, and the pieces of a record are joined once."""
            nonlocal size, need, first
            while held:
                need = _needs(held[0][1]) if need is None else need
                if need > size:
                    return
                start = held[0][0]
                if need:
                    parts, n = [], 0
                    for _, x in held:
                        parts.append(x)
                        n += len(x)
                        if n >= need:
                            break
                    whole = b"".join(parts)
                    if got := _parse(whole, 0):
                        out.append((*now, start, None, start, start + got[2], *_row(got[0], got[1], with_payload)))
                        if got[2] < n:  # bytes before the next mark
                            out.append((*now, start, None, start + got[2], start + n, "gap", *[None] * 7))
                        for _ in parts:
                            held.popleft()
                        size, need, first = size - n, None, False
                        continue
                raw = held.popleft()[1]
                size, need = size - len(raw), None
                if raw:
                    loose = first and now[1] > 0
                    out.append((*now, start, raw if loose else None, start, start + len(raw), LOOSE if loose else "gap", *[None] * 7))

        def close():
            nonlocal size, need
            if now is not None:
                settle()
                claim = (_needs(held[0][1]) if need is None else need) if held else 0
                out.extend((*now, p, x, p, p + len(x), OPEN, *[None] * 5, claim, None) for p, x in held)
                out.append((*now, at, None, 0, at, SIZE, *[None] * 7))
                held.clear()
                size, need = 0, None

        for b in batches:
            for path, split, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if (path, split) != now:
                    close()
                    now, at, number, first = (path, split), 0, 0, True
                raw = raw.as_py()
                raw = raw if not number and not split else MARK + raw  # a range after the first begins behind a mark
                held.append((at, raw))
                at, number, size = at + len(raw), number + 1, size + len(raw)
                settle()
                if len(out) >= 500:
                    yield batch(schema, *zip(*out, strict=True))
                    out = []
        close()
        if out:
            yield batch(schema, *zip(*out, strict=True))

    return run


def read_warc(spark: SparkSession, path: str, with_payload: bool = True, compressed: bool = False, glob: str = "part-*") -> DataFrame:
    """All records and quarantined gaps of the archives at path (compressed: archives of gzip members).

    status: ok, digest (the payload differs from its digest) or gap (bytes start to end hold no valid record; all other
    columns are null). Empty archives give no row."""
    schema = pa.schema(FIELDS)

    def whole(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for start, end, head, block in salvage(raw.as_py()):
                    rows.append((name, start, end, *_row(head, block, with_payload)))
                    if len(rows) >= 500:
                        yield batch(schema, *zip(*rows, strict=True))
                        rows = []
                if rows:
                    yield batch(schema, *zip(*rows, strict=True))

    if compressed:
        return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content").mapInArrow(whole, COLUMNS)

    def stitched(batches):
        """Pieces at the ends of ranges, sorted by path and position: runs without a hole are one text."""
        name, start, end, held = None, 0, 0, []
        for b in batches:
            for path, at, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (path != name or at != end):
                    yield from whole_of(name, start, b"".join(held))
                    held = []
                if not held:
                    name, start = path, at
                held.append(raw)
                end = at + len(raw)
        if held:
            yield from whole_of(name, start, b"".join(held))

    def whole_of(name, start, raw):
        rows = [(name, x, y, *_row(head, block, with_payload)) for x, y, head, block in salvage(raw, start)]
        if rows:
            yield batch(schema, *zip(*rows, strict=True))

    pieces = spark.read.option("lineSep", MARK.decode()).option("pathGlobFilter", glob).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("raw"))
    table = materialise(pieces.mapInArrow(_in_range(with_payload), RANGED), "records")
    sizes = table.where(F.col("status") == SIZE).select("path", "split", (F.sum("end").over(Window.partitionBy("path").orderBy("split")) - F.col("end")).alias("base"))  # one row a range
    placed = table.where(F.col("status") != SIZE).join(sizes, ["path", "split"]).withColumns({"start": F.col("start") + F.col("base"), "end": F.col("end") + F.col("base")})
    at_ends = F.col("status").isin(OPEN, LOOSE)
    claims = placed.where(F.col("status") == OPEN).groupBy("path", "split").agg(F.min("start").alias("low"), (F.min("start") + F.max("payload_bytes")).alias("high"))
    inside = (F.col("start") > F.col("low")) & (F.col("start") < F.col("high"))
    again = materialise(placed.where(~at_ends).select("path", "start").join(claims.drop("split"), "path").where(inside).select("path").distinct(), "again")
    placed = placed.join(again, "path", "left_anti")
    ends = placed.where(at_ends).select("path", "start", "piece").repartition("path").sortWithinPartitions("path", "start")
    names = [n for n, _ in FIELDS]
    found = placed.where(~at_ends).select(*names).unionByName(ends.mapInArrow(stitched, COLUMNS))
    if again.isEmpty():
        return found
    in_order = pieces.mapInArrow(_numbered, "path string, split long, raw binary, number long").join(again, "path", "left_semi")
    streams = in_order.repartition("path").sortWithinPartitions("path", "split", "number").select("path", F.lit(0).cast("long").alias("split"), "raw").mapInArrow(_in_range(with_payload), RANGED)
    rest = streams.where(F.col("status") == OPEN).select("path", "start", "piece").repartition("path").sortWithinPartitions("path", "start").mapInArrow(stitched, COLUMNS)
    return found.unionByName(streams.where((F.col("status") != SIZE) & (F.col("status") != OPEN)).select(*names)).unionByName(rest)


def _numbered(batches):
    """Pieces (path, split, raw) with their number within the range."""
    now, number = None, 0
    for b in batches:
        numbers = []
        for own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            now, number = own, number + 1 if own == now else 0
            numbers.append(number)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=["path", "split", "raw", "number"])


def op7_warc(spark, sf_dir):
    """One row per page, as read back. Repeated pages with the largest page_id of their payload are responses each."""
    before, path = written(), new_path(spark, "warc")
    write_warc(read_table(spark, sf_dir, "pages"), path)
    rows = read_warc(spark, path, with_payload=False).where("status = 'ok'")
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    digits = lambda c: F.when(number(c) != "", number(c).cast("long"))
    found = rows.select(digits("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), digits("refers_to").alias("refers_to"))
    return finished(found, "pages", before)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last, count(*) AS n FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.h, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '') AS payload_digest,
  CASE WHEN g.n > 1 AND page_id <> g.last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN g.n > 1 AND page_id <> g.last THEN g.last END AS refers_to
FROM p JOIN g ON p.h = g.h
"""
