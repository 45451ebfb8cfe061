"""Operator 13: WARC archives written and read by Spark; segments are put together again.

Writing (expressions only): a page becomes a response record whose HTTP message
is framed in chunks.  Of pages with equal payloads of at least `least` bytes the
one with the largest page_id is the response, and the others are revisits that
name its payload's digest.  A block longer than `segment` bytes is cut: the first
part is the record itself, the others are continuation records that name it as
their origin, with their numbers and, in the last, the whole length.  Records go
through Spark's text writer (gzip), so a lost executor's files are written again
and nothing half-written is ever seen; a file holds at most `per_file` records of
at most `segment` bytes, however many pages a task has.

Reading: Spark lists and reads the files (any store that it can read), each is
parsed as a stream.  Records with a segment number are grouped by their origin,
put in the order of their numbers and checked against the total length; then
chunks are unframed.  A revisit takes the length of the response with its digest.

Which page is the response is decided on digests alone, before any page moves.
Digests that more than a thousandth of all pages have are at most a thousand;
they are broadcast, and only the others are joined by digest, so that a payload
that a third of the pages share stays spread.

Defined results: a null html is the empty payload; rows that repeat the largest
page_id with its payload are all responses; a null page_id is smaller than any,
and of payloads without any page_id all are responses; line breaks in a url are
written %0D and %0A, a null url isn't written.  Other columns aren't read.  No
pages: no rows.  Reading never drops a record: what can't be read is returned
with its `problem` (segments missing or repeated, a total length that differs or
is missing, broken chunks, a digest that differs, a record cut short; after a
place that is no record the rest of that file is one such row).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

#: Payload bytes from which equal ones are written once; bytes of a chunk and of a segment; records of a file.
LEAST, CHUNK, SEGMENT, PER_FILE = 0, 4096, 16_384, 8192
#: A digest that more than 1 / SHARE of the rows have is hot: there are at most SHARE of these.
SHARE = 1000
FIELDS = "path string, position long, headers map<string, string>, block binary, problem string"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def base32(hex40: Column) -> Column:
    """The base32 of a SHA-1 in hexadecimal: each 5 hexadecimal digits are 4 of base 32."""
    four = lambda k: F.lpad(F.conv(F.substring(hex40, 5 * k + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*map(four, range(8))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def spread_join(rows: DataFrame, facts: DataFrame, key: str, own: list[Column]) -> DataFrame:
    """rows left-joined by key to facts, which has a row a key with `n`, how many of the rows have it; own: columns by which rows of a hot key are dealt out."""
    total = facts.agg(F.sum("n")).first()[0] or 0
    names = [c for c in facts.columns if c not in (key, "n")]
    hot = facts.filter(F.col("n") * SHARE > total).select(key, *[F.col(c).alias(f"_{c}") for c in names], F.lit(1).alias("_hot"))
    rest = facts.filter(F.col("n") * SHARE <= total).drop("n").withColumn("_apart", F.lit(0).cast("long"))
    # hot rows match nothing in the second join; own columns spread them
    out = rows.join(F.broadcast(hot), key, "left").withColumn("_apart", F.when(F.col("_hot") == 1, F.xxhash64(*own).bitwiseOR(1)).otherwise(0))
    out = out.join(rest, [key, "_apart"], "left")
    return out.select(*rows.columns, *[F.coalesce(f"_{c}", c).alias(c) for c in names])


def payload_of(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))


def holders(rows: DataFrame, least: int) -> DataFrame:
    """Of payloads that several rows have: digest, the page_id of the response, n rows."""
    return rows.filter(F.octet_length("payload") >= least).groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("n"), F.lit(True).alias("shared")).filter("n > 1")


def uuid_of(*parts: str) -> str:
    return f"regexp_replace(md5(concat_ws('#', {', '.join(parts)})), '(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})', '<urn:uuid:$1-$2-$3-$4-$5>')"


def field(name: str, value: str) -> str:
    """SQL of a header line; nothing where the value is null."""
    return f"coalesce(concat('{name}: ', {value}, '\\r\\n'), '')"


def records(rows: DataFrame, chunk: int, segment: int, date: str) -> DataFrame:
    """The records of each row in their order, as text of whatever bytes they have."""
    framed = f"""concat(if(size = 0, '', array_join(transform(sequence(0L, (size - 1) div {chunk}), k -> concat(
        lower(hex(least({chunk}, size - k * {chunk}))), '\\r\\n', cast(substring(payload, int(k * {chunk} + 1), {chunk}) AS string), '\\r\\n')), '')), '0\\r\\n\\r\\n')"""
    head = HTTP.replace("\r\n", "\\r\\n")
    block = F.expr(f"cast(if(revisit, '{head}', concat('{head}', {framed})) AS binary)")
    part = f"substring(block, int(k * {segment} + 1), {segment})"
    record = f"""concat('WARC/1.1\\r\\n',
        {field("WARC-Type", "CASE WHEN k > 0 THEN 'continuation' WHEN revisit THEN 'revisit' ELSE 'response' END")},
        {field("WARC-Record-ID", f"if(k = 0, id, {uuid_of('id', 'k')})")}, {field("WARC-Date", f"'{date}'")},
        {field("WARC-Target-URI", "uri")}, {field("X-Page-ID", "page_id")},
        {field("WARC-Payload-Digest", "if(k = 0, concat('sha1:', digest), null)")},
        {field("WARC-Profile", "if(revisit, 'http://netpreserve.org/warc/1.1/revisit/identical-payload-digest', null)")},
        {field("WARC-Segment-Number", "if(last > 0, k + 1, null)")}, {field("WARC-Segment-Origin-ID", "if(k > 0, id, null)")},
        {field("WARC-Segment-Total-Length", "if(last > 0 AND k = last, octet_length(block), null)")},
        {field("Content-Type", "if(k = 0, 'application/http; msgtype=response', null)")},
        {field("Content-Length", f"octet_length({part})")}, '\\r\\n', cast({part} AS string), '\\r\\n\\r')"""
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    named = rows.select("page_id", "revisit", "payload", F.octet_length("payload").cast("long").alias("size"), base32(F.col("sha1")).alias("digest"), uri.alias("uri"), F.monotonically_increasing_id().alias("row"))
    named = named.select("page_id", "revisit", "digest", "uri", block.alias("block"), F.expr(uuid_of("digest", "row", "page_id")).alias("id"))
    cut = named.withColumn("last", F.expr(f"greatest(0L, (octet_length(block) - 1L) div {segment})"))
    return cut.select(F.explode(F.expr(f"transform(sequence(0L, last), k -> {record})")).alias("record"))


def write_warc(pages: DataFrame, path: str, least: int = LEAST, chunk: int = CHUNK, segment: int = SEGMENT, per_file: int = PER_FILE, date: str | None = None) -> None:
    """Writes a record of each page to gzipped archives in the folder `path`."""
    rows = payload_of(pages)
    with Scratch(pages.sparkSession) as scratch:
        held = scratch.written(holders(rows, least))
        known = spread_join(rows, held, "sha1", [F.col("page_id"), F.col("url")])
        revisit = F.coalesce(F.col("shared"), F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("holder"))
        out = records(known.withColumn("revisit", revisit), chunk, segment, date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
        out.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", per_file).text(path)


class Stream:
    """The bytes of an archive, gzipped in any number of members or plain, unpacked piece by piece."""

    def __init__(self, data: bytes, piece: int = 1 << 20):
        self.left, self.at, self.taken = bytearray(), 0, 0
        self.pieces = self.unpacked(data, piece) if data[:2] == b"\x1f\x8b" else (data[i : i + piece] for i in range(0, len(data), piece))

    @staticmethod
    def unpacked(data: bytes, piece: int, fed: int = 1 << 16) -> Iterator[bytes]:
        at = 0
        while at < len(data):
            member = zlib.decompressobj(31)
            try:
                while not member.eof and (at < len(data) or member.unconsumed_tail):
                    if not (some := member.unconsumed_tail):
                        some = data[at : at + fed]
                        at += len(some)
                    yield member.decompress(some, piece)
            except zlib.error:
                return  # what follows is cut short
            at -= len(member.unused_data)

    def more(self) -> bool:
        if (piece := next(self.pieces, None)) is None:
            return False
        del self.left[: self.at]
        self.at = 0
        self.left += piece
        return True

    def until(self, end: bytes) -> bytes | None:
        """What comes before end, which is passed over; None if it doesn't come."""
        start = self.at
        while (k := self.left.find(end, start)) < 0:
            back = max(0, len(self.left) - self.at - len(end) + 1)
            if not self.more():
                return None
            start = self.at + back
        out = bytes(self.left[self.at : k])
        self.taken, self.at = self.taken + k + len(end) - self.at, k + len(end)
        return out

    def take(self, n: int) -> bytes:
        while len(self.left) - self.at < n and self.more():
            pass
        out = bytes(self.left[self.at : self.at + n])
        self.taken, self.at = self.taken + len(out), self.at + len(out)
        return out

    def over(self) -> bool:
        while len(self.left) == self.at:
            if not self.more():
                return True
        return False


def fields_of(head: bytes) -> dict[str, str]:
    """Header lines by their lower-cased names; a line that begins with white space goes on the one before."""
    out, name = {}, ""
    for line in head.split(b"\r\n")[1:]:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def parsed(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes, str | None]]:
    """Position, headers, block and problem of each record."""
    stream = Stream(data)
    while not stream.over():
        at, head = stream.taken, stream.until(b"\r\n\r\n")
        fields = fields_of(head) if head is not None else {}
        size = fields.get("content-length", "")
        if head is None or not head.startswith(b"WARC/1.") or not size.isdecimal():
            yield at, fields, b"", "no record"
            return
        block = stream.take(int(size))
        whole = len(block) == int(size) and stream.take(4) == b"\r\n\r\n"
        yield at, fields, block, None if whole else "cut short"
        if not whole:
            return


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """path, position, headers (names in lower case), block and problem of every record of the archives in a folder."""

    def work(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string()]
        names = ["path", "position", "headers", "block", "problem"]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for at, fields, block, problem in parsed(batch.column(1)[i].as_py()):
                    rows.append((name, at, list(fields.items()), block, problem))
                    held += len(block)
                    if held > 1 << 23 or len(rows) >= 5000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, FIELDS)


def reassembled(found: DataFrame) -> DataFrame:
    """headers, block, problem: one row a record, segments put together under the headers of the first."""
    number = F.expr("try_cast(headers['warc-segment-number'] AS long)")
    cut = F.col("headers").isNotNull() & F.coalesce(F.element_at("headers", "warc-segment-number").isNotNull() | (F.element_at("headers", "warc-type") == "continuation"), F.lit(False))
    apart = found.select("headers", "block", "problem", cut.alias("cut"))
    origin = F.coalesce(F.element_at("headers", "warc-segment-origin-id"), F.element_at("headers", "warc-record-id"))
    parts = apart.filter("cut").select(origin.alias("origin"), number.alias("number"), "headers", "block", "problem", F.expr("try_cast(headers['warc-segment-total-length'] AS long)").alias("total"))
    joined = parts.groupBy("origin").agg(
        F.min_by("headers", F.coalesce("number", F.lit(2**62))).alias("headers"),
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("parts"),
        F.max("total").alias("total"),
        F.count("total").alias("totals"),
        F.max("problem").alias("problem"),
    )
    block = F.array_join(F.transform("parts", lambda p: p["block"].cast("string")), "").cast("binary")
    whole = F.transform("parts", lambda p: p["number"]) == F.sequence(F.lit(1).cast("long"), F.size("parts").cast("long"))
    problem = F.when(~F.coalesce(whole, F.lit(False)), "segments missing or repeated").when(F.col("totals") != 1, "no total length").when(F.octet_length(block) != F.col("total"), "total length differs")
    done = joined.select("headers", block.alias("block"), F.coalesce("problem", problem).alias("problem"))
    return apart.filter("NOT cut").select("headers", "block", "problem").unionByName(done)


def unchunked(data: bytes) -> bytes | None:
    """The bytes without their framing in chunks; None if it is broken."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not size or size.strip(b"0123456789abcdefABCDEF"):
            return None
        n = int(size, 16)
        if n == 0:
            return b"".join(out)
        if data[end + 2 + n : end + 4 + n] != b"\r\n":
            return None
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def payload(block: bytes, kind: str) -> tuple[bytes, str | None]:
    """The payload of a record's block, and what is wrong with it."""
    if not kind.replace(" ", "").lower().startswith("application/http"):
        return block, None
    head, _, body = block.partition(b"\r\n\r\n")
    if b"chunked" not in fields_of(head).get("transfer-encoding", "").lower().encode():
        return body, None
    out = unchunked(body)
    return (b"", "broken chunks") if out is None else (out, None)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers, payload, sha1, problem of every record of the archives in a folder; a revisit's payload is null, its sha1 the declared one."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            kinds = batch.column(batch.schema.get_field_index("kind")).to_pylist()
            got, wrong = [], []
            for block, kind in zip(batch.column(batch.schema.get_field_index("block")), kinds, strict=True):
                p, w = (None, None) if kind is None else payload(block.as_py(), kind)
                got.append(p)
                wrong.append(w)
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("block", "kind")]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(got, pa.binary()), pa.array(wrong, pa.string())], names=[*[batch.schema.names[i] for i in keep], "payload", "wrong"])

    kind = F.when(F.element_at("headers", "warc-type") == "revisit", None).otherwise(F.coalesce(F.element_at("headers", "content-type"), F.lit("")))
    rows = reassembled(read_records(spark, path)).select("headers", "problem", "block", kind.alias("kind"))
    rows = rows.mapInArrow(work, "headers map<string, string>, problem string, payload binary, wrong string")
    declared = F.regexp_extract(F.coalesce(F.element_at("headers", "warc-payload-digest"), F.lit("")), r"(?i)\Asha1:([A-Z2-7]{32})\z", 1)
    digest = F.coalesce(base32(F.sha1("payload")), F.when(declared != "", declared))
    problem = F.coalesce("problem", "wrong", F.when((declared != "") & (digest != declared), "digest differs"))
    return rows.select("headers", "payload", digest.alias("digest"), problem.alias("problem"))


def index(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, problem of each page's record: revisits are resolved by their digests."""
    with Scratch(spark) as scratch:
        read = read_warc(spark, path)
        rows = scratch.written(read.select(F.expr("try_cast(headers['x-page-id'] AS long)").alias("page_id"), F.element_at("headers", "warc-type").alias("record_type"), F.octet_length("payload").cast("long").alias("bytes"), "digest", "problem"))
        again = rows.filter("record_type = 'revisit'").select("page_id", "digest", "problem")
        kept = rows.filter("record_type = 'response' AND problem IS NULL").groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.max("bytes").alias("payload_bytes"))
        facts = scratch.written(again.groupBy("digest").agg(F.count("*").alias("n")).join(kept, "digest"))
        revisits = spread_join(again, facts, "digest", [F.col("page_id")]).select("page_id", "payload_bytes", "digest", F.lit("revisit").alias("record_type"), "refers_to", F.coalesce("problem", F.when(F.col("payload_bytes").isNull(), "no response")).alias("problem"))
        others = rows.filter("record_type IS DISTINCT FROM 'revisit'").select("page_id", F.col("bytes").alias("payload_bytes"), "digest", "record_type", F.lit(None).cast("long").alias("refers_to"), "problem")
        return scratch.kept(others.unionByName(revisits)).withColumnRenamed("digest", "payload_digest")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        write_warc(table(spark, sf_dir, "pages"), f"{scratch.path}/archives")
        rows = index(spark, f"{scratch.path}/archives")
    sound = F.when(F.col("problem").isNull(), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("an archive can't be read: "), "problem")))
    return rows.select("page_id", "payload_bytes", sound.alias("payload_digest"), "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder FROM pages)
SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(t), 1 + 5 * (k // 4), 5))::BIGINT >> (15 - 5 * (k % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM p
"""
