"""WARC archives: written with an index first, read back by coalesced byte ranges.

Records are written as one gzip member each.  Of records with equal payloads of
at least ``LEAST_BYTES`` bytes, the one with the largest page id is a response and
the others are revisits that name it; copies are settled on (page id, digest)
rows, and the payloads are shuffled once, into archives by page id.

While an archive is written, its index rows (archive, offset, length, URL,
digest, page id) go to a table.  Reading starts from index rows: those selected
are sorted by place, neighbours closer than ``GAP_BYTES`` become one byte range,
and each range is one read, from which the records are cut.  Revisits get the
length of their payload from the response that they name.

Defined results: null html is an empty payload, a null url an empty URI; a null
page id is below every other.  Rows that share the largest page id and payload
are all responses.  Repeated rows are written one by one.  An empty table writes
no archive.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscope.llm.common import materialize, shared_folder, whole_text
from corpuscope.llm.files import open_store, written

#: Payloads below this size are always written in full.
LEAST_BYTES = 1000
#: An archive is closed beyond this size.
ARCHIVE_BYTES = 256 << 20
#: Ranges this close are read as one, up to RANGE_BYTES.
GAP_BYTES, RANGE_BYTES = 64 << 10, 8 << 20

_ID = "urn:page:"
_INDEX = "page_id long, archive string, offset long, length long, url string, digest string, record_type string"


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; ``refers_to`` makes it a revisit, which has no payload."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>",
            f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{_ID}{refers_to}>"]
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def _line(text: str) -> str:
    """A header value must stay on its line."""
    return "".join(c if c >= " " else f"%{ord(c):02X}" for c in text)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


def _number(uri: str | None) -> int | None:
    value = (uri or "").strip("<>").removeprefix(_ID)
    return int(value) if value else None


def write_archives(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write one record per row; returns the stored index."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    body = whole_text(html_col).cast("binary")
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), whole_text(url_col).alias("url"), body.alias("body"))
    slim = materialize(src.select("page_id", F.sha1("body").alias("digest"), F.octet_length("body").alias("size")), "warc-digests")
    large = slim.filter(F.col("size") >= least_bytes)
    heads = (large.groupBy("digest", "size").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
             .filter("n > 1 AND head IS NOT NULL"))
    revisits = (large.join(heads, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("head")))
                .select(F.struct("page_id", "digest").alias("key"), F.col("head").alias("refers_to")).distinct())
    revisits = materialize(revisits, "warc-revisits")
    rows = (src.withColumn("digest", F.sha1("body")))
    key = F.struct("page_id", "digest")
    gone = F.broadcast(revisits) if revisits.count() <= 200_000 else revisits
    rows = (rows.join(gone, key.eqNullSafe(F.col("key")), "left")
            .withColumn("body", F.when(F.col("refers_to").isNull(), F.col("body")))
            .select("page_id", "url", "digest", "refers_to", "body"))
    rows = rows.sortWithinPartitions("page_id", "digest")

    def run(batches):
        from pyspark import TaskContext

        part, at, number = TaskContext.get().partitionId(), 0, 0
        rows = ((p, u, d, r, b or b"") for batch in batches for p, u, d, r, b in zip(*(c.to_pylist() for c in batch.columns)))
        row = next(rows, None)
        while row is not None:
            name, at, index = f"part-{part:06d}-{number:04d}.warc.gz", 0, []
            with written(folder, name) as out:
                while row is not None and at < ARCHIVE_BYTES:
                    page_id, url, digest, refers_to, payload = row
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    raw = packer.compress(record(page_id, url, payload, digest, refers_to)) + packer.flush()
                    out.write(raw)
                    index.append((page_id, f"{folder}/{name}", at, len(raw), url, digest,
                                  "response" if refers_to is None else "revisit"))
                    at += len(raw)
                    row = next(rows, None)
            number += 1
            for i in range(0, len(index), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*index[i:i + 10_000]),
                                                    [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])],
                    ["page_id", "archive", "offset", "length", "url", "digest", "record_type"])

    return materialize(rows.mapInArrow(run, _INDEX), "warc-index")


def _ranges(places: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Groups of (offset, length), sorted, that one read covers."""
    held: list[tuple[int, int]] = []
    for offset, length in places:
        if held and (offset > held[-1][0] + held[-1][1] + GAP_BYTES or offset + length - held[0][0] > RANGE_BYTES):
            yield held
            held = []
        held.append((offset, length))
    if held:
        yield held


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that ``index`` rows point to: ``page_id, url, record_type, refers_to, payload_bytes,
    payload_digest`` and the ``payload`` on request (null for revisits, as are their ``payload_bytes``).

    The digest of a response is that of the payload as read, checked against its header.
    """
    places = index.select("archive", "offset", "length")
    # stretches of an archive go to different tasks; the reads of one stretch are coalesced
    dealt = (places.withColumn("stretch", F.floor(F.col("offset") / F.lit(4 * RANGE_BYTES)))
             .repartition("archive", "stretch").sortWithinPartitions("archive", "offset").drop("stretch"))
    schema = ("page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
              + (", payload binary" if with_payload else ""))

    def run(batches):
        import hashlib

        store = stream = name = None
        for batch in batches:
            table: dict[str, list[tuple[int, int]]] = {}
            for archive, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                table.setdefault(archive, []).append((offset, length))
            for archive, wanted in table.items():
                if archive != name:
                    if stream is not None:
                        stream.close()
                    store, path = open_store(archive)
                    stream, name = store.open_input_file(path), archive
                for group in _ranges(wanted):
                    first = group[0][0]
                    raw = stream.read_at(group[-1][0] + group[-1][1] - first, first)
                    rows = []
                    for offset, length in group:
                        headers, payload = parse(zlib.decompress(raw[offset - first:offset - first + length], 31))
                        kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"{archive}, offset {offset}: the payload does not match its digest")
                        rows.append((_number(headers["warc-record-id"]), headers["warc-target-uri"], kind,
                                     _number(headers.get("warc-refers-to")), len(payload) if kind == "response" else None,
                                     digest, *([payload if kind == "response" else None] if with_payload else [])))
                    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                                     ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest",
                                                      "payload"][:len(cols)])

    return dealt.mapInArrow(run, schema)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` (stored) with the ``payload_bytes`` of revisits from the responses that they name."""
    revisits = records.filter("record_type = 'revisit'")
    named = revisits.select(F.col("refers_to").alias("r_id"), F.col("payload_digest").alias("r_digest")).distinct()
    sizes = materialize(records.filter("record_type = 'response'")
                        .join(named, (F.col("page_id") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")))
                        .groupBy("r_id", "r_digest").agg(F.max("payload_bytes").alias("r_bytes")), "warc-sizes")
    sizes = F.broadcast(sizes) if sizes.count() <= 200_000 else sizes
    filled = (revisits.join(sizes, (F.col("refers_to") == F.col("r_id")) & (F.col("payload_digest") == F.col("r_digest")), "left")
              .withColumn("payload_bytes", F.col("r_bytes")).drop("r_id", "r_digest", "r_bytes"))
    return records.filter("record_type = 'response'").unionByName(filled)
