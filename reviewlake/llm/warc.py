"""WARC archives with an index, and reads by coalesced byte ranges.

Writing: records of a partition go to archive files of bounded size, one gzip member a record, and
the index (url, digest, file, offset, length) comes out as a table. Equal payloads are stored once,
as the response with the smallest id; the others become revisit records that name it. The smallest
id per digest is a grouped minimum, joined back by digest, so that a payload that a third of all
pages share is a hot join key, which adaptive execution splits.

Reading: the selected index rows are sorted by file and offset, ranges that touch or almost touch
are read in one request, and records are cut out of it.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import fresh_folder, stage, utf8

LEAST_REVISIT = 100  # bytes of a payload that is worth a revisit record
FILE_BYTES = 256 << 20
RANGE_BYTES = 8 << 20
GAP_BYTES = 64 << 10
LEVEL = 1
DATE = "2026-01-01T00:00:00Z"
INDEX = ("page_id long, url string, digest string, record_type string, refers_to long, "
         "file string, offset long, length long")


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder given as a path or URI that pyarrow knows."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, digest: str, refers_to: int | None,
           size: int, payload: bytes) -> bytes:
    """One WARC record. A revisit keeps the HTTP head, with the length of the full payload."""
    revisit = refers_to is not None
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    block = http if revisit else http + payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode())
                  for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(member: bytes) -> dict:
    """The fields of one record; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"record_type": kind, "payload_bytes": size, "payload_digest": digest,
            "refers_to": _id_of(fields.get("WARC-Refers-To")),
            "payload": payload if kind == "response" else None}


def _id_of(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, size, refers_to): refers_to is set for revisits."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(utf8(html_col), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.length("payload")})
    # written first, so that Spark may split a hot digest of the join below
    firsts = stage(pages.select(F.col(id_col).alias("page_id"),
                           F.coalesce(utf8(html_col), F.lit(b"")).alias("payload"))
              .where(F.length("payload") >= LEAST_REVISIT)
              .groupBy(F.sha2("payload", 256).alias("digest"))
              .agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
              .where("_n > 1").drop("_n"), "firsts")
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", "digest", "size",
        F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record per row of `pages` to archives in `folder`; return their index.

    The index is a written table: it names only files of tasks that ended well, and what a lost
    attempt left is not in it. A null html is an empty payload and a null url an empty one. Rows
    that repeat an id are records of their own: all rows with the smallest id of a payload are
    responses. A row with a null id is a revisit of the smallest id, or else a response. An empty
    table writes no archive.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name, files = None, 0, "", _place(folder)
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at > FILE_BYTES:
                    if out:
                        out.close()
                    name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                    files[0].create_dir(files[1], recursive=True)
                    out = files[0].open_output_stream(f"{files[1]}/{name}",
                                                      compression=None)
                member = gzip.compress(record(r["page_id"], r["url"], r["digest"], r["refers_to"],
                                              r["size"], r["payload"]), LEVEL, mtime=0)
                out.write(member)
                kind = "response" if r["refers_to"] is None else "revisit"
                rows.append((r["page_id"], r["url"], r["digest"], kind, r["refers_to"], name, at,
                             len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), _INDEX_TYPES)],
                    names=[f.split()[0] for f in INDEX.split(", ")])
        if out:
            out.close()

    return stage(roles(pages, id_col, url_col, html_col).mapInArrow(run, INDEX), "index")


_INDEX_TYPES = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]]
                for f in INDEX.split(", ")]


def _ranges(rows: Iterator[dict]) -> Iterator[list[dict]]:
    """Index rows in order, grouped so that each group is one read."""
    held: list[dict] = []
    for r in rows:
        if held and (r["file"] != held[-1]["file"]
                     or r["offset"] - held[-1]["offset"] - held[-1]["length"] > GAP_BYTES
                     or r["offset"] + r["length"] - held[0]["offset"] > RANGE_BYTES):
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that `index` selects: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to and, if asked for, payload (null for revisits).

    Damaged records raise an error.
    """
    schema = ("page_id long, url string, record_type string, payload_bytes long, "
              "payload_digest string, refers_to long" + ", payload binary" * payloads)
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, source, name = _place(folder), None, None
        for group in _ranges(r for b in batches for r in b.to_pylist()):
            if group[0]["file"] != name:
                if source:
                    source.close()
                name = group[0]["file"]
                source = files[0].open_input_file(f"{files[1]}/{name}")
            begin = group[0]["offset"]
            data = source.read_at(group[-1]["offset"] + group[-1]["length"] - begin, begin)
            rows = []
            for r in group:
                at = r["offset"] - begin
                rows.append(r | parse(data[at:at + r["length"]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names=names)
        if source:
            source.close()

    sought = index.select("page_id", "url", "file", "offset", "length")
    return (sought.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
            .mapInArrow(run, schema))


def archive_folder(spark) -> str:
    """A new folder, named with the file system that Spark takes it to be on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(fresh_folder(spark, "warc"))
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.makeQualified(path).toString()


SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                  sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISIT}
      GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""
