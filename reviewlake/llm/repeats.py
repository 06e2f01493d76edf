"""Removal of long passages that occur more than once, byte by byte.

A byte goes if it lies in a string of LENGTH bytes that starts anywhere else too. That is a
question about suffixes: which of them share LENGTH bytes with another one.

Every suffix is assigned to one sample position. The sample is a cover chosen by content: of the
grams in each window of LENGTH bytes the one with the least hash is sampled. Two suffixes that
agree in LENGTH bytes thus have their sample at the same distance and with the same gram, which is
what a difference cover provides for any two suffixes, here with 0.6 % of all positions instead of
the 6 % of a fixed residue cover, and without rank lists for every suffix.

Suffixes are taken bucket by bucket, a bucket being all suffixes of one sample gram:

* A gram that occurs once has no equal suffixes and is dropped; that is nearly all of them.
* The suffixes of one sample position are a stretch of text, its context. Where a context occurs
  twice, all its suffixes do. The few contexts that occur very often are sent to all tasks, so no
  task gathers their occurrences.
* What is left are different contexts of one gram, at the ends of passages and around edits. Only
  their bytes are moved. Within a bucket, suffixes are ordered by distance to the sample and by
  the ranks of their power-of-two blocks; neighbours with all ranks equal are repeated.
* A bucket with very many different contexts (a passage that thousands of texts share, each with
  words of its own before it) is spread over the cluster: its suffixes become single rows, counted
  by distance and rank.

Positions and hashes, never texts, pass through the shuffles that all suffixes take part in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stage, utf8

LENGTH = 400
GRAM = 64
STRETCH = 1 << 16  # positions of a text whose ranges are merged at once
CHUNK = 1 << 21  # bytes of text sampled at once; below 2 ** 24
BUCKET = 1000  # different contexts of a gram that one task compares
OFTEN = 1000  # occurrences of a context that meet in one task
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(data: bytes) -> np.ndarray:
    """The 8 bytes at every position as a number."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def _stir(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def _gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes (a multiple of 8) at every position that has them."""
    words, n = _words(data), len(data) - gram + 1
    h = np.full(n, gram, np.uint64)
    for at in range(0, gram, 8):
        h = _stir(h ^ words[at:at + n])
    return h


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i + width] for every i."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def samples(data: bytes, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(gram hash, first, last, sample) per sample position of texts that lie end to end.

    `ends` are the ends of the texts in `data`. The suffixes first..last, all with `length` bytes
    in their text, have their sample there.
    """
    if len(data) < length:
        return (np.empty(0, np.uint64),) + (np.empty(0, np.int64),) * 3
    h = _gram_hashes(data, gram)
    position = np.uint64((1 << 24) - 1)
    keyed = (h & ~position) | np.arange(len(h), dtype=np.uint64)  # the first of equal ones
    at = (_sliding_min(keyed, length - gram + 1) & position).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    valid = np.zeros(len(at) + 1, np.int8)
    long_enough = ends - starts >= length
    np.add.at(valid, starts[long_enough], 1)
    np.add.at(valid, ends[long_enough] - length + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    change = np.empty(len(at), bool)
    change[0] = True
    change[1:] = (at[1:] != at[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(at)) - 1
    keep = valid[first]
    first, last = first[keep], last[keep]
    return h[at[first]], first, last, at[first]


def _chunks(keys: list[bytes], texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray,
                                                                     np.ndarray]]:
    """Texts end to end in pieces of about CHUNK bytes: data, ends, row of each, offset in it.

    A long text is cut into pieces that overlap by LENGTH - 1 bytes: each suffix is in one.
    """
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - LENGTH + 1, 0), CHUNK):
            piece = text[at:at + CHUNK + LENGTH - 1]
            held.append((piece, row, at))
            size += len(piece)
            if size >= CHUNK:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held):
    pieces, rows, at = zip(*held)
    return (b"".join(pieces), np.cumsum([len(p) for p in pieces]), np.array(rows), np.array(at))


def _occurrences(docs: DataFrame) -> DataFrame:
    """(key, first, last, at, gram, context) per sample position; key is the digest of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column("key"), batch.column("text").to_pylist()
            for data, ends, rows, offsets in _chunks(keys, texts):
                gram, first, last, at = samples(data, ends)
                piece = np.searchsorted(ends, first, side="right")
                begin = np.concatenate(([0], ends[:-1]))[piece] - offsets[piece]
                digest = xxhash.xxh64_intdigest
                context = [digest(data[a:b], seed) for a, b, seed in zip(
                    first.tolist(), (last + LENGTH).tolist(), (at - first).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows[piece])), *(pa.array((x - begin).astype(np.int32))
                                                         for x in (first, last, at)),
                     pa.array(gram.view(np.int64)),
                     pa.array(np.array(context, np.uint64).view(np.int64))],
                    names=["key", "first", "last", "at", "gram", "context"])

    return docs.where(F.length("text") >= LENGTH).mapInArrow(
        run, "key binary, first int, last int, at int, gram long, context long")


def suffix_ranks(data: bytes, length: int = LENGTH) -> np.ndarray:
    """A 64-bit rank of the `length` bytes at every position that has them.

    Ranks of blocks of 8, 16, 32... bytes are built from those of half their size.
    """
    rank, size, n = _stir(_words(data) ^ _MIX), 8, len(data) - length + 1
    total, at = np.zeros(n, np.uint64), 0
    while size <= length:
        if length & size:
            total = _stir(total ^ rank[at:at + n])
            at += size
        if 2 * size <= length:
            rank = _stir(_stir(rank[:-size]) ^ rank[size:])
        size *= 2
    if length % 8:
        total = _stir(total ^ _words(data)[length - 8:length - 8 + n])
    return total


def _with_bytes(contexts: DataFrame, docs: DataFrame) -> DataFrame:
    """Contexts (gram, context, key, first, last, at) with their bytes, cut from the texts.

    Copies of a text give the same context again; tasks drop repeats before they send them.
    """
    wanted = stage(contexts.groupBy("key").agg(F.collect_list(F.struct(
        "gram", "context", "first", "last", "at")).alias("wanted")), "wanted")
    cut = F.transform("wanted", lambda w: F.struct(
        w.gram.alias("gram"), w.context.alias("context"), w.first.alias("first"),
        (w.at - w.first).alias("reach"),
        F.substring(F.col("text"), w.first + 1, w.last - w.first + LENGTH).alias("bytes")))
    return (docs.join(wanted, "key").select("key", F.explode(cut).alias("c"))
            .select("key", "c.*").dropDuplicates(["gram", "context"]))


def _windows(batch: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in its context, rank) of every suffix of the contexts in a batch."""
    data = batch["bytes"]
    ranks = suffix_ranks(b"".join(data))
    sizes = np.array([len(b) for b in data])
    begins = np.cumsum(sizes) - sizes
    counts = sizes - LENGTH + 1
    row = np.repeat(np.arange(len(data)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    distance = np.array(batch["reach"], np.int64)[row] - place
    rank = ranks[begins[row] + place]
    return row, place, _stir(rank ^ _stir(distance.astype(np.uint64)))


def _in_buckets(contexts: DataFrame) -> DataFrame:
    """(key, first, last): ranges of suffixes that occur twice in the bucket of their gram."""
    def compared(rows: dict) -> pa.RecordBatch:
        row, place, rank = _windows(rows)
        rank = _stir(rank ^ np.array(rows["gram"], np.int64).view(np.uint64)[row])
        order = np.argsort(rank, kind="stable")
        same = rank[order][1:] == rank[order][:-1]
        twice = np.zeros(len(rank), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        row, place = row[twice], place[twice]
        ends = np.ones(len(row) + 1, bool)
        ends[1:-1] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        a, b = np.flatnonzero(ends[:-1]), np.flatnonzero(ends[1:])
        base = np.array(rows["first"], np.int64)[row[a]]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows["key"][r] for r in row[a].tolist()], pa.binary()),
             pa.array((base + place[a]).astype(np.int32)),
             pa.array((base + place[b]).astype(np.int32))], names=["key", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in batch.to_pylist():
                if len(held) >= BUCKET and r["gram"] != held[-1]["gram"]:
                    yield compared({n: [h[n] for h in held] for n in r})
                    held = []
                held.append(r)
        if held:
            yield compared({n: [h[n] for h in held] for n in held[0]})

    return (contexts.repartition("gram").sortWithinPartitions("gram")
            .mapInArrow(run, "key binary, first int, last int"))


def _spread(contexts: DataFrame) -> DataFrame:
    """The same for buckets of any size, each suffix being a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = part.to_pydict()
                row, place, rank = _windows(rows)
                index = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("key").take(index), part.column("gram").take(index),
                     pa.array(rank.view(np.int64)),
                     pa.array((np.array(rows["first"])[row] + place).astype(np.int32))],
                    names=["key", "gram", "rank", "first"])

    rows = stage(contexts.mapInArrow(
        run, "key binary, gram long, rank long, first int"), "suffixes")
    twice = stage(rows.groupBy("gram", "rank").agg(F.count("*").alias("_n")).where("_n > 1"),
                  "twice")
    return rows.join(twice, ["gram", "rank"], "left_semi").select(
        "key", "first", F.col("first").alias("last"))


def _met_again(found: DataFrame, contexts: DataFrame) -> DataFrame:
    """(key, first, last) of the rows of `found` whose context occurs more than once.

    A periodic passage has its context once a period. Contexts with over OFTEN occurrences, at
    most one for every OFTEN rows, are broadcast: their rows stay where they were read.
    """
    both = ["gram", "context"]
    often = F.broadcast(contexts.where(F.col("n") > OFTEN).select(both))
    again = contexts.where(F.col("n").between(2, OFTEN)).select(both)
    rest = found.join(often, both, "left_anti").join(again, both, "left_semi")
    return found.join(often, both, "left_semi").union(rest).select("key", "first", "last")


def repeated(docs: DataFrame) -> DataFrame:
    """(key, first, last): ranges of suffixes of texts that share LENGTH bytes with another one.

    `docs` has (key, text): the digest of a text and its bytes.
    """
    found = stage(_occurrences(docs), "samples")
    # small sides of joins are written first: only then may Spark split a hot key of the other
    shared = stage(
        found.groupBy("gram").agg(F.count("*").alias("_n"), F.min("context").alias("_low"),
                                  F.max("context").alias("_high")).where("_n > 1")
        .select("gram", (F.col("_low") == F.col("_high")).alias("alike")), "grams")
    met = stage(found.join(shared, "gram"), "shared")
    whole = met.where("alike").select("key", "first", "last")
    mixed = met.where("not alike")
    contexts = stage(mixed.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "first", "last", "at")).alias("r"))
        .select("gram", "context", "n", "r.*"), "contexts")
    twice = _met_again(mixed, contexts)
    sizes = stage(contexts.groupBy("gram").agg(F.count("*").alias("_size"))
                  .where(F.col("_size") > BUCKET), "large")
    texts = stage(_with_bytes(contexts, docs), "bytes")
    large = texts.join(sizes, "gram", "left_semi")
    small = texts.join(sizes, "gram", "left_anti")
    return whole.union(twice).union(_in_buckets(small)).union(_spread(large))


def merged(ranges: DataFrame) -> DataFrame:
    """(key, spans): per text its suffix ranges (key, first, last), sorted, neighbours as one.

    A periodic text may have a range for every byte. They are merged in stretches of STRETCH
    positions first, then come together as what is left: runs that bytes lie between.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_runs(s) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(spans, _SPANS)], names=["key", "spans"])

    def together(rows: DataFrame, *keys) -> DataFrame:
        return rows.groupBy(*keys).agg(F.collect_set(F.struct("first", "last")).alias("spans"))

    schema = "key binary, spans array<struct<first: int, last: int>>"
    parts = together(ranges, "key", F.expr(f"first div {STRETCH}").alias("_part"))
    parts = parts.select("key", "spans").mapInArrow(run, schema).select(
        "key", F.inline("spans"))
    return together(parts, "key")


_SPANS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


def _runs(spans: list[dict]) -> list[dict]:
    """Ranges of suffixes whose bytes touch, as one range each."""
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["first"], s["last"])):
        if out and s["first"] <= out[-1]["last"] + LENGTH:
            out[-1]["last"] = max(out[-1]["last"], s["last"])
        else:
            out.append(dict(s))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, kept) per row; kept are the bytes that stay.

    Texts are UTF-8 bytes, null being empty; strings never reach across texts, and are judged on
    the input. Texts shorter than LENGTH bytes stay whole. Copies of a long text are removed all,
    the first included. Repeated rows are texts of their own; null ids come out as null. An empty
    table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(utf8(text_col), F.lit(b"")).alias("text"))
    texts = texts.withColumn("key", F.unhex(F.md5("text")))
    spans = stage(merged(repeated(texts.select("key", "text"))), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_without(text, spans) for text, spans in zip(
                batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            sizes = [len(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()),
                 pa.array([n - len(kept) for n, (kept, _) in zip(sizes, rows)], pa.int64()),
                 pa.array([n for _, n in rows], pa.int64()),
                 pa.array([hashlib.sha256(kept).hexdigest() for kept, _ in rows], pa.string()),
                 pa.array([kept for kept, _ in rows], pa.binary())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    # by shuffle at every size: few spans would be broadcast on small tables only
    return texts.join(spans.hint("merge"), "key", "left").select("id", "text", "spans").mapInArrow(
        run, f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
             "kept binary")


def _without(text: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """The text without the bytes of the suffixes in `spans`, and the number of cuts."""
    kept, count, end = [], 0, 0
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if first > end or not count:
            kept.append(text[end:first])
            count += 1
        end = max(end, last + LENGTH)
    return b"".join([*kept, text[end:]]), count
