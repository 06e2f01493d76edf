"""Token ids of documents in ORC files.

Documents are dealt by ranges of their id, so every file holds an ascending range and file order
is document order. ORC stores the ids with integer run-length encoding, in stripes that readers
take in parallel; row indexes and a Bloom filter on the document id let a lookup of a few
documents skip all other stripes and row groups. Each row also keeps its file's number and the
count of ids before it in that file; one sum per file then turns these into corpus offsets.

A text is encoded piece by piece. A lone space between two characters that are not white space
always begins a new word for the tokenizer, so a text may be cut there without changing its ids,
and a piece that occurred before in the same task is looked up instead of encoded again.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import map_arrow

END_ID = 0
MEMO_PIECES = 800_000  # pieces a Python worker remembers; then it starts afresh
SPACE = "\u0120"  # how byte-level vocabularies write the byte 0x20
MEMO_CHARS = 32 << 20  # and their characters
PIECES_AT_ONCE = 300  # new ones encoded as one text; in longer texts each took more time
STRIPE_BYTES = 64 << 20
INDEX_STRIDE = 1000


# white space that a cut at every space could not tell from a lone one
_OTHER_SPACE = re.compile(r"[^\S \n]")
_ASCII_SPACE = "\t\r\v\f\x1c\x1d\x1e\x1f"  # all of it in ASCII


def _other_space(text: str) -> bool:
    if text.isascii():  # the same by plain search, which is faster
        return any(c in text for c in _ASCII_SPACE)
    return _OTHER_SPACE.search(text) is not None


def _cut(text: str) -> list[str] | None:
    """`text` at its spaces if every one is lone, else None."""
    if " \n" in text or "\n " in text or _other_space(text):
        return None
    parts = text.split(" ")
    return None if "" in parts and text else parts


class _Places(dict):
    """Numbers of pieces; an unknown piece gets the next number and waits to be encoded."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        self[piece] = at = len(self)
        return at


class Encoder:
    """A tokenizer that remembers pieces, kept without their leading space.

    New pieces are encoded some hundred at a time, as one text. Inside a piece only its first byte
    is a space, so the tokens that begin with one show where each piece begins.
    """

    def __init__(self, path: str, memo: int | None = None):
        self.memo = memo or MEMO_PIECES
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[:1] == SPACE]] = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.flat = np.empty(1 << 20, np.int32)
        self.bounds = np.zeros(1 << 18, np.int64)
        self.chars = 0

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text."""
        if len(self.places) > self.memo or self.chars > MEMO_CHARS:
            self._forget()
        place, heads, places = self.places.__getitem__, [], []
        for text in texts:
            parts = None if any(t in text for t in self.added) else _cut(text)
            heads.append(parts[0] if parts else text)
            rest = parts[1:] if parts else ()
            places.append(np.fromiter(map(place, rest), np.int64, len(rest)))
        self._learn()
        heads = self.tokenizer.encode_batch_fast(heads, add_special_tokens=False)
        ends = np.cumsum([len(p) for p in places])
        ids, bounds = self._gather(np.concatenate(places)) if texts else (None, None)
        return [np.concatenate((np.array(head.ids, np.int32), ids[bounds[a]:bounds[b]]))
                for head, a, b in zip(heads, [0, *ends[:-1].tolist()], ends.tolist())]

    def _learn(self) -> None:
        """Encode the pieces that wait."""
        new, self.places.new = self.places.new, []
        if not new:
            return
        self.chars += len(new) + sum(map(len, new))
        ids = np.concatenate([
            np.array(self.tokenizer.encode_batch_fast(
                [" " + " ".join(new[at:at + PIECES_AT_ONCE])], add_special_tokens=False)[0].ids,
                np.int32)
            for at in range(0, len(new), PIECES_AT_ONCE)])
        begins = np.flatnonzero(self.spaced[ids])
        known = len(self.places) - len(new)
        at = int(self.bounds[known])
        self.flat = _room(self.flat, at + len(ids))
        self.flat[at:at + len(ids)] = ids
        self.bounds = _room(self.bounds, len(self.places) + 1)
        self.bounds[known + 1:len(self.places) + 1] = at + np.append(begins[1:], len(ids))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces end to end, and where each piece begins, with the end."""
        starts = self.bounds[at]
        lengths = self.bounds[at + 1] - starts
        bounds = np.append(0, np.cumsum(lengths))
        shift = np.repeat(starts - bounds[:-1], lengths)
        shift += np.arange(len(shift))
        return self.flat[shift], bounds


@lru_cache(maxsize=1)
def encoder(path: str, memo: int | None = None) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, memo)


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    return np.concatenate((array, np.zeros(max(size, len(array)), array.dtype)))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text", parts: int | None = None, memo: int | None = None) -> None:
    """Write one row (id, file, start_in_file, ids) per document as ORC files under `path`.

    Every document's ids end with END_ID; a null or empty text has that id alone. Rows with
    equal ids are neighbours in the order of a hash of their texts, so reruns agree; rows with a
    null id come first. An empty table gives files without rows. `tokenizer` is a file that executors can open,
    and `memo` the number of pieces a Python worker remembers.
    """
    keys = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt = (keys.repartitionByRange(parts, "doc_id") if parts else
             keys.repartitionByRange("doc_id"))
    dealt = dealt.sortWithinPartitions("doc_id", F.xxhash64("text")).withColumn(
        "file", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(tokenizer, memo).encode, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = encode([t or "" for t in part.column("text").to_pylist()])
                lengths = np.array([len(i) + 1 for i in ids])
                ends = np.cumsum(lengths)
                flat = np.full(int(ends[-1]), END_ID, np.int32)
                keep = np.ones(len(flat), bool)
                keep[ends - 1] = False
                flat[keep] = np.concatenate(ids)
                offsets = np.concatenate(([0], ends)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("file"),
                     pa.array(before + ends - lengths), pa.array(lengths),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "file", "start_in_file", "n_ids", "ids"])
                before += int(ends[-1])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = dealt.mapInArrow(
        run, f"doc_id {kind}, file int, start_in_file long, n_ids long, ids array<int>")
    (rows.write.option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.row.index.stride", INDEX_STRIDE)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .orc(path))


def read_tokens(spark: SparkSession, path: str, id_type: str = "long") -> DataFrame:
    """The rows of `write_tokens`, whose ids are of `id_type`; a filter on doc_id reads only row
    groups that may hold it."""
    return spark.read.schema(f"doc_id {id_type}, file int, start_in_file long, n_ids long, "
                             "ids array<int>").orc(path)


def token_index(spark: SparkSession, path: str, release: bool = False,
                id_type: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    start counts the ids of all documents before it. Only one row per file meets in one task.
    `release` gives up what workers remember from writing, where memory is short.
    """
    def digest(cols):
        if release:
            encoder.cache_clear()
        lists = cols["ids"]
        values = lists.values.to_numpy().view("<u4")
        ends = lists.offsets.to_numpy()
        return {"doc_id": cols["doc_id"], "file": cols["file"],
                "start_in_file": cols["start_in_file"], "n_tokens": np.diff(ends),
                "ids_crc32": [zlib.crc32(values[a:b]) for a, b in
                              zip(ends[:-1].tolist(), ends[1:].tolist())]}

    files = read_tokens(spark, path, id_type)
    rows = map_arrow(files.drop("n_ids"),
                     f"doc_id {id_type}, file int, start_in_file long, n_tokens long, ids_crc32 long",
                     digest)
    sizes = files.groupBy("file").agg(F.sum("n_ids").alias("_ids"))
    before = F.sum("_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("file", F.coalesce(before, F.lit(0)).alias("_before"))
    return rows.join(offsets, "file").select(
        "doc_id", (F.col("_before") + F.col("start_in_file")).alias("start"), "n_tokens",
        "ids_crc32")
