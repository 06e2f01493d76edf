"""Near duplicates by SimHash fingerprints.

A fingerprint takes, for each of 64 bits, the majority over the XXH64 hashes of a text's word
shingles. Fingerprints link at a small Hamming distance k. They are found by pigeonhole: cut into
b blocks, two fingerprints that differ in at most k bits agree in at least b - k whole blocks, so
each is filed once for every choice of b - k blocks and compared only inside these buckets. With
six blocks and k = 3 a bucket shares 32 or 33 bits, so random fingerprints hardly meet, whatever
the size of the corpus.

Only distinct fingerprints are filed, so copies cost nothing. A bucket emits a spanning forest of
its links rather than all of them, which has the same components. A bucket of many fingerprints, such
as a template filled in many ways, is filed again by the same rule over the bits that may still
differ, so that its parts are buckets of their own, dealt over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import map_arrow, stage, utf8

SEED = 42
BLOCKS = 6
MAX_BITS = 3
SPLIT_OVER = 2048


def fingerprint(data: bytes | None, width: int = 3) -> int:
    """Unsigned fingerprint of a text's lower-cased (A-Z) words; 0 if it has none."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(text, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(text[a:b], SEED) for a, b in
                  zip(starts.tolist(), ends[width - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = np.array(hashes[at:at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp) per row of `docs`, fp as a signed long. A null or empty text gives 0."""
    def step(cols):
        values = [fingerprint(v.as_py()) for v in cols["_text"]]
        return {id_col: cols[id_col], "fp": np.array(values, np.uint64).view(np.int64)}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(id_col, utf8(text_col).alias("_text")),
                     f"`{id_col}` {kind}, fp long", step)


def block_masks(blocks: int, free: int, mask: int = (1 << 64) - 1) -> list[int]:
    """For each choice of `blocks - free` blocks of the bits in `mask`, the mask of their bits."""
    bits = [b for b in range(64) if mask >> b & 1]
    parts = [sum(1 << int(b) for b in part) for part in np.array_split(bits, blocks)]
    return [sum(chosen) for chosen in combinations(parts, blocks - free)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _links(fps: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of a spanning forest of the links inside each run of equal `group`."""
    label = np.arange(len(fps))
    found: list[tuple[int, int]] = []
    at, lag = np.arange(len(fps)), 0

    def root(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    while True:
        lag += 1
        at = at[at + lag < len(fps)]
        at = at[group[at] == group[at + lag]]
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + lag]) <= max_bits
        a, b = at[near], at[near] + lag
        open_ = label[a] != label[b]
        for x, y in zip(a[open_].tolist(), b[open_].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                label[max(rx, ry)] = min(rx, ry)
                found.append((x, y))
        while open_.any():
            flat = label[label]
            if (flat == label).all():
                break
            label = flat
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _forest(mask: np.ndarray, key: np.ndarray, fps: np.ndarray,
            max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole buckets, sorted by (mask, key)."""
    new = np.ones(len(fps), bool)
    new[1:] = (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])
    a, b = _links(fps, np.cumsum(new), max_bits)
    return fps[a], fps[b]


def _file(fps: DataFrame, masks: Column) -> DataFrame:
    """(fp, mask, key) for every mask of an array."""
    return fps.select("fp", F.explode(masks).alias("mask")).withColumn(
        "key", F.col("fp").bitwiseAND(F.col("mask")))


def _narrower(masks: list[int], max_bits: int) -> Column:
    """For a row's mask, the masks that fix some of the other bits as well."""
    finer = [F.lit(x) for m in masks for x in (_signed(m), F.array(*[
        F.lit(_signed(m | part)) for part in block_masks(BLOCKS, max_bits, ((1 << 64) - 1) & ~m)]))]
    return F.create_map(*finer)[F.col("mask")]


def filed(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(fp, mask, key): distinct fingerprints under each of their buckets.

    Any two that differ in at most `max_bits` bits share a bucket. Buckets of more than SPLIT_OVER
    fingerprints are replaced by narrower ones, of at most 2**15 fingerprints each.
    """
    masks = block_masks(blocks, max_bits)
    once = stage(fps.select("fp").distinct(), "distinct")
    rows = _file(once, F.array(*[F.lit(_signed(m)) for m in masks]))
    large = stage(rows.groupBy("mask", "key").agg(F.count("*").alias("_n"))
                  .where(F.col("_n") > SPLIT_OVER).drop("_n"), "large")
    wide = rows.join(large, ["mask", "key"], "left_semi")
    return rows.join(large, ["mask", "key"], "left_anti").select("fp", "mask", "key").unionByName(
        _file(wide, _narrower(masks, max_bits)))


def near_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct fingerprints at most `max_bits` apart.

    A subset of all such links with the same connected components; a link may repeat.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            a, b = _forest(*rows, max_bits)
            if len(a):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held = [np.empty(0, np.uint64)] * 3
        for batch in batches:
            held = [np.concatenate((h, batch.column(n).to_numpy().view(np.uint64)))
                    for h, n in zip(held, ("mask", "key", "fp"))]
            same = (held[0] == held[0][-1:]) & (held[1] == held[1][-1:])
            cut = int(np.argmax(same)) if len(same) else 0  # the last bucket may go on
            if cut:
                yield from out([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield from out(held)

    return (filed(fps, max_bits, blocks).repartition("mask", "key")
            .sortWithinPartitions("mask", "key", "fp").mapInArrow(run, "a long, b long"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`.

    component_id is the smallest id reachable over links, the row's own included; rows with a
    null id take part in links and have the group's smallest id (null if it has none). Repeated
    rows come out as often as they came in. No rows give no rows.
    """
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    # an fp -> smallest id of its rows; summed per task first, so copies don't meet in one task
    least = rows.groupBy("fp").agg(F.min(id_col).alias("_least"))
    roots = components(near_links(rows, max_bits), "a", "b")
    rooted = least.join(roots, least.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "_least")
    rooted = stage(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("_least").alias("component_id"))
    classes = stage(rooted.join(smallest, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(id_col, "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without near duplicates: of each group the row with the smallest id stays.

    Rows are told apart by their id and a hash of their text. Of rows that repeat an id, the one with
    the smallest hash stands for it, so a text of its own under a repeated id stays; rows
    without an id come last, and one of a group of such rows stays. Of equal rows one stays.
    """
    me = F.struct(F.col(id_col).isNull().alias("_last"), F.col(id_col).alias("_id"),
                  F.xxhash64(text_col).alias("_text"))
    named = docs.select(me.alias("_me"), F.struct("*").alias("_row"))
    groups = near_groups(named.select("_me", F.col(f"_row.{text_col}").alias("text")), "_me", "text")
    chosen = stage(groups.where(F.col("_me") == F.col("component_id")).select("_me").distinct(),
                   "chosen")
    return named.join(chosen, "_me", "left_semi").dropDuplicates(["_me"]).select("_row.*")
