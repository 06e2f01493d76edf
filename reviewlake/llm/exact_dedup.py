"""Exact duplicates by an extendible-hash index on shared files.

The index has one record per text, filed under the 64-bit hash of its bytes. A bucket is a range of
hashes: all that share their first `depth` bits. The directory has a slot for every value of the
first bits; it doubles (one more bit) until no slot holds more records than a bucket may, and slots
that fit into one bucket share it. The index is written in ranges of buckets, each task owning whole
ones, sorted by hash.

Texts are equal if their bytes are. Where several rows have a hash, their bytes are compared: Spark
groups them by text. A hash with more than one text (a collision) gets a chain: a record for each,
told apart by their bytes. Only rows that share their hash with another one are compared, so
only they move as text; everything else is narrow. Copies are counted in tasks before they are sent,
and no step gathers the rows of a text.

Everything is column expressions.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stage

CAPACITY = 10_000  # records of a bucket


def text_hash(text: str) -> Column:
    return F.xxhash64(F.col(text))


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text).cast("binary"), F.lit(b""))


def _slot(bits: int) -> Column:
    """The first `bits` bits of the hash."""
    return F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")


def directory(records: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, depth, bucket) for each used slot, and the number of bits of a slot.

    `depth` is the number of bits that the records of the slot's bucket share, `bucket` its first
    slot. One job counts slots; each doubling is one more, over hashes only.
    """
    n = records.count()
    bits = ceil(log2(n / capacity)) if n > capacity else 0
    while True:
        slots = stage(records.groupBy(_slot(bits).alias("slot")).agg(F.count("*").alias("n")),
                      "slots")
        if bits == 64 or (slots.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        bits += 1
    depths = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    depths = depths.withColumn("prefix", F.expr(f"shiftright(slot, {bits} - depth)"))
    fitting = depths.groupBy("depth", "prefix").agg(F.sum("n").alias("load")).where(
        F.col("load") <= capacity)
    least = depths.join(fitting, ["depth", "prefix"]).groupBy("slot").agg(
        F.min("depth").alias("depth"))
    first = F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)")
    return stage(least.withColumn("bucket", first), "directory"), bits


def _group() -> list[Column]:
    """Size of a group, the id that stays, and which of the rows with that id."""
    return [F.count("*").alias("n"), F.max("id").alias("keep_id"),
            F.coalesce(F.max_by("row", "id"), F.min("row")).alias("keep_row")]


def build_index(entries: DataFrame, texts: DataFrame,
                capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The index (bucket, depth, key, link, n, keep_id, keep_row), and the rows (id, row, sha,
    key, link) of chains.

    `entries` has (id, row, key, sha), `texts` (id, key, text) of the same documents. `link` is a
    text's place in the chain of its hash, null for the only text of a hash.
    """
    records = stage(entries.groupBy("key").agg(*_group()), "records")
    shared = stage(records.where("n > 1").select("key"), "shared")
    # by text alone: the key follows from it, and a hot key can then be split before the grouping
    distinct = (texts.join(shared, "key", "left_semi")
                .groupBy("text").agg(F.first("key").alias("key")))
    chained = stage(distinct.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1")
                    .select("key"), "chained")
    rows = stage(texts.join(chained, "key", "left_semi")
                 .withColumn("row", F.monotonically_increasing_id()), "chain-rows")
    links = rows.groupBy("key", "text").agg(*_group()).withColumn(
        "link", F.row_number().over(W.partitionBy("key").orderBy("text")))
    links = stage(links, "links")
    chain_rows = stage(rows.join(links, ["key", "text"]).select(
        "id", "row", F.unhex(F.sha2("text", 256)).alias("sha"), "key", "link"), "chain-links")
    plain = records.join(chained, "key", "left_anti").withColumn("link", F.lit(None).cast("int"))
    all_records = plain.unionByName(links.drop("text"))
    slots, bits = directory(all_records, capacity)
    placed = (all_records.withColumn("slot", _slot(bits)).join(slots, "slot")
              .select("bucket", "depth", "key", "link", "n", "keep_id", "keep_row"))
    index = placed.repartitionByRange("bucket").sortWithinPartitions("bucket", "key", "link")
    return stage(index, "index"), chain_rows


def equal_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of `docs`.

    Null texts count as empty, and all empty ones are equal. Of equal texts the row with the
    largest id stays; of rows that repeat that id one, and of rows that all have a null id one,
    which then names nothing (`keep_id` null). No rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), _bytes(text_col).alias("text"))
    rows = rows.withColumn("key", text_hash("text"))
    entries = stage(rows.select("id", F.monotonically_increasing_id().alias("row"), "key",
                                F.unhex(F.sha2("text", 256)).alias("sha")), "entries")
    index, chain_rows = build_index(entries, rows, capacity)
    single = index.where("link IS NULL").drop("link")
    chains = index.where("link IS NOT NULL")
    found = (entries.join(single, "key").select(*_outcome(id_col))
             .unionByName(chain_rows.join(chains, ["key", "link"]).select(*_outcome(id_col))))
    return found


def _outcome(id_col: str) -> list[Column]:
    return [F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"),
            (F.col("row") == F.col("keep_row")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256")]


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
