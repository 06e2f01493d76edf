"""Benchmark decontamination by spaced seeds.

A seed is the hash of the tokens at the fixed positions of MASK; positions in between are ignored,
so a seed survives substitutions there. MASK is chosen so that any window of WINDOW tokens with at
most two substitutions holds at least one intact seed (`tolerance` checks that by enumeration):
no overlap within the tolerance is missed. Seeds of the test items meet those of all training
texts in a hash join, and each hit is verified on the tokens around it. Items shorter than the mask
are found verbatim, by the hash of their first tokens.

Everything is column expressions, in two steps. First, texts are cut into slices of STEP tokens, so
no row grows with its text, and seeds meet as numbers: a place in a text is kept if its seed is
one of an item. Then the texts with such places, few of all, are read again, and the words around a
place are compared with the item's. Seeds of the test items are broadcast only if they are counted
to be few; beyond that the same rows meet by shuffle.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import stage

MASK = (0, 1, 3, 6, 7)
SPAN = MASK[-1] + 1
SHORT_MASK = (0, 1, 2, 3)  # of items with fewer tokens than SPAN
SHORTEST = len(SHORT_MASK)
WINDOW = 13
MAX_SUBSTITUTIONS = 2
REACH = WINDOW - SPAN  # words on either side of a seed that a window with it may hold
STEP = 64  # places of a slice
BROADCAST_SEEDS = 2_000_000  # distinct numbers, 16 bytes each in a task: at most 32 MB
NO_TOKEN = r"[^\p{L}\p{N}]+"
# Scripts that are written without spaces; each of their letters is a token.
UNSPACED = ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")


@cache
def tolerance(n: int) -> int:
    """Substitutions that leave a seed intact in every window of an item of n tokens."""
    n = min(n, WINDOW)
    seeds = [frozenset(a + m for m in MASK) for a in range(n - SPAN + 1)]
    best = -1
    for k in range(MAX_SUBSTITUTIONS + 1):
        if all(any(s.isdisjoint(bad) for s in seeds) for bad in combinations(range(n), k)):
            best = k
    return best


def tokens(text: str) -> Column:
    """Lower-cased runs of letters and digits, single letters in scripts without spaces; none for
    null."""
    plain = F.lower(F.coalesce(F.col(text), F.lit("")))
    unspaced = "([" + "".join(rf"\p{{Is{name}}}" for name in UNSPACED) + "])"
    cut = F.when(F.octet_length(plain) > F.length(plain),
                 F.regexp_replace(plain, unspaced, " $1 ")).otherwise(plain)
    return F.filter(F.split(cut, NO_TOKEN), lambda t: t != "")


def _seeds(words: str, first: Column, count: Column, mask: tuple[int, ...]) -> Column:
    """Seeds at `count` places of `words` from `first` on."""
    at = F.when(count > 0, F.sequence(first, first + count - 1)).otherwise(
        F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(F.col(words), i + m) for m in mask],
                                                F.lit(len(mask))))


def _items(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(_no, item_id, _item, _window, _span, _need): one row per item that is searched, numbered."""
    size = F.size("_item")
    least = F.least(size, F.lit(WINDOW))
    allowed = F.create_map(*[F.lit(x) for n in range(SHORTEST, WINDOW + 1)
                             for x in (n, tolerance(n) if n >= SPAN else 0)])
    return (items.select(F.col(item_col).alias("item_id"), tokens(text_col).alias("_item"))
            .where(size >= SHORTEST)
            .select(F.monotonically_increasing_id().alias("_no"), "item_id", "_item",
                    least.alias("_window"),
                    F.when(size < SPAN, SHORTEST).otherwise(SPAN).alias("_span"),
                    (least - allowed[least]).alias("_need")))


def _item_seeds(searched: DataFrame) -> DataFrame:
    """(_no, _item_at, _seed): every seed of a long item, the first of a short one."""
    count = F.size("_item") - SPAN + 1
    seeds = F.when(count > 0, _seeds("_item", F.lit(0), count, MASK)).otherwise(
        _seeds("_item", F.lit(0), F.lit(1), SHORT_MASK))
    return searched.select("_no", F.posexplode(seeds).alias("_item_at", "_seed"))


def unsearched(items: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of `items` with too few tokens (under SHORTEST) to tell a leak from chance."""
    return items.where(F.size(tokens(text_col)) < SHORTEST)


def _slices(texts: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, _size, _first, _off, _words): pieces of `_text`, STEP tokens from `_first` on.

    `_words` begins at token `_off` and reaches far enough for every window around these places;
    `_size` is the number of tokens of the text.
    """
    # behind a generator the tokens are a column, computed once and not once a slice
    words = texts.select(*keys, F.explode(F.array(tokens("_text"))).alias("_all")).where(
        F.size("_all") >= SHORTEST)
    cut = F.transform(F.sequence(F.lit(0), F.size("_all") - 1, F.lit(STEP)), lambda first: F.struct(
        F.size("_all").alias("_size"), first.alias("_first"),
        F.greatest(first - REACH, F.lit(0)).alias("_off"),
        F.slice("_all", F.greatest(first - REACH, F.lit(0)) + 1, STEP + SPAN + 2 * REACH)
        .alias("_words")))
    return words.select(*keys, F.inline(cut))  # nothing but this needs all tokens


def _placed(texts: DataFrame, short: bool) -> DataFrame:
    """(_key, _at, _seed) for every place of every text; both kinds of seeds if `short`."""
    begin = F.col("_first") - F.col("_off")

    def count(span: int) -> Column:
        return F.greatest(F.least(F.lit(STEP), F.col("_size") - F.col("_first") - span + 1),
                          F.lit(0))

    seeds = _seeds("_words", begin, count(SPAN), MASK)
    place = F.col("_pos")
    if short:
        seeds = F.concat(seeds, _seeds("_words", begin, count(SHORTEST), SHORT_MASK))
        place = F.when(place >= F.col("_long"), place - F.col("_long")).otherwise(place)
    return (_slices(texts, "_key").select("_key", "_first", count(SPAN).alias("_long"),
                                          F.posexplode(seeds).alias("_pos", "_seed"))
            .select("_key", (F.col("_first") + place).alias("_at"), "_seed"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, best_match) for every document that holds a window of an item.

    A window is WINDOW consecutive tokens of the item, or all of them if it has fewer; it matches
    with at most `tolerance` of them replaced, of items shorter than the mask with none. best_match
    is the largest number of equal tokens in a window. Items of under SHORTEST tokens are
    too short to tell a leak from chance; `unsearched` lists them. Null texts hold no tokens; rows
    that repeat an id are one document; null ids come out as null. An empty table on either side
    gives no rows.
    """
    searched = stage(_items(items, item_col, item_text), "items")
    seeds = stage(_item_seeds(searched), "seeds")
    known = stage(seeds.select("_seed").distinct(), "known")
    short = searched.where(F.col("_span") < SPAN).limit(1).count() > 0
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    texts = texts.withColumn("_key", F.xxhash64("doc_id", "_text"))
    few = known.count() <= BROADCAST_SEEDS
    places = stage(_placed(texts, short).join(F.broadcast(known) if few else known, "_seed",
                                              "left_semi"), "places")
    hits = stage(places.distinct().join(seeds, "_seed").select(
        "_key", "_at", F.floor(F.col("_at") / STEP).cast("int").alias("_slice"), "_no",
        "_item_at"), "hits")
    # texts with one key are verified each; equal ones hit alike
    texts = texts.join(stage(hits.select("_key").distinct(), "keys"), "_key", "left_semi")
    pieces = _slices(texts, "_key", "doc_id").withColumn(
        "_slice", F.floor(F.col("_first") / STEP).cast("int"))
    found = pieces.join(hits, ["_key", "_slice"]).join(searched, "_no").select(
        "doc_id", "item_id", _best().alias("best_match"), "_need")
    return (found.where(F.col("best_match") >= F.col("_need"))
            .groupBy("doc_id", "item_id").agg(F.max("best_match").alias("best_match"))
            .withColumnRenamed("doc_id", id_col))


def _best() -> Column:
    """The most equal tokens in any window of the item that holds the seed and fits in both texts."""
    shift = F.col("_at") - F.col("_item_at")  # from item positions to document positions
    window = F.col("_window")
    first = F.greatest(F.col("_item_at") + F.col("_span") - window, -shift, F.lit(0))
    last = F.least(F.col("_item_at"), F.size("_item") - window, F.col("_size") - shift - window)
    equal = F.transform(
        F.sequence(first, last + window - 1),
        lambda t: (F.get("_words", shift + t - F.col("_off")) == F.get("_item", t)).cast("int"))
    counts = F.transform(F.sequence(first, last), lambda a: F.aggregate(
        F.slice(equal, a - first + 1, window), F.lit(0), lambda s, x: s + x))
    return F.when(first <= last, F.array_max(counts)).otherwise(0)


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """`docs` without the rows that leak an item, each judged by its own text, null ids included."""
    name = "_leaking_row"
    named = docs.select(F.struct(F.col(id_col), F.xxhash64(text_col)).alias(name), "*")
    bad = leaks(named, items, name, text_col).select(name).distinct()
    return named.join(stage(bad, "leaking"), name, "left_anti").select(*docs.columns)


def leaks_sql() -> str:
    """The same result by comparing all positions, for DuckDB."""
    need = " ".join(f"WHEN {n} THEN {n - (tolerance(n) if n >= SPAN else 0)}"
                    for n in range(SHORTEST, WINDOW + 1))
    unspaced = "([" + "".join(rf"\p{{{name}}}" for name in UNSPACED) + "])"
    split = (f"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), "
             f"'{unspaced}', ' \\1 ', 'g'), '{NO_TOKEN}'), lambda x: x <> '')")
    return f"""
WITH d AS (SELECT doc_id, {split} AS w FROM documents),
i AS (SELECT item_id, {split} AS w FROM benchmark),
i2 AS (SELECT item_id, w, len(w) AS n, least(len(w), {WINDOW}) AS win,
       CASE least(len(w), {WINDOW}) {need} END AS need FROM i WHERE len(w) >= {SHORTEST}),
dp AS (SELECT doc_id, len(w) AS dn, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM d),
ip AS (SELECT item_id, n, win, need, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM i2),
m AS (SELECT doc_id, item_id, dn, n, win, need, dp.p - ip.p AS shift, ip.p AS p
      FROM dp JOIN ip USING (t)),
g AS (SELECT doc_id, item_id, dn, n, win, need, shift, list(p) AS ps FROM m
      GROUP BY ALL HAVING count(*) >= need),
s AS (SELECT *, unnest(range(greatest(1, 1 - shift),
                             least(n, dn - shift) - win + 2)) AS a FROM g),
c AS (SELECT doc_id, item_id, need,
      len(list_filter(ps, lambda x: x >= a AND x < a + win)) AS k FROM s)
SELECT doc_id, item_id, CAST(max(k) AS INTEGER) AS best_match FROM c WHERE k >= need
GROUP BY doc_id, item_id"""
