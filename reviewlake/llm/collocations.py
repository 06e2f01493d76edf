"""Collocations: phrases of two to four words that stand together more than their parts do.

Everything is per language. A phrase is frequent if it occurs MIN_COUNT times or more inside pieces
of text; a frequent phrase has frequent words only (Apriori), so words are counted first and all
others become breaks.

1. Words are counted; frequent ones get numbers, and texts become arrays of numbers. Texts of
   about POSITIONS words together are a block.
2. Every run of two to four numbers is hashed into one of about half as many buckets as there are
   words. Tasks count their buckets, the sums of a shard of buckets come together in one task, which
   tells each block the full ones among its own. A phrase whose bucket is not full is not frequent:
   what is left are a block's candidates, a safe superset of its frequent phrases.
3. The candidates of a block become double-array tries, each of bounded size.
   The states of all text positions advance together, word by word in two digits each:
   next = base[state] + digit, valid if check[next] == state. Accepting states are counted with bincount, and the counts of all
   blocks are summed by shard.
4. Scores, cuts and containment are joins over the frequent phrases.

Every text meets the buckets and phrases of its own block only, so each step is one pass whatever
their number in all. Only the dictionary is broadcast: DICTIONARY words at a time, more of them
means more passes. Numbered texts, buckets and counts are written in between, so a lost executor
costs one pass of its tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from math import ceil, isqrt, log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import stage

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
CONTAINED = 80  # percent of a phrase's occurrences that stand inside one longer phrase
SCALE = 2_000_000

DICTIONARY = 2_000_000  # words looked up in one pass: about 50 MB as Arrow
LOOKED = 1 << 20  # words looked up at once
SLICE = 1 << 27  # bits that tell the full buckets of a block: 16 MB, buckets that agree share one
SHARD = 1 << 18  # buckets summed in one task, or more if there are over SHARDS times as many
SHARDS = 1 << 10
TRIE = 500_000  # phrases of a trie
POSITIONS = 1 << 21  # of text, handled at once
COUNTED = 1 << 14  # full buckets whose phrases are summed in one task
FEW = 64  # children of a state that is placed together with others
NUMBERED = 16_384  # words numbered in one group
RANKED = 50_000  # phrases ranked in one group before the whole language is
TEXT = 1 << 20  # bytes of a text split into words at once

# What ends a piece of text.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
BREAK = b"\xff"  # in no UTF-8 text
_CUT = bytes.maketrans(b"\t" + SEPARATORS, b" " + b"\n" * len(SEPARATORS))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased, with BREAK between pieces."""
    return text.lower().translate(_CUT).replace(b"\n", b" " + BREAK + b" ").split()


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words."""
    at = 0
    while at < len(text):
        end = at + TEXT
        while end < len(text) and text[end] not in b" \t" + SEPARATORS:
            end += 1
        yield text[at:end]
        at = end


def count_words(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of documents (lang, text); tasks add up before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        size = 0

        def out():
            for lang, counts in seen.items():
                counts.pop(BREAK, None)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(lang, len(counts)).cast(pa.string()),
                     pa.array(counts.keys(), pa.binary()),
                     pa.array(counts.values(), pa.int64())], names=["lang", "word", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(),
                                  batch.column("text").to_pylist()):
                counts = seen.setdefault(lang, Counter())
                size -= len(counts)
                for part in _parts(text):
                    counts.update(words(part))
                size += len(counts)
                if size > 500_000:
                    yield from out()
                    size = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(
        F.sum("n").alias("n"))


def number_words(frequent: DataFrame) -> tuple[DataFrame, int]:
    """(id, lang, word, n, part) with ids from 1, and the number of dictionary parts."""
    n = frequent.count()
    groups, parts = max(1, ceil(n / NUMBERED)), max(1, ceil(n / DICTIONARY))
    group = F.pmod(F.xxhash64("lang", "word"), F.lit(groups))
    place = F.row_number().over(W.partitionBy("_group").orderBy("lang", "word")) - 1
    numbered = frequent.withColumn("_group", group).select(
        (place * groups + F.col("_group") + 1).cast("int").alias("id"), "lang", "word", "n")
    return stage(numbered.withColumn("part", F.col("id") % parts), "words"), parts


def _squeezed(ids: np.ndarray) -> np.ndarray:
    """Without zeros that follow another one, and without a zero at the beginning."""
    zero = ids == 0
    return ids[~(zero & np.append(True, zero[:-1]))]


def _dictionary(table: pa.Table) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """By language its words and their numbers, and 0: as Arrow, far smaller than Python's objects."""
    langs = table.column("lang").combine_chunks().dictionary_encode()
    of = langs.indices.to_numpy()
    order = pa.array(np.argsort(of, kind="stable"))
    known, ids = (table.column(c).combine_chunks().take(order) for c in ("word", "id"))
    out, begin = {}, 0
    for lang, n in zip(langs.dictionary.to_pylist(), np.bincount(of).tolist()):
        out[lang] = known.slice(begin, n), np.append(ids.slice(begin, n), 0).astype("<i4")
        begin += n
    return out


def _numbers(texts: Iterable[tuple[str, bytes]],
             dictionary: dict[str, tuple[pa.Array, np.ndarray]]) -> Iterator[np.ndarray]:
    """The numbers of the words of each text, 0 for breaks and words not in the dictionary."""
    held: list[tuple[str, list[bytes] | None]] = []  # None behind the last part of a text
    size, ids = 0, [np.empty(0, "<i4")]

    def looked_up() -> Iterator[np.ndarray | None]:
        by_lang: dict[str, list[bytes]] = {}
        for lang, found in held:
            by_lang.setdefault(lang, []).extend(found or ())
        numbers, begin = {}, dict.fromkeys(by_lang, 0)
        for lang, found in by_lang.items():
            numbers[lang] = np.zeros(len(found), "<i4")
            if lang in dictionary:
                known, number = dictionary[lang]
                at = pc.index_in(pa.array(found, pa.binary()), value_set=known)
                at = at.fill_null(len(known)).to_numpy()
                numbers[lang] = number[at]
        for lang, found in held:
            if found is not None:
                a, begin[lang] = begin[lang], begin[lang] + len(found)
                yield numbers[lang][a:begin[lang]]
            else:
                yield None

    for lang, text in chain(texts, [(None, None)]):
        for found in chain(map(words, _parts(text)), [None]) if text is not None else ():
            held.append((lang, found))
            size += len(found or ())
        if size >= LOOKED or text is None:
            for part in looked_up():
                if part is not None:
                    ids.append(part)
                else:
                    yield np.concatenate(ids)
                    ids = [np.empty(0, "<i4")]
            held, size = [], 0


def _in_blocks(texts: Iterable[np.ndarray], block: int) -> Iterator[pa.RecordBatch]:
    """Rows (block, ids, own): texts of about POSITIONS numbers together, from `block` on.

    A phrase may begin in the first `own` numbers of a row. A longer text is cut with LONGEST - 1
    numbers of overlap, which begin theirs in the next block; the row before them ends its block.
    """
    held, size = [], 0

    def out() -> pa.RecordBatch:
        ids, own = zip(*held)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(block, pa.int64()), len(held)),
             pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(own, pa.int32())],
            names=["block", "ids", "own"])

    for ids in texts:
        for at in range(0, len(ids), POSITIONS):
            part, more = ids[at:at + POSITIONS + LONGEST - 1], at + POSITIONS < len(ids)
            held.append((part, POSITIONS if more else len(part)))
            size += len(part) + LONGEST
            if size >= POSITIONS or more:
                yield out()
                held, size, block = [], 0, block + 1
    if held:
        yield out()


def encode(docs: DataFrame, numbered: DataFrame, parts: int) -> DataFrame:
    """(block, ids, own) of documents (lang, text): little-endian ints, 0 for breaks and rare words.

    One pass per part of the dictionary, which fills in the words of that part.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("ids", F.lit(None).cast("binary"))
    for part in range(parts):
        table = numbered.where(F.col("part") == part).select("lang", "word", "id").toArrow()
        shared, last = spark.sparkContext.broadcast(table), part == parts - 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting = deque()

            def texts():
                for batch in batches:
                    for row in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "ids"))):
                        waiting.append(row)
                        yield row[:2]

            def filled():
                for ids in _numbers(texts(), _dictionary(shared.value)):
                    lang, text, before = waiting.popleft()
                    if before is not None:
                        ids = np.maximum(ids, np.frombuffer(before, "<i4"))
                    yield lang, text, ids

            if last:
                yield from _in_blocks((_squeezed(ids) for *_, ids in filled()),
                                      TaskContext.get().partitionId() << 32)
            else:
                held, size = [], 0
                for lang, text, ids in chain(filled(), [(None, b"", None)]):
                    if ids is not None:
                        held.append((lang, text, ids.tobytes()))
                        size += len(text) + ids.nbytes
                    if held and (ids is None or size >= POSITIONS):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(column, kind) for column, kind in zip(
                                zip(*held), (pa.string(), pa.binary(), pa.binary()))],
                            names=["lang", "text", "ids"])
                        held, size = [], 0

        schema = "block long, ids binary, own int" if last else "lang string, text binary, ids binary"
        rows = stage(rows.mapInArrow(run, schema), "numbered")
        shared.destroy()
    return rows


def _joined(rows: Iterable[tuple[bytes, int]]) -> tuple[np.ndarray, int]:
    """Texts (ids, own) of a block end to end with LONGEST zeros behind each.

    With them, the place below which phrases may begin: the text that is cut comes last.
    """
    gap, held = np.zeros(LONGEST, "<i4"), []
    over = 0
    for over, data in sorted(((len(data) // 4 - own, data) for data, own in rows),
                             key=lambda row: row[0]):
        held += [np.frombuffer(data, "<i4"), gap]
    ids = np.concatenate(held)
    return ids, len(ids) - LONGEST - over


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, int]]:
    """Each block with its texts end to end and the place below which phrases may begin."""
    rows = chain.from_iterable(
        zip(*(batch.column(c).to_pylist() for c in ("block", "ids", "own"))) for batch in batches)
    for block, part in groupby(rows, key=lambda row: row[0]):
        yield block, *_joined(row[1:] for row in part)


def _runs(ids: np.ndarray, upto: int, n: int) -> np.ndarray:
    """Places below `upto` where n words follow each other."""
    whole = ids[:len(ids) - n + 1] > 0
    for k in range(1, n):
        whole = whole & (ids[k:len(ids) - n + 1 + k] > 0)
    return np.flatnonzero(whole[:upto])


def _buckets(ids: np.ndarray, at: np.ndarray, n: int, bits: int) -> np.ndarray:
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = (h ^ ids[at + k].astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(32)
    return (h * _MIX) >> np.uint64(64 - bits)


def _squash(values: np.ndarray) -> bytes:
    """Numbers, compressed by the planes of their bytes: most upper ones are alike."""
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return zlib.compress(planes.tobytes(), 1)


def _expand(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _steps(values: np.ndarray) -> np.ndarray:
    return np.diff(values, prepend=values.dtype.type(0))


def _per_shard(shard: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(shard, its part of each column) for each run of equal numbers in `shard`."""
    cuts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[:len(shard)]).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(shard)]):
        yield int(shard[a]), *(c[a:b] for c in columns)


def _shard_size(bits: int) -> int:
    return min(max(SHARD, (1 << bits) // SHARDS), 1 << bits)


def full_buckets(encoded: DataFrame, bits: int, min_count: int) -> DataFrame:
    """(block, shard, places, full): the full ones among the buckets of a block.

    `full`, added up, is the number of full buckets in all. A task's counts stop at `min_count`,
    which changes none.
    """
    size = _shard_size(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, upto in _blocks(batches):
            found = np.concatenate([_buckets(ids, _runs(ids, upto, n), n, bits)
                                    for n in range(2, LONGEST + 1)])
            buckets, counts = np.unique(found, return_counts=True)
            shard = (buckets // np.uint64(size)).astype(np.int64)
            place = (buckets % np.uint64(size)).astype("<u4")
            counts = np.minimum(counts, min_count).astype("<u4")
            rows = [(block, k, _squash(_steps(p)), _squash(c))
                    for k, p, c in _per_shard(shard, place, counts)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column) for column in zip(*rows)],
                    names=["block", "shard", "places", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.int64)

        def places(data: pa.Scalar) -> np.ndarray:
            return np.cumsum(_expand(data.as_py(), "<u4"), dtype=np.int64)

        for data, counts in zip(table.column("places"), table.column("counts")):
            total[places(data)] += _expand(counts.as_py(), "<u4")
        full = total >= min_count
        of_blocks = ((at := places(data))[full[at]].astype("<u4") for data in table.column("places"))
        return pa.table({
            "block": table.column("block"), "shard": table.column("shard"),
            "places": pa.array([_squash(_steps(at)) for at in of_blocks], pa.binary()),
            "full": pa.array([int(full.sum())] + [0] * (len(table) - 1), pa.int64())})

    return stage(
        encoded.mapInArrow(count, "block long, shard long, places binary, counts binary")
        .groupBy("shard").applyInArrow(add, "block long, shard long, places binary, full long"),
        "buckets")


_PHRASE = [f"w{k}" for k in range(LONGEST)]


def _bitmap(full: pa.Table, bits: int) -> np.ndarray:
    """The full buckets of a block, a bit for each or, beyond SLICE, for those that agree in it."""
    size, room = _shard_size(bits), min(SLICE, 1 << bits)
    bitmap = np.zeros(ceil(room / 8), np.uint8)
    for shard, data in zip(full.column("shard").to_pylist(), full.column("places")):
        at = np.cumsum(_expand(data.as_py(), "<u4"), dtype=np.int64)
        at = (at + shard * size) % room
        for k in range(8):
            bitmap[at[at & 7 == k] >> 3] |= np.uint8(1 << k)
    return bitmap


def candidates(ids: np.ndarray, upto: int, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Distinct phrases of a block whose bucket is full, in rows of LONGEST numbers, 0 behind the last.

    A bit that buckets share may let in a phrase that is not frequent, which its sum tells. So may
    one whose beginning is no candidate, so its longer ones need no look.
    """
    found, room = [], np.uint64(min(SLICE, 1 << bits))
    at = np.flatnonzero(ids[:upto])
    for n in range(2, LONGEST + 1):
        at = at[ids[at + n - 1] > 0]
        bit = (_buckets(ids, at, n, bits) % room).astype(np.int64)
        at = at[(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1) > 0]
        one = at[_distinct(ids, at, n)]
        found.append(ids[one[:, None] + np.arange(LONGEST)]
                     * (np.arange(LONGEST) < n).astype("<i4"))
    return np.concatenate(found)


def _distinct(ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Indices into `at` of one occurrence of every phrase of n words."""
    code, index = ids[at].astype(np.uint64), np.arange(len(at))
    for k in range(1, n):
        _, index, code = np.unique(code << np.uint64(32) | ids[at + k].astype(np.uint64),
                                   return_index=True, return_inverse=True)
        code = code.astype(np.uint64)
    return index


class Trie(NamedTuple):
    """A double array over the words of its phrases, numbered from 1 in their order.

    First words are states of their own number. Others are read as two digits, as a state may have
    many words behind it, whose numbers lie far apart: no room has the shape that they ask for. The
    child of state s by digit d is base[s] + d if check[] there is s. accept[] is the phrase that a
    state ends, or -1.
    """
    words: np.ndarray
    base: np.ndarray
    check: np.ndarray
    accept: np.ndarray
    phrases: np.ndarray

    def count(self, ids: np.ndarray, upto: int) -> np.ndarray:
        """Occurrences of every phrase that begin below `upto`; LONGEST zeros end the text."""
        known = np.zeros(max(ids.max(initial=0), self.words.max(initial=0)) + 1, np.int32)
        known[self.words] = np.arange(1, len(self.words) + 1)
        local = known[ids]
        at = np.flatnonzero(local[:upto])
        state = local[at]
        counts = np.zeros(len(self.phrases), np.int64)
        for k in range(1, LONGEST):
            at, state = at[local[at + k] > 0], state[local[at + k] > 0]
            for digit in _digits(len(self.words)):
                next_ = self.base[state] + digit(local[at + k])
                valid = self.check[next_] == state
                at, state = at[valid], next_[valid]
            ends = self.accept[state]
            counts += np.bincount(ends[ends >= 0], minlength=len(counts))
        return counts


def _digits(n: int) -> list[Callable[[np.ndarray], np.ndarray]]:
    """The two digits of numbers from 1 to n, from 1 to about its root."""
    many = isqrt(n) + 1
    return [lambda word: word // many + 1, lambda word: word % many + 1]


def build_trie(phrases: np.ndarray, seed: int = 5) -> Trie:
    """A trie of phrases of two words or more: rows of word numbers, zeros behind the last."""
    phrases = phrases[np.lexsort(phrases.T[::-1])]
    vocabulary = np.unique(phrases[phrases > 0])
    local = np.where(phrases > 0, np.searchsorted(vocabulary, phrases) + 1, 0)
    digits = _digits(len(vocabulary))
    local = np.column_stack([local[:, 0], *(np.where(w > 0, digit(w), 0)
                                            for w in local[:, 1:].T for digit in digits)])
    widest = int(local[:, 1:].max(initial=0))
    top = max(len(vocabulary), widest)
    other = np.logical_or.accumulate(local[1:] != local[:-1], axis=1)
    states = int((local[:1, 1:] > 0).sum() + (other & (local[1:] > 0))[:, 1:].sum())
    room = 2 * (top + 1) + 3 * states
    end = room  # nothing is behind it
    base, check = np.zeros(room, np.int32), np.full(room, -1, np.int32)
    check[:top + 1] = 0  # first words
    rng = np.random.default_rng(seed)
    slots = local[:, 0].copy()  # state of each phrase's first k words
    owner = np.empty(room, np.int64)
    ends = []
    for k in range(1, local.shape[1]):
        rows = np.flatnonzero(local[:, k])
        parent, label = slots[rows], local[rows, k]
        new = np.append(True, (parent[1:] != parent[:-1]) | (label[1:] != label[:-1]))[:len(rows)]
        parent_of, label_of = parent[new], label[new]
        begin = np.flatnonzero(np.append(True, parent_of[1:] != parent_of[:-1])[:len(parent_of)])
        sizes = np.diff(np.append(begin, len(parent_of)))
        slot_of = np.zeros(len(parent_of), np.int64)
        for least, most in ((FEW + 1, top), (9, FEW), (4, 8), (2, 3)):
            some = np.flatnonzero((sizes >= least) & (sizes <= most))
            # the children of a state keep their distances: many states look for room at once
            for _ in range(32 if most <= FEW else 0):
                n = sizes[some]
                of = np.repeat(np.arange(len(some)), n)
                member = np.arange(len(of)) + np.repeat(begin[some] - np.cumsum(n) + n, n)
                low = top + 1 - label_of[begin[some]]
                high = room - label_of[begin[some] + n - 1]
                at = low + (rng.random(len(some)) * (high - low)).astype(np.int64)
                slot = at[of] + label_of[member]
                owner[slot] = of
                fits = np.ones(len(some), bool)
                fits[of[(check[slot] >= 0) | (owner[slot] != of)]] = False
                inside = fits[of]
                slot_of[member[inside]] = slot[inside]
                check[slot[inside]] = parent_of[member[inside]]
                base[parent_of[begin[some[fits]]]] = at[fits]
                some = some[~fits]
                if len(some) < 8:
                    break
            for g in some[np.argsort(-sizes[some], kind="stable")].tolist():  # the rest one by one
                a, b = begin[g], begin[g] + sizes[g]
                labels = label_of[a:b]
                low, high = top + 1 - labels[0], room - labels[-1]
                for _ in range(8):
                    tries = rng.integers(low, high, 16)
                    fits = (check[tries[:, None] + labels] < 0).all(axis=1)
                    if fits.any():
                        at = tries[np.argmax(fits)]
                        break
                else:  # behind everything
                    at, end = end - labels[0], end + int(labels[-1] - labels[0]) + 1
                    if end > len(check):
                        more = max(end - len(check), len(check) // 4)
                        base = np.append(base, np.zeros(more, np.int32))
                        check = np.append(check, np.full(more, -1, np.int32))
                slot_of[a:b] = at + labels
                check[slot_of[a:b]] = parent_of[a]
                base[parent_of[a]] = at
        single = begin[sizes == 1]
        free = np.flatnonzero(check[top + 1:] < 0)[:len(single)] + top + 1
        slot_of[single] = free
        check[free] = parent_of[single]
        base[parent_of[single]] = free - label_of[single]
        slots[rows] = slot_of[np.cumsum(new) - 1]
        last = rows[(local[rows, k + 1] == 0) if k + 1 < local.shape[1] else slice(None)]
        ends.append((slots[last], last))
    size = max(end, int(base.max(initial=0)) + widest + 1)
    base = np.append(base, np.zeros(max(size - len(base), 0), np.int32))[:size]
    check = np.append(check, np.full(max(size - len(check), 0), -1, np.int32))[:size]
    accept = np.full(size, -1, np.int32)
    for states, rows in ends:
        accept[states] = rows
    return Trie(vocabulary.astype(np.int32), base, check, accept, phrases)


def _pack(table: pa.Table) -> pa.Table:
    """The trie of the phrases of one part, its arrays compressed."""
    trie = build_trie(np.stack([table.column(w).to_numpy() for w in _PHRASE], axis=1))
    return pa.table({"part": table.column("part")[:1]} | {
        name: pa.array([_squash(np.ascontiguousarray(a, "<i4").reshape(-1))], pa.binary())
        for name, a in zip(Trie._fields, trie)})


def _phrases(packed: dict[str, bytes]) -> np.ndarray:
    return _expand(packed["phrases"], "<i4").reshape(-1, LONGEST)


def _unpack(packed: dict[str, bytes]) -> Trie:
    return Trie(*(_expand(packed[name], "<i4") for name in Trie._fields[:-1]), _phrases(packed))


def count_phrases(encoded: DataFrame, full: DataFrame, bits: int, min_count: int) -> DataFrame:
    """(w0, w1, w2, w3, a) of the phrases that occur `min_count` times or more."""
    shards = max(1, ceil((full.agg(F.sum("full")).first()[0] or 0) / COUNTED))

    def count(texts: pa.Table, full: pa.Table) -> pa.Table:
        rows = []
        if len(texts) and len(full):
            ids, upto = _joined(zip(texts.column("ids").to_pylist(),
                                    texts.column("own").to_pylist()))
            phrases = candidates(ids, upto, _bitmap(full, bits), bits)
            for begin in range(0, len(phrases), TRIE):
                trie = build_trie(phrases[begin:begin + TRIE])
                counted = np.column_stack((trie.phrases, trie.count(ids, upto))).astype("<i4")
                words_of, shard = (trie.phrases > 0).sum(axis=1), np.empty(len(counted), np.int64)
                for n in range(2, LONGEST + 1):
                    of = np.flatnonzero(words_of == n)
                    shard[of] = _buckets(trie.phrases.reshape(-1), of * LONGEST, n, bits) % np.uint64(
                        shards)
                order = np.argsort(shard, kind="stable")
                rows += [(k, _squash(_steps(c[:, 0].copy())), _squash(c[:, 1:].T.reshape(-1)))
                         for k, c in _per_shard(shard[order], counted[order])]
        shard, places, data = zip(*rows) if rows else ((), (), ())
        return pa.table({"shard": pa.array(shard, pa.int64()), "places": pa.array(places, pa.binary()),
                         "data": pa.array(data, pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        found = []
        for first, rest in zip(table.column("places"), table.column("data")):
            first = np.cumsum(_expand(first.as_py(), "<i4"), dtype=np.int32)
            found.append(np.vstack((first, _expand(rest.as_py(), "<i4").reshape(LONGEST, -1))))
        phrases = np.concatenate(found, axis=1)
        phrases = phrases[:, np.lexsort(phrases[LONGEST - 1::-1])]
        new = (phrases[:LONGEST, 1:] != phrases[:LONGEST, :-1]).any(axis=0)
        begin = np.flatnonzero(np.append(True, new))
        total = np.add.reduceat(phrases[LONGEST], begin, dtype=np.int64)
        often = total >= min_count
        return pa.table({w: pa.array(phrases[k, begin[often]]) for k, w in enumerate(_PHRASE)}
                        | {"a": pa.array(total[often])})

    return stage(
        encoded.groupBy("block").cogroup(full.groupBy("block"))
        .applyInArrow(count, "shard long, places binary, data binary").groupBy("shard")
        .applyInArrow(add, ", ".join(f"{w} int" for w in _PHRASE) + ", a long"), "frequent")


def _exact(*factors) -> Column:
    """A product in 38 digits."""
    first, *rest = [F.lit(f).cast("decimal(10,0)") if isinstance(f, int)
                    else f.cast("decimal(20,0)") for f in factors]
    for f in rest:
        first = first * f
    return first


def _scored(phrases: DataFrame, numbered: DataFrame, scale: int) -> DataFrame:
    """(key, a, score, l, r): the lowest-scoring cut of each phrase, the first of equal ones."""
    f = phrases.select("key", F.col("a").alias("f")).union(
        numbered.select(F.array("id"), "n"))
    f = stage(f, "counts")
    cuts = phrases.select("key", "a", F.explode(F.sequence(F.lit(1), F.size("key") - 1)).alias("k"))
    cuts = cuts.withColumns({"first": F.expr("slice(key, 1, k)"),
                             "rest": F.expr("slice(key, k + 1, size(key) - k)")})
    both = (cuts.join(f.select(F.col("key").alias("first"), F.col("f").alias("l")), "first")
            .join(f.select(F.col("key").alias("rest"), F.col("f").alias("r")), "rest"))
    both = both.withColumn("_whole", _exact(scale, F.col("a"))).withColumn(
        "score", F.expr("_whole div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))"))
    return both.groupBy("key", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select(
        "key", "a", "c.score", "c.l", "c.r")


def _maximal(phrases: DataFrame, contained: int) -> DataFrame:
    """The phrases that stand mostly outside any one longer phrase."""
    spans = F.expr("""flatten(transform(sequence(2, size(key) - 1), n ->
        transform(sequence(1, size(key) - n + 1), i -> slice(key, i, n))))""")
    inside = phrases.where(F.size("key") > 2).select(
        F.explode(spans).alias("key"), F.col("a").alias("f")).groupBy("key").agg(
        F.max("f").alias("longer"))
    mostly = _exact(100, F.col("longer")) >= _exact(contained, F.col("a"))
    return phrases.join(inside, "key", "left").where(
        ~F.coalesce(mostly, F.lit(False))).drop("longer")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
                 min_count: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED,
                 scale: int = SCALE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` collocations of every language.

    `a` is how often the phrase occurs, `l` and `r` how often the parts of its worst cut do, `n` the
    words of the language, `score` floor(scale * a / (l + r)). Of phrases whose words stand in a
    longer one `contained` percent of the time or more, only the longer one stays. Ties go to the
    larger `a`, then to the smaller phrase in byte order.

    A null language is `und`; a null or empty text has no words; repeated rows count as often as
    they come. No rows give no rows.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    counts = stage(count_words(texts), "word-counts")
    totals = stage(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    numbered, parts = number_words(counts.where(F.col("n") >= min_count))
    encoded = encode(texts, numbered, parts)
    size = totals.agg(F.sum("total")).first()[0] or 0
    bits = max(10, ceil(log2(size / 2))) if size else 10
    frequent = count_phrases(encoded, full_buckets(encoded, bits, min_count), bits, min_count)
    key = F.filter(F.array(*_PHRASE), lambda w: w > 0)
    phrases = stage(frequent.select(key.alias("key"), "a"), "phrases")
    # contained phrases go before anything is scored, but parts may be any phrase
    kept = _maximal(phrases, contained)
    scored = stage(_scored(phrases, numbered, scale).join(kept.select("key"), "key", "left_semi"),
                   "scored")
    named = (scored.select("*", F.posexplode("key").alias("_at", "id"))
             .join(numbered.select("id", "lang", "word"), "id")
             .groupBy("key", "a", "score", "l", "r")
             .agg(F.min("lang").alias("lang"),
                  F.sort_array(F.collect_list(F.struct("_at", "word"))).alias("_words")))
    named = stage(named.select(
        "lang", F.concat_ws(" ", F.transform("_words", lambda w: w["word"].cast("string")))
        .alias("phrase"), "a", "l", "r", "score"), "named")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salts = max(1, ceil(named.count() / RANKED))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts))
    first = named.withColumn("_salt", salt).withColumn("_place", F.row_number().over(
        W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_place") <= top)
    rank = F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")
    return (first.withColumn("rank", rank).where(F.col("rank") <= top)
            .join(totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))


SQL = f"""
WITH t AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\n\\x0b\\f\\r]')) AS piece
        FROM t)),
g AS (
  SELECT lang, k AS len, unnest(list_transform(range(1, len(w) - k + 2),
    lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS phrase
  FROM p, (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k),
f AS (SELECT lang, len, phrase, count(*) AS f FROM g GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
c AS (SELECT lang, len, phrase, f AS a, string_split(phrase, ' ') AS w FROM f
      WHERE len > 1 AND f >= {MIN_COUNT}),
cut AS (SELECT *, unnest(range(1, len)) AS k FROM c),
s AS (
  SELECT cut.lang, cut.phrase, a, k, x.f AS l, y.f AS r,
    CAST(({SCALE} * a::HUGEINT) // (x.f + y.f) AS BIGINT) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(list_slice(w, 1, k), ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(list_slice(w, k + 1, cut.len), ' ')
  QUALIFY row_number() OVER (PARTITION BY cut.lang, cut.phrase ORDER BY score, k) = 1),
span AS (SELECT lang, a, len, w, unnest(range(2, len)) AS m FROM c),
inside AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, unnest(list_transform(range(1, len - m + 2),
      lambda i: array_to_string(list_slice(w, i, i + m - 1), ' '))) AS phrase FROM span) GROUP BY ALL)
SELECT s.lang, row_number() OVER o AS rank, s.phrase, a, l, r, n, score
FROM s JOIN total ON total.lang = s.lang
LEFT JOIN inside i ON i.lang = s.lang AND i.phrase = s.phrase
WHERE i.longer IS NULL OR 100 * i.longer < {CONTAINED} * a
WINDOW o AS (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase)
QUALIFY row_number() OVER o <= {TOP}"""
