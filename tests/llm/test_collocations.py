"""Collocations against plain counting; the trie against looking up every phrase."""

from __future__ import annotations

import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reviewlake.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string"


def plain(rows, min_count, top=c.TOP):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\v\f\r]", lowered):
            words = tuple(re.findall(r"[^ \t]+", piece))
            total[lang] += len(words)
            for n in range(1, 5):
                counts[lang].update(words[i:i + n] for i in range(len(words) - n + 1))
    out = []
    for lang, f in counts.items():
        frequent = {p: n for p, n in f.items() if len(p) > 1 and n >= min_count}
        longest = Counter()
        for p, n in frequent.items():
            for size in range(2, len(p)):
                for i in range(len(p) - size + 1):
                    longest[p[i:i + size]] = max(longest[p[i:i + size]], n)
        found = []
        for p, a in frequent.items():
            if 100 * longest[p] >= 80 * a:
                continue
            score, k = min((c.SCALE * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        found.sort()
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s)
                for i, (s, a, p, l, r) in enumerate(found[:top])]
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "the", "é", "Éa", "zz", "x-y", "1", "\x00q", "ab", "of", "ñ"]
    rows = []
    for i in range(n):
        words = [rng.choices(vocabulary, range(len(vocabulary), 0, -1))[0] + rng.choice(
            [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " "]) for _ in range(
            rng.choice([0, 3, 40, 90]))]
        if rng.random() < 0.3:
            words.insert(0, "in the middle of the night ")
        rows.append((i, "".join(words), rng.choice(["en", "en", "de", None, "und", ""])))
    return rows


def mined(frame, **options):
    return sorted(tuple(r) for r in c.collocations(frame, **options).select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_counting(spark, seed):
    rows = texts(seed)
    got = mined(spark.createDataFrame(rows, SCHEMA), min_count=4)
    assert got == plain(rows, 4) and len(got) > 50


def test_in_many_passes(spark, monkeypatch):
    for name, value in {"DICTIONARY": 5, "NUMBERED": 3, "SHARD": 64, "SLICE": 256, "TRIE": 20, "COUNTED": 3,
                        "POSITIONS": 16, "RANKED": 10, "TEXT": 50}.items():
        monkeypatch.setattr(c, name, value)
    rows = texts(3, 60)
    got = mined(spark.createDataFrame(rows, SCHEMA), min_count=3, top=15)
    assert got == plain(rows, 3, 15) and len(got) > 40


def test_one_pass_whatever_their_number(spark, monkeypatch):
    """The texts are read once for all buckets and once for all phrases, not per slice or trie."""
    for name, value in {"SHARD": 64, "SLICE": 256, "TRIE": 20, "POSITIONS": 200}.items():
        monkeypatch.setattr(c, name, value)
    written, write = Counter(), c.stage
    monkeypatch.setattr(c, "stage", lambda df, label: written.update([label]) or write(df, label))
    rows = texts(5)
    got = mined(spark.createDataFrame(rows, SCHEMA).repartition(3), min_count=3)
    assert got == plain(rows, 3) and len(got) > 50
    assert set(written.values()) == {1}


def test_numbers(monkeypatch):
    """Words are looked up some at a time, across texts and within long ones."""
    for name, value in {"LOOKED": 7, "TEXT": 20}.items():
        monkeypatch.setattr(c, name, value)
    rows = [(lang or "und", (text or "").encode()) for _, text, lang in texts(6)] + [("xx", b"a b")]
    table = pa.table({"lang": ["en", "de", "en", "und", "en"], "word": pa.array(
        [b"a", b"b", "é".encode(), b"of", b"zz"], pa.binary()), "id": pa.array([3, 1, 9, 4, 2], pa.int32())})
    known = {(lang, word): at for lang, word, at in zip(*table.to_pydict().values())}
    got = list(c._numbers(iter(rows), c._dictionary(table)))
    assert [ids.tolist() for ids in got] == [
        [known.get((lang, w), 0) for part in c._parts(text) for w in c.words(part)] for lang, text in rows]
    assert sum(ids.sum() for ids in got) > 0
    assert not any(ids.any() for ids in c._numbers(iter(rows), c._dictionary(table.slice(0, 0))))


@pytest.mark.parametrize("sizes", [[3, 40, 7, 0, 21], [16, 17, 1], [100]])
def test_blocks(monkeypatch, sizes):
    """A phrase begins in one block only, whichever row of its block comes first."""
    monkeypatch.setattr(c, "POSITIONS", 16)
    rng = np.random.default_rng(sum(sizes))
    rows = [rng.integers(1, 50, n).astype("<i4") for n in sizes]
    wanted = Counter(tuple(r[i:i + n].tolist()) for r in rows for n in (2, 3, 4)
                     for i in range(len(r) - n + 1))
    got, blocks = Counter(), defaultdict(list)
    for batch in c._in_blocks(iter(rows), 5):
        for block, data, own in zip(*batch.to_pydict().values()):
            blocks[block].append((data, own))
    for part in blocks.values():
        ids, upto = c._joined(reversed(part))
        for n in (2, 3, 4):
            got.update(tuple(ids[i:i + n].tolist()) for i in c._runs(ids, upto, n))
    assert got == wanted and min(blocks) == 5 and len(blocks) > 1


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_many_states(seed):
    """States with few children are placed together; none takes another's room."""
    rng = np.random.default_rng(seed)
    phrases = rng.zipf(1.4, (6000, 4)) % 700 + 1
    phrases = np.unique(phrases * (np.arange(4) < rng.integers(2, 5, 6000)[:, None]), axis=0)
    ids = np.concatenate((rng.zipf(1.4, 20_000) % 720, np.zeros(4))).astype("<i4")
    trie = c.build_trie(rng.permutation(phrases))
    wanted = Counter(tuple(ids[i:i + n].tolist()) for n in (2, 3, 4) for i in range(len(ids) - n + 1))
    counts = trie.count(ids, len(ids))
    assert trie.phrases.tolist() == phrases.tolist() and counts.sum() > 1000
    assert counts.tolist() == [wanted[tuple(w for w in p if w)] for p in phrases.tolist()]


def test_trie_of_many_hubs():
    """Words with hundreds of others behind them, far apart, take no more room than their phrases do."""
    rng = np.random.default_rng(1)
    phrases = np.concatenate([np.stack((np.full(300, w), rng.choice(20_000, 300, False) + 1), axis=1)
                              for w in range(1, 201)])
    phrases = np.pad(phrases, ((0, 0), (0, 2)))
    trie = c.build_trie(phrases)
    assert len(trie.check) < 10 * len(phrases)
    text = np.concatenate((phrases[rng.permutation(len(phrases)), :3].reshape(-1), np.zeros(4)))
    assert (trie.count(text.astype("<i4"), len(text)) == 1).all()


def test_driver_only_passes_on(spark, monkeypatch):
    """Tasks build the tries and the dictionary of words; the driver holds neither."""
    driver, build = os.getpid(), c.build_trie

    def elsewhere(*args):
        assert os.getpid() != driver, "built in the driver"
        return build(*args)

    rows = texts(4)
    frame = spark.createDataFrame(rows, SCHEMA)
    shared = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(c, "build_trie", elsewhere)
    monkeypatch.setattr(type(spark.sparkContext), "broadcast",
                        lambda self, value: shared.append(value) or send(self, value))
    assert mined(frame, min_count=4) == plain(rows, 4)
    assert not any(isinstance(v, tuple) or isinstance(v, dict) and any(
        isinstance(x, dict) for x in v.values()) for v in shared)


def test_packed_trie():
    phrases = np.array([[5, 2, 0, 0], [5, 2, 9, 0], [1, 1, 1, 70_000]])
    table = pa.table({"part": pa.array([0] * 3, pa.int32())} | {
        f"w{k}": pa.array(phrases[:, k], pa.int32()) for k in range(4)})
    packed = {n: v[0] for n, v in c._pack(table).to_pydict().items() if n != "part"}
    for got, wanted in zip(c._unpack(packed), c.build_trie(phrases)):
        assert np.array_equal(got, wanted)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text, r.lang) for r in odd_docs.collect()] + [
        (1, "one two three four. " * 40, "en"), (2, "one two, three four", None)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS id", "3 AS w0")
    assert mined(frame) == plain(rows, c.MIN_COUNT)
    assert mined(frame, min_count=1) == plain(rows, 1)
    assert mined(no_docs) == []
    assert mined(spark.createDataFrame([(1, None, None), (2, "", "en")], SCHEMA)) == []


def test_products_pass_64_bits(spark):
    n = 9 * 10**17
    phrases = spark.createDataFrame([([1, 2], n)], "key array<int>, a long")
    numbered = spark.createDataFrame([(1, n + 1), (2, n + 2)], "id int, n long")
    row = c._scored(phrases, numbered, c.SCALE).first()
    assert row.score == c.SCALE * n // (2 * n + 3) and (row.l, row.r) == (n + 1, n + 2)


@pytest.mark.parametrize("seed", range(4))
def test_trie(seed):
    rng = np.random.default_rng(seed)
    many = rng.integers(1, 30, (400, 4)) * (np.arange(4) < rng.integers(2, 5, 400)[:, None])
    hub = np.array([[7, w, 0, 0] for w in range(1, 900)])
    phrases = np.unique(np.concatenate((many, hub)), axis=0)
    trie = c.build_trie(rng.permutation(phrases))
    ids = np.concatenate((rng.integers(0, 30, 5000), [7, 899, 7, 500], np.zeros(4))).astype("<i4")
    counts = trie.count(ids, len(ids))
    wanted = Counter(tuple(ids[i:i + n]) for n in (2, 3, 4) for i in range(len(ids) - n + 1))
    assert len(trie.phrases) == len(phrases)
    for phrase, n in zip(trie.phrases.tolist(), counts.tolist()):
        assert wanted[tuple(w for w in phrase if w)] == n
    assert trie.count(ids, 2500).sum() < counts.sum()


def test_words():
    assert c.words("A b\tÀ.c;\x1cd\r\n".encode()) == [
        b"a", b"b", "À".encode(), b"\xff", b"c", b"\xff", b"\x1cd", b"\xff", b"\xff"]
