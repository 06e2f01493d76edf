from __future__ import annotations

import random
import re
import time

import pytest

from reviewlake.llm import decontaminate as dc


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def plain(docs, items):
    out = set()
    for doc_id, text in docs:
        d = words(text)
        for item_id, item in items:
            t = words(item)
            n = min(len(t), dc.WINDOW)
            if len(t) < dc.SHORTEST:
                continue
            best = max((sum(x == y for x, y in zip(d[i:i + n], t[j:j + n]))
                        for i in range(len(d) - n + 1) for j in range(len(t) - n + 1)), default=0)
            if best >= n - (dc.tolerance(n) if n >= dc.SPAN else 0):
                out.add((doc_id, item_id, best))
    return out


def frames(spark, docs, items):
    return (spark.createDataFrame(docs, "doc_id long, text string").selectExpr(
        "*", "1 AS item_id", "2 AS _seed"),
        spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_windows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", broadcast)
    rng = random.Random(4)
    vocabulary = "a b c d e f g h i j".split()
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(2, 30)))) for i in range(16)]
    items += [(99, None), (98, ""), (0, items[0][1])]
    docs = []
    for i in range(80):
        text = rng.choices(vocabulary, k=rng.randrange(20))
        passage = (rng.choice(items)[1] or "").upper().split(" ")
        for _ in range(rng.randrange(5)):
            passage[rng.randrange(len(passage))] = "Zz,"
        at = rng.randrange(len(text) + 1)
        docs.append((i, " - ".join(text[:at] + passage + text[at:])))
    docs += [(None, items[3][1] + " x"), (80, None), (81, ""), (5, docs[5][1])]
    got = dc.leaks(*frames(spark, docs, items)).collect()
    assert {tuple(r) for r in got} == plain(docs, items)
    assert len(got) == len({tuple(r) for r in got})


def test_clean(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs, items = frames(spark, [(1, "x " + passage), (2, "other"), (None, passage), (3, None),
                                 (4, passage.replace("six", "6")), (2, "other")], [(1, passage)])
    kept = dc.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "2", "3"]
    same, _ = frames(spark, [(1, "x " + passage), (1, "its own text"), (None, "y")], [])
    assert sorted(r.text for r in dc.clean(same, items).collect()) == ["its own text", "y"]
    assert dc.leaks(docs.limit(0), items).count() == dc.leaks(docs, items.limit(0)).count() == 0
    assert dc.clean(docs, items.limit(0)).count() == docs.count()


def test_tolerance():
    assert [dc.tolerance(n) for n in (8, 9, 10, 12, 13, 50)] == [0, 0, 1, 1, 2, 2]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_a_long_text(spark, monkeypatch, broadcast):
    """Time grows with the words of a text, not with their square."""
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", broadcast)
    passage = " ".join(f"w{i}" for i in range(14))
    filler = "".join(f"word{i % 9973} " for i in range(1_000_000))
    docs, items = frames(spark, [(1, filler + passage)], [(7, passage)])
    began = time.perf_counter()
    assert [tuple(r) for r in dc.leaks(docs, items).collect()] == [(1, 7, 13)]
    assert time.perf_counter() - began < 30


@pytest.mark.parametrize("at", range(45, 90))
def test_every_place_around_the_ends_of_slices(spark_rows, at):
    assert spark_rows[at] == {(at, 1, 13), (at, 2, 10), (at, 3, 5)}


@pytest.fixture(scope="module")
def spark_rows(spark):
    """Passages of each kind of item that begin at every place around the end of a slice."""
    a, b, c = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 13), ("b", 11), ("c", 5)))
    b_found = b[:4] + ["other"] + b[5:]
    docs = [(at, " ".join([f"f{i}" for i in range(at)] + a + b_found + c)) for at in range(45, 90)]
    items = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, "f1 f2 f3"), (5, "c0 c2")]
    got = {at: set() for at, _ in docs}
    frame = frames(spark, docs, items)
    assert {r.item_id for r in dc.unsearched(frame[1]).collect()} == {4, 5}
    for r in dc.leaks(*frame).collect():
        got[r.doc_id].add(tuple(r))
    return got


def test_scripts_without_spaces(spark):
    text = "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c\u6240\u4ee5\u6bcf\u4e2a\u5b57\u90fd\u7b97"
    docs, items = frames(spark, [(1, "x" + text + "y"), (2, text[:6] + "\u3042" + text[7:]),
                                 (3, text[:5]), (4, "abc")], [(1, text), (2, "none of these here")])
    assert {tuple(r) for r in dc.leaks(docs, items).collect()} == {(1, 1, 13), (2, 1, 12)}


def test_sql_on_the_same_rows(spark):
    """The registered SQL, with short items and letters of their own among the words."""
    import duckdb

    rng = random.Random(9)
    words_ = ["\u4e2d", "\u6587", "\u3042\u30a2", "ab", "Cd", "\u0e01\u0e32", "7", "\u00e9"]
    items = [(i, rng.choice([" ", ""]).join(rng.choices(words_, k=rng.randrange(2, 20))))
             for i in range(20)]
    docs = [(i, " ".join(rng.choices(words_, k=20)) + rng.choice(["", " "]) + rng.choice(items)[1])
            for i in range(60)]
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    wanted = set(con.execute(dc.leaks_sql()).fetchall())
    assert {tuple(r) for r in dc.leaks(*frames(spark, docs, items)).collect()} == wanted
    assert len(wanted) > 30


def shuffled(spark):
    """Bytes written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = sc.statusStore().stageList(None, False, False, none, spark._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_shuffled_seeds_carry_no_words(spark, monkeypatch):
    """Past the broadcast the bytes shuffled are in proportion to the words, not to their square."""
    text = [f"word{i}" for i in range(4000)]
    docs, items = frames(spark, [(1, " ".join(text)), (2, " ".join(text[:20])), (3, "x")],
                         [(7, " ".join(text[3000:3050])), (8, " ".join(text[5:19]))])
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = shuffled(spark)
        got = {tuple(r) for r in dc.leaks(docs, items).collect()}
        moved = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {(1, 7, 13), (1, 8, 13), (2, 8, 13)}
    assert 0 < moved < 1_000_000, moved


@pytest.mark.parametrize("broadcast", [0, 1000])
@pytest.mark.parametrize("key", [None, 5])
def test_texts_of_one_id(spark, monkeypatch, key, broadcast):
    """Texts that share an id, or have none, are each searched; item rows that share one as well."""
    monkeypatch.setattr(dc, "BROADCAST_SEEDS", broadcast)
    parts = [" ".join(f"{c}{i}" for i in range(20)) for c in "abc"]
    docs, items = frames(spark, [(key, parts[0]), (key, parts[1]), (key, parts[1]), (6, "x")],
                         [(1, parts[0]), (2, parts[1]), (2, parts[2]), (None, parts[1])])
    got = sorted((tuple(r) for r in dc.leaks(docs, items).collect()), key=str)
    assert got == sorted([(key, 1, 13), (key, 2, 13), (key, None, 13)], key=str)
