from __future__ import annotations

import os.path
import random
import re

import pytest
from pyspark.sql import functions as F

from reviewlake.functions import paths, secrets
from reviewlake.functions.cwe import CWE_KEYWORDS, with_cwe
from reviewlake.functions.text import SPACE, decode_text, has_text, strip

ODD = list("ab /\\'\"=._-\n\r\t\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u2028\u3000éß中😀")


def texts(n: int, alphabet: list[str], seed: int, longest: int = 12) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randrange(longest))) for _ in range(n)]


def apply(spark, values: list, kind: str, *columns):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_decoding_equals_python(spark):
    rng = random.Random(1)
    pool = [b"a", b"\r", b"\n", b"\xc3", b"\xa9", b"\xe2", b"\x82", b"\xac", b"\xff", b"\xf0",
            b"\x9f", b"\x98", b"\x80", b"\xed", b"\xa0"]
    values = [b"".join(rng.choices(pool, k=rng.randrange(9))) for _ in range(2000)]
    wanted = [re.sub("\r\n?", "\n", v.decode("utf-8", errors="replace")) for v in values]
    got = apply(spark, values, "binary", decode_text(F.col("v")))
    assert [g for g, in got] == wanted


def test_whitespace_equals_python(spark):
    values = texts(2000, ODD, 2)
    got = apply(spark, values, "string", has_text(F.col("v")), strip(F.col("v")))
    assert got == [(bool(v.strip()), v.strip()) for v in values]


def test_extension_and_base_name_equal_python(spark):
    values = texts(2000, list("ab./.j"), 3) + ["x.tar.gz", ".js", "..js", "a/.b/c", "a.JS"]
    got = apply(spark, values, "string", paths.extension(F.col("v")), paths.base_name(F.col("v")))
    assert got == [(os.path.splitext(v.split("/")[-1])[1], v.split("/")[-1]) for v in values]


@pytest.mark.parametrize("path,language", [
    ("a.py", "python"), (".py", "python"), ("a.js", "javascript"), ("a.jsx", "javascript"),
    ("a.mjs", "javascript"), ("a.ts", "typescript"), ("a.tsx", "tsx"), (".js", None),
    ("a.JS", None), ("a.js/b", None), ("a.d.ts", "typescript"), ("README", None)])
def test_language(spark, path, language):
    assert apply(spark, [path], "string", paths.language(F.col("v"))) == [(language,)]


@pytest.mark.parametrize("path,review,call_graph", [
    ("a.py", True, True), (".a.py", True, True), (".git/a.py", False, False),
    ("x/.tox/a.py", False, False), ("venv/a.py", False, False), ("venv", True, True),
    ("env/a.py", False, True), ("x/node_modules/y/a.py", False, True), ("build/a.py", False, True),
    ("mybuild/a.py", True, True), ("build.py/a.py", True, True), ("p.egg-info/a.py", True, True),
    ("*.egg-info/a.py", False, True), ("__pycache__/a.py", False, False)])
def test_ignored_folders(spark, path, review, call_graph):
    got = apply(spark, [path], "string", paths.kept_folder(F.col("v")),
                paths.kept_folder(F.col("v"), "call_graph"))
    assert got == [(review, call_graph)]


@pytest.mark.parametrize("url,ok,slug", [
    ("https://github.com/o/r", True, "o/r"), (" https://github.com/o/r.git/ ", True, "o/r"),
    ("https://github.com/o", False, None), ("https://gitlab.com/o/r", False, None), ("", False, None),
    ("https://github.com/o/my.github//", True, "o/my.github"), ("http://github.com/o/r", False, None),
    (None, False, None)])
def test_targets(spark, url, ok, slug):
    from reviewlake.sources.targets import check_targets, validate_targets

    df = spark.createDataFrame([(url,)], "repo_url string")
    row = check_targets(df).first()
    assert (row.error is None, row.slug) == (ok, slug)
    accepted, rejected = validate_targets(df)
    assert (accepted.count(), rejected.count()) == ((1, 0) if ok else (0, 1))


def python_form(secret: secrets.Secret) -> tuple[str, str]:
    """The pattern as Python reads it: its strings are Unicode, with only \\n ending a line."""
    flags, body = re.fullmatch(r"(?:\(\?([a-zA-Z]+)\))?(.*)", secret.pattern, re.S).groups()
    body = body.replace(SPACE, r"\s")
    return ("(?i)" if "i" in (flags or "") else "") + body, secret.replacement.replace("$1", r"\1")


PIECES = [
    "sk-" + "a1" * 12, "sk-short", "AKIA" + "Z9" * 8, "akia", "aws_secret = ", "AWS my SECRET: ",
    "awſ ſecret", "ap\u0131_key", "AP\u0130KEY", "a\u212aia", "\u0131\u0130", '"' + "aB/+" * 10 + '"', "'" + "x" * 25 + "'", "api_key", "API-KEY", "apikey",
    "to\u212aen", "token", "passwd", "pa\u017f\u017fword", "PWD", " = ", "=", "\n", "\u2028", "\xa0",
    "ghp_" + "b2" * 18, "Bearer ", "Bearer\x1f", "bearer ", "c3._-" * 5, " ", "'", '"', "é"]


def test_scrubbing_equals_python(spark):
    values = texts(3000, PIECES, 4, longest=8)
    forms = [python_form(s) for s in secrets.SECRET_PATTERNS]
    wanted, counts = [], [0] * len(forms)
    for v in values:
        for i, (pattern, replacement) in enumerate(forms):
            counts[i] += len(re.findall(pattern, v))
            v = re.sub(pattern, replacement, v)
        wanted.append(v)
    df = spark.createDataFrame(list(enumerate(values)), "i int, code string")
    rows = secrets.scrub(df).withColumn("other", F.lit(1)).orderBy("i").collect()
    assert [r.code for r in rows] == wanted
    plain = df.select("i", secrets.scrub_secrets(F.col("code")).alias("code")).orderBy("i")
    assert [r.code for r in plain.collect()] == wanted
    hits = {r.pattern: r.hits for r in secrets.secret_hits(df).collect()}
    assert list(hits.values()) == counts and all(counts)


def test_first_keyword_in_dictionary_order_wins(spark):
    words = [k for k, _ in CWE_KEYWORDS] + ["XSS", "evaluate", "fine", "SQL Injection", "Shell"]
    values = texts(1000, words, 5, longest=4)

    def first(text: str):
        return next((f"CWE-{n}" for k, n in CWE_KEYWORDS if k in text.lower()), None)

    df = spark.createDataFrame(list(enumerate(values)), "i int, comment string")
    rows = with_cwe(df).orderBy("i").collect()
    assert [r.cwe_id for r in rows] == [first(v) for v in values]
    assert all((r.cwe_url or "").split("/")[-1].removesuffix(".html") == (r.cwe_id or "")[4:]
               for r in rows)


@pytest.mark.parametrize("secret", secrets.SECRET_PATTERNS, ids=lambda s: s.name)
def test_needles_survive_every_spelling(spark, secret):
    """Each letter of a needle replaced by any character that equals it without regard to case."""
    if not secret.lowered:
        return
    like = {c: [chr(i) for i in range(0x10000) if re.fullmatch(c, chr(i), re.I)]
            for n in secret.needles for c in n}
    values = [n.replace(c, other) for n in secret.needles for c in n for other in like[c]]
    assert len(values) > len(secret.needles)
    got = apply(spark, values, "string", secrets.has_needle(F.col("v"), secret))
    assert all(g for g, in got)


@pytest.mark.parametrize("comment,cwe", [
    ("xxss", "CWE-79"), ("XsS", "CWE-79"), ("x ss", None), ("", None), (None, None),
    ("sqlixss", "CWE-89"), ("XSS first, then SQL Injection", "CWE-89"),
    ("medieval", "CWE-95"), ("sql  injection", None)])
def test_keywords(spark, comment, cwe):
    """Parts of words count, in any case; of several the first of the dictionary wins."""
    assert with_cwe(spark.createDataFrame([(comment,)], "comment string")).first().cwe_id == cwe
