"""Weakness classes: the first dictionary keyword contained in a comment decides."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keyword and weakness number, in matching order.
CWE_KEYWORDS = (
    ("sql injection", 89),
    ("sqli", 89),
    ("sql query construction", 89),
    ("parameterized quer", 89),
    ("xss", 79),
    ("cross-site scripting", 79),
    ("cross site scripting", 79),
    ("html injection", 79),
    ("html escaping", 79),
    ("command injection", 78),
    ("shell", 78),
    ("pickle", 502),
    ("deserialization", 502),
    ("path traversal", 22),
    ("hardcoded credential", 798),
    ("hardcoded password", 259),
    ("csrf", 352),
    ("buffer overflow", 120),
    ("race condition", 362),
    ("null pointer", 476),
    ("division by zero", 369),
    ("open redirect", 601),
    ("weak cryptography", 327),
    ("insecure random", 330),
    ("eval", 95),
    ("exec", 95),
)
CWE_URL = "https://cwe.mitre.org/data/definitions/{}.html"


def cwe_keywords(spark: SparkSession) -> DataFrame:
    """The dictionary as a table, small by construction and known to be so by the planner."""
    rows = [
        F.struct(F.lit(i).alias("prio"), F.lit(k).alias("keyword"),
                 F.lit(f"CWE-{n}").alias("cwe_id"), F.lit(CWE_URL.format(n)).alias("url"))
        for i, (k, n) in enumerate(CWE_KEYWORDS)
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def keyword_index(lowered: Column) -> Column:
    """Position of the first keyword contained in lower-case text, else NULL."""
    result = None
    for i, (keyword, _) in enumerate(CWE_KEYWORDS):
        result = (F if result is None else result).when(lowered.contains(keyword), F.lit(i))
    return result


def with_keyword(df: DataFrame, col: str = "comment") -> DataFrame:
    """Add `cwe_prio`. The comment is lowered once, in a projection of its own."""
    lowered = df.withColumn("_lowered", F.lower(col))
    return lowered.withColumn("cwe_prio", keyword_index(F.col("_lowered"))).drop("_lowered")


def with_cwe(findings: DataFrame, col: str = "comment") -> DataFrame:
    """Add `cwe_id` and `cwe_url`, both NULL where no keyword occurs."""
    numbers = F.array(*[F.lit(str(n)) for _, n in CWE_KEYWORDS])
    head, tail = CWE_URL.split("{}")
    numbered = with_keyword(findings, col).withColumn(
        "_number", F.get(numbers, F.col("cwe_prio"))
    )
    return numbered.select(
        *findings.columns,
        F.concat(F.lit("CWE-"), "_number").alias("cwe_id"),
        F.concat(F.lit(head), "_number", F.lit(tail)).alias("cwe_url"),
    )
