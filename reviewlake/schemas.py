"""Fixed schemas. Nothing in this package infers a schema."""

from pyspark.sql import types as T

CATEGORIES = ("Security", "Performance", "Bug", "Style", "Maintainability", "Documentation")
SEVERITIES = ("Critical", "High", "Medium", "Low")  # worst first

FILES = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("content", T.BinaryType()),
])

# One row per definition found in a file, plus one row per file that failed to parse
# (those have only repo, path, language and error set).
DEFINITIONS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("reviewable", T.BooleanType()),
    T.StructField("ord", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("code", T.StringType()),
    T.StructField("docstring", T.StringType()),
    T.StructField("callees", T.ArrayType(T.StringType())),
    T.StructField("error", T.StringType()),
])

BLOCK_COLUMNS = (
    "repo", "file_path", "name", "type", "line_number", "code", "docstring", "language",
)

FINDING_FIELDS = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("function_name", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("issue_category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("comment", T.StringType()),
    T.StructField("suggested_fix", T.StringType()),
    T.StructField("vulnerable_snippet", T.StringType()),
    T.StructField("impact", T.StringType()),
    T.StructField("confidence_score", T.IntegerType()),
    T.StructField("needs_verification", T.BooleanType()),
])
FINDING_COLUMNS = tuple(FINDING_FIELDS.fieldNames())

REPORT = T.StructType([
    T.StructField("reviews", T.ArrayType(FINDING_FIELDS)),
    T.StructField("batch_summary", T.StringType()),
])

REPO_META_JSON = T.StructType([
    T.StructField("size", T.LongType()),
    T.StructField("stargazers_count", T.LongType()),
    T.StructField("language", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("default_branch", T.StringType()),
])

HISTORY = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("findings", T.IntegerType()),
    T.StructField("critical", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
])

PROMPTS = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("prompt", T.StringType()),
])

REVIEWED = T.StructType([
    T.StructField("repo", T.StringType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("report", T.StringType()),
    T.StructField("error", T.StringType()),
])
