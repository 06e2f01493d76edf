"""From raw files to the ones worth parsing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import decode_text, has_text


def prune_dirs(files: DataFrame, walk: str = "review", path: str = "path") -> DataFrame:
    """Drop files below ignored folders. `walk="call_graph"` ignores fewer of them."""
    return files.filter(paths.kept_folder(F.col(path), walk))


def with_language(files: DataFrame, languages: dict[str, str] | None = None,
                  path: str = "path") -> DataFrame:
    """Add `language` and drop unsupported files."""
    return (
        files.withColumn("language", paths.language(F.col(path), languages))
        .filter(F.col("language").isNotNull())
    )


def decode(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn(content, decode_text(F.col(content)))


def drop_blank(files: DataFrame, content: str = "content") -> DataFrame:
    return files.filter(has_text(F.col(content)))


def source_files(files: DataFrame, languages: dict[str, str] | None = None) -> DataFrame:
    """Pruned, dispatched and decoded text: repo, path, language, reviewable, content.

    The path tests come first, so no content is decoded for a file that is dropped by path.
    Rows kept only for the call graph have `reviewable` false.
    """
    kept = with_language(prune_dirs(files, "call_graph"), languages)
    kept = kept.withColumn("reviewable", paths.kept_folder(F.col("path"), "review")).filter(
        F.col("reviewable") | (F.col("language") == "python")
    )
    return drop_blank(decode(kept)).select("repo", "path", "language", "reviewable", "content")
