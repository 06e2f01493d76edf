"""File paths, languages and repository addresses."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# Extension to language, language to code fence, ignored folder names.
EXTENSION_LANGUAGE = {
    ".py": "python",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".ts": "typescript",
    ".tsx": "tsx",
}
CODE_FENCE = {
    "python": "python",
    "javascript": "javascript",
    "typescript": "typescript",
    "tsx": "tsx",
}
# Every folder starting with a dot is ignored as well, in both walks.
REVIEW_IGNORED = (
    "venv", "env", "__pycache__", "node_modules", "dist", "build", "*.egg-info",
)
CALL_GRAPH_IGNORED = ("venv", "__pycache__")
REPO_HOST = "https://github.com/"


def _quote(name: str) -> str:
    return "".join(f"\\{c}" if c in "*." else c for c in name)


def kept_folder(path: Column, walk: str = "review") -> Column:
    """False for a path below an ignored folder. File names themselves are never tested."""
    ignored = {"review": REVIEW_IGNORED, "call_graph": CALL_GRAPH_IGNORED}[walk]
    names = "|".join(_quote(n) for n in ignored)
    return ~path.rlike(rf"(^|/)(\.[^/]*|{names})/")


def base_name(path: Column) -> Column:
    """Text after the last slash (the whole text if there is none)."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last extension with its dot; leading dots belong to the name."""
    return F.regexp_extract(base_name(path), r"(?s)^\.*[^.].*(\.[^.]*)\z", 1)


def language(path: Column, languages: dict[str, str] | None = None) -> Column:
    """Language of a path, NULL if unsupported. Python goes by suffix, the others by extension."""
    known = EXTENSION_LANGUAGE if languages is None else languages
    ext = extension(path)
    result = F.when(path.endswith(".py"), F.lit(known.get(".py")))
    for suffix, name in known.items():
        if suffix != ".py":
            result = result.when(ext == suffix, F.lit(name))
    return result


def code_fence(lang: Column) -> Column:
    result = None
    for name, fence in CODE_FENCE.items():
        result = (F if result is None else result).when(lang == name, F.lit(fence))
    return result.otherwise(F.lit("text"))


def clean_url(url: Column) -> Column:
    return F.regexp_replace(strip(url), r"/+\z", "")


def is_repo_url(url: Column) -> Column:
    """https://github.com/<owner>/<name>; a cleaned address is expected."""
    return url.rlike(r"(?d)^https://github\.com/[a-zA-Z0-9_.-]+/[a-zA-Z0-9_.-]+(\.git)?$")


def repo_slug(url: Column) -> Column:
    """owner/name of an address, without the host and a `.git` ending."""
    return F.regexp_replace(F.replace(url, F.lit(REPO_HOST), F.lit("")), r"\.git\z", "")
