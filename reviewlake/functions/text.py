"""Text columns that agree with Python's own notion of whitespace and decoding."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.strip() also removes U+001C..U+001F, which Java's (?U)\s leaves out.
SPACE = r"[\s\x1c-\x1f]"
_NOT_SPACE = r"(?U)[^\s\x1c-\x1f]"


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text: bad bytes become U+FFFD, all line ends become a newline."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def has_text(col: Column) -> Column:
    """True where something other than whitespace is left; NULL counts as empty."""
    return F.coalesce(col, F.lit("")).rlike(_NOT_SPACE)


def strip(col: Column) -> Column:
    left = F.regexp_replace(col, rf"(?U)^{SPACE}+", "")
    return F.regexp_replace(left, rf"(?U){SPACE}+\z", "")
