"""Manifest line functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import as_col

# Java regex with UNICODE_CHARACTER_CLASS (White_Space) plus the four separator
# controls U+001C..U+001F: exactly the characters Python's str.strip() removes
# (Spark's trim only removes spaces).
_STRIP = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(c) -> Column:
    """remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(as_col(c), _STRIP, "")


def is_non_blank(c) -> Column:
    return strip(c) != F.lit("")


def first_segment(c) -> Column:
    """text before the first '/', or the whole line when there is none."""
    return F.substring_index(as_col(c), "/", 1)


def join_path(root: str, c, ext: str = ".jpg") -> Column:
    """``os.path.join(root, line + ext)`` with every backslash made a slash.

    The root is a driver-side string, so its separator logic is resolved here;
    the per-row part stays a Catalyst expression.
    """
    prefix = root if (root == "" or root.endswith("/") or root.endswith("\\")) else root + "/"
    prefix = prefix.replace("\\", "/")
    return F.concat(F.lit(prefix), F.translate(as_col(c), "\\", "/"), F.lit(ext))
