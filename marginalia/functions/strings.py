"""Column builders for text: blank tests, trimming, link-target normalisation."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space (Unicode White_Space plus the four ASCII separators U+001C..U+001F).
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# File endings removed when a link target is normalised.
TARGET_ENDINGS = ("md", "canvas", "pdf", "png", "jpg", "jpeg", "gif", "svg", "webp")


def strip(c: Column) -> Column:
    """``c`` without white space of any script at both ends; null stays null."""
    return F.btrim(c, F.lit(WHITE))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only strings."""
    return c.isNull() | (strip(c) == "")


def present(c: Column) -> Column:
    """``c`` where it is neither null nor blank, else null."""
    return F.when(~is_blank(c), c)


def normalize_target(c: Column) -> Column:
    """Lower case, trimmed, one known file ending removed, spaces turned into hyphens."""
    bare = F.regexp_replace(strip(F.lower(c)), f"\\.({'|'.join(TARGET_ENDINGS)})$", "")
    return F.replace(bare, F.lit(" "), F.lit("-"))


def file_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a name that only starts with a dot keeps it."""
    return F.regexp_replace(file_name(path), "(?s)(?<=.)\\.[^.]*$", "")


# Where a path of a machine begins: a drive, a home folder, or a slash with a folder after it.
_PATH_BEGINS = r"(?:[A-Za-z]:\\|~[/\\]|/(?=[^/:\s]+/))"


def redact_paths(c: Column) -> Column:
    """``c`` on one line, with the paths of machines replaced by a mark; relative paths and web addresses stay.

    A path between quotes reaches to the closing one, a file URI to the next blank. Any other reaches to the next comma, colon, semicolon, quote or closing
    bracket, as folders may have blanks in their names.
    """
    quoted, bare = rf"(?<=['\"])(?:{_PATH_BEGINS}|(?i:file)://)[^'\"]+", rf"(?<![\w./:]){_PATH_BEGINS}[^'\",:;)\]}}]*"
    return F.regexp_replace(F.translate(c, "\r\n", "  "), rf"{quoted}|(?i:file)://\S+|{bare}", "[REDACTED_PATH]")


def _first_object(text: str | None) -> str | None:
    text = (text or "").strip()
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer(r"\{", text)):
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def json_object_in(texts: pd.Series) -> pd.Series:
    """The first JSON object in free text, as text: the one that begins at the earliest brace at which one does; null where none does."""
    return texts.map(_first_object)
