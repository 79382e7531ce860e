"""Marking query terms in result texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to mark (English, then Portuguese), and the markers that may be used.
STOP_WORDS = frozenset(
    "the and for that this with from are was were been have has had but not you all can her his they will would could should "
    "que para com uma por mais como mas foi ser tem seu sua ele ela isso este esta".split()
)
MARKERS = frozenset("** * __ _ == ~~ `` ` <mark> </mark> <em> </em> <strong> </strong> <b> </b> <i> </i> [[ ]] << >>".split())
DEFAULT_MARKER = "**"
LEAST_CHARS = 3


def query_terms(query: str | None) -> list[str]:
    """The words of a query worth marking: of three letters or more and no stop-words."""
    return [w for w in (query or "").split() if len(w) >= LEAST_CHARS and w.lower() not in STOP_WORDS]


def highlight(text: Column, query: str | None, start: str = DEFAULT_MARKER, end: str | None = None) -> Column:
    """``text`` with every occurrence of a query term between markers, whatever its case; a marker that is not allowed becomes ``**``."""
    words = sorted({w.lower() for w in query_terms(query)}, key=lambda w: (-len(w), w))
    if not words:
        return text
    before, after = (m if m in MARKERS else DEFAULT_MARKER for m in (start, start if end is None else end))
    pattern = "(?iu)(" + "|".join(re.escape(w) for w in words) + ")"
    return F.regexp_replace(text, pattern, f"{before}$1{after}")
