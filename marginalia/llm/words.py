"""Words as the operators of this package count them: longest runs of letters and digits, in lower case."""

from __future__ import annotations

import re

_RUN = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """The words of a text in order; none of a null or blank one. Runs are found first and lowered after."""
    if not text:
        return []
    runs = _RUN.findall(text)
    return " ".join(runs).lower().split(" ") if runs else []
