"""Settings of a corpus, passed to the operators that need them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

# Note formats and folders that are never scanned.
NOTE_EXTENSIONS = (".md", ".mdx", ".txt", ".pdf", ".canvas")
IGNORED_FOLDERS = (".obsidian", ".smart-env", ".trash", ".git")


@dataclass(frozen=True)
class Settings:
    """``chunk_chars`` and ``overlap_chars`` size the passages, ``header_levels`` are the heading depths that cut a note,
    ``language`` names the stop-words that text search leaves out."""

    extensions: tuple[str, ...] = NOTE_EXTENSIONS
    ignored_folders: tuple[str, ...] = IGNORED_FOLDERS
    chunk_chars: int = 2000
    overlap_chars: int = 200
    header_levels: int = 4
    separators: tuple[str, ...] = ("\n\n", "\n", ". ", " ")
    language: str | None = None
    debounce_s: float = 2.0
    breaker_attempts: int = 3
    breaker_window_s: float = 60.0

    def __post_init__(self) -> None:
        if self.chunk_chars < 1 or not 0 <= self.overlap_chars < self.chunk_chars:
            raise ValueError("overlap_chars must be at least 0 and less than chunk_chars")
        if not 1 <= self.header_levels <= 6:
            raise ValueError("header_levels must be from 1 to 6")

    @classmethod
    def from_file(cls, path: str) -> Settings:
        """Settings of a YAML file; unknown keys are refused."""
        import yaml

        with open(path, encoding="utf-8") as f:
            given = yaml.safe_load(f) or {}
        known = {f.name for f in fields(cls)}
        if unknown := set(given) - known:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    @classmethod
    def from_environment(cls, variable: str = "MARGINALIA_CONFIG") -> Settings:
        """Settings of the YAML file that an environment variable names; the defaults where it is unset or empty."""
        return cls.from_file(path) if (path := os.environ.get(variable)) else cls()
