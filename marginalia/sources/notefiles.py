"""Changing single note files: atomic writes, soft deletes, moves. Driver-side; tables follow through the change log that they write."""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame

from marginalia.config import Settings
from marginalia.errors import InvalidRequest, NotFound
from marginalia.sources.notes import split_frontmatter

LONGEST_PATH, LONGEST_CONTENT, MOST_KEYS = 500, 10 << 20, 100
FRONT_BYTES = 64 << 10
TRASH = ".trash"


def uuid7() -> str:
    """A UUID of version 7: milliseconds since 1970, then random bits."""
    value = (int(time.time() * 1000) << 80) | (int.from_bytes(os.urandom(10)) & ((1 << 80) - 1))
    value = (value & ~(0xF << 76)) | (0x7 << 76)
    return str(uuid.UUID(int=(value & ~(0x3 << 62)) | (0x2 << 62)))


def dump_frontmatter(meta: dict, body: str) -> str:
    """A note of frontmatter, in its order, and body; the body alone where there is no frontmatter."""
    if not meta:
        return body
    return f"---\n{yaml.safe_dump(meta, sort_keys=False, allow_unicode=True)}---\n\n{body}"


class NoteFiles:
    """``log`` is a folder that takes a file of JSON lines per change, for ``streaming.changes.change_log``; none is written without it."""

    def __init__(self, root: str, settings: Settings = Settings(), log: str | None = None):
        self.root, self.settings, self.log = Path(root).resolve(), settings, Path(log) if log else None

    def _changed(self, *changes: tuple[str, bool]) -> None:
        """Logs (path, deleted) pairs; the file gets its name when it is whole."""
        if self.log is None:
            return
        self.log.mkdir(parents=True, exist_ok=True)
        now = datetime.now(timezone.utc).isoformat()
        name = f"{time.time_ns()}-{uuid.uuid4().hex}.json"
        (self.log / f".{name}").write_text("".join(json.dumps({"path": p, "deleted": d, "ts": now}) + "\n" for p, d in changes))
        os.rename(self.log / f".{name}", self.log / name)

    def path(self, rel: str, must_exist: bool = False, kinds: tuple[str, ...] = (".md",)) -> Path:
        """The file of a relative path, which must stay inside the tree and out of hidden and ignored folders."""
        if not rel or len(rel) > LONGEST_PATH or "\0" in rel or Path(rel).is_absolute():
            raise InvalidRequest("the path is empty, too long or absolute")
        parts = Path(rel).parts
        if ".." in parts or any(p.startswith(".") or p in self.settings.ignored_folders for p in parts):
            raise InvalidRequest("the path leaves the tree or enters a hidden folder")
        full = self.root / rel
        if not full.resolve().is_relative_to(self.root) or full.suffix.lower() not in kinds:
            raise InvalidRequest(f"the path must name one of {', '.join(kinds)} inside the tree")
        if must_exist and not full.is_file():
            raise NotFound(rel)
        return full

    def read(self, rel: str) -> str:
        return self.path(rel, True).read_text("utf-8", "replace")

    def metadata(self, rel: str) -> dict:
        """The frontmatter of a note, from its first bytes alone."""
        with self.path(rel, True).open("rb") as f:
            return split_frontmatter(f.read(FRONT_BYTES).decode("utf-8", "replace"))[0]

    def revision(self, rel: str) -> tuple[int, int, int]:
        s = self.path(rel, True).stat()
        return s.st_ino, s.st_mtime_ns, s.st_size

    def _write(self, full: Path, text: str, fresh: bool = False) -> None:
        raw = text.encode()
        if len(raw) > LONGEST_CONTENT:
            raise InvalidRequest("the content is too long")
        full.parent.mkdir(parents=True, exist_ok=True)
        fd, name = tempfile.mkstemp(dir=full.parent, prefix=".write-")
        try:
            with os.fdopen(fd, "wb") as f:
                f.write(raw)
                f.flush()
                os.fsync(f.fileno())
            if fresh:
                os.link(name, full)  # fails if another has made the file meanwhile
                os.unlink(name)
            else:
                os.replace(name, full)
        except BaseException:
            Path(name).unlink(missing_ok=True)
            raise
        self._changed((str(full.relative_to(self.root)), False))

    def create(self, rel: str, body: str, meta: dict | None = None) -> dict:
        meta = dict(meta or {})
        if len(meta) > MOST_KEYS:
            raise InvalidRequest("too many frontmatter fields")
        meta.setdefault("id", uuid7())
        try:
            self._write(self.path(rel), dump_frontmatter(meta, body), fresh=True)
        except FileExistsError:
            raise InvalidRequest(f"{rel} exists") from None
        return meta

    def write(self, rel: str, text: str) -> None:
        self._write(self.path(rel, True), text)

    def append(self, rel: str, text: str, separator: str = "\n\n") -> None:
        """``text`` after the note, with the separator between unless the note already ends with it."""
        old = self.read(rel)
        self._write(self.path(rel), old + ("" if not old or old.endswith(separator) else separator) + text)

    def update_frontmatter(self, rel: str, meta: dict, merge: bool = True) -> dict:
        old, body = split_frontmatter(self.read(rel))
        new = {**old, **meta} if merge else dict(meta)
        self._write(self.path(rel), dump_frontmatter(new, body))
        return new

    def delete(self, rel: str) -> str:
        """Moves a note to the trash folder, under a free name."""
        full = self.path(rel, True, self.settings.extensions)
        for k in range(1000):
            to = self.root / TRASH / (rel if not k else f"{Path(rel).with_suffix('')}-{k}{full.suffix}")
            if not to.exists():
                to.parent.mkdir(parents=True, exist_ok=True)
                os.rename(full, to)
                self._changed((rel, True))
                return str(to.relative_to(self.root))
        raise InvalidRequest("the trash holds too many notes of this name")

    def move(self, rel: str, to: str) -> None:
        a, b = self.path(rel, True, self.settings.extensions), self.path(to, False, self.settings.extensions)
        if a.suffix.lower() != b.suffix.lower() or b.exists():
            raise InvalidRequest("the new path has another extension or exists")
        b.parent.mkdir(parents=True, exist_ok=True)
        os.rename(a, b)
        self._changed((rel, True), (to, False))


def lacking_ids(notes: DataFrame, root: str, settings: Settings = Settings(), write: bool = False) -> DataFrame:
    """Those of ``notes`` (path) whose frontmatter has no id, as (path); with ``write`` each gets one.

    Tasks read the files' first bytes and write them, so ``root`` must be a folder that every executor mounts. A note that a lost task has
    written already has an id and keeps it. Notes that cannot be read are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = NoteFiles(root, settings)
        for batch in batches:
            lacking = []
            for path in batch.column(0).to_pylist():
                try:
                    if not files.metadata(path).get("id"):
                        lacking.append(path)
                        if write:
                            files.update_frontmatter(path, {"id": uuid7()})
                except (OSError, InvalidRequest, NotFound):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(lacking, pa.string())], names=["path"])

    return notes.select("path").mapInArrow(run, "path string")
