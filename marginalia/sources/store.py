"""Corpus tables at rest: generations of parts, published by one pointer.

A table is cut into ``PARTS`` parts by a hash of its notes. A generation is a folder with the parts that it changed and a manifest that names,
for each part of each table, the generation whose files hold it. It is written under a name of its own, and becomes current when
the pointer file is renamed into place: readers see all tables of one generation or all of the next. A failed write leaves
the pointer alone.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marginalia.operators.notelinks import note_names

NOTE_KEY = {"chunks": "note_path", "links": "from_note_path", "aliases": "note_path", "catalog": "path", "postings": "note_path"}
SORTED = {"postings": "term"}  # a search reads only the row groups that have its terms
PARTS, SALTS = 64, 8


def part_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.base))

    def has(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.base}/{name}"))

    def _names(self, prefix: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.base)) if s.getPath().getName().startswith(prefix))

    def current(self) -> str | None:
        """The name of the current generation: that of the last pointer."""
        pointers = self._names("_CURRENT-")
        return pointers[-1].split("-", 2)[2] if pointers else None

    def _manifest(self, name: str) -> dict:
        return json.loads(self.spark.read.text(f"{self.base}/{name}/manifest.json", wholetext=True).first()[0])

    def load(self, generation: str | None = None) -> dict[str, DataFrame]:
        """The tables of a generation, the current one if none is named; the pointer is read once."""
        name = generation or self.current()
        if name is None:
            raise FileNotFoundError(f"nothing is published in {self.base}")
        manifest = self._manifest(name)
        return {t: self._parts(manifest, t) for t in manifest}

    def _parts(self, manifest: dict, table: str, parts: set[int] | None = None) -> DataFrame:
        """A table, or those of its rows that are in ``parts``."""
        schema = StructType.fromJson(manifest[table]["schema"])
        folders = [f"{self.base}/{g}/{table}/part={p}" for p, g in manifest[table]["parts"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def publish(self, tables: dict[str, DataFrame], expected: str | None = None, parts: dict[str, set[int]] | None = None) -> str:
        """Write tables as a new generation and make it current, in one step.

        ``expected`` is the generation that the tables were made from: if another has become current since, nothing is published.
        ``parts`` names those that a table's rows replace; its other parts, and tables that are not given, stay as they are in ``expected``.
        """
        name = f"gen-{uuid.uuid4().hex}"
        manifest = self._manifest(expected) if expected is not None and parts is not None else {}
        for t, df in tables.items():
            salt = F.pmod(F.xxhash64(*(c for c, kind in df.dtypes if not kind.startswith("map"))), F.lit(SALTS))  # a note of any size is written by several tasks
            placed = df.withColumn("part", part_of(NOTE_KEY[t])).repartition("part", salt)
            placed = placed.sortWithinPartitions("part", SORTED[t]) if t in SORTED else placed
            placed.write.partitionBy("part").parquet(f"{self.base}/{name}/{t}")
            made = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.base}/{name}/{t}"))]
            kept = {p: g for p, g in manifest[t]["parts"].items() if int(p) not in parts[t]} if t in manifest else {}
            manifest[t] = {"schema": df.schema.jsonValue(), "parts": kept | {m.removeprefix("part="): name for m in made if m.startswith("part=")}}
        out = self._fs.create(self._path(f"{self.base}/{name}/manifest.json"), False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if expected is not None and self.current() != expected:
            raise RuntimeError("another generation was published meanwhile")
        self._point(name)
        return name

    def _point(self, name: str) -> None:
        pointers = self._names("_CURRENT-")
        number = int(pointers[-1].split("-")[1]) + 1 if pointers else 1
        waiting = self._path(f"{self.base}/.pointer-{name}-{number}")
        self._fs.create(waiting, False).close()
        if not self._fs.rename(waiting, self._path(f"{self.base}/_CURRENT-{number:012d}-{name}")):
            raise RuntimeError("the pointer could not be moved into place")

    def replace_notes(self, changed: dict[str, DataFrame], gone: DataFrame, resolve: Callable[[DataFrame, DataFrame, DataFrame], DataFrame] = lambda links, catalog, aliases: links) -> str:
        """A generation in which the notes of ``changed`` (tables as stored) replace their old rows and those of ``gone``
        (path) have none; only parts that hold such notes are read and written.

        ``resolve(links, catalog, aliases)`` gives links their paths anew: those of the changed notes, and those in parts with links that use a
        name which a changed note has or had.
        """
        before = self.current()
        manifest = self._manifest(before)
        touched = changed["catalog"].select("path").unionByName(gone.select("path")).distinct()
        own_parts = {r[0] for r in touched.select(part_of("path")).distinct().collect()}  # at most PARTS numbers
        named = lambda t: touched.withColumnRenamed("path", NOTE_KEY[t])
        new, parts = {}, {}
        for t in manifest:
            if t != "links":
                old = self._parts(manifest, t, own_parts)
                new[t] = old.join(F.broadcast(named(t)), NOTE_KEY[t], "left_anti").select(old.columns).unionByName(changed[t].select(old.columns))
                parts[t] = own_parts

        def whole(t: str) -> DataFrame:
            others = self._parts(manifest, t, set(range(PARTS)) - own_parts)
            return others.unionByName(new[t])

        old_names = note_names(self._parts(manifest, "catalog", own_parts), self._parts(manifest, "aliases", own_parts))
        names = old_names.unionByName(note_names(changed["catalog"], changed["aliases"])).join(F.broadcast(touched), "path", "left_semi").select("name").distinct()
        using = self._parts(manifest, "links").select("from_note_path", F.col("link_target_normalized").alias("name")).join(names, "name", "left_semi")
        parts["links"] = own_parts | {r[0] for r in using.select(part_of("from_note_path")).distinct().collect()}
        old = self._parts(manifest, "links", parts["links"])
        links = old.join(F.broadcast(named("links")), "from_note_path", "left_anti").select(old.columns).unionByName(changed["links"].select(old.columns))
        new["links"] = resolve(links, whole("catalog"), whole("aliases")).select(old.columns)
        return self.publish(new, before, parts)

    def compact(self) -> str:
        """The same rows, all parts written anew: many small generations become one."""
        before = self.current()
        return self.publish(self.load(before), before)

    def restore(self, generation: str) -> str:
        """Make an older generation current again."""
        if not self._fs.exists(self._path(f"{self.base}/{generation}")):
            raise FileNotFoundError(generation)
        self._point(generation)
        return generation


def upsert(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """``catalog`` with ``rows`` in place of those of the same path; of repeated rows the one modified last."""
    fresh = rows.groupBy("path").agg(F.max(F.struct("mtime_ns", *(c for c in rows.columns if c not in ("path", "mtime_ns")))).alias("r")).select("path", "r.*").select(catalog.columns)
    return catalog.join(fresh.select("path"), "path", "left_anti").select(catalog.columns).unionByName(fresh)
