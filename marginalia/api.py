"""One function for every question about a corpus: thin calls of the operators, with the limits of the public surface.

A ``Notebook`` joins a store of published tables, the note tree they come from, and an embedder. Answers that are tables come as
DataFrames. ``now`` is passed where time matters.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime
from statistics import mean, median, quantiles

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import Settings
from marginalia.errors import InvalidRequest, NotFound
from marginalia.functions import highlight as hl
from marginalia.functions.coerce import FieldRule, validate
from marginalia.functions.lineage import Scratch
from marginalia.functions.strings import normalize_target
from marginalia.functions.vectors import mean_vectors, nearest
from marginalia.operators import duplicates, fts, graph, ivf, navigate, notelinks, search, sync
from marginalia.providers import Embedder, HashingEmbedder, embed_query
from marginalia.sources.notefiles import NoteFiles, lacking_ids
from marginalia.sources.notes import ingest, scan, stored_tables
from marginalia.sources.store import Store
from marginalia.streaming.changes import apply_to_store, change_log, follow

LONGEST_QUERY, MOST_TERMS = 10_000, 20
SLOW_MS, LEAST_HIT_RATE, SAMPLES = 500.0, 0.7, 1000
PUBLIC = ("note_path", "note_title", "folder", "headers", "tags", "text")


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def _p95(times: list[float]) -> float:
    return max(times) if len(times) < 20 else quantiles(times, n=20)[18]


class Notebook:
    def __init__(self, spark: SparkSession, root: str, base: str, embedder: Embedder | None = None, settings: Settings = Settings(), rules: dict[str, FieldRule] | None = None, pdf_pages: Callable[[bytes], list[str]] | None = None, scorer: Callable[[Column, Column], Column] = search.lexical_score, log: str | None = None):
        """``pdf_pages`` gives the text of each page of a PDF; ``scorer`` reranks by (query, text), see ``providers.model_scorer``; ``log`` is
        the folder in which own writes of notes are logged as changes."""
        self.spark, self.root, self.settings, self.rules, self.pdf_pages, self.scorer = spark, root, settings, rules or {}, pdf_pages, scorer
        self.files, self.store, self.embedder = NoteFiles(root, settings, log), Store(spark, base), embedder or HashingEmbedder()
        self.samples: dict[str, list[float]] = {}

    # Tables

    def table(self, name: str) -> DataFrame:
        return self.store.load()[name]

    def _catalog(self) -> DataFrame:
        return self.table("catalog").withColumn("deleted_at", F.lit(None).cast("timestamp"))

    def reindex_vault(self, dry_run: bool = False) -> DataFrame | str:
        """All tables anew, published at once; with ``dry_run`` the notes per extension."""
        if dry_run:
            return scan(self.spark, self.root, self.settings).groupBy("extension").agg(F.count("*").alias("notes"))
        c = ingest(self.spark, self.root, self.settings, self.pdf_pages)
        return self.store.publish(stored_tables(c, self.settings, self.embedder))

    def sync_vault(self, dry_run: bool = True) -> DataFrame:
        """New, deleted and modified notes; unless ``dry_run`` their rows are replaced."""
        seen = self.table("catalog").select("path", F.date_format(F.timestamp_micros((F.col("mtime_ns") / 1000).cast("long")), "yyyy-MM-dd'T'HH:mm:ss").alias("modified_at"))
        diff = sync.sync_diff(scan(self.spark, self.root, self.settings).select("path", "mtime"), seen)
        if not dry_run:
            self._apply(diff.select("path", (F.col("change") == "deleted").alias("deleted")))
        return diff

    def reindex_note(self, path: str) -> None:
        self.files.path(path, True, self.settings.extensions)
        self._apply(self.spark.createDataFrame([(path, False)], "path string, deleted boolean"))

    def _apply(self, changes: DataFrame) -> None:
        apply_to_store(self.spark, self.store, self.root, self.settings, self.embedder, self.pdf_pages)(changes, 0)

    def follow_changes(self, folder: str, checkpoint: str, once: bool = False):
        """Applies the changes that ``folder`` logs, batch by batch; what failed is logged by path beside the store."""
        stream = change_log(self.spark, folder, self.settings)
        return follow(stream, apply_to_store(self.spark, self.store, self.root, self.settings, self.embedder, self.pdf_pages), checkpoint, once)

    def reconcile(self) -> DataFrame:
        """Brings the tables in line with the files, whatever was logged: (path, action) of all that differed. For a schedule."""
        found = sync.reconcile(scan(self.spark, self.root, self.settings), self.table("catalog"))
        found = Scratch(self.spark, "reconcile").table(found)
        self._apply(found.select("path", (F.col("action") == "delete").alias("deleted")))
        return found

    def compact_index(self) -> str:
        return self.store.compact()

    def _index(self) -> str:
        return f"vectors-{self.store.current()}"

    def build_vector_index(self, least_rows: int = ivf.INDEX_FROM_ROWS) -> dict:
        """An inverted file over the vectors of the current generation, for searches with ``probes``; smaller tables get none. A later generation has
        none until it is built for that one."""
        rows = self.table("chunks").where("vector IS NOT NULL")
        n = rows.count()
        if n >= max(1, least_rows) and not self.store.has(f"{self._index()}/centres"):
            centres = ivf.fit_centres(rows, "vector", ivf.list_count(n))
            ivf.write_index(ivf.assign(rows, "chunk_id", "vector", centres), f"{self.store.base}/{self._index()}/lists")
            made = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
            made.coalesce(1).write.parquet(f"{self.store.base}/{self._index()}/centres")  # last: an index with centres is whole
        return self.vector_index_status()

    def _centres(self) -> np.ndarray | None:
        """The centres of the current generation's index, ``ivf.MOST_LISTS`` at most."""
        if not self.store.has(f"{self._index()}/centres"):
            return None
        return np.array([r.centre for r in self.spark.read.parquet(f"{self.store.base}/{self._index()}/centres").orderBy("list").collect()])

    def vector_index_status(self) -> dict:
        """The rows of the current generation, whether its index is built, and of how many lists."""
        centres = self._centres()
        return {"rows": self.table("chunks").count(), "indexed": centres is not None, "lists": 0 if centres is None else len(centres)}

    def prewarm(self) -> int:
        """Keeps the passages in the executors' memory and disk; their number."""
        return self.table("chunks").cache().count()

    # Search

    def _query(self, query: str) -> str:
        if not query or not query.strip():
            raise InvalidRequest("the query is empty")
        return query[:LONGEST_QUERY]

    def _near(self, rows: DataFrame, query: str, k: int, probes: int | None = None) -> DataFrame:
        asked = self.spark.createDataFrame([(0, list(embed_query(self.embedder, query)))], "query_id long, vector array<double>")
        centres = self._centres() if probes else None
        if centres is None:
            return nearest(rows, asked, "chunk_id", "vector", k)
        return ivf.search_index(self.spark.read.parquet(f"{self.store.base}/{self._index()}/lists"), asked, centres, probes, k)

    def _answer(self, ranked: DataFrame, rows: DataFrame, query: str, k: int, exclude: list[str] | None = None) -> DataFrame:
        whole = ranked.join(rows.select("chunk_id", *PUBLIC), F.col("id") == F.col("chunk_id")).withColumn("query", F.lit(query))
        whole = whole.where(navigate.without_terms(exclude)) if exclude else whole
        best = search.rerank(whole, k, self.scorer)
        return search.formatted(best, reranked="rerank_score").orderBy("position").select("position", *PUBLIC, "score")

    def _timed(self, name: str, run: Callable[[], DataFrame]) -> DataFrame:
        """The answer, computed and timed: at most a hundred rows, since every search has a bound on ``top_k``."""
        start = time.perf_counter()
        answer = run()
        out = self.spark.createDataFrame(answer.collect(), answer.schema)
        self.samples[name] = [*self.samples.get(name, []), (time.perf_counter() - start) * 1000][-SAMPLES:]
        return out

    def search_vault(self, query: str, top_k: int = 10, probes: int | None = None) -> DataFrame:
        """Exact, or with ``probes`` among the passages of that many lists of the vector index, where one is built."""
        q, k, rows = self._query(query), clamp(top_k, 1, 100), self.table("chunks")
        return self._timed("search_vault", lambda: self._answer(self._near(rows, q, search.candidate_count(k), probes), rows, q, k))

    def search_vault_hybrid(self, query: str, top_k: int = 10) -> DataFrame:
        q, k, rows = self._query(query), clamp(top_k, 1, 100), self.table("chunks")
        n = search.candidate_count(k)
        asked = self.spark.createDataFrame([(0, q)], "query_id long, query string")
        sizes = rows.select(F.col("n_terms").alias("length"))
        words = fts.bm25_indexed(self.table("postings"), sizes, asked, n, without=fts.stop_words(self.settings.language))
        fused = search.fuse([self._near(rows, q, n), words], n)
        return self._timed("search_vault_hybrid", lambda: self._answer(fused, rows, q, k))

    def search_by_folder(self, query: str, folder: str, top_k: int = 10) -> DataFrame:
        q, k = self._query(query), clamp(top_k, 1, 100)
        rows = self.table("chunks").where(navigate.in_folder("folder", folder))
        return self._timed("search_by_folder", lambda: self._answer(self._near(rows, q, search.candidate_count(k)), rows, q, k))

    def search_advanced(self, query: str, top_k: int = 10, exclude: list[str] | None = None, highlight: tuple[str, str] | str | None = None, now: datetime | None = None, **facets) -> DataFrame:
        """Facets narrow the rows before ranking; excluded terms drop candidates after it, of which twice as many are taken."""
        q, k, terms = self._query(query), clamp(top_k, 1, 100), (exclude or [])[:MOST_TERMS]
        rows = self.table("chunks").where(navigate.facets(now=now, **facets))
        n = min(search.candidate_count(k) * (2 if terms else 1), search.MOST_CANDIDATES)
        out = self._timed("search_advanced", lambda: self._answer(self._near(rows, q, n), rows, q, k, terms))
        return out.withColumn("text", hl.highlight(F.col("text"), q, *([highlight] if isinstance(highlight, str) else highlight))) if highlight else out

    def find_similar_notes(self, path: str, top_k: int = 5) -> DataFrame:
        return self._similar(path, clamp(top_k, 1, 20))

    def _similar(self, path: str, k: int) -> DataFrame:
        rows = self.table("chunks").withColumn("note_id", F.xxhash64("note_path"))
        own = rows.where(F.col("note_path") == path).select("note_id").distinct()
        if own.isEmpty():
            raise NotFound(path)
        found = search.similar_groups(rows, own, "note_id", "chunk_id", "vector", k)
        names = rows.select(F.col("note_id").alias("other"), "note_path", "note_title").distinct()
        return search.formatted(found.join(names, "other")).orderBy("rank").select("rank", "note_path", "note_title", "score")

    def search_duplicates(self, threshold: float = 0.9, folder: str | None = None) -> DataFrame:
        """Groups of notes whose mean vectors are alike: each note joins the first earlier seed that it matches."""
        rows = self.table("chunks")
        rows = rows.where(navigate.in_folder("folder", folder)) if folder else rows
        ids = rows.select("note_path").distinct().repartitionByRange("note_path").sortWithinPartitions("note_path").withColumn("note_id", F.monotonically_increasing_id())
        ids = Scratch(self.spark, "notes").table(ids)
        means = mean_vectors(rows.join(ids, "note_path"), "note_id", "vector")
        pairs = duplicates.similar_pairs(means, "note_id", "mean", min(0.99, max(0.5, threshold)))
        groups = duplicates.with_copies(duplicates.greedy_groups(pairs), duplicates.vector_classes(means, "note_id", "mean"))
        name = lambda c: ids.select(F.col("note_id").alias(c), F.col("note_path").alias(f"{c}_path"))
        return groups.join(name("seed"), "seed").join(name("member"), "member").select("seed_path", "member_path", "similarity")

    def search_by_tags(self, tags: list[str], match_all: bool = False, limit: int = 50) -> DataFrame:
        return navigate.notes_with_tags(self.table("chunks"), tags[:MOST_TERMS], match_all).orderBy("note_path").limit(clamp(limit, 1, 200))

    # Links

    def get_backlinks(self, path: str) -> DataFrame:
        one = self._catalog().where(F.col("path") == path)
        return notelinks.backlinks(self.table("links"), one).orderBy("from_note_path")

    def get_outlinks(self, path: str) -> tuple[DataFrame, DataFrame]:
        """A note's links by kind, (kind, target, resolved, resolved_path, alias, heading, block_ref), and one row with the number of
        each kind, of all, and of broken ones, in which embeds do not count."""
        own = self.table("links").where(F.col("from_note_path") == path)
        path_of = F.when(F.col("is_resolved") & (F.col("to_note_path") != ""), F.col("to_note_path"))
        rows = own.select(F.col("link_type").alias("kind"), F.col("link_target").alias("target"), F.col("is_resolved").alias("resolved"), path_of.alias("resolved_path"), "alias", "heading", "block_ref")
        counts = notelinks.outlink_counts(own).withColumn("total", F.col("wikilinks") + F.col("markdown_links") + F.col("embeds") + F.col("external"))
        return rows.orderBy("kind", "target"), counts

    def find_broken_links(self, folder: str | None = None, limit: int = 100) -> DataFrame:
        return notelinks.broken_by_note(self.table("links"), folder, clamp(limit, 1, 500))

    def find_orphan_notes(self, folder: str | None = None, limit: int = 100) -> DataFrame:
        found = notelinks.orphan_notes(self.table("links"), self._catalog())
        found = found.where(navigate.in_folder("folder", folder)) if folder else found
        return found.orderBy("mtime_ns", "path").limit(clamp(limit, 1, 500))

    def link_stats(self, limit: int = 50) -> tuple[DataFrame, DataFrame]:
        return notelinks.link_totals(self.table("links")), notelinks.link_rankings(self.table("links"), clamp(limit, 1, 200))

    def graph_data(self, folder: str | None = None, include_orphans: bool = False) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the links out of ``folder``, if one is given, else of all."""
        links = self.table("links")
        links = links.where(F.col("from_note_path").startswith(folder.strip("/") + "/")) if folder else links
        nodes, edges = graph.node_degrees(links), graph.note_edges(links)
        if include_orphans:
            lone = graph.unlinked_notes(links, self._catalog())
            nodes = nodes.unionByName(lone.select("path", F.col("path").alias("label"), F.lit(0).cast("long").alias("outlinks"), F.lit(0).cast("long").alias("backlinks")))
        return nodes, edges

    def suggest_links(self, path: str, limit: int = 10, min_similarity: float = 0.7) -> DataFrame:
        """Notes among the most similar (three times ``limit``) that the note does not link to yet, by path or by name."""
        k = clamp(limit, 1, 50)
        near = self._similar(path, 3 * k).where(F.col("score") >= min_similarity)
        own = self.table("links").where((F.col("from_note_path") == path) & (F.col("link_type") != "external"))
        linked = own.select(F.explode(F.array("to_note_path", "link_target_normalized")).alias("name")).where("name <> ''").distinct()
        by_path = near.join(linked, F.col("note_path") == F.col("name"), "left_anti")
        by_name = by_path.join(linked, normalize_target(F.col("note_path")) == F.col("name"), "left_anti")
        return by_name.orderBy(F.desc("score"), "note_path").limit(k)

    def find_link_clusters(self, min_cluster_size: int = 3, folder: str | None = None) -> DataFrame:
        """The 20 largest clusters with their first 20 notes; see ``graph.cluster_members``."""
        links = self.table("links")
        found = graph.cluster_members(graph.note_edges(links, folder), clamp(min_cluster_size, 2, 100))
        titles = graph.node_degrees(links).select(F.col("path").alias("node"), "label")
        return found.join(titles, "node", "left").orderBy(F.desc("size"), "component", "position")

    def find_bridge_notes(self, limit: int = 20, folder: str | None = None) -> DataFrame:
        return graph.bridge_notes(graph.note_edges(self.table("links"), folder)).orderBy(F.desc("score"), "node").limit(clamp(limit, 1, 100))

    # Navigation

    def get_recent_notes(self, now: datetime, days: int = 7, limit: int = 20, folder: str | None = None) -> DataFrame:
        return navigate.recent_notes(self._catalog(), now, clamp(days, 1, 365), folder, clamp(limit, 1, 100))

    def tag_stats(self, limit: int = 50, folder: str | None = None) -> DataFrame:
        return navigate.tag_counts(self.table("chunks"), folder, clamp(limit, 1, 500))

    def folder_tree(self, max_depth: int = 10) -> DataFrame:
        return navigate.folder_tree(self._catalog(), clamp(max_depth, 1, 50))

    def random_note(self, seed: int, folder: str | None = None, extension: str | None = None) -> DataFrame:
        return navigate.random_note(self._catalog(), seed, folder, extension)

    def daily_note(self, date: str, folder: str = "daily") -> DataFrame:
        return navigate.daily_note(self._catalog(), date, folder)

    def list_notes(self, folder: str | None = None, extension: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
        return navigate.list_notes(self._catalog(), folder, extension, clamp(limit, 1, 5000), max(0, offset))

    def vault_stats(self) -> DataFrame:
        return navigate.corpus_totals(self.table("chunks"))

    def system_stats(self, reset: bool = False) -> dict:
        out = {name: {"count": len(t), "p50_ms": median(t), "p95_ms": _p95(t), "mean_ms": mean(t)} for name, t in self.samples.items() if t}
        if reset:
            self.samples.clear()
        return out | {"query_cache": embed_query.cache_info()._asdict()}

    def health_check(self) -> dict:
        slow = sorted(n for n, t in self.samples.items() if t and _p95(t) > SLOW_MS)
        cache = embed_query.cache_info()
        asked = cache.hits + cache.misses
        alerts = [f"slow: {n}" for n in slow] + (["few cache hits"] if asked and cache.hits / asked < LEAST_HIT_RATE else [])
        return {"status": "warning" if alerts else "ok", "alerts": alerts, "published": self.store.current()}

    def benchmark_search(self, query: str = "test", iterations: int = 10) -> dict:
        times = []
        for _ in range(clamp(iterations, 1, 100)):
            start = time.perf_counter()
            self.search_vault(query).collect()
            times.append((time.perf_counter() - start) * 1000)
        times.sort()
        return {"mean_ms": mean(times), "min_ms": times[0], "max_ms": times[-1], "p50_ms": times[len(times) // 2], "p95_ms": times[int(0.95 * len(times))]}

    # Notes

    def read_note(self, path: str) -> str:
        return self.files.read(path)

    def get_note_metadata(self, path: str) -> dict:
        return self.files.metadata(path)

    def create_note(self, path: str, content: str, frontmatter: dict | None = None) -> dict:
        return self.files.create(path, content, frontmatter)

    def write_note(self, path: str, content: str) -> None:
        self.files.write(path, content)

    def append_note(self, path: str, content: str, separator: str = "\n\n") -> None:
        self.files.append(path, content, separator)

    def update_frontmatter(self, path: str, metadata: dict, merge: bool = True) -> dict:
        return self.files.update_frontmatter(path, metadata, merge)

    def delete_note(self, path: str) -> str:
        return self.files.delete(path)

    def move_note(self, from_path: str, to_path: str) -> None:
        self.files.move(from_path, to_path)

    def generate_missing_ids(self, folder: str = "", dry_run: bool = True) -> DataFrame:
        """Markdown notes without an id, as (path); unless ``dry_run``, each gets one. Files are read and written by the tasks."""
        notes = scan(self.spark, self.root, self.settings).where("extension = '.md'")
        notes = notes.where(navigate.in_folder("folder", folder)) if folder else notes
        return Scratch(self.spark, "ids").table(lacking_ids(notes, self.root, self.settings, not dry_run))

    def validate_frontmatter(self, path: str | None = None, frontmatter: dict | None = None) -> DataFrame:
        if (path is None) == (frontmatter is None):
            raise InvalidRequest("give either a path or frontmatter")
        import json

        meta = self.files.metadata(path) if path is not None else frontmatter
        flat = {str(k): json.dumps(v) if isinstance(v, list) else str(v) for k, v in meta.items() if v is not None}
        return validate(self.spark.createDataFrame([(flat,)], "frontmatter map<string,string>"), self.rules)

    def enrich_frontmatter(self, notes: DataFrame, fill, limit: int = 100) -> DataFrame:
        """Notes (path, frontmatter) with missing required fields, filled by ``fill``, a function for ``mapInPandas``; no command is run."""
        lacking = validate(notes, self.rules).where(F.exists("validation.errors", lambda e: e["code"] == "required_missing"))
        return lacking.select("path", "frontmatter").orderBy("path").limit(clamp(limit, 1, 1000)).mapInPandas(fill, "path string, frontmatter map<string,string>")

    def enrich_frontmatter_status(self, query_id: str | None = None) -> list[dict]:
        """The jobs that Spark's status tracker knows: of the job group ``query_id``, running or done, or all that run now."""
        tracker = self.spark.sparkContext.statusTracker()
        ids = tracker.getActiveJobsIds() if query_id is None else tracker.getJobIdsForGroup(query_id)
        return [{"job_id": j, "status": info.status, "stages": list(info.stageIds)} for j in sorted(ids) if (info := tracker.getJobInfo(j))]

    # Resources

    def resource_stats(self) -> DataFrame:
        return self.vault_stats()

    def resource_folders(self) -> DataFrame:
        return navigate.folders(self._catalog()).orderBy("folder")

    def resource_notes(self) -> DataFrame:
        return self.list_notes(limit=5000)

    def resource_note(self, path: str) -> str:
        return self.read_note(path)

    def resource_recent(self, now: datetime) -> DataFrame:
        return self.get_recent_notes(now, 7, 50)

    def resource_tags(self) -> DataFrame:
        return navigate.tag_counts(self.table("chunks"))
