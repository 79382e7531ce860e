"""The registered queries of the core: each takes (spark, sf_dir) and returns a DataFrame over the whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import highlight as hl
from marginalia.functions import links as ln
from marginalia.functions.coerce import FieldRule, coerce, issue_counts, validate
from marginalia.functions.strings import is_blank, normalize_target, present, stem
from marginalia.functions.vectors import mean_vectors, nearest
from marginalia.operators import duplicates, fts, graph, navigate, notelinks, search, sync
from marginalia.operators.orphans import orphan_references, orphan_report
from marginalia.operators.packed import packed_values
from marginalia.operators.passages import section_passages
from marginalia.streaming.changes import allowed_attempts, coalesced

NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _over(name: str, *tables: str):
    """Registers a query that applies a function to whole tables."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf: f(*(_read(spark, sf, t) for t in tables))
        return f

    return register


# Vectors: every hundredth row is a query against all rows.


def _asked(embeddings: DataFrame) -> DataFrame:
    return embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _knn(metric: str) -> Callable[[DataFrame], DataFrame]:
    def run(e: DataFrame) -> DataFrame:
        found = nearest(e, _asked(e), "vec_id", "embedding", 10, metric)
        return found.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), "rank")

    return run


for _metric in ("cosine", "l2", "dot"):
    _over(f"knn_{_metric}", "embeddings")(_knn(_metric))


@_over("knn_other_labels", "embeddings")
def _(e):
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").alias("own"))
    found = nearest(e, asked, "vec_id", "embedding", 5, skip="label")
    return search.formatted(found).select("query_id", "id", F.round("distance", 6).alias("distance"), "rank", F.round("score", 3).alias("score"))


@_over("mean_vectors_by_label", "embeddings")
def _(e):
    return mean_vectors(e, "label", "embedding").select("label", F.posexplode("mean").alias("i", "m")).select("label", "i", F.round("m", 6).alias("m"))


@_over("similar_labels", "embeddings")
def _(e):
    found = search.similar_groups(e, e.select("label").distinct(), "label", "vec_id", "embedding", 5)
    return found.select("query_id", "other", F.round("distance", 6).alias("distance"), "rank")


@_over("duplicate_note_groups", "embeddings")
def _(e):
    pairs = duplicates.similar_pairs(e, "vec_id", "embedding", 0.4)
    groups = duplicates.with_copies(duplicates.greedy_groups(pairs), duplicates.vector_classes(e, "vec_id", "embedding"))
    return duplicates.group_summary(groups)


@_over("duplicate_note_links", "embeddings")
def _(e):
    pairs = duplicates.similar_pairs(e, "vec_id", "embedding", 0.4)
    return duplicates.linked_classes(e, "vec_id", "embedding", pairs).withColumnRenamed("id", "vec_id")


# Full text: titles of every hundredth document are the queries.


def _titles(d: DataFrame) -> DataFrame:
    return d.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("title").alias("query")).where("query IS NOT NULL")


@_over("fts_terms", "documents")
def _(d):
    return fts.term_frequencies(fts.postings(d, "doc_id"))


@_over("bm25_topk", "documents")
def _(d):
    return fts.bm25(d, _titles(d), "doc_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@_over("hybrid_rrf", "documents", "embeddings")
def _(d, e):
    words = fts.bm25(d, _titles(d), "doc_id", top_k=search.candidate_count(10))
    near = nearest(e, _asked(e), "vec_id", "embedding", search.candidate_count(10))
    return search.fuse([near, words], 10).select("query_id", "id", F.round("score", 9).alias("score"), "best_rank", "rank")


@_over("reranked", "documents")
def _(d):
    titles = _titles(d)
    ranked = fts.bm25(d, titles, "doc_id", top_k=search.candidate_count(10)).join(titles, "query_id").join(d.select(F.col("doc_id").alias("id"), "text"), "id")
    return search.rerank(ranked, 10).select("query_id", "id", "rerank_score", "position")


@_over("exclude_after_topk", "documents")
def _(d):
    ranked = fts.bm25(d, _titles(d), "doc_id", top_k=50).join(d.select(F.col("doc_id").alias("id"), "text"), "id")
    return ranked.where(navigate.without_terms(["ledger", "puzzle"])).select("query_id", "id", "rank")


@_over("highlighted", "documents")
def _(d):
    return d.select("doc_id", hl.highlight(F.col("text"), "the Sensor panel (draft)", "<mark>", "</mark>").alias("marked"))


# Links inside texts.


@_over("note_links", "documents")
def _(d):
    return ln.extract_links(d, "doc_id").select("doc_id", "link_type", "link_target", "link_target_normalized", "is_resolved", "alias", "heading", "block_ref", "context")


@_over("wikilinks", "documents")
def _(d):
    found = ln.extract_links(d, "doc_id", context=False).where("link_type = 'wikilink'")
    return found.groupBy("doc_id").agg(F.count("*").alias("n_links"), F.min("link_target").alias("first_target"))


@_over("external_links", "documents")
def _(d):
    return ln.extract_links(d, "doc_id", context=False).where("link_type = 'external'").select("doc_id", F.col("link_target").alias("url"))


@_over("embedded_files", "links")
def _(k):
    return ln.extract_links(k, "link_id", "context", context=False).where("link_type = 'embed'").select("link_id", "link_target", "link_target_normalized")


@_over("markdown_links", "links")
def _(k):
    return ln.extract_links(k, "link_id", "context", context=False).where("link_type = 'markdown'").select("link_id", "link_target", "alias")


@_over("link_parts", "links")
def _(k):
    return k.where("link_type = 'wikilink'").select("link_id", ln.wikilink_parts(F.col("link_target")).alias("p")).select("link_id", "p.target", "p.alias", "p.heading", "p.block_ref")


@_over("links_that_match_paths", "links")
def _(k):
    return k.where("to_note_path <> ''").select("link_id", ln.matches_note(F.col("link_target"), F.col("to_note_path")).alias("matches"))


# Sections and passages of whole documents.


@_over("document_passages", "documents")
def _(d):
    return section_passages(d, "doc_id")


@_over("note_labels", "note_catalog")
def _(n):
    return n.where(~is_blank(F.col("path"))).select("path", stem(F.col("path")).alias("stem")).distinct()


@_over("normalized_targets", "links")
def _(k):
    return k.select("link_id", normalize_target(F.col("link_target")).alias("normalized"))


# The link table.

_over("resolve_links", "links", "note_catalog", "aliases")(notelinks.resolve_links)
_over("backlinks", "links", "note_catalog")(notelinks.backlinks)
_over("backlink_counts", "links", "note_catalog")(notelinks.backlink_counts)
_over("outlink_counts", "links")(notelinks.outlink_counts)
_over("broken_links", "links")(lambda k: notelinks.broken_by_note(k, limit=100))
_over("broken_links_in_folder", "links")(lambda k: notelinks.broken_by_note(k, folder="projects"))
_over("broken_link_details", "links")(notelinks.broken_details)
_over("orphan_notes", "links", "note_catalog")(notelinks.orphan_notes)
_over("orphan_totals", "links", "note_catalog")(notelinks.orphan_totals)
_over("link_totals", "links")(notelinks.link_totals)
_over("link_rankings", "links")(notelinks.link_rankings)

# Passages and the catalog.

_over("corpus_totals", "chunks")(navigate.corpus_totals)
_over("notes_by_extension", "note_catalog")(navigate.by_extension)
_over("tag_counts", "chunks")(navigate.tag_counts)
_over("tag_counts_top", "chunks")(lambda c: navigate.tag_counts(c, "projects", 50))
_over("notes_with_any_tag", "chunks")(lambda c: navigate.notes_with_tags(c, ["ops", "Todo"]))
_over("notes_with_all_tags", "chunks")(lambda c: navigate.notes_with_tags(c, ["field notes", "home-lab"], match_all=True))
_over("folder_counts", "note_catalog")(lambda n: navigate.folder_counts(n, 1))
_over("folder_tree", "note_catalog")(navigate.folder_tree)
_over("folders", "note_catalog")(navigate.folders)
_over("list_notes", "note_catalog")(lambda n: navigate.list_notes(n, "projects", "md", 50, 10).select("path", "mtime_ns", "total", "has_more"))
_over("recent_notes", "note_catalog")(lambda n: navigate.recent_notes(n, NOW, 365))
_over("random_note", "note_catalog")(lambda n: navigate.random_note(n, 7))
_over("daily_note", "note_catalog")(lambda n: navigate.daily_note(n, "2024-05-01"))
_over("capped_passages", "chunks")(lambda c: navigate.capped_passages(c, 20).select("chunk_id", "note_path"))


@_over("facet_search", "chunks")
def _(c):
    wanted = navigate.facets(tags=["o"], status="Draft", start="2023-06-01", end="2024-12-31", extension="md")
    return c.where(wanted).select("chunk_id", "note_path", "modified_at")


@_over("recent_passages", "chunks")
def _(c):
    return c.where(navigate.since(365, NOW)).select("chunk_id", "modified_at")


@_over("sync_diff", "note_catalog", "chunks")
def _(n, c):
    scanned = navigate.living_notes(n).select("path", F.timestamp_micros((F.col("mtime_ns") / 1000).cast("long")).alias("mtime"))
    indexed = c.where(present(F.col("note_path")).isNotNull()).groupBy(F.col("note_path").alias("path")).agg(F.max("modified_at").alias("modified_at"))
    return sync.sync_diff(scanned, indexed)


@_over("catalog_reconcile", "note_catalog")
def _(n):
    first = n.groupBy("path").agg(F.min(F.struct("mtime_ns", "size")).alias("r")).select("path", "r.*")
    return sync.reconcile(navigate.living_notes(n), first)


@_over("latest_lives", "note_catalog")
def _(n):
    return sync.latest_rows(n.select("path", "first_seen_at", "mtime_ns", "size"), "path", ["first_seen_at"])


_over("latency_by_type", "events")(lambda e: navigate.latency_summary(e, "event_type", "value").select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")))

# Changes: events stand for writes, users for notes.


@_over("coalesced_changes", "events")
def _(e):
    changes = e.select(F.col("user_id").cast("string").alias("path"), (F.col("event_type") == "error").alias("deleted"), "ts")
    return coalesced(changes, 1800).select("path", "deleted", F.col("ts").cast("timestamp_ntz").alias("ts"), "n")


@_over("refused_attempts", "events")
def _(e):
    tried = allowed_attempts(e.select(F.col("user_id").cast("string").alias("path"), "ts"), most=3, window_s=86_400.0)
    return tried.groupBy("path").agg(F.count("*").alias("attempts"), F.count_if(~F.col("allowed")).alias("refused"))


# Frontmatter: the metadata that passages carry, as a map of strings.

RULES = {
    "status": FieldRule("enum", on_missing="require", values=("draft", "review", "published", "archived")),
    "id": FieldRule("uuid", on_missing="suggest"),
    "created_at": FieldRule("datetime"),
    "tags": FieldRule("list", max_items=5),
    "description": FieldRule("string", max_length=80),
}


def _frontmatter(c: DataFrame) -> DataFrame:
    given = F.map_filter(F.create_map(*(x for f in RULES for x in (F.lit(f), F.col(f)))), lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    return c.select("chunk_id", given.alias("frontmatter"))


@_over("frontmatter_issues", "chunks")
def _(c):
    return issue_counts(validate(_frontmatter(c), RULES))


@_over("valid_frontmatter", "chunks")
def _(c):
    return validate(_frontmatter(c), RULES).select("chunk_id", F.col("validation.valid").alias("valid"), F.size("validation.errors").alias("n_errors"))


@_over("coerced_numbers", "events")
def _(e):
    value = F.get_json_object("props", "$.k")
    return e.select("event_id", coerce(value, FieldRule("int", minimum=10, maximum=90)).alias("c")).select("event_id", F.col("c.value").cast("long").alias("k"), F.col("c.problem").alias("problem"))


@_over("coerced_dates", "chunks")
def _(c):
    return c.select("chunk_id", coerce(F.col("created_at"), FieldRule("date")).alias("c")).select("chunk_id", F.col("c.value").alias("day"), F.col("c.problem").alias("problem"), F.col("c.warning").alias("warning"))


# The graph.

_over("graph_nodes", "links")(lambda k: graph.node_degrees(k).select("path", "outlinks", "backlinks"))
_over("graph_edges", "links")(graph.note_edges)
_over("unlinked_notes", "links", "note_catalog")(graph.unlinked_notes)
_over("matched_clusters", "graph_edges")(lambda g: graph.link_clusters(_ends(g)))
_over("link_clusters", "links")(lambda k: graph.link_clusters(graph.note_edges(k)))
_over("bridge_notes", "links")(lambda k: graph.bridge_notes(graph.note_edges(k)))


def _ends(g: DataFrame) -> DataFrame:
    return g.select(present(F.trim("source")).alias("source"), present(F.trim("target")).alias("target")).where("source IS NOT NULL AND target IS NOT NULL")


# Packed fields and missing records.


@query
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return packed_values(_read(spark, sf, "chunks"), "chunk_id", ("tags", "category"))


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(*(_read(spark, sf, t) for t in ("links", "aliases", "chunks", "note_catalog")))


@query
def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).where("kind = 'direct'").select("src_table", "ref_field", "row_id", "reason", "period_month")


@query
def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf))
