"""Queries over the link table: resolution, backlinks, broken links, orphan notes, statistics.

Every total counts all links; limits apply only to the top-k reports that have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.strings import is_blank, normalize_target, present, stem
from marginalia.operators.skew import join_any, join_unique


def _external() -> F.Column:
    return F.coalesce(F.col("link_type") == "external", F.lit(False))


def note_names(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """The names by which a link may mean a note, as (name, path, priority): normalized path 1, stem 2, alias 3."""
    paths = catalog.select("path").where(~is_blank(F.col("path"))).distinct()
    of_paths = paths.select(F.explode(F.array(F.struct(normalize_target(F.col("path")).alias("name"), "path", F.lit(1).alias("priority")), F.struct(normalize_target(stem(F.col("path"))).alias("name"), "path", F.lit(2).alias("priority")))).alias("n")).select("n.*")
    of_aliases = aliases.select(F.col("alias_normalized").alias("name"), F.col("note_path").alias("path"), F.lit(3).alias("priority"))
    return of_paths.unionByName(of_aliases).where(~is_blank(F.col("name")) & ~is_blank(F.col("path")))


def resolve_links(links: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """Links without a path, external ones aside, as (link_id, resolved_path): null where no note has the name.

    Of several notes with a name the one by path comes before that by stem, this before that by alias; ties take the least path.
    """
    best = note_names(catalog, aliases).groupBy("name").agg(F.min(F.struct("priority", "path")).alias("b")).select("name", F.col("b.path").alias("resolved_path"))
    open_ = links.where(~_external() & is_blank(F.col("to_note_path"))).select("link_id", present(F.col("link_target_normalized")).alias("name"))
    counts = open_.groupBy("name").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return join_unique(open_, best, "name", counts, total, "left").select("link_id", "resolved_path")


def backlinks(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every note with each other note that links to it, as (path, from_note_path, link_id, link_type, context).

    A link means a note by ``to_note_path`` or by a normalized target equal to the note's normalized path or stem. Of a
    source's several links the first (least link_id) is shown.
    """
    paths = catalog.select("path").where(~is_blank(F.col("path"))).distinct()
    own = links.select("link_id", "from_note_path", "to_note_path", "link_target_normalized", "link_type", "context")
    names = paths.select(F.explode(F.array_distinct(F.array(normalize_target(F.col("path")), normalize_target(stem(F.col("path")))))).alias("name"), "path").where("name <> ''")
    source = ["link_id", "from_note_path", "link_type", "context"]
    by_path = own.select(*source, F.col("to_note_path").alias("path")).join(paths, "path", "left_semi")
    by_name = join_any(own.select(*source, F.col("link_target_normalized").alias("name")).where("name IS NOT NULL"), names, "name").drop("name")
    both = by_path.select("path", *source).unionByName(by_name.select("path", *source)).where("from_note_path IS NOT NULL AND from_note_path <> path")
    first = both.groupBy("path", "from_note_path").agg(F.min(F.struct("link_id", "link_type", "context")).alias("f"))
    return first.select("path", "from_note_path", "f.*")


def backlink_counts(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """How many other notes link to each note that any links to, as (path, backlinks)."""
    return backlinks(links, catalog).groupBy("path").agg(F.count("*").alias("backlinks"))


def outlink_counts(links: DataFrame) -> DataFrame:
    """Links per source note and kind; broken ones without embeds, as (from_note_path, wikilinks, markdown_links, embeds,
    external, broken)."""
    kind = lambda k: F.count_if(F.col("link_type") == k)
    broken = F.col("link_type").isin("wikilink", "markdown") & ~F.coalesce("is_resolved", F.lit(False))
    return links.where("from_note_path IS NOT NULL").groupBy("from_note_path").agg(kind("wikilink").alias("wikilinks"), kind("markdown").alias("markdown_links"), kind("embed").alias("embeds"), kind("external").alias("external"), F.count_if(broken).alias("broken"))


def broken(links: DataFrame, folder: str | None = None) -> DataFrame:
    """Unresolved links that are not external, under ``folder`` if one is given."""
    out = links.where(~_external() & (F.col("is_resolved") == F.lit(False)))
    return out.where((F.col("from_note_path").startswith(folder.rstrip("/") + "/"))) if folder else out


def broken_by_note(links: DataFrame, folder: str | None = None, limit: int | None = None) -> DataFrame:
    """Notes by their broken links, most first, then by path, as (from_note_path, broken_count, total_broken, total_notes)."""
    counts = broken(links, folder).groupBy("from_note_path").agg(F.count("*").alias("broken_count"))
    totals = counts.agg(F.sum("broken_count").alias("total_broken"), F.count("*").alias("total_notes"))
    out = counts.join(F.broadcast(totals)).select("from_note_path", "broken_count", "total_broken", "total_notes")
    return out.orderBy(F.desc("broken_count"), "from_note_path").limit(limit) if limit else out


def broken_details(links: DataFrame, folder: str | None = None, limit: int = 100) -> DataFrame:
    """The broken links of the ``limit`` notes that have most of them."""
    top = broken_by_note(links, folder, limit).select("from_note_path")
    return broken(links, folder).join(F.broadcast(top), "from_note_path", "left_semi").select("link_id", "from_note_path", "link_type", "link_target")


def orphan_notes(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """Markdown notes that no link means, by path, normalized path or stem, as (path, folder, title, mtime_ns).

    A note of several lives shows its latest; three equi-joins stand for the disjunction.
    """
    rows = catalog.where((F.col("extension") == ".md") & ~is_blank(F.col("path")))
    notes = rows.groupBy("path").agg(F.max(F.struct("mtime_ns", "folder", "title")).alias("r")).select("path", "r.folder", "r.title", "r.mtime_ns")
    keyed = notes.withColumns({"by_path": normalize_target(F.col("path")), "by_stem": normalize_target(stem(F.col("path")))})
    inner = links.where(~_external())
    meant = inner.select(F.col("to_note_path").alias("path")).where("path IS NOT NULL").distinct()
    named = inner.select(F.col("link_target_normalized").alias("t")).where("t IS NOT NULL").distinct()
    left = keyed.join(meant, "path", "left_anti").join(named, F.col("by_path") == F.col("t"), "left_anti").join(named, F.col("by_stem") == F.col("t"), "left_anti")
    return left.select("path", "folder", "title", "mtime_ns")


def orphan_totals(links: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row (orphans, notes, percentage to one place)."""
    found = orphan_notes(links, catalog).agg(F.count("*").alias("orphans"))
    all_ = catalog.where((F.col("extension") == ".md") & ~is_blank(F.col("path"))).agg(F.count_distinct("path").alias("notes"))
    return found.join(F.broadcast(all_)).withColumn("percentage", F.round(F.col("orphans") / F.greatest("notes", F.lit(1)) * 100, 1))


def link_totals(links: DataFrame) -> DataFrame:
    """One row: links, resolved and broken internal ones, external ones, their rate and the distinct ends.

    External links count in neither side of the rate.
    """
    external, resolved = _external(), F.coalesce("is_resolved", F.lit(False))
    inside = F.count_if(~external)
    return links.agg(
        F.count("*").alias("total"),
        F.count_if(~external & resolved).alias("resolved"),
        F.count_if(~external & (F.col("is_resolved") == F.lit(False))).alias("broken"),
        F.count_if(external).alias("external"),
        F.when(inside > 0, F.count_if(~external & resolved) * 100 / inside).otherwise(0.0).alias("resolution_rate"),
        F.count_distinct("from_note_path").alias("sources"),
        F.count_distinct(F.when(resolved & ~is_blank(F.col("to_note_path")), F.col("to_note_path"))).alias("targets"),
    )


def link_rankings(links: DataFrame, limit: int = 50) -> DataFrame:
    """The ``limit`` notes with most links out and most resolved links in, as (side, rank, path, n)."""
    out = links.where("from_note_path IS NOT NULL").groupBy(F.col("from_note_path").alias("path")).agg(F.count("*").alias("n"))
    into = links.where(~_external() & F.coalesce("is_resolved", F.lit(False)) & ~is_blank(F.col("to_note_path"))).groupBy(F.col("to_note_path").alias("path")).agg(F.count("*").alias("n"))
    top = lambda d, side: d.orderBy(F.desc("n"), "path").limit(limit).select(F.lit(side).alias("side"), "path", "n")
    both = top(out, "source").unionByName(top(into, "target"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(F.desc("n"), "path")))
