"""Statistics, listings and filters over passages and the note catalog."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.lineage import Scratch
from marginalia.functions.strings import is_blank, strip


def in_folder(column: str, folder: str) -> Column:
    """In a folder or below it; a folder whose name only begins alike is not."""
    folder = folder.strip("/")
    return (F.col(column) == folder) | F.col(column).startswith(folder + "/")


def tag_list(tags: Column) -> Column:
    """The values of a comma-separated field, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(tags, ","), lambda t: strip(t)), lambda t: t != "")


def any_tag_contains(tags: list[str], column: str = "tags") -> Column:
    """Whether the tag field contains any of ``tags`` as a part."""
    out = F.lit(False)
    for t in tags:
        out = out | F.col(column).contains(t)
    return out


def has_tags(tags: list[str], match_all: bool = False, column: str = "tags") -> Column:
    """Whether the tag list has any (or all) of ``tags`` as whole values, whatever their case."""
    own = F.transform(tag_list(F.col(column)), lambda t: F.lower(t))
    hits = [F.array_contains(own, t.strip().lower()) for t in tags if t.strip()]
    out = F.lit(match_all and bool(hits))
    for h in hits:
        out = (out & h) if match_all else (out | h)
    return F.coalesce(out, F.lit(False))


def since(days: int, now: datetime, column: str = "modified_at") -> Column:
    """Within ``days`` before ``now``, compared as ISO text; a blank between date and time counts as T."""
    iso = F.replace(F.col(column), F.lit(" "), F.lit("T"))
    return iso >= (now - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S")


def date_range(start: str | None = None, end: str | None = None, column: str = "modified_at") -> Column:
    """From ``start`` to ``end``, ISO dates or datetimes; an end date includes its day, an invalid side is ignored."""
    iso = F.replace(F.col(column), F.lit(" "), F.lit("T"))
    out = F.lit(True)
    if start and _iso(start):
        out = out & (iso >= start.replace(" ", "T"))
    if end and _iso(end):
        out = out & (iso <= (end.replace(" ", "T") if len(end) > 10 else end + "T23:59:59.999999"))
    return out


def _iso(text: str) -> bool:
    try:
        datetime.fromisoformat(text)
        return True
    except ValueError:
        return False


def facets(tags: list[str] | None = None, folder: str | None = None, extension: str | None = None, days: int | None = None, now: datetime | None = None, start: str | None = None, end: str | None = None, status: str | None = None, note_type: str | None = None, category: str | None = None, project: str | None = None) -> Column:
    """All given facets at once. They belong before a top-k: they reach the scan as pushed filters where they can."""
    conditions = [F.lit(True)]
    if tags:
        conditions.append(any_tag_contains(tags))
    if folder:
        conditions.append(in_folder("folder", folder))
    if extension:
        conditions.append(F.col("note_path").endswith("." + extension.lstrip(".")))
    if days is not None and now is not None:
        conditions.append(since(days, now))
    if start or end:
        conditions.append(date_range(start, end))
    for column, value in (("status", status), ("note_type", note_type)):
        if value:
            conditions.append(F.lower(strip(F.col(column))) == value.strip().lower())
    if category:
        conditions.append(F.lower(F.col("category")).contains(category.strip().lower()))
    if project:
        conditions.append(strip(F.col("project")) == project.strip())
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def without_terms(terms: list[str], column: str = "text") -> Column:
    """Texts that contain none of ``terms``, whatever their case. Belongs after a top-k, before reranking."""
    out = F.lit(True)
    for t in terms:
        if t.strip():
            out = out & ~F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(t.lower()))
    return out


def corpus_totals(chunks: DataFrame) -> DataFrame:
    """One row (passages, notes, last_modified)."""
    return chunks.agg(F.count("*").alias("passages"), F.count_distinct("note_path").alias("notes"), F.max("modified_at").alias("last_modified"))


def by_extension(catalog: DataFrame) -> DataFrame:
    """Living notes per extension."""
    return catalog.where("deleted_at IS NULL").groupBy("extension").agg(F.count_distinct("path").alias("notes"))


def tag_counts(chunks: DataFrame, folder: str | None = None, limit: int | None = None) -> DataFrame:
    """Notes per tag, each note counting once, with totals, as (tag, notes, total_tags, tagged_notes); most first."""
    own = chunks.where(in_folder("folder", folder)) if folder else chunks
    pairs = own.select("note_path", F.explode(tag_list(F.col("tags"))).alias("tag")).distinct()
    counts = pairs.groupBy("tag").agg(F.count("*").alias("notes"))
    totals = pairs.agg(F.count_distinct("tag").alias("total_tags"), F.count_distinct("note_path").alias("tagged_notes"))
    out = counts.join(F.broadcast(totals))
    return out.orderBy(F.desc("notes"), "tag").limit(limit) if limit else out


def notes_with_tags(chunks: DataFrame, tags: list[str], match_all: bool = False) -> DataFrame:
    """Notes that have the tags in any passage, as (note_path, chunk_id, tags): the first such passage."""
    hits = chunks.where(has_tags(tags, match_all)).select("note_path", "chunk_id", "tags")
    return hits.groupBy("note_path").agg(F.min(F.struct("chunk_id", "tags")).alias("f")).select("note_path", "f.*")


def folder_counts(catalog: DataFrame, max_depth: int = 10) -> DataFrame:
    """Notes per folder, its own level only; folders deeper than ``max_depth`` count in their ancestor of that depth."""
    folder = F.array_join(F.slice(F.split(F.coalesce("folder", F.lit("")), "/"), 1, max_depth), "/")
    return catalog.where("deleted_at IS NULL").select("path", folder.alias("folder")).distinct().groupBy("folder").agg(F.count("*").alias("notes"))


def folder_tree(catalog: DataFrame, max_depth: int = 10) -> DataFrame:
    """Every folder with the notes in and below it, as (folder, depth, notes)."""
    own = folder_counts(catalog, max_depth).where("folder <> ''")
    parts = F.split("folder", "/")
    up = own.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("folder"), k.alias("depth")))).alias("f"), "notes")
    return up.groupBy("f.folder", "f.depth").agg(F.sum("notes").alias("notes"))


def folders(catalog: DataFrame) -> DataFrame:
    """Folders of living notes, without the root."""
    return catalog.where("deleted_at IS NULL").select("folder").where(~is_blank(F.col("folder"))).distinct()


def living_notes(catalog: DataFrame) -> DataFrame:
    """One row per living note: of rows with the same path that modified last."""
    rows = catalog.where("deleted_at IS NULL").where(~is_blank(F.col("path")))
    last = F.max(F.struct("mtime_ns", "folder", "extension", "title", "size")).alias("r")
    return rows.groupBy("path").agg(last).select("path", "r.*")


def list_notes(catalog: DataFrame, folder: str | None = None, extension: str | None = None, limit: int = 500, offset: int = 0) -> DataFrame:
    """A page of living notes, newest first, then by path, with the total and whether more follow."""
    own = living_notes(catalog)
    own = own.where(in_folder("folder", folder)) if folder else own
    own = own.where(F.col("extension") == "." + extension.lstrip(".").lower()) if extension else own
    total = own.agg(F.count("*").alias("total"))
    page = own.orderBy(F.col("mtime_ns").desc_nulls_last(), "path").offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def recent_notes(catalog: DataFrame, now: datetime, days: int = 7, folder: str | None = None, limit: int | None = None) -> DataFrame:
    """Living notes modified within ``days`` before ``now``, with whole days of 24 hours since, as (path, mtime_ns, days_ago)."""
    ns = int(now.timestamp()) * 10**9
    own = living_notes(catalog)
    own = own.where(in_folder("folder", folder)) if folder else own
    recent = own.where((F.col("mtime_ns") >= ns - days * 86_400 * 10**9) & (F.col("mtime_ns") <= ns))
    out = recent.select("path", "mtime_ns", F.floor((F.lit(ns) - F.col("mtime_ns")) / F.lit(86_400 * 10**9)).alias("days_ago"))
    return out.orderBy(F.desc("mtime_ns"), "path").limit(limit) if limit else out


def random_note(catalog: DataFrame, seed: int, folder: str | None = None, extension: str | None = None) -> DataFrame:
    """One living note, by the least hash of its path with ``seed``."""
    own = living_notes(catalog)
    own = own.where(in_folder("folder", folder)) if folder else own
    own = own.where(F.col("extension") == "." + extension.lstrip(".").lower()) if extension else own
    return own.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(1)


def daily_note(catalog: DataFrame, date: str, folder: str = "daily") -> DataFrame:
    """The living note of a day, at ``folder``/``date``.md, as (path, found)."""
    path = f"{folder.strip('/')}/{datetime.fromisoformat(date).date().isoformat()}.md"
    here = living_notes(catalog).where(F.col("path") == path)
    return here.agg(F.lit(path).alias("path"), (F.count("*") > 0).alias("found"))


def capped_passages(chunks: DataFrame, cap: int = 1000) -> DataFrame:
    """The first ``cap`` passages of each note in reading order; repeated numbers by chunk_id.

    A view for those who ask for it: no table is cut by it. Passages without a note path belong to no common note, and each is kept.
    """
    order = Window.partitionBy("note_path").orderBy("chunk_no", "chunk_id")
    of_notes = chunks.where("note_path IS NOT NULL").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")
    return of_notes.unionByName(chunks.where("note_path IS NULL"))


def latency_summary(events: DataFrame, by: str, value: str) -> DataFrame:
    """Count, mean, median and 95th percentile (interpolated) of a measure, per group: (``by``, n, mean, p50, p95).

    Exact for groups of any size: equal values are counted first, the counts are cut into ranges of (group, value), and each range
    starts at the number of values before it, so no task has a whole group. Null values do not count; a group of nulls alone has n = 0
    and nulls, a null group is a group.
    """
    disk = Scratch(events.sparkSession, "latency")
    own = events.select(F.col(by).alias("g"), F.col(value).alias("v"))
    summary = own.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"))
    counts = own.where("v IS NOT NULL").groupBy("g", "v").agg(F.count("*").alias("c"))
    ranges = disk.table(counts.repartitionByRange("g", "v").withColumn("at", F.spark_partition_id()))
    sizes = ranges.groupBy("g", "at").agg(F.sum("c").alias("size"))
    earlier = Window.partitionBy("g").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col("g").alias("of"), F.col("at").alias("range"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"), F.sum("size").over(Window.partitionBy("g")).alias("total"))
    within = Window.partitionBy("g", "at").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranges.withColumn("upto", F.sum("c").over(within)).join(starts, F.col("g").eqNullSafe(F.col("of")) & (F.col("at") == F.col("range")))
    end = F.col("start") + F.col("upto")
    first = end - F.col("c")

    def quantile(share: float) -> Column:
        place = F.lit(share) * (F.col("total") - 1)
        at = lambda k: F.max(F.when((first <= k) & (k < end), F.col("v").cast("double")))
        low, high, rest = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        return low + (high - low) * rest

    found = placed.groupBy(F.col("g").alias("of")).agg(quantile(0.5).alias("p50"), quantile(0.95).alias("p95"))
    return summary.join(found, F.col("g").eqNullSafe(F.col("of")), "left").select(F.col("g").alias(by), "n", "mean", "p50", "p95")
