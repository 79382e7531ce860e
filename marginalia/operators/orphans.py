"""References to records that do not exist: missing, deleted or not there yet, direct and inherited."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.lineage import Scratch
from marginalia.functions.strings import is_blank, normalize_target, present, stem
from marginalia.operators.skew import is_hot, join_unique

FOREVER = "9999-12-31 00:00:00"
# Rounds after which what they found is written as one table.
MOST_PARTS = 20


def judged(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """``refs`` (key, ts, ref) with ``reason``: null where a life of the key covers the time.

    ``lives`` has (key, start, till), till null while the life lasts. A life covers a time from its start until before its
    end. ``missing``: the key has no life; ``late``: one starts after the time; ``deleted``: all others. A null time is covered
    by none. Lives and references of a key are put in order of time, and the latest end so far is carried along. Keys of more rows than
    a task should hold are first thinned to their distinct times and cut by day, with the days before summed up, so that no key
    needs to fit into one task.
    """
    disk = Scratch(refs.sparkSession, "judged")
    lasting = F.lit(FOREVER).cast("timestamp_ntz")
    refs = disk.table(refs.select("key", "ts", "ref"))
    spans = disk.table(lives.select("key", F.col("start").alias("ts"), F.coalesce("till", lasting).alias("till")).distinct())
    keys = disk.table(refs.select("key").unionAll(spans.select("key")).groupBy("key").agg(F.count("*").alias("n")))
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = disk.table(keys.where(is_hot(F.col("n"), total)).select("key", F.lit(True).alias("hot")))
    disk.drop(keys)
    if few.isEmpty():
        return _in_order(refs, spans)

    hot = F.broadcast(few)
    own, all_spans = refs.join(hot, "key", "left"), spans.join(hot, "key", "left")
    out = _in_order(own.where("hot IS NULL"), all_spans.where("hot IS NULL"))

    by_key = Window.partitionBy("key")
    hot_refs = own.where("hot").drop("hot")
    days = _events(hot_refs.select("key", "ts", F.lit(None).cast(dict(refs.dtypes)["ref"]).alias("ref")).distinct(), all_spans.where("hot")).withColumn("day", F.date_trunc("day", "ts"))
    per_day = days.groupBy("key", "day").agg(F.max("till").alias("t"), F.max(F.when(F.col("kind") == 0, F.col("ts"))).alias("s"), F.count("till").alias("c"))
    earlier = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    sums = per_day.select("key", "day", F.max("t").over(earlier).alias("before"), F.max("s").over(by_key).alias("last_start"), F.sum("c").over(by_key).alias("n_lives"))
    within = Window.partitionBy("key", "day").orderBy(F.col("ts").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    cut = days.join(sums.withColumnsRenamed({"key": "k", "day": "d"}), F.col("key").eqNullSafe(F.col("k")) & F.col("day").eqNullSafe(F.col("d")))
    seen = cut.withColumn("latest", F.greatest("before", F.max("till").over(within))).where("kind = 1")
    probe = F.struct("key", "ts").alias("probe")
    answers = seen.select(probe, _reason())
    waiting = hot_refs.select(probe, "ref")
    times = waiting.groupBy("probe").agg(F.count("*").alias("n"))
    met = join_unique(waiting, answers, "probe", times, total)
    return out.unionByName(met.select("probe.key", "probe.ts", "ref", "reason"))


def _in_order(refs: DataFrame, lives: DataFrame) -> DataFrame:
    """The references of keys that fit into a task."""
    by_key = Window.partitionBy("key")
    so_far = by_key.orderBy(F.col("ts").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    events = _events(refs, lives)
    seen = events.withColumns({"latest": F.max("till").over(so_far), "last_start": F.max(F.when(F.col("kind") == 0, F.col("ts"))).over(by_key), "n_lives": F.count("till").over(by_key)})
    return seen.where("kind = 1").select("key", "ts", "ref", _reason())


def _events(refs: DataFrame, lives: DataFrame) -> DataFrame:
    kind = dict(refs.dtypes)["ref"]
    marks = lives.select("key", "ts", F.lit(0).alias("kind"), "till", F.lit(None).cast(kind).alias("ref"))
    return marks.unionByName(refs.select("key", "ts", F.lit(1).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("till"), "ref"))


def _reason():
    covered = F.col("latest") > F.col("ts")
    return F.when(covered, F.lit(None)).when(F.col("n_lives") == 0, "missing").when(F.col("last_start") > F.col("ts"), "late").otherwise("deleted").alias("reason")


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` holds values of ``parent.key``."""

    child: str
    column: str
    parent: str
    key: str


def inherited_orphans(tables: dict[str, DataFrame], direct: DataFrame, keys: list[ForeignKey]) -> DataFrame:
    """Orphaned records as (src_table, row_id, depth): 0 for those in ``direct`` (src_table, row_id), more for inherited.

    A record is indirectly orphaned when it refers to a key all of whose records are orphaned, in all parents that its column has
    among ``keys``. Semi-joins go down the foreign keys until a round finds no new record, however deep that is; circles end since a
    record is found once. A round looks only at keys of records found in the round before: a key is lost when its last record is.
    Null keys and references are none. ``tables`` have a unique ``row_id`` each. Keys with many referring records are joined
    without moving these.
    """
    disk = Scratch(direct.sparkSession, "orphans")
    columns = list(dict.fromkeys((fk.child, fk.column) for fk in keys))
    children, sizes = {}, {}
    for child, column in columns:
        rows = tables[child].select("row_id", F.col(column).alias("k")).where(F.col("k").isNotNull())
        children[child, column] = rows
        counted, seen = disk.measured(rows.groupBy("k").agg(F.count("*").alias("n")), total=F.sum("n"))
        sizes[child, column] = counted, seen["total"] or 0

    fresh = known = disk.table(direct.select("src_table", "row_id").distinct().withColumn("depth", F.lit(0)))
    n_parts, depth = 1, 0
    while True:
        depth += 1
        found = None
        for child, column in columns:
            gone = alive = None
            for fk in keys:
                if (fk.child, fk.column) == (child, column):
                    parents = tables[fk.parent].select("row_id", F.col(fk.key).alias("k")).where(F.col("k").isNotNull())
                    own_gone = parents.join(fresh.where(F.col("src_table") == fk.parent).select("row_id"), "row_id", "left_semi").select("k")
                    own_alive = parents.join(known.where(F.col("src_table") == fk.parent).select("row_id"), "row_id", "left_anti").select("k")
                    gone = own_gone if gone is None else gone.unionByName(own_gone)
                    alive = own_alive if alive is None else alive.unionByName(own_alive)
            lost = gone.distinct().join(alive, "k", "left_anti")
            new = join_unique(children[child, column], lost, "k", *sizes[child, column]).select(F.lit(child).alias("src_table"), "row_id")
            found = new if found is None else found.unionByName(new)
        if found is None:
            return known
        once = found.distinct().join(known.select("src_table", "row_id"), ["src_table", "row_id"], "left_anti").withColumn("depth", F.lit(depth))
        fresh, seen = disk.measured(once, n=F.count("*"))
        if not seen["n"]:
            return known
        known, n_parts = known.unionByName(fresh), n_parts + 1
        if n_parts > MOST_PARTS:
            known, n_parts = disk.table(known), 1


def orphan_references(links: DataFrame, aliases: DataFrame, chunks: DataFrame, catalog: DataFrame) -> DataFrame:
    """Orphan references as (src_table, ref_field, row_id, reason, period_month, kind, depth).

    ``kind`` is ``direct`` for a reference no life of whose notes covers its row's time (see ``judged``), with depth 0, and
    ``inherited`` for the target of a link that stands in an orphaned note's row or is named only by orphaned alias rows (by no
    sound one, and by the path or stem of no note in ``catalog``), with reason ``inherited``; a reference that is an orphan itself is not also inherited.

    References are both ends of ``links`` (external ones have no target), and ``note_path`` of ``aliases`` and ``chunks``. Null
    and blank ones are none. Paths must equal a path in ``catalog`` as written; a target without path names all notes whose
    path or stem equals it once normalised, and those of equal aliases. Rows written twice each count; repeated lives count
    once; empty tables are fine; other columns are ignored.
    """
    at = lambda c: F.col(c).cast("timestamp_ntz").alias("ts")
    ref = lambda t, f, i: F.struct(F.lit(t).alias("src_table"), F.lit(f).alias("ref_field"), F.col(i).cast("long").alias("row_id")).alias("ref")
    path = lambda c: F.concat(F.lit("p"), present(F.col(c))).alias("key")

    link = links.select("link_id", "from_note_path", "to_note_path", "link_target_normalized", "recorded_at", F.coalesce(F.col("link_type") == "external", F.lit(False)).alias("external"))
    name = F.when(is_blank(F.col("to_note_path")), F.concat(F.lit("n"), present(F.col("link_target_normalized"))))
    target = F.coalesce(F.concat(F.lit("p"), present(F.col("to_note_path"))), name).alias("key")
    refs = (
        link.select(path("from_note_path"), at("recorded_at"), ref("links", "from_note_path", "link_id"))
        .unionAll(link.where("NOT external").select(target, at("recorded_at"), ref("links", "target", "link_id")))
        .unionAll(aliases.select(path("note_path"), at("recorded_at"), ref("aliases", "note_path", "alias_id")))
        .unionAll(chunks.select(path("note_path"), at("indexed_at"), ref("chunks", "note_path", "chunk_id")))
    ).where(F.col("key").isNotNull())

    notes = catalog.select("path", at("first_seen_at").alias("start"), F.col("deleted_at").cast("timestamp_ntz").alias("till")).where(~is_blank(F.col("path"))).distinct()
    paths = notes.select("path").distinct()
    names = paths.select(F.explode(F.array(normalize_target(F.col("path")), normalize_target(stem(F.col("path"))))).alias("name"), "path")
    also = aliases.select(F.col("alias_normalized").alias("name"), F.col("note_path").alias("path"))
    named = names.unionAll(also).where(~is_blank(F.col("name")) & ~is_blank(F.col("path"))).distinct()
    lives = notes.select(F.concat(F.lit("p"), "path").alias("key"), "start", "till").unionAll(named.join(notes, "path").select(F.concat(F.lit("n"), "name").alias("key"), "start", "till"))

    disk = Scratch(links.sparkSession, "references")
    found = disk.table(judged(refs, lives).where(F.col("reason").isNotNull()).select("ref.*", "reason", F.date_format("ts", "yyyy-MM").alias("period_month")))

    rows = {"aliases": aliases.select(F.col("alias_id").cast("long").alias("row_id"), present(F.col("alias_normalized")).alias("name"))}
    rows["links"] = link.where("NOT external").select(F.col("link_id").cast("long").alias("row_id"), F.when(is_blank(F.col("to_note_path")), present(F.col("link_target_normalized"))).alias("name"))
    rows["note_catalog"] = disk.table(names.where(~is_blank(F.col("name"))).select("name").distinct().select(F.xxhash64("name").alias("row_id"), "name"))
    name_keys = [ForeignKey("links", "name", "aliases", "name"), ForeignKey("links", "name", "note_catalog", "name")]
    whole = inherited_orphans(rows, found.where("src_table = 'aliases' OR ref_field = 'from_note_path'"), name_keys)
    reached = whole.where("src_table = 'links'").select("row_id", "depth")
    targets = link.where("NOT external").where(target.isNotNull()).select(F.col("link_id").cast("long").alias("row_id"), F.date_format(F.col("recorded_at").cast("timestamp_ntz"), "yyyy-MM").alias("period_month"))
    direct_targets = found.where("ref_field = 'target'").select("row_id")
    inherited = targets.join(reached, "row_id").join(direct_targets, "row_id", "left_anti")
    inherited = inherited.select(F.lit("links").alias("src_table"), F.lit("target").alias("ref_field"), "row_id", F.lit("inherited").alias("reason"), "period_month", F.lit("inherited").alias("kind"), F.greatest("depth", F.lit(1)).alias("depth"))
    return found.select("*", F.lit("direct").alias("kind"), F.lit(0).alias("depth")).unionByName(inherited)


def orphan_report(references: DataFrame) -> DataFrame:
    """Orphan references counted per table, field, month, kind and reason."""
    return references.groupBy("src_table", "ref_field", "period_month", "kind", "reason").agg(F.count("*").alias("n_references"))
