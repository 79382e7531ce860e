"""Column builders and row generators for the links inside a note's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.strings import normalize_target, stem, strip

# Link syntax and the schemes of external links.
WIKILINK = r"(?<!!)\[\[([^\]]+)\]\]"
EMBED = r"!\[\[([^\]]+)\]\]"
MARKDOWN = r"\[([^\]]+)\]\(([^)]+)\)"
BARE_URL = r"(?<![(\[])(https?://[^\s)>\]\"']+)"
SCHEMES = ("http://", "https://", "mailto:", "tel:", "ftp://")
CONTEXT_CHARS = 50


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _after(c: Column, mark: str) -> Column:
    """What follows the first ``mark``, trimmed; null where that is nothing."""
    rest = strip(F.when(F.instr(c, mark) > 0, c.substr(F.instr(c, mark) + len(mark), F.length(c))))
    return F.when(rest != "", rest)


def _before(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, 1)


def wikilink_parts(inner: Column) -> Column:
    """A struct (target, alias, heading, block_ref) of what stands between double brackets.

    The alias follows the first ``|``, then the block reference the first ``^``, then the heading the first ``#``; absent
    parts are null. Where no target is left, the whole is the target.
    """
    no_alias = _before(inner, "|")
    no_block = _before(no_alias, "^")
    target = strip(_before(no_block, "#"))
    return F.struct(F.when(target != "", target).otherwise(inner).alias("target"), _after(inner, "|").alias("alias"), _after(no_block, "#").alias("heading"), _after(no_alias, "^").alias("block_ref"))


def is_external(href: Column) -> Column:
    out = F.lit(False)
    for scheme in SCHEMES:
        out = out | href.startswith(scheme)
    return out


def link_context(text: Column, raw: Column, window: int = CONTEXT_CHARS) -> Column:
    """``raw`` with ``window`` characters on both sides of its first occurrence, white space collapsed, dots where cut; "" where
    it does not occur."""
    at = F.instr(text, raw)
    start = F.greatest(F.lit(1), at - window)
    end = F.least(F.length(text) + 1, at + F.length(raw) + window)
    cut = strip(text.substr(start, end - start))
    marked = F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(end < F.length(text) + 1, "...").otherwise(""))
    return F.when(at > 0, strip(F.regexp_replace(marked, r"(?U)\s+", " "))).otherwise("")


def matches_note(target: Column, path: Column) -> Column:
    """Whether a link target names a note: normalized, it is the note's stem, its path, or the end of its path after a slash, this also
    without the target's hyphens."""
    wanted, whole = normalize_target(target), normalize_target(path)
    ends = lambda name: whole.endswith(F.concat(F.lit("/"), name))
    return (wanted == normalize_target(stem(path))) | (wanted == whole) | ends(wanted) | ends(F.replace(wanted, F.lit("-"), F.lit("")))


def extract_links(notes: DataFrame, id_col: str, text_col: str = "text", context: bool = True) -> DataFrame:
    """All links of each note as (``id_col``, link_type, pos, link_target, link_target_normalized, is_resolved, alias, heading,
    block_ref, raw, context).

    Of each type a note's first occurrence per target counts, targets compared in lower case, external ones as written;
    ``pos`` counts matches of the type from 0. External links are resolved and have no normalized target; bare URLs follow those in
    brackets. Null texts have none.
    """
    n = notes.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    none = F.lit(None).cast("string")

    wiki = n.select("id", F.posexplode(all_matches(F.col("text"), WIKILINK, 1)).alias("pos", "inner")).withColumn("p", wikilink_parts(F.col("inner")))
    wiki = wiki.select("id", F.lit("wikilink").alias("link_type"), "pos", F.col("p.target").alias("target"), F.col("p.alias").alias("alias"), F.col("p.heading").alias("heading"), F.col("p.block_ref").alias("block_ref"), F.concat(F.lit("[["), "inner", F.lit("]]")).alias("raw"))

    embeds = n.select("id", F.posexplode(all_matches(F.col("text"), EMBED, 1)).alias("pos", "inner"))
    embeds = embeds.select("id", F.lit("embed").alias("link_type"), "pos", strip(_before(F.col("inner"), "|")).alias("target"), none.alias("alias"), none.alias("heading"), none.alias("block_ref"), F.concat(F.lit("![["), "inner", F.lit("]]")).alias("raw")).where("target <> ''")

    pairs = n.select("id", F.posexplode(all_matches(F.col("text"), MARKDOWN)).alias("pos", "raw"))
    href = strip(F.regexp_extract("raw", MARKDOWN, 2))
    pairs = pairs.select("id", "pos", "raw", F.regexp_extract("raw", MARKDOWN, 1).alias("alias"), href.alias("href")).withColumn("out", is_external(F.col("href")))
    inner = pairs.where("NOT out").select("id", F.lit("markdown").alias("link_type"), "pos", strip(_before(F.col("href"), "#")).alias("target"), "alias", none.alias("heading"), none.alias("block_ref"), "raw").where("target <> ''")
    outer = pairs.where("out").select("id", F.lit("external").alias("link_type"), "pos", F.col("href").alias("target"), "alias", none.alias("heading"), none.alias("block_ref"), "raw")
    bare = n.select("id", F.posexplode(all_matches(F.col("text"), BARE_URL, 1)).alias("pos", "target"))
    bare = bare.select("id", F.lit("external").alias("link_type"), (F.col("pos") + (1 << 30)).alias("pos"), "target", none.alias("alias"), none.alias("heading"), none.alias("block_ref"), F.col("target").alias("raw"))

    every = wiki.unionByName(embeds).unionByName(inner).unionByName(outer).unionByName(bare)
    key = F.when(F.col("link_type") == "external", F.col("target")).otherwise(F.lower("target"))
    first = every.groupBy("id", "link_type", key.alias("k")).agg(F.min_by(F.struct("pos", "target", "alias", "heading", "block_ref", "raw"), "pos").alias("f")).select("id", "link_type", "f.*")
    external = F.col("link_type") == "external"
    out = first.select(F.col("id").alias(id_col), "link_type", "pos", F.col("target").alias("link_target"), F.when(external, "").otherwise(normalize_target(F.col("target"))).alias("link_target_normalized"), external.alias("is_resolved"), "alias", "heading", "block_ref", "raw")
    if not context:
        return out
    with_text = out.join(notes.select(id_col, F.col(text_col).alias("_text")), id_col)
    return with_text.withColumn("context", link_context(F.col("_text"), F.col("raw"))).drop("_text")
