"""Splitting oversized texts at natural boundaries, by byte ranges.

A text is never handled as a whole by Python. It is cut into byte ranges of fixed length; each task sees one range with a
halo on both sides. The first good boundary near the start of a range is its *anchor*. A range's anchor depends only on the
bytes around the range's start, so the range before it, whose halo covers them, finds the same one: the tables of
neighbouring ranges fit together without talking to each other. Between its own anchor and the next range's, a range
packs pieces greedily. Prefix sums of the ranges' piece counts and character counts turn local numbers into numbers and
character offsets of the whole text.

``split_texts`` takes the ranges from a string column, ``split_files`` reads them from files by offset.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions.lineage import Scratch

MAX_CHARS, OVERLAP, RANGE_BYTES = 2000, 200, 1 << 16
RANGES_PER_BLOCK = 4096

PIECE = "range_no long, local_no int, char_start long, char_end long, text string, range_chars long, n_local int"

# Best kind of boundary first: a cut stands after the match.
_BREAKS = tuple(
    re.compile(p)
    for p in (
        r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*",
        r"(?:\r\n|\r|\n)\s*",
        r"[.!?…][\"'”’»)\]]*\s+|[。！？]\s*",
        r"\s+",
    )
)


def best_cut(text: str, least: int, most: int) -> int:
    """The last boundary of the best kind within ``least`` < cut <= ``most``; where there is none, within the part before; only text
    without any boundary is cut at ``most``.

    Paragraph ends come before line ends, these before sentence ends, these before word ends.
    """
    for low, high in ((least, most), (0, least)):
        for kind in _BREAKS:
            cut = 0
            for m in kind.finditer(text, max(0, low - 1), min(len(text), high + 1)):
                if low < m.end() <= high:
                    cut = m.end()
                elif m.start() < high < m.end():  # a long run of white space may be cut anywhere
                    cut = high
            if cut:
                return cut
    while most > least + 1 and most < len(text) and _joins(text[most]):
        most -= 1
    return most


def _joins(c: str) -> bool:
    """Combining marks, variation selectors and joiners stay with the character before them."""
    return "\u0300" <= c <= "\u036f" or "\ufe00" <= c <= "\ufe0f" or c == "\u200d"


def _decode(raw: bytes) -> str:
    """Invalid bytes become one lone surrogate each, so that bytes and characters can be counted into each other."""
    return raw.decode("utf-8", "surrogateescape")


def _n_bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogateescape"))


def _valid(text: str) -> str:
    return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _aligned(raw: bytes, at: int) -> int:
    """The first byte at or after ``at`` that starts a character."""
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(raw))


def _anchor(raw: bytes, at: int, window: int) -> int:
    """The cut nearest after byte ``at``, from the bytes around it alone."""
    at = _aligned(raw, at)
    near = _decode(raw[at : at + 4 * window + 8])[: window + 1]
    if len(near) <= window:  # the rest of the text is short: the range before takes it
        return len(raw)
    return at + _n_bytes(near[: best_cut(near, 0, window)])


def pieces_of_range(raw: bytes, start: int, own: int, first: bool, last: bool, max_chars: int, overlap: int) -> tuple[list[tuple[int, int, str]], int]:
    """Pieces that begin in one range, and the range's length in characters.

    ``raw`` holds the range and its halos, ``start`` is the range's first byte in it and ``own`` its length. A piece is
    (first character, end, text), counted from the range's first character, its overlap included.
    """
    step = max_chars - overlap
    here = 0 if first else _aligned(raw, start)
    after = len(raw) if last else _aligned(raw, start + own)
    n_chars = len(_decode(raw[here:after]))
    begin = here if first else _anchor(raw, start, step)
    end = len(raw) if last else _anchor(raw, start + own, step)
    before = _decode(raw[_aligned(raw, max(0, begin - 4 * overlap)) : begin])[-overlap:] if overlap else ""
    text = _decode(raw[begin:end])
    offset = len(_decode(raw[here:begin]))
    out, at = [], 0
    whole = before + text
    lead = len(before)
    while at < len(text):
        room = max_chars if first and at == 0 else step
        cut = len(text) if len(text) - at <= room else at + best_cut(text[at : at + room + 1], room // 2, room)
        back = min(overlap, lead + at)
        out.append((offset + at - back, offset + cut, _valid(whole[lead + at - back : lead + cut])))
        at = cut
    return out, n_chars


def _in_ranges(batches: Iterator[pa.RecordBatch], max_chars: int, overlap: int, range_bytes: int, keep: list[str], reader=None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, cols = [], {k: [] for k in ("range_no", "local_no", "char_start", "char_end", "text", "range_chars", "n_local")}
        size, rows = 0, batch.to_pydict()
        for i in range(batch.num_rows):
            k, n = rows["range_no"][i], rows["n_bytes"][i]
            raw = rows["raw"][i] if reader is None else reader(rows["path"][i], *halo(k, n, max_chars, overlap, range_bytes))
            lo = halo(k, n, max_chars, overlap, range_bytes)[0]
            start = k * range_bytes - lo
            own = min(range_bytes, n - k * range_bytes)
            pieces, n_chars = pieces_of_range(raw, start, own, k == 0, (k + 1) * range_bytes >= n, max_chars, overlap)
            for j, (a, b, text) in enumerate(pieces or [(0, 0, None)]):
                kept.append(i)
                for c, v in zip(cols, (k, j, a, b, text, n_chars if j == 0 else 0, len(pieces) if j == 0 else 0), strict=True):
                    cols[c].append(v)
                size += len(text or "")
            if size > 4 << 20:
                yield _batch(batch, kept, cols, keep)
                kept, cols, size = [], {c: [] for c in cols}, 0
        yield _batch(batch, kept, cols, keep)


def _batch(batch: pa.RecordBatch, kept: list[int], cols: dict[str, list], keep: list[str]) -> pa.RecordBatch:
    types = {"range_no": pa.int64(), "local_no": pa.int32(), "char_start": pa.int64(), "char_end": pa.int64(), "text": pa.string(), "range_chars": pa.int64(), "n_local": pa.int32()}
    taken = batch.select(keep).take(pa.array(kept, pa.int64()))
    return pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(v, types[c]) for c, v in cols.items())], names=[*keep, *cols])


def halo(k: int, n_bytes: int, max_chars: int, overlap: int, range_bytes: int) -> tuple[int, int]:
    """First byte and length of range ``k`` with its halos: the overlap before it, the next range's anchor after it."""
    lo = max(0, k * range_bytes - 4 * (overlap + 2))
    hi = min(n_bytes, (k + 1) * range_bytes + 4 * (max_chars - overlap) + 64)
    return lo, hi - lo


def _number(local: DataFrame, key: str) -> DataFrame:
    """Prefix sums over the ranges' tables (a row a range), joined back to the pieces; ``key`` tells texts apart.

    Ranges are summed in blocks first, so no task holds more rows of one text than a block's or the number of its blocks.
    """
    ranges = local.where("local_no = 0").select(key, "range_no", "range_chars", "n_local", F.floor(F.col("range_no") / RANGES_PER_BLOCK).alias("_block"))
    ahead = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = ranges.groupBy(key, "_block").agg(F.sum("range_chars").alias("c"), F.sum("n_local").alias("p"))
    of_blocks = Window.partitionBy(key).orderBy("_block")
    starts = blocks.select(key, "_block", ahead(of_blocks, "c").alias("_c"), ahead(of_blocks, "p").alias("_p"))
    within = Window.partitionBy(key, "_block").orderBy("range_no")
    table = ranges.select(key, "_block", "range_no", ahead(within, "range_chars").alias("_chars"), ahead(within, "n_local").alias("_pieces")).join(starts, [key, "_block"])
    table = table.select(key, "range_no", (F.col("_chars") + F.col("_c")).alias("_chars"), (F.col("_pieces") + F.col("_p")).alias("_pieces"))
    return local.where(F.col("text").isNotNull()).join(table, [key, "range_no"])


def _finish(one: DataFrame, many: DataFrame, key: str, carry: list[str]) -> DataFrame:
    """Pieces with global numbers: ``one`` has the pieces of texts of a single range, which need no stitching."""
    single = one.where(F.col("text").isNotNull()).withColumns({"_chars": F.lit(0).cast("long"), "_pieces": F.lit(0).cast("long")})
    several = _number(many, key)
    out = [*carry, (F.col("_pieces") + F.col("local_no")).cast("int").alias("piece_no"), (F.col("_chars") + F.col("char_start")).alias("char_start"), (F.col("_chars") + F.col("char_end")).alias("char_end"), "text"]
    return single.select(*out).unionByName(several.select(*out))


def split_texts(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", carry: tuple[str, ...] = ("headers",), max_chars: int = MAX_CHARS, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of every text over ``max_chars`` characters, as (``id_col``, carry..., piece_no, char_start, char_end, text).

    A text counts without spaces, tabs, CR and LF at both ends; offsets count from its first remaining character. A piece
    has ``max_chars`` characters at most and repeats the last ``overlap`` characters before it (fewer where fewer stand
    there). Cuts stand at the last paragraph end in the later half of the window, else line end, sentence end, word end, else at such an
    end in its earlier half; only text without any is cut hard. Joined without their overlaps, the pieces give the text back.
    ``carry`` columns come along as they are (null stays null). Texts within the limit, null, empty and blank ones give no row; an
    empty table gives none; rows with the same text or id are split alike, each with numbers of its own; null ids are ids; other
    columns of ``df`` are ignored, whatever their names. The pieces of texts of several ranges are cut once and written to the shared folder.
    """
    if not 0 <= overlap < max_chars:
        raise ValueError("overlap must be at least 0 and less than max_chars")
    keep = [id_col, *carry]
    left, right = 4 * (overlap + 2), 4 * (max_chars - overlap) + 64
    trimmed = df.select(*keep, F.expr(f"trim(BOTH ' \\t\\r\\n' FROM `{text_col}`)").alias("_t")).where(F.length("_t") > max_chars)
    sized = trimmed.withColumn("_b", F.col("_t").cast("binary")).withColumn("n_bytes", F.octet_length("_b").cast("long")).drop("_t").withColumn("_row", F.monotonically_increasing_id())
    ranges = sized.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / range_bytes))))
    lo = F.greatest(F.lit(0), F.col("range_no") * range_bytes - left)
    hi = F.least(F.col("n_bytes"), (F.col("range_no") + 1) * range_bytes + right)
    raw = ranges.select(*keep, "_row", "range_no", "n_bytes", F.substring(F.col("_b"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("raw"))
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), "_row long", "n_bytes long", PIECE])
    cols = [*keep, "_row", "n_bytes"]

    def pieces(part: DataFrame) -> DataFrame:
        return part.mapInArrow(lambda it: _in_ranges(it, max_chars, overlap, range_bytes, cols), schema)

    several = F.col("n_bytes") > range_bytes
    cut = Scratch(df.sparkSession, "pieces").table(pieces(raw.where(several)))
    return _finish(pieces(raw.where(~several)), cut, "_row", keep)


def split_files(spark: SparkSession, root: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``split_texts`` for the UTF-8 files under ``root``, as (path, piece_no, char_start, char_end, text).

    No task loads a file: a task opens it, seeks to its range and reads that and the halos. Files need not be trimmed
    or oversized: short files come out as one piece, empty files give no row, invalid bytes become U+FFFD. ``root`` must
    be a folder that every executor mounts.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.col("length").alias("n_bytes")).where("n_bytes > 0")
    ranges = files.withColumn("range_no", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / range_bytes))))
    spread = ranges.repartition("path", "range_no").select("path", "n_bytes", "range_no")

    def read(path: str, lo: int, n: int) -> bytes:
        with open(path, "rb") as f:
            f.seek(lo)
            return f.read(n)

    def pieces(part: DataFrame) -> DataFrame:
        return part.mapInArrow(lambda it: _in_ranges(it, max_chars, overlap, range_bytes, ["path", "n_bytes"], read), f"path string, n_bytes long, {PIECE}")

    several = F.col("n_bytes") > range_bytes
    cut = Scratch(spark, "pieces").table(pieces(spread.where(several)))
    return _finish(pieces(spread.where(~several)), cut, "path", ["path"])
