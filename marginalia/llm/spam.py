"""Keyword-stuffed pages and link lists, told from prose by rank-frequency curves.

A page's words, ordered by count, make a curve that is near a line in logarithms for prose. SQL windows give the ranks, weighted
sums the line's slope and the residual about it, and both are held against prose pages (half of whose words stand in
sentences) of the same language and comparable length. The same pages give, rank by rank, the band in which the share of a word of
that rank lies in prose, and how much of a prose page lies above it.

A page is *odd* if its slope or residual lies far outside the middle half of comparable pages', if its overlap with the commonest words of
its language lies far below theirs, or if more of it lies above the band than in nearly all of them. The keywords of a page that lies so far above the band are its
repeated words, less what its language makes usual; those of any other page are only the words above the band. A page is reported if it is odd, its
keywords, links and tags hold most of its words, and fewer than a quarter of them stand in sentences.

A page that no learned language fits is held against all prose of its length by the curve, which prose of a language that is rare in the
corpus follows although none of its words is known. Its sentences are told without words, too: phrases closed with a stop, of five words or more, at least two of
which the page does not repeat.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.lineage import Scratch
from marginalia.llm.words import words

# Of a language's profile: words at most and the share that each must have; its own share of all words and its pages at least. They bound
# what the driver holds to COMMON_WORDS / LANGUAGE_SHARE words. Pages in other languages are judged by their curve.
COMMON_WORDS, COMMON_SHARE = 80, 0.002
LANGUAGE_SHARE, LANGUAGE_PAGES = 0.002, 30
# Pages behind a baseline; with fewer, that of the length in all languages is taken, then that of all prose, then Zipf's law.
BASE_PAGES = 30
ZIPF = 0.2
LEAST_WORDS, REPEATED = 25, 3
# Standard deviations from which a page's line and a word's share at its rank are far; share of the usual overlap that is low; share of prose
# pages that must have less above the band.
FAR, BAND, LOW, NEARLY_ALL = 3.0, 2.0, 0.6, 0.99
HELD_WORDS = 200_000
# Language codes that stand for no single language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")

_LINK = re.compile(r"<a\b[^>]*>.*?</a>|!?\[\[[^\]\n]*\]\]|!?\[[^\]\n]*\]\([^)\s]*\)|https?://\S+|www\.\S+", re.S)
_LINK_SIGNS = ("](", "[[", "://", "www.", "<a ")
_TAG = re.compile(r"#(?<![\w#]#)[^\W_][\w/-]*")
_SEGMENT = re.compile(r"[.!?…。！？\n•·|;](?:(?<=[.!?…。！？])[\"'”’»)\]]*\s+|(?<=\n)(?:\s*\n|(?=\s*(?:[-*+•#>|]|\d+[.)]\s)))|(?<=[•·|;]))")

_ENDS = re.compile(r"([.!?…。！？\n•·|;])")
_STOPS = frozenset(".!?…。！？")

PAGE = "lang string, n int, overlap double, linked int, repeated int, sentences int, said int, counts array<int>, times array<int>, own_counts array<int>, own_times array<int>, own_named array<int>"
_INTS = pa.list_(pa.int32())
_PAGE_TYPES = [pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), _INTS, _INTS, _INTS, _INTS, _INTS]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of the words of each declared language; a full table is handed on and started anew."""
    held: dict[str, Counter] = {}

    def flush() -> pa.RecordBatch:
        rows = [(lang, w, c) for lang, own in held.items() for w, c in own.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "c"])

    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield flush()
    yield flush()


def common_words(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """The words of each language that are at least ``COMMON_SHARE`` of its text, ``COMMON_WORDS`` at most, as (lang, word, p).

    Languages are the declared ones, cut to their first letters; those that hold under ``LANGUAGE_SHARE`` of all words are left
    out, so there are at most 1 / ``LANGUAGE_SHARE`` of them, and so are those of under ``LANGUAGE_PAGES`` pages.
    """
    lang = F.regexp_extract(F.lower(F.trim(F.col(lang_col))), "^([a-z]{2,3})(?![a-z])", 1)
    declared = docs.select(lang.alias("lang"), F.col(text_col).alias("text")).where("lang <> '' AND text IS NOT NULL").where(~F.col("lang").isin(*NO_LANGUAGE))
    spoken = declared.groupBy("lang").agg(F.count("*").alias("pages")).where(F.col("pages") >= LANGUAGE_PAGES).select("lang")
    counts = declared.mapInArrow(_count_words, "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("c"))
    counts = Scratch(docs.sparkSession, "words").table(counts)
    totals = counts.groupBy("lang").agg(F.sum("c").alias("t"))
    shares = totals.crossJoin(F.broadcast(totals.agg(F.sum("t").alias("all")))).where(F.col("t") >= F.col("all") * LANGUAGE_SHARE).join(spoken, "lang", "left_semi").select("lang", "t")
    often = counts.join(F.broadcast(shares), "lang").where(F.col("c") >= F.col("t") * COMMON_SHARE)  # at most 1 / COMMON_SHARE words a language
    ranked = often.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "word")))
    return ranked.where(F.col("r") <= COMMON_WORDS).select("lang", "word", (F.col("c") / F.col("t")).alias("p"))


class _Pages:
    """Counts one page. ``common``: word -> [(language, p)]."""

    def __init__(self, common: list[tuple[str, str, float]]):
        self.of: dict[str, dict[str, float]] = {}
        self.langs: dict[str, list[str]] = {}
        for lang, word, p in common:
            self.of.setdefault(lang, {})[word] = p
            self.langs.setdefault(word, []).append(lang)
        self.total = {lang: sum(own.values()) for lang, own in self.of.items()}

    def page(self, text: str) -> tuple | None:
        spans: list[str] = []
        cut = lambda m: spans.append(m[0]) or "\n\n"
        rest = _LINK.sub(cut, text) if any(map(text.__contains__, _LINK_SIGNS)) else text
        rest = _TAG.sub(cut, rest)
        linked = words(" ".join(spans))
        segments = [said for said in map(words, _SEGMENT.split(rest)) if said]
        seen = Counter(chain.from_iterable(segments))
        counts = seen + Counter(linked) if linked else seen
        n = sum(counts.values())
        if not n:
            return None

        best: dict[str, float] = {}
        for w in counts.keys() & self.langs.keys():
            for lang in self.langs[w]:
                best[lang] = best.get(lang, 0.0) + min(counts[w] / n, self.of[lang][w])
        lang = max(best, key=lambda k: (best[k] / self.total[k], k), default="")
        overlap = best[lang] / self.total[lang] if lang else 0.0
        common = self.of.get(lang, {})

        often = [(w, c, n * common.get(w, 0.0)) for w, c in seen.items() if c >= REPEATED]
        repeated = sum(max(0.0, c - 2 * usual) for w, c, usual in often if not w.isdigit())
        heavy = {w for w, c, usual in often if c >= 0.015 * n and c > 3 * usual}
        is_common, is_heavy = common.__contains__, heavy.__contains__
        sentences = 0
        for said in segments:
            k = len(said)
            if k < 4 or 6 * (known := sum(map(is_common, said))) < k or known < 2:
                continue
            if len(set(filter(is_common, said))) >= 2 and not (heavy and 2 * sum(map(is_heavy, said)) >= k):
                sentences += k
        said = 0 if 4 * sentences >= n else self._closed(rest, seen)
        curve, own, numbers = Counter(counts.values()), Counter(seen.values()), Counter(map(seen.__getitem__, filter(str.isdigit, seen)))
        return lang, n, overlap, len(linked), int(repeated), sentences, said, list(curve), list(curve.values()), list(own), list(own.values()), [m - numbers[c] for c, m in own.items()]


    @staticmethod
    def _closed(text: str, seen: Counter) -> int:
        """Words in phrases that a stop closes, of five words or more, at least two of which the page does not repeat."""
        parts, out = _ENDS.split(text), 0
        for phrase, end in zip(parts[::2], parts[1::2], strict=False):
            if end in _STOPS and len(own := words(phrase)) >= 5 and len({w for w in own if seen[w] < REPEATED and not w.isdigit()}) >= 2:
                out += len(own)
        return out


def _count_pages(batches: Iterator[pa.RecordBatch], common: list, names: list[str]) -> Iterator[pa.RecordBatch]:
    pages = _Pages(common)
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            kept, rows = [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                row = pages.page(text) if text else None
                if row:
                    kept.append(i)
                    rows.append(row)
            cols = zip(*rows, strict=True) if rows else [[] for _ in _PAGE_TYPES]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), *(pa.array(list(c), t) for c, t in zip(cols, _PAGE_TYPES, strict=True))], names=names)


def _steps(pages: DataFrame, counts: str, times: str, named: str) -> DataFrame:
    """The curve of each page in steps: ``m`` words of ``c`` occurrences, ``named`` of them no numbers, on the ranks ``first`` to ``last``."""
    spread = pages.select("row", F.inline(F.arrays_zip(F.col(counts).alias("c"), F.col(times).alias("m"), F.col(named).alias("named"))))
    so_far = Window.partitionBy("row").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = spread.withColumn("last", F.sum("m").over(so_far))
    return ranked.select("row", "c", "m", "named", (F.col("last") - F.col("m") + 1).alias("first"), "last")


def _lines(pages: DataFrame) -> DataFrame:
    """Slope and residual of ln(count) over ln(rank), a row per page; words of one count share their mean rank."""
    points = _steps(pages, "counts", "times", "times").select("row", F.col("m").cast("double").alias("m"), F.log((F.col("first") + F.col("last")) / 2).alias("x"), F.log(F.col("c").cast("double")).alias("y"))
    s = points.groupBy("row").agg(F.sum("m").alias("w"), F.sum(F.expr("m*x")).alias("sx"), F.sum(F.expr("m*y")).alias("sy"), F.sum(F.expr("m*x*x")).alias("sxx"), F.sum(F.expr("m*x*y")).alias("sxy"), F.sum(F.expr("m*y*y")).alias("syy"))
    s = s.withColumns({"vx": F.expr("sxx - sx*sx/w"), "vxy": F.expr("sxy - sx*sy/w"), "vy": F.expr("syy - sy*sy/w")})
    slope = F.when(F.col("vx") > 1e-12, F.col("vxy") / F.col("vx")).otherwise(0.0)
    return s.select("row", slope.alias("slope"), F.sqrt(F.greatest(F.lit(0.0), F.col("vy") - slope * F.col("vxy")) / F.col("w")).alias("residual"))


def _quartiles(c: str) -> Column:
    return F.percentile_approx(c, [0.25, 0.5, 0.75], 1000)


def _spread(q: Column, least: float) -> Column:
    """The standard deviation that a middle half speaks of."""
    return F.greatest((q[2] - q[0]) / 1.349, F.lit(least))


def _band_of(rank: Column) -> Column:
    return F.floor(2 * F.log2(rank)).cast("int")


def _above_band(pages: DataFrame, band: float) -> DataFrame:
    """How many words of a page lie above the band, as (row, above): the occurrences of repeated words whose share of the page is over
    that of prose words of the same rank by more than ``band`` standard deviations of its logarithm.

    ``pages`` has (row, n, length, base_lang, prose, own_counts, own_times, own_named): links and tags are not in the curve, numbers have ranks in it but
    do not count.
    """
    steps = _steps(pages, "own_counts", "own_times", "own_named").join(pages.select("row", "n", "length", "base_lang", "prose"), "row")
    steps = steps.withColumn("share", F.log(F.col("c") / F.col("n")))
    covered = steps.where("prose").withColumn("rank", F.explode(F.sequence(_band_of(F.col("first")), _band_of(F.col("last")))))
    of = [F.count("*").alias("pages"), _quartiles("share").alias("q")]
    q = F.col("q")
    limit = (q[1] + band * _spread(q, 0.1)).alias("limit")
    near = covered.where("base_lang <> ''").groupBy("base_lang", "length", "rank").agg(*of).where(F.col("pages") >= BASE_PAGES).select("base_lang", "length", "rank", limit.alias("near"))
    wide = covered.groupBy("length", "rank").agg(*of).where(F.col("pages") >= BASE_PAGES).select("length", "rank", limit.alias("wide"))
    every = covered.groupBy("rank").agg(*of).where(F.col("pages") >= BASE_PAGES).select("rank", limit.alias("every"))
    mean = (F.col("first") + F.col("last")) / 2
    # Baselines are few: at most 1 / LANGUAGE_SHARE languages times 64 lengths times 64 bands of ranks.
    held = steps.where(F.col("c") >= REPEATED).withColumn("rank", _band_of(mean))
    held = held.join(F.broadcast(near), ["base_lang", "length", "rank"], "left").join(F.broadcast(wide), ["length", "rank"], "left").join(F.broadcast(every), "rank", "left")
    above = F.col("share") > F.coalesce("near", "wide", "every", F.log(F.lit(ZIPF) / mean))
    return held.groupBy("row").agg(F.sum(F.when(above, F.col("c") * F.col("named"))).alias("above"))


def page_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", far: float = FAR, low: float = LOW, band: float = BAND) -> DataFrame:
    """A row per non-blank text with its language, counts, curve and their distance from comparable pages.

    Columns: ``id_col``, lang, n (words), overlap, linked, repeated, above, keywords, sentences (words), slope, residual, slope_z,
    residual_z, overlap_ratio, stuffed (above the band by more than nearly all prose), odd. The language is the one whose commonest words fit best, whatever ``lang_col`` says; pages that fit none
    have "". Pages whose overlap is under ``low`` of their language's are held against prose of all languages. Texts without a word give no row; equal texts and ids each give theirs; an empty table none; other columns are
    ignored. Baselines of under ``BASE_PAGES`` prose pages give way to wider ones and at last to Zipf's law, so a table of any size is judged.
    """
    spark = docs.sparkSession
    disk = Scratch(spark, "pages")
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("text").isNotNull())
    common = [tuple(r) for r in common_words(known, "text", "lang").collect()]  # at most COMMON_WORDS / LANGUAGE_SHARE rows
    shared = spark.sparkContext.broadcast(common)
    kind = dict(docs.dtypes)[id_col]
    names = ["id", "lang", "n", "overlap", "linked", "repeated", "sentences", "said", "counts", "times", "own_counts", "own_times", "own_named"]
    counted = known.select("id", "text").mapInArrow(lambda it: _count_pages(it, shared.value, names), f"id {kind}, {PAGE}")
    numbered = disk.table(counted.withColumn("row", F.monotonically_increasing_id()))
    length = F.floor(F.log2("n") * 2)
    measured = disk.table(numbered.drop("counts", "times").join(_lines(numbered), "row").withColumn("length", length).withColumn("prose", F.col("sentences") * 2 >= F.col("n")))

    of = [F.count("*").alias("pages"), _quartiles("slope").alias("s"), _quartiles("residual").alias("r"), _quartiles("overlap").alias("o")]
    prose = measured.where("prose")
    near = prose.groupBy("lang", "length").agg(*of).where(F.col("pages") >= BASE_PAGES)
    wide = prose.groupBy("length").agg(*of).where(F.col("pages") >= BASE_PAGES)
    every = prose.agg(*of)
    # at most 1 / LANGUAGE_SHARE languages times 64 lengths
    based = measured.join(F.broadcast(near.select("lang", "length", F.struct("s", "r", "o").alias("near"))), ["lang", "length"], "left")
    based = based.join(F.broadcast(wide.select("length", F.struct("s", "r", "o").alias("wide"))), "length", "left")
    based = based.crossJoin(F.broadcast(every.select(F.struct("s", "r", "o").alias("every"))))
    b = based.withColumn("base", F.coalesce("near", "wide", "every"))
    ratio = F.col("overlap") / F.greatest(F.col("base.o")[1], F.lit(0.01))

    def z(value: str, q: str) -> Column:
        return (F.col(value) - F.col(f"base.{q}")[1]) / _spread(F.col(f"base.{q}"), 0.02)

    held = ["row", "id", "lang", "length", "n", "overlap", "linked", "repeated", "sentences", "said", "slope", "residual", "prose", "own_counts", "own_times", "own_named"]
    placed = disk.table(b.select(*held, z("slope", "s").alias("slope_z"), z("residual", "r").alias("residual_z"), ratio.alias("overlap_ratio")).withColumn("base_lang", F.when(F.col("overlap_ratio") >= low, F.col("lang")).otherwise("")))
    banded = disk.table(placed.drop("own_counts", "own_times", "own_named").join(_above_band(placed, band), "row", "left").withColumn("above", F.coalesce("above", F.lit(0))))

    most = [F.count("*").alias("pages"), F.percentile_approx(F.col("above") / F.col("n"), NEARLY_ALL, 1000).alias("most")]
    sound = banded.where("prose")
    near = sound.where("base_lang <> ''").groupBy("base_lang", "length").agg(*most).where(F.col("pages") >= BASE_PAGES).select("base_lang", "length", F.col("most").alias("near"))
    wide = sound.groupBy("length").agg(*most).where(F.col("pages") >= BASE_PAGES).select("length", F.col("most").alias("wide"))
    limits = banded.join(F.broadcast(near), ["base_lang", "length"], "left").join(F.broadcast(wide), "length", "left").crossJoin(F.broadcast(sound.agg(*most).select(F.col("most").alias("every"))))
    stuffed = (F.col("above") / F.col("n") > F.coalesce("near", "wide", "every", F.lit(0.0))).alias("stuffed")
    odd = F.col("stuffed") | F.coalesce((F.abs("slope_z") > far) | (F.abs("residual_z") > far) | (F.col("overlap_ratio") < low), F.lit(True))
    keywords = F.when(F.col("stuffed"), F.col("repeated")).otherwise(F.col("above")).cast("int")
    sentences = F.when(F.col("base_lang") == "", F.greatest("sentences", "said")).otherwise(F.col("sentences"))
    out = limits.select("*", stuffed).withColumns({"odd": odd, "keywords": keywords, "sentences": sentences})
    return out.select(F.col("id").alias(id_col), "lang", "n", "overlap", "linked", "repeated", "above", "keywords", "sentences", "slope", "residual", "slope_z", "residual_z", "overlap_ratio", "stuffed", "odd")


def stuffed_pages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", far: float = FAR, low: float = LOW, band: float = BAND) -> DataFrame:
    """The pages that are spam, with their measures: odd, mostly keywords, links and tags, few sentences (see above).

    ``far`` is the distance from comparable pages, in their standard deviations, from which a slope or residual is extreme, ``band`` that
    of a word's share from those of its rank; ``low`` the share of their overlap under which words diverge. A page without any
    comparable page is odd. Pages of fewer than ``LEAST_WORDS`` words are never reported.
    """
    m = page_measures(docs, id_col, text_col, lang_col, far, low, band)
    listed = F.col("linked") + F.col("keywords") > F.col("n") / 2
    return m.where(F.col("odd") & listed & (F.col("n") >= LEAST_WORDS) & (F.col("sentences") < F.col("n") / 4))
