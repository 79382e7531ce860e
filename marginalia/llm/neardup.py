"""Near-duplicate records by HyperMinHash.

Every text is a set of runs of ``SHINGLE`` consecutive words. A sketch splits the runs' hashes into buckets and keeps, of the
least hash in each, the count of its leading zeros and the mantissa bits after its first one, in 16 bits. Empty buckets of
short texts take another bucket's register, chosen by hash. Three registers and their place, packed in one number, are a band: texts
that agree in a band are candidates. A candidate's similarity is estimated from its equal registers, corrected for registers that agree by
chance, and what may reach the threshold is verified on the sets themselves.

Texts with the same words are one class, compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.lineage import Scratch
from marginalia.llm.words import words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 3
BUCKETS = BANDS * ROWS
MANTISSA = 10
CACHED_WORDS = 300_000
CLASS_BLOCK = 2000

_WORD_HASHES: dict[str, int] = {}
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit."""
    h = h + np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[1])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[2])
    return h ^ (h >> np.uint64(31))


def _word_hashes(own: list[str]) -> np.ndarray:
    known = _WORD_HASHES
    if len(known) > CACHED_WORDS:
        known.clear()
    out = []
    for w in own:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, np.uint64)


def shingles(own: list[str], size: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of ``size`` words, in order; of a shorter text the hash of all its words."""
    if not own:
        return np.empty(0, np.uint64)
    h = _word_hashes(own)
    size = min(size, len(own))
    runs = np.zeros(len(h) - size + 1, np.uint64)
    for j in range(size):
        runs = _mix(runs ^ h[j : len(h) - size + 1 + j])
    return np.unique(runs)


def _detours(buckets: int, tries: int = 64) -> np.ndarray:
    """Where an empty bucket looks for a register, try by try."""
    k = np.arange(tries * buckets, dtype=np.uint64).reshape(tries, buckets)
    return (_mix(k + np.uint64(77)) % np.uint64(buckets)).astype(np.int64)


def sketch(sets: list[np.ndarray], buckets: int = BUCKETS) -> np.ndarray:
    """HyperMinHash registers of non-empty sets, one row each."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    bucket = (_mix(flat ^ np.uint64(_MIX[1])) % np.uint64(buckets)).astype(np.int64)
    value = _mix(flat ^ np.uint64(_MIX[2]))
    least = np.full(n * buckets, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, owner * buckets + bucket, value)
    least = least.reshape(n, buckets)
    filled = np.zeros(n * buckets, bool)
    filled[owner * buckets + bucket] = True
    filled = filled.reshape(n, buckets)

    zeros = (64 - np.frexp(np.maximum(least, np.uint64(1)).astype(np.float64))[1]).clip(0, 63).astype(np.uint64)
    after = np.where(zeros < 63, least << np.minimum(zeros + np.uint64(1), np.uint64(63)), np.uint64(0))
    register = ((zeros << np.uint64(MANTISSA)) | (after >> np.uint64(64 - MANTISSA))).astype(np.int64)

    out, open_ = register.copy(), ~filled
    for detour in _detours(buckets):
        if not open_.any():
            break
        r, c = np.nonzero(open_)
        hit = filled[r, detour[c]]
        r, c = r[hit], c[hit]
        out[r, c] = register[r, detour[c]]
        open_[r, c] = False
    if open_.any():  # ever so rare: the first filled bucket
        r, c = np.nonzero(open_)
        out[r, c] = register[r, filled[r].argmax(1)]
    return out.astype(np.uint16)


def _sketches(batches: Iterator[pa.RecordBatch], size: int, least_words: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            kept, sets, same = [], [], []
            for i, text in enumerate(part.column(1).to_pylist()):
                own = words(text)
                if len(own) >= max(1, least_words):
                    kept.append(i)
                    sets.append(shingles(own, size))
                    same.append(xxhash.xxh3_128_digest(" ".join(own)))
            if not kept:
                continue
            bands = sketch(sets).reshape(len(sets), BANDS, ROWS).astype(np.int64) @ (1 << 16 * np.arange(ROWS, dtype=np.int64)) + (np.arange(BANDS, dtype=np.int64) << 16 * ROWS)
            ends = np.arange(0, bands.size + 1, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(kept)), pa.array(same, pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))],
                names=names,
            )


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            sets = [shingles(words(t), size).view(np.int64) for t in part.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], names=["rep", "runs"])


def agreeing_registers(a: Column, b: Column) -> Column:
    """How many of two sketches' registers are equal: the bands' lanes of 16 bits in which they do not differ."""
    lanes = [F.lit(0xFFFF << 16 * k) for k in range(ROWS)]
    total = F.lit(0)
    for k in range(BANDS):
        for lane in lanes:
            total = total + (a[k].bitwiseXOR(b[k]).bitwiseAND(lane) == 0).cast("int")
    return total


def estimated_similarity(agree: Column, na: Column, nb: Column) -> Column:
    """Jaccard similarity from ``agree`` equal registers, less those that two unrelated sets of these sizes share by chance."""
    ratio = na / nb
    chance = F.lit(0.169919487159739 / 2**MANTISSA) * 4 * ratio / ((1 + ratio) * (1 + ratio))
    return (agree / F.lit(float(BUCKETS)) - chance) / (1 - chance)


def _meetings(banded: DataFrame, threshold: float, disk: Scratch) -> DataFrame:
    """Pairs (a, b, na, nb), a < b, that share a band (rep, n, key) and whose sizes allow the threshold.

    Keys of one text, by far the most, fall away before anything else is done. Keys of many are cut into blocks of about ``CLASS_BLOCK`` texts, and each task joins
    one block to another, so no key needs to fit into a task.
    """
    shared = banded.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    live = disk.table(banded.join(shared, "key")).withColumn("blocks", F.ceil(F.col("met") / CLASS_BLOCK).cast("int"))
    placed = live.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    a = placed.select("key", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"), F.col("rep").alias("x"), F.col("n").alias("nx"))
    b = placed.select("key", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"), F.col("rep").alias("y"), F.col("n").alias("ny"))
    close = (F.col("nx") >= F.col("ny") * threshold) & (F.col("ny") >= F.col("nx") * threshold)
    met = a.join(b, ["key", "i", "j"]).where(close & ((F.col("i") < F.col("j")) | (F.col("x") < F.col("y"))))
    first = F.col("x") < F.col("y")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("nx")).otherwise(F.col("ny")).alias("na"), F.when(first, F.col("ny")).otherwise(F.col("nx")).alias("nb"))


class NearDuplicates:
    """Classes of rows with the same words, and the pairs of classes that are near-duplicates; see ``near_duplicates``."""

    def __init__(self, members: DataFrame, pairs: DataFrame):
        self.members, self.pairs = members, pairs


def near_duplicates(df: DataFrame, id_col: str, text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, least_words: int = 1, slack: float = 0.3) -> NearDuplicates:
    """``members`` (``id_col``, class_id) of all texts and ``pairs`` (class_a, class_b, similarity) of classes.

    Rows whose texts have the same words in the same order share a class, named by its least id. Two classes are a pair if
    their distinct runs of ``size`` words found in both are at least ``threshold`` of those found in either. Null, empty and
    blank texts and those of fewer than ``least_words`` words are in no class; a text shorter than ``size`` is one run.
    Sizes rule out what cannot reach the threshold; the sketch's estimate rules out what lies ``slack`` below it, five
    standard deviations; the rest is counted exactly on 64-bit hashes of the runs. Buckets and partners have no cap. ``id_col``
    must be unique and not null. Other columns are ignored; an empty table gives none.
    """
    spark = df.sparkSession
    disk = Scratch(spark, "neardup")
    kind = dict(df.dtypes)[id_col]
    names = ["id", "same", "n", "bands"]
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    sketched = disk.table(texts.mapInArrow(lambda it: _sketches(it, size, least_words, names), f"id {kind}, same binary, n int, bands array<long>"))

    classes = sketched.groupBy("same").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = disk.table(classes)
    several = classes.where("copies > 1")
    in_class = sketched.select("id", "same").join(several, "same").select("id", F.col("rep").alias("class_id"), "copies")
    reps = sketched.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")

    banded = reps.select(F.col("id").alias("rep"), "n", F.explode("bands").alias("key"))
    candidates = _meetings(banded, threshold, disk).select("a", "b", "na", "nb").repartition("a").distinct()  # one shuffle for this and the next join

    regs = reps.select(F.col("id").alias("rep"), "bands")
    with_a = candidates.join(regs.withColumnsRenamed({"rep": "a", "bands": "ra"}), "a")
    with_b = with_a.join(regs.withColumnsRenamed({"rep": "b", "bands": "rb"}), "b")
    estimate = estimated_similarity(agreeing_registers(F.col("ra"), F.col("rb")), F.col("na"), F.col("nb"))
    likely = disk.table(with_b.where(estimate >= threshold - slack).select("a", "b", "na", "nb"))

    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    runs = disk.table(texts.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(lambda it: _sets(it, size), f"rep {kind}, runs array<long>"))
    both = likely.join(runs.withColumnsRenamed({"rep": "a", "runs": "sa"}), "a").join(runs.withColumnsRenamed({"rep": "b", "runs": "sb"}), "b")
    shared = both.withColumn("shared", F.size(F.array_intersect("sa", "sb"))).drop("sa", "sb")
    exact = shared.withColumn("similarity", F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared")))
    pairs = disk.table(exact.where(F.col("shared") >= F.lit(threshold) * (F.col("na") + F.col("nb") - F.col("shared")) - F.lit(1e-9)).select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "similarity"))

    lone = sketched.join(several, "same", "left_anti").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("copies"))
    members = in_class.unionByName(lone)
    return NearDuplicates(members, pairs)


def row_pairs(found: NearDuplicates) -> DataFrame:
    """All pairs of rows (a < b) that ``found`` implies: within classes and between paired classes.

    Large classes are cut into blocks of about ``CLASS_BLOCK`` rows; a task joins one block to another.
    """
    spread = found.members.withColumn("blocks", F.ceil(F.col("copies") / CLASS_BLOCK).cast("int"))
    placed = spread.select("id", "class_id", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    between = found.pairs.select("class_a", "class_b")
    counts = spread.select("class_id", "blocks").where("blocks > 1").distinct()

    def blocks_of(pairs: DataFrame, c: str) -> DataFrame:
        known = pairs.join(counts.withColumnsRenamed({"class_id": c, "blocks": f"_n_{c}"}), c, "left")
        return known.withColumn(f"block_{c[-1]}", F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"_n_{c}"), F.lit(1)) - 1))).drop(f"_n_{c}")

    within = spread.where("copies > 1").select("class_id").distinct().select(F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"))
    jobs = blocks_of(blocks_of(between.unionByName(within), "class_a"), "class_b").where("class_a <> class_b OR block_a <= block_b")
    of_a = placed.select(F.col("class_id").alias("class_a"), F.col("block").alias("block_a"), F.col("id").alias("x"))
    of_b = placed.select(F.col("class_id").alias("class_b"), F.col("block").alias("block_b"), F.col("id").alias("y"))
    met = jobs.join(of_a, ["class_a", "block_a"]).join(of_b, ["class_b", "block_b"])
    same_block = (F.col("class_a") == F.col("class_b")) & (F.col("block_a") == F.col("block_b"))
    kept = met.where(~same_block | (F.col("x") < F.col("y")))
    return kept.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def duplicate_classes(df: DataFrame, id_col: str, **options) -> DataFrame:
    """One row per text as (``id_col``, class_id, n_links): its class and the number of other classes that are near it."""
    found = near_duplicates(df, id_col, **options)
    ends = found.pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id"))
    links = ends.groupBy("class_id").agg(F.count("*").alias("n_links"))
    joined = found.members.join(links, "class_id", "left")
    return joined.select(F.col("id").alias(id_col), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
