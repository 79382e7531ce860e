"""Full-text search: an inverted index as a table, ranked by BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.skew import join_any

K1, B = 1.2, 0.75
MOST_PUSHED = 200
# Accented letters and what they fold to.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def terms(text: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """The folded terms of a text in order, without stems; ``stop_words`` (folded) fall away, by default none does."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(*stop_words) if stop_words else t != "")


def stop_words(language: str | None) -> tuple[str, ...]:
    """The stop-words of a language as Spark has them ("english", "portuguese", ...), folded; none without a language."""
    if not language:
        return ()
    from pyspark.ml.feature import StopWordsRemover

    table = str.maketrans(ACCENTED, PLAIN)
    return tuple(sorted({w.lower().translate(table) for w in StopWordsRemover.loadDefaultStopWords(language)}))


def _spread(docs: DataFrame, id_col: str, text_col: str, without: tuple[str, ...], keep: tuple[str, ...] = ()) -> DataFrame:
    """(term, id, length) of every occurrence of a term, with the columns ``keep``."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *keep, terms(F.col(text_col), without).alias("ts"))
    return own.select("id", *keep, F.size("ts").alias("length"), F.explode("ts").alias("term"))


def _counted(spread: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return spread.groupBy("term", "id", *keep).agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def postings(docs: DataFrame, id_col: str, text_col: str = "text", without: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """The inverted index (term, id, tf, length): a row per term and document. Words of ``without`` are no terms; ``keep`` are
    columns of a document that its rows carry."""
    return _counted(_spread(docs, id_col, text_col, without, keep), keep)


def lengths(text: Column, without: tuple[str, ...] = ()) -> Column:
    """The number of terms of a text, null for a null one."""
    return F.when(text.isNotNull(), F.size(terms(text, without)))


def term_frequencies(index: DataFrame) -> DataFrame:
    """(term, df, cf): documents with the term and its occurrences."""
    return index.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str = "text", top_k: int = 10, k1: float = K1, b: float = B, without: tuple[str, ...] = ()) -> DataFrame:
    """The best ``top_k`` documents of every query as (query_id, id, score, rank); ties by id.

    ``queries`` has (query_id, query). Query terms count once; words of ``without`` are terms of neither side. Each term's weight is taken from the whole corpus. Only the
    documents' occurrences of query terms leave the scan: the terms of all queries are joined before anything is counted.
    """
    wanted = _wanted(queries, without)
    sizes = docs.where(F.col(text_col).isNotNull()).select(F.size(terms(F.col(text_col), without)).alias("length"))
    asked = _spread(docs, id_col, text_col, without).join(wanted.select("term").distinct(), "term", "left_semi")
    return _ranked(_counted(asked), sizes, wanted, top_k, k1, b)


def bm25_indexed(index: DataFrame, sizes: DataFrame, queries: DataFrame, top_k: int = 10, k1: float = K1, b: float = B, without: tuple[str, ...] = ()) -> DataFrame:
    """``bm25`` over stored ``postings`` and ``lengths`` (a column ``length``), made with the same ``without``: no text is read.

    The terms of few queries, ``MOST_PUSHED`` at most, are pushed into the scan, so that of an index sorted by term only the row groups
    which have them are read; those of more queries are joined.
    """
    wanted = _wanted(queries, without)
    asked = [r[0] for r in wanted.select("term").distinct().limit(MOST_PUSHED + 1).collect()]
    own = index.where(F.col("term").isin(asked)) if len(asked) <= MOST_PUSHED else index.join(wanted.select("term").distinct(), "term", "left_semi")
    return _ranked(own.select("term", "id", "tf", "length"), sizes, wanted, top_k, k1, b)


def _wanted(queries: DataFrame, without: tuple[str, ...]) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("query"), without))).alias("term"))


def _ranked(hits: DataFrame, sizes: DataFrame, wanted: DataFrame, top_k: int, k1: float, b: float) -> DataFrame:
    """The ranking from the postings (term, id, tf, length) of the wanted terms. Those of a frequent term are joined in parts."""
    stats = sizes.where("length > 0").agg(F.count("*").alias("N"), F.avg("length").alias("avgdl"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("N") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.join(F.broadcast(stats)).select("term", "df", idf.alias("idf"), "avgdl").join(wanted, "term")
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avgdl")))
    scored = join_any(hits, weighted.drop("df"), "term", df.withColumnRenamed("df", "n"))
    totals = scored.groupBy("query_id", "id").agg(F.sum(F.col("idf") * tf).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return totals.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
