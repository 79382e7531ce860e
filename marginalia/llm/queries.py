"""The registered queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.llm.bpe import encode_texts
from marginalia.llm.components import connected_groups
from marginalia.llm.leak import leaked_items, leaked_spans
from marginalia.llm.neardup import duplicate_classes, near_duplicates, row_pairs
from marginalia.llm.spam import page_measures, stuffed_pages
from marginalia.llm.split import MAX_CHARS, OVERLAP, split_texts


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(_read(spark, sf, "chunks")).where("piece_no = 0").select("chunk_id")


def p1_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return split_texts(_read(spark, sf, "chunks"))


def p1_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """Every split text put together again from its pieces without their overlaps, with what must hold for all of them."""
    p = split_texts(_read(spark, sf, "chunks"))
    in_text = Window.partitionBy("chunk_id").orderBy("piece_no")
    seen = p.withColumn("end", F.coalesce(F.lag("char_end").over(in_text), F.lit(0)))
    back = F.when(F.col("piece_no") > 0, F.least(F.lit(OVERLAP), F.col("end"))).otherwise(0)
    own = F.col("text").substr((back + 1).cast("int"), F.length("text"))
    sound = (F.length("text") <= MAX_CHARS) & (F.col("char_end") - F.col("char_start") == F.length("text")) & (F.col("char_start") == F.col("end") - back)
    parts = seen.select("chunk_id", "headers", "char_end", F.struct("piece_no", own.alias("t")).alias("part"), sound.alias("sound"))
    whole = parts.groupBy("chunk_id", "headers").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("char_end").alias("n_chars"), F.bool_and("sound").alias("sound"))
    return whole.select("chunk_id", "headers", F.md5(F.array_join(F.transform("parts", lambda x: x["t"]), "").cast("binary")).alias("text_md5"), "n_chars", "sound")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = near_duplicates(_read(spark, sf, "chunks"), "chunk_id", threshold=0.7, size=3, least_words=30)
    return row_pairs(found).select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_classes(_read(spark, sf, "chunks"), "chunk_id", threshold=0.7, size=3, least_words=30)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return connected_groups(_read(spark, sf, "graph_edges"))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(_read(spark, sf, "documents"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p7_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_spans(_read(spark, sf, "documents"), _read(spark, sf, "eval_items"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(_read(spark, sf, "documents")).select("doc_id")


def p8_measures(spark: SparkSession, sf: str) -> DataFrame:
    return page_measures(_read(spark, sf, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p2_found, p2_classes, p5_found, p6_ids, p7_found, p7_spans, p8_found, p8_measures)}


_WORDS = r"list_transform(regexp_extract_all({}, '[\p{{L}}\p{{N}}]+'), lambda w: lower(w))"


def _runs(table: str, key: str, n: int) -> str:
    """Rows (key, run): every run of ``n`` words of a text."""
    return f"""SELECT {key}, pos, array_to_string(ws[pos:pos + {n - 1}], ' ') AS run FROM (
      SELECT {key}, ws, unnest(range(1, len(ws) - {n - 2})) AS pos FROM (SELECT {key}, {_WORDS.format("text")} AS ws FROM {table} WHERE text IS NOT NULL))"""


_TRIMMED = "trim(text, ' ' || chr(9) || chr(10) || chr(13))"

ORACLE: dict[str, str] = {
    "p1_found": f"SELECT chunk_id FROM chunks WHERE length({_TRIMMED}) > 2000",
    "p1_rebuilt": f"SELECT chunk_id, headers, md5({_TRIMMED}) AS text_md5, length({_TRIMMED}) AS n_chars, true AS sound FROM chunks WHERE length({_TRIMMED}) > 2000",
    "p2_found": f"""
WITH long AS (SELECT chunk_id, text FROM chunks WHERE len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+')) >= 30),
runs AS (SELECT DISTINCT chunk_id, hash(run) AS run FROM ({_runs("long", "chunk_id", 3)})),
sizes AS (SELECT chunk_id, count(*) AS n FROM runs GROUP BY chunk_id),
shared AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.run = b.run AND a.chunk_id < b.chunk_id GROUP BY 1, 2)
SELECT a AS chunk_id_a, b AS chunk_id_b FROM shared JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE k >= 0.7 * (x.n + y.n - k)""",
    "p5_found": """
WITH RECURSIVE p AS (SELECT DISTINCT trim(source) AS a, trim(target) AS b FROM graph_edges WHERE trim(source) <> '' AND trim(target) <> ''),
e AS (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p),
reach AS (SELECT DISTINCT u AS root, u AS node FROM e UNION SELECT root, v FROM reach JOIN e ON node = u WHERE root <= v)
SELECT node AS note_path, min(root) AS group_path FROM reach GROUP BY node""",
    "p7_spans": f"""
WITH d AS ({_runs('documents', 'doc_id', 15)}), i AS (SELECT DISTINCT item_id, run FROM ({_runs('eval_items', 'item_id', 15)})),
hits AS (SELECT DISTINCT doc_id, item_id, pos - 1 AS p FROM d JOIN i USING (run)),
marked AS (SELECT *, CASE WHEN p <= lag(p) OVER w + 15 THEN 0 ELSE 1 END AS head FROM hits WINDOW w AS (PARTITION BY doc_id, item_id ORDER BY p)),
spans AS (SELECT *, sum(head) OVER (PARTITION BY doc_id, item_id ORDER BY p) AS span FROM marked)
SELECT doc_id, item_id, min(p) AS first_word, max(p) + 15 AS end_word FROM spans GROUP BY doc_id, item_id, span""",
    "p2_classes": f"""
WITH long AS (SELECT chunk_id, array_to_string(ws, ' ') AS text FROM (SELECT chunk_id, {_WORDS.format("text")} AS ws FROM chunks WHERE text IS NOT NULL) WHERE len(ws) >= 30),
classes AS (SELECT text, min(chunk_id) AS class_id FROM long GROUP BY text),
heads AS (SELECT class_id AS chunk_id, text FROM classes),
runs AS (SELECT DISTINCT chunk_id, hash(run) AS run FROM ({_runs("heads", "chunk_id", 3)})),
sizes AS (SELECT chunk_id, count(*) AS n FROM runs GROUP BY chunk_id),
shared AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM runs a JOIN runs b ON a.run = b.run AND a.chunk_id <> b.chunk_id GROUP BY 1, 2),
near AS (SELECT a, count(*) AS n_links FROM shared JOIN sizes x ON x.chunk_id = a JOIN sizes y ON y.chunk_id = b WHERE k >= 0.7 * (x.n + y.n - k) GROUP BY a)
SELECT chunk_id, class_id, coalesce(n_links, 0) AS n_links FROM long JOIN classes USING (text) LEFT JOIN near ON a = class_id""",
    "p7_found": f"WITH d AS ({_runs('documents', 'doc_id', 15)}), i AS ({_runs('eval_items', 'item_id', 15)}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)",
}
