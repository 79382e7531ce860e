"""The package's queries on the smallest data, against SQL where there is any."""

import collections
import glob
import os

import duckdb
import pytest

from marginalia.llm.queries import ORACLE, QUERIES


def rows_of(df):
    return collections.Counter(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, name):
    df = QUERIES[name](spark, sf)
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = con.execute(ORACLE[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    assert rows_of(df) == collections.Counter(tuple(r[k] for k in order) for r in want.fetchall())


def test_pieces_are_in_the_limit_and_carry_their_headers(spark, sf):
    chunks = {r.chunk_id: r for r in spark.read.parquet(f"{sf}/chunks.parquet").select("chunk_id", "headers", "text").collect()}
    rows = QUERIES["p1_pieces"](spark, sf).collect()
    assert {r.chunk_id for r in rows} == {i for i, r in chunks.items() if len((r.text or "").strip(" \t\r\n")) > 2000}
    for r in rows:
        own = chunks[r.chunk_id]
        assert r.text == own.text.strip(" \t\r\n")[r.char_start : r.char_end] and 0 < len(r.text) <= 2000 and r.headers == own.headers


def test_ids_are_the_public_tokenizers(spark, sf):
    import tiktoken

    from marginalia.llm.bpe import VOCABULARY, WORDS, read_ranks

    with open(VOCABULARY, "rb") as f:
        public = tiktoken.Encoding("public", pat_str=WORDS, mergeable_ranks=read_ranks(f.read()), special_tokens={})
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r.ids for r in QUERIES["p6_ids"](spark, sf).collect()}
    assert got == {i: public.encode_ordinary(t) if t else [] for i, t in texts.items()}


def test_found_pages_are_those_measured_so(spark, sf):
    measures = {r.doc_id: r for r in QUERIES["p8_measures"](spark, sf).collect()}
    found = {r.doc_id for r in QUERIES["p8_found"](spark, sf).collect()}
    assert found and found < set(measures)
    assert found == {i for i, m in measures.items() if m.odd and m.n >= 25 and 2 * (m.linked + m.keywords) > m.n and 4 * m.sentences < m.n}


def test_every_query_is_tested():
    assert set(QUERIES) - set(ORACLE) == {"p1_pieces", "p6_ids", "p8_found", "p8_measures"}
