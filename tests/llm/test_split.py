import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm.split import best_cut, halo, pieces_of_range, split_files, split_texts

TEXT = "chunk_id long, headers string, text string"


def check(pieces, text, limit, overlap):
    """Pieces in order give the text back, are in the limit and repeat what stands before them."""
    end, before = 0, None
    for start, stop, piece in pieces:
        assert piece == text[start:stop] and 0 < len(piece) <= limit
        if before is not None:
            assert start == end - min(overlap, end) and stop > end
        end, before = stop, piece
    assert end == len(text)


def in_ranges(text, limit, overlap, size):
    raw, out, base = text.encode(), [], 0
    n = len(raw)
    for k in range(-(-n // size)):
        lo, length = halo(k, n, limit, overlap, size)
        own, chars = pieces_of_range(raw[lo : lo + length], k * size - lo, min(size, n - k * size), k == 0, (k + 1) * size >= n, limit, overlap)
        out += [(base + a, base + b, t) for a, b, t in own]
        base += chars
    assert base == len(text)
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab .\n\r\té語🎉́"), min_size=1, max_size=900), st.integers(5, 60), st.integers(0, 4), st.integers(40, 400))
def test_ranges_fit_together(text, limit, overlap, size):
    check(in_ranges(text, limit, overlap, size), text, limit, overlap)


def test_best_cut_prefers_paragraph_then_line_then_sentence_then_word():
    assert best_cut("one.\n\ntwo. three four", 0, 15) == 6
    assert best_cut("one\ntwo. three four", 0, 14) == 4
    assert best_cut("one. two three", 0, 10) == 5
    assert best_cut("one two", 0, 5) == 4
    assert best_cut("abcdefgh", 0, 5) == 5
    assert best_cut("abcdéfgh", 0, 5) == 4


def test_no_hard_cut_where_the_window_has_a_boundary():
    text = "word " * 180 + "x" * 1500
    got = in_ranges(text, 2000, 200, 1 << 16)
    check(got, text, 2000, 200)
    assert [b for _, b, _ in got] == [900, 2400]
    assert best_cut("a b" + "c" * 20, 11, 22) == 2 and best_cut("a. b c" + "d" * 20, 12, 22) == 3


def test_blocks_of_ranges_and_repeated_ids(spark, monkeypatch):
    from marginalia.llm import split

    monkeypatch.setattr(split, "RANGES_PER_BLOCK", 3)
    text = "A sentence here. " * 3000 + "x"
    df = spark.createDataFrame([(1, "h", text), (1, "h", text + "y"), (None, None, text)], TEXT)
    got = split_texts(df, range_bytes=2048).collect()
    alone = sorted((r.char_start, r.char_end, r.text) for r in got if r.chunk_id is None)
    check(alone, text, 2000, 200)
    numbers = sorted(r.piece_no for r in got if r.chunk_id == 1)
    assert numbers == sorted(2 * list(range(len(alone))))


def test_split_texts(spark):
    rng = random.Random(3)
    long = "  " + "".join(rng.choice(["word ", "Satz. ", "\n", "\n\n", "語語", "é"]) for _ in range(60_000)) + "x\r\n"
    rows = [(1, "A > B", long), (2, None, "x" * 5000), (3, "", "short"), (4, "h", None), (5, "h", ""), (6, "h", " \n\t "), (7, "h", " " * 3000 + "a"), (8, "h", "é" * 2000), (9, "h", "x" * 5000), (9, "h", "x" * 5000)]
    df = spark.createDataFrame(rows, TEXT)
    got = split_texts(df, range_bytes=4096).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append(r)
    assert set(by) == {1, 2, 9}
    own = sorted(by[1], key=lambda r: r.piece_no)
    assert [r.piece_no for r in own] == list(range(len(own))) and {r.headers for r in own} == {"A > B"}
    check([(r.char_start, r.char_end, r.text) for r in own], long.strip(" \t\r\n"), 2000, 200)
    whole = sorted((r for r in split_texts(df).collect() if r.chunk_id == 9), key=lambda r: r.piece_no)
    assert len(whole) == 6 and {r.piece_no for r in whole} == {0, 1, 2}


def test_empty_table_and_clashing_columns(spark):
    assert split_texts(spark.createDataFrame([], TEXT)).count() == 0
    df = spark.createDataFrame([(1, "h", "a " * 3000, 5, "p")], TEXT + ", range_no int, piece_no string")
    assert split_texts(df).columns == ["chunk_id", "headers", "piece_no", "char_start", "char_end", "text"]


def test_bad_overlap(spark):
    with pytest.raises(ValueError):
        split_texts(spark.createDataFrame([], TEXT), max_chars=10, overlap=10)


def test_files(spark, tmp_path):
    text = "A sentence here. " * 9000 + "\n\nlast é"
    (tmp_path / "big.txt").write_text(text)
    (tmp_path / "small.txt").write_text("tiny")
    (tmp_path / "none.txt").write_text("")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe ok " * 2000)
    rows = split_files(spark, str(tmp_path), range_bytes=8192).collect()
    big = sorted((r for r in rows if r.path.endswith("big.txt")), key=lambda r: r.piece_no)
    check([(r.char_start, r.char_end, r.text) for r in big], text, 2000, 200)
    assert {r.path.rsplit("/", 1)[1] for r in rows} == {"big.txt", "small.txt", "bad.txt"}
