import random
from datetime import datetime, timedelta

from marginalia.operators.orphans import ForeignKey, inherited_orphans, judged, orphan_references, orphan_report

LINK = "link_id long, from_note_path string, link_type string, to_note_path string, link_target_normalized string, recorded_at timestamp_ntz, is_resolved boolean, key string"
ALIAS = "alias_id long, note_path string, alias_normalized string, recorded_at timestamp_ntz, path string"
CHUNK = "chunk_id long, note_path string, indexed_at timestamp_ntz, reason string"
LIFE = "path string, first_seen_at timestamp_ntz, deleted_at timestamp_ntz, title string"
DAY = lambda d: datetime(2024, 1, 1) + timedelta(days=d)


def tables(spark, links=(), aliases=(), chunks=(), lives=()):
    make = spark.createDataFrame
    return make([(*r, None, "k") for r in links], LINK), make([(*r, "p") for r in aliases], ALIAS), make([(*r, "r") for r in chunks], CHUNK), make([(*r, "t") for r in lives], LIFE)


def direct(spark, **kw):
    return {(r.src_table, r.ref_field, r.row_id): (r.reason, r.period_month) for r in orphan_references(*tables(spark, **kw)).where("kind = 'direct'").collect()}


def test_reasons(spark):
    lives = [("a.md", DAY(10), DAY(20)), ("a.md", DAY(30), None), ("a.md", DAY(30), None), ("x/My Note.md", DAY(0), None), ("y/My Note.md", DAY(0), DAY(1)), (None, DAY(0), None), (" ", DAY(0), None)]
    chunks = [(1, "a.md", DAY(5)), (2, "a.md", DAY(10)), (3, "a.md", DAY(20)), (4, "a.md", DAY(40)), (5, "b.md", DAY(5)), (6, None, DAY(5)), (7, " ", DAY(5)), (8, "a.md", None), (9, "A.md", DAY(40)), (9, "A.md", DAY(40))]
    links = [
        (1, "a.md", "wikilink", "", "my-note", DAY(40)),
        (2, "a.md", "wikilink", None, "nothing", DAY(40)),
        (3, "a.md", "external", "", "nothing", DAY(40)),
        (4, "a.md", "embed", "gone.md", "my-note", DAY(40)),
        (5, "a.md", None, "", "", DAY(40)),
        (6, "a.md", "markdown", "", "nick", DAY(40)),
        (7, "a.md", "markdown", "", "y/my-note", DAY(40)),
        (8, "a.md", "markdown", "", "lost", DAY(40)),
    ]
    aliases = [(1, "a.md", "nick", DAY(25)), (2, "never.md", "lost", DAY(25)), (3, None, "nick", DAY(25))]
    got = direct(spark, links=links, aliases=aliases, chunks=chunks, lives=lives)
    assert got == {
        ("chunks", "note_path", 1): ("late", "2024-01"),
        ("chunks", "note_path", 3): ("late", "2024-01"),
        ("chunks", "note_path", 5): ("missing", "2024-01"),
        ("chunks", "note_path", 8): ("deleted", None),
        ("chunks", "note_path", 9): ("missing", "2024-02"),
        ("links", "target", 2): ("missing", "2024-02"),
        ("links", "target", 4): ("missing", "2024-02"),
        ("links", "target", 7): ("deleted", "2024-02"),
        ("links", "target", 8): ("missing", "2024-02"),
        ("aliases", "note_path", 1): ("late", "2024-01"),
        ("aliases", "note_path", 2): ("missing", "2024-01"),
    }


def random_case(seed):
    rng = random.Random(seed)
    lives = [(f"n{rng.randrange(6)}", DAY(a := rng.randrange(0, 40)), DAY(a + rng.randrange(1, 9)) if rng.random() < 0.8 else None) for _ in range(25)]
    refs = [(i, f"n{rng.randrange(8)}", DAY(rng.randrange(0, 50)) if i % 20 else None) for i in range(300)]
    return lives, refs


def brute(lives, refs):
    out = {}
    for i, p, t in refs:
        own = [(a, b) for q, a, b in lives if q == p]
        if t is None or not any(a <= t and (b is None or b > t) for a, b in own):
            out[i] = "missing" if not own else "late" if t and any(a > t for a, _ in own) else "deleted"
    return out


def test_random_lives_with_and_without_hot_keys(spark, monkeypatch):
    from marginalia.operators import skew

    for hot in (10**9, 20):
        monkeypatch.setattr(skew, "HOT_ROWS", hot)
        monkeypatch.setattr(skew, "MOST_HOT", 10**6)
        lives, refs = random_case(hot)
        a = spark.createDataFrame([(p, t, (i,)) for i, p, t in refs], "key string, ts timestamp_ntz, ref struct<row_id:long>")
        b = spark.createDataFrame(lives, "key string, start timestamp_ntz, till timestamp_ntz")
        rows = judged(a, b).collect()
        assert len(rows) == len(refs)
        assert {r.ref.row_id: r.reason for r in rows if r.reason} == brute(lives, refs)


def test_cascade_reaches_a_fixpoint(spark):
    ids = "row_id long, key string, parent string"
    t = {
        "a": spark.createDataFrame([(1, "a1", None), (2, "a2", None), (3, "a2", None)], ids),
        "b": spark.createDataFrame([(1, "b1", "a1"), (2, "b2", "a2"), (3, "b3", None)], ids),
        "c": spark.createDataFrame([(1, "c1", "b1"), (2, "c2", "c1"), (3, "c3", "c4"), (4, "c4", "c2"), (5, "c5", "b2")], ids),
    }
    keys = [ForeignKey("b", "parent", "a", "key"), ForeignKey("c", "parent", "b", "key"), ForeignKey("c", "parent", "c", "key")]
    first = spark.createDataFrame([("a", 1), ("a", 2)], "src_table string, row_id long")
    got = {(r.src_table, r.row_id): r.depth for r in inherited_orphans(t, first, keys).collect()}
    assert got == {("a", 1): 0, ("a", 2): 0, ("b", 1): 1, ("c", 1): 2, ("c", 2): 3, ("c", 4): 4, ("c", 3): 5}


def test_cascade_has_no_depth_limit(spark):
    rows = [(i, f"k{i}", f"k{i - 1}") for i in range(1, 111)]
    t = {"a": spark.createDataFrame(rows, "row_id long, key string, parent string").coalesce(1)}
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    found = inherited_orphans(t, spark.createDataFrame([("a", 1)], "src_table string, row_id long"), [ForeignKey("a", "parent", "a", "key")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.row_id: r.depth for r in found.collect()} == {i: i - 1 for i in range(1, 111)}


def test_inherited_and_report(spark):
    lives = [("a.md", DAY(0), None), ("b.md", DAY(0), DAY(3))]
    links = [(1, "gone.md", "wikilink", "a.md", "a", DAY(5)), (2, "a.md", "wikilink", "", "nick", DAY(2)), (3, "a.md", "wikilink", "a.md", "a", DAY(5))]
    aliases = [(1, "b.md", "nick", DAY(5))]
    out = orphan_references(*tables(spark, links=links, aliases=aliases, lives=lives))
    assert {(r.row_id, r.ref_field) for r in out.where("kind = 'inherited'").collect()} == {(1, "target"), (2, "target")}
    assert {(r.src_table, r.kind): r.n_references for r in orphan_report(out).collect()} == {("links", "direct"): 1, ("aliases", "direct"): 1, ("links", "inherited"): 2}


def test_names_that_a_note_has_are_not_inherited(spark):
    lives = [("x/Nick.md", DAY(0), None), ("b.md", DAY(0), DAY(3))]
    links = [(1, "x/Nick.md", "wikilink", "", "nick", DAY(2)), (2, "x/Nick.md", "wikilink", "", "x/nick", DAY(2)), (3, "x/Nick.md", "wikilink", "", "other", DAY(2))]
    aliases = [(1, "b.md", "nick", DAY(5)), (2, "b.md", "x/nick", DAY(5)), (3, "b.md", "other", DAY(5))]
    out = orphan_references(*tables(spark, links=links, aliases=aliases, lives=lives))
    assert {(r.row_id, r.ref_field) for r in out.where("kind = 'inherited'").collect()} == {(3, "target")}


def test_empty(spark):
    assert orphan_references(*tables(spark)).count() == 0
    assert direct(spark, chunks=[(1, "a", DAY(0))]) == {("chunks", "note_path", 1): ("missing", "2024-01")}
