import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.config import Settings
from marginalia.errors import InvalidRequest, NotFound
from marginalia.functions import links as ln
from marginalia.functions.coerce import FieldRule, coerce, validate
from marginalia.functions.passages import passages, sections
from marginalia.functions.links import matches_note
from marginalia.functions.strings import json_object_in, normalize_target, redact_paths, stem
from marginalia.operators.navigate import capped_passages, latency_summary
from marginalia.sources.notefiles import NoteFiles, uuid7
from marginalia.sources.notes import clean_mdx, ingest, note_fields, split_frontmatter
from marginalia.sources.store import Store, upsert
from marginalia.streaming.changes import allowed_attempts, apply_to_store, change_log, coalesced, follow, statuses


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("ab .\n"), max_size=400), st.integers(1, 40), st.integers(0, 12))
def test_passages_keep_to_the_limit(text, limit, overlap):
    out = passages(text, limit, min(overlap, limit - 1))
    assert all(len(p) <= limit for p in out)
    left = "".join(c for c in text if c not in " .\n")
    assert len("".join(c for p in out for c in p if c not in " .\n")) >= len(left)


def test_passages():
    assert passages("") == [""] and passages("short", 10, 2) == ["short"]
    assert passages("aaaa bbbb cccc", 9, 0) == ["aaaa bbbb", "cccc"]
    assert passages("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]


def test_sections():
    body = "intro\n# A\ntext\n### C\nmore\n## B\n\n# D\nend\n##### no heading"
    assert sections(body) == [([], "intro"), (["A"], "# A\ntext"), (["A", "C"], "### C\nmore"), (["A", "B"], "## B"), (["D"], "# D\nend\n##### no heading")]
    assert sections(" \n") == []


def test_frontmatter():
    assert split_frontmatter("﻿---\na: 1\n---\nbody\n") == ({"a": 1}, "body")
    assert split_frontmatter("---\njust text\n---\nbody") == ({}, "body") and split_frontmatter("---\n- x\n---\nb") == ({}, "b")
    assert split_frontmatter("text\n---\na: 1\n---\n") == ({}, "text\n---\na: 1\n---\n") and split_frontmatter("---\n: [\n---\nb") == ({}, "b")
    fields = note_fields({"created": "2024-01-02T03:04:05.678", "type": " Daily ", "categories": ["Work", "Home"], "summary": 5, "url": " u "})
    assert (fields["created_at"], fields["note_type"], fields["category"], fields["description"], fields["source"]) == ("2024-01-02T03:04:05", "daily", "work, home", "", "u")


@pytest.mark.parametrize(("raw", "want"), [("Note", "note"), ("My Note.md", "my-note"), ("  A B.PNG ", "a-b"), ("x.md.md", "x.md"), ("v1.2", "v1.2"), ("folder/Note.canvas", "folder/note")])
def test_targets(spark, raw, want):
    assert spark.range(1).select(normalize_target(F.lit(raw))).first()[0] == want


def test_stems(spark):
    df = spark.createDataFrame([("a/b.c.md",), ("x",), ("a.b/.env",), ("n.",)], "p string")
    assert [r[0] for r in df.select(stem(F.col("p"))).collect()] == ["b.c", "x", ".env", "n"]


@pytest.mark.parametrize(
    ("inner", "want"),
    [("Note", ("Note", None, None, None)), ("Note|alias", ("Note", "alias", None, None)), ("Note#H|a", ("Note", "a", "H", None)), ("Note^b1", ("Note", None, None, "b1")), ("#H", ("#H", None, "H", None)), ("N#H^b| ", ("N", None, "H", "b"))],
)
def test_wikilink_parts(spark, inner, want):
    assert tuple(spark.range(1).select(ln.wikilink_parts(F.lit(inner)).alias("p")).first().p) == want


def test_links_of_a_text(spark):
    text = "[[A|x]] [[a]] ![[p.png|100]] [t](d/m.md#s) [e](https://e.x) https://e.x https://f.x/y, ![i](pic.jpg) [h](#only)"
    rows = ln.extract_links(spark.createDataFrame([(1, text), (2, None), (3, "")], "i int, text string"), "i").collect()
    assert sorted((r.link_type, r.link_target, r.is_resolved) for r in rows) == [
        ("embed", "p.png", False), ("external", "https://e.x", True), ("external", "https://f.x/y,", True), ("markdown", "d/m.md", False), ("markdown", "pic.jpg", False), ("wikilink", "A", False),
    ]
    assert all(r.raw.split("]")[0] in text for r in rows)


@pytest.fixture
def tree(tmp_path):
    def put(path, text):
        f = tmp_path / "notes" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)

    put("Welcome.md", "---\ntitle: Hello\ntags: [a, b]\naliases: Start, Home page\n---\n# Top\n\n[[Other]] ![[pic.png]]\n\n## Sub\ntext")
    put("docs/m.md", "[[home page]] [[Missing]]")
    put("p/Other.MDX", "import x from 'y'\n# Hi\n<Box>gone</Box> kept <Chip /> ![[z.png]]")
    put("a.canvas", json.dumps({"nodes": [{"id": "1", "type": "text", "text": " note "}, {"type": "group", "label": "G"}, {"type": "file"}], "edges": [{"fromNode": "1", "toNode": "2", "label": "leads"}, {}]}))
    put("bad.canvas", "{nope")
    put("doc.pdf", "%PDF")
    put("empty.md", "---\n- x\n---\n")
    for hidden in (".obsidian/c.md", ".smart-env/d.md", ".e.md", "readme.rst"):
        put(hidden, "x")
    return tmp_path / "notes", put


def test_ingest_store_and_stream(spark, tree, tmp_path):
    root, put = tree
    c = ingest(spark, str(root))
    status = {r.path: r.status_of_file for r in c.parsed.collect()}
    assert status == {"Welcome.md": "success", "docs/m.md": "success", "p/Other.MDX": "success", "a.canvas": "success", "bad.canvas": "error", "doc.pdf": "unsupported", "empty.md": "empty"}
    chunks = {(r.note_path, r.chunk_no): (r.headers, r.text) for r in c.chunks.collect()}
    assert chunks["Welcome.md", 1] == ("Top > Sub", "## Sub\ntext") and chunks["a.canvas", 2] == ("Edge: 1 → 2", "leads")
    assert "kept" in chunks["p/Other.MDX", 0][1] and "gone" not in chunks["p/Other.MDX", 0][1]
    links = {(r.from_note_path, r.link_target): (r.to_note_path, r.is_resolved) for r in c.links.collect()}
    assert links == {("Welcome.md", "Other"): ("p/Other.MDX", True), ("Welcome.md", "pic.png"): ("", False), ("docs/m.md", "home page"): ("Welcome.md", True), ("docs/m.md", "Missing"): ("", False)}
    assert ingest(spark, str(root), pdf_pages=lambda raw: ["page text", ""]).chunks.where("note_path = 'doc.pdf'").first().headers == "Page 1"

    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        store.load()
    first = store.publish({"chunks": c.chunks, "links": c.links, "aliases": c.aliases, "catalog": c.catalog})
    with pytest.raises(Exception, match="(?i)boom|raise"):
        store.publish({"chunks": c.chunks, "links": c.links.withColumn("x", F.raise_error(F.lit("boom")))})
    assert store.current() == first

    put("docs/m.md", "[[Welcome]]")
    put("Missing.md", "found")
    (root / "a.canvas").unlink()
    log = tmp_path / "log"
    log.mkdir()
    at = "2024-01-01T00:00:0"
    changes = [("docs/m.md", False, 0), ("a.canvas", False, 0), ("a.canvas", True, 1), ("Missing.md", False, 1), (".git/x.md", False, 1), ("x.rst", False, 1)]
    (log / "1.json").write_text("\n".join(json.dumps({"path": p, "deleted": d, "ts": f"{at}{s}Z"}) for p, d, s in changes))
    follow(change_log(spark, str(log)), apply_to_store(spark, store, str(root)), str(tmp_path / "cp"), once=True).awaitTermination()
    now = store.load()
    assert {r.path for r in now["catalog"].collect()} == {"Welcome.md", "docs/m.md", "p/Other.MDX", "bad.canvas", "doc.pdf", "empty.md", "Missing.md"}
    assert now["links"].where("from_note_path = 'docs/m.md'").first().to_note_path == "Welcome.md" and now["chunks"].where("note_path = 'a.canvas'").count() == 0
    assert {r.path: r.status for r in statuses(spark, store).collect()} == {"docs/m.md": "success", "Missing.md": "success", "a.canvas": "deleted"}
    kept = store._manifest(store.current())["catalog"]["parts"].values()
    assert set(kept) == {first, store.current()}  # parts of unchanged notes stay where they are
    (root / "out.md").symlink_to("/etc/hostname")
    again = spark.createDataFrame([("out.md", False), ("docs", False), ("empty.md", False)], "path string, deleted boolean")
    for _ in range(4):
        apply_to_store(spark, store, str(root), Settings(breaker_window_s=3600))(again, 1)
    seen = {(r.path, r.status): r["count"] for r in statuses(spark, store).groupBy("path", "status").count().collect()}
    assert seen[("out.md", "failed: outside")] == 3 and seen[("out.md", "refused")] == 1 and seen[("empty.md", "empty")] == 4
    assert store.load()["catalog"].count() == now["catalog"].count()
    rows = store.load()["chunks"].count()
    store.compact()
    assert store.load()["chunks"].count() == rows
    with pytest.raises(RuntimeError):
        store.publish({"catalog": now["catalog"]}, expected=first)
    store.restore(first)
    assert store.load()["chunks"].where("note_path = 'a.canvas'").count() == 3


def test_ingest_writes_every_passage(spark, tmp_path):
    (tmp_path / "log.md").write_text("\n\n".join(f"entry {i} {'x' * 40}" for i in range(1300)))
    chunks = ingest(spark, str(tmp_path), Settings(chunk_chars=60, overlap_chars=0)).chunks
    assert chunks.count() == 1300 and chunks.where("startswith(text, 'entry 1299 ')").count() == 1


def test_capped_passages_keep_rows_without_a_note(spark):
    rows = [(i, "a.md", 9 - i) for i in range(5)] + [(10 + i, None, i) for i in range(5)]
    got = capped_passages(spark.createDataFrame(rows, "chunk_id long, note_path string, chunk_no int"), 2).collect()
    assert sorted(r.chunk_id for r in got) == [3, 4, 10, 11, 12, 13, 14]


def test_upsert(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1)], "path string, mtime_ns long, size long")
    b = spark.createDataFrame([("x", 2, 5), ("x", 3, 6), ("z", 1, 1)], "path string, mtime_ns long, size long")
    assert sorted(tuple(r) for r in upsert(a, b).collect()) == [("x", 3, 6), ("y", 1, 1), ("z", 1, 1)]


def test_note_files(tmp_path):
    log = tmp_path / "log"
    n = NoteFiles(str(tmp_path), log=str(log))
    assert n.create("a/b.md", "body", {"k": 1})["k"] == 1 and n.metadata("a/b.md")["k"] == 1
    with pytest.raises(InvalidRequest):
        n.create("a/b.md", "again")
    for bad in ("../x.md", "/x.md", ".git/x.md", "x.exe", ""):
        with pytest.raises(InvalidRequest):
            n.create(bad, "")
    with pytest.raises(NotFound):
        n.read("none.md")
    n.append("a/b.md", "more")
    n.append("a/b.md", "\n\n")
    n.append("a/b.md", "end")
    assert n.read("a/b.md").endswith("body\n\nmore\n\n\n\nend")
    assert n.update_frontmatter("a/b.md", {"z": "é"})["k"] == 1 and n.update_frontmatter("a/b.md", {"q": 1}, merge=False) == {"q": 1}
    n.move("a/b.md", "c.md")
    assert n.delete("c.md") == ".trash/c.md"
    n.create("c.md", "x")
    assert n.delete("c.md") == ".trash/c-1.md"
    logged = [(d["path"], d["deleted"]) for f in sorted(log.iterdir()) for d in map(json.loads, f.read_text().splitlines())]
    assert logged[0] == ("a/b.md", False) and logged[-4:] == [("c.md", False), ("c.md", True), ("c.md", False), ("c.md", True)] or logged[-3:] == [("c.md", True), ("c.md", False), ("c.md", True)]
    assert len({uuid7() for _ in range(100)}) == 100 and uuid7()[14] == "7"


CASES = [
    (FieldRule("int", maximum=5), [("3", "3", None), ("3.7", "3", None), ("9", None, "above_maximum"), ("nan", None, "not_a_number"), ("x", None, "not_a_number"), ("true", "1", None), (None, None, None)]),
    (FieldRule("float"), [("1.5", "1.5", None), ("inf", None, "not_a_number")]),
    (FieldRule("bool"), [("Sim", "true", None), ("não", "false", None), ("2", None, "not_a_bool")]),
    (FieldRule("date"), [("2024-02-29T10:00", "2024-02-29", None), ("2023-02-29", None, "not_a_date"), ("2024-1-1", None, "not_a_date")]),
    (FieldRule("datetime"), [("2024-01-02", "2024-01-02T00:00:00", None), ("2024-01-02 03:04:05", "2024-01-02T03:04:05", None), ("later", None, "not_a_datetime")]),
    (FieldRule("uuid"), [("01A220B4-79B4-7975-BE6D-A5370946F571", "01a220b4-79b4-7975-be6d-a5370946f571", None), ("x", None, "not_a_uuid")]),
    (FieldRule("url"), [("https://x.y/z", "https://x.y/z", None), ("ftp://x", None, "not_a_url"), ("http://", None, "not_a_url")]),
    (FieldRule("enum", values=("Draft", "Done")), [("dRAFT", "Draft", None), ("no", None, "not_allowed")]),
    (FieldRule("list", item_type="int", max_items=2), [("1, 2", '["1","2"]', None), ('["1"]', '["1"]', None), ("1,2,3", None, "too_many_items"), ("a", None, "bad_item")]),
    (FieldRule("string", min_length=2, max_length=4, pattern="a"), [("abc", "abc", None), ("a", None, "too_short"), ("abcde", None, "too_long"), ("bca", None, "pattern_mismatch")]),
]


def test_coercion(spark):
    for rule, cases in CASES:
        df = spark.createDataFrame([(c[0],) for c in cases], "raw string").select(coerce(F.col("raw"), rule).alias("c"))
        assert [(r.c.value, r.c.problem) for r in df.collect()] == [c[1:] for c in cases], rule.type
    for wrong in ({"type": "enum"}, {"type": "string", "on_missing": "auto"}, {"type": "string", "minimum": 1}, {"type": "int", "max_length": 3}, {"type": "other"}):
        with pytest.raises(ValueError):
            FieldRule(**wrong)


def test_validation(spark):
    rules = {"status": FieldRule("enum", values=("draft",), on_missing="require"), "when": FieldRule("datetime", on_missing="auto"), "kind": FieldRule("string", aliases=("type",), on_missing="suggest", default="note")}
    df = spark.createDataFrame([(1, {"status": "x", "extra": "e", "type": "b"}), (2, {"status": "Draft", "kind": "a", "type": "b"}), (3, None)], "i int, frontmatter map<string,string>")
    got = {r.i: r.validation for r in validate(df, rules, allow_extra=False).collect()}
    codes = lambda issues: sorted((x.field, x.code) for x in issues)
    assert codes(got[1].errors) == [("extra", "extra_field_not_allowed"), ("status", "validation_error")] and codes(got[1].warnings) == [("kind", "alias_resolved")]
    assert got[2].valid
    assert got[2].data["kind"] == "a" and ("kind", "alias_conflict") in codes(got[2].warnings)
    assert codes(got[3].errors) == [("status", "required_missing")] and got[3].data["kind"] == "note" and "when" in got[3].generated
    lax = {r.i: r.validation for r in validate(df, rules, mode="warn_only").collect()}
    assert all(v.valid and not v.errors for v in lax.values()) and lax[1].data["extra"] == "e"


def test_attempts_against_a_plain_loop(spark):
    rng = random.Random(3)
    rows = sorted((f"p{rng.randrange(4)}", rng.randrange(0, 20_000)) for _ in range(400))
    want, state = [], {}
    for p, t in rows:
        first, n = state.get(p, (None, 0))
        first, n = (t, 0) if first is None or t - first > 60 else (first, n)
        state[p] = (first, n + 1)
        want.append((p, t, n + 1 <= 3))
    df = spark.createDataFrame(rows, "path string, s long").select("path", F.timestamp_seconds("s").alias("ts"))
    got = [(r.path, r.s, r.allowed) for r in allowed_attempts(df).select("path", F.unix_seconds("ts").alias("s"), "allowed").collect()]
    assert sorted(got) == sorted(want)


def test_bursts_in_streams_and_tables(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    rows = [("a.md", False, 0), ("a.md", True, 1), ("a.md", False, 10), ("b.md", True, 3), ("z.md", False, 5000)]
    (log / "1.json").write_text("\n".join(json.dumps({"path": p, "deleted": d, "ts": f"2024-01-01T{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}Z"}) for p, d, s in rows))
    want = {("a.md", True, 2), ("a.md", False, 1), ("b.md", True, 1), ("z.md", False, 1)}
    table = spark.read.schema("path string, deleted boolean, ts timestamp").json(str(log))
    assert {(r.path, r.deleted, r.n) for r in coalesced(table).collect()} == want
    stream = coalesced(change_log(spark, str(log)), watermark="1 minute")
    q = stream.writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.path, r.deleted, r.n) for r in spark.table("bursts").collect()} == {w for w in want if w[0] != "z.md"}


def test_settings(tmp_path, monkeypatch):
    with pytest.raises(ValueError):
        Settings(chunk_chars=10, overlap_chars=10)
    (tmp_path / "s.yaml").write_text("chunk_chars: 500\nextensions: ['.md']\n")
    assert Settings.from_file(str(tmp_path / "s.yaml")).extensions == (".md",)
    assert Settings.from_environment("MARGINALIA_NONE") == Settings()
    monkeypatch.setenv("MARGINALIA_CONFIG", str(tmp_path / "s.yaml"))
    assert Settings.from_environment().chunk_chars == 500
    (tmp_path / "s.yaml").write_text("nonsense: 1\n")
    with pytest.raises(ValueError):
        Settings.from_file(str(tmp_path / "s.yaml"))


def test_redaction_and_json_in_text(spark):
    texts = ["see '/home/a b/c.md' now", "at /var/log/x.log: no", "C:\\a\\b.txt; ok", "~/n.md", "file:///x y", "and/or a.b/c", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(redact_paths(F.col("t"))).collect()]
    m = "[REDACTED_PATH]"
    assert got == [f"see '{m}' now", f"at {m}: no", f"{m}; ok", m, f"{m} y", "and/or a.b/c", None]
    found = ['{"a":1}', 'x ```json\n{"a":1}\n``` y {', 'so {"a":{"b":1}} end', "[1]", "{no}", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in found], "t string").select(json_object_in(F.col("t"))).collect()]
    assert got == ['{"a":1}', '{"a":1}', '{"a":{"b":1}}', None, None, None, None]


def test_mdx_is_cleaned_to_any_depth():
    nested = "gone"
    for k in range(30):
        nested = f"<A{k}>{nested}</A{k}>"
    assert clean_mdx(f"import x from 'y'\nexport const a = 1\nkept <B c='d'/>{nested} too <p>html</p>").split() == ["kept", "too", "<p>html</p>"]


def test_matches_note(spark):
    note, spaced = "folder/my-note.md", "folder/my note.md"
    cases = [("my-note", note, True), ("My-Note", note, True), ("my-note.md", note, True), ("folder/my-note", note, True), ("my note", note, True), ("my-note", spaced, True), ("other-note", note, False), ("note", note, False), ("note", "a/b/note.md", True), (None, note, None)]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, p string")
    assert [r.m for r in df.select(matches_note(F.col("t"), F.col("p")).alias("m")).collect()] == [c[2] for c in cases]


def test_latency_summary_of_groups_in_many_ranges(spark):
    rng = random.Random(6)
    rows = [("hot", rng.randrange(900) / 4) for _ in range(3000)] + [("one", 7.0), ("same", 2.0), ("same", 2.0), ("none", None), (None, 1.0), (None, 4.0), (None, None), ("two", -1.0), ("two", 5.5)]
    df = spark.createDataFrame(rows, "kind string, v double").withColumns({"c": F.lit("x"), "at": F.lit(1)}).repartition(5)
    want = df.groupBy("kind").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.median("v").alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95"))
    plain = lambda d: {r.kind: tuple(None if x is None else round(x, 9) for x in r[1:]) for r in d.collect()}
    assert plain(latency_summary(df, "kind", "v")) == plain(want) and len(plain(want)) == 6
    assert latency_summary(df.where("false"), "kind", "v").count() == 0
