from datetime import datetime, timezone

import pytest

from marginalia.api import Notebook
from marginalia.errors import InvalidRequest, NotFound
from marginalia.functions.coerce import FieldRule


@pytest.fixture(scope="module")
def nb(spark, tmp_path_factory):
    root, base = tmp_path_factory.mktemp("notes"), tmp_path_factory.mktemp("store")
    (root / "docs").mkdir()
    (root / "Welcome.md").write_text("---\ntags: [a, b]\naliases: Start\n---\n# Top\nplain words about trains [[manual]] [[lost]]")
    (root / "docs/manual.md").write_text("how trains run and stop [[start]]")
    (root / "docs/copy.md").write_text("how trains run and stop [[start]]")
    (root / "z.txt").write_text("zebra")
    n = Notebook(spark, str(root), str(base), rules={"status": FieldRule("string", on_missing="require")})
    assert {r.extension: r.notes for r in n.reindex_vault(dry_run=True).collect()} == {".md": 3, ".txt": 1}
    n.reindex_vault()
    return n


def test_search(nb):
    assert nb.search_vault("zebra", 1).first().note_path == "z.txt"
    assert nb.search_vault_hybrid("trains run", 2).first().note_path.startswith("docs/")
    assert {r.folder for r in nb.search_by_folder("trains", "docs").collect()} == {"docs"}
    assert "**zebra**" in nb.search_advanced("zebra", 1, highlight="**", extension="txt").first().text
    assert nb.search_advanced("trains", exclude=["how"]).where("note_path LIKE 'docs/%'").count() == 0
    assert nb.find_similar_notes("docs/manual.md", 1).first().note_path == "docs/copy.md"
    assert [tuple(r)[:2] for r in nb.search_duplicates(0.9).collect()] == [("docs/copy.md", "docs/manual.md")]
    with pytest.raises(NotFound):
        nb.find_similar_notes("none.md")
    with pytest.raises(InvalidRequest):
        nb.search_vault(" ")
    assert nb.system_stats()["search_vault"]["count"] == 1 and nb.health_check()["published"]


def test_links_and_navigation(nb):
    assert {r.from_note_path for r in nb.get_backlinks("Welcome.md").collect()} == {"docs/manual.md", "docs/copy.md"}
    assert {(r.target, r.resolved_path) for r in nb.get_outlinks("Welcome.md")[0].collect()} == {("manual", "docs/manual.md"), ("lost", None)}
    assert (lambda r: (r.wikilinks, r.total, r.broken))(nb.get_outlinks("Welcome.md")[1].first()) == (2, 2, 1)
    nodes, edges = nb.graph_data("docs")
    assert {r.path for r in nodes.collect()} == {"docs/manual.md", "docs/copy.md", "Welcome.md"} and {r.source for r in edges.collect()} == {"docs/manual.md", "docs/copy.md"}
    assert nb.graph_data()[0].where("path = 'docs/manual.md'").first().label == "manual"
    assert nb.suggest_links("docs/manual.md", 5, 0.0).where("note_path = 'Welcome.md'").count() == 0
    assert [(r.node, r.position) for r in nb.find_link_clusters(2).collect()] == [("Welcome.md", 1), ("docs/copy.md", 2), ("docs/manual.md", 3)]
    assert [tuple(r)[:2] for r in nb.find_broken_links().collect()] == [("Welcome.md", 1)]
    assert [r.path for r in nb.find_orphan_notes().collect()] == ["docs/copy.md"]
    assert nb.link_stats()[0].first().total == 4
    assert nb.find_link_clusters(2).first()["size"] == 3
    assert [r.node for r in nb.find_bridge_notes().collect()] == ["Welcome.md"]
    assert [r.tag for r in nb.tag_stats().collect()] == ["a", "b"] and nb.search_by_tags(["A"]).count() == 1
    assert nb.list_notes().first().total == 4 and nb.vault_stats().first().notes == 4
    assert nb.get_recent_notes(datetime.now(timezone.utc), 365).count() == 4
    assert nb.daily_note("2024-01-01").first().found is False and nb.random_note(1).count() == 1
    assert [r.folder for r in nb.resource_folders().collect()] == ["docs"] and nb.resource_tags().count() == 2


def test_changes(nb):
    nb.create_note("new.md", "about [[Welcome]]")
    assert [tuple(r) for r in nb.sync_vault().collect()] == [("new.md", "new")]
    nb.reindex_note("new.md")
    assert nb.table("chunks").where("vector IS NULL").count() == 0 and nb.table("catalog").count() == 5
    assert nb.get_outlinks("new.md")[0].first().resolved_path == "Welcome.md"
    assert sorted(r.path for r in nb.generate_missing_ids().collect()) == ["Welcome.md", "docs/copy.md", "docs/manual.md"]
    assert nb.generate_missing_ids("docs", dry_run=False).count() == 2 and [r.path for r in nb.generate_missing_ids().collect()] == ["Welcome.md"]
    assert {(r.path, r.action) for r in nb.reconcile().collect()} == {("docs/copy.md", "upsert"), ("docs/manual.md", "upsert")} and nb.reconcile().count() == 0
    nb.delete_note("new.md")
    nb.sync_vault(dry_run=False)
    assert nb.table("catalog").count() == 4 and nb.sync_vault().count() == 0
    assert nb.table("postings").select("note_path").distinct().count() == 4 and nb.table("postings").where("term = 'trains'").count() == 3
    assert nb.search_vault_hybrid("zebra", 1).first().note_path == "z.txt"
    nb.compact_index()
    assert nb.table("chunks").count() == 4 and nb.vector_index_status() == {"rows": 4, "indexed": False, "lists": 0}
    assert nb.build_vector_index() == nb.vector_index_status()
    assert nb.build_vector_index(least_rows=1) == {"rows": 4, "indexed": True, "lists": 1}
    assert nb.search_vault("zebra", 1, probes=1).first().note_path == "z.txt"


def test_frontmatter(nb, spark):
    assert nb.validate_frontmatter("Welcome.md").first().validation.errors[0].code == "required_missing"
    assert nb.validate_frontmatter(frontmatter={"status": "x", "list": [1]}).first().validation.valid
    with pytest.raises(InvalidRequest):
        nb.validate_frontmatter()

    def fill(batches):
        for b in batches:
            b["frontmatter"] = [{"status": "draft"}] * len(b)
            yield b

    notes = spark.createDataFrame([("a.md", {"k": "v"}), ("b.md", {"status": "ok"})], "path string, frontmatter map<string,string>")
    assert [tuple(r) for r in nb.enrich_frontmatter(notes, fill).collect()] == [("a.md", {"status": "draft"})]
