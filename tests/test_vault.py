"""Vault, index versions, incremental ingest, tools and streams on a small directory."""

import json

import pytest
from pyspark.sql import functions as F

from lorekiln.api import Engine
from lorekiln.config import Config
from lorekiln.operators.embedding import HashProvider, embedded
from lorekiln.operators.ingest import ingest
from lorekiln.sources import qa, vault
from lorekiln.sources.store import Store
from lorekiln.streaming import notes as streams


@pytest.fixture
def config(tmp_path):
    root = tmp_path / "a vault"
    (root / "api").mkdir(parents=True)
    (root / "checkout.md").write_text("---\nid: checkout\nowner: team-a\ndepends_on: [payments]\n---\n# Checkout\nThe checkout calls the payment gateway.\n\n## Limits\nWAL mode concurrency matters here.\n")
    (root / "api" / "payments.MD").write_text("---\nid: payments\nconflicts_with: ledger\n---\n# Payments\nStreamable HTTP and bearer authorization.\n")
    (root / "plain.txt").write_text("A plain note about tsconfig strict mode.")
    (root / "image.png").write_bytes(b"x")
    return Config(str(root), str(tmp_path / "store"), dim=64)


def test_scan_and_paths(spark, config):
    rows = {r["path"]: r for r in vault.scan_vault(spark, config.vault_dir).collect()}
    assert set(rows) == {"checkout.md", "api/payments.MD", "plain.txt"} and rows["plain.txt"]["content"].startswith("A plain")
    assert [r["path"] for r in vault.list_notes(spark, config.vault_dir, "api/").collect()] == ["api/payments.MD"]
    assert vault.scan_vault(spark, config.vault_dir + "/none").count() == 0
    assert vault.safe_path(config.vault_dir, "../../x.md")[1] == "x.md"
    with pytest.raises(ValueError):
        vault.safe_path(config.vault_dir, "/etc/passwd")
    with pytest.raises(FileNotFoundError):
        vault.read_note(spark, config.vault_dir, "none.md")


def test_ingest_is_incremental(spark, config):
    first = ingest(spark, config)
    assert first["files_new"] == 3 and first["chunks_new"] == 4
    again = ingest(spark, config)
    assert again["files_unchanged"] == 3 and again["chunks_new"] == 0
    store = Store(spark, config.store_dir)
    assert store.versions() == [1]
    before = {r["content"]: r["chunk_id"] for r in store.read("chunks").collect()}
    note = vault.safe_path(config.vault_dir, "checkout.md")[0]
    note.write_text(note.read_text().replace("matters here", "matters most"))
    (note.parent / "plain.txt").unlink()
    third = ingest(spark, config)
    assert (third["files_updated"], third["files_deleted"], third["chunks_new"], third["chunks_kept"], third["chunks_deleted"]) == (1, 1, 1, 1, 2)
    after = {r["content"]: r["chunk_id"] for r in store.read("chunks").collect()}
    assert after["The checkout calls the payment gateway."] == before["The checkout calls the payment gateway."]
    assert store.read("chunks", 1).count() == 4 and store.versions() == [1, 2]
    names = {r["name"]: r["type"] for r in store.read("entities").collect()}
    assert set(names) == {"checkout", "payments", "team-a", "ledger"}
    assert ingest(spark, config, force=True)["files_updated"] == 2


def test_tools(spark, config):
    ingest(spark, config)
    engine = Engine(spark, config)
    assert engine.keyword_search("WAL mode concurrency").first()["file_path"] == "checkout.md"
    assert engine.hybrid_search("bearer authorization", 3).first()["file_path"] == "api/payments.MD"
    assert engine.similar_notes("tsconfig strict mode").first()["file_path"] == "plain.txt"
    assert "gateway" in engine.context_for_query("payment gateway").first()["context"]
    assert {r["name"] for r in engine.graph_hybrid_search("payment gateway").collect()} >= {"checkout"}
    assert {r["name"] for r in engine.impact_analysis("CHECKOUT").collect()} == {"payments"}
    assert engine.impact_analysis("nobody").count() == 0 and engine.suggestions("check").first()["name"] == "checkout"
    assert engine.find_owner("checkout").first()["owner"] == "team-a"
    assert engine.detect_conflicts("ledger").first()["with_name"] == "payments"
    assert [r["name"] for r in engine.get_entity_lineage("checkout").collect()] == ["checkout", "payments"]
    written = engine.write_note("new/idea.md", "# Idea\nA quokka sleeps.")
    assert written["ingest"]["chunks_new"] == 1 and engine.keyword_search("quokka").count() == 1
    with pytest.raises(FileExistsError):
        engine.write_note("new/idea.md", "x")
    engine.append_note("new/idea.md", "## More\nA numbat digs.")
    assert engine.read_note("new/idea.md").first()["content"] == "# Idea\nA quokka sleeps.\n\n## More\nA numbat digs."
    assert engine.keyword_search("numbat").first()["heading_path"] == "Idea > More" and engine.list_notes("new/").count() == 1


def test_stream_builds_the_same_index(spark, config, tmp_path):
    streams.stream_ingest(spark, config, str(tmp_path / "ck")).awaitTermination()
    other = Config(config.vault_dir, str(tmp_path / "batch"), dim=64)
    ingest(spark, other)
    for table, key in (("chunks", ["chunk_id", "content", "heading_path", "chunk_index"]), ("edges", ["source_id", "target_id", "edge_type"]), ("entities", ["entity_id", "name", "type"])):
        a, b = (sorted(map(tuple, Store(spark, c.store_dir).read(table).select(*key).collect())) for c in (config, other))
        assert a == b and a


def test_stream_of_changes_and_windows(spark, config, tmp_path):
    for name, frame in (("changed", streams.changed_notes(streams.note_stream(spark, config.vault_dir))), ("windows", streams.notes_by_window(streams.note_stream(spark, config.vault_dir)))):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append" if name == "changed" else "update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.table("changed").count() == 3
    assert spark.table("windows").agg(F.sum("n_notes")).first()[0] == 3


def test_provider_falls_back(spark):
    def broken(texts):
        raise OSError("down")

    rows = spark.createDataFrame([(1, "a b"), (2, " "), (3, None)], "id int, text string")
    got = {r["id"]: r for r in embedded(rows, "id", "text", 8, broken, "remote").collect()}
    assert got[1]["embedding_model"] == "hash-djb2" and got[2]["embedding"] is None and got[3]["embedding"] is None
    assert got[1]["embedding"] == pytest.approx(list(HashProvider(8)(["a b"])[0]))
    fine = embedded(rows, "id", "text", 2, lambda t: [[0.0, 1.0]] * len(t), "remote").filter("id = 1").first()
    assert fine["embedding"] == [0.0, 1.0] and fine["embedding_model"] == "remote"


def test_questions_become_notes(spark, tmp_path):
    rows = spark.createDataFrame([(0, [("A (b)", ["One.", "Two."]), ("C d", ["Three."])]), (1, [("C d", ["Other."])]), (200, [("Late", ["x"])])], "n int, context array<struct<title:string,sentences:array<string>>>")
    got = {r["path"]: r["content"] for r in qa.question_notes(rows).collect()}
    assert set(got) == {"A_b.md", "C_d.md"} and "One. Two." in got["A_b.md"] and "[[C_d]]" in got["A_b.md"] and "Three." in got["C_d.md"]
    (tmp_path / "t.json").write_text(json.dumps([{"id": "1", "category": "x", "query": "q", "expectedFiles": ["a"]}, {"id": "2", "expectedOwner": "o"}]))
    assert [r["expectedOwner"] for r in qa.read_ground_truth(spark, str(tmp_path / "t.json")).orderBy("id").collect()] == [None, "o"]


def test_of_two_writers_one_publishes(spark, config):
    ingest(spark, config)
    store = Store(spark, config.store_dir)
    entities, edges = store.read("entities"), store.read("edges")
    store.publish({"entities": entities.limit(1)}, {}, base=1)
    with pytest.raises(FileExistsError):
        store.publish({"edges": edges.limit(0)}, {}, base=1)
    assert store.versions() == [1, 2] and store.read("entities").count() == 1 and store.read("edges").count() == edges.count()


def test_an_append_writes_the_rows_of_its_file(spark, config):
    ingest(spark, config)
    store = Store(spark, config.store_dir)
    engine = Engine(spark, config)
    engine.append_note("plain.txt", "A numbat digs under checkout notes.")
    before, after = store.manifest(1), store.manifest(2)
    for table in ("chunks", "postings", "doc_stats", "entity_chunk_map"):
        assert after[table][: len(before[table])] == before[table] and len(after[table]) == len(before[table]) + 1
    folder = f"{config.store_dir}/data/{after['chunks'][-1]}"
    assert spark.read.parquet(f"{folder}/chunks").count() == 1 and spark.read.parquet(f"{folder}/doc_stats").count() == 1
    assert engine.keyword_search("numbat").first()["file_path"] == "plain.txt" and store.read("chunks").count() == 4
    assert store.read("doc_stats").count() == store.read("chunks").count()
    answer = engine.answer("get_entity_lineage", "Checkout")
    assert answer["found"] and [c["name"] for c in answer["tree"]["children"]] == ["payments"]
    assert engine.answer("find_owner", "checkout")["has_owner"] and engine.answer("detect_conflicts", "ledger")["count"] == 1
    assert engine.answer("impact_analysis", "check") == {"found": False, "suggestions": [{"name": "checkout", "type": "document"}]}
    found = engine.graph_hybrid_search("numbat gateway").collect()
    assert {r["file_path"] for r in found} >= {"plain.txt", "checkout.md"} and any(r["nth"] is None and r["content"] for r in found)


def test_segments_are_written_together(spark, config, monkeypatch):
    from lorekiln.sources import store as stores

    monkeypatch.setattr(stores, "MOST_SEGMENTS", 2)
    engine = Engine(spark, config)
    ingest(spark, config)
    for i in range(2):
        engine.append_note("plain.txt", f"Line {i} of quokka.")
    store = Store(spark, config.store_dir)
    assert len(store.manifest()["chunks"]) == 1 and store.read("chunks").count() == 4
    assert engine.keyword_search("quokka").count() == 1 and engine.keyword_search("gateway").count() == 1


def test_chunks_get_the_context_of_their_note(spark, config):
    def contextualizer(document, content):
        if "WAL" in content:
            raise OSError("down")
        return f"From a note of {len(document)} characters."

    ingest(spark, config, contextualizer=contextualizer)
    rows = {r["content"]: r["contextualized_content"] for r in Store(spark, config.store_dir).read("chunks").collect()}
    assert rows["WAL mode concurrency matters here."] is None
    assert rows["A plain note about tsconfig strict mode."] == "From a note of 40 characters.\n\nA plain note about tsconfig strict mode."
    assert Engine(spark, config).keyword_search("characters").count() == 3


def test_questions_become_truth(spark):
    rows = spark.createDataFrame(
        [(0, "q1", "Which?", "That.", "bridge", [["A (b)", "0"], ["C d", "1"], ["A (b)", "2"]]), (1, "q2", "Who?", None, "other", []), (100, "q3", "Late?", "x", "bridge", [])],
        "n int, _id string, question string, answer string, type string, supporting_facts array<array<string>>",
    )
    got = {r["id"]: r for r in qa.question_truth(rows).collect()}
    assert set(got) == {"q1", "q2"} and got["q1"]["expectedFiles"] == ["A_b.md", "C_d.md"] and got["q1"]["category"] == "multi_hop"
    assert got["q2"]["category"] == "single_hop" and got["q2"]["expectedFiles"] == [] and got["q2"]["expectedOwner"] is None
