import datetime
import shutil
import time

import pytest

from scopegrain.operators import scopes, sync
from scopegrain.plans.engine import Engine, Engines
from scopegrain.sources import files, models, store
from scopegrain.sources.store import Store
from scopegrain.streaming.watch import EVENTS, watch, watch_tree


def corpus(tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.md").write_text("# Alpha\nvector index search\n\n## Beta\nfolding of results")
    (root / "sub" / "b.py").write_text("import os\n\ndef load_index(path):\n    return os.path.join(path, 'index')\n")
    (root / "c.bin").write_text("no")
    return root


def test_init_search_read_and_sync(spark, tmp_path):
    root = corpus(tmp_path)
    engine = Engine(spark, str(root), str(tmp_path / "store"))
    status = engine.init()
    assert status["files"] == 2 and status["chunks"] >= 3 and status["vectors"] == status["chunks"] and status["dimensions"] == 64
    session, page = engine.search("vector index search")
    rows = page.collect()
    assert session == "S1" and rows and rows[0].path == "a.md"
    assert engine.read(session, [1], 4).count() == 1
    assert engine.search("vector index search", enhanced=False)[1].count() >= 1
    assert not any(v for k, v in engine.sync().items() if k != "total_chunks")
    (root / "a.md").write_text("# Alpha\nsomething new")
    (root / "d.txt").write_text("added file")
    (root / "sub" / "b.py").unlink()
    counts = engine.sync()
    assert (counts["added"], counts["updated"], counts["removed"]) == (1, 1, 1)
    assert not any(v for k, v in engine.sync().items() if k != "total_chunks")
    assert engine.check_model() == "none" and engine.config("chunk_size") == 512
    assert {r.folder for r in engine.folders().collect()} == {""}
    assert engine.tree() == [{"path": str(root), "depth": 0, "vectors": status["vectors"], "tags": status["tags"]}]
    assert engine.store.read("file_tags").count() and engine.store.read("axes").count() <= 1
    few = engine.search("vector index search", top_k=1, min_similarity=0.01)[1].collect()
    assert len(few) == 1 and engine.search("vector index search", min_similarity=0.9999)[1].count() <= 1
    again = Engine(spark, str(root), str(tmp_path / "store"))
    assert again.settings == engine.settings and Engine(spark, str(root), str(tmp_path / "store"), chunk_size=99).settings["chunk_size"] == 99
    assert engine.tag_inspect().count() == status["tags"]
    engine.embedder = models.hashing(32)
    assert engine.check_model() == "rebuild"
    engine.recover()
    assert engine.status()["dimensions"] == 32


def test_scan_sees_all_names_and_opens_wanted_files_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "LISTED", 2)
    for name in ("pkg/__init__.py", ".hidden/_x.md", "node_modules/m/a.js", "deep/a/b/c/d.txt", "deep/a/.git/e.txt", "x.bin", "nest/in.md", "nest2/in.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"caf\xc3\xa9 \xff")
    nested = spark.createDataFrame([("nest",), ("other",)], "path string")
    rows = {r.path: r for r in files.scan(spark, str(tmp_path), nested=nested).collect()}
    assert set(rows) == {"pkg/__init__.py", ".hidden/_x.md", "deep/a/b/c/d.txt", "nest2/in.md"}
    one = rows["deep/a/b/c/d.txt"]
    assert one.content == "café \ufffd" and one.size == 7 and one.mtime > 1_500_000_000_000 and len(one.hash) == 16
    assert files.scan(spark, f"file://{tmp_path}").count() == 5 and files.scan(spark, str(tmp_path / "none")).count() == 0
    listed = {r.path for r in files.listing(spark, str(tmp_path), files.IGNORE).collect()}
    assert not any("node_modules" in p or ".git" in p for p in listed) and "x.bin" in listed


def test_readers_see_all_tables_of_a_version(spark, tmp_path):
    kept = Store(spark, str(tmp_path / "kept"))
    one = lambda n: spark.createDataFrame([(n, n, 1.0)], "a bigint, b bigint, weight double")
    tag = lambda n: spark.createDataFrame([(n, n)], "file_id bigint, tag_id bigint")
    assert not kept.exists() and kept.read("edges").count() == 0 and not kept.has("edges")
    kept.write(edges=one(1), file_tags=tag(1))
    seen, swap, reader = [], kept._replace, Store(spark, str(tmp_path / "kept"))

    def between(name, text):
        seen.append((reader.read("edges").first().a, reader.read("file_tags").first().tag_id))
        swap(name, text)
        seen.append((reader.read("edges").first().a, reader.read("file_tags").first().tag_id))

    kept._replace = between
    old = kept.read("edges")
    kept.write(edges=one(2), file_tags=tag(2))
    assert seen == [(1, 1), (2, 2)] and old.first().a == 1
    kept.write(edges=one(3))
    assert kept.read("edges").first().a == 3 and kept.read("file_tags").first().tag_id == 2
    assert len([x for x in (tmp_path / "kept").iterdir() if x.name.startswith("edges-")]) == 2


def test_lost_vectors_are_made_again(spark, tmp_path):
    engine = Engine(spark, str(corpus(tmp_path)), str(tmp_path / "store"))
    with pytest.raises(FileNotFoundError):
        engine.search("x")
    engine.init()
    before = {r.id: r.vector for r in engine.store.read("vectors").collect()}
    shutil.rmtree(tmp_path / "store" / engine.store.version()["vectors"])
    assert engine.search("vector index search", enhanced=False)[1].count() >= 1
    assert {r.id: r.vector for r in engine.store.read("vectors").collect()} == before


def test_roots_below_and_above_are_searched_by_scope(spark, tmp_path, monkeypatch):
    text = "vector index search of shared notes"
    for name in ("top/a.md", "top/mid/b.md", "top/mid/low/c.md", "top/mid/low2/d.md"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"# {name}\n{text}")
    made = {}
    for name in ("top/mid", "top", "top/mid/low", "top/mid/low2"):
        made[name] = Engine(spark, str(tmp_path / name), str(tmp_path / "stores" / name.replace("/", "_")), registry=str(tmp_path / "registry"))
        made[name].register()
    monkeypatch.setattr(Engine, "build_tags", lambda self: None)
    for engine in made.values():
        engine.init()
    mid = made["top/mid"]
    covered = {s: [p.removeprefix(str(tmp_path)) for p, _ in mid.members(s)] for s in ("local", "bubble", "cascade", "merge")}
    assert covered == {"local": ["/top/mid"], "bubble": ["/top", "/top/mid"], "cascade": ["/top/mid", "/top/mid/low", "/top/mid/low2"], "merge": ["/top", "/top/mid", "/top/mid/low", "/top/mid/low2"]}
    session, page = mid.search(text, enhanced=False, scope="merge", level=0)
    assert {r.path for r in page.select("path").collect()} == {"b.md", "../a.md", "low/c.md", "low2/d.md"}
    assert mid.read(session, [1, 2], level=4, direction="before").count() == 2
    assert [p.removeprefix(str(tmp_path)) for p, _ in made["top/mid/low"].members("merge")] == ["/top", "/top/mid", "/top/mid/low"]
    assert [(t["path"].removeprefix(str(tmp_path)), t["depth"], t["vectors"]) for t in made["top"].tree()] == [("/top", 0, 1), ("/top/mid", 1, 1), ("/top/mid/low", 2, 1), ("/top/mid/low2", 2, 1)]


def test_tree_is_watched(spark, tmp_path):
    root = corpus(tmp_path)
    engine = Engine(spark, str(root), str(tmp_path / "store"))
    engine.init()
    query = watch_tree(spark, str(tmp_path / "cp"), engine.sync, "1 second")
    try:
        (root / "new.md").write_text("# New\nseen by the watcher")
        end = time.time() + 120
        while time.time() < end and not engine.store.read("files").filter("path = 'new.md'").count():
            time.sleep(1)
    finally:
        query.stop()
    assert engine.store.read("chunks").filter("path = 'new.md'").count() == 1


def test_stream_of_documents(spark, tmp_path):
    engine = Engine(spark, str(corpus(tmp_path)), str(tmp_path / "store"))
    engine.init()
    at = datetime.datetime(2025, 1, 1)
    rows = [("n.txt", "old", at), ("n.txt", "streamed text", at + datetime.timedelta(1)), ("a.md", None, at), (None, "x", at)]
    spark.createDataFrame(rows, EVENTS).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), str(tmp_path / "cp"), engine.take, interval=None).awaitTermination(120)
    got = {r.path: r.content for r in engine.store.read("chunks").collect()}
    assert got["n.txt"] == "streamed text" and "a.md" not in got


def test_changes_and_numbering(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("c", None), (None, "9")], "path string, hash string")
    old = spark.createDataFrame([("b", "3"), ("c", None), ("d", "4")], "path string, hash string")
    assert {r.path: r.status for r in sync.changes(now, old).collect()} == {"a": "added", "b": "updated", "c": "same", "d": "removed"}
    assert {r.status for r in sync.changes(old, old, force=True).collect()} == {"updated"}
    ids = [r.id for r in sync.numbered(now.filter("path is not null"), ["path", "hash"], 10).orderBy("path", "id").collect()]
    assert ids == [11, 12, 13, 14]
    assert sync.numbered(now.limit(0), ["path"], 10).count() == 0


def test_scopes(spark):
    roots = spark.createDataFrame([(1, "r", None), (2, "r/a", 1), (3, "r/a/b", 2), (4, "x", 99)], "id bigint, path string, parent_id bigint")
    up = scopes.ancestors(roots)
    assert {(r.id, r.ancestor_id) for r in up.collect()} == {(2, 1), (3, 2), (3, 1)}
    merge = {(r.id, r.member_id) for r in scopes.members(roots, up, "merge").collect()}
    assert {(3, 1), (3, 2), (2, 3), (1, 2)} <= merge and (1, 3) not in merge
    files = spark.createDataFrame([(1, "./r/a/f.md"), (2, "r\\a\\b\\g.md"), (3, "ra/h.md")], "id bigint, path string")
    assert {(r.file_id, r.root_id) for r in scopes.nearest_root(files, roots).collect()} == {(1, 2), (2, 3)}


def test_models_settings_and_store(spark, tmp_path):
    assert models.resolve("bge-m3").dimensions == 1024 and models.resolve("x", dimensions=7).source == "manual"
    assert models.resolve("mine", probe=models.hashing(5)).dimensions == 5
    assert models.unpack(models.pack([1.0, 2.0])) == [1.0, 2.0]
    assert models.project_kind({"package.json", "tsconfig.json"})[0] == "typescript" and models.project_kind(set())[0] == "generic"
    file = tmp_path / "s.json"
    file.write_text('{"a": "http://x", // note\n "b": /* two */ 2}')
    assert store.load_settings(str(file), {"b": 1, "c": 3}) == {"a": "http://x", "b": 2, "c": 3}
    (tmp_path / ".env").write_text("KEY='v'\n# no\n")
    assert store.load_environment(str(tmp_path))["KEY"] == "v"
    engines = Engines(2)
    for r in "abca":
        engines.get(r, lambda root: root)
    assert list(engines._held) == ["c", "a"]
    frame = models.embed_column(spark.createDataFrame([("x",), (None,), ("x",)], "t string"), "t", models.hashing(4))
    assert sorted(r.vector is None for r in frame.collect()) == [False, False, True]
