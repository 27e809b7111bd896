"""Listing of source trees, and their changes as a stream."""

from __future__ import annotations

import json

from corpuscope.operators import corpus
from corpuscope.sources import tree


def write(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_listing_is_dealt_by_directory(spark, tmp_path):
    write(tmp_path / "a", {"x.ts": "x", "src/y.ts": "yy", "src/deep/er/z.py": "zzz", "node_modules/q.ts": "q", "src/.git/config": "c", "docs/r.md": "#"})
    write(tmp_path / "b", {"k.go": "k"})
    found = tree.list_tree(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b"), "none": str(tmp_path / "none")})
    names = sorted((r.project_id, r.file.removeprefix(str(tmp_path)), r.length) for r in found.collect())
    assert names == [("a", "/a/docs/r.md", 1), ("a", "/a/src/deep/er/z.py", 3), ("a", "/a/src/y.ts", 2), ("a", "/a/x.ts", 1), ("b", "/b/k.go", 1)]
    assert found.rdd.getNumPartitions() == 5
    read = corpus.read_listed(found).collect()
    assert sorted((r.file.rsplit("/", 1)[1], r.content) for r in read) == [("k.go", "k"), ("r.md", "#"), ("x.ts", "x"), ("y.ts", "yy"), ("z.py", "zzz")]
    assert tree.list_tree(spark, {}).count() == 0


def test_changes_between_snapshots(spark, tmp_path):
    root, out = tmp_path / "t", tmp_path / "out"
    write(root, {"a.ts": "1", "src/b.ts": "22", "old/c.ts": "333"})

    def run(number):
        stream = tree.tree_changes(spark, {"p": str(root)}, str(tmp_path / "snaps"))
        query = (stream.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").json(str(out / f"{number}-{n}")))
                 .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        query.awaitTermination(120)
        assert query.exception() is None
        rows = [json.loads(line) for f in out.glob(f"{number}-*/*.json") for line in f.read_text().splitlines()]
        return sorted((r["file"].removeprefix(str(root)), r["action"], r.get("length")) for r in rows)

    assert run(0) == [("/a.ts", "add", 1), ("/old/c.ts", "add", 3), ("/src/b.ts", "add", 2)]
    write(root, {"a.ts": "changed", "new/d.ts": "4", "src/node_modules/e.ts": "e"})
    (root / "old/c.ts").unlink()
    (root / "old").rmdir()
    assert run(1) == [("/a.ts", "change", 7), ("/new/d.ts", "add", 1), ("/old/c.ts", "delete", None)]
    assert run(2) == []


def test_a_repeated_batch_gives_the_same_rows(tmp_path):
    write(tmp_path / "t", {"a.ts": "1"})
    reader = tree.ChangeReader({"p": str(tmp_path / "t")}, str(tmp_path / "snaps"))
    start, end = reader.initialOffset(), reader.latestOffset()
    rows = lambda: [r for p in reader.partitions(start, end) for r in reader.read(p)]
    first = rows()
    write(tmp_path / "t", {"a.ts": "later", "b.ts": "2"})
    assert rows() == first and len(first) == 1
