"""Golden cases for what SQL can't say well: extraction, resolution, classification, streams, snapshots."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalens.functions import paths, text
from stratalens.operators import graph, imports, index, search, symbols
from stratalens.plans import analyses, routing
from stratalens.sources import corpus, snapshot
from stratalens.sources.mini import EDGES, FILES, SYMBOLS, mini


def tree(spark, *rows):
    df = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(rows)], "id long, path string, content string")
    return corpus.files(df, F.col("path"), F.col("content"), F.col("id"))


def test_golden_symbols_and_edges(spark):
    f = mini(spark)
    assert [tuple(r) for r in symbols.extract(f).orderBy("path", "ord").select("path", "name", "kind", "line_start", "line_end").collect()] == SYMBOLS
    ids = {i: p for i, (p, _) in enumerate(FILES)}
    assert sorted((ids[r.src], ids[r.dst]) for r in imports.edges(f).collect()) == EDGES


@pytest.mark.parametrize("importer,content,target", [
    ("src/a.rs", "use crate::b::helper;", "src/b.rs"), ("app/a.py", "from lib.util import x", "lib/util.py"), ("web/a.ts", 'import x from "./b"', "web/b/index.ts"), ("a/A.java", "import com.x.B;", "com/x/B.java"),
    ("k/A.kt", "import com.x.B", "com/x/B.kt"), ("s/A.scala", "import com.x.B", "com/x/B.scala"), ("l/a.lua", 'require("x.b")', "x/b.lua"), ("c/a.c", '#include "b.h"', "c/b.h"), ("z/a.zig", '@import("b.zig")', "z/b.zig"),
    ("r/a.rb", "require_relative 'b'", "r/b.rb"), ("d/a.dart", "import 'package:x/b.dart';", "lib/b.dart"), ("n/a.nix", "import ./b.nix", "n/b.nix"), ("s/a.css", '@import "b.css";', "s/b.css"), ("s/a.scss", '@use "b";', "s/_b.scss"),
    ("b/a.sh", "source ./b.sh", "b/b.sh"), ("m/Makefile", "include b.mk", "m/b.mk"), ("h/a.html", '<script src="b.js">', "h/b.js"), ("t/a.tf", 'source = "./mod"', "t/mod/main.tf"), ("r/a.r", 'source("b.R")', "r/b.R"),
    ("p/a.proto", 'import "b.proto";', "p/b.proto"), ("s/a.sol", 'import "./b.sol";', "s/b.sol"), ("y/a.yml", "- include_tasks: b.yml", "y/b.yml"), ("j/a.j2", '{% extends "b.html" %}', "j/b.html"), ("g/a.go", 'import "example.com/x/pkg"', "pkg/p.go"),
])
def test_resolution(spark, importer, content, target):
    f = tree(spark, (importer, content), (target, ""), ("other/far" + target.replace("/", "_"), ""))
    assert [(r.src, r.dst) for r in imports.edges(f).collect()] == [(0, 1)]


def test_paths(spark):
    rows = spark.createDataFrame([("a/./b/../c.py",), ("src/barfoo.rs",), (".hidden/x.py",), ("x/.env",), ("node_modules/a.js",), ("Dockerfile.dev",), ("A.PY",)], "p string")
    p = F.col("p")
    got = {r.p: r for r in rows.select("p", paths.normalised(p).alias("n"), paths.ignored(p).alias("i"), paths.language(p).alias("l")).collect()}
    assert got["a/./b/../c.py"].n == "a/c.py"
    assert [got[x].i for x in (".hidden/x.py", "x/.env", "node_modules/a.js", "src/barfoo.rs")] == [True, False, True, False]
    assert (got["Dockerfile.dev"].l, got["A.PY"].l) == ("dockerfile", "python")


def test_search_cases(spark):
    f = tree(spark, ("a.rs", "fn main() {\n    hello_world();\n}\n"), ("b.rs", "hello there"), ("barfoo.rs", "aaaa aaaa\naaaa"))
    assert [(r.path, r.line_no) for r in search.search(f, "hello_world").collect()] == [("a.rs", 2)]
    assert search.search(f, "he").count() == 0
    assert search.candidates(f, "aaa").count() == 1
    assert search.find_word(f, "hello").count() == 1 and search.find_word(f, "Hello").count() == 0
    assert search.resolve_path(f, "foo.rs").count() == 0 and search.resolve_path(f, "barfoo.rs").count() == 1
    assert index.trigram_postings(f, 12).where("file_id = 2").count() == 0
    new = tree(spark, ("a.rs", "beta_token")).withColumn("file_id", F.lit(9).cast("long"))
    g = index.upsert(f, new)
    assert search.search(g, "hello_world").count() == 0 and search.search(g, "beta_token").count() == 1 and index.remove(g, new).count() == 2
    assert not index.needs_compaction(64, 8) and index.needs_compaction(65, 8)
    assert index.splice(f.where("file_id = 0"), 2, 2, "bye").first().content == "fn main() {\nbye\n}\n"
    r = f.where("file_id = 0").select(text.snippet(F.lit("x" * 100 + "HIT" + "y" * 100), F.lit(101), F.lit(3)).alias("s")).first().s
    assert "HIT" in r and len(r) == 80


def test_secrets(spark):
    hit = ['password = "hunter2hunter2"', "MY_KEY=abcdefgh123", "secret: abcdefgh9"]
    miss = ["password = changeme12", "# secret = abcdefghi", "token = f(abcdefghij)", "secret = ${ABCDEFGH}", "name = abcdefghi"]
    f = tree(spark, ("config.rs", "\n".join(hit + miss)), ("test_config.rs", hit[0]))
    got = analyses.security(f).where("rule = 'hardcoded_secret_assignment'").collect()
    assert sorted(r.line for r in got) == [1, 2, 3] and {r.file for r in got} == {"config.rs"}


def test_local_bindings_and_empty(spark):
    f = tree(spark, ("a.zig", "fn f() void {\n    const x = 1;\n    const S = struct {\n        fn g() void {}\n    };\n}\n"), ("e.py", ""))
    assert [r.name for r in symbols.extract(f).orderBy("ord").collect()] == ["f", "S", "g"]
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert {r.name for r in symbols.python_symbols(tree(spark, ("a.py", "class A:\n    def f(self):\n        pass\n"), ("b.py", "def (:"))).collect()} == {"A", "f"}


def test_cycle_and_impact(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 5), (6, 1)], "src long, dst long")
    assert sorted(tuple(r) for r in graph.components(e).collect()) == [(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)]
    start = spark.createDataFrame([(1,)], "node long")
    assert sorted(tuple(r) for r in graph.change_impact(e, start).collect()) == [(1, 3), (2, 2), (3, 1), (4, 1), (5, 2), (6, 1)]
    assert sorted(r.node for r in graph.change_impact(e, start, 0).collect()) == [3, 4, 6]
    assert "graph LR" in graph.mermaid(spark.createDataFrame([("a", "b", 2)], "from_pkg string, to_pkg string, weight long"))


def test_components_of_a_deep_graph(spark, monkeypatch):
    cuts, cut = [], graph._cut
    monkeypatch.setattr(graph, "_cut", lambda df: cuts.append(1) or cut(df))
    path = spark.range(80).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    back = spark.createDataFrame([(90, 80), (80, 90), (7, 7)], "src long, dst long")
    assert graph.components(path).count() == 0 and len(cuts) < 5  # not a round for each node of a path
    assert sorted(tuple(r) for r in graph.components(path.union(back)).collect()) == [(80, 80), (90, 80)]


def test_components_in_one_task_and_by_rounds(spark):
    rng = np.random.default_rng(6)
    e = [tuple(x) for x in rng.integers(0, 60, (75, 2)).tolist()] + [(100, 101), (101, 102), (102, 100), (102, 103)]
    e += [(200, 300 + k) for k in range(700)] + [(300 + k, 200) for k in range(0, 700, 3)]  # a node with very many edges
    edges = spark.createDataFrame(e, "src long, dst long")
    reach = {a: {b for x, b in e if x == a} for a, _ in e}
    while True:
        new = {a: x.union(*(reach.get(b, set()) for b in x)) for a, x in reach.items()}
        if new == reach:
            break
        reach = new
    same = {a: [b for b in x if a in reach.get(b, ())] for a, x in reach.items()}
    want = sorted((a, min(x)) for a, x in same.items() if len(x) > 1)
    assert sorted(tuple(r) for r in graph.components(edges).collect()) == want
    assert sorted(tuple(r) for r in graph.components(edges, room=2000).collect()) == want


@pytest.mark.parametrize("cmd,want", [
    ("grep -rn requireRemote packages/", ("ident", "requireRemote")), ("git grep requireRemote", ("ident", "requireRemote")), ("A=/tmp grep -rn find_symbol .", ("ident", "find_symbol")), ("grep -c name a.ts", ("none", "")),
    ("grep -rn name . | wc -l", ("none", "")), ("grep -rn ERROR /var/log/syslog", ("none", "")), ("cat src/a.ts", ("file", "src/a.ts")), ("sed -n '1,20p' README.md", ("none", "")), ("git status", ("none", "")), (None, ("none", "")), ("grep 'open", ("none", "")),
])
def test_commands(cmd, want):
    assert routing.classify(cmd) == want


def test_scan_reconcile_snapshot(spark, tmp_path):
    root = tmp_path / "ws"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("x = 1\n")
    (root / "src/b.bin").write_text("x")
    (root / ".gitignore").write_text("gen/\n")
    (root / "gen").mkdir()
    (root / "gen/c.py").write_text("y = 1\n")
    patterns = corpus.ignore_patterns(spark, str(root))
    f, listing = corpus.directory(spark, str(root), patterns)
    assert sorted(r.path for r in f.collect()) == ["src/a.py"]
    (root / "src/d.py").write_text("z = 1\n")
    f, listing = corpus.directory(spark, str(root), patterns)
    assert corpus.directory(spark, str(root), patterns, max_files=1)[1].where("capped").count() == 1
    old = listing.withColumn("length", F.when(F.col("path") == "src/a.py", 99).otherwise(F.col("length")))
    assert {r.path: r.change for r in corpus.reconcile(old, listing).collect()} == {"src/d.py": "unchanged", "src/a.py": "changed"}
    at = str(tmp_path / "snap")
    assert snapshot.save(at, "ws", {"files": f}) == 1 and snapshot.save(at, "ws", {"files": f.limit(1)}) == 2
    assert snapshot.load(spark, at, "ws")["files"].count() == 1 and snapshot.load(spark, at, "elsewhere") is None


def test_watch(spark, tmp_path):
    from stratalens.streaming import watch

    root, seen = tmp_path / "w", []
    root.mkdir()
    (root / "old.py").write_text("1")
    query = watch.watch(spark, str(root), str(tmp_path / "state"), str(tmp_path / "cp"), lambda df, n: seen.extend((r.path, r.op) for r in df.collect()))
    try:
        query.processAllAvailable()
        for act, want in ((lambda: (root / "a.py").write_text("1"), ("a.py", "create")), (lambda: (root / "a.py").write_text("22"), ("a.py", "modify")), (lambda: (root / "a.py").unlink(), ("a.py", "delete"))):
            act()
            end = time.time() + 30
            while want not in seen and time.time() < end:
                time.sleep(0.2)
            assert want in seen
    finally:
        query.stop()
    assert all(p != "old.py" for p, _ in seen)
    f = tree(spark, ("a.py", "1"), ("b.py", "2"))
    e = spark.createDataFrame([("a.py", "modify", 1), ("a.py", "delete", 2), ("c.py", "create", 1)], "path string, op string, version long")
    out = watch.apply_changes(f, e, lambda p: tree(spark, ("c.py", "3")))
    assert sorted(r.path for r in out.collect()) == ["b.py", "c.py"]


LONG_TEXT = "filler line\n" * 50_000 + "the token = qzx\n" + "License and more"  # over 512 KiB


def test_texts_over_the_posting_gate(spark):
    f = tree(spark, ("a.txt", "the License"), ("b.txt", LONG_TEXT))
    assert f.where("byte_size > 524288").count() == 1
    assert [(r.path, r.line_no) for r in search.search(f, "token = ").collect()] == [("b.txt", 50_001)]
    assert [(r.path, r.line_no) for r in search.find_word(f, "the").collect()] == [("a.txt", 1), ("b.txt", 50_001)]
    assert {r.path for r in search.search(f, "License", postings=index.trigram_postings(f)).collect()} == {"a.txt", "b.txt"}
    assert index.trigram_postings(f).where("trigram = 'qzx'").count() == 1 and index.word_postings(f).where("word = 'qzx'").count() == 1
    gated = index.trigram_postings(f, 1000), index.word_postings(f, 1000)
    assert gated[0].where("trigram = 'qzx'").count() == 0
    assert [(r.path, r.line_no) for r in search.search(f, "License", postings=gated[0], most_bytes=1000).collect()] == [("a.txt", 1), ("b.txt", 50_002)]
    assert [r.line_no for r in search.find_word(f, "token", postings=gated[1], most_bytes=1000).collect()] == [50_001]


@pytest.mark.parametrize("name,table,cols", [("search_token", "documents", "0L doc_id, 'en' lang, 'a' source"), ("search_phrase", "documents", "0L doc_id, 'en' lang, 'a' source"), ("find_word", "documents", "0L doc_id, 'en' lang, 'a' source"), ("find_word_conversations", "conversations", "0L conv_id, 1 turn, 'user' role"), ("trigram_posting_sizes", "documents", "0L doc_id, 'en' lang, 'a' source"), ("word_posting_sizes", "documents", "0L doc_id, 'en' lang, 'a' source")])
def test_queries_over_a_long_text(spark, tmp_path, name, table, cols):
    from stratalens.queries import QUERIES

    spark.range(1).selectExpr(*cols.split(", ")).withColumn("text", F.lit(LONG_TEXT)).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() > 0
