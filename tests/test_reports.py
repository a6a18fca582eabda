"""Reports, tools by name, saved postings: small cases by hand."""

import json

import pytest
from pyspark.sql import functions as F

from stratalens.operators import graph, imports, index, search, symbols
from stratalens.plans import analyses, reports, tools
from stratalens.sources import corpus
from stratalens.sources.mini import FILES, mini


def tree(spark, *rows):
    df = spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(rows)], "id long, path string, content string")
    return corpus.files(df, F.col("path"), F.col("content"), F.col("id"))


@pytest.fixture(scope="module")
def tables(spark):
    f = mini(spark)
    changes = spark.createDataFrame([(1, "a", "added"), (2, "b", "modified")], "seq long, path string, op string")
    return {"files": f, "symbols": symbols.extract(f), "edges": imports.edges(f), "changes": changes}


def test_version_log(spark, tmp_path):
    (tmp_path / "log").write_text("\x01aa\x02first\n\nMarked-by: x\x03\n\nsrc/a.py\nsrc/b.py\n\x01bb\x02second\x03\n\nsrc/a.py\n\x01cc\x02empty\x03\n")
    c = reports.version_log(spark, str(tmp_path / "log"))
    assert [(r.hash, r.files) for r in c.orderBy("hash").collect()] == [("aa", ["src/a.py", "src/b.py"]), ("bb", ["src/a.py"]), ("cc", [])]
    assert {r.path: r.churn for r in reports.churn(c).collect()} == {"src/a.py": 2, "src/b.py": 1}
    assert tuple(reports.marked(c, "(?i)marked-by: x").first()) == (1, 3, 33.3, 2)
    assert tuple(reports.marked(c.limit(0), "x").first()) == (0, 0, 0.0, 0)


def test_findings_tables_and_page(spark, tmp_path):
    rows = [("r1", f"f{k}", k, "low" if k else "critical") for k in range(6)] + [("r2", "f", 1, "medium")]
    got = {r.rule: tuple(r)[1:] for r in reports.findings_by_rule(spark.createDataFrame(rows, "rule string, file string, line int, severity string")).collect()}
    assert got == {"r1": (6, "critical", "f0:0,f1:1,f2:2,f3:3"), "r2": (1, "medium", "f:1")}
    t = {"a": spark.createDataFrame([("</script>", None)], "x string, y int")}
    reports.write_tables(t, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/a")).count() == 1
    page = reports.page("t & t", t)
    assert "<h1>t &amp; t</h1>" in page and "</script>\"" not in page and json.loads(page.split('id="data">')[1].split("</script>")[0]) == {"a": [{"x": "</script>", "y": None}]}


def test_tools(spark, tables, tmp_path):
    assert tools.catalogue(spark).count() == 16
    ask = lambda tool, /, **a: tools.answer(tables, {"id": 7, "method": "tools/call", "params": {"name": tool, "arguments": a}})
    got = [json.loads(x) for x in ask("find_symbol", name="charge")["result"]["content"]]
    assert got and all("charge" in x["name"] for x in got)
    src = tables["edges"].join(tables["files"], F.col("dst") == F.col("file_id")).orderBy("src", "dst").first()
    path = dict(enumerate(p for p, _ in FILES))[src.src]
    assert {"path": src.path} in [json.loads(x) for x in ask("get_imports", path=path)["result"]["content"]]
    assert {"path": path} in [json.loads(x) for x in ask("get_imported_by", path=src.path)["result"]["content"]]
    assert len(ask("changes_since", since=1)["result"]["content"]) == 1
    assert ask("nothing")["error"]["code"] == ask("search")["error"]["code"] == ask("search", x=1)["error"]["code"] == -32602
    assert tools.answer(tables, {"id": 1, "method": "x"})["error"]["code"] == -32601 and len(tools.answer(tables, {"method": "tools/list"})["result"]["tools"]) == 16
    for name in ("complexity", "coupling", "literal_scan", "duplication"):
        assert tools.call(tables, "analyze", analysis=name).columns
    with pytest.raises(ValueError):
        tools.call(tables, "analyze", analysis="none")


def test_index_workspace(spark, tmp_path):
    root = tmp_path / "ws"
    (root / "src").mkdir(parents=True)
    (root / "src/a.py").write_text("import b\n\ndef f():\n    return 1\n")
    (root / "src/b.py").write_text("x = 1\n")
    t = tools.index_workspace(spark, str(root), str(tmp_path / "snap"))
    assert t["files"].count() == 2 and t["symbols"].where("name = 'f'").count() == 1 and t["edges"].count() == 1
    assert tools.content(spark, t["files"], str(root), "src/a.py").first().content.startswith("import b")
    assert tools.content(spark, t["files"].limit(0), str(root), "src/b.py").first().content == "x = 1\n"
    for bad in ("/", "/home/someone"):
        with pytest.raises(ValueError):
            tools.index_workspace(spark, bad, str(tmp_path / "snap"))


def test_saved_postings(spark, tmp_path):
    f = tree(spark, ("a.txt", "one été two"), ("b.txt", "éa\nabc"), ("c.txt", "\U0001d11ex\U0001d11e\n\nab\ncd"), ("d.txt", ""))
    index.save_postings(index.trigram_postings(f), str(tmp_path / "t"))
    p = index.load_postings(spark, str(tmp_path / "t"))
    assert {(r.file_id, r.trigram) for r in p.collect()} == {(i, t[k : k + 3]) for i, text in enumerate(["one été two", "éa\nabc", "\U0001d11ex\U0001d11e\n\nab\ncd", ""]) for t in text.split("\n") for k in range(len(t) - 2)}
    assert [r.path for r in search.search(f, "été", postings=p).collect()] == ["a.txt"]
    assert [r.path for r in search.search(f, "éa", postings=p).collect()] == ["b.txt"] == [r.path for r in search.search(f, "éa").collect()]
    assert search.search(f, "nowhere", postings=p).count() == 0
    sizes = {r.trigram: r.files for r in index.trigram_sizes(f.union(f)).collect()}
    assert sizes["abc"] == 2 and sizes["\U0001d11ex\U0001d11e"] == 2 and "cd" not in sizes


def test_specifiers(spark):
    f = tree(spark, ("c/a.c", '#include <stdio.h>\n#include "b.h"\n#include "sys.h"\n'), ("c/b.h", ""), ("c/stdio.h", ""), ("m/Makefile", "include a.mk b.mk # c.mk\n-include c.mk\n"), ("m/a.mk", ""), ("m/b.mk", ""), ("m/c.mk", ""))
    got = [(r.path, r.spec, r.system) for r in imports.specs(f).orderBy("path", "ord").collect()]
    assert got == [("c/a.c", "stdio.h", True), ("c/a.c", "b.h", False), ("c/a.c", "sys.h", False), ("m/Makefile", "a.mk", False), ("m/Makefile", "b.mk", False), ("m/Makefile", "c.mk", False)]
    assert sorted((r.src, r.dst) for r in imports.edges(f).collect()) == [(0, 1), (3, 4), (3, 5), (3, 6)]


def test_plans_of_a_change(spark):
    lines = tree(spark, ("a.py", 'u = "http://localhost:5432/x"\nv = "https://a.b" # TODO\np = "/home/x"\n\n' + "z" * 2001 + " TODO\n"))
    assert tuple(analyses.literal_counts(lines).first()) == ("a.py", 1, 1, 1, 1, 1)
    many = spark.createDataFrame([("n", f"p{k:02d}") for k in range(30)], "name string, path string")
    assert analyses.smallest(many, ["name"], "path", 3).first()["first"] == ["p00", "p01", "p02"]
    edges = spark.createDataFrame([(a, b) for a, b in [(0, 1), (1, 0), (1, 2), (2, 3), (3, 4), (4, 2)]], "src long, dst long")
    nodes = spark.createDataFrame([(i, f"f{i}") for i in range(5)], "file_id long, path string")
    assert [tuple(r) for r in graph.cycle_groups(edges, nodes).collect()] == [(2, 3, "f2,f3,f4"), (0, 2, "f0,f1")]
