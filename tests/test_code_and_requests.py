"""Program text, table functions, requests by name, quarantine and copies as files."""

import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tagweave.engine import Engine
from tagweave.functions import code, sql
from tagweave.functions import text as tx
from tagweave.requests import Requests
from tagweave.sources import files

PYTHON = '''import os

# about f
@decorated
def f(a,
      b):
    """def not_me(): {"""
    def inner():
        return "}"
    return inner

class C(Base):

    async def n(self): pass
y = f(1)
'''
RUST = """/// doc
pub struct S<'a> { x: &'a str }

impl<'a> S<'a> {
    pub fn new(x: &'a str) -> Self { /* } */
        S { x } // }
    }
    fn c() -> char { '{' }
}
fn main()
where
    T: X,
{
    println!("}}");
}
const A: i32 = 1;
"""
SCRIPT = """export default class K {
  get(a) { return `}${a}`; }
}
function go(x) {
  if (x) { return '}'; }
}
go(1);
"""
GO = """package main

// add adds
func (s *T) add(a, b int) int {
\treturn a + b
}

type P struct {
\tx int
}
"""


def told(text, extension):
    made = code.atoms(text, extension)
    return [(a.kind, a.name, a.level, None if a.parent is None else made[a.parent].name) for a in made]


def test_definitions_of_several_languages():
    assert told(PYTHON, "py") == [("text", None, 0, None), ("def", "f", 0, None), ("def", "inner", 1, "f"), ("class", "C", 0, None), ("def", "n", 1, "C"), ("text", None, 0, None)]
    assert told(RUST, "rs") == [("struct", "S", 0, None), ("text", None, 0, None), ("impl", "S", 0, None), ("fn", "new", 1, "S"), ("fn", "c", 1, "S"), ("fn", "main", 0, None), ("text", None, 0, None)]
    assert told(SCRIPT, "js") == [("class", "K", 0, None), ("function", "go", 0, None), ("text", None, 0, None)]
    assert [k for k, *_ in told(GO, "go")] == ["text", "func", "text"]
    cut = {a.name: PYTHON[a.start : a.end] for a in code.atoms(PYTHON, "py") if a.name}
    assert cut["f"].startswith("# about f\n@decorated\ndef f(a,") and cut["f"].endswith("return inner\n\n") and cut["inner"] == '    def inner():\n        return "}"\n'


def test_atoms_cover_any_text():
    draw = random.Random(5)
    for k in range(300):
        text = "".join(draw.choices(["def f():\n", "fn g() {\n", "}\n", "    ", "\n", '"', "'", "// x\n", "/*", "*/", "class A:", "(", ")", "é", "{", '"""', "# c\n", "x = 1\n"], k=draw.randrange(0, 60)))
        made = code.atoms(text, draw.choice(["py", "rs", ""]))
        assert "".join(text[a.start : a.end] for a in made if a.level == 0) == text
        for k, a in enumerate(made):
            assert a.start < a.end and (a.parent is None) == (a.level == 0)
            if a.parent is not None:
                p = made[a.parent]
                assert a.parent < k and p.level == a.level - 1 and p.start <= a.start and a.end <= p.end


def test_scanning_is_linear():
    begin = time.perf_counter()
    for text in (PYTHON * 2000, "{" * 200_000, "# c\n" * 50_000 + "def f(): pass\n", "class A:\n" + "    def m(self): pass\n" * 20_000, '"' * 100_001):
        code.atoms(text, "py")
    assert time.perf_counter() - begin < 20


def test_code_atoms_of_a_table(spark):
    df = spark.createDataFrame([(1, PYTHON, "a/b.py"), (2, RUST, "c.rs"), (3, None, None), (4, "", "x.py")], "doc_id long, text string, path string")
    got = code.code_atoms(df, path_col="path").collect()
    assert {r.doc_id for r in got} == {1, 2}
    for r in got:
        text = {1: PYTHON, 2: RUST}[r.doc_id]
        assert r.content == text[r.char_start : r.char_end]
    assert code.code_atoms(df.limit(0)).isEmpty()


def test_table_functions_equal_column_functions(spark, sf):
    sql.register(spark)
    talks = spark.read.parquet(f"{sf}/conversations.parquet").filter("conv_id < 40").groupBy("conv_id").agg(F.array_join(F.collect_list(F.concat(F.lit("## "), "role", F.lit("\n"), "text")), "\n\n").alias("text"))
    talks = talks.unionByName(spark.createDataFrame([(-1, ""), (-2, None), (-3, "\n\n\na\n\n"), (-4, "no header\n# One\n#### no\n## Two")], "conv_id long, text string"))
    talks.createOrReplaceTempView("talks")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(spark.sql("SELECT conv_id, t.* FROM talks, LATERAL tw_atoms(text) t")) == rows(tx.atoms(spark.table("talks"), "conv_id", "text"))
    assert rows(spark.sql("SELECT conv_id, seq, coalesce(header, '-'), content FROM talks, LATERAL tw_molecules(text)")) == rows(tx.molecules(spark.table("talks"), "conv_id", "text").withColumn("header", F.coalesce("header", F.lit("-"))))
    assert spark.sql("SELECT t.name FROM VALUES ('def f():\n  pass\n') v(x), LATERAL tw_code_atoms(x, 'py') t").first().name == "f"


@pytest.fixture(scope="module")
def requests(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('requests')}")
    rows = [("rust.md", "Rust is a systems language. #rust"), ("b/c.md", "memory and #rust\n\nlines")]
    e.ingest_documents(files.inline(spark.createDataFrame(rows, "name string, content string"), F.lit(datetime(2024, 1, 1)).cast("timestamp")))
    return Requests(e)


def ask(requests, method, **params):
    out = requests.answer({"jsonrpc": "2.0", "id": 7, "method": method, "params": params})
    assert out["id"] == 7 and out["jsonrpc"] == "2.0"
    return out.get("result", out.get("error"))


def test_requests_answer(requests):
    assert ask(requests, "get_stats")["sources"] == 2 and ask(requests, "health")["status"] == "ok"
    assert ask(requests, "query", query="rust", max_results=5)["planets"] == 2
    assert len(ask(requests, "match", query='"systems language" OR mem*')) == 2
    assert ask(requests, "illuminate", seed="#rust")["total"] >= 2 and ask(requests, "read_file", path="inline:b/c.md", start_line=2)["content"] == "lines"
    assert ask(requests, "add_path", path="/x") == {"added": True} and ask(requests, "list_paths") == {"paths": ["/x"]} and ask(requests, "remove_path", path="/x") == {"removed": True}
    assert ask(requests, "track_repository", url="https://github.com/o/r/tree/main")["ref"] == "main" and len(ask(requests, "list_repositories")) == 1


def test_requests_tell_errors(requests):
    code_of = lambda out: out["error"]["code"]
    assert code_of(requests.answer("{not json")) == -32700 and code_of(requests.answer("[1]")) == -32600 and code_of(requests.answer({"method": "health"})) == -32600
    assert ask(requests, "none")["code"] == -32601
    for params in ({}, {"query": 3}, {"query": "x", "other": 1}, {"query": "x", "max_results": True}):
        assert ask(requests, "query", **params)["code"] == -32602
    assert code_of(requests.answer({"jsonrpc": "2.0", "method": "query", "params": [1]})) == -32602
    assert ask(requests, "read_file", path="absent")["code"] == -32000 and ask(requests, "match", query="(a")["code"] == -32000 and ask(requests, "track_repository", url="?")["code"] == -32000
    assert ask(requests, "ingest_file", path="/there/is/none")["code"] == -32603


def test_quarantine(requests):
    assert ask(requests, "quarantine", source_id="src_b_c.md", reason="looks wrong") is None
    held = ask(requests, "list_quarantine")
    assert [(r["source_id"], r["reason"]) for r in held] == [("src_b_c.md", "looks wrong")] and ask(requests, "get_stats")["sources"] == 1
    assert ask(requests, "match", query="memory") == [] and ask(requests, "quarantine", source_id="src_b_c.md")["code"] == -32000
    assert ask(requests, "restore", source_id="src_b_c.md") is None and ask(requests, "list_quarantine") == [] and len(ask(requests, "match", query="memory")) == 1
    assert ask(requests, "restore", source_id="src_b_c.md")["code"] == -32000


def test_copies_are_files(spark, tmp_path):
    rows = [("a/b.md", "inside"), ("c.md", "é\n"), ("../../out.md", "stays below"), ("none", None)]
    df = spark.createDataFrame(rows, "name string, content string")
    for _ in range(2):
        files.write_copies(df, f"file://{tmp_path}/copies")
    held = {str(p.relative_to(tmp_path / "copies")): p.read_text() for p in (tmp_path / "copies").rglob("*") if p.is_file()}
    assert held == {"a/b.md": "inside", "c.md": "é\n", "out.md": "stays below", "none": ""}
    files.write_copies(df.filter("name = 'c.md'").withColumn("content", F.lit("new")), f"{tmp_path}/copies")
    assert (tmp_path / "copies/c.md").read_text() == "new"
