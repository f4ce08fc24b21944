"""Definitions of operators that SQL doesn't state, on small cases and random texts."""

import hashlib
import json
import random
from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import config, providers, reports
from lodestone import __main__ as cli
from lodestone.functions import text as T
from lodestone.operators import analytics as A
from lodestone.operators import chunking as C
from lodestone.operators import cite, codeblocks, compress, fusion
from lodestone.operators import dense as D
from lodestone.operators import jsontext as N
from lodestone.operators.index import SparseIndex
from lodestone.pipeline import Engine
from lodestone.sources import store as K


# --- chunkers


def test_fixed_windows():
    text = "x" * 90 + " " + "y" * 700
    assert list(C.spans(text, compat=True)) == [(0, 91), (41, 91), (41, 91), (91, 603), (553, 791)]
    assert list(C.spans(text)) == [(0, 91), (41, 91), (91, 603), (553, 791)]
    assert C.fixed("a" * 512) == ["a" * 512] and len(C.fixed("a" * 513)) == 2 and C.fixed("") == [""]


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=400), st.integers(20, 80), st.integers(0, 19))
def test_windows_cover_and_advance(text, size, overlap):
    spans = list(C.spans(text, size, overlap))
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a < c <= b < d for (a, b), (c, d) in zip(spans, spans[1:], strict=False))


def test_prose_and_markdown_and_code():
    assert C.prose("one\n\ntwo") == ["one\n\ntwo"]
    a, b = "a" * 500, "b" * 400
    assert C.prose(f"{a}\n\nsmall\n\n{b}") == [f"{a}\n\nsmall", f"small\n\n{b}"]
    long = " ".join(f"Sentence number {k} is here." for k in range(100))
    assert all(len(c) < 1100 for c in C.prose(long)) and " ".join(C.prose(long)).count("number 50 ") >= 1
    text = "# Head\n\n" + "x" * 700 + "\n\n## Next\n\ny"
    assert C.markdown(text) == ["# Head\n\n" + "x" * 700, "## Next\n\ny"]
    cut = C.markdown("intro " * 60 + "\n# H\n" + "z" * 790 + "\n## I\n")
    assert cut[0].startswith("intro") and cut[1] == "# H\n\n" + "z" * 790
    assert C.code("x = 1\ndef f():\n  pass\n\ndef g():\n  pass\n") == ["def f():\n  pass\n\ndef g():\n  pass"]
    assert C.code("no\ndefinitions") == ["no\ndefinitions"]
    assert C.lines("a\nb\nc", 4) == ["a\nb", "c"]


def test_sections_of_repositories():
    asked = "**What is it?**\n\nA long enough answer here.\n\n**Why so?**\n\nBecause of something else.\n"
    assert [k for k, _ in C.sections(asked)] == ["qa", "qa"]
    body = "w" * 60
    assert C.sections(f"lost\n# A\n{body}\n## B\nshort") == [("section", f"# A\n\n{body}")]
    assert C.sections(body) == [("section", body)]
    assert C.sections("short") == []


def test_code_blocks():
    source = "import os\n\nclass A:\n    def f(self):\n        return 1\n\ndef g():\n    return 2\n"
    assert [(b.block_type, b.block_name, b.start_line) for b in codeblocks.blocks(source, "python")] == [("imports", None, None), ("class", "A", 2), ("function", "g", 6), ("method", "A.f", 3)]
    assert [b.block_type for b in codeblocks.blocks("def broken(:\n  x\ndef h():\n  y", "python")] == ["function", "function"]
    js = "import x from 'y';\nexport function go(a) {\n  return a;\n}\nconst f = (a) => {\n  return 1;\n}\n"
    assert [(b.block_type, b.block_name) for b in codeblocks.blocks(js, "javascript")] == [("imports", None), ("function", "go"), ("function", "f")]
    go = "import \"fmt\"\nfunc (s *S) Run() {\n}\ntype S struct {\n}\n"
    assert [b.block_name for b in codeblocks.blocks(go, "go")] == [None, "Run", "S"]
    java = "import a.b;\npublic final class A {\n  // }\n  private static List<String> names(int n) throws X {\n    String s = \"}\"; char c = '}';\n    if (n > 0) {\n      return null;\n    }\n  }\n  int x = f(1);\n}\nclass B {}\n"
    assert [(b.block_type, b.block_name, b.start_line, b.end_line) for b in codeblocks.blocks(java, "java")] == [("imports", None, None, None), ("class", "A", 1, 11), ("method", "names", 3, 9), ("class", "B", 11, 12)]
    rust = "use a::b;\npub(crate) async fn run<'a>(x: &'a str) {\n  /* { */ let s = \"{\";\n}\nimpl<T> Show for Thing<T> {\n}\npub struct Unit;\nstruct P {\n  x: i32,\n}\n"
    assert [(b.block_type, b.block_name, b.start_line, b.end_line) for b in codeblocks.blocks(rust, "rust")] == [("imports", None, None, None), ("function", "run", 1, 4), ("impl", "Thing", 4, 6), ("struct", "Unit", 6, 7), ("struct", "P", 7, 10)]
    more = "export default class C extends D {\n}\nconst g = async (a, b) => a + b;\nlet h = 5;\nfunction* k() {\n  return `}\n`;\n}\n"
    assert [(b.block_name, b.start_line, b.end_line) for b in codeblocks.blocks(more, "typescript")] == [("C", 0, 2), ("g", 2, 3), ("k", 4, 8)]
    assert codeblocks.blocks("plain", "unknown")[0].block_type == "file"
    big = "def f():\n" + "    x = 1\n" * 400
    parts = codeblocks.chunks("import os\n" + big, "python")
    assert parts[0].block_name == "f_part0" and len(parts) == 3 and parts[0].imports == "import os"


def test_chunk_tables(spark):
    docs = spark.createDataFrame([(1, "# T\n\n" + "w " * 200), (2, None), (3, ""), (4, "short")], "doc_id long, text string")
    assert {r["doc_id"] for r in C.chunks(docs, C.fixed).collect()} == {1, 3, 4}
    kinds = {(r["doc_id"], r["chunk_type"]) for r in C.semantic_chunks(docs).collect()}
    assert kinds == {(1, "section"), (4, "full_document")}
    files = spark.createDataFrame([("a.py", "import os\n\ndef f():\n    return 1\n"), ("b.bin", None)], "path string, text string")
    row = C.code_chunks(files).first()
    assert row["language"] == "python" and row["indexable"].startswith("File: a.py | combined: f | Language: python\n\nImports:\nimport os\n\nCode:\n")
    tree = C.hierarchical(docs, size=100, overlap=10)
    rows = tree.collect()
    parents = {r["doc_id"]: r["content"] for r in rows if r["doc_level"] == "parent"}
    assert len(parents) == 3
    for r in rows:
        if r["doc_level"] == "child":
            assert r["content"] in parents[r["parent_id"]] and 0 <= r["child_index"] < r["child_total"]


# --- JSON


def test_flat_json():
    value = {"a": {"b": 1, "c": [1, None, True], "d": [{"x": 1}, 2]}, "e": [], "f": "t"}
    assert N.flatten(value).split("\n") == ["a.b: 1", "a.c: [1, None, True]", "a.d[0].x: 1", "a.d[1]: 2", "e: []", "f: t"]
    deep = {}
    for _ in range(12):
        deep = {"k": deep}
    assert N.flatten(deep).endswith("[max depth exceeded]")
    assert N.flatten(5) == "5"


def test_json_strategies(spark):
    assert N.strategy({"Time": 1, "msg": "x"}) == "logs"
    assert N.strategy({"body": "x" * 101}) == "semantic" and N.strategy({"body": "x" * 100}) == "flatten"
    assert N.strategy([{}, {}, {}]) == "records" and N.strategy([{}, {}]) == "flatten"
    content, meta, title = next(N.parsed({"name": "N", "text": "y" * 30, "id": 4, "n": 2}, "semantic"))
    assert (content, title) == ("Title: N\n\nText: " + "y" * 30, "N") and meta["id"] == 4 and meta["json_n"] == 2
    records = list(N.parsed({"rows": [{"a": 1}, {"a": 2}, 3]}, "records"))
    assert [m["record_index"] for _, m, _ in records] == [0, 1] and records[0][1]["parent_key"] == "rows"
    docs = spark.createDataFrame([(1, '{"level": "E", "time": 5, "msg": "m", "x": {"y": 1}}'), (2, "{bad"), (3, None)], "doc_id long, json string")
    rows = N.json_chunks(docs).collect()
    assert [(r["doc_id"], r["content"]) for r in rows] == [(1, '[5] | [E] | m | x: {"y": 1}')]


def test_json_lines_stop_after_eleven_errors(spark):
    lines = ['{"a": 1}', "", *["{bad"] * 10, '{"a": 2}', "{bad", '{"a": 3}']
    df = spark.createDataFrame([("f", k, t) for k, t in enumerate(lines)], "path string, line int, text string")
    found = {r["line"]: json.loads(r["meta"]) for r in N.json_lines(df).collect()}
    assert set(found) == {0, 12} and found[12]["line_index"] == 12


def test_json_of_replies():
    assert N.reply_json('x\n```json\n{"a": [1, 2,],}\n```') == {"a": [1, 2]}
    assert N.reply_json('{"a": [1, {"b": "c') == {"a": [1, {"b": "c"}]}
    assert N.reply_json('[1, 2] and more') == [1, 2] and N.reply_json("none") is None
    assert N.reply_json('{\n// note\n"a": "//b"}') == {"a": "//b"}


# --- text and URLs


def test_urls(spark):
    base = "http://h.example/a/b/c?q=1"
    links = ["g", "./g", "../g", "../../g", "../../../g", "/g", "//o.example/x", "?y", "#s", "g?y#s", "http://o.example:80/", "g/./h", "", ".", "..", "g;x"]
    df = spark.createDataFrame([(x,) for x in links], "link string")
    for r in df.select("link", T.resolve(F.lit(base), F.col("link")).alias("url")).collect():
        assert r["url"] == urljoin(base, r["link"]), r["link"]
    normal = {"HTTP://A.Example:80/x/?b=2&a=1#f": "http://a.example/x?a=1&b=2", "https://h.example:80/a/": "https://h.example:80/a", "https://h.example:443": "https://h.example/", "/rel/?b=1": "/rel?b=1", "http://h.example/": "http://h.example/"}
    df = spark.createDataFrame(list(normal.items()), "url string, wanted string")
    for r in df.select("wanted", T.url_normal(F.col("url")).alias("got")).collect():
        assert r["got"] == r["wanted"]
    repos = {"https://github.com/o/r.git": ("o", "r", "main"), "https://github.com/o/r/tree/dev/x": ("o", "r", "dev"), "https://other.example/o/r": None}
    df = spark.createDataFrame([(x,) for x in repos], "url string")
    assert {r["url"]: r["r"] and tuple(r["r"]) for r in df.select("url", T.repository(F.col("url")).alias("r")).collect()} == repos
    blob = spark.createDataFrame([("https://github.com/o/r/blob/main/p/f.md",)], "u string")
    assert blob.select(T.raw_url(F.col("u"))).first()[0] == "https://raw.githubusercontent.com/o/r/main/p/f.md"


def test_text_functions(spark):
    rows = [("What is Spark?", True, "factual_is"), ("a\u00a0b c", True, "short_query"), ("one two three four five six seven eight nine ten eleven", False, "long_query"), ("how to build an expanding thing here now", False, "wh_question")]
    df = spark.createDataFrame(rows, "q string, simple boolean, pattern string")
    for r in df.select("simple", "pattern", T.simple_query(F.col("q")).alias("s"), T.query_pattern(F.col("q")).alias("p")).collect():
        assert (r["s"], r["p"]) == (r["simple"], r["pattern"])
    kinds = [("see Figure 1", "technical"), ("WHEREAS x", "legal"), ("# T", "markdown"), ("import x", "code"), ("Title line:\n", "structured"), ("plain", "prose")]
    df = spark.createDataFrame(kinds, "t string, k string")
    assert all(r["k"] == r["d"] for r in df.select("k", T.document_type(F.col("t")).alias("d")).collect())
    page = "<title> A &amp; B</title><SCRIPT>x<y</script>a<!-- <b> -->b<p>c&nbsp;&lt;d</p>"
    r = spark.createDataFrame([(page,)], "h string").select(T.html_text(F.col("h")), T.html_title(F.col("h"))).first()
    assert (r[0], r[1]) == ("A & B ab c <d", "A &amp; B")
    names = spark.range(1).select(T.language_name(F.lit("de")), T.language_name(F.lit("xx")), T.latency_label(F.lit(None).cast("double")), T.latency_label(F.lit(1500.0)), T.citation_marker(F.array(F.lit(1), F.lit(2)), "enterprise")).first()
    assert tuple(names) == ("German", "XX", "N/A", "1.50s", " {ref:1,2}")


# --- retrieval, fusion, vectors


def test_dense_leaves_out_what_it_cant_compare(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0]), (4, [None, 1.0]), (5, None), (6, [0.0, 0.0])]
    v = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["doc_id"], r["score"]) for r in D.dense(v, q).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0), (6, 0.0)]
    assert D.dense(v, q.where("false")).count() == 0
    s = spark.range(1).select(*[D.similarity(F.lit(0.25), m) for m in ("cosine", "l2", "ip")]).first()
    assert tuple(s) == (0.75, 0.8, -0.25)


def test_auto_merge_by_query_and_length(spark):
    rows = [(1, "c1", "p", 0.5), (1, "c2", "p", 0.9), (2, "c1", "p", 0.4), (3, "d1", "long", 0.3), (3, "d2", "long", 0.2)]
    children = spark.createDataFrame(rows, "query_id int, doc_id string, parent_id string, score double")
    parents = spark.createDataFrame([("p", 10), ("long", 50_001)], "parent_id string, length int")
    found = {(r["query_id"], r["doc_id"], r["score"]) for r in fusion.auto_merge(children, parents, k=1).collect()}
    assert found == {(1, "p", 0.9), (2, "c1", 0.4), (3, "d1", 0.3)}
    fused = fusion.append_missing(spark.createDataFrame([(1, "a", 0.1)], "query_id int, doc_id string, score double"), spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, doc_id string"))
    assert {(r["doc_id"], r["score"]) for r in fused.collect()} == {("a", 0.1), ("b", 0.7)}


def test_index_changes(spark, tmp_path):
    index = SparseIndex(spark, str(tmp_path / "index"))
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple apple"), (3, "blue sky"), (4, "- !"), (None, "x y")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "apple apple"), (8, "absent"), (7, None)], "query_id long, text string")
    assert index.search(q).count() == 0
    assert index.add(docs) == 3 and index.add(docs) == 0
    assert [r["doc_id"] for r in index.search(q).orderBy("rank").collect()] == [2, 1]
    assert index.remove(docs.where("doc_id = 2")) == 1 and index.remove(docs.where("doc_id = 2")) == 0
    assert [r["doc_id"] for r in index.search(q).collect()] == [1]
    assert index.add(docs.where("doc_id = 2")) == 1 and index.stats()["documents"] == 3
    before = index.search(q).collect()
    index.compact()
    assert index.search(q).collect() == before
    assert index.sync(docs.where("doc_id < 2")) == (0, 2) and index.documents().count() == 1
    again = SparseIndex(spark, str(tmp_path / "index"))
    assert again.stats()["documents"] == 1
    again.clear()
    assert again.stats() == {"documents": 0, "avgdl": 0.0, "terms": 0}
    with pytest.raises(RuntimeError):
        number, state = again._manifest()
        again._commit(number - 1, state)


# --- store


def test_store(spark, tmp_path):
    store = K.ChunkStore(spark, str(tmp_path / "store"), longest=10)
    assert store.count() == 0 and store.healthy()
    store.upsert_documents(spark.createDataFrame([("a", "x" * 20), ("b", "short")], "doc_id string, content string"))
    rows = spark.createDataFrame([("b", "one", 1, [1.0]), ("b", "two", 2, [2.0]), ("c_1", "c", 1, [0.0])], "doc_id string, content string, seq int, embedding array<float>")
    store.upsert(rows, [F.desc("seq")])
    found = {r["doc_id"]: r for r in store.chunks().collect()}
    assert found["a"]["content"] == "x" * 10 and found["a"]["meta"] == {"truncated": "true"} and found["a"]["doc_level"] == "parent"
    assert found["b"]["content"] == "two" and found["b"]["doc_level"] == "child" and found["b"]["language_code"] == "en"
    assert [r[0] for r in store.ids("c_*").collect()] == ["c_1"] and store.ids(embedded=True).count() == 2
    assert store.get("a").count() == 1 and store.get("zz").count() == 0
    asked = spark.createDataFrame([("a",), ("b",), ("q",)], "doc_id string")
    assert {(r[0], r[1]) for r in store.embedded(asked).collect()} == {("a", False), ("b", True), ("q", False)}
    assert store.lookup(asked).count() == 2
    store.remove(asked)
    assert store.info()["documents"] == 1
    assert not store.clear() and store.count() == 1 and store.clear(confirm=True) and store.count() == 0


def test_upsert_keeps_the_last_of_new(spark):
    old = spark.createDataFrame([(1, "old", 0), (2, "old", 0)], "id int, v string, seq int")
    new = spark.createDataFrame([(2, "first", 1), (2, "last", 2), (3, "new", 1)], "id int, v string, seq int")
    assert {(r["id"], r["v"]) for r in K.upsert(old, new, ["id"], [F.desc("seq")]).collect()} == {(1, "old"), (2, "last"), (3, "new")}
    ids = spark.createDataFrame([(None,), ("",)], "t string").select(K.content_id(F.col("t"))).collect()
    assert ids[0][0] is None and ids[1][0] is not None


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"Hello  \xff world\n")
    (tmp_path / "sub" / "p.html").write_text("<p>Hi</p>")
    (tmp_path / ".hidden.txt").write_text("no")
    (tmp_path / "empty.md").write_text(" \n")
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}')
    found = {r["source_path"].rsplit("/", 1)[1]: r["content"] for r in K.read_files(spark, [str(tmp_path)]).collect()}
    assert found == {"a.txt": "Hello \ufffd world", "p.html": "Hi"}
    assert {r["kind"] for r in K.list_files(spark, [str(tmp_path)]).collect()} == {"text", "html", "jsonl"}
    assert K.read_lines(spark, [str(tmp_path / "l.jsonl")]).count() == 2


# --- folds


def windows_of(duration, scenes, size=10.0, overlap=2.0):
    """By a loop."""
    step = size - overlap if size > overlap else size
    grid = []
    while duration > 0 and (not grid or grid[-1][1] < duration):
        grid.append((len(grid) * step, len(grid) * step + size))
    for scene in sorted(s for s in scenes or [] if s is not None):
        grid = [w for a, b in grid for w in ([(a, scene), (max(scene - overlap, a), b)] if scene - a > overlap and b - scene > overlap else [(a, b)])]
    return [(max(0.0, a), min(b, duration)) for a, b in grid if min(b, duration) - max(0.0, a) >= overlap]


def test_scene_windows(spark):
    assert windows_of(30.0, []) == [(0.0, 10.0), (8.0, 18.0), (16.0, 26.0), (24.0, 30.0)] and windows_of(10.0, [5.0]) == [(0.0, 5.0), (3.0, 10.0)]
    rng = random.Random(3)
    rows = [(0, 30.0, []), (1, 10.0, [5.0]), (2, 10.0, [1.0, 9.0]), (3, 0.0, [1.0]), (4, None, [1.0]), (5, 12.0, None), (6, 25.0, [None, 12.5]), (7, 10.0, [4.0, 4.0, 7.0])]
    rows += [(i, rng.randint(0, 400) / 4, [rng.randint(0, 440) / 4 for _ in range(rng.randint(0, 12))]) for i in range(8, 150)]
    df = spark.createDataFrame(rows, "id int, duration double, scenes array<double>")
    for size, overlap in ((10.0, 2.0), (3.0, 4.0), (7.5, 0.25)):
        found = {}
        for r in A.scene_windows(df, "id", size, overlap).orderBy("id", "window_no").collect():
            found.setdefault(r["id"], []).append((r["start"], r["stop"]))
        assert found == {i: w for i, d, s in rows if d and (w := windows_of(d, s, size, overlap))}
    assert A.scene_windows(df.where("id >= 100"), "id", most=3).groupBy("id").count().agg(F.max("count")).first()[0] == 3


def test_chapters_and_cooldown(spark):
    rows = [(1, k, float(s), float(s + 5)) for k, s in enumerate([0, 100, 250, 400, 900])]
    df = spark.createDataFrame(rows, "user_id long, event_id long, start double, stop double")
    assert [r["chapter"] for r in A.chapters(df, "user_id", 200).orderBy("event_id").collect()] == [1, 1, 1, 1, 2]
    assert [r["chapter"] for r in A.chapters(df, "user_id", 200, 300).orderBy("event_id").collect()] == [1, 1, 1, 2, 3]
    kept = A.cooled(df.select("user_id", F.col("start").alias("at")), "user_id", 150.0)
    assert sorted(r["at"] for r in kept.collect()) == [0.0, 250.0, 400.0, 900.0]
    frames = spark.createDataFrame([(1, 0.0, [0, 0]), (1, 1.0, [10, 0]), (1, 2.0, [10, 1])], "k int, at double, pixels array<int>")
    assert [(r["at"], r["difference"]) for r in A.changes(frames, "k", 1.0).collect()] == [(1.0, 5.0)]


def test_transcript_chunks(spark):
    rows = [("v", 1, 0.0, 30.0, "a", "en"), ("v", 2, 30.0, 50.0, "b", "de"), ("v", 3, 50.0, 70.0, "c", "de"), ("v", 4, 110.0, 115.0, "d", "fr")]
    df = spark.createDataFrame(rows, "src string, event_id int, start double, stop double, text string, language string")
    found = [(r["window_no"], r["start"], r["stop"], r["content"], r["language"]) for r in A.transcript_chunks(df, "src").orderBy("window_no").collect()]
    assert found == [(0, 0.0, 60.0, "a b c", "de"), (1, 50.0, 110.0, "c", "de"), (2, 100.0, 115.0, "d", "fr")]


# --- compression and citations


def test_distinct_results_and_clusters(spark):
    texts = ["the red fox jumps", "the red fox jumps high", "something else here", "the red fox"]
    df = spark.createDataFrame([(1, k + 1, k, t) for k, t in enumerate(texts)], "query_id int, rank int, doc_id int, content string")
    assert sorted(r["doc_id"] for r in compress.distinct_results(df, 0.7).collect()) == [0, 2]
    rows = [(1, k + 1, k, v) for k, v in enumerate([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [1.0, 0.05], [1.0, 0.01]])]
    v = spark.createDataFrame(rows, "query_id int, rank int, doc_id int, embedding array<double>")
    found = {r["doc_id"]: r["cluster"] for r in compress.clusters(v).collect()}
    assert found == {0: 1, 1: 1, 2: 3, 3: 1, 4: 5}
    joined = compress.merged(compress.clusters(v).join(df.select("doc_id", "content"), "doc_id", "left").fillna("-")).collect()
    assert sorted(r["n"] for r in joined) == [1, 1, 3]


def test_similar_pairs_equal_a_loop(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.sample("abcdefghijklmnop", rng.randint(1, 12))) for _ in range(120)]
    texts += [texts[0], texts[1] + " q", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set((t or "").split()) for t in texts]
    wanted = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) > 0.6}
    pairs = [(r["a"], r["b"]) for r in compress.similar_pairs(df, 0.6).collect()]
    # equal sets meet as one: their pairs are those of the least id
    first = {i: min(j for j, s in enumerate(sets) if s == sets[i]) for i in range(len(sets))}
    assert {(min(first[a], first[b]), max(first[a], first[b])) for a, b in wanted if first[a] != first[b]} == {p for p in pairs if first[p[1]] == p[1]}
    assert {p for p in pairs if first[p[1]] != p[1]} == {(first[i], i) for i in range(len(sets)) if first[i] != i and sets[i]}


def test_markers():
    answer = "Spark is fast. It scales well! Nothing else"
    assert cite.insert_markers(answer, [("Spark is fast", [1, 2]), ("absent", [3]), ("Nothing else", [4])]) == "Spark is fast. [1, 2] It scales well! Nothing else [4]"
    assert cite.insert_markers(answer, [("It scales well!", [1, 2, 3, 4])], "footnote") == "Spark is fast. It scales well!^[1,2,3] Nothing else"


def test_sentences_match_what_stands_late_in_a_source(spark):
    results = spark.createDataFrame([(1, 7, "filler " * 100 + "granite quarry", 0.9), (1, 8, "granite", 0.8)], "query_id long, doc_id long, content string, score double")
    sentences = spark.createDataFrame([(1, 1, "The granite quarry.")], "query_id long, sentence_no long, sentence string")
    found = cite.match(sentences, cite.sources(results)).select("sentence_no", "number", "overlap").collect()
    assert [tuple(r) for r in found] == [(1, 1, 2)]


def test_all_sentences_of_long_answers(spark, tmp_path):
    from lodestone.plans import library

    text = " ".join(f"Sentence number {k} ends here." for k in range(45))
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = library._sentences(spark, str(tmp_path)).orderBy("sentence_no").collect()
    assert [(r["sentence_no"], r["sentence"]) for r in found] == [(k + 1, f"Sentence number {k} ends here.") for k in range(45)]


def test_audit_ids_tell_answers_of_one_beginning_apart(spark):
    df = spark.createDataFrame([("a" * 150 + "b", "2024-01-01"), ("a" * 150 + "c", "2024-01-01")], "answer string, at string")
    found = [r[0] for r in df.select(T.audit_id(F.col("answer"), F.col("at"))).collect()]
    assert found == [hashlib.sha256((x + "2024-01-01").encode()).hexdigest()[:16] for x in ("a" * 150 + "b", "a" * 150 + "c")]


# --- providers, settings, facade


def test_providers(spark):
    calls = []

    def shaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError
        return x

    assert providers.Retrying(shaky, wait=0)(5) == 5 and len(calls) == 3
    with pytest.raises(OSError):
        providers.Retrying(lambda: (_ for _ in ()).throw(OSError()), wait=0, final=lambda e: True)()
    import pandas as pd

    rated = providers.RatedByReply(lambda p: pd.Series(["score: 85 of 100", "none"]))
    assert rated(pd.Series(["q", "q"]), pd.Series(["a", None])).tolist() == [0.85, 0.0]
    df = spark.createDataFrame([(1, "der Hund und die Katze sind auf dem Weg"), (2, "the dog and the cat"), (3, ""), (4, None)], "doc_id long, text string")
    found = {r["doc_id"]: (r["language_code"], r["language_method"]) for r in providers.languages(df).collect()}
    assert found[1][0] == "de" and found[2] == ("en", "words") and found[3] == found[4] == ("en", "fallback")
    made = providers.translated(providers.languages(df), lambda s: s.str.upper())
    rows = {r["doc_id"]: r for r in made.collect()}
    assert rows[1]["was_translated"] and rows[1]["text"].startswith("DER HUND") and rows[2]["original"] is None
    registry = providers.Registry()
    registry.register("f", "text", ("x",))(len)
    assert registry.invoke("f", "abc") == 3 and registry.names(tag="x") == ["f"] and registry.by_category() == {"text": ["f"]}
    with pytest.raises(KeyError):
        registry.register("f")(len)
    assert registry.unregister("f") and not registry.unregister("f")


def test_reranked(spark):
    q = spark.createDataFrame([(1, "red fox")], "query_id long, text string")
    rows = spark.createDataFrame([(1, k, k, t) for k, t in enumerate(["a b", "red fox", "red", None], 1)], "query_id long, doc_id long, rank int, content string")
    found = providers.reranked(q, rows, providers.SharedWords(), 2).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in found] == [(2, 1.0), (3, 0.5)]


def test_settings(tmp_path, monkeypatch):
    file = tmp_path / "c.json"
    file.write_text('{"dense_k": 7, "hierarchical": "no"}')
    monkeypatch.setenv("LODESTONE_SPARSE_K", "3")
    c = config.load(str(file), "shipped")
    assert (c.dense_k, c.sparse_k, c.fused_k, c.hierarchical) == (7, 3, 10, False)
    file.write_text('{"no_such": 1}')
    with pytest.raises(ValueError):
        config.load(str(file))


def test_reports(tmp_path):
    hits = [{"doc_id": "a", "score": 0.9, "content": "<x>"}, {"doc_id": "b", "score": 0.5}, {"doc_id": "c", "score": 0.1}]
    assert reports.normal_scores([0.9, 0.5, 0.1]) == pytest.approx([100, 50, 0]) and reports.normal_scores([1, 1]) == [100, 100]
    for form in ("md", "html", "json", "txt"):
        reports.save(str(tmp_path / f"r.{form}"), "q?", "An answer", hits)
        assert "An answer" in (tmp_path / f"r.{form}").read_text()
    assert "&lt;x&gt;" in (tmp_path / "r.html").read_text()


def test_engine(spark, tmp_path):
    docs = spark.createDataFrame([("a.md", "Spark joins tables quickly. " * 40), ("b.md", "Llamas live in the Andes mountains. " * 40)], "source_path string, content string")
    engine = Engine(spark, str(tmp_path / "e"), config.Config(chunk_size=200, dimension=64))
    first = engine.ingest(docs)
    assert engine.ingest(docs)["chunks"] == first["chunks"] and first["indexed"] > 2
    q = spark.createDataFrame([(1, "llamas in mountains"), (2, "joins of tables")], "query_id long, text string")
    for mode in ("bm25", "dense", "hybrid"):
        best = {r["query_id"]: r["content"] for r in engine.search(q, mode).where("rank = 1").collect()}
        assert "Llamas" in best[1] and "Spark" in best[2]
    answers = {r["query_id"]: r for r in engine.query(q).collect()}
    assert "Llamas" in answers[1]["answer"] and answers[1]["bibliography"].startswith("[1] ")
    with pytest.raises(ValueError):
        engine.search(q, "other")
    assert not engine.clear() and engine.clear(confirm=True) and engine.stats()["index"]["documents"] == 0


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.md").write_text("# Title of this\n\nSome words about engines. " * 3)
    at = ["--folder", str(tmp_path / "s")]
    assert cli.main([*at, "ingest", str(tmp_path / "a.md")]) == 0
    assert cli.main([*at, "search", "engines", "--mode", "bm25", "--save", str(tmp_path / "r.md")]) == 0
    assert "engines" in (tmp_path / "r.md").read_text()
    cli.main([*at, "stats"])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["index"]["documents"] == 1
