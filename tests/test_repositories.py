"""Repository walks against a loop: cycles, relative paths, missing files, names of READMEs, caps."""

import posixpath
import random
import re

from lodestone.operators import repositories as G

SCHEMA = "repo string, path string, text string"


def loop(files, depth, most):
    """(repo, path, depth, found) by a queue a repository."""
    out = []
    for repo in {r for r, _, _ in files}:
        texts = {p: t for r, p, t in files if r == repo and t}
        root = next((n for n in ("README.md", "readme.md", "README.MD", "Readme.md") if n in texts), None)
        level, seen, n = [root] if root else [], set(), 0
        for d in range(depth + 1):
            following = set()
            for path in sorted(level):
                if path not in texts:
                    out.append((repo, path, d, False))
                    seen.add(path)
                elif n < most:
                    n += 1
                    out.append((repo, path, d, True))
                    seen.add(path)
                    for link in re.findall(r"\[[^\]]+\]\(([^)#]+\.md)(?:#[^)]+)?\)", texts[path]):
                        if "://" not in link:
                            following.add(posixpath.normpath(posixpath.join("/", posixpath.dirname(path), link)).lstrip("/"))
            level = following - seen
    return sorted(out)


def test_random_trees(spark):
    rng = random.Random(3)
    files = []
    for r in range(12):
        folders = ["", "docs/", "docs/deep/", "x/"]
        paths = [rng.choice(folders) + f"f{i}.md" for i in range(25)] + ["README.md" if r % 3 else "Readme.md"]
        for p in paths:
            links = ["".join(rng.choice(["", "../", "./", "/", "docs/", "deep/", "../x/"]) for _ in range(2)).replace("//", "/") + f"f{rng.randrange(30)}.md" for _ in range(4)]
            text = "".join(rng.choice([f"[a]({k})", f"see [b]({k}#part)", f"[c](https://elsewhere.example/{k})"]) for k in links)
            files.append((f"o/r{r}", p, text if rng.random() < 0.95 else rng.choice(["", None])))
    table = spark.createDataFrame(files, SCHEMA)
    for depth, most in ((0, 5), (2, 200), (5, 200), (5, 4)):
        assert sorted(map(tuple, G.walk(table, depth, most).collect())) == loop(files, depth, most), (depth, most)


def test_odd_rows(spark):
    files = [
        ("o/a", "readme.md", "[p](https://github.com/o/a/blob/main/docs/p.md) [q](https://github.com/o/b/blob/main/docs/q.md) [r](../../r.md#x)"),
        ("o/a", "readme.md", "[s](s.md)"),  # a second row of one path
        ("o/a", "README.md", ""),
        ("o/a", "docs/p.md", "[self](p.md) [home](../readme.md)"),
        ("o/a", "r.md", "x"),
        ("o/b", "docs/readme.md", "[x](y.md)"),  # no README at the root
        (None, "README.md", "x"),
        ("o/c", None, "x"),
        ("o/d", "README.md", None),
    ]
    table = spark.createDataFrame(files, SCHEMA)
    found = sorted(map(tuple, G.walk(table).collect()))
    assert found == [("o/a", "docs/p.md", 1, True), ("o/a", "r.md", 1, True), ("o/a", "readme.md", 0, True), ("o/a", "s.md", 1, False)]
    assert sorted((r["path"], r["depth"]) for r in G.walked_files(table).collect()) == [("docs/p.md", 1), ("r.md", 1), ("readme.md", 0), ("readme.md", 0)]
    assert G.walk(table.limit(0)).count() == 0


def test_chunks_by_kind_of_file(spark):
    body = "words of a section that are long enough to be a chunk of their own"
    source = "import os\n\n\ndef first():\n" + "".join(f"    x{i} = os.name\n" for i in range(20))
    files = spark.createDataFrame([("o/a", "d/x.md", f"# One\n\n{body}\n\n# Two\n\n{body}"), ("o/a", "y.py", source), ("o/b", "y.py", "   "), ("o/b", "z.md", None)], SCHEMA)
    rows = G.chunked(files).collect()
    assert sorted((r["path"], r["content"]) for r in rows if r["path"].endswith(".md")) == [("d/x.md", f"# One\n\n{body}"), ("d/x.md", f"# Two\n\n{body}")]
    code = [r for r in rows if r["path"] == "y.py"]
    assert code and all(r["repo"] == "o/a" for r in code) and any("def first" in r["content"] for r in code)
