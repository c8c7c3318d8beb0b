"""The data source for trees against the reader that lists everything."""

import pytest

from lanternq.sources import corpus, tree_source


@pytest.fixture
def root(tmp_path):
    texts = {
        "a.py": b"x = 1\r\n", "src/b.py": b"y\n", "src/deep/er/c.java": b"class C {}", "node_modules/x/d.js": b"no", "src/__pycache__/e.pyc": b"no", ".git/config": b"no",
        "src/node_modules/f.py": b"no", "docs/g.md": b"\xff bad", "docs/h": b"", "src/deep/__init__.py": b"pass", "build/out.py": b"no", "src/big.py": b"#" * 5000,
    }
    for name, data in texts.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return str(tmp_path / "tree")


@pytest.mark.parametrize("options", [{}, {"extensions": [".py", ".md"]}, {"strict": False}, {"ignores": ["docs"]}])
def test_same_rows_as_the_plain_reader(spark, root, options):
    columns = ["path", "file_name", "ext", "language", "size_bytes", "content", "error"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()), key=repr)
    found = tree_source.read_source_tree(spark, root, **options)
    # The plain reader passes over empty files and names that begin with a dot or an underscore.
    assert rows(found.filter("size_bytes > 0").filter("path not rlike '/[._]'")) == rows(corpus.read_tree(spark, root, **options))
    assert found.filter("size_bytes = 0").count() == ("extensions" not in options and "ignores" not in options)


def test_ignored_folders_are_never_listed(root, monkeypatch):
    listed = []
    real = tree_source.TreeReader._list
    monkeypatch.setattr(tree_source.TreeReader, "_list", lambda self, store, folder: listed.append(folder[len(root) :]) or real(self, store, folder))
    reader = tree_source.TreeReader({"root": root})
    names = {p for part in reader.partitions() for p, _, _ in part.files}
    assert names == {"/a.py", "/src/b.py", "/src/deep/er/c.java", "/docs/g.md", "/docs/h", "/src/big.py", "/src/deep/__init__.py"}
    assert sorted(listed) == ["", "/docs", "/src", "/src/deep", "/src/deep/er"]


def test_filters_reach_the_listing(root, monkeypatch):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan, StringStartsWith

    listed = []
    real = tree_source.TreeReader._list
    monkeypatch.setattr(tree_source.TreeReader, "_list", lambda self, store, folder: listed.append(folder[len(root) :]) or real(self, store, folder))
    reader = tree_source.TreeReader({"root": root})
    rest = GreaterThan(("size_bytes",), 1)
    assert list(reader.pushFilters([In(("ext",), (".py", ".md")), StringStartsWith(("path",), "/src/"), LessThan(("size_bytes",), 100), rest])) == [rest]
    assert [p for part in reader.partitions() for p, _, _ in part.files] == ["/src/b.py", "/src/deep/__init__.py"]
    assert sorted(listed) == ["", "/src", "/src/deep", "/src/deep/er"]
    reader = tree_source.TreeReader({"root": root})
    assert list(reader.pushFilters([EqualTo(("ext",), ".py"), EqualTo(("ext",), ".md")])) == [] and [f for part in reader.partitions() for f in part.files] == []


def test_partitions_have_about_the_bytes_asked_for(root):
    parts = tree_source.TreeReader({"root": root, "bytesperpartition": "10"}).partitions()
    assert sum(len(p.files) for p in parts) == 7 and len(parts) >= 3
    assert sorted(f[0] for p in parts for f in p.files) == [f[0] for p in parts for f in p.files]
