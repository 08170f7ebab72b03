"""Listing by tasks, and filters that reach the reader."""

import os
import re

import pytest

from loomgraph.plans.storage import shared_dir
from loomgraph.sources import extract, listing
from loomgraph.sources.repository import RepositorySource


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for k in range(60):
        folder = root / f"p{k % 7}" / ("deep-" + "x" * (k % 3)) / f"q{k % 2}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"m{k:02}.{('py', 'go', 'txt', 'PY')[k % 4]}").write_text(f"def f{k}():\n    return g()\n" * (k % 5 + 1))
    for name, content in {"a.py": "def a():\n    pass\n", "p1/z.py": "", "p1-/z.py": "x = 1\n", "é/ü.py": "def u():\n    pass\n", "noend": "x", "p2/big.py": "#" * 5000, ".git/config": "x", "node_modules/m.js": "x"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(content)
    os.symlink(root / "a.py", root / "linked.py")
    os.symlink(root / "p1", root / "linked_folder")
    os.symlink(root / "gone", root / "broken.py")
    (root / "empty").mkdir()
    return root


def source(spark, root, **options):
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").options(root=str(root), **options).load()


def rows(df):
    return sorted((r.walk_order, r.path, r.name, r.depth, r.size, r.is_symlink, r.status, r.reason, bytes(r.content) if r.content is not None else None) for r in df.collect())


@pytest.mark.parametrize("bounds", [{}, {"max_files": 9}, {"max_files": 0}, {"max_depth": 2}, {"max_bytes": 100}])
@pytest.mark.parametrize("contents", ["true", "sources", "false"])
def test_tasks_list_what_a_walk_lists(spark, tree, bounds, contents):
    names = {"max_files": "maxFiles", "max_depth": "maxDepth", "max_bytes": "maxBytes"}
    files = listing.listed(spark, str(tree), folders_per_task=2, **bounds)
    got = listing.with_contents(files, str(tree), contents, **({"max_bytes": bounds["max_bytes"]} if "max_bytes" in bounds else {}), files_per_task=5)
    expected = source(spark, tree, withContent=contents, **{names[k]: v for k, v in bounds.items()})
    assert rows(got) == rows(expected)


def test_filters_read_less_and_leave_the_bounds(spark, tree):
    files = listing.listed(spark, str(tree), max_files=30)
    some = files.where("path like 'p3/%'")
    assert "PushedFilters: [IsNotNull(path), StringStartsWith(path,p3/)]" in some._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
    every = rows(listing.with_contents(files, str(tree)))
    assert rows(listing.with_contents(some, str(tree))) == [r for r in every if r[1].startswith("p3/")]


def test_batches_of_contents_are_bounded(spark, tree, monkeypatch):
    files = listing.listed(spark, str(tree))
    every = rows(listing.with_contents(files, str(tree), files_per_task=1000))
    monkeypatch.setattr(listing, "BATCH_BYTES", 200)
    schema = [c.split()[0] for c in listing.LISTED.split(", ")]
    batches = files.select(*schema).toArrow().combine_chunks().to_batches()
    out = list(listing._contents(str(tree), "true", listing.MAX_BYTES, 1e18)(iter(batches)))
    assert len(out) > 10 and sum(b.num_rows for b in out) == len(every)
    assert all(sum(len(c or b"") for c in b["content"].to_pylist()[:-1]) <= 200 for b in out)


def test_deadline_errors_and_empty_trees(spark, tree, tmp_path):
    files = listing.listed(spark, str(tree))
    late = listing.with_contents(files, str(tree), max_seconds=-1.0)
    assert {r.reason for r in late.collect()} == {"wall_clock_exceeded", "symlink"}
    moved = listing.with_contents(files.where("name = 'a.py'"), str(tmp_path))
    assert [r.reason for r in moved.collect()] == ["read_error: No such file or directory"]
    before = set(os.listdir(shared_dir(spark)))
    none = listing.listed(spark, str(tmp_path))
    assert none.count() == 0 and listing.with_contents(none, str(tmp_path)).count() == 0
    # only the list itself is kept
    assert [n.split("-")[0] for n in set(os.listdir(shared_dir(spark))) - before] == ["files"]


def test_the_graph_is_the_same(spark, tree):
    a = extract.build(listing.with_contents(listing.listed(spark, str(tree)), str(tree), "sources"))
    b = extract.build(source(spark, tree, withContent="sources"))
    for name in ("nodes", "edges", "files"):
        one, other = getattr(a, name), getattr(b, name)
        assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and one.count() > 20


def test_the_data_source_takes_filters_over(spark, tree):
    every = rows(source(spark, tree, maxFiles=20))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for condition, test in {
            "path like 'p3/%'": lambda r: r[1].startswith("p3/"),
            "size > 60 and name like '%.py'": lambda r: r[4] > 60 and r[2].endswith(".py"),
            "not path like 'p%' and depth in (0, 1)": lambda r: not r[1].startswith("p") and r[3] in (0, 1),
            "walk_order >= 3 and walk_order <= 9 and is_symlink = false": lambda r: 3 <= r[0] <= 9 and not r[5],
            "status = 'skipped' and path like '%m%'": lambda r: r[6] == "skipped" and "m" in r[1],
            "path is null": lambda r: False,
        }.items():
            df = source(spark, tree, maxFiles=20, pushdown="true").where(condition)
            assert rows(df) == [r for r in every if test(r)], condition
            plan = df._jdf.queryExecution().executedPlan().toString()
            # of these, Spark itself is left with the one that no listing can judge
            assert re.findall(r"^.*\bFilter (.*)$", plan, re.M) == [] if "status" not in condition else "Filter" in plan, plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
