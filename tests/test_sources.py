"""The git source and the index table."""

import os
import subprocess

import pytest

from adherix.sources.git import GitFiles, added_lines
from adherix.sources.tables import read_index, read_results, write_index, write_results


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("repo")
    env = os.environ | {k: "x@x" for k in ("GIT_AUTHOR_NAME", "GIT_AUTHOR_EMAIL", "GIT_COMMITTER_NAME", "GIT_COMMITTER_EMAIL")}

    def git(*a):
        subprocess.run(["git", "-C", str(path), *a], check=True, capture_output=True, env=env)

    git("init", "-q")
    (path / "dist").mkdir()
    (path / "dist" / "out.js").write_text("x\n")
    (path / "a_test.py").write_text("t\n")
    (path / "types.d.ts").write_text("d\n")
    (path / "empty.py").write_text("")
    (path / "a.py").write_text("one\ntwo\n")
    (path / "b.bin").write_bytes(b"\xff\xfe\x00")
    (path / "gone.py").write_text("x\n")
    git("add", "-A")
    git("commit", "-qm", "first")
    (path / "a.py").write_text("one\nthree\ntwo\n")
    (path / "c d.py").write_text("néw\n")
    (path / "gone.py").unlink()
    git("add", "-A")
    git("commit", "-qm", "second")
    return str(path)


def load(spark, repo, **options):
    spark.dataSource.register(GitFiles)
    return {r["path"]: (r["content"], r["change_type"]) for r in spark.read.format("git_files").options(repo=repo, **options).load().collect()}


def test_diff(spark, repo):
    assert load(spark, repo) == {"a.py": ("three", "modified"), "c d.py": ("néw\n", "added")}
    assert load(spark, repo, commit="HEAD~1") == {"a.py": ("one\ntwo\n", "added"), "gone.py": ("x\n", "added"), "empty.py": ("", "added")}


def test_tree(spark, repo):
    kept = {"a.py", "c d.py", "empty.py"}
    assert set(load(spark, repo, mode="tree")) == kept
    assert set(load(spark, repo, mode="tree", tests="true", generated="true")) == kept | {"a_test.py", "types.d.ts"}
    assert set(load(spark, repo, mode="tree", exclude="false")) == kept | {"a_test.py", "types.d.ts", "dist/out.js"}


def test_bad_ref(spark, repo):
    with pytest.raises(Exception, match="(?i)needed a single revision|unknown revision|fatal"):
        load(spark, repo, commit="nowhere")


def test_added_lines():
    assert added_lines("+++ b/x\n+one\n-two\n+\n") == "one\n"


def test_index_table(spark, tmp_path):
    schema = "commit_id string, domain string, ref_id long"
    path = str(tmp_path / "index")
    write_index(spark.createDataFrame([("c1", "a", 1), ("c1", "b", 2), ("c2", "a", 3)], schema), path)
    write_index(spark.createDataFrame([("c1", "a", 9)], schema), path)
    assert sorted(r["ref_id"] for r in read_index(spark, path).collect()) == [2, 3, 9]
    assert [r["ref_id"] for r in read_index(spark, path, "c1", ["a"]).collect()] == [9]


def test_results(spark, tmp_path):
    path = str(tmp_path / "out")
    write_results(spark.createDataFrame([("a.ts", 0.5)], "path string, score double"), path)
    assert read_results(spark, path, "path string, score double").first()["score"] == 0.5
