"""A batch data source over a git repository: the files of a commit, or what it changed.

    spark.dataSource.register(GitFiles)
    spark.read.format("git_files").option("repo", path).option("commit", "HEAD").option("mode", "diff").load()

``mode`` tree gives every UTF-8 file of the commit; diff gives added files whole and
of modified files the added lines, against the first parent (a root commit against
the empty tree).  Paths are listed once on the driver; contents are read by the tasks,
in chunks of paths, whole files of a chunk by one git process.

Excluded folders, test files and generated files are left out (``functions.paths``).
``exclude`` false keeps everything, ``tests`` and ``generated`` true keep those kinds.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from adherix.functions.paths import left_out

SCHEMA = "commit_id string, file_ord long, path string, content string, change_type string"
#: The tree of a commit without a parent is compared with git's empty tree (a fixed value).
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
PATHS_PER_TASK = 200


def _git(repo: str, *args: str, given: bytes | None = None) -> bytes:
    got = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], capture_output=True, input=given)
    if got.returncode:
        raise ValueError(got.stderr.decode(errors="replace").strip() or "git failed")
    return got.stdout


def _blobs(repo: str, commit: str, paths: list[str]) -> list[bytes | None]:
    """The contents of paths of a commit, read by one process; None for what is no file."""
    asked = b"".join(f"{commit}:{p}".encode(errors="surrogateescape") + b"\n" for p in paths)
    answer = _git(repo, "cat-file", "--batch", given=asked)
    out, at = [], 0
    for _ in paths:
        end = answer.index(b"\n", at)
        head, at = answer[at:end].rsplit(b" ", 2), end + 1
        if len(head) < 3 or not head[2].isdigit():  # missing, or a submodule
            out.append(None)
            continue
        size = int(head[2])
        out.append(answer[at : at + size] if head[1] == b"blob" else None)
        at += size + 1
    return out


def added_lines(patch: str) -> str:
    """The added lines of a patch, without their mark."""
    return "\n".join(x[1:] for x in patch.split("\n") if x.startswith("+") and not x.startswith("+++"))


class _Paths(InputPartition):
    def __init__(self, items: list[tuple[int, str, str]]) -> None:
        self.items = items


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.repo, self.mode = options["repo"], options.get("mode", "diff")
        if self.mode not in ("diff", "tree"):
            raise ValueError(f"mode is diff or tree, not {self.mode}")
        flag = lambda name, default: options.get(name, default).lower() == "true"
        self.exclude, self.tests, self.generated = flag("exclude", "true"), flag("tests", "false"), flag("generated", "false")
        self.commit = _git(self.repo, "rev-parse", "--verify", options.get("commit", "HEAD") + "^{commit}").decode().strip()
        parents = _git(self.repo, "rev-list", "--parents", "-n", "1", self.commit).decode().split()[1:]
        self.parent = parents[0] if parents else EMPTY_TREE

    def _kept(self, path: str) -> bool:
        return bool(path) and not (self.exclude and left_out(path, self.tests, self.generated))

    def partitions(self) -> list[InputPartition]:
        if self.mode == "tree":
            names = _git(self.repo, "ls-tree", "-r", "-z", "--name-only", self.commit).decode(errors="surrogateescape").split("\0")
            items = [(n, p, "added") for n, p in enumerate(names) if self._kept(p)]
        else:
            parts = _git(self.repo, "diff-tree", "-r", "-z", "--no-renames", "--name-status", self.parent, self.commit).decode(errors="surrogateescape").split("\0")
            kinds = {"A": "added", "M": "modified", "T": "modified"}
            items = [(n, p, kinds[k]) for n, (k, p) in enumerate(zip(parts[::2], parts[1::2])) if k in kinds and self._kept(p)]
        return [_Paths(items[a : a + PATHS_PER_TASK]) for a in range(0, len(items), PATHS_PER_TASK)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        # a line end in a path would end the request, so such files are read one by one
        whole = [p for _, p, kind in partition.items if kind == "added" and "\n" not in p]
        blobs = dict(zip(whole, _blobs(self.repo, self.commit, whole))) if whole else {}
        for n, path, kind in partition.items:
            try:
                if kind == "added":
                    raw = blobs.pop(path) if path in blobs else _git(self.repo, "cat-file", "blob", f"{self.commit}:{path}")
                    if raw is None:
                        continue
                    text = raw.decode("utf-8")
                else:
                    text = added_lines(_git(self.repo, "diff", "--no-renames", self.parent, self.commit, "--", path).decode("utf-8"))
                    if not text.strip():
                        continue
            except (UnicodeDecodeError, ValueError):  # no text, or a submodule
                continue
            yield self.commit, n, path, text, kind


class GitFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))
