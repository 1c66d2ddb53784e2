"""Files and commits of a git repository as data sources.

`spark.read.format("git_files").option("repository", path)` gives commit, path, text; without the
option `commits` (revisions, comma-separated) of all commits. Each commit is a partition. Filters on commit and
path are handed to git: commits that are not asked for are not listed, files not read. A file that a commit does not have
has no row; files that are not UTF-8 text have a null text. `git_commits` gives commit and parent, its first one, or null.

The repository has to be where the tasks run, at the same path. Filters are pushed down only
while spark.sql.python.filterPushdown.enabled is true; register sets it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

#: Text bytes of a batch.
BATCH_BYTES = 8 << 20


def git(repository: str, *words: str) -> str:
    return subprocess.run(["git", "-C", repository, *words], check=True, capture_output=True).stdout.decode()


def revisions(options: dict[str, str]) -> list[str]:
    named = [c.strip() for c in options.get("commits", "").split(",") if c.strip()]
    repository = options["repository"]
    return [git(repository, "rev-parse", "--verify", f"{c}^{{commit}}").strip() for c in named] if named else git(repository, "rev-list", "--all", "--reverse").split()


@dataclass
class Wanted:
    """What the pushed filters ask for; an empty set of commits or paths is all of them."""

    commits: set[str] | None = None
    paths: set[str] | None = None
    prefixes: list[str] = field(default_factory=list)

    def take(self, f: Filter) -> bool:
        """Whether the filter is carried out here, whole."""
        if isinstance(f, EqualTo):
            return self._among(f.attribute, {f.value})
        if isinstance(f, In):
            return self._among(f.attribute, set(f.value))
        if isinstance(f, StringStartsWith) and f.attribute == ("path",):
            self.prefixes.append(f.value)
            return True
        return False

    def _among(self, attribute: tuple, values: set) -> bool:
        if attribute not in (("commit",), ("path",)):
            return False
        name = attribute[0] + "s"
        now = getattr(self, name)
        setattr(self, name, values if now is None else now & values)
        return True

    def has(self, path: str) -> bool:
        return (self.paths is None or path in self.paths) and all(path.startswith(p) for p in self.prefixes)


@dataclass
class Commit(InputPartition):
    commit: str


class FilesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Commit]:
        return [Commit(c) for c in revisions(self.options) if self.wanted.commits is None or c in self.wanted.commits]

    def _listed(self, commit: str) -> Iterator[tuple[str, str]]:
        """Path and object of each file of a commit that is asked for."""
        repository, where = self.options["repository"], []
        if self.wanted.paths is not None:
            where = sorted(p for p in self.wanted.paths if p)
            if not where:
                return
        for entry in git(repository, "--literal-pathspecs", "ls-tree", "-r", "-z", "--full-tree", commit, "--", *where).split("\0"):
            if entry:
                meta, path = entry.split("\t", 1)
                if meta.split()[1] == "blob" and self.wanted.has(path):
                    yield path, meta.split()[2]

    def read(self, partition: Commit) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("commit", pa.string()), ("path", pa.string()), ("text", pa.string())])
        held: list[tuple] = []
        size = 0
        with subprocess.Popen(["git", "-C", self.options["repository"], "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as process:
            for path, blob in self._listed(partition.commit):
                process.stdin.write(blob.encode() + b"\n")
                process.stdin.flush()
                n = int(process.stdout.readline().split()[2])
                body = process.stdout.read(n + 1)[:-1]
                try:
                    text = body.decode()
                except UnicodeDecodeError:
                    text = None
                held.append((partition.commit, path, text))
                size += n
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)
                    held, size = [], 0
            process.stdin.close()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], schema=schema)


class GitFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_files"

    def schema(self) -> str:
        return "commit string, path string, text string"

    def reader(self, schema) -> DataSourceReader:
        return FilesReader(self.options)


class CommitsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = dict(options)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        wanted = set(revisions(self.options))
        for line in git(self.options["repository"], "rev-list", "--all", "--reverse", "--parents").splitlines():
            commit, *parents = line.split()
            if commit in wanted:
                yield commit, parents[0] if parents else None


class GitCommits(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_commits"

    def schema(self) -> str:
        return "commit string, parent string"

    def reader(self, schema) -> DataSourceReader:
        return CommitsReader(self.options)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let it push filters down to them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (GitFiles, GitCommits):
        spark.dataSource.register(source)
