import difflib
import random
import time

from loomspark.operators import diffstat as D


def plain_kept(old, new):
    row = [0] * (len(old) + 1)
    for line in new:
        before, row = row, [0]
        for j, other in enumerate(old, 1):
            row.append(max(row[-1], before[j], before[j - 1] + 1 if line == other else 0))
    return row[-1]


def test_kept_lines_are_the_longest_common_run():
    draw = random.Random(1)
    for _ in range(400):
        old, new = ([draw.choice("abcde ") for _ in range(draw.randrange(30))] for _ in range(2))
        assert D.kept_lines(old, new) == plain_kept(old, new)
    assert D.kept_lines(list("moved line up".split()), list("up moved line".split())) == 2


def test_lines():
    assert [D.lines_of(t) for t in (None, "", "a", "a\n", "a\n\n", "\n")] == [[], [], ["a"], ["a"], ["a", ""], [""]]


def test_long_files_of_one_line_many_times():
    old, new = ["", "x"] * 20_000, ["", "y", "x"] * 15_000
    began = time.monotonic()
    assert D.kept_lines(old, new) >= 30_000 and time.monotonic() - began < 20
    assert difflib.SequenceMatcher(None, "ab", "ab").ratio() == 1


def test_versions(spark):
    versions = spark.createDataFrame(
        [("p", "same.md", "x\ny\n"), ("c", "same.md", "x\ny\n"), ("p", "gone.md", "1\n2\n3"), ("c", "new.md", "1\n"), ("p", "edit.md", "a\nb\nc\n"), ("c", "edit.md", "b\nc\na\nd\n"), ("p", "emptied.md", "a"), ("c", "emptied.md", ""), ("q", "other.md", "z")],
        "commit string, path string, text string",
    )
    commits = spark.createDataFrame([("c", "p"), ("p", None), ("q", "nowhere")], "commit string, parent string")
    got = {(r.commit, r.path): (r.change, r.added, r.removed) for r in D.diffstat(versions, commits).collect()}
    assert got == {
        ("c", "gone.md"): ("deleted", 0, 3), ("c", "new.md"): ("added", 1, 0), ("c", "edit.md"): ("changed", 2, 1), ("c", "emptied.md"): ("changed", 0, 1), ("q", "other.md"): ("added", 1, 0),
        ("p", "same.md"): ("added", 2, 0), ("p", "gone.md"): ("added", 3, 0), ("p", "edit.md"): ("added", 3, 0), ("p", "emptied.md"): ("added", 1, 0),
    }
    text = {r.commit: r.summary for r in D.summaries(D.diffstat(versions, commits)).collect()}
    assert text["c"].splitlines() == ["edit.md | 3 +2 -1", "emptied.md | 1 +0 -1", "gone.md | 3 +0 -3", "new.md | 1 +1 -0", "4 changed, 3 added, 5 removed"]


def test_no_versions(spark):
    none = spark.createDataFrame([], "commit string, path string, text string")
    assert D.diffstat(none, spark.createDataFrame([("c", "p")], "commit string, parent string")).collect() == []
