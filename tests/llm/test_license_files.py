"""Texts with very many licence lines."""

import glob
import time

import pytest

from loomspark.llm import licenses

LINE = "you can redistribute it under the License, Version 2.0 of the License\nother words here of no licence\n"


def scan(spark, text, path="a/LICENSE"):
    began = time.monotonic()
    row = licenses.license_scan(spark.createDataFrame([(path, text)], "path string, text string")).first()
    return row, time.monotonic() - began


def test_ten_thousand_notice_lines_in_proportion(spark):
    scan(spark, "Released under the MIT License.")  # compiled
    small = min(scan(spark, LINE * 500)[1] for _ in range(2))
    row, large = scan(spark, LINE * 5000)
    assert large < 15 * small + 5 and large < 90
    assert row.origin in ("own", "none")


@pytest.mark.parametrize("name", ["GPL-3", "Apache-2.0", "CC0-1.0"])
def test_whole_licence_texts(spark, name):
    found = glob.glob(f"/usr/share/common-licenses/{name}")
    if not found:
        pytest.skip("no licence texts on this machine")
    with open(found[0]) as file:
        assert scan(spark, file.read())[1] < 30


def test_many_notices_in_one_text(spark):
    """The nearest run wins, coverage counts each line once, and a file of notices licenses its directory."""
    text = "\n".join(["Released under the MIT License."] * 300 + ["other words of a text"] * 100)
    rows = {r.path: r for r in licenses.license_scan(spark.createDataFrame([("a/notes", text), ("a/b/c", "nothing"), ("z/y", text.replace("MIT", "new"))], "path string, text string")).collect()}
    assert (rows["a/notes"].license, rows["a/notes"].cosine, rows["a/b/c"].license, rows["a/b/c"].origin) == ("MIT", 1.0, "MIT", "inherited")
