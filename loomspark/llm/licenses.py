"""Licences of files: notices in the text, or the nearest licensed directory above. DataFrame expressions only.

Every run of consecutive lines of a text, up to RUN_TIMES a notice's words, is compared with the notices of known licences by the
cosine of sparse TF-IDF vectors; runs that an upper bound of the cosine rules out are not scored.
Time is in proportion to a text's lines.
The vocabulary is that of the notices; document frequencies are counted over all texts. A file without a notice of its own takes the licence of the nearest directory above
it that holds a licence file; directories find that by joins on their paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined, let, staged

#: The wording of licence notices, by SPDX identifier.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Words of the notices that tell nothing.
STOP = frozenset("a all and any are as be by can except following for form forms have has in is it its may met not of or that the this to under up use with you".split())
#: A run of lines is a notice from this cosine on; a file is a licence file if its name says so or notices are this much of its words.
MIN_COSINE, MIN_COVERAGE = 0.6, 0.5
#: A run of several lines is compared with notices that have a fourth of its words or more.
RUN_TIMES = 4
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
_TERM = re.compile(r"[a-z]+[0-9]*|[0-9]+")


def terms_of(text: str) -> list[str]:
    return [t for t in _TERM.findall(text.lower()) if t not in STOP]


VOCABULARY = tuple(sorted({t for _, notice in NOTICES for t in terms_of(notice)}))
#: What rounding may add to a cosine.
SLACK = 1e-6


def _words(line: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(line), F.lit(_TERM.pattern), F.lit(0)), lambda t: ~t.isin(*STOP))


def idf(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, float], float]:
    """Inverse document frequency of each vocabulary term over all texts, and that of other words: the least of them."""
    words = F.regexp_extract_all(F.lower(docs[text_col]), F.lit(_TERM.pattern), F.lit(0))
    found = docs.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, VOCABULARY)))).alias("term"))
    counts = {r["term"]: r["n"] for r in found.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most the vocabulary
    n = docs.count()
    weights = {t: math.log((1 + n) / (1 + counts.get(t, 0))) + 1 for t in VOCABULARY}
    return weights, min(weights.values())


def vectors(weights: dict[str, float]) -> list[tuple[str, dict[str, float]]]:
    """The notices as vectors of length one: (licence, term -> weight)."""
    out = []
    for name, notice in NOTICES:
        raw = {t: n * weights[t] for t, n in Counter(terms_of(notice)).items()}
        size = math.sqrt(sum(x * x for x in raw.values()))
        out.append((name, {t: x / size for t, x in raw.items()}))
    return out


def anchors(weights: dict[str, float], min_cosine: float) -> list[str]:
    """Terms that a text must hold one of to reach min_cosine with any notice.

    By Cauchy-Schwarz a cosine is at most the length of the notice's part that the text holds. Of each
    notice the lightest terms that together stay under min_cosine are left out; the others are anchors.
    """
    found = set()
    for _, vector in vectors(weights):
        mass = 0.0
        for term, x in sorted(vector.items(), key=lambda item: (item[1], item[0])):
            mass += x * x
            if mass >= (min_cosine - SLACK) ** 2:
                found.add(term)
    return sorted(found)


def _best(words: Column, weights: dict[str, float], other: float) -> Column:
    """(cosine, licence) of the notice nearest to a run's words; of equal ones the licence that sorts first."""
    table = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.lit(w))])

    def weighed(words: Column) -> Column:
        counts = F.transform(F.array_distinct(words), lambda t: F.struct(t.alias("t"), F.size(F.filter(words, lambda u: u == t)).alias("n")))
        return F.transform(counts, lambda c: F.struct(c["t"].alias("t"), (c["n"] * F.coalesce(F.try_element_at(table, c["t"]), F.lit(other))).alias("w")))

    def dot(weighed: Column, vector: dict[str, float]) -> Column:
        notice = F.create_map(*[x for t, w in vector.items() for x in (F.lit(t), F.lit(w))])
        return F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(F.try_element_at(notice, x["t"]), F.lit(0.0)))

    def nearest(weighed: Column) -> Column:
        norm = F.sqrt(F.aggregate(weighed, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
        scored = [F.struct(F.when(norm > 0, -F.round(dot(weighed, v) / norm, 6)).otherwise(0.0).alias("minus"), F.lit(name).alias("license")) for name, v in vectors(weights)]
        return F.array_min(F.array(*scored))

    return let(words, lambda words: let(weighed(words), nearest))


def _measured(words: Column, weights: dict[str, float], other: float) -> Column:
    """A line's words, its products with all notices, and the least that it adds to the square of a run's length."""
    notices = vectors(weights)
    table = F.create_map(*[x for t, w in weights.items() for x in (F.lit(t), F.array(*[F.lit(w * v.get(t, 0.0)) for _, v in notices], F.lit(w)))])

    def summed(words: Column) -> Column:
        known = F.transform(F.filter(words, lambda t: t.isin(*VOCABULARY)), lambda t: F.element_at(table, t))
        unknown = F.size(F.filter(words, lambda t: ~t.isin(*VOCABULARY)))
        return let(known, lambda known: F.struct(
            words.alias("words"),
            F.transform(F.sequence(F.lit(0), F.lit(len(notices) - 1)), lambda v: F.aggregate(known, F.lit(0.0), lambda acc, x: acc + F.get(x, v))).alias("dots"),
            F.aggregate(known, unknown * F.lit(other * other), lambda acc, x: acc + F.get(x, F.lit(len(notices))) * F.get(x, F.lit(len(notices)))).alias("square"),
        ))

    return let(words, summed)


def _run_words() -> list[int]:
    """For each notice the words (without those that tell nothing) that a run compared with it has at most."""
    return [RUN_TIMES * len(terms_of(notice)) for _, notice in NOTICES]


def _lasts(lines: Column, first: Column, min_cosine: float) -> Column:
    """The last lines of all runs from line first on that may reach min_cosine with a notice.

    A run's product with a notice is the sum of its lines', and its square at least the sum of theirs,
    as no weight is negative: the quotient bounds the cosine from above. A run whose first or
    last line has no word of the notice is left out, for without that line it is at least as near.
    A line has a word at least, so a run ends within as many lines as it may have words.
    """
    least = (min_cosine - SLACK) ** 2
    most = F.array(*map(F.lit, _run_words()))

    def ends(v: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("square"), F.lit(0).alias("n"), first.alias("at"), F.array().cast("array<int>").alias("found"))

        def longer(acc: Column, line: Column) -> Column:
            dot, square, n = acc["dot"] + F.get(line["dots"], v), acc["square"] + line["square"], acc["n"] + F.size(line["words"])
            fits = (F.get(line["dots"], v) > 0) & (dot * dot >= square * F.lit(least)) & ((n <= F.get(most, v)) | (acc["at"] == first))
            found = F.when(fits, F.concat(acc["found"], F.array(acc["at"]))).otherwise(acc["found"])
            return F.struct(dot.alias("dot"), square.alias("square"), n.alias("n"), (acc["at"] + 1).alias("at"), found.alias("found"))

        return F.aggregate(F.slice(lines, first, F.get(most, v)), start, longer, lambda acc: acc["found"])

    dots = F.element_at(lines, first)["dots"]
    held = F.filter(F.sequence(F.lit(0), F.lit(len(NOTICES) - 1)), lambda v: F.get(dots, v) > 0)
    return F.array_distinct(F.flatten(F.transform(held, ends)))


def _covered(lines: Column, hits: Column) -> Column:
    """Words in lines that are notices alone, or in runs that no run they overlap is nearer than.

    hits has for each line the runs that start with it. Runs overlap where they share a line, so a run is the
    nearest if it is that on each of its lines; only runs that start within a run's length above reach a line.
    """
    reach = max(_run_words())
    of_lines = F.sequence(F.lit(1), F.size(lines))

    def above(runs: Column, i: Column) -> Column:
        """The runs that hold line i."""
        first = F.greatest(i - reach + 1, F.lit(1))
        return F.filter(F.flatten(F.slice(runs, first, i - first + 1)), lambda x: x["last"] >= i)

    def nearest(near: Column) -> Column:
        own = F.transform(hits, lambda runs, i: F.filter(runs, lambda x: (x["last"] == i + 1) | (F.array_min(F.slice(near, i + 1, x["last"] - i)) >= x["best"]["minus"])))
        return let(own, lambda own: F.aggregate(F.transform(of_lines, lambda i: F.when(F.size(above(own, i)) > 0, F.size(F.element_at(lines, i)["words"])).otherwise(0)), F.lit(0), lambda acc, n: acc + n))

    return let(F.transform(of_lines, lambda i: F.coalesce(F.array_min(F.transform(above(hits, i), lambda x: x["best"]["minus"])), F.lit(0.0))), nearest)


def license_scan(files: DataFrame, path_col: str = "path", text_col: str = "text", min_cosine: float = MIN_COSINE, keep: list[str] | None = None) -> DataFrame:
    """The columns of files (or those in keep) plus license, cosine, origin (own, inherited or none) and license_dir, from where it is inherited.

    A null or empty text has no notice, but inherits; a null path is a file of no directory.
    Several notices in one text: the nearest run of lines wins, then the licence that sorts first. Several
    licence files in one directory: the most frequent licence, then the one that sorts first.
    Repeated rows are each scanned. Columns with the result's names are replaced.
    """
    ours = ("license", "cosine", "origin", "license_dir")
    kept = [c for c in (files.columns if keep is None else keep) if c not in ours]
    weights, other = idf(files, text_col)
    terms = anchors(weights, min_cosine)
    words = "|".join(t for t in terms if not t[-1].isdigit()), "|".join(t for t in terms if t[-1].isdigit())
    anchor = "(?<![a-z])(?:" + "|".join(f"(?:{group})(?!{after})" for group, after in zip(words, ("[a-z0-9]", "[0-9]"), strict=True) if group) + ")"
    text = F.coalesce(files[text_col], F.lit(""))
    split = F.filter(F.transform(F.split(text, "\n"), _words), lambda words: F.size(words) > 0)
    lines = F.when(F.lower(text).rlike(anchor), F.transform(split, lambda words: _measured(words, weights, other)))

    def scored(lines: Column) -> Column:
        def run(first: Column, last: Column) -> Column:
            words = F.flatten(F.transform(F.slice(lines, first, last - first + 1), lambda line: line["words"]))
            return F.struct(last.alias("last"), _best(words, weights, other).alias("best"))

        def starting(first: Column) -> Column:
            return F.filter(F.transform(_lasts(lines, first, min_cosine), lambda last: run(first, last)), lambda x: x["best"]["minus"] <= -min_cosine)

        hits = F.when(F.size(lines) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), starting))
        return let(hits, lambda hits: F.struct(F.array_min(F.transform(F.flatten(hits), lambda x: x["best"])).alias("best"), F.when(F.size(lines) > 0, _covered(lines, hits)).otherwise(0).alias("n")))

    found = F.when(lines.isNotNull(), let(lines, scored))
    base = files.select(*kept, files[path_col].alias("_loomspark_path"), found.alias("_loomspark_found"), text.alias("_loomspark_whole"))
    base = base.withColumns({
        "_loomspark_best": F.col("_loomspark_found.best"),
        "_loomspark_cover": F.when(F.col("_loomspark_found.n") > 0, F.col("_loomspark_found.n") / F.greatest(F.size(_words(F.col("_loomspark_whole"))), F.lit(1))).otherwise(F.lit(0.0)),
        "_loomspark_dir": F.regexp_extract("_loomspark_path", r"^(.*)/[^/]*$", 1),
        "_loomspark_name": F.regexp_extract("_loomspark_path", r"([^/]*)$", 1),
    }).drop("_loomspark_whole", "_loomspark_found")
    base = staged(base)  # texts are scanned once
    is_file = F.col("_loomspark_best").isNotNull() & (F.col("_loomspark_name").rlike(LICENSE_FILE) | (F.col("_loomspark_cover") >= MIN_COVERAGE)) & F.col("_loomspark_path").isNotNull()
    counted = base.filter(is_file).groupBy("_loomspark_dir", F.col("_loomspark_best.license").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    licensed = counted.groupBy("_loomspark_dir").agg(F.min(F.struct((-F.col("n")).alias("minus"), "name")).alias("top")).select(F.col("_loomspark_dir").alias("_loomspark_above"), F.col("top.name").alias("_loomspark_given"))
    dirs = staged(base.filter("_loomspark_path is not null").groupBy("_loomspark_dir").agg(F.count(F.lit(1)).alias("n_files")))
    parts = F.split("_loomspark_dir", "/")
    above = dirs.select("_loomspark_dir", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")).withColumn("_loomspark_above", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    below = above.groupBy("_loomspark_above").agg(F.count(F.lit(1)).alias("n_dirs"))
    given = joined(above, licensed.join(below, "_loomspark_above"), "_loomspark_above", "n_dirs").filter("_loomspark_given is not null")
    nearest = given.groupBy("_loomspark_dir").agg(F.max(F.struct("depth", "_loomspark_above", "_loomspark_given")).alias("near")).select("_loomspark_dir", "near._loomspark_above", "near._loomspark_given")
    base = joined(base, nearest.join(dirs, "_loomspark_dir"), "_loomspark_dir", "n_files")
    own = F.col("_loomspark_best").isNotNull()
    return base.select(
        *kept,
        F.when(own, F.col("_loomspark_best.license")).otherwise(F.col("_loomspark_given")).alias("license"),
        F.when(own, -F.col("_loomspark_best.minus")).alias("cosine"),
        F.when(own, F.lit("own")).when(F.col("_loomspark_given").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("origin"),
        F.when(~own, F.col("_loomspark_above")).alias("license_dir"),
    )
