"""Secrets in text: key patterns, and strings of high entropy. DataFrame expressions only.

Three base kinds are matched by pattern. The method adds a fourth: over candidate strings a
window slides whose character counts are kept up to date, one character in and one out, so
its Shannon entropy costs a step a character. Each character class has its own threshold.
Candidates that match the allow-list are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: The kinds in their order of listing.
KINDS = ("assign", "access", "hex", "entropy")

#: Whole runs of these characters that hold a letter and a digit.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
WINDOW = 20
#: Characters of a piece when secrets are cut out of a text.
CUT = 1024
#: Characters of a candidate that one fold goes over, and the whole units that a bit counts.
PIECE, UNIT = 1 << 14, 10**12
#: Bits a window must reach, by the class of all the candidate's characters.
MIN_BITS = {"hex": 3.0, "base36": 3.4, "base64": 3.8}
CLASSES = {"hex": r"^([0-9a-f]+|[0-9A-F]+)$", "base36": r"^([0-9a-z]+|[0-9A-Z]+)$", "base64": r"."}
#: Candidates that are no secrets: dates first, words with a number, dummies.
ALLOW = (r"^\d{4}-\d{2}-\d{2}", r"^[A-Za-z/_-]+[0-9]{1,4}$", r"(?i)example|placeholder|x{6}|0123456789|abcdefgh")


def _found(text: Column, pattern: str) -> Column:
    """Matches in order: array of (start, end, hit), in code points."""
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def placed(hits: Column) -> Column:
        lengths = F.zip_with(hits, F.slice(F.transform(F.split(text, pattern, -1), F.length), 1, F.size(hits)), lambda hit, gap: gap + F.length(hit))
        ends = running(lengths, lambda a, b: a + b)
        return F.zip_with(hits, ends, lambda hit, end: F.struct((end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit")))

    return F.when(F.coalesce(text.rlike(pattern), F.lit(False)), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(none)


def _hot_extent(candidate: Column, window: int, least: Column) -> Column:
    """(start, end) from the first to the last window of enough entropy; nulls if there is none.

    The candidate is cut into pieces that overlap by a window less one, so that each window lies
    in one of them and a long candidate takes no more memory than a piece.
    """
    # entropy is log2 w - sum / w, so this is the most that the sum of n log2 n over a window may be
    most = F.floor((F.lit(math.log2(window)) - least + 1e-9) * window * UNIT)

    def within(given: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(given["raw"]) - window, F.lit(0)), F.lit(PIECE))
        piece = lambda at: F.substr(given["raw"], at + 1, F.lit(PIECE + window - 1)).cast("string")
        return F.transform(starts, lambda at: F.struct(at.alias("at"), _hot_windows(piece(at), window, given["most"]).alias("hot")))

    return let(
        let(F.struct(candidate.cast("binary").alias("raw"), most.alias("most")), within),  # ASCII, so a byte is a character
        lambda found: F.struct(
            F.array_min(F.transform(found, lambda x: x["at"] + x["hot"]["start"])).alias("start"), F.array_max(F.transform(found, lambda x: x["at"] + x["hot"]["end"])).alias("end")
        ),
    )


def _hot_windows(piece: Column, window: int, most: Column) -> Column:
    """(start, end) of a piece's windows of enough entropy.

    A fold keeps the window's character counts, a byte each and eight to a number, and the sum
    of n log2 n over them in whole units: a step costs the same at every place, and nothing drifts.
    """
    bits = F.array(*[F.lit(round(n * math.log2(n) * UNIT) if n else 0) for n in range(window + 1)])
    codes = F.transform(F.split(piece, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)

    def shift(code: Column) -> Column:
        return F.shiftleft(code.bitwiseAND(7), 3)

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(counts, F.shiftright(code, 3)), shift(code)).bitwiseAND(F.lit(255)).cast("int")

    def change(n: Column, sign: int) -> Column:
        return F.get(bits, n + sign) - F.get(bits, n)

    def one(code: Column, at: Column) -> Column:
        """One of the character, in the number of the counts that holds it."""
        return F.when(at == F.shiftright(code, 3), F.call_function("shiftleft", F.lit(1).cast("long"), shift(code))).otherwise(F.lit(0).cast("long"))

    def fold(codes: Column) -> Column:
        def enter(acc: Column, x: Column) -> Column:
            # the character that enters the window, and the one that it pushes out (null while there is room)
            new, old, counts, at = x["new"], x["old"], acc["counts"], acc["at"] + 1
            total = (
                F.when(old.isNull(), acc["sum"] + change(count(counts, new), 1))
                .when(old == new, acc["sum"])
                .otherwise(acc["sum"] + change(count(counts, new), 1) + change(count(counts, old), -1))
            )
            moved = F.when(old.isNull(), F.transform(counts, lambda n, i: n + one(new, i))).when(old == new, counts).otherwise(F.transform(counts, lambda n, i: n + one(new, i) - one(old, i)))
            hot = lambda y: (at >= window) & (y <= most)
            return let(
                total,
                lambda y: F.struct(
                    moved.alias("counts"),
                    y.alias("sum"),
                    at.alias("at"),
                    F.when(hot(y), F.coalesce(acc["start"], at - window)).otherwise(acc["start"]).alias("start"),
                    F.when(hot(y), at).otherwise(acc["end"]).alias("end"),
                ),
            )

        none = F.lit(None).cast("int")
        empty = F.struct(F.array_repeat(F.lit(0).cast("long"), -(-len(ALPHABET) // 8)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(0).alias("at"), none.alias("start"), none.alias("end"))
        moves = F.transform(codes, lambda code, i: F.struct(code.alias("new"), F.when(i >= window, F.get(codes, i - window)).alias("old")))
        return F.aggregate(moves, empty, enter, lambda acc: F.struct(acc["start"].alias("start"), acc["end"].alias("end")))

    return let(codes, fold)


def _entropy(text: Column, window: int, allow: tuple[str, ...]) -> Column:
    wanted = F.filter(_found(text, CANDIDATE), lambda x: ~_any(x["hit"], allow))
    least = lambda hit: F.when(hit.rlike(CLASSES["hex"]), MIN_BITS["hex"]).when(hit.rlike(CLASSES["base36"]), MIN_BITS["base36"]).otherwise(MIN_BITS["base64"])
    hot = F.transform(wanted, lambda x: F.struct(x["start"].alias("from"), _hot_extent(x["hit"], window, least(x["hit"])).alias("hot")))
    return F.transform(F.filter(hot, lambda x: x["hot"]["start"].isNotNull()), lambda x: _span(x["from"] + x["hot"]["start"], 3, x["from"] + x["hot"]["end"]))


def _any(hit: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | hit.rlike(pattern)
    return out


def _span(start: Column, kind: int, end: Column) -> Column:
    return F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))


def secret_spans(docs: DataFrame, text_col: str = "text", window: int = WINDOW, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs plus secret_spans, an array of (start, kind, end) by start and then kind.

    start and end count code points, end exclusive; kind is an index into KINDS. Spans of
    different kinds may overlap. A null text counts as empty and has none, as has an empty
    one; a row that is there twice gets its spans twice. A column secret_spans is replaced.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    assigned = F.filter(_found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 12)
    kinds = [
        F.transform(assigned, lambda x: _span(x["start"], 0, x["end"])),
        F.transform(_found(text, ACCESS), lambda x: _span(x["start"], 1, x["end"])),
        F.transform(_found(text, HEX), lambda x: _span(x["start"], 2, x["end"])),
        _entropy(text, window, allow),
    ]
    return docs.withColumn("secret_spans", F.array_sort(F.concat(*kinds)))


def shown(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == KINDS.index(kind))).cast("long")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every run of overlapping secret spans in the text replaced by mark; null texts stay null."""
    names, at = docs.columns, docs.columns.index(text_col)
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = F.col(f"c{at}")
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))  # so that no place is counted from the text's beginning

    def cut(pieces: Column) -> Column:
        def between(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
            head, tail = F.coalesce(F.get(pieces, first), F.lit("")), F.coalesce(F.get(pieces, last), F.lit(""))
            inner = F.array_join(F.slice(pieces, first + 2, last - first - 1), "")
            return F.when(first == last, F.substr(head, a % CUT + 1, b - a)).otherwise(F.concat(F.substr(head, a % CUT + 1), inner, F.substr(tail, F.lit(1), b % CUT)))

        def kept(ends: Column) -> Column:
            """What lies outside the spans: before each that begins at or after all ends so far, and after the last end."""
            before = F.transform(F.col("secret_spans"), lambda x, i: F.struct(F.when(i > 0, F.get(ends, i - 1)).otherwise(0).alias("a"), x["start"].alias("b")))
            gaps = F.transform(F.filter(before, lambda x: x["b"] >= x["a"]), lambda x: between(x["a"], x["b"]))
            return F.array_join(F.concat(gaps, F.array(between(F.element_at(ends, -1), F.length(text)))), mark)

        return let(running(F.transform("secret_spans", lambda x: x["end"]), F.greatest), kept)

    clean = F.when(F.size("secret_spans") > 0, let(pieces, cut)).otherwise(text)
    return secret_spans(inner, f"c{at}").withColumn(f"c{at}", clean).drop("secret_spans").toDF(*names)
