import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from loomspark.llm import conversations as V

SPACE = " \t\n\x0b\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_edits(rows):
    """(cost, audit, repaired) by trying all edits from the last row backward; rows: (initial, must go, truncated, role, text)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, "", ()))
        else:
            initial, gone, cut, role, text = rows[i]
            rest = best(i + 1, state, 0)
            found.append((2 + rest[0], "D" + rest[1], rest[2]))
            if not gone:
                if (state, initial) in step:
                    rest = best(i + 1, step[state, initial], 0)
                    found.append((5 * cut + rest[0], "K" + rest[1], (f"{role}:{text}", *rest[2])))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        rest = best(i + 1, new[0], 0)
                        found.append((1 + 5 * cut + rest[0], "R" + rest[1], (f"{new}:{text}", *rest[2])))
        if inserts < 3:
            for new in ("user", "assistant"):
                if (state, new[0]) in step:
                    rest = best(i, new[0], inserts + 1)
                    found.append((5 + rest[0], "I" + rest[1], (f"{new}:", *rest[2])))
        return min(found, default=(10**9, "", ()))

    return best(0, "", 0)


def plain_report(rows, convs):
    out = []
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2][:64], r[3][:64], hashlib.md5(r[3].encode()).hexdigest()))
        seen, coded, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            bare = text.rstrip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            coded.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, repaired = plain_edits(coded)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SHAPE = "conv_id long, turn long, role string, text string"


def run(spark, rows, damage=False):
    df = spark.createDataFrame(rows, SHAPE).withColumn("pos", F.lit("mine")).repartition(5)
    out = V.repair_report(V.damaged(df) if damage else df, df)
    return sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str)


def drawn(seed, convs=120, most=12):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        n = draw.randrange(0, most)
        for t in range(n):
            role = draw.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = draw.choice(["Hello.", "What?", "no end", "no end", " ", "", None, "A b!", "x.\n", f"t{t}.", f"t{t}!", f"t{t}"])
            rows.append((c if c else None, draw.choice([t, t, t, None, t + 2]), role, text))
    return rows


@pytest.mark.parametrize("block", [1, 2, 3, 4096])
def test_reports_are_those_of_all_edits(spark, monkeypatch, block):
    """Blocks of any size give the same: their summaries, ends and tokens fit together."""
    monkeypatch.setattr(V, "BLOCK", block)
    rows = drawn(block)
    convs = {r[0] for r in rows}
    filled = [(c, t, r or "", x or "") for c, t, r, x in rows]
    assert run(spark, rows) == plain_report(filled, convs)


def test_damage(spark):
    rows = drawn(9, 200)
    assert run(spark, rows, damage=True) == plain_report(plain_damage(rows), {r[0] for r in rows})
    df = spark.createDataFrame(rows, SHAPE)
    assert sorted(map(str, (tuple(r) for r in V.damaged(df).collect()))) == sorted(map(str, plain_damage(rows)))


def test_hirschberg_alone():
    draw = random.Random(4)
    for n in [0, 1, 2, 3, 7, 30, 90]:
        for _ in range(20):
            codes = bytes(draw.choice([0, 1, 2, 1, 2, 1, 2, 3, 4 + draw.randrange(4), 8 + draw.randrange(4)]) for _ in range(n))
            rows = [("sua-"[c & 3].strip("-"), bool(c & 4), bool(c & 8), "r", "t") for c in codes]
            cost, audit, _ = plain_edits(rows)
            tokens, paid = V.block_tokens(codes, V.BEGUN, -1)
            assert (paid, "".join(tokens)) == (cost, audit) and len(tokens) == n + 1


def test_one_conversation_with_most_rows(spark, monkeypatch):
    """A conversation of many blocks is solved in pieces, and its repeated rows are not one range."""
    monkeypatch.setattr(V, "BLOCK", 50)
    rows = [(7, t, ("user", "assistant")[t % 2], f"line {t}.") for t in range(400)] + [(7, None, "user", "again.")] * 100 + [(8, 0, "user", "hi.")]
    sys.setrecursionlimit(20_000)
    assert run(spark, rows) == plain_report(rows, {7, 8})


def test_repaired_rows_are_well_formed(spark):
    df = spark.createDataFrame(drawn(5), SHAPE)
    ordered = V.in_order(df)
    rows = V.repaired(ordered, V.edits(ordered), whole=True).collect()
    by = {}
    for r in rows:
        by[r.conv_id] = by.get(r.conv_id, "") + r.role[0]
        assert r.edit in "KRI" and (r.edit != "I" or (r.turn is None and r.text == ""))
    assert by and all(re.fullmatch("(s?(ua)+)?", v) for v in by.values())
    blockwise = V.repaired(ordered, V.edits(ordered)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, blockwise))


def test_edges(spark):
    assert run(spark, []) == []
    nothing = hashlib.sha256().hexdigest()
    assert run(spark, [(1, None, None, None)]) == [(1, 0, 1, 0, 0, 0, 2, "D", nothing)]
    long = "word " * 300_000 + "end."
    assert run(spark, [(1, 0, "user", long), (1, 1, "assistant", long)])[0][6:8] == (0, "KK")


def test_query(spark):
    from loomspark.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op11_conversations"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out), key=str) == plain_report(plain_damage(rows), {r[0] for r in rows})
