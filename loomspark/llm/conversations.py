"""Structure repair of conversations by Hirschberg's divide and conquer.

A conversation is well formed when its roles, by their initials, read `(s?(ua)+)?`: nothing, or
perhaps a system turn and then user and assistant in turn. That pattern has four states (begun,
after s, after u, after a). A row is kept, given another role or deleted, and rows are inserted, so that
the whole is well formed at least cost; of equally cheap edits those count whose initials are
least in ASCII order.

Each row is one token: the inserts before it and its own edit, in initials (`K`, `R`, `D`, `IK`, ...). No
token begins another one, so of two ways through the same rows the lesser is known at the first
token in which they differ, whatever follows. A forward vector holds, for each state after a
number of rows, the least cost and the rank of its least audit among the four; a backward vector
the least cost to the end. They meet in the middle, the crossing of least total cost and then of least rank is
taken, and both halves are solved in the same way: only vectors are held, never a table of all rows.

Rows are ordered by ranges (functions.ordered), and conversations cut in blocks of BLOCK rows: a
block is summed up by costs and ranks from each state to each, so blocks of one long
conversation are solved by different tasks once their ends are known.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running
from .common import staged

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a conversation that one task solves at once.
BLOCK = 4096
#: States: begun, after a system, a user and an assistant turn.
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
INITIALS = "sua"
#: A row's code: 0 to 2 its initial, 3 another one; 4 if it must go; 8 if it is truncated.
GONE, CUT = 4, 8
Vector = list[tuple[int, int]]


def _insert(state: int) -> int:
    """An insert leads on to the only turn of user or assistant that may follow."""
    return ASSISTANT if state == USER else USER


def _tokens(code: int) -> list[list[tuple[int, str] | None]]:
    """For each state before and after a row of this code: the least (cost, token) between them."""
    table: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for before in range(4):
        at = before
        for inserts in range(3):  # a third one would repeat a state
            paid = INSERT * inserts
            ways = [(at, DELETE, "D")]
            if not code & GONE:
                extra = TRUNCATED if code & CUT else 0
                ways.append((_insert(at), REROLE + extra, "R"))
                initial = code & 3
                follows = {0: SYSTEM if at == BEGUN else None, 1: USER if at != USER else None, 2: ASSISTANT if at == USER else None}.get(initial)
                if follows is not None:
                    ways.append((follows, extra, "K"))
            for after, cost, edit in ways:
                found = (paid + cost, "I" * inserts + edit)
                if table[before][after] is None or found < table[before][after]:
                    table[before][after] = found
            at = _insert(at)
    return table


TOKENS = [_tokens(code) for code in range(16)]
#: Cost and inserts from each state to a well-formed end.
TAIL = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


def start_from(state: int) -> Vector:
    return [(0, 0) if s == state else (FAR, s) for s in range(4)]


def forward(codes: bytes, vector: Vector) -> Vector:
    """Cost and rank of each state after the rows, from those before them."""
    for code in codes:
        table = TOKENS[code]
        best: list[tuple[int, int, str] | None] = [None] * 4
        for before, (cost, rank) in enumerate(vector):
            if cost < FAR:
                for after, way in enumerate(table[before]):
                    if way is not None:
                        found = (cost + way[0], rank, way[1])
                        if best[after] is None or found < best[after]:
                            best[after] = found
        order = {b[1:]: i for i, b in enumerate(sorted((b for b in best if b is not None), key=lambda b: b[1:]))}
        vector = [(FAR, 3) if b is None else (b[0], order[b[1:]]) for b in best]
    return vector


def backward(codes: bytes, costs: Sequence[int]) -> list[int]:
    """Least cost from each state before the rows to the states after them, which cost what costs says."""
    for code in reversed(codes):
        costs = [min((way[0] + costs[after] for after, way in enumerate(row) if way is not None), default=FAR) for row in TOKENS[code]]
    return list(costs)


def crossing(vector: Vector, costs: Sequence[int]) -> int:
    """The state of least total cost; of several the one whose audit so far is least."""
    return min(range(4), key=lambda s: (vector[s][0] + costs[s], vector[s][1]))


def solved(codes: bytes, before: int, after: int) -> list[str]:
    """The tokens of the least cheapest way through the rows from one state to another."""
    if len(codes) == 1:
        return [TOKENS[codes[0]][before][after][1]]
    if not codes:
        return []
    middle = len(codes) // 2
    ahead = backward(codes[middle:], [0 if s == after else FAR for s in range(4)])
    at = crossing(forward(codes[:middle], start_from(before)), ahead)
    return solved(codes[:middle], before, at) + solved(codes[middle:], at, after)


def block_tokens(codes: bytes, before: int, after: int) -> tuple[tuple[str, ...], int]:
    """Tokens and cost of a block; after -1: the conversation ends here, and its last inserts are one more token."""
    ends = forward(codes, start_from(before))
    if after >= 0:
        return tuple(solved(codes, before, after)), ends[after][0]
    last = crossing(ends, [cost for cost, _ in TAIL])
    return (*solved(codes, before, last), TAIL[last][1]), ends[last][0] + TAIL[last][0]


#: Short conversations are alike by the thousand: their answers are remembered.
_remembered = lru_cache(1 << 14)(block_tokens)


def block_summary(codes: bytes) -> tuple[list[int], list[int]]:
    """Cost and rank of each state after the block, from each state before it."""
    vectors = [forward(codes, start_from(s)) for s in range(4)]
    return [cost for v in vectors for cost, _ in v], [rank for v in vectors for _, rank in v]


def block_ends(costs: Sequence[Sequence[int]], ranks: Sequence[Sequence[int]]) -> list[tuple[int, int]]:
    """The states before and after each block of one conversation (-1 after the last), from the blocks' summaries in order."""
    vectors = [start_from(BEGUN)]
    for cost, rank in zip(costs, ranks, strict=True):
        best: list[tuple[int, int, int] | None] = [None] * 4
        for s, (paid, r) in enumerate(vectors[-1]):
            for e in range(4):
                if paid < FAR and cost[4 * s + e] < FAR:
                    found = (paid + cost[4 * s + e], r, rank[4 * s + e])
                    if best[e] is None or found < best[e]:
                        best[e] = found
        order = {b[1:]: i for i, b in enumerate(sorted((b for b in best if b is not None), key=lambda b: b[1:]))}
        vectors.append([(FAR, 3) if b is None else (b[0], order[b[1:]]) for b in best])
    ahead = [[cost for cost, _ in TAIL]]
    for cost in reversed(costs):
        ahead.append([min(cost[4 * s + e] + ahead[-1][e] for e in range(4)) for s in range(4)])
    at = [crossing(v, a) for v, a in zip(vectors, reversed(ahead), strict=True)]
    return [(at[i], at[i + 1] if i + 1 < len(costs) else -1) for i in range(len(costs))]


# --- rows ---


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by crc32 of `conv_id:turn` modulo 20, nulls as one space.

    0 drops a row, 1 empties its text, 2 takes its `[.!?]` away, 3 repeats it, 4 makes it a user's.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def in_order(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and pos, a row's place in its conversation from 0; null roles and texts are empty.

    Rows go by turn, nulls first; of one turn by role, the first 64 characters of the text and its MD5. Other columns are not kept.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # the last of these tells repeated rows apart, so that many of them are not one range
    rows = rows.withColumn("spot", F.monotonically_increasing_id())
    order = [F.col("turn").asc_nulls_first(), F.left("role", F.lit(64)).asc(), F.left("text", F.lit(64)).asc(), F.md5("text").asc(), F.col("spot").asc()]
    return running(rows, ["conv_id"], order, {"pos": F.lit(1)}).withColumn("pos", F.col("pos") - 1).drop("spot")


def _code(initial: Column, tail: Column, first: Column) -> tuple[Column, Column]:
    """A row's code and its fault (blank, duplicate, truncated or null) from its role's initial and its last character."""
    fault = F.when(tail == "", "blank").when(~first, "duplicate").when(~tail.isin(".", "!", "?"), "truncated")
    initial = F.array_position(F.array(*[F.lit(c) for c in INITIALS]), initial)
    code = F.when(initial > 0, initial - 1).otherwise(3) + F.when(fault.isin("blank", "duplicate"), GONE).when(fault == "truncated", CUT).otherwise(0)
    return code.cast("int"), fault


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [block_summary(bytes(c)) for c in batch.column("codes").to_pylist()]
        yield pa.RecordBatch.from_pydict({
            "conv_id": batch.column("conv_id"), "block": batch.column("block"),
            "costs": pa.array([f[0] for f in found], pa.list_(pa.int64())), "ranks": pa.array([f[1] for f in found], pa.list_(pa.int32())),
        })


def _ends(table: pa.Table) -> pa.Table:
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("block", "costs", "ranks")), strict=True))
    ends = block_ends([r[1] for r in rows], [r[2] for r in rows])
    blocks = pa.array([r[0] for r in rows], pa.int64())
    conv = pa.array([table.column("conv_id")[0].as_py()] * len(rows), table.schema.field("conv_id").type)
    return pa.table({"conv_id": conv, "block": blocks, "before": pa.array([e[0] for e in ends], pa.int32()), "after": pa.array([e[1] for e in ends], pa.int32())})


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(_remembered if len(c) <= 32 else block_tokens)(bytes(c), b, a) for c, b, a in zip(*(batch.column(n).to_pylist() for n in ("codes", "before", "after")), strict=True)]
        same = {c: batch.column(c) for c in batch.schema.names if c not in ("codes", "after", "n_blocks")}
        yield pa.RecordBatch.from_pydict(same | {"tokens": pa.array([list(f[0]) for f in found], pa.list_(pa.string())), "cost": pa.array([f[1] for f in found], pa.int64())})


def edits(ordered: DataFrame) -> DataFrame:
    """One row per block of a conversation: conv_id, block, before (its state), tokens, cost, blank, duplicate, truncated, illegal.

    ordered is what in_order gives. tokens has one entry for each of the block's rows, and in
    the last block one more, of the inserts at the end. illegal counts neighbours whose initials do not follow each
    other. Texts are read where they lie; only 16 bytes and a code of each row are shuffled.
    """
    spark = ordered.sparkSession
    conv = ordered.schema["conv_id"].dataType.simpleString()
    first = ordered.groupBy("conv_id", "role", F.md5("text").alias("digest")).agg(F.min("pos").alias("pos")).select(F.col("conv_id").alias("_conv"), F.col("pos").alias("_pos"), F.lit(True).alias("first"))
    slim = ordered.select("conv_id", "pos", F.left("role", F.lit(1)).alias("initial"), F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).alias("tail"))
    known = slim.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    code, fault = _code(F.col("initial"), F.col("tail"), F.coalesce("first", F.lit(False)))
    block = F.floor(F.col("pos") / BLOCK)
    # a block's last row is also shown to the next block, for the neighbours that they are
    coded = known.select("conv_id", "pos", code.alias("code"), fault.alias("fault"), F.explode(F.when(F.col("pos") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"))
    own = F.floor(F.col("pos") / BLOCK) == F.col("block")
    count = lambda name: F.count_if(own & (F.col("fault") == name)).alias(name)
    cells = F.array_sort(F.collect_list(F.struct("pos", "code")))  # BLOCK + 1 at most
    blocks = coded.groupBy("conv_id", "block").agg(cells.alias("cells"), *[count(f) for f in ("blank", "duplicate", "truncated")], F.count_if(own).alias("n"), F.min("pos").alias("from")).filter("n > 0")
    initials = F.transform("cells", lambda x: x["code"].bitwiseAND(F.lit(3)))
    # s before u, u before a, a before u
    lawful = lambda a, b: ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
    pairs = F.filter(F.zip_with(F.slice(initials, 1, F.size(initials) - 1), F.slice(initials, 2, F.size(initials) - 1), lambda a, b: ~lawful(a, b)), lambda x: x)
    codes = F.transform(F.filter("cells", lambda x: F.floor(x["pos"] / BLOCK) == F.col("block")), lambda x: x["code"])
    blocks = staged(blocks.select("conv_id", "block", codes.alias("codes"), "blank", "duplicate", "truncated", F.when(F.size("cells") > 1, F.size(pairs)).otherwise(0).cast("long").alias("illegal")))
    long = blocks.filter("block > 0").select(F.col("conv_id").alias("_conv")).distinct()  # conversations of more than one block
    in_long = F.col("conv_id").eqNullSafe(F.col("_conv"))
    parts = blocks.join(long, in_long, "left_semi").select("conv_id", "block", "codes").mapInArrow(_summaries, f"conv_id {conv}, block long, costs array<long>, ranks array<int>")
    ends = parts.groupBy("conv_id").applyInArrow(_ends, f"conv_id {conv}, block long, before int, after int")  # a row for each 4,096 of a conversation
    ends = ends.withColumnsRenamed({"conv_id": "_conv", "block": "_block"})
    placed = blocks.join(ends, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")), "left").withColumns({"before": F.coalesce("before", F.lit(BEGUN)), "after": F.coalesce("after", F.lit(-1))}).drop("_conv", "_block")
    kinds = "tokens array<string>, cost long"
    return staged(placed.mapInArrow(_edits, f"conv_id {conv}, block long, blank long, duplicate long, truncated long, illegal long, before int, {kinds}"))


def _repaired(conv_type: pa.DataType, turn_type: pa.DataType):
    names = ("conv_id", "edit", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[str] = []
        state, base = BEGUN, 0
        for batch in batches:
            out: list[tuple] = []
            for conv, pos, block, before, made, turn, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "pos", "kind", "before", "tokens", "turn", "role", "text")), strict=True):
                if block == 0:  # the edits of the rows that follow
                    tokens, state, base = made, before, pos
                    continue
                token = tokens[pos - base]
                if block == 1:
                    for _ in token[:-1]:
                        state = _insert(state)
                        out.append((conv, "I", None, "user" if state == USER else "assistant", ""))
                    edit = token[-1]
                    if edit == "R":
                        state = _insert(state)
                        role = "user" if state == USER else "assistant"
                    elif edit == "K":
                        state = 1 + INITIALS.index(role[0])
                    if edit != "D":
                        out.append((conv, edit, turn, role, text))
                else:
                    for _ in token:
                        state = _insert(state)
                        out.append((conv, "I", None, "user" if state == USER else "assistant", ""))
            columns = list(zip(*out, strict=True)) if out else [()] * 5
            kinds = (conv_type, pa.string(), turn_type, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def repaired(ordered: DataFrame, made: DataFrame, whole: bool = False) -> DataFrame:
    """The rows of the repaired conversations: conv_id, edit (K, R or I), turn, role, text; inserted rows have no turn and an empty text.

    ordered comes from in_order and made from edits. Rows are dealt by blocks and are in order within a
    partition; with whole by conversations, so that each is in one piece, which only a digest of it needs.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    conv, turn = (ordered.schema[c].dataType for c in ("conv_id", "turn"))
    block = F.floor(F.col("pos") / BLOCK)
    nothing = {"before": F.lit(None).cast("int"), "tokens": F.lit(None).cast("array<string>")}
    rows = ordered.select("conv_id", "pos", block.alias("block"), F.lit(1).alias("kind"), "turn", "role", "text").withColumns(nothing)
    empty = {"turn": F.lit(None).cast(turn), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    head = made.select("conv_id", (F.col("block") * BLOCK).alias("pos"), "block", F.lit(0).alias("kind"), "before", "tokens").withColumns(empty)
    last = made.groupBy("conv_id").agg(F.max_by(F.struct("block", F.size("tokens").alias("n")), "block").alias("e")).select("conv_id", (F.col("e.block") * BLOCK + F.col("e.n") - 1).alias("pos"), F.col("e.block").alias("block"), F.lit(2).alias("kind")).withColumns(empty | nothing)
    dealt = rows.unionByName(head).unionByName(last).repartition(*(["conv_id"] if whole else ["conv_id", "block"]))
    dealt = dealt.sortWithinPartitions("conv_id", "block", F.when(F.col("kind") == 0, 0).otherwise(1), "pos", "kind")
    shape = f"conv_id {conv.simpleString()}, edit string, turn {turn.simpleString()}, role string, text string"
    return dealt.select("conv_id", "pos", "kind", "before", "tokens", "turn", "role", "text").mapInArrow(_repaired(to_arrow_type(conv), to_arrow_type(turn)), shape)


def _digests(conv_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """SHA-256 of each conversation's `role:text` lines; rows of one follow each other."""
        open_for, digest = None, None

        def closed(done: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"conv_id": pa.array([d[0] for d in done], conv_type), "repaired_sha256": pa.array([d[1] for d in done], pa.string())})

        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if digest is None or conv != open_for:
                    if digest is not None:
                        done.append((open_for, digest.hexdigest()))
                    open_for, digest = conv, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if done:
                yield closed(done)
        if digest is not None:
            yield closed([(open_for, digest.hexdigest())])

    return run


def repair_report(turns: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    originals names conversations that have a row even where turns has none of theirs: zeros, an empty
    audit and the hash of nothing. A null conv_id is a conversation. Texts null or empty are blank
    and their rows are deleted, repeated rows are duplicates; roles of another initial are given one or deleted.
    Columns other than conv_id, turn, role and text are not read; an empty table gives an empty result.

    An audit has a letter for each row and edit, and a digest runs over a whole repaired text, so that much of one
    conversation is read by one task, as a stream; edits and repaired are not so bound.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    ordered = in_order(turns)
    made = edits(ordered)
    gaps = ordered.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")).cast("long").alias("gaps"))
    strings = F.array_sort(F.collect_list(F.struct("block", F.array_join("tokens", "").alias("s"))))
    audits = made.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], F.array_join(F.transform(strings, lambda x: x["s"]), "").alias("audit"))
    conv = ordered.schema["conv_id"].dataType
    digests = repaired(ordered, made, whole=True).mapInArrow(_digests(to_arrow_type(conv)), f"conv_id {conv.simpleString()}, repaired_sha256 string")
    out = (turns if originals is None else originals).select("conv_id").distinct()
    for part in (gaps, audits, digests):
        part = part.withColumnRenamed("conv_id", "_conv")
        out = out.join(part, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    longs = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
