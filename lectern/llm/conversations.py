"""Conversation structure repair: the cheapest edits that make the roles of a conversation alternate.

A conversation is in order if its roles read ``(system? (user assistant)+)?`` by their first letters. Rows
are kept (0), given another role (3) or deleted (4, a must for blank and duplicate ones), empty rows are
inserted (3); a truncated row that stays adds 3. What a prefix of a conversation leaves behind is one of
four states: nothing yet, after system, after user, after assistant.

The edits are found by Hirschberg's divide and conquer. A forward vector (for each state the least cost of
the first half, and the rank of its least audit among the four) meets a backward vector (the least cost of the
second half) in the middle; the crossing of least total cost, and of these the one of least rank, splits the
conversation in two, and both halves are solved alike. Two different audits of the same rows never continue
each other, as they end in an edit that uses up a row; so ranks decide ties as the whole strings would.

In Spark, rows are sorted by ranges of (conversation, turn) and numbered, and blocks of at most BLOCK rows are
folded to four by four costs and ranks each, which add up like rows do. So a conversation of any length is
solved top down: crossings between nodes of a tree first, then inside the blocks, each in a task of its own.
Only the digest of a repaired text has to read its conversation in order; it does so as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lectern.llm.tasks import stored

BLOCK = 4096
# Nodes that are solved together; a conversation with more gets another level.
FAN = 4096

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
_OTHER = 3
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 50
# What ends a conversation from each state.
_TAIL = ("", "II", "I", "")

# A matrix: 16 costs [from, to], then 16 ranks of the audits that lead from a state to each other one.
Matrix = tuple[int, ...]
# A vector: 4 costs, then 4 ranks.
Vector = tuple[int, ...]


def _edits(code: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest, then least, edits of one row from state to state, with rows inserted before it.

    ``code``: initial of the role (s, u, a, other) + 4 if truncated + 8 if it must go.
    """
    initial, truncated, must_go = code & 3, code >> 2 & 1, code >> 3
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for begin in _STATES:
        state = begin
        for inserted in range(3):
            found = [(4, "D", state)]
            if not must_go:
                found.append((3 + 3 * truncated, "R", _NEXT[state]))
                if initial == 0 and state == START:
                    found.append((3 * truncated, "K", SYSTEM))
                elif initial == 1 and state != USER or initial == 2 and state == USER:
                    found.append((3 * truncated, "K", _NEXT[state]))
            for cost, letter, end in found:
                edit = (3 * inserted + cost, "I" * inserted + letter)
                best[begin, end] = min(edit, best.get((begin, end), edit))
            state = _NEXT[state]
    return best


def _matrix(edits: dict[tuple[int, int], tuple[int, str]]) -> Matrix:
    costs, ranks = [], []
    for begin in _STATES:
        order = sorted(edits[begin, end][1] for end in _STATES if (begin, end) in edits)
        for end in _STATES:
            cost, audit = edits.get((begin, end), (_NEVER, ""))
            costs.append(cost)
            ranks.append(order.index(audit) if cost < _NEVER else 4)
    return (*costs, *ranks)


_EDITS = [_edits(code) for code in range(16)]
ROWS: list[Matrix] = [_matrix(edits) for edits in _EDITS]


def _at(state: int) -> Vector:
    return (*(0 if s == state else _NEVER for s in _STATES), 0, 0, 0, 0)


@lru_cache(maxsize=50_000)
def _forward(vector: Vector, matrix: Matrix) -> tuple[int, Vector]:
    """The vector behind a matrix, with its least cost taken out."""
    came, costs = [0] * 4, [_NEVER] * 4
    for end in _STATES:
        options = [(vector[s] + matrix[4 * s + end], vector[4 + s], s) for s in _STATES]
        cost, _, came[end] = min(options)
        costs[end] = min(cost, _NEVER)
    order = sorted(_STATES, key=lambda e: (0, vector[4 + came[e]], matrix[16 + 4 * came[e] + e]) if costs[e] < _NEVER else (1, e, 0))
    least = min(costs)
    return least, (*(c - least if c < _NEVER else _NEVER for c in costs), *(order.index(e) for e in _STATES))


@lru_cache(maxsize=50_000)
def _backward(costs: Vector, matrix: Matrix) -> Vector:
    """Costs before a matrix from those behind it, up to a constant."""
    found = [min(min(matrix[4 * s + e] + costs[e] for e in _STATES), _NEVER) for s in _STATES]
    least = min(found)
    return tuple(c - least if c < _NEVER else _NEVER for c in found)


def folded(matrices: list[Matrix]) -> Matrix:
    """One matrix for a run of rows or nodes."""
    costs, ranks = [], []
    for begin in _STATES:
        total, vector = 0, _at(begin)
        for matrix in matrices:
            least, vector = _forward(vector, matrix)
            total += least
        costs += [c + total if c < _NEVER else _NEVER for c in vector[:4]]
        ranks += vector[4:]
    return (*costs, *ranks)


def crossings(matrices: list[Matrix], begin: int, end: int) -> list[int]:
    """States between the matrices on the cheapest, then least, way from ``begin`` to ``end``."""
    n = len(matrices)
    if n < 2:
        return []
    middle = n // 2
    ahead = _at(begin)
    for matrix in matrices[:middle]:
        ahead = _forward(ahead, matrix)[1]
    behind = _at(end)[:4]
    for matrix in reversed(matrices[middle:]):
        behind = _backward(behind, matrix)
    at = min(_STATES, key=lambda s: (ahead[s] + behind[s], ahead[4 + s]))
    return [*crossings(matrices[:middle], begin, at), at, *crossings(matrices[middle:], at, end)]


def ending(matrix: Matrix) -> tuple[int, int]:
    """Least cost of a whole conversation with this matrix, and the state behind its last row."""
    return min((matrix[s] + 3 * len(_TAIL[s]), matrix[16 + s], s) for s in _STATES)[::2]


def block_audit(codes: list[int], begin: int, end: int) -> str:
    """The edits of a block that is entered and left in given states."""
    states = [begin, *crossings([ROWS[c] for c in codes], begin, end), end]
    return "".join(_EDITS[c][a, b][1] for c, a, b in zip(codes, states, states[1:], strict=False))


def damage(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` (these four columns) with faults planted by the crc32 of ``id:turn``, modulo 20.

    0 drops a row, 1 empties its text, 2 takes the marks ``.!?`` out of it, 3 repeats it, 4 makes its role
    ``user``. Null counts as one space in role, text and the key of the checksum.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (id, turn)])
    fault = (F.crc32(key.cast("binary")) % 20).cast("int")
    role_, text_ = (F.coalesce(F.col(c), F.lit(" ")) for c in (role, text))
    rows = turns.select(
        id,
        turn,
        F.when(fault == 4, "user").otherwise(role_).alias(role),
        F.when(fault == 1, "").when(fault == 2, F.translate(text_, ".!?", "")).otherwise(text_).alias(text),
        F.explode(F.when(fault == 0, F.array().cast("array<int>")).when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"),
    )
    return rows.drop("_copy")


def _same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _numbered(rows: DataFrame) -> DataFrame:
    """Narrow rows in order: c, turn, digest, flags, pos; stored.

    Equal rows are told apart by their place in the input, so that any number of them is spread over ranges.
    """
    bare = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "c",
        "turn",
        _digest().alias("digest"),
        (F.length(bare) == 0).alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(_OTHER).alias("initial"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = [F.asc_nulls_first("c"), F.asc_nulls_first("turn"), F.asc("digest")]
    ordered = narrow.repartitionByRange(*order, F.asc("row")).sortWithinPartitions(*order)
    return stored(ordered.drop("row").withColumn("pos", F.monotonically_increasing_id()), "turns")


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _flagged(numbered: DataFrame) -> DataFrame:
    """Adds ``fault`` (the first that holds: 1 blank, 2 duplicate, 3 truncated, else 0) and ``code``."""
    again = numbered.groupBy("c", "digest").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = again.select(F.col("c").alias("_c"), F.col("digest").alias("_d"), "_first")
    joined = numbered.join(again, _same(F.col("c"), F.col("_c")) & (F.col("digest") == F.col("_d")), "left")
    repeated = F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
    fault = F.when(F.col("blank"), 1).when(repeated, 2).when(F.col("open"), 3).otherwise(0)
    code = F.col("initial") + 4 * F.col("open").cast("int") + 8 * (F.col("blank") | repeated).cast("int")
    return joined.select("c", "turn", "pos", fault.alias("fault"), code.alias("code"))


_NODE = "matrix array<bigint>, first int, last int, illegal bigint"


def _joined_illegally(before: int, after: int) -> bool:
    """Initials (s, u, a, other) that may not stand side by side."""
    return (before, after) not in ((0, 1), (1, 2), (2, 1))


def _mapped(df: DataFrame, one, schema: str, keys: list[str], inputs: list[str], outputs: list[str]) -> DataFrame:
    """``keys`` as they are, and what ``one`` makes of each row of ``inputs``: a list of tuples of ``outputs``."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    empty = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            taken, made = [], []
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in inputs), strict=True)):
                for out in one(*row):
                    taken.append(i)
                    made.append(out)
            columns = [batch.column(k).take(pa.array(taken, pa.int64())) for k in keys]
            columns += [pa.array([m[j] for m in made], empty.field(j).type) for j in range(len(outputs))]
            yield pa.RecordBatch.from_arrays(columns, [*keys, *outputs])

    return df.select(*keys, *[c for c in inputs if c not in keys]).mapInArrow(run, f"{kinds}, {schema}")


def _block_node(codes: list[int]) -> list[tuple]:
    initials = [c & 3 for c in codes]
    illegal = sum(map(_joined_illegally, initials, initials[1:]))
    return [(list(folded([ROWS[c] for c in codes])), initials[0], initials[-1], illegal)]


def _parent_node(children: list[dict]) -> list[tuple]:
    illegal = sum(c["illegal"] for c in children)
    illegal += sum(_joined_illegally(a["last"], b["first"]) for a, b in zip(children, children[1:], strict=False))
    return [(list(folded([tuple(c["matrix"]) for c in children])), children[0]["first"], children[-1]["last"], illegal)]


def _solved_root(children: list[dict]) -> list[tuple]:
    """Every child with its states; the first one carries cost, illegal pairs and tail of the conversation."""
    matrix, _, _, illegal = _parent_node(children)[0]
    cost, end = ending(tuple(matrix))
    states = [START, *crossings([tuple(c["matrix"]) for c in children], START, end), end]
    return [
        (child["node"], a, b, cost if k == 0 else None, illegal if k == 0 else None, _TAIL[end] if k == 0 else None)
        for k, (child, a, b) in enumerate(zip(children, states, states[1:], strict=False))
    ]


def _solved_node(children: list[dict], begin: int, end: int) -> list[tuple]:
    states = [begin, *crossings([tuple(c["matrix"]) for c in children], begin, end), end]
    return [(child["node"], a, b) for child, a, b in zip(children, states, states[1:], strict=False)]


def _families(nodes: DataFrame, parent: Column | None) -> DataFrame:
    """Children of a parent (or of a conversation) in order; at most FAN."""
    children = F.array_sort(F.collect_list(F.struct("node", "matrix", "first", "last", "illegal"))).alias("children")
    keys = ["c"] if parent is None else ["c", parent.alias("parent")]
    return nodes.groupBy(*keys).agg(children)


def _solve(blocks: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """States of each block (c, node, begin, end) and the totals of each conversation (c, cost, illegal, tail)."""
    level = stored(_mapped(blocks, _block_node, _NODE, ["c", "node"], ["codes"], ["matrix", "first", "last", "illegal"]), "nodes")
    below = []
    while (level.groupBy("c").count().agg(F.max("count")).first()[0] or 0) > fan:
        families = stored(_families(level, F.expr(f"node div {fan}")), "families")
        below.append(families)
        level = _mapped(families, _parent_node, _NODE, ["c", "parent"], ["children"], ["matrix", "first", "last", "illegal"])
        level = stored(level.withColumnRenamed("parent", "node"), "nodes")
    names = ["node", "begin", "end"]
    solved = _mapped(
        _families(level, None),
        _solved_root,
        "node bigint, begin int, end int, cost bigint, illegal bigint, tail string",
        ["c"],
        ["children"],
        [*names, "cost", "illegal", "tail"],
    )
    solved = stored(solved, "solved")
    totals = solved.where("cost is not null").select("c", "cost", "illegal", "tail")
    for families in reversed(below):
        own = solved.select(F.col("c").alias("_c"), F.col("node").alias("_n"), "begin", "end")
        met = families.join(own, _same(F.col("c"), F.col("_c")) & (F.col("parent") == F.col("_n")))
        met = _mapped(met, _solved_node, "node bigint, begin int, end int", ["c"], ["children", "begin", "end"], names)
        solved = stored(met, "solved")
    return solved.select("c", *names), totals


_HEAD, _AUDIT, _TAIL_KIND, _TEXT = range(4)
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Replay:
    """Reads the records of conversations in order and replays their audits on the rows."""

    def __init__(self, turns: bool):
        self.turns, self.open = turns, False
        self.out: list[list] = []
        self.weight = 0

    def head(self, key, counts: list[int]) -> None:
        self.key, self.counts, self.open = key, counts, True
        self.audit: list[str] | str = []
        self.state, self.at, self.lines, self.hash = START, 0, 0, hashlib.sha256()

    def line(self, role: str, text: str, edit: str) -> None:
        self.lines += 1
        if self.turns:
            self.out.append([self.key, self.lines, role, text, edit])
            self.weight += 50 + len(text)
        else:
            self.hash.update((("\n" if self.lines > 1 else "") + role + ":" + text).encode())

    def inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state, self.at = _NEXT[self.state], self.at + 1
            self.line(_ROLE[self.state], "", "I")

    def row(self, role: str, text: str) -> None:
        if isinstance(self.audit, list):
            self.audit = "".join(self.audit)
        self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            self.state = _NEXT[self.state]
            self.line(_ROLE[self.state], text, edit)
        elif edit == "K":
            self.state = SYSTEM if role[0] == "s" else _NEXT[self.state]
            self.line(role, text, edit)

    def close(self) -> None:
        if not self.open:
            return
        self.audit, self.open = "".join(self.audit), False
        self.inserted()
        if not self.turns:
            self.out.append([self.key, *self.counts, self.audit, self.hash.hexdigest()])
            self.weight += 150 + len(self.audit)


def repair(
    turns: DataFrame,
    id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    conversations: DataFrame | None = None,
    with_turns: bool = False,
    block: int = BLOCK,
    fan: int = FAN,
) -> DataFrame:
    """One row per conversation: ``id``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows come by ``turn`` (an integer, nulls first), rows of one turn by a digest of role and text. A row counts as
    blank, duplicate (role and text stood before) or truncated (its last character that is not blank is none of
    ``.!?``), whichever comes first. ``gaps`` counts turns missing between the least and the greatest, ``illegal``
    neighbours whose roles do not follow each other. ``audit`` has an initial for each edit (Keep, Rerole, Delete,
    Insert), the least string of those of least ``cost``; the digest is of ``role:text`` lines of what results.

    With ``with_turns``, the repaired rows come instead: ``id``, place (from 1), role, text, edit. ``conversations``
    (``id``) names conversations that get a row even if ``turns`` has none of theirs: zeros, an empty audit,
    the digest of an empty text. Nulls in role or text are one space; rows without an id are one conversation.
    Repeated rows are duplicates; an empty table gives an empty one; other columns are not read. ``block`` and
    ``fan`` do not change results.
    """
    one_space = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = turns.select(F.col(id).alias("c"), F.col(turn).cast("bigint").alias("turn"), *one_space)
    numbered = _numbered(rows)
    flagged = stored(_flagged(numbered), "flagged")
    place = F.expr(f"pos div {block}").alias("node")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("pos", "code"))), lambda x: x["code"])
    blocks = stored(flagged.groupBy("c", place).agg(codes.alias("codes")), "blocks")
    solved, totals = _solve(blocks, fan)
    own = solved.select(F.col("c").alias("_c"), F.col("node").alias("_n"), "begin", "end")
    met = blocks.join(own, _same(F.col("c"), F.col("_c")) & (F.col("node") == F.col("_n")))
    audits = _mapped(met, lambda *x: [(block_audit(*x),)], "audit string", ["c", "node"], ["codes", "begin", "end"], ["audit"])
    counts = flagged.groupBy("c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == k).alias(n) for k, n in enumerate(_COUNTS[1:4], 1)],
    )
    named = rows.select("c") if conversations is None else rows.select("c").unionByName(conversations.select(F.col(id).alias("c")))
    heads = named.distinct()
    for table in (counts, totals):
        heads = heads.join(table.withColumnRenamed("c", "_c"), _same(F.col("c"), F.col("_c")), "left").drop("_c")
    numbers = F.array(*[F.coalesce(n, F.lit(0).cast("bigint")) for n in _COUNTS])
    none = F.lit(None)
    shape = ["c", "kind", "node", "turn", "digest", "numbers", "role", "text"]
    kinds = [None, "int", "bigint", "bigint", "binary", "array<bigint>", "string", "string"]

    def records(df: DataFrame, kind: int, **columns) -> DataFrame:
        given = {"c": F.col("c"), "kind": F.lit(kind), **columns}
        return df.select(*[(given.get(n, none) if k is None else given.get(n, none).cast(k)).alias(n) for n, k in zip(shape, kinds, strict=True)])

    every = records(heads, _HEAD, numbers=numbers)
    every = every.unionByName(records(audits, _AUDIT, node=F.col("node"), text=F.col("audit")))
    every = every.unionByName(records(totals, _TAIL_KIND, text=F.col("tail")))
    every = every.unionByName(records(rows, _TEXT, turn=F.col("turn"), digest=_digest(), role=F.col("role"), text=F.col("text")))
    order = [F.asc_nulls_first("c"), "kind", "node", F.asc_nulls_first("turn"), "digest"]
    every = every.repartition("c").sortWithinPartitions(*order).select("c", "kind", "numbers", "role", "text")
    kind = turns.schema[id].dataType.simpleString()
    if with_turns:
        schema = f"`{id}` {kind}, place bigint, role string, text string, edit string"
    else:
        schema = f"`{id}` {kind}, " + ", ".join(f"{n} bigint" for n in _COUNTS) + ", audit string, repaired_sha256 string"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = _Replay(with_turns)

        def made() -> pa.RecordBatch:
            columns = list(zip(*replay.out, strict=True)) or [()] * len(target)
            replay.out, replay.weight = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, target, strict=True)], target.names)

        for batch in batches:
            for key, what, numbers, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == _HEAD:
                    replay.close()
                    replay.head(key, numbers)
                elif what == _TEXT:
                    replay.row(role, text)
                else:
                    replay.audit.append(text)
                if replay.weight > 4 << 20:
                    yield made()
        replay.close()
        yield made()

    return every.mapInArrow(run, schema)
