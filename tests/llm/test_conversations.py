"""Conversation repair against a search over whole audit strings, row by row."""

import hashlib
import itertools
import random
import zlib

import pytest

from lectern.llm import conversations
from lectern.llm.queries import QUERIES

BLANKS = " \t\n\x0b\x0c\r"
INITIALS = {"": "", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    """``rows``: (conv_id, turn, role, text)."""
    out = []
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (c, turn)).encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else "".join(x for x in text if x not in ".!?") if fault == 2 else text
        out += [(c, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def cheapest(rows):
    """``rows``: (initial, truncated, must go). The least cost and its least audit, from the back."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": (6, "II"), "u": (3, "I"), "a": (0, "")}
    for initial, truncated, must_go in reversed(rows):
        plain = {}
        for state in allowed:
            cost, audit = best[state]
            options = [(cost + 4, "D" + audit)]
            if not must_go:
                if initial in allowed[state] and initial:
                    cost, audit = best[initial]
                    options.append((cost + 3 * truncated, "K" + audit))
                cost, audit = best[INITIALS[state] or "u"]
                options.append((cost + 3 + 3 * truncated, "R" + audit))
            plain[state] = min(options)
        for _ in range(3):
            for state in allowed:
                cost, audit = plain[INITIALS[state] or "u"]
                plain[state] = min(plain[state], (cost + 3, "I" + audit))
        best = plain
    return best[""]


def plainly(rows):
    """What ``repair`` should give of the damaged rows of one conversation."""

    def digest(r):
        return hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()

    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, digest(r)))
    seen, classes, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        bare = text.rstrip(BLANKS)
        truncated = bool(bare) and bare[-1] not in ".!?"
        again = (role, text) in seen
        seen.add((role, text))
        if not bare or again:
            counts[0 if not bare else 1] += 1
        elif truncated:
            counts[2] += 1
        classes.append((role[:1], truncated, not bare or again))
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = cheapest(classes)
    state, lines, left = "", [], iter(rows)
    for edit in audit:
        if edit == "I":
            state = INITIALS[state] or "u"
            lines.append(("user" if state == "u" else "assistant") + ":")
            continue
        _, _, role, text = next(left)
        if edit == "R":
            state = INITIALS[state] or "u"
            role = "user" if state == "u" else "assistant"
        elif edit == "K":
            state = role[0]
        if edit != "D":
            lines.append(f"{role}:{text}")
    assert next(left, None) is None
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def wanted(rows, keep=damaged):
    left = keep(rows)
    return {c: plainly([r for r in left if r[0] == c]) for c in {r[0] for r in rows}}


def told(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


def random_rows(seed, conversations_, length):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "What?", "a.b", "end!\n", " ", "x. "]
    roles = ["user", "assistant", "system", "tool", "", "a", "Up", None]
    rows = []
    for c in range(conversations_):
        for turn in range(rng.randrange(length)):
            weights = [9, 9, 2, 1, 1, 1, 1, 1]
            text = f"line {turn}." if rng.random() < 0.6 else rng.choice(texts)
            rows.append((c, rng.choice([turn, turn, None]), rng.choices(roles, weights)[0], text))
    return rows


def test_matrices_agree_with_whole_audits():
    """Every block size folds to the same costs, and the crossings spell the least audit."""
    rng = random.Random(3)
    for _ in range(400):
        codes = [rng.choice([0, 1, 2, 3, 1, 2]) + 4 * (rng.random() < 0.3) + 8 * (rng.random() < 0.2) for _ in range(rng.randrange(1, 14))]
        rows = [("suax"[c & 3], c >> 2 & 1, c >> 3) for c in codes]
        matrix = conversations.folded([conversations.ROWS[c] for c in codes])
        cost, end = conversations.ending(matrix)
        audit = conversations.block_audit(codes, conversations.START, end) + conversations._TAIL[end]
        assert (cost, audit) == cheapest(rows)
        cut = rng.randrange(len(codes))
        halves = [conversations.folded([conversations.ROWS[c] for c in part]) for part in (codes[:cut], codes[cut:]) if part]
        assert conversations.folded(halves) == matrix


@pytest.mark.parametrize(("block", "fan"), [(4096, 4096), (3, 2)])
def test_random_conversations(spark, block, fan):
    rows = random_rows(11, 60, 12) + [(None, 3, "user", "Null id."), (None, None, None, None)]
    turns = table(spark, rows)
    got = conversations.repair(conversations.damage(turns), conversations=turns.select("conv_id"), block=block, fan=fan)
    assert told(got) == wanted(rows)


def test_a_conversation_of_most_rows(spark):
    rng = random.Random(8)
    rows = [(7, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice([f"t{t}.", "again.", "cut"])) for t in range(3000)]
    rows += [(7, None, "user", "same.")] * 500 + random_rows(2, 40, 8)
    turns = table(spark, rows).repartition(6)
    got = conversations.repair(turns, block=50, fan=4)
    assert told(got) == wanted(rows, keep=lambda r: [(c, t, " " if a is None else a, x) for c, t, a, x in r])


def test_repaired_turns_are_in_order(spark):
    rows = random_rows(5, 30, 10)
    repaired = conversations.repair(table(spark, rows), with_turns=True).collect()
    whole = told(conversations.repair(table(spark, rows)))
    for c, facts in whole.items():
        lines = sorted((r["place"], r["role"], r["text"]) for r in repaired if r["conv_id"] == c)
        assert [x[0] for x in lines] == list(range(1, len(lines) + 1))
        roles = "".join(x[1][0] for x in lines)
        assert roles.removeprefix("s").replace("ua", "") == "" and (roles != "s")
        assert hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in lines).encode()).hexdigest() == facts[-1]


def test_nothing_left_and_empty_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    turns = table(spark, [(5, gone, "user", "Gone.")])
    got = conversations.repair(conversations.damage(turns), conversations=turns.select("conv_id"))
    assert told(got) == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert conversations.repair(table(spark, [])).collect() == []
    assert conversations.repair(conversations.damage(table(spark, [])), with_turns=True).collect() == []


def test_clashing_columns_and_other_key_types(spark):
    rows = [("x", 1, "user", "Hi."), ("x", 2, "assistant", "Ho."), (None, 1, "user", "Hi.")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "id string, at int, who string, said string, c int, pos int, digest int")
    got = told(conversations.repair(df, "id", "at", "who", "said"))
    assert got["x"][5:7] == (0, "KK") and got[None][5:7] == (3, "KI")


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert told(QUERIES["op13_conversation_repair"](spark, sf)) == wanted(rows)
