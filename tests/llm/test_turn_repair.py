import hashlib
import itertools
import random
import re
import zlib

from ledgermill.llm import auction, turn_repair
from ledgermill.llm.repair_queries import op12_turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int"


def dp(codes):
    """Least (cost, letters) by plain dynamic programming; codes are (initial, status) per turn."""
    best = {0: (0, "")}

    def inserts(found):
        for _ in range(2):
            for s, (c, a) in list(found.items()):
                to = auction.NEXT[s]
                found[to] = min(found.get(to, (10**9, "")), (c + 3, a + "I"))
        return found

    best = inserts(best)
    for initial, status in codes:
        after = {}
        for s, (c, a) in best.items():
            ways = [("D", 4, s)]
            if status != "f":
                extra = 3 * (status == "t")
                ways.append(("R", 3 + extra, auction.NEXT[s]))
                if (s, initial) in auction.KEEPS:
                    ways.append(("K", extra, auction.KEEPS[s, initial]))
            for letter, cost, to in ways:
                after[to] = min(after.get(to, (10**9, "")), (c + cost, a + letter))
        best = inserts(after)
    return min(best[s] for s in (0, 3) if s in best)


def every_edit(codes):
    """Least (cost, letters) of all edits of up to two insertions at a place."""
    found = []
    for letters in itertools.product("KRD", repeat=len(codes)):
        for gaps in itertools.product(range(3), repeat=len(codes) + 1):
            cost, state, ok, audit = 0, 0, True, ""
            for (initial, status), letter, n in zip([*codes, ("", "")], [*letters, ""], gaps):
                for _ in range(n):
                    state = auction.NEXT[state]
                cost, audit = cost + 3 * n, audit + "I" * n + letter
                if letter in "KR" and letter:
                    cost += 3 * (status == "t") + 3 * (letter == "R")
                    if status == "f" or (letter == "K" and (state, initial) not in auction.KEEPS):
                        ok = False
                        break
                    state = auction.NEXT[state] if letter == "R" else auction.KEEPS[state, initial]
                elif letter == "D":
                    cost += 4
            if ok and state in (0, 3):
                found.append((cost, audit))
    return min(found)


def run_of(codes):
    return " ".join(f"{i}{s}1" for i, s in codes)


def test_auction_equals_every_edit_and_plain_programming():
    rng = random.Random(4)
    for k in range(60):
        codes = [(rng.choice("suax"), rng.choice("ooootf")) for _ in range(k % 5)]
        assert auction.repairs(run_of(codes))[0][:2] == dp(codes) == every_edit(codes)
    for _ in range(300):
        codes = [(rng.choice("suuaax"), rng.choice("oooootf")) for _ in range(rng.randrange(40))]
        assert auction.repairs(run_of(codes))[0][:2] == dp(codes)


def test_many_equal_turns_are_one_step():
    lattice = auction.Lattice("uo1000000 ao1", auction.ENDS, True)
    assert len(lattice.steps) == 3 and lattice.auction(0) == 0 and lattice.base == 4 * (10**6 - 1)


def plain(rows):
    """Results per conversation from all of its rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text, *_ in [r for r in rows if r[0] == conv]:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, codes, faults = set(), [], {"b": 0, "d": 0, "t": 0}
        for _, role, text in after:
            body = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "o"
            seen.add((role, text))
            if fault in faults:
                faults[fault] += 1
            codes.append((role[0] if role[:1] and role[0] in "sua" else "x", {"b": "f", "d": "f"}.get(fault, fault)))
        cost, audit = dp(codes)
        lines, state, at = [], 0, iter(after)
        for letter in audit:
            if letter == "I":
                state = auction.NEXT[state]
                lines.append(auction.ROLES[state] + ":")
                continue
            _, role, text = next(at)
            if letter == "K":
                state = auction.KEEPS[state, role[0]]
                lines.append(f"{role}:{text}")
            elif letter == "R":
                state = auction.NEXT[state]
                lines.append(f"{auction.ROLES[state]}:{text}")
        known = [t for t, *_ in after if t is not None]
        out[conv] = (
            max(known) - min(known) + 1 - len(set(known)) if known else 0, faults["b"], faults["d"], faults["t"],
            sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def test_repair_equals_plain_version(spark, tmp_path):
    rng = random.Random(9)
    texts = ["Hello there.", "Why? ", "no end", None, "", " \n", "é!", "Fine.\n", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", None, "", "tool", "Ünused", "umbrella"]
    rows = []
    for conv in [None, *range(40)]:
        for turn in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(roles + roles[:3] * 3), rng.choice(texts) if turn % 3 else f"Text {turn}."))
    # a conversation of many runs, one of many equal turns, one row of one turn many times
    rows += [(100, k, ("user", "assistant")[k % 2], f"turn {k}" + "." * (k % 5 > 0)) for k in range(400)]
    rows += [(101, k, "user", "the same.") for k in range(150)]
    rows += [(102, 3, "assistant", "again.")] * 90 + [(102, 4, "user", "why?")]
    rows += [(103, k, rng.choice(roles), rng.choice(texts)) for k in range(130)]
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((dropped, 0, "user", "gone."))
    spark.createDataFrame([(*r, "a", 1) for r in rows], SCHEMA).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r)[1:] for r in op12_turn_repair(spark, str(tmp_path)).collect()}
    want = plain(rows)
    assert found.keys() == want.keys()
    for conv in want:
        assert found[conv] == want[conv], conv
    assert found[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_turns(spark):
    rows = spark.createDataFrame([(1, 2, "assistant", "B."), (1, 1, "assistant", "A."), (2, 1, "user", "Q?"), (3, 1, "user", " ")], "conv_id long, turn long, role string, text string")
    plans = turn_repair.edit_plans(rows, rows)
    found = sorted(tuple(r) for r in turn_repair.repaired(rows, plans).collect())
    assert found == [(1, 0, "R", "user", "A."), (1, 1, "K", "assistant", "B."), (2, 0, "K", "user", "Q?"), (2, 1, "I", "assistant", "")]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert op12_turn_repair(spark, str(tmp_path)).count() == 0
