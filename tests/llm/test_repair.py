import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from spreadloom.llm import repair

SF = "/root/testdata/sf0.01"
NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(rows):
    """Dynamic program over (rows taken, last role) that keeps the cheapest letters, and the roles they give."""
    best, todo = {(0, ""): (0, "", ())}, [(0, "")]
    n = len(rows)
    # Bellman-Ford over rising costs: at most three inserts before a row
    for _ in range(4 * (n + 1)):
        new = {}
        for at, last in todo:
            cost, letters, roles = best[at, last]
            options = [(at, c, "I", 2, ({"u": "user", "a": "assistant"}[c], "")) for c in "ua"]
            if at < n:
                role, text, must, cut = rows[at]
                options.append((at + 1, None, "D", 3, None))
                if not must:
                    options.append((at + 1, role[:1] or "x", "K", cut, (role, text)))
                    options += [(at + 1, c, "R", 2 + cut, ({"u": "user", "a": "assistant"}[c], text)) for c in "ua"]
            for place, c, letter, more, kept in options:
                if c is not None and last + c not in ("s", "u", "su", "ua", "au"):
                    continue
                found = (cost + more, letters + letter, (*roles, kept) if kept else roles)
                key = (place, last if c is None else c)
                if key not in best or found[:2] < best[key][:2]:
                    best[key] = found
                    new[key] = True
        todo = list(new)
        if not todo:
            break
    return min((best[n, c] for c in ("", "a") if (n, c) in best), key=lambda b: b[:2])


def slow(rows, damage=True):
    convs = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fate == 1:
            text = ""
        if fate == 2:
            text = re.sub("[.!?]", "", text)
        if fate == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    out = []
    for conv, of in convs.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in of if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen, sight = dict.fromkeys(("blank", "duplicate", "truncated"), 0), set(), []
        for _, role, text in of:
            last = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            sight.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(of, of[1:], strict=False))
        cost, audit, roles = cheapest(sight)
        assert GRAMMAR.fullmatch("".join(r[:1] for r, _ in roles))
        out.append((conv, gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in roles).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def conversations(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux", "User"]
    texts = ["a.", "b", "c!", "d?", "", " \t", None, "é. ", "f.\x0b", "long. " * 50, "\x00", "x "]
    out = []
    for conv in range(n):
        for k in range(rng.randrange(longest)):
            out.append((conv, rng.choice([k, k, k, k, k + 3, -1, None]), rng.choice(roles[:5] if conv % 2 else roles), rng.choice(texts)))
    return out + [(None, 1, "user", "a."), (None, None, "assistant", "b."), (None, None, None, None)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_search_is_the_plain_one(monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 2)
    rng = random.Random(2)
    for _ in range(3000):
        rows = [rng.choice("DsuaxSUAX") for _ in range(rng.randrange(9))]
        plain = cheapest([({"D": "user"}.get(r, r.lower()), "t", r == "D", int(r.isupper() and r != "D")) for r in rows])
        assert repair.search(rows)[:2] == plain[:2]
        # cut in blocks of two and segments of three blocks
        ends, after = [], repair.closing()
        cuts = [rows[k : k + 6] for k in range(0, len(rows), 6)]
        for part in reversed(cuts):
            ends.append(after)
            after = repair.before_segment(repair.products(part)[-1], after)
        assert after["-"] == plain[0]
        state, letters = "-", ""
        for part, to_come in zip(cuts, reversed(ends), strict=True):
            more, state = repair.segment_paths(part, to_come)[state]
            letters += more
        assert letters + repair.last_letters(state) == plain[1]


@pytest.mark.parametrize("limit", [repair.WHOLE_ROWS, 3])
def test_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(repair, "WHOLE_ROWS", limit)
    rows = conversations(limit, 60, 12)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("step", "part", "edit", "fate", "c")}).repartition(3)
    assert rows_of(repair.summarise(df)) == slow(rows, damage=False)
    assert repair.repair(df).where("edit <> 'I'").count() == len(rows)
    found = repair.summarise(repair.damaged(df))
    assert rows_of(found) == [r for r in slow(rows) if r[7] or any(r[1:7])]


def test_one_very_long_conversation(spark):
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant"]), f"t{rng.randrange(900)}" + rng.choice([".", ".", ""])) for k in range(2000)] + [(7, 5, "user", "same.")] * 500 + [(8, 0, "user", "x" * 5_000_000)]
    # every part is cut into segments of its own
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(repair.summarise(df)) == slow(rows, damage=False)
    steps = repair.repair(df).where("conv_id = 7").orderBy("step").collect()
    assert [r.step for r in steps] == list(range(len(steps)))
    assert GRAMMAR.fullmatch("".join(r.role[:1] for r in steps if r.role))


def test_empty_and_query(spark):
    assert repair.summarise(spark.createDataFrame([], SCHEMA)).collect() == []
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = repair.op11_repair(spark, SF)
    assert tuple(got.columns) == NAMES
    assert rows_of(got) == slow(rows)


def test_conversations_without_rows_left(spark, tmp_path):
    gone = next(k for k in range(10_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "a."), (None, None, None, None), (3, None, "user", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert rows_of(repair.op11_repair(spark, str(tmp_path))) == slow(rows)
