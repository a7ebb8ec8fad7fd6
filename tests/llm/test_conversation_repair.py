import hashlib
import heapq
import random
import re
import zlib

import pytest

from leaksieve.llm import conversation_repair
from leaksieve.llm.conversation_repair import damaged, numbered, repair, repair_conversations
from leaksieve.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SPACE = " \t\n\x0b\x0c\r"


def shown(value):
    return " " if value is None else str(value)


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = shown(role), shown(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        found.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows):
    """(cost, audit, repaired rows) by a search through all series of edits, cheapest and ASCII-least first."""
    found = faults(rows)
    queue, been = [(0, "", 0, ())], set()
    while queue:
        cost, audit, i, kept = heapq.heappop(queue)
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "-" for r, _ in kept)
        # What may follow depends on the last role alone; the first to come here is the cheapest and least.
        if not re.fullmatch("s?(ua)*u?", initials) or (i, initials[-1:]) in been:
            continue
        been.add((i, initials[-1:]))
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, kept
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                heapq.heappush(queue, (cost + 2, audit + "I", i, kept + ((role, ""),)))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 3, audit + "D", i + 1, kept))
            if found[i] not in ("blank", "duplicate"):
                more = cost + (found[i] == "truncated")
                if role:
                    heapq.heappush(queue, (more, audit + "K", i + 1, kept + ((role, text),)))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (more + 2, audit + "R", i + 1, kept + ((other, text),)))


def brute_force(rows):
    groups = {conv: [] for conv, *_ in rows}
    for conv, *row in after_damage(rows):
        groups[conv].append(row)
    out = {}
    for conv, found in groups.items():
        turns = [t for t, _, _ in found if t is not None]
        pairs = [(role, text) for _, role, text in found]
        kinds = faults(pairs)
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, kept = cheapest(pairs)
        text = "\n".join(f"{r}:{t}" for r, t in kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")),
                     illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def result(frame):
    rows = frame.collect()
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def random_rows(seed, conversations=120, longest=8):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sudo", "User"] if rng.random() < 0.4 else [("user", "assistant")[turn % 2]])
            text = rng.choice(["Yes.", "No!", "cut off", "Why?\n ", " \t", "", None, "Repeated.", f"Text {rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, None, 3]), role, text))
    rows += [(None, 1, "user", "Hello."), (None, 2, "assistant", "Yes."), (None, None, None, None)]
    return rows


def test_random_conversations(spark):
    rows = random_rows(1)
    assert result(repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute_force(rows)


@pytest.mark.parametrize("min_block", [1, 3])
def test_conversations_of_several_blocks(spark, monkeypatch, min_block):
    """Blocks of a few rows: conversations go through checkpoints, and long ones through several ranges."""
    monkeypatch.setattr(conversation_repair, "isqrt", lambda n: 1)
    rows = random_rows(min_block + 7, 20, 14)
    rng = random.Random(4)
    rows += [(900, t, rng.choice(["user", "assistant", "tool"]), rng.choice(["a.", f"b {t}", f"c {t}."])) for t in range(16)]
    assert result(repair_conversations(spark.createDataFrame(rows, SCHEMA), min_block)) == brute_force(rows)


def test_large_conversation_is_spread(spark):
    """A conversation that holds most rows is numbered by several tasks, and its audit is that of one block."""
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "tool", "system"]), rng.choice([f"Text {t}.", f"cut {t}", "same."])) for t in range(6000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        frame = numbered(damaged(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert frame.selectExpr("id >> 33 AS part").distinct().count() > 2
    few = repair(frame, 1024)
    assert few.rows.select("head").distinct().count() > 4
    pairs = [(r, t) for _, _, r, t in after_damage(rows)]
    letters = "".join(chr(65 + 4 * {"s": 0, "u": 1, "a": 2}.get(r[:1], 3) + ("", "blank", "duplicate", "truncated").index(f))
                      for (r, _), f in zip(pairs, faults(pairs)))
    edits, _ = conversation_repair.walk(letters, conversation_repair.AT_END, 0, True)
    assert result(repair_conversations(spark.createDataFrame(rows, SCHEMA)))[1][6] == "".join(edits)
    kept = few.rows.where("role IS NOT NULL").orderBy("head", "place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))


def test_odd_tables(spark):
    assert repair_conversations(spark.createDataFrame([], SCHEMA)).collect() == []
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and set(result(repair_conversations(spark.createDataFrame(gone, SCHEMA))).values()) == {
        (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    rows = random_rows(3, 30) + [(5000, 0, "user", "long. " * 200000)]
    frame = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS head", "'x' AS kind", "3 AS chunk", "4 AS letters")
    assert result(repair_conversations(frame)) == brute_force(rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op12_conversation_repair(spark, sf)) == brute_force(rows)
