"""Operators over conversations against plain versions: structure repair and the prefix trie."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from rankloom.llm import prefix_trie, turn_repair

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string, live string, chunk string, seq string"


def order(rows, fill):
    full = [(t, fill if r is None else r, fill if x is None else x) for t, r, x in rows]
    return sorted(full, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))


def repaired(conv, rows):
    """All edit scripts of a conversation, cheapest first; rows of (turn, role, text) before damage."""
    hurt = []
    for t, r, x in order(rows, " "):
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if t is None else t}".encode()) % 20
        x = "" if draw == 1 else re.sub("[.!?]", "", x) if draw == 2 else x
        hurt += [(t, "user" if draw == 4 else r, x)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    hurt = order(hurt, " ")
    faults, seen = [], set()
    for _, r, x in hurt:
        body = x.rstrip(WHITE)
        faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((r, x))
    best = None
    for edits in itertools.product("KRD", repeat=len(hurt)):
        if any(f in ("blank", "duplicate") and e != "D" for e, f in zip(edits, faults)):
            continue
        for gaps in itertools.product(("", "I"), repeat=len(hurt) + 1):
            cost = sum({"K": 0, "R": 2, "D": 3}[e] + (e != "D" and f == "truncated") for e, f in zip(edits, faults)) + 2 * sum(map(len, gaps))
            audit = "".join(g + e for g, e in zip(gaps, (*edits, "")))
            if best is not None and (cost, audit) >= best[0]:
                continue
            out, i, good = [], 0, True
            for e in audit:
                last = out[-1][0][:1] if out else ""
                given = "assistant" if last == "u" else "user"
                if e == "I":
                    out.append((given, ""))
                elif e == "K":
                    good &= hurt[i][1][:1] == given[0] or not out and hurt[i][1][:1] == "s"
                    out.append(hurt[i][1:])
                elif e == "R":
                    out.append((given, hurt[i][2]))
                i += e != "I"
            if good and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
                best = (cost, audit), hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
    turns = {t for t, _, _ in hurt if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(hurt, hurt[1:]))
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *best[0], best[1])


def dialogues(seed, most=5):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No!", "why", "", " \t", None, "Well?  ", "Well? \n", "é…", "x" * 70 + "a.", "x" * 70 + "b."]
    for conv in [*range(60), None]:
        for t in range(rng.randint(1, most)):
            out.append((conv, rng.choice([t, t, t, None, 3 * t]), rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None, "umpire"]), rng.choice(texts), "x", "x", "x"))
    return out + out[:3]  # some rows repeated


@pytest.mark.parametrize("chunk_rows", [2048, 2])
def test_repair_is_the_cheapest_of_all_edit_scripts(spark, chunk_rows):
    rows = dialogues(chunk_rows)
    want = [repaired(c, [r[1:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}]
    got = turn_repair.repair(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk_rows=chunk_rows).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_long_and_hot_conversations_give_the_same_in_chunks(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["So.", "so", f"{t}.", ""]), "x", "x", "x") for c, n in ((1, 700), (2, 90), (3, 4)) for t in range(n)]
    rows += [(1, 5, "user", "hot text.", "x", "x", "x")] * 300
    turns = spark.createDataFrame(rows, SCHEMA)
    whole, cut = (sorted(turn_repair.repair(turns, chunk_rows=k).collect()) for k in (4096, 16))
    assert whole == cut and len(whole) == 3


def test_repair_of_very_long_texts_and_empty_tables(spark):
    big = "word " * 500_000 + "x" * 3_000_000 + "."
    turns = spark.createDataFrame([(7, 1, "user", big, "", "", ""), (7, 2, "assistant", "Yes.", "", "", "")], SCHEMA)
    for size in (64 << 20, 1 << 10):
        (row,) = turn_repair.repair(turns, chunk_bytes=size).collect()
        assert tuple(row)[1:] == repaired(7, [(1, "user", big), (2, "assistant", "Yes.")])[1:]
    assert turn_repair.repair(turns.filter("turn = 99")).count() == 0


def trie(rows):
    words = re.compile(f"[^{WHITE}]+")
    own = {c: [r[1:] for r in order([x[1:4] for x in rows if x[0] == c], "")] for c in {r[0] for r in rows}}
    paths = {}
    for c in own:
        h = zlib.crc32(b"" if c is None else str(c).encode()) % 4
        paths[c] = tuple(([] if c is None else own.get(c - c % 20, [])[:h]) + own[c][h:])
    big = 1 << 70
    least = lambda cs: min(cs, key=lambda c: big if c is None else c)
    nodes = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            nodes.setdefault(p[:d], []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in below) for q in below)
        saved = sum((len(nodes[q]) - 1) * len(words.findall(q[-1][1])) for q in below if q)
        ends = ",".join("" if c is None else str(c) for c in sorted((c for c in members if paths[c] == p), key=lambda c: big if c is None else c))
        out.append((least(members), len(p), least(nodes[p[:-1]]) if p else None, len(members), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def shared_dialogues():
    rng, rows = random.Random(9), []
    for conv in [*range(70), 100_000, 9_999_999_999, None]:
        for t in range(rng.randint(1, 6)):
            rows.append((conv, rng.choice([t, t, t, None]), rng.choice(["user", None]), rng.choice(["a b", "a b", "c  d e", "", None]), "x", "x", "x"))
    return rows + rows[:2]


@pytest.mark.parametrize("subtree_turns", [1024, 12])
def test_trie_equals_the_plain_one(spark, subtree_turns):
    rows = shared_dialogues()
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(3), subtree_turns).collect()
    assert sorted(map(tuple, got), key=str) == trie(rows)


def test_trie_of_copies_long_texts_and_empty_tables(spark):
    big = "word " * 500_000 + "x" * 3_000_000
    rows = [(20 * k + 19, t, "user", big if t else "hello there", "", "", "") for k in range(6) for t in range(3)]
    turns = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.prefix_trie(turns).collect()
    assert sorted(map(tuple, got), key=str) == trie(rows)
    assert prefix_trie.prefix_trie(turns.filter("turn = 99")).count() == 0


def test_statements_hold_on_odd_rows(spark, tmp_path):
    """The DuckDB statements agree with the queries on ties and nulls too."""
    rows = dialogues(5) + shared_dialogues()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    for query, sql in ((turn_repair.op11_turn_repair, turn_repair.OP11_SQL), (prefix_trie.op12_prefix_trie, prefix_trie.OP12_SQL)):
        df = query(spark, str(tmp_path))
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
