r"""Conversation structure repair by Dijkstra's search on the edit lattice.

A node of the lattice is (rows consumed, grammar state); edges keep, rerole, delete a row or insert an empty turn. The
search runs on the implicit lattice with the priority key (cost, audit) and stops at the first accepting end node that it
pops. The audit string settles the cost (each letter's cost depends on the row it stands at alone), so of two paths of
equal cost to one node neither audit starts with the other, and the key orders whole paths as it orders their parts.

Conversations of ordinary length are dealt by conv_id, sorted, and searched one by one as they stream by. A conversation
of over `chunk_rows` rows or `chunk_bytes` of text never goes to one task: its rows are dealt by range, over any number
of tasks, a chunk of consecutive rows is searched from each grammar state to each other, and chunks are put together
pair by pair, which gives the same cheapest audit. Only the hash of the repaired text, which is sequential by nature,
reads such a conversation in one task, as a stream.

Defined results: null role and null text count as one space, as do null conv_id and null turn in the key of the damage;
a null conv_id is a conversation of its own; ties in a turn follow role, the first 64 characters, then the SHA-256 of
the text; repeated rows are rows of their own (all but the first are duplicates); an empty role cannot be kept; a text
of any length is one row; bytes that are not UTF-8 stay as they are; a conversation of which no row is left gives zeros,
an empty audit and the hash of the empty string; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import materialize
from rankloom.llm.dialogue import KEY, TURN_ORDER_SQL, crc32_sql, keyed, turn_order

_WHITE = " \t\n\x0b\x0c\r"
#: Grammar (s?(ua)+)?: states are the last role's initial, "" at the start; the role that rerole and insert can give next.
_STATES = ("", "s", "u", "a")
_GIVEN = {"": "u", "s": "u", "u": "a", "a": "u"}
_ROLE = {"u": b"user", "a": b"assistant"}
_ACCEPT = ("", "a")
_LEGAL = (b"su", b"ua", b"au")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_RESULT_ARROW = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows after damage: conv_id, turn, role, text, live; a dropped row stays as a marker with live = false and nothing else."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    given = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    draw = given.withColumn("draw", F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20)
    hurt = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return draw.select(
        "conv_id",
        F.when(F.col("draw") != 0, F.col("turn")).alias("turn"),
        F.when(F.col("draw") == 4, "user").when(F.col("draw") != 0, F.col("role")).alias("role"),
        F.when(F.col("draw") != 0, hurt).alias("text"),
        (F.col("draw") != 0).alias("live"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def with_marks(rows: DataFrame) -> DataFrame:
    """blank and cut: the faults that a row shows by itself."""
    body = F.rtrim("text", F.lit(_WHITE))
    return rows.withColumns({"blank": F.length(body) == 0, "cut": ~F.substring(body, -1, 1).isin(".", "!", "?")})


def search(cells: list[tuple], entry: str = "", stop: bool = True) -> dict[str, tuple[int, str]]:
    """Cheapest (cost, audit) from the entry state before the first cell to states after the last one.

    cells: (role initial, must it be deleted, cost of leaving it in). With stop only the first accepting end node that
    is popped, which is the answer for a whole conversation; without, all end states.
    """
    n, heap, settled, ends = len(cells), [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n:
            if not stop or state in _ACCEPT:
                ends[state] = (cost, audit)
                if stop:
                    break
        given = _GIVEN[state]
        if (i, given) not in settled:
            heapq.heappush(heap, (cost + 2, audit + "I", i, given))
        if i < n:
            initial, delete, extra = cells[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if not delete:
                if initial == given or initial == "s" and state == "":
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, initial))
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, given))
    return ends


def replay(audit: str, initials: list[str], state: str = "") -> Iterator[tuple[str, int, str]]:
    """(edit, row or -1, state after it) along an audit."""
    i = 0
    for edit in audit:
        state = initials[i] if edit == "K" else state if edit == "D" else _GIVEN[state]
        yield edit, -1 if edit == "I" else i, state
        i += edit != "I"


def _line(edit: str, state: str, role: bytes, text: bytes) -> bytes:
    return (role if edit == "K" else _ROLE[state]) + b":" + text


def _initial(role: bytes) -> str:
    return role[:1].decode("latin-1")


def _mend(conv_id, rows: list[tuple]) -> tuple:
    """The result row of one conversation; rows: (turn, role, text, blank, cut) in order."""
    seen, cells, count = set(), [], [0, 0, 0]
    for _, role, text, blank, cut in rows:
        fault = 0 if blank else 1 if (role, text) in seen else 2 if cut else 3
        seen.add((role, text))
        if fault < 3:
            count[fault] += 1
        cells.append((_initial(role), fault < 2, int(fault == 2)))
    turns = {r[0] for r in rows if r[0] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in _LEGAL for a, b in zip(rows, rows[1:]))
    ((cost, audit),) = search(cells).values()
    lines = [_line(e, s, rows[i][1], rows[i][2]) if i >= 0 else _line(e, s, b"", b"") for e, i, s in replay(audit, [c[0] for c in cells]) if e != "D"]
    return (conv_id, gaps, *count, illegal, cost, audit, hashlib.sha256(b"\n".join(lines)).hexdigest())


def _mend_all(batches):
    """Conversations of a sorted partition, one after the other."""
    now, rows, out = None, [], []
    for batch in batches:
        for conv_id, live, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != conv_id:
                if now is not None:
                    out.append(_mend(now[0], rows))
                now, rows = (conv_id,), []
            if live:
                rows.append(row)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _RESULT_ARROW)], schema=_RESULT_ARROW)
            out = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(_mend(now[0], rows), _RESULT_ARROW)], schema=_RESULT_ARROW)


def _mend_short(rows: DataFrame) -> DataFrame:
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *turn_order())
    binary = [F.col(c).cast("binary").alias(c) for c in ("role", "text")]
    return with_marks(dealt).select("conv_id", "live", "turn", *binary, "blank", "cut").mapInArrow(_mend_all, _RESULT)


def _search_chunk(key, table):
    """All ways through one chunk: cheapest (cost, audit) by entry and exit state."""
    table = table.sort_by("at")
    initials = [_initial(r) for r in table.column("head").to_pylist()]
    cells = list(zip(initials, table.column("gone").to_pylist(), table.column("extra").to_pylist()))
    ways = {a: search(cells, a, stop=False) for a in _STATES}
    illegal = sum((a + b).encode("latin-1") not in _LEGAL for a, b in zip(initials, initials[1:]))
    columns = [*([k.as_py()] for k in key), [json.dumps(initials)], [illegal], [json.dumps(ways)]]
    return pa.table({n: pa.array(c, t) for (n, t), c in zip((("conv_key", pa.int64()), ("conv_null", pa.bool_()), ("chunk", pa.int64()), ("initials", pa.string()), ("illegal", pa.int64()), ("ways", pa.string())), columns)})


def join_ways(left: dict, right: dict) -> dict:
    """Cheapest ways through two neighbouring chunks."""
    out: dict = {}
    for a, mids in left.items():
        out[a] = {}
        for mid, (cost, audit) in mids.items():
            for b, (more, rest) in right.get(mid, {}).items():
                way = (cost + more, audit + rest)
                if b not in out[a] or way < out[a][b]:
                    out[a][b] = way
    return out


def _join_chunks(key, table):
    """One result row of a long conversation (chunk null), and for each chunk its share of the audit and the state before it."""
    table = table.sort_by("chunk")
    initials = [json.loads(x) for x in table.column("initials").to_pylist()]
    ways = [{a: {b: tuple(w) for b, w in ends.items()} for a, ends in json.loads(x).items()} for x in table.column("ways").to_pylist()]
    while len(ways) > 1:
        ways = [join_ways(*pair) if len(pair) == 2 else pair[0] for pair in (ways[k : k + 2] for k in range(0, len(ways), 2))]
    cost, audit = min(ways[0][""][b] for b in _ACCEPT if b in ways[0][""])
    illegal = sum(table.column("illegal").to_pylist()) + sum((a[-1] + b[0]).encode("latin-1") not in _LEGAL for a, b in zip(initials, initials[1:]))
    parts, state, at = [], "", 0
    for k, own in enumerate(initials):
        end, left = at, len(own)
        while end < len(audit) and (left or k == len(initials) - 1):
            left -= audit[end] != "I"
            end += 1
        parts.append((audit[at:end], state))
        for *_, state in replay(audit[at:end], own, state):
            pass
        at = end
    n = len(parts)
    return pa.table({
        "conv_key": pa.array([key[0].as_py()] * (n + 1), pa.int64()), "conv_null": pa.array([key[1].as_py()] * (n + 1), pa.bool_()),
        "chunk": pa.array([*table.column("chunk").to_pylist(), None], pa.int64()), "initials": pa.array([*map(json.dumps, initials), None], pa.string()),
        "part": pa.array([*(p[0] for p in parts), audit], pa.string()), "state": pa.array([*(p[1] for p in parts), ""], pa.string()),
        "cost": pa.array([None] * n + [cost], pa.int64()), "illegal": pa.array([None] * n + [illegal], pa.int64()),
    })


def _row_edits(batches):
    """For each row of a long conversation: its position, edit, state after it, and the states of the turns inserted before and (at the end) after it."""
    for batch in batches:
        out = []
        for chunk, initials, part, state in zip(*(c.to_pylist() for c in batch.columns)):
            before = ""
            for edit, i, after in replay(part, json.loads(initials), state):
                if edit == "I":
                    before += after
                else:
                    out.append([chunk, i, edit, after, before, ""])
                    before = ""
            if before:
                out[-1][-1] = before
        schema = pa.schema([("chunk", pa.int64()), ("k", pa.int64()), *((n, pa.string()) for n in ("edit", "after", "before", "behind"))])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 6, schema)], schema=schema)


def _hash_lines(batches):
    """SHA-256 of each conversation's lines, as they stream by in order."""
    schema = pa.schema([("conv_key", pa.int64()), ("conv_null", pa.bool_()), ("repaired_sha256", pa.string())])
    now, digest, out = None, None, []
    for batch in batches:
        for key, null, line in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (key, null):
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (key, null), hashlib.sha256()
                digest.update(line[1:])  # every line starts with its line feed, the first has none
            else:
                digest.update(line)
    if now is not None:
        out.append((*now, digest.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 3, schema)], schema=schema)


def _mend_long(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Conversations of any length: ranges of rows, chunks searched apart, chunks joined. row: a number for each row, to tell repeated ones apart."""
    same = [*KEY, "role", "sha"]
    rows = with_marks(rows.filter("live")).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))
    first = rows.groupBy(*same).agg(F.min(F.struct("turn", "row"))["row"].alias("first"))
    marked = rows.join(first, same).withColumn("again", F.col("row") != F.col("first"))
    dealt = marked.repartitionByRange(*KEY, *turn_order(), "row").sortWithinPartitions(*KEY, *turn_order(), "row")
    slot = F.monotonically_increasing_id()
    cut = dealt.select(*KEY, "turn", "role", "text", "blank", "cut", "again", slot.alias("slot"))
    chunk = F.shiftright("slot", chunk_rows.bit_length() - 1)
    placed = materialize(cut.withColumn("chunk", chunk), "repair-rows")
    gone, extra = F.col("blank") | F.col("again"), F.when(~F.col("blank") & ~F.col("again") & F.col("cut"), 1).otherwise(0).cast("long")
    slim = placed.select(*KEY, "chunk", F.col("slot").alias("at"), F.substring("role", 1, 1).cast("binary").alias("head"), gone.alias("gone"), extra.alias("extra"))
    ways = slim.groupBy(*KEY, "chunk").applyInArrow(_search_chunk, "conv_key long, conv_null boolean, chunk long, initials string, illegal long, ways string")
    parts = materialize(ways.groupBy(*KEY).applyInArrow(_join_chunks, "conv_key long, conv_null boolean, chunk long, initials string, part string, state string, cost long, illegal long"), "repair-parts")

    edits = parts.filter("chunk is not null").select(F.col("chunk"), "initials", "part", "state", *KEY)
    each = _all_edits(edits)
    ranked = placed.join(placed.groupBy(*KEY, "chunk").agg(F.min("slot").alias("start")), [*KEY, "chunk"]).withColumn("k", F.col("slot") - F.col("start"))
    name = lambda c: F.when(c == "u", "user").otherwise("assistant")
    empty = lambda states: F.array_join(F.transform(F.split(states, ""), lambda c: F.when(c == "", "").otherwise(F.concat(F.lit("\n"), name(c), F.lit(":")))), "").cast("binary")
    own = F.when(F.col("edit") == "D", F.lit(b"")).otherwise(F.concat(F.lit(b"\n"), F.when(F.col("edit") == "K", F.col("role")).otherwise(name(F.col("after"))).cast("binary"), F.lit(b":"), F.col("text").cast("binary")))
    lines = ranked.join(each, [*KEY, "chunk", "k"]).select(*KEY, "slot", F.concat(empty(F.col("before")), own, empty(F.col("behind"))).alias("line")).filter("octet_length(line) > 0")
    hashes = lines.repartition(*KEY).sortWithinPartitions(*KEY, "slot").select(*KEY, "line").mapInArrow(_hash_lines, "conv_key long, conv_null boolean, repaired_sha256 string")

    faults = placed.groupBy(*KEY).agg(
        F.count_if("blank").alias("blank"), F.count_if(~F.col("blank") & F.col("again")).alias("duplicate"), F.sum(extra).alias("truncated")
    )
    turns = placed.select(*KEY, "turn").distinct().groupBy(*KEY).agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    whole = parts.filter("chunk is null").select(*KEY, "illegal", "cost", F.col("part").alias("audit"))
    out = whole.join(faults, KEY).join(turns, KEY).join(hashes, KEY, "left")
    return out.select(F.when(~F.col("conv_null"), F.col("conv_key")).alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def _all_edits(edits: DataFrame) -> DataFrame:
    """One row per row of a long conversation, from the audits of its chunks; a chunk number can stand for two conversations, so the key goes along."""
    tagged = edits.withColumn("tag", F.struct(*KEY, "chunk"))
    body = "k long, edit string, after string, before string, behind string"

    def run(batches):
        for batch in batches:
            tags = batch.column(0)
            for i in range(batch.num_rows):
                one = pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), *(batch.column(c).slice(i, 1) for c in (1, 2, 3))], names=["chunk", "initials", "part", "state"])
                for rows in _row_edits([one]):
                    tag = pa.array([tags[i].as_py()] * rows.num_rows, tags.type)
                    yield pa.RecordBatch.from_arrays([tag, *rows.columns[1:]], names=["tag", *rows.schema.names[1:]])

    out = tagged.select("tag", "initials", "part", "state").mapInArrow(run, f"tag struct<conv_key: long, conv_null: boolean, chunk: long>, {body}")
    return out.select("tag.*", "k", "edit", "after", "before", "behind")


def repair(turns: DataFrame, chunk_rows: int = 2048, chunk_bytes: int = 64 << 20, **columns: str) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    chunk_rows (a power of two) and chunk_bytes: a conversation beyond either is searched in chunks; the result is the same.
    """
    rows = damaged(turns, **columns)
    sizes = keyed(rows).groupBy(*KEY).agg(F.count_if("live").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    long = materialize(sizes.filter((F.col("n") > chunk_rows) | (F.col("bytes") > chunk_bytes)).select(*KEY), "repair-long")
    if long.isEmpty():
        return _mend_short(rows)
    numbered = keyed(rows).withColumn("row", F.monotonically_increasing_id())  # at the scan, where it is the same in every plan
    short = keyed(rows).join(long, KEY, "left_anti").drop(*KEY)
    return _mend_short(short).union(_mend_long(numbered.join(long, KEY, "left_semi"), chunk_rows))


def op11_turn_repair(spark, sf_dir):
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = rf"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
drawn AS (SELECT *, {crc32_sql("name")} % 20 AS draw FROM given),
hurt AS (SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role, CASE draw WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
         FROM drawn, (VALUES (1), (2)) AS v(copy) WHERE draw <> 0 AND (copy = 1 OR draw = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {TURN_ORDER_SQL}) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM hurt),
marked AS (SELECT *, left(role, 1) AS head, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS prior FROM placed),
faulty AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM marked),
given_next(st, nxt) AS (VALUES ('', 'u'), ('s', 'u'), ('u', 'a'), ('a', 'u')),
inserts AS (SELECT st AS a, st AS b, '' AS ins FROM given_next UNION ALL SELECT st, nxt, 'I' FROM given_next UNION ALL SELECT x.st, y.nxt, 'II' FROM given_next x JOIN given_next y ON x.nxt = y.st),
moves AS (SELECT f.conv_id, f.k, i.a, i.ins || e.letter AS letters, 2 * length(i.ins) + e.price + CASE WHEN e.letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS price,
            CASE e.letter WHEN 'D' THEN i.b WHEN 'R' THEN g.nxt ELSE f.head END AS z
          FROM faulty f, inserts i JOIN given_next g ON g.st = i.b, (VALUES ('K', 0), ('R', 2), ('D', 3)) AS e(letter, price)
          WHERE e.letter = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e.letter = 'R' OR f.head = g.nxt OR f.head = 's' AND i.b = '')),
walk AS (SELECT conv_id, 0::BIGINT AS k, '' AS st, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM conversations GROUP BY conv_id
         UNION ALL
         SELECT w.conv_id, w.k + 1, m.z, min({{'cost': w.best.cost + m.price, 'audit': w.best.audit || m.letters}}) FROM walk w JOIN moves m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1 AND m.a = w.st GROUP BY ALL),
last AS (SELECT c.conv_id, coalesce(max(f.k), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
done AS (SELECT w.conv_id, min({{'cost': w.best.cost + 2 * length(i.ins), 'audit': w.best.audit || i.ins}}) AS best
         FROM walk w JOIN last l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.k JOIN inserts i ON i.a = w.st AND i.b IN ('', 'a') GROUP BY w.conv_id),
letters AS (SELECT conv_id, p, best.audit[p] AS letter, length(replace(left(best.audit, p), 'I', '')) AS k, length(replace(left(best.audit, p), 'D', '')) AS j, length(replace(best.audit, 'D', '')) % 2 AS odd
            FROM (SELECT conv_id, best, unnest(range(1, length(best.audit) + 1)) AS p FROM done)),
lines AS (SELECT t.conv_id, t.p, CASE WHEN letter = 'K' THEN f.role WHEN (j - odd) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END AS line
          FROM letters t LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.k = t.k WHERE letter <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS body FROM lines GROUP BY conv_id),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (prior IS NOT NULL AND prior || head NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT d.conv_id, coalesce(s.gaps, 0)::BIGINT AS gaps, coalesce(s.blank, 0)::BIGINT AS blank, coalesce(s.duplicate, 0)::BIGINT AS duplicate, coalesce(s.truncated, 0)::BIGINT AS truncated,
  coalesce(s.illegal, 0)::BIGINT AS illegal, d.best.cost AS cost, d.best.audit AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
FROM done d LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM d.conv_id
"""
