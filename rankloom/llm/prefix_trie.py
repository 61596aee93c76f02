r"""Prefix trie of rebuilt conversations, in pointer dictionary tries over hash partitions.

Every conversation is rebuilt (the first h turns of its group's base, then its own turns after its first h) as a string
of 128-bit turn digests, and equal rebuilt conversations become one sequence with a count before anything is dealt, so
a group of copies of any size is one row. Sequences are hash-partitioned by the digest of their first turn; a task builds
a pointer dictionary trie for each first turn and sums it up in an iterative postorder. A first-turn subtree of over
`subtree_turns` turns is not built in one task: its top becomes a row of its own and its sequences are dealt again by
the next turn, and so on until every subtree fits; what the subtrees sum up to is added to the tops above them.

The hash of the members that end in a node is sequential by nature: ids are joined in blocks of 65,536 first, on any
number of tasks, and the blocks of a node stream through its hash in order.

Defined results: null role and null text count as empty; null turns come first; ties in a turn follow role, the first 64
characters, then the SHA-256 of the text; repeated rows are turns of their own; a null conv_id is a conversation of its
own, larger than all others, without a base, and its decimal is empty; the remainder of a negative conv_id has its sign;
turns of any length are told apart by SHA-256 of role and text, cut to 128 bits; bytes that are not UTF-8 are compared as
they stand; an empty table gives no row; other columns are not looked at. The digests of one conversation's turns stand
in one row, 32 bytes a turn.
"""

from __future__ import annotations

import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rankloom.llm.common import WHITE, materialize
from rankloom.llm.dialogue import TURN_ORDER_SQL, crc32_sql

_WIDE = 32  # hex digits of a turn's digest
_NODES = "pk string, top boolean, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, seq string"
_EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = 20, most_shared: int = 3) -> DataFrame:
    """One row per conversation: conv_id, digests (of its rebuilt turns in order, joined), words (of each turn)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    told = given.withColumn("sha", F.sha2(F.col("text").cast("binary"), 256)).select(
        "conv_id", "turn", "role", F.substring("text", 1, 64).alias("head"), "sha",
        F.substring(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("sha")).cast("binary"), 256), 1, _WIDE).alias("digest"),
        F.regexp_count("text", F.lit("[^" + WHITE[1:])).cast("long").alias("words"),
    )
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "head", "sha")
    shared = F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")) % (most_shared + 1)
    placed = told.withColumn("pos", F.row_number().over(order)).select("conv_id", "digest", "words", "pos", shared.alias("h"))
    turn = F.struct("pos", "digest", "words").alias("t")
    convs = given.groupBy("conv_id").agg(F.lit(1)).select("conv_id", shared.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base"))
    bases = placed.filter((F.col("pos") <= most_shared) & (F.col("conv_id") % family == 0)).select(F.col("conv_id").alias("base"), "pos", "digest", "words")
    own = placed.filter(F.col("pos") > F.col("h")).select("conv_id", turn)
    lent = convs.join(bases, "base").filter(F.col("pos") <= F.col("h")).select("conv_id", turn)
    bare = convs.select("conv_id", F.lit(None).cast(own.schema["t"].dataType).alias("t"))
    joined = own.union(lent).union(bare).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return joined.select("conv_id", F.array_join("t.digest", "").alias("digests"), F.col("t.words").alias("words"))


class Node:
    """A trie node: pointers to its children by turn digest, and what its members sum up to."""

    __slots__ = ("kids", "least", "convs", "words", "end", "leaves", "saved")

    def __init__(self, words: int):
        self.kids, self.least, self.convs, self.words, self.end, self.leaves, self.saved = {}, None, 0, words, None, 0, 0

    def add(self, conv: tuple, n: int) -> None:
        self.convs += n
        if self.least is None or conv < self.least:
            self.least = conv


def build(rows, at: int) -> Node:
    """Trie below a top at depth `at`; rows: (conv as (is null, id), count, digests, words, sequence)."""
    top = Node(0)
    for conv, n, digests, words, seq in rows:
        node = top
        for i in range(at, len(words)):
            turn = digests[i * _WIDE : (i + 1) * _WIDE]
            kid = node.kids.get(turn)
            if kid is None:
                kid = node.kids[turn] = Node(int(words[i]))
            kid.add(conv, n)
            node = kid
        node.end = seq
    return top


def postorder(top: Node, parent: tuple, depth: int):
    """(node, parent's smallest member, depth) below top, children before their parents; sums are ready when a node comes."""
    stack = [(kid, parent, depth + 1, False) for kid in top.kids.values()]
    while stack:
        node, above, d, ready = stack.pop()
        if not ready and node.kids:
            stack.append((node, above, d, True))
            stack += [(kid, node.least, d + 1, False) for kid in node.kids.values()]
            continue
        node.leaves = sum(k.leaves for k in node.kids.values()) if node.kids else 1
        node.saved = (node.convs - 1) * node.words + sum(k.saved for k in node.kids.values())
        yield node, above, d


def _tries(pdf: pd.DataFrame) -> pd.DataFrame:
    out: list[tuple] = []
    number = lambda pair: None if pair[0] else pair[1]
    for (pk, at), part in pdf.groupby(["pk", "at"], sort=False):
        convs = zip(part["conv_null"], part["conv"])
        top = build(zip(convs, part["n"], part["digests"], part["words"], part["seq"]), int(at))
        parent = (part["top_null"].iloc[0], part["top_conv"].iloc[0])
        for node, above, depth in postorder(top, parent, int(at)):
            out.append((pk, depth == at + 1, number(node.least), depth, number(above), node.convs, len(node.kids), node.leaves, node.saved, node.end))
    names = [x.split()[0] for x in _NODES.split(", ")]
    frame = pd.DataFrame(out, columns=names)
    return frame.astype({"conv_id": "Int64", "parent_conv_id": "Int64"})


def _hash_blocks(batches):
    """SHA-256 of each sequence's blocks of ids, joined by commas, as they stream by in order."""
    schema = pa.schema([("seq", pa.string()), ("ends_sha256", pa.string())])
    now, digest = None, None
    for batch in batches:
        out = []
        for seq, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if seq != now:
                if now is not None:
                    out.append((now, digest.hexdigest()))
                now, digest = seq, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], schema=schema)


def _ends(paths: DataFrame) -> DataFrame:
    """seq, ends_sha256: hash of the ascending ids of the conversations that are that sequence."""
    block = F.shiftright("conv_id", 16)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = paths.groupBy("seq", block.alias("block")).agg(ids.alias("ids"))
    return blocks.repartition("seq").sortWithinPartitions("seq", F.col("block").asc_nulls_last()).select("seq", "ids").mapInArrow(_hash_blocks, "seq string, ends_sha256 string")


def prefix_trie(turns: DataFrame, subtree_turns: int = 1024, **columns: str) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    subtree_turns: turns of distinct sequences in a subtree that one task builds; larger ones are dealt by the next turn.
    """
    spark = turns.sparkSession
    paths = materialize(rebuilt(turns, **columns).withColumn("seq", F.sha2("digests", 256)), "trie-paths")
    sequences = paths.groupBy("seq").agg(F.min("conv_id").alias("conv"), F.count(F.lit(1)).alias("n"), F.first("digests").alias("digests"), F.first("words").alias("words"))
    root = "sha2('', 256)"
    work = materialize(sequences.selectExpr("*", f"{root} AS pk", f"array({root}) AS above", "0 AS at", "0L AS word", "cast(null AS long) AS parent_conv"), "trie-level")
    whole = work.agg(F.min("conv"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    work = work.withColumn("top_conv", F.lit(whole[0]).cast("long"))
    ready, tops = [], []
    while True:
        more = F.size("words") > F.col("at")
        next_turn = F.when(more, F.expr(f"substring(digests, at * {_WIDE} + 1, {_WIDE})"))
        work = work.withColumn("next", next_turn)
        fixed = ["pk", "above", "at", "word", "parent_conv", "top_conv"]
        by_next = materialize(work.groupBy(*fixed, "next").agg(
            F.sum("n").alias("n"), F.min("conv").alias("conv"), F.sum(F.size("words") - F.col("at")).alias("turns"), F.max(F.when(~more, F.col("seq"))).alias("seq"),
            F.first(F.when(more, F.expr("words[at]"))).alias("next_word")), "trie-tops")
        tops.append(by_next.groupBy(*fixed).agg(F.sum("n").alias("n_convs"), F.count("next").alias("n_children"), F.max("seq").alias("seq")))
        over = by_next.filter(F.col("next").isNotNull() & (F.col("turns") > subtree_turns)).select("pk", "next", F.col("conv").alias("next_conv"), "next_word")
        going = work.filter(more)
        if over.isEmpty():
            ready.append(going)
            break
        ready.append(going.join(over, ["pk", "next"], "left_anti"))
        key = F.sha2(F.concat("pk", "next"), 256)
        down = going.join(over, ["pk", "next"]).select("seq", "conv", "n", "digests", "words", key.alias("pk"), F.array_append("above", key).alias("above"), (F.col("at") + 1).alias("at"), F.col("next_word").alias("word"), F.col("top_conv").alias("parent_conv"), F.col("next_conv").alias("top_conv"))
        work = materialize(down, "trie-level")

    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), whole[1] // (64 * subtree_turns))
    dealt = None
    for each in ready:
        each = each.select(
            "pk", "at", F.isnull("top_conv").alias("top_null"), F.coalesce("top_conv", F.lit(0)).alias("top_conv"), F.isnull("conv").alias("conv_null"), F.coalesce("conv", F.lit(0)).alias("conv"),
            "n", "digests", "words", "seq", F.pmod(F.xxhash64("pk", "next"), F.lit(parts)).alias("bucket"),
        )
        dealt = each if dealt is None else dealt.union(each)
    nodes = materialize(dealt.groupBy("bucket").applyInPandas(_tries, _NODES), "trie-nodes")

    top = tops[0]
    for each in tops[1:]:
        top = top.union(each)
    below = nodes.filter("top").groupBy("pk").agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    own = top.join(below, "pk", "left").withColumns({
        "leaves": F.coalesce("leaves", F.lit(0)) + F.when(F.col("n_children") == 0, 1).otherwise(0),
        "saved": F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("word"),
    })
    sums = own.select(F.explode("above").alias("pk"), "leaves", "saved").groupBy("pk").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    upper = top.join(sums, "pk").select(F.col("top_conv").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), *names[3:], "seq")
    every = nodes.select(*names, "seq").union(upper)
    ended = every.filter("seq is not null").join(_ends(paths), "seq").select(*names, "ends_sha256")
    return every.filter("seq is null").select(*names, F.lit(_EMPTY_HASH).alias("ends_sha256")).union(ended)


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP12_SQL = rf"""
WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY {TURN_ORDER_SQL}) AS pos FROM given),
ids AS (SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base, coalesce(conv_id::VARCHAR, '') AS name FROM given),
convs AS (SELECT conv_id, base, {crc32_sql("name")} % 4 AS h FROM ids),
turns AS (SELECT p.conv_id, pos, {{'role': role, 'text': text}} AS t FROM placed p JOIN convs c ON c.conv_id IS NOT DISTINCT FROM p.conv_id WHERE pos > h
          UNION ALL SELECT c.conv_id, pos, {{'role': role, 'text': text}} FROM convs c JOIN placed p ON p.conv_id = c.base WHERE pos <= h),
paths AS (SELECT c.conv_id, coalesce(list(t ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path FROM convs c LEFT JOIN turns r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d, path[1:d] AS p, len(path) = d AS ends FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM paths)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(coalesce(conv_id::VARCHAR, ''), ',' ORDER BY conv_id NULLS LAST) FILTER (ends), '') AS members,
            CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS own FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.p = n.p),
sums AS (SELECT k AS d, p[1:k] AS p, sum(own) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS k FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n::BIGINT AS n_convs, n.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(n.members) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.d = n.d AND s.p = n.p LEFT JOIN nodes u ON n.d > 0 AND u.d = n.d - 1 AND u.p = n.p[1:n.d - 1]
"""
