"""Prefix trie of conversations, by collapsing whole sequences.

Conversations are numbered, rebuilt on the head of another one, and hashed as a whole: identical ones collapse into
one weighted sequence with a list of those that end there.  Sequences that are proper prefixes of others are dropped
by an anti-join, which leaves the leaves; each sequence then gives its weight to its prefixes, which are the nodes.

A prefix of d turns is known by d and the XOR, over its turns, of two 64-bit hashes of place, role and text, so that
prefixes are running values that several tasks can make of one long conversation.  Sums over a subtree need no walk
from level to level.  What n_convs times a text's length sums up to below a node is what its sequences still have to
come, times their weight; the lengths by themselves are summed by letting each node count for one sequence only, the
one of the smallest conversation, which owns a tail of its path.

No task holds all turns of a conversation, nor all members of a node: turns are sorted by ranges over conversation,
turn, role and text and numbered from the ranges' counts; running values are made of blocks of ``BLOCK`` turns and of
the blocks' totals; lists of members are joined to texts by blocks of ``IDS`` numbers and then read in order, a block
at a time, by a hash that holds none of them.

Defined results: rows without conv_id are of no conversation; a null turn comes first, turns of one number are
ordered by role, then text; a repeated row is a turn of its own; a null role or text is empty; for a negative id
c - c % 100 rounds towards 0; an empty table has no nodes; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.llm.common import discard, materialize

#: A conversation takes its head from the first one of so many ids, and fewer turns of it than HEADS.
FAMILY, HEADS = 100, 6
#: Turns whose running values one task makes at once.
BLOCK = 1024
#: Range of ids whose decimal forms are joined to one text.
IDS = 4096
KEY = ["depth", "k1", "k2"]


def own_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, len) of every turn; pos counts from 1. A stored table."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    # Rows of a partition are in order, so that this id is theirs; it has the partition in its upper bits.
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    held = materialize(at.select("conv_id", "at", F.xxhash64(F.lit(1), "role", "text").alias("h1"), F.xxhash64(F.lit(2), "text", "role").alias("h2"), F.length("text").cast("bigint").alias("len")), "trie-turns", True)
    part = F.shiftright("at", 33).alias("part")
    runs = held.groupBy("conv_id", part).agg(F.min("at").alias("low"), F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = runs.select("conv_id", "part", (F.col("low") - ahead).alias("base"))
    out = held.withColumn("part", part).join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("base") + 1).alias("pos"), "h1", "h2", "len")
    out = materialize(out, "trie-numbered", True)
    discard(held)
    return out


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of every conversation, and (conv_id, p, k1, k2, len) of its turns as rebuilt. Stored tables."""
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    # At most HEADS - 1 turns each, of one conversation in FAMILY.
    heads = own.where((F.col("pos") < HEADS) & (F.col("conv_id") % FAMILY == 0)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "len"))).alias("head"))
    ids = own.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", taken.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    head = F.filter(F.coalesce("head", F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,len:bigint>>")), lambda x: x.pos <= F.col("h"))
    convs = materialize(ids.join(heads, "base", "left").select("conv_id", "h", head.alias("head")), "trie-convs", True)
    first = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.col("x.pos").alias("p"), "x.h1", "x.h2", "x.len")
    rest = own.join(convs.select("conv_id", "h", F.size("head").alias("n")), "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("n")).alias("p"), "h1", "h2", "len")
    hashed = first.unionByName(rest).select("conv_id", "p", F.xxhash64("p", "h1", "h2").alias("k1"), F.xxhash64(F.lit(3), "p", "h2", "h1").alias("k2"), "len")
    return convs.select("conv_id"), materialize(hashed, "trie-rebuilt", True)


def sequences(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, total) of every rebuilt conversation as a whole. A stored table."""
    whole = turns.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"), F.sum("len").alias("total"))
    filled = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("depth", "k1", "k2", "total")}
    return materialize(ids.join(whole, "conv_id", "left").withColumns(filled), "trie-whole", True)


def ends(whole: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of every sequence: the hash of its conversations' ids in order, comma-joined."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    blocks = whole.groupBy(*KEY, F.floor(F.col("conv_id") / IDS).alias("block")).agg(ids.alias("ids"))
    dealt = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "block").select(*KEY, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sha = None, None
        names = [*KEY, "ends_sha256"]
        for batch in batches:
            done = []
            for *key, ids in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if key != at:
                    if at is not None:
                        done.append((*at, sha.hexdigest()))
                    at, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=names)
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, sha.hexdigest())], names=names)

    return dealt.mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def weighted_prefixes(turns: DataFrame, seqs: DataFrame) -> DataFrame:
    """(conv_id, w, n, total, depth, k1, k2, pk1, pk2, before) of each sequence and each depth from 0 on.

    conv_id: the sequence's smallest; pk1, pk2: the parent's key; before: code points of the turns before the last.
    """
    held = turns.join(seqs.select("conv_id"), "conv_id").withColumn("block", F.floor((F.col("p") - 1) / BLOCK))
    totals = held.groupBy("conv_id", "block").agg(F.bit_xor("k1").alias("b1"), F.bit_xor("k2").alias("b2"), F.sum("len").alias("bl"))
    so_far = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    ahead = totals.select("conv_id", "block", *(F.coalesce(f(c).over(so_far), zero).alias(c) for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bl"))))
    own = Window.partitionBy("conv_id", "block").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    run = held.select("conv_id", "block", "p", "k1", "k2", "len", F.bit_xor("k1").over(own).alias("r1"), F.bit_xor("k2").over(own).alias("r2"), F.sum("len").over(own).alias("rl"))
    xor = lambda *cs: cs[0].bitwiseXOR(cs[1]) if len(cs) == 2 else xor(xor(*cs[:-1]), cs[-1])
    c = F.col
    deep = run.join(ahead, ["conv_id", "block"]).select(
        "conv_id", c("p").alias("depth"), xor(c("r1"), c("b1")).alias("k1"), xor(c("r2"), c("b2")).alias("k2"),
        xor(c("r1"), c("b1"), c("k1")).alias("pk1"), xor(c("r2"), c("b2"), c("k2")).alias("pk2"), (c("rl") + c("bl") - c("len")).alias("before"),
    ).join(seqs.select("conv_id", "w", c("depth").alias("n"), "total"), "conv_id")
    top = seqs.select("conv_id", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), zero.alias("pk1"), zero.alias("pk2"), zero.alias("before"), "w", c("depth").alias("n"), "total")
    return deep.unionByName(top)


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    own = own_turns(conversations)
    ids, turns = rebuilt(own)
    discard(own)
    whole = sequences(ids, turns)
    seqs = materialize(whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("w"), F.min("total").alias("total")), "trie-sequences", True)
    paths = materialize(weighted_prefixes(turns, seqs), "trie-paths", True)
    discard(turns)
    leaves = seqs.join(paths.where("depth < n").select(*KEY).distinct(), KEY, "left_anti").select("conv_id", F.lit(1).cast("bigint").alias("leaf"))
    # A node is owned by its smallest sequence; what a sequence owns is the tail of its path from some depth on.
    owned = paths.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.min("before").alias("before")).groupBy("conv_id").agg(F.min("before").alias("owned"))
    marked = paths.join(seqs.select("conv_id").join(owned, "conv_id", "left").join(leaves, "conv_id", "left"), "conv_id")
    to_come = F.sum(F.col("w") * (F.col("total") - F.col("before")))
    once = F.sum(F.when(F.col("owned").isNotNull(), F.col("total") - F.greatest("before", "owned")).otherwise(0))
    nodes = materialize(
        marked.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.sum("w").alias("n_convs"), F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
            (to_come - once).alias("saved_tokens"), F.min("pk1").alias("pk1"), F.min("pk2").alias("pk2"),
        ), "trie-nodes", True,
    )
    discard(paths)
    above = {"depth": F.col("depth") - 1, "k1": F.col("pk1"), "k2": F.col("pk2")}
    children = nodes.where("depth > 0").select(*(v.alias(k) for k, v in above.items())).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(children, KEY, "left").join(ends(whole), KEY, "left").join(parents, ["depth", "pk1", "pk2"], "left")
    zero, empty = F.lit(0).cast("bigint"), F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


#: crc32 bit by bit: a byte comes in at each eighth step.
SQL = """
with own as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} as said
  from conversations where conv_id is not null),
convs as (
  select conv_id, conv_id - conv_id % 100 as base, xor(crc, 4294967295) % 6 as h from (
    select conv_id, list_reduce(list_concat([4294967295::bigint], list_transform(range(8 * length(conv_id::varchar)), lambda i: case when i % 8 = 0 then ascii(substr(conv_id::varchar, (i // 8 + 1)::int, 1))::bigint else 0::bigint end)),
      lambda c, b: xor(xor(c, b) >> 1, case when xor(c, b) & 1 = 1 then 3988292384::bigint else 0::bigint end)) as crc
    from (select distinct conv_id from own))),
turns as (
  select c.conv_id, o.pos as p, o.said from convs c join own o on o.conv_id = c.base and o.pos <= c.h
  union all
  select c.conv_id, o.pos - c.h + (select count(*) from own b where b.conv_id = c.base and b.pos <= c.h), o.said from convs c join own o on o.conv_id = c.conv_id and o.pos > c.h),
whole as (
  select c.conv_id, coalesce(t.path, []) as path from convs c left join (select conv_id, list(said order by p) as path from turns group by conv_id) t using (conv_id)),
members as (
  select conv_id, path, d, path[:d] as node from whole, lateral (select unnest(range(len(path) + 1)) as d)),
nodes as (
  select node, d, min(conv_id) as conv_id, count(*) as n_convs,
         coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(path) = d), '') as ends
  from members group by node, d),
family as (
  select n.*, (select count(*) from nodes k where k.d = n.d + 1 and k.node[:n.d] = n.node) as n_children,
         case when n.d > 0 then length(n.node[n.d].text) else 0 end as len
  from nodes n)
select f.conv_id, f.d::bigint as depth, (select p.conv_id from nodes p where f.d > 0 and p.d = f.d - 1 and p.node = f.node[:f.d - 1]) as parent_conv_id,
       f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) as ends_sha256
from family f join (
  select a.node, a.d, count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.len)::bigint as saved_tokens
  from family a join family b on b.d >= a.d and b.node[:a.d] = a.node group by a.node, a.d) s on s.node = f.node and s.d = f.d
"""
