"""The trie of conversation prefixes by smallest-member ownership (op13).

A node is a distinct sequence of first turns; its members are the conversations that begin with it, its owner the smallest of
them.  Members only get fewer on the way down, so what a conversation owns of its path is a suffix of it, and every node has one
owner: sums over the distinct nodes of a subtree are sums over what its members own.  Hence one grouping by prefix gives it all: a
member adds the tokens of its turns from the node down, less those of the nodes that it owns there, a flag if it owns the leaf
where it ends, and one for the child that it owns.

A prefix is told by the exclusive-or of 128 bits for each (depth, turn), which come from the SHA-256 of role and text; such sums, like those of
tokens, run over parts of a conversation of PART turns and then over parts, so one that holds a third of all rows is no task's
alone.  Positions come from a range sort by (conversation, turn) and offsets of its partitions.  Counts are combined before they are
shuffled, the one join on a possibly hot prefix (a parent's) has one row for each conversation and is Spark's to split, and the ids that end
at a node are joined to CHUNK bytes where they lie in order, then hashed as they stream by.

Defined results: a row with a null conversation id is left out.  Turns are ordered by turn (null first), then role and text, so
that ties have an order; repeated rows are turns each.  Null role or text is empty.  Texts count whole, however long.  An empty table has no
nodes.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import record
from .shared import cut, with_offsets

PART = 1 << 14  # turns of a conversation that one window holds
CHUNK = 1 << 16  # characters of ids that are joined before they are hashed
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, position (from 1), g1, g2 (of role and text), words."""
    said = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    order = ("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    sorted_ = said.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", digest.alias("digest"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("at"))
    parts = F.shiftright("at", 33).alias("part")
    g1, g2 = (F.conv(F.substr("digest", F.lit(i), F.lit(15)), 16, 10).cast("long") for i in (1, 16))
    dealt = cut(sorted_.select("conv_id", parts, "at", g1.alias("g1"), g2.alias("g2"), "words"))
    groups = dealt.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    offsets = with_offsets(groups, "conv_id", "part", "n", "offset").drop("n")
    return dealt.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("offset") + 1).alias("position"), "g1", "g2", "words")


def rebuilt(said: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """conv_id, depth (0: the conversation as such, without a turn), g1, g2, words.

    The first h turns of c come from conversation c - c % block, its own follow after its first h; h is the CRC-32 of the decimal id modulo ``most``.
    """
    said = cut(said)
    c = F.col("conv_id")
    convs = said.select("conv_id").distinct().select("conv_id", (c - c % block).alias("donor"), (F.crc32(c.cast("string")) % most).alias("h"))
    lent = said.where((c % block == 0) & (F.col("position") < most)).select(c.alias("donor"), "position", "g1", "g2", "words")
    # Fewer than ``most`` turns of each donor go to fewer than 2 * block conversations.
    got = convs.join(lent, "donor").where(F.col("position") <= F.col("h")).select("conv_id", F.col("position").alias("depth"), "g1", "g2", "words")
    taken = got.groupBy("conv_id").agg(F.count("*").alias("taken"))
    begins = convs.join(taken, "conv_id", "left").select("conv_id", "h", F.coalesce("taken", F.lit(0)).alias("taken"))
    own = said.join(begins, "conv_id").where(F.col("position") > F.col("h")).select("conv_id", (F.col("position") - F.col("h") + F.col("taken")).alias("depth"), "g1", "g2", "words")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), zero.alias("words"))
    return got.unionByName(own).unionByName(roots)


def _paths(rows: DataFrame) -> DataFrame:
    """Each (conversation, depth) with its prefix x1, x2 and the parent's p1, p2, its words, those up to it (until), and the conversation's length and words in all."""

    def bits(salt: int) -> Column:
        return F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(salt), "depth", "g1", "g2"))

    dealt = cut(rows.select("conv_id", "depth", F.expr(f"depth div {PART}").alias("part"), bits(1).alias("b1"), bits(2).alias("b2"), "words"))
    sums = dealt.groupBy("conv_id", "part").agg(F.bit_xor("b1").alias("x1"), F.bit_xor("b2").alias("x2"), F.sum("words").alias("n"), F.max("depth").alias("deepest"))
    whole, before = W.partitionBy("conv_id"), W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    offsets = sums.select(
        "conv_id", "part", F.coalesce(F.bit_xor("x1").over(before), none).alias("o1"), F.coalesce(F.bit_xor("x2").over(before), none).alias("o2"), F.coalesce(F.sum("n").over(before), none).alias("o"),
        F.max("deepest").over(whole).alias("length"), F.sum("n").over(whole).alias("total"),
    )
    up_to = W.partitionBy("conv_id", "part").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    joined = dealt.join(offsets, ["conv_id", "part"])
    x1, x2 = F.bit_xor("b1").over(up_to).bitwiseXOR(F.col("o1")), F.bit_xor("b2").over(up_to).bitwiseXOR(F.col("o2"))
    told = joined.select("conv_id", "depth", x1.alias("x1"), x2.alias("x2"), "b1", "b2", "words", (F.sum("words").over(up_to) + F.col("o")).alias("until"), "length", "total")
    return told.select("conv_id", "depth", "x1", "x2", F.col("x1").bitwiseXOR(F.col("b1")).alias("p1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("p2"), "words", "until", "length", "total")


def trie(rows: DataFrame) -> DataFrame:
    """conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node; rows: as ``rebuilt`` returns them, with a row of depth 0 for each conversation."""
    paths = cut(_paths(rows))
    prefix = ["depth", "x1", "x2"]
    # Who owns a node, what of the owner's words stand above it, and whether a member goes on.
    owners = cut(paths.groupBy(*prefix).agg(F.min(F.struct("conv_id", (F.col("until") - F.col("words")).alias("above"), "p1", "p2")).alias("own"), F.max(F.col("length") > F.col("depth")).alias("goes_on")))
    # What a conversation owns: its path from ``top`` down, and its end if nobody goes on there.
    owned = owners.groupBy(F.col("own.conv_id").alias("conv_id")).agg(F.min(F.struct("depth", "own.above", "own.p1", "own.p2")).alias("first"), F.max(~F.col("goes_on")).alias("leaf"))
    owned = cut(owned.select("conv_id", F.col("first.depth").alias("top"), F.col("first.above").alias("above"), F.col("first.p1").alias("p1"), F.col("first.p2").alias("p2"), F.col("leaf").cast("long").alias("leaf")))
    depth, top = F.col("depth"), F.col("top")
    marked = paths.drop("p1", "p2").join(owned.drop("p1", "p2"), "conv_id", "left")
    shared_words = F.when(top.isNull(), F.col("total")).otherwise(F.col("above")) - F.col("until") + F.col("words")
    nodes = marked.groupBy(*prefix).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.when((depth + 1 >= top) & (depth < F.col("length")), 1).otherwise(0)).alias("n_children"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.when(top.isNull() | (depth < top), shared_words).otherwise(0)).alias("saved_tokens"),
    )
    # The parent of a node is its owner's too, but at the owner's top.
    above = owners.select((depth + 1).alias("depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"), F.col("own.conv_id").alias("parent"))
    tops = owned.select("conv_id", top.alias("depth"), "p1", "p2").where(depth > 0).join(above, ["depth", "p1", "p2"]).select("conv_id", "depth", "parent")
    ends = paths.where(depth == F.col("length")).select(*prefix, "conv_id")
    out = nodes.join(tops, ["conv_id", "depth"], "left").join(_digests(ends, prefix), prefix, "left")
    parent = F.when(depth > 0, F.coalesce("parent", "conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


RUNS = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
DIGESTS = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends_sha256", pa.string())])


def _digests(ends: DataFrame, prefix: list[str]) -> DataFrame:
    """The SHA-256 of the ids of each prefix in ascending order, comma-joined.

    Ids lie sorted over range partitions, so one prefix may have many tasks; there they are joined to chunks, and only chunks come together.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, size, done = None, [], 0, []
        for batch in batches:
            for *k, i in zip(*(batch.column(c).to_pylist() for c in (*prefix, "conv_id")), strict=True):
                if k != key or size >= CHUNK:
                    if ids:
                        done.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids, size = k, [], 0
                ids.append(i)
                size += 20
            if done:
                yield record(RUNS, *zip(*done, strict=True))
                done = []
        if ids:
            yield record(RUNS, *zip((*key, ids[0], ",".join(map(str, ids))), strict=True))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            for *k, ids in zip(*(batch.column(c).to_pylist() for c in (*prefix, "ids")), strict=True):
                if k == key:
                    state.update(b"," + ids.encode())
                    continue
                if key is not None:
                    done.append((*key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids.encode())
            if done:
                yield record(DIGESTS, *zip(*done, strict=True))
                done = []
        if key is not None:
            yield record(DIGESTS, *zip((*key, state.hexdigest()), strict=True))

    runs = ends.repartitionByRange(*prefix, "conv_id").sortWithinPartitions(*prefix, "conv_id").mapInArrow(chunks, "depth long, x1 long, x2 long, first long, ids string")
    return runs.repartition(*prefix).sortWithinPartitions(*prefix, "first").mapInArrow(hashed, "depth long, x1 long, x2 long, ends_sha256 string")


#: The same over whole prefixes as texts: a chained digest of role and text names a node.
ORACLE = r"""
with recursive crc as (select range as i, range as c, 0 as n from range(256) union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, n + 1 from crc where n < 8),
crc_table as (select list(c order by i) as t from crc where n = 8),
ids as (select distinct conv_id as c, cast(conv_id as varchar) as s from conversations where conv_id is not null),
steps as (select c, s, 1 as i, cast(4294967295 as bigint) as r from ids union all
  select c, s, i + 1, xor(r >> 8, t[cast(xor(r, ascii(substr(s, i, 1))) & 255 as int) + 1]) from steps, crc_table where i <= length(s)),
h as (select c, c - c % 20 as donor, xor(r, 4294967295) % 4 as h from steps where i = length(s) + 1),
o as (select conv_id as c, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
t as (select h.c, o.p as d, role, text from h join o on o.c = donor where p <= h
  union all select h.c, p - h + (select count(*) from o q where q.c = h.donor and q.p <= h.h) as d, role, text from h join o on o.c = h.c where p > h),
w as (select *, md5(concat(length(role), ':', role, text)) as g, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as n from t),
x as (select c, d, n, sha256(string_agg(g, '' order by d) over (partition by c order by d)) as k from w union all select c, 0, 0, 'root' from h),
e as (select *, lag(k) over (partition by c order by d) as pk, max(d) over (partition by c) as last from x),
nodes as (select k, d, any_value(pk) as pk, min(c) as c, count(*) as n_convs, any_value(n) as n, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where d = last), '')) as ends from e group by k, d),
kids as (select pk, count(*) as n_children from nodes where pk is not null group by pk),
full_ as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids on kids.pk = nodes.k),
walk as (select k as top, pk, n, n_convs, n_children from full_ union all select full_.k, full_.pk, walk.n, walk.n_convs, walk.n_children from walk join full_ on full_.k = walk.pk),
sums as (select top, sum((n_convs - 1) * n) as saved, count(*) filter (where n_children = 0) as leaves from walk group by top)
select f.c as conv_id, cast(f.d as bigint) as depth, p.c as parent_conv_id, f.n_convs, f.n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, f.ends as ends_sha256
from full_ f join sums on sums.top = f.k left join full_ p on p.k = f.pk
"""
