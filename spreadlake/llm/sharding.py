"""Sharding by balanced label propagation under the law ``rows`` (op3): DataFrame functions only.

Documents of equal text are linked.  Shards start exactly even, by rank.  Groups larger than an
eighth of a shard go first, the largest one ahead, each into as few shards as the rooms allow: one larger
than a shard fills one after the other.  Then, in every round, each group asks whole for the shard that most
of its members start in, of those with room left; a shard accepts, the largest asks first, up to its quota of
rows.  Who is refused asks again in the next round; from round ROUNDS on a shard also takes the part of a
group that fills it, so rounds end, and no more of these groups are split than there are shards.  Members of
a group are alike, so rounds work on counts per (group, shard), never on documents.
Documents without links have nothing to lose and fill what the quotas leave, so that the counts of shards
differ by one at most.  Ranks come from counts per bucket of ids, whose number grows with the table, and sums over
earlier groups from parts of groups, so neither a hot group nor a shard nor the whole table ever meets in one task.

Defined results: a null text has size 16, the CRC of no bytes, and is linked with empty texts; repeated rows
are linked and counted each; a null id is an id like others; texts are taken whole; ties go by group name and id; fewer documents than shards leave shards empty;
an empty table gives no rows; columns other than id and text, also those with names used here, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

ROWS = 50_000  # documents of a bucket of ids, about: the tables of the buckets' counts have a row for each
DIGITS = 3  # of a group's name that part the groups of a shard, for sums over earlier groups
ROUNDS = 4  # in which groups are taken whole or not at all
PART = 8  # groups over this part of a shard are seated first: little more than PART x shards of them


def _before(df: DataFrame, keys: list[str], order: list[Column], named: list[str], n: str, out: str) -> DataFrame:
    """Adds the sum of n over the rows of the same keys that come earlier by (order, g).

    Parts of equal order and of equal first digits of g are summed first; only inside a part are rows sorted. named: order's columns.
    """
    parted = df.withColumn("__part", F.substring("g", 1, DIGITS))
    parts = parted.groupBy(*keys, *named, "__part").agg(F.sum(n).alias("__n"))
    earlier = W.partitionBy(*keys).orderBy(*order, "__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*keys, *named, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__off"))
    inside = W.partitionBy(*keys, *named, "__part").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    both = parted.join(parts, [*keys, *named, "__part"])
    return both.withColumn(out, F.col("__off") + F.coalesce(F.sum(n).over(inside), F.lit(0))).drop("__part", "__off")


def _offsets(counts: DataFrame) -> DataFrame:
    """bucket, n -> bucket, before; a row for each bucket, so one task will do."""
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    return counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def _seat_large(votes: dict[str, dict[int, int]], rooms: list[int]) -> list[tuple[str, int, int]]:
    """(g, shard, n): whole shards first, the rest where the least room holds it; among equals where most members are. Takes from rooms."""
    seats = []
    for g in sorted(votes, key=lambda g: (-sum(votes[g].values()), g)):
        left = sum(votes[g].values())
        while left:
            fits = [s for s, room in enumerate(rooms) if room >= left]
            s = min(fits, key=lambda s: (rooms[s], -votes[g].get(s, 0), s)) if fits else max(range(len(rooms)), key=lambda s: (rooms[s], votes[g].get(s, 0), -s))
            n = min(left, rooms[s])
            seats.append((g, s, n))
            rooms[s] -= n
            left -= n
    return seats


def propagate(held: DataFrame, quotas: list[int]) -> DataFrame:
    """(g, shard, n) after label propagation, all members of all groups seated within the quotas."""
    spark = held.sparkSession
    rooms = list(quotas)
    sizes = cut(held.groupBy("g").agg(F.sum("n").alias("c")))
    large = F.col("c") * PART > max(rooms)
    votes: dict[str, dict[int, int]] = {}
    for r in held.join(sizes.where(large), "g", "left_semi").collect():  # little more than PART x shards groups, an entry for each shard
        votes.setdefault(r["g"], {})[r["shard"]] = r["n"]
    seats = spark.createDataFrame(_seat_large(votes, rooms), "g string, shard int, n long")
    left, turn = sizes.where(~large), 0
    while not left.isEmpty():
        room_left = [s for s, room in enumerate(rooms) if room > 0]
        target = held.where(F.col("shard").isin(room_left)).join(left, "g", "left_semi").groupBy("g").agg(F.max_by("shard", F.struct("n", F.xxhash64("g", "shard"))).alias("target"))
        other = F.get(F.array(*map(F.lit, room_left)), F.pmod(F.xxhash64("g", F.lit(turn)), F.lit(len(room_left))).cast("int"))
        asks = left.join(target, "g", "left").withColumn("target", F.coalesce("target", other))
        room = F.get(F.array(*[F.lit(x).cast("long") for x in rooms]), F.col("target"))
        asks = _before(asks, ["target"], [F.desc("c")], ["c"], "c", "ahead")
        asks = asks.withColumn("free", room - F.col("ahead")).withColumn("m", F.when(F.col("free") >= F.col("c"), F.col("c")).otherwise(F.greatest("free", F.lit(0)) if turn >= ROUNDS else F.lit(0)).cast("long"))
        asks = cut(asks.select("g", "c", "target", "m"))
        seats = seats.unionByName(asks.where("m > 0").select("g", F.col("target").alias("shard"), F.col("m").alias("n")))
        for r in asks.groupBy("target").agg(F.sum("m").alias("m")).collect():
            rooms[r["target"]] -= r["m"]
        left, turn = asks.where("m < c").select("g", (F.col("c") - F.col("m")).alias("c")), turn + 1
    return cut(seats)


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("g"), F.xxhash64(F.col(id_col).cast("long")).alias("hash")))
    total = rows.count()
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(max(64, 1 << (total // ROWS).bit_length()))).cast("int")).drop("hash")
    per_bucket = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")))
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    # Ranks within a bucket, and within a group's part in the bucket; both on one exchange.
    dealt = rows.repartition("bucket")
    dealt = dealt.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy("doc_id", "g")) - 1).withColumn("j", F.row_number().over(W.partitionBy("bucket", "g").orderBy("doc_id")) - 1)
    ranked = cut(dealt.join(_offsets(per_bucket), "bucket").withColumn("start", F.pmod(F.col("k") + F.col("before"), F.lit(shards)).cast("int")).drop("k", "before"))
    held = ranked.groupBy("g", F.col("start").alias("shard")).agg(F.count("*").alias("n"))
    linked = held.groupBy("g").agg(F.sum("n").alias("c")).where("c > 1").select("g")
    held = propagate(cut(held.join(linked, "g", "left_semi")), quotas)
    # Where each group's members go: intervals of their ranks, and the slot of an interval's first.
    placed = _before(held, ["shard"], [], [], "n", "slot")
    plan = placed.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("shard", "n", "slot"))).alias("x"))  # as many entries as shards at most
    upto = "aggregate(slice(x, 1, i + 1), 0L, (a, e) -> a + e.n)"
    plan = plan.selectExpr("g", f"transform(x, (e, i) -> named_struct('upto', {upto}, 'shard', e.shard, 'shift', e.slot + e.n - {upto})) plan")
    parts = ranked.groupBy("g", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("g").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.join(plan, "g").select("g", "bucket", "plan", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    joined = cut(ranked.join(parts, ["g", "bucket"], "left").selectExpr("doc_id", "size", "text_crc32", "bucket", "g", "plan is null free", "j + before r", "plan").selectExpr("doc_id", "size", "text_crc32", "bucket", "g", "free", "r", "filter(plan, e -> r < e.upto)[0] e"))
    taken = {r["shard"]: r["n"] for r in held.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    # Documents without links, by rank, into what is left of the quotas.
    frees, at = [], 0
    for s in range(shards):
        room = quotas[s] - taken.get(s, 0)
        frees.append((at + room, s, taken.get(s, 0) - at))
        at += room
    left = ", ".join(f"named_struct('upto', {u}L, 'shard', {s}, 'shift', {d}L)" for u, s, d in frees)
    free = joined.where("free")
    offsets = _offsets(free.groupBy("bucket").agg(F.count("*").alias("n")))
    free = free.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy("doc_id", "g")) - 1).join(offsets, "bucket")
    free = free.selectExpr("doc_id", "size", "text_crc32", "k + before r", "e").selectExpr("doc_id", "size", "text_crc32", "r", f"filter(array({left}), f -> r < f.upto)[0] e")
    both = joined.where("not free").select("doc_id", "size", "text_crc32", "r", "e").unionByName(free)
    return both.selectExpr("doc_id", "size", "text_crc32", "'rows' law", "e.shard shard", "cast(r + e.shift as long) slot", "cast(null as int) grown_shard")
