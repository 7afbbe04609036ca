"""N-gram Jaccard join by parity sketches (op8).

A document is the set of its distinct word shingles, as 64-bit hashes.  Flipping one bit of a sketch
per shingle (the XOR of all) makes a parity sketch whose Hamming distance to another never exceeds the
symmetric difference of the sets.  The sketch's blocks give a pigeonhole join: dealt into m blocks,
sets that differ in at most k shingles agree in all but k blocks.  A block is kept as the XOR of its
shingles' hashes, the sketch with so many bits that none meet.  m goes by the size band; a document
near a band's lower edge is also sketched in the band below, where its smaller partners are.

Every document sends out the k + 1 rarest of its blocks that aren't empty (rarity: counts of all
blocks of all documents, in a table of fixed size); k is the largest difference that the similarity
allows it.  Two documents that have k + 1 such blocks and are similar share one that both send.  A
document with fewer also sends single shingles by the same rule, where there are always enough, so two
of that kind meet there.  So no link is lost.

Documents of equal sets are one node.  Nodes that share a block make a group.  Each node of a group is
first held against the group's smallest node; what then still lies in different components is compared
across components within the group, by sketch, inside the task.  Only each node's nearest one
leaves it and is verified on whole sets; components are merged, and this goes on, with GROWTH times as many
partners each, in the parts of groups where some are left untried.  So rows stay in proportion to the members,
not to their pairs.  A group of more than UNIT nodes is compared part by part, each pair of parts in its own unit.

Defined results: no words or a null text: an empty set, size 0, linked with nothing, its own component;
repeated rows and equal texts are one component; an empty table gives no rows; ids are integers, a null id
takes part in nothing and has a null component, also where its text equals others; texts are taken whole;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import record, text_blocks
from .components import forest, merge
from .shared import LARGE_ROWS, cut, drop, shuffle_partitions
from .shingles import folded, mix, shingle_sets

RARITY_BITS = 18  # of the table of block counts: 1 MB
LEAST_BAND = 4  # smaller sets have the sketch of this band: 1,024 bits
BLOCK = 2 << 20  # bytes of text that are hashed at once: some fifty times as much memory
GROWTH = 8  # of the partners that a node tries, from round to round
UNIT = 4096  # nodes of a group that are compared in one task at most
DEALT = 8  # buckets of sent blocks for each shuffle partition


def band_of(n: np.ndarray) -> np.ndarray:
    return (np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1) // 2  # the power of 4


def blocks_in(band: np.ndarray) -> np.ndarray:
    return np.maximum(64, (3 * 4 ** (band.astype(np.int64) + 1)) // 4)


def block_keys(hashes: np.ndarray, offsets: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the blocks that aren't empty, and the number of the set of each. band: of each set, -1 to leave it out."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    use = band[owner] >= 0
    h, owner = hashes[use], owner[use]
    m = blocks_in(band).astype(np.uint64)[owner]
    block = ((h >> np.uint64(32)) * m) >> np.uint64(32)  # ascending within a set, as the hashes are
    if not len(h):
        return h, owner
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])])
    at = np.flatnonzero(new)
    content = np.bitwise_xor.reduceat(mix(h, 7), at)
    return mix(content ^ mix(block[at] + (band[owner[at]].astype(np.uint64) << np.uint64(40)), 8), 9), owner[at]


def bands(sizes: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Own band, and the one below where partners can lie in it; -1 for none."""
    own = np.where(sizes > 0, band_of(sizes), -1)
    least = -(-sizes * t.numerator // t.denominator)
    return own, np.where((own > 0) & (least < 4 ** np.maximum(own, 0)), own - 1, -1)


def rarest(keys: np.ndarray, owner: np.ndarray, count: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which keys are among the most[owner] + 1 rarest of their set; ties by key."""
    order = np.lexsort((keys, count, owner))
    o = owner[order]
    first = np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.zeros(0, dtype=bool)
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0))
    keep = np.zeros(len(o), dtype=bool)
    keep[order] = rank <= most[o]
    return keep


def sent_keys(hashes: np.ndarray, offsets: np.ndarray, table: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Keys that each set sends out, and the set's number."""
    sizes = np.diff(offsets)
    shift = np.uint64(64 - RARITY_BITS)
    # Sets of a and b >= a shingles with similarity t differ in b - a at most; with b <= a in less.
    most = sizes * (t.denominator - t.numerator) // t.numerator
    out = []
    few = np.zeros(len(sizes), dtype=bool)
    for band in bands(sizes, t):
        keys, owner = block_keys(hashes, offsets, band)
        few |= (band >= 0) & (np.bincount(owner, minlength=len(sizes)) <= most)
        keep = rarest(keys, owner, table[(keys >> shift).astype(np.int64)], most)
        out.append((keys[keep], owner[keep]))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    single = few[owner]
    keys, owner = mix(hashes[single], 11), owner[single]
    keep = rarest(keys, owner, np.zeros(len(keys), dtype=np.int64), sizes - -(-sizes * t.numerator // t.denominator))
    out.append((keys[keep], owner[keep]))
    return np.concatenate([k for k, _ in out]), np.concatenate([o for _, o in out])


def sketch_bits(sizes: np.ndarray) -> np.ndarray:
    """By size band, as many as the band's sets have shingles, or more."""
    return 4 ** (np.maximum(band_of(sizes), LEAST_BAND).astype(np.int64) + 1)


def sketches(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Parity sketches; XOR of its quarters makes a sketch that of the band below."""
    bits = sketch_bits(np.diff(offsets))
    first = np.concatenate([[0], np.cumsum(bits)])
    owner = np.repeat(np.arange(len(bits)), np.diff(offsets))
    odd = np.bincount(first[owner] + (mix(hashes, 3) % bits[owner].astype(np.uint64)).astype(np.int64), minlength=int(first[-1])) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(first, first[1:], strict=False)]


def folded_to(sketch: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(sketch.reshape(-1, size), axis=0) if len(sketch) > size else sketch


def distance(a: bytes, b: bytes) -> int:
    x, y = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded_to(x, size) ^ folded_to(y, size)).sum())


def _sets(block: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets(block.column("text"), width)


SCANNED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("sketch", pa.binary()), ("counts", pa.binary())])


def _scan(docs: DataFrame, width: int, t: Fraction) -> DataFrame:
    """Of each document its set's size, digests and sketch; and, a row for each partition, the counts of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        for batch in batches:
            for block in text_blocks(batch, "text", BLOCK):
                hashes, offsets = _sets(block, width)
                for band in bands(np.diff(offsets), t):
                    keys, _ = block_keys(hashes, offsets, band)
                    counts += np.bincount((keys >> np.uint64(64 - RARITY_BITS)).astype(np.int64), minlength=len(counts))
                node = mix(folded(mix(hashes, 5), offsets, np.add), 1).view(np.int64)
                check = folded(mix(hashes, 6), offsets, np.bitwise_xor).view(np.int64)
                yield record(SCANNED, block.column("doc_id"), np.diff(offsets), node, check, sketches(hashes, offsets), pa.nulls(len(node), pa.binary()))
        none = pa.nulls(1, pa.int64())
        yield record(SCANNED, none, none, none, none, pa.nulls(1, pa.binary()), [counts.tobytes()])

    return docs.mapInArrow(run, "doc_id long, n long, node long, check long, sketch binary, counts binary")


def _added(counts: DataFrame) -> np.ndarray:
    """Sum of the partitions' tables; one table of fixed size reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, dtype=np.int64)
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]}, schema=pa.schema([("counts", pa.binary())]))

    part = counts.select("counts").mapInArrow(run, "counts binary")
    got = part.coalesce(1).mapInArrow(run, "counts binary").collect()
    return np.frombuffer(got[0]["counts"], dtype=np.int64) if got else np.zeros(1 << RARITY_BITS, dtype=np.int64)


SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary())])


def _send(docs: DataFrame, table, width: int, t: Fraction, buckets: int) -> DataFrame:
    """The sent keys with their nodes, in one row for each bucket and block of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = table.value
        for batch in batches:
            for block in text_blocks(batch, "text", BLOCK):
                hashes, offsets = _sets(block, width)
                node = mix(folded(mix(hashes, 5), offsets, np.add), 1)
                keys, owner = sent_keys(hashes, offsets, counts, t)
                bucket = (keys % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                keys, nodes, bucket = keys[order], node[owner[order]], bucket[order]
                cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
                stops = np.append(cuts[1:], len(keys))
                if len(cuts):
                    yield record(SENT, bucket[cuts].astype(np.int32), [keys[a:b].tobytes() for a, b in zip(cuts, stops, strict=True)], [nodes[a:b].tobytes() for a, b in zip(cuts, stops, strict=True)])

    return docs.mapInArrow(run, "bucket int, keys binary, nodes binary")


MET = pa.schema([("grp", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _meet(sent: DataFrame) -> DataFrame:
    """Rows (null, smallest, other) of each group, once a partition, and (group, null, member) of groups of three and more, a group for each list of members."""

    def groups(keys: np.ndarray, nodes: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])])
        keys, nodes = keys[new], nodes[new]
        head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        size = np.diff(np.append(head, len(keys)))
        lead = np.repeat(nodes[head], size)
        other = nodes != lead
        pairs = np.unique(np.stack([lead[other], nodes[other]], axis=1), axis=0)
        if len(pairs):
            yield record(MET, pa.nulls(len(pairs), pa.int64()), pairs[:, 0], pairs[:, 1])
        big = size >= 3
        name = np.add.reduceat(mix(nodes.view(np.uint64), 13), head).view(np.int64)
        _, once = np.unique(np.where(big, name, 0), return_index=True)
        once = once[big[once]]
        for i in range(0, len(once), 5000):
            part = once[i : i + 5000]
            rows = np.concatenate([np.arange(head[j], head[j] + size[j]) for j in part])
            yield record(MET, np.repeat(name[part], size[part]), pa.nulls(len(rows), pa.int64()), nodes[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, nodes = None, [], []
        for batch in batches:
            for bucket, k, n in zip(*(batch.column(c).to_pylist() for c in SENT.names), strict=True):
                if bucket != now and keys:
                    yield from groups(np.concatenate(keys), np.concatenate(nodes))
                    keys, nodes = [], []
                now = bucket
                keys.append(np.frombuffer(k, dtype=np.uint64))
                nodes.append(np.frombuffer(n, dtype=np.int64))
        if keys:
            yield from groups(np.concatenate(keys), np.concatenate(nodes))

    n = shuffle_partitions(sent.sparkSession)
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "grp long, a long, b long")


def _near(bits: np.ndarray, na: np.ndarray, nb: np.ndarray, t: Fraction) -> np.ndarray:
    """Whether sketches that differ in so many bits, of sets so large, can be of similar sets."""
    whole, part = t.denominator, t.numerator
    total = na + nb
    return (np.minimum(na, nb) * whole >= np.maximum(na, nb) * part) & (bits * (whole + part) <= total * (whole - part))


NEAR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bits", pa.int64())])


def _sketched(pairs: DataFrame, nodes: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) of nodes that their sizes and sketches allow, with the sketches' distance."""
    of = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") * t.denominator >= F.greatest("na", "nb") * t.numerator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([distance(a, b) for a, b in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)], dtype=np.int64)
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            keep = _near(bits, na, nb, t)
            yield record(NEAR, *(batch.column(c).filter(pa.array(keep)) for c in ("a", "b")), bits[keep])

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, bits long")


FOUND = pa.schema([*((c, pa.int64()) for c in ("grp", "ua", "ub", "x", "y")), ("more", pa.bool_())])


def _units(members: DataFrame) -> DataFrame:
    """members with the unit of comparison: a group of at most UNIT nodes, or a pair of such parts of a larger one; side tells the parts apart."""
    sizes = members.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.expr(f"(count(*) + {UNIT - 1}) div {UNIT}").alias("parts"))
    open_ = members.join(sizes.where("low <> high").select("grp", "parts"), "grp").withColumn("part", F.expr("pmod(xxhash64(node), parts)"))
    return open_.withColumn("u", F.explode(F.expr("transform(sequence(0L, parts - 1), j -> named_struct('ua', least(part, j), 'ub', greatest(part, j), 'side', if(part > j, 1, 0)))"))).select("grp", "u.*", "node", "comp")


def _across(units: DataFrame, t: Fraction, most: int) -> DataFrame:
    """Unit, x, y, more: of each node x the ``most`` nearest nodes of smaller components in its unit that sizes and sketches allow and x has not tried; and whether x has further ones to try."""

    def pairs(side: np.ndarray, comp: np.ndarray, node: np.ndarray, n: np.ndarray, sketch: list[bytes], tried: list) -> Iterator[np.ndarray]:
        order = np.argsort(n, kind="stable")
        side, comp, node, n = side[order], comp[order], node[order], n[order]
        whole = [np.frombuffer(sketch[i], dtype=np.uint64) for i in order]
        size = np.array([len(x) for x in whole])
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(n)]  # ascending sizes: bands lie together
        stacks = {a: np.stack(whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)}
        halves = len(np.unique(side)) > 1
        for at, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            # A node's partners lie in its own band and the next ones; the larger sketch is folded.
            near = {a: stacks[a]}
            if at:
                near[cuts[at - 1]] = stacks[cuts[at - 1]]
            if b < len(n):
                near[b] = np.stack([folded_to(x, size[a]) for x in stacks[b]])
            for i in range(a, b):
                low, high = np.searchsorted(n * t.denominator, n[i] * t.numerator, side="left"), np.searchsorted(n * t.numerator, n[i] * t.denominator, side="right")
                hits, dist = [], []
                for first, stack in near.items():
                    lo, hi = max(low, first), min(high, first + len(stack))
                    if hi <= lo:
                        continue
                    use = comp[lo:hi] < comp[i]
                    if halves:
                        use &= side[lo:hi] != side[i]
                    use = np.flatnonzero(use)
                    if not len(use):
                        continue
                    mine = folded_to(whole[i], stack.shape[1])
                    bits = np.bitwise_count(stack[use + lo - first] ^ mine).sum(axis=1, dtype=np.int64)
                    keep = _near(bits, n[use + lo], np.full(len(use), n[i]), t)
                    hits.append(node[use[keep] + lo])
                    dist.append(bits[keep])
                if not hits:
                    continue
                hits, dist = np.concatenate(hits), np.concatenate(dist)
                if tried[order[i]]:
                    new = ~np.isin(hits, tried[order[i]])
                    hits, dist = hits[new], dist[new]
                best = np.lexsort((hits, dist))[:most]
                if len(best):
                    yield np.stack([np.full(len(best), node[i]), hits[best], np.full(len(best), len(hits) > len(best))], axis=1)

    columns = ("side", "comp", "node", "n", "sketch", "tried")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            numbers = (np.concatenate([p[i] for p in parts]) for i in range(4))
            got = list(pairs(*numbers, *([x for p in parts for x in p[i]] for i in (4, 5))))
            if got:
                got = np.concatenate(got).T
                yield record(FOUND, *(np.full(got.shape[1], u) for u in now), *got[:2], got[2].astype(bool))

        for batch in batches:
            unit = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "ua", "ub")], axis=1)
            have = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns[:4]] + [batch.column(c).to_pylist() for c in columns[4:]]
            cuts = [0, *(np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1).tolist(), len(unit)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                name = tuple(unit[a].tolist())
                if name != now and parts:
                    yield from flush()
                    parts.clear()
                now = name
                parts.append([x[a:b] for x in have])
        if parts:
            yield from flush()

    keys = ("grp", "ua", "ub")
    dealt = units.repartition(shuffle_partitions(units.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, *columns).mapInArrow(run, "grp long, ua long, ub long, x long, y long, more boolean")


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """Pairs whose whole sets are similar. sets: node, items (ascending hashes)."""
    of = lambda x: sets.select(F.col("node").alias(x), F.col("items").alias(f"i{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ia").to_pylist(), batch.column("ib").to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common * t.denominator >= (len(both) - common) * t.numerator)
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long")


def _items(docs: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("node", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch, "text", BLOCK):
                hashes, offsets = _sets(block, width)
                same = mix(folded(mix(hashes, 5), offsets, np.add), 1).view(np.int64) == block.column("node").to_numpy(zero_copy_only=False)  # an id may stand for several texts
                rows = record(schema, block.column("node"), [hashes[a:b].tobytes() for a, b in zip(offsets, offsets[1:], strict=False)])
                yield rows.filter(pa.array(same))

    return docs.select("node", "text").mapInArrow(run, "node long, items binary")


def jaccard_components(docs: DataFrame, similarity: Fraction = Fraction(3, 4), width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest id that links of at least the similarity lead to."""
    t = similarity
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    scanned = cut(_scan(docs, width, t))
    counts = _added(scanned.where(F.col("counts").isNotNull()))
    rows = scanned.where(F.col("counts").isNull()).drop("counts")
    classes = cut(rows.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.min("check").alias("check"), F.max("check").alias("other")))
    if not classes.where("check <> other").isEmpty():
        raise ValueError("two different shingle sets have the same 64-bit digest")
    table = spark.sparkContext.broadcast(counts)
    met = cut(_meet(_send(docs.where(F.col("doc_id").isNotNull()), table, width, t, DEALT * shuffle_partitions(spark))))
    pairs = met.where("grp is null").select("a", "b").distinct()
    near = cut(_sketched(pairs, classes, t))

    def similar(pairs: DataFrame) -> DataFrame:
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", F.col("rep").alias("doc_id")), "node"))
        sets = cut(_items(docs.join(wanted, "doc_id"), width).dropDuplicates(["node"]))
        links = cut(_verified(pairs, sets, t), LARGE_ROWS)
        drop(wanted, sets)
        return links

    # First the nearest leader of each node, which mostly joins it to its component; then the other leaders that are still apart.
    nearest = cut(near.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b"))
    comp = cut(forest(similar(nearest)))  # a leader is smaller than its group, and each node has one nearest
    rest = cut(_apart(near.select("a", "b").join(nearest, ["a", "b"], "left_anti"), comp))
    if not rest.isEmpty():
        comp = merge(comp, similar(rest))
    # Then the nearest nodes across components within a group, as far as they were not tried. A unit is done when none of its nodes has more to try.
    members = cut(met.where("grp is not null").select("grp", F.col("b").alias("node")).distinct())
    drop(met)
    placed = lambda: members.join(comp, "node", "left").select("grp", "node", F.coalesce("comp", "node").alias("comp"))
    units = _units(placed()).drop("comp")
    tried = near.select(F.col("b").alias("x"), F.col("a").alias("y"))
    most = 1
    while True:
        known = tried.groupBy(F.col("x").alias("node")).agg(F.collect_set("y").alias("tried"))
        now = units.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node")).join(classes.select("node", "n", "sketch"), "node").join(known, "node", "left")
        found = cut(_across(now, t, most))
        pairs = found.select("x", "y").distinct()
        if found.isEmpty():
            break
        comp = merge(comp, similar(pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()))
        left = found.where("more").select("grp", "ua", "ub").distinct()
        if left.isEmpty():
            break
        units = cut(units.join(left, ["grp", "ua", "ub"], "left_semi"))
        tried = cut(tried.unionByName(pairs))
        most *= GROWTH
    named = classes.select("node", "rep").join(comp, "node", "left").select("node", "rep", F.coalesce("comp", "node").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = named.join(smallest, "comp").select("node", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(final, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs (a, b) that lie in different components."""
    of = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")
