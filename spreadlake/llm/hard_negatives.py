"""Hard negatives by inner product, found through a pivot table (op12).

With M the greatest length of any vector, x becomes (x, sqrt(M^2 - |x|^2)) and an anchor a becomes (a, 0); then the distance D of the two
has D^2 = M^2 + |a|^2 - 2<a, x>, so that inner product turns into Euclidean distance.  Every vector keeps its distances to
PIVOTS pivots.  By the triangle inequality |D(a, p) - D(x, p)| <= D(a, x) <= D(a, p) + D(x, p) for each pivot p, which brackets the
score from both sides.

Vectors are dealt into blocks by their nearest pivot and their distance to it, so a block's distances to the pivots lie in narrow
ranges; these bracket whole blocks first, then single vectors, and what survives is scored exactly in integers.  Anchors are taken in
slices of at most SLICE bytes, which are broadcast one after another and held against all blocks where these lie; nothing but
results is shuffled.  A slice visits the blocks in bands of growing size, in an order by hash; after each band the last of an anchor's
best so far is the threshold below which later vectors drop out.  First come the positives, then, with the window that
each positive opens, the negatives.  Brackets and thresholds only ever drop pairs that can't be returned.

Defined results: rows with a null label, null id, null vector, or any null or non-finite component take no part.  A vector of fewer
components than another counts as zero in the rest, an empty one in all.  Scores are exact whatever the size of the components; a
returned one that doesn't fit a long raises an error.  A row with the anchor's id is the anchor's own, whatever its vector; an id that stands on
several anchor rows is answered for each of them, and repeated rows are candidates each.  Equal scores go to the smaller id.
A component whose multiple by the scale leaves the doubles counts as non-finite.  An empty table, and anchors without positives, give no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import record
from .shared import cut

PIVOTS = 12
PIVOT_SAMPLE = 2048  # vectors that pivots are chosen among: those of least hash
BLOCK = 4096  # vectors of a block
SLICE = 16 << 20  # bytes of the anchors that are held against all blocks at once
TOGETHER = 256  # anchors that are held against a block at once
NEAR = 4  # pivots, the nearest to a block, that bracket its single vectors
FIRST = 16  # blocks of the first band, about
BAND = 8  # each band of blocks is so many times as large as the one before
EXACT = 2.0**53
WIDE = 2.0**62  # products beyond this are taken in Python's integers

VECTORS = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("v", pa.binary()), ("norm2", pa.float64()), ("d", pa.int32())])
NUMBERED = pa.schema([*VECTORS, ("number", pa.int64())])
BLOCKS = pa.schema([("ids", pa.binary()), ("labels", pa.binary()), ("width", pa.int32()), ("m", pa.binary()), ("far", pa.binary())])
BLOCK_TYPE = "ids binary, labels binary, width int, m binary, far binary"


def vectors_of(table: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, label, v (floor(scale * x) as doubles, which hold it exactly), norm2, d, number (of the row, fixed once written); rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, label, x in zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), batch.column("v"), strict=True):
                if not x.is_valid or x.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(v).all():
                    with np.errstate(over="ignore"):
                        out.append((i, label, v.tobytes(), min(float(v @ v), 1e300), len(v)))
            yield record(VECTORS, *(zip(*out, strict=True) if out else [[]] * 5))

    read = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v")).dropna(subset=["id", "label"])
    return read.mapInArrow(run, "id long, label long, v binary, norm2 double, d int").withColumn("number", F.monotonically_increasing_id())


def _matrix(rows: list[bytes], d: int) -> np.ndarray:
    """Vectors as rows, zeros where one has fewer components."""
    if all(len(r) == 8 * d for r in rows):
        return np.frombuffer(b"".join(rows)).reshape(len(rows), d)
    out = np.zeros((len(rows), d))
    for i, r in enumerate(rows):
        x = np.frombuffer(r)
        out[i, : len(x)] = x
    return out


def _packed(m: np.ndarray) -> tuple[int, bytes]:
    """Width in bytes of the narrowest integers that hold all components, 0 for doubles, and the components."""
    most = float(np.abs(m).max(initial=0))
    for width in (1, 2, 4):
        if most < 1 << (8 * width - 1):
            return width, m.astype(f"<i{width}").tobytes()
    return 0, m.astype("<f8").tobytes()


def _unpacked(width: int, raw: bytes, n: int, d: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{width}" if width else "<f8").reshape(n, d).astype(np.float64)


def _integers(m: np.ndarray) -> np.ndarray:
    """Python's integers, which hold every product."""
    return np.array([int(x) for x in m.ravel()], dtype=object).reshape(m.shape)


def _products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """All exact products of the rows: in floating point where every partial sum is an exact integer, else in wider integers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(x)), dtype=np.int64)
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(x).max(initial=0)) * a.shape[1]
    if bound < EXACT:
        return (a @ x.T).astype(np.int64)
    if bound < WIDE:
        return a.astype(np.int64) @ x.astype(np.int64).T
    return _integers(a) @ _integers(x).T


def _pivots(vectors: DataFrame, d: int) -> np.ndarray:
    """Vectors far from one another, of PIVOT_SAMPLE at most; which ones they are decides how much is pruned, never the result."""
    sample = vectors.orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_SAMPLE).select("v").collect()
    m = _matrix([bytes(r["v"]) for r in sample], d)
    chosen = [0]
    near = np.full(len(m), np.inf)
    while len(chosen) < min(PIVOTS, len(m)):
        with np.errstate(over="ignore", invalid="ignore"):
            near = np.minimum(near, np.nan_to_num(((m - m[chosen[-1]]) ** 2).sum(axis=1), nan=np.inf))
        chosen.append(int(near.argmax()))
    return m[chosen]


class Space:
    """The space of the augmented vectors, and the pivots in it."""

    def __init__(self, pivots: np.ndarray, d: int, longest2: float):
        self.d, self.longest2 = d, longest2
        self.pivots, self.pivot_extra = pivots, np.sqrt(np.maximum(longest2 - self._norm2(pivots), 0))

    @staticmethod
    def _norm2(m: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.minimum((m**2).sum(axis=1), 1e300)

    def distances(self, m: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Of every row, with ``extra`` as its last component, to every pivot."""
        with np.errstate(over="ignore"):
            return np.stack([np.sqrt(np.minimum(((m - p) ** 2).sum(axis=1) + (extra - e) ** 2, 1e300)) for p, e in zip(self.pivots, self.pivot_extra, strict=True)], axis=1)

    def of_vectors(self, m: np.ndarray) -> np.ndarray:
        return self.distances(m, np.sqrt(np.maximum(self.longest2 - self._norm2(m), 0)))

    def of_anchors(self, m: np.ndarray) -> np.ndarray:
        return self.distances(m, np.zeros(len(m)))

    def scores(self, anchors: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, high) of the score for each anchor, where distances lie between least and most; wider by what rounding may do."""
        norm2 = self._norm2(anchors).reshape(-1, *[1] * (least.ndim - 1))
        slack = 1e-9 * (self.longest2 + norm2) + 1
        with np.errstate(over="ignore"):
            return (self.longest2 + norm2 - most**2) / 2 - slack, (self.longest2 + norm2 - least**2) / 2 + slack


def _blocks(vectors: DataFrame, space: Space, n: int) -> DataFrame:
    """Blocks of vectors that lie at like distances from the pivots; an order by hash in which they are visited."""
    schema = pa.schema([*NUMBERED, ("wide", pa.int32()), ("cell", pa.int32()), ("near", pa.float64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v").to_pylist(), space.d)
            far = space.of_vectors(m)
            wide = (np.abs(m).max(axis=1, initial=0) >= 1 << 15).astype(np.int32)  # so that few blocks hold large components
            yield record(schema, *[batch.column(c) for c in NUMBERED.names], wide, far.argmin(axis=1).astype(np.int32), far.min(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                held.append(batch.slice(at, BLOCK))
                while sum(b.num_rows for b in held) >= BLOCK:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    yield packed(whole.slice(0, BLOCK))
                    held = whole.slice(BLOCK).to_batches()
        if held:
            yield packed(pa.Table.from_batches(held))

    def packed(t: pa.Table) -> pa.RecordBatch:
        m = _matrix(t["v"].to_pylist(), space.d)
        width, raw = _packed(m)
        return record(BLOCKS, [t["id"].to_numpy().tobytes()], [t["label"].to_numpy().tobytes()], [width], [raw], [space.of_vectors(m).tobytes()])

    placed = vectors.mapInArrow(place, "id long, label long, v binary, norm2 double, d int, number long, wide int, cell int, near double")
    dealt = placed.repartitionByRange(max(1, -(-n // BLOCK)), "wide", "cell", "near", "number").sortWithinPartitions("wide", "cell", "near", "number")
    return dealt.mapInArrow(run, BLOCK_TYPE).withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))


FOUND = pa.schema([("a", pa.int32()), ("j", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def _first(r: np.ndarray, ids: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores of each r, ties by smaller id."""
    order = sorted(range(len(r)), key=lambda i: (r[i], -s[i], ids[i])) if s.dtype == object else np.lexsort((ids, -s, r))
    order = np.asarray(order, dtype=np.int64)
    r = r[order]
    new = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, dtype=bool)
    rank = np.arange(len(r)) - np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    return order[rank < k]


class Visit:
    """What a task needs to hold a slice of anchors against a block: the k first of every list that an anchor has.

    List j of anchor a takes scores with low[a][j] <= score <= high[a][j], objects that are integers or infinities: of vectors of the
    anchor's label or, if not ``same``, of others.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, m: np.ndarray, space: Space, k: int, same: bool, low: np.ndarray, high: np.ndarray):
        self.ids, self.labels, self.m, self.space, self.k, self.same = ids, labels, m, space, k, same
        self.far = space.of_anchors(m)
        self.low, self.high = low, high
        # For scores that are held as longs, which lie within 2^62, and for brackets, with room for rounding.
        self.low_i, self.high_i = (np.array([max(-(1 << 62), min(1 << 62, v)) for v in x.ravel()], dtype=np.int64).reshape(x.shape) for x in (low, high))
        low_f, high_f = low.astype(np.float64), high.astype(np.float64)
        low_f, high_f = low_f - 1 - 1e-12 * np.abs(np.where(np.isfinite(low_f), low_f, 0)), high_f + 1 + 1e-12 * np.abs(np.where(np.isfinite(high_f), high_f, 0))
        self.least, self.most = low_f.min(axis=1, initial=np.inf), high_f.max(axis=1, initial=-np.inf)

    def block(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, far: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of the anchors whose brackets of the whole block allow it."""
        gap = np.maximum(np.maximum(far.min(axis=0) - self.far, self.far - far.max(axis=0)), 0).max(axis=1)
        low, high = self.space.scores(self.m, gap, (self.far + far.max(axis=0)).min(axis=1))
        some = np.flatnonzero((high >= self.least) & (low <= self.most))
        for at in range(0, len(some), TOGETHER):
            yield self.found(some[at : at + TOGETHER], ids, labels, x, far)

    def found(self, a: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, far: np.ndarray) -> pa.RecordBatch:
        near, reach = np.zeros((len(a), len(ids))), np.full((len(a), len(ids)), np.inf)
        for p in np.argsort(far.mean(axis=0))[:NEAR]:
            near = np.maximum(near, np.abs(self.far[a, p][:, None] - far[:, p]))
            reach = np.minimum(reach, self.far[a, p][:, None] + far[:, p])
        least, most = self.least[a][:, None], self.most[a][:, None]
        low, high = self.space.scores(self.m[a], near, reach)
        may = ((self.labels[a][:, None] == labels) == self.same) & (self.ids[a][:, None] != ids) & (high >= least) & (low <= most)
        rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
        s = _products(self.m[a[rows]], x[cols])
        about = s.astype(np.float64)
        r, c = np.nonzero(may[np.ix_(rows, cols)] & (about >= least[rows]) & (about <= most[rows]))
        s, r, c = s[r, c], a[rows[r]], cols[c]
        out = []
        for j in range(self.low.shape[1]):
            low, high = (self.low, self.high) if s.dtype == object else (self.low_i, self.high_i)
            ok = np.flatnonzero(((s >= low[r, j]) & (s <= high[r, j])).astype(bool))
            ok = ok[_first(r[ok], ids[c[ok]], s[ok], self.k)]
            out.append((r[ok], np.full(len(ok), j), ids[c[ok]], s[ok]))
        r, j, i, s = (np.concatenate(x) for x in zip(*out, strict=True))
        if s.dtype == object:
            if any(v >= 2**63 for v in s):
                raise OverflowError("a score among the best does not fit a long")
            s = np.array([max(v, -(2**63)) for v in s], dtype=object)  # below 0 a positive has no negatives and is not returned
        return record(FOUND, r.astype(np.int32), j.astype(np.int32), i, s.astype(np.int64))


def _visitor(visit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = visit.value.space.d
        for batch in batches:
            for ids, labels, width, m, far in zip(*(batch.column(c).to_pylist() for c in BLOCKS.names), strict=True):
                ids, labels = np.frombuffer(ids, dtype=np.int64), np.frombuffer(labels, dtype=np.int64)
                yield from visit.value.block(ids, labels, _unpacked(width, m, len(ids), d), np.frombuffer(far).reshape(len(ids), -1))

    return run


def _best(blocks: DataFrame, n_blocks: int, anchors: tuple, k: int, same: bool, low: np.ndarray, high: np.ndarray) -> DataFrame:
    """a, j, id, score, rank: the k first of every list, from bands of blocks that grow."""
    spark = blocks.sparkSession
    best = W.partitionBy("a", "j").orderBy(F.desc("score"), "id")
    found, before, share = None, 0.0, min(1.0, FIRST / max(1, n_blocks))
    low = low.copy()
    while before < 1:
        now = min(1.0, before + share)
        place = F.pmod("turn", F.lit(1 << 20)) / float(1 << 20)
        band = blocks.where((place >= before) & (place < now)).drop("turn")
        new = band.mapInArrow(_visitor(spark.sparkContext.broadcast(Visit(*anchors, k, same, low, high))), "a int, j int, id long, score long")
        both = new if found is None else found.unionByName(new)
        ranked = both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        before, share = now, share * BAND
        if before < 1:
            found = cut(ranked.drop("rank"))
            for r in found.groupBy("a", "j").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).collect():  # a slice's lists at most
                low[r["a"], r["j"]] = max(low[r["a"], r["j"]], r["least"])
        else:
            found = cut(ranked)
    return found


def hard_negatives(
    table: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: tuple[int, int] = (80, 100), scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding"
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each anchor and each of its first ``positives`` other rows of the same label: the first ``negatives`` rows of other labels with
    low[0] / low[1] * positive score <= score <= positive score.
    """
    spark = table.sparkSession
    vectors = cut(vectors_of(table, id_col, label_col, vec_col, scale))
    told = vectors.agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max("norm2").alias("longest2")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not told["n"]:
        return spark.createDataFrame([], out)
    space = Space(_pivots(vectors, told["d"]), told["d"], told["longest2"])
    blocks = cut(_blocks(vectors, space, told["n"]))
    n_blocks = blocks.count()
    asked = cut(vectors_of(anchors, id_col, label_col, vec_col, scale))

    def of(n: int):
        return F.pmod(F.xxhash64("number"), F.lit(n))

    slices, most_rows = 1, max(1, SLICE // (8 * (told["d"] + PIVOTS + 2 * positives + 2)))
    while (asked.groupBy(of(slices)).count().agg(F.max("count")).first()[0] or 0) > most_rows:
        slices *= 2
    parts = []
    for i in range(slices):
        rows = asked.where(of(slices) == i).orderBy("id", "number").collect()  # most_rows at most
        if not rows:
            continue
        these = (np.array([r["id"] for r in rows], dtype=np.int64), np.array([r["label"] for r in rows], dtype=np.int64), _matrix([bytes(r["v"]) for r in rows], space.d), space)
        nowhere = np.full((len(rows), 1), -np.inf, dtype=object), np.full((len(rows), 1), np.inf, dtype=object)
        chosen = _best(blocks, n_blocks, these, positives, True, *nowhere)
        least, most = np.full((len(rows), positives), np.inf, dtype=object), np.full((len(rows), positives), -np.inf, dtype=object)
        for r in chosen.select("a", "rank", "score").collect():  # positives of a slice
            p = r["score"]
            least[r["a"], r["rank"] - 1], most[r["a"], r["rank"] - 1] = -(-(low[0] * p) // low[1]), p
        held = _best(blocks, n_blocks, these, negatives, False, least, most)
        ids = spark.createDataFrame([(i, int(r["id"])) for i, r in enumerate(rows)], "a int, anchor_id long")
        pairs = chosen.select("a", (F.col("rank") - 1).alias("j"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        done = held.select("a", "j", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, ["a", "j"]).join(ids, "a")
        parts.append(done.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
        if slices > 1:
            parts[-1] = cut(parts[-1])
    done = spark.createDataFrame([], out)
    for part in parts:
        done = done.unionByName(part)
    return done
