"""Exact top-k by inner product over norm-sorted blocks with rotated partial sums (op1).

Vectors are dealt into blocks by descending length.  A rotation from the eigenvectors of their second
moments (a d x d matrix, summed over all vectors) moves most of every length into the first coordinates.
Queries are taken in slices of at most QUERIES vectors and SLICE bytes, which are broadcast one after another; the blocks stay where they lie
and only scores are shuffled.  A slice visits the blocks in bands of growing size, the longest vectors first.  After each band every
query's threshold is the k-th best score so far; by Cauchy-Schwarz a later block whose greatest length times the query's cannot reach it is
passed over, and a slice is done once no query of it can be reached by the next block.  Inside a visited block the partial sum over
the first coordinates plus the product of the residual lengths bounds every score; pairs that may reach the threshold are scored exactly in
integers.  Thresholds only ever drop pairs that cannot be among the k best.  Blocks keep the narrowest integers that hold their components.

Vectors of another dimension than most have, or of a squared length of 2^62 and more, lie in blocks of their own, which all slices visit
without bounds; as queries they are held against all blocks so.  Their products are taken in integers that hold them.

Defined results: vectors that are null, or hold a null or a non-finite component, take no part, neither
as queries nor as candidates.  A vector of fewer components than another counts as zero in the rest, an empty one in all.  A returned score that
doesn't fit a long is an error.  Equal scores go to the
smaller id; repeated rows are candidates each, and a query id that stands on several rows is answered for each of
them.  A candidate with the query's id is its own, whatever its vector.  A null id takes no part.  A query with fewer than k
candidates gets all.  A component whose multiple by the scale leaves the doubles counts as non-finite.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .batches import record
from .hard_negatives import _first, _matrix, _packed, _products, _unpacked
from .shared import cut

CANDIDATES = 4096  # vectors of a block
BYTES = 64 << 20  # of a block, unless one vector has more
QUERIES = 32768  # queries of a slice
SLICE = 16 << 20  # bytes of a slice, unless one vector has more
TOGETHER = 256  # queries that are held against a block at once
HEAD = 16  # rotated coordinates of the partial sum
FIRST = 2  # blocks of the first band
BAND = 4  # each band of blocks is so many times as large as the one before

VECTORS = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("norm2", pa.float64()), ("d", pa.int32())])


def integer_vectors(table: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """id, v (floor(scale * x) as doubles, which hold it exactly), norm2, d; rows that take no part are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, norms, dims = [], [], [], []
            for i, x in zip(batch.column("id").to_pylist(), batch.column("v"), strict=True):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                with np.errstate(over="ignore"):
                    v = np.floor(scale * x.values.to_numpy(zero_copy_only=False).astype(np.float64))
                    norm2 = min(float(v @ v), 1e300)
                if not np.isfinite(v).all():
                    continue
                ids.append(i), rows.append(v.tobytes()), norms.append(norm2), dims.append(len(v))
            yield record(VECTORS, ids, rows, norms, dims)

    return table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).mapInArrow(run, "id long, v binary, norm2 double, d int")


def _moments(vectors: DataFrame, d: int) -> np.ndarray:
    """Sum of the outer products; d x d numbers for each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("v").to_pylist())).reshape(-1, d)
                total += x.T @ x
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]}, schema=pa.schema([("m", pa.binary())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for x in batch.column("m").to_pylist():
                total += np.frombuffer(x).reshape(d, d)
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]}, schema=pa.schema([("m", pa.binary())]))

    got = vectors.select("v").mapInArrow(run, "m binary").coalesce(1).mapInArrow(add, "m binary").collect()
    return np.frombuffer(got[0]["m"]).reshape(d, d) if got else np.zeros((d, d))


BLOCKS = pa.schema([("top", pa.float64()), ("ids", pa.binary()), ("width", pa.int32()), ("d", pa.int32()), ("m", pa.binary())])
BLOCK_TYPE = "top double, ids binary, width int, d int, m binary"


def _blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of vectors by descending length: greatest length, ids, width, dimension (the greatest, the others are filled up with zeros), components; one block at a time in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        widest = 0

        def out() -> pa.RecordBatch:
            ids, rows, norms = zip(*held, strict=True)
            m = _matrix(rows, widest // 8)
            width, raw = _packed(m)
            return record(BLOCKS, [float(np.sqrt(max(norms)))], [np.array(ids, dtype=np.int64).tobytes()], [width], [m.shape[1]], [raw])

        for batch in batches:
            for i, v, norm2 in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "norm2")), strict=True):
                if held and (len(held) == size or (len(held) + 1) * max(widest, len(v)) > BYTES):
                    yield out()
                    held, widest = [], 0
                held.append((i, v, norm2))
                widest = max(widest, len(v))
        if held:
            yield out()

    n = vectors.count()
    dealt = vectors.repartitionByRange(max(1, -(-n // size)), F.desc("norm2"), "id").sortWithinPartitions(F.desc("norm2"), "id").mapInArrow(run, BLOCK_TYPE)
    return dealt.withColumn("block", F.monotonically_increasing_id())


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact products of regular vectors, which fit a long: by floating point where every partial sum is an exact integer, else in integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most < 2.0**53:
        return (q @ v.T).astype(np.int64)
    return q.astype(np.int64) @ v.astype(np.int64).T


def _visit(qid: np.ndarray, q: np.ndarray, tau: np.ndarray, vid: np.ndarray, v: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's number, candidate id, score) of at most k candidates for each query, none below its threshold that could count."""
    rq, rv = q @ rotation, v @ rotation
    head = rq[:, :HEAD] @ rv[:, :HEAD].T
    rest = np.sqrt((rq[:, HEAD:] ** 2).sum(axis=1))[:, None] * np.sqrt((rv[:, HEAD:] ** 2).sum(axis=1))
    slack = 1e-9 * np.sqrt((rq**2).sum(axis=1))[:, None] * np.sqrt((rv**2).sum(axis=1)) + 1e-6  # of rounding
    may = head + rest + slack >= tau[:, None]
    rows, cols = np.flatnonzero(may.any(axis=1)), np.flatnonzero(may.any(axis=0))
    if not len(rows) or not len(cols):
        return (np.zeros(0, dtype=np.int64),) * 3
    if may.sum() * 8 < len(rows) * len(cols):  # few pairs: one by one
        r, c = np.nonzero(may)
        whole = [(q[r[i : i + 65536]].astype(np.int64), v[c[i : i + 65536]].astype(np.int64)) for i in range(0, len(r), 65536)]
        s = np.concatenate([np.einsum("ij,ij->i", a, b) for a, b in whole])
    else:
        s = _scores(q[rows], v[cols])
        hit = may[np.ix_(rows, cols)] & (qid[rows][:, None] != vid[cols])
        if k < s.shape[1]:  # what the block alone has k better ones of
            open_ = np.where(hit, s, np.iinfo(np.int64).min)
            hit &= s >= np.partition(open_, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
        r, c = np.nonzero(hit)
        s, r, c = s[r, c], rows[r], cols[c]
    good = (s >= tau[r]) & (qid[r] != vid[c])
    r, c, s = r[good], c[good], s[good]
    order = np.lexsort((vid[c], -s, r))
    r, c, s = r[order], c[order], s[order]
    first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.zeros(0, dtype=bool)
    rank = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0))
    return r[rank < k], vid[c[rank < k]], s[rank < k]


FOUND = pa.schema([("i", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
LOWEST = -(2**63)  # stands for any score below


class Visit:
    """What a task needs to hold a slice of queries against a block: at most k candidates for each query, none below its threshold that could count."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, rotation: np.ndarray, k: int, tau: np.ndarray):
        self.ids, self.m, self.rotation, self.k, self.tau = ids, m, rotation, k, tau
        with np.errstate(over="ignore"):
            norm = np.sqrt(np.minimum((m**2).sum(axis=1), 1e300))
        need = np.where(norm > 0, tau / np.maximum(norm, 1e-300), np.where(tau > 0, np.inf, -np.inf))
        self.need = need * (1 - 1e-9 * np.sign(need)) - 1e-6  # the length below which no vector can reach a query

    def block(self, top: float, vid: np.ndarray, v: np.ndarray, bounded: bool) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(self.need <= top) if bounded else np.arange(len(self.ids))
        for a in range(0, len(some), TOGETHER):
            part = some[a : a + TOGETHER]
            r, c, s = _visit(self.ids[part], self.m[part], self.tau[part], vid, v, self.rotation, self.k) if bounded else self.plain(part, vid, v)
            yield record(FOUND, part[r].astype(np.int32), c, s)

    def plain(self, part: np.ndarray, vid: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Without bounds: vectors of any dimension and length."""
        d = min(self.m.shape[1], v.shape[1])
        s = _products(self.m[part][:, :d], v[:, :d])
        r, c = np.nonzero((s.astype(np.float64) >= self.tau[part][:, None]) & (self.ids[part][:, None] != vid))
        if s.dtype == object and any(x >= 2**63 for x in s[r, c]):
            raise OverflowError("a score among the best does not fit a long")
        s = np.array([max(x, LOWEST) for x in s[r, c]], dtype=np.int64) if s.dtype == object else s[r, c]
        best = _first(r, vid[c], s.astype(object) if (s == LOWEST).any() else s, self.k)
        return r[best], vid[c[best]], s[best]


def _visitor(visit, bounded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top, ids, width, d, m in zip(*(batch.column(c).to_pylist() for c in BLOCKS.names), strict=True):
                vid = np.frombuffer(ids, dtype=np.int64)
                yield from visit.value.block(top, vid, _unpacked(width, m, len(vid), d), bounded)

    return run


def _slices(asked: DataFrame, number: str = "number") -> Iterator[list]:
    """The queries in slices within QUERIES and SLICE; each reaches the driver alone."""

    def of(n: int):
        return F.pmod(F.xxhash64(number), F.lit(n))

    slices = 1
    while True:
        most = asked.groupBy(of(slices)).agg(F.count("*").alias("n"), F.max(F.length("v")).alias("b")).agg(F.max("n").alias("n"), F.max(F.col("n") * F.col("b")).alias("bytes")).first()
        if (most["n"] or 0) <= 1 or (most["n"] <= QUERIES and most["bytes"] <= SLICE):
            break
        slices *= 2
    for i in range(slices):
        rows = asked.where(of(slices) == i).orderBy("id", number).collect()
        if rows:
            yield rows


def _searched(rows: list, d: int | None, blocks: DataFrame, n_blocks: int, odd: DataFrame, rotation: np.ndarray, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of a slice; d: the dimension of regular queries, None for others, which visit all blocks."""
    spark = blocks.sparkSession
    ids, m = np.array([r["id"] for r in rows], dtype=np.int64), _matrix([bytes(r["v"]) for r in rows], max(r["d"] for r in rows))
    best = W.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    tau = np.full(len(rows), -np.inf)

    def visited(df: DataFrame, bounded: bool) -> DataFrame:
        visit = Visit(ids, m, rotation, k, tau.copy())
        return df.select(*BLOCKS.names).mapInArrow(_visitor(spark.sparkContext.broadcast(visit), bounded), "i int, vec_id long, score long")

    def kept(df: DataFrame) -> DataFrame:
        return cut(df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank"))  # limited before the shuffle too

    found = kept(visited(odd if d is not None else odd.unionByName(blocks.drop("place")), False))
    start, size = 0, FIRST
    while d is not None and start < n_blocks:
        for r in found.groupBy("i").agg(F.count("*").alias("n"), F.min("score").alias("score")).where(F.col("n") >= k).collect():  # a slice's queries
            tau[r["i"]] = r["score"]
        longest = blocks.where(F.col("place") == start).select("top").first()["top"]
        if not (Visit(ids, m, rotation, k, tau).need <= longest).any():
            break
        found = kept(found.unionByName(visited(blocks.where((F.col("place") >= start) & (F.col("place") < start + size)), True)))
        start, size = start + size, size * BAND
    names = spark.createDataFrame([(i, int(r["id"])) for i, r in enumerate(rows)], "i int, query_id long")
    ranked = found.withColumn("rank", F.row_number().over(best)).join(names, "i")
    score = F.when(F.col("score") > F.lit(LOWEST), F.col("score")).otherwise(F.raise_error(F.lit("a score among the best does not fit a long")).cast("long"))
    return ranked.select("query_id", "rank", "vec_id", score.alias("score"))


def top_k(table: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest integer products of each query with every row but its own id."""
    spark = table.sparkSession
    vectors = cut(integer_vectors(table, id_col, vec_col, scale))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    common = vectors.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return out
    d = common["d"]
    regular = (F.col("d") == d) & (F.col("norm2") < 2.0**62)
    rotation = np.ascontiguousarray(np.linalg.eigh(_moments(vectors.where(regular), d))[1][:, ::-1]) if d else np.zeros((0, 0))
    asked = cut(integer_vectors(queries, id_col, vec_col, scale).withColumn("number", F.monotonically_increasing_id()))
    # Numbers of blocks by descending length: a row for each block of CANDIDATES vectors.
    vs = cut(_blocks(vectors.where(regular), CANDIDATES))
    places = vs.select("block", (F.row_number().over(W.orderBy(F.desc("top"), "block")) - 1).alias("place"))
    blocks = cut(vs.join(places, "block").drop("block"))
    n_blocks = blocks.count()
    odd = cut(_blocks(vectors.where(~regular), CANDIDATES).drop("block"))
    for dimension, some in ((d, asked.where(regular)), (None, asked.where(~regular))):
        for rows in _slices(some):
            got = _searched(rows, dimension, blocks, n_blocks, odd, rotation, k)
            out = out.unionByName(got if len(rows) < QUERIES // 2 else cut(got))
    return out
