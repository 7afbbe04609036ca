"""Line dedup by an exact set-similarity join (op10): DataFrame functions only.

A line is the set of its words, named by a hash of 64 bits; a second hash, made of other hashes of the words, tells sets that share a name, and all but
one of them get another.  A line goes when an earlier one, by (id, line number), has a Jaccard
similarity of at least the threshold.  Lines of equal sets are one node.  A node's words are put in order of
rarity; the prefix that any similar set must meet goes into an equi-join on words, whose condition is the
length filter, the shorter prefix of the smaller set, the positional filter, and a lower bound of the
symmetric difference from parity sketches of 128 bits.  A word's rarity is the count of its bucket over all
lines, a table of fixed size: it orders words, and any order gives the same pairs.

The join is a semi-join: it keeps the entries that have some partner, at most as many rows as go in, however
large a group is.  A line needs one earlier match only, so partners are tried in rounds: first the earliest
node of each of its words, the nearest by sketch; nodes that a round resolves leave it, and each word's next node
leads the next round.  What ROUNDS rounds leave is held against all its earlier partners.  Partners are
verified on whole sets of words, read again from the lines.

Defined results: a line without a word stays; a null text has no lines and stays null; repeated rows (same id)
are ordered by line number alone, of their equal lines none is later than itself, so they are treated alike; a
null id's lines are neither removed nor do they remove others; equal positions aren't earlier than one another;
texts and lines are taken whole; an empty table gives no rows; other columns pass through ``dedup`` untouched.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, drop

WORD = r"[^\\x20\\x09-\\x0D]"  # a character of a word, as in a SQL string
BUCKETS = 1 << 18  # of the table of word counts: a byte each
CHUNK = 1 << 12  # bytes of a table that a row holds on its way to the driver
MARKS = 1 << 18  # bytes of the table of document ids
HASH_BITS = 55  # of a word, below its rank
SEED = 7  # of the words' other hashes
ROUNDS = 2


def _plain(text: Column) -> Column:
    """The text with a blank for every other separator of words but the line feed."""
    for c in "\t\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _bytes(values: DataFrame, size: int) -> bytes:
    """The values (b, v), 0 <= v < 128, as a byte for each b below size; 0 where there is none. A row for CHUNK bytes reaches the driver."""
    zeros = values.sparkSession.range(size).selectExpr("cast(id as int) b", "0 v")
    full = values.select("b", "v").unionByName(zeros).groupBy("b").agg(F.max("v").alias("v"))
    chunks = full.groupBy(F.expr(f"b div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("b", "v"))).alias("x"))
    rows = chunks.select("chunk", F.expr("array_join(transform(x, e -> char(e.v)), '')").alias("v")).collect()
    return "".join(r["v"] for r in sorted(rows, key=lambda r: r["chunk"])).encode("ascii")


def _byte(table: bytes, at: Column) -> Column:
    return F.ascii(F.substring(F.lit(bytearray(table)), at + 1, F.lit(1)).cast("string"))


def _marks(ids: DataFrame) -> bytes:
    """Bits of the ids' hashes, seven in a byte: which documents may be among them."""
    at = ids.select(_mark(F.col("doc_id")).alias("h")).select((F.col("h") / 7).cast("int").alias("b"), (F.col("h") % 7).cast("int").alias("bit"))
    return _bytes(at.groupBy("b").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("v")), MARKS)


def _mark(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(7 * MARKS))


def _marked(doc_id: Column, marks: bytes) -> Column:
    h = _mark(doc_id)
    return F.getbit(_byte(marks, (h / 7).cast("int")), (h % 7).cast("int")) == 1


def _rarity(docs: DataFrame) -> bytes:
    """A byte for each bucket of words, greater for more frequent ones."""
    words = docs.select(F.explode(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ", -1)).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("b")).agg(F.count("*").alias("n"))
    rank = F.least(F.round(4 * F.log2(1 + F.col("n"))), F.lit(127)).cast("int")
    return _bytes(counts.select("b", rank.alias("v")), BUCKETS)


def _ranked(words: Column, table: bytes) -> Column:
    """The line's different words, rarest first, as numbers: rank, then hash."""

    def number(h: Column) -> Column:
        rank = _byte(table, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(rank.cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << HASH_BITS) - 1)))

    different = F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return F.sort_array(F.transform(different, number))


def _check(words: Column) -> Column:
    """A second name of the line's set, from other hashes of its words: words that share the 55 bits of the first share these 64 with a probability of 2^-64."""
    other = lambda w: F.xxhash64(F.lit(SEED), w)
    return F.xxhash64(F.sort_array(F.array_remove(F.array_distinct(F.transform(words, other)), other(F.lit("")))))


def _lines(docs: DataFrame, table: bytes, p: int, q: int, min_words: int) -> DataFrame:
    """doc_id, line_no, sid (name of the set), c (its second name), n (its size), s0, s1 (sketch), prefix: a row for each line with so many different words."""
    lines = docs.select("doc_id", F.posexplode(F.split(_plain(F.col("text")), "\n", -1)).alias("line_no", "line"))
    words = F.split("line", " ", -1)
    ranked = lines.select("doc_id", "line_no", _ranked(words, table).alias("r"), _check(words).alias("c"))
    # A generator instead of a filter, which would be pushed below and rank the line twice.
    some = ranked.selectExpr("doc_id", "line_no", "c", f"explode(if(size(r) >= {max(1, min_words)}, array(r), array())) r")
    side = "aggregate(r, 0L, (a, x) -> a ^ shiftleft({}, cast(x & 63 as int)))"
    made = some.selectExpr(
        "doc_id",
        "line_no",
        "xxhash64(r) sid",
        "c",
        "size(r) n",
        side.format("1L") + " s",
        side.format("shiftright(x, 6) & 1") + " s0",
        # Similar sets share one of the first n - ceil(t n) + 1 words.
        f"transform(slice(r, 1, size(r) - cast((size(r) * {p}L + {q - 1}) div {q} as int) + 1), e -> cast(e & 2147483647 as int)) prefix",
    )
    return made.selectExpr("doc_id", "line_no", "sid", "c", "n", "s0", "s ^ s0 s1", "prefix")


def _close(p: int, q: int) -> str:
    """Whether the sets of sides a and b may be similar, by size and sketch: similar sets differ in (q - p) / (q + p) of their words together at most."""
    return f"a.n * {q}L >= b.n * {p}L and b.n * {q}L >= a.n * {p}L and ({DISTANCE}) * {p + q}L <= (a.n + b.n) * {q - p}L"


DISTANCE = "bit_count(a.s0 ^ b.s0) + bit_count(a.s1 ^ b.s1)"


def _meets(p: int, q: int) -> str:
    """Whether the sets may first meet at this word: ``brief`` marks the shorter prefix, k words of which come before."""
    return f"if(a.n <= b.n, a.brief, b.brief) and least(a.n - a.k, b.n - b.k) >= ((a.n + b.n) * {p}L + {p + q - 1}) div {p + q}"


class _Verifier:
    """Holds whole sets of words of the nodes that have partners."""

    def __init__(self, docs: DataFrame, at: DataFrame, p: int, q: int):
        self.p, self.q = p, q
        self.named = named = cut(at.select("at.*", "sid", "c"))
        # Lines of documents that may be named: bits of fixed number tell most of the others, so their texts are not moved.
        marks = _marks(named.select("doc_id").distinct())
        lines = docs.where(_marked(F.col("doc_id"), marks)).select("doc_id", F.posexplode(F.split(_plain(F.col("text")), "\n", -1)).alias("line_no", "line"))
        lines = lines.join(named, ["doc_id", "line_no"]).select("sid", "c", F.split("line", " ", -1).alias("words")).withColumn("name", _check(F.col("words")))
        # An id may stand for several texts: the line must have the set's name. A generator instead of a filter, which would become a key
        # of the join and be worked out for all lines.
        lines = lines.select("sid", F.explode(F.expr("if(name = c, array(words), array())")).alias("words"))
        self.sets = cut(lines.select("sid", F.array_remove(F.array_distinct("words"), "").alias("words")).dropDuplicates(["sid"]))

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (x, y) whose sets are similar."""
        of = lambda c: self.sets.select(F.col("sid").alias(c), F.col("words").alias(f"w{c}"))
        both = pairs.join(of("x"), "x").join(of("y"), "y").withColumn("c", F.size(F.array_intersect("wx", "wy")))
        return both.where(f"c * {self.q}L >= (size(wx) + size(wy) - c) * {self.p}L").select("x", "y")


def _resolved(entries: DataFrame, verifier: _Verifier, p: int, q: int) -> DataFrame:
    """sid of the nodes that an earlier node is similar to. entries: word, sid, n, k, brief, s0, s1, at."""
    done, pool = None, entries
    seen = None  # pairs that were verified

    def left(df: DataFrame) -> DataFrame:
        return df if done is None else df.join(done, "sid", "left_anti")

    for _ in range(ROUNDS):
        first = pool.groupBy("word").agg(F.min(F.struct("at", "sid", "n", "s0", "s1")).alias("b"))
        tried = left(entries).alias("a").join(first, "word").where(f"{_close(p, q)} and b.at < a.at and a.sid <> b.sid")
        best = cut(tried.select(F.col("a.sid").alias("x"), F.struct(F.expr(DISTANCE).alias("d"), F.col("b.sid").alias("y")).alias("b")).groupBy("x").agg(F.min("b").alias("b")).select("x", "b.y"))
        seen = best if seen is None else seen.unionByName(best)
        found = cut(verifier.similar(best).select(F.col("x").alias("sid")))
        if found.isEmpty():
            break
        done = found if done is None else cut(done.unionByName(found))
        pool = pool.join(first.select("word", "b.sid"), ["word", "sid"], "left_anti")
    a, b = left(entries).alias("a"), entries.alias("b")
    rest = a.join(b, F.expr(f"a.word = b.word and {_close(p, q)} and b.at < a.at and a.sid <> b.sid and {_meets(p, q)}"))
    rest = rest.select(F.col("a.sid").alias("x"), F.col("b.sid").alias("y")).distinct().join(seen, ["x", "y"], "left_anti")
    found = verifier.similar(rest).select(F.col("x").alias("sid")).distinct()
    return cut(found if done is None else done.unionByName(found))


def _position() -> Column:
    return F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")


def _named(made: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines whose sets have names of their own, and of sets on several lines the first position: at.

    A position is one number, so that a set's lines are reduced where they are read: a line that a third of all documents share is one row
    for each of their partitions. The same pass finds sets that share a name.
    """
    while True:
        sets = made.groupBy("sid").agg(F.min(_position()).alias("at"), F.count("*").alias("lines"), F.min("c").alias("low"), F.max("c").alias("high"))
        several = cut(sets.where("lines > 1").drop("lines"))
        twice = several.where("low <> high").select("sid", "low")
        if twice.isEmpty():
            return made, several
        other = F.when(F.col("c") != F.col("low"), F.xxhash64("sid", "c")).otherwise(F.col("sid"))
        made = cut(made.join(twice, "sid", "left").withColumn("sid", other).select(*made.columns))


def earliest(docs: DataFrame, similarity: Fraction = Fraction(3, 4), min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no of every line to remove; lines of fewer than min_words different words are left alone."""
    p, q = similarity.numerator, similarity.denominator
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("doc_id is not null")
    table = _rarity(docs)
    made, several = _named(cut(_lines(docs, table, p, q, min_words)))
    nodes = made.groupBy("sid").agg(*(F.min(c).alias(c) for c in ("n", "s0", "s1", "prefix")))
    words = nodes.select("sid", "n", "s0", "s1", F.posexplode("prefix").alias("k", "word"))
    # Of two similar sets the smaller one has a common word among even fewer of its first.
    words = words.withColumn("brief", F.expr(f"k <= n - (n * {2 * p}L + {p + q - 1}) div {p + q}"))
    met = F.expr(f"a.word = b.word and {_close(p, q)} and a.sid <> b.sid and {_meets(p, q)}")
    near = cut(words.alias("a").join(words.alias("b"), met, "left_semi"))
    placed = made.select("doc_id", "line_no", "sid", "c")
    at = cut(placed.join(near.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "line_no")).alias("at"), F.min("c").alias("c")))
    verifier = _Verifier(docs, at, p, q)
    entries = cut(near.join(at.drop("c"), "sid"))
    drop(near)
    done = _resolved(entries, verifier, p, q).withColumn("gone", F.lit(True))
    drop(entries, at, verifier.named, verifier.sets)
    # Of a set that no earlier one is similar to, the first line stays.
    start = cut(several.select("sid", "at").join(done, "sid", "full").select("sid", "at", "gone"))
    return placed.join(start, "sid").where((_position() > F.col("at")) | F.col("gone")).select("doc_id", "line_no").distinct()


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, removed: the numbers of the lines to remove, in order, of documents that have any."""
    gone = earliest(docs, id_col=id_col, text_col=text_col, **options)
    return gone.groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("removed"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, n_lines, n_removed, removed: a row for each document."""
    gone = removals(docs, id_col, text_col, **options)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.size(F.split(F.col(f"`{text_col}`").cast("string"), "\n", -1)), F.lit(0)).cast("long").alias("n_lines"))
    rows = rows.join(gone, "doc_id", "left").withColumn("removed", F.coalesce("removed", F.expr("cast(array() as array<int>)")))
    return rows.select("doc_id", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", drop_emptied: bool = False, **options) -> DataFrame:
    """docs without the removed lines; columns as before. drop_emptied: a document that loses lines and has no word left goes."""
    gone = removals(docs, id_col, text_col, **options).select(F.col("doc_id").alias("__doc"), F.col("removed").alias("__gone"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__r"), F.col(f"`{id_col}`").cast("long").alias("__id")).join(gone, F.col("__id") == F.col("__doc"), "left")
    rows = rows.withColumn("__gone", F.coalesce("__gone", F.expr("cast(array() as array<int>)")))
    text = F.expr(f"if(size(__gone) = 0, __r.`{text_col}`, array_join(filter(split(__r.`{text_col}`, '\\n', -1), (l, i) -> not array_contains(__gone, i)), '\\n'))")
    if drop_emptied:  # a generator instead of a filter, which would cut the text twice
        rows = rows.select("__r", F.size("__gone").alias("__n"), text.alias("__t")).select("__r", F.explode(F.expr(f"if(__n > 0 and not rlike(__t, '{WORD}'), array(), array(__t))")).alias("__t"))
        text = F.col("__t")
    return rows.select(*[text.alias(c) if c == text_col else F.col("__r").getField(c).alias(c) for c in docs.columns])
