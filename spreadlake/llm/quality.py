"""Line-first quality rules (op4): DataFrame functions only, no shuffle.

Rules look at one line at a time and remove it when it fails:

* punctuation: a tenth of its characters or more are symbols ``#*$%&|<>``, or it has three ``!!``;
* navigation: two bars or more part it, or it holds two web addresses or more;
* boilerplate: it holds a phrase of the list below.

A document is rejected when base rules fail (fewer than 10 words; more than a fifth of its words in
5-word windows that occur twice) or when the removed lines hold more than half of its word characters.

Defined results: a null text has no words, so it fails the base rules and has an empty cleaned text; lines
without a word neither fail nor count, and stay; texts are taken whole; repeated rows are answered one by
one; a null id stays; an empty table gives no rows; other columns pass through ``clean`` untouched, also
those whose names clash with the verdict's, which come in one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fresh

# Phrases of lines that belong to a site, not to its text.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "licensed under", "general public license", "click here", "subscribe to our", "sign in to", "log in to", "enable javascript",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "hier klicken", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "cliquez ici", "abonnez-vous",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "haga clic aquí", "suscríbete",
)

WORD = r"[^\\x20\\x09-\\x0D]+"
SPACE = r"[\\x20\\x09-\\x0D]+"
MIN_WORDS, REPEAT_PERCENT, LOST_PERCENT, WIDTH = 10, 20, 50, 5


def verdicts(docs: DataFrame, text_col: str = "text", out: str = "q") -> DataFrame:
    """Adds a struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, cleaned."""
    names = [c for c in docs.columns if c.lower() != out.lower()]
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    row = row.selectExpr("r", f"regexp_extract_all(t, '{WORD}', 0) w", r"split(t, '\n', -1) lines", r"split(lower(t), '\n', -1) low")
    phrases = " or ".join(f"contains(get(low, i), '{p}')" for p in BOILERPLATE)
    window = ", ".join(f"get(w, i + {k})" if k else "get(w, i)" for k in range(WIDTH))
    row = row.selectExpr(
        "r",
        "lines",
        "cast(size(w) as long) n_words",
        f"if(size(w) < {WIDTH}, cast(array() as array<bigint>), transform(sequence(0, size(w) - {WIDTH}), i -> xxhash64({window}))) h",
        f"""transform(lines, (l, i) -> named_struct(
              'chars', length(regexp_replace(l, '{SPACE}', '')),
              'symbols', length(l) - length(regexp_replace(l, '[#*$%&|<>]', '')),
              'bars', length(l) - length(replace(l, '|', '')),
              'bangs', length(l) - length(replace(l, '!!', '!')),
              'links', length(l) - length(replace(l, '://', ':/')),
              'phrase', {phrases})) facts""",
    )
    row = row.selectExpr(
        "r",
        "lines",
        "n_words",
        "facts",
        "transform(facts, f -> f.chars > 0 and (f.phrase or f.bars >= 2 or f.links >= 2 or f.bangs >= 3 or 10 * f.symbols >= f.chars)) fails",
        "if(size(array_distinct(h)) < size(h), array_sort(transform(h, (x, i) -> named_struct('h', x, 'i', i))), null) s",
    )
    row = row.selectExpr(
        "r",
        "lines",
        "n_words",
        "facts",
        "fails",
        "if(s is null, null, array_sort(transform(filter(s, (e, j) -> get(s, j - 1).h = e.h or get(s, j + 1).h = e.h), e -> e.i))) again",
    )
    total = "aggregate(facts, 0L, (a, f) -> a + f.{0})"
    worded = "filter(lines, (l, i) -> get(facts, i).chars > 0)"
    row = row.selectExpr(
        "r",
        "n_words",
        f"{total.format('chars')} word_chars",
        f"{total.format('symbols')} n_symbols",
        f"cast(size({worded}) - size(array_distinct({worded})) as long) n_dup_lines",
        f"""if(again is null, 0L, aggregate(again, named_struct('p', -{WIDTH}, 'n', 0L),
              (a, p) -> named_struct('p', p, 'n', a.n + least({WIDTH}, p - a.p)), a -> a.n)) n_repeat_words""",
        "aggregate(arrays_zip(facts, fails), 0L, (a, z) -> a + if(z.fails, z.facts.chars, 0)) lost_chars",
        "array_join(filter(lines, (l, i) -> not get(fails, i)), '\n') cleaned",
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    row = row.withColumn("base_failed", base)
    row = row.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= LOST_PERCENT * F.col("word_chars")))
    verdict = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "cleaned").alias(out)
    return row.select("r", verdict).select(*[F.col("r").getField(c).alias(c) for c in names], out)


def clean(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The kept documents, their failed lines removed; columns as before."""
    q = fresh(docs.columns, "q")
    judged = verdicts(docs, text_col, q)
    # A generator instead of a filter, which would be pushed below the rules and evaluate them again.
    kept = judged.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), F.explode(F.expr(f"if(`{q}`.kept, array(`{q}`.cleaned), array())")).alias("t"))
    return kept.select(*[F.col("t").alias(c) if c == text_col else F.col("r").getField(c).alias(c) for c in docs.columns])


ORACLE = """
with base as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from base),
win as (select doc_id, i, list_slice(w, i, i + 4) as x from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)),
dup as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, x) as n from win) where n > 1),
cov as (select doc_id, cast(sum(least(5, i - p)) as bigint) as n from (select doc_id, i, lag(i, 1, -5) over (partition by doc_id order by i) as p from dup) group by doc_id),
ln as (select doc_id, unnest(string_split(t, chr(10))) as l from base),
fact as (select doc_id, l, length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) as chars,
  length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g')) as symbols, length(l) - length(replace(l, '|', '')) as bars, length(l) - length(replace(l, '!!', '!')) as bangs, length(l) - length(replace(l, '://', ':/')) as links,
  (PHRASES) as phrase from ln),
sums as (select doc_id, cast(sum(chars) as bigint) as word_chars, cast(sum(symbols) as bigint) as n_symbols,
  cast(count(case when chars > 0 then 1 end) - count(distinct case when chars > 0 then l end) as bigint) as n_dup_lines,
  cast(sum(case when chars > 0 and (phrase or bars >= 2 or links >= 2 or bangs >= 3 or 10 * symbols >= chars) then chars else 0 end) as bigint) as lost_chars from fact group by doc_id),
r as (select w.doc_id, cast(len(w.w) as bigint) as n_words, word_chars, n_symbols, n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, lost_chars from w join sums using (doc_id) left join cov using (doc_id))
select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost_chars <= 50 * word_chars as kept from r
""".replace("PHRASES", " or ".join(f"contains(lower(l), '{p}')" for p in BOILERPLATE))
