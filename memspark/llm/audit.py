r"""Filter interaction audit by lattice edges (operator 13), in DataFrame functions only.

A document fails a subset of the filters. What a filter does to it depends only on the set of filters that ran before, not on their
order, so all orders are paths through the lattice of subsets: 80 edges (already-applied subset, next filter) for five
filters. Documents are counted by part and failed subset, these few counts are summed over the edges, and each of the 600 steps of the
120 orders takes its edge's counts. No document is looked at once for each order, and the Shapley sum weighs an edge by the number of orders that take it.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

FILTERS = "ABCDE"
#: Words that a text must have; the least share of different words, and the largest of capitals, in hundredths; characters that it must not hold.
WORDS, DIFFERENT, CAPITALS, MARKS = 200, 50, 2, "[#$%&*|]"


def own_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text (not null) fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [
        F.size(words) < WORDS,
        F.size(F.array_distinct(words)).cast("long") * 100 < F.size(words).cast("long") * DIFFERENT,
        capitals.cast("long") * 100 > F.char_length(text).cast("long") * CAPITALS,
        text.rlike(MARKS),
    ]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, failed (the bits of all filters failed), good and toxic of each document.

    Texts meet by their SHA-256 to find copies, so only narrow rows are shuffled; copies join one row a text, and a text that a third of
    all rows hold is a skewed join that adaptive execution splits.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = cut(docs.select("doc_id", F.coalesce(docs["source"], F.lit("")).alias("part"), own_failures(text).alias("failed"), F.unhex(F.sha2(text, 256)).alias("digest")), "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    found = rows.join(first, "digest", "left").join(marks, "doc_id", "left")
    copy = F.when(F.col("doc_id") > F.col("first"), 1 << FILTERS.index("E")).otherwise(0)
    return found.select("part", (F.col("failed") + copy).alias("failed"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def edges(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, done (bits of the filters applied before), next (a filter's place) and its counts, of all edges of the lattice.

    counts: part, failed, n, good, toxic; a row for each part and failed subset.
    """
    k = len(filters)
    lattice = F.array(*(F.struct(F.lit(s).alias("done"), F.lit(i).alias("next"), F.lit(factorial(bin(s).count("1")) * factorial(k - 1 - bin(s).count("1"))).alias("orders")) for s in range(1 << k) for i in range(k) if not s >> i & 1))
    met = counts.select("*", F.explode(lattice).alias("edge")).select(*counts.columns, "edge.*")
    bit = F.expr("shiftleft(1, next)")
    before, fails = F.col("failed").bitwiseAND(F.col("done")) != 0, F.col("failed").bitwiseAND(bit) != 0
    here = ~before & fails
    total = lambda which, c="n": F.sum(F.when(which, F.col(c)).otherwise(0))
    return met.groupBy("part", "done", "next", "orders").agg(
        total(~before & ~fails).alias("kept"), total(here).alias("removed"), total(before & fails).alias("redundant"), total(F.col("failed") == bit).alias("unique_fails"),
        total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"),
    )


def paths(edges: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, the counts of the step's edge and shapley, for every order of the filters; edges joins the 600 steps, a table of fixed size."""
    spark = edges.sparkSession
    steps = [("".join(filters[i] for i in p), at + 1, sum(1 << i for i in p[:at]), p[at]) for p in permutations(range(len(filters))) for at in range(len(filters))]
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, done int, next int"))
    weighed = edges.groupBy("part", "next").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    return edges.join(weighed, ["part", "next"]).join(steps, ["done", "next"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (source), order of the filters A to E and step, with its counts of documents as longs.

    Defined results: a null text is empty; a null source is the part of the empty string; a null doc_id is smaller or larger than
    none, so its row is never a failing copy and makes no other one; repeated rows share their doc_id and aren't copies of each other;
    a doc_id with several labels has those that any row gives it, null labels are none, and labels of no document count nowhere; an empty
    table has no parts, so no rows; other columns aren't looked at, whatever their names. Texts of any length are read whole.
    """
    counts = failures(docs, labels).groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return paths(edges(cut(counts, "counts")))


#: The same from the tables themselves, by following each order.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
x(letter) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, letter, n, good, toxic, fails = letter AS alone, contains(fails, letter) AS own,
  length(translate(fails, before, '')) < length(fails) AS gone FROM s, c),
t AS (SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT own THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN NOT gone AND own THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND own THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND own THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN NOT gone AND own THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, cast(step AS INTEGER) AS step, cast(kept AS BIGINT) AS kept, cast(removed AS BIGINT) AS removed, cast(redundant AS BIGINT) AS redundant,
  cast(unique_fails AS BIGINT) AS unique_fails, cast(good_lost AS BIGINT) AS good_lost, cast(toxic_lost AS BIGINT) AS toxic_lost,
  cast(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM t
"""
