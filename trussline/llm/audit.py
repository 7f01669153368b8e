r"""How filters interact: what every order of them removes, from one pass over the documents.

Five filters judge each document (see `failures`).  A document's outcome is a mask of five bits, and all that
an order of filters does depends on how many documents of a part have which mask: 32 numbers a part.
The subset-zeta transform turns them into survivors: for each set of filters, the documents that pass them all.
A step of an order is then a difference between two neighbouring sets, and so is what it takes from labelled
documents.  So the texts are read once, not once an order.

Filter E (the same text under a smaller doc_id) needs no join of documents with copies: rows are summed by
(text, part, doc_id), then by (text, part), and only sums meet by text.  Texts are known by their SHA-256.
Both sums are combined before they are dealt, so a text or doc_id that holds a third of the rows is no task's work.

Defined cases: a null text is empty and equal to other empty texts; a null lang is the part ""; a null doc_id is
neither smaller nor larger than any, so such a row never fails E and has no label; repeated rows of one doc_id are equals, none
fails E through another; a doc_id with several labels has quality or toxic if any of them has; labels of no document
and null labels count nothing; an empty table gives no rows; other columns of `docs` are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
ALL = SETS - 1
#: Words at least; percent of distinct words at least; percent of capital letters at most.
WORDS, DISTINCT, CAPITALS = 200, 50, 3
_WORD_BREAK = "[ \\t-\\r]+"


def failures(text: Column) -> Column:
    """The mask of filters A to D that a text (not null) fails: bit 0 is A."""
    words = F.filter(F.split(text, _WORD_BREAK), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    fails = (n < WORDS, 100 * distinct < DISTINCT * n, 100 * capitals > CAPITALS * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents, labelled good and labelled toxic documents by (part, mask)."""
    body = F.coalesce(F.col(text), F.lit(""))
    judged = docs.select(F.col(doc_id).alias("_doc"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("_text"), failures(body).alias("_mask"))
    marked = labels.groupBy(F.col("doc_id").alias("_of")).agg(F.max(F.col("quality") == 1).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    told = small(materialize(marked.where("_of is not null and (_good or _toxic)")))
    rows = judged.join(told, F.col("_doc") == F.col("_of"), "left")
    sums = [F.count("*").alias("n"), *(F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c[1:]) for c in ("_good", "_toxic"))]
    names = ["n", "good", "toxic"]
    by_id = rows.groupBy("_text", "_mask", "part", "_doc").agg(*sums)  # one row a doc_id
    held = F.col("_doc").isNotNull()
    by_part = by_id.groupBy("_text", "_mask", "part").agg(
        *(F.sum(c).alias(c) for c in names),
        F.min(F.when(held, F.struct("_doc", *names))).alias("least"),
        *(F.coalesce(F.sum(F.when(~held, F.col(c))), F.lit(0)).alias(f"free_{c}") for c in names),
    )
    first = F.min("least._doc").over(Window.partitionBy("_text"))  # a row a part
    passing = [(F.col(f"free_{c}") + F.when(F.col("least._doc") == F.col("_first"), F.col(f"least.{c}")).otherwise(0)) for c in names]
    shared = by_part.withColumn("_first", first).select("part", "_mask", *names, *(p.alias(f"pass_{c}") for p, c in zip(passing, names, strict=True)))
    e = 1 << FILTERS.index("E")
    rows_of = [F.struct(F.col("_mask").alias("mask"), *(F.col(f"pass_{c}").alias(c) for c in names)), F.struct((F.col("_mask") + e).alias("mask"), *((F.col(c) - F.col(f"pass_{c}")).alias(c) for c in names))]
    both = shared.select("part", F.explode(F.array(*rows_of)).alias("r")).select("part", "r.*").where("n > 0")
    return both.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in names))


def _zeta(counts: Column) -> Column:
    """Sums over all subsets: entry S of the result is the sum of the entries whose mask lies within S."""
    bits = F.array(*(F.lit(1 << i) for i in range(len(FILTERS))))

    def step(sums: Column, bit: Column) -> Column:
        return F.transform(sums, lambda x, s: x + F.when(s.bitwiseAND(bit) != 0, F.get(sums, s - bit)).otherwise(0))

    return F.aggregate(bits, counts, step)


def survivors(counted: DataFrame) -> DataFrame:
    """A row a part: arrays n, good and toxic, whose entry S counts the documents that pass all filters of set S."""
    names = ["n", "good", "toxic"]
    seen = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*names)))).alias("m"))  # 32 entries at most

    def dense(c: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(ALL)), lambda s: F.coalesce(F.element_at("m", s)[c], F.lit(0))).alias(c)

    out = seen.select("part", *map(dense, names))
    out = out.select("part", *(_zeta(F.col(c)).alias(c) for c in names))
    # entry S holds the documents that fail nothing outside S: those that pass the complement
    return out.select("part", *(F.reverse(c).alias(c) for c in names))


def _bit(letter: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), F.ascii(letter) - ord(FILTERS[0]))


def orders(survived: DataFrame) -> DataFrame:
    """One row a part, order and step."""
    every = F.explode(F.array(*(F.lit("".join(p)) for p in permutations(FILTERS))))
    steps = survived.select("part", "n", "good", "toxic", every.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    taken = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda s, k: s + _bit(F.substring(F.col("filter_order"), k, F.lit(1))))
    at = steps.withColumns({"_own": _bit(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))), "_after": taken})
    before = F.col("_after") - F.col("_own")

    def lost(c: str, low: Column = before, high: Column | None = None) -> Column:
        return F.get(c, low) - F.get(c, F.col("_after") if high is None else high)

    # of the orders, so many have just the filters of a set before the one in question
    sizes = [1, 1, 2, 6, 24, 120]
    ways = F.array(*(F.lit(sizes[k] * sizes[len(FILTERS) - 1 - k]) for k in range(len(FILTERS))))
    sets = F.filter(F.sequence(F.lit(0), F.lit(ALL)), lambda s: s.bitwiseAND(F.col("_own")) == 0)
    shapley = F.aggregate(sets, F.lit(0).cast("long"), lambda acc, s: acc + F.get(ways, F.bit_count(s)) * lost("n", s, s + F.col("_own")))
    fails = lost("n", F.lit(0), F.col("_own"))
    return at.select(
        "part",
        "filter_order",
        "step",
        F.get("n", "_after").alias("kept"),
        lost("n").alias("removed"),
        (fails - lost("n")).alias("redundant"),
        lost("n", F.lit(ALL) - F.col("_own"), F.lit(ALL)).alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """All orders of the five filters over `docs`, a row a part, order and step."""
    return orders(survivors(masks(docs, labels, doc_id, text, part)))


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, MAP {
    'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
    'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
    'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false)} AS fails
  FROM d LEFT JOIN l USING (doc_id)),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE NOT contains(filter_order, c)),
s AS (SELECT filter_order, CAST(i AS INT) AS step, filter_order[i] AS own, string_split(filter_order[1:i - 1], '') AS earlier FROM o, range(1, 6) r(i) WHERE length(filter_order) = 5),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
j AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fails_own,
         len(list_filter(earlier, lambda c: c <> '' AND fails[c])) > 0 AS gone, len(list_filter(map_values(fails), lambda v: v)) AS failed
  FROM m, s),
r AS (
  SELECT part, filter_order, step, own, CAST(sum(CASE WHEN NOT gone AND NOT fails_own THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN NOT gone AND fails_own THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN gone AND fails_own THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN fails_own AND failed = 1 THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN NOT gone AND fails_own THEN good ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN NOT gone AND fails_own THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM j GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM r
"""
