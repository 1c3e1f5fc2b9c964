"""Removal of repeated and nearly repeated lines by an exact set-similarity join, in DataFrame operations alone.

A line is the set of its lower-cased words. Lines with the same set are one class, which its first line stands for
(by doc_id, then place). The words of a set are ordered by rarity, counted over all lines. A step is a word with the word
before it in that order (none before the first). A word that only one of two sets has parts at most one step of those they
share, so sets with a Jaccard similarity of `threshold` or more share a step among their rarest, the prefix, and these steps
are the join keys. (A threshold of 0.5 or less may leave no shared step; then single words are the keys.) What meets passes a
filter on lengths, one on positions, which bound the overlap that is still possible, and one on parities: 64 bits of which each
word flips one cannot differ in more places than the sets differ in words. What is left is verified on all words, and a line
goes if it matches an earlier one.

Of each key the rows are counted, with their lengths and parities, which settles keys of one or two rows before anything is
sorted. Up to `crowd` classes are paired. Larger groups are compared with their first class, which settles what matches it, and
what is left of them with all their classes.
"""

from __future__ import annotations

import gc
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spreadloom.llm.common import documents, drop, is_empty, save

THRESHOLD, CROWD = 0.8, 256
#: Hash buckets in which words are counted for their rarity; the bits of a word's hash that follow its rank; the finest
#: step of a rank, as a part of a doubling.
BUCKETS, BITS, STEP = 1 << 18, 53, 16
#: Bits that are left off words in keys: what is left fits 31 bits. Equal words stay equal; others that get alike are verified.
SHORT = 31
#: Parts of the keys that are shuffled one after another, so that disk holds one of them.
SHARES = 3
#: Words of 64 bits in the filter that spares lines nobody asks for.
MASK = 1 << 16
#: Place of rows without a doc_id: after all others.
LAST = (1 << 63) - 1
SET, PLACE = ["k1", "k2"], ["doc", "no", "row"]


def lines_of(docs: DataFrame) -> DataFrame:
    """row, doc, no, line of every line; rows without a doc_id come last; null text is one empty line."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"), text.alias("text")).select("row", "doc", F.posexplode(F.split("text", "\n")).alias("no", "line"))


def words_of(text: Column) -> Column:
    """Lower-cased words of a text, with empty strings where white space repeats."""
    # a split at one plain character is the quickest, and few lines have other white space
    odd = reduce(or_, [F.contains(text, F.lit(space)) for space in "\t\n\x0b\f\r"])
    return F.split(F.lower(F.when(odd, F.regexp_replace(text, "[\t\n\x0b\f\r]", " ")).otherwise(text)), " ")


def table(df: DataFrame, place: Column, value: Column, size: int) -> Column:
    """A literal array of `size` numbers (0 where no row has the place) from the aggregated rows of `df`."""
    whole = df.sparkSession.range(size).select(F.col("id").cast("long").alias("p"))
    rows = whole.join(df.select(place.cast("long").alias("p"), value.alias("v")), "p", "left").select("p", F.coalesce("v", F.lit(0)).alias("v"))
    numbers = rows.agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("v")).select(F.to_json(F.transform("v", lambda x: x["v"])))
    return F.from_json(F.lit(numbers.first()[0]), "array<bigint>")


def rank_of(count: Column) -> Column:
    return F.least(F.lit(511), F.floor(STEP * F.log2(count + 1))).cast("long")


def rarity(docs: DataFrame) -> Column:
    """The rank of each bucket of words, rarest lowest, by their occurrences in `docs`: a literal of `BUCKETS` small numbers."""
    words = lines_of(docs).select(F.explode(words_of(F.col("line"))).alias("w")).where("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).agg(F.count("*").alias("n"))
    return table(counts, F.col("bucket"), rank_of(F.col("n")), BUCKETS)


def coded(text: Column, ranks: Column) -> Column:
    """The distinct words of a text as numbers in order of rarity: rank, then 53 bits of the hash."""
    rank = lambda h: F.shiftleft(F.get(ranks, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), BITS)
    hashes = F.transform(F.array_remove(words_of(text), ""), lambda w: F.xxhash64(w))
    return F.sort_array(F.array_distinct(F.transform(hashes, lambda h: rank(h).bitwiseOR(F.shiftrightunsigned(h, 64 - BITS)))))


def with_sets(lines: DataFrame, ranks: Column) -> DataFrame:
    """`lines` (as `lines_of`) with words (the set of each, coded) and k1, k2 (its hashes, null without words) for the line itself."""
    some = F.size("words") > 0
    sets = lines.select(*PLACE, coded(F.col("line"), ranks).alias("words"))
    return sets.withColumns({"k1": F.when(some, F.xxhash64("words")), "k2": F.when(some, F.xxhash64(F.lit(2), "words"))})


def parities(words: Column) -> Column:
    """64 bits of which each word flips one."""
    flip = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, w: bits.bitwiseXOR(flip(w)))


def by_steps(threshold: float) -> bool:
    """Whether similar sets always share a step."""
    return threshold > 0.5


def prefix(words: Column, threshold: float) -> Column:
    """The rarest words, shortened, at which any similar set has a key of its own prefix too.

    Sets of n and m words that share o have at least o - (n + m - 2 * o) steps in common, where o is at least
    threshold / (1 + threshold) * (n + m) and m at least threshold * n.
    """
    n = F.size(words)
    shared = F.ceil(threshold * n - 1e-9)
    if by_steps(threshold):
        shared = F.ceil((2 * threshold - 1) / (1 + threshold) * (n + shared) - 1e-6)
    return F.transform(F.slice(words, F.lit(1), F.least(n, n - shared.cast("int") + 1)), lambda w: F.shiftright(w, SHORT).cast("int"))


def similar_enough(n: Column, m: Column, apart: Column, threshold: float) -> Column:
    """Filters by length and by differing parities for sets of n and m words."""
    return (F.least(n, m) + 1e-9 >= threshold * F.greatest(n, m)) & (apart <= n + m - 2 * threshold / (1 + threshold) * (n + m) + 1e-6)


def possible(threshold: float) -> Column:
    """Filters by length, position and parities for rows of two sets: x_at, y_at (words * 2**32 + place), x_bits, y_bits."""
    low = F.lit((1 << 32) - 1)
    n, m = F.shiftright("x_at", 32), F.shiftright("y_at", 32)
    i, j = F.col("x_at").bitwiseAND(low), F.col("y_at").bitwiseAND(low)
    overlap = F.least(i, j) + F.least(n - i, m - j)
    return similar_enough(n, m, F.bit_count(F.col("x_bits").bitwiseXOR(F.col("y_bits"))), threshold) & (overlap + 1e-9 >= threshold / (1 + threshold) * (n + m))


def shared_keys(firsts: DataFrame, threshold: float, share: int) -> DataFrame:
    """key, k1, at, bits, c: the rows of keys that more than one class has, with their number, of one of `SHARES` of the keys.
    Keys of two classes whose lengths or parities tell them apart are left out."""
    rows = firsts.select("k1", "n", "bits", "rarest", F.posexplode("rarest").alias("i", "w"))
    key = F.col("w").cast("long")
    if by_steps(threshold):
        key = key.bitwiseOR(F.shiftleft(F.coalesce(F.get("rarest", F.col("i") - 1), F.lit(0)).cast("long"), SHORT))
    rows = rows.where(F.pmod("w", F.lit(SHARES)) == share).select(key.alias("key"), "k1", (F.shiftleft("n", 32) + F.col("i")).alias("at"), "bits")
    all_of = Window.partitionBy("key")
    rows = rows.withColumns({"c": F.count("*").over(all_of), "low": F.min("at").over(all_of), "high": F.max("at").over(all_of), "apart": F.bit_xor("bits").over(all_of)})
    two = similar_enough(F.shiftright("low", 32), F.shiftright("high", 32), F.bit_count("apart"), threshold)
    return rows.where((F.col("c") > 2) | ((F.col("c") == 2) & two)).drop("low", "high", "apart")


def met(one: DataFrame, two: DataFrame, threshold: float, order: Column, once: Column | None = None) -> DataFrame:
    """Pairs x1, y1 (of k1) of sets of `one` and `two` (key, k1, at, bits) on one key that pass the filters and `order`, by which
    a pair stands one way round. `once` holds at one of the keys that a pair shares."""
    x = one.select("key", *[F.col(c).alias("x_" + c) for c in one.columns if c != "key"])
    y = two.select("key", *[F.col(c).alias("y_" + c) for c in two.columns if c != "key"])
    out = x.join(y, "key").where(order & (possible(threshold) if once is None else possible(threshold) & once))
    return out.select(F.col("x_k1").alias("x1"), F.col("y_k1").alias("y1")).distinct()


def asked_sets(docs: DataFrame, ranks: Column, classes: DataFrame, asked: DataFrame) -> DataFrame:
    """k1, k2, words of the classes in `asked` (k1), read once more from the first line of each; a repeated row repeats them."""
    places = classes.join(asked, "k1").select("first.*")
    slot = F.xxhash64("doc", "no")
    bit = F.shiftrightunsigned(slot, 42).bitwiseAND(F.lit(63)).cast("int")
    marks = places.groupBy(F.shiftrightunsigned(slot, 48).alias("p")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("v"))
    mask = table(marks, F.col("p"), F.col("v"), MASK)
    hit = F.call_function("shiftright", F.get(mask, F.shiftrightunsigned(slot, 48).cast("int")), bit).bitwiseAND(F.lit(1)) == 1
    # a few lines more than asked for may come; what joins the sets by k1 passes over them
    return save(with_sets(lines_of(docs).where(hit), ranks).select(*SET, "words"), "sets")


def matching(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """x1, x2, y1, y2 of those of `pairs` whose sets have the similarity."""
    one = sets.select(F.col("k1").alias("x1"), F.col("k2").alias("x2"), F.col("words").alias("xw"))
    two = sets.select(F.col("k1").alias("y1"), F.col("k2").alias("y2"), F.col("words").alias("yw"))
    both = F.size(F.array_intersect("xw", "yw"))
    close = both + 1e-9 >= threshold * (F.size("xw") + F.size("yw") - both)
    return pairs.join(one, "x1").join(two, "y1").where(close).select("x1", "x2", "y1", "y2")


def sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("x1", "y1")).alias("k1"))


def release(*saved: DataFrame) -> None:
    """Delete what `save` has written, and have Spark delete the shuffle files of finished steps: it does so when the driver
    collects garbage, which by itself may come after the query."""
    drop(*saved)
    gc.collect()
    SparkSession.active()._jvm.System.gc()


def removed_classes(docs: DataFrame, ranks: Column, firsts: DataFrame, classes: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """k1, k2 of the classes that match an earlier one; `firsts` (k1, n, bits, rarest of each class) is deleted on the way."""
    made, crowds, settled = [], [], None
    for share in range(SHARES):
        rest = save(shared_keys(firsts, threshold, share), "keys")
        few = rest.where(F.col("c") <= crowd).drop("c")
        made.append(save(met(few, few, threshold, F.col("x_k1") < F.col("y_k1")), "pairs"))
        crowds.append(save(rest.where(F.col("c") > crowd).drop("c").join(classes, "k1"), "crowds"))
        release(rest)
    release(firsts)
    still = reduce(DataFrame.union, crowds)
    if not is_empty(still):
        heads = save(still.groupBy("key").agg(F.min(F.struct("first", *SET, "at", "bits")).alias("h")).select("key", "h.*"), "heads")
        earlier = F.col("x_first") < F.col("y_first")
        leads = save(met(heads, still, threshold, earlier), "leads")
        sets = asked_sets(docs, ranks, classes, sides(leads).distinct())
        settled = save(matching(leads, sets, threshold).select(F.col("y1").alias("k1"), F.col("y2").alias("k2")).distinct(), "settled")
        # two classes meet at the least of the crowded keys that both have, not at each
        still = still.withColumn("keys", F.collect_set("key").over(Window.partitionBy("k1")))
        still = save(still.withColumn("before", F.filter("keys", lambda k: k < F.col("key"))).drop("keys"), "crowds")
        once = ~F.arrays_overlap("x_before", "y_before")
        made.append(save(met(still, still.join(settled, SET, "left_anti"), threshold, earlier, once), "pairs"))
    every = save(reduce(DataFrame.union, made).distinct(), "pairs")
    release(*made)
    sets = asked_sets(docs, ranks, classes, sides(every).distinct())
    known = save(matching(every, sets, threshold), "known")
    release(every, sets)
    for side in "xy":
        known = known.join(classes.select(F.col("k1").alias(side + "1"), F.col("k2").alias(side + "2"), F.col("first").alias(side + "f")), [side + "1", side + "2"])
    later = F.when(F.col("xf") < F.col("yf"), F.struct(F.col("y1").alias("k1"), F.col("y2").alias("k2"))).otherwise(F.struct(F.col("x1").alias("k1"), F.col("x2").alias("k2")))
    gone = known.select(later.alias("k")).select("k.*")
    return (gone.union(settled) if settled is not None else gone).distinct()


def line_removals(docs: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """One row per row of `docs`: row (a number), doc_id, n_lines, n_removed, removed (places, from 0, in order).

    Words are what white space parts, in lower case; a line without words never goes, and null text is one such
    line. Rows without a doc_id come after all others, and rows that share a doc_id in any order, so of repeated
    rows one keeps its lines. No rows give no rows; columns other than doc_id and text are not looked at.
    """
    ranks = rarity(docs)
    sets = with_sets(lines_of(docs), ranks)
    wide = save(sets.select(*PLACE, *SET, F.size("words").cast("long").alias("n"), parities(F.col("words")).alias("bits"), prefix(F.col("words"), threshold).alias("rarest")), "wide")
    lines, first = save(wide.select(*PLACE, *SET), "lines"), F.struct(*PLACE)
    classes = save(lines.where("k1 is not null").groupBy(*SET).agg(F.min(first).alias("first")), "classes")
    firsts = save(wide.join(classes.select(*SET, "first.*"), [*SET, *PLACE]).select("k1", "n", "bits", "rarest"), "firsts")
    release(wide)
    gone = removed_classes(docs, ranks, firsts, classes, threshold, crowd).withColumn("gone", F.lit(True))
    fate = save(classes.join(gone, SET, "left").select(*SET, "first", "gone"), "fate")
    out = lines.select("row", "doc", "no", *SET).join(fate, SET, "left")
    goes = F.coalesce((first != F.col("first")) | F.coalesce("gone", F.lit(False)), F.lit(False))
    out = out.groupBy("row", "doc").agg(F.count("*").alias("n_lines"), F.count_if(goes).alias("n_removed"), F.array_sort(F.collect_list(F.when(goes, F.col("no")))).alias("removed"))
    return out.select("row", F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"), "n_lines", "n_removed", "removed")


def without_lines(text: Column, removed: Column) -> Column:
    """`text` without the lines at the places in `removed`."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed, i)), "\n")


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_removals(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


OP5_SQL = r"""
WITH l AS (
  SELECT doc_id, n - 1 AS no, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(ls[n]), '\s+'), lambda w: w <> ''))) AS ws
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), c AS (
  SELECT ws, min((doc_id, no)) AS first, row_number() OVER (ORDER BY min((doc_id, no))) AS c, len(ws) AS n FROM l WHERE len(ws) > 0 GROUP BY ws
), t AS (SELECT c, n, unnest(ws) AS w FROM c
), d AS (
  SELECT DISTINCT b.c FROM t a JOIN t b ON a.w = b.w AND a.c < b.c AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9
  GROUP BY a.c, b.c, a.n, b.n HAVING count(*) + 1e-9 >= 0.8 * (a.n + b.n - count(*))
), r AS (
  SELECT l.doc_id, l.no, coalesce((l.doc_id, l.no) <> c.first OR d.c IS NOT NULL, false) AS goes
  FROM l LEFT JOIN c ON l.ws = c.ws LEFT JOIN d ON c.c = d.c
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_removed,
       coalesce(string_agg(no::VARCHAR, ',' ORDER BY no) FILTER (goes), '') AS removed
FROM r GROUP BY doc_id
"""
