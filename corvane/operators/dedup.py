"""Exact and fuzzy removal of repeated texts within a scope.

Exact: of equal texts the first stays. Fuzzy: items are visited in order, and one goes if its word set
has a Jaccard similarity of `threshold` or more to an earlier one that stayed. Candidate pairs come
from a prefix-filtered join on rare words, so all pairs of a scope are never made; the order-dependent
choice among them is a fixpoint over the pairs alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.functions.text import jaccard, word_set
from corvane.sources.shared import released, written

SHORTEST = 20
THRESHOLD = 0.95


def exact_flags(items: DataFrame, scope: list[str], order: list[str], text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """items with `first`: of equal texts in a scope the first in order (a total one), every text under
    `shortest`, and null texts. The first is an aggregate, and joined back by its order as well, so a text
    that a third of all rows share is no hot group."""
    own = items.withColumn("__hash", F.md5(text_col))
    names = [f"__o{k}" for k in range(len(order))]
    least = own.filter(F.length(text_col) >= shortest).groupBy(*scope, "__hash").agg(F.min(F.struct(*order)).alias("__least"))
    least = least.select(*(F.col(c).alias(f"__s{k}") for k, c in enumerate(scope)), F.col("__hash").alias("__text"), *(F.col(f"__least.{c}").alias(n) for c, n in zip(order, names, strict=True)))
    same = F.col("__hash") == F.col("__text")
    for k, c in enumerate(scope):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{k}"))
    for c, n in zip(order, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    first = F.coalesce(F.length(text_col) < shortest, F.lit(True)) | F.col("__text").isNotNull()
    return own.join(least, same, "left").select(*items.columns, first.alias("first"))


#: Groups of more than one row in so many are joined by a broadcast of their heads: at most so many.
HOT_GROUPS = 1000


def joined_to_heads(rows: DataFrame, heads: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined to heads (one row a key, with `copies`, its number of rows) of `total` rows. The heads
    of the large groups are broadcast, so their rows stay where they are; all others are shuffled."""
    large = F.col("copies") > max(1, total // HOT_GROUPS)
    hot = F.broadcast(heads.filter(large).drop("copies"))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(heads.filter(~large).drop("copies"), keys)
    return rows.join(hot, keys).unionByName(cold)


#: Words are counted under so many digests; the counts go to all tasks.
COUNTED = 1 << 20
#: Words that are ordered at once in a task.
AT_ONCE = 1 << 20
#: Bytes of word sets that travel with candidate pairs at once, about; more pairs are verified in rounds.
VERIFIED_AT_ONCE = 1 << 30


def _rarity(own: DataFrame) -> np.ndarray:
    """How many items hold words of each of COUNTED digests: no less than the items of any word of it."""
    counts = own.select(F.explode("words").alias("word")).groupBy(F.pmod("word", F.lit(COUNTED)).alias("at")).agg(F.count(F.lit(1)).alias("n")).toPandas()  # COUNTED rows at most
    out = np.zeros(COUNTED, np.int64)
    out[counts["at"].to_numpy()] = counts["n"].to_numpy()
    return out


def _prefixes(classes: DataFrame, rarity: np.ndarray, threshold: float, scope: list[str]) -> DataFrame:
    """scope, id, n, at, word: the first words of each class by rarity, then digest."""
    sent = classes.sparkSession.sparkContext.broadcast(rarity)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = np.asarray(batch.column(batch.num_columns - 1).offsets)[:-1]
            starts = np.flatnonzero(np.diff((before - before[:1]) // AT_ONCE, prepend=-1))
            for s, e in zip(starts, np.append(starts[1:], batch.num_rows), strict=False):
                yield ordered(batch.slice(s, e - s))

    def ordered(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, ends = np.asarray(batch.column(batch.num_columns - 1).flatten()), np.asarray(batch.column(batch.num_columns - 1).offsets)
        ends, n = ends - ends[0], np.diff(ends)
        item = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((words, sent.value[words % COUNTED], item))
        at = np.arange(len(words)) - np.repeat(ends[:-1], n) + 1
        first = at <= np.repeat(n - np.ceil(np.round(n * threshold, 9)) + 1, n)
        # without the words themselves: a row for each word of a prefix would hold the whole set again
        rows = batch.select(range(batch.num_columns - 1)).take(pa.array(item[first]))
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(at[first]), pa.array(words[order][first])], names=[*scope, "id", "n", "at", "word"])

    kinds = dict(classes.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*scope, "id", "n"]) + ", at long, word long"
    return classes.select(*scope, "id", "n", "words").mapInArrow(run, schema)


def _verified(pairs: DataFrame, classes: DataFrame, scope: list[str], threshold: float, k: int, rounds: int) -> DataFrame:
    """scope, a, b, similarity of the candidates of round k that reach the threshold."""
    turn = lambda name: F.pmod(F.xxhash64(name), F.lit(rounds)) == k
    left = classes.filter(turn("id")).select(*scope, F.col("id").alias("a"), F.col("words").alias("wa"))
    right = classes.select(*scope, F.col("id").alias("b"), F.col("words").alias("wb"))
    full = pairs.filter(turn("a")).select(*scope, "a", "b").join(left, [*scope, "a"]).join(right, [*scope, "b"])
    return full.select(*scope, "a", "b", jaccard(F.col("wa"), F.col("wb")).alias("similarity")).filter(F.col("similarity") >= threshold - 1e-12)


def similar_pairs(items: DataFrame, threshold: float = THRESHOLD, scope: list[str] | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """scope columns, a, b (a < b), similarity, copy of every pair at or over the threshold with a word in it.

    Two sets that similar share a word among the size - ceil(threshold * size) + 1 first of each in any
    order of words, and their sizes differ by the same factor. The order: rarest first, by counts of COUNTED digests
    of words, which is one order for all items and needs no join of words with their counts. Words are joined
    within classes of sizes that can match, and a pair leaves the join only if what follows the word in both leaves
    room for the similarity. Words are known by 64-bit digests throughout.
    Items of one word set are one class in the join, and come back as pairs with the class' smallest id,
    and pairs between classes' smallest ids. A candidate takes the set of one class to that of the other, in rounds
    whose shuffled sets are gone before the next, so the disk holds VERIFIED_AT_ONCE of them and all sets once.
    """
    spark, scope = items.sparkSession, scope or []
    digests = F.sort_array(F.transform(word_set(F.col(text_col)), lambda w: F.xxhash64(w)))
    sets = written(spark, items.select(*scope, F.col(id_col).alias("id"), digests.alias("words")), "word-sets")
    own = sets.filter(F.size("words") > 0)
    own = own.withColumn("key", F.concat_ws("-", F.xxhash64("words"), F.hash("words"), F.size("words")))
    classes = own.groupBy(*scope, "key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("words").alias("words"))
    classes = written(spark, classes.withColumn("n", F.size("words")), "word-classes")
    members = written(spark, own.select(*scope, "key", "id"), "class-members")
    total = members.count()
    prefix = written(spark, _prefixes(classes, _rarity(own), threshold, scope), "word-prefixes")
    released(spark, sets)
    # sizes that can match are in one class of sizes or in neighbours
    size = F.floor(F.log("n") / F.lit(-float(np.log(threshold)) * (1 + 1e-9))).cast("int") if threshold < 1 else F.col("n")
    near = F.sequence(size - 1, size + 1) if threshold < 1 else F.array(size)
    left = prefix.select(*scope, "word", size.alias("size"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"))
    right = prefix.select(*scope, "word", F.explode(near).alias("size"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    fits = (F.col("a") < F.col("b")) & (F.col("na") >= F.round(F.col("nb") * threshold, 9)) & (F.col("nb") >= F.round(F.col("na") * threshold, 9))
    # a word in common at places pa and pb, if it is the first one, leaves room for so many in common
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) + 1
    wide = room >= F.round((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)), 9)
    pairs = written(spark, left.join(right, [*scope, "word", "size"]).filter(fits & wide).select(*scope, "a", "b", "na").distinct(), "word-pairs")
    released(spark, prefix)
    rounds = max(1, -(-(pairs.agg(F.sum(F.col("na").cast("long") * 8)).first()[0] or 0) // VERIFIED_AT_ONCE))
    tables = [written(spark, _verified(pairs, classes, scope, threshold, k, rounds), "near-pairs") for k in range(rounds)]
    near = spark.read.schema(tables[0].schema).parquet(*(x._written_at for x in tables)).withColumn("copy", F.lit(False))
    released(spark, pairs)
    heads = classes.filter("copies > 1").select(*scope, "key", F.col("id").alias("a"), "copies")
    same = joined_to_heads(members, heads, [*scope, "key"], total).filter(F.col("id") != F.col("a")).select(*scope, "a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"), F.lit(True).alias("copy"))
    return near.unionByName(same)


def greedy_kept(pairs: DataFrame, ids: DataFrame, checkpoint) -> DataFrame:
    """ids (column id) that stay: a fixpoint in which an item with no undecided earlier neighbour is
    decided. Rounds are as many as the longest chain of earlier neighbours. A copy never stays: what
    drops the first of its class, or that one itself, is earlier and as similar to it.

    checkpoint: DataFrame -> DataFrame, cuts the lineage of a round (into the shared folder).
    """
    dropped = pairs.filter("copy").select(F.col("b").alias("id")).distinct()
    live = checkpoint(pairs.filter("not copy").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while live.limit(1).count():
        # a stays if nothing earlier can drop it: it is no later end of a live edge
        sure = live.select("a").distinct().join(live.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = checkpoint(live.join(sure, "a").select(F.col("b").alias("id")).distinct())
        dropped = checkpoint(dropped.unionByName(gone).distinct())
        live = checkpoint(live.join(sure, "a", "left_anti").join(gone.select(F.col("id").alias("a")), "a", "left_anti").join(gone.select(F.col("id").alias("b")), "b", "left_anti").select("a", "b"))
    return ids.join(dropped, "id", "left_anti")


def deduplicated(items: DataFrame, exact_scope: list[str], fuzzy_scope: list[str], order: list[str], checkpoint, threshold: float = THRESHOLD, shortest: int = SHORTEST, fits: bool = False) -> DataFrame:
    """items (id, text, scope and order columns) that stay after both stages; short texts bypass them.
    fits: whether every scope of both stages is known to fit into a task (a document, a page)."""
    if fits:
        nth = F.row_number().over(W.partitionBy(*exact_scope, "__hash").orderBy(*order))
        flagged = items.withColumn("__hash", F.md5("text")).withColumn("__nth", nth).filter(_short(shortest) | (F.col("__nth") == 1)).drop("__hash", "__nth")
    else:
        flagged = exact_flags(items, exact_scope, order, shortest=shortest).filter("first").drop("first")
    return fuzzy_deduplicated(flagged, fuzzy_scope, order, checkpoint, threshold, shortest, fits)


def _short(shortest: int) -> Column:
    return F.coalesce(F.length("text") < shortest, F.lit(True))


def fuzzy_deduplicated(flagged: DataFrame, fuzzy_scope: list[str], order: list[str], checkpoint, threshold: float = THRESHOLD, shortest: int = SHORTEST, fits: bool = False) -> DataFrame:
    """The second stage alone: what is similar to nothing earlier that stays; short texts bypass it. Where scopes are
    known to fit into a task, rows are sorted into their scopes once, and nothing else is shuffled or written."""
    if fits:
        return _kept_in_scopes(flagged, fuzzy_scope, order, threshold, shortest)
    long = flagged.filter(~_short(shortest))
    numbered = long.withColumn("n", F.row_number().over(W.partitionBy(*fuzzy_scope).orderBy(*order)))
    key = F.concat_ws("\x1f", *(F.col(c).cast("string") for c in fuzzy_scope), F.lpad(F.col("n").cast("string"), 12, "0"))
    keyed = checkpoint(numbered.withColumn("key", key))
    pairs = checkpoint(similar_pairs(keyed.select(*fuzzy_scope, F.col("key").alias("id"), "text"), threshold, fuzzy_scope))
    kept = greedy_kept(pairs, keyed.select(F.col("key").alias("id")), checkpoint).withColumnRenamed("id", "key")
    return flagged.filter(_short(shortest)).unionByName(keyed.join(kept, "key", "left_semi").select(*flagged.columns))


def _kept_in_scopes(flagged: DataFrame, scope: list[str], order: list[str], threshold: float, shortest: int) -> DataFrame:
    """The rows that stay, many scopes at a time. Rows come from the window scope by scope, in order."""
    digests = F.sort_array(F.transform(word_set(F.col("text")), lambda w: F.xxhash64(w)))
    own = flagged.withColumn("__words", F.when(~_short(shortest), digests)).withColumn("__key", F.xxhash64("__words")).withColumn("__other", F.hash("__words"))
    own = own.withColumn("__n", F.row_number().over(W.partitionBy(*scope).orderBy(*order)))
    names, helpers = flagged.columns, ["__n", "__key", "__other", "__words"]

    def kept(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        if rows.num_rows:
            n, key, other, words = (rows[c].chunk(0) for c in helpers)
            stays = _greedy(np.cumsum(np.asarray(n) == 1), np.asarray(key), np.asarray(other), words, threshold)
            yield from rows.select(names).filter(pa.array(stays)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of a scope that isn't at its end
        for batch in batches:
            starts = np.flatnonzero(np.asarray(batch.column("__n")) == 1)
            if len(starts):
                if held or starts[-1]:
                    yield from kept([*held, batch.slice(0, starts[-1])])
                held, batch = [], batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from kept(held)

    return own.select(*names, *helpers).mapInArrow(run, flagged.schema)


def _greedy(scope: np.ndarray, key: np.ndarray, other: np.ndarray, words: pa.ListArray, threshold: float) -> np.ndarray:
    """Whether each row stays, rows being in order: of equal word sets of a scope the first can, and it does unless it is
    similar to an earlier one that stays. Candidates share a word among the first of each, rarest first."""
    bounds = np.asarray(words.offsets)
    flat, n = np.asarray(words.flatten()), np.diff(bounds)
    n[np.asarray(words.is_null())] = 0
    starts, rows = np.cumsum(n) - n, np.arange(len(n))
    by = np.lexsort((rows, n, other, key, scope))
    first = np.ones(len(n), bool)
    first[by[1:]] = np.any([x[by[1:]] != x[by[:-1]] for x in (scope, key, other, n)], axis=0)
    stays = first | (n == 0)
    item = np.repeat(rows, n)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((flat, count[place], item))
    at = np.arange(len(flat)) - np.repeat(starts, n)
    prefix = (at < np.repeat(n - np.ceil(np.round(n * threshold, 9)) + 1, n)) & np.repeat(first, n)
    # words of prefixes, equal ones of a scope side by side
    order, item, at = order[prefix], item[prefix], at[prefix]
    by = np.lexsort((item, place[order], scope[item]))
    word, item, at = place[order][by], item[by], at[by]
    left, pairs = np.arange(len(by)), []
    for d in range(1, len(by)):
        left = left[left + d < len(by)]
        left = left[(word[left] == word[left + d]) & (scope[item[left]] == scope[item[left + d]])]
        if not len(left):
            break
        a, b, room = item[left], item[left + d], np.minimum(n[item[left]] - at[left], n[item[left + d]] - at[left + d])
        fits = (n[a] >= np.round(n[b] * threshold, 9)) & (n[b] >= np.round(n[a] * threshold, 9)) & (room >= np.round((n[a] + n[b]) * (threshold / (1 + threshold)), 9))
        pairs.append(np.unique(b[fits] * len(n) + a[fits]))
    found = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)])).astype(np.int64)
    b, a = found // len(n), found % len(n)
    size = n[a] + n[b]
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // AT_ONCE, prepend=-1))
    near = np.zeros(len(found), bool)
    for s, e in zip(cuts, np.append(cuts[1:], len(found)), strict=False):
        both = _in_common(flat, starts, n, a[s:e], b[s:e])
        near[s:e] = both / (size[s:e] - both) >= threshold - 1e-12
    for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
        if stays[x]:
            stays[y] = False
    return stays


def _in_common(flat: np.ndarray, starts: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words the rows of each pair share; no row holds a word twice."""
    ends, sizes = np.concatenate([a, b]), np.concatenate([n[a], n[b]])
    pair = np.repeat(np.tile(np.arange(len(a)), 2), sizes)
    word = flat[np.repeat(starts[ends], sizes) + np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    by = np.lexsort((word, pair))
    pair, word = pair[by], word[by]
    return np.bincount(pair[1:][(word[1:] == word[:-1]) & (pair[1:] == pair[:-1])], minlength=len(a))


def near(a: Column, b: Column) -> Column:
    return jaccard(word_set(a), word_set(b))
