"""7. SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most 2 of 64 bits are linked. A fingerprint is cut into 2 segments of
32 bits, so that one segment of a linked pair differs by at most one bit. For each segment and each of
its bits the segment with that bit deleted is indexed; equal entries are joined and the pair's distance
is verified. Only distinct fingerprints are indexed: copies of a text cost one.

An entry under which more than MAX_BUCKET distinct fingerprints lie isn't compared pair by pair: its
members go into a second index, of whole fingerprints with at most one bit flipped. Two fingerprints
differ in at most 2 bits just if they share such a value, and no value has more than 65 members, so
rows stay in proportion and no link is lost.

With a Jaccard threshold (the pipeline's stage; op7 has none) texts whose sets of five-word shingles are
that similar are linked too. Such texts may differ in many bits, so candidates come from min-hashes:
BANDS keys of ROWS min-hashes each, of which a pair at 0.8 shares one with probability 0.99998. What
links is the exact similarity. Texts under a key are first compared with the next one in an order of the
key's own. Of texts that share a key with one of another component the private shingles are counted,
those that none of the others has, and each text is compared with the key's leader, the one with fewest of
them. So each text has shingles that the leader has, shingles that others but not the leader have, and
private ones; the smaller number of the first kind and of the second bound what two texts have in common.
At last all pairs under a key are compared that are still in different components and may reach the
threshold by that bound. So no link is left out, and a large group of near copies costs pairs only for
texts that could link and have not.

Components come from alternating star contractions; each round's edges are a table in the shared
folder. Defined results: a text without words (null, empty) has fingerprint 0 and is linked like any
other; rows of a null doc_id get the component of their fingerprint (null if no row of it has an id).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from corvane.llm.common import GROUP_ROWS, batches_of, joined_by_group, lower_words_of, narrow, released, rows_of, written

SEED = 42
SHINGLE = 3
BITS, DISTANCE, SEGMENTS = 64, 2, 2
SEGMENT_BITS = BITS // SEGMENTS
MAX_BUCKET = 32
# Of the links by Jaccard similarity.
WIDTH, BANDS, ROWS = 5, 28, 5
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS + WIDTH, np.uint64) * np.uint64(2) + np.uint64(1)
PERMUTE, PLACES = _ODD[: BANDS * ROWS, None], _ODD[BANDS * ROWS :]


def fingerprint(text: str | None) -> int:
    """Unsigned. A bit is set if over half of the shingles' hashes have it."""
    words = lower_words_of(text)
    if not words:
        return 0
    digest, n = xxhash.xxh64_intdigest, max(1, len(words) - SHINGLE + 1)
    if len(words) < SHINGLE:
        return digest(b" ".join(words), SEED)
    hashes = np.fromiter((digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:])), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):  # bounded memory for giant texts
        counts += np.unpackbits(hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), key (of the text)."""

    def run(batches):
        rows = ((doc_id, signed(fingerprint(text)), key) for doc_id, text, key in rows_of(batches))
        return batches_of(rows, pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("key", pa.int64())]))

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, key long")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return narrow(docs, doc_id=f"{id_col}:long", text=f"{text_col}:string").withColumn("key", F.xxhash64("text"))


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the WIDTH-word shingles; a shorter text with words is one shingle."""
    words = lower_words_of(text)
    own = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(words)}
    h = np.fromiter(map(own.__getitem__, words), np.uint64, len(words))
    n = min(len(h), WIDTH)
    total = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for k in range(n):
        total += h[k : k + len(total)] * PLACES[k]
    return np.unique(mixed(total))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS signed longs, of ROWS min-hashes each; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(hashes), 4096):  # bounded memory for giant texts
        least = np.minimum(least, (PERMUTE * hashes[k : k + 4096]).min(axis=1))
    bands = (mixed(least).reshape(BANDS, ROWS) * PLACES[:ROWS]).sum(axis=1, dtype=np.uint64)
    return mixed(bands + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As fingerprints(), with key (of the text), size (of its shingle set) and its band keys."""

    def run(batches):
        def rows():
            for doc_id, text, key in rows_of(batches):
                hashes = shingle_set(text)
                yield doc_id, signed(fingerprint(text)), key, len(hashes), band_keys(hashes)

        return batches_of(rows(), pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("key", pa.int64()), ("size", pa.int64()), ("bands", pa.list_(pa.int64()))]))

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long, key long, size long, bands array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """x, y (structs of key, fp, size, ...) of the pairs, with how many shingles are in common."""
    spark = pairs.sparkSession

    def run(batches):
        def rows():
            for kx, ky, left, right in rows_of(batches):
                left, right = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                yield kx, ky, len(np.intersect1d(left, right, assume_unique=True))

        return batches_of(rows(), pa.schema([("kx", pa.int64()), ("ky", pa.int64()), ("common", pa.int64())]))

    pairs = written(spark, pairs, "shingle-pairs")
    own = pairs.select(F.col("x.key").alias("kx"), F.col("y.key").alias("ky")).distinct()
    own = own.join(sets.select(F.col("key").alias("kx"), F.col("hashes").alias("left")), "kx").join(sets.select(F.col("key").alias("ky"), F.col("hashes").alias("right")), "ky")
    found = own.select("kx", "ky", "left", "right").mapInArrow(run, "kx long, ky long, common long")
    return pairs.join(found, (pairs["x.key"] == found["kx"]) & (pairs["y.key"] == found["ky"])).drop("kx", "ky")


def similar(found: DataFrame, jaccard: float) -> DataFrame:
    """Edges (a, b) between fingerprints of the pairs that reach jaccard."""
    near = found.filter(f"x.fp <> y.fp and common >= {jaccard} * (x.size + y.size - common)")
    return near.select(F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")).distinct()


def jaccard_links(docs: DataFrame, prints: DataFrame, edges: DataFrame, jaccard: float, text_col: str = "text") -> DataFrame:
    """edges and those (a, b) between fingerprints of texts at or over jaccard, whose components are those
    of all such links. prints: signatures(docs); edges: other links between fingerprints."""
    spark = docs.sparkSession
    texts = prints.groupBy("key").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    index = texts.select(F.explode("bands").alias("entry"), F.struct("key", "fp", "size").alias("x"))
    sizes = index.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = written(spark, sizes.withColumn("parts", F.ceil(F.col("n") / GROUP_ROWS)), "shingle-sizes")
    index = joined_by_group(index, sizes, "entry", BANDS * prints.count())
    # neighbours within parts of a large entry: what they miss is found below like any other pair
    place = F.xxhash64("entry", "x.key")
    order = W.partitionBy("entry", "part").orderBy("place", "x.key")
    index = index.select("entry", "x", place.alias("place"), F.pmod(place, F.col("parts")).alias("part")).select("entry", "x", F.lead("x").over(order).alias("y"))
    index = written(spark, index, "shingle-entries")
    fits = f"x.fp <> y.fp and least(x.size, y.size) >= {jaccard} * greatest(x.size, y.size)"

    def in_order(pairs: DataFrame) -> DataFrame:
        swap = F.expr("x.key > y.key")
        return pairs.filter(fits).select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y")).distinct()

    def hashed(batches):
        return batches_of(((key, shingle_set(text).tobytes()) for key, text in rows_of(batches)), pa.schema([("key", pa.int64()), ("hashes", pa.binary())]))

    own = narrow(docs, text=f"{text_col}:string").select(F.xxhash64("text").alias("key"), "text")
    own = own.join(index.select("x.key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    sets = written(spark, own.mapInArrow(hashed, "key long, hashes binary"), "shingle-sets")
    tried = in_order(index.filter("y is not null").select("x", "y"))
    edges = written(spark, edges.unionByName(similar(overlaps(tried, sets), jaccard)).distinct(), "shingle-links")

    def apart(entries: DataFrame, edges: DataFrame) -> DataFrame:
        """Entries with the component c of each text, where a key joins more than one."""
        named = entries.withColumn("node", F.col("x.fp")).join(components(edges), "node", "left").select(*entries.columns, F.coalesce("component", "node").alias("c"))
        named = written(spark, named, "shingle-named")
        several = named.groupBy("entry").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most").drop("least", "most")
        return written(spark, joined_by_group(named, several, "entry", named.count()), "shingle-apart")

    def each_shingle(batches):
        for batch in batches:
            for key, hashes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = np.frombuffer(hashes, np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key)), pa.array(h.view(np.int64))], names=["key", "h"])

    parted = apart(index.select("entry", "x"), edges)
    shingles = sets.join(parted.select("x.key").distinct(), "key", "left_semi").mapInArrow(each_shingle, "key long, h long")
    private = shingles.groupBy("h").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("texts")).filter("texts = 1").groupBy("key").agg(F.count(F.lit(1)).alias("own"))
    bounded = parted.join(private, parted["x.key"] == private["key"], "left").select("entry", "x", F.coalesce("own", F.lit(0)).alias("own"))
    bounded = written(spark, bounded, "shingle-bounds")
    least = bounded.groupBy("entry").agg(F.min_by("x", F.struct("own", "x.key")).alias("y"), F.count(F.lit(1)).alias("n"))
    led = written(spark, joined_by_group(bounded, least, "entry", bounded.count()), "shingle-led")
    common = written(spark, overlaps(led.filter("x.key <> y.key").select("x", "y").distinct(), sets), "shingle-overlaps")
    edges = written(spark, edges.unionByName(similar(common, jaccard)).distinct(), "shingle-links")
    with_leader = common.select(F.col("x.key").alias("kx"), F.col("y.key").alias("ky"), "common")
    led = led.join(with_leader, (led["x.key"] == with_leader["kx"]) & (led["y.key"] == with_leader["ky"]), "left").select(
        "entry", F.struct("x.key", "x.fp", "x.size", F.coalesce("common", "x.size").alias("led"), F.when(F.col("common").isNull(), 0).otherwise(F.expr("x.size - common - own")).alias("other")).alias("x")
    )
    left = apart(led, edges)
    share = jaccard / (1 + jaccard)
    # a text that not even the shortest under its key can match goes before pairs are made
    sizes = left.groupBy("entry").agg(F.min("x.size").alias("shortest"), F.count(F.lit(1)).alias("n"))
    left = joined_by_group(left, sizes, "entry", left.count()).filter(f"x.led + x.other >= {share} * (x.size + greatest(shortest, x.led + x.other)) - 1e-6").drop("shortest")
    left = written(spark, left, "shingle-left")
    reach = f"least(x.led, y.led) + least(x.other, y.other) >= {share} * (x.size + y.size) - 1e-6"
    rest = in_order(left.join(left.select("entry", F.col("x").alias("y"), F.col("c").alias("d")), "entry").filter("c < d").filter(reach).select("x", "y"))
    return edges.unionByName(similar(overlaps(rest, sets), jaccard)).distinct()


def links(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b), a < b, between distinct fingerprints (column fp), whose components are those of all
    links: every link under small entries, a star for each value of the second index."""
    spark = prints.sparkSession
    distinct = prints.select("fp").distinct()
    low = (1 << SEGMENT_BITS) - 1
    entries = [
        F.shiftleft(F.lit(s * SEGMENT_BITS + i).cast("long"), SEGMENT_BITS).bitwiseOR(F.shiftrightunsigned("fp", s * SEGMENT_BITS).bitwiseAND(F.lit(low & ~(1 << i)).cast("long")))
        for s in range(SEGMENTS)
        for i in range(SEGMENT_BITS)
    ]
    distinct = written(spark, distinct, "simhash-distinct")
    total = 2 * SEGMENT_BITS * distinct.count()
    # a fingerprint is short and has 64 entries, so they are dealt before they are made
    index = distinct.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).select("fp", F.explode(F.array(*entries)).alias("entry"))
    sizes = written(spark, index.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "simhash-sizes")
    counted = written(spark, joined_by_group(index, sizes.withColumn("of", F.col("n")), "entry", total, shuffled=True).withColumnRenamed("of", "n"), "simhash-entries")
    near = F.expr(f"flatten(transform(fps, a -> transform(filter(fps, b -> b > a and bit_count(a ^ b) <= {DISTANCE}), b -> struct(a as a, b as b))))")
    small = counted.filter(F.col("n") <= max_bucket).groupBy("entry").agg(F.collect_list("fp").alias("fps")).select(F.explode(near).alias("e")).select("e.a", "e.b")
    flipped = F.expr(f"concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))")
    large = counted.filter(F.col("n") > max_bucket).select("fp").distinct().select("fp", F.explode(flipped).alias("entry"))
    star = large.groupBy("entry").agg(F.min("fp").alias("a")).join(large, "entry").filter("a <> fp").select("a", F.col("fp").alias("b"))
    return small.unionByName(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) can reach."""
    spark = edges.sparkSession
    edges = written(spark, edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    one = F.count(F.lit(1)).alias("n")

    def large_star(e: DataFrame, total: int) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))  # a: the centre
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"), one)
        return joined_by_group(both.filter("b > a"), least, "a", total).select(F.col("m").alias("a"), "b").filter("a <> b").distinct()

    def small_star(e: DataFrame, total: int) -> DataFrame:
        least = e.groupBy("b").agg(F.min("a").alias("m"), one)  # b: the centre, larger than its a
        moved = joined_by_group(e, least, "b", total).filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return moved.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()

    before = None
    while (now := state(edges)) != before:
        before = now
        if now[0]:
            old, edges = edges, written(spark, small_star(large_star(edges, now[0]), now[0]), "edges")
            released(spark, old)
    return edges.groupBy("b").agg(F.min("a").alias("component")).withColumnRenamed("b", "node")


def _named(docs: DataFrame, id_col: str, text_col: str, max_bucket: int, jaccard: float | None) -> tuple[DataFrame, DataFrame]:
    """The rows' prints (doc_id, fp, key), and (fp, component, n) of each fingerprint, n being its rows."""
    spark = docs.sparkSession
    prints = written(spark, (fingerprints if jaccard is None else signatures)(docs, id_col, text_col), "fingerprints")
    edges = links(prints, max_bucket)
    if jaccard is not None:
        edges = jaccard_links(docs, prints, edges, jaccard, text_col)
    nodes = components(edges)
    firsts = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    named = firsts.join(nodes, firsts["fp"] == nodes["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"), "n")
    return prints, written(spark, named, "simhash-named")  # it is read several times


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bucket: int = MAX_BUCKET, jaccard: float | None = None) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every row. jaccard: links texts of
    at least this five-word similarity too."""
    prints, named = _named(docs, id_col, text_col, max_bucket, jaccard)
    total = prints.count()
    # a component is named by a fingerprint; its smallest doc_id names it in the result
    of = joined_by_group(prints.select("doc_id", "fp"), named, "fp", total)
    least = of.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    out = joined_by_group(of, least, "component", total)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", jaccard: float | None = None) -> DataFrame:
    """docs with one row of each component, under all its columns: that of its smallest doc_id, nulls last,
    and of one id that of the smallest text digest. Rows that repeat an id and a text are one row, that of the
    smallest digest of all columns. An empty table stays empty."""
    prints, named = _named(docs, id_col, text_col, MAX_BUCKET, jaccard)
    of = joined_by_group(prints.select("doc_id", "fp", "key"), named, "fp", prints.count())
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    chosen = of.groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.key")
    repeats = prints.groupBy("doc_id", "key").count().filter("count > 1").limit(1).count()
    keyed_docs = docs.withColumn("__key", F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("key").alias("__chosen"))
    same = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__chosen"))
    out = keyed_docs.join(chosen, same, "left_semi")
    if repeats:
        one = W.partitionBy(f"`{id_col}`", "__key").orderBy(F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))
        out = out.withColumn("__at", F.row_number().over(one)).filter("__at = 1").drop("__at")
    return out.drop("__key")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
