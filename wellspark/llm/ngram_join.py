"""Near-duplicate join: pairs of documents whose sets of word n-grams have a Jaccard similarity of 0.8 or more.

1. Every text becomes its set of hashed n-grams (whole text, lower-cased, words split at white space). Texts with the
   same set are one *class*, named by its smallest document id; only classes are compared, so copies cost nothing.
2. MinHash banding: ``bands`` x ``rows`` minima per class, with the counts chosen for a target recall at the threshold
   (:func:`banding`). Classes meet in a shuffle on the band hashes.
3. A band bucket of at most ``small`` classes gives its pairs directly. Larger ones are compared in *groups* without
   pair rows: a group is cut into blocks, every two blocks meet in one task, which verifies all their pairs on the full
   sets and returns per class the number of links. Buckets that overlap closely are one group (a component of shared
   buckets with at most CHAINED times as many classes as its largest bucket, so that near copies, which share most of
   their buckets, are compared once); in a longer chain of buckets every bucket is a group, and a pair counts in the
   first bucket that both classes are in. So every candidate is verified, however many classes share a bucket, the work
   never exceeds that of the buckets by more than CHAINED squared, and no task holds more than two blocks.
4. Groups of near-duplicates are the connected components of the verified links.

Edge cases: a text of fewer than n words is one n-gram of all its words; null, empty and white-space texts have no
n-grams, no class partner and no link. Rows with a null id are left out of the result. Rows that repeat an id are one
document (the smallest class and most links among them). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wellspark.llm.components import components
from wellspark.session import materialize

# Fixed odd multipliers of the hash functions (64-bit, from the golden ratio and from a published mixer).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BLOCK_CLASSES, BLOCK_GRAMS = 256, 400_000
CHAINED = 4
SALTS = 32  # tasks that a band bucket is dealt to at least when its members look for their smallest
CACHE_WORDS = 200_000  # some 40 MB; a word beyond is one hash call


def banding(threshold: float, recall: float, rows: int = 5) -> tuple[int, int]:
    """(bands, rows): the fewest bands of ``rows`` minima that meet a pair at the threshold with ``recall``."""
    bands = 1
    while 1 - (1 - threshold**rows) ** bands < recall:
        bands += 1
    return bands, rows


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


class _WordHash(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def gram_set(text: str | None, n: int, words: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a whole text."""
    found = (text or "").lower().split()
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    if not len(h):
        return h
    k = min(n, len(h))
    grams = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        grams = grams * GOLDEN + h[i : len(h) - k + 1 + i]
    return np.unique(mix(grams + np.uint64(k)))


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """MinHash signatures, one row per (non-empty) set, computed for all sets of a batch at once."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * GOLDEN)
    out = np.empty((len(sets), count), dtype=np.uint64)
    for k in range(count):  # one random odd multiplier per function; the upper bits of the product order the grams
        out[:, k] = np.minimum.reduceat((flat ^ seeds[k]) * (seeds[k] | np.uint64(1)), starts)
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest of the n-gram set (null if it is empty), its size and one hash per band."""

    def run(batches):
        words = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = part.column(0).to_pylist()
                sets = [gram_set(t, n, words) for t in part.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                digest, keys = [None] * len(sets), [None] * len(sets)
                if full:
                    sig = minima([sets[i] for i in full], bands * rows).reshape(len(full), bands, rows)
                    band = np.zeros((len(full), bands), dtype=np.uint64)
                    for r in range(rows):
                        band = mix(band * GOLDEN + sig[:, :, r])
                    band = mix(band + np.arange(1, bands + 1, dtype=np.uint64) * GOLDEN).view(np.int64)
                    for i, row in zip(full, band):
                        digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
                        keys[i] = row
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(digest, pa.binary()),
                     pa.array([len(s) for s in sets], pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "digest", "grams", "bands"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return (rows_in.where("doc_id is not null")
            .mapInArrow(run, "doc_id long, digest binary, grams int, bands array<long>"))


def full_sets(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(cid, set) of the classes in ``wanted`` (cid): the n-gram hashes of the document that names the class."""

    def run(batches):
        words = _WordHash()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [gram_set(t, n, words).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], ["cid", "grams"])

    rows_in = docs.select(F.col(id_col).cast("long").alias("cid"), F.col(text_col).alias("text"))
    # a shuffle join at every size: the wanted ids grow with the data, so they are never broadcast
    return rows_in.join(wanted.hint("merge"), "cid", "left_semi").select("cid", "text").mapInArrow(run, "cid long, grams array<long>")


def block_links(cids: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], own: bool, num: int, den: int,
                keys: list[np.ndarray] | None = None, group: int = 0):
    """All pairs of two blocks (of one if ``own``): links per class, and for each linked class the smallest class it is
    connected to inside these blocks. With ``keys`` (the sorted groups of each class, empty for a class of one group)
    a pair counts only where ``group`` is the first that both have."""
    m = len(cids)
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    grams, col = np.unique(flat, return_inverse=True)
    shared = np.bincount(col) > 1
    place = np.cumsum(shared) - 1
    keep = shared[col]
    col, who = place[col[keep]], who[keep]
    common = np.zeros((m, m), dtype=np.float32)
    width = 8192
    order = np.argsort(col, kind="stable")
    col, who = col[order], who[order]
    cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + width, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = np.zeros((m, width), dtype=np.float32)
        part[who[a:b], col[a:b] - k * width] = 1
        common += part @ part.T
    inter = common.astype(np.int64)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    link = inter * den >= num * union
    np.fill_diagonal(link, False)
    if not own:
        link &= blocks[:, None] != blocks[None, :]
    if keys is not None and any(len(k) for k in keys):
        for a, b in np.argwhere(np.triu(link)).tolist():
            if len(keys[a]) and np.intersect1d(keys[a], keys[b])[0] != group:
                link[a, b] = link[b, a] = False
    root = cids.copy()
    while True:  # smallest id among the neighbours, again and again
        low = np.where(link, root[None, :], np.iinfo(np.int64).max).min(axis=1, initial=np.iinfo(np.int64).max)
        nxt = np.minimum(root, low)
        if (nxt == root).all():
            return link.sum(axis=1), root
        root = nxt


def ngram_join(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(4, 5), recall: float = 0.9995,
               small: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, set_id, n_copies, n_links.

    ``set_id`` is the smallest id with the same n-gram set, ``n_copies`` the number of rows with that set, ``n_links``
    the number of *different* n-gram sets that are similar to it, ``class_id`` the smallest id of the group of
    documents connected by such links.
    """
    num, den = threshold.numerator, threshold.denominator
    bands, rows = banding(float(threshold), recall)
    signed = materialize(signatures(docs, n, bands, rows, id_col, text_col), "signatures")
    classes = materialize(
        signed.where("digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("cid"), F.count("*").alias("n_copies"), F.first("grams").alias("grams"),
             F.first("bands").alias("bands")), "classes")

    keyed = classes.select("cid", "grams", F.explode("bands").alias("key"))
    met = materialize(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"), "buckets")
    keyed = materialize(keyed.join(met, "key"), "candidates")

    # buckets too large for direct pairs: components of shared buckets, by edges to a smallest member
    large = keyed.where(F.col("members") > small).withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)))
    lead = materialize(large.groupBy("key", "salt").agg(F.min("cid").alias("lead")), "leads")
    top = lead.groupBy("key").agg(F.min("lead").alias("top"))
    edges = (large.join(lead, ["key", "salt"]).select(F.col("cid").alias("a"), F.col("lead").alias("b"))
             .unionByName(lead.join(top, "key").select(F.col("lead").alias("a"), F.col("top").alias("b"))))
    hot = materialize(components(edges, "hot").select(F.col("node").alias("cid"), F.col("root").alias("comp")), "hot")
    # a component much larger than its largest bucket is a chain: there each bucket is compared by itself
    size = hot.groupBy("comp").agg(F.count("*").alias("n"))
    widest = top.join(hot, F.col("top") == F.col("cid")).join(met, "key").groupBy("comp").agg(
        F.max("members").alias("widest"))
    chained = size.join(widest, "comp").select("comp", (F.col("n") > CHAINED * F.col("widest")).alias("chain"))
    hot = materialize(hot.join(chained, "comp"), "hot_groups")
    grouped = hot.where("NOT chain").select("cid", F.col("comp").alias("grp"), F.array().cast("array<long>").alias("keys"))
    in_chain = large.join(hot.where("chain").select("cid"), "cid").select("cid", F.col("key").alias("grp"))
    every = in_chain.groupBy("cid").agg(F.sort_array(F.collect_list("grp")).alias("keys"))  # a class has `bands` at most
    grouped = materialize(grouped.unionByName(in_chain.join(every, "cid").select("cid", "grp", "keys")), "groups")

    # direct pairs, unless the block comparison of a group has them already
    listed = (keyed.where(F.col("members") <= small).groupBy("key")
              .agg(F.sort_array(F.collect_list(F.struct("cid", "grams"))).alias("m")))
    pairs = (listed.select(F.explode(F.expr(
        "flatten(transform(m, (x, i) -> transform(slice(m, i + 2, size(m)), y -> struct(x.cid as a, x.grams as na, "
        "y.cid as b, y.grams as nb))))")).alias("p")).select("p.*")
        .where((F.least("na", "nb") * den >= F.greatest("na", "nb") * num) & (F.col("a") != F.col("b"))).distinct())
    side = lambda c: grouped.groupBy("cid").agg(
        F.collect_list("grp").alias(f"g{c}")).withColumnRenamed("cid", c)
    pairs = (pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
             .where("ga IS NULL OR gb IS NULL OR NOT arrays_overlap(ga, gb)").select("a", "b"))
    pairs = materialize(pairs, "pairs")

    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(hot.select("cid")).distinct()
    sets = materialize(full_sets(docs, wanted, n, id_col, text_col).dropDuplicates(["cid"]), "sets")

    verified = (pairs.join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("ga")), "a")
                .join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("gb")), "b")
                .withColumn("inter", F.size(F.array_intersect("ga", "gb")))
                .where(F.col("inter") * den >= (F.size("ga") + F.size("gb") - F.col("inter")) * num)
                .select("a", "b"))
    verified = materialize(verified, "links")
    dealt = materialize(_blocks(grouped, classes, sets, num, den), "block_links")

    counts = (verified.select(F.col("a").alias("cid"), F.lit(1).cast("long").alias("links"))
              .unionByName(verified.select(F.col("b").alias("cid"), F.lit(1).cast("long").alias("links")))
              .unionByName(dealt.select("cid", "links"))
              .groupBy("cid").agg(F.sum("links").alias("n_links")))
    groups = components(verified.unionByName(dealt.select(F.col("cid").alias("a"), F.col("root").alias("b"))), "groups")
    named = (classes.select("digest", "cid", "n_copies").join(counts, "cid", "left")
             .join(groups, F.col("cid") == F.col("node"), "left")
             .select("digest", F.col("cid").alias("set_id"), "n_copies",
                     F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                     F.coalesce("root", "cid").alias("class_id")))
    named = materialize(named, "named")
    # a set that many rows share is a skewed key: adaptive execution splits the documents' side of this join
    found = (signed.select("doc_id", "digest").where("digest is not null").join(named.hint("merge"), "digest")
             .select("doc_id", "class_id", "set_id", "n_copies", "n_links"))
    alone = signed.where("digest is null").select(
        "doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("set_id"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    return (found.unionByName(alone).groupBy("doc_id")
            .agg(F.min("class_id").alias("class_id"), F.min("set_id").alias("set_id"),
                 F.max("n_copies").alias("n_copies"), F.max("n_links").alias("n_links")))


def _blocks(grouped: DataFrame, classes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """cid, links, root: the verified links inside each group, one row per class and pair of blocks."""
    sized = grouped.join(classes.select("cid", F.col("grams").alias("weight")), "cid")
    total = sized.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES),
                                                F.ceil(F.sum("weight") / BLOCK_GRAMS)).alias("blocks"))
    member = (sized.join(total, "grp").withColumn("mine", F.pmod(F.xxhash64("cid"), F.col("blocks")))
              .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
              .select("cid", "grp", "keys", "mine", F.least("mine", "other").alias("i"),
                      F.greatest("mine", "other").alias("j")))

    def lists_of(table: pa.Table, column: str) -> list[np.ndarray]:
        lists = table.column(column).combine_chunks()
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        return [values[a:b] for a, b in zip(offsets, offsets[1:])]

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        own = key[1].as_py() == key[2].as_py()
        cids = table.column("cid").to_numpy()
        sets = [s.view(np.uint64) for s in lists_of(table, "grams")]
        links, root = block_links(cids, table.column("mine").to_numpy(), sets, own, num, den,
                                  lists_of(table, "keys"), key[0].as_py())
        some = links > 0
        return pa.table({"cid": cids[some], "links": links[some].astype(np.int64), "root": root[some]})

    return (member.join(sets, "cid").select("grp", "i", "j", "cid", "mine", "keys", "grams").groupBy("grp", "i", "j")
            .applyInArrow(compare, "cid long, links long, root long"))


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each near-duplicate group; rows with a null id stay."""
    gone = (ngram_join(docs, id_col=id_col, text_col=text_col, **options).where("doc_id != class_id")
            .select(F.col("doc_id").alias("gone__")))
    return docs.join(gone, F.col(id_col).cast("long") == F.col("gone__"), "left_anti")
