"""Near-duplicate documents by b-bit MinHash, banding and exact confirmation.

1. Arrow batches of texts become word hashes, shingle hashes, FIELDS minima, the band keys and a signature that keeps the low ``BITS`` bits of each minimum, packed in
   longs.  Only these leave the task; the sets do not.
2. Documents with the same shingle set form one class, numbered when the classes are
   written; one of its rows, by doc_id and text, gives the set when it is needed.
3. Classes that share a band are candidates.  Bit counts of the signatures estimate their
   similarity, corrected for chance collisions of low bits; far ones and those of too
   different sizes are dropped (the bound lies 3.7 standard deviations under the threshold).
4. Each class is tried with a few others, the closest of two in each part of its buckets
   (:func:`tries`), and confirmed links are merged to components: rows grow with the members
   of buckets, never with their pairs.
5. Close pairs that still lie in different components are gathered (:func:`apart`): the
   closest one of each two components is confirmed first, then all that even then lie in
   different ones.  Pairs inside a component are not made.
6. Confirmation intersects the full shingle sets of both texts.

Defined results: null, empty and blank texts have no shingles and are linked with
nothing; a text with fewer words than a shingle has one, its whole sequence; repeated
doc_ids keep a row each (they share a component only if their texts do, and the smallest
doc_id names it); a text of any length is read whole, a batch of texts at a time; ties go by
doc_id and the text's hash; an empty table gives an empty result; further columns are
ignored, and passed through by :func:`clean_documents` under any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, stored

BITS = 2
BANDS, ROWS = 32, 4
#: Minima in a signature; the bands use the first of them.
FIELDS = 1024
#: Odd multipliers of the hash functions below (any odd 64-bit numbers do).
PRIME, MIX = 0x9E3779B97F4A7C15, (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
LOW = 0x5555555555555555
#: Fields of the signature that part the buckets for tries.
DEPTHS = (0, 3, 6)
PIECE = 1 << 15


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose low and high bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of a text whose A-Z are in lower case."""
    data = np.frombuffer(text, np.uint8)
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.concatenate(([True], blank, [True])).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(start):
        return np.empty(0, np.uint64)
    # each byte as a 64-bit number, times a power of PRIME by its place in the word; sums by word
    place = np.arange(len(data)) - np.repeat(np.concatenate(([0], start[1:])), np.diff(np.concatenate(([0], start[1:], [len(data)]))))
    longest = int((stop - start).max())
    powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(longest, PRIME, np.uint64))), dtype=np.uint64)
    value = BYTES[data] * powers[np.clip(place, 0, longest)]
    value[blank] = 0
    return mixed(np.add.reduceat(value, start) + (stop - start).astype(np.uint64))


BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(PRIME))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of the ``size``-word shingles of a text."""
    w = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(w):
        return w
    size = min(size, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = mixed(h * np.uint64(PRIME) + w[k : len(w) - size + 1 + k])
    return np.unique(h)


def minima(sets: list[np.ndarray], count: int) -> np.ndarray:
    """For each non-empty set, ``count`` minima, each under another multiplicative order."""
    multipliers = mixed(np.arange(1, count + 1, dtype=np.uint64)) | np.uint64(1)
    low = np.full((len(sets), count), ~np.uint64(0))
    # pieces that stay in the processor's cache; a set may lie in several
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    for part in range(0, len(flat), PIECE):
        x, who = flat[part : part + PIECE], owner[part : part + PIECE]
        start = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1])))
        rows = who[start]
        for k, m in enumerate(multipliers):
            low[rows, k] = np.minimum(low[rows, k], np.minimum.reduceat(x * m, start))
    return mixed(low)


def packed(low: np.ndarray) -> list[list[int]]:
    """The low BITS bits of each minimum, in longs of 64 // BITS minima."""
    per = 64 // BITS
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(len(low), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(bits, axis=2).view(np.int64).tolist()


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, h, n_shingles, key, bands, sig): ``h`` hashes the text, ``key`` tells shingle sets apart (128 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            sets = [shingle_set(text.as_py(), size) for text in batch.column(2)]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys, all_bands, sigs = [None] * len(sets), [None] * len(sets), [None] * len(sets)
            if full:
                low = minima([sets[k] for k in full], FIELDS)
                band = np.zeros((len(full), bands), np.uint64)
                for r in range(rows):
                    band = mixed(band * np.uint64(PRIME) + low[:, : bands * rows].reshape(-1, bands, rows)[:, :, r])
                for k, of_bands, of_sig in zip(full, band.view(np.int64).tolist(), packed(low), strict=True):
                    keys[k], all_bands[k], sigs[k] = hashlib.blake2b(sets[k].tobytes(), digest_size=16).digest(), of_bands, of_sig
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(keys, pa.binary()),
                    pa.array(all_bands, pa.list_(pa.int64())),
                    pa.array(sigs, pa.list_(pa.int64())),
                ],
                names=["doc_id", "h", "n_shingles", "key", "bands", "sig"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(
        run, "doc_id long, h long, n_shingles long, key binary, bands array<long>, sig array<long>"
    )


def sets_of(docs: DataFrame, size: int) -> DataFrame:
    """(id, shingles) of documents (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                some = batch.slice(part, 256)
                sets = pa.array([shingle_set(t.as_py(), size).view(np.int64) for t in some.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([some.column(0), sets], names=["id", "shingles"])

    return docs.select("id", "text").mapInArrow(run, "id long, shingles array<long>")


def estimate(a: str, b: str, longs: int) -> Column:
    """The similarity of two packed signatures: the share of equal fields, less those equal by chance."""
    per = 64 // BITS
    differ = []
    for k in range(longs):
        x = f"({a}[{k}] ^ {b}[{k}])"
        differ.append(f"bit_count(({x} | shiftrightunsigned({x}, 1)) & {LOW}L)")
    share = f"(1 - ({' + '.join(differ)}) / {float(longs * per)}D)"
    return F.expr(f"({share} - {2.0**-BITS}D) / {1 - 2.0**-BITS}D")


def sorted_side(rows: DataFrame) -> DataFrame:
    """``rows`` as a side of a sort-merge join.  What is joined here grows with the corpus; as broadcasts, many
    in one plan, they would all pass through the driver."""
    return rows.hint("merge")


def components(links: DataFrame, partitions: int | None = None) -> DataFrame:
    """(id, comp): for each id in the links (a, b), the smallest id it is connected with.

    Smallest labels pass over the links and then jump twice to the label's own label, so the
    rounds grow with the logarithm of a chain's length.  Each round is a stored table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stored(both, "links")
    label = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")), "labels")
    while True:
        heard = both.join(sorted_side(label.select(F.col("id").alias("a"), F.col("comp").alias("near"))), "a").groupBy(F.col("b").alias("id")).agg(F.min("near").alias("near"))
        step = label.join(sorted_side(heard), "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        for _ in range(2):
            up = label.select(F.col("id").alias("mid"), F.col("comp").alias("top"))
            step = step.join(sorted_side(up), "mid", "left").select("id", "old", F.least("mid", "top").alias("mid"))
        new = stored(step.withColumnRenamed("mid", "comp"), "labels")
        moved = new.filter("comp < old").limit(1).count()
        label = new.select("id", "comp")
        if not moved:
            return label


def confirmed(pairs: DataFrame, docs: DataFrame, rows: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of ids whose full shingle sets have 100 * common >= threshold * union.

    ``rows`` (id, doc_id, h): the row of ``docs``, by doc_id and hash of the text, that has an id's set."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = rows.join(sorted_side(wanted), "id").select("id", F.col("doc_id").alias("_i"), F.col("h").alias("_h"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the one join that may be a broadcast: few wanted rows spare all texts a shuffle
    text = text.join(wanted, text["doc_id"].eqNullSafe(F.col("_i")) & (F.xxhash64("text") == F.col("_h"))).select("id", "text")
    sets = stored(sets_of(text, size), "sets").dropDuplicates(["id"])
    left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(sorted_side(left), "a").join(sorted_side(right), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.withColumn("common", common).filter(100 * F.col("common") >= threshold * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, **how: float) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept; options as in :func:`grouped`."""
    return grouped(docs, **how).drop("h", "stays")


def tries(hot: DataFrame, sig: DataFrame, threshold: int, slack: float | None) -> DataFrame:
    """(a, b): for each class of ``hot`` (band, bucket, id) up to a few others, one for each of DEPTHS.

    Buckets are parted by the first fields of a piece of the signatures (for depth 0 they stay
    whole).  In each part the smallest and the largest class are held against all others, so rows
    grow with the members, not with their pairs; the closest by estimate is tried.
    """
    longs = FIELDS * BITS // 64
    parts = [F.expr(f"struct({d} AS depth, " + (f"shiftrightunsigned(sig[pmod(band * 5 + {d}, {longs})], {64 - BITS * d})" if d else "0L") + " AS part)") for d in DEPTHS]
    dealt = hot.join(sorted_side(sig.select("id", "sig")), "id").select("band", "bucket", "id", F.explode(F.array(*parts)).alias("d")).select("band", "bucket", "id", "d.depth", "d.part")
    key = ["band", "bucket", "depth", "part"]
    ends = dealt.groupBy(*key).agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi")
    near = F.explode(F.expr("filter(array(lo, hi), x -> x <> id)")).alias("near")
    pairs = dealt.join(sorted_side(ends), key).select("id", "depth", near).distinct()
    close = pairs.join(sorted_side(sig), "id").join(sorted_side(sig.toDF("near", "near_n", "near_sig")), "near").filter(closeness("", "near_", threshold, slack))
    best = close.groupBy("id", "depth").agg(F.max_by("near", F.struct(estimate("sig", "near_sig", longs), -F.col("near"))).alias("near"))
    return best.select(F.least("id", "near").alias("a"), F.greatest("id", "near").alias("b")).distinct()


def closeness(mine: str, theirs: str, threshold: int, slack: float | None) -> Column:
    """Whether two sets may reach the threshold, by their sizes and by the estimate (not with ``slack`` None)."""
    sizes = F.expr(f"100 * least({mine}n, {theirs}n) >= {threshold} * greatest({mine}n, {theirs}n)")
    if slack is None:
        return sizes
    return sizes & (estimate(f"{mine}sig", f"{theirs}sig", FIELDS * BITS // 64) >= threshold / 100 - slack)


def apart(members: DataFrame, sig: DataFrame, bands: DataFrame, threshold: int, slack: float | None) -> DataFrame:
    """(a, b, comp_a, comp_b, close): all close pairs of a bucket whose classes lie in different
    components, each pair once, with their components and the estimate.

    Members of a bucket's largest component meet only the others, which are few once the
    components have grown; a pair belongs to the first of the bands that it shares.
    """
    sizes = members.groupBy("band", "bucket", "comp").agg(F.count("*").alias("m")).groupBy("band", "bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"))
    full = stored(members.join(sorted_side(sizes), ["band", "bucket"]).withColumn("main", F.expr("comp = main")).join(sorted_side(sig), "id").join(sorted_side(bands), "id"), "members")
    theirs = full.select("band", "bucket", *(F.col(c).alias(f"near_{c}") for c in ("id", "comp", "main", "n", "sig", "bands")))
    once = F.expr("comp <> near_comp AND (near_main OR id < near_id)")
    first = F.expr("size(filter(sequence(0, band), k -> bands[k] = near_bands[k])) = 1")
    pairs = full.filter("NOT main").join(sorted_side(theirs), ["band", "bucket"]).filter(once & closeness("", "near_", threshold, slack) & first)
    one, other = F.struct(F.col("id").alias("id"), "comp"), F.struct(F.col("near_id").alias("id"), F.col("near_comp").alias("comp"))
    both = pairs.select(F.least(one, other).alias("x"), F.greatest(one, other).alias("y"), estimate("sig", "near_sig", FIELDS * BITS // 64).alias("close"))
    return both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.comp").alias("comp_a"), F.col("y.comp").alias("comp_b"), "close")


def grouped(
    docs: DataFrame, size: int = 5, threshold: int = 80, bands: int = BANDS, rows: int = ROWS, slack: float | None = 0.055
) -> DataFrame:
    """One row per document: doc_id, h (the text's hash), n_shingles, component_id, kept, and
    ``stays`` for the one row (doc_id, h) that stands for its group.

    ``size``: words of a shingle.  ``threshold``: least similarity in hundredths.
    ``slack``: how far under the threshold an estimate may lie (3.7 standard deviations);
    None confirms all candidates, without estimates.
    """
    shared_dir(docs.sparkSession)
    signed = stored(signatures(docs, size, bands, rows), "signatures")
    # classes are named by their sets: a doc_id may stand on rows with different texts
    row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("row")
    classes = signed.filter("key IS NOT NULL").groupBy("key").agg(row, F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # written once, so the numbers stay whatever is computed anew
    classes = stored(classes.select("key", F.monotonically_increasing_id().alias("id"), "row.doc_id", "row.h", "n", "bands", "sig"), "classes")
    holders = classes.select("id", "doc_id", "h")
    buckets = stored(classes.select("id", F.posexplode("bands").alias("band", "bucket")), "buckets")
    shared = buckets.groupBy("band", "bucket").agg(F.count("*").alias("m")).filter("m > 1").drop("m")
    hot = stored(buckets.join(sorted_side(shared), ["band", "bucket"]), "hot")
    ids = hot.select("id").distinct()
    sig = stored(classes.select("id", "n", "sig").join(sorted_side(ids), "id"), "sigs")
    done = stored(tries(hot, sig, threshold, slack), "tries")
    links = stored(confirmed(done, docs, holders, size, threshold), "confirmed")
    label = components(links)
    # what may still join two components: only buckets of several components matter
    members = hot.join(sorted_side(label), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    several = members.groupBy("band", "bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("band", "bucket")
    members = stored(members.join(sorted_side(several), ["band", "bucket"]), "several")
    rest = stored(apart(members, sig, classes.select("id", "bands"), threshold, slack).join(sorted_side(done), ["a", "b"], "left_anti"), "apart")
    # first the closest pair of each two components; then what still lies in different ones
    ends = [F.least("comp_a", "comp_b").alias("p"), F.greatest("comp_a", "comp_b").alias("q")]
    best = rest.groupBy(*ends).agg(F.max_by(F.struct("a", "b", "comp_a", "comp_b"), F.struct("close", "a", "b")).alias("x")).select("x.*")
    best = stored(best, "closest")
    ties = joined = None
    for turn in range(2):
        wanted = best
        if turn:
            wanted = rest.join(sorted_side(best.select("a", "b")), ["a", "b"], "left_anti")
            if joined is not None:
                for side in ("comp_a", "comp_b"):
                    wanted = wanted.join(sorted_side(joined.toDF(side, f"{side}_top")), side, "left").withColumn(f"{side}_top", F.coalesce(f"{side}_top", side))
                wanted = wanted.filter("comp_a_top <> comp_b_top")
            wanted = stored(wanted.select("a", "b", "comp_a", "comp_b"), "rest")
        if wanted.limit(1).count():
            found = stored(confirmed(wanted, docs, holders, size, threshold).join(sorted_side(wanted), ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), "confirmed")
            if found.limit(1).count():
                ties = found if ties is None else ties.union(found)
                joined = components(ties).toDF("comp", "whole")
    # the smallest doc_id names a component, and the first of its rows stands for it
    by_class = classes.select("key", "id", "doc_id", "h").join(sorted_side(label), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    if joined is not None:
        by_class = by_class.join(sorted_side(joined), "comp", "left").withColumn("comp", F.coalesce("whole", "comp"))
    names = by_class.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("top"))
    by_key = by_class.select("key", "comp").join(sorted_side(names), "comp").select("key", "top")
    out = signed.select("doc_id", "h", "n_shingles", "key").join(sorted_side(by_key), "key", "left")
    component = F.expr("CASE WHEN key IS NULL THEN doc_id ELSE top.doc_id END")
    stays = F.expr("key IS NULL OR (doc_id <=> top.doc_id AND h = top.h)")
    return out.select("doc_id", "h", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), stays.alias("stays"))


def clean_documents(docs: DataFrame, **how: int) -> DataFrame:
    """One row of each group, with all its columns: the smallest doc_id, of equal ones the smallest
    hash of the text, of rows alike in both any one; rows without shingles all stay."""
    found = stored(grouped(docs, **how).select("doc_id", "h", "stays", F.expr("n_shingles > 0").alias("full")), "groups")
    rest = found.filter("NOT stays").select(F.col("doc_id").alias("_i"), F.col("h").alias("_h")).distinct()
    same = lambda keys: docs["doc_id"].cast("long").eqNullSafe(keys["_i"]) & (F.xxhash64(docs["text"]) == keys["_h"])
    again = found.filter("stays AND full").groupBy(F.col("doc_id").alias("_i"), F.col("h").alias("_h")).agg(F.count("*").alias("n")).filter("n > 1").select("_i", "_h")
    if again.limit(1).count():
        again = stored(again, "again")
        once = docs.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"])
        rest = rest.union(again)
        return docs.join(rest, same(rest), "left_anti").unionByName(once)
    return docs.join(rest, same(rest), "left_anti")
