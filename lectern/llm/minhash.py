"""Near-duplicate detection with b-bit MinHash.

Signatures keep the low ``BITS`` bits of each minimum, packed into longs. Documents of equal
shingle sets fall into one class first, so copies never pair up. Classes that share a band of
full minima are candidates; the collision-corrected estimate from bit counts drops the
hopeless ones, and links are confirmed on full shingle sets.

Each bucket's members are first compared with one centre, the member with the fullest buckets.
Only members that this leaves in different components of one bucket are compared further: in
small buckets pair by pair, in large ones by a prefix-filtered join of their differences from
a centre (``_cross_by_differences``), one for all alike centres of a component. So no link is
lost, and a large group of near copies lists its differences in proportion to its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .storage import discard, kept, parted
from .textblocks import NOT_SPACE, Block, blocks, lower_ascii, mix, shingle_hashes, word_hashes
from .workers import mapped

ROWS = 4
BITS = 4
#: Estimates this far below the threshold are dropped: over five standard deviations of an estimate at the threshold.
SLACK = 0.2
#: Most wanted chance that two documents at the threshold share no band.
MISS = 1e-7
#: Members of buckets up to this size are compared pair by pair.
SMALL_BUCKET = 32


def band_count(percent: int) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS) / 4) * 4


def shingles(block: Block, k: int) -> tuple[np.ndarray, np.ndarray]:
    low = Block(lower_ascii(block.data), block.at, block.first)
    starts, ends, first = low.words(NOT_SPACE)
    return shingle_hashes(word_hashes(low.data, starts, ends), first, k)


def _sketch(k: int, bands: int):
    n_hashes = bands * ROWS
    rng = np.random.default_rng(20240229)
    scale = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
    per_long = 64 // BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, band_rows, bit_rows = [], [], [], []
            for block in blocks(batch.column(2)):
                h, at = shingles(block, k)
                n = len(block)
                some = np.flatnonzero(np.diff(at))
                least = np.zeros((n_hashes, n), np.uint64)
                if len(some):
                    for j in range(n_hashes):
                        least[j, some] = np.minimum.reduceat(h * scale[j] + shift[j], at[some])
                least = mix(least)
                keys = np.zeros((bands, n), np.uint64)
                for r in range(ROWS):
                    keys = mix(keys + least[r::ROWS] + np.arange(bands, dtype=np.uint64)[:, None] + np.uint64(r))
                low = (least & np.uint64((1 << BITS) - 1)).reshape(-1, per_long, n)
                packed = np.bitwise_or.reduce(low << (np.arange(per_long, dtype=np.uint64) * np.uint64(BITS))[None, :, None], axis=1)
                band_rows.append(keys.T.astype(np.int64))
                bit_rows.append(packed.T.astype(np.int64))
                for d in range(n):
                    own = np.unique(h[at[d] : at[d + 1]])
                    counts.append(len(own))
                    digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            lists = [np.concatenate(x) if x else np.zeros((0, 1), np.int64) for x in (band_rows, bit_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), *[pa.ListArray.from_arrays(np.arange(0, x.size + 1, max(x.shape[1], 1), dtype=np.int32), pa.array(x.ravel())) for x in lists]], ["key", "text_hash", "n", "digest", "bands", "bits"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                h, at = shingles(block, k)
                own = [np.unique(h[i:j]).astype(np.int64) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, len(block)), pa.array(own, pa.list_(pa.int64()))], ["node", "grams"])

    return run


def estimate(a: Column, b: Column, n_hashes: int) -> Column:
    """Similarity from packed low bits: the share of equal fields, less what equals by chance."""
    ones = int("0001" * 16, 2)
    low = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 2))
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(low(x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))).bitwiseAND(F.lit(ones)))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    return ((F.lit(1.0) - differ / F.lit(float(n_hashes))) - chance) / (1 - chance)


def _references(many: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """For every centre of ``many`` its reference: of its component's centres the one of most members, if at least half alike, else itself.

    A large group has the more centres the larger it is, and each of its members lies in buckets of many.
    """
    named = F.coalesce("root", "centre").alias("root")
    sizes = many.groupBy("centre").agg(F.count(F.lit(1)).alias("n")).join(roots.select(F.col("node").alias("centre"), "root"), "centre", "left").select("centre", "n", named)
    hosts = sizes.groupBy("root").agg(F.max(F.struct("n", "centre")).alias("best")).select("root", F.col("best.centre").alias("host"))
    grams = lambda x: sets.select(F.col("node").alias(x), F.col("grams").alias(f"of_{x}"))
    both = sizes.join(hosts, "root").join(grams("centre"), "centre").join(grams("host"), "host")
    alike = 3 * F.size(F.array_intersect("of_centre", "of_host")) >= F.size("of_centre") + F.size("of_host")
    return both.select("centre", F.when(alike, F.col("host")).otherwise(F.col("centre")).alias("reference"))


def _cross_by_differences(many: DataFrame, sets: DataFrame, marks: DataFrame, roots: DataFrame, percent: int, alike: Callable[..., Column]) -> DataFrame:
    """Pairs ``a, b`` of one centre's members in different components that may be similar enough.

    Centres of one component that are much alike give their members to one of them, so that a
    member's differences are listed about once, however many buckets it is in. Members that are
    similar enough to this centre are given as pairs with it, and count as of its component.

    Let D(x) be the symmetric difference of x's set and the centre's, q = (100 - percent) /
    (100 + percent). A link of x and y needs |D(x) and D(y)| >= (|D(x)| + |D(y)| - q (|x| + |y|)) / 2.
    One of the two is outside the centre's component, so its D is greater than q (|x| + |centre|).
    Hence with a partner outside x needs over (|D(x)| + q (|centre| - |x|)) / 2 common elements,
    with one inside (|D(x)| - q (|centre| + |x|)) / 2 or more. As |D(y)| is at least |D(x)| -
    q (|x| + |y|), it also needs |D(x)| - q (|x| + |y|) or more, for the longest y there may be.
    Sets that share so many share one among the first |D| - need + 1 of each, in any common
    order: here the elements of the fewest members come first, so that what a centre has of its
    own, and all others lack, brings together only those that need it. Needs are exact integers.
    From a first common element on, no more than the rest of the shorter list can agree: pairs of
    which that falls short of the need go at once.
    """
    less, whole = 100 - percent, 2 * (100 + percent)
    references = kept(_references(many, sets, roots), "references")
    many = many.join(references, "centre").select(F.col("reference").alias("centre"), "node", "root").distinct()
    placed = many.join(roots.select(F.col("node").alias("centre"), F.col("root").alias("of_centre")), "centre", "left")
    both = placed.join(sets, "node").join(sets.select(F.col("node").alias("centre"), F.col("grams").alias("hub")), "centre")
    both = both.select("centre", "node", F.col("root").alias("own_root"), F.coalesce("of_centre", "centre").alias("of_centre"), F.size("grams").cast("long").alias("n_own"), F.size("hub").cast("long").alias("n_hub"), F.sort_array(F.array_except("grams", "hub")).alias("extra"), F.sort_array(F.array_except("hub", "grams")).alias("lacking"))
    n_diff = F.size("extra") + F.size("lacking")
    linked = whole // 2 * n_diff <= less * (F.col("n_hub") + F.col("n_own"))
    both = both.withColumn("root", F.when(linked, F.col("of_centre")).otherwise(F.col("own_root"))).withColumn("inside", F.col("root") == F.col("of_centre"))
    furthest = n_diff - F.floor(less * (F.col("n_own") + F.floor(100 * F.col("n_own") / percent)) / (whole // 2))
    over = F.greatest(furthest, F.floor((whole // 2 * n_diff + less * (F.col("n_hub") - F.col("n_own"))) / whole) + 1)
    least = F.greatest(furthest, F.ceil((whole // 2 * n_diff - less * (F.col("n_hub") + F.col("n_own"))) / whole))
    first = lambda need: F.greatest(F.lit(0), n_diff - F.greatest(F.lit(1), need) + 1).cast("int")
    # An element is signed by whether the centre has it, so the two parts never meet.
    marked = lambda part: F.transform(part, lambda x: F.struct(F.lit(part == "extra").alias("extra"), x.alias("gram")))
    prefix = F.when(F.col("inside"), first(over)).otherwise(F.greatest(first(over), first(least)))
    both = kept(both.select("centre", "node", "root", "inside", (linked & (F.col("own_root") != F.col("of_centre"))).alias("joins"), n_diff.cast("long").alias("differ"), first(over).alias("short"), prefix.alias("prefix"), F.concat(marked("extra"), marked("lacking")).alias("signed")), "own-differences")
    # The order: elements of few members first. Those of one member alone meet none, so only their number counts.
    # A centre's many members lie together, so they are dealt out before their elements are.
    elements = both.select("centre", "node", "signed").repartition("centre", "node").select("centre", "node", F.explode("signed").alias("e")).select("centre", "node", "e.extra", "e.gram")
    counted = elements.groupBy("centre", "extra", "gram").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    listed = elements.join(counted, ["centre", "extra", "gram"]).groupBy("centre", "node").agg(F.sort_array(F.collect_list(F.struct("members", "extra", "gram"))).alias("common"))
    alone = (F.col("differ") - F.size("common")).cast("int")
    taken = both.drop("signed").join(listed, ["centre", "node"]).join(marks, "node").withColumn("alone", alone).withColumn("common", F.slice("common", F.lit(1), F.greatest(F.lit(0), F.col("prefix") - F.col("alone"))))
    posts = taken.select("centre", "node", "root", "inside", "n", "bits", "differ", "short", "alone", F.posexplode("common").alias("place", "element")).withColumn("at", F.col("alone") + F.col("place"))
    posts = kept(posts.select("centre", "element.extra", "element.gram", "node", "root", "inside", "n", "bits", "differ", (F.col("differ") - F.col("at")).alias("rest"), (F.col("at") < F.col("short")).alias("early")), "differences")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "inside", "n", "bits", "differ", "rest", "early")]
    left = posts.where("early").select("centre", "extra", "gram", *side("a")).alias("l")
    right = posts.where("not inside").select("centre", "extra", "gram", *side("b")).alias("r")
    same = (F.col("l.gram") == F.col("r.gram")) & (F.col("l.centre") == F.col("r.centre")) & (F.col("l.extra") == F.col("r.extra"))
    once = F.col("inside_a") | (F.col("early_b") & (F.col("node_a") < F.col("node_b")))
    enough = whole * F.least("rest_a", "rest_b") >= whole // 2 * (F.col("differ_a") + F.col("differ_b")) - less * (F.col("n_a") + F.col("n_b"))
    met = left.join(right, same & once & enough & (F.col("root_a") != F.col("root_b")) & alike("n_a", "n_b", "bits_a", "bits_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    found = kept(met.union(both.where("joins").select("node", "centre")).distinct(), "far")
    discard(references, both, posts)
    return found


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key, n_shingles, component_id, kept``.

    Links join documents whose sets of distinct ``k``-word shingles have 100 * intersection >=
    ``percent`` * union; a component's id is its smallest key. Null, empty and wordless texts
    have no shingles and link with nothing. Rows of one key but different texts are judged
    each for itself; a null key is kept, alone and without a component. Repeated rows are in
    one component; an empty table gives an empty one; other columns are left out.
    """
    bands = band_count(percent)
    n_hashes = bands * ROWS
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(body).alias("text_hash"), body.alias("text"))
    sketched = kept(mapped(rows, _sketch(k, bands), f"key {kind}, text_hash long, n long, digest binary, bands array<long>, bits array<long>"), "sketches")
    sound = sketched.where("key is not null and digest is not null")
    classes = kept(sound.groupBy("digest").agg(F.min(F.struct("key", "text_hash")).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits")), "classes")

    banded = classes.select(F.col("digest").alias("node"), F.explode("bands").alias("bucket"))
    shared = kept(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    crowded = kept(banded.join(shared, "bucket"), "crowded")
    company = crowded.groupBy("node").agg(F.sum("size").alias("company"))
    centres = kept(crowded.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node")).alias("best")).select("bucket", F.col("best.node").alias("centre")), "centres")
    members = kept(crowded.join(centres, "bucket"), "members")
    discard(shared, crowded, centres)
    involved = members.select(F.col("node").alias("digest")).distinct().join(classes.select("digest", "rep.key", "rep.text_hash"), "digest")
    involved = kept(involved, "involved")
    _, near = parted(rows, F.col("text_hash"), involved, F.col("text_hash"))
    repeated = kept(mapped(near.join(involved, ["key", "text_hash"]).select(F.col("digest").alias("node"), "text"), _sets(k), "node binary, grams array<long>"), "sets")
    sets = kept(repeated.dropDuplicates(["node"]), "distinct-sets")
    discard(repeated, involved)
    marks = classes.select(F.col("digest").alias("node"), "n", "bits")

    def alike(n_a: str, n_b: str, bits_a: str, bits_b: str) -> Column:
        longer, shorter = F.greatest(n_a, n_b), F.least(n_a, n_b)
        return (100 * shorter >= percent * longer) & (estimate(F.col(bits_a), F.col(bits_b), n_hashes) >= percent / 100 - SLACK)

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(c).alias(f"{name}" if c == "node" else f"{c}_{name}") for c in df.columns])

    def confirmed(pairs: DataFrame, checked: bool) -> DataFrame:
        if not checked:
            pairs = pairs.join(side(marks, "a"), "a").join(side(marks, "b"), "b").where(alike("n_a", "n_b", "bits_a", "bits_b")).select("a", "b")
        pairs = pairs.join(side(sets, "a"), "a").join(side(sets, "b"), "b")
        both = F.size(F.array_intersect("grams_a", "grams_b"))
        return pairs.where(100 * both >= percent * (F.size("grams_a") + F.size("grams_b") - both)).select("a", "b")

    links = kept(confirmed(members.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), False), "centre-links")
    roots = first = second = components(links)
    # Buckets whose members are still in several components: compare those across components.
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = kept(placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"), "mixed")
    open_ = kept(placed.where("node <> centre").join(mixed, "bucket").select("bucket", "size", "centre", "node", "root"), "open")
    few = open_.where(F.col("size") <= SMALL_BUCKET).join(marks, "node")
    left, right = (few.select("bucket", F.col("node").alias(x), F.col("root").alias(f"root_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")) for x in "ab")
    crossed = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("root_a") < F.col("root_b")) & alike("n_a", "n_b", "bits_a", "bits_b")).select("a", "b").distinct()
    many = open_.where(F.col("size") > SMALL_BUCKET).select("centre", "node", "root").distinct()
    far = _cross_by_differences(many, sets, marks, roots, percent, alike)
    crossing = kept(crossed.union(far).distinct(), "crossed")
    more = kept(confirmed(crossing, True), "cross-links")
    discard(members, mixed, open_, far, crossing, sets)
    if not more.isEmpty():
        # Only the roots that the further links join have to be brought together.
        known = roots.select("node", "root")
        ends = more.join(side(known, "a"), "a", "left").join(side(known, "b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
        second = components(ends)
        joined = second.select(F.col("node").alias("root"), F.col("root").alias("_upper"))
        moved = known.join(joined, "root", "left").select("node", F.coalesce("_upper", "root").alias("root"))
        # A node that was no member of a component before is its own root.
        roots = moved.unionByName(second.join(known.select("node"), "node", "left_anti"))

    grouped = classes.select(F.col("digest").alias("node"), "rep.key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = kept(grouped.groupBy("root").agg(F.min("key").alias("component_id")), "least")
    ids = kept(grouped.join(least, "root").select(F.col("node").alias("digest"), "component_id"), "component-ids")
    discard(classes, links, more, least, *{id(x): x for x in (first, second)}.values())
    out = sketched.select("key", "n", "digest").join(ids, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.when(F.col("key").isNotNull(), F.col("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("key"), F.lit(True)).alias("kept"))
