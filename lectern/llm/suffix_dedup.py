"""Exact removal of byte strings that occur earlier in the corpus, by a sampled suffix array.

Every window of ``WIDTH`` bytes belongs to one anchor inside it: the position whose ``GRAM``
bytes hash lowest. Equal windows have equal anchors at equal offsets, so it is enough to sort
the suffixes that start at anchors. Splitters from a sample of documents deal the suffixes to
buckets by their leading tokens, the anchor's bytes, and, among equal ones, by what follows in
the order of the sort; so no group of equal suffixes has to fit into one bucket. Each bucket
sorts its suffixes by multikey quicksort and compares neighbours, and what touches a bucket's
edges is compared across the boundary.

Suffixes of one anchor, byte for byte, lie side by side. Where their whole neighbourhood is
equal, the first occurrence stays and the others go at once; only first occurrences of
differing neighbourhoods have their windows compared one by one. Texts leave their place only
where something may have to go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import discard, kept, parted, partitions
from .textblocks import Block, blocks, mix, powers
from .workers import mapped

WIDTH = 100
#: Bytes of an anchor, and the tokens of eight bytes that hold them.
GRAM = 24
TOKENS = GRAM // 8
#: Neighbouring windows that are first compared by the bytes they have in common.
STEP = 8
#: Suffixes that a bucket is meant to have, about as many bytes of text as lie between two anchors, and rows of the sample for each bucket.
BUCKET, SPACING, SAMPLED = 400_000, 39, 64
#: Runs up to this length are sorted at once.
SHORT = 24
_SIGN = np.uint64(1 << 63)


def _tokens(data: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The ``GRAM`` bytes from each position as big-endian tokens, in an order that signed comparison keeps."""
    out = []
    for first in range(0, GRAM, 8):
        token = np.zeros(len(at), np.uint64)
        for j in range(first, first + 8):
            token = (token << np.uint64(8)) | data[at + j].astype(np.uint64)
        out.append((token ^ _SIGN).view(np.int64))
    return out


def _hashes(c: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _, down = powers(len(c))
    return mix((c[ends] - c[starts]) * down[starts])


def anchors(block: Block) -> tuple[np.ndarray, ...]:
    """For each anchor: document, place, tokens of its bytes, hash of the neighbourhood. A place packs the first window, the way from there to the anchor and the number of windows."""
    data, at = block.data, block.at
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < WIDTH:
        return (none,) * (3 + TOKENS)
    c = block.prefix_hash()
    _, down = powers(n + 1)
    starts = n - GRAM + 1
    low = mix((c[GRAM:] - c[:starts]) * down[:starts]) >> np.uint64(32)
    least = (low << np.uint64(32)) | np.arange(starts, dtype=np.uint64)
    span, reach = WIDTH - GRAM + 1, 1
    while 2 * reach <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < span:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    # least[p] is the anchor of the window at p; windows that cross a document's end don't count.
    sound = np.zeros(len(least), bool)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        sound[i : max(i, j - WIDTH + 1)] = True
    windows = np.flatnonzero(sound)
    if not len(windows):
        return (none,) * (3 + TOKENS)
    anchor = (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(at, windows, "right") - 1
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(windows)))
    begin, anchor, doc = windows[first], anchor[first], doc[first]
    around = mix(_hashes(c, begin, begin + count + (WIDTH - 1)) + (count * 256 + anchor - begin).astype(np.uint64))
    return doc, (begin - at[doc]) << 16 | (anchor - begin) << 8 | count, *_tokens(data, anchor), around.view(np.int64)


#: A suffix in the order of the sort: its tokens, its neighbourhood, where it is.
ORDER = [*[f"t{k}" for k in range(TOKENS)], "around", "key", "sub", "place"]
_SUFFIX = ", ".join(f"{c} {'int' if c == 'sub' else 'long'}" for c in ORDER)


def _packed_rows(columns: list[np.ndarray]) -> np.ndarray:
    """Rows of signed columns as byte strings of one length that compare as the rows do."""
    out = np.empty((len(columns[0]), len(columns)), ">u8")
    for k, c in enumerate(columns):
        out[:, k] = c.astype(np.int64).view(np.uint64) ^ _SIGN
    return out.view(f"S{8 * len(columns)}").ravel()


def _suffixes(splitters=None):
    """Suffixes of texts, with the bucket that the broadcast splitters give them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for block in blocks(batch.column(2)):
                doc, place, *rest = anchors(block)
                at = block.first + doc
                columns = [*rest, keys[at], subs[at].astype(np.int32), place]
                bucket = np.searchsorted(splitters.value, _packed_rows(columns), "right").astype(np.int32) if splitters is not None else np.zeros(len(at), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*columns, bucket)], [*ORDER, "bucket"])

    return run


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by several columns, by multikey quicksort.

    All runs take each step together. A run is parted around one of its values in its column
    into less, equal and more; the equal rows go on with the next column. Short runs are
    sorted at once.
    """
    n, depth = len(columns[0]), len(columns)
    order = np.arange(n)
    runs = np.array([[0, n, 0]], np.int64) if n > 1 else np.zeros((0, 3), np.int64)  # start, length, column
    short = []
    while len(runs):
        small = runs[:, 1] <= SHORT
        short.append(runs[small])
        runs = runs[~small]
        if not len(runs):
            break
        starts, sizes, at = runs.T
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(runs)), sizes)
        spots = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        rows = order[spots]
        value = np.empty(len(rows), np.int64)
        for k in np.unique(at):
            here = at[owner] == k
            value[here] = columns[k][rows[here]]
        # The middle one of three values parts a run.
        three = np.sort(np.stack([value[ends - sizes], value[ends - sizes + sizes // 2], value[ends - 1]]), axis=0)
        pivot = three[1][owner]
        side = owner * 3 + (value >= pivot) + (value > pivot)
        by = np.argsort(side, kind="stable")
        order[spots] = rows[by]
        counts = np.bincount(side, minlength=3 * len(runs)).reshape(-1, 3)
        begins = starts[:, None] + np.cumsum(counts, axis=1) - counts
        deeper = at[:, None] + np.array([0, 1, 0])
        runs = np.stack([begins.ravel(), counts.ravel(), deeper.ravel()], axis=1)
        runs = runs[(runs[:, 1] > 1) & (runs[:, 2] < depth)]
    runs = np.concatenate(short) if short else runs
    if len(runs):
        starts, sizes, _ = runs.T
        ends = np.cumsum(sizes)
        spots = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
        rows = order[spots]
        order[spots] = rows[np.lexsort([*[c[rows] for c in reversed(columns)], np.repeat(np.arange(len(runs)), sizes)])]
    return order


_PACKED = "key long, sub int, packed binary"
_FOUND = "key long, sub int, begin long, n int, offset int, first boolean, several boolean, edge int, part int, around long, low long, high long, rows long, " + ", ".join(f"t{k} long" for k in range(TOKENS))
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
HEAD, TAIL = 1, 2


def _bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sort one bucket and judge its suffixes.

    Out come suffixes of repeated anchors (``edge`` 0), those of the groups at the bucket's edges
    (``HEAD``, ``TAIL`` or both), and, with a null key, what is known of the two edge groups.
    """
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got).combine_chunks()
    columns = [table.column(c).to_numpy() for c in ORDER]
    del got, table
    order = multikey_order(columns)
    *tokens, around, key, sub, place = (c[order] for c in columns)
    n = len(around)
    changed = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
    new_group = np.logical_or.reduce([changed(t) for t in tokens])
    new_class = new_group | changed(around)
    group = np.cumsum(new_group) - 1
    starts = np.flatnonzero(new_group)
    sizes = np.diff(np.append(starts, n))
    several = (np.add.reduceat(new_class.astype(np.int64), starts) > 1)[group]
    edge = np.where(group == 0, HEAD, 0) | np.where(group == group[-1], TAIL, 0)
    take = np.flatnonzero((edge > 0) | ~new_class | several)
    part = TaskContext.get().partitionId()
    for at in range(0, len(take), 50_000):
        t = take[at : at + 50_000]
        inner = edge[t] == 0  # neighbourhoods matter at the edges only
        fill = pa.nulls(len(t), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(key[t]), pa.array(sub[t]), pa.array(place[t] >> 16), pa.array((place[t] & 255).astype(np.int32)), pa.array((place[t] >> 8 & 255).astype(np.int32)), pa.array(new_class[t]),
                pa.array(several[t]), pa.array(edge[t].astype(np.int32)), pa.array(np.full(len(t), part, np.int32)), pa.array(around[t], mask=inner), *[fill] * (3 + TOKENS),
            ],
            _FOUND_NAMES,
        )
    rows = []
    for side, g in ((HEAD, 0), (TAIL, len(starts) - 1)):
        i, j = starts[g], starts[g] + sizes[g]
        rows.append((None, None, None, None, None, None, None, side, part, int(around[0] if side == HEAD else around[-1]), int(around[i:j].min()), int(around[i:j].max()), int(sizes[g]), *[int(t[i]) for t in tokens]))
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), *[pa.int64()] * (4 + TOKENS)]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _FOUND_NAMES)


def _across(edges: list) -> list[tuple[int, int, bool, bool, int]]:
    """Compare buckets across boundaries. ``edges``: two rows for each bucket. Returns for each (part, edge): is the group of several neighbourhoods, is its first class begun earlier, and how many rows it has in all."""
    anchor = lambda e: tuple(e[f"t{k}"] for k in range(TOKENS))
    groups: dict[tuple[int, ...], list[int]] = {}
    parts: dict[int, dict[int, object]] = {}
    for e in edges:
        parts.setdefault(e["part"], {})[e["edge"]] = e
    for both in parts.values():
        one = anchor(both[HEAD]) == anchor(both[TAIL])
        for e in [both[HEAD]] if one else both.values():
            g = groups.setdefault(anchor(e), [e["low"], e["high"], 0])
            g[:] = [min(g[0], e["low"]), max(g[1], e["high"]), g[2] + e["rows"]]
    out, last = [], None
    for part in sorted(parts):
        for side in (HEAD, TAIL):
            e = parts[part][side]
            low, high, rows = groups[anchor(e)]
            out.append((part, side, low != high, side == HEAD and last == (anchor(e), e["around"]), rows))
        e = parts[part][TAIL]
        last = (anchor(e), e["around"])
    return out


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows by steps of ``STEP`` that lie alike to their anchor: the hash of the bytes that all windows of the step share, and the hashes of the windows."""
    for batch in batches:
        keys, subs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        wanted = batch.column(3).to_pylist()
        for block in blocks(pa.array([zstandard.decompress(x.as_py()) for x in batch.column(2)], pa.large_binary())):
            c = block.prefix_hash()
            rows = []
            for d in range(len(block)):
                for x in wanted[block.first + d]:
                    anchor, first, last = x["begin"] + x["offset"], x["begin"], x["begin"] + x["n"] - 1
                    for step in range((anchor - last) // STEP, (anchor - first) // STEP + 1):
                        low, high = max(first, anchor - STEP * step - STEP + 1), min(last, anchor - STEP * step)
                        rows.append((d, step, anchor - STEP * step, low, high - low + 1))
            if not rows:
                continue
            d, step, core, low, n = np.array(rows, np.int64).T
            base = block.at[d]
            cores = mix(_hashes(c, base + core, base + core + WIDTH - STEP + 1) + step.astype(np.uint64)).view(np.int64)
            ends = np.cumsum(n)
            begin = np.repeat(base + low - (ends - n), n) + np.arange(int(ends[-1]))
            hashes = pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(_hashes(c, begin, begin + WIDTH).view(np.int64)))
            at = block.first + d
            yield pa.RecordBatch.from_arrays([pa.array(cores), pa.array(keys[at]), pa.array(subs[at].astype(np.int32)), pa.array(low), hashes], ["core", "key", "sub", "begin", "hashes"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for their way through a shuffle."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([squeeze.compress(x.as_py().encode()) for x in batch.column(2)], pa.binary())], ["key", "sub", "packed"])


def _removed(name: str, with_bytes: bool, packed: bool):
    """What is left of texts: packed ones with the spans that go, or others, which stay whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                said = batch.column(1)[k].as_py()
                data = np.frombuffer(zstandard.decompress(said) if packed else said.encode(), np.uint8)
                spans = batch.column(2)[k].values if packed else None
                gone = np.zeros(len(data) + 1, np.int32)
                if spans is not None:
                    np.add.at(gone, spans.field("begin").to_numpy(), 1)
                    np.add.at(gone, spans.field("end").to_numpy(), -1)
                away = np.cumsum(gone)[:-1] > 0
                runs = int(away[0]) + int((away[1:] & ~away[:-1]).sum()) if len(away) else 0
                left = data[~away].tobytes()
                rows.append((len(data), int(away.sum()), runs, hashlib.sha256(left).hexdigest(), *([left] if with_bytes else [])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * (4 + with_bytes)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), *([pa.binary()] if with_bytes else []))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [name, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept_bytes"] if with_bytes else [])])

    return run


def _identified(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, bool]:
    """``key, sub, text`` with ``sub`` telling apart different texts of one key, in the order of their hashes; and whether any key is repeated."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    again = rows.where("key is not null").groupBy("key").count().where("count > 1").select("key")
    again = kept(again, "repeated-keys")
    if again.isEmpty():
        return rows.select("key", F.lit(0).alias("sub"), "text"), False
    hashed = rows.withColumn("th", F.xxhash64("text"))
    order = Window.partitionBy("key").orderBy("th")
    subs = hashed.select("key", "th").join(again, "key").distinct().withColumn("sub", F.row_number().over(order) - 1)
    return hashed.join(subs, ["key", "th"], "left").select("key", F.coalesce("sub", F.lit(0)).alias("sub"), "text"), True


def _splitters(sound: DataFrame, n_bytes: int, buckets: int) -> np.ndarray:
    """Rows that part the suffixes into about equal buckets, from those of a sample of documents, about ``SAMPLED`` rows for each bucket. They and their number grow like those of Spark's own range shuffle."""
    share = max(1, n_bytes // SPACING // (SAMPLED * buckets))
    some = sound.where(F.pmod(F.xxhash64(F.lit("sample"), "key", "sub"), F.lit(share)) == 0)
    got = mapped(some, _suffixes(), _SUFFIX + ", bucket int").drop("bucket").toArrow()
    rows = np.sort(_packed_rows([got.column(c).to_numpy() for c in ORDER])) if got.num_rows else np.zeros(0, f"S{8 * len(ORDER)}")
    return rows[(np.arange(1, buckets) * len(rows)) // buckets] if len(rows) else rows


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """Per row of ``docs``: ``key, n_bytes, n_removed, n_spans, kept_sha256`` and, if wanted, ``kept_bytes``.

    A byte goes if it lies in a string of ``WIDTH`` bytes that also starts earlier: in a smaller
    key, or further up in the same text. Null and empty texts have no bytes, an empty table
    gives an empty one. Different texts of one key are ordered by hash; equal rows count as one
    document and each return its result; rows without a key keep all bytes and count for no
    other. ``key`` must be an integer; other columns are left out, whatever their names.
    Anchors are compared byte by byte, neighbourhoods and single windows by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows, repeated = _identified(docs, key, text)
    sound = rows.where("key is not null")
    if repeated:
        sound = sound.dropDuplicates(["key", "sub"])
    n_bytes = sound.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-n_bytes // SPACING // BUCKET))
    splitters = spark.sparkContext.broadcast(_splitters(sound, n_bytes, buckets))
    dealt = mapped(sound, _suffixes(splitters), _SUFFIX + ", bucket int").repartitionById(buckets, "bucket")
    found = kept(mapped(dealt, _bucket, _FOUND), "suffixes")
    edges = found.where("key is null").select("part", "edge", "around", "low", "high", "rows", *[f"t{k}" for k in range(TOKENS)]).collect()  # two rows for each bucket
    told = {(p, e): (s, b, r) for p, e, s, b, r in _across(edges)}
    # Bounded by the number of buckets: what the edge groups are once their neighbours are known.
    known = F.broadcast(spark.createDataFrame([(p, *told[p, HEAD], *told[p, TAIL]) for p in sorted({p for p, _ in told})], "part int, head_several boolean, head_begun boolean, head_rows long, tail_several boolean, tail_begun boolean, tail_rows long"))
    heads = F.broadcast(found.where(f"key is null and edge = {HEAD}").select("part", F.col("around").alias("head_around")))
    placed = found.where("key is not null").join(known, "part").join(heads, "part")
    at_head, at_tail = F.col("edge").bitwiseAND(HEAD) > 0, F.col("edge") == TAIL
    begun = at_head & F.col("head_begun") & (F.col("around") == F.col("head_around"))
    alone = F.when(at_head, F.col("head_rows")).when(at_tail, F.col("tail_rows")).otherwise(2) < 2
    several = F.when(at_head, F.col("head_several")).when(at_tail, F.col("tail_several")).otherwise(F.col("several"))
    judged = placed.where(~alone).select("key", "sub", "begin", "n", (F.col("first") & ~begun).alias("first"), "offset", several.alias("several"))
    whole = judged.where("not first").select("key", "sub", F.struct("begin", (F.col("begin") + F.col("n") + (WIDTH - 1)).alias("end")).alias("span"))

    row = F.xxhash64("key", "sub")
    unsure = judged.where("first and several").groupBy("key", "sub").agg(F.collect_list(F.struct("begin", "n", "offset")).alias("runs"))  # of one document
    unsure = kept(unsure, "unsure")
    asked = mapped(parted(sound, row, unsure, row)[1], _packed, _PACKED).join(unsure, ["key", "sub"])
    steps = kept(mapped(asked, _window_hashes, "core long, key long, sub int, begin long, hashes array<long>"), "window-steps")
    # Equal windows have equal cores, so a core that occurs once holds no repeated window.
    cores = kept(steps.groupBy("core").count().where("count > 1").select("core"), "cores")
    windows = kept(steps.join(cores, "core").select("core", "key", "sub", F.col("begin").alias("low"), F.posexplode("hashes").alias("i", "hash")).select("core", "hash", "key", "sub", (F.col("low") + F.col("i")).alias("begin")), "windows")
    discard(unsure, steps, cores)
    firsts = kept(windows.groupBy("core", "hash").agg(F.min(F.struct("key", "sub", "begin")).alias("at"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times"), "first-windows")
    later = windows.join(firsts, ["core", "hash"]).where(F.struct("key", "sub", "begin") != F.col("at")).select("key", "sub", F.struct("begin", (F.col("begin") + WIDTH).alias("end")).alias("span"))
    spans = kept(whole.union(later).groupBy("key", "sub").agg(F.collect_list("span").alias("spans")), "spans")  # of one document
    discard(found, windows, firsts)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_bytes binary" if with_bytes else "")
    stay, lose = parted(rows, row, spans, row)
    lose = mapped(lose, _packed, _PACKED).join(spans, ["key", "sub"], "left").select(F.col("key").cast(kind).alias(key), "packed", "spans")
    stay = stay.select(F.col("key").cast(kind).alias(key), "text")
    return mapped(stay, _removed(key, with_bytes, False), schema).unionByName(mapped(lose, _removed(key, with_bytes, True), schema))
