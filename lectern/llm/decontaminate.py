"""Benchmark decontamination as a prefix-filtered set join.

The shingles of items are windows of ``WINDOW`` words; equal ones are one, with a list of items
beside. A window must occur whole, so one word of it is a sufficient prefix: the rarest, by
counts over all documents. Documents bring out those of their words that may be prefixes, each
with the words around it, and these are joined to the windows by the word. What stands before
and behind the word must be long enough and is then compared letter by letter.

Neither items nor documents pass through the driver: both sides of the join are shuffled, at
any size. Only two bit maps of fixed size are broadcast; they spare the shuffles words that no
item holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import bit_map, held_bits, kept
from .textblocks import ALNUM, Block, blocks, lower_ascii
from .workers import mapped

WINDOW = 13

def _words(block: Block) -> tuple[Block, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = Block(lower_ascii(block.data), block.at, block.first)
    starts, ends, first = low.words(ALNUM)
    return low, starts, ends, first, low.span_hashes(starts, ends)


def _windows(window: int):
    """A row for each distinct window of each item: its words joined by blanks, and their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                low, starts, ends, first, h = _words(block)
                said = [low.data[i:j].tobytes().decode() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                signed = h.view(np.int64)
                for d in range(len(block)):
                    i, j = int(first[d]), int(first[d + 1])
                    n = min(window, j - i)
                    found = {" ".join(said[k : k + n]): signed[k : k + n] for k in range(i, j - n + 1)} if n else {}
                    item = batch.column(0).slice(block.first + d, 1)
                    for texts in [list(found)[k : k + 10_000] for k in range(0, len(found), 10_000)]:
                        yield pa.RecordBatch.from_arrays([pa.concat_arrays([item] * len(texts)), pa.array(texts), pa.array([found[t] for t in texts], pa.list_(pa.int64()))], ["item", "window", "hashes"])

    return run


def _counted(bits):
    """Words that items may hold, counted in each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0)):
                h = _words(block)[4]
                values, n = np.unique(h[held_bits(bits.value, h)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n.astype(np.int64))], ["hash", "n"])

    return run


_POST = "key {}, text_hash long, n_words long, hash long, at int, before string, behind string"


def _postings(bits, window: int):
    """For each document a row with its number of words and, for each word that may be a prefix, one with the words before and from it on, each with a blank at both ends."""
    names = [x.split()[0] for x in _POST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                low, starts, ends, first, h = _words(block)
                heads = np.arange(block.first, block.first + len(block))
                fill = [pa.nulls(len(block), t) for t in (pa.int64(), pa.int32(), pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(heads)), batch.column(1).take(pa.array(heads)), pa.array(np.diff(first).astype(np.int64)), *fill], names)
                at = held_bits(bits.value, h)
                doc = np.searchsorted(first, at, "right") - 1
                for k in range(0, len(at), 10_000):
                    some, own = at[k : k + 10_000], doc[k : k + 10_000]
                    low_end, high_end = np.maximum(first[own], some - (window - 1)), np.minimum(first[own + 1], some + window)
                    before, behind = [], []
                    for i, a, j in zip(low_end.tolist(), some.tolist(), high_end.tolist(), strict=True):
                        words = [low.data[starts[x] : ends[x]].tobytes().decode() for x in range(i, j)]
                        before.append(f" {' '.join(words[: a - i])} " if a > i else " ")
                        behind.append(f" {' '.join(words[a - i :])} ")
                    rows = pa.array(own + block.first)
                    columns = [batch.column(0).take(rows), batch.column(1).take(rows), pa.nulls(len(some), pa.int64()), pa.array(h[some].view(np.int64)), pa.array((some - first[own]).astype(np.int32)), pa.array(before), pa.array(behind)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return run


def mark(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``key, n_words, n_hit, n_items, items_sha256, contaminated`` and ``items`` (sorted ids).

    Null and empty texts have no words and are clean; items without words never occur; an
    empty benchmark leaves all clean. Repeated items count once by id; a null id counts as an
    empty one. Each row is judged for itself, repeated rows alike; of equally rare words of a
    window the first is its prefix. Other columns are left out, whatever their names.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(said).alias("text_hash"), said.alias("text"))
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text"))
    of_items = kept(mapped(items, _windows(window), "item string, window string, hashes array<long>"), "item-windows")
    windows = of_items.groupBy("window").agg(F.first("hashes").alias("hashes"))
    parts = kept(windows.select("window", F.posexplode("hashes").alias("offset", "hash")), "window-words")

    known = spark.sparkContext.broadcast(bit_map(parts))
    counts = mapped(rows.select("text"), _counted(known), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    rarest = parts.join(counts, "hash", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "hash")).alias("rarest"))
    words = F.split("window", " ")
    offset = F.col("rarest.offset")
    lead = F.when(offset > 0, F.concat(F.lit(" "), F.array_join(F.slice(words, F.lit(1), offset), " "), F.lit(" "))).otherwise(F.lit(" "))
    rest = F.concat(F.lit(" "), F.array_join(F.slice(words, offset + 1, F.size(words)), " "), F.lit(" "))
    prefixes = kept(rarest.select(F.col("rarest.hash").alias("hash"), "window", offset.alias("offset"), F.size(words).alias("size"), lead.alias("lead"), rest.alias("rest")), "prefixes")

    wanted = spark.sparkContext.broadcast(bit_map(prefixes))
    posted = kept(mapped(rows, _postings(wanted, window), _POST.format(kind)), "postings")
    fits = (F.col("at") >= F.col("offset")) & F.col("before").endswith(F.col("lead")) & F.col("behind").startswith(F.col("rest"))
    hits = posted.where("hash is not null").join(prefixes, "hash").where(fits)
    hits = kept(hits.select("key", "text_hash", "window", (F.col("at") - F.col("offset")).alias("begin"), "size"), "hits")

    # Of one document: its stretches, merged from left to right, and its items.
    stretches = F.sort_array(F.collect_set(F.struct("begin", (F.col("begin") + F.col("size")).alias("end"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("done"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(acc["done"], x["begin"]))).alias("n"), F.greatest(acc["done"], x["end"]).alias("done"))
    covered = hits.groupBy("key", "text_hash").agg(stretches.alias("s")).select("key", "text_hash", F.aggregate("s", start, step)["n"].cast("long").alias("n_hit"))
    named = hits.select("key", "text_hash", "window").distinct().join(of_items.select("window", "item"), "window").groupBy("key", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    same = F.col("c.key").eqNullSafe(F.col("i.key")) & (F.col("c.text_hash") == F.col("i.text_hash"))
    found = kept(covered.alias("c").join(named.alias("i"), same).select("c.key", "c.text_hash", "n_hit", "items"), "contaminations")

    heads = posted.where("n_words is not null").select("key", "text_hash", "n_words")
    same = F.col("h.key").eqNullSafe(F.col("f.key")) & (F.col("h.text_hash") == F.col("f.text_hash"))
    out = heads.alias("h").join(found.alias("f"), same, "left")
    n_hit, names = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("h.key").alias(key), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), names.alias("items"),
    )
