"""Lines that many documents have, by levelled sorted runs of line hashes.

The runs are Parquet tables of ``hi, lo, n``: a line's 128-bit hash and in how many documents
of a batch it was, dealt into buckets by the hash and sorted in each, so that runs meet bucket
by bucket without a shuffle. A new batch anti-joins the runs' lines that are already common and
adds the others as a run of level 0; ``fanout`` runs of one level are merged into one of the
next. A manifest beside the runs names those that count, so a store can be opened again and a
crash between writing and naming leaves it as it was.

A line's documents are the sum over all runs. Lines are left out of a run only where another
run alone has enough documents, so which lines are common never depends on the batches.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import kept, new_path, partitions
from .textblocks import blocks
from .workers import mapped

#: White space that does not belong to a line's key.
SPACE = b" \t\n\x0b\x0c\r"
#: Documents that make a line common, runs of a level that are merged, batches of a query.
LEAST, FANOUT, BATCHES = 10, 3, 4
#: Distinct lines that a task counts before it hands them on, and most common lines that are sent to all tasks (16 bytes each).
HELD, FEW = 200_000, 1 << 20


def keys(text: bytes) -> list[bytes]:
    """The key of each line: without white space at its ends, A-Z in small letters."""
    return [line.strip(SPACE) for line in text.lower().split(b"\n")]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _halves(digests: list[bytes]) -> list[pa.Array]:
    both = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
    return [pa.array(both[:, 0]), pa.array(both[:, 1])]


def counted(docs: DataFrame, batch: str, text: str = "text") -> DataFrame:
    """``batch, hi, lo, n``: in how many rows of each batch every line is that has a key; several rows for one line of several tasks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[int, bytes]] = Counter()

        def out() -> pa.RecordBatch:
            rows = [*held]
            columns = [pa.array([b for b, _ in rows], pa.int32()), *_halves([d for _, d in rows]), pa.array([*held.values()], pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, ["batch", "hi", "lo", "n"])

        for part in parts:
            owner = part.column(0).to_pylist()
            for block in blocks(part.column(1)):
                for d in range(len(block)):
                    held.update([(owner[block.first + d], digest(k)) for k in {*keys(block.text(d))} if k])
                    if len(held) >= HELD:
                        yield out()
        yield out()

    return mapped(docs.select(F.col(batch).cast("int"), F.col(text).cast("string")), run, "batch int, hi long, lo long, n long")


class LineRuns:
    """The store: runs by level, as tables under ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, least: int = LEAST, fanout: int = FANOUT, buckets: int | None = None):
        """Open the store at ``folder``, or start one. A store keeps the least number of documents and the buckets that it was started with."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self._files = self._path("x").getFileSystem(spark._jsc.hadoopConfiguration())
        said = self._read("manifest.json")
        self.state = json.loads(said) if said else {"least": least, "fanout": fanout, "buckets": buckets or partitions(spark), "levels": []}
        for run in self.runs():
            if not spark.catalog.tableExists(run):
                self._register(run)

    def runs(self) -> list[str]:
        return [run for level in self.state["levels"] for run in level]

    def add(self, lines: DataFrame) -> None:
        """Add one batch: distinct ``hi, lo`` with their number of documents ``n``. Lines that a run alone shows to be common are left out."""
        new = lines.select("hi", "lo", "n")
        for run in self.runs():
            known = self.spark.table(run).where(F.col("n") >= self.state["least"]).select("hi", "lo")
            new = new.join(known, ["hi", "lo"], "left_anti")
        levels = [[*level] for level in self.state["levels"]] or [[]]
        levels[0].append(self._write(new))
        self._name(levels)
        self._compact()

    def totals(self) -> DataFrame:
        """``hi, lo, n`` over all runs."""
        return self._merged(self.runs())

    def common(self) -> DataFrame:
        return self.totals().where(F.col("n") >= self.state["least"]).select("hi", "lo")

    def delete(self) -> None:
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS `{run}`")
        self._files.delete(self._path(""), True)

    def _merged(self, runs: list[str]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], "hi long, lo long, n long")
        # Merged bucket by bucket as joins; a union of bucketed tables may pass for one that is dealt by their key, which it is not.
        both = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).withColumnRenamed("n", "_n")
            both = both.join(other, ["hi", "lo"], "full_outer").select("hi", "lo", (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"))
        return both

    def _compact(self) -> None:
        """Merge each full level into a run of the next. The new run is named before the old ones go."""
        level = 0
        while level < len(self.state["levels"]):
            full = self.state["levels"][level]
            if len(full) >= self.state["fanout"]:
                levels = [[*x] for x in self.state["levels"]] + ([[]] if level + 1 == len(self.state["levels"]) else [])
                levels[level] = []
                levels[level + 1].append(self._write(self._merged(full)))
                self._name(levels)
                for run in full:
                    self.spark.sql(f"DROP TABLE IF EXISTS `{run}`")
                    self._files.delete(self._path(run), True)
            level += 1

    def _write(self, rows: DataFrame) -> str:
        run = f"line_run_{uuid.uuid4().hex}"
        rows = rows.repartition(self.state["buckets"], "hi", "lo")
        rows.write.option("path", f"{self.folder}/{run}").bucketBy(self.state["buckets"], "hi", "lo").sortBy("hi", "lo").saveAsTable(run)
        return run

    def _register(self, run: str) -> None:
        self.spark.sql(f"CREATE TABLE `{run}` (hi BIGINT, lo BIGINT, n BIGINT) USING parquet CLUSTERED BY (hi, lo) SORTED BY (hi, lo) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/{run}'")

    def _read(self, name: str) -> str:
        if not self._files.exists(self._path(name)):
            return ""
        return self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0]  # a list of names

    def _name(self, levels: list[list[str]]) -> None:
        """Write the manifest beside the old one, then put it in its place."""
        self.state = self.state | {"levels": levels}
        out = self._files.create(self._path("manifest.new"), True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if self._files.exists(self._path("manifest.json")):
            self._files.delete(self._path("manifest.json"), False)
        self._files.rename(self._path("manifest.new"), self._path("manifest.json"))


def _cleaned(text: bytes, gone: Callable[[list[bytes]], np.ndarray]) -> tuple[int, int, bytes]:
    """Number of lines, of dropped ones, and the text without them. ``gone`` judges digests; lines without a key stay."""
    own = keys(text)
    at = [k for k, x in enumerate(own) if x]
    drop = np.flatnonzero(gone([digest(own[k]) for k in at])) if at else np.zeros(0, int)
    if not len(drop):
        return len(own), 0, text
    stay = np.ones(len(own), bool)
    stay[np.array(at)[drop]] = False
    return len(own), len(drop), b"\n".join([line for line, good in zip(text.split(b"\n"), stay.tolist(), strict=True) if good])


def without(docs: DataFrame, common: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Rows without their lines of ``common`` (``hi, lo``): ``key, n_lines, n_dropped, kept_sha256`` and, if asked for, the ``text`` that is left.

    Up to ``FEW`` common lines go to all tasks and no text is moved; more of them are joined to
    the distinct texts' lines by a shuffle. Both ways give the same rows.
    """
    kind = docs.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    names = [key, "n_lines", "n_dropped", "kept_sha256"] + (["text"] if with_text else [])
    schema = f"`{key}` {kind}, n_lines long, n_dropped long, kept_sha256 string" + (", text string" if with_text else "")
    few = common.count() <= FEW
    if few:
        hashes = common.toPandas()  # FEW rows at most
        known = np.sort(_packed(hashes["hi"].to_numpy(), hashes["lo"].to_numpy()))
        sent = docs.sparkSession.sparkContext.broadcast(known)
        rows = docs.select(F.col(key), body)
    else:
        texts = docs.select(F.unhex(F.md5(body)).alias("_text"), body.alias("_body"))
        found = mapped(texts, _lines_of, "_text binary, hi long, lo long").join(common, ["hi", "lo"], "left_semi").distinct()
        lists = found.groupBy("_text").agg(F.collect_list("hi").alias("_hi"), F.collect_list("lo").alias("_lo"))  # the lines of one text
        rows = docs.select(F.col(key), body.alias("_body"), F.unhex(F.md5(body)).alias("_text")).join(lists, "_text", "left").select(key, "_body", "_hi", "_lo")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block in blocks(batch.column(1)):
                for d in range(len(block)):
                    own = sent.value if few else np.sort(_packed(*(np.array(batch.column(c)[block.first + d].as_py() or [], np.int64) for c in (2, 3))))
                    n, dropped, left = _cleaned(block.text(d), lambda digests, own=own: _held(own, digests))
                    out.append((n, dropped, hashlib.sha256(left).hexdigest(), left) if with_text else (n, dropped, hashlib.sha256(left).hexdigest()))
            columns = [*zip(*out, strict=True)] if out else [[]] * (len(names) - 1)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [pa.array(c if t != pa.string() or k < 3 else [x.decode() for x in c], t) for k, (c, t) in enumerate(zip(columns, types, strict=False))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    return mapped(rows, run, schema)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in blocks(batch.column(1)):
            for d in range(len(block)):
                own = [digest(k) for k in {*keys(block.text(d))} if k]
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[block.first + d].as_py()] * len(own), pa.binary()), *_halves(own)], ["_text", "hi", "lo"])


def _packed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Digests of 16 bytes each from their halves."""
    return np.column_stack([hi, lo]).astype(">i8").reshape(-1).view("S16")


def _held(known: np.ndarray, digests: list[bytes]) -> np.ndarray:
    """Which digests are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(digests), bool)
    own = np.frombuffer(b"".join(digests), "S16")
    return known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own


def deduplicated(docs: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", batches: int = BATCHES, fanout: int = FANOUT, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``key, n_lines, n_dropped, kept_sha256``: lines of keys found in ``least`` documents or more go, in every document.

    Each row is a document, repeated rows too. Lines are cut at \\n; a null or empty text is one
    empty line; lines without a key (white space only) stay. An empty table gives an empty one;
    null keys are kept; other columns are left out, whatever their names. ``batches``: the rows
    are added to the runs in so many batches, dealt by key; they don't change the result.
    """
    spark = docs.sparkSession
    store = LineRuns(spark, new_path(spark, "line-runs"), least, fanout)
    staged = counted(docs.select(F.pmod(F.xxhash64(key), F.lit(batches)).alias("_batch"), text), "_batch", text)
    staged = staged.repartition(store.state["buckets"], "hi", "lo").groupBy("batch", "hi", "lo").agg(F.sum("n").alias("n"))
    name = f"line_batches_{uuid.uuid4().hex}"
    path = new_path(spark, "line-batches")
    staged.write.option("path", path).partitionBy("batch").bucketBy(store.state["buckets"], "hi", "lo").sortBy("hi", "lo").saveAsTable(name)
    for batch in range(batches):
        store.add(spark.table(name).where(F.col("batch") == batch))
    common = kept(store.common(), "common-lines")
    store.delete()
    spark.sql(f"DROP TABLE `{name}`")
    store._files.delete(spark._jvm.org.apache.hadoop.fs.Path(path), True)
    return without(docs, common, key, text, with_text)
