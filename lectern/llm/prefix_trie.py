"""The trie of conversations' common beginnings, from a global sort of their turns.

A turn is 16 bytes of the sha256 of its role and text, a conversation the row of its turns'
digests. These rows are range-sorted over all tasks. Each task sweeps its rows once: what two
neighbours have in common (their LCP) says which nodes of a stack end, and a node that ends
hands its sums to the one below. Nodes on the path to a task's first or last row may go on in
other tasks: they leave the task as open stacks, which are stitched in the order of the tasks,
``FAN`` stacks at a time, by the same sweep. Only digests are sorted; texts stay where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import kept
from .workers import mapped

#: Bytes of a turn, stacks that are stitched at once, children and bytes of ids that a task holds for one node, parts of a parent with many children.
WIDTH, FAN, HELD, CHUNK, SALTS = 16, 64, 8192, 1 << 16, 16
_NOTHING = hashlib.sha256(b"").digest()

_FIELDS = [("kind", pa.int32()), ("run", pa.int64()), ("side", pa.int32()), ("depth", pa.int64()), ("name", pa.binary()), ("parent", pa.binary()), ("step", pa.binary()), ("words", pa.int64()), ("is_open", pa.bool_()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.binary())]
_SCHEMA = "kind int, run long, side int, depth long, name binary, parent binary, step binary, words long, is_open boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends binary"
#: Kinds of rows: a node whose parent is known, one whose parent is open, an open node of a stack, ids of an open node.
NODE, CHILD, OPEN, IDS = range(4)


def packed(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, steps, words``: each conversation's turns in order, as digests end to end and as 32-bit numbers of words.

    Null turn numbers come first; equal numbers go by digest. Null roles and texts are empty;
    rows without a conversation are left out. A conversation's digests have to fit into a task.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    whole = F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)
    one = F.struct(F.col(turn).cast("long").alias("turn"), F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, WIDTH).alias("step"), F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    rows = conversations.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("conv_id"), one.alias("turn")).groupBy("conv_id").agg(F.collect_list("turn").alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, words = [], []
            for turns in batch.column(1).to_pylist():
                own = sorted((x["turn"] is not None, x["turn"] or 0, x["step"], x["words"]) for x in turns)
                steps.append(b"".join(x[2] for x in own))
                words.append(np.array([x[3] for x in own], "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(steps, pa.binary()), pa.array(words, pa.binary())], ["conv_id", "steps", "words"])

    return mapped(rows, run, "conv_id long, steps binary, words binary")


def rebuilt(rows: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Packed conversations that begin as the first of their group: of c the first h turns of c - c % ``group`` (all if fewer, none if absent), then c's own after its first h; h = crc32(decimal c) % ``most``."""
    first = rows.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_first"), F.substring("steps", 1, WIDTH * most).alias("_steps"), F.substring("words", 1, 4 * most).alias("_words"))
    own = rows.withColumn("_first", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    joined = own.join(first, "_first", "left")

    def spliced(name: str, width: int) -> Column:
        before = F.substring(F.coalesce(F.col(f"_{name}"), F.lit(b"")), F.lit(1), F.col("_h") * width)
        return F.concat(before, F.substring(F.col(name), F.col("_h") * width + 1, F.greatest(F.octet_length(name) - F.col("_h") * width, F.lit(0)))).alias(name)

    return joined.select("conv_id", spliced("steps", WIDTH), spliced("words", 4))


class _Node:
    """An open node of a stack: its last turn, and the sums over what has ended below it."""

    __slots__ = ("step", "words", "is_open", "name", "n", "least", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, step: bytes, words: int, is_open: bool, name: bytes | None = None):
        self.step, self.words, self.is_open, self.name = step, words, is_open, name
        self.n = self.children = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ends: bytes | None = None
        self.waiting: list[tuple] = []  # ended children, whose rows need this node's smallest member

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least


def _names(steps: Iterable[bytes]) -> list[bytes]:
    """A name for every beginning of the path, the root's first."""
    hashed = hashlib.blake2b(digest_size=WIDTH)
    out = []
    for step in steps:
        hashed.update(step)
        out.append(hashed.digest())
    return out


class _Sweep:
    """The stack of one run of rows, or of stacks. The path to the first row is open on the left: what ends there is set aside."""

    def __init__(self, run: int):
        self.run, self.stack, self.left, self.rows = run, [], [], []

    def row(self, kind: int, **values) -> None:
        self.rows.append((kind, self.run, *[values.get(name) for name, _ in _FIELDS[2:]]))

    def close(self, depth: int) -> None:
        """End all nodes deeper than ``depth``."""
        stack = self.stack
        while len(stack) - 1 > depth:
            node = stack.pop()
            if node.is_open:
                self.left.append((len(stack), node))
                continue
            leaves, saved = node.leaves or 1, node.saved + (node.n - 1) * node.words
            own = {"depth": len(stack), "name": node.name, "conv_id": node.least, "n_convs": node.n, "n_children": node.children, "n_leaves": leaves, "saved": saved, "ends": node.ends}
            self.known(node)
            if stack:
                below = stack[-1]
                below.add(node.n, node.least, 1, leaves, saved)
                below.waiting.append(own)
                if len(below.waiting) >= HELD:
                    self.unknown(below, len(stack) - 1)
            else:
                self.row(NODE, **own)

    def known(self, node: _Node) -> None:
        for child in node.waiting:
            self.row(NODE, parent_conv_id=node.least, **child)
        node.waiting = []

    def unknown(self, node: _Node, depth: int) -> None:
        """Rows of ended children whose parent may go on: they name it."""
        if node.waiting and node.name is None:
            node.name = _names(x.step for x in self.stack[: depth + 1])[-1]
        for child in node.waiting:
            self.row(CHILD, parent=node.name, **child)
        node.waiting = []

    def open_stacks(self) -> None:
        """Rows of what is open when the run is over: the path to its first row as far as it ended, then the stack."""
        for side, nodes in ((0, self.left), (1, [*enumerate(self.stack)])):
            for depth, node in nodes:
                self.unknown(node, depth)
                self.row(OPEN, side=side, depth=depth, name=node.name, step=node.step, words=node.words, is_open=node.is_open, conv_id=node.least, n_convs=node.n, n_children=node.children, n_leaves=node.leaves, saved=node.saved, ends=node.ends)

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = [*zip(*rows, strict=True)] if rows else [[]] * len(_FIELDS)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [n for n, _ in _FIELDS])


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sorted rows. The ids that end at a node come one after another, so they are hashed as they come; those at the task's edges are handed on as bytes."""
    sweep = _Sweep(TaskContext.get().partitionId())
    before: bytes | None = None
    ids: list[bytes] = []  # of the node at which the last rows ended
    size = part = 0
    hashed = hashlib.sha256()

    def hand_on() -> None:
        nonlocal ids, size, part
        if ids:
            sweep.row(IDS, depth=part, name=hashlib.blake2b(before, digest_size=WIDTH).digest(), ends=b",".join(ids))
            ids, size, part = [], 0, part + 1

    for batch in batches:
        for conv, steps, words in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
            if steps != before:
                if before is not None:
                    top = sweep.stack[-1]
                    if top.is_open:  # the first row's own node
                        hand_on()
                    else:
                        top.ends = hashed.digest()
                depth, most = 0, len(steps) // WIDTH
                if before is None:
                    sweep.stack.append(_Node(b"", 0, True))
                else:
                    shared = min(most, len(before) // WIDTH)
                    while depth < shared and steps[WIDTH * depth : WIDTH * depth + WIDTH] == before[WIDTH * depth : WIDTH * depth + WIDTH]:
                        depth += 1
                    sweep.close(depth)
                counts = np.frombuffer(words, "<i4").tolist()
                sweep.stack += [_Node(steps[WIDTH * d : WIDTH * d + WIDTH], counts[d], before is None) for d in range(depth, most)]
                if before is None:
                    for node, name in zip(sweep.stack, _names(x.step for x in sweep.stack), strict=True):
                        node.name = name
                before, ids, size, part, hashed = steps, [], 0, 0, hashlib.sha256()
            said = str(conv).encode()
            hashed.update(said if not size and not part else b"," + said)
            ids.append(said)
            size += len(said) + 1
            if size >= CHUNK:
                hand_on()
            sweep.stack[-1].add(1, conv, 0, 0, 0)
        yield sweep.taken()
    if before is not None:
        hand_on()
        for node, name in zip(sweep.stack, _names(x.step for x in sweep.stack), strict=True):
            node.name = name
        sweep.open_stacks()
        yield sweep.taken()


def _stitched(whole: bool) -> Callable[[pa.Table], pa.Table]:
    """Sweep the open stacks of neighbouring runs in order. ``whole``: they are all there are, so that nothing stays open."""

    def run(table: pa.Table) -> pa.Table:
        runs: dict[int, tuple[list[dict], list[dict]]] = {}
        for row in sorted(table.to_pylist(), key=lambda r: (r["run"], r["side"], r["depth"])):
            runs.setdefault(row["run"], ([], []))[row["side"]].append(row)
        sweep = _Sweep(min(runs) // FAN)

        def push(rows: list[dict], is_open: bool) -> None:
            for r in rows:
                node = _Node(r["step"], r["words"], is_open, r["name"])
                node.add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved"])
                node.ends = r["ends"]
                sweep.stack.append(node)

        for number, (left, stack) in enumerate(runs.values()):
            both = sum(r["is_open"] for r in stack)  # on the paths to the first and to the last row
            first = stack[:both] + left
            shared = 0
            while shared < min(len(first), len(sweep.stack)) and first[shared]["step"] == sweep.stack[shared].step:
                shared += 1
            sweep.close(shared - 1)
            for node, r in zip(sweep.stack, first[:shared], strict=True):
                node.add(r["n_convs"], r["conv_id"], r["n_children"], r["n_leaves"], r["saved"])
                node.ends = node.ends or r["ends"]
            push(first[shared:], number == 0 and not whole)
            sweep.close(both - 1)
            push(stack[both:], False)
        if whole:
            sweep.close(-1)
        else:
            sweep.open_stacks()
        return pa.Table.from_batches([sweep.taken()])

    return run


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by name, run and part: one hash for each name, over its ids joined by commas. Nothing is gathered."""
    name, hashed = None, hashlib.sha256()
    for batch in batches:
        out = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != name:
                if name is not None:
                    out.append((name, hashed.digest()))
                name, hashed = own, hashlib.sha256(ids)
            else:
                hashed.update(b"," + ids)
        yield _hash_rows(out)
    if name is not None:
        yield _hash_rows([(name, hashed.digest())])


def _hash_rows(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1)], ["name", "_ends"])


def nodes(rows: DataFrame) -> DataFrame:
    """Per node of the trie of packed conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    A node is a distinct sequence of first turns, from the empty one; ``conv_id`` its smallest
    member, ``n_convs`` its members, ``n_leaves`` the childless nodes in its subtree,
    ``saved_tokens`` the sum over its subtree of (members - 1) times the words of the node's last
    turn, ``ends_sha256`` of the ascending ids of members that end there, joined by commas (as in
    the sha256 of an empty string where none does). No conversations, no nodes.
    """
    ordered = rows.select("conv_id", "steps", "words").repartitionByRange("steps", "conv_id").sortWithinPartitions("steps", "conv_id")
    swept = kept(mapped(ordered, _swept, _SCHEMA), "swept")
    done = swept.where(F.col("kind").isin(NODE, CHILD))
    stacks, last = swept.where(F.col("kind") == OPEN), swept.agg(F.max("run")).first()[0] or 0
    while True:
        whole = last < FAN
        stitched = kept(stacks.groupBy(F.expr(f"run div {FAN}").alias("_group")).applyInArrow(_stitched(whole), _SCHEMA), "stitched")
        done = done.unionByName(stitched.where(F.col("kind").isin(NODE, CHILD)))
        if whole:
            break
        stacks, last = stitched.where(F.col("kind") == OPEN), last // FAN
    # Children of nodes that were open, and the ids that ended at these, by name.
    named = done.where("name is not null").select(F.col("name").alias("parent"), F.col("conv_id").alias("_parent_id"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    children = done.where(F.col("kind") == CHILD).withColumn("_salt", F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int"))
    children = children.join(named.select("parent", "_parent_id", salt), ["parent", "_salt"]).withColumn("parent_conv_id", F.col("_parent_id"))
    parted = swept.where(F.col("kind") == IDS).select("name", "run", F.col("depth").alias("part"), "ends").repartition("name").sortWithinPartitions("name", "run", "part")
    ended = mapped(parted.select("name", "ends"), _hashed_ids, "name binary, _ends binary")
    plain = [c for c, _ in _FIELDS]
    both = done.where(F.col("kind") == NODE).select(plain).unionByName(children.select(plain))
    hidden = both.where("name is not null and ends is null").join(ended, "name", "left").withColumn("ends", F.coalesce("_ends", F.lit(_NOTHING))).select(plain)
    out = both.where("name is null or ends is not null").unionByName(hidden)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.lower(F.hex(F.coalesce("ends", F.lit(_NOTHING)))).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True) -> DataFrame:
    """The nodes of ``conversations``, rebuilt by groups first if ``rebuild``; columns as of :func:`nodes`.

    Turns go by number, null first, equal ones in a fixed order; null roles and texts are empty;
    repeated rows are turns of their own; rows without a conversation are left out; texts of any
    length count whole. An empty table has no nodes; other columns are left out.
    """
    rows = packed(conversations, key, turn, role, text)
    return nodes(rebuilt(kept(rows, "packed")) if rebuild else rows)
