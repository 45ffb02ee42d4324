"""Lloyd clusters, line dedup and the prefix trie against brute force, over many partitions and odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import line_dedup, lloyd, prefix_trie
from lectern.llm.storage import new_path


@pytest.fixture
def many(spark):
    """Ranges and shuffles stay in as many partitions as they are dealt to."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def lloyd_by_hand(rows, k, rounds, size):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, [min(max(x, -lloyd.LARGEST), lloyd.LARGEST) for x in v]) for i, v in good]
    packed = lambda v: np.array(v, "<i4").tobytes()
    centroids = [v for _, v in sorted(good, key=lambda x: (hashlib.sha256(f"3:{'' if x[0] is None else x[0]}".encode()).hexdigest(), packed(x[1])))[:k]]

    def assigned():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)) for _, v in good]

    for _ in range(rounds):
        own = assigned()
        for c in range(len(centroids)):
            mine = [v for (_, v), (_, n) in zip(good, own, strict=True) if n == c]
            if mine:
                centroids[c] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assigned()
    sums = Counter()
    for d, n in own:
        sums[n] += d
    return Counter((i, n, d, sums[n], sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for (i, _), (d, n) in zip(good, own, strict=True))


@pytest.mark.parametrize("n", [0, 3, 120])
def test_lloyd(spark, n):
    """Negative sums, ties, equal vectors, too few vectors, null ids beside ones that no double holds, and vectors that don't count."""
    rng = random.Random(n)
    rows = [(k + (1 << 60), [rng.choice([rng.uniform(-2, 2), -0.5, 0.0]) for _ in range(4)]) for k in range(n)] + [(7, [0.1] * 4)] * min(n, 60)
    rows += [(None, [0.1, 0.2, 0.3, 0.4]), (None, [1e300, -1e9, 2.0, 3.0])] * min(n, 1)
    rows += [(900, None), (901, [1.0] * 3), (902, [1.0] * 5), (903, [1.0, None, 1.0, 1.0]), (904, [1.0, math.nan, 1.0, 1.0]), (905, [math.inf, 1.0, 1.0, 1.0]), (906, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5).withColumns({"v": F.lit("?"), "cluster": F.lit("?"), "_order": F.lit("?")})
    got = lloyd.clusters(df, k=5, rounds=4, dimensions=4)
    assert Counter(map(tuple, got.collect())) == lloyd_by_hand(rows, 5, 4, 4)


def lines_by_hand(rows, least):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    split = [(i, (t or "").split("\n")) for i, t in rows]
    seen = Counter(k for _, lines in split for k in {key(x) for x in lines} if k)
    out = []
    for i, lines in split:
        left = [x for x in lines if seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest()))
    return Counter(out)


def line_rows(n=60):
    rng = random.Random(5)
    said = ["Cookies  here", " COOKIES  here\t", "é À", "É À", "\x0bend\r", "", "   ", "a\x00b", "ß", "x" * 5000, *[f"line {k}" for k in range(30)]]
    rows = [(k, "\n".join(rng.choice(said) for _ in range(rng.randint(0, 12)))) for k in range(n)]
    return rows + [(3, "line 1\nline 1"), (3, "line 1\nline 1"), (None, None), (None, "line 2\n"), (8, ""), (9, "only here\n" * 400), (9, "line 3\n" * 20_000)]


@pytest.mark.parametrize(("few", "least"), [(1 << 20, 5), (0, 5)])
def test_lines(spark, monkeypatch, few, least):
    """Lines sent to all tasks or joined by a shuffle, tasks that hand on early, several batches and levels: the same rows."""
    monkeypatch.setattr(line_dedup, "FEW", few)
    monkeypatch.setattr(line_dedup, "HELD", 7)
    df = spark.createDataFrame(line_rows(), "doc_id long, text string").repartition(6).withColumns({c: F.lit("?") for c in ("hi", "lo", "n", "batch", "_text", "_batch")})
    got = line_dedup.deduplicated(df, least=least, batches=3, fanout=2, with_text=True)
    rows = got.collect()
    assert Counter((r[0], r[1], r[2], r[3]) for r in rows) == lines_by_hand(line_rows(), least)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)


def test_no_lines(spark):
    assert line_dedup.deduplicated(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_are_opened_again(spark):
    """Levels after each batch, a store opened from its manifest, and one whose new manifest was never put in place."""
    folder = new_path(spark, "test-runs")
    store = line_dedup.LineRuns(spark, folder, least=3, fanout=2, buckets=3)
    want = Counter()
    rng = random.Random(1)
    for batch in range(5):
        own = Counter((rng.randrange(12), 1) for _ in range(10))
        for (hi, _), n in own.items():
            want[hi] += n
        store.add(spark.createDataFrame([(hi, lo, n) for (hi, lo), n in own.items()], "hi long, lo long, n long"))
        assert all(len(level) < 2 for level in store.state["levels"])
        if batch == 2:
            for run in store.runs():
                spark.sql(f"DROP TABLE `{run}`")
            store._files.create(store._path("manifest.new"), True).close()
            store = line_dedup.LineRuns(spark, folder)
            assert store.state["least"] == 3
    assert {r["hi"] for r in store.common().collect()} == {hi for hi, n in want.items() if n >= 3}
    assert sum(map(len, store.state["levels"])) == 2 and len(store.state["levels"]) == 3
    store.delete()


def trie_by_hand(rows, rebuild=True):
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            step = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()[:16]
            said[conv].append((turn is not None, turn or 0, step, len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    if rebuild:
        h = lambda c: zlib.crc32(str(c).encode()) % 4
        said = {c: said.get(c - c % 20, [])[: h(c)] + v[h(c) :] for c, v in said.items()}
    members, children, leaves, saved = defaultdict(list), Counter(), Counter(), Counter()
    for c, v in said.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * k[-1][1] if k else 0
    ends = lambda k, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(said[c]) == len(k)))).encode()).hexdigest()
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in range(160):
        if rng.random() < 0.3:
            rows += [(c, t, "user", f"copy {t}") for t in range(3)]  # a large group of copies
        elif rng.random() < 0.1:
            rows.append((c, 0, None, None))
        else:
            rows += [(c, t if t else None, rng.choice(["user", "assistant"]), " ".join(["word"] * rng.randint(0, 2))) for t in range(rng.randint(1, 7))]
    rows += [(500, t, "user", f"long {t // 2}") for t in range(1500)] + [(501, t, "user", f"long {t // 2}") for t in range(900)]
    return rows + [(None, 1, "user", "nobody's"), (20, 1, "user", "again"), (20, 1, "user", "again")]


@pytest.mark.parametrize(("rebuild", "parts", "fan", "held", "chunk"), [(True, 9, 2, 2, 8), (False, 12, 64, 8192, 1 << 16)])
def test_trie(spark, monkeypatch, many, rebuild, parts, fan, held, chunk):
    """One task or many, several levels of stitching, nodes whose children and ids are handed on early: the same nodes."""
    for name, value in (("FAN", fan), ("HELD", held), ("CHUNK", chunk)):
        monkeypatch.setattr(prefix_trie, name, value)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        rows = conversations(parts)
        df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("?") for c in ("steps", "words", "name", "run", "depth", "_first")})
        got = prefix_trie.prefix_trie(df, rebuild=rebuild)
        assert Counter(map(tuple, got.collect())) == trie_by_hand(rows, rebuild)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_conversation_without_turns_left(spark):
    """Conversation 3 gives its only turn away (h = 3, and its group has no first one): it ends at the root."""
    rows = [(c, 0, "user", "hello there") for c in (3, 5, 60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = prefix_trie.prefix_trie(df).collect()
    assert Counter(map(tuple, got)) == trie_by_hand(rows)
    assert any(zlib.crc32(str(c).encode()) % 4 for c in (3, 5))
