"""Retrieval on small tables whose answers are known."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lectern import catalog, settings
from lectern.operators import analytics as A
from lectern.operators import retrieval as R
from lectern.operators import near_terms as N
from lectern.operators import sync as Y
from lectern.operators import term_index as X
from lectern.operators.shared import text_slices
from lectern.operators.vector_index import CellIndex
from lectern.streaming import changes

DOCS = [
    (1, "L'énergie du dépôt créé à Évry : les études environnementales."), (2, "Une étude de l’énergie éolienne, des chevaux et des travaux."), (3, "日本 の エネルギー"), (4, None), (5, ""), (6, "the wind of the north"),
]


def test_terms_of_any_script(spark):
    rows = {r["k"]: r for r in spark.createDataFrame(DOCS, "k int, t string").select("k", R.terms(F.col("t")).alias("plain"), R.french_terms(F.col("t")).alias("french")).collect()}
    assert rows[1]["plain"] == "l energie du depot cree a evry les etudes environnementales".split()
    assert rows[1]["french"] == ["energ", "depot", "cree", "evry", "etud", "environemental"]
    assert rows[2]["french"] == ["etud", "energ", "eolien", "cheval", "traval"]
    assert rows[3]["plain"] == ["日本", "の", "エネルキー"] and rows[4]["plain"] == [] and rows[5]["french"] == []


def test_scores_by_hand(spark):
    """Weights of one field against the formula, with a null and an empty text among the documents."""
    docs = spark.createDataFrame(DOCS, "doc_id int, text string")
    asked = spark.createDataFrame([(1, "énergie wind absent"), (2, ""), (3, None)], "item_id int, text string")
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in R.bm25(docs, asked).collect()}
    words = {1: 10, 2: 11, 3: 3, 6: 5}
    mean = sum(words.values()) / len(words)
    weight = lambda df, dl: math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) / (1 + 1.2 * (0.25 + 0.75 * dl / mean))
    want = {(1, 1): weight(2, 10), (1, 2): weight(2, 11), (1, 6): weight(1, 5)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_near_terms_and_fields(spark):
    docs = spark.createDataFrame([(1, "turbine", "a.pdf"), (2, "turbines", "b.pdf"), (3, "turban", "turbine.pdf")], "doc_id int, text string, file_name string")
    asked = spark.createDataFrame([(1, "turbine")], "item_id int, text string")
    plain = (R.Field("text", 1.0, R.terms), R.Field("file_name", 10.0, R.terms))
    exact = {r["doc_id"] for r in R.search(docs, asked, plain).collect()}
    near = {r["doc_id"]: r["score"] for r in R.search(docs, asked, plain, fuzzy=True).collect()}
    assert exact == {1, 3} and set(near) == {1, 2, 3} and near[3] == max(near.values()) and near[1] > near[2]


def test_nearest_vectors(spark):
    """Blocks against all pairs, with ties, zero and null vectors."""
    rng = np.random.default_rng(3)
    v = rng.integers(-2, 3, (300, 6)).astype(float)
    v[7] = 0
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(999, None)], "vec_id long, embedding array<double>").repartition(5)
    asked = rows.where("vec_id % 50 = 0 OR vec_id = 7").select(F.col("vec_id").alias("qid"), "embedding")
    got = {}
    for r in R.top(R.dense(rows, asked, 9), "qid", "vec_id", 9).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = v / np.where(np.linalg.norm(v, axis=1, keepdims=True) > 0, np.linalg.norm(v, axis=1, keepdims=True), 1)
    for q in [0, 7, 50, 100, 150, 200, 250]:
        cosine = np.round(unit @ unit[q], 6)
        best = sorted(range(300), key=lambda i: (-cosine[i], i))[:9]
        assert [x[1] for x in sorted(got[q])] == best
    assert all(s == 0 for _, _, s in got[7])


def test_stand_in_vectors(spark):
    rows = spark.createDataFrame([(1, "bonjour"), (2, "Bonjour"), (3, "ab"), (4, None), (5, "autre chose")], "k int, t string")
    got = {r["k"]: r["embedding"] for r in R.hashed_vectors(rows, "k", "t", 16).collect()}
    assert got[1] == got[2] != got[5] and not any(got[3]) and not any(got[4])
    assert abs(sum(x * x for x in got[5]) - 1) < 1e-9 and len(got[5]) == 16


def test_funnel(spark):
    fused = spark.createDataFrame([(1, k, k) for k in range(1, 41)], "q int, d int, rank int")
    scores = spark.createDataFrame([(1, k, float(k % 4)) for k in range(1, 31)], "q int, d int, score double")
    got = [r["d"] for r in R.funnel(fused, scores, "q", "d", R.Profile(), F.col("d") != 3).orderBy("place").collect()]
    assert got == sorted((k for k in range(1, 31)), key=lambda k: (-(k % 4), k))[1:16] and R.DEEP.with_(rerank=3).rerank == 3
    assert R.funnel(fused, scores, "q", "d", R.Profile().with_(fusion=5, rerank=7)).count() == 5


def test_percentiles_and_averages(spark):
    rows = spark.range(10_001).select(F.lit("a").alias("k"), F.col("id").cast("double").alias("v")).union(spark.createDataFrame([("b", float("nan")), ("b", None)], "k string, v double"))
    got = {r["k"]: r for r in A.percentiles(rows.where("k = 'a'"), "k", "v").collect()}
    assert abs(got["a"]["p50"] - 5000) <= 2 and abs(got["a"]["p95"] - 9500) <= 2
    assert tuple(A.averages(rows.where("k = 'b' OR v < 3"), ["v"]).first()) == (1.0, 5)


def test_purge_takes_children(spark):
    store = spark.createDataFrame([(1, "deleted", "2024-01-01"), (2, "deleted", "2024-05-01"), (3, "indexed", None)], "k int, status string, d string").withColumn("deleted_at", F.to_timestamp("d"))
    chunks = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "d")], "k int, t string")
    left, kept = Y.purged(store, chunks, "k", F.to_timestamp(F.lit("2024-05-20")))
    assert sorted(r["k"] for r in left.collect()) == [2, 3] and sorted(r["t"] for r in kept.collect()) == ["b", "c", "d"]


def test_settings():
    base = {"a": {"b": 1, "c": 2}, "d": 3}
    assert settings.merged(base, {"a": {"b": 5}, "e": 6}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 6} and base["a"]["b"] == 1
    assert settings.from_environment("X_", {"B": ("a", "b"), "C": ("a", "c"), "N": ("n",)}, {"X_B": "7", "X_C": "", "X_N": "8"}) == {"a": {"b": "7"}, "n": "8"}
    assert settings.watched_paths(["/a/", {"path": "/b", "index": "i"}, "/"]) == [("/a", None), ("/b", "i"), ("/", None)]


def test_settings_hold_from_the_next_batch(spark, tmp_path):
    seen = []
    for k, said in enumerate(["", '{"size": 1}', '{"size": 2}']):
        spark.createDataFrame([(k, "/w/a.md"), (k, "/w/a.tmp")], "k int, path string").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        if said:
            (tmp_path / "settings.json").write_text(said)
        stream = spark.readStream.schema("k int, path string").json(f"{tmp_path}/in")
        changes.reloading(stream, str(tmp_path / "settings.json"), lambda batch, n, s: seen.append((batch.count(), s.get("size"))), f"{tmp_path}/cp").awaitTermination()
    assert seen == [(2, None), (2, 1), (2, 2)]
    changes.event_log(stream, F.col("path"), (".md",), f"{tmp_path}/log", f"{tmp_path}/cp2").awaitTermination()
    assert sorted((r["path"], r["reason"]) for r in spark.read.parquet(f"{tmp_path}/log").distinct().collect() if r["k"] == 0) == [("/w/a.md", None), ("/w/a.tmp", "temporary extension")]


def test_cell_index(spark, tmp_path):
    """Recall against brute force, exact scores, pruned partitions, an index opened again, odd rows."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(30, 16))
    x = middle[rng.integers(0, 30, 3000)] + 0.15 * rng.normal(size=(3000, 16))
    x[:1000] = x[0]  # a third of all rows are one vector
    x[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    folder = str(tmp_path / "index")
    built = CellIndex.build(v, folder, k=10)
    index = CellIndex(spark, folder)
    assert index.probes == built.probes <= len(index.cells) // 4
    assert index.blocks.select(F.explode("keys")).count() == 3000
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), "embedding")
    found = {(r["qid"], r["vec_id"]): r["score"] for r in R.top(index.search(q, 10), "qid", "vec_id", 10).collect()}
    exact = {(r["qid"], r["vec_id"]): r["score"] for r in R.top(R.dense(v, q, 10), "qid", "vec_id", 10).collect()}
    assert len(found.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(found[p] - exact[p]) < 1e-6 for p in found.keys() & exact.keys())
    one = index.search(q.where("qid = 2000"), 10, probes=2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    assert len(one.collect()) <= 20
    everything = R.top(index.search(q, 10, probes=len(index.cells)), "qid", "vec_id", 10)
    assert {(r["qid"], r["vec_id"]): r["score"] for r in everything.collect()} == exact
    empty = CellIndex.build(v.limit(0), str(tmp_path / "empty"))
    assert empty.search(q, 3).collect() == []


def test_recall_of_the_index(spark):
    recall = catalog.queries()["ann_recall"](spark, "/root/testdata/sf0.01").agg(F.avg("recall")).first()[0]
    assert recall >= 0.9


def edits(a, b):
    """Optimal string alignment, the whole table."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_near_terms(spark):
    """Every term against every other: swaps are one edit, words of all lengths around the change of method, and the whole vocabulary of the smallest table."""
    rng = random.Random(2)
    words = {"ab", "abc", "abcd", "acbd", "abdc", "abcde", "abced", "abecd", "abcdef", "abdcef", "abdcfe", "ab" + "x" * 40, "ab" + "x" * 38}
    for size in range(1, 24):
        w = "ab" + "".join(rng.choice("cde") for _ in range(size))
        for _ in range(12):
            x = list(w)
            for _ in range(rng.randint(0, 3)):
                i = rng.randrange(1, len(x))
                act = rng.randrange(4)
                if act == 0:
                    x[i] = rng.choice("cde")
                elif act == 1 and len(x) > 3:
                    del x[i]
                elif act == 2:
                    x.insert(i, rng.choice("cde"))
                elif i + 1 < len(x):
                    x[i], x[i + 1] = x[i + 1], x[i]
            words.add("".join(x))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = {r[0] for r in docs.select(F.explode(R.terms(F.col("text")))).distinct().collect()}
    asked = [*words, *sorted(own)[::40]]
    field = F.lit("f").alias("field")
    rows = lambda ws: spark.createDataFrame([(w,) for w in ws], "term string").select(field, "term")
    got = {(r["term"], r["found"], r["distance"]) for r in N.near(rows(asked), rows(words | own)).collect()}
    allowed = lambda w: 0 if len(w) <= 2 else 1 if len(w) <= 5 else 2
    want = set()
    for a in asked:
        for b in words | own:
            if a[:2] == b[:2] and abs(len(a) - len(b)) <= 2 and (n := edits(a, b)) <= allowed(a):
                want.add((a, b, n))
    assert got == want and len(want) > 3 * len(words)


def test_best_by_pruning(spark, tmp_path, monkeypatch):
    """The best of many questions, exactly, however documents and questions are dealt, with equal scores, copies, empty documents and unknown terms; fewer sums are completed than there are pairs."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(120)]
    chance = 1 / np.arange(1, 121)
    texts = [" ".join(rng.choice(words, rng.integers(0, 40), p=chance / chance.sum())) for _ in range(700)]
    texts[100:160] = [texts[99] or "w7 w50"] * 60
    docs = spark.createDataFrame([(f"d{i:04}", t) for i, t in enumerate(texts)] + [(None, "w1 w2")], "key string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(words, rng.integers(1, 9)))) for i in range(60)] + [(98, "nowhere"), (99, None)], "item_id int, text string")
    every = R.bm25(docs, asked, key="key")
    want = sorted(map(tuple, R.top(every, "item_id", "key", 7).select("item_id", "key", "score", "rank").collect()))
    split = [t.split() for t in texts]
    mean = sum(map(len, split)) / sum(1 for t in split if t)
    n = sum(1 for t in split if t)
    for q, key, score, _ in want[::40]:
        own = split[int(key[1:])]
        by_hand = 0.0
        for t in set(asked.where(F.col("item_id") == q).first()["text"].split()):
            df, tf = sum(t in x for x in split), own.count(t)
            by_hand += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(own) / mean))
        assert abs(by_hand - score) < 1e-6
    monkeypatch.setattr(X, "BLOCK", 16)
    for shards, first in ((1, False), (9, True), (9, None)):
        index = X.TermIndex.build(docs, {"text": R.terms(F.col("text"))}, "key", str(tmp_path / f"{shards}{first}"), shards)
        monkeypatch.setattr(X, "FEW", 3)
        best = R.bm25(docs, asked, key="key", k=7, index=index) if first is None else index.scores(X.terms_asked(asked, "item_id", {"text": R.terms(F.col("text"))}), "item_id", "key", 7, first=first).select("item_id", "key", "score")
        assert sorted(map(tuple, R.top(best, "item_id", "key", 7).select("item_id", "key", "score", "rank").collect())) == want
    assert R.bm25(docs.limit(0), asked, key="key", k=3).collect() == []


def test_sums_that_are_not_completed():
    """A frequent term of little weight: documents with it alone are never summed up."""
    rare, often = np.arange(50), np.arange(5000)
    terms = [(5.0, "a", 5.0, rare.astype("<i4"), np.linspace(0.5, 1, 50)), (0.3, "b", 0.3, often.astype("<i4"), np.linspace(0.1, 1, 5000))]
    counted = []
    at, sums = X._best(terms, 5000, 10, 0.0, counted)
    assert counted[0] < 30 and at.tolist() == list(range(49, 39, -1))
    full = np.zeros(5000)
    for _, _, w, ids, part in terms:
        full[ids] += w * part
    assert np.allclose(sums, np.sort(full)[::-1][:10])
    assert not len(X._best(terms, 5000, 10, 6.0)[0])


def light_stem(word):
    """The published light stemmer of French, on a list of letters whose length shrinks."""
    s = list(word)
    ends = lambda x: "".join(s).endswith(x)

    def norm():
        nonlocal s
        if len(s) > 4:
            s = [dict(zip("àáâôèéêùûîç", "aaaoeeeuuic", strict=True)).get(c, c) for c in s]
            k = 1
            while k < len(s):
                if s[k] == s[k - 1] and s[k].isalpha():
                    del s[k]
                else:
                    k += 1
        if len(s) > 4 and ends("ie"):
            del s[-2:]
        if len(s) > 4:
            for c in "ree":
                if s[-1:] == [c]:
                    s.pop()
            if len(s) > 1 and s[-1] == s[-2] and s[-1].isalpha():
                s.pop()
        return "".join(s)

    def cut(n, last=""):
        if n:
            del s[-n:]
        if last:
            s[len(s) - len(last) :] = list(last)

    if len(s) > 5 and s[-1] == "x":
        if s[-3] == "a" and s[-2] == "u" and s[-4] != "e":
            s[-2] = "l"
        s.pop()
    for c in "xs":
        if len(s) > 3 and s[-1] == c:
            s.pop()
    if len(s) > 9 and ends("issement"):
        cut(6, "r")
        return norm()
    if len(s) > 8 and ends("issant"):
        cut(4, "r")
        return norm()
    if len(s) > 6 and ends("ement"):
        cut(4)
        if len(s) > 3 and ends("ive"):
            cut(1, "f")
        return norm()
    for n, x, k, last in ((11, "ficatrice", 5, "er"), (10, "ficateur", 4, "er"), (9, "catrice", 3, "que"), (8, "cateur", 2, "quer"), (8, "atrice", 4, "er"), (7, "ateur", 3, "er")):
        if len(s) > n and ends(x):
            cut(k, last if x != "catrice" else "")
            if x == "catrice":
                s[-4:-1] = list("que")
            return norm()
    if len(s) > 6 and ends("trice"):
        cut(1, "eur")
    for n, x, k, last in ((5, "ième", 4, ""), (7, "teuse", 2, "r"), (6, "teur", 1, "r"), (5, "euse", 2, ""), (8, "ère", 1, "er"), (7, "ive", 1, "f"), (4, "folle", 2, "u"), (4, "molle", 2, "u"), (9, "nnelle", 5, ""), (9, "nnel", 3, "")):
        if len(s) > n and ends(x):
            cut(k, last)
            return norm()
    if len(s) > 4 and ends("ète"):
        cut(1, "et")
    if len(s) > 8 and ends("ique"):
        cut(4)
    if len(s) > 9 and ends("isation"):
        cut(7)
        if len(s) > 5 and ends("ual"):
            s[-2] = "e"
        return norm()
    for n, x, k in ((8, "esse", 3), (7, "inage", 3), (9, "isateur", 7), (8, "ation", 5), (8, "ition", 5)):
        if len(s) > n and ends(x):
            cut(k)
            return norm()
    return norm()


def test_french_stems(spark):
    """Every ending at every length around its limit, and the whole French vocabulary of the smallest tables."""
    endings = [x for group in (R.FIRST_ENDINGS, R.BEFORE_SECOND, R.SECOND_ENDINGS, R.BEFORE_THIRD, R.THIRD_ENDINGS) for _, x, _ in group]
    endings += ["aux", "eaux", "x", "s", "xs", "ie", "er", "ée", "eer", "elle", "ement", "tionnelles", "ivements", "isatrices", "ll", "é", "ualisations"]
    words = {"bcdfghijklmn"[:n] + x + y for x in endings for n in range(13) for y in ("", "s")} | {"œuvre", "ww", "a", "1122", "11ee", "été"}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'fr'")
    words |= {r[0] for r in docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).distinct().collect()}
    words = sorted(words - {""})
    got = spark.createDataFrame([(words,)], "w array<string>").select(R.stemmed(F.col("w"))).first()[0]
    assert {w: g for w, g in zip(words, got, strict=True)} == {w: light_stem(w) for w in words}
    assert len(words) > 1000


def test_vectors_by_hand(spark):
    """Signed buckets of trigrams, letter by letter, over texts that share a batch, with letters beyond the basic plane."""
    texts = ["Bonjour à tous", "ab", "", None, "😀😀😀a", "x" * 50, "éàü"]
    got = {r["k"]: r["embedding"] for r in R.hashed_vectors(spark.createDataFrame([*enumerate(texts)], "k int, t string").coalesce(1), "k", "t", 16).collect()}
    for k, said in enumerate(texts):
        want, low = np.zeros(16), (said or "").lower()
        for i in range(len(low) - 2):
            h = zlib.crc32(low[i : i + 3].encode())
            want[h % 16] += 1 if h // 16 % 2 == 0 else -1
        assert np.allclose(got[k], want / (np.linalg.norm(want) or 1))


def test_slices_of_long_texts():
    """What a task takes up at once is bounded by bytes, whatever the number of rows in a batch."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 700_000, None, "b" * 700_000, "", "c" * 5_000_000, "d"])], ["k", "t"])
    parts = [p.column(0).to_pylist() for p in text_slices(batch, 1)]
    assert sum(parts, []) == list(range(6)) and parts[-1] == [5] and len(parts) > 2
    assert [*text_slices(batch.slice(0, 0), 1)] == []


def test_best_field_of_every_document(spark, tmp_path):
    """The best field's score for every document is that of all fields' scores, with repeated, null and unasked rows."""
    rng = random.Random(5)
    said = lambda n: " ".join(rng.choice("abcdefgh") * 2 for _ in range(n))
    rows = spark.createDataFrame([(k % 70 if k != 9 else None, said(rng.randrange(9)), said(3) if k % 5 else None) for k in range(80)], "doc_id int, t string, u string")
    fields = (R.Field("t", 3.0, R.terms), R.Field("u", 2.0, R.terms))
    asked = spark.createDataFrame([(1, "aa bb zz"), (2, "cc dd cc"), (3, "yy"), (None, "aa")], "item_id int, text string")
    index = R.search_index(rows, f"{tmp_path}/i", fields)
    got = {(r["item_id"], r["doc_id"]): r["score"] for r in R.search(rows, asked, fields, index=index).collect()}
    want = {}
    for r in index.scores(X.terms_asked(asked, "item_id", {f.column: f.analysis(F.col("text")) for f in fields}), "item_id", "doc_id").collect():
        pair = r["item_id"], r["doc_id"]
        want[pair] = max(want.get(pair, 0), {"t": 3.0, "u": 2.0}[r["field"]] * r["score"])
    assert got == want and len(got) > 50


def test_counted():
    """Numbers of several parts are counted as one list, and a shard holds 4,096 documents at most."""
    parts = [np.array(x, np.int64) for x in ([5, 1, 5], [], [1, 9, 1])]
    want = np.unique(np.concatenate(parts), return_counts=True)
    assert all((a == b).all() for a, b in zip(X._counted(parts), want, strict=True)) and not parts
    assert [len(x) for x in X._counted([])] == [0, 0] and X.SHARD <= 4096
