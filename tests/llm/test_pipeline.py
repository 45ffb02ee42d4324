"""The pipeline keeps clean documents and its decisions take effect."""

import hashlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from lectern.llm import quality_rules, secret_scan
from lectern.llm.oracles import ORACLES
from lectern.llm.queries import TOKENIZER
from test_operators import components
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(out)
        before, docs = docs, spark.read.parquet(out)
        seen.append(docs.count())
        if name == "quality":
            assert docs.count() == quality_rules.judge(before).where("kept").count()
        if name == "secrets":
            assert docs.columns == before.columns
            assert secret_scan.scan(docs).where("n_hex > 0 OR n_access > 0").count() == 0
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.5 * seen[0]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_stages_go_by_row(spark, tmp_path):
    """Each stage against brute force, with null and repeated ids: as many of each row as must stay."""
    rng = np.random.default_rng(2)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW source AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
    clean = [f"Paper {i}: " + " ".join(f"{'the of and to that with'.split()[k % 6]} word{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in rng.integers(0, 100, 60)) + "." for i in range(6)]
    passage = c.execute("SELECT text FROM benchmark ORDER BY length(text) DESC LIMIT 1").fetchone()[0]
    foul = [x + " " + passage + " " + passage for x in clean[:3]]
    near = clean[3] + " And one more."
    texts = [(1, clean[0]), (1, foul[0]), (None, foul[1]), (None, clean[1]), (None, clean[1]), (2, clean[2]), (2, clean[2]), (2, clean[2]), (10, clean[3]), (9, near), (None, near), (9, clean[4]), (3, clean[4]), (4, None), (4, None), (None, ""), (5, foul[2]), (5, foul[2]), (6, clean[5])]
    texts += c.execute("SELECT doc_id + 100, text FROM source ORDER BY doc_id LIMIT 60").fetchall()
    start = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    columns = [x for x in start.columns if x not in ("lang", "source")]

    def verdicts(rows, name, column):
        c.execute("CREATE OR REPLACE TABLE documents (doc_id BIGINT, text VARCHAR)")
        c.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(r["text"] for r in rows)))
        found = c.execute(ORACLES[name])
        names = [x[0] for x in found.description]
        return {r[names.index("doc_id")]: r[names.index(column)] for r in found.fetchall()}

    def run(name, docs):
        dict(corpus_pipeline.STAGES)[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    plain = lambda rows: Counter(tuple(r[x] for x in columns) for r in rows)
    rows, good = start.collect(), run("quality", start)
    kept = verdicts(rows, "op9_quality_rules", "kept")
    assert plain(good.collect()) == plain(r for k, r in enumerate(rows) if kept[k])

    digest = lambda t: b"" if t is None else hashlib.md5(t.encode()).digest()
    keys = sorted({(i is None, i or 0, digest(t), i, t) for i, t in texts}, key=lambda x: x[:3])
    want = components([(n, x[4] or "") for n, x in enumerate(keys)], 5, 80)
    distinct = run("near_duplicates", start)
    assert plain(distinct.collect()) == Counter((x[3], x[4], len(x[4] or "")) for n, x in enumerate(keys) if want[n][2])

    bad = verdicts(rows, "op4_decontaminate", "contaminated")
    assert plain(run("decontaminated", start).collect()) == plain(r for k, r in enumerate(rows) if not bad[k])
    assert bad[1] and bad[2] and bad[16] and not bad[0] and not bad[3]

    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    ids = [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids) for r in rows]
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in run("tokens", start).collect()) == Counter((k, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest()) for k, x in ids)
