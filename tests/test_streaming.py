"""Streams: changes of a folder, the store of versions, quiet periods and retries with timers."""

import os
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import sync as Y
from lectern.streaming import changes, folder, timers
from lectern.streaming.versions import Versions


def test_folder_changes(spark, tmp_path):
    """Files that come, change, move and go, over several starts of the query: each change once, in its batch."""
    spark.dataSource.register(folder.FolderChanges)
    watched, sub = tmp_path / "watched", tmp_path / "watched" / "sub"
    sub.mkdir(parents=True)

    def run():
        stream = spark.readStream.format("folder_changes").option("path", str(watched)).option("state", str(tmp_path / "state")).load()
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        short = lambda p: p and os.path.relpath(p, watched)
        return Counter((r["event"], r["action"], short(r["path"]), short(r["old_path"])) for r in rows)

    (watched / "a.md").write_text("a")
    (watched / "b.md").write_text("b")
    (sub / "c.md").write_text("c")
    seen = run()
    assert seen == Counter({("created", "upsert", p, None): 1 for p in ("a.md", "b.md", "sub/c.md")})
    assert run() == seen
    (watched / "a.md").write_text("a, longer")
    os.rename(watched / "b.md", sub / "d.md")
    os.remove(sub / "c.md")
    (watched / "e.md").write_text("")
    after = run() - seen
    assert after == Counter([("modified", "upsert", "a.md", None), ("moved", "move", "sub/d.md", "b.md"), ("deleted", "delete", "sub/c.md", None), ("created", "upsert", "e.md", None)])
    assert run() == seen + after
    assert len([n for n in os.listdir(tmp_path / "state") if n.endswith(".json")]) <= 2


def test_snapshots_compared():
    a = {"x": [1, 1, 0, 7], "y": [1, 1, 0, 8], "z": [2, 2, 0, 9]}
    b = {"x2": [1, 1, 0, 7], "y": [3, 1, 0, 8], "w": [5, 5, 0, 9], "z": [2, 2, 0, 10]}
    assert [(r[0], r[1], r[3]) for r in folder.changed(a, b)] == [("w", "created", None), ("x2", "moved", "x"), ("y", "modified", None), ("z", "modified", None)]
    assert [(r[0], r[1]) for r in folder.changed(b, {})] == [(p, "deleted") for p in sorted(b)]


SCHEMA = "path string, action string, content_hash string, seq long"


def model(days):
    """The store's rows after each day, in a dictionary."""
    held, out = {}, []
    for day in days:
        for path in {r[0] for r in day}:
            _, action, digest, _ = max((r for r in day if r[0] == path), key=lambda r: r[3])
            if action == "delete":
                held.pop(path, None)
            elif path not in held or held[path][0] != digest:
                held[path] = (digest, held.get(path, (None, 0))[1] + 1)
        out.append(dict(held))
    return out


def random_days(n):
    rng = random.Random(n)
    return [[(rng.choice("abcdef"), rng.choice(["upsert", "upsert", "delete"]), f"h{rng.randint(1, 3)}", d * 100 + k) for k in range(rng.randint(1, 5))] for d in range(n)]


def test_store_of_versions(spark, tmp_path):
    """A stream of single batches with compactions against a dictionary."""
    days = random_days(7)
    store = f"{tmp_path}/store"
    for number, day in enumerate(days):
        spark.createDataFrame(day, SCHEMA).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in")
        changes.apply_changes(stream, store, f"{tmp_path}/checkpoint", most=3).awaitTermination()
        if number in (3, 6):
            assert {r["path"]: (r["content_hash"], r["version"]) for r in changes.current(spark, store, stream.schema).collect()} == model(days)[number]
    held = Versions(spark, store, stream.schema, 3)
    assert held.manifest()["snapshot"] and len(held.manifest()["batches"]) < 3
    assert len(os.listdir(f"{store}/data")) <= 12


def test_store_survives_crashes(spark, tmp_path, monkeypatch):
    """A run that dies before it names what it wrote, in a batch or a compaction, changes nothing; the next one does it again. Readers of a named version go on."""
    batch = lambda path, digest: spark.createDataFrame([(path, "upsert", digest, 1, 1)], f"{SCHEMA}, version long")
    held = Versions(spark, str(tmp_path / "store"), batch("a", "h").schema, most=100)
    rows = lambda m=None: {(r["path"], r["content_hash"]) for r in held.rows(m).collect()}
    assert rows() == set()
    assert held.add(batch("a", "h1"), 0) and held.add(batch("b", "h1"), 1)
    assert not held.add(batch("a", "h9"), 1)

    def dies(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(Versions, "_name", dies)
        with pytest.raises(OSError):
            held.add(batch("a", "h2"), 2)
        with pytest.raises(OSError):
            held.compact()
    assert rows() == {("a", "h1"), ("b", "h1")} and held.manifest()["snapshot"] is None
    assert held.add(batch("a", "h2"), 2)
    before = held.manifest()
    with monkeypatch.context() as m:
        m.setattr(Versions, "clean", dies)
        with pytest.raises(OSError):
            held.compact()
    named = held.manifest()["snapshot"]
    assert named and rows() == rows(before) == {("a", "h2"), ("b", "h1")}
    held.compact()
    assert held.manifest()["snapshot"] == named and rows(before) == rows()
    for k in range(3, 7):
        assert held.add(batch("c", f"h{k}"), k)
    held.compact()
    assert len(os.listdir(tmp_path / "store" / "data")) < 9 and ("c", "h6") in rows()


START = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, timers.PROVIDER)
    yield
    spark.conf.unset(name)


def drain(spark, tmp_path, batches, schema, transform):
    """Each batch in a start of the query of its own; then a far event that lets all timers run out."""
    out = str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "10 minutes")
        query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.parquet(out).collect()


def test_quiet_periods_by_timers(spark, tmp_path, rocks):
    """Shuffled and late events over several starts: the rows of the batch query."""
    rng = random.Random(6)
    events = [(rng.choice("abc"), START + timedelta(milliseconds=1000 * k + rng.randint(0, 900)), f"act{k}") for k in range(60)]
    late = sorted(events, key=lambda e: e[1] + timedelta(seconds=rng.randint(0, 20)))
    batches = [late[k::1][:20] for k in (0, 20, 40)] + [[("z", START + timedelta(days=1), "end")]]
    got = drain(spark, tmp_path, batches, "path string, ts timestamp, action string", lambda s: timers.debounced(s, 3000))
    df = spark.createDataFrame(events, "path string, ts timestamp, action string")
    want = Y.debounced(df, "path", "ts", "action", "3 seconds").collect()
    plain = lambda rows: Counter((r["path"], r["started"], r["ended"], r["last_action"], r["n_events"]) for r in rows if r["path"] != "z")
    assert plain(got) == plain(want) and len(want) > 10


def test_retries_by_timers(spark, tmp_path, rocks):
    at = lambda minutes: START + timedelta(minutes=minutes)
    batches = [
        [("a", at(0), False, "e1"), ("b", at(0), True, None), ("c", at(0), False, "e1"), ("d", at(0), False, "e1")],
        [("a", at(5), False, "e2"), ("c", at(0.5), True, None), ("d", at(20), False, "e2")],
        [("a", at(30), False, "e3"), ("d", at(50), True, None)],
        [("z", at(3000), True, None)],
    ]
    got = drain(spark, tmp_path, batches, "job string, ts timestamp, ok boolean, error string", timers.retried)
    minutes = lambda r: (r["at"] - START).total_seconds() / 60
    by_job = {j: sorted((minutes(r), r["status"], r["attempts"], r["error"]) for r in got if r["job"] == j) for j in "abcd"}
    assert by_job == {
        "a": [(1, "retry", 1, "e1"), (7, "retry", 2, "e2"), (30, "dead", 3, "e3")],
        "b": [(0, "completed", 0, "")],
        "c": [(0.5, "completed", 0, "")],
        "d": [(1, "retry", 1, "e1"), (22, "retry", 2, "e2"), (50, "completed", 0, "")],
    }
