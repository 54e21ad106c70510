from __future__ import annotations

import os
import threading
import time

import pyarrow as pa
import pytest

from trailmill.plans import dispatch
from trailmill.sources import index, ledger
from trailmill.streaming import ingest

SCHEMA = "id string, v int"


def rows_of(table):
    found = table.read()
    return [] if found is None else sorted(map(tuple, found.select("id", "v").collect()))


def test_a_log_has_one_winner_for_each_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger, "SNAPSHOT", 3)
    log = ledger.Log(spark, str(tmp_path / "log"))
    known = []
    for k in range(8):
        assert log.append({"k": k}, known)
        assert not log.append({"k": "late"}, known)
        known = log.entries()
        assert [e["k"] for e in known] == list(range(k + 1))
    reads = []
    load = ledger.Log._load
    monkeypatch.setattr(ledger.Log, "_load", lambda self, n: reads.append(n) or load(self, n))
    assert len(log.entries()) == 8 and reads == [6, 7]
    os.remove(tmp_path / "log" / "000000000002.json")
    with pytest.raises(ValueError):
        log.entries()


def test_two_writers_leave_every_key_once(spark, tmp_path, monkeypatch):
    one, two = (ledger.Table(spark, str(tmp_path / "t")) for _ in range(2))
    df = lambda rows: spark.createDataFrame(rows, SCHEMA)
    real, raced = ledger.Log.append, []

    def between(self, entry, known):
        if self is one.log and not raced:
            raced.append(1)
            two.append(df([("b", 20), ("c", 20)]), "id", "two", 0)
        return real(self, entry, known)

    monkeypatch.setattr(ledger.Log, "append", between)
    assert one.append(df([("a", 10), ("b", 10), ("b", 10), (None, 1)]), "id", "one", 0)
    assert rows_of(one) == [("a", 10), ("b", 20), ("c", 20)]
    assert not one.append(df([("z", 1)]), "id", "one", 0)  # a batch that runs twice
    assert one.append(df([("a", 99)]), "id", "one", 1) and len(rows_of(two)) == 3


def test_what_a_crash_leaves_is_no_part_of_the_table(spark, tmp_path, monkeypatch):
    table = ledger.Table(spark, str(tmp_path / "t"))
    assert table.read() is None and table.vacuum(0) == 0
    table.append(spark.createDataFrame([("a", 1)], SCHEMA), "id", "w", 0)
    table.write(ledger.dealt(spark.createDataFrame([("b", 1)], SCHEMA), "id"), by_key=True)  # written, never committed
    assert rows_of(table) == [("a", 1)]
    assert table.vacuum(3_600) == 0 and table.vacuum(-5) == 1 and rows_of(table) == [("a", 1)]


def test_a_stream_that_dies_between_files_and_entry(spark, tmp_path, monkeypatch):
    source, sink, ck = (str(tmp_path / n) for n in ("in", "sink", "ck"))
    spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run = lambda: ingest.append_committed(ingest.frame_stream(spark, source, SCHEMA), sink, "id", ck).awaitTermination()
    real = ledger.Log.append

    def dies(self, entry, known):
        raise OSError("the machine is gone")

    monkeypatch.setattr(ledger.Log, "append", dies)
    with pytest.raises(Exception, match="gone"):
        run()
    assert rows_of(ledger.Table(spark, sink)) == []

    def dies_after(self, entry, known):
        assert real(self, entry, known)
        raise OSError("the machine is gone")

    monkeypatch.setattr(ledger.Log, "append", dies_after)
    with pytest.raises(Exception, match="gone"):
        run()
    monkeypatch.setattr(ledger.Log, "append", real)
    run()  # the batch is there already
    spark.createDataFrame([("b", 9), ("c", 3)], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    run()
    assert rows_of(ledger.Table(spark, sink)) == [("a", 1), ("b", 2), ("c", 3)]


def test_an_index_follows_its_files(spark, tmp_path):
    root, path, asked = str(tmp_path / "root dir"), str(tmp_path / "index"), []
    put = lambda name, ids: spark.createDataFrame([(i, f"text {i}", i * 2) for i in ids], "id long, text string, more long").coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}")

    def read(paths):
        asked.append(paths)
        return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(*paths)

    def refresh(build=lambda rows: rows.select("id", "file_path")):
        asked.clear()
        out = index.refreshed(spark, path, root, "*.parquet", build, read)
        return sorted(r.id for r in out.collect()), out

    put("x", [1, 2])
    put("y", [3])
    assert refresh()[0] == [1, 2, 3]
    assert refresh()[0] == [1, 2, 3] and all(p == [root] for p in asked)  # the schema alone is asked for
    put("z", [4])
    assert refresh()[0] == [1, 2, 3, 4] and [p for p in asked if p != [root]] and all(len(p) == 1 and "/z/" in p[0] for p in asked if p != [root])
    time.sleep(0.01)
    put("x", [5, 6, 7])
    assert refresh()[0] == [3, 4, 5, 6, 7]
    for f in (tmp_path / "root dir" / "y").glob("*.parquet"):
        f.unlink()
    assert refresh()[0] == [4, 5, 6, 7]
    ids, out = refresh(lambda rows: rows.select("id", "more", "file_path"))  # a column that older rows lack
    assert ids == [4, 5, 6, 7] and sorted(r.more for r in out.collect()) == [8, 10, 12, 14]
    assert refresh(lambda rows: rows.select("id", "more", "file_path"))[0] == [4, 5, 6, 7] and all(p == [root] for p in asked)
    assert ledger.Table(spark, path).vacuum(-5) > 0 and refresh()[0] == [4, 5, 6, 7]


def test_a_window_slides_over_batches(monkeypatch):
    monkeypatch.setattr(dispatch, "CHUNK", 4)
    lock, now, most, order, began = threading.Lock(), [0], [0], [], time.time()

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.6 if x == 0 else 0.01)
        with lock:
            now[0] -= 1
            order.append(x)
        if x == 7:
            raise ValueError("no answer")
        return f"<{x}>"

    batches = [pa.RecordBatch.from_pydict({"k": [f"k{i}" for i in r], "x": list(r)}) for r in (range(0, 5), range(5, 30), range(30, 31))]
    got = {r["key"]: (r["answer"], r["error"]) for b in dispatch.answers(iter(batches), call, 3, pa.string()) for r in b.to_pylist()}
    assert most[0] <= 3 and order[-1] == 0 and time.time() - began < 2
    assert len(got) == 31 and got["k7"] == (None, "ValueError: no answer") and got["k30"] == ("<30>", None)
    assert list(dispatch.answers(iter([]), call, 3, pa.string())) == []


def test_calls_in_flight_over_all_tasks_and_what_a_rerun_asks(spark, tmp_path):
    place = str(tmp_path)
    os.makedirs(f"{place}/flying")
    os.makedirs(f"{place}/asked")

    def make():
        import os
        import time
        import uuid

        def call(text):
            name = f"{place}/flying/{uuid.uuid4().hex}"
            open(name, "w").close()
            open(f"{place}/asked/{text}-{uuid.uuid4().hex}", "w").close()
            n = len(os.listdir(f"{place}/flying"))
            if n > 5:
                open(f"{place}/too-many", "w").close()
            time.sleep(0.02)
            os.remove(name)
            if text == "t13" and not os.path.exists(f"{place}/died"):
                open(f"{place}/died", "w").close()
                os._exit(1)
            if text == "t7":
                raise ValueError("never")
            return text.upper()

        return call

    requests = spark.createDataFrame([(k % 60, f"t{k % 60}") for k in range(120)] + [(None, "x")], "k long, text string").repartition(6)
    go = lambda: dispatch.dispatched(spark, requests, "k", ["text"], make, f"{place}/answers", limit=5, per_round=15, lanes=4)
    with pytest.raises(Exception):  # noqa: B017  a worker has died
        go()
    saved = {r.k for r in ledger.Table(spark, f"{place}/answers").read().collect()} if ledger.Table(spark, f"{place}/answers").read() is not None else set()
    before = len(os.listdir(f"{place}/asked"))
    got = {r.k: r.answer for r in go().collect()}
    assert got == {k: f"T{k}" for k in range(60) if k != 7} and not os.path.exists(f"{place}/too-many")
    assert len(os.listdir(f"{place}/asked")) - before == 60 - len(saved)
    before = len(os.listdir(f"{place}/asked"))
    assert go().count() == 59 and len(os.listdir(f"{place}/asked")) - before == 1  # the failed one alone


def test_no_requests(spark, tmp_path):
    none = spark.createDataFrame([], "k long, text string")
    assert dispatch.dispatched(spark, none, "k", ["text"], lambda: str, str(tmp_path / "a"), 4).collect() == []
