from __future__ import annotations

import json

import pytest
from duck import SF_DIR, needs_tables
from pyspark.sql import functions as F

from trailmill.functions import text as tx
from trailmill.operators import relational as rel
from trailmill.operators import scoring as sc
from trailmill.plans import models
from trailmill.sources import annotations as an
from trailmill.sources import datasets as ds
from trailmill.streaming import ingest


def write(path, lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_filter_keeps_finite_numbers(spark, tmp_path):
    scores = ["0.94", "0.95", "1.2", "null", '"1"', "true", "NaN", "Infinity", '"NaN"']
    lines = [f'{{"selection":{{"score":{s}}},"object":{{"n":1}}}}' for s in scores] + ["{}", "  "]
    source = write(tmp_path / "a.jsonl", lines)
    assert an.filter_file(spark, source, str(tmp_path / "out"), 0.95) == (2, 10)
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == [lines[1], lines[2]]
    with pytest.raises(Exception, match="exist"):
        an.filter_file(spark, source, str(tmp_path / "out"), 0.95)


def test_filter_asks_every_arm(spark, tmp_path):
    arms = lambda a, b: json.dumps({"arms": [{"arm": "left", "selection": {"score": a}}, {"arm": "right", "selection": {"score": b}}]})
    source = write(tmp_path / "b.jsonl", [arms(0.95, 1.2), arms(1.2, 0.94), arms(0.94, 1.2), arms(1.2, None), arms(True, 1.2)])
    assert an.filter_file(spark, source, str(tmp_path / "out"), 0.95) == (1, 5)


@pytest.mark.parametrize("bad", ["{bad json}", "[]", "3"])
def test_malformed_lines_stop(spark, tmp_path, bad):
    source = write(tmp_path / "c.jsonl", ['{"selection":{"score":1}}', bad])
    with pytest.raises(ValueError, match="line 2"):
        an.filter_file(spark, source, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def row(tid, sub, version=an.VERSION, **more):
    return json.dumps({"schema": {"name": an.NAME, "version": version}, "trajectory_id": tid, "subtask_index": sub, "start_frame": 0, "end_frame_exclusive": 9, "instruction": "x", **more})


def test_merge_and_resume(spark, tmp_path):
    base = write(tmp_path / "m.jsonl", [row("a", 0), "{bad", row("b", 0)])
    node = write(tmp_path / "m_node0.jsonl", [row("a", 0, note=2), row("c", 0), row("", 0), row("d", 0, error="e")])
    once = [r.line for r in an.merge_files(spark, base, [node]).collect()]
    assert sorted(json.loads(x)["trajectory_id"] for x in once) == ["a", "b", "c", "d"] and all("note" not in x for x in once)
    again = write(tmp_path / "n.jsonl", once)
    assert an.merge_files(spark, again, [node]).count() == 4
    assert {r.trajectory_id for r in an.resumable(spark, [base, node]).collect()} == {"a", "b", "c"}
    old = write(tmp_path / "old.jsonl", [row("a", 0, version="1.0")])
    with pytest.raises(Exception, match="unsupported"):
        an.resumable(spark, [old]).collect()


def test_annotation_id_is_that_of_other_languages(spark):
    import hashlib

    values = {"camera": None, "text": 'é "q" \\ 日\n', "n": 5}
    df = spark.createDataFrame([(values["text"], 5)], "text string, n int")
    got = df.select(tx.annotation_id(("text", F.col("text")), ("n", F.col("n")), ("camera", F.lit(None).cast("string"))).alias("i")).first().i
    assert got == "sha256:" + hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def test_text_functions(spark):
    df = spark.createDataFrame([("Pick up the Cups",), ("unfold it",), (None,), ("a b~c*é/",)], "s string")
    rows = df.select(tx.task_group(F.col("s")).alias("g"), tx.name_tokens(F.col("s")).alias("t"), tx.quoted(F.col("s")).alias("q")).collect()
    assert [r.g for r in rows] == ["movement_relocate", "non_movement_tool_or_shape", "other", "other"]
    assert rows[0].t == ["cup", "pick", "up"] and rows[3].q == "a%20b~c%2A%C3%A9%2F"
    v = spark.createDataFrame([("**Verdict: Yes**\nno",), ("line\nI say no.",), ("hm",), ('```json\n[{"k":1},{"k":2}]\n```',), ('{"k":3}',), ("none",)], "s string")
    got = v.select(tx.verdict(F.col("s")).alias("v"), tx.model_output(F.col("s"), "struct<k:int>").alias("m")).collect()
    assert [r.v for r in got[:3]] == [1.0, 0.0, 0.5] and [len(r.m) if r.m else r.m for r in got[3:]] == [2, 1, None]


def test_allocation():
    assert rel.allocated({"a": 50, "b": 30, "c": 20}, 10) == {"a": 5, "b": 3, "c": 2}
    assert rel.allocated({"a": 1, "b": 100}, 10, "balanced") == {"a": 1, "b": 9}
    assert rel.allocated({"a": 1, "b": 1, "c": 1000}, 3, floor=1) == {"a": 1, "b": 1, "c": 1}
    assert rel.allocated({"a": 5, "b": 5}, 4, "weighted", {"a": 0.0, "b": 1.0}) == {"a": 0, "b": 4}
    assert rel.allocated({"a": 2, "b": 0}, 9) == {"a": 2, "b": 0} and rel.allocated({}, 5) == {}
    assert rel.allocated({"a": 1, "b": 1, "c": 1}, 2) == {"a": 0, "b": 1, "c": 1}
    groups = {"a": [f"a{i}" for i in range(9)], "b": [f"b{i}" for i in range(9)]}
    assert rel.sampled(groups, {"a": 3, "b": 2}) == rel.sampled(groups, {"a": 3, "b": 2}) and len(rel.sampled(groups, {"a": 3, "b": 99})) == 12


def test_picks_on_ties_and_nothing_finite(spark):
    rows = [(1, 0, 0.5), (1, 1, 0.9), (1, 2, 0.9), (2, 0, None), (2, 1, float("nan")), (3, 0, float("inf")), (3, 1, -1.0)]
    df = spark.createDataFrame(rows, "grp int, cand int, s double")
    assert {(r.grp, r.cand) for r in sc.winner(df, ["grp"], "s").collect()} == {(1, 1), (3, 1)}
    assert {(r.grp, r.cand) for r in sc.detector_baseline(df, ["grp"], "s").collect()} == {(1, 1), (2, 0), (3, 1)}


def test_dataset_folder(spark, tmp_path):
    root = tmp_path / "set"
    (root / "meta/episodes/chunk-000").mkdir(parents=True)
    (root / "meta/info.json").write_text(json.dumps({"chunks_size": 1000, "fps": 10, "features": {"observation.images.top": {"dtype": "video"}, "action": {"dtype": "float32"}}}))
    (root / "meta/tasks.jsonl").write_text('{"task_index": 0, "task": "Pick"}\n{"id": 1, "instruction": "Place"}\n')
    eps = spark.createDataFrame([(0, ["1"], 2.5, 0, 0), (1200, ["Pick"], 0.0, 0, 1)], "episode_index long, tasks array<string>, `videos/observation.images.top/from_timestamp` double, `videos/observation.images.top/chunk_index` long, `videos/observation.images.top/file_index` long")
    eps.coalesce(1).write.mode("overwrite").parquet(str(root / "meta/episodes/chunk-000"))
    frames = spark.createDataFrame([(0, 1, [0.0, 0.25]), (0, 0, [0.0, 1.0]), (1200, 0, [0.5])], "episode_index long, frame_index long, action array<double>")
    frames.write.parquet(str(root / "data"))
    about = ds.info(spark, str(root))
    assert about["cameras"] == ["observation.images.top"] and about["fps"] == 10
    index = {r.trajectory_id: r for r in ds.episodes(spark, str(root), about, ds.tasks(spark, str(root))).collect()}
    assert index["0/0"].task == "Place" and index["0/1200"].task == "Pick" and index["0/1200"].data_file == 1 and index["0/0"].videos[0].from_ts == 2.5
    got = ds.frames(spark, str(root), ds.Spec("x", grippers=(ds.Gripper("action", -1, "invert"),))).orderBy("episode_index", "frame_index")
    assert [r.gripper_0 for r in got.collect()] == [0.0, 0.75, 0.5]
    assert ds.chosen_camera(["a", "b"], "c", ("b", "a")) == "b" and ds.chosen_camera([], "c") == "c" and ds.chosen_camera(["z"]) == "z"
    with pytest.raises(ValueError):
        ds.transformed(F.col("x"), "odd", [])


def test_requests_are_made_once(spark):
    df = spark.createDataFrame([("Pick the cup from table to shelf.", "g")] * 3 + [("Open it", "g"), ("", "g")], "instruction string, phase_key string")
    asked = models.requests(df, df.where("instruction = 'Open it'"), ["instruction", "phase_key"])
    answers = {r.instruction: r.answer for r in models.parse_tasks(asked).collect()}
    assert json.loads(answers["Pick the cup from table to shelf."]) == {"action": "pick", "object": "cup", "start_location": "table", "target_location": "shelf"}
    assert set(answers) == {"Pick the cup from table to shelf.", ""} and answers[""] is None


def test_append_stream_is_exactly_once(spark, tmp_path):
    schema, source, sink = "id string, v int", str(tmp_path / "in"), str(tmp_path / "sink")
    for k, rows in enumerate(([("a", 1), ("b", 2), ("a", 3)], [("b", 9), ("c", 4)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        ingest.append_new(ingest.frame_stream(spark, source, schema), sink, "id", str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(sink).count() == (2, 3)[k]


def test_sessions_on_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:05:00"), ("a", "2024-01-01 01:00:00"), ("b", "2024-01-02 00:00:00")]
    df = spark.createDataFrame(rows, "traj string, at string").select("traj", F.col("at").cast("timestamp").alias("at"))
    source = str(tmp_path / "in")
    df.write.parquet(source)
    batch = {(r.traj, r.n) for r in ingest.sessions(df, "traj", "at").collect()}
    assert batch == {("a", 2), ("a", 1), ("b", 1)}
    stream = ingest.frame_stream(spark, source, "traj string, at timestamp")
    ingest.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"), shape=lambda s: ingest.sessions(s, "traj", "at", late="1 minute"))
    assert {(r.traj, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", 2), ("a", 1)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_live_phases_equal_those_of_the_table(spark, tmp_path):
    import numpy as np

    from trailmill.operators.phases import gripper_phases

    rng, source = np.random.default_rng(6), str(tmp_path / "in")
    signals = {k: np.repeat(rng.random(12), 8) for k in ("a", "b", "c")}
    rows = [(k, t, float(v), t == len(x) - 1) for k, x in signals.items() for t, v in enumerate(x)]
    schema = "traj string, t int, v double, done boolean"
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part[::-1], schema).coalesce(1).write.mode("append").parquet(source)
        stream = ingest.frame_stream(spark, source, schema)
        ingest.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"), shape=lambda s: ingest.live_phases(s, "traj", "t", "v", "done"))
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).collect():
        got.setdefault(r.traj, []).append((r.start_frame, r.end_frame, r.phase))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(gripper_phases(x)) for k, x in signals.items()}


@needs_tables
def test_annotate_scores_candidates_of_all_lines(spark, monkeypatch):
    from trailmill.plans import annotate as an

    seen, real = [], an.candidates
    monkeypatch.setattr(an, "candidates", lambda found, *a, **k: seen.append(found) or real(found, *a, **k))
    assert an.annotate(spark, SF_DIR).count() > 0
    assert seen[0].count() == spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
