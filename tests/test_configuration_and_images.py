from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.sources import configuration as cf
from trailmill.sources import datasets as ds
from trailmill.sources import images as im


def test_settings_are_merged_and_filled_in():
    got = cf.resolved("bridge", given={"annotator": {"most_candidates": 5}, "dataset": {"root": "/data/b/"}}, overrides=["annotator.most_candidates=7", "dataset.subsets=[\"x\"]", "requests.attempts=3"])
    assert got["annotator"]["most_candidates"] == 7 and got["dataset"]["subsets"] == ["x"] and got["requests"] == {"in_flight": 16, "attempts": 3}
    assert got["annotator"]["output_file"] == "/data/b/bridge_annotations.jsonl" and got["dataset"]["spec"]["name"] == "bridge"
    assert cf.DEFAULTS["annotator"]["most_candidates"] == 22
    own = cf.resolved("droid", overrides=["dataset.root=/d", "annotator.output_file=/elsewhere/x.jsonl"])
    assert own["annotator"]["output_file"] == "/elsewhere/x.jsonl"


@pytest.mark.parametrize("name, overrides", [("nowhere", ["dataset.root=/d"]), ("droid", []), ("droid", ["dataset.root=/d", "annotator.tracking_mode=old"]), ("droid", ["dataset.root=/d", "annotator.speed=9"]), ("droid", ["dataset.root"]), ("droid", ["dataset.root=/d", "dataset.root.x=1"])])
def test_settings_that_mean_nothing_are_refused(name, overrides):
    with pytest.raises(ValueError):
        cf.resolved(name, overrides=overrides)


def test_resolved_form_is_written_once(spark, tmp_path):
    one = cf.resolved("droid", overrides=["dataset.root=/d", "requests.attempts=5"])
    path = cf.write(spark, one, str(tmp_path))
    assert cf.read(spark, path) == json.loads(json.dumps(one))
    cf.write(spark, one, str(tmp_path))
    assert spark.read.text(path).count() == 1


def test_frames_are_decoded_in_the_asked_order(spark):
    rng = np.random.default_rng(3)
    video = rng.integers(0, 256, (20, 6, 8, 3), dtype=np.uint8)
    rows = [(1, im.raw_video(video), [19, 3, 3, -4, 99]), (2, None, [1]), (3, im.raw_video(video[:0]), [0])]
    df = spark.createDataFrame(rows, "k int, content binary, indices array<bigint>")
    got = {r.k: r.frames for r in im.decoded(df).collect()}
    assert [f["index"] for f in got[1]] == [19, 3, 3, 0, 19] and got[2] is None and got[3] == []
    assert all((np.frombuffer(f["data"], np.uint8).reshape(6, 8, 3) == video[f["index"]]).all() for f in got[1])
    small = im.decoded(df.where("k = 1"), size=(3, 4)).first().frames
    want = np.floor(video[19].reshape(3, 2, 4, 2, 3).mean(axis=(1, 3)) + 0.5)
    assert (np.frombuffer(small[0]["data"], np.uint8).reshape(3, 4, 3) == want).all()


def test_times_become_frames(spark):
    df = spark.createDataFrame([([0.0, 0.24, 0.26, 9.0],)], "t array<double>")
    assert df.select(im.frame_indices(F.col("t"), F.lit(0.0), F.lit(10), F.lit(21))).first()[0] == [0, 2, 3, 20]


def test_an_index_of_a_builder_that_died_is_built_again(spark, tmp_path):
    build = lambda: spark.range(3)
    path = ds.cached_index(spark, str(tmp_path), "x", ["a"], build).inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    import os

    os.remove(f"{path}/_SUCCESS")
    assert ds.cached_index(spark, str(tmp_path), "x", ["a"], build).count() == 3
    assert not [p for p in os.listdir(tmp_path) if ".building-" in p]


def test_tasks_of_a_table_are_numbered_as_they_lie(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    spark.createDataFrame([(t,) for t in "zyxab"], "task string").coalesce(1).write.parquet(f"{tmp_path}/meta/tasks.parquet")
    assert [r.task for r in ds.tasks(spark, str(tmp_path), True).orderBy("task_index").collect()] == list("zyxab")


def test_datasets_of_a_tree(spark, tmp_path):
    for leaf, n in (("home/a", 3), ("home/b c", 2), ("shop/x/y", 1)):
        (tmp_path / leaf / "meta").mkdir(parents=True)
        (tmp_path / leaf / "meta" / "info.json").write_text("{}")
        spark.range(n).selectExpr("cast(id as string) as trajectory_id").write.parquet(f"{tmp_path}/{leaf}/data")
    (tmp_path / "home" / "info.json").write_text("{}")
    (tmp_path / "bad" / "meta").mkdir(parents=True)
    (tmp_path / "bad" / "meta" / "info.json").write_text("{}")
    assert ds.leaves(spark, str(tmp_path)) == ["bad", "home/a", "home/b c", "shop/x/y"]
    rows = ds.tree(spark, str(tmp_path), "ego", lambda s, folder: s.read.parquet(f"{folder}/data")).collect()
    assert len(rows) == 6 and {r.trajectory_id for r in rows if r.dataset == "ego/home/b c"} == {"ego/home/b c/0", "ego/home/b c/1"}
    assert ds.tree(spark, str(tmp_path), "ego", lambda s, folder: s.read.parquet(f"{folder}/data"), ["shop/x/y"]).count() == 1
    with pytest.raises(ValueError):
        ds.tree(spark, str(tmp_path), "ego", lambda s, folder: s.read.parquet(f"{folder}/data"), ["bad"])


def test_raw_tracks_are_stored_in_the_original_image(spark):
    from trailmill.sources import arrays

    tensor = lambda v: {"dtype": v.dtype.name, "shape": list(v.shape), "data": bytearray(v.tobytes())}
    tracks = np.array([[[10, 20], [-1, -1]]], np.float32)
    bundle = {"cotracker_tracks": tensor(tracks), "winner_idx": tensor(np.array([3], np.int32)), "candidate_masks": tensor(np.ones(2, np.uint8)), "gripper_tracks_3d": tensor(np.ones((1, 3), np.float32))}
    df = spark.createDataFrame([(bundle,)], f"arrays {arrays.BUNDLE}")
    got = arrays.raw_tracks(df, "arrays", F.lit(5), F.lit(7), F.lit(0.5)).first().arrays
    assert set(got) == {"cotracker_tracks", "winner_idx"} and got["cotracker_tracks"].dtype == "float16"
    assert arrays.unpack(got["cotracker_tracks"].asDict()).tolist() == [[[30, 54], [-1, -1]]] and arrays.unpack(got["winner_idx"].asDict()).tolist() == [3]
    name = spark.createDataFrame([("/a b/c\\d/",)], "t string").select(arrays.stored_name(F.col("t"), F.lit(4))).first()[0]
    assert name == "a_b_c_d_4"


def test_remote_models():
    from trailmill.plans.model_stages import Remote

    calls = []

    def send(method, arguments, seconds):
        calls.append((method, arguments))
        if len(calls) < 3:
            raise ConnectionError("not yet")
        if method == "verify":
            raise ValueError("the model's own")
        return "answer"

    assert Remote(send, pause=0).parse("a", "b") == "answer" and calls == [("parse", ("a", "b"))] * 3
    with pytest.raises(ValueError):
        Remote(send, pause=0).verify("x", None)
    calls.clear()
    with pytest.raises(ConnectionError):
        Remote(send, attempts=2, pause=0).parse("a", "b")
