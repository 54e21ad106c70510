"""Configuration: a catalogue of datasets with defaults, overrides by dotted names, and the resolved form beside the output.

A configuration is a tree of plain values. It is made from the defaults, the dataset's entry, a file (JSON) and
overrides, later ones first; what depends on other values is filled in last, and what was retired is refused, so
that a run never ignores a setting in silence.
"""

from __future__ import annotations

import copy
import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from .datasets import PRESETS

DEFAULTS = {
    "annotator": {
        "detector": "boxes", "tracker": "still", "detection_threshold": 0.3, "most_candidates": 22, "tracking_fps": 6.0, "most_frames": 800,
        "robot_frames": 64, "shard_bytes": 1 << 30, "output_file": None, "task_cache": None,
    },
    "requests": {"in_flight": 16, "attempts": 2},
    "dataset": {"name": None, "root": None, "fps": 30.0, "subsets": []},
}
#: Names that are no settings any more, and what to do instead.
RETIRED = {
    "annotator.tracking_mode": "delete it: there is one way of tracking",
    "annotator.n_tracker_instances": "the number of workers is the session's number of cores",
    "annotator.num_workers": "the number of workers is the session's number of cores",
}


def merged(base: dict, over: dict) -> dict:
    """Both trees in one; the second's values win, lists are replaced whole."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def from_dotted(overrides: list[str]) -> dict:
    """A tree of `a.b=value` settings; values are JSON, or else text."""
    out: dict = {}
    for item in overrides:
        name, equals, text = item.partition("=")
        if not equals or not name:
            raise ValueError(f"an override is name=value, not {item!r}")
        try:
            value = json.loads(text)
        except ValueError:
            value = text
        *path, last = name.split(".")
        at = out
        for part in path:
            at = at.setdefault(part, {})
            if not isinstance(at, dict):
                raise ValueError(f"{name} lies under a setting with a value")
        at[last] = value
    return out


def _names(tree: dict, prefix: str = "") -> list[str]:
    return [n for k, v in tree.items() for n in (_names(v, f"{prefix}{k}.") if isinstance(v, dict) and v else [f"{prefix}{k}"])]


def resolved(dataset: str, *, given: dict | None = None, overrides: list[str] = ()) -> dict:
    """The whole configuration of a run. Unknown datasets, unknown or retired settings and a missing root raise."""
    if dataset not in PRESETS:
        raise ValueError(f"unknown dataset {dataset!r}; there are {sorted(PRESETS)}")
    own = merged(given or {}, from_dotted(list(overrides)))
    for name in _names(own):
        if name in RETIRED:
            raise ValueError(f"{name} was retired: {RETIRED[name]}")
    known = set(_names(DEFAULTS)) | {"dataset.subsets"}
    if unknown := sorted(set(_names(own)) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    out = merged(merged(DEFAULTS, {"dataset": {"name": dataset}}), own)
    if not out["dataset"]["root"]:
        raise ValueError("set dataset.root to the dataset's folder")
    out["dataset"]["root"] = out["dataset"]["root"].rstrip("/")
    name, root = out["dataset"]["name"], out["dataset"]["root"]
    out["annotator"]["output_file"] = out["annotator"]["output_file"] or f"{root}/{name}_annotations.jsonl"
    out["annotator"]["task_cache"] = out["annotator"]["task_cache"] or f"{root}/{name}_tasks"
    out["dataset"]["spec"] = asdict(PRESETS[dataset])
    return out


def read(spark: SparkSession, path: str) -> dict:
    """A configuration's file, from any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write(spark: SparkSession, configuration: dict, folder: str) -> str:
    """Writes the resolved configuration beside a run's output, once for a run; where it lies. The text is the
    same for equal configurations, whatever order their settings were given in."""
    text = json.dumps(configuration, sort_keys=True, ensure_ascii=False)
    path = f"{folder.rstrip('/')}/resolved-configuration"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path
