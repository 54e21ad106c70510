"""Queries with state along a trajectory, of model stages, streams and array bundles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import phases as ph
from ..operators import sequences as seq
from ..streaming import ingest
from . import models
from .registry import frames, query, table, tracks


#: The phase machine, a frame at a time: a first walk measures the grips, a second one labels with what they say. A walk's
#: state is its phase, where that began, the streak of frames that would end it, and the last release, which a grasp that is
#: too short may shorten.
MACHINE = """u AS (SELECT traj, min(signal) AS lo, max(signal) AS hi, count(*) AS n FROM v_frames GROUP BY traj),
 c AS (SELECT *, hi - lo < 0.05::DOUBLE OR (hi - lo < 0.1::DOUBLE AND lo > 0.9::DOUBLE) AS flat, least(7, CAST(floor(0.2::DOUBLE * n) AS BIGINT)) AS shortest, least(5, CAST(floor(0.05::DOUBLE * n) AS BIGINT)) AS need, 0.6::DOUBLE - 0.05::DOUBLE AS enter_at, 0.6::DOUBLE + 0.05::DOUBLE AS leave_at FROM u),
 x AS (SELECT f.traj, f.t, (f.signal - lo) / (hi - lo + 1e-8::DOUBLE) AS x FROM v_frames f JOIN c ON c.traj = f.traj WHERE NOT flat),
 w1 AS (SELECT traj, CAST(-1 AS BIGINT) AS t, 'grasp' AS state, CAST(0 AS BIGINT) AS mark, CAST(0 AS BIGINT) AS streak, CAST(NULL AS BIGINT) AS grip FROM c WHERE NOT flat
  UNION ALL SELECT traj, t, CASE WHEN state = 'release' THEN CASE WHEN over THEN 'grasp' ELSE state END WHEN fires THEN CASE state WHEN 'grasp' THEN 'interact' ELSE 'release' END ELSE state END,
   CASE WHEN state = 'release' THEN CASE WHEN over THEN t ELSE mark END WHEN fires THEN t - k + 1 ELSE mark END, CASE WHEN state = 'release' OR fires THEN 0 ELSE k END, CASE WHEN state = 'interact' AND fires THEN t - k + 1 - mark END
  FROM (SELECT *, k > 0 AND k >= need AS fires FROM (SELECT r.traj, x.t, r.state, r.mark, c.need, x.t - r.mark >= c.shortest // 2 OR x.x < enter_at AS over, CASE WHEN CASE r.state WHEN 'grasp' THEN x.x < enter_at ELSE x.x >= leave_at END THEN r.streak + 1 ELSE 0 END AS k FROM w1 r JOIN x ON x.traj = r.traj AND x.t = r.t + 1 JOIN c ON c.traj = r.traj))),
 g1 AS (SELECT traj, grip FROM w1 WHERE grip IS NOT NULL UNION ALL SELECT w1.traj, CASE state WHEN 'interact' THEN n - mark ELSE streak END FROM w1 JOIN c ON c.traj = w1.traj WHERE w1.t = n - 1 AND (state = 'interact' OR state = 'grasp' AND streak > 0 AND streak >= shortest // 2)),
 g AS (SELECT c.*, count(grip) AS grips, min(grip) AS smallest, median(grip) AS middle, any_value(grip) AS one FROM c LEFT JOIN g1 ON g1.traj = c.traj WHERE NOT flat GROUP BY ALL),
 p AS (SELECT traj, n, enter_at, leave_at, least(shortest, coalesce(smallest, shortest)) AS shortest, CASE WHEN grips = 1 THEN one - 1 ELSE least(greatest(4, 0.5::DOUBLE * (0.07::DOUBLE * n) / greatest(grips, 1), coalesce(0.4::DOUBLE * middle, 0)), 0.3::DOUBLE * n / greatest(grips, 1)) END AS need_grip FROM g),
 w2 AS (SELECT traj, CAST(-1 AS BIGINT) AS t, 'grasp' AS state, CAST(0 AS BIGINT) AS mark, CAST(0 AS BIGINT) AS streak, CAST(NULL AS BIGINT) AS rf, CAST(NULL AS BIGINT) AS rl, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS z, CAST(NULL AS VARCHAR) AS phase, CAST(0 AS BIGINT) AS take FROM p
  UNION ALL SELECT traj, t, CASE WHEN state = 'release' THEN CASE WHEN over THEN 'grasp' ELSE state END WHEN NOT fires THEN state WHEN state = 'grasp' THEN 'interact' WHEN good THEN 'release' ELSE 'grasp' END,
   CASE WHEN state = 'release' THEN CASE WHEN over THEN t ELSE mark END WHEN fires THEN pos ELSE mark END, CASE WHEN state = 'release' OR fires THEN 0 ELSE k END,
   CASE WHEN state = 'release' AND over AND t > mark THEN mark WHEN state <> 'release' AND fires AND pos > mark - took THEN NULL ELSE rf END,
   CASE WHEN state = 'release' AND over AND t > mark THEN t - 1 WHEN state <> 'release' AND fires AND pos > mark - took THEN NULL ELSE rl - took END,
   CASE WHEN state = 'release' AND over AND t > mark OR state <> 'release' AND fires AND pos > mark - took THEN mark - took END, CASE WHEN state = 'release' AND over AND t > mark THEN t - 1 WHEN state <> 'release' AND fires AND pos > mark - took THEN pos - 1 END,
   CASE WHEN state = 'release' THEN 'release' WHEN state = 'grasp' THEN 'grasp' WHEN good THEN 'interact' ELSE 'grasp_failure' END, took
  FROM (SELECT *, pos - mark >= need_grip AS good, CASE WHEN state = 'grasp' AND fires AND pos - mark < need_grip AND rf IS NOT NULL THEN CAST(floor(least(need_grip - (pos - mark), greatest(0, least(rl - rf + 1 - greatest(1, shortest // 2), rl - rf)))) AS BIGINT) ELSE 0 END AS took
  FROM (SELECT *, k > 0 AND k >= shortest AS fires, t - k + 1 AS pos FROM (SELECT r.traj, x.t, r.state, r.mark, r.rf, r.rl, p.shortest, p.need_grip, x.t - r.mark >= p.shortest // 2 OR x.x < enter_at AS over, CASE WHEN CASE r.state WHEN 'grasp' THEN x.x < enter_at ELSE x.x >= leave_at END THEN r.streak + 1 ELSE 0 END AS k FROM w2 r JOIN x ON x.traj = r.traj AND x.t = r.t + 1 JOIN p ON p.traj = r.traj)))),
 l AS (SELECT w2.*, n, p.shortest, need_grip FROM w2 JOIN p ON p.traj = w2.traj WHERE w2.t = n - 1),
 e AS (SELECT traj, t * 4 AS o, a, z, phase, take FROM w2 WHERE a IS NOT NULL OR take > 0
  UNION ALL SELECT traj, t * 4 + 1, mark, n - 1, state, 0 FROM l WHERE state = 'interact' AND n - mark >= need_grip OR state = 'release'
  UNION ALL SELECT traj, t * 4 + 2, mark, n - streak - 1, 'grasp', 0 FROM l WHERE state = 'grasp' AND streak > 0 AND streak >= shortest // 2 AND n - streak > mark
  UNION ALL SELECT traj, t * 4 + 3, n - streak, n - 1, 'interact', 0 FROM l WHERE state = 'grasp' AND streak > 0 AND streak >= shortest // 2),
 s AS (SELECT *, coalesce(lead(take) OVER (PARTITION BY traj ORDER BY o), 0) AS given FROM e), q AS (SELECT traj, o, a, z - CASE WHEN phase = 'release' THEN given ELSE 0 END AS z, phase FROM s WHERE a IS NOT NULL),
 y AS (SELECT q.*, n, row_number() OVER (PARTITION BY q.traj ORDER BY o DESC) AS back, lag(phase) OVER (PARTITION BY q.traj ORDER BY o) AS before, lead(phase) OVER (PARTITION BY q.traj ORDER BY o) AS next FROM q JOIN p ON p.traj = q.traj),
 done AS (SELECT traj, a AS start_frame, CASE WHEN phase = 'release' AND (back = 1 OR back = 2 AND next = 'grasp') THEN n - 1 ELSE z END AS end_frame, phase FROM y WHERE NOT (back = 1 AND phase = 'grasp' AND coalesce(before, '') = 'release')
  UNION ALL SELECT traj, 0, n - 1, 'interact' FROM c WHERE traj NOT IN (SELECT traj FROM q))"""


@query("q_gripper_phases", f"WITH RECURSIVE {MACHINE} SELECT traj, start_frame, end_frame, phase FROM done")
def gripper_phases(spark, sf_dir):
    """Debounced phases of every trajectory; held against a frame-by-frame machine in the tests too."""
    return ph.detect_phases(frames(spark, sf_dir), "traj", "t", "signal", 0.05)


STEPS = """l AS (SELECT l_orderkey AS traj, l_linenumber AS n, l_linenumber * 10 AS s, l_linenumber * 10 + 5 + 5 * (l_partkey % 2) AS e, l_partkey % 5 AS sk, CASE l_partkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS arm, ['Pick', 'Move', 'Place', 'Carry', 'Pour'][l_partkey % 5 + 1] || ' with ' || ['left', 'right', 'any'][l_partkey % 3 + 1] AS label FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY s, e, label) AS i FROM l)"""


def _steps(spark, sf_dir):
    """Steps of an order's lines: an arm and a skill each."""
    skills = F.array(*(F.lit(s) for s in ("Pick", "Move", "Place", "Carry", "Pour")))
    arms = F.array(*(F.lit(a) for a in ("left arm.", "right arm.", "any arm.")))
    k = F.col("l_partkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("traj"), (F.col("l_linenumber") * 10).cast("bigint").alias("start_frame"), (F.col("l_linenumber") * 10 + 5 + 5 * (k % 2)).cast("bigint").alias("end_frame"),
        F.concat_ws(" ", skills[(k % 5).cast("int")], F.lit("with"), arms[(k % 3).cast("int")]).alias("label"), skills[(k % 5).cast("int")].alias("skill"),
    )


@query(
    "q_subtask_groups",
    f"""WITH RECURSIVE {STEPS}, r AS (SELECT traj, i, s, e, sk, arm, 0 AS g, arm AS garm, sk = 2 AS ended FROM o WHERE i = 1
 UNION ALL SELECT traj, i, s, e, sk, arm, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN garm ELSE arm END, CASE WHEN j THEN ended ELSE sk = 2 END FROM
 (SELECT o.traj, o.i, o.s, o.e, o.sk, o.arm, r.g, r.ended, CASE WHEN o.s = r.e THEN coalesce(r.garm, o.arm) ELSE r.garm END AS garm, coalesce(NOT r.ended AND o.sk <> 0 AND CASE WHEN o.s = r.e THEN coalesce(r.garm, o.arm) ELSE r.garm END = CASE WHEN o.s = r.e THEN coalesce(o.arm, r.garm) ELSE o.arm END, FALSE) AS j FROM r JOIN o ON o.traj = r.traj AND o.i = r.i + 1))
 SELECT traj, CAST(g AS BIGINT) AS subtask, min(s) AS start_frame, max_by(e, i) AS end_frame, count(*) AS n_steps, string_agg(['pick', 'move', 'place', 'carry', 'pour'][sk + 1] || ' with ' || coalesce(arm, 'any') || ' arm', ' then ' ORDER BY i) AS instruction, CAST(max(max(g)) OVER (PARTITION BY traj) + 1 AS BIGINT) AS longtask_len FROM r GROUP BY traj, g""",
)
def subtask_groups(spark, sf_dir):
    """Steps in groups of one arm, which a first skill that ends an interaction closes."""
    return ph.group_steps(_steps(spark, sf_dir), "traj")


LABELS = ("Grasp the cup", "Pick up a bowl", "Hold it", "Place the cup", "Move slowly", "Put the bowl down", "Wait")


def noun_of(label: str) -> str | None:
    return next((n for n in ("cup", "bowl") if n in label), None)


@query(
    "q_label_groups",
    """WITH RECURSIVE l AS (SELECT l_orderkey AS traj, l_linenumber * 10 AS s, l_linenumber * 10 + 5 + 5 * (l_partkey % 2) AS e, l_suppkey % 7 AS k, CASE l_partkey % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' END AS arm, ['Grasp the cup', 'Pick up a bowl', 'Hold it', 'Place the cup', 'Move slowly', 'Put the bowl down', 'Wait'][l_suppkey % 7 + 1] || [', left', ', right', ''][l_partkey % 3 + 1] AS label FROM lineitem), q AS (SELECT *, CASE WHEN k IN (0, 3) THEN 'cup' WHEN k IN (1, 5) THEN 'bowl' END AS noun, k IN (3, 5) AS ends, k IN (0, 1) AS starts FROM l), o AS (SELECT *, row_number() OVER (PARTITION BY traj ORDER BY s, e, label) AS i FROM q),
 r AS (SELECT traj, i, s, e, k, 0 AS g, arm AS garm, noun AS gn, ends AS ended FROM o WHERE i = 1
 UNION ALL SELECT traj, i, s, e, k, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN coalesce(raw, garm) ELSE raw END, CASE WHEN j THEN coalesce(noun, gn) ELSE noun END, ends FROM
 (SELECT o.traj, o.i, o.s, o.e, o.k, o.arm AS raw, o.noun, o.ends, r.g, r.gn, CASE WHEN o.s = r.e THEN coalesce(r.garm, o.arm) ELSE r.garm END AS garm,
 NOT (r.ended OR o.starts OR coalesce(CASE WHEN o.s = r.e THEN coalesce(r.garm, o.arm) ELSE r.garm END <> CASE WHEN o.s = r.e THEN coalesce(o.arm, r.garm) ELSE o.arm END, FALSE) OR coalesce(r.gn <> o.noun, FALSE)) AS j FROM r JOIN o ON o.traj = r.traj AND o.i = r.i + 1))
 SELECT traj, CAST(g AS BIGINT) AS subtask, min(s) AS start_frame, max_by(e, i) AS end_frame, count(*) AS n_steps FROM r GROUP BY traj, g""",
)
def label_groups(spark, sf_dir):
    """Steps that have labels alone, in groups of one arm and one object as far as they are known."""
    import functools

    text = F.array(*(F.lit(x) for x in LABELS))[(F.col("l_suppkey") % 7).cast("int")]
    arm = F.array(F.lit(", left"), F.lit(", right"), F.lit(""))[(F.col("l_partkey") % 3).cast("int")]
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("traj"), (F.col("l_linenumber") * 10).cast("bigint").alias("start_frame"), (F.col("l_linenumber") * 10 + 5 + 5 * (F.col("l_partkey") % 2)).cast("bigint").alias("end_frame"),
        F.concat(text, arm).alias("label"), F.lit("").alias("skill"),
    )
    return ph.group_steps(lines, "traj", functools.partial(ph.LabelRule, noun_of)).select("traj", "subtask", "start_frame", "end_frame", "n_steps")


@query(
    "q_split_on_jump",
    """WITH f AS (SELECT traj, t, CAST(event_id % 30 AS DOUBLE) AS x FROM v_frames), n AS (SELECT *, lag(x) OVER (PARTITION BY traj ORDER BY t) AS px FROM f),
 j AS (SELECT traj, t, CASE WHEN px IS NOT NULL AND (greatest(0.0, 10 - abs(x - px)) * 10) / (200 - greatest(0.0, 10 - abs(x - px)) * 10) < 0.1 THEN 1 ELSE 0 END AS c FROM n)
 SELECT traj, t, CAST(sum(c) OVER (PARTITION BY traj ORDER BY t) AS BIGINT) AS piece FROM j""",
)
def split_on_jump(spark, sf_dir):
    x = (F.col("event_id") % 30).cast("double")
    box = F.struct(x.alias("x1"), F.lit(0.0).alias("y1"), (x + 10).alias("x2"), F.lit(10.0).alias("y2"))
    out = seq.split_on_jump(frames(spark, sf_dir).withColumn("box", box), ["traj"], "t", "box")
    return out.select("traj", "t", F.col("piece").cast("bigint").alias("piece"))


@query(
    "q_task_parse_stage",
    "SELECT DISTINCT lower(p_brand) AS object, 'grasp_interact' AS phase_key FROM part",
)
def task_parse_stage(spark, sf_dir):
    """Instructions through the rule-based stand-in of a language model: asked once each."""
    asked = table(spark, sf_dir, "part").select(F.concat(F.lit("Pick the "), "p_brand", F.lit(" from table to shelf.")).alias("instruction"), F.lit("grasp_interact").alias("phase_key"))
    none = spark.createDataFrame([], "instruction string, phase_key string")
    answers = models.parse_tasks(models.requests(asked, none, ["instruction", "phase_key"]))
    return answers.select(F.get_json_object("answer", "$.object").alias("object"), "phase_key")


@query(
    "ext_session_trajectories",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS c FROM events), i AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
 SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM i GROUP BY user_id, s""",
)
def session_trajectories(spark, sf_dir):
    """Extension: trajectories that end when idle, by session windows; the same plan runs on streams."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = ingest.sessions(events, "user_id", "ts", "6 hours")
    return out.select("user_id", F.unix_micros("start_time").alias("start_us"), "n")


@query("q_array_bundles", "SELECT cand, 16 AS n_frames, round(avg(x), 2) AS mean_x FROM v_tracks WHERE pt = 0 GROUP BY cand")
def array_bundles(spark, sf_dir):
    """Traces as packed tensors in a bundle, written as text archives and read again."""
    from ..sources import arrays

    listed = F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda p: p["x"])
    traces = tracks(spark, sf_dir).where("pt = 0").groupBy("cand").agg(listed.alias("trace"))
    bundled = traces.select("cand", F.create_map(F.lit("trace"), arrays.tensor("trace", F.col("trace"), [16])).alias("arrays"))
    back = arrays.bundle_of_text(arrays.bundle_text(bundled, "arrays").select("cand", "blob"), "blob")

    @F.pandas_udf("struct<n_frames:int,mean_x:double>")
    def measured(dtype: pd.Series, data: pd.Series) -> pd.DataFrame:
        values = [np.frombuffer(d, k).astype(float) for k, d in zip(dtype, data, strict=True)]
        return pd.DataFrame({"n_frames": [len(v) for v in values], "mean_x": [float(v.mean()) for v in values]})

    entry = F.col("arrays")["trace"]
    out = back.select("cand", measured(entry["dtype"], entry["data"]).alias("m"))
    return out.select("cand", F.col("m.n_frames").alias("n_frames"), F.round("m.mean_x", 2).alias("mean_x"))


@query(
    "q_shards",
    """WITH b AS (SELECT o_orderpriority AS dataset, o_orderkey AS k, 16 * (1 + o_orderkey % 9) AS bytes FROM orders) SELECT k, CAST(floor(coalesce(sum(bytes) OVER (PARTITION BY dataset ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 4096) AS INTEGER) AS shard,
 'trajectories/t%2F' || k || '/subtasks/' || lpad(CAST(k % 7 AS VARCHAR), 4, '0') || '/id' || k AS place FROM b""",
)
def shards(spark, sf_dir):
    """Bundles of different sizes in shards of 4 KB, and where each lies in its own."""
    from ..sources import arrays

    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), k.alias("k"), F.repeat(F.lit("x"), (16 * (1 + k % 9)).cast("int")).cast("binary").alias("data"))
    bundle = F.create_map(F.lit("a"), F.struct(F.lit("uint8").alias("dtype"), F.array(F.lit(1)).alias("shape"), F.col("data").alias("data")))
    rows = arrays.sharded(orders.withColumn("arrays", bundle), ["dataset"], ["k"], arrays.bundle_bytes(F.col("arrays")), 4096)
    at = arrays.storage(F.concat(F.lit("t/"), F.col("k").cast("string")), F.col("k") % 7, F.concat(F.lit("id"), F.col("k").cast("string")), F.col("shard"))
    return rows.select("k", "shard", at["group"].alias("place"))
