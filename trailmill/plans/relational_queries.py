"""Queries of indexing, resuming, merging, sampling, text and publication."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import relational as rel
from .registry import query, table


@query("q_task_lookup_left", "SELECT c_custkey, lower(n_name) AS task FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def task_lookup_left(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.lower("n_name").alias("task"))
    return rel.looked_up(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), nations, [("c_nationkey", "n_nationkey")], "task", "task").select("c_custkey", "task")


@query("q_two_level_fallback", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(p.p_name, s.s_name) AS name FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size > 25) p ON l_partkey = p_partkey LEFT JOIN supplier s ON l_suppkey = s_suppkey")
def two_level_fallback(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    parts = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey", F.lit(None).cast("bigint").alias("s_suppkey"), F.col("p_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.lit(None).cast("bigint").alias("p_partkey"), "s_suppkey", F.col("s_name").alias("name"))
    return rel.looked_up(lines, parts.unionByName(suppliers), [("l_partkey", "p_partkey"), ("l_suppkey", "s_suppkey")], "name", "name")


@query("q_resume_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resume_anti(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return rel.remaining(table(spark, sf_dir, "customer").select("c_custkey"), done, "c_custkey")


@query("q_gt_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def gt_semi(spark, sf_dir):
    return rel.selected(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id")


@query(
    "q_merge_distinct",
    """WITH u AS (SELECT o_custkey AS k, o_orderkey, 0 AS s FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'O'),
 r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s, o_orderkey) AS p FROM u) SELECT k, o_orderkey FROM r WHERE p = 1""",
)
def merge_distinct(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", "o_orderstatus")
    parts = [orders.where("o_orderstatus = 'O'").drop("o_orderstatus"), orders.where("o_orderstatus <> 'O'").drop("o_orderstatus")]
    return rel.merged(parts, ["k"], ["o_orderkey"])


@query("q_union_sources", "SELECT 'customer' AS kind, c_custkey AS id, c_name AS name, NULL::INTEGER AS size FROM customer UNION ALL SELECT 'part', p_partkey, p_name, p_size FROM part")
def union_sources(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    return c.unionByName(p, allowMissingColumns=True)


@query(
    "q_natural_sort_rank",
    """WITH p AS (SELECT o_orderkey, o_orderkey % 12 AS a, o_orderkey % 7 AS b, o_orderkey AS c FROM orders) SELECT a || '/' || b || '/' || c AS path, row_number() OVER (PARTITION BY a ORDER BY b, c) AS rank FROM p""",
)
def natural_sort_rank(spark, sf_dir):
    """Places of paths in natural order within their first part, so that no task sorts everything."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    paths = table(spark, sf_dir, "orders").select(F.concat_ws("/", (k % 12).cast("string"), (k % 7).cast("string"), k.cast("string")).alias("path"))
    numbers = tx.path_numbers(F.col("path"))
    return paths.select("path", F.row_number().over(Window.partitionBy(numbers[0]).orderBy(numbers)).cast("bigint").alias("rank"))


@query(
    "q_index_funnel",
    """SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 200000) AS large FROM orders GROUP BY o_orderpriority""",
)
def index_funnel(spark, sf_dir):
    n = lambda c, name: F.count_if(c).alias(name)
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), n(F.col("o_orderstatus") == "F", "finished"), n(F.col("o_totalprice") > 200000, "large")
    )


@query("q_group_collect", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def group_collect(spark, sf_dir):
    grouped = rel.collected(table(spark, sf_dir, "nation"), ["n_regionkey"], "n_name")
    return grouped.select("n_regionkey", F.array_join("values", ",").alias("names"))


@query("q_max_per_group", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS p FROM documents) WHERE p <= 5")
def max_per_group(spark, sf_dir):
    return rel.per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", 5, keys=["doc_id"]).select("source", "doc_id")


@query(
    "q_stratified_sample",
    """WITH c AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), q AS (SELECT lang, n, 100.0 * n / (SELECT sum(n) FROM c) AS share FROM c),
 f AS (SELECT *, floor(share) AS fl, row_number() OVER (ORDER BY share - floor(share) DESC, n DESC, lang DESC) AS p FROM q), a AS (SELECT lang, fl + CASE WHEN p <= 100 - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS quota FROM f),
 k AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) AS place FROM documents) SELECT k.lang, k.doc_id FROM k JOIN a ON a.lang = k.lang WHERE place <= quota""",
)
def stratified_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    return rel.stratified(docs, "lang", rel.seeded(42, "doc_id"), rel.allocated(counts, 100)).select("lang", "doc_id")


@query("q_shuffled_limit", "SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50")
def shuffled_limit(spark, sf_dir):
    """A seeded shuffle with a limit: what a quick look at a dataset draws."""
    return rel.shuffled(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 50)


SCORES = "SELECT doc_id, quality * 1.2 - toxic * 0.3 AS s FROM labels"


@query("q_reliability_filter", f"WITH s AS ({SCORES}) SELECT d.doc_id, d.source FROM documents d JOIN s USING (doc_id) WHERE s >= 0.95")
def reliability_filter(spark, sf_dir):
    """Annotations whose score is at least 0.95: one JSON line for each label, parsed as a file would be."""
    from ..sources.annotations import parsed, reliable

    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 1.2 - F.col("toxic") * 0.3).alias("score"))
    lines = labels.select("doc_id", F.to_json(F.struct(F.struct("score").alias("selection"))).alias("line"))
    kept = reliable(parsed(lines, "line"), 0.95)
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(kept.select("doc_id"), "doc_id")


@query("q_all_arms_pass", "SELECT o_orderkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey HAVING min(l_quantity / 25.0) >= 0.95")
def all_arms_pass(spark, sf_dir):
    """Every arm must pass: the lines of an order are its arms."""
    from ..sources.annotations import parsed, reliable

    arms = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.struct((F.col("l_quantity") / 25.0).alias("score")).alias("selection"))).alias("arms"))
    lines = arms.select(F.col("l_orderkey").alias("o_orderkey"), F.to_json(F.struct("arms")).alias("line"))
    known = table(spark, sf_dir, "orders").select("o_orderkey")
    return reliable(parsed(lines, "line"), 0.95).select("o_orderkey").join(known, "o_orderkey", "left_semi")


@query("q_schema_gate", "SELECT event_id FROM events WHERE event_id % 3 = 0")
def schema_gate(spark, sf_dir):
    from ..sources.annotations import parsed, published

    version = F.when(F.col("event_id") % 3 == 0, "2.0").otherwise("1.0")
    schema = F.struct(F.lit("trailmill.annotation").alias("name"), version.alias("version"))
    return published(parsed(table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(schema.alias("schema"))).alias("line")), "line")).select("event_id")


@query(
    "q_task_group",
    """SELECT p_partkey, CASE WHEN contains(a, 'pick') OR contains(a, 'place') OR contains(a, 'move') THEN 'movement_relocate' WHEN contains(a, 'open') OR contains(a, 'close') THEN 'non_movement_open_close' WHEN contains(a, 'push') OR contains(a, 'turn') THEN 'movement_articulate'
 WHEN contains(a, 'press') THEN 'non_movement_articulate' ELSE 'other' END AS task_group FROM (SELECT p_partkey, ['Replace it', 'open DOOR', 'press', 'push', 'dance', 'Turn key'][p_partkey % 6 + 1] AS raw, lower(raw) AS a FROM part)""",
)
def task_group(spark, sf_dir):
    actions = F.array(*(F.lit(x) for x in ("Replace it", "open DOOR", "press", "push", "dance", "Turn key")))
    return table(spark, sf_dir, "part").select("p_partkey", tx.task_group(actions[(F.col("p_partkey") % 6).cast("int")]).alias("task_group"))


@query("q_navigation_filter", "SELECT event_id FROM events WHERE NOT starts_with(lower(['move to A', 'Grasp', 'return to B', 'place'][event_id % 4 + 1]), 'move to ') AND NOT starts_with(lower(['move to A', 'Grasp', 'return to B', 'place'][event_id % 4 + 1]), 'return to ')")
def navigation_filter(spark, sf_dir):
    labels = F.array(*(F.lit(x) for x in ("move to A", "Grasp", "return to B", "place")))
    return table(spark, sf_dir, "events").where(~tx.is_navigation(labels[(F.col("event_id") % 4).cast("int")])).select("event_id")


@query(
    "q_name_tokens",
    """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: w NOT IN ('a', 'an', 'the')), lambda w: regexp_replace(w, '^(..+[^s])s$', '\\1')))), ' ') AS tokens FROM part""",
)
def name_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(tx.name_tokens(F.col("p_name")), " ").alias("tokens"))


@query("q_bilingual_label", "SELECT p_partkey, lower(trim(p_brand)) AS label FROM part")
def bilingual_label(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", tx.english_label(F.concat(F.lit("零件@ "), "p_brand", F.lit(" "))).alias("label"))


@query("q_annotation_id", """SELECT o_orderkey, 'sha256:' || sha256('{"camera":null,"episode":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') AS annotation_id FROM orders""")
def annotation_id(spark, sf_dir):
    ident = tx.annotation_id(("status", F.col("o_orderstatus")), ("episode", F.col("o_orderkey")), ("camera", F.lit(None).cast("string")))
    return table(spark, sf_dir, "orders").select("o_orderkey", ident.alias("annotation_id"))


@query(
    "q_verdict_parse",
    """WITH a AS (SELECT conv_id, turn, ['**Verdict: YES**', 'well' || chr(10) || 'I say no', '**verdict: uncertain**', 'maybe'][turn % 4 + 1] AS t FROM conversations) SELECT conv_id, turn, CASE WHEN lower(t) LIKE '%**verdict: yes**%' THEN 1.0::DOUBLE WHEN t LIKE '%say no' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS verdict FROM a""",
)
def verdict_parse(spark, sf_dir):
    answers = F.array(*(F.lit(x) for x in ("**Verdict: YES**", "well\nI say no", "**verdict: uncertain**", "maybe")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.verdict(answers[(F.col("turn") % 4).cast("int")]).alias("verdict"))


@query("q_model_json", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def model_json(spark, sf_dir):
    """Model output, fenced as models like to: an object, read as an array of one."""
    raw = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", tx.model_output(raw, "struct<k:bigint>")[0]["k"].alias("k"))


@query("q_publish_rows", "SELECT o_orderkey, count(*) AS n_arms, round(min(l_quantity), 4) AS least FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def publish_rows(spark, sf_dir):
    """Published rows with their arms, written as JSON and read again."""
    from ..sources.annotations import annotation_rows

    arms = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trajectory_id"), F.col("l_quantity").alias("score"))
    rows = annotation_rows(arms, "trajectory_id", "score")
    back = F.from_json("line", "trajectory_id bigint, arms array<struct<selection:struct<score:double>>>")
    out = rows.select(back.alias("r")).select(F.col("r.trajectory_id").alias("o_orderkey"), F.size("r.arms").cast("bigint").alias("n_arms"), F.round(F.array_min("r.arms.selection.score"), 4).alias("least"))
    return out.join(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", "left_semi")


@query("q_model_stage_dedup", "SELECT DISTINCT user_id, event_type FROM events WHERE event_type <> 'view'")
def model_stage_dedup(spark, sf_dir):
    """Requests to a model: those not in the cache, each key once."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    cached = events.where("event_type = 'view'").distinct()
    return events.join(cached, ["user_id", "event_type"], "left_anti").dropDuplicates(["user_id", "event_type"])
