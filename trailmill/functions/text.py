"""Text functions as columns: labels, nouns, tokens, verdicts, model output, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword groups of tasks, asked in this order; the first that occurs decides.
TASK_GROUPS = (
    (
        "movement_relocate",
        "pick", "place", "move", "lift", "remove", "transfer", "hand over", "stack", "unstack", "carry", "pass",
        "receive", "put away", "retrieve", "throw", "hang", "grasp", "uncover", "separate", "grab",
    ),
    ("non_movement_open_close", "open", "close"),
    ("movement_articulate", "push", "pull", "turn", "rotate", "flip", "flatten", "smooth", "spread", "clamp", "manipulate"),
    ("non_movement_articulate", "press", "switch"),
    ("non_movement_fluid", "pour", "scoop", "wash", "wipe", "sweep"),
    ("non_movement_tool_or_shape", "cut", "peeler", "fold", "unfold", "plug", "attach"),
)
#: The groups by which replayed scores are weighted: one more than the live ones.
REPLAY_GROUPS = (*TASK_GROUPS, ("other_interaction", "stamp"))
# Prefixes of labels that only move the robot.
NAVIGATION_PREFIXES = ("move to ", "return to ")
# How two-language labels (Chinese@English) begin that only move the body, and whole English ones.
BODY_PREFIXES_ZH = ("本体", "本机", "底盘", "躯体", "躯干", "机器", "恢复", "静止", "无任", "无动", "体回", "向右", "向左")
BODY_PREFIXES_EN = ("move chassis", "return to initial", "reset to initial", "reset body to")
BODY_LABELS_EN = (
    "halt", "halt robot", "no action", "do nothing", "perform no meaningful actions", "perform a meaningless action",
    "remain stationary", "remain still", "remain motionless", "remain completely still", "hold still",
    "machine not moving", "machine, do not move", "main body no action", "main body remains stationary",
    "main body, no action", "body remain stationary", "body remains stationary", "keep body stationary",
    "maintain body still", "maintain stationary",
)
ARTICLES = ("a", "an", "the")


def any_of(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def task_group(action: Column, groups=TASK_GROUPS) -> Column:
    low = F.lower(F.coalesce(action, F.lit("")))
    out = None
    for name, *words in groups:
        hit = any_of(low, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def is_navigation(label: Column, prefixes=NAVIGATION_PREFIXES) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(F.lower(F.trim(label)), F.lit(p))
    return out


def is_body_motion(label: Column) -> Column:
    """Whether a two-language label only moves the robot's body; a label of one language never does."""
    at = F.instr(label, "@")
    chinese = F.trim(F.substr(label, F.lit(1), F.greatest(at - 1, F.lit(0))))
    english = F.regexp_replace(F.lower(F.trim(F.substr(label, at + 1))), r"\.+$", "")
    found = english.isin(*BODY_LABELS_EN)
    for p in BODY_PREFIXES_ZH:
        found = found | F.startswith(chinese, F.lit(p))
    for p in BODY_PREFIXES_EN:
        found = found | F.startswith(english, F.lit(p))
    return F.coalesce((at > 0) & found, F.lit(False))


def english_label(label: Column) -> Column:
    """What stands behind the first @ of a two-language label, trimmed and lower-cased; else all."""
    at = F.instr(label, "@")
    return F.lower(F.trim(F.when(at > 0, F.substr(label, at + 1)).otherwise(label)))


def arm_side(label: Column) -> Column:
    low = F.lower(label)
    return F.when(F.contains(low, F.lit("left")), "left").when(F.contains(low, F.lit("right")), "right")


def name_tokens(name: Column) -> Column:
    """Distinct words of an object's name without articles, plurals cut."""
    words = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(*ARTICLES))
    cut = F.transform(words, lambda w: F.regexp_replace(w, "^(..+[^s])s$", "$1"))
    return F.array_sort(F.array_distinct(cut))


def instruction(labels: Column) -> Column:
    """Labels joined by ' then ', lower-cased, without closing full stops."""
    return F.array_join(F.transform(labels, lambda x: F.regexp_replace(F.lower(x), r"\.+$", "")), " then ")


def verdict(answer: Column) -> Column:
    """1 for yes, 0 for no, 0.5 else: by the marked verdict, or by the last line."""
    low = F.lower(answer)
    marked = F.regexp_extract(low, r"\*\*verdict:\s*(yes|no|uncertain)\*\*", 1)
    last = F.element_at(F.split(F.trim(low), "\n"), -1)
    told = F.when(F.contains(last, F.lit("yes")), 1.0).when(F.contains(last, F.lit("no")), 0.0).otherwise(0.5)
    return F.when(marked == "yes", 1.0).when(marked == "no", 0.0).when(marked == "uncertain", 0.5).otherwise(told)


def model_output(raw: Column, schema: str) -> Column:
    """A model's JSON, an object or an array of them, fenced or not, as an array; null if it is neither."""
    bare = F.trim(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1"))
    many = F.from_json(bare, f"array<{schema}>")
    return F.when(F.startswith(bare, F.lit("[")), many).when(F.startswith(bare, F.lit("{")), F.array(F.from_json(bare, schema)))


def path_numbers(path: Column) -> Column:
    """The parts of a path as numbers, for natural order; parts without digits are null."""
    return F.transform(F.split(path, "/"), lambda p: F.nullif(F.regexp_extract(p, r"\d+", 0), F.lit("")).cast("bigint"))


def canonical_json(*fields: tuple[str, Column]) -> Column:
    """JSON with sorted keys, no blanks, nulls kept and ASCII only, as other languages write it."""
    ordered = F.struct(*(c.alias(k) for k, c in sorted(fields, key=lambda f: f[0])))
    text = F.to_json(ordered, {"ignoreNullFields": "false", "writeNonAsciiCharacterAsCodePoint": "true"})
    # Escapes have lower-case digits elsewhere.
    return F.concat_ws("", F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\\u[0-9A-F]{4}|\\.|[^\\]+"), F.lit(0)), lambda p: F.when(F.startswith(p, F.lit("\\u")), F.lower(p)).otherwise(p)))


def annotation_id(*fields: tuple[str, Column]) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(*fields), 256))


def quoted(part: Column) -> Column:
    """A path part percent-coded; letters, digits and - . _ ~ stay."""
    coded = F.url_encode(part)
    for there, here in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        coded = F.replace(coded, F.lit(there), F.lit(here))
    return coded


def rounded(value: Column, digits: int = 6) -> Column:
    return F.when(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.round(value, digits))


# Patterns of the object in a label that takes something, and in one that puts it down.
TAKEN = (
    r"(?i)(?:simultaneously\s+)?(?:grab\s+and\s+(?:pick\s+up|lift)|pick\s+up|grasp|grab|take|retrieve)"
    r"\s+(?:the\s+)?(.+?)(?:\s+(?:from|with|on\s+the|into)|[,.]|$)"
)
PUT = r"(?i)(?:place|put|store|insert|return)\s+(?:the\s+)?(.+?)(?:\s+(?:into|onto|in\b|on\b|with\b|to\b)|[,.]|$)"


def object_noun(label: Column) -> Column:
    """The object that a label is about, lower-cased; null if no pattern fits."""
    found = F.coalesce(F.nullif(F.regexp_extract(label, TAKEN, 1), F.lit("")), F.nullif(F.regexp_extract(label, PUT, 1), F.lit("")))
    return F.nullif(F.regexp_replace(F.trim(F.lower(found)), r"[.,]+$", ""), F.lit(""))


def path_key(*parts: Column) -> Column:
    """A trajectory's key of whole numbers or names, joined by slashes."""
    return F.concat_ws("/", *(p.cast("string") for p in parts))


def chosen_views(requested: Column, available: Column, most: int = 2) -> Column:
    """The requested views that exist, each once, in order, at most so many; the first available if none."""
    both = F.slice(F.array_distinct(F.filter(requested, lambda v: F.array_contains(available, v))), 1, most)
    return F.when(F.size(both) > 0, both).otherwise(F.slice(available, 1, 1))
