"""Secret scans: fixed patterns, and Markov models for what no pattern describes.

Two second-order character models, one of random strings and one of ordinary identifiers, are
trained from labelled samples by grouped aggregation. Half of each model's weight has a list of
made samples (random strings of the usual alphabets; identifiers of common words), half the corpus's
own: what the patterns find in about SAMPLE documents is random, other runs of key characters there
are ordinary. Orders lean on lower ones, so pairs that no sample has say little.

A run of key characters is a secret if the log-likelihood ratio of the whole run passes EVIDENCE and
that of each character on average THRESHOLD. Rulers, repeated characters, alphabets and counts
(most characters next to the one before), UUIDs and data behind `base64,` are never asked. Such
spans are added (kind "random") where no pattern's span overlaps them; the patterns' own spans stay.

A span is the whole match, in code points, end exclusive. Patterns work on bytes, so that only
ASCII letters fold case.

Defined cases: a null text is an empty one and has no spans; very long texts are scanned whole;
repeated rows get equal spans; an empty table gives an empty result; other columns pass through
untouched, and the added struct takes a name that clashes with none. An empty training sample
gives uniform models, whose ratio is zero everywhere: no span is added.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import code_points, map_column, unused, utf8

# The base patterns and their least lengths.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # a run of 32 or more is found whole, as by [0-9a-f]+ and its length
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "random")

#: Runs of at least so many key characters are asked.
RUN = 12
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{12,}")
#: Nats by which a random string must be the likelier: of the whole run, and per character.
EVIDENCE = 12.0
THRESHOLD = 0.5
#: Share of characters that may be next to the one before, or equal to it, and the least number of different ones.
STEADY, DIFFERENT = 0.5, 6
#: Key characters that an ordinary string from which models learn has at least.
LEARNED = 4
UUID = re.compile(rb"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
DATA = b"base64,"
#: Symbols of the models: one for each key character, one for the start, one for what is left.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 2
START, OTHER = SIZE - 2, SIZE - 1
#: Labelled strings of each label that default_samples() makes, and its seed.
SAMPLES = 20_000
SEED = 20_260_101
#: Documents from which labelled strings are taken, in expectation.
SAMPLE = 20_000
#: Weight of the made and of the corpus's samples in each model, in characters, and of the next lower order.
WEIGHT, LEAN = 200_000.0, 6.0

SCHEMA = (
    "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_random:bigint,"
    "spans:array<struct<kind:string,start:bigint,end:bigint>>>"
)

# The words of which ordinary identifiers are made.
IDENTIFIER_WORDS = (
    "account", "action", "active", "address", "agent", "array", "async", "audio", "auto", "average", "balance", "base", "batch", "billing", "block",
    "body", "buffer", "build", "button", "cache", "call", "channel", "chart", "check", "child", "class", "client", "cluster", "code", "column",
    "command", "commit", "compile", "config", "connect", "consumer", "content", "context", "control", "cookie", "copy", "count", "create", "current",
    "custom", "data", "date", "debug", "default", "delete", "depth", "device", "digest", "dispatch", "display", "document", "domain", "driver",
    "edge", "element", "email", "enable", "encode", "engine", "entity", "entry", "error", "event", "export", "factory", "feature", "fetch", "field",
    "file", "filter", "final", "find", "flag", "float", "folder", "font", "format", "frame", "function", "gateway", "generate", "global", "graph",
    "group", "handler", "hash", "header", "height", "host", "html", "http", "image", "import", "index", "info", "input", "insert", "instance",
    "integer", "internal", "interval", "item", "iterator", "job", "join", "key", "label", "language", "layer", "layout", "length", "level",
    "library", "limit", "line", "link", "list", "listener", "load", "local", "location", "lock", "logger", "login", "loop", "machine", "main",
    "manager", "map", "mask", "match", "matrix", "maximum", "member", "memory", "merge", "message", "meta", "method", "metric", "middle", "minimum",
    "mobile", "mode", "model", "module", "monitor", "mount", "name", "native", "network", "node", "normal", "note", "notify", "null", "number",
    "object", "offset", "option", "order", "origin", "output", "owner", "package", "page", "panel", "parameter", "parent", "parse", "partition",
    "patch", "path", "pattern", "payment", "permission", "person", "pixel", "plugin", "point", "policy", "pool", "port", "position", "power",
    "prefix", "preview", "print", "priority", "process", "product", "profile", "project", "property", "protocol", "provider", "proxy", "public",
    "query", "queue", "random", "range", "reader", "record", "reference", "region", "register", "release", "remote", "render", "replace", "report",
    "request", "reset", "resource", "response", "result", "retry", "sample", "scale", "schedule", "schema", "scope", "screen", "script", "scroll",
    "search", "second", "section", "secure", "select", "sender", "sequence", "serial", "server", "service", "session", "setting", "shader", "shape",
    "share", "shift", "signal", "single", "size", "slice", "slot", "socket", "sort", "source", "space", "spec", "speed", "stack", "stage", "standard",
    "start", "state", "static", "status", "step", "stop", "storage", "store", "stream", "string", "structure", "style", "subject", "submit", "sum",
    "support", "switch", "symbol", "sync", "system", "table", "tag", "target", "task", "template", "temporary", "terminal", "test", "text",
    "texture", "theme", "thread", "time", "timeout", "title", "toggle", "token", "tool", "topic", "total", "trace", "track", "train",
    "transaction", "transform", "tree", "trigger", "type", "unique", "unit", "update", "upload", "user", "utility", "valid", "value", "variable",
    "vector", "version", "vertex", "video", "view", "visible", "visit", "volume", "wait", "watch", "weight", "widget", "width", "window", "word",
    "work", "worker", "wrapper", "write", "xml", "year", "zero", "zone", "zoom",
)
#: What syllables of many languages' words and names begin with, have in the middle, and end with, in letters without accents.
ONSETS = (
    "b bl br c ch cl cr cz d dj dr dz f fj fl fr g gh gl gr gw h hj hs j k kh kl kn kr kv kw l ll lj m mb mn n nd ng nj ny p pf ph pl pr pw q qu r rh rz "
    "s sc sch sh sk sl sm sn sp st str sv sz szcz t th tl tr ts tz v vl vr w wr x y z zh zl zv"
).split()
NUCLEI = "a a a e e e i i o o u y aa ae ai au ea ee ei eu ia ie ii ij io oa oe oi oo ou ue ui uo uu w ya yo yu eau iei".split()
CODAS = [""] * 14 + "b c ch ck ct d f ff g gh ght k ks l ld ll lm lt m mb mp n nd ng nk ns nt p ph pp q r rd rk rl rm rn rs rt s sch sh sk ss st t th ts tt tz v w x z".split()


def _part(rng: random.Random) -> str:
    """A word of an identifier, one that could be of some language, an acronym, or a stem with a number."""
    kind = rng.random()
    if kind < 0.5:
        return rng.choice(IDENTIFIER_WORDS)
    if kind < 0.93:
        syllables = rng.choice((1, 1, 2, 2, 3, 3, 4, 5, 7))
        return "".join((rng.choice(ONSETS) if rng.random() < 0.85 else "") + rng.choice(NUCLEI) + rng.choice(CODAS) for _ in range(syllables))
    if kind < 0.97:
        return "".join(rng.choices(ALPHABET[:26], k=rng.randint(2, 4)))
    return rng.choice(IDENTIFIER_WORDS)[:3] + str(rng.choice((2, 3, 8, 16, 32, 64, 128, 256)))


def _ordinary(rng: random.Random) -> str:
    parts = [_part(rng) for _ in range(rng.choice((1, 1, 2, 2, 3, 3, 4, 5, 6)))]
    if rng.random() < 0.3:
        parts.insert(rng.randint(1, len(parts)), str(rng.randint(0, 2030)))
    first = lambda p: p[:1].upper() + p[1:]
    match rng.randrange(8):
        case 0:
            return parts[0] + "".join(map(first, parts[1:]))
        case 1:
            return "".join(map(first, parts))
        case 2:
            return "_".join(parts)
        case 3:
            return "-".join(parts)
        case 4:
            return "/".join(parts)
        case 5:
            return "_".join(parts).upper()
        case 6:
            return "-".join(map(first, parts))
    return "/".join(first(p) if rng.random() < 0.5 else p for p in parts)


def default_samples(n: int = SAMPLES, seed: int = SEED) -> list[tuple[str, bool]]:
    """(string, is random): `n` of each label, the same at every call."""
    rng = random.Random(seed)
    sets = (ALPHABET[:64], ALPHABET[:62], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef", "0123456789ABCDEF")
    out = [("".join(rng.choices(rng.choice(sets), k=rng.randint(20, 64))), True) for _ in range(n)]
    return out + [(_ordinary(rng), False) for _ in range(n)]


def _sample(docs: DataFrame, text: str) -> DataFrame:
    last = min((1 << 63) - 1, int(SAMPLE / max(1, docs.count()) * (1 << 64)) - (1 << 63))
    return docs.where(F.xxhash64(text) <= F.lit(last).cast("bigint")).select(F.col(text))


def _gathered(places: DataFrame) -> np.ndarray:
    table = places.groupBy("place").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(2 * SIZE**3)
    out[[r["place"] for r in table]] = [r["n"] for r in table]
    return out.reshape(2, SIZE, SIZE, SIZE)


def counts_of(samples: DataFrame, text: str = "text", label: str = "is_random") -> np.ndarray:
    """How often each three symbols follow each other, by label. Each task sums its own strings; what
    reaches the driver is at most one count for each three symbols of the fixed alphabet."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * SIZE**3, np.int64)
        for batch in batches:
            for y, word in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                a, b, c = triples(word)
                np.add.at(sums, ((int(y) * SIZE + a) * SIZE + b) * SIZE + c, 1)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["place", "n"])

    rows = samples.where(F.col(label).isNotNull()).select(F.col(label).cast("boolean"), F.col(text).cast("string"))
    return _gathered(rows.mapInArrow(counted, "place bigint, n bigint"))


def labelled_symbols(data: bytes) -> tuple[np.ndarray, ...]:
    """(label, a, b, c) of every symbol of a text's labelled strings. A string is a run of key characters,
    cut where a pattern's value begins or ends; it is random inside of a value, and ordinary outside of all
    spans if it has at least four characters. Keywords of spans are in no string."""
    codes = _CODES[np.frombuffer(data, np.uint8)]
    label, starts = np.zeros(len(codes), np.int64), np.zeros(len(codes) + 1, bool)
    value = np.zeros(len(codes), bool)
    inside = np.zeros(len(codes), bool)
    for start, end, kind in base_spans(data):
        inside[start:end] = True
        begin = ASSIGN.match(data, start, end).start(2) if kind == "assign" else start
        label[begin:end] = 1
        value[begin:end] = True
        starts[[begin, end]] = True
    key = (codes != OTHER) & (value | ~inside)
    # A string begins behind what is no key character, and where a span begins or ends.
    first = key & (starts[:-1] | ~np.concatenate(([False], key[:-1])))
    number = np.cumsum(first)
    long = np.bincount(number[key], minlength=len(first) + 1)[number] >= LEARNED
    back = lambda x, n: np.concatenate((np.full(n, START), x[:-n])) if len(x) > n else np.full(len(x), START)
    before = np.where(first, START, back(codes, 1))
    second = np.concatenate(([False], first[:-1]))
    earlier = np.where(first | second, START, back(codes, 2))
    at = np.flatnonzero(key & (long | value))
    return label[at], earlier[at], before[at], codes[at]


def corpus_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """As `counts_of`, of the labelled strings of about SAMPLE documents, those whose hash is below a limit."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * SIZE**3, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for data in utf8(batch.column(0).slice(at, 256)):
                    if data:
                        y, a, b, c = labelled_symbols(data)
                        places, n = np.unique(((y * SIZE + a) * SIZE + b) * SIZE + c, return_counts=True)
                        sums[places] += n
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["place", "n"])

    return _gathered(_sample(docs, text).mapInArrow(counted, "place bigint, n bigint"))


def ratios(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood ratios of each three symbols. Each order leans on the next lower one."""
    logs = []
    for three in counts:
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + LEAN * p1) / (two.sum(axis=1, keepdims=True) + LEAN)
        p3 = (three + LEAN * p2) / (three.sum(axis=2, keepdims=True) + LEAN)
        logs.append(np.log(p3))
    return (logs[1] - logs[0]).astype(np.float32)


def weighed(*counts: np.ndarray) -> np.ndarray:
    """Sums of counts in which each kind of sample has the same weight in each model."""
    totals = [c.sum(axis=(1, 2, 3), keepdims=True) for c in counts]
    return sum(np.where(t > 0, c * (WEIGHT / np.maximum(t, 1)), 0.0) for c, t in zip(counts, totals, strict=True))


def train(samples: DataFrame, text: str = "text", label: str = "is_random") -> np.ndarray:
    """The ratios from labelled strings alone."""
    return ratios(counts_of(samples, text, label))


def made_counts(spark: SparkSession) -> np.ndarray:
    return counts_of(spark.createDataFrame(default_samples(), "text string, is_random boolean"))


def default_model(spark: SparkSession) -> np.ndarray:
    """The ratios from made samples alone."""
    return ratios(weighed(made_counts(spark)))


def fit(docs: DataFrame, text: str = "text") -> np.ndarray:
    """The ratios from made samples and the corpus's own."""
    return ratios(weighed(made_counts(docs.sparkSession), corpus_counts(docs, text)))


_CODES = np.full(256, OTHER, np.int64)
_CODES[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def triples(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each symbol with the two before it."""
    codes = _CODES[np.frombuffer(run, np.uint8)]
    led = np.concatenate(([START, START], codes))
    return led[:-2], led[1:-1], codes


def evidence(run: bytes, model: np.ndarray) -> float:
    """Nats in favour of a random string."""
    return float(model[triples(run)].sum(dtype=np.float64)) if run else 0.0


def ratio(run: bytes, model: np.ndarray) -> float:
    """Nats per character in favour of a random string."""
    return evidence(run, model) / len(run) if run else -math.inf


def steady(run: bytes) -> bool:
    """Whether the run is a ruler, a repetition, an alphabet or a count."""
    steps = np.abs(np.diff(np.frombuffer(run, np.uint8).astype(np.int16)))
    return len(set(run)) < DIFFERENT or float((steps <= 1).mean()) > STEADY


def is_random(run: bytes, model: np.ndarray, threshold: float = THRESHOLD) -> bool:
    if len(run) < RUN or UUID.fullmatch(run) or steady(run):
        return False
    nats = evidence(run, model)
    return nats > EVIDENCE and nats > threshold * len(run)


def base_spans(data: bytes) -> list[tuple[int, int, str]]:
    """Byte spans of the patterns."""
    out = []
    low = data.lower()
    if any(k in low for k in KEYWORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(data) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        out += [(*m.span(), "access") for m in ACCESS.finditer(data) if len(m[0]) >= LEAST["access"]]
    out += [(*m.span(), "hex") for m in HEX.finditer(data)] if len(data) >= LEAST["hex"] else []
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def added_spans(data: bytes, base: list[tuple[int, int, str]], model: np.ndarray, threshold: float) -> list:
    """Byte spans of random runs outside the base spans."""
    out = []
    for m in CANDIDATE.finditer(data):
        start, end = m.span()
        if not any(s < end and start < e for s, e, _ in base) and data[max(0, start - len(DATA)) : start] != DATA and is_random(m[0], model, threshold):
            out.append((start, end, "random"))
    return out


def scan(data: bytes, model: np.ndarray | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, by start, then kind."""
    base = base_spans(data)
    spans = base + (added_spans(data, base, model, threshold) if model is not None else [])
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    out, seen, points = [], 0, 0
    for start, end, kind in spans:
        points += code_points(data[seen:start])
        seen = start
        out.append((kind, points, points + code_points(data[start:end])))
    return out


def scanned(texts: pa.Array, model: np.ndarray, threshold: float = THRESHOLD) -> pa.Array:
    found = [scan(data, model, threshold) for data in utf8(texts)]
    counts = [pa.array([sum(s[0] == kind for s in spans) for spans in found], pa.int64()) for kind in KINDS]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    listed = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in found], pa.list_(span))
    return pa.StructArray.from_arrays([*counts, listed], ["n_assign", "n_access", "n_hex", "n_random", "spans"])


def secrets(docs: DataFrame, text: str = "text", model: np.ndarray | None = None, threshold: float = THRESHOLD):
    """The documents with one struct of counts and spans, and that struct's name."""
    model = fit(docs, text) if model is None else model
    name = unused(docs, "secrets")
    return docs.withColumn(name, map_column(lambda t: scanned(t, model, threshold), SCHEMA, F.col(text))), name


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with each span replaced by its kind; overlapping spans become one."""
    if not spans:
        return text
    merged: list[list] = []
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(end, merged[-1][2])
        else:
            merged.append([kind, start, end])
    out, at = [], 0
    for kind, start, end in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text: str = "text", model: np.ndarray | None = None, threshold: float = THRESHOLD):
    """The documents with every secret replaced; all columns stay, a null text too."""
    model = fit(docs, text) if model is None else model

    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for raw in texts.to_pylist():
            spans = scan(raw.encode("utf-8", "surrogatepass"), model, threshold) if raw else []
            out.append(redact(raw, spans))
        return pa.array(out, pa.string())

    return docs.withColumn(text, map_column(clean, "string", F.col(text)))


def digest(docs: DataFrame) -> DataFrame:
    """The result of the query, for every document."""
    out, s = secrets(docs.select("doc_id", "text"))
    text = lambda spans: F.concat_ws(
        ",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    )
    spans = F.col(s)["spans"]
    return out.select(
        "doc_id",
        *(F.col(s)[c].alias(c) for c in ("n_assign", "n_access", "n_hex", "n_random")),
        F.sha2(text(F.filter(spans, lambda x: x["kind"] != "random")), 256).alias("base_sha256"),
        text(spans).alias("spans"),
    )
