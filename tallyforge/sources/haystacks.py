"""Long documents with needles. The plain filler is closed-form, so it comes from a range; needles go in by position.

Styles that draw on a seeded random stream are generated line by line, one document in a task.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import string
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the plain filler's line.
FILLER = "Log entry {i}: routine system check completed for node {n} with nominal status and no anomalies recorded across all monitored subsystems."


def filler(spark: SparkSession, target_tokens: int, start: int = 0, template: str = FILLER) -> DataFrame:
    """Numbered lines until their words times 1.3 reach the target (pos, line)."""
    per_line = int(len(template.format(i=1, n=1).split()) * 1.3)
    count = -(-target_tokens // max(1, per_line))
    head, rest = template.split("{i}")
    middle, tail = rest.split("{n}")
    i = F.col("id") + start + 1
    line = F.concat(F.lit(head), i.cast("string"), F.lit(middle), ((i * 7) % 1000).cast("string"), F.lit(tail))
    return spark.range(count).select(F.col("id").alias("pos"), line.alias("line"))


def with_needles(lines: DataFrame, needles: list[tuple[str, float]], count: int) -> DataFrame:
    """Lines with needles at their depths (0 is the start, 1 the end), in the order given; positions are new."""
    spark = lines.sparkSession
    placed: list[tuple[int, str]] = []  # (place in the final document, needle)
    for n, (text, depth) in enumerate(needles, count):
        at = min(n, max(0, int(n * depth)))
        placed = [(p + (p >= at), t) for p, t in placed] + [(at, text)]
    # A needle at final place p, the k-th of its kind, has p - k lines before it.
    rows = [(p - k - 0.5 + k / (len(placed) + 1) / 2, t) for k, (p, t) in enumerate(sorted(placed))]
    extra = spark.createDataFrame(rows, "pos double, line string")
    both = lines.select(F.col("pos").cast("double").alias("pos"), "line").unionByName(extra)
    return both.orderBy("pos")


def needles(spec: dict[str, Any]) -> list[tuple[str, float]]:
    """What a spec hides, with depths, in order of insertion: one needle among distractors, a chain of hops, or counted keywords."""
    spread = lambda items, low, share, by: [(x, low + share * (j / max(1, by))) for j, x in enumerate(items)]
    decoys = spec.get("distractors", [])
    kind = spec.get("type", "single")
    if kind == "multi_hop":
        chain, latent = spec["chain"], spec.get("latent", [])
        links = spread(chain, 0.1, 0.8, len(chain) - 1) if len(chain) > 1 else [(x, 0.5) for x in chain]
        hidden = [(x, 0.2 + 0.6 * (j + 1) / (len(latent) + 1)) for j, x in enumerate(latent)]
        return links + hidden + spread(decoys, 0.15, 0.6, len(decoys))
    if kind == "aggregation":
        counts = sorted(spec["inject"].items())
        mentions = [f"Note: the keyword {word} is mentioned here." for word, n in spec["inject"].items() for _ in range(n)]
        random.Random(repr(counts)).shuffle(mentions)  # mixed, and the same for the same spec
        return [(x, (j + 1) / (len(mentions) + 1)) for j, x in enumerate(mentions)]
    return spread(decoys, 0.15, 0.6, len(decoys)) + [(spec["needle"], spec.get("position", 0.5))]


# The styles that draw on a random stream. What is drawn from, the lines' forms, and the order of draws.

SERVICES = (
    "billing-api", "billing-worker", "billing-api-staging", "ledger-api", "ledger-worker", "invoice-api", "payments-api", "payments-worker", "auth-api", "auth-worker", "search-api",
    "notify-api", "export-worker", "recon-api", "webhook-api", "gateway-edge", "session-api", "audit-sink",
)
ACTORS = ("m.oyelaran", "s.kowalczyk", "deploybot", "t.nakamura", "a.ferreira", "rotation-cron", "j.okonkwo", "terraform-ci", "l.bergstrom", "pagerduty-sync", "r.dasgupta", "vault-agent")
ENVIRONMENTS = ("prod", "prod", "prod", "staging", "canary")
REGIONS = ("eu-west-1", "eu-north-1", "us-east-1", "ap-northeast-1")
PATHS = ("/v2/invoices", "/v2/charges", "/v1/customers", "/v2/refunds", "/health", "/v2/payouts", "/v1/webhooks", "/v2/disputes")
SIGNS = string.ascii_lowercase + string.ascii_uppercase + string.digits
AUDIT_LINES = (
    "{ts} {env} {svc} deploy {sha} by {actor}: rollout complete, {n} pods healthy",
    "{ts} {env} {svc} GET {path} 200 {n}ms trace={trace} req={req}",
    "{ts} {env} {svc} POST {path} 201 {n}ms trace={trace} req={req}",
    "{ts} audit actor={actor} action=secret.read scope={svc} ref={req} result=allow",
    "{ts} audit actor={actor} action=secret.list scope={svc} ref={req} result=allow",
    "{ts} {env} {svc} webhook signing secret verified whsec_{k24} attempts=1",
    "{ts} {env} {svc} publishable key in use pk_live_{k24} region={region}",
    "{ts} {env} {svc} test-mode credential issued sk_test_{k36} ttl=3600s",
    "{ts} {env} {svc} scheduled key audit: no findings, checksum {sha}",
    "{ts} {env} {svc} connection pool resized to {n} by {actor}",
    "{ts} {env} {svc} cache eviction pass freed {n}MB, region={region}",
    "{ts} INC-{n} {actor} noted elevated latency on {svc} in {region}; no customer impact, monitoring continues and the on-call handover has been updated accordingly.",
    "{ts} {env} {svc} config change by {actor}: timeout {n}ms, retries 3, ref={req}",
    "{ts} {env} {svc} certificate renewed, fingerprint {sha}, expiry 2027-01-14",
    "{ts} {env} {svc} vault lease renewed for {actor}, lease_id={trace}",
    "{ts} {env} {svc} backup snapshot {req} written, {n}GB, region={region}",
)
#: Month, day, hour, minute and second are drawn from [low, high).
TIMES = ((3, 9), (1, 29), (0, 24), (0, 60), (0, 60))
#: After the time and the line's form, in this order: one of a tuple, a number from a range, or so many signs.
AUDIT_DRAWS = (
    ("env", ENVIRONMENTS), ("svc", SERVICES), ("actor", ACTORS), ("region", REGIONS), ("path", PATHS), ("n", range(2, 9000)), ("sha", 12), ("trace", 16), ("req", 20), ("k24", 24), ("k36", 36),
)
CAST = ("Priya", "Marco", "Dana", "Ines", "Rafael", "Nadia", "Bo", "Tomas")
#: What is talked of, and its short name.
TOPICS = (
    ("the on-call rota", "rota"),
    ("the vendor invoice backlog", "invoices"),
    ("staging flakiness", "staging"),
    ("the onboarding docs", "docs"),
    ("the hiring loop", "hiring"),
    ("the dashboard cleanup", "dashboards"),
    ("the log retention change", "retention"),
    ("the API deprecation notice", "deprecation"),
    ("the incident review write-up", "the write-up"),
    ("the storage cost spike", "storage costs"),
)
CHATTER = (
    "{a}: On {topic} — where did we land last week?",
    "{a}: I looked at {topic} briefly and it is smaller than it sounded.",
    "{b}: Agreed, though the timing is awkward with the release freeze.",
    "{a}: Do we have numbers on that? I saw about {n} last time I checked.",
    "{b}: Roughly {n}, yes, but it moves around week to week.",
    "{a}: Can we park {topic} until after the freeze lifts?",
    "{b}: Fine by me. Nothing there is urgent.",
    "{a}: One caveat — the {topic} work touches the same config as {other}.",
    "{b}: Then we sequence them. {other} first, it is further along.",
    "{a}: I will add a note to the doc so nobody trips over it.",
    "{b}: Sorry, I dropped off for a second. What was the last thing?",
    "{a}: Just that {topic} is parked until the freeze lifts.",
    "{b}: Understood. Anything blocking on my side?",
    "{a}: Not that I know of. It is mostly waiting on review.",
    "{b}: The review queue is about {n} deep, so give it a few days.",
    "{a}: That is fine. It is not on the critical path.",
    "{b}: While we are here — did anyone hear back about {other}?",
    "{a}: Not yet. I chased it on Tuesday and again this morning.",
    "{b}: I would give it until Friday and then escalate.",
    "{a}: Works for me. Let us move on.",
)
OWNERSHIP = (
    "{a}: I can own {topic} — it overlaps what I am already doing.\n{b}: Great, {a} has {topic} then.",
    "{a}: Does anyone want {topic}?\n{b}: I will take it.\n{a}: Thanks {b}, noted as yours.",
    "{a}: {topic} needs an owner before we close.\n{b}: Put me down, I have the context already.\n{a}: Done.",
)
OWNERSHIP_SHARE, GUESTS = 0.10, range(3, 400)


def drawn(rnd: random.Random, of: Any) -> Any:
    match of:
        case int():
            return "".join(rnd.choice(SIGNS) for _ in range(of))
        case range():
            return rnd.randrange(of.start, of.stop)
    return rnd.choice(of)


def audit(rnd: random.Random) -> Iterator[tuple[str, int]]:
    """Lines of an audit log with what they weigh: identifiers make about two characters a token."""
    while True:
        month, *rest = (rnd.randrange(low, high) for low, high in TIMES)
        at = "2026-0{}-{:02d}T{:02d}:{:02d}:{:02d}Z".format(month, *rest)
        form = rnd.choice(AUDIT_LINES)
        values = {name: drawn(rnd, of) for name, of in AUDIT_DRAWS}
        line = form.format(ts=at, **values | {"req": f"req_{values['req']}"})
        yield line, len(line) // 2


def meeting(rnd: random.Random) -> Iterator[tuple[str, int]]:
    """Lines of a meeting, a tenth of its exchanges about who owns what. An exchange is never cut, so its lines weigh with its last."""
    while True:
        topic, short = rnd.choice(TOPICS)
        names = {"topic": short, "other": rnd.choice([t for t, _ in TOPICS if t != topic])}
        names["a"], names["b"] = rnd.sample(CAST, 2)
        form = rnd.choice(OWNERSHIP if rnd.random() < OWNERSHIP_SHARE else CHATTER)
        lines = form.format(**names, n=drawn(rnd, GUESTS)).split("\n")
        yield from ((line, 0) for line in lines[:-1])
        yield lines[-1], sum(int(len(x.split()) * 1.3) for x in lines)


def plain(salt: str) -> Iterator[tuple[str, int]]:
    first = salted(salt) + 1
    lines = (FILLER.format(i=i, n=i * 7 % 1000) for i in itertools.count(first))
    return ((line, int(len(line.split()) * 1.3)) for line in lines)


def salted(salt: str) -> int:
    """Where a salted document's numbering begins, so that two documents share no beginning."""
    return int(hashlib.sha256(salt.encode()).hexdigest()[:8], 16) % 1_000_000 if salt else 0


STYLES = {
    "log": plain,
    "ops_audit": lambda salt: audit(random.Random(f"ops-audit::{salt}")),
    "meeting": lambda salt: meeting(random.Random(f"meeting::{salt}")),
}


def styled(style: str, target_tokens: int, salt: str = "") -> list[str]:
    """Lines of a style until they weigh the target. The same style and salt always give the same lines."""
    out, weight = [], 0
    lines = STYLES[style](salt)
    while weight < target_tokens:
        line, more = next(lines)
        out.append(line)
        weight += more
        while not more:  # the rest of an exchange
            line, more = next(lines)
            out.append(line)
            weight += more
    return out


def document(spec: dict[str, Any], salt: str = "") -> str:
    """The whole text of a spec's haystack."""
    lines = styled(spec.get("filler_style", "log"), spec.get("filler_tokens", 8000), salt)
    for text, depth in needles(spec):
        lines.insert(min(len(lines), max(0, int(len(lines) * depth))), text)
    return "\n".join(lines)


def documents(specs: DataFrame) -> DataFrame:
    """task_id and text of every spec (task_id, spec JSON), salted by its task_id; a document is built in one task, specs in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, spec in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.string()), pa.array([document(json.loads(spec), i)], pa.string())], ["task_id", "text"])

    return specs.select(F.col("task_id").cast("string").alias("task_id"), "spec").mapInArrow(run, "task_id string, text string")


def build(spark: SparkSession, spec: dict[str, Any], start: int = 0) -> DataFrame:
    """The lines of a spec's haystack in the plain style, in order."""
    lines = filler(spark, spec.get("filler_tokens", 8000), start)
    return with_needles(lines, needles(spec), lines.count())
