"""Rule and policy files (JSON, or YAML where its reader is installed) as the tables that the operators take.

Such a file is small by nature and is read on the driver, through Spark, so it may lie in any store that Spark reads.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import attribution, behaviour
from ..operators.policy import IdentityPolicy

try:
    import yaml
except ImportError:  # JSON files work without it
    yaml = None

# What a rule file must declare, and the sections of each of its events.
KIND, SECTIONS = "mvp_event_rules", ["actors", "counting", "prerequisites", "temporal"]
# The sections that an identity policy must fill.
POLICY_SECTIONS = ["assumptions", "continuity", "identity", "identity.short_gap", "identity.hypotheses"]
# The limits of an identity policy: setting -> (section, name in the file, kind).
POLICY_LIMITS = {
    "visual": ("continuity", "visual_delta_threshold", float),
    "churn": ("continuity", "track_churn_threshold", float),
    "cut": ("continuity", "score_threshold", float),
    "max_gap": ("short_gap", "max_gap_frames", int),
    "link": ("short_gap", "repair_score_threshold", float),
    "max_court": ("short_gap", "max_court_distance", float),
    "max_ratio": ("short_gap", "max_center_distance_ratio", float),
    "hypothesis": ("hypotheses", "min_score", float),
    "top": ("hypotheses", "max_candidates_per_group", int),
    "ambiguity": ("hypotheses", "ambiguity_margin", float),
}
# Fixed value: the video where neither a call nor the configuration names one.
DEFAULT_VIDEO = "data/sample.mp4"


@dataclass
class EventRules:
    """Arguments of ``attribution.violations`` and ``attribution.stat_deltas``."""

    rules: dict[str, tuple]
    max_gap_ms: dict[str, int]
    stat_deltas: list[tuple[str, str, str, int]]


def read_document(spark: SparkSession, path: str) -> dict:
    """The mapping that a JSON or YAML file holds; a missing file raises FileNotFoundError, anything else than a mapping ValueError."""
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    text = row[0] if row else ""
    try:
        out = json.loads(text)
    except ValueError:
        if yaml is None:
            raise ValueError(f"{path} is not JSON, and no YAML reader is installed") from None
        out = yaml.safe_load(text)
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no mapping")
    return out


def _max_gap(temporal: dict) -> int | None:
    inner = [temporal.get(k) for k in ("resolution_required", "expected_follow_up")]
    found = [temporal.get("max_gap_ms"), temporal.get("max_pass_to_make_gap_ms"), *[d.get("max_gap_ms") for d in inner if isinstance(d, dict)]]
    return next((g for g in found if g is not None), None)


def event_rules(document: dict) -> EventRules:
    """Check the contract of an event-rule document and turn it into tables; the first fault raises ValueError.

    In order: its kind, assumptions, events, the required events, and of each required event the four sections, the
    primary actor and the stat deltas.
    """
    if document.get("kind") != KIND:
        raise ValueError(f"event rules must declare kind: {KIND}")
    for section in ("assumptions", "events"):
        if not document.get(section):
            raise ValueError(f"event rules lack {section}")
    events = document["events"]
    if missing := sorted(set(attribution.RULES) - set(events)):
        raise ValueError(f"event rules lack events: {', '.join(missing)}")
    for name in attribution.RULES:
        event = events[name] or {}
        if missing := [s for s in SECTIONS if s not in event]:
            raise ValueError(f"event rule {name} lacks sections: {', '.join(missing)}")
        if "primary" not in (event["actors"] or {}):
            raise ValueError(f"event rule {name} has no primary actor")
        if "stat_deltas" not in (event["counting"] or {}):
            raise ValueError(f"event rule {name} has no counting.stat_deltas")
    rules, gaps, deltas = {}, {}, []
    for name, event in events.items():
        t = event.get("temporal") or {}
        expected, resolution = t.get("expected_follow_up") or {}, t.get("resolution_required") or {}
        rules[name] = (
            list(event.get("prerequisites") or []),
            (event.get("actors") or {}).get("secondary"),
            t.get("must_follow"),
            expected.get("event"),
            list(t.get("allowed_follow_up") or []),
            list(resolution.get("allowed_events") or []),
            t.get("required_terminal_event"),
        )
        if (gap := _max_gap(t)) is not None:
            gaps[name] = int(gap)
        counted = (event.get("counting") or {}).get("stat_deltas") or {}
        flat = all(isinstance(v, int) for v in counted.values())
        for shot, stats in [("", counted)] if flat else counted.items():
            deltas += [(name, shot, stat, delta) for stat, delta in stats.items()]
    return EventRules(rules, gaps, deltas)


def identity_policy(document: dict) -> dict:
    """An identity policy whose required sections are all filled; an empty or missing one raises ValueError."""

    def at(name: str):
        out = document
        for key in name.split("."):
            out = (out or {}).get(key)
        return out

    if missing := [s for s in POLICY_SECTIONS if not at(s)]:
        raise ValueError(f"the identity policy lacks sections: {', '.join(missing)}")
    return document


def identity_settings(document: dict) -> IdentityPolicy:
    """The settings of an identity policy; an empty section, or a limit that is missing or no number, raises ValueError.

    The three switches may be missing and are then on.
    """
    identity_policy(document)
    sections = {"continuity": document["continuity"], "short_gap": document["identity"]["short_gap"], "hypotheses": document["identity"]["hypotheses"]}

    def number(section: str, name: str, kind: type):
        try:
            return kind(sections[section][name])
        except (KeyError, TypeError, ValueError):
            raise ValueError(f"the identity policy has no number {section}.{name}") from None

    limits = {field: number(section, name, kind) for field, (section, name, kind) in POLICY_LIMITS.items()}
    return IdentityPolicy(
        **limits,
        reset=bool(sections["continuity"].get("reset_identity_on_discontinuity", True)),
        fill=bool(document["identity"].get("occlusion_first_within_segment", True)),
        with_hypotheses=bool(sections["hypotheses"].get("enabled", True)),
    )


def identity_policy_document(policy: IdentityPolicy = IdentityPolicy()) -> dict:
    """Settings as a document that ``identity_settings`` reads back, as a start for a policy of one's own."""
    sections: dict[str, dict] = {"continuity": {}, "short_gap": {}, "hypotheses": {}}
    for field, (section, name, _) in POLICY_LIMITS.items():
        sections[section][name] = getattr(policy, field)
    sections["continuity"]["reset_identity_on_discontinuity"] = policy.reset
    sections["hypotheses"]["enabled"] = policy.with_hypotheses
    identity = {"occlusion_first_within_segment": policy.fill, "short_gap": sections["short_gap"], "hypotheses": sections["hypotheses"]}
    return {"assumptions": {"continuity_default": "conserved"}, "continuity": sections["continuity"], "identity": identity}


def kinematic_rules(document: dict) -> list[tuple]:
    """The behaviour rules of a document in their order, as ``behaviour.label`` takes them; without rules there are none."""
    out = []
    for rule in document.get("rules") or []:
        asked = [p.get("state") for p in rule.get("preconditions") or [] if p.get("actor") == "self"]
        controlled = any(c.get("ball_state") == "controlled" for c in rule.get("conditions") or [])
        predicates = [(p["joint"], p["metric"], p["operator"], p.get("reference") if p["metric"] == "pos_y" else p.get("threshold", 0.0)) for p in rule.get("predicates") or []]
        out.append((rule["id"], rule.get("type", "kinematic"), "has_possession" in asked, predicates, controlled))
    return out


def labels(document: dict) -> dict[str, int]:
    """Every rule name of all categories, once, sorted and numbered from 0."""
    names = {r for c in document.get("categories") or [] for r in c.get("rules") or []}
    return {name: i for i, name in enumerate(sorted(names))}


def video_path(spark: SparkSession, requested: str | None, configuration: str) -> str:
    """The requested video, else that of the configuration file, else the default; the file is read only if needed."""
    if requested is not None:
        return requested
    return read_document(spark, configuration).get("local_video_path", DEFAULT_VIDEO)


def with_video_path(rows: DataFrame, configuration: str, requested: str = "requested", name: str = "video") -> DataFrame:
    """``rows`` with the requested video, else that of the configuration file, else the default.

    A missing configuration stops the query only if a row needs it.
    """
    try:
        other = F.lit(video_path(rows.sparkSession, None, configuration))
    except FileNotFoundError:
        other = F.raise_error(F.lit(f"no configuration at {configuration}")).cast("string")
    return rows.withColumn(name, F.coalesce(F.col(requested), other))


def event_rules_document(rules: dict[str, tuple] = attribution.RULES, max_gap_ms: dict[str, int] = attribution.MAX_GAP_MS, stat_deltas: list[tuple] = attribution.STAT_DELTAS) -> dict:
    """Rule tables as a document that ``event_rules`` reads back, as a start for rules of one's own."""
    events = {}
    for name, (prerequisites, second, follows, expected, allowed, resolution, terminal) in rules.items():
        counted: dict = {}
        for event, shot, stat, delta in stat_deltas:
            if event == name:
                (counted.setdefault(shot, {}) if shot else counted)[stat] = delta
        temporal = {"max_gap_ms": max_gap_ms.get(name), "must_follow": follows, "allowed_follow_up": allowed, "required_terminal_event": terminal}
        temporal |= {"expected_follow_up": {"event": expected} if expected else None, "resolution_required": {"allowed_events": resolution} if resolution else None}
        actors = {"primary": "actor"} | ({"secondary": second} if second else {})
        events[name] = {"prerequisites": prerequisites, "actors": actors, "temporal": {k: v for k, v in temporal.items() if v}, "counting": {"stat_deltas": counted}}
    return {"kind": KIND, "assumptions": {"deterministic_counting": True}, "events": events}


def kinematic_rules_document(rules: list[tuple] = behaviour.RULES) -> dict:
    """Behaviour rules as a document that ``kinematic_rules`` reads back."""
    out = []
    for name, kind, ball, predicates, *more in rules:
        rule = {"id": name, "type": kind, "predicates": [{"joint": j, "metric": m, "operator": o, "reference" if m == "pos_y" else "threshold": v} for j, m, o, v in predicates]}
        if ball:
            rule["preconditions"] = [{"actor": "self", "state": "has_possession"}]
        if more and more[0]:
            rule["conditions"] = [{"ball_state": "controlled"}]
        out.append(rule)
    return {"rules": out}
