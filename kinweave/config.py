"""Typed, validated settings of a resolver: fields, blocking rules, comparisons, model parameters."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

JARO_WINKLER = "jaro_winkler"
EXACT_MATCH = "exact_match"
# Kinds of comparison known by name; `scoring.register` adds further ones.
COMPARISON_KINDS = [JARO_WINKLER, EXACT_MATCH]
DEFAULT_THRESHOLDS = (0.9, 0.8)
DEFAULT_TRAIN_AT = 200


@dataclass(frozen=True)
class JoinRule:
    """Pairs agree on all `keys`, where NULL agrees with nothing; with a `name`, its normalised values are similar, too."""

    keys: tuple[str, ...]
    name: str | None = None
    cutoff: float = 0.0


@dataclass(frozen=True)
class Comparison:
    """How one field is graded: level numbers fall from exact match to 0, the else level."""

    kind: str
    field: str
    thresholds: tuple[float, ...] = ()

    @property
    def levels(self) -> tuple[int, ...]:
        """Level numbers from the strongest to the else level."""
        return tuple(range(len(self.thresholds) + 1, -1, -1))


@dataclass(frozen=True)
class LevelParameters:
    """Match and non-match probability of one comparison level and where the values come from."""

    level: int
    m: float
    u: float
    source: str = "cold_start"

    @property
    def weight(self) -> float:
        return math.log2(self.m / self.u)


@dataclass(frozen=True)
class Model:
    """Prior and level parameters per compared field."""

    prior: float
    parameters: dict[str, tuple[LevelParameters, ...]]

    @property
    def prior_weight(self) -> float:
        return math.log2(self.prior / (1.0 - self.prior))


@dataclass(frozen=True)
class BatchSettings:
    """Bounds of one micro-batch of requests: bytes of input, milliseconds between batches, and messages of a queue."""

    max_bytes: int = 50_000_000
    linger_ms: int = 250
    max_mentions: int = 500

    def __post_init__(self):
        if self.max_bytes <= 0 or self.linger_ms < 0 or self.max_mentions <= 0:
            raise ValueError(f"A batch needs max_bytes and max_mentions above 0 and linger_ms from 0 on, got {self!r}")


@dataclass(frozen=True)
class ResolverConfig:
    """Everything a resolution run needs besides its tables."""

    entity_fields: tuple[str, ...]
    rules: tuple[JoinRule, ...]
    comparisons: tuple[Comparison, ...]
    model: Model
    threshold: float = 0.7
    match_weight_threshold: float = -10.0
    top_n: int = 100
    auto_train_threshold: int = DEFAULT_TRAIN_AT
    normalised_fields: tuple[str, ...] = ("legal_name",)
    em_blocking_field: str = "country_code"
    missing: str = "penalise"
    batch: BatchSettings = field(default_factory=BatchSettings)

    def with_fields(self, fields: list[str] | tuple[str, ...]) -> ResolverConfig:
        """The same settings for mentions that only have some of the fields."""
        return replace(
            self,
            entity_fields=tuple(f for f in self.entity_fields if f in fields),
            comparisons=tuple(c for c in self.comparisons if c.field in fields),
        )

    @classmethod
    def from_dict(cls, raw: dict) -> ResolverConfig:
        """Read the settings as they appear in a resolver file; problems raise `ValueError` naming the culprit."""
        missing = [k for k in ("entity_fields", "threshold", "match_weight_threshold", "top_n", "splink") if k not in raw]
        if missing:
            raise ValueError(f"Missing setting(s): {', '.join(missing)}")
        linkage = raw["splink"]
        fields = tuple(raw["entity_fields"])
        normalised = tuple(linkage.get("normalised_fields", ["legal_name"]))
        em_field = linkage.get("em_blocking_field", "country_code")
        rules = linkage.get("blocking_rules") or []
        allowed = {"key": fields, "name": [f for f in fields if f in normalised]}
        problems = [f"entity field {f!r} is not an identifier" for f in fields if not str(f).isidentifier()]
        problems += [f"{f!r} is normalised or a training block, but not an entity field" for f in (*normalised, em_field) if f not in fields]
        problems += [] if rules else ["blocking_rules needs at least one entry"]
        compiled = [compile_rule(rule, f"blocking rule {number}", allowed, problems) for number, rule in enumerate(rules, 1)]
        if problems:
            raise ValueError("; ".join(problems))
        comparisons = tuple(_comparison(entry) for entry in linkage.get("comparisons", []))
        batch = raw.get("batch") or {}
        return cls(
            entity_fields=fields,
            rules=tuple(compiled),
            comparisons=comparisons,
            model=cold_start_model(
                comparisons,
                linkage.get("probability_two_random_records_match", 0.0001),
                linkage.get("cold_start", {}).get("comparisons", {}),
            ),
            threshold=float(raw["threshold"]),
            match_weight_threshold=float(raw["match_weight_threshold"]),
            top_n=int(raw["top_n"]),
            auto_train_threshold=int(raw.get("auto_train_threshold", DEFAULT_TRAIN_AT)),
            normalised_fields=normalised,
            em_blocking_field=em_field,
            batch=BatchSettings(**{k: batch[k] for k in ("max_bytes", "linger_ms") if k in batch}),
        )

    @classmethod
    def load(cls, path: str) -> ResolverConfig:
        """Read settings from a JSON file, or a YAML file where a YAML reader is installed."""
        with open(path, encoding="utf-8") as handle:
            if str(path).endswith(".json"):
                return cls.from_dict(json.load(handle))
            import yaml

            return cls.from_dict(yaml.safe_load(handle))


def _comparison(entry: dict) -> Comparison:
    kind = entry.get("type")
    if kind not in COMPARISON_KINDS:
        raise ValueError(f"Comparison type {kind!r} is not one of {', '.join(COMPARISON_KINDS)}")
    thresholds = tuple(entry.get("thresholds", DEFAULT_THRESHOLDS if kind == JARO_WINKLER else ()))
    if kind == EXACT_MATCH:
        thresholds = ()
    return Comparison(kind, entry["field"], thresholds)


#: Where the parts of a rule stand in its three written forms: alone, in a list, in a mapping.
ITEM = "[]"
LAYOUT = {
    (): "key",
    (ITEM,): "key",
    ("same",): "key",
    ("similar", "field"): "name",
    ("similar", "min_jaro_winkler"): "cutoff",
}


def _leaves(value, path: tuple[str, ...] = ()):
    """(path, value) of everything in nested mappings and lists that is neither."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _leaves(inner, (*path, str(key)))
    elif isinstance(value, (list, tuple)):
        for inner in value:
            yield from _leaves(inner, (*path, ITEM))
    else:
        yield path, value


def compile_rule(rule, label: str, allowed: dict[str, list[str]], problems: list[str]) -> JoinRule:
    """The join of a written rule; whatever is wrong with it is added to `problems`, all at once."""
    parts: dict[str, list] = {"key": [], "name": [], "cutoff": []}
    for path, value in _leaves(rule):
        part = LAYOUT.get(path)
        if part is None:
            problems.append(f"{label}: {'.'.join(path)} has no meaning")
            continue
        sound = value in allowed[part] if part in allowed else type(value) in (int, float) and 0 <= value <= 1
        if not sound:
            wanted = f"one of {', '.join(allowed[part])}" if part in allowed else "a number from 0 to 1"
            problems.append(f"{label}: {value!r} at {'.'.join(path) or 'the top'} should be {wanted}")
        parts[part].append(value)
    needed = [p for p in LAYOUT if isinstance(rule, dict) and len(p) and p[0] != ITEM] or [()]
    given = {path for path, _ in _leaves(rule)}
    problems += [f"{label}: {'.'.join(p) or 'a field'} is missing" for p in needed if p not in given and (p or not parts["key"])]
    return JoinRule(tuple(parts["key"]), *parts["name"][:1], *parts["cutoff"][:1])


def default_parameters(levels: tuple[int, ...]) -> tuple[list[float], list[float]]:
    """Start values without any configuration: 0.95 for the exact level, the rest shared; u from weights 10, 3, -5."""
    rest = 0.05 / (len(levels) - 1)
    m = [0.95] + [rest] * (len(levels) - 1)
    weights = [10.0] + [3.0] * (len(levels) - 2) + [-5.0]
    raw = [p / 2.0**w for p, w in zip(m, weights)]
    return m, [p / sum(raw) for p in raw]


def cold_start_model(comparisons: tuple[Comparison, ...], prior: float, configured: dict) -> Model:
    """Hand-set parameters in level order; surplus values are ignored, absent ones take the defaults.

    The values of one field need not sum to 1 and are never rescaled.
    """
    parameters = {}
    for comparison in comparisons:
        m, u = default_parameters(comparison.levels)
        entry = configured.get(comparison.field, {})
        for target, given in ((m, entry.get("m_probabilities", [])), (u, entry.get("u_probabilities", []))):
            for position, value in enumerate(given[: len(target)]):
                target[position] = value
        parameters[comparison.field] = tuple(
            LevelParameters(level, m[position], u[position]) for position, level in enumerate(comparison.levels)
        )
    return Model(prior, parameters)


# The shipped settings (thresholds, rules, hand-set probabilities).
SHIPPED = {
    "entity_fields": ["legal_name", "country_code", "nuts_code", "post_code", "post_name", "thoroughfare"],
    "threshold": 0.7,
    "top_n": 100,
    "match_weight_threshold": -10,
    "auto_train_threshold": 200,
    "splink": {
        "probability_two_random_records_match": 0.003,
        "comparisons": [
            {"type": "jaro_winkler", "field": "legal_name", "thresholds": [0.9, 0.8]},
            {"type": "exact_match", "field": "nuts_code"},
            {"type": "jaro_winkler", "field": "post_code", "thresholds": [0.95, 0.85]},
            {"type": "jaro_winkler", "field": "post_name", "thresholds": [0.9, 0.8]},
            {"type": "jaro_winkler", "field": "thoroughfare", "thresholds": [0.95, 0.85]},
        ],
        "blocking_rules": [
            {"same": "country_code", "similar": {"field": "legal_name", "min_jaro_winkler": 0.8}},
        ],
        "cold_start": {
            "comparisons": {
                "legal_name": {
                    "m_probabilities": [0.9, 0.6, 0.025, 0.005],
                    "u_probabilities": [0.00001, 0.0004, 0.004, 0.99559],
                },
                "nuts_code": {"m_probabilities": [0.92, 0.08], "u_probabilities": [0.05, 0.95]},
                "post_code": {
                    "m_probabilities": [0.85, 0.40, 0.02, 0.005],
                    "u_probabilities": [0.02, 0.08, 0.08, 0.82],
                },
                "post_name": {
                    "m_probabilities": [0.65, 0.25, 0.01, 0.005],
                    "u_probabilities": [0.05, 0.15, 0.15, 0.65],
                },
                "thoroughfare": {
                    "m_probabilities": [0.85, 0.50, 0.02, 0.005],
                    "u_probabilities": [0.01, 0.08, 0.08, 0.83],
                },
            }
        },
    },
}

_NAME_ONLY = {
    "entity_fields": ["legal_name", "country_code", "post_name"],
    "threshold": 0.7,
    "top_n": 100,
    "match_weight_threshold": -10,
    "auto_train_threshold": 200,
}
_NAME_COMPARISON = {
    "probability_two_random_records_match": 0.003,
    "comparisons": [{"type": "jaro_winkler", "field": "legal_name", "thresholds": [0.9, 0.8]}],
}
# Blocking rules of further variants.
COMPOUND = {**_NAME_ONLY, "splink": {**_NAME_COMPARISON, "blocking_rules": [["country_code", "post_name"]]}}
MULTIRULE = {**_NAME_ONLY, "splink": {**_NAME_COMPARISON, "blocking_rules": ["country_code", "post_name", "legal_name"]}}


def shipped() -> ResolverConfig:
    """Name-similarity blocking with address evidence."""
    return ResolverConfig.from_dict(SHIPPED)


def compound() -> ResolverConfig:
    """Blocking on country and town together."""
    return ResolverConfig.from_dict(COMPOUND)


def multirule() -> ResolverConfig:
    """Blocking on country, town or exact name."""
    return ResolverConfig.from_dict(MULTIRULE)
