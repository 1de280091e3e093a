"""Run settings: a nested mapping, flattened, with defaults for the older format and range checks by table."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

FORMATS = (2, 3)
MODES = ("query_only", "schema_aware")
UPDATE = "centered_full_information_exponential"
STRATEGIES = ("by_probability", "top_k")

# Settings, their kinds, and what format 2 has where it says nothing ("-": it must say).
SETTINGS: dict[str, tuple[type, Any]] = {
    "schema_version": (int, "-"), "random_seed": (int, "-"), "prompt_mode": (str, "-"), "num_rounds": (int, "-"), "num_training_sqls": (int, "-"), "initial_benign_ratio": (float, "-"), "mix_benign_sources": (bool, False),
    "attacker.gamma_start": (float, "-"), "attacker.gamma_end": (float, "-"), "attacker.strategy": (str, "-"), "attacker.clusters_per_round": (int, "-"), "attacker.weight_exponent": (float, "-"),
    "verifier.update": (str, "-"), "verifier.learning_rate": (float, "-"), "verifier.reward_smoothing_alpha": (float, 1.0), "verifier.reward_smoothing_beta": (float, 1.0), "verifier.benign_fpr_target": (float, 0.05),
    "verifier.benign_ratio_step_size": (float, 0.5), "verifier.benign_error_ema_decay": (float, 0.7), "verifier.benign_ratio_min": (float, 0.15), "verifier.benign_ratio_max": (float, 0.35),
    "payload_mutation.enabled": (bool, "-"), "payload_mutation.probability_start": (float, "-"), "payload_mutation.probability_end": (float, "-"), "payload_mutation.weight_scale_min": (float, 0.5), "payload_mutation.effective_probability_max": (float, 0.8),
    "payload_mutation.llm_temperature": (float, 0.7), "payload_mutation.llm_max_tokens": (int, 2000), "payload_mutation.info_focused_probability": (float, 0.3), "payload_mutation.infer_expected_types": (bool, True),
    "payload_mutation.types_inference_temperature": (float, 0.3), "payload_mutation.types_inference_max_tokens": (int, 500), "payload_mutation.fewshot_examples": (int, 5), "payload_mutation.model": (object, "-"),
    "synthesis.cepp.rational_explanation_probability": (float, 0.2), "synthesis.cepp.llm_max_tokens": (int, 96), "synthesis.cepp.llm_max_retries": (int, 0),
}
#: Sections that format 2 doesn't have: its defaults hold whatever is written there.
NEW_SECTIONS = ("synthesis.",)
MAY_LACK = ("mix_benign_sources",)

positive: Callable[[Any], bool] = lambda x: math.isfinite(x) and x > 0
not_negative: Callable[[Any], bool] = lambda x: math.isfinite(x) and x >= 0
share: Callable[[Any], bool] = lambda x: 0.0 <= x <= 1.0
RANGES: list[tuple[str, Callable[[Any], bool], tuple[str, ...]]] = [
    ("positive", positive, ("num_rounds", "num_training_sqls", "attacker.clusters_per_round", "attacker.weight_exponent", "verifier.learning_rate", "verifier.reward_smoothing_alpha", "verifier.reward_smoothing_beta", "verifier.benign_ratio_step_size", "payload_mutation.llm_max_tokens", "payload_mutation.types_inference_max_tokens", "synthesis.cepp.llm_max_tokens")),
    ("0 or more", not_negative, ("payload_mutation.weight_scale_min", "payload_mutation.llm_temperature", "payload_mutation.types_inference_temperature", "payload_mutation.fewshot_examples", "synthesis.cepp.llm_max_retries")),
    ("within 0 and 1", share, ("initial_benign_ratio", "verifier.benign_fpr_target", "verifier.benign_error_ema_decay", "verifier.benign_ratio_min", "verifier.benign_ratio_max", "payload_mutation.probability_start", "payload_mutation.probability_end", "payload_mutation.effective_probability_max", "payload_mutation.info_focused_probability", "synthesis.cepp.rational_explanation_probability")),
]


@dataclass(frozen=True)
class Settings:
    values: tuple[tuple[str, Any], ...]

    def __getitem__(self, name: str) -> Any:
        return dict(self.values)[name]

    def as_dict(self) -> dict[str, Any]:
        return dict(self.values)

    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(self.as_dict(), sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()

    def overridden(self, **changes: Any) -> Settings:
        """With the changes that aren't None; the schema-aware mode turns source mixing off."""
        now = self.as_dict() | {k: v for k, v in changes.items() if v is not None}
        if now["prompt_mode"] == "schema_aware":
            now["mix_benign_sources"] = False
        return checked(now)


def look_up(raw: dict, name: str) -> tuple[bool, Any]:
    for part in name.split("."):
        if not isinstance(raw, dict):
            raise ValueError(f"{name}: a section must be a mapping")
        if part not in raw:
            return False, None
        raw = raw[part]
    return True, raw


def settings(raw: dict) -> Settings:
    """Settings of a mapping read from YAML or JSON."""
    found, version = look_up(raw, "schema_version")
    if not found or version not in FORMATS:
        raise ValueError(f"unsupported schema_version {version}")
    values = {}
    for name, (kind, default) in SETTINGS.items():
        there, value = look_up(raw, name)
        if version == 2 and name.startswith(NEW_SECTIONS):
            there = False
        if not there:
            if default == "-" or version == 3 and name not in MAY_LACK:
                raise ValueError(f"{name} is missing")
            value = default
        if kind is bool and not isinstance(value, bool):
            raise ValueError(f"{name} must be a boolean")
        values[name] = value if kind in (bool, object) else kind(value)
    if values["prompt_mode"] == "schema_aware":
        values["mix_benign_sources"] = False
    return checked(values)


def checked(v: dict[str, Any]) -> Settings:
    for what, test, names in RANGES:
        for name in names:
            if not test(v[name]):
                raise ValueError(f"{name} must be {what}: {v[name]}")
    wrong = [
        (v["prompt_mode"] not in MODES, f"prompt_mode must be one of {MODES}"),
        (v["mix_benign_sources"] and v["prompt_mode"] != "query_only", "mix_benign_sources needs query_only"),
        (not 0 < v["attacker.gamma_end"] <= v["attacker.gamma_start"] <= 1, "gamma must fall within 0 and 1"),
        (v["attacker.strategy"] not in STRATEGIES, f"strategy must be one of {STRATEGIES}"),
        (v["verifier.update"] != UPDATE, f"update must be {UPDATE}"),
        (not v["verifier.benign_ratio_min"] <= v["initial_benign_ratio"] <= v["verifier.benign_ratio_max"], "initial_benign_ratio is out of its bounds"),
        (not isinstance(v["payload_mutation.model"], str | None), "model must be text or null"),
    ]
    for bad, why in wrong:
        if bad:
            raise ValueError(why)
    return Settings(tuple(v.items()))
