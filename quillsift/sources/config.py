"""Settings: defaults, files in sections, and flags."""

from __future__ import annotations

import argparse
import copy
from collections.abc import Mapping, Sequence
from typing import Any

from quillsift.functions import vocabulary as V

# The defaults of every setting, by section.
SECTIONS: dict[str, dict[str, Any]] = {
    "retrieval": {"top_k": 100, "use_dynamic_attribute_scoring": True, "dynamic_field_gain": 0.65, "dynamic_attribute_max_weight": 0.52, "field_weights": V.FIELD_WEIGHTS},
    "fusion": {
        "rrf_k": 60, "bm25_base": 0.75, "dense_base": 0.25, "browsing_weights": [[0.50, 0.50], [0.60, 0.40]], "use_adaptive_fusion": True,
        "use_dense_risk_gate": True, "dense_gate_min_bm25": 20, "dense_gate_max_confidence": 0.12,
    },
    "dense": {"use_dense": True, "use_field_aware_dense": True},
    "ranking": {
        "use_features": True, "rerank_top_n": 20, "mmr_lambda": 1.0, "profile_weight": 0.15, "use_field_aware_slot_coverage": True,
        "feature_weights": {"base": 1.0, "attribute": 1.6, "negative": 1.4, "slot": 0.8, "category": 1.0, "popularity": 0.15, "price": 0.4},
    },
    "dialogue": {
        "use_reply_purification": True, "override_carryover_confidence": 0.35, "entropy_tau": 0.3, "min_pool_for_dynamic": 10, "few_slots_threshold": 2,
        "pool_size_threshold": 50, "truncated_size": 20, "use_early_stop": True, "use_dynamic_entropy": True, "use_override_detection": True,
    },
}

#: Settings that go by another name outside their section.
RENAMED = {("retrieval", "top_k"): "retrieval_top_k"}


def flat(sections: Mapping[str, Mapping[str, Any]]) -> dict[str, Any]:
    """Settings by one name each; sections and settings that are not known are left out."""
    return {RENAMED.get((s, k), k): copy.deepcopy(sections[s][k]) for s, own in SECTIONS.items() if s in sections for k in own if k in sections[s]}


def load(overrides: Mapping[str, Any] | None = None, sections: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, Any]:
    """Defaults, then those of sections (as a file has them), then overrides by name.

    field_weights may be given in part; every other override replaces the whole value. Nothing given is changed.
    """
    settings = flat(SECTIONS) | flat(sections or {})
    for name, value in (overrides or {}).items():
        settings[name] = {**settings[name], **value} if name == "field_weights" else copy.deepcopy(value)
    return settings


def read(path: str) -> dict[str, Any]:
    """Settings from a file in sections: YAML where its reader is installed, and JSON."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        import yaml
    except ImportError:
        import json

        return load(sections=json.loads(text))
    return load(sections=yaml.safe_load(text) or {})


def add_flags(parser: argparse.ArgumentParser) -> argparse.ArgumentParser:
    """--name and --no-name for every setting that is on or off; left alone they are None."""
    for name, value in load().items():
        if isinstance(value, bool):
            parser.add_argument(f"--{name.replace('_', '-')}", action=argparse.BooleanOptionalAction, default=None)
    return parser


def from_flags(args: Sequence[str] | argparse.Namespace) -> dict[str, bool]:
    """Only the settings that were given."""
    given = add_flags(argparse.ArgumentParser()).parse_args(args) if not isinstance(args, argparse.Namespace) else args
    return {k: v for k, v in vars(given).items() if v is not None and k in load()}
