"""Buyer profiles as data.

``Profile`` is the compiled form a scoring plan inlines as literals.
``read_profiles`` turns any number of profile files into long tables.
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nestrank.sources import profile_data

SECTIONS = (
    "hard_filters", "soft_caps", "weights", "nlp_signals",
    "location_modifiers", "alerts", "visual_preferences", "explain",
)


@dataclass(frozen=True)
class Profile:
    hard_filters: Mapping[str, Any] = field(default_factory=dict)
    soft_caps: Mapping[str, Any] = field(default_factory=dict)
    weights: Mapping[str, float] = field(default_factory=dict)
    nlp_signals: Mapping[str, Any] = field(default_factory=dict)
    location_modifiers: Mapping[str, Any] = field(default_factory=dict)
    alerts: Mapping[str, Any] = field(default_factory=dict)
    visual_preferences: Mapping[str, Any] = field(default_factory=dict)
    explain: Mapping[str, Any] = field(default_factory=dict)
    mode: str = "rent"
    normalize_keywords: bool = False

    def groups(self, polarity: str) -> dict[str, list[str]]:
        """Keyword groups of a polarity.  Keywords are matched as written: an upper-case
        keyword never matches lower-cased text unless ``normalize_keywords`` is set."""
        out = {}
        for name, payload in (self.nlp_signals.get(polarity) or {}).items():
            words = list((payload or {}).get("keywords") or [])
            if words:
                out[name] = [w.lower() for w in words] if self.normalize_keywords else words
        return out

    def keywords(self, polarity: str, group: str) -> list[str]:
        return self.groups(polarity).get(group, [])

    def multiplier(self, polarity: str, group: str) -> float:
        payload = (self.nlp_signals.get(polarity) or {}).get(group) or {}
        return float(payload.get("weight", 1.0))

    def penalizes(self, condition: str) -> bool:
        return condition in (self.location_modifiers.get("penalize_conditions") or [])

    @property
    def neighborhoods(self) -> list[str]:
        return [n for n in self.hard_filters.get("neighborhoods") or [] if isinstance(n, str)]

    @property
    def total_weight(self) -> float:
        total = float(sum(self.weights.values()))
        return total if total > 0 else 1.0


def compile_profile(data: Mapping[str, Any], mode: str = "rent", normalize_keywords: bool = False) -> Profile:
    """Profile from a mapping; a section that is not a mapping counts as empty."""
    parts = {s: (data.get(s) if isinstance(data.get(s), dict) else {}) for s in SECTIONS}
    return Profile(**parts, mode=mode, normalize_keywords=normalize_keywords)


def rental_profile(**kwargs) -> Profile:
    return compile_profile(profile_data.RENTAL, **kwargs)


def purchase_profile(**kwargs) -> Profile:
    kwargs.setdefault("mode", "buy")
    return compile_profile(profile_data.PURCHASE, **kwargs)


def parse_profile_text(text: str, name: str = "profile") -> dict[str, Any]:
    """Mapping from YAML (when PyYAML is there) or JSON text."""
    try:
        import yaml

        data = yaml.safe_load(text) or {}
    except ImportError:
        data = json.loads(text or "{}")
    if not isinstance(data, dict):
        raise ValueError(f"{name}: a profile must be a mapping")
    return data


def load_profile(path: str, **kwargs) -> Profile:
    with open(path, encoding="utf-8") as handle:
        return compile_profile(parse_profile_text(handle.read(), path), **kwargs)


TABLES = {
    "profile_weights": "profile_id string, ord int, criterion string, weight double",
    "profile_keywords": "profile_id string, polarity string, grp string, ord int, keyword string, grp_weight double",
    "profile_streets": "profile_id string, kind string, ord int, street string",
    "profile_filters": "profile_id string, section string, name string, value double, item string",
}


def profile_tables(spark: SparkSession, profiles: Mapping[str, Mapping[str, Any] | Profile]) -> dict[str, DataFrame]:
    """Long tables of many profiles, one row per weight, keyword, street and filter.

    A group without keywords keeps its weight in a row whose keyword is null, and the mode is a
    filter row, so the tables hold all that scoring reads.
    """
    weights, words, streets, filters = [], [], [], []
    for pid, data in profiles.items():
        profile = data if isinstance(data, Profile) else compile_profile(data)
        filters.append((pid, "mode", "mode", None, profile.mode))
        weights += [
            (pid, i, c, float(w)) for i, (c, w) in enumerate(profile.weights.items())
        ]
        for polarity in ("positive", "negative"):
            found = profile.groups(polarity)
            for grp in profile.nlp_signals.get(polarity) or {}:
                mult = profile.multiplier(polarity, grp)
                words += [(pid, polarity, grp, i, t, mult) for i, t in enumerate(found.get(grp) or [None])]
        for kind in ("boost_streets", "penalize_streets", "penalize_conditions"):
            streets += [
                (pid, kind, i, s)
                for i, s in enumerate(profile.location_modifiers.get(kind) or [])
            ]
        for section in ("hard_filters", "soft_caps"):
            for name, value in getattr(profile, section).items():
                if isinstance(value, (int, float)):
                    filters.append((pid, section, name, float(value), None))
        filters += [
            (pid, "hard_filters", "neighborhoods", None, n) for n in profile.neighborhoods
        ]
    rows = (weights, words, streets, filters)
    return {name: spark.createDataFrame(part, kind) for part, (name, kind) in zip(rows, TABLES.items())}


def read_profiles(spark: SparkSession, paths: Sequence[str]) -> dict[str, DataFrame]:
    """Load profile files (any Hadoop path) into the long tables; the file name without
    its extension is the profile id."""
    rows = (
        spark.read.option("wholetext", True)
        .text(list(paths))
        .select(F.col("value"), F.input_file_name().alias("path"))
        .collect()  # profiles are a handful of small configuration files
    )
    profiles = {}
    for row in sorted(rows, key=lambda r: r.path):
        pid = os.path.splitext(os.path.basename(row.path))[0]
        profiles[pid] = parse_profile_text(row.value, row.path)
    return profile_tables(spark, profiles)
