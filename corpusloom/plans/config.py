"""Settings of jobs: defaults under a file, under a profile, under the environment, under overrides."""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any, get_type_hints

ENVIRONMENT = "CORPUSLOOM_"


class ConfigurationError(ValueError):
    """A setting that can't be."""


@dataclass
class CorpusSettings:
    source: str = ""
    format: str = "auto"
    text_field: str = "text"
    language: str | None = None
    minimum_sentence_characters: int = 1
    maximum_sentence_characters: int = 10_000
    lowercase: bool = False
    deduplicate: bool = True

    def check(self) -> None:
        if not 0 < self.minimum_sentence_characters <= self.maximum_sentence_characters:
            raise ConfigurationError("sentence lengths: 0 < minimum <= maximum")


@dataclass
class PairSettings:
    minimum_anchor_characters: int = 8
    minimum_positive_characters: int = 100
    maximum_positive_characters: int = 2000
    maximum_overlap: float = 1.0

    def check(self) -> None:
        if not 0 < self.minimum_positive_characters <= self.maximum_positive_characters:
            raise ConfigurationError("positive lengths: 0 < minimum <= maximum")
        if not 0 <= self.maximum_overlap <= 1:
            raise ConfigurationError("the overlap is a share")


@dataclass
class NegativeSettings:
    count: int = 4
    pool: int = 32
    maximum_similarity: float = 0.95
    minimum_similarity: float = 0.0
    margin: float | None = None

    def check(self) -> None:
        if self.count < 1 or self.pool < self.count:
            raise ConfigurationError("negatives: 1 <= count <= pool")
        if not -1 <= self.minimum_similarity < self.maximum_similarity <= 1:
            raise ConfigurationError("similarities: -1 <= minimum < maximum <= 1")


@dataclass
class SelectionSettings:
    train_pairs: int = 20_000
    evaluation_pairs: int = 2_000
    seed: int = 0
    query_prefix: str = ""
    passage_prefix: str = ""
    kinds: list[str] = field(default_factory=list)
    languages: list[str] = field(default_factory=list)

    def check(self) -> None:
        if self.train_pairs < 1 or self.evaluation_pairs < 2:
            raise ConfigurationError("one training pair and two evaluation pairs at least")


@dataclass
class Settings:
    corpus: CorpusSettings = field(default_factory=CorpusSettings)
    pairs: PairSettings = field(default_factory=PairSettings)
    negatives: NegativeSettings = field(default_factory=NegativeSettings)
    selection: SelectionSettings = field(default_factory=SelectionSettings)

    def check(self) -> None:
        for f in dataclasses.fields(self):
            getattr(self, f.name).check()


def parse_override(text: str) -> tuple[list[str], Any]:
    """`a.b=value`; the value is JSON if it can be, else a string."""
    key, equals, value = text.partition("=")
    if not equals or not key.strip():
        raise ConfigurationError(f"{text!r} is no key=value")
    try:
        return key.strip().split("."), json.loads(value)
    except ValueError:
        return key.strip().split("."), value


def from_environment(environment: Mapping[str, str]) -> dict:
    out: dict = {}
    for name, value in environment.items():
        if name.startswith(ENVIRONMENT) and "__" in name:
            path, parsed = parse_override(name.removeprefix(ENVIRONMENT).lower().replace("__", ".") + "=" + value)
            _put(out, path, parsed)
    return out


def _put(tree: dict, path: list[str], value: Any) -> None:
    for part in path[:-1]:
        tree = tree.setdefault(part, {})
    tree[path[-1]] = value


def _apply(settings: Any, values: Mapping) -> None:
    hints = get_type_hints(type(settings))
    for name, value in values.items():
        if name not in hints:
            raise ConfigurationError(f"no setting {name!r}; there are {sorted(hints)}")
        held = getattr(settings, name)
        if dataclasses.is_dataclass(held):
            _apply(held, value)
            continue
        if isinstance(held, float) and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        if held is not None and value is not None and not isinstance(value, type(held)):
            raise ConfigurationError(f"{name} is a {type(held).__name__}, not {value!r}")
        setattr(settings, name, value)


def load(file: Mapping | None = None, profile: str | None = None, environment: Mapping[str, str] | None = None, overrides: list[str] | None = None) -> Settings:
    """Settings from all layers, checked after each."""
    settings = Settings()
    file = dict(file or {})
    profiles = file.pop("profiles", {})
    if profile is not None and profile not in profiles:
        raise ConfigurationError(f"no profile {profile!r}; there are {sorted(profiles)}")
    layers = [file, profiles.get(profile, {}) if profile else {}, from_environment(os.environ if environment is None else environment)]
    for text in overrides or []:
        layer: dict = {}
        _put(layer, *parse_override(text))
        layers.append(layer)
    for layer in layers:
        _apply(settings, layer)
        settings.check()
    return settings
