"""Immutable settings and the rule maps that weigh documents."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints


@dataclass(frozen=True)
class Excludes:
    dirs: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Vault:
    path: str
    name: str
    enabled: bool = True
    exclude: Excludes = Excludes()


@dataclass(frozen=True)
class Decay:
    half_life_days: float = 365
    min_weight: float = 0.5
    type_specific_decay: Mapping[str, float] = field(default_factory=dict)


#: Weights of document statuses where no configuration names any.
STATUS_RULES = {"published": 1.2, "completed": 1.1, "active": 0.9, "draft": 0.7, "archived": 0.5}

#: The rules that come with the shipped configuration, ``dairy`` as it is spelt there.
SHIPPED_TYPES = {"official": 1.2, "project": 1.15, "technical": 1.1, "dairy": 0.9, "blog": 0.9, "archive": 0.7}
SHIPPED_STATUSES = {"published": 1.2, "已发布": 1.2, "completed": 1.1, "已完成": 1.1, "active": 0.9, "编写中": 0.9, "draft": 0.7, "archived": 0.5, "存档": 0.5}
SHIPPED_HALF_LIVES = {"official": 1825, "project": 730, "technical": 1095, "personal": 180, "diary": 180, "archive": 90}


@dataclass(frozen=True)
class Confidence:
    doc_type_rules: Mapping[str, float] = field(default_factory=dict)
    status_rules: Mapping[str, float] = field(default_factory=lambda: dict(STATUS_RULES))
    date_decay: Decay = Decay()

    @classmethod
    def shipped(cls) -> Confidence:
        return cls(SHIPPED_TYPES, SHIPPED_STATUSES, Decay(365, 0.5, SHIPPED_HALF_LIVES))


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 512
    overlap: int = 50
    token_mode: str = "estimate"
    #: A file of ranks for ``token_mode: tiktoken``; without one the library's own encoding, which it may have to fetch.
    vocabulary: str = ""
    chinese_chars_per_token: float = 1.5
    english_chars_per_token: float = 4.0
    max_chars_multiplier: float = 2.5


@dataclass(frozen=True)
class Model:
    name: str = "hashing"
    cache_dir: str = "~/.cache/models"
    size: str = "small"
    dimensions: int = 512
    batch_size: int = 32
    unload_after_seconds: int = 300


@dataclass(frozen=True)
class Cache:
    db_path: str = "./data/cache.db"
    ttl_seconds: float = 3600
    max_entries: int = 1000


@dataclass(frozen=True)
class Settings:
    vaults: tuple[Vault, ...] = ()
    exclude: Excludes = Excludes()
    embedding_model: Model = Model()
    chunking: Chunking = Chunking()
    confidence: Confidence = field(default_factory=Confidence)
    retrieval: Mapping[str, float] = field(default_factory=lambda: {"alpha": 0.7, "beta": 0.3})
    maintenance: Mapping[str, Any] = field(default_factory=lambda: {"soft_delete_threshold": 0.2})
    cache: Cache = Cache()
    jieba_user_dict: str = ""
    jieba_seg_mode: str = "precise"
    log_level: str = "INFO"
    prompts: str = ""


def _clean(value: Any) -> Any:
    """No white space in keys, none around the strings they hold; strings in lists stay as they are."""
    if isinstance(value, dict):
        return {re.sub(r"\s+", "", str(k)): v.strip() if isinstance(v, str) else _clean(v) for k, v in value.items()}
    return [_clean(x) for x in value] if isinstance(value, list) else value


def _build(kind: type, raw: Any) -> Any:
    """A dataclass from a mapping; unknown keys are ignored, missing ones take their defaults."""
    if not isinstance(raw, dict):
        raise ValueError(f"{kind.__name__} must be a mapping")
    hints = get_type_hints(kind)
    known = {}
    for f in fields(kind):
        if raw.get(f.name) is None:
            continue
        hint, value = hints[f.name], raw[f.name]
        inner = next((a for a in getattr(hint, "__args__", ()) if is_dataclass(a)), None)
        if is_dataclass(hint):
            value = _build(hint, value)
        elif inner:
            value = tuple(_build(inner, x) for x in value)
        elif isinstance(value, list):
            value = tuple(value)
        known[f.name] = value
    return kind(**known)


def load_config(path: str) -> Settings:
    """Settings of a YAML file. A missing file is FileNotFoundError, anything else that is wrong ValueError."""
    import yaml

    file = Path(path)
    if not file.exists():
        raise FileNotFoundError(f"no configuration at {file.absolute()}")
    try:
        raw = _clean(yaml.safe_load(file.read_text(encoding="utf-8")) or {})
        settings = _build(Settings, raw)
        return Settings(**{**{f.name: getattr(settings, f.name) for f in fields(Settings)}, "vaults": tuple(Vault(str(Path(v.path).expanduser()), v.name, v.enabled, v.exclude) for v in settings.vaults)})
    except (yaml.YAMLError, TypeError, AttributeError, ValueError) as error:
        raise ValueError(f"configuration {path} can't be used: {error}") from error
