"""Engine configuration: dataclasses with defaults, overlaid by YAML and validated."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any

LANGUAGES = ("auto", "english", "russian", "mixed")


@dataclass
class SourceConfig:
    dir: str = "./documents"
    encoding: str = "utf-8"
    extensions: list[str] = field(default_factory=lambda: [".txt"])


@dataclass
class StorageConfig:
    """``memory`` keeps an index cached; ``lsm`` keeps it as tables under ``data_dir``."""

    backend: str = "memory"
    data_dir: str = ".index-data"
    block_size: int = 1024
    sst_size: int = 4 << 20
    sst_num_per_level: int = 10
    sst_block_size: int = 4 << 10
    max_level: int = 4


@dataclass
class PipelineConfig:
    """Stages of one text pipeline. Without ``normalize`` neither case nor length is looked at."""

    stop_words: bool = False
    stemming: bool = True
    strip_accents: bool = False
    normalize: bool = True
    min_term_length: int = 1


@dataclass
class CustomStopWords:
    """Extra stop words, taken as written."""

    english: list[str] = field(default_factory=list)
    russian: list[str] = field(default_factory=list)


@dataclass
class Config:
    source: SourceConfig = field(default_factory=SourceConfig)
    language: str = "auto"
    storage: StorageConfig = field(default_factory=StorageConfig)
    index: PipelineConfig = field(default_factory=lambda: PipelineConfig(stop_words=True))
    query: PipelineConfig = field(default_factory=PipelineConfig)
    custom_stop_words: CustomStopWords = field(default_factory=CustomStopWords)

    def validate(self) -> Config:
        """Raises ``ValueError`` for settings that don't fit; sizes that aren't positive get their defaults."""
        if not self.source.dir:
            raise ValueError("no source.dir given")
        if self.language not in LANGUAGES:
            raise ValueError(f"unknown language {self.language!r}: one of {', '.join(LANGUAGES)} is wanted")
        for name in ("stemming", "strip_accents", "normalize"):
            if getattr(self.index, name) != getattr(self.query, name):
                raise ValueError(f"index and query need the same {name}")
        if self.storage.backend not in ("", "memory", "lsm"):
            raise ValueError(f"unknown storage.backend {self.storage.backend!r}: memory or lsm is wanted")
        plain = StorageConfig()
        for name in ("block_size", "sst_size", "sst_num_per_level", "sst_block_size", "max_level"):
            if getattr(self.storage, name) <= 0:
                setattr(self.storage, name, getattr(plain, name))
        return self


def _overlay(target: Any, values: dict[str, Any]) -> Any:
    names = {f.name for f in fields(target)}
    for key, value in values.items():
        if key not in names or value is None:
            continue
        own = getattr(target, key)
        if is_dataclass(own):
            _overlay(own, value)
        else:
            setattr(target, key, value)
    return target


def load(path: str) -> Config:
    """Defaults overlaid by a YAML file, validated."""
    import yaml

    try:
        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f) or {}
    except OSError as e:
        raise ValueError(f"cannot open {path}: {e}") from e
    except yaml.YAMLError as e:
        raise ValueError(f"{path} is not YAML: {e}") from e
    try:
        return _overlay(Config(), values).validate()
    except ValueError as e:
        raise ValueError(f"{path}: {e}") from e
