"""Typed settings of every part, from YAML with defaults in code."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

VARIABLE, DEFAULT_FILE = "QUIREFLOW_CONFIG", "config/config.yaml"


@dataclass
class Model:
    base_url: str = ""
    model: str = ""
    max_tokens: int = 4096
    temperature: float = 0.3
    timeout: float = 120.0
    attempts: int = 3


@dataclass
class Vision(Model):
    enabled: bool = False
    timeout: float = 180.0


@dataclass
class Embedding:
    model: str = "hashing"
    batch_size: int = 32
    dimension: int = 768


@dataclass
class Storage:
    path: str = "library"


@dataclass
class Chunking:
    min_tokens: int = 500
    max_tokens: int = 2000
    overlap: float = 0.2
    preserve_structure: bool = True
    strategy: str = "recursive"
    compat: bool = True


@dataclass
class Agents:
    enabled: dict[str, bool] = field(default_factory=lambda: {k: True for k in ("bibliography", "genre_tags", "overview", "themes", "technical_concepts", "key_quotes", "chapter_summary")})
    predefined_tags: list[str] = field(default_factory=list)


@dataclass
class Batch:
    max_files: int = 0
    recursive: bool = True
    retry_failed: bool = False


@dataclass
class Logging:
    level: str = "INFO"
    file: str = ""


SECTIONS = {"llm": Model, "vlm": Vision, "embedding": Embedding, "storage": Storage, "chunking": Chunking, "agents": Agents, "batch": Batch, "logging": Logging}


@dataclass
class Config:
    llm: Model = field(default_factory=Model)
    vlm: Vision = field(default_factory=Vision)
    embedding: Embedding = field(default_factory=Embedding)
    storage: Storage = field(default_factory=Storage)
    chunking: Chunking = field(default_factory=Chunking)
    agents: Agents = field(default_factory=Agents)
    batch: Batch = field(default_factory=Batch)
    logging: Logging = field(default_factory=Logging)

    @classmethod
    def from_dict(cls, raw: dict | None) -> Config:
        """Unknown sections and keys are an error, missing ones take their default."""
        made = {}
        for name, values in (raw or {}).items():
            if name not in SECTIONS:
                raise ValueError(f"unknown section {name}")
            known = {f.name for f in fields(SECTIONS[name])}
            if extra := set(values or {}) - known:
                raise ValueError(f"unknown keys in {name}: {sorted(extra)}")
            made[name] = SECTIONS[name](**(values or {}))
        return cls(**made)

    @classmethod
    def from_yaml(cls, path: str | Path) -> Config:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()))

    @classmethod
    def load(cls, path: str | Path | None = None) -> Config:
        """The given file, else the one that the environment names, else the default file, else the defaults."""
        for found in (path, os.environ.get(VARIABLE)):
            if found:
                if not Path(found).is_file():
                    raise FileNotFoundError(found)
                return cls.from_yaml(found)
        return cls.from_yaml(DEFAULT_FILE) if Path(DEFAULT_FILE).is_file() else cls()

    def to_yaml(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(asdict(self), sort_keys=False))

    def to_spark(self, spark) -> None:
        """The settings as spark.conf keys quireflow.<section>.<key>."""
        for section, values in asdict(self).items():
            for key, value in values.items():
                spark.conf.set(f"quireflow.{section}.{key}", str(value))
