"""Parameters of the pipeline as one frozen value, read from YAML where there is a file."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    warehouse: str = "warehouse"
    domain: str = "default"
    interdisciplinary: float = 0.5
    confidence: float = 0.3
    dedup_similarity: float = 0.85
    min_document_frequency: int = 5
    max_skills: int = 30
    max_words: int = 8
    min_cluster_size: int = 10
    min_samples: int | None = None
    cluster_epsilon: float = 0.25
    top_skills: int = 15
    experience_bins: tuple[int, ...] = (0, 1, 3, 5, 10)
    axes: tuple[str, ...] = ("domain_knowledge", "experimental", "data_analysis", "computational", "professional_texts", "t_profile", "management")

    def path(self, table: str) -> str:
        """Tables of all domains lie in one folder each, with the domain as a partition."""
        return f"{self.warehouse}/{table}/domain={self.domain}"


def load(path: str | None) -> Config:
    if not path or not Path(path).exists():
        return Config()
    import yaml

    given = yaml.safe_load(Path(path).read_text("utf-8")) or {}
    names = {f.name for f in fields(Config)}
    return Config(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if k in names})
