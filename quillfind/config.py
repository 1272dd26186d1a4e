"""Experiment settings: nested dataclasses with overrides, JSON or YAML files, and validation."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields, is_dataclass


@dataclass(frozen=True)
class Encoder:
    model_name: str = "hash"
    projection_dim: int = 64
    max_query_length: int = 64
    max_doc_length: int = 256


@dataclass(frozen=True)
class Chunking:
    chunk_size: int = 200
    chunk_overlap: int = 50


@dataclass(frozen=True)
class Clustering:
    soft_threshold: float = 0.1
    min_cluster_size: int = 3
    max_k: int = 10
    n_components: int = 10
    max_levels: int = 6


@dataclass(frozen=True)
class Summarizer:
    max_chunk_tokens: int = 1024
    max_summary_sentences: int = 5


@dataclass(frozen=True)
class Retrieval:
    top_k: int = 10
    first_stage_k: int = 100
    rrf_k: int = 60
    bm25_prf_k: int = 5
    expansion_terms: int = 10
    idf_reweighting: bool = True


@dataclass(frozen=True)
class Evaluation:
    k_values: tuple[int, ...] = (1, 3, 5, 10, 100)
    n_resamples: int = 10_000
    alpha: float = 0.05
    correction: str = "bonferroni"


@dataclass(frozen=True)
class Experiment:
    dataset: str = "scifact"
    max_queries: int | None = 100
    max_docs: int | None = None
    seed: int = 42
    output_dir: str = "runs"
    encoder: Encoder = field(default_factory=Encoder)
    chunking: Chunking = field(default_factory=Chunking)
    clustering: Clustering = field(default_factory=Clustering)
    summarizer: Summarizer = field(default_factory=Summarizer)
    retrieval: Retrieval = field(default_factory=Retrieval)
    evaluation: Evaluation = field(default_factory=Evaluation)
    pipelines: tuple[str, ...] = ("naive_dense", "hybrid_rag", "bm25_prf", "contextual_hybrid")

    def validate(self, known: set[str] | None = None) -> Experiment:
        """Itself, or a ValueError that lists everything that is wrong."""
        wrong = []
        if known is not None and (odd := sorted(set(self.pipelines) - known)):
            wrong.append(f"unknown pipelines {odd}")
        for name in ("max_queries", "max_docs"):
            if getattr(self, name) is not None and getattr(self, name) < 1:
                wrong.append(f"{name} must be at least 1")
        for name, value in (("retrieval.top_k", self.retrieval.top_k), ("retrieval.rrf_k", self.retrieval.rrf_k), ("encoder.projection_dim", self.encoder.projection_dim), ("chunking.chunk_size", self.chunking.chunk_size)):
            if value < 1:
                wrong.append(f"{name} must be at least 1")
        for name, value in (("clustering.soft_threshold", self.clustering.soft_threshold), ("evaluation.alpha", self.evaluation.alpha)):
            if not 0 < value < 1:
                wrong.append(f"{name} must lie between 0 and 1")
        if not 0 <= self.chunking.chunk_overlap < self.chunking.chunk_size:
            wrong.append("chunking.chunk_overlap must be smaller than chunking.chunk_size")
        if wrong:
            raise ValueError("; ".join(wrong))
        return self

    def to_dict(self) -> dict:
        return asdict(self)


def from_dict(values: dict, cls=Experiment):
    """Nested settings from a dict. Names that are not known are errors, so that a mistyped one is not passed over."""
    got = {}
    if odd := sorted(set(values) - {f.name for f in fields(cls)}):
        raise ValueError(f"{cls.__name__} has no settings {odd}")
    for f in fields(cls):
        if f.name in values:
            default = f.default_factory() if callable(getattr(f, "default_factory", None)) else f.default
            v = values[f.name]
            got[f.name] = from_dict(v, type(default)) if is_dataclass(default) and isinstance(v, dict) else tuple(v) if isinstance(v, list) else v
    return cls(**got)


def with_overrides(config: Experiment, **dotted) -> Experiment:
    """A copy with settings replaced; nested ones by dotted names: with_overrides(c, **{"retrieval.top_k": 5})."""
    values = config.to_dict()
    for name, v in dotted.items():
        at = values
        *outer, last = name.split(".")
        for part in outer:
            if not isinstance(at.get(part), dict):
                raise ValueError(f"no settings {name!r}")
            at = at[part]
        at[last] = v
    return from_dict(values)


def load(path: str) -> Experiment:
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            return from_dict(_yaml().safe_load(f))
        return from_dict(json.load(f))


def save(config: Experiment, path: str) -> None:
    values = json.loads(json.dumps(config.to_dict()))
    with open(path, "w") as f:
        if path.endswith((".yaml", ".yml")):
            _yaml().safe_dump(values, f, sort_keys=False)
        else:
            json.dump(values, f, indent=2)


def _yaml():
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML settings need the yaml package; JSON works without it") from e
    return yaml
