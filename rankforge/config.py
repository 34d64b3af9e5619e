"""The configuration tree: defaults, YAML, dotted overrides and validation."""

from __future__ import annotations

import copy
import os
import platform
from collections.abc import Callable
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = dict(
    device="auto",
    logging=dict(level="INFO"),
    ingestion=dict(input_directory="data/raw", recursive=True, supported_extensions=[".pdf", ".docx", ".txt", ".md"]),
    preprocessing=dict(
        {k: True for k in ("normalize_unicode", "cleanup_whitespace", "remove_headers", "remove_footers", "remove_page_numbers", "remove_empty_lines")},
        header_footer_removal_threshold=0.7, header_detection_lines=2, footer_detection_lines=2,
    ),
    chunking=dict(strategy="recursive", chunk_size=250, overlap=40, semantic_similarity_threshold=0.58, semantic_min_sentences=2, semantic_encoder_model=None),
    output=dict(output_directory="data/processed", processed_corpus_filename="processed_corpus.json"),
    embedding=dict(
        model_name="sentence-transformers/all-MiniLM-L6-v2", backend="auto", device="auto", batch_size=32, normalize_embeddings=True,
        fallback_dimension=384, cache_directory="data/cache/embeddings", show_progress=True,
    ),
    index=dict(index_directory="data/index", bm25=dict(k1=1.5, b=0.75), dense=dict(metric="cosine")),
    retrieval=dict(retriever="hybrid", top_k=10, fusion=dict(strategy="reciprocal_rank_fusion", rrf_k=60)),
    query_enhancement=dict(enabled=False, method="none", methods=[], expansion=dict(max_expansion_terms=3, similarity_threshold=0.35, vocabulary_size=512)),
    reranking=dict(enabled=False, backend="auto", model_name="cross-encoder/ms-marco-MiniLM-L-6-v2", top_n=5),
    benchmark=dict(dataset_path=None, experiment_directory="reports/experiments", results_directory="reports/benchmarks", test_split_ratio=0.2, notes=None),
    reporting=dict(reports_directory="reports/generated", include_csv=True, include_json=True, include_markdown=True),
    visualization=dict(output_directory="reports/visualizations", export_html=True, export_png=True),
    recommendation=dict(quality_weight=0.65, latency_weight=0.2, embedding_cost_weight=0.075, index_build_weight=0.075),
)
CHOICES = {
    "device": ("auto", "cuda", "mps", "cpu"),
    "embedding.device": ("auto", "cuda", "mps", "cpu"),
    "index.dense.metric": ("cosine",),
}
POSITIVE = ("chunking.chunk_size", "chunking.semantic_min_sentences", "embedding.batch_size", "embedding.fallback_dimension", "retrieval.top_k", "retrieval.fusion.rrf_k", "reranking.top_n", "query_enhancement.expansion.vocabulary_size")


def _registered() -> dict[str, tuple]:
    """The names that components are registered under, by the setting that names them."""
    from rankforge.operators import chunking, dense, ranking
    from rankforge.plans import retrieval

    return {
        "chunking.strategy": tuple(chunking.CHUNKERS), "embedding.backend": ("auto", *dense.BACKENDS), "retrieval.retriever": tuple(retrieval.RETRIEVERS),
        "retrieval.fusion.strategy": tuple(ranking.FUSIONS), "query_enhancement.method": ("none", *retrieval.ENHANCERS), "reranking.backend": ("auto", *ranking.RERANKERS),
    }


class ConfigError(ValueError):
    """A value outside its domain."""


def _merge(base: dict, more: dict, path: str = "") -> dict:
    out = dict(base)
    for k, v in (more or {}).items():
        here = f"{path}{k}"
        if k not in base:
            raise ConfigError(f"unknown setting {here}")
        out[k] = _merge(base[k], v or {}, here + ".") if isinstance(base[k], dict) else v
    return out


class Config:
    """A validated, immutable-by-convention tree; config["chunking.overlap"] reads a dotted path."""

    def __init__(self, values: dict | None = None):
        self.values = _merge(copy.deepcopy(DEFAULTS), values or {})
        q = self.values["query_enhancement"]
        q["methods"] = [m for m in dict.fromkeys(q["methods"] or []) if m != "none"]
        self._validate()

    @classmethod
    def load(cls, path: str | Path, read: Callable[[str], str] | None = None) -> Config:
        """From YAML; `read` gets the text where the path is not on this machine."""
        import yaml

        text = read(str(path)) if read else Path(expand(path)).read_text(encoding="utf-8")
        return cls(yaml.safe_load(text) or {})

    def __getitem__(self, path: str) -> Any:
        value: Any = self.values
        for part in path.split("."):
            value = value[part]
        return value

    def with_overrides(self, overrides: dict[str, Any]) -> Config:
        """A new configuration with dotted paths replaced, validated again."""
        values = copy.deepcopy(self.values)
        for path, v in overrides.items():
            *parents, last = path.split(".")
            at = values
            for p in parents:
                at = at.setdefault(p, {})
            at[last] = v
        return Config(values)

    def _validate(self) -> None:
        for path, allowed in (CHOICES | _registered()).items():
            if self[path] not in allowed:
                raise ConfigError(f"{path} must be one of {', '.join(allowed)}; it is {self[path]!r}")
        for path in POSITIVE:
            if not self[path] > 0:
                raise ConfigError(f"{path} must be above zero")
        if unknown := set(self.methods) - set(_registered()["query_enhancement.method"]):
            raise ConfigError(f"no query enhancement {', '.join(sorted(unknown))}")
        size, overlap = self["chunking.chunk_size"], self["chunking.overlap"]
        if not 0 <= overlap < size:
            raise ConfigError("chunking.overlap must be at least 0 and below chunking.chunk_size")
        if not 0 < self["benchmark.test_split_ratio"] < 1:
            raise ConfigError("benchmark.test_split_ratio must lie between 0 and 1")
        if not 0 < self["preprocessing.header_footer_removal_threshold"] <= 1:
            raise ConfigError("preprocessing.header_footer_removal_threshold must be above 0 and at most 1")
        if not 0.99 <= sum(self["recommendation"].values()) <= 1.01:
            raise ConfigError("the recommendation weights must sum to 1")

    @property
    def methods(self) -> list[str]:
        """The query enhancements in effect, in order."""
        q = self["query_enhancement"]
        if not q["enabled"]:
            return []
        return q["methods"] or ([q["method"]] if q["method"] != "none" else [])

    @property
    def resolved_device(self) -> str:
        """The configured device; `auto` is cpu unless torch is importable and finds better."""
        if self["device"] != "auto":
            return self["device"]
        try:
            import torch
        except ImportError:
            return "cpu"
        if torch.cuda.is_available():
            return "cuda"
        return "mps" if platform.system() == "Darwin" and torch.backends.mps.is_available() else "cpu"


def expand(path: str) -> str:
    return os.path.expandvars(os.path.expanduser(str(path)))
