"""Settings for every stage, with YAML and environment overrides."""

from __future__ import annotations

import os
from collections.abc import Callable, MutableMapping
from dataclasses import dataclass, fields, replace
from importlib import import_module
from typing import Any

# The section labels, floors and token limits results depend on.
SECTION_LABELS = ("Item 1", "Item 1A", "Item 7", "Item 7A", "Item 8", "Item 9A")
REQUIRED_SECTIONS = ("Item 1", "Item 1A", "Item 7")
OPTIONAL_SECTIONS = ("Item 7A", "Item 8", "Item 9A")
MIN_SECTION_CHARS = 30
MIN_REQUIRED_CHARS = 500
MIN_CHUNK_TOKENS = 32
ABSTENTION = "The provided documents do not contain enough information to answer this."
GENERATION_ERROR_ANSWER = (
    "The system was unable to generate an answer due to a generation error. Please try again."
)


# The first two mean the one built-in pattern, a substitute for either library;
# the last learns the abbreviations of the corpus.
SPLITTERS = ("nltk", "pysbd", "learned")


def hook(path: str) -> Callable:
    """The function named "module:function"."""
    module, _, name = path.partition(":")
    return getattr(import_module(module), name)


@dataclass(frozen=True)
class Settings:
    # corpus
    tickers: tuple[str, ...] = (
        "PFE", "MRK", "JNJ", "ABBV", "BMY", "LLY", "AMGN", "GILD", "REGN", "VRTX", "MRNA", "BIIB",
    )
    num_fiscal_years: int = 1
    max_filings_per_run: int = 30
    prefer_amended: bool = True
    # chunking
    chunk_size_tokens: int = 800
    chunk_overlap_tokens: int = 120
    sentence_splitter: str = "nltk"
    min_chunk_tokens: int = MIN_CHUNK_TOKENS
    # embedding
    embed_dim: int = 64
    max_seq_length: int = 2048
    normalize: bool = True
    query_instruction: str = "search_query: "
    document_instruction: str = "search_document: "
    device: str = "auto"
    batch_size_gpu: int = 64
    batch_size_cpu: int = 16
    # "module:function" of model loaders, empty for the offline stand-ins. The
    # embedder's gets the device and returns texts -> vectors, the reranker's
    # nothing and returns pairs -> scores.
    embed_loader: str = ""
    # The tokenizer's gets the path and returns texts -> lists of (start, end) of
    # tokens in characters; empty for the pattern that needs no Python.
    tokenizer_loader: str = ""
    tokenizer_path: str = ""
    rerank_loader: str = ""
    # retrieval
    top_k_dense: int = 20
    hybrid_enabled: bool = False
    bm25_top_k: int = 20
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    # reranking
    rerank_enabled: bool = True
    rerank_top_n: int = 5
    rerank_timeout_sec: float = 30.0
    rerank_score_threshold: float = -2.0
    # Scorer without a loader: "lexical" or "proximity".
    rerank_scorer: str = "lexical"
    # generation
    backend: str = "extractive"
    model: str = "lexical"
    temperature: float = 0.1
    top_p: float = 0.95
    max_output_tokens: int = 800
    offline: bool = False
    local_model: str = ""
    # Where answers of chat services are kept, so that none is asked for twice; empty: nowhere.
    ledger_path: str = ""
    chat_host: str = "http://localhost:11434"
    # evaluation
    judge_backend: str = "lexical"
    judge_model: str = "lexical"
    judge_url: str = ""
    golden_set_path: str = ""
    seed: int = 42
    # physical limits: sides above these sizes are never broadcast
    broadcast_questions: int = 2048
    broadcast_rows: int = 200_000
    # number of hash buckets the chunk store is laid out in
    store_buckets: int = 64

    @property
    def safe_max_tokens(self) -> int:
        return min(self.max_seq_length - 12, int(self.chunk_size_tokens * 1.05))

    @property
    def split_stride(self) -> int:
        return max(self.chunk_size_tokens - self.chunk_overlap_tokens, 1)

    @property
    def fused_top_k(self) -> int:
        return max(self.top_k_dense, self.bm25_top_k)

    @property
    def model_version(self) -> str:
        return f"{self.backend}/{self.model}"


# Where each setting sits in the YAML file.
_YAML_KEYS = {
    "tickers": "corpus.tickers",
    "num_fiscal_years": "corpus.num_fiscal_years",
    "max_filings_per_run": "corpus.max_filings_per_run",
    "prefer_amended": "edgar.prefer_amended",
    "chunk_size_tokens": "chunking.chunk_size_tokens",
    "chunk_overlap_tokens": "chunking.chunk_overlap_tokens",
    "embed_dim": "embeddings.dim",
    "max_seq_length": "embeddings.max_seq_length",
    "normalize": "embeddings.normalize",
    "query_instruction": "embeddings.query_instruction",
    "document_instruction": "embeddings.document_instruction",
    "device": "embeddings.device",
    "batch_size_gpu": "embeddings.batch_size_gpu",
    "batch_size_cpu": "embeddings.batch_size_cpu",
    "embed_loader": "embeddings.loader",
    "rerank_loader": "rerank.loader",
    "sentence_splitter": "chunking.sentence_splitter",
    "tokenizer_loader": "chunking.tokenizer_loader",
    "tokenizer_path": "chunking.tokenizer_path",
    "ledger_path": "generation.ledger_path",
    "local_model": "serving.ollama_model_name",
    "judge_backend": "eval.judge_backend",
    "judge_url": "eval.judge_url",
    "golden_set_path": "eval.golden_set_path",
    "top_k_dense": "retrieval.top_k_dense",
    "hybrid_enabled": "retrieval.hybrid_enabled",
    "bm25_top_k": "retrieval.bm25_top_k",
    "rrf_k": "retrieval.rrf_k",
    "rerank_enabled": "rerank.enabled",
    "rerank_scorer": "rerank.scorer",
    "rerank_top_n": "rerank.top_n",
    "rerank_timeout_sec": "rerank.timeout_sec",
    "rerank_score_threshold": "rerank.score_threshold",
    "backend": "generation.backend",
    "model": "generation.model",
    "temperature": "generation.temperature",
    "top_p": "generation.top_p",
    "max_output_tokens": "generation.max_output_tokens",
    "chat_host": "serving.ollama_host",
    "judge_model": "eval.judge_model",
    "seed": "eval.seed",
}


def lookup(tree: Any, dotted: str, default: Any = None) -> Any:
    """Value at a dotted path of nested dicts, or ``default``."""
    for key in dotted.split("."):
        if not isinstance(tree, dict) or key not in tree:
            return default
        tree = tree[key]
    return tree


def from_tree(tree: dict, environ: dict[str, str] | None = None) -> Settings:
    """Settings from a parsed YAML tree; environment variables win."""
    env = os.environ if environ is None else environ
    known = {f.name for f in fields(Settings)}
    found = {
        name: value
        for name, path in _YAML_KEYS.items()
        if name in known and (value := lookup(tree, path)) is not None
    }
    if "tickers" in found:
        found["tickers"] = tuple(found["tickers"])
    settings = Settings(**found)
    if settings.sentence_splitter not in SPLITTERS:
        raise ValueError(f"unknown sentence splitter {settings.sentence_splitter}")
    overrides: dict[str, Any] = {}
    if env.get("EMBED_DEVICE"):
        overrides["device"] = env["EMBED_DEVICE"]
    if env.get("GENERATOR_BACKEND_OVERRIDE"):
        overrides["backend"] = env["GENERATOR_BACKEND_OVERRIDE"]
    if env.get("OFFLINE_MODE") == "1":
        overrides["offline"] = True
    return replace(settings, **overrides)


def load_env(path: str = ".env", environ: MutableMapping[str, str] | None = None) -> list[str]:
    """Puts the variables of a ``.env`` file into the environment of this process, those that are not set there yet, and
    names them. Lines are ``NAME=value``, also after ``export``; quotes around a value and what follows `` #`` go. A
    missing file has no variables."""
    env, added = os.environ if environ is None else environ, []
    if not os.path.isfile(path):
        return added
    with open(path, encoding="utf-8") as handle:
        lines = [line.strip().removeprefix("export ").strip() for line in handle]
    for line in lines:
        name, found, value = line.partition("=")
        name, value = name.strip(), value.strip()
        if not found or not name.isidentifier():
            continue
        if value[:1] in ("'", '"') and value.find(value[0], 1) > 0:
            value = value[1:value.find(value[0], 1)]
        else:
            value = f" {value}".partition(" #")[0].strip()
        if name not in env:
            env[name] = value
            added.append(name)
    return added


def load_settings(path: str | None = None, environ: dict[str, str] | None = None) -> Settings:
    """Read a YAML file (or only the environment when ``path`` is None)."""
    if path is None:
        return from_tree({}, environ)
    import yaml

    with open(path, encoding="utf-8") as handle:
        return from_tree(yaml.safe_load(handle) or {}, environ)
