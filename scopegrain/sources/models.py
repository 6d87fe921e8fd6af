"""Embedding models and providers: registry, resolution, fingerprints, and embedding of a column."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Known models with provider and width, and the providers' addresses.
MODELS = {
    "text-embedding-3-small": ("openai", 1536),
    "text-embedding-3-large": ("openai", 3072),
    "text-embedding-ada-002": ("openai", 1536),
    "models/text-embedding-004": ("google", 768),
    "nomic-embed-text": ("ollama", 768),
    "mxbai-embed-large": ("ollama", 1024),
    "bge-m3": ("ollama", 1024),
    "all-minilm": ("ollama", 384),
    "Qwen/Qwen3-Embedding-0.6B": ("custom", 1024),
    "Qwen/Qwen3-Embedding-4B": ("custom", 2560),
    "Qwen/Qwen3-Embedding-8B": ("custom", 4096),
}
ADDRESSES = {"openai": "https://api.openai.com/v1", "ollama": "http://localhost:11434", "google": "https://generativelanguage.googleapis.com/v1beta", "custom": "http://localhost:3000/v1"}
#: Texts of one request, and what a fingerprint is taken of (this index's own sentence: stored fingerprints are its own too).
BATCH, SENTINEL = 100, "The quick brown fox jumps over the lazy dog. Index sentinel v1."

Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Model:
    name: str
    provider: str
    dimensions: int
    base_url: str
    source: str


def provider_of(name: str, base_url: str | None = None) -> str:
    if base_url:
        return "openai" if "openai.com" in base_url else "ollama" if "localhost:11434" in base_url or "ollama" in base_url else "google" if "googleapis.com" in base_url else "custom"
    return "openai" if name.startswith("text-embedding") else "google" if name.startswith("models/") else "ollama"


def resolve(name: str, provider: str | None = None, dimensions: int | None = None, base_url: str | None = None, probe: Embedder | None = None) -> Model:
    """A model's provider, width and address: from the registry, else by a probe, else as given; else an error."""
    if name in MODELS:
        own, width = MODELS[name]
        return Model(name, provider or own, dimensions or width, base_url or ADDRESSES[own], "registry")
    owner = provider or provider_of(name, base_url)
    if probe is not None:
        try:
            return Model(name, owner, len(probe(["hello"])[0]), base_url or ADDRESSES.get(owner, ""), "probe")
        except (OSError, ValueError, KeyError, IndexError):
            pass
    if dimensions:
        return Model(name, owner, dimensions, base_url or ADDRESSES.get(owner, ""), "manual")
    raise ValueError(f"the width of {name!r} is unknown; give dimensions")


def _post(url: str, body: dict, headers: dict[str, str]) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=60) as answer:
        return json.loads(answer.read())


def remote(model: Model, key: str = "") -> Embedder:
    """An embedder that asks the model's provider; unknown providers are asked in the first one's form."""
    bearer = {"Authorization": f"Bearer {key}"} if key else {}
    if model.provider == "ollama":
        return lambda texts: _post(f"{model.base_url}/api/embed", {"model": model.name, "input": texts}, {})["embeddings"]
    if model.provider == "google":
        ask = lambda t: {"model": model.name, "content": {"parts": [{"text": t}]}}
        return lambda texts: [e["values"] for e in _post(f"{model.base_url}/{model.name}:batchEmbedContents?key={key}", {"requests": [ask(t) for t in texts]}, {})["embeddings"]]
    return lambda texts: [d["embedding"] for d in sorted(_post(f"{model.base_url}/embeddings", {"model": model.name, "input": texts}, bearer)["data"], key=lambda d: d.get("index", 0))]


def hashing(dimensions: int = 64) -> Embedder:
    """A deterministic local embedder: signed hashed words and word pairs, of unit length. A stand-in, of lesser quality."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            words = text.lower().split()
            vector = np.zeros(dimensions, np.float64)
            for token in [*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]:
                digest = hashlib.blake2b(token.encode("utf-8", "replace"), digest_size=8).digest()
                vector[int.from_bytes(digest[:4], "little") % dimensions] += 1 if digest[4] & 1 else -1
            norm = float(np.sqrt((vector * vector).sum()))
            out.append((vector / norm if norm else vector).astype(np.float32).tolist())
        return out

    return embed


def embed_column(df: DataFrame, text_col: str, embedder: Embedder, out_col: str = "vector", batch: int = BATCH) -> DataFrame:
    """``df`` with a vector for each text; a null text has a null vector. Each distinct text of an Arrow batch is asked once."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            distinct = list(dict.fromkeys(t for t in texts if t is not None))
            vectors: dict[str, list[float]] = {}
            for at in range(0, len(distinct), batch):
                some = distinct[at : at + batch]
                vectors.update(zip(some, embedder(some), strict=True))
            yield pd.Series([vectors.get(t) for t in texts], dtype=object)

    return df.withColumn(out_col, run(F.col(text_col).cast("string")))


def cached(embedder: Embedder, size: int = 256) -> Callable[[str], tuple[float, ...]]:
    """Embed one query at a time; the latest ``size`` are kept."""
    return lru_cache(maxsize=size)(lambda text: tuple(embedder([text])[0]))


def fingerprint(embedder: Embedder) -> tuple[str, int]:
    """SHA-256 of the sentinel's vector as little-endian floats, and its width."""
    vector = np.array(embedder([SENTINEL])[0], "<f4")
    return hashlib.sha256(vector.tobytes()).hexdigest(), len(vector)


def pack(vector: list[float]) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def unpack(data: bytes) -> list[float]:
    if len(data) % 4:
        raise ValueError("a packed vector's length must be a multiple of 4")
    return np.frombuffer(data, "<f4").tolist()


#: Files that tell a project's kind, in order, with the endings it reads and the names it passes over.
PROJECTS = (
    (("tsconfig.json",), "typescript", (".ts", ".tsx", ".js", ".jsx", ".md", ".json", ".yaml", ".yml"), ("node_modules", ".git", "dist", "build", ".next", "coverage", "*.lock")),
    (("package.json",), "javascript", (".js", ".jsx", ".mjs", ".md", ".json", ".yaml", ".yml"), ("node_modules", ".git", "dist", "build", ".next", "coverage", "*.lock")),
    (("Cargo.toml",), "rust", (".rs", ".toml", ".md", ".txt"), ("target", ".git")),
    (("requirements.txt", "pyproject.toml", "setup.py"), "python", (".py", ".md", ".txt", ".yaml", ".yml", ".toml", ".cfg"), ("__pycache__", ".venv", "venv", ".git", "dist", "build", "*.egg-info")),
    (("go.mod",), "go", (".go", ".md", ".txt", ".yaml", ".yml"), ("vendor", ".git")),
    (("pom.xml", "build.gradle", "build.gradle.kts"), "java", (".java", ".kt", ".xml", ".md", ".yaml", ".yml", ".properties"), ("target", "build", ".gradle", ".idea", ".git")),
)
OTHER = ("generic", (".md", ".txt", ".json", ".yaml", ".yml", ".ts", ".js", ".py", ".rs", ".go"), ("node_modules", ".git", "dist", "build"))


def project_kind(names: set[str]) -> tuple[str, list[str], list[str]]:
    """Kind, endings and ignored names of a project by the files in its root."""
    for marks, kind, endings, ignored in PROJECTS:
        if names & set(marks) and (kind != "typescript" or "package.json" in names):
            return kind, list(endings), list(ignored)
    return OTHER[0], list(OTHER[1]), list(OTHER[2])
