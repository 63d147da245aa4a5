"""Engine settings: defaults, YAML, environment. Inventory 11, 14, 181."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from typing import Any

from corvine.operators.bm25 import Bm25
from corvine.operators.chunking import ChunkRules


class ConfigError(ValueError):
    """Settings cannot be read."""


@dataclass(frozen=True)
class RetrievalSettings:
    mode: str = "hybrid"
    dense_top_k: int = 40
    sparse_top_k: int = 40
    top_k: int = 12
    rrf_k: int = 60
    weights: Mapping[str, float] = field(default_factory=lambda: {"dense": 1.0, "sparse": 1.0})
    score_threshold: float = 0.0


@dataclass(frozen=True)
class RerankSettings:
    kind: str = "off"
    input_top_k: int = 40
    top_k: int = 6
    fail_open: bool = True


@dataclass(frozen=True)
class PromptSettings:
    max_blocks: int = 8
    max_tokens: int = 6000
    heading_in_prompt: bool = True
    require_citation: bool = True
    refuse_without_evidence: bool = True
    sentences: int = 2


@dataclass(frozen=True)
class Settings:
    chunking: ChunkRules = field(default_factory=ChunkRules)
    bm25: Bm25 = field(default_factory=Bm25)
    retrieval: RetrievalSettings = field(default_factory=RetrievalSettings)
    rerank: RerankSettings = field(default_factory=RerankSettings)
    prompt: PromptSettings = field(default_factory=PromptSettings)
    embedder: str = "hash"
    dim: int = 32
    api_key: str | None = None

    def safe_dump(self) -> dict[str, Any]:
        """All values, with secrets masked."""
        def plain(x: Any) -> Any:
            return {f.name: plain(getattr(x, f.name)) for f in fields(x)} if is_dataclass(x) else x

        return plain(self) | {"api_key": "***" if self.api_key else None}


def _merged(base: Any, raw: Mapping[str, Any]) -> Any:
    """Unknown keys are ignored; nested sections are merged."""
    known = {f.name for f in fields(base)}
    use = {}
    for k, v in raw.items():
        if k in known:
            old = getattr(base, k)
            use[k] = _merged(old, v) if is_dataclass(old) and isinstance(v, Mapping) else tuple(v) if isinstance(v, list) else v
    return replace(base, **use)


def load_settings(path: str | None = None, env: Mapping[str, str] | None = None) -> Settings:
    """Defaults, then the file (a missing one changes nothing), then CORVINE_<SECTION>__<NAME> variables."""
    out = Settings()
    if path and os.path.exists(path):
        try:
            import yaml

            raw = yaml.safe_load(open(path, encoding="utf-8")) or {}  # noqa: SIM115
        except ImportError:
            import json

            raw = json.load(open(path, encoding="utf-8"))  # noqa: SIM115
        except Exception as e:
            raise ConfigError(f"{path} cannot be read: {e}") from e
        if not isinstance(raw, Mapping):
            raise ConfigError(f"{path} does not hold a mapping")
        out = _merged(out, raw)
    for name, value in (os.environ if env is None else env).items():
        if name.startswith("CORVINE_"):
            section, _, key = name.removeprefix("CORVINE_").lower().partition("__")
            target = getattr(out, section, None)
            if key and is_dataclass(target) and key in {f.name for f in fields(target)}:
                out = replace(out, **{section: replace(target, **{key: type(getattr(target, key))(value)})})
            elif not key and section in {f.name for f in fields(out)} and not is_dataclass(target):
                out = replace(out, **{section: int(value) if isinstance(target, int) else value})
    return out
