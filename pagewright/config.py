"""Settings of the engine and how they are read from the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class EngineConfig:
    image_area_threshold: float = 0.3
    text_coverage_threshold: float = 0.05
    table_accuracy: float = 0.7
    min_confidence: float = 0.3
    reading_order_y_tolerance: float = 0.008
    table_overlap: float = 0.5
    line_tolerance: float = 3.0
    paragraph_gap: float = 0.03
    ocr_postprocess: bool = True
    ocr_clean: bool = True
    ocr_fix_errors: bool = True
    ocr_merge_words: bool = False
    ocr_min_line_length: int = 3
    ocr_batch_pages: int = 20
    embedding_batch: int = 32
    embedding_max_chars: int = 6000
    embedding_timeout_s: float = 120.0
    search_results: int = 10
    agent_max_iterations: int = 8
    agent_char_budget: int = 400_000
    agent_force_share: float = 0.10
    agent_temperature: float = 0.1
    agent_max_tokens: int = 4096
    worker_interval_s: float = 2.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "PAGEWRIGHT_") -> "EngineConfig":
        """Defaults, overridden by ``PAGEWRIGHT_<NAME>``; a value that doesn't parse is an error."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is not None and raw.strip():
                found[f.name] = _parse(raw.strip(), type(f.default))
        return replace(cls(), **found)


def _parse(raw: str, kind: type):
    if kind is bool:
        low = raw.lower()
        if low in ("1", "true", "yes", "on"):
            return True
        if low in ("0", "false", "no", "off"):
            return False
        raise ValueError(f"not a truth value: {raw!r}")
    return kind(raw)
