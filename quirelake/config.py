"""Parameters: defaults, deep merge with a file and overrides, and env files."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any

DEFAULTS: dict[str, Any] = {
    "quality": {"min_chars": 100, "min_words": 6, "min_alpha": 0.45, "max_weird": 0.25, "max_duplicate": 0.40},
    "images": {"tiny": 0.02, "mostly": 0.70},
    "chunking": {"max_tokens": 220, "hard_max_tokens": 320, "min_tokens": 80, "overlap_tokens": 40, "semantic_cut": 0.72, "semantic_min_sentences": 3, "semantic": False},
    "retrieval": {"candidate_k": 20, "prescription_candidate_k": 30, "top_k": 5, "prescription_rerank_k": 20, "anchors": 5},
    "fusion": {"rrf_k": 60, "semantic_weight": 1.0, "keyword_weight": 1.0, "section": 0.25, "medication": 0.20, "affinity": 0.35, "phrase": 0.35, "boilerplate": 0.20, "text_match": 0.55, "co_up": 0.80, "co_down": 0.30, "blend": 0.35},
    "bm25": {"k1": 1.5, "b": 0.75},
    "review": {"block": 0.70, "handwritten": 0.72},
    "audit": {"enabled": True, "required": False, "page_size": 25},
}


def merge(base: dict, over: dict | None) -> dict:
    """A new dict: values of `over` win, dicts are merged level by level; neither argument is changed."""
    out = {k: merge(v, None) if isinstance(v, dict) else v for k, v in base.items()}
    for k, v in (over or {}).items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(path: str | os.PathLike | None = None, over: dict | None = None) -> dict:
    """Defaults, a JSON file and overrides, in this order; a missing file is an error, an empty one is not."""
    text = Path(path).read_text() if path else ""
    return merge(merge(DEFAULTS, json.loads(text) if text.strip() else None), over)


def load_env(path: str | os.PathLike) -> list[str]:
    """Sets the NAME=value lines of a file that the environment lacks; returns the names that were set. No file, no change."""
    done = []
    file = Path(path)
    for line in file.read_text().splitlines() if file.exists() else ():
        name, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and name.strip() and not name.startswith("#") and name.strip() not in os.environ:
            os.environ[name.strip()] = value.strip().strip("'\"")
            done.append(name.strip())
    return done
