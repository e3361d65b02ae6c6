"""Weights, limits and vocabularies of selection, with a TOML overlay.

The values are fixed by the data contract that the engine's results must meet.
"""

from __future__ import annotations

import copy
import hashlib
import json
import tomllib
from pathlib import Path

# Fixed values.
DEFAULTS: dict = {
    "scoring": {"relevance": 0.50, "freshness": 0.0, "source_trust": 0.20, "quality": 0.30, "duplicate_penalty": 0.0, "risk_penalty": 0.0},
    "filters": {"min_width": 300, "min_height": 300, "min_pixels": 120000},
    "selection": {
        "min_images": 5,
        "max_images": 20,
        "per_item_max": 20,
        "minimum_score": 0.0,
        "type_limits": {
            "game_cg": 20, "gameplay_screenshot": 10, "key_visual": 1, "cover": 1, "character_art": 4, "announcement_art": 3, "goods": 10,
            "background_art": 20, "decorative": 0, "unknown": 0, "photo": 0, "logo": 0, "banner": 0, "ui": 0,
        },
    },
    "search": {"max_results": 5, "depth": 3, "max_candidates_per_source": 500, "page_budget": 16, "official_cap": 16},
    "image_types": {
        "minimum_type_confidence": 0.6, "auto_confidence": 0.8, "fallback_penalty": 0.25, "unknown_requires_review": True, "auto_select_unknown": False,
        "banner_aspect_ratio": 3.0, "character_aspect_ratio": 1.8, "scene_aspect_ratio": 1.15,
        "rejected": {
            "cg": ["cover", "goods", "logo", "banner", "ui", "photo", "character_art", "announcement_art"],
            "announcement": ["logo", "banner", "ui", "photo", "goods", "cover"],
            "goods": ["logo", "banner", "ui", "photo", "game_cg", "gameplay_screenshot", "key_visual", "character_art", "cover"],
            "release": ["logo", "banner", "ui", "goods", "photo"],
            "generic": ["logo", "banner", "ui"],
            "unknown": ["logo", "banner", "ui"],
        },
    },
    "video": {"max_height": 1080, "max_duration_seconds": 600, "max_file_bytes": 1073741824, "max_per_item": 3},
    "network": {"timeout_seconds": 12.0, "page_concurrency": 4, "image_concurrency": 8},
}

# How well an image type serves a requirement; others score DEFAULT_MATCH.
DEFAULT_MATCH = 0.25
TYPE_MATCH: dict[str, dict[str, float]] = {
    "cg": {"game_cg": 1.0, "gameplay_screenshot": 0.8, "key_visual": 0.4, "background_art": 0.6, "announcement_art": 0.25, "unknown": 0.1},
    "announcement": {"announcement_art": 1.0, "key_visual": 0.8, "game_cg": 0.35, "gameplay_screenshot": 0.25, "unknown": 0.1},
    "goods": {"goods": 1.0, "announcement_art": 0.7, "key_visual": 0.5, "game_cg": 0.25, "gameplay_screenshot": 0.2, "unknown": 0.1},
    "release": {"game_cg": 1.0, "gameplay_screenshot": 0.85, "key_visual": 0.65, "cover": 0.55, "background_art": 0.7, "unknown": 0.1},
    "generic": {"game_cg": 0.9, "gameplay_screenshot": 0.8, "announcement_art": 0.7, "key_visual": 0.6, "background_art": 0.7, "unknown": 0.1},
    "unknown": {"game_cg": 0.9, "gameplay_screenshot": 0.8, "announcement_art": 0.7, "key_visual": 0.6, "background_art": 0.7, "unknown": 0.1},
}


def overlay(base: dict, over: dict) -> dict:
    """Recursive merge: maps merge, everything else of `over` replaces."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = overlay(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load(path: str | Path | None = None) -> dict:
    if path is None:
        return copy.deepcopy(DEFAULTS)
    return overlay(DEFAULTS, tomllib.loads(Path(path).read_text(encoding="utf-8")))


def semantic_hash(config: dict) -> str:
    """Hash of what changes results: sections about speed alone are left out."""
    kept = {k: v for k, v in config.items() if k != "network"}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
