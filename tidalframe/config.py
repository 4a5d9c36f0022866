"""Default options of the operators, grouped as callers override them."""

from __future__ import annotations

from typing import Any

#: The defaults that results are compared under.
DEFAULTS: dict[str, dict[str, Any]] = {
    "agc": {"target_rms": 0.08, "max_gain": 8.0, "limiter": 0.99, "fade_ms": 20.0},
    "spectral": {"fft": 2048, "hop": 512, "n_mels": 64, "dynamic_range": 80.0, "fmin": 0.0, "fmax": None, "log": True},
    "trim": {"threshold": 0.01, "chunk_ms": 10.0, "min_non_silence_ms": 50.0, "padding_ms": 10.0, "pre_roll_fraction": 0.0, "post_roll_fraction": 0.0, "pre_roll_ms": 0.0, "post_roll_ms": 0.0},
    "segment": {"silence_ratio": 0.12, "smoothing": 3, "min_silence": 5, "min_speech": 3},
    "prep": {"per_recording": 800, "total": 20_000, "context": 0, "clamp": 1000.0, "min_rms": 0.002, "mel_ratio": 0.02, "rms_ratio": 0.05, "keep_silence": 0.0, "zscore": "all"},
    "pca": {"k": 8, "batch_below": 30, "enough_rows": 200, "degenerate_norm": 1e-6, "min_frames": 4},
    "online_kmeans": {"k": 3, "dims": 2, "epochs": 3, "preview": 2000},
    "sweep": {"k_min": 2, "k_max": 8, "n_init": 5, "max_iter": 200, "tol": 1e-4, "silhouette_sample": 1500, "db_sample": 2000},
    "overlay": {"window_sec": 2.0},
}


def options(section: str, **overrides: Any) -> dict[str, Any]:
    """A section's defaults with overrides; None means the default, and 0 means 0."""
    known = DEFAULTS[section]
    if unknown := set(overrides) - set(known):
        raise ValueError(f"no such option in {section}: {sorted(unknown)}")
    return known | {k: v for k, v in overrides.items() if v is not None}


def merged(*layers: dict[str, dict[str, Any]]) -> dict[str, dict[str, Any]]:
    """Layers of sections; within a section the later layer's keys win."""
    out: dict[str, dict[str, Any]] = {}
    for layer in layers:
        for section, values in layer.items():
            out[section] = out.get(section, {}) | values
    return out
