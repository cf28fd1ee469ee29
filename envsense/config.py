"""Thresholds of the detectors. Fixed values, overridable by environment variables ENVSENSE_<NAME>, which are read when this module is."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    kalman_q: float = 1e-5
    kalman_r: float = 5e-2
    plain_r: float = 1e-2
    adapt_alpha: float = 0.1
    adapt_window: int = 10
    window: int = 100
    sigmas: float = 3.0
    min_samples: int = 10
    audio_peak: float = 0.8
    weight_magnetic: float = 0.4
    weight_audio: float = 0.4
    weight_humanoid: float = 0.2
    min_score: float = 0.6
    clip_before_s: int = 2
    clip_after_s: int = 3
    correlation_ms: int = 1000
    sample_rate: int = 44_100
    calibration_samples: int = 100
    gravity: float = 9.8
    rate_limit: int = 10

    @classmethod
    def from_env(cls, env=None) -> Settings:
        env = os.environ if env is None else env
        given = {f.name: type(f.default)(env[f"ENVSENSE_{f.name.upper()}"]) for f in fields(cls) if f"ENVSENSE_{f.name.upper()}" in env}
        return cls(**given)


DEFAULT = Settings.from_env()
