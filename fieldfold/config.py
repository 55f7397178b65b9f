"""Settings of the engine. The defaults are fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class DedupConfig:
    eps_m: float = 2.0
    min_samples: int = 1
    frame_exclusivity: bool = True
    split_gate_m: float | None = None
    drop_noise: bool = False
    frame_nms_m: float = 0.25
    adaptive: bool = True
    spacing_quantile: float = 0.10
    spacing_share: float = 0.45
    min_eps_m: float = 0.35

    def __post_init__(self):
        if self.eps_m <= 0 or self.min_samples < 1 or self.frame_nms_m < 0 or (self.split_gate_m is not None and self.split_gate_m <= 0):
            raise ValueError("eps_m and split_gate_m must be positive, min_samples at least 1, frame_nms_m not negative")
        if not (0 < self.spacing_share < 1 and 0 <= self.spacing_quantile <= 1 and self.min_eps_m > 0):
            raise ValueError("spacing_share must lie between 0 and 1, spacing_quantile from 0 to 1, min_eps_m must be positive")

    @property
    def gate(self) -> float:
        return self.eps_m if self.split_gate_m is None else self.split_gate_m


@dataclass(frozen=True)
class RegistrationConfig:
    iterations: int = 3
    min_matches: int = 3
    min_spread_m: float = 5.0
    max_shift_m: float = 5.0
    max_rotation_deg: float = 5.0
    max_scale: float = 0.1
    trim_m: float | None = None


@dataclass(frozen=True)
class SyncConfig:
    radius_m: float = 1.5
    bin_m: float = 0.08
    min_votes: int = 3
    huber_m: float = 0.15
    prior: float = 0.05
    rounds: int = 4


@dataclass(frozen=True)
class IngestOptions:
    width: int = 4000
    height: int = 3000
    fov_deg: float = 84.0
    fov_type: str = "diagonal"
    pitch_deg: float = -90.0
    altitude_m: float | None = None
    fps: float = 30.0
    anchor: str = "center"
    time_tolerance_s: float = 0.5
    derive_heading: bool = True

    def __post_init__(self):
        if self.fps <= 0 or self.time_tolerance_s < 0 or self.anchor not in ("center", "bottom"):
            raise ValueError("fps must be positive, the time tolerance not negative, anchor center or bottom")
