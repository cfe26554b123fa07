"""Settings of a study in one place, with the defaults that the reference's configuration states."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Study:
    """What detectors, cleaning and stages are run with."""

    gap_s: int = 3600
    merge_within_s: int = 300
    large: int = 100
    least_samples: int = 120
    least_kmh: float = 4.0
    noise: int = 5
    least_points: int = 7
    default_mode: str = "car"
    vote_rows: int = 2
    vote_rounds: int = 3
    clean_rows: int = 100
    clean_rounds: int = 3
    name: str = "study"
    window: dict = field(default_factory=lambda: {"window_s": 300, "step_s": 60, "threshold_km": 0.25})
    stop: dict = field(default_factory=lambda: {"ceps": 0.3, "eps": 0.1, "least": 10})


STUDY = Study()
