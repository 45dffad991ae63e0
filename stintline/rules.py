"""Season rules and model constants."""

from __future__ import annotations

from dataclasses import dataclass, field

# Points by finishing position.
RACE_POINTS = {1: 25, 2: 18, 3: 15, 4: 12, 5: 10, 6: 8, 7: 6, 8: 4, 9: 2, 10: 1}
SPRINT_POINTS = {1: 8, 2: 7, 3: 6, 4: 5, 5: 4, 6: 3, 7: 2, 8: 1}
# Power-unit elements and gearbox, units allowed by season, mean life in laps.
COMPONENTS = ["ICE", "TC", "EX", "MGU_K", "ES", "CE", "GB"]
ALLOCATIONS = {
    2026: {"ICE": 4, "TC": 4, "EX": 4, "MGU_K": 3, "ES": 3, "CE": 3, "MGU_H": 0, "GB": 4},
    2027: {"ICE": 3, "TC": 3, "EX": 3, "MGU_K": 2, "ES": 2, "CE": 2, "MGU_H": 0, "GB": 4},
}
COMPONENT_LIVES = {"ICE": 450.0, "TC": 450.0, "EX": 450.0, "MGU_K": 500.0, "ES": 600.0, "CE": 700.0, "GB": 400.0}
DEFAULT_LIFE = 450.0
# Words of a retirement's cause. A status that names both kinds is mechanical.
MECHANICAL = (
    "engine", "gearbox", "hydraulics", "power unit", "turbo", "turbocharger", "brakes", "suspension", "wheel", "driveshaft",
    "differential", "electrical", "electronics", "cooling", "oil leak", "water leak", "fuel system", "clutch", "transmission",
    "exhaust", "overheating", "mechanical", "power loss", "fire", "oil pressure", "water pressure", "fuel pressure", "battery",
    "energy store", "vibrations", "technical",
)
INCIDENT = (
    "collision", "accident", "spun off", "spin", "crash", "debris", "collision damage", "damage", "track limits",
    "safety concerns", "contact", "out of fuel",
)
# Beta priors (alpha, beta) of retirement rates.
PRIORS = {"mechanical": (1.2, 13.8), "incident": (0.8, 14.2), "total": (2.0, 13.0)}
# Sessions of a weekend by format, and the session whose laps give race pace.
SESSIONS = {"conventional": ("FP1", "FP2", "FP3", "Q", "R"), "sprint": ("FP1", "SQ", "S", "Q", "R")}
PACE_SESSION = {"conventional": "FP2", "sprint": "FP1"}


# Defaults of the season's rules and models.
@dataclass(frozen=True)
class PaceRules:
    min_lap_s: float = 60.0
    min_long_run_laps: int = 5
    fuel_kg_per_lap: float = 1.6
    seconds_per_kg: float = 0.035
    iqr_factor: float = 3.0
    trim_quantile: float = 0.90
    sprint_min_laps: int = 3
    suspect_long_run_s: float = 3.0
    suspect_quali_s: float = 1.5


@dataclass(frozen=True)
class StrengthRules:
    quali_outlier_s: float = 5.0
    long_run_outlier_s: float = 10.0
    min_sd: float = 0.01
    wide_sd: float = 2.0
    grid_scale: float = 0.15


@dataclass(frozen=True)
class PenaltyRules:
    first: int = 10
    further: int = 5
    pit_lane_over: int = 15
    laps_per_race: float = 58.0


@dataclass(frozen=True)
class ChaosRules:
    safety_car: float = 0.55
    rain: float = 0.10
    safety_car_noise: float = 1.35
    rain_noise: float = 1.25
    rain_compression: float = 0.65
    extra_dnf: float = 0.02


@dataclass(frozen=True)
class SimulationRules:
    n_sims: int = 30_000
    seed: int = 42
    noise: float = 0.5
    grid_weight: float = 0.02
    pit_lane_extra: float = 0.5
    development_sd: float = 0.4
    default_dnf: float = 0.08
    unknown_sd: float = 2.0
    max_points_per_round: int = 33
    max_entrants: int = 30
    chaos: ChaosRules = field(default_factory=ChaosRules)

    def __post_init__(self) -> None:
        if self.n_sims < 1000:
            raise ValueError("n_sims must be 1000 or more")
        if min(self.noise, self.development_sd) < 0:
            raise ValueError("standard deviations must not be negative")


PACE, STRENGTH, PENALTY, SIMULATION = PaceRules(), StrengthRules(), PenaltyRules(), SimulationRules()
