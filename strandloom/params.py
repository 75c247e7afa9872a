"""Parameters of the three commands, with their ranges."""

from __future__ import annotations

from dataclasses import dataclass

# Variant types as used by all graph operators.
SNP, SV, MOD, INDEL, REPEAT_INDEL = range(5)


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}], not {value}")


@dataclass(frozen=True)
class PhaseParams:
    ont: bool = True
    indels: bool = False
    indel_quality: float = 0.0
    mapping_quality: int = 1
    base_quality: int = 12
    low_weight: float = 0.1
    adjacent: int = 35
    distance: int = 300_000
    edge_threshold: float = 0.7
    overlap: float = 0.2
    sv_window: int = 20
    sv_threshold: float = 0.10
    read_confidence: float = 0.65
    snp_confidence: float = 0.75

    def __post_init__(self) -> None:
        for name in ("low_weight", "edge_threshold", "overlap", "sv_threshold", "read_confidence", "snp_confidence"):
            _within(name, getattr(self, name), 0, 1)
        for name in ("mapping_quality", "base_quality", "distance", "sv_window", "indel_quality"):
            _within(name, getattr(self, name), 0, 1 << 40)
        _within("adjacent", self.adjacent, 1, 1 << 20)


@dataclass(frozen=True)
class HaplotagParams:
    mapping_quality: int = 1
    percentage: float = 0.6
    sv_window: int = 20
    sv_threshold: float = 0.10
    tag_supplementary: bool = False
    region: str | None = None

    def __post_init__(self) -> None:
        _within("percentage", self.percentage, 0, 1)
        _within("sv_threshold", self.sv_threshold, 0, 1)


@dataclass(frozen=True)
class ModcallParams:
    modified: float = 0.8
    unmodified: float = 0.2
    heterozygous: float = 0.6
    noise: float = 0.2
    adjacent: int = 20
    confidence: float = 0.9
    rounds: int = 2
    all_sites: bool = False

    def __post_init__(self) -> None:
        for name in ("modified", "unmodified", "heterozygous", "noise", "confidence"):
            _within(name, getattr(self, name), 0, 1)
