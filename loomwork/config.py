"""Parameters of the analyses, with the defaults that reports and filters use."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    seed: int = 42
    val_fraction: float = 0.10
    sample_size: int = 50
    smoke_size: int = 20
    sample_mode: str = "task_balanced"
    gate: float = 0.95
    pilot_rows: int = 100
    numeric_rel_tol: float = 1e-3
    numeric_abs_tol: float = 1e-6
    min_quality: float = 0.5
    max_words: int = 400
    downweight: float = 0.5
    default_max_new_tokens: int = 512
    workers: int = 15
    prices_per_million: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        """From a parsed configuration file; unknown keys are refused by name."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**values)

    def to_dict(self) -> dict:
        return asdict(self)
