"""Run parameters. Only an absent (None) value falls back to its default; an
explicit zero stays zero."""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass


class MissingKey(ValueError, KeyError):
    """A named key column is absent (both a value error and a key error)."""

    def __str__(self) -> str:
        return str(self.args[0]) if self.args else ""


@dataclass(frozen=True)
class TilingParams:
    tile_size: int = 512
    distance_weighting: bool = False
    erosion: bool = True
    surface_model: bool = False
    shrink_factor: float = 1.0
    codes: tuple[str, ...] = ("background", "building")

    def __post_init__(self):
        if self.tile_size <= 0:
            raise ValueError(f"TilingParams.tile_size is {self.tile_size}; tiles need at least one pixel a side.")

    @property
    def has_edge(self) -> bool:
        return "edge" in self.codes


@dataclass(frozen=True)
class SegmentationParams:
    """Thresholds of the clean-up and vectorisation chain. The defaults."""
    building_threshold: float = 0.3
    edge_threshold: float = 0.1
    min_building_size: int = 50
    max_hole_size: int = 50
    morph_kernel_size: int = 5
    min_building_area: float = 2.0
    max_building_area: float = 30000.0
    simplify_tolerance: float = 1.0
    buffer_distance: float = 0.2
    use_mbr: bool = True
    mbr_threshold: float = 0.85
    drop_largest: bool = False


@dataclass(frozen=True)
class TrainParams:
    seed: int = 2022
    test_size: float = 0.2
    epochs: int = 1
    architecture: str = "u-net"

    def __post_init__(self):
        if not isinstance(self.test_size, (int, float)) or not 0 <= self.test_size <= 1:
            raise ValueError(f"TrainParams.test_size is {self.test_size!r}; give the share of tiles to hold out, from 0 to 1.")
        if not isinstance(self.epochs, int) or isinstance(self.epochs, bool):
            raise ValueError(f"TrainParams.epochs is {self.epochs!r}; give a whole number.")
        if self.architecture.lower() not in ("u-net", "hrnet"):
            raise ValueError(f"TrainParams.architecture {self.architecture!r} is unknown here; known are u-net and hrnet.")


def fill(cls, values: dict | None):
    """Parameters from a (partial) dictionary; None means default, unknown names are ignored."""
    known = {f.name for f in dataclasses.fields(cls)}
    return cls(**{k: tuple(v) if isinstance(v, list) else v
                  for k, v in (values or {}).items() if k in known and v is not None})


def require_column(df, key: str):
    """The key column must exist; the message names the ones that do."""
    if key not in df.columns:
        raise MissingKey(f"Key column '{key}' is missing; the table has {', '.join(df.columns)}.")
    return df
