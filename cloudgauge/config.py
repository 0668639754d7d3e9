"""Parameters of a scoring run and the float32 constants that follow from them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_DEGREE = np.float32(np.pi / 180)


class SettingsError(ValueError):
    """All faults of the parameters at once, one a line."""


@dataclass(frozen=True)
class Settings:
    """Tolerances are sorted; equal ones stay apart, each with an index of its own.

    Negative tolerances are refused, which is stricter than the description asks for: their
    squares would not be ordered.
    """

    tolerances: tuple[float, ...]
    voxel_size: float = 0.01
    beam_start_radius: float = 0.5 * 0.00225
    beam_halfangle_degrees: float = 0.011

    def __post_init__(self):
        faults = []
        if not self.tolerances:
            faults.append("tolerances: at least one is needed")
        if any(not t >= 0 for t in self.tolerances):
            faults.append("tolerances: must be numbers that are not negative")
        if not self.voxel_size > 0:
            faults.append("voxel_size: must be above 0")
        if not self.beam_start_radius >= 0:
            faults.append("beam_start_radius: must not be negative")
        if not 0 <= self.beam_halfangle_degrees < 90:
            faults.append("beam_halfangle_degrees: must be from 0 to below 90")
        if faults:
            raise SettingsError("\n".join(faults))
        object.__setattr__(self, "tolerances", tuple(sorted(float(np.float32(t)) for t in self.tolerances)))

    @property
    def squared(self) -> tuple[float, ...]:
        """Squared tolerances, rounded to float32."""
        return tuple(float(np.float32(t) * np.float32(t)) for t in self.tolerances)

    @property
    def voxel_inverse(self) -> float:
        return float(np.float32(1.0 / float(np.float32(self.voxel_size))))

    @property
    def beam_start(self) -> float:
        return float(np.float32(self.beam_start_radius))

    @property
    def beam_tangent(self) -> float:
        return float(np.tan(np.float32(self.beam_halfangle_degrees) * _DEGREE))
