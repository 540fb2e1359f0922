"""Target transformations and their inverses as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.lookup import resolve


@dataclass(frozen=True)
class LogTarget:
    """``ln(y + shift)``."""

    shift: float

    def apply(self, y: Column) -> Column:
        return F.log(y + self.shift)

    def invert(self, z: Column) -> Column:
        return F.exp(z) - self.shift


@dataclass(frozen=True)
class PowerTarget:
    """``(y + shift) ^ (1 / power)``."""

    shift: float
    power: float

    def apply(self, y: Column) -> Column:
        return F.pow(y + self.shift, F.lit(1.0 / self.power))

    def invert(self, z: Column) -> Column:
        return F.pow(z, F.lit(float(self.power))) - self.shift


TRANSFORMERS = {"log": LogTarget, "power": PowerTarget}


def make_target_transform(name: str, params: dict):
    """Every parameter of a transformation must be given."""
    try:
        return resolve(name, TRANSFORMERS)(**params)
    except TypeError as missing:
        raise ValueError(f"target transformation {name!r}: {missing}") from None
