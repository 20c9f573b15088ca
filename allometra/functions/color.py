"""Colour maps: stops on [0, 1] to 0xAARRGGBB, smooth or in steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Stops = Sequence[tuple[float, tuple[int, int, int]]]

# Plain colour ramps.
PALETTES: dict[str, Stops] = {
    "grey": [(0.0, (0, 0, 0)), (1.0, (255, 255, 255))],
    "blue_red": [(0.0, (0, 0, 255)), (0.5, (255, 255, 255)), (1.0, (255, 0, 0))],
    "traffic": [(0.0, (0, 128, 0)), (0.5, (255, 255, 0)), (1.0, (255, 0, 0))],
    "heat": [(0.0, (0, 0, 0)), (0.33, (255, 0, 0)), (0.66, (255, 255, 0)), (1.0, (255, 255, 255))],
}


def sample(value: Column, stops: Stops, steps: int = 0) -> Column:
    """Colour of a position as an int 0xRRGGBB, linear between stops and constant beyond them.

    With ``steps``, the range is cut into that many equal parts, each with the colour of its middle. Null stays null.
    """
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value.cast("double")))
    if steps:
        value = (F.least(F.floor(value * steps), F.lit(steps - 1)) + 0.5) / steps
    out = None
    for channel, weight in enumerate((65536, 256, 1)):
        level = F.lit(float(stops[-1][1][channel]))
        for (p0, c0), (p1, c1) in reversed(list(zip(stops, stops[1:], strict=False))):
            between = c0[channel] + (value - p0) * ((c1[channel] - c0[channel]) / (p1 - p0))
            level = F.when(value < p1, between).otherwise(level)
        level = F.when(value <= stops[0][0], F.lit(float(stops[0][1][channel]))).otherwise(level)
        part = F.floor(level + 0.5).cast("int") * weight
        out = part if out is None else out + part
    return out
