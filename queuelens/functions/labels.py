"""Label transforms around the regressor."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_CLIP = 7200.0


def clip(y: Column, clip_target: float | None) -> Column:
    """``min(y, clip)``; identity when clip is None."""
    return y if clip_target is None else F.least(y, F.lit(float(clip_target)))


def to_training_label(y: Column, clip_target: float | None, log1p_target: bool) -> Column:
    """Clip, then optionally ``log1p``: the label the model is fit on."""
    out = clip(y, clip_target)
    return F.log1p(out) if log1p_target else out


def to_seconds(raw: Column, clip_target: float | None, log1p_target: bool,
               floor_zero: bool) -> Column:
    """Map a raw model output back to seconds.

    log1p models: cap at ``log1p(clip)`` and ``expm1``; then cap at clip.
    The evaluator also floors at 0 (``floor_zero``); training-time metrics do not.
    """
    out = raw
    if log1p_target:
        if clip_target is not None:
            out = F.least(out, F.lit(math.log1p(clip_target)))
        out = F.expm1(out)
    out = clip(out, clip_target)
    if floor_zero:
        out = F.greatest(out, F.lit(0.0))
    return out
