from queuelens.functions.time import (
    minute_bucket, day_index, hour_index, minute_index, seconds_between,
)
from queuelens.functions.split import hash_bucket, split_label
from queuelens.functions.labels import clip, to_training_label, to_seconds
from queuelens.functions.binning import bin_index, bin_edges

__all__ = [
    "minute_bucket", "day_index", "hour_index", "minute_index", "seconds_between",
    "hash_bucket", "split_label", "clip", "to_training_label", "to_seconds",
    "bin_index", "bin_edges",
]
