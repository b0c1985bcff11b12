"""Column expressions; all of them stay inside the JVM."""

from tripwise.functions.choice import draw_index, draw_option, softmax_array, softmax_by_group
from tripwise.functions.draws import hash_int, hash_uniform, hash_word
from tripwise.functions.geo import bbox_overlap, extent, haversine_km, in_bbox
from tripwise.functions.numeric import (
    clamp, half_even_round, let, minmax_by_group, minmax_value, normal_cdf, normal_pdf, sigmoid,
)
from tripwise.functions.polyline import cumulative_km, downsample, keyframe_position, position_at_fraction
from tripwise.functions.text import (
    coerce_unit_interval, day_minutes_label, first_nonempty, jaccard, normalize_score, normalize_tokens, strip_blank,
)

__all__ = [name for name in dir() if not name.startswith("_")]
