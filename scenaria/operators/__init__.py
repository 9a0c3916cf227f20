"""The engine's operators."""

from .basins import basins_frame, find_basins, merge_partials, partial_basins
from .estimate import estimate_basins, estimate_frame
from .forecast import forecast_basins
from .kernel import consistent_frame, find_consistent, kernel_frame
from .structure import influence_structure, product_basins, split
from .transitions import lever_frames, transition_graph

__all__ = ["basins_frame", "consistent_frame", "estimate_basins", "estimate_frame", "find_basins", "find_consistent", "forecast_basins", "influence_structure", "kernel_frame", "lever_frames", "merge_partials", "partial_basins", "product_basins", "split", "transition_graph"]
