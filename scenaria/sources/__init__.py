"""Model files, solution files, partial results and sinks."""

from .files import expand_paths, load_from_text, load_scw, load_solutions, parse_scw, parse_solutions, to_scw
from .frames import descriptors_frame, impacts_frame, model_from_frames, variants_frame

__all__ = ["descriptors_frame", "expand_paths", "impacts_frame", "load_from_text", "load_scw", "load_solutions", "model_from_frames", "parse_scw", "parse_solutions", "to_scw", "variants_frame"]
