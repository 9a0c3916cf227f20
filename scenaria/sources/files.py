"""The text formats: models (.scw) and solution lists (.sl)."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterable, Mapping, Sequence

import numpy as np

from ..model import Model


def parse_scw(text: str) -> Model:
    """A model from text: `&descriptor` and `-variant` lines, and after the fifth `#` the matrix, up to the next one."""
    descriptors: list[str] = []
    variants: list[list[str]] = []
    rows: list[list[int]] = []
    marks = 0
    for line in map(str.strip, text.splitlines()):
        if line.startswith("#"):
            marks += 1
            if marks > 5:
                break
        elif not line:
            continue
        elif marks == 0 and line[0] == "&":
            descriptors.append(line[1:].strip())
            variants.append([])
        elif marks == 0 and line[0] == "-" and variants:
            variants[-1].append(line[1:].strip())
        elif marks == 5:
            rows.append([int(x) for x in line.split(",")])
    n = sum(map(len, variants))
    if not n:
        raise ValueError("no variants: this is not a model file")
    if len(set(descriptors)) < len(descriptors):
        raise ValueError("two descriptors have the same name")
    if len(rows) != n:
        raise ValueError(f"the matrix has {len(rows)} rows, but there are {n} variants")
    for k, row in enumerate(rows):
        if len(row) != n:
            raise ValueError(f"row {k + 1} of the matrix has {len(row)} numbers, but there are {n} variants")
    return Model(tuple(descriptors), tuple(map(tuple, variants)), np.array(rows))


def parse_solutions(text: str) -> list[tuple[int, ...]]:
    """Scenarios (0-based) of a solution list: the first quoted field of each line that starts with a quote."""
    found = []
    for line in text.splitlines():
        if line.startswith('"'):
            found.append(tuple(int(x) - 1 for x in line[1 : line.index('"', 1)].split()))
    return found


def to_scw(model: Model, name: str = "model.scw") -> str:
    lines = ["$ ScenarioWizard 4.0", name]
    for d, vs in zip(model.descriptors, model.variants, strict=True):
        lines += [f"&{d}", *(f" -{v}" for v in vs)]
    lines += ["#"] * 5
    lines += [",".join(map(str, row)) for row in model.matrix.tolist()]
    return "\n".join([*lines, "#", ""])


def load_from_text(text: str) -> Model:
    """Parse only; no kernel is searched."""
    return parse_scw(text)


def load_scw(path: str, sl_file: str | None = None, kernel: Iterable[Sequence[int]] | None = None, spark=None, algorithm: str = "auto") -> Model:
    """A model with its kernel: the one given, else that of sl_file, else searched for if a session is given.

    kernel=[] only parses.
    """
    with open(path, encoding="utf-8", errors="replace") as f:
        model = parse_scw(f.read())
    if kernel is not None:
        return model.with_kernel(kernel)
    if sl_file is not None:
        return model.with_kernel(load_solutions(sl_file))
    if spark is not None:
        from ..operators.kernel import find_consistent

        return model.with_kernel(find_consistent(spark, model, algorithm=algorithm))
    return model


def load_model(file_path: str | None, scw_content: str | None) -> Model:
    """From exactly one of a path and a text; no kernel is searched."""
    if (file_path is None) == (scw_content is None):
        raise ValueError("give either a file or its content")
    return load_from_text(scw_content) if file_path is None else load_scw(file_path, kernel=[]).with_kernel(None)


# -- JSON ------------------------------------------------------------------------


def _read(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise ValueError(f"this is no JSON: {e}") from e


def model_to_json(model: Model) -> str:
    return json.dumps({"descriptors": [{"name": d, "variants": list(v)} for d, v in zip(model.descriptors, model.variants, strict=True)], "matrix": model.matrix.tolist(), "kernel": model.kernel}, ensure_ascii=False)


def model_from_json(text: str) -> Model:
    """descriptors (each with name and variants), matrix, and perhaps kernel."""
    said = _read(text)
    if not isinstance(said, dict) or not {"descriptors", "matrix"} <= said.keys():
        raise ValueError("a model in JSON has descriptors and a matrix")
    model = Model(tuple(d["name"] for d in said["descriptors"]), tuple(tuple(d["variants"]) for d in said["descriptors"]), np.array(said["matrix"]))
    kernel = said.get("kernel")
    return model if kernel is None else model.with_kernel([model.check(u) for u in kernel])


def signature_from(said: object) -> int:
    """A signature as services write it: a number, or beyond 2^53 its decimal digits in a string."""
    if isinstance(said, str) and said.isdecimal() and said.isascii():
        return int(said)
    if isinstance(said, int) and not isinstance(said, bool) and said >= 0:
        return said
    raise ValueError(f"{said!r} is no signature")


def scenario_from_json(model: Model, text: str) -> tuple[int, ...]:
    """Digits of a list or an object of names and indices, or of a signature."""
    said = _read(text)
    return model.resolve(said) if isinstance(said, (list, Mapping)) else model.inv_signature(signature_from(said))


def load_solutions(path: str) -> list[tuple[int, ...]]:
    with open(path, encoding="utf-8", errors="replace") as f:
        return parse_solutions(f.read())


def expand_paths(paths: str | Iterable[str]) -> list[str]:
    """A folder, a pattern, one file or several of them, as a sorted list of files."""
    if isinstance(paths, (str, os.PathLike)):
        p = os.fspath(paths)
        return sorted(glob.glob(os.path.join(p, "*.scw"))) if os.path.isdir(p) else sorted(glob.glob(p)) or [p]
    return [x for p in paths for x in expand_paths(p)]
