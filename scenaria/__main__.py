"""python -m scenaria MODEL.scw | --content TEXT [--mode consistent|basins|estimate|structure|transitions] [--samples N] [--radius R] [--world JSON] [--csv FILE]: a JSON report, and a table as CSV."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> str:
    from pyspark.sql import SparkSession

    from .sources.files import load_model, load_solutions, scenario_from_json
    from .sources.sinks import analyse, export_csv, to_json, write_text

    said = argparse.ArgumentParser(prog="scenaria", description=__doc__)
    said.add_argument("model", nargs="?", help="a file; or else give --content")
    said.add_argument("--content", help="the text of a model")
    said.add_argument("--mode", default="consistent")
    said.add_argument("--samples", type=int, default=1_000_000)
    said.add_argument("--radius", type=int, default=1)
    said.add_argument("--world", help="the current world of mode transitions: a JSON list or object of names or indices, or a signature")
    said.add_argument("--solutions", help="a solution file to take the kernel from")
    said.add_argument("--csv", help="a file for the table of mode basins, estimate or transitions")
    given = said.parse_args(argv)
    model = load_model(given.model, given.content)
    if given.solutions:
        model = model.with_kernel(load_solutions(given.solutions))
    world = None if given.world is None else scenario_from_json(model, given.world)
    spark = SparkSession.builder.getOrCreate()
    if given.csv:
        write_text(given.csv, export_csv(spark, model, given.mode, given.samples, given.radius, world))
    return to_json(analyse(spark, model, given.mode, given.samples, given.radius, world))


if __name__ == "__main__":
    print(main())
