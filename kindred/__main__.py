"""python -m kindred STEP --root FOLDER --train S1 S2 S3 --truth FILE [--test S1 S2 S3] ..: one step of the linkage path."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.model import TrainConfig
from .plans.linkage import FEATURES, Linkage

STEPS = ("ingest", "train", "choose", "calibrate", "reselect", "audit", "export", "validate")


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="kindred", description=__doc__)
    p.add_argument("step", choices=STEPS)
    p.add_argument("--root", required=True)
    p.add_argument("--train", nargs=3, required=True)
    p.add_argument("--truth", required=True)
    p.add_argument("--test", nargs=3)
    p.add_argument("--drop", default="", help="features to leave out, with commas")
    p.add_argument("--rounds", type=int, default=TrainConfig.rounds)
    p.add_argument("--depth", type=int, default=TrainConfig.depth)
    p.add_argument("--least", type=int, default=TrainConfig.least, help="rows in a leaf at least")
    p.add_argument("--role", default="A2")
    p.add_argument("--scale", type=float, default=1.0)
    p.add_argument("--update", action="store_true", help="reselect: change the release")
    p.add_argument("--output", help="export, validate: the folder of the result files")
    p.add_argument("--taus", type=json.loads, help='thresholds of some countries, as {"France": 0.8}')
    a = p.parse_args(args)
    lost = {x for x in a.drop.split(",") if x}
    if lost - set(FEATURES):
        p.error(f"unknown features {sorted(lost - set(FEATURES))}")
    spark = SparkSession.builder.getOrCreate()
    link = Linkage(spark, a.root, tuple(a.train), a.truth, tuple(a.test) if a.test else None, config=TrainConfig(rounds=a.rounds, depth=a.depth, least=a.least), features=[f for f in FEATURES if f not in lost])
    steps = {
        "ingest": lambda: {part: link.ingest(part) for part in ("train", *(["test"] if a.test else []))}, "train": link.train_models, "choose": link.choose, "calibrate": link.calibrate,
        "reselect": lambda: link.reselect(a.scale, a.update), "audit": lambda: link.audit(a.role, a.scale), "export": lambda: link.export(a.output, a.taus), "validate": lambda: link.validate(a.output),
    }
    out = steps[a.step]()
    print(json.dumps(out, indent=2, default=str))
    return out


if __name__ == "__main__":
    main()
