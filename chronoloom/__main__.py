"""python -m chronoloom --edges FILE --kind csv|lines|parquet --root DIR --phase prepare,predict

``--config`` names a JSON file of session settings (mode, model, parts, snaps, ...); settings
given on the command line come before those of the file."""

from __future__ import annotations

import argparse
import json
from typing import Any

from pyspark.sql import SparkSession

from chronoloom.plans.session import Session, load_edges


def settings(spark: SparkSession, path: str | None, **given: Any) -> dict[str, Any]:
    """Settings of a JSON file, which any file system of Spark can hold, with those that
    were given in their place."""
    found = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return {**found, **{k: v for k, v in given.items() if v is not None}}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="chronoloom")
    p.add_argument("--edges", required=True)
    p.add_argument("--kind", default="csv")
    p.add_argument("--root", required=True)
    p.add_argument("--phase", default="all")
    p.add_argument("--config")
    p.add_argument("--mode")
    p.add_argument("--model")
    p.add_argument("--split", default="test")
    p.add_argument("--batch-size", type=int)
    p.add_argument("--epochs", type=int)
    p.add_argument("--checkpoint")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("chronoloom").getOrCreate()
    phases = {"prepare", "train", "predict"} if a.phase == "all" else set(a.phase.split(","))
    session = Session.from_config(spark, settings(spark, a.config, mode=a.mode, model=a.model, batch_size=a.batch_size, epochs=a.epochs), load_edges(spark, a.edges, a.kind), a.root)
    if "prepare" in phases:
        print(session.prepare_data())
    if phases & {"train", "predict"}:
        session.build_runtime()
    if "train" in phases:
        session.run_task().show()
        if a.checkpoint:
            session.save_checkpoint(a.checkpoint)
    elif a.checkpoint:
        session.load_checkpoint(a.checkpoint)
    if "predict" in phases:
        session.predict(a.split).show()


if __name__ == "__main__":
    main()
