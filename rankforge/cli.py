"""Command line: python -m rankforge.cli COMMAND ... Errors exit with 1 and a suggestion."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession


COMMANDS: dict[str, list[str]] = {
    "ingest": ["source", "output_path"], "preprocess": ["source", "output_path"], "chunk": ["source", "output_path"],
    "embed": ["corpus_path", "output_path"], "index": ["corpus_path", "index_path"], "retrieve": ["query", "index_path", "top_k"], "search": ["query", "index_path", "top_k"],
    **{n: ["corpus_path", "dataset_path", "experiment_directory", "notes"] for n in ("evaluate", "benchmark")},
    **{n: ["corpus_path", "dataset_path", "experiment_directory", "notes", "parameters_path"] for n in ("sweep", "grid-search")},
    "optuna-search": ["corpus_path", "dataset_path", "experiment_directory", "notes", "search_space_path", "trials", "objective", "seed"],
    "experiments": ["experiment_directory"], "history": ["experiment_directory"], "recommend": ["experiment_directory"], "visualize": ["experiment_directory"],
    "compare": ["experiment_directory", "experiment_ids"], "report": ["experiment_directory", "experiment_ids"], "leaderboard": ["experiment_directory", "sort_by"],
}
METHODS = {"search": "retrieve", "benchmark": "evaluate", "sweep": "benchmark", "grid-search": "benchmark", "optuna-search": "search", "recommend": "recommendation", "visualize": "visualizations", "report": "reports"}
REQUIRED = {"source", "corpus_path", "query", "parameters_path", "search_space_path"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rankforge")
    commands = top.add_subparsers(dest="command", required=True)
    for name, options in COMMANDS.items():
        p = commands.add_parser(name)
        p.add_argument("--config", dest="config_path")
        for o in options:
            kind = int if o in ("top_k", "trials", "seed") else str
            if o == "source":
                p.add_argument(o)
            else:
                p.add_argument("--" + o.replace("_", "-"), type=kind, required=o in REQUIRED)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from rankforge.service import Service

    given = {k: v for k, v in vars(parser().parse_args(argv)).items() if v is not None}
    command = given.pop("command")
    if "experiment_ids" in given:
        given["experiment_ids"] = [i.strip() for i in given["experiment_ids"].split(",") if i.strip()]
    if command in ("sweep", "grid-search"):
        given["mode"] = command.replace("-", "_")
    service = Service(spark or SparkSession.builder.appName("rankforge").getOrCreate())
    try:
        out = getattr(service, METHODS.get(command, command))(given)
    except (FileNotFoundError, RuntimeError, ValueError, KeyError) as e:
        print(f"error: {e}\nsuggestion: check the paths, the configuration and `rankforge {command} --help`", file=sys.stderr)
        return 1
    if command in ("retrieve", "search"):
        rows, scores = out["results"], [r["score"] for r in out["results"]]
        for r in rows:
            print(f"{r['rank']:>3}  {r['score']:.4f}  {r['chunk_id']}  {' '.join(r['text'].split())[:160]}")
        if scores:
            print(f"best {max(scores):.4f}, worst {min(scores):.4f}, mean {sum(scores) / len(scores):.4f}")
    else:
        print(json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
