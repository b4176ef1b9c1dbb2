"""Command line: validate-config and inspect-data work; the others name the input that they miss and fail."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

import yaml

from headwater.sources import config_files, inventory

# Loggers held at WARNING.
QUIET = ("urllib3", "httpcore", "httpx")
MISSING = {
    "build-graph": "build-graph needs processed road-network data; ingest it first",
    "run-analysis": "run-analysis needs the processed data layer and a built graph",
    "run-experiment": "run-experiment needs ingested data, a built graph and the analysis results",
}


def configure_logging(level: str = "INFO") -> None:
    """Root logger to stderr. An unknown level name raises AttributeError."""
    logging.basicConfig(level=getattr(logging, level), format="%(asctime)s %(levelname)-8s %(name)s %(message)s", datefmt="%Y-%m-%dT%H:%M:%S", stream=sys.stderr)
    for name in QUIET:
        logging.getLogger(name).setLevel(logging.WARNING)


def _fail(text: str) -> int:
    print(f"ERROR: {text}", file=sys.stderr)
    return 1


def validate_config(configs_dir: Path) -> int:
    if not configs_dir.is_dir():
        return _fail(f"configs directory not found: {configs_dir}")
    try:
        docs = config_files.load_all(configs_dir)
    except FileNotFoundError as e:
        return _fail(f"missing config file: {e}")
    except (config_files.ConfigInvalid, yaml.YAMLError) as e:
        return _fail(f"config validation failed:\n{e}")
    print("All configuration files are valid.")
    print("  " + "  ".join(f"{k}={len(docs[k][k])}" for k in ("scenarios", "experiments", "shelters")))
    return 0


def inspect_data(data_dir: Path, spark=None) -> int:
    if not data_dir.is_dir():
        return _fail(f"data directory not found: {data_dir}")
    if spark is None:
        from headwater.session import build_session

        spark = build_session("local[2]", 2)
    per = inventory.counts(inventory.listing(spark, data_dir))
    rows = {r["directory"]: r for r in per.collect()}  # four rows
    for name in inventory.SUBDIRECTORIES:
        print(f"  {name}/: {rows[name]['n']} file(s)" if rows[name]["present"] else f"  {name}/: directory missing")
    print(f"  manifests/: {rows['manifests']['n']} manifest(s)")
    if inventory.all_empty(per).first()["all_empty"]:
        print("\nNo case-study data has been ingested yet.")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="headwater")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("validate-config", "inspect-data", *MISSING):
        p = sub.add_parser(name)
        p.add_argument("--log-level", default="INFO")
        if name == "validate-config":
            p.add_argument("--configs-dir", "-c", type=Path, default=Path(__file__).resolve().parents[1] / "configs")
        elif name == "inspect-data":
            p.add_argument("--data-dir", "-d", type=Path, default=Path("data"))
        elif name == "run-experiment":
            p.add_argument("experiment_id", nargs="?")
    args = parser.parse_args(argv)
    configure_logging(args.log_level)
    if args.command == "validate-config":
        return validate_config(args.configs_dir)
    if args.command == "inspect-data":
        return inspect_data(args.data_dir)
    logging.getLogger("headwater.cli").warning("%s called without its inputs", args.command)
    return _fail(MISSING[args.command])


if __name__ == "__main__":
    sys.exit(main())
