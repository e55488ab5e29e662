"""Run one stage from the command line.

    spark-submit --py-files pairloom.zip -m pairloom prompts --settings mapping.json --root . --work out --run 2025-01-01
    python -m pairloom mappings   --settings mapping.json --responses answers.parquet --model m --work out --run 2025-01-01
    python -m pairloom template   --settings evaluation.json --work out --run 2025-01-01
    python -m pairloom execution  --settings evaluation.json --databases dbs --work out --run 2025-01-01
    python -m pairloom ratings    --settings evaluation.json --schemas schemas.json --work out --run 2025-01-01
    python -m pairloom semantic   --settings evaluation.json --responses judged.parquet --work out --run 2025-01-01
"""

from __future__ import annotations

import argparse
import json

from pairloom.functions.vocabulary import QUERY_SECONDS
from pairloom.operators.workload import catalog_per_target, tables_below
from pairloom.plans import jobs
from pairloom.session import build_session
from pairloom.sources import files


def arguments() -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="pairloom")
    parser.add_argument("stage", choices=["prompts", "mappings", "template", "execution", "ratings", "semantic"])
    parser.add_argument("--settings", required=True, help="settings file")
    parser.add_argument("--work", required=True, help="folder of the tables")
    parser.add_argument("--root", default=".", help="folder the data sets' paths start from")
    parser.add_argument("--run", required=True, help="name of the run, such as its start time; the same for all its stages")
    parser.add_argument("--model", default="model")
    parser.add_argument("--responses", help="parquet table of answers")
    parser.add_argument("--mappings", help="folder of response_<source>.json files, instead of the table of pairs")
    parser.add_argument("--databases", help="folder <target>/<table>.parquet")
    parser.add_argument("--schemas", help="schemas.json of the targets")
    parser.add_argument("--parallel", type=int, default=8, help="queries at a time")
    parser.add_argument("--seconds", type=float, default=QUERY_SECONDS, help="time limit of a query")
    parser.add_argument("--shard", default="0/1", help="which part of the queries this application runs, such as 0/4; all have to be run before labels count")
    return parser.parse_args()


def main() -> None:
    args = arguments()
    spark = build_session()
    settings = json.loads(jobs.read_text(spark, args.settings))
    if args.stage == "prompts":
        jobs.prompts_stage(spark, settings, args.root, args.work, args.run)
    elif args.stage == "mappings":
        jobs.mappings_stage(spark, settings, spark.read.parquet(args.responses), args.work, args.run, args.model)
    elif args.stage == "template":
        pairs = files.scan_mappings(spark, args.mappings) if args.mappings else jobs.read_run(spark, f"{args.work}/mappings", args.run)
        jobs.template_stage(spark, settings, pairs, args.work, args.run)
    elif args.stage == "execution":
        sessions = catalog_per_target(spark, tables_below(spark, args.databases))
        shard, shards = (int(x) for x in args.shard.split("/"))
        jobs.execution_stage(spark, settings, sessions, args.work, args.run, args.seconds, args.parallel, shard, shards)
    elif args.stage == "ratings":
        jobs.rating_prompts_stage(spark, settings, files.scan_schemas(spark, args.schemas), args.work, args.run, root=args.root)
    else:
        jobs.semantic_stage(spark, settings, spark.read.parquet(args.responses), args.work, args.run)


if __name__ == "__main__":
    main()
