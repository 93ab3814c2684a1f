"""Command line: rebuild an index, ask, evaluate, compare the wording switch."""

from __future__ import annotations

import argparse
import json
from dataclasses import replace

from sourcelight.engine import Engine
from sourcelight.operators import evaluation
from sourcelight.session import build_session
from sourcelight.settings import DEFAULT_SETTINGS
from sourcelight.sources import cases


def _show(df) -> None:
    for line in df.toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sourcelight")
    parser.add_argument("--folder", required=True, help="folder of the stored tables")
    parser.add_argument("--no-adaptations", action="store_true", help="switch the corpus wording rules off")
    commands = parser.add_subparsers(dest="command", required=True)
    rebuild = commands.add_parser("rebuild")
    rebuild.add_argument("documents")
    ask = commands.add_parser("ask")
    ask.add_argument("question")
    for name in ("evaluate", "ablation", "audit"):
        sub = commands.add_parser(name)
        sub.add_argument("cases")
        if name == "audit":
            sub.add_argument("report")
    args = parser.parse_args(argv)

    spark = build_session()
    settings = replace(DEFAULT_SETTINGS, adaptations=not args.no_adaptations)
    engine = Engine(spark, args.folder, settings)
    if args.command == "rebuild":
        print(json.dumps(engine.rebuild(args.documents), ensure_ascii=False, default=str))
    elif args.command == "ask":
        asked = spark.createDataFrame([("q", args.question)], "query_id string, question string")
        _show(engine.ask(asked).drop("results"))
    elif args.command == "evaluate":
        rows = engine.evaluate(cases.evaluation_cases(spark, args.cases))
        _show(evaluation.summarize(rows))
        _show(rows)
    elif args.command == "ablation":
        given = cases.evaluation_cases(spark, args.cases)
        off = Engine(spark, args.folder, replace(settings, adaptations=False))
        compared = ["rank", "hit_at_3", "failure_type", "refusal_correct"]
        _show(evaluation.ablation_diff(engine.evaluate(given), off.evaluate(given), compared))
    else:
        given = cases.acceptance_cases(spark, args.cases)
        asked = given.select(given["id"].alias("query_id"), "question")
        cases.write_audit(engine.ask(asked).drop("question", "results"), given, args.report)


if __name__ == "__main__":
    main()
