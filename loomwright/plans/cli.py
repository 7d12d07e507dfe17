"""python -m loomwright.plans.cli collect | quality | annotate | learn | run"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from loomwright.operators import annotate, clean, learn, profile, sample
from loomwright.plans import pipeline, reports
from loomwright.sources.collect import CATALOG, Collector, discover, read_numbered, write_file


def strategy(text: str) -> dict[str, str]:
    """missing=median,duplicates=drop"""
    return {k.strip(): v.strip() for k, v in (p.split("=", 1) for p in text.split(",") if p)}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loomwright", description="Labelled text data sets with Spark")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("collect", help="records of all sources of a task or topic")
    c.add_argument("--task", "-t")
    c.add_argument("--topic", "-T")
    c.add_argument("--config", "-c")
    c.add_argument("--list", "-l", action="store_true", dest="list_tasks")
    c.add_argument("--max-samples", "-n", type=int, default=3000)
    q = sub.add_parser("quality", help="find and repair problems")
    q.add_argument("input")
    q.add_argument("--strategy", default="missing=median,duplicates=drop,outliers=clip_iqr")
    q.add_argument("--output", "-o")
    a = sub.add_parser("annotate", help="label, check, export")
    a.add_argument("input")
    a.add_argument("--threshold", type=float, default=annotate.THRESHOLD)
    a.add_argument("--task", default="classification")
    a.add_argument("--output", "-o", default=".")
    a.add_argument("--one-file", action="store_true")
    g = sub.add_parser("learn", help="compare strategies of active learning")
    g.add_argument("input")
    g.add_argument("--strategies", default="entropy,random")
    g.add_argument("--iterations", type=int, default=5)
    g.add_argument("--batch-size", type=int, default=20)
    g.add_argument("--model", choices=("logreg", "rf"), default="logreg")
    g.add_argument("--output", "-o", default="learning_curve.svg")
    r = sub.add_parser("run", help="everything")
    r.add_argument("--auto", action="store_true")
    r.add_argument("--fast", action="store_true")
    r.add_argument("--max-samples", type=int)
    r.add_argument("--one-file", action="store_true")
    r.add_argument("--threshold", type=float, default=annotate.THRESHOLD)
    r.add_argument("--config")
    r.add_argument("--task", default="sentiment_analysis")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("loomwright").getOrCreate()
    if args.command == "collect":
        collector = Collector(spark, args.config or CATALOG)
        if args.list_tasks or not (args.task or args.topic):
            for name, about in collector.available_tasks().items():
                print(f"{name:30s} {about}")
            return 0 if args.list_tasks else 2
        if args.topic:
            sources, output = discover(spark, args.topic, args.max_samples)
            df = Collector(spark, {"output": output}).run(sources=sources)
        else:
            df = collector.with_max_samples(args.max_samples).run(args.task)
        print(f"{df.count()} rows, columns {', '.join(df.columns)}")
        df.show(10)
        profile.value_counts(df, "label").show()
    elif args.command == "quality":
        df = read_numbered(spark, args.input).cache()
        print(json.dumps(profile.detect(df), indent=2, default=str))
        fixed = clean.fix(df, strategy(args.strategy)).cache()
        profile.compare(profile.metrics(df), profile.metrics(fixed)).show(truncate=False)
        if args.output:
            write_file(fixed, args.output, "csv")
    elif args.command == "annotate":
        df, method = pipeline.label(read_numbered(spark, args.input), ["positive", "negative"], args.threshold)
        df = df.cache()
        found = annotate.check_quality(df, args.threshold)
        print(method, json.dumps(found, indent=2))
        reports.annotation_spec(df, f"{args.output}/annotation_spec.md", args.task)
        reports.export_tasks(df, f"{args.output}/labelstudio_import.json", array=args.one_file)
        write_file(annotate.flag(df, args.threshold), f"{args.output}/review_queue.csv", "csv", single=args.one_file)
    elif args.command == "learn":
        df = read_numbered(spark, args.input).where("label is not null")
        train, test = sample.train_test(df)
        seed, pool = sample.first_and_rest(train, sample.seed_size(train.count()))
        results = learn.compare_strategies(seed, pool, test, tuple(args.strategies.split(",")), args.iterations, args.batch_size, kind=args.model)
        reports.learning_curve(results, args.output)
        print(json.dumps(results, indent=2))
    else:
        settings = pipeline.Settings(task=args.task, threshold=args.threshold, auto=args.auto, one_file=args.one_file, max_samples=args.max_samples or (300 if args.fast else 1000))
        m = pipeline.run(spark, settings, collector=Collector(spark, args.config or CATALOG))
        print(json.dumps({k: v for k, v in m.items() if isinstance(v, (int, float, str)) and k != "classification_report"}, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
