"""Command line: data list | show | prepare, bench list, mix, eval."""

from __future__ import annotations

import argparse
import importlib
import json
from pathlib import Path

from pyspark.sql import functions as F

from tallyloom import catalog
from tallyloom.operators import metrics, mixture, prompts
from tallyloom.session import local_session
from tallyloom.sources import readers, record_json


def _records(spark, folder: str, source: mixture.Source):
    if source.name.endswith(".jsonl"):
        return readers.read_records(spark, source.name)
    spec = catalog.DATASETS.find(source.name)
    if source.split not in spec.splits:
        raise SystemExit(f"{spec.name} has the splits {', '.join(spec.splits)}")
    return readers.materialised(spark, folder, spec.name, source.split, spec.version, None, spec.build)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tallyloom", description=__doc__)
    p.add_argument("--load", action="append", default=[], help="module that registers datasets and benchmarks")
    p.add_argument("--folder", default="records", help="where materialised datasets are")
    sub = p.add_subparsers(dest="verb", required=True)
    data = sub.add_parser("data").add_subparsers(dest="what", required=True)
    data.add_parser("list")
    for what in ("show", "prepare"):
        one = data.add_parser(what)
        one.add_argument("name")
        one.add_argument("--split", default="train")
        one.add_argument("-n", type=int, default=3)
    sub.add_parser("bench").add_subparsers(dest="what", required=True).add_parser("list")
    mix = sub.add_parser("mix", help="build a mixture and its report")
    mix.add_argument("sources", help="name, name:split or file.jsonl, comma-separated, or a YAML file")
    mix.add_argument("--exclude", default="", help="sources of evaluation records, benchmarks or suites")
    mix.add_argument("--out")
    mix.add_argument("--objects", action="store_true", help="write questions and targets as objects by name instead of arrays")
    ev = sub.add_parser("eval", help="metrics of a Parquet table of scored decisions")
    ev.add_argument("table")
    ev.add_argument("--temperature", type=float)
    ev.add_argument("--keys", default="")
    return p


def main(args: list[str] | None = None) -> dict | list:
    """Run a verb; what it tells is printed as JSON and returned."""
    a = parser().parse_args(args)
    for module in a.load:
        importlib.import_module(module)
    spark = local_session("*")
    if a.verb in ("data", "bench") and a.what == "list":
        out = [r.asDict() for r in catalog.catalog(spark, catalog.DATASETS if a.verb == "data" else catalog.BENCHMARKS).collect()]
    elif a.verb == "data":
        found = _records(spark, a.folder, mixture.Source(a.name, a.split))
        out = [{"id": r.id, "prompt": r.prompt} for r in prompts.rendered(found).orderBy("id").limit(a.n).collect()] if a.what == "show" else {"records": found.count()}
    elif a.verb == "mix":
        config = Path(a.sources).read_text() if a.sources.endswith((".yaml", ".yml")) else a.sources
        wanted = mixture.sources_of(config)
        catalog.check_trainable([s.name for s in wanted])
        sources = [(s, _records(spark, a.folder, s)) for s in wanted]
        banned = None
        suites = {b.suite for b in catalog.BENCHMARKS.values()}
        for name in filter(None, (x.strip() for x in a.exclude.split(","))):
            known = name in catalog.BENCHMARKS or name in suites
            parts = [mixture.Source(b.dataset, b.split) for b in catalog.expanded([name])] if known else mixture.parsed_sources(name)
            for s in parts:
                more = _records(spark, a.folder, s)
                banned = more if banned is None else banned.unionByName(more)
        mixed, report = mixture.build_mixture(sources, banned)
        out = [r.asDict() for r in report.collect()]
        if a.out:
            (record_json.write_lines if a.objects else readers.write_records)(mixed, a.out)
    else:
        table = spark.read.parquet(a.table)
        t = a.temperature or metrics.fitted_temperature(table).first().temperature
        out = {"temperature": t} | metrics.summary(table, t).first().asDict()
        if a.keys:
            out["breakdown"] = [r.asDict() for r in metrics.breakdown(table, a.keys.split(",")).orderBy(F.col("key"), F.col("value")).collect()]
    print(json.dumps(out, indent=2, ensure_ascii=False, default=str))
    return out


if __name__ == "__main__":
    main()
