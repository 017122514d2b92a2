"""Command line: ``python -m lumenframe build|solve|report|check|inspect STORE``, or the same under spark-submit."""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .plans import build as building
from .plans import diagnose, run, serve
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lumenframe", description="Spectral cubes in Spark: build, solve, report.")
    out.add_argument("--tile-size", type=int, default=128)
    out.add_argument("--quiet", action="store_true")
    steps = out.add_subparsers(dest="step", required=True)
    for name, text in (("build", "build the tiles that are missing"), ("solve", "solve for the weights and save them"), ("report", "compare the saved solution's mix with the prior"), ("check", "list what is wrong with the tables"), ("inspect", "histograms and models of some apertures")):
        one = steps.add_parser(name, help=text)
        one.add_argument("store")
        if name == "solve":
            one.add_argument("--solver", default=None)
            one.add_argument("--epochs", type=int, default=None)
            one.add_argument("--batched", action="store_true", help="save after each epoch")
            one.add_argument("--fresh", action="store_true", help="do not resume")
        if name == "inspect":
            one.add_argument("--apertures", default="0:1", help="start:count or a list")
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(arguments)
    logging.basicConfig(level=logging.WARNING if args.quiet else logging.INFO, format="%(asctime)s %(name)s %(message)s", stream=sys.stderr)
    spark = spark or SparkSession.builder.appName("lumenframe").getOrCreate()
    store = Store(spark, args.store, args.tile_size)
    if not store.present():
        print(f"no store at {args.store}", file=sys.stderr)
        return 2
    if args.step == "build":
        print(f"{building.build(store)} tiles built")
    elif args.step == "solve":
        config = run.RunConfig.from_conf(spark)
        config.solver, config.epochs, config.resume = args.solver or config.solver, args.epochs or config.epochs, config.resume and not args.fresh
        weights = (run.solve_all_batched if args.batched else run.solve_all)(store, config)
        print(f"{weights.where('x > 0').count()} columns in use, digest {store.metadata()['x_digest']}")
    elif args.step == "report":
        kept, target = run.saved_weights(store, run.DISPLAY), run.prior_weights(store)
        if kept is None or target is None:
            print("no solution or no prior", file=sys.stderr)
            return 1
        serve.mix_report(kept[1], spark.createDataFrame(sorted(target.items()), "c int, w double")).show(truncate=False)
    elif args.step == "check":
        found = serve.issues(store).limit(100).collect()
        for row in found:
            print(*row, sep="\t")
        return 1 if found else 0
    else:
        from .functions.expressions import parse_selection

        diagnose.inspect(store, parse_selection(args.apertures, int(store.metadata()["n_s"]))).orderBy("s", "c").show(1000, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
