"""python -m quillsift: build an index, evaluate simulated sessions, compare settings, list failures."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillsift.operators import metrics, selection
from quillsift.plans.agent import ablation
from quillsift.plans.search import Engine, product_index
from quillsift.plans.simulate import evaluate
from quillsift.sources import catalog, config, store

#: Switches that the comparison turns off one at a time.
TOGGLES = {"all on": {}, "no early stop": {"use_early_stop": False}, "no override detection": {"use_override_detection": False}, "fixed entropy": {"use_dynamic_entropy": False}}


def main(argv: list[str] | None = None) -> None:
    parser = config.add_flags(argparse.ArgumentParser(prog="quillsift", description=__doc__))
    parser.add_argument("what", choices=("index", "evaluate", "compare", "failures"))
    parser.add_argument("--catalog", required=True, help="products, lines of JSON (for failures: outcomes that evaluate wrote)")
    parser.add_argument("--out", required=True, help="folder that is written")
    parser.add_argument("--samples", type=int, default=200)
    parser.add_argument("--seed", type=int, default=20_260_829)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillsift").getOrCreate()
    if args.what == "failures":
        sessions = store.read_json_lines(spark, args.catalog, "sample_id string, scenario_type string, hit boolean, first_hit_turn int, best_rank int, reciprocal_rank double")
        late = metrics.near_misses(sessions).withColumn("kind", F.lit("near miss"))
        store.write_json(late.unionByName(metrics.complete_misses(sessions).withColumn("kind", F.lit("complete miss"))), args.out)
        return
    lines = catalog.read_catalog(spark, args.catalog)
    products = catalog.products(lines)
    if args.what == "index":
        product_index(products).save(args.out)
        return
    settings = config.load(config.from_flags(args))
    engine = Engine(products, product_index(products), settings=settings)
    samples = selection.unseen_samples(products, args.samples, args.seed).withColumn("tags", F.array().cast("array<string>"))
    shoppers = lines.withColumnRenamed("parent_asin", "doc_id")
    if args.what == "evaluate":
        outcomes, summary = evaluate(engine, samples, shoppers)
        store.write_json(outcomes, f"{args.out}/sessions")
        store.write_json(summary, f"{args.out}/summary")
    else:
        rows = [{"change": name} | row.asDict() for name, row in ablation(engine, samples, shoppers, TOGGLES).items()]
        store.write_json(spark.createDataFrame(rows), args.out)


if __name__ == "__main__":
    main()
