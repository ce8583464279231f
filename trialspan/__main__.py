"""Command line: run a query over a folder of tables, fit models, build corpora, or compare scores.

    python -m trialspan query NAME --tables DIR --out PATH
    python -m trialspan fit --sessions PATH --model pvl --mode insample|holdout|kfold --out PATH
    python -m trialspan corpus --texts PATH --budget 200000 --limit 8192 --out PATH
    python -m trialspan likelihood --responses PATH --out PATH
    python -m trialspan statistics --scores PATH --pair A B --out PATH
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession, functions as F


def query(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    from trialspan.plans import catalogue

    if args.name not in catalogue.QUERIES:
        raise SystemExit(f"unknown query {args.name!r}")
    return catalogue.QUERIES[args.name](spark, args.tables)


def fit(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    from trialspan.operators import cognitive, pooled

    rows = spark.read.parquet(args.sessions)
    common = {"starts": args.starts, "steps": args.steps}
    if args.mode == "insample":
        return cognitive.fit_sessions(rows, args.key, "trials", args.model, **common)
    if args.mode == "holdout":
        return cognitive.holdout(rows, args.key, "trials", args.model, fit_share=args.share, **common)
    return pooled.pooled_folds(rows, args.key, args.unit, "trials", "experiment", args.model, folds=args.folds, **common)


def corpus(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    from trialspan.functions.text import approx_tokens
    from trialspan.operators import corpus as K

    texts = spark.read.parquet(args.texts).where(~K.of_task(F.col("experiment"), F.col("text")) & ~K.blank(F.col("text")))
    sized = texts.select(args.key, approx_tokens(F.col("text")).alias("n"))
    kept = K.budget_prefix(sized, K.hash_order(F.col(args.key).cast("string"), args.seed), args.key, F.col("n"), args.budget).select(args.key)
    return K.marker_chunks(texts.join(kept, args.key, "left_semi"), "text", args.limit)


def likelihood(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    from trialspan.operators import answers

    return answers.session_nll(answers.trial_logprobs(spark.read.parquet(args.responses), args.key, "response"), args.key)


def statistics(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    from trialspan.operators import scores, statistics as X

    a, b = args.pair
    wide = scores.wide_scores(scores.latest_scores(spark.read.parquet(args.scores)), [a, b])
    deltas = scores.paired_deltas(wide, [(f"{a}_{b}", a, b)])
    out = X.with_p_values(scores.paired_summary(deltas, ["contrast"]))
    return out.join(X.session_bootstrap(deltas, ["contrast"], args.replicates), "contrast").join(X.sign_flip(deltas, ["contrast"], args.replicates).select("contrast", F.col("p").alias("p_sign_flip")), "contrast")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="trialspan", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("--tables", required=True)
    f = sub.add_parser("fit")
    f.add_argument("--sessions", required=True)
    f.add_argument("--model", required=True)
    f.add_argument("--mode", choices=("insample", "holdout", "kfold"), default="kfold")
    f.add_argument("--key", default="prompt_id")
    f.add_argument("--unit", default="subject_id")
    f.add_argument("--share", type=float, default=0.5)
    f.add_argument("--folds", type=int, default=5)
    f.add_argument("--starts", type=int, default=32)
    f.add_argument("--steps", type=int, default=1000)
    c = sub.add_parser("corpus")
    c.add_argument("--texts", required=True)
    c.add_argument("--key", default="row_id")
    c.add_argument("--seed", default="v1")
    c.add_argument("--budget", type=int, default=710_000)
    c.add_argument("--limit", type=int, default=8192)
    n = sub.add_parser("likelihood")
    n.add_argument("--responses", required=True)
    n.add_argument("--key", default="prompt_id")
    s = sub.add_parser("statistics")
    s.add_argument("--scores", required=True)
    s.add_argument("--pair", nargs=2, required=True)
    s.add_argument("--replicates", type=int, default=10_000)
    for p in sub.choices.values():
        p.add_argument("--out", required=True)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("trialspan").getOrCreate()
    from trialspan.runtime import ship

    ship(spark)
    run = {"query": query, "fit": fit, "corpus": corpus, "likelihood": likelihood, "statistics": statistics}[args.command]
    run(spark, args).write.mode("overwrite").parquet(args.out)


if __name__ == "__main__":
    main()
