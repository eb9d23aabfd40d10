"""Command line over a data directory of parquet tables.

python -m chronoweave query NAME DIR OUT        one query into a parquet folder; `query` alone lists the names
python -m chronoweave preprocess DIR OUT        index visits, labels and framed token sequences
python -m chronoweave train DIR OUT             a token scorer and its metrics, as a bundle
python -m chronoweave run DIR OUT [BUNDLE]      attributions, patterns, validation and the report's tables; resumed from OUT
python -m chronoweave risk DIR OUT              the visit-risk table
python -m chronoweave compare DIR OUT           held-out comparison of the risk models, with bootstrap intervals
python -m chronoweave kernel DIR OUT            kernel attributions batch by batch, resumed from OUT
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import functions as F

from chronoweave.common import session, table
from chronoweave.config import Config
from chronoweave.operators import metrics as Me
from chronoweave.operators import models as Mo
from chronoweave.pipeline import Pipeline
from chronoweave.plans import problems, queries
from chronoweave.sources import tables as So

QUERIES = {**queries.QUERIES, **problems.QUERIES}


def preprocess(c: queries.Context, out: str) -> None:
    So.save(c.index, os.path.join(out, "index"))
    So.save(queries.Co.framed(c.entity_tokens), os.path.join(out, "sequences"))


def train(c: queries.Context, out: str) -> None:
    Pipeline(c.t("sequences"), train=F.pmod(F.xxhash64("key"), F.lit(10)) < 7).save_bundle(out)


def run(c: queries.Context, out: str, bundle: str | None = None) -> None:
    cache = os.path.join(out, "cache")
    p = Pipeline.from_bundle(c.spark, bundle, c.t("sequences"), cache) if bundle else Pipeline(c.t("sequences"), Config(), cache=cache)
    So.save(p.validate(), os.path.join(out, "validation"))
    for name, df in p.report().items():
        So.save(df, os.path.join(out, name))


def risk(c: queries.Context, out: str) -> None:
    So.save(c.risk, os.path.join(out, "risk"))


def compare(c: queries.Context, out: str) -> None:
    So.save(QUERIES["risk_models"](c.spark, c.d), os.path.join(out, "risk_models"))
    cols = ["l", "a", "c", "e"]
    rows = c.labelled.select("entity", "visit", "label").join(c.risk.drop("entity"), "visit").select("entity", "visit", "label", F.col("score").alias("total"), *[F.col(x).cast("double").alias(x) for x in cols])
    fit, test = queries._held_out(c, rows)
    scored = Mo.with_score(Mo.train_columns(fit, cols, "label"), test).select("label", F.col("total").cast("double").alias("plain"), F.col("score").alias("fitted"))
    So.save(Me.bootstrap(scored, "label", ["plain", "fitted"]), os.path.join(out, "intervals"))


def kernel(c: queries.Context, out: str, batches: int = 10) -> None:
    """Batches of sequences by hash of the key; those already written are passed over."""
    e, m = queries._encoded(c)
    for k in range(batches):
        path = os.path.join(out, f"batch-{k}-of-{batches}")
        if not So._exists(c.spark, os.path.join(path, "_SUCCESS")):
            So.save(queries.kernel_values(c, e.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == k), m, 15), path)


COMMANDS = {f.__name__: f for f in (preprocess, train, run, risk, compare, kernel)}


def main(args: list[str]) -> int:
    if args[:1] == ["query"] and len(args) == 4 and args[1] in QUERIES:
        QUERIES[args[1]](session(), args[2]).write.mode("overwrite").parquet(args[3])
        return 0
    if args and args[0] in COMMANDS and len(args) in ((3, 4) if args[0] == "run" else (3,)):
        COMMANDS[args[0]](queries.Context(session(), args[1]), *args[2:])
        return 0
    print(__doc__, *(sorted(QUERIES) if args == ["query"] else ()), sep="\n")
    return int(args not in ([], ["query"]))


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
