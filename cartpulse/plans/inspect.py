"""Physical-plan summary of a registered query (exchanges, scans, Python).

    python -m cartpulse.plans.inspect pair_features [/root/testdata/sf0.1] [--shuffle-joins]

``--shuffle-joins`` disables broadcast joins and AQE so the plan shows what a
large layout gets (every join a sort-merge join on shuffled inputs).
"""

from __future__ import annotations

import contextlib
import io
import re
import sys

from pyspark.sql import DataFrame


def formatted_plan(df: DataFrame) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def physical_plan(df: DataFrame) -> str:
    """The physical plan as a tree string (AQE: the initial plan)."""
    return df._jdf.queryExecution().executedPlan().toString()


def summary(df: DataFrame) -> dict:
    text = formatted_plan(df)
    tree = physical_plan(df)
    exchanges = re.findall(r"Exchange (hashpartitioning\([^)]*\)|rangepartitioning\([^)]*\)|SinglePartition"
                           r"|RoundRobinPartitioning\(\d+\))", tree)
    return {
        "exchanges": exchanges,
        "broadcasts": tree.count("BroadcastExchange"),
        "sort_merge_joins": tree.count("SortMergeJoin"),
        "broadcast_joins": tree.count("BroadcastHashJoin") + tree.count("BroadcastNestedLoopJoin"),
        "windows": tree.count("Window"),
        "expand": tree.count("Expand"),
        "python": len(re.findall(r"(ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas)", tree)),
        "pushed_filters": re.findall(r"PushedFilters: (\[.*?\])", text),
        "read_schemas": re.findall(r"ReadSchema: (struct<.*?>)", text),
    }


def main(argv: list[str]) -> None:
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    from cartpulse.plans.catalog import QUERIES
    from cartpulse.session import local_session

    args = [a for a in argv if not a.startswith("--")]
    name = args[0]
    sf_dir = args[1] if len(args) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    if "--shuffle-joins" in argv:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    for k, v in summary(QUERIES[name](spark, sf_dir)).items():
        if isinstance(v, list):
            print(f"{k}:")
            for x in v:
                print(f"  {x}")
        else:
            print(f"{k}: {v}")


if __name__ == "__main__":
    main(sys.argv[1:])
