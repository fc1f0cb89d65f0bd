"""Write PLANS.md: the physical plan skeleton of the headline queries (exchanges, joins, aggregates, scans).

Usage: ``python tests/plan_report.py [sf_dir] > PLANS.md`` (plans are taken after one execution, so AQE's final
plan is shown).
"""

from __future__ import annotations

import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

KEEP = re.compile(r"(Exchange|BroadcastExchange|BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|HashAggregate|"
                  r"ObjectHashAggregate|SortAggregate|Window|WindowGroupLimit|FlatMapCoGroupsInPandas|MapInPandas|"
                  r"ArrowEvalPython|TakeOrderedAndProject|Generate|FileScan|Scan parquet|Union|Expand|AQEShuffleRead)")


def skeleton(plan: str) -> list[str]:
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"Location: [^,]*(, |$)", "", line)
        line = re.sub(r"\[plan_id=\d+\]", "", line)
        out.append(line.rstrip()[:170])
    return out


def main() -> None:
    from bench import HEADLINE
    from feedsift.catalog import QUERIES, load_all
    from feedsift.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    load_all()
    spark = local_session(8)
    print("# PLANS — physical plans of the headline queries\n")
    print(f"Generated by `python tests/plan_report.py {sf}` after one execution of each query (AQE final plans),")
    print("keeping the lines that move or combine data: exchanges, joins, aggregates, windows, Python stages, scans.\n")
    for name in HEADLINE:
        df = QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        n_ex = len(re.findall(r"Exchange hashpartitioning|Exchange RoundRobin|Exchange SinglePartition|Exchange rangepartitioning", plan))
        print(f"## {name}\n")
        print(f"{(QUERIES[name].__doc__ or '').strip().splitlines()[0]}  \nShuffle exchanges: {n_ex}\n")
        print("```")
        print("\n".join(skeleton(plan)))
        print("```\n")


if __name__ == "__main__":
    main()
