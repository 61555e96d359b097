"""Write PLANS.md: physical-plan features of every registered query (final AQE plan).

Usage: python tests/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FEATURES = [
    ("hash shuffles", r"Exchange hashpartitioning"),
    ("range shuffles", r"Exchange rangepartitioning"),
    ("single-partition", r"Exchange SinglePartition"),
    ("broadcasts", r"BroadcastExchange"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SMJ", r"SortMergeJoin"),
    ("windows", r"\bWindow \["),
    ("python stages", r"MapInArrow|MapInPandas|ArrowEvalPython|BatchEvalPython"),
    ("top-n", r"TakeOrderedAndProject"),
    ("partial aggs", r"functions=\[partial_"),
]


def single_partition_inputs(p: str) -> list[str]:
    """What feeds each SinglePartition exchange (first operator below it)."""
    out = []
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and i + 1 < len(lines):
            nxt = re.sub(r"^[\s:+\-]*", "", lines[i + 1])
            out.append(nxt.split("(")[0].split(" [")[0])
    return out


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    from samplecraft.session import local_session
    import __spark_entry__ as entry
    spark = local_session(8, 8)
    print("# Physical plans of the registered queries\n")
    print(f"Final adaptive plans at `{os.path.basename(sf)}`, local[8]. Generated by `tests/plan_report.py`.")
    print("`single-partition` exchanges are listed with the operator feeding them; each one sits on a")
    print("bounded set (the distinct class set, per-bucket or per-partition counts, a per-run table, a")
    print("global 1-row aggregate) or on the input of a top-n / limit, never on a table-sized branch.\n")
    print("`eager jobs` is the number of Spark jobs that ran while the query was built (written tables,")
    print("checkpoints, size checks, training steps); their stages are not part of the final plan.\n")
    print("| query | eager jobs | " + " | ".join(f for f, _ in FEATURES) + " | single-partition inputs |")
    print("| --- | --- | " + " | ".join("---" for _ in FEATURES) + " | --- |")
    sc = spark.sparkContext
    for name, fn in entry.queries().items():
        sc.setJobGroup(name, name)
        df = fn(spark, sf)
        eager = len(sc.statusTracker().getJobIdsForGroup(name))
        df.write.format("noop").mode("overwrite").save()
        p = df._jdf.queryExecution().executedPlan().toString()
        counts = [len(re.findall(rx, p)) for _, rx in FEATURES]
        sp = ", ".join(sorted(set(single_partition_inputs(p)))) or "-"
        print(f"| {name} | {eager} | " + " | ".join(str(c) for c in counts) + f" | {sp} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
