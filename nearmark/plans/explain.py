"""Print the executed (final adaptive) plan of a registered query.

    python -m nearmark.plans.explain jaccard_scores /root/testdata/sf0.01

The query runs once (its own query execution) so AQE's final plan (broadcasts chosen
at run time, coalesced or split partitions) is what gets printed.
"""

from __future__ import annotations

import sys


def main(argv: list[str]) -> None:
    name = argv[0]
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from nearmark.plans.queries import QUERIES
    from nearmark.session import local_session
    spark = local_session()
    df = QUERIES[name](spark, sf_dir)
    qe = df._jdf.queryExecution()
    qe.toRdd().count()  # runs this very plan, so AQE's final plan is attached to it
    print(qe.executedPlan().treeString())


if __name__ == "__main__":
    main(sys.argv[1:])
