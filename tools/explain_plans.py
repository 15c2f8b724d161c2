"""Print the formatted physical plan of registered queries (for plan review).

Usage: python tools/explain_plans.py [sf_dir] name [name ...]
"""

from __future__ import annotations

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from labelset.plans import all_queries
    from labelset.session import get_spark

    spark = get_spark("explain", cpus=8, shuffle_partitions=16)
    reg = all_queries()
    for n in names or list(reg):
        print(f"===== {n}")
        reg[n].build(spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv)
