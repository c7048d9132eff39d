"""python -m riskweave QUERY --data DIR [--out DIR] [--format parquet|csv] [--list]"""

from __future__ import annotations

import argparse

from .plans import catalogue
from .plans.reports import markdown
from .session import get_session
from .sources.series import as_of


def main() -> None:
    parser = argparse.ArgumentParser(prog="riskweave")
    parser.add_argument("query", nargs="?")
    parser.add_argument("--data")
    parser.add_argument("--out")
    parser.add_argument("--format", default="parquet", choices=("parquet", "csv"))
    parser.add_argument("--asof", help="read the tables as they were on this day: fits and ranks see nothing later")
    parser.add_argument("--log-level", default="WARN")
    parser.add_argument("--list", action="store_true")
    args = parser.parse_args()
    if args.list or not args.query:
        print("\n".join(sorted(catalogue.QUERIES)))
        return
    spark = get_session()
    spark.sparkContext.setLogLevel(args.log_level)
    with as_of(args.asof):
        df = catalogue.QUERIES[args.query](spark, args.data)
    if args.out:
        df.write.mode("overwrite").format(args.format).save(args.out)
    else:
        print(markdown(df, args.query))


if __name__ == "__main__":
    main()
