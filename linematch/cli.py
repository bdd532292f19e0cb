"""python -m linematch.cli TEXT_OR_FILE CATALOG.csv: the result as JSON on standard output.

Exit codes: 0, 2 usage, 3 no session, 4 the catalog can't be used, 5 the text can't be processed.
"""

from __future__ import annotations

import sys


def main(args: list[str], spark=None) -> int:
    if not 1 <= len(args) <= 2:
        print(__doc__.splitlines()[0], file=sys.stderr)
        return 2
    from linematch.plans.pipeline import Engine
    from linematch.sources.catalog import CatalogError

    try:
        from pyspark.sql import SparkSession

        spark = spark or SparkSession.builder.getOrCreate()
    except Exception as e:
        print(f"Error: {e}", file=sys.stderr)
        return 3
    with Engine(spark) as engine:
        try:
            engine.load_catalog(args[1] if len(args) == 2 else "data/products.csv")
        except CatalogError as e:
            print(f"Error: {e}", file=sys.stderr)
            return 4
        try:
            print(engine.process_source(args[0]))
        except Exception as e:
            print(f"Error: {e}", file=sys.stderr)
            return 5
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
