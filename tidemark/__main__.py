"""python -m tidemark QUERY --input FOLDER [--limit N] [--export PATH]"""

from __future__ import annotations

import argparse


def main(args: list[str] | None = None) -> int:
    from tidemark.plans.registry import QUERIES
    from tidemark.report import render
    from tidemark.session import session

    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("query", choices=sorted(QUERIES))
    p.add_argument("--input", required=True, help="folder of the Parquet tables")
    p.add_argument("--limit", type=int, default=25, help="rows to show")
    p.add_argument("--export", help="write all rows as JSON lines instead")
    p.add_argument("--master", default=None)
    a = p.parse_args(args)
    rows = QUERIES[a.query](session(a.master), a.input)
    if a.export:
        rows.write.mode("overwrite").json(a.export)
    else:
        print(render(a.query, rows, a.limit))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
