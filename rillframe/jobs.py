"""Command line: ``python -m rillframe.jobs <job>``.

query      run a registered query and write its rows
delineate  catchments of selected dams; choosing nothing ends with status 2
publish    write a table under its content version and switch its pointer
"""

from __future__ import annotations

import argparse
import sys

from rillframe.session import build_session

#: Dams that may be delineated without --yes.
MANY = 30


def _query(spark, a) -> int:
    from rillframe import catalogue

    catalogue.queries()[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
    return 0


def _delineate(spark, a) -> int:
    from rillframe.operators import catchments, select
    from rillframe.storage import lineage_cut

    dams = spark.read.parquet(a.dams)
    try:
        chosen = select.select_targets(dams, a.pref, a.id, a.only, a.all)
    except KeyError as e:
        print(e.args[0], file=sys.stderr)
        return 2
    n = chosen.count()
    if not n:
        print("no dam is selected", file=sys.stderr)
        return 2
    if n > MANY and not a.yes:
        print(f"{n} dams: add --yes", file=sys.stderr)
        return 2
    rows = chosen.select("dam_id", "lat", "lon", "sizing_km2", "official_km2")
    catchments.delineate_growing(rows, spark.read.parquet(a.tiles), lineage_cut(spark, "delineate")).write.mode("overwrite").parquet(a.out)
    return 0


def _publish(spark, a) -> int:
    from rillframe import publish

    version, wrote = publish.publish(spark, spark.read.parquet(a.table), a.root, a.name, a.key)
    print(version, "written" if wrote else "unchanged")
    return 0


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="rillframe", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = p.add_subparsers(dest="job", required=True)
    q = jobs.add_parser("query")
    q.add_argument("name")
    q.add_argument("--tables", required=True)
    q.add_argument("--out", required=True)
    d = jobs.add_parser("delineate")
    for flag in ("--dams", "--tiles", "--out"):
        d.add_argument(flag, required=True)
    d.add_argument("--pref", action="append", default=[])
    d.add_argument("--id", action="append", default=[])
    d.add_argument("--only")
    d.add_argument("--all", action="store_true")
    d.add_argument("--yes", action="store_true")
    u = jobs.add_parser("publish")
    for flag in ("--table", "--root", "--name", "--key"):
        u.add_argument(flag, required=True)
    a = p.parse_args(argv)
    return {"query": _query, "delineate": _delineate, "publish": _publish}[a.job](spark or build_session(), a)


if __name__ == "__main__":
    sys.exit(main())
