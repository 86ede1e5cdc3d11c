"""``python -m flipside STEP --corpus C --splits S --out O``: run one investigation step."""

from __future__ import annotations

import argparse

from flipside.plans.runs import STEPS, Workspace, run_audit
from flipside.session import build_session


def main() -> None:
    parser = argparse.ArgumentParser(prog="flipside")
    parser.add_argument("step", choices=sorted(STEPS))
    parser.add_argument("--corpus", required=True, help="CSV or parquet: id, keyword, location, text, target")
    parser.add_argument("--splits", required=True, help="JSON id lists, or parquet: id, split, pos")
    parser.add_argument("--out", required=True, help="folder for result tables and ledgers")
    parser.add_argument("--contract", help="JSON contract for the probe")
    parser.add_argument("--reviews", help="CSV of verdicts for the audit: id, verdict, new_label")
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    args = parser.parse_args()
    work = Workspace(build_session(), args.corpus, args.splits, args.out, args.contract, args.format)
    if args.step == "audit":
        run_audit(work, args.reviews)
    else:
        STEPS[args.step](work)


if __name__ == "__main__":
    main()
