"""Command line: python -m siltstone WORKSPACE ingest ID SOURCE | list | status ID."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .api import Workspace
from .operators import corpus
from .session import ship


def main() -> None:
    p = argparse.ArgumentParser(prog="siltstone")
    p.add_argument("workspace")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("corpus_id")
    i.add_argument("source")
    i.add_argument("--domain", default="general")
    i.add_argument("--strategy")
    i.add_argument("--force", action="store_true")
    x = sub.add_parser("list")
    x.add_argument("--domain")
    x.add_argument("--status")
    sub.add_parser("status").add_argument("corpus_id")
    a = p.parse_args()
    w = Workspace(ship(SparkSession.builder.appName("siltstone").getOrCreate()), a.workspace)
    if a.command == "ingest":
        print(w.ingest(a.corpus_id, a.source, a.domain, a.strategy, force=a.force))
    elif a.command == "list":
        w.list(a.domain, a.status).show(truncate=False)
    else:
        try:
            corpus.get_corpus(w.corpora(), a.corpus_id).show(truncate=False, vertical=True)
        except LookupError as e:
            raise SystemExit(str(e)) from None


if __name__ == "__main__":
    main()
