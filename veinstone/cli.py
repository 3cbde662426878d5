"""Command line: index, maintain, ask, search, status, sessions, audit, config. Exit 0 (a refusal too), 1 on an error or a failed audit, 2 on wrong usage."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from .plans import ask, audit, ingest, settings
from .session import build_session
from .sources import records


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veinstone", description=__doc__)
    p.add_argument("--index", default="index", help="folder of the index")
    p.add_argument("--profile", default=None)
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("index")
    one.add_argument("paths", nargs="+")
    one.add_argument("--rebuild", action="store_true")
    for name in ("ask", "search"):
        one = sub.add_parser(name)
        one.add_argument("question")
        one.add_argument("-k", type=int, default=None)
    sub.add_parser("status")
    one = sub.add_parser("maintain", help="merge small segments and remove files that no kept snapshot needs")
    one.add_argument("--keep", type=int, default=2)
    one = sub.add_parser("audit", help="compare a source tree with others")
    one.add_argument("target")
    one.add_argument("reference", nargs="+")
    one = sub.add_parser("sessions")
    one.add_argument("keyword")
    sub.add_parser("config")
    return p


def run(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        cfg = settings.load(args.profile)
        if args.command == "config":
            print(json.dumps(cfg.shown(), indent=2, ensure_ascii=False))
            return 0
        spark = build_session()
        result = _command(spark, args, cfg)
    except Exception as error:  # noqa: BLE001 - any failure is a message and 1
        print(f"error: {error}", file=sys.stderr)
        return 1
    print(json.dumps(result, ensure_ascii=False, default=str) if args.json else _shown(result))
    return 1 if not result.get("ok", True) or not result.get("passed", True) else 0


def _command(spark, args, cfg) -> dict:
    if args.command == "index":
        report = ingest.build(spark, args.index, args.paths, cfg, args.rebuild)
        return {**report._asdict(), "ok": report.ok}
    if args.command == "maintain":
        merged, gone = ingest.maintain(spark, args.index, cfg, keep=args.keep)
        return {"merged": merged, "removed": gone}
    if args.command == "audit":
        return audit.trees(spark, [args.target], args.reference)
    opened = ask.Index.open(spark, args.index, cfg)
    if args.command == "status":
        return opened.status()
    sessions = f"{args.index}/sessions"
    if args.command == "sessions":
        rows = records.read_jsonl(spark, sessions, "question string, text string, status string")
        word = args.keyword.lower()
        hit = F.contains(F.lower("question"), F.lit(word)) | F.contains(F.lower("text"), F.lit(word))
        return {"sessions": [r.asDict() for r in rows.where(hit).limit(100).collect()]}
    asked = spark.createDataFrame([(1, args.question)], "query_id long, query string")
    if args.command == "search":
        found = ask.search(opened, asked, args.k).join(opened.fragments.select(F.col("fragment_id").alias("id"), "text"), "id").orderBy("rank")
        return {"hits": [r.asDict() for r in found.collect()]}
    row = ask.ask(opened, asked).first().asDict()
    status = "REFUSED" if row["refused"] else "SUCCESS"
    try:
        _keep_session(spark, sessions, args.question, row["text"], status)
    except Exception as error:  # noqa: BLE001 - the answer is there all the same
        print(f"the session was not kept: {error}", file=sys.stderr)
    return {**row, "status": status}


def _keep_session(spark, sessions: str, question: str, answer: str, status: str) -> None:
    records.append_jsonl(spark.createDataFrame([(question, answer, status)], "question string, text string, status string"), sessions)


def _shown(result: dict) -> str:
    return "\n".join(f"{k}: {v}" for k, v in result.items())


if __name__ == "__main__":
    sys.exit(run())
