"""Command line: build, embed, search, context, open, stats, validate, verify, evaluate, serve."""

from __future__ import annotations

import argparse
import json
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import evaluation, integrity, service
from .functions import lexicon as L
from .functions import text as X
from .operators import fetch, sessions, vectors
from .plans.engine import Archive
from .shipping import ship
from .sources import store


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trawl", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options):
        c = sub.add_parser(name)
        c.add_argument("--archive", default="archive")
        for flags, kw in options:
            c.add_argument(*flags, **kw)

    number = lambda name, default: ((f"--{name}",), {"type": int, "default": default})
    flag = lambda name: ((f"--{name}",), {"action": "store_true"})
    text = lambda name, **kw: ((f"--{name}",), kw)
    command("build", text("raw", required=True), number("chunk-chars", L.CHUNK_CHARS), number("chunk-overlap", L.CHUNK_OVERLAP), flag("semantic"), text("model"))
    command("embed", number("batch-size", 64), text("roles", choices=("user", "all"), default="user"), number("max-text-chars", 2400), number("limit", 0), text("model"))
    command(
        "search", (("query",), {}), flag("lexical-only"), flag("semantic-only"), number("limit", 12), number("candidate-limit", 250), text("from", dest="date_from"), text("to", dest="date_to"),
        text("conversation-id"), flag("timeline"), text("order", choices=("auto", "relevance", "earliest", "latest"), default="auto"), number("context", 1), number("max-chars", 1800), flag("json"), text("model"),
    )
    command("context", (("query",), {}), text("depth", choices=tuple(L.DEPTHS), default="medium"), text("from", dest="date_from"), text("to", dest="date_to"), text("model"))
    command("open", text("conversation-id", required=True), ((("--turn",)), {"type": int, "required": True}), number("before", 2), number("after", 2))
    command("stats")
    command("validate", text("needles", nargs="*", default=[]), text("expect", nargs="*", default=[]), text("output"), text("model"))
    command("verify", text("source", required=True), text("copy", required=True), text("output"))
    command("evaluate", text("cases", required=True), number("repeat", 2), text("only", nargs="*", default=[]), text("output"), text("model"))
    command("serve", text("log-level", choices=("critical", "error", "warning", "info"), default="info"), text("model"))
    return p


def search_records(archive: Archive, args) -> list[dict]:
    """Search results with the turns around each, found by one join."""
    found = archive.search(
        args.query, args.limit, args.candidate_limit, args.date_from, args.date_to, args.conversation_id, args.timeline, args.order, args.lexical_only, args.semantic_only
    ).cache()
    conversations = [r["conversation_id"] for r in found.select("conversation_id").distinct().collect()]  # `limit` at most
    turns = archive.tables["turns"].where(fetch.near("conversation_id", conversations))
    near = sessions.turn_window(turns, found.select("conversation_id", "turn_index").hint("broadcast"), args.context, args.context)
    short = lambda c: X.shorten(F.col(c), args.max_chars)
    near = near.groupBy("conversation_id", "seed").agg(
        F.sort_array(F.collect_list(F.struct("turn_index", X.timestamp_iso(F.col("create_time")).alias("date"), short("user_text").alias("user"), short("assistant_text").alias("assistant"), "acceptance"))).alias("window")
    ).withColumnRenamed("conversation_id", "c")
    rows = found.join(near, (F.col("conversation_id") == F.col("c")) & (F.col("turn_index") == F.col("seed")), "left").orderBy("place").select(
        F.col("place").alias("rank"), F.round("score", 8).alias("score"), X.timestamp_iso(F.col("create_time")).alias("date"), "title", "conversation_id", "turn_index",
        F.col("role").alias("matched_role"), F.col("message_id").alias("matched_message_id"), short("text").alias("matched_text"), X.source_uri(F.col("conversation_id"), F.col("turn_index")).alias("source"), "window",
    )
    return [r.asDict(recursive=True) for r in rows.collect()]


def report(query: str, records: list[dict]) -> str:
    lines = [f"# Search: {query}", "", f"Results: {len(records)}", ""]
    for r in records:
        lines += [f"## {r['rank']}. {r['title']} — {r['date']}", f"Source: `{r['source']}`", f"Matched {r['matched_role']} message `{r['matched_message_id']}`", "", r["matched_text"] or "[no text]"]
        for t in r["window"] or []:
            lines += ["", f"- Turn {t['turn_index']} ({t['date']}, {t['acceptance']})"]
            lines += [f"  - {who}: {t[key]}" for who, key in (("User", "user"), ("Assistant", "assistant")) if t[key]]
        lines.append("")
    return "\n".join(lines)


def validate(archive: Archive, needles: list[str], expected: dict[str, int] | None = None) -> dict:
    """Counts that must agree, with each other and with those expected of tables, and whether each phrase is among the first results of a search for it."""
    chunks, turns, messages = (archive.tables[t] for t in ("chunks", "turns", "messages"))
    orphans = chunks.join(turns, ["conversation_id", "turn_index"], "left_anti").count()
    ids = chunks.agg(F.count(F.lit(1)).alias("n"), F.max("chunk_id").alias("last"), F.countDistinct("chunk_id").alias("distinct")).first()
    counts = {name: table.count() for name, table in archive.tables.items()}
    checks = {"chunks_have_turns": orphans == 0, "chunk_ids_dense": ids["n"] == (ids["last"] or 0) == ids["distinct"], "messages_present": messages.limit(1).count() == 1}
    checks |= {f"{name} has {n} rows": counts.get(name) == n for name, n in (expected or {}).items()}
    for needle in needles:
        hits = archive.search(needle, 10, weights=(1.0, 1.0)).where(F.contains(F.lower(F.concat("title", F.lit("\n"), "text")), F.lit(needle.lower())))
        checks[f"finds {needle}"] = hits.limit(1).count() == 1
    return {"checks": checks, "counts": counts, "semantic": archive.semantic_ready, "passed": all(checks.values())}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("trawl").config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    ship(spark)

    def show(value, to: str | None = None) -> None:
        """Print a result, and write it to a file wherever Spark can write."""
        shown = json.dumps(value, indent=2, ensure_ascii=False, default=str)
        print(shown)
        if to:
            store.write_text(spark, to, shown)

    model = getattr(args, "model", None)
    encoder = vectors.ModelEncoder(model) if model else vectors.HashingEncoder()
    if args.command == "build":
        try:
            Archive.build(spark, args.raw, args.archive, encoder if args.semantic or model else None, chunk_chars=args.chunk_chars, chunk_overlap=args.chunk_overlap)
        except FileNotFoundError as e:
            print(e)
            return 2
        show(store.read_manifest(spark, args.archive))
        return 0
    if args.command == "verify":
        result = integrity.verify(spark, args.source, args.copy)
        show(result, args.output)
        return int(not result["all_match"])
    if args.command == "embed":
        tables = store.load(spark, args.archive)
        rows = tables["chunks"].orderBy("chunk_id").limit(args.limit) if args.limit else tables["chunks"]
        tables["vectors"] = vectors.embed(rows, encoder, args.roles, args.max_text_chars, args.batch_size)
        show(store.save(spark, args.archive, tables, store.about(encoder)))
        return 0
    archive = Archive.open(spark, args.archive, encoder, whole=args.command == "validate")
    if args.command == "search":
        records = search_records(archive, args)
        if args.json:
            show({"query": args.query, "count": len(records), "semantic": archive.semantic_ready and not args.lexical_only, "results": records})
        else:
            print(report(args.query, records))
    elif args.command == "context":
        show(archive.context(args.query, args.depth, args.date_from, args.date_to))
    elif args.command == "open":
        show([r.asDict(recursive=True) for r in archive.open_context(args.conversation_id, args.turn, args.before, args.after).collect()])
    elif args.command == "stats":
        show(archive.stats().first().asDict())
    elif args.command == "validate":
        result = validate(archive, args.needles, {name: int(n) for name, _, n in (e.partition("=") for e in args.expect)})
        show(result, args.output)
        return int(not result["passed"])
    elif args.command == "evaluate":
        cases = [c for c in evaluation.load_cases(args.cases) if not args.only or c["name"] in args.only]
        result = evaluation.evaluate(archive.cached(), cases, args.repeat)
        show(result, args.output)
        s = result["summary"]
        return int(not (s["all_deterministic"] and s["all_within_budget"] and s["rejected_leakage"] == 0))
    else:
        logging.basicConfig(level=args.log_level.upper())
        server = service.create_server(archive.cached())
        try:
            server.serve_forever(0.25)
        except KeyboardInterrupt:
            pass
        finally:
            server.server_close()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
