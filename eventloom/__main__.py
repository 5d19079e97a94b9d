"""Command line: ``python -m eventloom COMMAND``. Paths may be in any store that Spark reads."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.operators import digest as G
from eventloom.operators.merge import mark_searched
from eventloom.operators.planner import post_queries, search_queries
from eventloom.operators.state import prune
from eventloom.plans import flows
from eventloom.plans.ingest import Config, run
from eventloom.shared import materialize, release, ship
from eventloom.sources import readers, snapshots, watchlist, writers

WRITES = "op string, doc_id string, if_version long, title string, url string, summary string, source string, published string, categories array<string>, matches array<struct<kind: string, label: string, role: string>>, start date, end date, date_note string, date_hint string, unverifiable boolean"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="eventloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("ingest", help="candidates to new and updated items, digest and state")
    for name in ("--candidates", "--watchlist", "--state", "--out"):
        c.add_argument(name, required=True)
    c.add_argument("--today", type=date.fromisoformat, required=True)
    c.add_argument("--commit", action="store_true", help="write the state, without entries past their time")
    c = sub.add_parser("queries", help="search queries, one a line")
    c.add_argument("--watchlist", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--posts", action="store_true", help="those for posts")
    c = sub.add_parser("inbox", help="rows of a folder's JSON files, after those of a file")
    c.add_argument("--folder", required=True)
    c.add_argument("--merge-into")
    c.add_argument("--out", required=True)
    c = sub.add_parser("searched", help="updates that mark entries as searched; exit code 2 if none is pending")
    c.add_argument("--documents", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--all", action="store_true")
    c = sub.add_parser("outbox", help="the row to send, if there is anything to say")
    c.add_argument("--digest", help="a digest as it is")
    c.add_argument("--writes", help="instead: a write list of merge-existing; only what is news is told")
    c.add_argument("--existing", help="the events table before the writes, as a folder of documents")
    c.add_argument("--today", type=date.fromisoformat)
    c.add_argument("--out", required=True)
    c.add_argument("--kind", default="full")
    c = sub.add_parser("confirm", help="items held against article bodies, and one row for each event; a new digest")
    for name in ("--items", "--out"):
        c.add_argument(name, required=True)
    c.add_argument("--today", type=date.fromisoformat, required=True)
    _fetched(c, "--bodies", "JSON rows (url, body, error_kind, error_detail)")
    c = sub.add_parser("from-db", help="the watch list of a folder of documents; exit code 2 if none is pending")
    for name in ("--documents", "--out"):
        c.add_argument(name, required=True)
    c.add_argument("--fallback", help="a watch list whose settings are kept")
    c.add_argument("--pending-only", action="store_true")
    c = sub.add_parser("to-writes", help="items as set operations")
    for name in ("--items", "--out"):
        c.add_argument(name, required=True)
    c = sub.add_parser("merge-existing", help="items folded into the events table, as a write list")
    for name in ("--existing", "--versions", "--items", "--out"):
        c.add_argument(name, required=True)
    c = sub.add_parser("feeds", help="candidates of feeds; exit code 1 if all fail")
    c.add_argument("--out", required=True)
    c.add_argument("--today", type=date.fromisoformat, required=True)
    c.add_argument("--max-age-days", type=int, default=14)
    _fetched(c, "--files", "a folder of feeds, each named by its source")
    c.add_argument("--feeds", help="with --fetcher: JSON rows (name, url)")
    c = sub.add_parser("posts", help="candidates of found posts; exit code 1 if there are none")
    for name in ("--found", "--out"):
        c.add_argument(name, required=True, help="JSON rows (url, user, posted, text, ord, backend)" if name == "--found" else None)
    c = sub.add_parser("state", help="the state of a control document, as a first snapshot")
    c.add_argument("--document", help="none: an empty state")
    c.add_argument("--out", required=True)
    c = sub.add_parser("preflight", help="which sources can be reached")
    c.add_argument("--sources", required=True, help="JSON rows (kind, name, url)")
    c.add_argument("--fetcher", required=True)
    return p


def _fetched(c: argparse.ArgumentParser, option: str, what: str) -> None:
    c.add_argument(option, help=what)
    c.add_argument("--fetcher", help="instead: module:function that returns a URL's bytes")


def _function(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _digest(rows: DataFrame, today: date, out: str) -> None:
    """A digest of flat rows and its calendar entries."""
    watched = rows.withColumn("watched", F.coalesce(F.size("matches"), F.lit(0)) > 0)
    writers.digest(watched, F.lit(today)).write.mode("overwrite").json(f"{out}/digest")
    G.calendar_events(watched).write.mode("overwrite").json(f"{out}/calendar")


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return readers.documents_by_name(spark, folder, readers.EVENT)


def _feeds(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.fetcher:
        fetch = _function(args.fetcher)
        named = spark.read.schema("name string, url string").json(args.feeds)
        got = readers.fetched(named, fetch)
        failed = got.filter("error_kind IS NOT NULL").select(F.col("name").alias("source"), F.col("error_detail").alias("error"))
        files = got.filter("error_kind IS NULL").select(F.col("name").alias("source"), F.col("raw").alias("content"))
    else:
        files = spark.read.format("binaryFile").load(args.files).select(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("source"), "content")
        failed = spark.createDataFrame([], "source string, error string")
    rows = materialize(readers.feeds(files), "feeds")
    failed = failed.unionByName(rows.filter("error IS NOT NULL").select("source", "error"))
    kept = rows.filter("error IS NULL").drop("error")
    kept = readers.recent(kept, D.parse_published(F.col("published")), F.lit(args.today), args.max_age_days) if args.max_age_days else kept
    kept.write.mode("overwrite").json(args.out)
    failed.write.mode("overwrite").json(f"{args.out}-failed")
    return 1 if not failed.isEmpty() and rows.filter("error IS NULL").isEmpty() else 0


def main(argv: list[str] | None = None) -> int:
    """Runs one command. What it wrote to the shared folder on the way goes at its end."""
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    ship(spark)
    try:
        return _run(spark, args)
    finally:
        release(spark)


def _run(spark: SparkSession, args: argparse.Namespace) -> int:
    if args.command == "ingest":
        found = watchlist.from_file(spark, args.watchlist)
        s = found["settings"]
        config = Config(args.today, found["works"], found["people"], s["categories"], s["include_unmatched"], s["drop_past_events"])
        rows = readers.candidates(spark, args.candidates).withColumn("ord", F.monotonically_increasing_id())
        items, after = run(rows, snapshots.read(spark, args.state), config)
        items.write.mode("overwrite").parquet(f"{args.out}/items")
        flat = spark.read.parquet(f"{args.out}/items").withColumns({"start": F.col("event.start"), "end": F.col("event.end")})
        _digest(flat, args.today, args.out)
        if args.commit:
            snapshots.write(prune(after, F.lit(args.today)), args.state)
    elif args.command == "queries":
        found = watchlist.from_file(spark, args.watchlist)
        s = found["settings"]
        works = spark.createDataFrame([(w["title"], i) for i, w in enumerate(found["works"])], "name string, ord long")
        people = spark.createDataFrame([(p["name"], i) for i, p in enumerate(found["people"])], "name string, ord long")
        plan = post_queries(works, people, s["max_x_queries"], s["venue_queries"]) if args.posts else search_queries(works, people, s["max_queries"], s["venue_queries"], s["include_unmatched"])
        writers.lines(plan, args.out)
    elif args.command == "inbox":
        rows = readers.inbox(spark, args.folder)
        if args.merge_into:
            rows = readers.append(readers.candidates(spark, args.merge_into), rows.drop("ord"))
        rows.write.mode("overwrite").json(args.out)
    elif args.command == "searched":
        ops = mark_searched(readers.documents_by_name(spark, args.documents, watchlist.DOCUMENT), not args.all)
        if ops.isEmpty():
            return 2
        writers.operations(ops, args.out)
    elif args.command == "outbox":
        if args.writes:
            writes = spark.read.schema(WRITES).json(args.writes)
            # the list has no order; events are told by date, then by their ids
            digest = flows.news_digest(writes.withColumn("ord", F.col("doc_id")), _events(spark, args.existing) if args.existing else spark.createDataFrame([], f"doc_id string, {readers.EVENT}"), F.lit(args.today or date.today()))
        else:
            digest = spark.read.json(args.digest)
        rows = G.outbox_row(digest, F.current_timestamp(), args.kind)
        if not rows.isEmpty():
            rows.write.mode("append").json(args.out)
    elif args.command == "confirm":
        items = spark.read.parquet(args.items)
        if args.fetcher:
            bodies = materialize(readers.bodies(items.filter("url <> ''"), _function(args.fetcher)), "bodies", wide=True)
        else:
            bodies = spark.read.schema("url string, body string, error_kind string, error_detail string").json(args.bodies)
        flows.confirmed(items, bodies).write.mode("overwrite").parquet(f"{args.out}/items")
        rows = spark.read.parquet(f"{args.out}/items")
        _digest(rows, args.today, args.out)
        rows.groupBy("date_confidence").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(f"{args.out}/tally")
    elif args.command == "from-db":
        fallback = watchlist.from_file(spark, args.fallback) if args.fallback else None
        found = watchlist.from_documents(readers.documents_by_name(spark, args.documents, watchlist.DOCUMENT), fallback, args.pending_only)
        if not found["works"] and not found["people"]:
            if args.pending_only:
                return 2
            raise SystemExit("the documents hold no watch list; keep the one in use")
        spark.createDataFrame([(json.dumps(found, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(args.out)
    elif args.command == "to-writes":
        writers.operations(flows.as_writes(_flat_items(spark, args.items)), args.out)
    elif args.command == "merge-existing":
        fresh = flows.as_members(_flat_items(spark, args.items))
        writers.operations(flows.merge_existing(_events(spark, args.existing), fresh, readers.versions(spark, args.versions)), args.out)
    elif args.command == "feeds":
        return _feeds(spark, args)
    elif args.command == "posts":
        found = spark.read.schema("url string, user string, posted date, text string, ord long, backend string").json(args.found)
        rows = materialize(readers.post_candidates(found), "posts")
        readers.collected(found)[1].write.mode("overwrite").json(f"{args.out}-backends")
        rows.write.mode("overwrite").json(args.out)
        return 1 if rows.isEmpty() else 0
    elif args.command == "state":
        docs = spark.read.text(args.document, wholetext=True) if args.document else None
        snapshots.write(readers.seen_state(spark, docs), args.out)
    elif args.command == "preflight":
        named = spark.read.schema("kind string, name string, url string").json(args.sources)
        got = readers.fetched(named, _function(args.fetcher))
        readers.reachability(got.select("kind", F.col("error_kind").isNull().alias("ok"))).orderBy("kind").show(1000, False)
    return 0


def _flat_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of a run, or of its confirmation, where the event's fields are columns of their own."""
    items = spark.read.parquet(path)
    if "event" in items.columns:
        return items
    return items.withColumn("event", F.when(F.col("start").isNotNull(), F.struct("start", "end", F.lit("").alias("raw"), "year_explicit")))


if __name__ == "__main__":
    sys.exit(main())
