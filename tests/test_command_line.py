import json

from pyspark.sql import functions as F

from eventloom.__main__ import main
from eventloom.sources import backends, watchlist, writers


def test_ingest_twice_then_outbox(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"works": [{"title": "星の海", "aliases": []}], "people": [{"name": "星一郎"}], "settings": {"max_queries": 5}}))
    (tmp_path / "c.json").write_text(json.dumps([{"title": "星の海 舞台挨拶", "url": "https://a.jp/1", "snippet": "2026年9月18日", "published": "2026-08-20"}]))
    args = ["ingest", "--candidates", str(tmp_path / "c.json"), "--watchlist", str(tmp_path / "w.json"), "--state", str(tmp_path / "s"), "--out", str(tmp_path / "o"), "--today", "2026-09-01", "--commit"]
    assert main(args) == 0
    row = spark.read.json(str(tmp_path / "o/digest")).first()
    assert row["count"] == 1 and row.subject == "09/01 新着1件（ウォッチ対象1件）" and row.bullets == "新着1件\n- 星の海 舞台挨拶"
    assert main(["outbox", "--digest", str(tmp_path / "o/digest"), "--out", str(tmp_path / "box")]) == 0 and spark.read.json(str(tmp_path / "box")).count() == 1
    assert main(args) == 0 and spark.read.parquet(str(tmp_path / "o/items")).count() == 0
    assert main(["outbox", "--digest", str(tmp_path / "o/digest"), "--out", str(tmp_path / "none")]) == 0 and not (tmp_path / "none").exists()
    assert main(["queries", "--watchlist", str(tmp_path / "w.json"), "--out", str(tmp_path / "q")]) == 0
    assert [r.value for r in spark.read.text(str(tmp_path / "q")).collect()][:2] == ["星一郎 イベント 上映 決定", "星の海 リバイバル上映"]


def test_searched_and_inbox(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for name, doc in {"a": {"kind": "work", "label": " A ", "searched": False}, "b": {"kind": "person", "label": "B", "aliases": [" x ", ""], "searched": True}, "c": {"label": "C"}, "e": {"label": " "}}.items():
        (tmp_path / "d" / f"{name}.json").write_text(json.dumps(doc))
    assert main(["searched", "--documents", str(tmp_path / "d"), "--out", str(tmp_path / "ops")]) == 0
    assert [r.doc_id for r in spark.read.json(str(tmp_path / "ops")).collect()] == ["a"]
    from eventloom.sources.readers import documents_by_name

    docs = documents_by_name(spark, str(tmp_path / "d"), watchlist.DOCUMENT)
    found = watchlist.from_documents(docs)
    assert [w["title"] for w in found["works"]] == ["A", "C"] and found["people"] == [{"name": "B", "role": "", "aliases": ["x"]}]
    some = watchlist.from_documents(docs, {"settings": {"max_queries": 7}}, pending_only=True)
    assert [w["title"] for w in some["works"]] == ["A"] and not some["settings"]["venue_queries"] and some["settings"]["max_queries"] == 7
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('[{"title": "T"}]')
    assert main(["inbox", "--folder", str(tmp_path / "in"), "--out", str(tmp_path / "rows")]) == 0 and spark.read.json(str(tmp_path / "rows")).first().title == "T"
    done = docs.withColumn("searched", F.lit(True)).select("kind", "label", "role", "aliases", "searched", "doc_id")
    assert watchlist.pending(done).count() == 0


def test_backends():
    def broken(q):
        raise OSError("403")

    assert backends.search("q", [("a", broken), ("b", lambda q: []), ("c", lambda q: [{"q": q}])]) == ([{"q": "q"}], "c")
    assert backends.search("q", [("a", broken)]) == ([], "none")


def test_event_rows(spark):
    item = spark.createDataFrame([("k", "t", None, None, "s", None, None, None)], "key string, title string, url string, summary string, source string, date_note string, date_hint string, unverifiable boolean").withColumns({"categories": F.array(F.lit("goods")), "matches": F.array().cast("array<struct<kind: string, label: string, role: string>>"), "event": F.lit(None).cast("struct<start: date, end: date>"), "published": F.lit(None).cast("date"), "first_seen": F.lit("2026-01-01").cast("date")})
    row = writers.event_rows(item).first()
    assert row.doc_id == "k" and row.url == "" and row.start is None and row.unverifiable is False
    back = writers.items_from_rows(writers.event_rows(item).withColumns({"sources": F.array().cast("array<struct<name: string, url: string, published: string>>"), "calendarEventId": F.lit(None).cast("string")})).first()
    assert back.status == "known" and back.calendar_id == "" and back.year_explicit is False


def _refuse(url):
    """A fetcher for tests: one host refuses, one is gone, others answer."""
    from eventloom.sources.readers import FetchError

    if "refused" in url:
        raise FetchError("no", 403)
    if "gone" in url:
        raise OSError("port 4031 is closed")
    if "feed" in url:
        return f"<rss><item><title>T {url}</title><link> </link><guid/><pubDate>2026-08-30</pubDate></item><item><title>old</title><pubDate>2020-01-01</pubDate></item></rss>".encode()
    return "<p>開催は2026年9月18日から9月20日</p>".encode()


def _candidates(tmp_path, *rows):
    (tmp_path / "c.json").write_text(json.dumps([{"title": "星の海 舞台挨拶 港町劇場", "published": "2026-08-20"} | r for r in rows]))
    (tmp_path / "w.json").write_text(json.dumps({"works": [{"title": "星の海", "aliases": []}]}))
    return ["ingest", "--candidates", str(tmp_path / "c.json"), "--watchlist", str(tmp_path / "w.json"), "--state", str(tmp_path / "s"), "--out", str(tmp_path / "o"), "--today", "2026-09-01"]


def test_confirm_merge_and_outbox_of_news(spark, tmp_path):
    assert main(_candidates(tmp_path, {"url": "https://a.jp/1", "snippet": "9月18日"}, {"url": "https://a.jp/2", "title": "港町劇場 星の海 舞台挨拶", "snippet": "9月18日"}, {"url": "https://refused.jp/3", "title": "星の海 グッズ 予約受付", "snippet": "2026年10月1日"})) == 0
    assert main(["confirm", "--items", str(tmp_path / "o/items"), "--fetcher", "tests.test_command_line:_refuse", "--today", "2026-09-01", "--out", str(tmp_path / "k")]) == 0
    rows = {r.ord: r for r in spark.read.parquet(str(tmp_path / "k/items")).collect()}
    assert len(rows) == 2 and str(rows[0].end) == "2026-09-20" and rows[0].date_confidence == "confirmed" and rows[2].date_confidence == "unreachable" and len(rows[0].sources) == 2
    digest = spark.read.json(str(tmp_path / "k/digest")).first()
    assert digest["count"] == 2 and {r["end_date_exclusive"] for r in spark.read.json(str(tmp_path / "k/calendar")).collect()} == {"2026-09-21", "2026-10-02"}
    # the table holds the first event with the same dates from another source, and the goods with other dates
    (tmp_path / "db").mkdir()
    label = {"kind": "work", "label": "星の海", "role": None}
    (tmp_path / "db" / "old1.json").write_text(json.dumps({"title": "星の海 舞台挨拶 港町劇場", "url": "u", "matches": [label], "categories": ["screening_event"], "start": "2026-09-18", "end": "2026-09-20", "sources": [{"name": "n", "url": "u", "published": ""}], "calendarEventId": "cal"}))
    (tmp_path / "db" / "old2.json").write_text(json.dumps({"title": "星の海 グッズ 予約受付", "url": "v", "matches": [label], "categories": ["goods"], "start": "2026-10-05"}))
    (tmp_path / "db" / "other.json").write_text(json.dumps({"title": "遠い国の話", "url": "w", "matches": [], "categories": ["goods"]}))
    (tmp_path / "v.json").write_text(json.dumps({"old1": 7, "other": 1}))
    assert main(["merge-existing", "--existing", str(tmp_path / "db"), "--versions", str(tmp_path / "v.json"), "--items", str(tmp_path / "k/items"), "--out", str(tmp_path / "ops")]) == 0
    ops = {r.doc_id: r for r in spark.read.json(str(tmp_path / "ops")).collect()}
    assert set(ops) == {"old1", "old2"} and ops["old1"].if_version == 7 and ops["old2"].if_version is None and ops["old1"].calendar_id == "cal"
    args = ["outbox", "--writes", str(tmp_path / "ops"), "--existing", str(tmp_path / "db"), "--today", "2026-09-01", "--out", str(tmp_path / "box")]
    assert main(args) == 0
    row = spark.read.json(str(tmp_path / "box")).first()
    # an explicit year in a published article is trusted over the table's: only the goods' dates changed
    assert row["count"] == 1 and "グッズ" in row.bullets and "舞台挨拶" not in row.body
    assert main(["to-writes", "--items", str(tmp_path / "o/items"), "--out", str(tmp_path / "w")]) == 0
    assert {r.op for r in spark.read.json(str(tmp_path / "w")).collect()} == {"set"} and spark.read.json(str(tmp_path / "w")).count() == 3


def test_from_db(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.json").write_text(json.dumps({"kind": "work", "label": "A", "searched": True}))
    (tmp_path / "f.json").write_text(json.dumps({"settings": {"max_queries": 3}}))
    assert main(["from-db", "--documents", str(tmp_path / "d"), "--fallback", str(tmp_path / "f.json"), "--out", str(tmp_path / "w")]) == 0
    found = watchlist.from_file(spark, str(tmp_path / "w"))
    assert found["works"] == [{"title": "A", "aliases": []}] and found["settings"]["max_queries"] == 3
    assert main(["from-db", "--documents", str(tmp_path / "d"), "--pending-only", "--out", str(tmp_path / "p")]) == 2


def test_collecting(spark, tmp_path, capfd):
    def lines(name, *rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
        return str(tmp_path / name)

    feeds = lines("feeds.json", {"name": "a", "url": "https://feed/1"}, {"name": "b", "url": "https://refused/2"})
    run = ["feeds", "--fetcher", "tests.test_command_line:_refuse", "--today", "2026-09-01", "--out", str(tmp_path / "rows")]
    assert main([*run, "--feeds", feeds]) == 0
    rows = spark.read.json(str(tmp_path / "rows")).collect()
    # a blank first link isn't passed over for a later name of the field
    assert [(r.title, r.url) for r in rows] == [("T https://feed/1", "")] and spark.read.json(str(tmp_path / "rows-failed")).first().source == "b"
    assert main([*run, "--feeds", lines("bad.json", {"name": "b", "url": "https://refused/2"})]) == 1
    posts = lines("posts.json", {"url": "p1", "user": "u", "text": "", "ord": 2, "backend": "api"}, {"url": "p1", "user": "v", "text": "t", "posted": "2026-08-01", "ord": 1, "backend": "api"})
    assert main(["posts", "--found", posts, "--out", str(tmp_path / "posts")]) == 0
    row = spark.read.json(str(tmp_path / "posts")).first()
    assert (row.title, row.snippet, row.source, row.published) == ("t", "t", "X (@v)", "2026-08-01")
    assert main(["posts", "--found", lines("none.json"), "--out", str(tmp_path / "no")]) == 1
    sources = lines("sources.json", {"kind": "feed", "name": "a", "url": "https://feed/1"}, {"kind": "feed", "name": "b", "url": "https://gone"})
    assert main(["preflight", "--sources", sources, "--fetcher", "tests.test_command_line:_refuse"]) == 0
    assert "|feed|1|2|" in capfd.readouterr().out.replace(" ", "")


def test_error_kinds():
    from urllib.error import HTTPError, URLError

    from eventloom.sources.readers import FetchError, error_kind

    kinds = [error_kind(e) for e in (HTTPError("http://403", 404, "x", None, None), HTTPError("u", 407, "x", None, None), URLError("Tunnel connection failed: 403 Forbidden"), OSError("http://h:4030 timed out"), FetchError("x", 403), ValueError("403"), OSError("HTTP 403"))]
    assert kinds == ["unreachable", "blocked", "blocked", "unreachable", "blocked", "unreachable", "blocked"]


def test_state_survives_a_broken_snapshot(spark, tmp_path):
    import shutil

    import pytest

    from eventloom.sources import snapshots

    folder = f"file://{tmp_path}/s"
    one = spark.createDataFrame([("k", None, None, "t", "u", None)], snapshots.SEEN)
    assert snapshots.read(spark, folder).count() == 0
    for _ in range(3):
        snapshots.write(snapshots.read(spark, folder).unionByName(one), folder)
    assert snapshots.read(spark, folder).count() == 3 and not (tmp_path / "s/state-0").exists()
    (tmp_path / "s/state-3").mkdir()  # a job that ended while it wrote
    assert snapshots.read(spark, folder).count() == 3 and snapshots.write(one, folder) == 3 and snapshots.read(spark, folder).count() == 1
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, folder, number=9)
    for k in (2, 3):
        (tmp_path / f"s/state-{k}/_SUCCESS").unlink()
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, folder)
    shutil.rmtree(tmp_path / "s")
    assert main(["state", "--out", str(tmp_path / "s")]) == 0 and snapshots.read(spark, folder).count() == 0


def test_dates_near_the_last_year():
    from datetime import date

    from eventloom.functions.dates import DateScanner

    assert list(DateScanner("9999年12月31日 3週間").ranges(None)) == [(date(9999, 12, 31), None, "9999年12月31日", True)]
    assert list(DateScanner("9999年12月1日 3週間").ranges(None))[0][1] == date(9999, 12, 21)
