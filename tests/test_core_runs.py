"""Runs over several steps: ingest with state, confirmation, clusters, merges, digests, sources, streams."""

import json
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from eventloom.operators import cluster as C
from eventloom.operators import confirm, digest, merge
from eventloom.operators import state as S
from eventloom.plans.ingest import Config, run
from eventloom.sources import readers as I
from eventloom.streaming import inbox

TODAY = date(2026, 9, 1)
CONFIG = Config(TODAY, works=[{"title": "星の海", "aliases": []}])


def candidates(spark, *rows):
    full = [(i, r.get("title", "星の海 リバイバル上映"), r.get("url", f"https://a.jp/{i}"), r.get("summary", ""), r.get("snippet", ""), "s", r.get("published", "2026-08-20")) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "ord long, title string, url string, summary string, snippet string, source string, published string")


def go(spark, *rows, seen=None, config=CONFIG):
    items, after = run(candidates(spark, *rows), seen if seen is not None else spark.createDataFrame([], I.SEEN), config)
    return {r.ord: r for r in items.collect()}, after


def test_new_known_updated(spark):
    first, seen = go(spark, {"url": "https://a.jp/x?utm_source=q"}, {"url": "https://a.jp/x"}, {"title": "他の話 舞台挨拶"}, {"url": "https://a.jp/search/1"})
    assert list(first) == [0] and first[0].status == "new" and first[0].event is None
    again, seen2 = go(spark, {"url": "https://a.jp/x"}, seen=seen)
    assert not again
    dated, _ = go(spark, {"url": "https://a.jp/x", "snippet": "2026年9月18日"}, seen=seen2)
    assert dated[0].status == "updated" and dated[0].event.start == date(2026, 9, 18)


def test_dates_in_a_run(spark):
    got, _ = go(
        spark,
        {"snippet": "9月18日公開"}, {"snippet": "9月18日公開", "published": ""}, {"snippet": "2026年8月1日から8月20日"}, {"snippet": "2026年8月1日から9月20日"}, {"published": "2026-03-01", "snippet": "2026年9月18日"},
        {"published": "", "snippet": "2026年11月開催"}, {"snippet": "2029年1月5日"}, {"published": ""}, {"snippet": "公開は2026年10月", "published": "2026-03-05"},
    )
    assert got[0].event.start == date(2026, 9, 18) and got[1].event is None and got[1].date_hint == "9月18日" and got[1].unverifiable
    assert 2 not in got and got[3].event.end == date(2026, 9, 20) and 4 not in got
    assert got[5].date_hint == "2026年11月" and not got[5].unverifiable and got[6].event is None and got[6].date_hint == "2029年1月5日"
    assert got[7].unverifiable and got[8].date_hint == "2026年10月"


def test_options(spark):
    assert 0 in go(spark, {"title": "他の話 舞台挨拶"}, config=Config(TODAY, include_unmatched=True))[0]
    assert 0 in go(spark, {"snippet": "2026年8月25日"}, config=Config(TODAY, works=CONFIG.works, drop_past_events=False))[0]


def test_prune(spark):
    seen = spark.createDataFrame([("a", TODAY, date(2026, 1, 4), "", "", None), ("b", TODAY, date(2026, 1, 3), "", "", None)], I.SEEN)
    assert [r.key for r in S.prune(seen, F.lit(TODAY)).collect()] == ["a"]


def test_confirm(spark):
    event = "struct<start: date, end: date, raw: string, year_explicit: boolean>"
    e = (date(2026, 9, 30), None, "", False)
    items = spark.createDataFrame([("u1", e, None), ("u2", e, None), ("u3", e, None), ("u4", e, None), ("u5", None, "9月30日"), ("", e, None), ("u6", e, None), ("u7", None, None)], f"url string, event {event}, date_hint string").withColumns({"date_note": F.lit("n"), "published": F.lit(date(2026, 8, 1))})
    bodies = spark.createDataFrame([("u1", "開催は2026年9月30日〜10月2日", None, None), ("u2", "10月1日のみ", None, None), ("u3", "9月30日に", None, None), ("u4", None, "blocked", "403"), ("u5", "2025年9月30日", None, None), ("u6", "本文", None, None), ("u7", "2026年9月30日", None, None)], "url string, body string, error_kind string, error_detail string")
    got = {r.url: r for r in confirm.confirm(items, bodies).collect()}
    assert [got[u].date_confidence for u in ("u1", "u2", "u3", "u4", "u5", "", "u6", "u7")] == ["confirmed", "contradicted", "consistent", "unreachable", "confirmed", "inconclusive", "inconclusive", "inconclusive"]
    assert got["u1"].event.end == date(2026, 10, 2) and got["u1"].date_note == "" and got["u2"].event is None and got["u4"].event.start == date(2026, 9, 30)
    assert got["u5"].event.start == date(2025, 9, 30) and got["u5"].date_hint is None and "遮断" in got["u4"].body_note


ITEM = "ord long, title string, url string, summary string, source string, published string, categories array<string>, matches array<struct<kind: string, label: string, role: string>>, start date, end date, year_explicit boolean, date_note string, date_hint string, date_confidence string, unverifiable boolean, sources array<struct<name: string, url: string, published: string>>, status string, doc_id string, calendar_id string"


def item(n, title, label="星の海", start=None, end=None, **x):
    return (n, title, x.get("url", f"u{n}"), x.get("summary", ""), x.get("source", f"s{n}"), x.get("published", ""), x.get("categories", ["exhibition"]), [("work", label, None)], start, end, x.get("explicit", False), "", x.get("hint", ""), x.get("sure", ""), x.get("unverifiable", False), x.get("sources", []), x.get("status", "new"), x.get("doc_id"), x.get("calendar", ""))


def test_collapse(spark):
    rows = [
        item(0, "星の海展 港町博物館 灯台企画", start=date(2026, 11, 3), end=date(2026, 11, 30), published="2026-08-01"),
        item(1, "港町博物館にて灯台企画の催し", start=date(2026, 11, 6), end=date(2026, 12, 6), published="2026-08-20", unverifiable=True),
        item(2, "全く別のグッズ 予約", categories=["goods"]),
        item(3, "公式 (@hoshi)", summary="港町博物館で開催", hint="2026年11月"),
        item(4, "港町博物館 灯台企画 の催し", label="他作品", start=date(2026, 11, 6)),
        item(5, "「星空の大展示」始まる", start=date(2026, 10, 1)), item(6, "話題: 星空の大展示 へ行く", start=date(2027, 1, 1)),
    ]
    got = {r.cluster: r for r in C.collapse(spark.createDataFrame(rows, ITEM)).collect()}
    assert set(got) == {0, 2, 4, 5}
    assert got[0].start == date(2026, 11, 6) and [c.start for c in got[0].date_conflict] == [date(2026, 11, 3)] and got[0].date_conflict[0].source == "s0"
    assert [s.url for s in got[0].sources] == ["u1", "u0", "u3"] and not got[0].unverifiable and got[0].status == "new"


@pytest.mark.parametrize("seed", range(3))
def test_large_labels_give_the_same_pairs(spark, seed):
    rng = random.Random(seed)
    words = ["港町博物館", "灯台企画", "星空", "展示", "大展示会", "開催", "音楽祭典", "特別", "oak", "Lighthouse", "house", "コンサート", "海", "上映会", "限定グッズ"]
    rows = []
    for i in range(150):
        title = " ".join(rng.choice(words) for _ in range(rng.randrange(6)))
        if rng.random() < 0.3:
            title += f"「{rng.choice(words)}{rng.choice(words)}」"
        day = date(2026, 10, 1 + rng.randrange(30)) if rng.random() < 0.6 else None
        labels = [x for x in ("星の海", "灯台企画", "他作品") if rng.random() < 0.5]
        rows.append((i, title, "", labels, rng.sample(["goods", "concert"], rng.randrange(3)), day, None, rng.choice(["2026年10月", ""])))
    df = spark.createDataFrame(rows, "ord long, title string, summary string, labels array<string>, categories array<string>, start date, end date, date_hint string")
    signalled = C.signals(df)
    want = sorted(map(tuple, C.same_event_pairs(signalled, 10**9).collect()))
    assert want and sorted(map(tuple, C.same_event_pairs(signalled, 0).collect())) == want and sorted(map(tuple, C.same_event_pairs(signalled, 75).collect())) == want


def test_merge_and_news(spark):
    d = date(2026, 11, 6)
    rows = [
        item(0, "港町博物館 灯台企画", start=d, doc_id="b", calendar="cal", status="known", sources=[("手", "x9", "")]), item(1, "灯台企画 港町博物館", start=d, doc_id="a", status="known"), item(2, "港町博物館の灯台企画", start=d, published="2026-08-01"),
        item(3, "孤島音楽祭典 開幕宣言", doc_id="c", status="known"), item(4, "山頂展望台 夜間公開", start=d),
    ]
    df = spark.createDataFrame(rows, ITEM)
    labelled = df.withColumn("labels", F.transform("matches", lambda m: m.label))
    members = C.clusters(df, C.same_event_pairs(C.signals(labelled)))
    versions = spark.createDataFrame([("b", 4), ("a", 7)], "doc_id string, version int")
    ops = merge.merge_clusters(members, versions)
    got = {(r.op, r.doc_id): r for r in ops.collect()}
    assert len(got) == 3 and got["set", "b"].if_version == 4 and got["delete", "a"].if_version == 7 and got["set", "b"].calendar_id == "cal"
    assert {s.url for s in got["set", "b"].sources} == {"x9", "u1", "u2"}
    new = next(r for (op, k), r in got.items() if op == "set" and k != "b")
    assert new.if_version is None and new.title == "山頂展望台 夜間公開"
    old = spark.createDataFrame([("b", "2026-11-06", "")], "doc_id string, start string, end string")
    assert [(r.doc_id, r.status) for r in merge.news(ops, old).collect()] == [(new.doc_id, "new")]
    moved = spark.createDataFrame([("b", "2026-11-03", None)], "doc_id string, start string, end string")
    assert {r.status for r in merge.news(ops, moved).collect()} == {"new", "updated"}


def test_digest(spark):
    rows = [(i, f"題 {i}", date(2026, 10, 20 - i) if i else None, None, "", "", "", ["goods"], [("work", "W", "")], "new", None, i == 1) for i in range(10)]
    items = spark.createDataFrame(rows, "ord long, title string, start date, end date, date_note string, summary string, url string, categories array<string>, matches array<struct<kind: string, label: string, role: string>>, status string, date_hint string, watched boolean")
    lines = digest.push_bullets(items.withColumn("g", F.lit(1)), ["g"]).first().bullets.split("\n")
    assert lines == ["新着10件", *(f"- 題 {i}" for i in (9, 8, 7, 6, 5, 4)), "- ほか4件"]
    assert digest.push_line(items).first().push == "10/11 題 9 ほか9件"
    body = digest.email_body(items, F.lit(TODAY)).first().body
    assert body.startswith("2026年9月1日 時点の新着イベント情報です。\n\n■ 10/11  題 9  NEW\n   [グッズ・商品] W\n") and "うち1件は" in body
    assert digest.email_body(items.limit(0), F.lit(TODAY)).first().body == "新着はありませんでした。"
    assert digest.calendar_events(items).count() == 9


def test_feeds(spark):
    rss = b"<rss><channel><item><title>A</title><link>u</link><description>d</description><pubDate>p</pubDate></item><item><link>no title</link></item></channel></rss>"
    atom = b'<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>first</id><title>B</title><link href="second"/><summary>s</summary><updated>q</updated></entry></feed>'
    rows = I.feeds(spark.createDataFrame([("r", rss), ("a", atom), ("bad", b"<x")], "source string, content binary")).collect()
    assert [(r.source, r.title, r.url, r.published) for r in rows if r.title] == [("r", "A", "u", "p"), ("a", "B", "first", "q")] and [r.source for r in rows if r.error] == ["bad"]


def test_inbox_and_states(spark, tmp_path):
    for name, text in {"b.json": '[{"title": "T2"}, 5, {"title": "T3", "url": "u"}]', "a.json": '[{"title": "T1"}]', "c.json": "{broken", "d.json": '{"title": "no array"}'}.items():
        (tmp_path / name).write_text(text)
    rows = I.inbox(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.title for r in rows] == ["T1", "T2", "T3"]
    doc = spark.createDataFrame([(json.dumps({"entries": {"k": {"first_seen": "2026-01-01", "last_seen": "2026-01-02", "title": "t", "url": "u"}}}),), ("nonsense",), ('{"entries": 5}',)], "value string")
    assert [(r.key, r.title) for r in I.seen_state(spark, doc).collect()] == [("k", "t")] and I.seen_state(spark, None).count() == 0


def test_pages_and_bodies(spark):
    text = "日本"
    pages = spark.createDataFrame([(1, b'<meta charset="Shift_JIS">' + text.encode("cp932")), (2, text.encode()), (3, b"charset=euc-jp " + text.encode("euc_jp")), (4, b"\xff")], "k int, raw binary")
    got = {r.k: r.t for r in pages.select("k", I.decode_page("raw").alias("t")).collect()}
    assert got[1].endswith(text) and got[2] == text and got[3].endswith(text) and got[4] == "�"

    def fetch(url):
        if url == "no":
            raise OSError("HTTP 403")
        return b"<p>x</p>"

    rows = {r.url: r for r in I.bodies(spark.createDataFrame([("no",), ("yes",), ("yes",)], "url string"), fetch).collect()}
    assert rows["no"].error_kind == "blocked" and rows["yes"].body == "x" and len(rows) == 2
    ch = I.channel_feeds(spark.createDataFrame([("a", '"externalId":"UC' + "x" * 22 + '"'), ("b", "")], "name string, html string")).collect()
    assert ch[0].url.endswith("UC" + "x" * 22) and ch[1].url is None


@pytest.mark.parametrize("consume", [False, True])
def test_stream(spark, tmp_path, consume):
    (tmp_path / "in").mkdir()

    def put(name, **row):
        (tmp_path / "in" / name).write_text(json.dumps([{"title": "星の海 リバイバル上映", "published": "2026-08-20"} | row]))

    def step():
        q = inbox.start(inbox.files(spark, f"file://{tmp_path}/in", consume), str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda n: CONFIG)
        q.awaitTermination(120)
        assert q.exception() is None

    put("1.json", url="https://a.jp/x")
    step()
    put("2.json", url="https://a.jp/x?utm_source=a", snippet="2026年9月18日")
    step()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()
    assert [(r.batch, r.status) for r in got] == [(0, "new"), (1, "updated")]


def test_release(spark):
    import os

    from eventloom.shared import materialize, release, work_dir

    assert materialize(spark.range(3), "x").count() == 3
    assert os.path.isdir(work_dir(spark).removeprefix("file:"))
    release(spark)
    assert not os.path.exists(work_dir(spark).removeprefix("file:"))
