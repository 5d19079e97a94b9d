"""Text, URL and date functions on small cases of our own."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from eventloom.functions import dates as D
from eventloom.functions import text as X
from eventloom.functions import urls as U
from eventloom.operators import rules as R


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'date' if isinstance(v, date) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], ddl).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "want"),
    [("『星 の海』（再）", "星の海再"), ("ＡＢＣ・ｄ－ｅ", "abcde"), ("Straße\nX", "strasse\nx"), ("スタ ー ト", "スタト"), (None, ""), ("", "")],
)
def test_normalize(spark, text, want):
    assert one(spark, X.normalize(F.col("t")), t=text) == want


@pytest.mark.parametrize(("key", "want"), [("劇場版星", "劇場版星"), ("劇場版星海", "星海"), ("劇場版総集編星海", "星海"), ("映画", "映画"), ("アニメ映画祭典", "祭典")])
def test_loosen(spark, key, want):
    assert one(spark, X.loosen(F.col("k")), k=key) == want


def test_site_suffix_and_clip(spark):
    assert one(spark, X.strip_site_suffix(F.col("t")), t="星の海 上映 - コミックナタリー | oricon  news ") == "星の海 上映"
    assert one(spark, X.clip(F.col("t"), 5), t=" a  b　c\td ") == "a b …" and one(spark, X.clip(F.col("t"), 9), t=None) == ""


@pytest.mark.parametrize(
    ("url", "want"),
    [(" https://a.jp/x/?utm_source=1#f ", "https://a.jp/x"), ("https://a.jp/x?a=1&fbclid=2&b=3", "https://a.jp/x?a=1&b=3"), ("/x?utm_source=1&b=2", "/x&b=2"), ("https://a.jp/x?ref=1", "https://a.jp/x"), (None, ""), ("https://a.jp//", "https://a.jp")],
)
def test_canonical_url(spark, url, want):
    assert one(spark, U.canonical_url(F.col("u")), u=url) == want


@pytest.mark.parametrize(("url", "want"), [("https://a.jp/search/?q=1", True), ("https://a.jp/Tag", True), ("https://a.jp/tagged/1", False), ("https://a.jp/?KEYWORD=x", True), ("https://a.jp/news/1", False), (None, False)])
def test_listing(spark, url, want):
    assert one(spark, U.is_listing_url(F.col("u")), u=url) is want


def test_posts(spark):
    number = (1_700_000_000_000 - U.POST_EPOCH_MS) << 22  # 2023-11-14 22:13:20 UTC
    url = f"https://mobile.twitter.com/abc/statuses/{number}"
    assert one(spark, U.published_from_post(F.col("u")), u=url) == date(2023, 11, 15)
    assert one(spark, U.post_user(F.col("u")), u=url) == "abc"
    for bad in ("https://x.com/abc/status/1234567890", "https://a.jp/abc/status/123456789012", f"https://x.com/a/status/{'9' * 25}", None):
        assert one(spark, U.published_from_post(F.col("u")), u=bad) is None
    beyond = (4_102_444_800_000 - U.POST_EPOCH_MS) << 22  # no long holds it
    assert one(spark, F.year(U.posted_at(U.post_id(F.col("u")))), u=f"https://x.com/a/status/{beyond}") == 2100


@pytest.mark.parametrize(("url", "want"), [("https://a.jp/2026/08/26/x", date(2026, 8, 26)), ("https://a.jp/a-20260826.html", date(2026, 8, 26)), ("https://a.jp/120260826", None), ("https://a.jp/2026/13/26/2026-02-01", date(2026, 2, 1)), ("https://20260101.jp/x", None), ("https://a.jp/2027/01/01", None), (None, None)])
def test_path_date(spark, url, want):
    assert one(spark, U.published_from_path(F.col("u"), F.lit(date(2026, 9, 1))), u=url) == want


def test_html(spark):
    page = "<style>p{}</style><SCRIPT>x</SCRIPT><p>a&amp;lt; b</p><div>é&hellip;</div><br><br><br><br>z"
    assert one(spark, X.html_to_text(F.col("h")), h=page) == "a&lt; b\n é…\n\nz".replace("\n é", "\n é")
    assert one(spark, X.html_to_text(F.col("h")), h=None) == ""


def test_terms_and_names(spark):
    assert one(spark, X.distinctive_terms(F.col("t"), F.col("l")), t="星海城 展覧会 ロケット発射 ABC xy", l=["星海"]) == ["ロケット", "発射", "ABC"]
    assert one(spark, X.quoted_names(F.col("t"), F.col("l")), t="「星の海展」と『星の海』「短い」", l=["星の海"]) == ["星の海展"]
    assert one(spark, X.shared_term_count(F.col("a"), F.col("b")), a=["小田原城", "原点辿", "別"], b=["小田原", "原点"]) == 2
    assert one(spark, X.related(F.col("a"), F.col("b")), a="abcde", b="xcdey") is True and one(spark, X.related(F.col("a"), F.col("b")), a="ab", b="ac") is False
    assert one(spark, X.signal_text(F.col("t"), F.col("s")), t="公式 (@abc)", s="催し") == "公式 (@abc) 催し"


def ranges(text, ref=None):
    return [(a.isoformat(), b and b.isoformat(), y) for a, b, _, y in D.DateScanner(text).ranges(ref)]


def test_scanner():
    ref = date(2026, 8, 1)
    assert ranges("2026年9月18日(金)より1週間限定") == [("2026-09-18", "2026-09-24", True)]
    assert ranges("9月18日～24日", ref) == [("2026-09-18", "2026-09-24", False)] and ranges("9月18日") == []
    assert ranges("２０２６/１０/２３公開") == [("2026-10-23", None, True)]
    assert ranges("12月28日から1月5日", date(2026, 12, 1)) == [("2026-12-28", "2027-01-05", False)]
    assert ranges("1月5日", date(2026, 12, 20)) == [("2027-01-05", None, False)] and ranges("12月30日", date(2026, 1, 5)) == [("2025-12-30", None, False)]
    assert ranges("10/3(金)", date(2026, 9, 1)) == [] and ranges("10/3(金)", date(2025, 12, 1)) == [("2025-10-03", None, False)]
    assert ranges("2026年10月3日(金)", date(2025, 10, 1)) == [("2025-10-03", None, False)]
    assert ranges("9月2日から3日間", ref) == [("2026-09-02", "2026-09-03", False)] and ranges("9月18日から3日間", ref) == [("2026-09-18", "2026-09-20", False)]
    assert ranges("13月5日", ref) == [("2026-03-05", None, False)] and ranges("2026年2月30日") == [] and ranges("") == [] and ranges(None) == []
    assert ranges("2026年9月1日から2ヶ月") == [("2026-09-01", "2026-10-30", True)]
    assert D.DateScanner("2026年9月から発売").month(None) == ("2026年9月", True) and D.DateScanner("11月決定").month(date(2026, 8, 1)) == ("2026年11月", False) and D.DateScanner("9月18日").month(None) is None
    assert D.DateScanner("2026年1月2日 3/4").bare() == "3/4"


def test_infer_year_column_equals_scanner(spark):
    rng, rows = random.Random(4), []
    for _ in range(800):
        ref = date(2023, 1, 1).toordinal() + rng.randrange(1200)
        rows.append((rng.randrange(1, 13), rng.randrange(1, 32), date.fromordinal(ref) if rng.random() > 0.1 else None, rng.choice([None, None, *D.WEEKDAYS])))
    got = spark.createDataFrame(rows, "m int, d int, ref date, w string").select(D.infer_year(F.col("m"), F.col("d"), F.col("ref"), F.col("w")).alias("y")).collect()
    for (m, d, ref, w), r in zip(rows, got):
        found = D.DateScanner.near(m, d, ref, w)
        assert r.y == (found.year if found else None), (m, d, ref, w)


@pytest.mark.parametrize(("text", "want"), [("Wed, 26 Aug 2026 23:30:00 +0900", date(2026, 8, 26)), ("2026-08-26T23:30:00-05:00", date(2026, 8, 26)), ("2026-08-26T23:30:00Z", date(2026, 8, 26)), ("2026-8-6", date(2026, 8, 6)), ("2026/08/26", date(2026, 8, 26)), ("Wed, 26 Aug 2026 23:30:00 GMT", None), ("2026-02-30", None), (None, None)])
def test_parse_published(spark, text, want):
    assert one(spark, D.parse_published(F.col("t")), t=text) == want


def verdict(spark, **v):
    row = {"s": date(2026, 9, 18), "e": None, "p": date(2026, 8, 20), "y": True, "c": ["concert"]} | v
    df = spark.createDataFrame([tuple(row.values())], "s date, e date, p date, y boolean, c array<string>")
    return df.select(R.assess(F.col("s"), F.col("e"), F.col("p"), F.lit(date(2026, 9, 1)), F.col("y"), F.col("c")).alias("v")).first().v


def test_assess_boundaries(spark):
    assert verdict(spark).accepted and not verdict(spark, s=None).accepted
    assert verdict(spark, e=date(2026, 10, 18)).accepted and not verdict(spark, e=date(2026, 10, 19)).accepted
    assert verdict(spark, e=date(2027, 4, 15), c=["concert", "exhibition"]).accepted and not verdict(spark, e=date(2027, 4, 16), c=[]).accepted
    assert verdict(spark, p=None).accepted and not verdict(spark, p=None, y=False).accepted
    assert verdict(spark, p=date(2026, 3, 5)).accepted and not verdict(spark, p=date(2026, 3, 4)).accepted
    assert verdict(spark, s=date(2026, 7, 20)).accepted and not verdict(spark, s=date(2026, 7, 19)).accepted
    assert verdict(spark, s=date(2026, 7, 1), e=date(2026, 9, 1), c=["exhibition"]).accepted
    assert verdict(spark, s=date(2028, 2, 21)).accepted and not verdict(spark, s=date(2028, 2, 22)).accepted


def test_classify(spark):
    def cats(text, enabled=None):
        key = X.normalize(F.col("t"))
        return one(spark, R.event_fallback(key, R.classify(key, enabled), enabled), t=text)

    assert cats("星の海 リバイバル上映と舞台挨拶") == ["revival", "screening_event"]
    assert cats("回顧展を見る") == ["exhibition"] and cats("発展する展開") == [] and cats("Blu-ray BOX") == ["goods"]
    assert cats("配信開始と舞台挨拶") == [] and cats("上映 決定 配信決定") == ["screening_event"]  # the weak sign comes after the exclusion
    assert cats("グッズ", ["revival"]) == [] and cats("上映決定", ["goods"]) == [] and cats("上映決定", ["revival"]) == ["screening_event"]


def test_watchlist(spark):
    works, people = [{"title": "劇場版 星の海", "aliases": ["Star Sea"]}], [{"name": "星 一", "role": "作者", "aliases": ["星一郎"]}]
    key = X.normalize(F.col("t"))
    m = R.match_watchlist(key, X.loosen(key), works, people)
    assert [x.label for x in one(spark, m, t="ＳＴＡＲ－ＳＥＡ 星一郎")] == ["劇場版 星の海", "星 一"]
    assert [x.label for x in one(spark, m, t="映画 星の海 上映")] == ["劇場版 星の海"] and one(spark, m, t="星一") == []
