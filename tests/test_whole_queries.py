"""Queries that leave no part of their tables out, on small fixtures."""

from eventloom.plans.catalog import QUERIES


def test_terms_after_the_eighth_are_shared(spark, tmp_path):
    first = "aaaa bbbb cccc dddd eeee ffff gggg hhhh lantern lantern harbour"
    second = "iiii jjjj kkkk llll mmmm nnnn oooo pppp lanterns harb"
    rows = [(1, 0, "user", first), (1, 1, "bot", second), (1, 2, "user", "zzzz"), (2, 0, "user", "lantern")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {(r.conv_id, r.turn): r.n_shared for r in QUERIES["shared_terms"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0): 2, (1, 1): 0}


def test_every_event_and_page_is_appended(spark, tmp_path):
    spark.createDataFrame([(k, "x") for k in range(5)], "event_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(k, f"u{k}") for k in range(3)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted(tuple(r) for r in QUERIES["append_inbox"](spark, str(tmp_path)).collect())
    assert got == [*((0, k) for k in range(5)), *((1, k) for k in range(3))]
