"""Two readings of a table by an operator may deal its files to tasks differently; results may not change by that."""

import pytest

from eventloom.llm import exact_dedup, language, near_dedup, pii, warc

KEY = "spark.sql.leafNodeDefaultParallelism"


@pytest.fixture
def redealt(spark, monkeypatch):
    """After the first table that an operator writes, files are dealt to another number of tasks."""

    def use(module):
        plain = module.materialize

        def patched(df, *args, **kwargs):
            out = plain(df, *args, **kwargs)
            spark.conf.set(KEY, "1")
            return out

        monkeypatch.setattr(module, "materialize", patched)
        spark.conf.set(KEY, "12")

    yield use
    spark.conf.unset(KEY)


def _twelve_files(spark, path, rows, schema):
    for i in range(12):
        spark.createDataFrame(rows[i::12], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.read.parquet(str(path))


def test_archives_keep_every_payload(spark, tmp_path, redealt):
    rows = [(i, "u", f"<p>{'x' * (150 + 40 * (i % 13))}{i}</p>" if i % 4 else "<p>" + "same" * 60) for i in range(240)]
    pages = _twelve_files(spark, tmp_path / "p", rows, "page_id long, url string, html string")
    redealt(warc)
    folder = f"file://{tmp_path}/w"
    got = warc.read_archives(warc.write_archives(pages, folder), folder, payloads=True).collect()
    payload = {r.page_id: r.payload for r in got if r.record_type == "response"}
    assert payload == {i: html.encode() for i, _, html in rows if i % 4 or i == 0}
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(i, 0) for i in range(4, 240, 4)}


def test_redaction_meets_the_right_text(spark, tmp_path, redealt):
    rows = [(i, f"please reach me at u{i}@mail.example now {'z' * (i % 17)}" if i % 3 else f"please reach me at HANDLE-{1000 + i} {'y' * (i % 7)}") for i in range(120)]
    rows += [(500 + i, f"plain words here and nothing else number {i}") for i in range(60)]
    docs = _twelve_files(spark, tmp_path / "d", rows, "doc_id long, text string")
    redealt(pii)
    got = {r.doc_id: r.text for r in pii.redact_documents(docs).collect()}
    assert all(("HANDLE" not in t and "[CTX]" in t) if i < 120 and i % 3 == 0 else "[CTX]" not in t for i, t in got.items())
    assert all(got[500 + i] == rows[120 + i][1] for i in range(60))


def test_near_copies_go_and_others_stay(spark, tmp_path, redealt):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30 + i % 11))) for i in range(120)]
    rows += [(1000 + i, rows[i][1] + " more") for i in range(0, 120, 3)]
    docs = _twelve_files(spark, tmp_path / "d", rows, "doc_id long, text string")
    redealt(near_dedup)
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs).collect()) == list(range(120))


def test_tables_that_are_no_scan_are_written_first(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(20)]
    docs = spark.createDataFrame(rows + rows, "doc_id long, text string").repartition(5, "text")
    assert sorted(r.doc_id for r in near_dedup.drop_near(docs.unionByName(docs)).collect()) == list(range(20))


def test_any_legal_column_name(spark, tmp_path):
    rows = [(1, "reach me at a@b.co", "en", "x", 1), (2, "reach me at a@b.co ", "en", "y", 2), (3, None, "en", "z", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` string, `at` int").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for stage in (exact_dedup.drop_copies, near_dedup.drop_near, pii.redact_documents, language.keep_known):
        out = stage(docs)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert {r["a.b"]: r["at"] for r in out.collect()}.items() <= {"x": 1, "y": 2, "z": 3}.items()
    pages = docs.selectExpr("doc_id AS page_id", "`a.b` AS url", "text AS html", "`a.b`", "`at`")
    assert warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w"), f"file://{tmp_path}/w").count() == 3
