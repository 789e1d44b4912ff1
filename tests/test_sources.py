"""Readers give the stated schema."""

from vacancia import schemas
from vacancia.session import checkpoint_root, ship
from vacancia.sources import pages

ROWS = [(1, "https://jobs.rbc.com/1", "<p>a"), (2, "https://x.test", None)]


def test_pages_from_parquet_and_json(spark, tmp_path):
    df = spark.createDataFrame(ROWS, schemas.PAGES)
    df.write.parquet(str(tmp_path / "p"))
    df.write.json(str(tmp_path / "j"))
    for read in (
        pages.read_pages(spark, str(tmp_path / "p")),
        pages.read_pages_json(spark, str(tmp_path / "j")),
    ):
        assert sorted(map(tuple, read.collect())) == ROWS
        assert read.columns == df.columns


def test_remote_copies(spark, tmp_path):
    df = spark.sql("SELECT 1L fetch_id, 'u' remote_url, 'linkedin' adapter_id, true ok, 'h' html, timestamp'2026-01-01 00:00:00' fetched_at")
    df.write.parquet(str(tmp_path / "r"))
    assert pages.read_remote_copies(spark, str(tmp_path / "r")).first()["html"] == "h"


def test_stream_of_captures(spark, tmp_path):
    df = spark.sql(
        "SELECT 1L capture_id, 't' tab_id, timestamp'2026-01-01 00:00:00' captured_at, 'u' url, 'h' html, false skeleton_removed"
    )
    df.write.parquet(str(tmp_path / "c"))
    stream = pages.stream_captures(spark, str(tmp_path / "c"))
    assert stream.isStreaming and stream.columns == df.columns


def test_pages_stored_by_host(spark, tmp_path):
    df = spark.createDataFrame(ROWS * 3, schemas.PAGES)
    pages.write_pages(df, str(tmp_path / "h"), 2)
    read = pages.read_pages(spark, str(tmp_path / "h"), schemas.STORED_PAGES)
    assert sorted({(r["page_id"], r["host"]) for r in read.collect()}) == [(1, "jobs.rbc.com"), (2, "x.test")]


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert checkpoint_root(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_the_package_can_be_shipped(spark):
    import zipfile

    assert "vacancia/operators/dom.py" in zipfile.ZipFile(ship(spark)).namelist()
