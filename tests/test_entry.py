"""Settings and the command line."""

import pytest

from palimpsest import __main__ as cli
from palimpsest import config

PAGE = "---\ntitle: Page\n---\n" + "Words of the page that are kept because there are many of them. " * 5


def test_settings_come_from_the_environment(monkeypatch):
    monkeypatch.setenv("PALIMPSEST_VERSION_LOW", "30")
    monkeypatch.setenv("PALIMPSEST_SCORE_FLOOR", " ")
    s = config.from_environment()
    assert s.versions == list(range(30, 36)) and s.score_floor == 0.35
    monkeypatch.setenv("PALIMPSEST_SEED", "x")
    with pytest.raises(ValueError, match="PALIMPSEST_SEED"):
        config.from_environment()


def test_ingest_writes_ranges_and_facts(spark, tmp_path):
    guide = "# G\n### v1.32\n#### Flow\nThe **flow/v1b** API version of Flow is no longer served as of v1.32.\n"
    for v in (29, 30, 31):
        p = tmp_path / "tree" / f"version={v}"
        p.mkdir(parents=True)
        (p / "a.md").write_text(PAGE)
        (p / "guide.md").write_text(guide)
    cli.ingest(spark, str(tmp_path / "tree"), str(tmp_path / "out"))
    chunks = spark.read.parquet(f"{tmp_path}/out/chunks").collect()
    assert [(c.doc_path, c.version_low, c.version_high) for c in chunks] == [("a.md", 29, 31)]
    assert [f.api for f in spark.read.parquet(f"{tmp_path}/out/facts").collect()] == ["flow/v1b"]
    assert cli.stats(spark, str(tmp_path / "out")).first().chunks == 1
