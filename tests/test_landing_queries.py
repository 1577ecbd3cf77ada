"""Queries over landed files: what they leave behind."""

from __future__ import annotations

from pathlib import Path

from awardlens.plans.landing_queries import archive_landing
from awardlens.sources.scratch import shared_dir

TABLES = "/root/testdata/sf0.001"


def test_archives_go_once_they_have_landed(spark):
    """Neither the awards that are archived nor the archives are there when the landed rows are read, and these are whole."""
    shared = Path(shared_dir(spark).removeprefix("file://"))
    held = lambda: {p.name for p in shared.iterdir()} if shared.exists() else set()
    before = held()
    landed = archive_landing(spark, TABLES)
    made = {name.rsplit("-", 1)[0] for name in held() - before}
    assert "landing" in made and not made & {"archived", "archives"}
    rows = landed.select("award_id", "award_description").collect()
    assert len(rows) == len({r[0] for r in rows}) > 5000 and all(r[1] == f'first line\n"second", {r[0]}' for r in rows)
