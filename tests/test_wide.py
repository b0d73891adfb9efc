"""The wide export of all assets against the long panel."""

from __future__ import annotations

from conftest import DATA

from factorloom import queries


def test_all_assets_are_exported(spark):
    folder = str(DATA / "sf0.001")
    made = queries.queries()
    want: dict = {}
    for r in made["panel_ohlcv"](spark, folder).collect():
        want.setdefault(r["date"], {})[str(r["asset"])] = r["close"]
    assets = {a for own in want.values() for a in own}
    got = made["wide_export_all"](spark, folder)
    assert set(got.columns) == {"date", *assets} and len(assets) > 3
    rows = got.collect()
    assert len(rows) == len(want)
    for r in rows:
        assert all(r[a] == want[r["date"]].get(a) for a in assets)
