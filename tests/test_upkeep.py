"""Months counted anew, texts within a budget, replays, sheets and the region array."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest

from tidemark.operators import upkeep as U, waves
from tidemark.sources import feeds, sheets

T0 = datetime(2024, 1, 10)
PERIOD = "location_id string, started_at timestamp, ended_at timestamp"


def test_only_changed_months_are_written(spark, tmp_path):
    path = f"file://{tmp_path}/months"
    rows = [(p, T0 + timedelta(days=30 * m, hours=h), T0 + timedelta(days=30 * m, hours=h + 1)) for p in "ab" for m in range(3) for h in range(3)]
    frame = lambda r: spark.createDataFrame(r, PERIOD)
    refresh = lambda every, changed: {r.month: r.outcome for r in U.refresh_months(frame(every), frame(changed), path).collect()}
    assert set(refresh(rows, rows).values()) == {"written"}
    stamp = {p.parent.name: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    new = ("a", T0 + timedelta(days=31), T0 + timedelta(days=31, hours=5))
    assert refresh([*rows, new], [new, rows[0]]) == {"2024-01": "confirmed", "2024-02": "written"}
    now = {p.parent.name: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    assert {m for m in stamp if stamp[m] != now[m]} == {"month=2024-02"}
    left = [r for r in [*rows, new] if r[1].month != 3]
    assert refresh(left, [r for r in rows if r[1].month == 3]) == {"2024-03": "removed"} and refresh(left, []) == {}
    want = waves.monthly_rollup(frame(left))
    stored = U.stored_months(spark, path, want)
    key = lambda df: sorted((r.month[:7], r.location_id, r.periods, float(r.total_seconds)) for r in df.collect())
    assert key(stored) == key(want)


def test_texts_within_a_budget(spark):
    rows = [("x", f"{i:03}", T0 + timedelta(hours=7 * i), 3, f"line {i}") for i in range(50)] + [("y", "1", T0, 99, "long"), ("z", "1", T0, 1, None), (None, "1", T0, 1, "t"), ("w", "b", T0, 4, "second"), ("w", "a", T0, 4, "first")]
    got = {r.location_id: r for r in U.budgeted_texts(spark.createDataFrame(rows, "location_id string, id string, at timestamp, tokens int, text string"), 10).collect()}
    assert got["x"].content == "line 47\nline 48\nline 49" and (got["x"].tokens, got["x"].entries, got["x"].compact_entries, got["x"].compact_tokens) == (9, 3, 47, 141)
    assert got["y"].content == "" and got["y"].compact_entries == 1 and got["w"].content == "first\nsecond" and set(got) == {"x", "y", "w"}


def test_diffs_of_a_replay(spark):
    schema = "message_id string, threat_type string, places array<string>, significant boolean, rejection string"
    old = spark.createDataFrame([("a", None, ["x", "y"], True, None), ("b", "uav", ["x"], True, None), ("c", "uav", None, False, "no_location"), ("d", "uav", [], True, None)], schema)
    new = spark.createDataFrame([("a", "unknown", ["y", "x", "x"], True, None), ("b", "mlrs", ["z"], True, None), ("c", "uav", ["x"], True, None), ("e", "uav", [], True, None)], schema)
    diffs = U.verdict_diffs(old, new)
    got = {r.message_id: (r.axes, r.left_places, r.came_places) for r in diffs.collect()}
    assert got == {"b": (["threat_type", "locations"], ["x"], ["z"]), "c": (["locations", "significance"], [], ["x"])}
    report = {(r.part, r.key): (r.messages, r.examples) for r in U.replay_report(diffs, 1).collect()}
    assert report[("axis", "locations")] == (2, ["b"]) and report[("move", "uav -> mlrs")][0] == 1 and report[("significance", "significant")][0] == 1
    assert U.replay_report(diffs.limit(0)).count() == 0


def workbook(rows, inline=False):
    shared, out = [], []
    for n, values in rows:
        cells = ""
        for column, text in values.items():
            if inline:
                cells += f'<c r="{column}{n}" t="inlineStr"><is><t>{text}</t></is></c>'
            else:
                shared.append(text)
                cells += f'<c r="{column}{n}" t="s"><v>{len(shared) - 1}</v></c>'
        out.append(f'<row r="{n}">{cells}</row>')
    ns, data = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as book:
        if not inline:
            book.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s}</t></r></si>" for s in shared) + "</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{''.join(out)}</sheetData></worksheet>")
    return data.getvalue()


def test_sheets_are_read_as_files(spark, tmp_path):
    rows = [(1, {"A": "title"}), (5, {"A": "R1", "F": "O", "G": " Region "}), (6, {"B": "D1", "F": "P", "G": "District"}), (7, {"C": "C1", "F": "H", "G": "Community &amp; co"}), (8, {"D": "T1", "F": "M", "G": "Town"}), (9, {"D": "T2", "F": "M", "G": "Other"}), (10, {"B": "D2", "F": "P", "G": "Second"}), (11, {"D": "T3", "F": "M"}), (12, {"A": "R2", "F": "O", "G": "Next"})]
    (tmp_path / "a.xlsx").write_bytes(workbook(rows))
    (tmp_path / "b.xlsx").write_bytes(workbook(rows, inline=True))
    (tmp_path / "c.xlsx").write_bytes(b"no workbook")
    (tmp_path / "d.txt").write_bytes(b"x")
    read = sheets.sheet_rows(spark, f"file://{tmp_path}")
    assert [r.sheet for r in read.where("error IS NOT NULL").collect()] == ["c.xlsx"]
    got = {s: [(r.code, r.region_code, r.district_code, r.community_code, r.name) for r in sheets.code_entries(read).where(f"sheet = '{s}'").orderBy("n").collect()] for s in ("a.xlsx", "b.xlsx")}
    assert got["a.xlsx"] == got["b.xlsx"] == [
        ("R1", "R1", None, None, "Region"), ("D1", "R1", "D1", None, "District"), ("C1", "R1", "D1", "C1", "Community & co"), ("T1", "R1", "D1", "C1", "Town"),
        ("T2", "R1", "D1", "C1", "Other"), ("D2", "R1", "D2", None, "Second"), ("R2", "R2", None, None, "Next"),
    ]


def test_an_entry_of_a_region_array_is_parsed_once(spark):
    """The last one of a field that comes twice counts, as in a parser of whole objects."""
    body = '{"raw": [{"regionName": "a", "regionName": "b", "activeAlerts": [{"type": "X", "type": "AIR", "lastUpdate": "2024-01-01T00:00:00Z"}]}]}'
    rows = feeds.region_array(spark.createDataFrame([(body, None), (None, None)], "body string, cached_at timestamp"))
    assert [r.name for r in rows.collect()] == ["b"]


def test_odd_bodies_of_a_region_array(spark):
    df = lambda *bodies: spark.createDataFrame([(b if isinstance(b, str) else json.dumps(b), T0) for b in bodies], "body string, cached_at timestamp")
    body = {"raw": [{"regionName": "X", "activeAlerts": [{"type": "AIR"}, {"type": "AIR", "lastUpdate": "2024-01-10T01:00:00Z"}]}, {"regionName": "Y", "activeAlerts": []}, {"regionName": "Z"}, None, 5, {"regionName": "S", "regionType": "State", "lastUpdate": "2024-01-09T00:00:00Z", "activeAlerts": [{"type": " air_raid "}]}]}
    got = {r.name: (r.level, r.changed_at) for r in feeds.region_array(df(body, "no json", {"raw": 1}, {})).collect()}
    assert got == {"X": ("other", T0), "S": ("State", datetime(2024, 1, 9))}
    assert feeds.region_array(df(body).limit(0)).count() == 0 and set(feeds.PARSERS) == {"snapshot", "region_array", "region_map", "name_map"}
    with pytest.raises(Exception, match="rollup may not assert"):
        feeds.snapshot_body(feeds.region_array(df(body)), rollup=True).collect()
