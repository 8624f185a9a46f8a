"""Studies, reports, sources of responses, and the command line."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomlake import __main__ as cli
from roomlake import studies
from roomlake.sources import exports, hrtf, tables


@pytest.fixture(scope="module")
def profiles(spark):
    rows = [(k, 3 + k % 2, 40.0 + 3 * (k * 7 % 30)) for k in range(60)]
    return spark.createDataFrame(rows, "plan long, room_count int, area double")


def measure(df):
    error = 3.0 / F.col("nodes") + (F.col("plan") % 5) * 0.01
    return df.withColumn("error", error).withColumn("correct", F.col("nodes") > 1).withColumn("local", F.col("plan") % 2 == 0)


def test_stratified_study(spark, profiles, tmp_path):
    configured = studies.configurations(spark, [{"nodes": n, "kind": "array"} for n in (1, 2, 4, 8)])
    how = {"key": "room_count", "area": "area", "index": "plan", "count": "nodes", "path": f"{tmp_path}/rows", "mark": "a"}
    calls = []

    def counted(df):
        calls.append(df.count())
        return measure(df)

    out = studies.stratified_study(profiles, configured, counted, **how)
    assert calls == [2 * 8 * 4]
    best = {r.room_count: r.nodes for r in out.tables["recommended"].collect()}
    assert best == {3: 4, 4: 4}  # the smallest whose median is at most a metre
    assert out.tables["metrics"].count() == 8 and out.tables["rows"].count() == 64
    again = studies.stratified_study(profiles, configured, counted, **how)
    assert calls[1:] == [0] and again.tables["rows"].count() == 64
    shown = ["metrics", "recommended", "population", "by_area"]
    studies.write(out, f"{tmp_path}/out", "A study", shown=shown)
    summary = json.loads((tmp_path / "out" / "summary.json").read_text())
    assert summary["title"] == "A study" and summary["rows"]["recommended"] == 2
    page = (tmp_path / "out" / "report.html").read_text()
    assert page.count("<table>") == len(shown) and "<h2>by area</h2>" in page
    back = spark.read.option("header", True).csv(f"{tmp_path}/out/recommended")
    assert {r.nodes for r in back.collect()} == {"4"}
    areas = studies.rebuilt(out.tables["rows"].where("split = 'validation'"), out.tables["recommended"], key="room_count", count="nodes", area_bin="area_bin", plan="plan")
    assert sorted(map(tuple, areas.select("room_count", "area_bin", "cases").collect())) == sorted(map(tuple, out.tables["by_area"].select("room_count", "area_bin", "cases").collect()))


def test_compared(spark):
    rows = spark.createDataFrame([(k, s, float(k % 3 + g), float(g)) for k in range(6) for g, s in enumerate(("none", "ds", "mvdr"))], "case long, strategy string, snr double, gain double")
    out = studies.compared(rows, ["case"], strategy="strategy", baseline="none", metrics=["snr"], improved="gain")
    assert {r.strategy: (r.pairs, r.delta_snr, r.win_snr) for r in out.tables["paired"].collect()} == {"ds": (6, 1.0, 1.0), "mvdr": (6, 2.0, 1.0)}
    assert {r.strategy: r.positive_share for r in out.tables["strategies"].collect()} == {"none": 0.0, "ds": 1.0, "mvdr": 1.0}


def test_ear_responses(spark, tmp_path):
    rows = [(k, 90.0 * k, 0.0, [1.0, 0.5, 0.25, 0.0], [0.0, 1.0, 0.0, 0.0]) for k in range(4)]
    spark.createDataFrame(rows, hrtf.SCHEMA).write.parquet(f"{tmp_path}/h")
    got = hrtf.read(spark, f"{tmp_path}/h", fs=8000, to=16000).orderBy("measurement").collect()
    assert len(got[0].left) == 8 and np.allclose(got[1].direction, [0, 1, 0], atol=1e-12) and abs(got[0].left[0] - 0.5) < 1e-6
    with pytest.raises(Exception, match="both ears"):
        hrtf.validated(spark.createDataFrame([(0, 0.0, 0.0, [1.0], [])], hrtf.SCHEMA)).collect()


def test_objects_and_documents(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": "x"}')
    assert [tuple(r) for r in tables.read_object(spark, f"{tmp_path}/one.json", "a int, b string").collect()] == [(1, "x")]
    assert tables.read_object(spark, f"{tmp_path}/none.json", "a int").count() == 0
    exports.export_scene(spark, {"corners": np.zeros((2, 2)), "name": "ä"}, f"{tmp_path}/scene.json")
    assert json.loads((tmp_path / "scene.json").read_text()) == {"corners": [[0, 0], [0, 0]], "name": "ä"}
    (tmp_path / "m.jsonl").write_text('{"id": "m1"}\n{"id": "m2"}\n')
    assert tables.read_materials(spark, f"{tmp_path}/m.jsonl", "id string").count() == 2


def test_command_line(spark, capsys):
    assert cli.main(["info"]) == 0 and "group_metrics" in capsys.readouterr().out
    assert cli.main(["run", "no_such_query", "/tmp"]) == 2
