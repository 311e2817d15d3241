"""Streams fed file by file."""

import json

from pyspark.sql import functions as F

from assayloom.sources.records import RUN_SCHEMA
from assayloom.streaming import streams as st

SCHEMA = RUN_SCHEMA + ", ts timestamp"


def drop(path, name, runs):
    (path / name).write_text("\n".join(json.dumps({"ligand_name": l, "receptor_key": "R", "replicate": k, "seed": 1, "poses": [{"mode": 1, "affinity": a}], "error": e, "ts": ts}) for l, k, a, e, ts in runs))


def test_replicates_resume_and_resend(spark, tmp_path):
    src, out, chk = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "chk")
    src.mkdir()
    day = "2024-01-01T00:00:0"

    def run():
        raw = spark.readStream.schema(SCHEMA).json(str(src)).select(F.col("ligand_name").alias("ligand"), F.col("receptor_key").alias("receptor"), "replicate", "poses", "error", "ts")
        got = st.run_available(st.stream_replicate_stats(raw), "update", ["ligand", "receptor"], chk, out)
        return {r["ligand"]: (r["n_replicates_success"], r["affinity_best"]) for r in got.collect()}
    drop(src, "a.json", [("A", 1, -6.0, None, day + "1"), ("A", 2, -7.0, None, day + "2"), ("A", 3, -9.0, "boom", day + "3")])
    assert run() == {"A": (2, -7.0)}
    drop(src, "b.json", [("A", 2, -7.0, None, day + "4"), ("A", 4, -8.0, None, day + "5"), ("B", 1, -5.0, None, day + "5")])
    assert run() == {"A": (3, -8.0), "B": (1, -5.0)}


def test_bins_append_after_watermark(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = lambda *r: "\n".join(json.dumps({"sample": "s", "ts": f"2024-01-01T00:{m:02d}:00", "y": y}) for m, y in r)
    chk, out = str(tmp_path / "chk"), str(tmp_path / "out")
    def run():
        pts = spark.readStream.schema("sample string, ts timestamp, y double").json(str(src))
        return {r["n"]: r["value"] for r in st.run_available(st.stream_binned_signal(pts, "5 minutes", delay="5 minutes"), "append", None, chk, out).collect()}
    (src / "a.json").write_text(rows((1, 1.0), (2, 2.0), (30, 5.0)))
    run()
    (src / "b.json").write_text(rows((3, 100.0), (59, 1.0)))                # the first point is late by now
    got = run()
    assert got.get(2) == 3.0 and 100.0 not in got.values()
