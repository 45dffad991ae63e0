"""The mixed order reaches the pipeline's result, whatever the part files."""

import corpus_pipeline as cp
from test_pipeline import corpus

from stintline.llm import mixing


def test_run_returns_the_mixed_order(spark, tmp_path, monkeypatch):
    corpus(spark, tmp_path)
    monkeypatch.setattr(cp, "STAGES", [(n, (lambda f: lambda *a: f(*a).repartition(5))(f)) if n == "mixing" else (n, f) for n, f in cp.STAGES])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = cp.run(spark, str(tmp_path))
        rows = got.collect()
        assert len(got.inputFiles()) > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    place = {r.doc_id: r.mix_pos for r in mixing.mix(spark.createDataFrame(rows).select(*cp.COLUMNS)).collect()}
    assert len(place) == len(rows) > 60
    assert {r.doc_id: r.mix_pos for r in rows} == place and len({r.mix_pos for r in rows}) == len(rows)
    parts = [[r.mix_pos for r in spark.read.parquet(f).collect()] for f in sorted(got.inputFiles())]
    assert [p for part in parts for p in part] == sorted(place.values())
