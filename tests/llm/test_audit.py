"""The audit against SQL where smaller ids arrive late, and awkward rows."""

import duckdb
from pyspark.sql import functions as F

from stintline.llm import audit

LONG = " ".join(f"word{i}" for i in range(250))


def by_sql(folder):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    con.sql(f"create view labels as select * from '{folder}/labels.parquet/*.parquet'")
    answer = con.sql(audit.OP12_SQL)
    return answer.columns, sorted(answer.fetchall())


def check(spark, folder, batches):
    columns, wanted = by_sql(folder)
    got = audit.audit(spark, f"{folder}/documents.parquet", spark.read.parquet(f"{folder}/labels.parquet"), batches)
    rows = sorted(tuple(r[c] for c in columns) for r in got.collect())
    assert rows == wanted
    return rows


def test_smaller_ids_arrive_later(spark, make, tmp_path, monkeypatch):
    """Three files, ids going down: each batch retracts what the last one held."""
    texts = {0: LONG, 1: "short $", 2: LONG + " Capital", 3: None, 4: "A B C D " * 100}
    for file, low in enumerate((60, 30, 0)):
        rows = [(low + i, texts[i % 5], "en", [None, "a", "b"][(i + file) % 3]) for i in range(30)] + [(low, texts[0], "en", "c"), (low, texts[0], "en", "c")]
        make(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, i % 2, i % 3 % 2) for i in range(0, 90, 2)] + [(1, 1, 1), (1, 0, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(audit, "BUCKET_ROWS", 30)
    assert check(spark, tmp_path, 3) == check(spark, tmp_path, 1)


def test_changes_retract():
    """The keyed function by itself: a smaller id takes its predecessor's count back; texts of a bucket keep apart."""
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def feed(rows):
        batch = pd.DataFrame([(0, *r) for r in rows], columns=["bucket", *audit.FACTS, "n"])
        return sorted(r for df in audit.retracting((0,), iter([batch]), state) for r in df[["part", "mask", "good", "toxic", "n"]].itertuples(index=False, name=None))

    state = State()
    assert feed([(b"k", 1, 50, True, "a", 1, 0, 2), (b"k", 1, 50, False, "b", 0, 0, 3), (b"j", 8, 60, True, "a", 0, 0, 1)]) == [("a", 1, 1, 0, 2), ("a", 8, 0, 0, 1), ("b", 17, 0, 0, 3)]
    assert feed([(b"k", 1, 60, True, "a", 0, 0, 1)]) == [("a", 17, 0, 0, 1)]
    assert feed([(b"k", 1, 50, True, "b", 0, 0, 1)]) == [("b", 1, 0, 0, 1)]
    assert feed([(b"k", 1, 7, True, "c", 0, 1, 1)]) == [("a", 1, 1, 0, -2), ("a", 17, 1, 0, 2), ("b", 1, 0, 0, -1), ("b", 17, 0, 0, 1), ("c", 1, 0, 1, 1)]
    assert feed([(b"k", 1, 7, True, "c", 0, 1, 1), (b"j", 8, 60, True, "a", 0, 0, 1)]) == [("a", 8, 0, 0, 1), ("c", 1, 0, 1, 1)]


def test_awkward_rows(spark, awkward, tmp_path):
    awkward.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(5, None, 1), (None, 1, 1)], "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    rows = check(spark, tmp_path, 2)
    assert {r[0] for r in rows} == {"", "a", "b", "c"} and len(rows) == 4 * 600


def test_empty_table(spark, make, tmp_path):
    make([(1, "x", "en", "a")]).where(F.lit(False)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    labels = spark.createDataFrame([], "doc_id long, quality long, toxic long")
    assert audit.audit(spark, str(tmp_path / "documents.parquet"), labels).count() == 0
