"""The pipeline against brute force: each stage's decisions on what its predecessor kept."""

import random

import corpus_pipeline as cp
import tiktoken
from test_line_dedup import brute as drop_lines
from test_quality import brute as base_counts
from test_quality import grams
from test_simhash import brute_components, brute_fingerprint

from stintline.llm import bpe, line_dedup, mixing, quality


def corpus(spark, folder):
    rng = random.Random(7)
    good, bad = [f"word{i}" for i in range(80)], [f"JUNK{i}!!" for i in range(80)]
    rows = []
    for i in range(90):
        words = [rng.choice(bad if i % 6 == 5 else good) for _ in range(rng.randint(60, 110))]
        text = " ".join(words[:30]) + ("\nshared boilerplate line\n" if i % 2 else "\n") + " ".join(words[30:])
        rows.append((i, text, "en", f"s{i % 3}"))
    rows += [(100 + i, rows[i][1].replace("\n", "  \n"), "en", "s0") for i in (0, 2, 4)]  # copies but for white space
    rows += [(200, None, None, None), (201, "", "en", "s1"), (202, "short", "en", None), (None, rows[7][1], "en", "s1")]
    docs = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 6 != 5), 0) for i in range(80)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages(spark, tmp_path):
    corpus(spark, tmp_path)
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append((name, before, docs.collect()))
        if k < 4:
            assert docs.columns == cp.COLUMNS

    name, before, after = seen[0]
    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    keep = [r for r in before if not base_counts(r.text)["base_failed"] and sum(model.ratios[g] for g in grams(r.text)) // len(grams(r.text)) >= model.threshold]
    assert sorted(map(str, after)) == sorted(map(str, keep)) and 70 < len(keep) < len(before)
    assert all("JUNK" not in r.text for r in after)

    name, before, after = seen[1]
    texts = drop_lines([(r.source, r.text) for r in before], line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert sorted((str(r.doc_id), r.source, r.text, r.n_chars) for r in after) == sorted((str(r.doc_id), s, t, len(t)) for r, (s, t) in zip(before, texts))
    assert all("boilerplate" not in r.text for r in after)

    name, before, after = seen[2]
    parts = brute_components([r.doc_id for r in before], [brute_fingerprint(r.text) for r in before])
    assert {r.doc_id for r in after} == {c for c in parts} and len(after) == len(set(parts)) < len(before)

    name, before, after = seen[3]
    assert sorted(map(str, after)) == sorted(map(str, before))
    place = {r.doc_id: r.mix_pos for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert [place[r.doc_id] for r in after] == sorted(place.values())

    name, before, after = seen[4]
    lines, pattern = bpe.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe._engine(lines).ranks, special_tokens={})
    assert len(after) == len(before) and all(list(r.token_ids) == library.encode_ordinary(r.text) for r in after)


def test_run_and_empty(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    assert 0 < cp.run(spark, str(tmp_path)).count() < len(docs)
    empty = f"{tmp_path}/none"
    for table in ("documents", "labels"):
        spark.read.parquet(f"{tmp_path}/{table}.parquet").where("false").write.parquet(f"{empty}/{table}.parquet")
    assert cp.run(spark, empty).count() == 0
