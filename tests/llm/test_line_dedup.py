from collections import Counter

from stintline.llm import line_dedup as ld


def brute(rows, ratio, least):
    pages = {(s, t) for s, t in rows if s is not None and t is not None}
    total = Counter(s for s, _ in pages)
    count = Counter((s, x) for s, t in pages for x in {x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")})
    flagged = {k for k, n in count.items() if n >= least and n > ratio * total[k[0]]}
    return [(s, t if s is None or t is None else "\n".join(x for x in t.split("\n") if (s, x) not in flagged)) for s, t in rows]


def test_brute_force(spark, make, monkeypatch):
    rows = [(i, "\n".join(["menu", f"line {i}", "", f"shared {i % 3}", "end " * (i % 2)]), "en", "ab"[i % 2]) for i in range(40)]
    rows += [(i, "menu\ncopied page", "en", "c") for i in range(100, 130)] + [(200, "menu", "en", None), (201, None, "en", "a"), (202, "menu", "en", "a")]
    frame = make(rows)
    expect = sorted(brute([(r[3], r[1]) for r in rows], 0.3, 5), key=str)
    for most in (200_000, 0):  # broadcast, and the salted join beyond its bound
        monkeypatch.setattr(ld, "BROADCAST_ROWS", most)
        got = ld.drop_boilerplate(frame, ratio=0.3, min_pages=5).collect()
        assert sorted(((r.source, r.text) for r in got), key=str) == expect
        assert {r.doc_id: r.n_lines_dropped for r in got}[202] == 1


def test_awkward_rows_stay(spark, awkward):
    got = ld.drop_boilerplate(awkward)
    assert got.count() == awkward.count() and got.columns == [*awkward.columns, "n_lines_dropped"]
    assert {r.n_lines_dropped for r in got.collect()} == {0}


def test_empty(spark, make):
    assert ld.drop_boilerplate(make([])).count() == 0
