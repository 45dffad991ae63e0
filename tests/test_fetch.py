"""The results API against a stub on this machine: paging, retries, age of answers, the ingest step."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest

from stintline import cli
from stintline.sources import fetch, landings


class Stub:
    """Two rounds, five results each; paths in ``failing`` answer 503 so many times first."""

    def __init__(self):
        self.hits, self.failing = Counter(), Counter()
        outer = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                url = urlparse(self.path)
                outer.hits[url.path] += 1
                body = outer.document(url.path, *(int(parse_qs(url.query)[k][0]) for k in ("limit", "offset")))
                code = 404 if body is None else 200
                if outer.failing[url.path] > 0:
                    outer.failing[url.path] -= 1
                    code = 503
                self.send_response(code)
                self.end_headers()
                self.wfile.write(json.dumps(body if code == 200 else {}).encode())

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        self.base = f"http://127.0.0.1:{self.server.server_port}/api/"
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def document(self, path, limit, offset):
        part = path.removeprefix("/api/").removesuffix(".json").split("/")
        races = [{"season": "2026", "round": str(r), "raceName": f"GP {r}", "date": f"2026-03-{8 * r:02d}", "Circuit": {"circuitId": f"c{r}", "circuitName": f"C{r}"}} for r in (1, 2)]
        if len(part) == 1:
            return {"MRData": {"total": "2", "RaceTable": {"Races": races}}}
        who = [{"Driver": {"driverId": f"d{i}"}, "Constructor": {"constructorId": "t"}, "position": str(i), "positionText": str(i), "grid": "1", "status": "Finished", "points": "1", "laps": "50", "wins": "0"} for i in range(1, 6)]
        mine = who[offset : offset + limit]
        if part[2] == "results":
            return {"MRData": {"total": "5", "RaceTable": {"Races": [{"season": part[0], "round": part[1], "date": "2026-03-08", "Results": mine}]}}}
        key = {"driverStandings": "DriverStandings", "constructorStandings": "ConstructorStandings"}.get(part[2])
        return key and {"MRData": {"total": "5", "StandingsTable": {"StandingsLists": [{"season": part[0], "round": part[1], key: mine}]}}}


@pytest.fixture
def stub():
    made = Stub()
    yield made
    made.server.shutdown()


def test_pages_and_retries(spark, stub, monkeypatch):
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(cli.__file__).rsplit("/", 2)[0])
    stub.failing["/api/2026/1/results.json"] = 2
    got = fetch.fetched(spark, stub.base, [("results", 2026, 1), ("schedule", 2026, None)], limit=2, wait=0.01)
    rows = sorted(((r.kind, r.page) for r in got.collect()))
    assert rows == [("results", 0), ("results", 1), ("results", 2), ("schedule", 0)]
    assert stub.hits["/api/2026/1/results.json"] == 2 + 3
    reader = fetch._Reader({"base": stub.base, "requests": "[]", "tries": "2", "wait": "0.01"})
    stub.failing["/api/2026/2/results.json"] = 9
    with pytest.raises(RuntimeError, match="503"):
        list(reader.read(fetch.Request("results", 2026, 2)))
    assert stub.hits["/api/2026/2/results.json"] == 2
    monkeypatch.setitem(fetch.PATHS, "drivers", "{season}/{round}/nothing.json")
    with pytest.raises(RuntimeError, match="404"):  # not tried again
        list(reader.read(fetch.Request("drivers", 2026, 2)))
    assert stub.hits["/api/2026/2/nothing.json"] == 1


def test_answers_are_kept_until_they_are_old(spark, stub, tmp_path):
    root, asked = str(tmp_path / "landing"), [("results", 2026, 1), ("results", 2026, 1), ("schedule", 2026, None)]
    assert fetch.land(spark, root, stub.base, asked, limit=2) == 4
    assert fetch.land(spark, root, stub.base, asked, limit=2) == 0 and stub.hits["/api/2026.json"] == 1
    assert landings.race_results(spark, f"{root}/results").count() == 5 and landings.schedule(spark, f"{root}/schedule").count() == 2
    assert fetch.too_old(spark, root, [*asked, ("results", 2026, 2)]) == [("results", 2026, 2)]
    assert fetch.land(spark, root, stub.base, asked, hours={"schedule": 0, "results": 1}) == 1 and stub.hits["/api/2026.json"] == 2
    assert landings.schedule(spark, f"{root}/schedule").count() == 2  # the newer answer replaced the older


def test_ingest_step(spark, stub, tmp_path, capsys):
    run = lambda day: cli.main(["--root", str(tmp_path), "--season", "2026", "ingest", "--base", stub.base, "--as-of", day])
    run("2026-03-10")
    assert "4 documents" in capsys.readouterr().out
    run("2026-03-20")
    assert "3 documents" in capsys.readouterr().out
    assert landings.standings(spark, str(tmp_path / "landing" / "drivers"), "drivers").groupBy("round").count().count() == 2
