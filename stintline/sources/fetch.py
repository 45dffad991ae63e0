"""The results API as a data source: a partition a request, paged and retried where it runs, landed as documents that ``landings`` reads.

What was fetched and when is a table, so which requests are too old is a join and only those are sent.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone
from urllib.error import HTTPError, URLError
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stintline.sources.artifacts import Folder, materialised

# The API's paths, and the hours after which an answer is asked for again.
PATHS = {"schedule": "{season}.json", "results": "{season}/{round}/results.json", "drivers": "{season}/{round}/driverStandings.json", "constructors": "{season}/{round}/constructorStandings.json"}
HOURS = {"schedule": 6, "results": 7 * 24, "drivers": 2, "constructors": 2}
REQUESTS = "kind string, season int, round int"
DOCUMENTS = "kind string, season int, round int, page int, fetched_at timestamp, body string"


class Request(InputPartition):
    def __init__(self, kind: str, season: int, round_: int | None):
        self.kind, self.season, self.round = kind, season, round_


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.base = options["base"].rstrip("/")
        self.requests = [Request(*r) for r in json.loads(options["requests"])]
        self.limit, self.tries = int(options.get("limit", "100")), int(options.get("tries", "3"))
        self.wait_s, self.timeout_s = float(options.get("wait", "1")), float(options.get("timeout", "30"))

    def partitions(self) -> list[Request]:
        return self.requests

    def _get(self, url: str) -> str:
        """The body; a refused connection, a time-out, 429 and 5xx are tried again after 1, 2, 4, ... waits, anything else fails at once."""
        for attempt in range(self.tries):
            try:
                with urlopen(url, timeout=self.timeout_s) as answer:
                    return answer.read().decode()
            except HTTPError as error:
                last, again = error, error.code == 429 or error.code >= 500
            except (URLError, TimeoutError) as error:
                last, again = error, True
            if not again:
                break
            if attempt < self.tries - 1:
                time.sleep(self.wait_s * 2**attempt)
        raise RuntimeError(f"no answer from {url}: {last}")

    def read(self, partition: Request) -> Iterator[tuple]:
        path, offset, page, total = PATHS[partition.kind].format(season=partition.season, round=partition.round), 0, 0, 1
        while offset < total:
            body = self._get(f"{self.base}/{path}?limit={self.limit}&offset={offset}")
            document = json.loads(body)
            total = int(document.get("MRData", {}).get("total", 0))
            yield partition.kind, partition.season, partition.round, page, datetime.now(timezone.utc), json.dumps(document)
            offset, page = offset + self.limit, page + 1


class SeasonApi(DataSource):
    """``spark.read.format("season_api")`` with the options ``base``, ``requests`` (JSON list of kind, season, round), ``limit``, ``tries``, ``wait`` and ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return "season_api"

    def schema(self) -> str:
        return DOCUMENTS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetched(spark: SparkSession, base: str, requests: Iterable[tuple], **options) -> DataFrame:
    """The documents of requests (kind, season, round), a task each."""
    spark.dataSource.register(SeasonApi)
    return spark.read.format("season_api").options(base=base, requests=json.dumps(list(requests)), **{k: str(v) for k, v in options.items()}).load()


def too_old(spark: SparkSession, root: str, requests: list[tuple], hours: dict[str, float] = HOURS) -> list[tuple]:
    """Those of the requests that were never fetched into ``root``, or longer ago than their kind's hours. A calendar of requests comes to the driver."""
    asked = spark.createDataFrame(requests, REQUESTS)
    if not Folder(spark, f"{root}/fetched").exists():
        return [tuple(r) for r in asked.distinct().collect()]
    age = F.create_map(*[F.lit(x) for k, h in hours.items() for x in (k, float(h) * 3600)])
    last = spark.read.parquet(f"{root}/fetched").groupBy("kind", "season", "round").agg(F.max("fetched_at").alias("at"))
    held = last.where(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("at") < F.element_at(age, F.col("kind")))
    same = (asked["kind"] == held["kind"]) & (asked["season"] == held["season"]) & asked["round"].eqNullSafe(held["round"])
    return [tuple(r) for r in asked.join(held, same, "left_anti").distinct().collect()]


def land(spark: SparkSession, root: str, base: str, requests: list[tuple], hours: dict[str, float] = HOURS, **options) -> int:
    """Fetch what is too old into ``root``/<kind>, a file a page, over an older answer; return how many documents came.

    Answers are stored before they are noted as fetched: after a failure they are fetched again.
    """
    due = too_old(spark, root, requests, hours)
    if not due:
        return 0
    documents = materialised(fetched(spark, base, due, **options))  # one request each, however many tables are written
    name = F.concat_ws("-", F.col("season"), F.coalesce(F.col("round").cast("string"), F.lit("all")), F.col("page"))
    for kind in sorted({r[0] for r in due}):
        rows = documents.where(F.col("kind") == kind).select(name.alias("request"), F.col("body").alias("value"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("request").text(f"{root}/{kind}")
    noted = documents.groupBy("kind", "season", "round").agg(F.min("fetched_at").alias("fetched_at"))
    noted.coalesce(1).write.mode("append").parquet(f"{root}/fetched")
    return documents.count()
