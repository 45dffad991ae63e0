"""Stored artifacts: snapshots that freeze, predictions that are written once, the metadata beside them.

Tables are Parquet written by Spark; a small JSON document beside them is written last and says
that the artifact is whole. It goes through Hadoop's file system, so any store that Spark
reads will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from stintline.operators.point_in_time import LeakageError, as_date

SUFFIX = {"pre-fp1": "pre", "post-sprint": "post-sprint", "post-q": "post-q"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a session on one machine may do without and gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="stintline-shared-")


class FrozenError(RuntimeError):
    """The artifact may not change any more."""


class NotFrozenError(RuntimeError):
    """The artifact is not complete yet."""


class Folder:
    """A folder of any Hadoop file system, with JSON documents in it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._hadoop(name))

    def read(self, name: str) -> dict:
        stream = self._fs.open(self._hadoop(name))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, name: str, document: dict | str) -> None:
        """Write a document (or text that is one) beside the target and rename over it, so that a reader never sees half of it."""
        text = document if isinstance(document, str) else json.dumps(document, indent=1, sort_keys=True, default=str)
        aside = self._hadoop(name + ".part")
        out = self._fs.create(aside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.exists(name):
            self._fs.delete(self._hadoop(name), False)
        self._fs.rename(aside, self._hadoop(name))

    def move(self, name: str, to: str) -> None:
        """Rename within the folder, over what is there."""
        if self.exists(to):
            self._fs.delete(self._hadoop(to), True)
        self._fs.rename(self._hadoop(name), self._hadoop(to))

    def delete(self, name: str = "") -> None:
        self._fs.delete(self._hadoop(name), True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._hadoop(""))) if self.exists() else []


class Snapshot:
    """Named frames known before one round. Frozen snapshots never change."""

    def __init__(self, spark: SparkSession, root: str, season: int, round_: int, version: str = "v1"):
        self.spark, self.season, self.round = spark, season, round_
        self.path = f"{root}/snapshots/{season}/{version}/round_{round_:02d}_pre"
        self.folder = Folder(spark, self.path)

    @property
    def exists(self) -> bool:
        return self.folder.exists("metadata.json")

    @property
    def metadata(self) -> dict:
        return self.folder.read("metadata.json") if self.exists else {}

    @property
    def is_frozen(self) -> bool:
        return bool(self.metadata.get("frozen"))

    @property
    def frames(self) -> list[str]:
        return self.metadata.get("frames", [])

    def _open(self) -> dict:
        if self.is_frozen:
            raise FrozenError(f"{self.path} is frozen")
        return self.metadata

    def start(self, cutoff, **more) -> Snapshot:
        old = self._open()
        now = datetime.now(timezone.utc).isoformat()
        self.folder.write("metadata.json", {"frames": [], "created_at": now, "frozen": False, **old, **more, "cutoff": str(cutoff), "season": self.season, "round": self.round})
        return self

    def write_frame(self, name: str, frame: DataFrame, day: str = "date", check: bool = True) -> Snapshot:
        """Store a frame; unless ``check`` is off, every row must be from before the cutoff.

        The check is watched in the job that stores the frame, which so is computed once: a frame with a leak never gets its name,
        and one without has its rows, first and last date in the metadata.
        """
        meta = self._open()
        if check and "cutoff" not in meta:
            raise ValueError("start the snapshot before writing checked frames")
        facts = write_watched(self.folder, f"{name}.parquet", frame, meta["cutoff"] if check else None, day)
        stored = {**meta.get("facts", {}), name: facts}
        self.folder.write("metadata.json", {**meta, "frames": sorted({*meta.get("frames", []), name}), "facts": stored})
        return self

    def freeze(self) -> Snapshot:
        if not self.exists:
            raise NotFrozenError(f"{self.path} has no metadata")
        if not self.is_frozen:
            self.folder.write("metadata.json", {**self.metadata, "frozen": True})
        return self

    def frame(self, name: str) -> DataFrame:
        if name not in self.frames:
            raise FileNotFoundError(f"no frame {name} in {self.path}; there are {', '.join(self.frames) or 'none'}")
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def is_past(self, as_of: str) -> bool:
        """Whether the snapshot's cutoff is not after ``as_of`` (ISO dates)."""
        return self.exists and date.fromisoformat(self.metadata["cutoff"][:10]) <= date.fromisoformat(as_of[:10])

    def rebuild(self, as_of: str) -> Snapshot:
        """Forget a snapshot of a round still to come after ``as_of``, to build it anew; what was frozen for a past round stays."""
        if self.is_past(as_of):
            raise FrozenError(f"{self.path} is of a round that is not to come after {as_of}")
        self.folder.delete()
        return self


def write_watched(folder: Folder, name: str, frame: DataFrame, cutoff=None, day: str = "date") -> dict:
    """Store a frame under ``name`` and return {rows, first, last} of it, from the job that writes it; LeakageError, and nothing stored, if rows are not before the cutoff."""
    if cutoff is not None and day not in frame.columns:
        raise ValueError(f"no column {day}")
    dated = as_date(F.col(day)) if day in frame.columns else F.lit(None).cast("date")
    late = F.coalesce(dated >= F.lit(str(cutoff)).cast("date"), F.lit(False)) if cutoff is not None else F.lit(False)
    seen = Observation(f"stored-{uuid.uuid4().hex}")
    watched = frame.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.min(dated).alias("first"), F.max(dated).alias("last"), F.count_if(late).alias("late"),
        F.min(F.when(late, dated)).alias("late_first"), F.max(F.when(late, dated)).alias("late_last"),
    )
    aside = f"{name}.part"
    watched.write.mode("overwrite").parquet(f"{folder.path}/{aside}")
    facts = seen.get
    if facts["late"]:
        folder.delete(aside)
        raise LeakageError(f"{facts['late']} rows from {facts['late_first']} to {facts['late_last']} are not before {cutoff}")
    folder.move(aside, name)
    return {k: facts[k] if k == "rows" else (None if facts[k] is None else str(facts[k])) for k in ("rows", "first", "last")}


class Predictions:
    """Forecasts by round and cutoff, each written once."""

    def __init__(self, spark: SparkSession, root: str, season: int, version: str = "v1"):
        self.spark, self.season = spark, season
        self.root = f"{root}/predictions/{season}/{version}"

    def _folder(self, round_: int, cutoff: str) -> Folder:
        return Folder(self.spark, f"{self.root}/round_{round_:02d}_{SUFFIX[cutoff]}")

    def exists(self, round_: int, cutoff: str = "pre-fp1") -> bool:
        return self._folder(round_, cutoff).exists("metadata.json")

    def save(self, frame: DataFrame, round_: int, cutoff_date, cutoff: str = "pre-fp1", model: str = "", overwrite: bool = False) -> None:
        if not {"driver"} <= set(frame.columns):
            raise ValueError("a prediction needs the column driver")
        folder = self._folder(round_, cutoff)
        if self.exists(round_, cutoff) and not overwrite:
            raise FrozenError(f"{folder.path} is frozen")
        facts = write_watched(folder, "finish_probs.parquet", frame)
        folder.write("metadata.json", {"rows": facts["rows"], "season": self.season, "round": round_, "cutoff": cutoff, "cutoff_date": str(cutoff_date), "model_version": model, "written_at": datetime.now(timezone.utc).isoformat()})

    def load(self, round_: int, cutoff: str = "pre-fp1") -> tuple[DataFrame, dict] | None:
        """The forecast and its metadata; None if it is absent or not whole."""
        folder = self._folder(round_, cutoff)
        try:
            return (self.spark.read.parquet(f"{folder.path}/finish_probs.parquet"), folder.read("metadata.json")) if folder.exists("metadata.json") else None
        except (AnalysisException, ValueError):
            return None

    def listing(self) -> list[tuple[int, str]]:
        """(round, cutoff) of all forecasts, by name."""
        back = {v: k for k, v in SUFFIX.items()}
        found = [n.split("_", 2)[1:] for n in Folder(self.spark, self.root).names() if n.startswith("round_")]
        return sorted((int(r), back[s]) for r, s in found if s in back and self.exists(int(r), back[s]))


def snapshot_listing(spark: SparkSession, root: str, season: int, version: str = "v1", frozen: bool = False) -> list[int]:
    names = Folder(spark, f"{root}/snapshots/{season}/{version}").names()
    rounds = [int(n.split("_")[1]) for n in names if n.startswith("round_")]
    return [r for r in rounds if (s := Snapshot(spark, root, season, r, version)).exists and (s.is_frozen or not frozen)]


def materialised(df: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder: for tables that several plans read, as a stored table would be."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def replace_rounds(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Overwrite only the (season, round) partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("season", "round").parquet(path)


__all__ = ["Folder", "FrozenError", "LeakageError", "NotFrozenError", "Predictions", "Snapshot", "materialised", "replace_rounds", "shared_folder", "snapshot_listing"]
