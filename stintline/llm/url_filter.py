"""URL filter: host and path rules, else the likelihood ratio of two character models."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm.common import cut, read, without
from stintline.llm.quality import best_threshold

#: (verdict, host and path): the rules of the registered query.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Longest context in characters, hash buckets of the count tables, weight of the shorter context, steps of a score.
ORDER, BUCKETS, BACK_OFF, STEPS, LONG_URL = 4, 1 << 15, 2.0, 200, 512
ADDED = ["host", "path", "rule", "score", "verdict"]


@dataclass(frozen=True)
class Model:
    """Counts of hashed strings (context and character) and of hashed contexts, for accepted and for rejected URLs."""

    accepted: tuple[int, ...]
    rejected: tuple[int, ...]
    accepted_contexts: tuple[int, ...]
    rejected_contexts: tuple[int, ...]
    threshold: int | None


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), upper, upper.lower())
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _by_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _grams(line: str) -> str:
    """SQL: for each character of a padded url, an array by context length of (bucket of context and character, bucket of context).

    Finding a character in a string takes steps in proportion to its place, so urls over LONG_URL characters are cut into an array first.
    """
    mask = BUCKETS - 1

    def each(part: str) -> str:
        g, c = part.format(n="o + 1"), part.format(n="o")
        return (
            f"transform(sequence({ORDER + 1}, length({line})), i -> transform(sequence(0, {ORDER}), o -> struct("
            f"cast(xxhash64({g}) & {mask} as int) as g, cast(xxhash64({c}) & {mask} as int) as c)))"
        )

    by_array = f"transform(array(split({line}, '')), y -> " + each("array_join(slice(y, i - o, {n}), '')") + ")[0]"
    return f"if(length({line}) <= {LONG_URL}, " + each("substring(" + line + ", i - o, {n})") + f", {by_array})"


def _padded(url: str) -> Column:
    """The lower-cased url between a start as long as the longest context and an end mark; null counts as empty."""
    return F.concat(F.lit("\x02" * ORDER), F.lower(F.coalesce(F.col(url), F.lit(""))), F.lit("\x03"))


def _score(model: Model) -> Column:
    """Mean over a url's characters of ln p(accepted) - ln p(rejected), in steps, from ``__grams``.

    Each context length mixes its own counts with the estimate of the next shorter one, which
    weighs BACK_OFF counts; the shortest rests on a uniform character. Strings and contexts share cells by hash, so in
    full tables an estimate is a smoothed ratio of counts that may exceed one; both classes use the same cells.
    """
    table = lambda counts: f"from_json('{json.dumps(counts, separators=(',', ':'))}', 'array<int>')"
    step = "({g}[x.g] + {b}D * p.{n}) / ({c}[x.c] + {b}D) as {n}"
    a = step.format(g=table(model.accepted), c=table(model.accepted_contexts), b=BACK_OFF, n="a")
    r = step.format(g=table(model.rejected), c=table(model.rejected_contexts), b=BACK_OFF, n="r")
    start = "struct(cast(1D / 256 as double) as a, cast(1D / 256 as double) as r)"
    each = f"aggregate(g, {start}, (p, x) -> struct({a}, {r}), p -> ln(p.a) - ln(p.r))"
    return F.expr(f"cast(floor({STEPS} * aggregate(__grams, 0D, (t, g) -> t + {each}) / size(__grams)) as bigint)")


def fit(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, url: str = "url") -> Model:
    """Character models of the urls that rules allow and of those that rules block, and a threshold.

    The models count all such urls. The threshold is set on urls that a model has not seen: models of half of the different urls
    score the other half, and the score that best parts their two classes is taken. What comes to the driver are the counts of
    2 * BUCKETS hashed strings for either class and a histogram of scores in 1 / STEPS nats.

    * without urls of one class among the scored there is no threshold; a null url fits no rule and teaches nothing;
    * equal urls of one class are counted together; a very long url is read whole; an empty input gives empty models.
    """
    host, path = split_url(F.col(url))
    known = pages.select(_by_rule(rules, host, path)[1].alias("v"), _padded(url).alias("line")).where("v is not null")
    known = known.groupBy("v", "line").agg(F.count(F.lit(1)).alias("n"))
    # few bytes, but much work for each: dealt to as many tasks as there are
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    known = cut(known.withColumn("counted", F.pmod(F.xxhash64("line", F.lit("half")), F.lit(2)) == 0).repartition(tasks, "v", "line"))
    grams = known.withColumn("__grams", F.expr(_grams("line")))
    each = grams.select("v", "n", F.when(F.col("counted"), F.col("n")).otherwise(0).alias("half"), F.explode(F.flatten("__grams")).alias("x"))
    both = each.select("v", "n", "half", F.explode(F.array(F.struct(F.lit("g").alias("k"), F.col("x.g").alias("b")), F.struct(F.lit("c").alias("k"), F.col("x.c").alias("b")))).alias("y"))
    tables = {name: {(v, k): [0] * BUCKETS for v in ("allow", "block") for k in "gc"} for name in ("n", "half")}
    for r in both.groupBy("v", "y").agg(F.sum("n").alias("n"), F.sum("half").alias("half")).collect():
        for name, table in tables.items():
            table[r.v, r.y.k][r.y.b] = r[name]
    whole, half = (Model(*(tuple(t[v, k]) for k in "gc" for v in ("allow", "block")), None) for t in tables.values())
    scored = grams.where("not counted").select((F.col("v") == "allow").cast("int").alias("good"), "n", _score(half).alias("s"))
    seen = scored.groupBy("good", "s").agg(F.sum("n").alias("n")).collect()
    return replace(whole, threshold=best_threshold([(r.s, r.good, r.n) for r in seen], 1.0))


def judge(pages: DataFrame, model: Model, rules: Sequence[tuple[str, str]] = RULES, url: str = "url") -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``score`` (nats a character) and ``verdict`` to every row.

    * the longest fitting rule decides (of two equally long the later by name); without one the
      url is allowed if its score reaches the threshold, and always if there is no threshold;
    * a null url is judged as an empty one; equal urls get equal verdicts;
    * input columns with the names of result columns are replaced; an empty input gives an empty result.
    """
    rows = without(pages, *[c for c in ADDED if c != url])
    host, path = split_url(F.col(url))
    rows = rows.withColumns({"__host": host, "__path": path, "__line": _padded(url)})
    rows = rows.withColumn("__grams", F.expr(_grams("__line"))).withColumn("__s", _score(model))
    rule, verdict = _by_rule(rules, F.col("__host"), F.col("__path"))
    passed = F.lit(True) if model.threshold is None else F.col("__s") >= model.threshold
    rows = rows.withColumns(
        {
            "host": F.col("__host"),
            "path": F.col("__path"),
            "rule": rule,
            "score": F.col("__s") / F.lit(float(STEPS)),
            "verdict": F.coalesce(verdict, F.when(passed, F.lit("allow")).otherwise(F.lit("block"))),
        }
    )
    return rows.drop("__host", "__path", "__line", "__grams", "__s")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, fit(pages)).select("page_id", "host", "path", "rule", "verdict", "score")
