"""Tuning over runs: rewards and scores as expressions, neighbour configurations, and climbers over a table of runs."""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of the parameters.
CELL_BOUNDS, PROBE_BOUNDS = (64, 65536), (1, 1024)
TARGET = 0.98


def stamp(c: Column, i: Column, p: Column) -> Column:
    return F.concat(F.lit("c"), c.cast("string"), F.lit("_i"), i.cast("string"), F.lit("_p"), p.cast("string"))


def reward(recall: Column, ms: Column, target: float = TARGET) -> Column:
    """1000 / time at the target recall or above; below, divided by 1 + 1000 times the shortfall."""
    speed = F.lit(1000.0) / F.nullif(ms, F.lit(0.0))
    return F.when(recall >= target, speed).otherwise(speed / (1 + 1000 * (target - recall)))


def score_compat(recall: Column, ms: Column, target: float = TARGET) -> Column:
    """The score as first written: below the target it grows with the shortfall."""
    return F.when(recall >= target, (20 - ms) * 7 + (recall - target) * 100).otherwise(ms + F.pow(F.lit(10.0), (target - recall) * 100))


def score(recall: Column, ms: Column, target: float = TARGET) -> Column:
    """The score as meant: below the target the shortfall's penalty is taken off, so larger is always better."""
    return F.when(recall >= target, (20 - ms) * 7 + (recall - target) * 100).otherwise(-(ms + F.pow(F.lit(10.0), (target - recall) * 100)))


def neighbours(configs: DataFrame, jitter_seed: int | None = None) -> DataFrame:
    """``(num_centroids, nprobe, n, c, p)``: the eight configurations around each, numbered, inside the bounds.

    Steps are a tenth of the cells (32 at least) and an eighth of the probes (4 at least), alone and together.
    With a seed, four random single steps follow as 9 to 12: 32 to 95 cells, 4 to 11 probes, by the hash of seed and configuration.
    """
    c, p = F.col("num_centroids"), F.col("nprobe")
    dc = F.greatest(F.floor(c / 10), F.lit(32)).cast("int")
    dp = F.greatest(F.floor(p / 8), F.lit(4)).cast("int")
    around = [(dc, 0), (-dc, 0), (0, dp), (0, -dp), (dc, dp), (dc, -dp), (-dc, dp), (-dc, -dp)]
    if jitter_seed is not None:
        named = lambda salt: F.concat_ws(":", F.lit(jitter_seed), F.lit(salt), c, p)
        draw = lambda salt, span, low: (F.conv(F.substring(F.md5(named(salt)), 1, 8), 16, 10).cast("bigint") % span).cast("int") + low
        rc, rp = draw(1, 64, 32), draw(2, 8, 4)
        around += [(rc, 0), (-rc, 0), (0, rp), (0, -rp)]
    each = F.array(*(F.struct(F.lit(n).alias("n"), (c + a).cast("int").alias("c"), (p + b).cast("int").alias("p")) for n, (a, b) in enumerate(around, 1)))
    inside = F.col("c").between(*CELL_BOUNDS) & F.col("p").between(*PROBE_BOUNDS)
    return configs.select("num_centroids", "nprobe", F.explode(each).alias("e")).select("num_centroids", "nprobe", "e.*").where(inside)


def ratio_window(spark: SparkSession, cells: list[int], probes: list[int], low: float, high: float) -> DataFrame:
    """``(c, p)``: the pairs whose ratio p / c lies in a window."""
    rows = spark.createDataFrame([(c,) for c in cells], "c int").select("c", F.explode(F.array(*(F.lit(p) for p in probes))).alias("p"))
    return rows.where((F.col("p") / F.col("c")).between(low, high))


@dataclass
class Step:
    step: int
    kind: str
    c: int
    p: int
    recall: float
    ms: float
    reward: float


Measure = Callable[[list[tuple[int, int, int]]], dict[tuple[int, int, int], tuple[float, float]]]


def from_runs(runs: DataFrame) -> Measure:
    """Looks configurations up in a table of runs: of the nearest run with the same rounds (in relative distance), its recall and time."""

    known = runs.where("recall IS NOT NULL AND avg_query_time_ms IS NOT NULL")

    def measure(configs: list[tuple[int, int, int]]) -> dict:
        spark = runs.sparkSession
        asked = spark.createDataFrame(configs, "c int, i int, p int")
        gap = F.abs(F.log(F.col("num_centroids") / F.col("c"))) + F.abs(F.log(F.col("nprobe") / F.col("p")))
        near = known.join(F.broadcast(asked), F.col("kmeans_iter") == F.col("i")).groupBy("c", "i", "p")
        rows = near.agg(F.min_by(F.struct("recall", "avg_query_time_ms"), F.struct(gap, "num_centroids", "nprobe", "recall", "avg_query_time_ms")).alias("r")).collect()
        return {(x["c"], x["i"], x["p"]): (x["r"]["recall"], x["r"]["avg_query_time_ms"]) for x in rows}  # one row a configuration

    return measure


def _reward(recall: float, ms: float, target: float) -> float:
    speed = 1000.0 / ms if ms else 0.0
    return speed if recall >= target else speed / (1 + 1000 * (target - recall))


def _around(c: int, p: int) -> list[tuple[int, int]]:
    dc, dp = max(c // 10, 32), max(p // 8, 4)
    every = [(c + a * dc, p + b * dp) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1))]
    return [(x, y) for x, y in every if CELL_BOUNDS[0] <= x <= CELL_BOUNDS[1] and PROBE_BOUNDS[0] <= y <= PROBE_BOUNDS[1]]


def hill_climb(measure: Measure, c: int = 2564, p: int = 42, i: int = 16, target: float = TARGET, fast_ms: float = 2.0, max_steps: int = 50) -> list[Step]:
    """The path of a climb by reward: to the best neighbour, until none is better or recall and time are good enough.

    ``measure`` gets all neighbours of a step at once, so a step is one job.
    """
    path: list[Step] = []
    got = measure([(c, i, p)]).get((c, i, p))
    if got is None:
        return path
    here = _reward(*got, target)
    path.append(Step(0, "current", c, p, *got, here))
    for n in range(1, max_steps + 1):
        seen = measure([(x, i, y) for x, y in _around(c, p)])
        tried = [Step(n, "neighbor", x, y, *r, _reward(*r, target)) for (x, _, y), r in sorted(seen.items())]
        path += tried
        best = max(tried, key=lambda s: (s.reward, -s.c, -s.p), default=None)
        if best is None or best.reward <= here:
            break
        c, p, here = best.c, best.p, best.reward
        path.append(Step(n, "best", c, p, best.recall, best.ms, here))
        if best.recall >= target and best.ms < fast_ms:
            break
    return path


@dataclass
class Adaptive:
    """A greedy search with relative steps that grow with success and shrink with failure."""

    # Bounds, first, least and largest relative steps.
    bounds: dict[str, tuple[int, int]] = field(default_factory=lambda: {"c": (64, 16384), "p": (1, 2048), "i": (1, 32)})
    size: dict[str, float] = field(default_factory=lambda: {"c": 0.05, "p": 0.15, "i": 0.05})
    low: dict[str, float] = field(default_factory=lambda: {"c": 0.01, "p": 0.02, "i": 0.01})
    high: dict[str, float] = field(default_factory=lambda: {"c": 0.3, "p": 0.4, "i": 0.2})
    seed: int = 0
    failures: int = 0  # moves in a row that gained little
    gains: list[float] = field(default_factory=list)  # relative gains of the last ten moves

    def _step(self, k: str, widen: float) -> float:
        """The relative step of a parameter now: shorter after many poor moves, longer after a good one."""
        size = min(self.size[k] * widen, self.high[k])
        if self.failures > 3:
            return max(size * 0.8, self.low[k])
        return min(size * 1.1, self.high[k]) if self.gains and not self.failures else size

    def near(self, at: dict[str, int], widen: float = 1.0) -> list[dict[str, int]]:
        """Each parameter alone one step up and down, and where these are fewer than eight, up to three mixed steps of cells and probes."""
        out: dict[tuple, dict[str, int]] = {}

        def offer(**new: int) -> None:
            x = at | {k: min(max(v, self.bounds[k][0]), self.bounds[k][1]) for k, v in new.items()}
            if x != at:
                out[tuple(sorted(x.items()))] = x

        for k in at:
            step = self._step(k, widen)
            for way in (1, -1):
                offer(**{k: at[k] + way * max(1, int(at[k] * step)) if k == "i" else int(at[k] * (1 + way * step))})
        if len(out) < 8:
            r = random.Random(self.seed + len(self.gains) + at["c"])
            for _ in range(3):
                offer(**{k: int(at[k] * (1 + r.choice((1, -1)) * self.size[k] * (0.5 + r.random()))) for k in ("c", "p")})
        return list(out.values())

    def learn(self, gain: float) -> None:
        """After a move with a relative gain: steps grow by a twentieth if it is over a hundredth, else they shrink by a tenth."""
        self.gains = [*self.gains, gain][-10:]
        good = gain > 0.01
        self.failures = 0 if good else self.failures + 1
        for k in self.size:
            self.size[k] = min(self.size[k] * 1.05, self.high[k]) if good else max(self.size[k] * 0.9, self.low[k])

    def converged(self) -> bool:
        return self.failures >= 5 and all(self.size[k] <= self.low[k] * 1.1 for k in self.size)

    def search(self, measure: Measure, start: dict[str, int], target: float = TARGET, rounds: int = 30) -> list[tuple[dict[str, int], float]]:
        """The configurations gone through with their scores, each better than the one before.

        A round tries all near configurations at once; without a better one it tries steps half as long again,
        and without one there the search ends, as it does when all steps have shrunk to the least.
        """

        def scores(configs: list[dict[str, int]]) -> list[tuple[float, dict[str, int]]]:
            got = measure([(x["c"], x["i"], x["p"]) for x in configs])
            out = []
            for x in configs:
                r = got.get((x["c"], x["i"], x["p"]))
                if r:
                    short = target - r[0]
                    out.append(((20 - r[1]) * 7 - short * 100 if short <= 0 else -(r[1] + 10 ** min(short * 100, 300)), x))
            return out

        first = scores([start])
        if not first:
            return []
        best, at = first[0]
        path = [(at, best)]
        for _ in range(rounds):
            found = None
            for widen in (1.0, 1.5) if self.failures < 5 else (1.0,):
                found = max(scores(self.near(at, widen)), key=lambda s: s[0], default=None)
                if found and found[0] > best + 1e-6:
                    if widen == 1.0:
                        self.learn((found[0] - best) / (abs(best) + 1e-6))
                    break
                found = None
            if found is None:
                break
            best, at = found
            path.append((at, best))
            if self.converged():
                break
        return path


def from_models(time_of: tuple[float, float, float], theta: float, points: int) -> Measure:
    """Configurations by fitted models: T = a P ln C + b P N / C + d and R = 1 - (1 - P/C)^theta."""
    a, b, d = time_of

    def measure(configs: list[tuple[int, int, int]]) -> dict:
        return {(c, i, p): (1 - (1 - min(p / c, 1.0)) ** theta, max(a * p * math.log(c) + b * p * points / c + d, 0.0)) for c, i, p in configs}

    return measure
