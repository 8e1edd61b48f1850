"""Top N items within every group, by a loser-tree merge of sorted runs.

Every input partition becomes sorted runs (one per Arrow batch), ordered by group and score. Runs are merged by a loser
tree; once a group has given N items, every run seeks to the start of its next group. What leaves a partition is again a
sorted run with at most N items a group, so a hot group shrinks before any shuffle. The shuffle buckets the runs by group
and the same merge runs once more. With very many runs, a salted level in between bounds what one task receives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Runs that are merged at once; more are merged in several passes.
FAN_IN = 32
#: Input partitions beyond which a salted level bounds the rows of a hot group in one task.
SALT_ABOVE = 256


class LoserTree:
    """Tournament over sorted runs: ``heads`` gives the current key of each run, None once it is exhausted."""

    def __init__(self, heads: list):
        self.heads = heads
        self.size = len(heads)
        self.losers = [-1] * max(self.size, 1)
        for run in range(self.size):
            self._insert(run)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _insert(self, run: int) -> None:
        """First round: a run waits at the first empty node on its way up."""
        node = (run + self.size) // 2
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = run
                return
            if self._beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run

    def winner(self) -> int:
        return self.losers[0]

    def replay(self, run: int) -> None:
        """The head of ``run``, the last winner, has changed: play its way up again."""
        node = (run + self.size) // 2
        while node > 0:
            if self._beats(self.losers[node], run):
                self.losers[node], run = run, self.losers[node]
            node //= 2
        self.losers[0] = run


class Run:
    """Rows in order (group, score descending, tie); ``starts`` are the offsets at which groups begin."""

    def __init__(self, groups: list[tuple], scores: list[float], ties: list, starts: np.ndarray):
        self.groups, self.scores, self.ties, self.starts = groups, scores, ties, starts

    @classmethod
    def of(cls, pdf: pd.DataFrame, group: list[str], score: str, tie: str, n: int) -> Run:
        """One batch as a run: repeated items count once, by their best score, and a group keeps its first n."""
        by = []
        for c in group:
            missing = pdf[c].isna()
            by += [missing.to_numpy(), pdf[c].where(~missing, "" if pdf[c].dtype == object else 0)]
        keys = pd.DataFrame({i: np.asarray(x) for i, x in enumerate(by)})
        keys["score"], keys["tie"] = -pdf[score].to_numpy(), pdf[tie].to_numpy()
        cols = list(range(len(by)))
        keys = keys.sort_values([*cols, "score", "tie"], kind="stable")
        keys = keys[~keys.duplicated([*cols, "tie"])]
        keys = keys[keys.groupby(cols, sort=False).cumcount() < n]
        groups = list(zip(*(keys[c].tolist() for c in cols), strict=True))
        first = ~keys.duplicated(cols).to_numpy()
        return cls(groups, keys["score"].tolist(), keys["tie"].tolist(), np.flatnonzero(first))

    def __len__(self) -> int:
        return len(self.groups)


def merge(runs: list[Run], n: int) -> Run:
    """The first n distinct items of every group over all runs, as one run."""
    at = [0] * len(runs)
    tree = LoserTree([(r.groups[0], r.scores[0], r.ties[0]) if len(r) else None for r in runs])
    groups: list[tuple] = []
    scores: list[float] = []
    ties: list = []
    starts: list[int] = []
    now, taken = None, set()
    while runs and (head := tree.heads[w := tree.winner()]) is not None:
        run = runs[w]
        if head[0] != now:
            now, taken = head[0], set()
            starts.append(len(groups))
        if len(taken) < n:
            if head[2] not in taken:
                taken.add(head[2])
                groups.append(head[0])
                scores.append(head[1])
                ties.append(head[2])
            at[w] += 1
        else:  # seek: the group is complete, so this run goes on at its next group
            k = int(np.searchsorted(run.starts, at[w], side="right"))
            at[w] = int(run.starts[k]) if k < len(run.starts) else len(run)
        i = at[w]
        tree.heads[w] = (run.groups[i], run.scores[i], run.ties[i]) if i < len(run) else None
        tree.replay(w)
    return Run(groups, scores, ties, np.asarray(starts, dtype=np.int64))


def top_n(df: DataFrame, group: list[str], score: str, tie: str, n: int, salt_above: int = SALT_ABOVE) -> DataFrame:
    """Per ``group`` the ``n`` rows of highest ``score``; equal scores go to the smaller ``tie``.

    Columns out: the group's columns, ``tie`` and ``score``. NULL or NaN scores and NULL ties never count. A NULL in a
    group column is a group of its own. A ``tie`` that occurs several times in a group counts once, by its best score.
    Groups with fewer than n items give what they have; an empty table gives no rows. Other columns are not read.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    rows = df.select(*group, tie, F.col(score).cast("double").alias(score)).filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(tie).isNotNull())
    width = len(group)

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: list[Run] = []
        for pdf in batches:
            if len(pdf):
                runs.append(Run.of(pdf, group, score, tie, n))
            if len(runs) >= FAN_IN:
                runs = [merge(runs, n)]
        out = merge(runs, n)
        if not len(out):
            return
        data = {c: [None if g[2 * i] else g[2 * i + 1] for g in out.groups] for i, c in enumerate(group[:width])}
        yield pd.DataFrame(data | {tie: out.ties, score: [-x for x in out.scores]}, columns=[*group, tie, score])

    def level(part: DataFrame) -> DataFrame:
        return part.mapInPandas(merged, rows.schema)

    runs = level(rows)
    if rows.rdd.getNumPartitions() > salt_above:
        salt = F.spark_partition_id() % 64
        runs = level(runs.withColumn("_salt", salt).repartition(*group, "_salt").drop("_salt"))
    return level(runs.repartition(*group))
