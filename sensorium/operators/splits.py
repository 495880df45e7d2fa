"""Stratified splits of blocks into training, test and validation.

Block ids are a small dimension (weeks), so the draws happen on the driver; frames are split by a broadcast join.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlockSplitter:
    """Strata are runs of `stratum` consecutive blocks; test takes one block of each, folds one of the others each.

    Three streams (test, folds, last validation) come from one seed, so that each draw is independent of the others.
    """

    def __init__(self, blocks: list[int], stratum: int = 5, seed: int = 2658918):
        self.blocks, self.stratum, self.seed = sorted(blocks), stratum, seed
        if len(self.blocks) < stratum:
            raise ValueError("fewer blocks than a stratum has")
        self.test_rng, self.fold_rng, self.last_rng = (np.random.default_rng(s) for s in np.random.SeedSequence(seed).spawn(3))

    def strata(self, blocks: list[int] | None = None) -> list[list[int]]:
        own = self.blocks if blocks is None else blocks
        return [own[k : k + self.stratum] for k in range(0, len(own), self.stratum)]

    def train_test(self) -> tuple[list[int], list[int]]:
        """One test block of each stratum, whole or not."""
        test = [int(self.test_rng.choice(s, size=1, replace=False)[0]) for s in self.strata()]
        return sorted(set(self.blocks) - set(test)), sorted(test)

    def folds(self, train: list[int], test: list[int]) -> list[tuple[list[int], list[int]]]:
        """stratum - 1 folds (train, validation): each training block is in exactly one validation set. Strata with one
        block for each fold are shuffled; blocks of others go to random folds after that."""
        k, held = self.stratum - 1, set(test)
        left = [[b for b in s if b not in held] for s in self.strata()]
        members: list[list[int]] = [[] for _ in range(k)]
        for own in left:
            if len(own) == k:
                self.fold_rng.shuffle(own)
                for place, b in enumerate(own):
                    members[place].append(b)
        for b in (b for own in left if len(own) != k for b in own):
            members[int(self.fold_rng.choice(k))].append(b)
        return [(sorted(set(train) - set(m)), sorted(m)) for m in members]

    def last_validation(self, train: list[int], folds: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
        """For each place up to the shortest validation set of the folds, one of the blocks that they have there."""
        sets = [v for _, v in folds]
        if not all(sets):
            raise ValueError("a fold has no validation block")
        held = [int(self.last_rng.choice([v[i] for v in sets], size=1)[0]) for i in range(min(map(len, sets)))]
        return sorted(set(train) - set(held)), sorted(held)

    def single_validation(self, train: list[int]) -> tuple[list[int], list[int]]:
        """Without folds: one validation block of each stratum's training blocks; of a lone one with the chance of a
        fold's share."""
        held = []
        for s in self.strata():
            own = [b for b in s if b in set(train)]
            if len(own) > 1 or own and self.last_rng.random() < 1 / (self.stratum - 1):
                held.append(int(self.fold_rng.choice(own)))
        return sorted(set(train) - set(held)), sorted(held)

    def table(self, spark: SparkSession) -> DataFrame:
        """fold (-1: train and test; -2: last validation), role, block_id."""
        train, test = self.train_test()
        rows = [(-1, "train", b) for b in train] + [(-1, "test", b) for b in test]
        folds = self.folds(train, test)
        for k, (t, v) in enumerate(folds):
            rows += [(k, "train", b) for b in t] + [(k, "validation", b) for b in v]
        t, v = self.last_validation(train, folds)
        rows += [(-2, "train", b) for b in t] + [(-2, "validation", b) for b in v]
        return spark.createDataFrame(rows, "fold int, role string, block_id int")


def part(df: DataFrame, splits: DataFrame, fold: int, role: str) -> DataFrame:
    """The rows of df whose block has a role in a fold."""
    own = splits.where((F.col("fold") == fold) & (F.col("role") == role)).select("block_id")
    return df.join(F.broadcast(own), "block_id", "left_semi")
