"""Boosting round by round, with a stop.

Each round grows one tree on the Newton step of the logistic loss: splits are those of the second-order gain with L1 and L2 terms, leaf values
-soft(G, alpha) / (H + lambda), times the learning rate. Every tree sees its own draw of the vector's slots.

All rows carry their margin: those that trees are grown from, and those that only measure (training and validation rows as they
were). After a round the loss of every part is known; training ends when validation has not improved for ``patience``
rounds, and the trees after the best round are dropped: nothing is fitted twice.

Rows are rewritten once as small whole numbers (``plans.histograms``) and dealt over as many tasks as run at a time, at least ``TASK_ROWS`` rows each.
The tasks of one stage, a barrier stage, grow run after run of rounds (1, 4, 16, ... of them) and add up their histograms level by level, so a
round costs no Spark job. After a run the rows with their margins are checkpointed: a lost executor repeats one run, and no plan holds the plans of the runs before.
"""

from __future__ import annotations

import pickle
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens import constants as K
from claimlens.plans import histograms as HI
from claimlens.plans.trees import BoostedTreesModel, Trees
from claimlens.session import ensure_checkpoint_dir

TASK_ROWS = 25_000  # rows of a task at least
FIT = "fit"
FOUND = -1          # number of the row that holds a run's trees and losses


@dataclass
class BoostConfig:
    max_iter: int = K.GBT_ROUNDS
    max_depth: int = 30
    step_size: float = K.GBT_LEARNING_RATE
    column_share: float = K.GBT_COLSAMPLE
    patience: int = K.GBT_EARLY_STOP
    alpha: float = K.GBT_ALPHA
    reg_lambda: float = K.GBT_LAMBDA
    min_leaf_weight: float = K.GBT_MIN_LEAF_WEIGHT
    max_bins: int = 32
    seed: int = K.SEED


@dataclass
class BoostResult:
    model: BoostedTreesModel
    best_iteration: int
    fitted: int                                   # rounds fitted: at most best_iteration + patience
    losses: dict[str, list[float]] = field(default_factory=dict)  # part -> mean logloss after each round


def stop_at(losses: list[float], patience: int) -> tuple[int, bool]:
    """(1-based round of the least loss so far, whether ``patience`` rounds have passed since)."""
    best = int(np.argmin(losses)) + 1
    return best, len(losses) - best >= patience


def leaf_value(g: float, h: float, cfg: BoostConfig) -> float:
    """The regularised Newton step of a leaf, times the learning rate."""
    return float(HI.leaf_values(np.float64(g), np.float64(h), cfg))


def logloss(label: Column, p: Column) -> Column:
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return F.when(label == 1, -F.log(p)).otherwise(-F.log(1 - p))


def drawn_slots(width: int, share: float, seed: int, turn: int) -> list[int]:
    n = max(1, round(width * share))
    return sorted(np.random.default_rng([seed, turn]).choice(width, n, replace=False).tolist())


class DecisionTreeRegressor:
    """Grows the trees of rounds ``first`` to ``end`` on binned rows, in the place of MLlib's learner of one tree."""

    def __init__(self, layout: HI.Layout, cfg: BoostConfig, width: int, watch: str, tasks: int, first: int, end: int, losses: dict[str, list[float]]):
        self.layout, self.cfg, self.width, self.watch, self.tasks = layout, cfg, width, watch, tasks
        self.first, self.end, self.before = first, end, losses

    def fit(self, rows: DataFrame) -> tuple[DataFrame, list[list[tuple]], dict[str, list[float]]]:
        """The rows with their new margins, checkpointed; the trees of this run, the losses of all rounds so far."""
        spark = rows.sparkSession
        layout, cfg, width, watch, tasks, first, end, before = (
            self.layout, self.cfg, self.width, self.watch, self.tasks, self.first, self.end, self.before)
        meet = f"{ensure_checkpoint_dir(spark).rstrip('/')}/claimlens-meet-{uuid.uuid4().hex[:12]}"

        def grow(blocks):
            context = (BarrierTaskContext if tasks > 1 else TaskContext).get()
            me = context.partitionId()
            attempt = min(context.allGather(f"{context.taskAttemptId():020d}")) if tasks > 1 else ""  # a stage that starts anew meets elsewhere
            g, sizes, back = HI.held(blocks, layout, FIT)
            g.total = HI.Exchange(f"{meet}/{attempt}", me, tasks).total
            names, trees, losses = layout.parts, [], {k: list(v) for k, v in before.items()}
            for turn in range(first, end):
                trees.append(g.tree(drawn_slots(width, cfg.column_share, cfg.seed, turn), cfg))
                for k, loss in g.losses(names.index(FIT)).items():
                    losses.setdefault(names[k], []).append(float(loss))
                if losses.get(watch) and stop_at(losses[watch], cfg.patience)[1]:
                    break
            kept, at = HI.given_back(g, back), 0
            for number, n in sizes:
                yield HI.part_of(kept, number, at, n)
                at += n
            if me == 0:
                yield HI.note(FOUND, pickle.dumps((trees, losses)))

        after = rows.mapInArrow(grow, BLOCK_DDL, barrier=tasks > 1).checkpoint()
        trees, losses = pickle.loads(after.where(F.col("at") == FOUND).select("body").collect()[0][0])  # all parts are read: Spark takes no less of a barrier stage
        return after, trees, losses


BLOCK_DDL = "at long, body binary, label binary, w binary, part binary, margin binary"


def slots_at_a_time(spark: SparkSession) -> int:
    """Tasks that run at a time, all of which a barrier stage needs."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def summarised(rows: DataFrame, width: int) -> HI.Summary:
    """One pass over all rows; a task passes on what it has seen, in bounded size."""

    def see(batches):
        seen = HI.Summary(width)
        for b in batches:
            seen.add(np.array(b.column(0).to_pylist(), object), b.column(1).to_numpy(zero_copy_only=False), b.column(2), FIT)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(seen.state())], pa.binary())], ["at", "body"])

    out = HI.Summary(width)
    for r in rows.select("part", "w", F.unwrap_udt("features").alias("v")).mapInArrow(see, "at int, body binary").sort("at").toLocalIterator():
        out.merge(pickle.loads(r["body"]))
    return out


def binned(rows: DataFrame, layout: HI.Layout, width: int) -> DataFrame:
    """Blocks of rows as numbers, one for each Arrow batch."""

    def cut(batches):
        task = TaskContext.get().partitionId()
        for k, b in enumerate(batches):
            if b.num_rows:
                part, label, w = (b.column(c) for c in range(3))
                yield HI.block((task << 32) + k, layout, np.array(part.to_pylist(), object), label.to_numpy(zero_copy_only=False), w.to_numpy(zero_copy_only=False), b.column(3), width)

    return rows.select("part", F.col("label").cast("int").alias("label"), "w", F.unwrap_udt("features").alias("v")).mapInArrow(cut, BLOCK_DDL)


def fit(rows: DataFrame, width: int, cfg: BoostConfig, watch: str = "val") -> BoostResult:
    """``rows``: part, label (0 or 1), w, features (``width`` slots). Trees grow from part ``fit``; losses of the others are measured, unweighted."""
    rows = rows.select("part", "label", F.col("w").cast("double").alias("w"), "features").persist(StorageLevel.MEMORY_AND_DISK)  # read twice
    seen = summarised(rows, width)
    if not seen.weight:
        raise ValueError("no rows to grow trees from")
    layout = HI.Layout.of(seen, cfg.max_bins)
    tasks = max(1, min(slots_at_a_time(rows.sparkSession), -(-seen.rows // TASK_ROWS)))
    state = binned(rows, layout, width).repartition(tasks)
    grown, losses = [], {}
    for first, end in HI.rounds(cfg.max_iter):
        learner = DecisionTreeRegressor(layout, cfg, width, watch, tasks, first, end, losses)
        state, trees, losses = learner.fit(state.where(F.col("at") != FOUND))
        grown += trees
        if not first:
            rows.unpersist()
        if losses.get(watch) and stop_at(losses[watch], cfg.patience)[1]:
            break
    best = stop_at(losses[watch], cfg.patience)[0] if losses.get(watch) else len(grown)
    return BoostResult(BoostedTreesModel(Trees.of(grown[:best])), best, len(grown), losses)
