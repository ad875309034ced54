"""Order-dependent folds within a position, entity linking, and the forest of dated identities."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.operators.components import connected_components
from vantage.operators.grams import overlap_join
from vantage.sources.shared import materialise


def same_beats(scenes: DataFrame, least_words: int = 4, least_shared: int = 2, ratio: float = 0.7) -> DataFrame:
    """``(pos, x, y)``: scenes of one position that recount one thing, ``x < y``.

    ``scenes`` has (id, pos, words, names). They share enough words, and at most one of them names someone whom the other does
    not: a fuller telling names more, but two different people make two scenes.
    """
    near = overlap_join(scenes.select("pos", "id", F.col("words").alias("set"), "names"), ["pos"], ratio, least_shared, least_words, "names")
    return near.where("only_x = 0 OR only_y = 0").select("pos", "x", "y")


def keep_first(scenes: DataFrame, least_words: int = 4, least_shared: int = 2, ratio: float = 0.7) -> DataFrame:
    """``(id, pos, kept, twin_of)``: scenes of a position in order; one that retells an earlier kept scene is folded into the first such.

    ``scenes`` has (id, pos, place, words, names). Likeness is no equivalence relation, so the order decides: a scene is
    kept once all earlier scenes like it are folded, and folded once one of them is kept. Rounds of joins over the like
    pairs alone settle all; no position is gathered in one task.
    """
    order = scenes.select(F.col("id"), F.struct("place", "id").alias("at"))
    beats = same_beats(scenes, least_words, least_shared, ratio)
    both = beats.join(order.select(F.col("id").alias("x"), F.col("at").alias("ax")), "x").join(order.select(F.col("id").alias("y"), F.col("at").alias("ay")), "y")
    early = F.col("ax") < F.col("ay")
    pairs = materialise(both.select(F.when(early, F.col("y")).otherwise(F.col("x")).alias("id"), F.when(early, F.col("x")).otherwise(F.col("y")).alias("before"), F.least("ax", "ay").alias("at")))
    open_ = materialise(pairs.select("id").union(pairs.select("before")).distinct())
    kept = folded = None
    while open_.head(1):
        waits = pairs.join(open_.withColumnRenamed("id", "before"), "before", "left_semi")
        fresh = materialise(open_.join(waits.select("id").distinct(), "id", "left_anti"))  # nothing earlier is undecided
        kept = fresh if kept is None else materialise(kept.unionByName(fresh))
        gone = materialise(pairs.join(open_, "id", "left_semi").join(fresh.withColumnRenamed("id", "before"), "before", "left_semi").select("id").distinct())
        folded = gone if folded is None else materialise(folded.unionByName(gone))
        open_ = materialise(open_.join(fresh, "id", "left_anti").join(gone, "id", "left_anti"))
    if kept is None:
        return scenes.select("id", "pos", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("twin_of"))
    twin = pairs.join(folded, "id", "left_semi").join(kept.withColumnRenamed("id", "before"), "before", "left_semi").groupBy("id").agg(F.min_by("before", "at").alias("twin_of"))
    return scenes.select("id", "pos").join(twin, "id", "left").select("id", "pos", F.col("twin_of").isNull().alias("kept"), "twin_of")


def name_spans(text: Column, names: list[str]) -> Column:
    """``array<struct<piece, name>>``: the text cut at whole-word names, the longest name first; pieces joined are the text."""
    pattern = re.compile("|".join(rf"(?<!\w){re.escape(n)}(?!\w)" for n in sorted(names, key=lambda n: (-len(n), n))))

    def cut(t: str) -> list[dict]:
        out, at = [], 0
        for m in pattern.finditer(t):
            if m.start() > at:
                out.append({"piece": t[at : m.start()], "name": None})
            out.append({"piece": m[0], "name": m[0]})
            at = m.end()
        if at < len(t):
            out.append({"piece": t[at:], "name": None})
        return out

    @F.pandas_udf("array<struct<piece:string,name:string>>")
    def spans(s: pd.Series) -> pd.Series:
        return s.map(cut, na_action="ignore")

    return spans(text)


def spanning_forest(edges: DataFrame, rank: Callable[[], list[Column]]) -> DataFrame:
    """Edges of the least spanning forest by ``rank``; ``edges`` has (id, src, dst) and the ranked columns.

    Every component takes its least edge that leads out of it, all at once, until none leads out: a logarithmic number of
    rounds. Cutting the forest at a date gives the components of that date.
    """
    own = materialise(edges.where("src <> dst"))
    nodes = own.select(F.col("src").alias("node")).union(own.select("dst")).distinct()
    comp = materialise(nodes.withColumn("root", F.col("node")))
    chosen = own.select("id", "src", "dst").limit(0)
    for _ in range(40):
        a = comp.select(F.col("node").alias("src"), F.col("root").alias("ra"))
        b = comp.select(F.col("node").alias("dst"), F.col("root").alias("rb"))
        out = own.join(a, "src").join(b, "dst").where("ra <> rb")
        best = out.withColumn("k", F.struct(*rank())).select(F.explode(F.array("ra", "rb")).alias("root"), "k", "id", "src", "dst").groupBy("root").agg(F.min_by(F.struct("id", "src", "dst"), "k").alias("e"))
        fresh = materialise(best.select("e.id", "e.src", "e.dst").distinct())
        if not fresh.head(1):
            return chosen
        chosen = materialise(chosen.unionByName(fresh).distinct())
        roots = connected_components(chosen.select("src", "dst"), materialise)
        comp = materialise(nodes.join(roots.withColumnRenamed("id", "node"), "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    raise RuntimeError("the forest did not settle")
