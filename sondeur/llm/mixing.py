"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic. Token weights of the
cells are raked in turn to the targets of each of the three dimensions until all
marginals hold. A document is then drawn with the probability of its cell,
proportional to the cell's calibrated weight per token and scaled so that the
expected number of tokens is a given share of all; a probability that would
pass 1 is 1, and the others take up what it leaves.

Targets are shares by value; without them a dimension's shares are its token
counts to a power below 1, which lifts the small ones.

Cells are few beside documents, but their number is not bounded by the code, so
it is checked: up to MAX_CELLS the driver rakes the cells' sums, beyond that the
same steps run as joins and sums of tables.

The topic of a text is its form, from counts over the whole text: shouting,
table, symbols, or else short, medium and long prose.

Defined results: a null source, language or text is the value `(none)` and an
empty text; a text without words has 0 tokens, no weight in its cell and its
cell's probability (1 in a cell without tokens). Draws hash doc_id and text, so
repeated rows are drawn alike. A value with a target but without documents gets
nothing, and its share goes to the others. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS = ("source", "lang", "topic")
#: Power of the token counts for targets that are not given.
TEMPER = {"source": 0.7, "lang": 0.6, "topic": 0.8}
SHARE = 0.5
MAX_CELLS = 100_000
SWEEPS, CLOSE = 60, 1e-9
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = "*#$%&@^~=+<>_{}[]\\/"


def features(text: Column) -> dict[str, Column]:
    """tokens (runs of other than white space) and topic of whole texts."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    n = F.char_length(t)
    removed = lambda chars: n - F.char_length(F.translate(t, chars, ""))
    tokens = F.regexp_count(t, F.lit(r"\S+")).cast("long")
    topic = (
        F.when(removed("|") > 0.1 * tokens, "table")
        .when(removed(_UPPER) > 0.4 * n, "shouting")
        .when(removed(_SYMBOLS) > 0.08 * n, "symbols")
        .when(tokens < 150, "short")
        .when(tokens < 1000, "medium")
        .otherwise("long")
    )
    return {"tokens": tokens, "topic": topic}


def _draw(seed: int) -> Column:
    """Even in [0, 1), from doc_id and text."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text").cast("string")), F.lit(1 << 52)) / F.lit(float(1 << 52))


def described(docs: DataFrame, seed: int = 1) -> DataFrame:
    """docs with _source, _lang, _topic, _tokens, _u."""
    f = features(F.col("text"))
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.withColumns({"_source": none("source"), "_lang": none("lang"), "_topic": f["topic"], "_tokens": f["tokens"], "_u": _draw(seed)})


def shares(totals: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    """Targets that add up to 1, of the values that have tokens."""
    raw = {v: (given.get(v, 0.0) if given is not None else n**power) for v, n in totals.items() if n > 0}
    total = sum(raw.values())
    return {v: x / total for v, x in raw.items()} if total else {}


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]]) -> np.ndarray:
    """Weights of cells (columns of DIMENSIONS and tokens), which add up to 1 and have the targets as marginals."""
    w = cells["tokens"].to_numpy(float)
    w = w / max(w.sum(), 1e-300)
    coded = []
    for d in DIMENSIONS:
        codes, values = pd.factorize(cells[d])
        coded.append((codes, np.array([targets[d].get(v, 0.0) for v in values])))
    for _ in range(SWEEPS):
        off = 0.0
        for codes, target in coded:
            now = np.bincount(codes, weights=w, minlength=len(target)).astype(float)
            off = max(off, float(np.abs(now - target).max(initial=0)))
            w = w * np.divide(target, now, out=np.zeros_like(now), where=now > 0)[codes]
        if off < CLOSE:
            break
    return w


def rake_table(cells: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """rake() by joins. targets: tables of value and target. Returns the cells with weight."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 1.0
    now = common.stored(cells.withColumn("weight", F.col("tokens") / F.lit(total)), "cells")
    for _ in range(SWEEPS):
        step, off = now, []
        for d in DIMENSIONS:
            sums = step.groupBy(F.col(d).alias("_v")).agg(F.sum("weight").alias("_now")).join(targets[d].select(F.col("value").alias("_v"), "target"), "_v", "left")
            sums = sums.select("_v", F.coalesce("target", F.lit(0.0)).alias("_target"), "_now", F.when(F.col("_now") > 0, F.coalesce("target", F.lit(0.0)) / F.col("_now")).otherwise(0.0).alias("_factor"))
            step = step.join(sums.select("_v", "_factor", F.abs(F.col("_now") - F.col("_target")).alias(f"_off_{d}")), step[d] == F.col("_v")).withColumn("weight", F.col("weight") * F.col("_factor")).drop("_v", "_factor")
            off.append(f"_off_{d}")
        step = common.stored(step.withColumn("_off", F.greatest(*off)).drop(*off), "cells")
        worst = step.agg(F.max("_off")).first()[0]
        now = step.drop("_off")
        if worst is None or worst < CLOSE:
            break
    return now


def scale(tokens: np.ndarray, weight: np.ndarray, budget: float) -> float:
    """The factor that makes sum(min(tokens, factor * weight)) the budget (or all that can be had)."""
    has = (weight > 0) & (tokens > 0)
    t, w = tokens[has], weight[has]
    if not len(t) or budget >= t.sum():
        return float((t / w).max() * 2) if len(t) else 1.0
    order = np.argsort(t / w)
    t, w = t[order], w[order]
    full = np.concatenate(([0.0], np.cumsum(t)[:-1]))
    rest = np.cumsum(w[::-1])[::-1]
    factor = (budget - full) / rest
    k = int(np.argmax(factor <= t / w)) if (factor <= t / w).any() else len(t) - 1
    return float(factor[k])


def calibrate(seen: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """_source, _lang, _topic, weight per token, probability, and whether the table is small. seen: rows of described()."""
    cells = common.stored(seen.groupBy(*[F.col(f"_{d}").alias(d) for d in DIMENSIONS]).agg(F.sum("_tokens").alias("tokens")), "cells")
    small = cells.limit(max_cells + 1).count() <= max_cells
    given = targets or {}
    spark = seen.sparkSession
    if small:
        local = cells.orderBy(*DIMENSIONS).toPandas()
        goal = {d: shares(local.groupby(d)["tokens"].sum().to_dict(), TEMPER[d], given.get(d)) for d in DIMENSIONS}
        w = rake(local, goal)
        tokens = local["tokens"].to_numpy(float)
        per = np.divide(w * tokens.sum(), tokens, out=np.zeros(len(local)), where=tokens > 0)
        factor = scale(tokens, w, share * tokens.sum())
        p = np.where(tokens > 0, np.minimum(1.0, np.divide(factor * w, tokens, out=np.ones(len(local)), where=tokens > 0)), 1.0)
        rows = [(*k, float(a), float(b)) for k, a, b in zip(local[list(DIMENSIONS)].itertuples(index=False), per, p)]
        return spark.createDataFrame(rows, "_source string, _lang string, _topic string, weight double, probability double"), True
    goals = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("tokens").alias("n")).where("n > 0")
        if d in given:
            sums = sums.join(spark.createDataFrame([(k, float(v)) for k, v in given[d].items()], "value string, raw double"), "value")
        else:
            sums = sums.withColumn("raw", F.pow(F.col("n").cast("double"), F.lit(TEMPER[d])))
        goals[d] = sums.crossJoin(sums.agg(F.sum("raw").alias("all"))).select("value", (F.col("raw") / F.col("all")).alias("target"))
    raked = common.stored(rake_table(cells, goals), "raked")
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    lo, hi = 0.0, 1.0
    had = lambda f: raked.agg(F.sum(F.least(F.col("tokens").cast("double"), F.lit(f) * F.col("weight")))).first()[0] or 0.0
    most = had(1e300)
    while had(hi) < min(share * total, most * (1 - 1e-12)):
        lo, hi = hi, hi * 4
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if had(mid) < share * total else (lo, mid)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(hi) * F.col("weight") / F.col("tokens"))).otherwise(1.0)
    per = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(float(total)) / F.col("tokens")).otherwise(0.0)
    return raked.select(*[F.col(d).alias(f"_{d}") for d in DIMENSIONS], per.alias("weight"), p.alias("probability")), False


def drawn(seen: DataFrame, cells: DataFrame, small: bool) -> DataFrame:
    """Rows of described() with _weight, _probability and _sampled."""
    cells = cells.select(*[F.col(f"_{d}").alias(f"_of_{d}") for d in DIMENSIONS], F.col("weight").alias("_weight"), F.col("probability").alias("_probability"))
    found = seen.join(F.broadcast(cells) if small else cells, [F.col(f"_{d}") == F.col(f"_of_{d}") for d in DIMENSIONS]).drop(*[f"_of_{d}" for d in DIMENSIONS])
    return found.withColumn("_sampled", F.col("_u") < F.col("_probability"))


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, share: float = SHARE, seed: int = 1) -> DataFrame:
    """The drawn rows of docs, with their columns."""
    # Rows travel in one column, so that no name of theirs clashes, and texts are read once for both uses.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")).select("_row", *[F.col(f"_row.{c}").alias(c) for c in ("doc_id", "text", "source", "lang")])
    seen = common.stored(described(rows, seed).drop("doc_id", "text", "source", "lang"), "described")
    cells, small = calibrate(seen.select("_source", "_lang", "_topic", "_tokens"), targets, share)
    return drawn(seen, cells, small).where("_sampled").select("_row.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Cell, weight per token, probability and draw of all documents."""
    docs = common.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    seen = common.stored(described(docs).drop("text", "source", "lang"), "described")
    cells, small = calibrate(seen)
    return drawn(seen, cells, small).select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
        F.col("_weight").alias("weight"), F.col("_probability").alias("probability"), F.col("_sampled").alias("sampled"),
    )
