"""Next-character model over contexts of several lengths, with back-off (interpolated Kneser-Ney).

The longest contexts are counted once over the corpus; every shorter table comes
from the one above it.  The longest has plain counts, a shorter one continuation
counts (how many different characters precede context and next character), and
each length its discount from the counts of counts.  What the discount takes
away goes to the next shorter context, in the end to a uniform share of all
characters and one unknown, so the probabilities of a context sum to 1.

Contexts that occur less than ``min_count`` times are pruned; they, like contexts
never seen, are read at the next shorter length.  A shorter context occurs at
least as often as a longer one that ends in it, so what a kept context falls back
on is kept as well.  Tables are written once per length; their joins are on (context,
character), where one row meets at most as many as there are characters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.operators.text import DEFAULT_BLOCK, ROWS_PER_BUCKET, _model_table, t_windows
from caseflow.session import reliable_checkpoint, shared_table

#: A discount stays within these bounds, so no seen character loses all and some mass is always passed on.
LEAST_DISCOUNT, MOST_DISCOUNT = 0.1, 0.9


@dataclass
class BackoffModel:
    """Per context length k: ``probs[k]`` (ctx, next_char, p) of seen pairs and ``weights[k]`` (ctx, g: the
    share left to the shorter context); and the number of characters, the unknown one included."""

    probs: list[DataFrame]
    weights: list[DataFrame]
    discounts: list[float]
    n_chars: int

    @property
    def order(self) -> int:
        return len(self.probs) - 1


def context_counts(df: DataFrame, order: int, text_col: str = "text", order_col: str = "id", block: int = DEFAULT_BLOCK) -> list[DataFrame]:
    """Per context length 0 to ``order``: (ctx, next_char, raw, cnt), as written tables; ``cnt`` is the
    raw count at the greatest length, else the number of different characters before."""
    w = t_windows(df, text_col, order_col, order, block)
    top = w.groupBy(F.col("window").alias("ctx"), "next_char").agg(F.count(F.lit(1)).alias("raw"))
    tables = [shared_table(top.withColumn("cnt", F.col("raw")), "contexts")]
    for _ in range(order):
        shorter = tables[0].groupBy(F.expr("substring(ctx, 2)").alias("ctx"), "next_char").agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("cnt"))
        tables.insert(0, shared_table(shorter, "contexts"))
    return tables


def t_backoff_model(df: DataFrame, order: int, text_col: str = "text", order_col: str = "id", min_count: int = 1,
                    block: int = DEFAULT_BLOCK) -> BackoffModel | None:
    """The model of a corpus (lines in ``order_col`` order); None if it has no window of ``order`` characters."""
    probs, weights, discounts, below, n_chars = [], [], [], None, 0
    for k, counts in enumerate(context_counts(df, order, text_col, order_col, block)):
        n = counts.agg(F.sum((F.col("cnt") == 1).cast("long")).alias("one"), F.sum((F.col("cnt") == 2).cast("long")).alias("two"), F.count("*").alias("all")).first()
        if not n["all"]:
            return None
        d = min(MOST_DISCOUNT, max(LEAST_DISCOUNT, n.one / (n.one + 2 * n.two) if n.one + n.two else 0.0))
        total = counts.groupBy("ctx").agg(F.sum("raw").alias("raw"), F.sum("cnt").alias("total"), F.count("*").alias("kinds"))
        if k:
            total = total.where(F.col("raw") >= min_count)
        total = shared_table(total.select("ctx", "total", (F.lit(d) * F.col("kinds") / F.col("total")).alias("g")), "context-totals")
        seen = counts.join(total, "ctx")
        if k:
            lower = below.select(F.col("ctx").alias("_short"), "next_char", F.col("p").alias("_lower"))
            seen = seen.withColumn("_short", F.expr("substring(ctx, 2)")).join(lower, ["_short", "next_char"])
        else:
            n_chars = n["all"] + 1
            seen = seen.withColumn("_lower", F.lit(1.0 / n_chars))
        below = shared_table(seen.select("ctx", "next_char", ((F.col("cnt") - F.lit(d)) / F.col("total") + F.col("g") * F.col("_lower")).alias("p")), "backoff")
        probs.append(below)
        weights.append(total.select("ctx", "g"))
        discounts.append(d)
    return BackoffModel(probs, weights, discounts, n_chars)


def t_backoff_score(pairs: DataFrame, model: BackoffModel) -> DataFrame:
    """``pairs`` (ctx of the model's greatest length, next_char, cnt) with ``p``, read at the longest
    context that has the character; each step passes on what is left to the shorter one."""
    here = shared_table(pairs.select("ctx", "next_char", "cnt", F.col("ctx").alias("_at"), F.lit(1.0).alias("_w")), "pairs")
    out = None
    for k in range(model.order, -1, -1):
        p = model.probs[k].withColumnRenamed("ctx", "_at")
        got = here.join(p, ["_at", "next_char"]).select("ctx", "next_char", "cnt", (F.col("_w") * F.col("p")).alias("p"))
        out = got if out is None else out.unionByName(got)
        rest = here.join(p.select("_at", "next_char"), ["_at", "next_char"], "left_anti")
        rest = rest.join(model.weights[k].withColumnRenamed("ctx", "_at"), "_at", "left")
        here = shared_table(rest.select("ctx", "next_char", "cnt", F.expr("substring(_at, 2)").alias("_at"),
                                        (F.col("_w") * F.coalesce("g", F.lit(1.0))).alias("_w")), "pairs")
    return out.unionByName(here.select("ctx", "next_char", "cnt", (F.col("_w") / model.n_chars).alias("p")))


def t_cross_entropy(df: DataFrame, model: BackoffModel, text_col: str = "text", order_col: str = "id", block: int = DEFAULT_BLOCK) -> DataFrame:
    """One row: characters scored and their mean negative log-probability (nats) in the corpus of ``df``."""
    w = t_windows(df, text_col, order_col, model.order, block)
    pairs = w.groupBy(F.col("window").alias("ctx"), "next_char").agg(F.count(F.lit(1)).alias("cnt"))
    return t_backoff_score(pairs, model).agg(F.sum("cnt").alias("n_chars"), (-F.sum(F.col("cnt") * F.log("p")) / F.sum("cnt")).alias("cross_entropy"))


def t_backoff_argmax(model: BackoffModel) -> DataFrame:
    """(ctx, next_char): the likeliest next character of every kept context of any length, the empty one
    included (ties: the smallest character).  An unseen character wins if its share of what is
    left to the shorter context is larger than that of every seen one."""
    def best(k: int) -> DataFrame:
        first = F.struct((-F.round("p", 12)).alias("r"), F.col("next_char"))
        return model.probs[k].groupBy("ctx").agg(F.min_by(F.struct("next_char", "p"), first).alias("b")).select("ctx", "b.*")

    below = shared_table(best(0), "argmax")
    out = below
    for k in range(1, model.order + 1):
        short = below.select(F.col("ctx").alias("_short"), F.col("next_char").alias("_char"), F.col("p").alias("_p"))
        x = best(k).join(model.weights[k], "ctx").withColumn("_short", F.expr("substring(ctx, 2)")).join(short, "_short")
        other = F.round(F.col("g") * F.col("_p"), 12) > F.round("p", 12)
        below = shared_table(x.select("ctx", F.when(other, F.col("_char")).otherwise(F.col("next_char")).alias("next_char"),
                                      F.when(other, F.col("g") * F.col("_p")).otherwise(F.col("p")).alias("p")), "argmax")
        out = out.unionByName(below)
    return out.select("ctx", "next_char")


def _ends(text: Column, order: int) -> Column:
    """All endings of a text of at most ``order`` characters, the empty one included."""
    return F.transform(F.sequence(F.lit(0), F.least(F.lit(order), F.length(text))), lambda k: F.right(text, k))


def t_backoff_generate(seeds: DataFrame, argmax: DataFrame, order: int, steps: int, checkpoint_every: int = 10,
                       rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Greedy generation, (pos, generated), for all ``seeds`` (pos, window) at once: each step
    appends the likeliest character after the longest known ending, so no seed stops early.

    The table is written once, in buckets by context hash; a step reads the buckets of
    its endings only (at most ``order`` + 1 per seed; seeds are a bounded parameter)."""
    table, n = _model_table(argmax, rows_per_bucket)
    table = table.select("b", "ctx", F.col("next_char").alias("_nx"))
    g = reliable_checkpoint(seeds.select("pos", F.expr(f"right(window, {order})").alias("text"), F.lit("").alias("generated")))
    cached = []
    for i in range(steps):
        ends = g.select("pos", "text", "generated", F.explode(_ends(F.col("text"), order)).alias("ctx"))
        ends = ends.withColumn("b", F.pmod(F.xxhash64("ctx"), F.lit(n)))
        part = table
        if n > 1:
            live = [r[0] for r in ends.select("b").distinct().collect()]
            part = table.where(F.col("b").isin(live))
        hit = ends.join(part, ["b", "ctx"])
        hit = hit.groupBy("pos", "text", "generated").agg(F.max_by("_nx", F.length("ctx")).alias("_nx"))
        g = hit.select("pos", F.expr(f"right(concat(text, _nx), {order})").alias("text"), F.concat("generated", "_nx").alias("generated"))
        if (i + 1) % checkpoint_every == 0 and i + 1 < steps:
            g = reliable_checkpoint(g)
            for c in cached:
                c.unpersist()
            cached = []
        elif n > 1:  # read twice: by the next step and by its search for buckets
            g = g.cache()
            cached.append(g)
    return g.select("pos", "generated")
