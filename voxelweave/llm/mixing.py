"""Mixing sources to target weights. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import checked_broadcast, stored

#: The exponent is a multiple of 2**-BITS in [0, 1], found by STEPS refinements of ARY values each.
STEPS, ARY = 3, 128
#: Documents of a permuted block on average; also bounds the window that cuts the last block.
BLOCK_DOCS = 512


def source_tokens(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> list[Column]:
    """`n_tok`, the words of a row of docs (runs of anything but white space), and `src` ("" for null)."""
    words = F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(r"[^ \t\n\x0B\f\r]+"))
    return [words.cast("long").alias("n_tok"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("src")]


def _hash(*parts: Column | str) -> Column:
    """Hexadecimal hash of the parts; every order and block number of the mix comes from it."""
    return F.md5(F.concat_ws("|", *[F.col(p) if isinstance(p, str) else p for p in parts]))


def temperature_weights(sources: DataFrame, entropy: float | None, repeats: float | None, budget: float = 1.0) -> DataFrame:
    """(src, tokens, share, alpha, weight): weight = share**alpha / sum(share**alpha).

    entropy: fraction of the largest possible entropy (log of the number of sources) the weights
    must reach; the largest exponent that does is taken. repeats: passes over any source that a
    budget of `budget` times all tokens may need; the smallest exponent that keeps to it is
    taken. With both, the larger of the two exponents (the repetition limit is the harder one).
    Sources without tokens get no weight. The bisection runs on the grid of multiples of
    ARY**-STEPS: each step is one aggregate over (source, exponent), whatever the number of sources.
    """
    positive = sources.where("tokens > 0")
    total = positive.agg(F.sum("tokens").alias("all"), F.count("*").alias("n"))
    s = positive.crossJoin(F.broadcast(total)).select("src", "tokens", "all", "n", (F.col("tokens") / F.col("all")).alias("share"))

    def step(low: DataFrame, width: float) -> DataFrame:
        """low: one row (e, r), the grid cells that hold either exponent; each ARY times narrower."""
        tried = s.crossJoin(F.broadcast(low)).select(
            "*", F.explode(F.array(F.struct(F.lit("e").alias("goal"), F.col("e").alias("lo")), F.struct(F.lit("r").alias("goal"), F.col("r").alias("lo")))).alias("g")
        ).select("*", F.explode(F.sequence(F.lit(0), F.lit(ARY))).alias("i"))
        alpha = F.col("g.lo") + F.col("i") * F.lit(width / ARY)
        z = tried.withColumn("alpha", alpha).withColumn("p", F.pow("share", alpha))
        per = z.groupBy(F.col("g.goal").alias("goal"), "i", "alpha").agg(
            F.sum("p").alias("z"), F.sum(F.col("p") * F.log("share")).alias("pl"), F.max(F.col("p") / F.col("share")).alias("worst"), F.max("n").alias("n")
        )
        h = F.log("z") - F.col("alpha") * F.col("pl") / F.col("z")
        enough = h >= F.lit(entropy or 0.0) * F.log("n") - 1e-12
        within = F.lit(budget) * F.col("worst") / F.col("z") <= F.lit(repeats or float("inf")) + 1e-12
        e = F.max(F.when((F.col("goal") == "e") & (enough | (F.col("i") == 0)), F.col("alpha")))
        # the last value that breaks the limit is the lower end of the cell; none: the cell's own
        r = F.coalesce(F.max(F.when((F.col("goal") == "r") & ~within & (F.col("i") < ARY), F.col("alpha"))), F.min(F.when(F.col("goal") == "r", F.col("alpha"))))
        return per.agg(e.alias("e"), r.alias("r"), F.max(F.when((F.col("goal") == "r") & (F.col("i") == 0) & within, 1)).alias("free"))

    low = s.sparkSession.range(1).select(F.lit(0.0).alias("e"), F.lit(0.0).alias("r"))
    width, first = 1.0, None
    for _ in range(STEPS):
        got = step(low.select("e", "r"), width)
        first = got.select(F.col("free").alias("free0")) if first is None else first
        low, width = got, width / ARY
    # if even exponent 0 keeps to the limit, the limit asks for nothing
    r = F.when((F.col("free0") == 1) | F.lit(repeats is None), F.lit(0.0)).otherwise(F.least(F.col("r") + width, F.lit(1.0)))
    e = F.col("e") if entropy is not None else F.lit(0.0 if repeats is not None else 1.0)
    alpha = low.crossJoin(first).select(F.greatest(e, r).alias("alpha"))
    z = s.crossJoin(F.broadcast(alpha)).withColumn("p", F.pow("share", "alpha"))
    norm = z.agg(F.sum("p").alias("z"))
    return z.crossJoin(F.broadcast(norm)).select("src", "tokens", "share", "alpha", (F.col("p") / F.col("z")).alias("weight"))


def mix_sources(
    docs: DataFrame,
    entropy: float | None = 0.95,
    repeats: float | None = 4.0,
    budget: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """docs' columns plus src, n_tok, weight, `epoch` (1, 2, ...) and `place` (order of the mix).

    Each source gets weight * budget * (tokens of all sources). Its documents fall into blocks of
    about BLOCK_DOCS by a hash of their ids; every whole pass takes all blocks, the last, partial
    one takes blocks in the order of a hash permutation as long as they fit, and of the first block
    that doesn't, documents in permuted order as long as their start lies within the budget. A
    source of any size is cut by windows over its blocks' totals and within one block only.

    Null source: the source "". Texts without words have no tokens: they come with every whole pass
    and wherever they fall in the partial one. A null id hashes like any value. Repeated rows are
    separate documents. Columns of docs named like the five added ones are replaced; all others come
    through unchanged, whatever their names: they travel as one struct. Empty table: empty.
    """
    added = ["n_tok", "src", "weight", "epoch", "place"]
    plain = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]).alias("doc")
    base = docs.select(plain, *source_tokens(docs, text_col, source_col), F.coalesce(docs[id_col].cast("string"), F.lit("null")).alias("key"))
    slim = base.select("src", "n_tok", "key")
    sums = stored(slim.groupBy("src").agg(F.sum("n_tok").alias("tokens"), F.count("*").alias("docs")), "sources")
    weights = temperature_weights(sums.select("src", "tokens"), entropy, repeats, budget)
    total = sums.agg(F.sum("tokens").alias("everything"))
    passes = F.col("weight") * F.lit(budget) * F.col("everything") / F.col("tokens")
    plan = sums.join(weights.select("src", "weight"), "src", "left").crossJoin(F.broadcast(total)).select(
        "src", F.coalesce("weight", F.lit(0.0)).alias("weight"), F.ceil(F.col("docs") / BLOCK_DOCS).cast("long").alias("blocks"),
        F.coalesce(F.floor(passes + 1e-9), F.lit(1)).cast("int").alias("whole"),
        F.coalesce((passes - F.floor(passes + 1e-9)) * F.col("tokens"), F.lit(0.0)).alias("rest"),
    )
    plan = checked_broadcast(stored(plan, "plan"))
    salt = F.lit(str(seed))
    number = lambda key: F.conv(F.substring(_hash(key, salt), 1, 8), 16, 10).cast("long") % F.col("blocks")
    block = number("key")
    last = F.col("whole") + 1
    of_block = slim.join(plan, "src").withColumn("block", block).groupBy("src", "block", "whole", "rest").agg(F.sum("n_tok").alias("in_block"))
    by_block = Window.partitionBy("src").orderBy(_hash("block", last, salt), "block").rowsBetween(Window.unboundedPreceding, -1)
    cuts = of_block.select("src", "block", F.coalesce(F.sum("in_block").over(by_block), F.lit(0)).alias("before"), "in_block")
    cuts = checked_broadcast(stored(cuts, "cuts"))
    keyed = base.join(plan, "src").withColumn("block", block).join(cuts, ["src", "block"])
    fits = F.col("before") + F.col("in_block") <= F.col("rest")
    edge = ~fits & (F.col("before") < F.col("rest"))
    within = Window.partitionBy("src", "block").orderBy(_hash("key", last, salt), "key").rowsBetween(Window.unboundedPreceding, -1)
    sure = keyed.where(~edge).withColumn("extra", F.when(fits, 1).otherwise(0))
    cut = keyed.where(edge).withColumn("extra", F.when(F.col("before") + F.coalesce(F.sum("n_tok").over(within), F.lit(0)) < F.col("rest"), 1).otherwise(0))
    both = sure.unionByName(cut).withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0")
    return both.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        "doc.*", "src", "n_tok", "weight", "epoch",
        F.concat(_hash("src", "block", "epoch", salt), _hash("key", "epoch", salt)).alias("place"),
    )
