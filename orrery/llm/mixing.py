"""Mixing sources to target weights: hierarchical budgeting over a tree of domains, languages and sources.

A leaf can give its tokens `max_epochs` times; an inner node what its leaves can give. From the root down, a node's budget
is shared among its children in proportion to their weights; a child that can't use its share keeps what it can give, and
the shortage goes to its siblings, again by weight. Only what all of them together can't use never reaches the node: its
own share was cut at what it can give, and its siblings got the rest. So shortages go to siblings before ancestors. All
this is integer arithmetic over one row a node, in windows.

A leaf's budget is then met from seeded epochs: whole passes, and in the last epoch the documents in the order of
md5(seed:epoch:doc_id) until the budget's token, so that the last document may give a prefix of its tokens. Running sums
are cut into slices of a leaf (see common.running), so that no task holds a large leaf. Texts are read once to count their
tokens, and what follows works on ids and counts in a table of the shared folder.

Edge cases: tokens are words; a null or empty text has none and is selected whole passes times only; null language, source
or domain is a node named ''; weights that are missing count 1, negative ones 0; ties in the order are broken by doc_id and
text; repeated rows each count; an empty table gives no rows; further columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Scratch, n_words, running

LEVELS = ("domain", "lang", "source")


def weight_of(level: str, weights: dict[str, dict[str, int]]) -> Column:
    known = {k: max(0, int(v)) for k, v in weights.get(level, {}).items()}
    if not known:
        return F.lit(1).cast("long")
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return F.coalesce(F.try_element_at(table, F.col(level)), F.lit(1).cast("long"))


def shares(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget` to children (name, weight, can) that have their parent's `of_parent`: shares by weight, none over `can`.

    In the order of can / weight the children that can't use their share come first; the others split the rest by weight,
    rounded by running sums so that nothing is lost.
    """
    up = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = up.orderBy(F.when(F.col("weight") > 0, F.col("can") / F.col("weight")).asc_nulls_last(), F.col(name))
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    rows = children.withColumn("earlier", F.coalesce(F.sum("can").over(before), F.lit(0))).withColumn("heavier", F.sum("weight").over(after))
    rows = rows.withColumn("short", (F.col("weight") > 0) & (F.col("can").cast("decimal(38,0)") * F.col("heavier") <= (F.col("of_parent") - F.col("earlier")).cast("decimal(38,0)") * F.col("weight")))
    rows = rows.withColumn("rest", F.col("of_parent") - F.sum(F.when(F.col("short"), F.col("can")).otherwise(0)).over(up))
    open_weight = F.when(F.col("short"), 0).otherwise(F.col("weight"))
    rows = rows.withColumn("total", F.sum(open_weight).over(up)).withColumn("upto", F.sum(open_weight).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    part = lambda w: F.expr(f"cast((cast(rest as decimal(20,0)) * {w}) div greatest(total, 1) as bigint)")
    budget = F.when(F.col("short"), F.col("can")).when(F.col("weight") > 0, part("upto") - part("(upto - weight)")).otherwise(0)
    return rows.withColumn("budget", F.greatest(budget, F.lit(0)).cast("long")).drop("earlier", "heavier", "short", "rest", "total", "upto", "of_parent")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, dict[str, int]], max_epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) from leaves (domain, lang, source, tokens)."""
    nodes = leaves.withColumn("can", F.col("tokens") * max_epochs)
    now = leaves.agg(F.coalesce(total, F.lit(0)).cast("long").alias("of_parent"))
    parent: list[str] = []
    for level in LEVELS:
        keys = [*parent, level]
        children = nodes.groupBy(*keys).agg(F.sum("can").alias("can")).withColumn("weight", weight_of(level, weights))
        if parent:
            up = now.select(*[F.col(k).alias(f"_{k}") for k in parent], F.col("budget").alias("of_parent"))
            children = children.join(up, [F.col(k) == F.col(f"_{k}") for k in parent]).drop(*[f"_{k}" for k in parent])
        else:
            children = children.join(F.broadcast(now))
        now = shares(children, parent, level)
        parent = keys
    found = now.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "budget")
    return leaves.join(found, [F.col(k) == F.col(f"_{k}") for k in LEVELS]).select(*LEVELS, "tokens", "budget")


def placed(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], total_percent: int, max_epochs: int, seed: int) -> DataFrame:
    """One row per row of docs, without its text: doc_id, levels, text_hash, n_tokens, budget, epochs, rest (tokens of the leaf's last
    epoch), place (the row's key in it) and before (tokens of the rows before it)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    name = lambda c: F.coalesce(c, F.lit(""))
    rows = docs.select("doc_id", n_words(F.col("text")).alias("n_tokens"), name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), F.xxhash64("text").alias("text_hash"))
    rows = scratch.table(rows, "rows")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, F.expr(f"sum(tokens) * {int(total_percent)} div 100"), weights, max_epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long")
    plan = plan.select(*[F.col(k).alias(f"_{k}") for k in LEVELS], "budget", whole.alias("epochs"), (F.col("budget") - whole * F.col("tokens")).alias("rest"))
    plan = scratch.table(plan, "plan")
    rows = rows.join(plan, [F.col(k) == F.col(f"_{k}") for k in LEVELS]).drop(*[f"_{k}" for k in LEVELS])
    return running(rows.withColumn("place", place(seed)), list(LEVELS), F.col("place"), F.col("n_tokens"), ["doc_id", "text_hash"])


def place(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], total_percent: int = 100, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """One row per row of docs (doc_id, text, lang, source): doc_id, domain, lang, source, n_tokens, budget (of its leaf),
    epochs (whole passes), prefix_tokens (taken in one more epoch). total_percent: the budget in per cent of all tokens."""
    prefix = F.least(F.col("n_tokens"), F.greatest(F.col("rest") - F.col("before"), F.lit(0))).cast("long")
    return placed(docs, domain, weights, total_percent, max_epochs, seed).select("doc_id", *LEVELS, "n_tokens", "budget", "epochs", prefix.alias("prefix_tokens"))


def apply_mix(docs: DataFrame, domain: Column, weights: dict[str, dict[str, int]], total_percent: int = 100, max_epochs: int = 4, seed: int = 7) -> DataFrame:
    """The rows of docs, all columns, as often as they are selected; a text of which a prefix is taken is cut after that word.

    Where a leaf's last epoch ends is decided on ids and lengths. Each row then compares its own place with its leaf's end,
    so that no text is shuffled. Only rows that agree with the last one in id and text are numbered to tell them apart.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    rows = scratch.table(placed(docs, domain, weights, total_percent, max_epochs, seed).select(*LEVELS, "epochs", "rest", "place", "text_hash", "n_tokens", "before"), "placed")
    of = lambda names: [F.col(k).alias(f"_{k}") for k in names]
    same = lambda names: [F.col(k) == F.col(f"_{k}") for k in names]
    ends = rows.where("n_tokens > 0 and before < rest and rest <= before + n_tokens").select(*LEVELS, "place", "text_hash", "n_tokens", "before", (F.col("rest") - F.col("before")).alias("take"))
    alike = rows.join(ends.select(*of([*LEVELS, "place", "text_hash"])), same([*LEVELS, "place", "text_hash"]), "left_semi")
    alike = alike.groupBy(*LEVELS).agg(F.count(F.lit(1)).alias("alike"), F.min("before").alias("least"))
    ends = ends.join(alike.select(*of(LEVELS), "alike", "least"), same(LEVELS)).withColumn("whole", F.expr("(before - least) div n_tokens"))
    leaves = rows.groupBy(*LEVELS).agg(F.first("epochs").alias("_epochs"))
    plan = leaves.select(*of(LEVELS), "_epochs").join(ends.select(*LEVELS, F.struct("place", "text_hash").alias("_end"), F.col("n_tokens").alias("_n"), F.col("take").alias("_take"), F.col("alike").alias("_alike"), F.col("whole").alias("_whole")), same(LEVELS), "left").drop(*LEVELS)
    plan = scratch.table(plan, "plan")

    names = docs.columns
    level = dict(zip(LEVELS, (domain, F.col("lang"), F.col("source"))))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("all"), "doc_id", "text", *[F.coalesce(c, F.lit("")).alias(k) for k, c in level.items()])
    held = held.join(plan, same(LEVELS)).withColumn("epochs", F.col("_epochs"))
    here = F.struct(place(seed).alias("place"), F.xxhash64("text").alias("text_hash"))
    held = held.withColumn("here", here).withColumn("at_end", F.coalesce(F.col("here") == F.col("_end"), F.lit(False)))
    filled = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    more = F.when(filled & (F.col("here") < F.col("_end")), -1).when(F.col("at_end"), F.col("_take")).otherwise(0)  # -1: the whole text
    if not plan.where("_alike > 1").isEmpty():
        crowd = held.where("at_end and _alike > 1").withColumn("nth", F.row_number().over(Window.partitionBy(*LEVELS).orderBy(F.lit(0))))
        of_crowd = F.when(F.col("nth") <= F.col("_whole"), -1).when(F.col("nth") == F.col("_whole") + 1, F.col("_take")).otherwise(0)
        held = held.where("not (at_end and _alike > 1)").withColumn("more", more).unionByName(crowd.withColumn("more", of_crowd).drop("nth"))
    else:
        held = held.withColumn("more", more)
    times = F.col("epochs") + F.when(F.col("more") != 0, 1).otherwise(0)
    copies = held.where(times > 0).select("all", "epochs", "more", "_n", F.explode(F.sequence(F.lit(1), times.cast("int"))).alias("copy"))
    text = F.col("all.text")
    short = (F.col("copy") > F.col("epochs")) & (F.col("more") > 0) & (F.col("more") < F.col("_n"))
    words = F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.greatest(F.col("more"), F.lit(1)).cast("int"))
    cut = F.when(short, F.array_join(words, " ")).otherwise(text)
    return copies.select(*[cut.alias(c) if c == "text" else F.col(f"all.`{c}`").alias(c) for c in names])
