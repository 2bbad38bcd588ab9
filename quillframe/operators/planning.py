"""Planning of data collection: deficits, seeds, weakness, allocation, worklists and their progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Seed bases of each mode, seeds of a bucket, weights of the weakness score, least scenes of a case.
SEED_BASES = {"eval": 1_000_000, "train": 2_000_000, "eval_error": 3_000_000, "train_error": 4_000_000}
SEED_BLOCK = 10_000
WEIGHTS = {"row_acc": 3.0, "col_acc": 3.0, "kind_acc": 2.0, "label_acc": 1.0}
CASE_FLOOR = 2


def bucket_index(pairs: DataFrame) -> DataFrame:
    """case, stage, bucket: the place of each pair in the sorted list of all pairs, from 0. A dimension table."""
    return pairs.select("case", "stage").distinct().withColumn("bucket", F.row_number().over(W.orderBy("case", "stage")) - 1)


def deficits(targets: DataFrame, existing: DataFrame) -> DataFrame:
    """case, deficit, pos: cases below their target, the largest deficit first."""
    have = existing.groupBy("case").agg(F.count(F.lit(1)).alias("have"))
    df = targets.join(have, "case", "left").na.fill(0, ["have"]).withColumn("deficit", F.col("target") - F.col("have")).where("deficit > 0")
    return df.select("case", "deficit", "have").withColumn("pos", F.row_number().over(W.orderBy(F.desc("deficit"), "case")) - 1)


def allocate_seeds(demand: DataFrame, buckets: DataFrame, served: DataFrame, mode: str) -> DataFrame:
    """case, item, stage, seed: items of each case cycle through its stages; each bucket gives its free seeds in order.

    demand: case, n. served: seed. A bucket with too few free seeds ends its case's list there.
    """
    base = SEED_BASES[mode]
    stages = buckets.withColumn("stage_no", F.row_number().over(W.partitionBy("case").orderBy("bucket")) - 1).withColumn("n_stages", F.count(F.lit(1)).over(W.partitionBy("case")))
    items = demand.where("n > 0").select("case", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("item"))
    items = items.join(stages.select("case", "n_stages").distinct(), "case").withColumns({"stage_no": F.col("item") % F.col("n_stages"), "k": F.floor(F.col("item") / F.col("n_stages")).cast("int") + 1})
    need = items.groupBy("case", "stage_no").agg(F.max("k").alias("need"))
    # A bucket's first free seeds lie among its first (needed + served) ones.
    start = F.lit(base).cast("long") + F.col("bucket") * SEED_BLOCK
    wanted = stages.join(need, ["case", "stage_no"]).withColumn("start", start)
    used = served.select("seed").distinct().withColumn("bucket", F.floor((F.col("seed") - base) / SEED_BLOCK).cast("int"))
    used_n = used.groupBy("bucket").agg(F.count(F.lit(1)).alias("used"))
    span = F.least(F.lit(SEED_BLOCK), F.col("need") + F.coalesce("used", F.lit(0)))
    slots = wanted.join(used_n, "bucket", "left").select("case", "stage", "stage_no", "bucket", F.explode(F.transform(F.sequence(F.lit(0), (span - 1).cast("int")), lambda i: F.col("start") + i)).alias("seed"))
    free = slots.join(used.select("seed"), "seed", "left_anti").withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy("seed")))
    out = items.join(free, ["case", "stage_no", "k"], "left")
    ended = F.min(F.when(F.col("seed").isNull(), F.col("item"))).over(W.partitionBy("case"))
    return out.withColumn("__e", ended).where("__e is null or item < __e").select("case", "item", "stage", "seed")


def error_items(targets: DataFrame, existing: DataFrame, served: DataFrame, cases: DataFrame, mode: str) -> DataFrame:
    """kind, case, seed, item: for each kind below its target, seeds from the number of existing scenes on, served ones skipped.

    targets: kind, target. existing: kind. cases: kind, case, kind_no (the kind's place in the sorted list).
    """
    base = SEED_BASES[mode]
    have = existing.groupBy("kind").agg(F.count(F.lit(1)).alias("have"))
    df = targets.join(have, "kind", "left").na.fill(0, ["have"]).withColumn("deficit", F.col("target") - F.col("have")).where("deficit > 0").join(cases, "kind")
    used = served.select("seed").distinct().withColumn("kind_no", F.floor((F.col("seed") - base) / SEED_BLOCK).cast("int"))
    used_n = used.groupBy("kind_no").agg(F.count(F.lit(1)).alias("used"))
    last = F.least(F.lit(SEED_BLOCK), F.col("have") + F.col("deficit") + F.coalesce("used", F.lit(0))) - 1
    slots = df.join(used_n, "kind_no", "left").where(last >= F.col("have")).select("kind", "case", "kind_no", "deficit", F.explode(F.sequence(F.col("have").cast("int"), last.cast("int"))).alias("counter"))
    slots = slots.withColumn("seed", F.lit(base).cast("long") + F.col("kind_no") * SEED_BLOCK + F.col("counter"))
    free = slots.join(used.select("seed"), "seed", "left_anti").withColumn("item", F.row_number().over(W.partitionBy("kind").orderBy("seed")) - 1)
    return free.where("item < deficit").select("kind", "case", "seed", "item")


def weakness() -> Column:
    """Weighted sum of 1 - accuracy; a missing accuracy counts as 0."""
    total = F.lit(0.0)
    for name, w in WEIGHTS.items():
        total = total + w * F.coalesce(1 - F.col(name), F.lit(1.0))
    return total


def allocate(cases: DataFrame, budget: int, floor: int = CASE_FLOOR) -> DataFrame:
    """case, weakness, cap -> alloc: floors first, then shares of the rest by weakness, largest remainder, never above the cap.

    Units left over go pass by pass, in order of falling remainders, to cases with room: full passes are a level found from
    sums over the cases, the last one is a rank. No unit is a row.
    """
    one = W.partitionBy()
    df = cases.withColumn("base", F.greatest(F.lit(0), F.least(F.lit(floor), F.col("cap"))).cast("long"))
    df = df.withColumns({"rest": F.lit(budget) - F.sum("base").over(one), "total": F.sum("weakness").over(one), "room": F.greatest(F.lit(0), F.col("cap") - F.col("base")).cast("long")})
    share = (F.col("rest") > 0) & (F.col("total") > 0)
    df = df.withColumn("raw", F.when(share, F.col("rest") * (F.col("weakness") / F.col("total"))).otherwise(0.0))
    df = df.withColumn("part", F.least(F.floor("raw"), F.col("room"))).withColumn("left", F.when(share, F.col("rest") - F.sum("part").over(one)).otherwise(0))
    df = df.withColumn("turn", F.row_number().over(W.orderBy(F.desc(F.col("raw") - F.floor("raw")), "case")))
    df = df.withColumn("spare", F.greatest(F.lit(0), F.col("room") - F.col("part")).cast("long"))
    # The level up to which all cases with room are filled: below it every pass is full. Of the cases by rising spare, those
    # before a case are used up when the units last for them and for as much in every case from there on.
    w = W.orderBy("spare", "case")
    up = df.select("left", "spare", F.coalesce(F.sum("spare").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), (F.count(F.lit(1)).over(one) - F.row_number().over(w) + 1).alias("still"))
    level = up.where(F.col("before") + F.col("spare") * F.col("still") >= F.col("left")).agg(F.min(F.struct("spare", "before", "still", "left")).alias("u"))
    level = level.select(F.floor((F.col("u.left") - F.col("u.before")) / F.col("u.still")).cast("long").alias("level"))
    df = df.join(F.broadcast(level)).withColumn("full", F.least(F.col("spare"), F.coalesce("level", F.col("spare"))))  # a level is one row
    open_ = F.col("spare") > F.col("full")
    df = df.withColumn("place", F.row_number().over(W.orderBy(F.desc(open_), "turn"))).withColumn("last", F.col("left") - F.sum("full").over(one))
    extra = F.when(F.col("left") > 0, F.col("full") + F.when(open_ & (F.col("place") <= F.col("last")), 1).otherwise(0)).otherwise(0)
    return df.select("case", "weakness", "cap", (F.col("base") + F.col("part") + extra).cast("long").alias("alloc"))


def _placed(items: DataFrame, order: DataFrame, key: str, place: str) -> DataFrame:
    """items (key, item from 0 on without gaps) with pos: the keys in the order of ``place``, each one's items after those of the keys before.

    Only the table of keys is put in order; an item's place is its key's offset plus its own number.
    """
    counts = items.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).join(order.select(key, place), key)
    offsets = counts.select(key, (F.sum("__n").over(W.orderBy(place)) - F.col("__n")).alias("__before"))
    return items.join(offsets, key).withColumn("pos", (F.col("__before") + F.col("item")).cast("int")).drop("__before")


def eval_worklist(targets: DataFrame, existing: DataFrame, buckets: DataFrame, served: DataFrame) -> DataFrame:
    """pos, case, stage, seed: the scenes still needed, by falling deficit."""
    need = deficits(targets, existing)
    items = allocate_seeds(need.select("case", F.col("deficit").alias("n")), buckets, served, "eval")
    return _placed(items, need.withColumnRenamed("pos", "case_pos"), "case", "case_pos").select("pos", "case", "stage", "seed")


def train_worklist(caps: DataFrame, metrics: DataFrame | None, budget: int, buckets: DataFrame, served: DataFrame) -> DataFrame:
    """pos, case, stage, seed for a round of training scenes; caps of 0 are left out, an unmeasured case is fully weak.

    metrics: case and the accuracies of WEIGHTS; None: the caps stand for the weakness. A budget of 0 or less gives nothing.
    """
    able = caps.where("cap > 0")
    weak = able.withColumn("weakness", F.col("cap").cast("double")) if metrics is None else able.join(metrics, "case", "left").select("case", "cap", weakness().alias("weakness"))
    plan = allocate(weak if budget > 0 else weak.limit(0), budget).where("alloc > 0")
    order = plan.withColumn("case_pos", F.row_number().over(W.orderBy(F.desc("alloc"), F.desc("weakness"), "case")))
    items = allocate_seeds(plan.select("case", F.col("alloc").alias("n")), buckets, served, "train")
    return _placed(items, order, "case", "case_pos").select("pos", "case", "stage", "seed")


def with_error_items(items: DataFrame, errors: DataFrame) -> DataFrame:
    """The list with the error items after it."""
    kinds = errors.select("kind").distinct().withColumn("kind_pos", F.row_number().over(W.orderBy("kind")))
    last = items.agg(F.count(F.lit(1)).alias("n_items"))
    a = items.select("case", "stage", "seed", F.lit("draw").alias("directive"), F.col("pos").cast("int").alias("pos"))
    b = _placed(errors, kinds, "kind", "kind_pos").join(F.broadcast(last)).select("case", F.lit("full").alias("stage"), "seed", F.lit("error").alias("directive"), (F.col("pos") + F.col("n_items")).cast("int").alias("pos"))
    return a.unionByName(b)


def list_progress(worklist: DataFrame) -> DataFrame:
    """total, done, pending and percent by case and for all."""
    done = F.sum((F.col("status") == "done").cast("long"))
    out = worklist.rollup("case").agg(F.count(F.lit(1)).alias("total"), done.alias("done"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g") > 0, "all").otherwise(F.col("case")).alias("case"), "total", "done", (F.col("total") - F.col("done")).alias("pending"), F.when(F.col("total") > 0, 100.0 * F.col("done") / F.col("total")).otherwise(0.0).alias("percent"))


def trimmed(worklist: DataFrame, key: str) -> DataFrame:
    """Lists without their leading run of done items; pos starts again at 0."""
    w = W.partitionBy(key).orderBy("pos")
    kept = worklist.withColumn("__p", F.min(F.when(F.col("status") == "done", 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))).where("__p = 0").drop("__p")
    return kept.withColumn("pos", F.row_number().over(w) - 1)


def advanced(worklist: DataFrame, sessions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The lists with the item at each session's cursor done, and the sessions with the cursor one further.

    sessions: key, cursor. A cursor before or after the list changes nothing.
    """
    size = worklist.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    within = (F.col("cursor") >= 0) & (F.col("cursor") < F.coalesce("__n", F.lit(0)))
    moved = sessions.join(size, key, "left").withColumn("__on", within).drop("__n")
    at = moved.where("__on").select(key, F.col("cursor").alias("pos"), F.lit(True).alias("__d"))
    marked = worklist.join(at, [key, "pos"], "left").withColumn("status", F.when(F.col("__d"), "done").otherwise(F.col("status"))).drop("__d")
    return marked, moved.withColumn("cursor", F.col("cursor") + F.col("__on").cast("int")).drop("__on")


def with_served(served: DataFrame, seeds: DataFrame) -> DataFrame:
    """The served seeds with those of a new session, each once."""
    return served.select("seed").unionByName(seeds.select("seed")).distinct()
