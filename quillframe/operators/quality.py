"""Labelled datasets: validation to issue rows, duplicates, splits, leakage, balance, weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import ontology as o
from .lineage import cut

ISSUE = ("kind", "path", "detail", "severity")
# Issue kinds that stop a preparation run.
HARD_FAIL = ("corrupt_image", "invalid_size", "invalid_channels", "unknown_label", "invalid_label_path", "missing_required_label", "insufficient_class_count")
#: Tables of up to so many labels are broadcast.
FEW_LABELS = 10_000
#: Hexadecimal digits of the digest ranges in which a label's rows are numbered: 4,096 ranges.
RANGE_DIGITS = 3
# What people write for a kind of issue.
ISSUE_ALIASES = {
    "wrong_label": ("wrong", "w", "wrong_label", "yes", "y", "1", "x"),
    "duplicate": ("dup", "duplicate", "d"),
    "spurious": ("extra", "spurious", "ghost", "fake"),
    "split": ("split",),
    "merged": ("merge",),
}
#: Files in a range of a tree digest, on average and at most.
MERKLE_LEAF = 256
EQUATION_KINDS = ("addition", "subtraction", "multiplication", "division", "bare_digits")
BOX_CLASSES = 6


def issues(df: DataFrame, path: Column, checks: list[tuple[Column, str, Column | str]], severity: str = "error") -> DataFrame:
    """One row for each check that holds on a row: (condition, kind, detail). One pass, no shuffle."""
    found = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("kind"), path.alias("path"), (d if isinstance(d, Column) else F.lit(d)).alias("detail"), F.lit(severity).alias("severity"))) for c, k, d in checks]
    return df.select(F.explode(F.array_compact(F.array(*found))).alias("i")).select("i.*")


def scene_issues(scenes: DataFrame, cases: list[str] | None = None, errors: list[str] | None = None) -> DataFrame:
    """Scene headers with an unknown kind, case or error kind."""
    path = F.col("scene_id").cast("string")
    checks = [(~F.coalesce(F.col("equation_kind"), F.lit("")).isin(*EQUATION_KINDS), "invalid_kind", F.coalesce("equation_kind", F.lit("missing")))]
    if cases is not None:
        checks.append((F.col("scene_case").isNotNull() & ~F.col("scene_case").isin(*cases), "invalid_case", F.col("scene_case")))
    if errors is not None:
        checks.append((F.col("error_kind").isNotNull() & ~F.col("error_kind").isin(*errors), "invalid_error_kind", F.col("error_kind")))
    return issues(scenes, path, checks)


def symbol_issues(symbols: DataFrame, size: float = 512.0) -> DataFrame:
    """Symbols with a label outside the vocabulary or a box that is not 0 <= x0 < x1 <= size (same for y)."""
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    good = (x0 >= 0) & (y0 >= 0) & (x0 < x1) & (y0 < y1) & (x1 <= size) & (y1 <= size)
    path = F.concat_ws("/", "scene_id", "gt_id")
    return issues(symbols, path, [(~F.coalesce(F.col("label"), F.lit("")).isin(*o.FINE_LABELS), "unknown_label", F.coalesce("label", F.lit("missing"))), (~F.coalesce(good, F.lit(False)), "invalid_box", "box outside the canvas or reversed")])


def box_line_issues(files: DataFrame, classes: int = BOX_CLASSES) -> DataFrame:
    """Box-label texts (path, text): lines 'class cx cy w h'. An empty text is only a warning."""
    line = F.trim(F.regexp_replace("line", r"[\t\r]", " "))
    lines = files.select("path", F.posexplode(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("n", "line")).withColumn("f", F.split(line, r"\s+"))
    num = lambda i: F.get("f", i).try_cast("double")
    cls = F.get("f", 0).try_cast("int")
    five = F.size("f") == 5
    parsed = five & cls.isNotNull() & num(1).isNotNull() & num(2).isNotNull() & num(3).isNotNull() & num(4).isNotNull()
    unit = lambda i: parsed & ~num(i).between(0, 1)
    side = lambda i: parsed & ~((num(i) > 0) & (num(i) <= 1))
    at = F.concat("path", F.lit(":"), (F.col("n") + 1).cast("string"))
    checks = [
        (~five, "field_count", F.size("f").cast("string")), (five & ~parsed, "parse", F.col("line")), (parsed & ~cls.between(0, classes - 1), "class_range", cls.cast("string")),
        (unit(1), "cx_range", F.get("f", 1)), (unit(2), "cy_range", F.get("f", 2)), (side(3), "w_range", F.get("f", 3)), (side(4), "h_range", F.get("f", 4)),
    ]
    empty = files.where(F.trim(F.coalesce("text", F.lit(""))) == "")
    return issues(lines, at, checks).unionByName(issues(empty, F.col("path"), [(F.lit(True), "empty_file", "no boxes")], "warning"))


def truth_issues(raw: DataFrame) -> DataFrame:
    """Ground-truth JSON texts (path, json) whose structure is not usable."""
    schema = "equation_type string, symbols array<struct<fine_label:string,bbox:array<double>>>"
    df = raw.withColumn("j", F.from_json("json", schema))
    s = F.col("j.symbols")
    return issues(df, F.col("path"), [
        (F.col("j").isNull() | F.coalesce(F.col("j.equation_type"), F.lit("")).isin(""), "missing_equation_type", "equation_type"),
        (s.isNull(), "missing_symbols", "symbols"),
        (F.exists(s, lambda x: x["fine_label"].isNull()), "missing_fine_label", "fine_label"),
        (F.exists(s, lambda x: x["bbox"].isNull() | (F.size(x["bbox"]) != 4)), "invalid_bbox", "bbox"),
    ])


def vocabulary_issues(rows: DataFrame, required: list[str], least: int = 1) -> DataFrame:
    """Unknown labels, required labels without rows, and required labels with fewer than ``least`` rows."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    wanted = rows.sparkSession.createDataFrame([(x,) for x in required], "label string").withColumn("need", F.lit(True))
    both = counts.join(wanted, "label", "full_outer")
    need, n = F.col("need").isNotNull(), F.col("n")
    return issues(both, F.col("label"), [
        (~need, "unknown_label", "label is not in the vocabulary"), (need & n.isNull(), "missing_required_label", "no rows"),
        (need & (n < least), "insufficient_class_count", F.concat(F.lit(f"need {least}, got "), n.cast("string"))),
    ])


def gate(found: DataFrame, kinds: tuple = HARD_FAIL, sample: int = 10) -> DataFrame:
    """The first issues (by kind and path) of the kinds that stop a run; empty when the run may go on."""
    return found.where(F.col("kind").isin(*kinds)).orderBy("kind", "path", "detail").limit(sample)


def duplicates(assets: DataFrame) -> DataFrame:
    """All rows whose content another row has too, with the number n of those rows; rows without content are none.

    Contents are counted apart and joined back, so that rows of one content need not meet in a task.
    """
    often = assets.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return assets.join(often, "sha256").select(*assets.columns, "n")


def first_of_each(assets: DataFrame, key: str = "sha256", order: str = "path") -> DataFrame:
    """One row for each content: the first by path. Rows without content are no copies of each other and all stay.

    An aggregate: a content with many rows sends one from each task.
    """
    row = F.struct(*[F.col(c) for c in assets.columns])
    lone = F.when(F.col(key).isNull(), F.struct(F.col(order), F.monotonically_increasing_id()))
    first = assets.groupBy(F.col(key).alias("__k"), lone.alias("__lone")).agg(F.min_by(row, F.struct(F.col(order).isNotNull().alias("known"), order)).alias("__f"))
    return first.select("__f.*")


def stratified_split(assets: DataFrame, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """split = train, val or test, by label and in a seeded order of contents; labels with one row stay in train.

    Contents count once; rows without content each count. A label of n rows gives round(n * (val + test)) rows, of which val takes its share; both round half
    to even, and at least one row stays in train.
    """
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce("sha256", F.concat(F.lit("none:"), F.coalesce("path", F.lit(""))))), 256)
    df = first_of_each(assets).withColumn("__o", order).withColumn("__range", F.substring("__o", 1, RANGE_DIGITS))
    # A label's rows are numbered in ranges of the order, each in a task of its own, however many rows the label has.
    ranges = df.groupBy("label", "__range").agg(F.count(F.lit(1)).alias("__c"))
    w = W.partitionBy("label")
    ranges = ranges.select("label", "__range", F.sum("__c").over(w).alias("__n"), (F.sum("__c").over(w.orderBy("__range")) - F.col("__c")).alias("__before"))
    place = F.row_number().over(W.partitionBy("label", "__range").orderBy("__o", "path"))
    df = df.withColumn("__p", place).join(ranges.withColumnRenamed("label", "__label"), F.col("label").eqNullSafe(F.col("__label")) & (df["__range"] == ranges["__range"]))
    df = df.drop("__label").drop(ranges["__range"]).withColumn("__p", F.col("__p") + F.col("__before"))
    out = F.least(F.bround(F.col("__n") * (val + test), 0).cast("int"), (F.col("__n") - 1).cast("int"))
    out = F.when(F.col("__n") < 2, 0).otherwise(out)
    n_val = F.bround(out * (val / (val + test)), 0).cast("int")
    split = F.when(F.col("__p") <= n_val, "val").when(F.col("__p") <= out, "test").otherwise("train")
    return df.withColumn("split", split).drop("__n", "__p", "__o", "__range", "__before")


def leakage(splits: DataFrame) -> DataFrame:
    """For each pair of splits, rows of the first whose content is in the second (columns sha256, split)."""
    held = splits.groupBy("sha256", "split").agg(F.count(F.lit(1)).alias("n"))
    a = held.select("sha256", F.col("split").alias("a"), "n")
    b = held.select("sha256", F.col("split").alias("b"))
    both = a.join(b, "sha256").where("a < b").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    return both


def class_balance(splits: DataFrame) -> DataFrame:
    """Rows by split and label with totals; 'all' stands for every value."""
    out = splits.cube("split", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    return out.select(F.when(F.col("g").bitwiseAND(2) > 0, "all").otherwise(F.col("split")).alias("split"), F.when(F.col("g").bitwiseAND(1) > 0, "all").otherwise(F.col("label")).alias("label"), "n")


def class_map(rows: DataFrame) -> DataFrame:
    """label, class_id: labels in order, from 0."""
    return rows.select("label").distinct().withColumn("class_id", F.dense_rank().over(W.orderBy("label")) - 1)


def class_weights(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Balanced weights n / (k * count) over the labels present; 1 for labels without rows."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy()
    counts = counts.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
    wanted = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return wanted.join(counts.select("label", "weight"), "label", "left").na.fill(1.0, ["weight"])


def scene_weights(scenes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Sampling weight of a scene: the largest total / count over its labels; 1 for a scene without symbols."""
    counts = symbols.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rarity = counts.withColumn("rarity", F.sum("n").over(W.partitionBy()) / F.col("n")).select("label", "rarity")
    few = rarity.count() <= FEW_LABELS
    most = symbols.join(F.broadcast(rarity) if few else rarity, "label").groupBy("scene_id").agg(F.max("rarity").alias("weight"))
    return scenes.select("scene_id").join(most, "scene_id", "left").na.fill(1.0, ["weight"])


def topup_plan(symbols: DataFrame, cases: DataFrame, least: int, budgets: DataFrame) -> DataFrame:
    """Labels under ``least`` and, for each case that holds one, the images to add: one row for each (case, label)."""
    counts = symbols.groupBy("label").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") < least)
    holds = symbols.join(cases, "scene_id").select("case", "label").distinct()
    return holds.join(counts, "label").join(budgets, "case").select("case", "label", "have", F.col("n_train").alias("add_images"))


def case_budgets(cases: DataFrame, images: int, train: float = 0.8, val: float = 0.1, test: float = 0.1) -> DataFrame:
    """Images of each case and split from its weight: at least one each, half-even rounding, negative weights as 0."""
    n = F.greatest(F.lit(1.0), F.bround(images * F.greatest(F.col("weight"), F.lit(0.0)), 0))
    part = lambda share: F.greatest(F.lit(1.0), F.bround(n * (share / train), 0)).cast("long")
    return cases.select("case", n.cast("long").alias("n_train"), part(val).alias("n_val"), part(test).alias("n_test"))


def clean_counters(rows: DataFrame) -> DataFrame:
    """Processed, rejected and saved rows by label and in total."""
    n = lambda c: F.sum(c.cast("long"))
    return rows.rollup("label").agg(F.count(F.lit(1)).alias("processed"), n(F.col("rejected")).alias("rejected"), n(~F.col("rejected")).alias("saved"), F.grouping_id().alias("g")).select(F.when(F.col("g") > 0, "all").otherwise(F.col("label")).alias("label"), "processed", "rejected", "saved")


def tree_digest(files: DataFrame, by: str, leaf: int = MERKLE_LEAF) -> DataFrame:
    """by, digest, n_files: the root of a Merkle tree over each group's files (columns path, sha256).

    Files stand in ranges of the digest of name and content. A group of n files has the fewest levels of 256 ranges that
    leave ``leaf`` files or fewer in a range on average; a range's digest covers its files' sorted digests, a node's those of
    its at most 256 children with their numbers. So no array holds more than a range or a node, whatever the group's size,
    and the root depends on the files alone. A repeated row counts (the leaf holds how often); a null path or content differs
    from every text.
    """
    part = lambda c: F.coalesce(F.concat(F.lit("v"), F.col(c)), F.lit("n"))
    rows = files.select(F.col(by).alias("g"), F.sha2(F.concat(part("path"), F.lit("\n"), part("sha256")), 256).alias("h")).groupBy("g", "h").agg(F.count(F.lit(1)).alias("c"))
    sizes = rows.groupBy("g").agg(F.sum("c").alias("n_files"), F.count(F.lit(1)).alias("u"))
    depth = F.aggregate(F.sequence(F.lit(0), F.lit(7)), F.lit(0), lambda d, i: F.when(F.col("u") > leaf * F.pow(F.lit(256.0), i), i + 1).otherwise(d))
    sizes = cut(sizes.select("g", "n_files", depth.alias("d")))
    top = sizes.agg(F.max("d")).first()[0] or 0
    nodes = rows.join(sizes.select(F.col("g").alias("s"), "d"), F.col("g").eqNullSafe(F.col("s"))).drop("s")
    listed = lambda x: F.sha2(F.array_join(F.sort_array(F.collect_list(x)), "\n"), 256)
    nodes = nodes.withColumn("at", F.substring("h", F.lit(1), F.col("d") * 2)).groupBy("g", "d", "at").agg(listed(F.concat("h", F.lit(":"), F.col("c").cast("string"))).alias("x"))
    for level in range(top, 0, -1):
        deep = F.col("d") >= level
        up = F.when(deep, F.substring("at", 1, 2 * (level - 1))).otherwise(F.col("at"))
        nodes = nodes.groupBy("g", "d", up.alias("at")).agg(F.when(deep, listed(F.concat("at", F.lit(":"), "x"))).otherwise(F.first("x")).alias("x"))
    out = nodes.join(sizes.select(F.col("g").alias("s"), "n_files"), F.col("g").eqNullSafe(F.col("s")))
    return out.select(F.col("g").alias(by), F.col("x").alias("digest"), "n_files")


def dataset_meta(assets: DataFrame, splits: DataFrame, found: DataFrame) -> DataFrame:
    """One row: rows, classes, rows of each split, duplicates and issues."""
    a = assets.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("label").alias("n_classes"), (F.count(F.lit(1)) - F.count_distinct("sha256")).alias("n_duplicates"))
    n = lambda s: F.sum((F.col("split") == s).cast("long")).alias(f"n_{s}")
    b = splits.agg(n("train"), n("val"), n("test"))
    c = found.agg(F.count(F.lit(1)).alias("n_issues"))
    one = F.lit(1)
    return a.withColumn("k", one).join(b.withColumn("k", one), "k").join(c.withColumn("k", one), "k").drop("k")


def missing(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Expected values that do not occur."""
    return expected.select(key).distinct().join(actual.select(key), key, "left_anti")


def oversampled(rows: DataFrame, times: int, name: str = "path") -> DataFrame:
    """Each row ``times`` times under names of its own (suffix __rtNN)."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn(name, F.format_string("%s__rt%02d", F.col(name), F.col("copy")))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union over the columns that both have."""
    common = [c for c in a.columns if c in b.columns]
    return a.select(*common).unionByName(b.select(*common))


def preferred(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union in which a row of the first table replaces rows of the second with the same key."""
    both = merged(first.withColumn("__p", F.lit(0)), second.withColumn("__p", F.lit(1)))
    return both.withColumn("__r", F.rank().over(W.partitionBy(key).orderBy("__p"))).where("__r = 1").drop("__r", "__p")


def enriched(assets: DataFrame) -> DataFrame:
    """Manifest columns derived from label and content: role, glyph_key, yolo_class, asset_id, source_type."""
    label = F.col("label")
    return assets.withColumns({
        "role": o.role(label), "glyph_key": o.glyph_key(label), "yolo_class": o.coarse_or_main(label), "asset_id": F.substring("sha256", 1, 20),
        "source_type": F.when(o.role(label) == "operator", "operator").otherwise("digit"),
    })


def reported_issues(rows: DataFrame) -> DataFrame:
    """report_id, token_index, issue_type, should_be of the reported tokens (issue and should_be as people wrote them).

    A known alias names the issue; without one, a correction alone makes it a wrong label; other rows report nothing.
    """
    said = F.lower(F.trim(F.coalesce("issue", F.lit(""))))
    should = F.trim(F.coalesce("should_be", F.lit("")))
    kind = F.create_map(*[F.lit(x) for k, names in ISSUE_ALIASES.items() for n in names for x in (n, k)])[said]
    kind = F.coalesce(kind, F.when(should != "", "wrong_label"))
    return rows.select("report_id", "token_index", kind.alias("issue_type"), should.alias("should_be")).where("issue_type is not null")


def missed_lines(rows: DataFrame) -> DataFrame:
    """report_id, should_be, note: one row for each line that names a missed token (column missed, a text); its first word is the label."""
    lines = rows.select("report_id", F.explode(F.split("missed", "\\r?\\n")).alias("line")).select("report_id", F.trim(F.regexp_replace("line", "^\\s+|\\s+$", "")).alias("note")).where("note <> ''")
    return lines.select("report_id", F.get(F.split("note", "\\s+"), 0).alias("should_be"), "note")
