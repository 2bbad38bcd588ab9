"""Worked column solutions: tokens of an exercise (op, a, b), on the rows and columns where they are written.

Input tables have exercise_id, op and the two numbers a and b (not negative). Every digit comes from one expression over
the exercise; all tokens of an exercise are one array, exploded once. Columns: exercise_id, row, col, label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import let

ID = "exercise_id"
OFFSET = 2


def digits(n: Column, width: Column | None = None) -> Column:
    """The digits of a number from the left, padded with zeros to a width."""
    s = n.cast("string")
    return F.transform(F.split(F.lpad(s, width, F.lit("0")) if width is not None else s, ""), lambda c: c.cast("int"))


def n_digits(n: Column) -> Column:
    return F.length(n.cast("string"))


def power10(k: Column) -> Column:
    return F.pow(F.lit(10.0), k).cast("long")


def digit_at(n: Column, k: Column) -> Column:
    """The digit at place k (units are place 0)."""
    return F.floor(n / power10(k)).cast("long") % 10


def _column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _token(row, col, label) -> Column:
    return F.struct(_column(row).cast("int").alias("row"), _column(col).cast("int").alias("col"), _column(label).alias("label"))


def _one(row, col, label) -> Column:
    return F.array(_token(row, col, label))


def _number(n: Column, row, right, label: str = "main_") -> Column:
    """Tokens of a number (or of its digits as text) that ends at column ``right``."""
    place = lambda s: F.struct(s.alias("s"), (_column(right) - F.length(s) + 1).alias("first"))
    return let(place(n.cast("string")), lambda x: F.transform(F.split(x["s"], ""), lambda c, i: _token(row, x["first"] + i, F.concat(F.lit(label), c))))


def _marked(places: Column, carry, row, col) -> Column:
    """A token carry_<n> in column col(k) for each place k whose carry n is over 0."""
    found = F.filter(F.transform(places, lambda k: F.struct(k.alias("k"), carry(k).alias("n"))), lambda x: x["n"] > 0)
    return F.transform(found, lambda x: _token(row, col(x["k"]), F.concat(F.lit("carry_"), x["n"].cast("string"))))


def _range(first: int, last: Column) -> Column:
    """first to last; empty when last is smaller."""
    return F.when(last >= first, F.sequence(F.lit(first), last.cast("int"))).otherwise(F.array().cast("array<int>"))


def _written(df: DataFrame, rows: bool, *parts: Column) -> DataFrame:
    """One row for each exercise with its tokens (arrays of tokens joined), or one for each token."""
    if rows:
        return df.select(ID, F.concat(*parts).alias("tokens"))
    return token_rows(df.select(ID, F.concat(*parts).alias("tokens")))


def token_rows(df: DataFrame, *keep: str) -> DataFrame:
    """One row for each token.

    An inner explode would have Spark infer a filter on the size of the array and work out all tokens in it once more, below
    whatever makes the exercises distinct: for each row of the source.
    """
    return df.select(ID, *keep, F.explode_outer("tokens").alias("t")).where("t is not null").select(ID, *keep, "t.row", "t.col", "t.label")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def carries(a: Column, b: Column, k: Column) -> Column:
    """Whether adding a and b carries into place k (k >= 1)."""
    p = power10(k)
    return (a % p + b % p) >= p


def lacks(a: Column, b: Column, k: Column) -> Column:
    """Whether the lower k + 1 digits of a are less than those of b; false for k = -1."""
    p = power10(k + 1)
    return (k >= 0) & ((a % p) < (b % p))


def addition(ex: DataFrame, rows: bool = False) -> DataFrame:
    """Rows: carries 0, a 1, b with the operator 2, bar 3, sum 4."""
    a, b, r = F.col("a"), F.col("b"), F.col("a") + F.col("b")
    df = ex.select(ID, "a", "b", F.greatest(n_digits(a), n_digits(b), n_digits(r)).alias("w"))
    right = F.col("w") + (OFFSET - 1)
    marks = F.transform(F.filter(_range(1, F.col("w") - 1), lambda k: carries(a, b, k)), lambda k: _token(0, right - k, "carry_1"))
    return _written(df, rows, marks, _number(a, 1, right), _number(b, 2, right), _one(2, OFFSET - 1, "op_plus"), _one(3, OFFSET - 1, "result_bar"), _number(r, 4, right))


def subtraction(ex: DataFrame, rows: bool = False) -> DataFrame:
    """Rows: borrow marks 0, a 1, b with the operator 2, bar 3, difference 4. The larger number comes first.

    At place k, S(k) says that the lower digits of a lack. A place that has lent shows its new digit (9 in a chain of zeros);
    a place that borrows shows a 1, but for the leftmost place and for zeros inside a chain.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    df = ex.select(ID, hi.alias("a"), lo.alias("b")).withColumn("w", n_digits(F.col("a")))
    a, b, w = F.col("a"), F.col("b"), F.col("w")
    right, places = w + (OFFSET - 1), _range(0, w - 1)
    lent = lambda k: lacks(a, b, k - 1)
    left = lambda k: F.when(digit_at(a, k) == 0, 9).otherwise(digit_at(a, k) - 1).cast("string")
    shown = F.transform(F.filter(places, lent), lambda k: _token(0, right - k, F.concat(F.lit("borrow_"), left(k))))
    takes = F.filter(places, lambda k: lacks(a, b, k) & ~((digit_at(a, k) == 0) & lent(k)) & (k < w - 1))
    borrows = F.transform(takes, lambda k: _token(0, right - k, "borrow_1"))
    result = F.lpad((a - b).cast("string"), w, F.lit("0"))
    return _written(df, rows, shown, borrows, _number(a, 1, right), _number(b, 2, right), _one(2, OFFSET - 1, "op_minus"), _one(3, OFFSET - 1, "result_bar"), _number(result, 4, right))


def _pass_carries(a: Column, m: Column, right: Column, row) -> Column:
    """Carry marks of a times one digit m: the carry out of place k stands one column to the left, but for the leftmost."""
    carry = lambda k: F.floor((a % power10(k + 1)) * m / power10(k + 1)).cast("long")
    return _marked(_range(0, n_digits(a) - 2), carry, row, lambda k: right - k - 1)


def multiplication(ex: DataFrame, rows: bool = False) -> DataFrame:
    """One-digit b: carries 0, a 1, b 2, bar 3, product 4. More digits: a 0, b 1, bar 2, then for each digit of b its carries
    and its partial product (with trailing zeros and, after the first, a plus), the carries of the sum, bar, product; rows
    of carries that stay empty close up.
    """
    a, b, n, w = (F.col(c) for c in ("a", "b", "n", "w"))
    r = a * b
    df = ex.select(ID, "a", "b", n_digits(b).alias("n"), F.greatest(n_digits(a), n_digits(b), n_digits(r)).alias("w"))
    right, left = w + (OFFSET - 1), OFFSET - 1
    short = [_pass_carries(a, b, right, 0), _number(a, 1, right), _one(2, left, "op_times"), _number(b, 2, right), _one(3, left, "result_bar"), _number(r, 4, right)]
    passes = _range(0, n - 1)
    # Of each digit of b: its place, the digit, the partial product as it is written and as a number.
    one = lambda i, d: F.struct(i.alias("i"), d.alias("d"), F.concat((a * d).cast("string"), F.repeat(F.lit("0"), i)).alias("s"), (a * d * power10(i)).alias("v"))
    written = F.transform(passes, lambda i: let(digit_at(b, i), lambda d: one(i, d)))
    base = 3 + n * 2

    def tokens(ps: Column) -> Column:
        # Carry out of place k when the partial products are added: what their digits up to place k come to, over 10 ** (k + 1).
        carry = lambda k: let(power10(k + 1), lambda p: F.floor(F.aggregate(ps, F.lit(0).cast("long"), lambda s, x: s + x["v"] % p) / p).cast("long"))
        last = F.array_max(F.transform(ps, lambda x: F.length(x["s"]))) - 1
        sums = _marked(F.filter(_range(0, last), lambda k: right - k > OFFSET), carry, base, lambda k: right - k - 1)
        each = lambda x: F.concat(
            _pass_carries(a, x["d"], right - x["i"], 3 + x["i"] * 2), _number(x["s"], 4 + x["i"] * 2, right),
            F.filter(_one(4 + x["i"] * 2, right - F.length(x["s"]), "op_plus"), lambda t: x["i"] > 0),
        )
        return F.concat(_number(a, 0, right), _one(1, left, "op_times"), _number(b, 1, right), _one(2, left, "result_bar"), F.flatten(F.transform(ps, each)), sums, _one(base + 1, left, "result_bar"), _number(r, base + 2, right))

    # Close up: a row's number falls by the empty carry rows above it.
    closed = lambda ts, empty: F.transform(ts, lambda t: _token(t["row"] - F.size(F.filter(empty, lambda e: e < t["row"])), t["col"], t["label"]))
    free = lambda ts: F.array_except(F.transform(_range(0, n), lambda i: 3 + i * 2), F.transform(ts, lambda t: t["row"]))
    many = let(let(written, tokens), lambda ts: let(free(ts), lambda empty: closed(ts, empty)))
    return _written(df.where("n >= 1"), rows, F.when(n == 1, F.concat(*short)).otherwise(many))


def _steps() -> Column:
    """Array of (quotient digit q, product p, remainder r, last column c): the steps of a / b, from the first prefix >= b."""
    zero = F.lit(0).cast("long")
    step_type = "array<struct<q:long,p:long,r:long,c:int>>"
    start = F.struct(zero.alias("cur"), F.array().cast(step_type).alias("steps"))
    b = F.nullif(F.col("b"), F.lit(0))  # rows without a divisor may be looked at before they are left out
    places = F.transform(F.split(F.col("a").cast("string"), ""), lambda c, i: F.struct(c.cast("long").alias("d"), i.alias("i")))

    def take(acc, x):
        cur = acc["cur"] * 10 + x["d"]
        q = F.floor(cur / b).cast("long")
        step = F.struct(q.alias("q"), (q * b).alias("p"), (cur - q * b).alias("r"), x["i"].alias("c"))
        last = x["i"] == n_digits(F.col("a")) - 1
        counts = (F.size(acc["steps"]) > 0) | (cur >= b) | last
        return F.when(counts, F.struct((cur - q * b).alias("cur"), F.array_append(acc["steps"], step).alias("steps"))).otherwise(F.struct(cur.alias("cur"), acc["steps"].alias("steps")))

    return F.aggregate(places, start, take)["steps"]


def division_steps(ex: DataFrame) -> DataFrame:
    """exercise_id, step, quotient_digit, product, remainder, right_col: the steps of a / b, from the first prefix >= b."""
    df = ex.where("b > 0").select(ID, "a", "b", F.posexplode(_steps()).alias("step", "s"))
    return df.select(ID, "a", "b", "step", F.col("s.q").alias("quotient_digit"), F.col("s.p").alias("product"), F.col("s.r").alias("remainder"), F.col("s.c").alias("right_col"))


def long_division(ex: DataFrame, rows: bool = False) -> DataFrame:
    """Quotient in row 0; divisor, bracket (column -1) and dividend in row 1; product, bar and remainder of step k in rows 2 + 3k on."""
    df = ex.where("b > 0").select(ID, "a", "b", _steps().alias("steps"))
    a, b = F.col("a"), F.col("b")

    def tokens(s: Column, i: Column) -> Column:
        row, following = 2 + i * 3, F.get("steps", i + 1)["c"]
        last = following.isNull()
        brought = F.substr(a.cast("string"), following + 1, F.lit(1))
        return F.concat(
            _one(0, s["c"], F.concat(F.lit("main_"), s["q"].cast("string"))), _number(s["p"], row, s["c"]), _one(row + 1, s["c"] - n_digits(s["p"]), "result_bar"),
            F.filter(_number(s["r"], row + 2, F.when(last, s["c"]).otherwise(following - 1)), lambda t: last | (s["r"] > 0)),
            F.filter(_one(row + 2, following, F.concat(F.lit("main_"), brought)), lambda t: ~last),
        )

    return _written(df, rows, F.flatten(F.transform("steps", tokens)), _number(b, 1, -2), _one(1, -1, "div_bracket"), _number(a, 1, n_digits(a) - 1))


def simple_division(ex: DataFrame, rows: bool = False) -> DataFrame:
    """Exact divisions on one line: dividend, operator, divisor; the quotient right-aligned under a bar. Others are left out."""
    df = ex.where("b > 0 and a % b = 0").select(ID, "a", "b")
    a, b = F.col("a"), F.col("b")
    end = n_digits(a) + n_digits(b)
    return _written(df, rows, _number(a, 0, n_digits(a) - 1), _one(0, n_digits(a), "op_divide"), _number(b, 0, end), _one(1, 0, "result_bar"), _number(F.floor(a / b).cast("long"), 2, end))


def solutions(ex: DataFrame) -> DataFrame:
    """Tokens of all exercises (op: add, subtract, multiply, divide), with token_id in reading order."""
    by = {"add": addition, "subtract": subtraction, "multiply": multiplication, "divide": long_division}
    out = _union([f(ex.where(F.col("op") == op)) for op, f in by.items()])
    return out.withColumn("token_id", F.row_number().over(W.partitionBy(ID).orderBy("row", "col", "label")))


def difficulty(ex: DataFrame) -> DataFrame:
    """n_carries of the sum, n_borrows of the difference, and the classes no_carries, dense_carries, forced_borrows."""
    a, b = F.col("a"), F.col("b")
    hi, lo = F.greatest(a, b), F.least(a, b)
    places = F.sequence(F.lit(1), F.greatest(n_digits(a), n_digits(b)))
    df = ex.withColumns({
        "n_carries": F.size(F.filter(places, lambda k: carries(a, b, k))),
        "n_borrows": F.size(F.filter(places, lambda k: lacks(hi, lo, k - 1))),
    })
    n = F.least(n_digits(a), n_digits(b))
    return df.withColumns({"no_carries": F.col("n_carries") == 0, "dense_carries": F.col("n_carries") >= n, "forced_borrows": F.col("n_borrows") >= 1})


# ---- variants and completion stages: filters over a token table ----


def _max_row() -> Column:
    return F.max("row").over(W.partitionBy(ID))


def is_mark() -> Column:
    return F.col("label").startswith("carry_") | F.col("label").startswith("borrow_")


def without_result(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("__m", _max_row()).where("row <> __m").drop("__m")


def without_bar(tokens: DataFrame) -> DataFrame:
    """No result and no bar above it."""
    return tokens.withColumn("__m", _max_row()).where("row < __m - 1").drop("__m")


def without_marks(tokens: DataFrame) -> DataFrame:
    return tokens.where(~is_mark())


def partial_result(tokens: DataFrame, share: float = 0.5) -> DataFrame:
    """The last digits of the result dropped: a share (half-even), at least one, but one digit stays."""
    df = tokens.withColumn("__m", _max_row()).withColumn("__in", (F.col("row") == F.col("__m")) & F.col("label").startswith("main_"))
    w = W.partitionBy(ID, "__in")
    df = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc("col"))))
    gone = F.when(F.col("__n") <= 1, 0).otherwise(F.least(F.greatest(F.lit(1), F.bround(F.col("__n") * share, 0)), F.col("__n") - 1))
    return df.where(~F.col("__in") | (F.col("__r") > gone)).drop("__m", "__in", "__n", "__r")


def operator_on_the_right(tokens: DataFrame) -> DataFrame:
    """The operator of a sum or difference one column right of its operands."""
    op = F.col("label").isin("op_plus", "op_minus") & (F.col("row") == 2)
    last = F.max(F.when(F.col("label").startswith("main_"), F.col("col"))).over(W.partitionBy(ID))
    return tokens.withColumn("__l", last).withColumn("col", F.when(op, F.col("__l") + 1).otherwise(F.col("col"))).drop("__l")


def two_in_a_cell(tokens: DataFrame) -> DataFrame:
    """A borrowing digit written as a pair: the 1 and the digit below it share a cell, told apart by sub_pos."""
    units = tokens.where("row = 1").select(ID, "col", F.substr("label", F.lit(6)).alias("__d"))
    ones = tokens.where("row = 0 and label = 'borrow_1'").join(units, [ID, "col"])
    pair = ones.select(ID, "row", "col", F.posexplode(F.array(F.lit("borrow_1"), F.concat(F.lit("borrow_"), "__d"))).alias("sub_pos", "label"))
    rest = tokens.where("not (row = 0 and label = 'borrow_1')").select(ID, "row", "col", F.lit(0).alias("sub_pos"), "label")
    return rest.unionByName(pair)


def result_override(tokens: DataFrame, results: DataFrame) -> DataFrame:
    """Result digits replaced from the right by those of a given number (columns exercise_id, result); extra digits stay."""
    w = W.partitionBy(ID, "__in").orderBy(F.desc("col"))
    df = tokens.withColumn("__m", _max_row()).withColumn("__in", (F.col("row") == F.col("__m")) & F.col("label").startswith("main_")).withColumn("__p", F.row_number().over(w))
    df = df.join(results.withColumn("__s", F.reverse(F.col("result").cast("string"))).select(ID, "__s"), ID, "left")
    fits = F.col("__in") & (F.col("__p") <= F.length("__s"))
    return df.withColumn("label", F.when(fits, F.concat(F.lit("main_"), F.substr("__s", F.col("__p"), F.lit(1)))).otherwise(F.col("label"))).drop("__m", "__in", "__p", "__s")


def chance(seed: int, *keys: str) -> Column:
    """A uniform number from a digest of the keys."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)


def injected(tokens: DataFrame, kind: str, p: float = 1.0, seed: int = 0) -> DataFrame:
    """Tokens with a deliberate error in a share p of the exercises.

    Kinds: wrong_result (the last result digit one higher), wrong_operator, drop_bar, drop_marks, wrong_mark (marks one
    higher), shifted_marks (one column to the left), drop_partial (the row of the second partial product).
    """
    hit = chance(seed, ID) < p
    label, w = F.col("label"), W.partitionBy(ID)
    number = F.substr(label, F.length(label), F.lit(1)).cast("int")
    up = F.concat(F.substr(label, F.lit(1), F.length(label) - 1), ((number + 1) % 10).cast("string"))
    if kind == "wrong_result":
        at = (F.col("row") == F.max("row").over(w)) & label.startswith("main_")
        df = tokens.withColumn("__at", at)
        last = F.max(F.when(F.col("__at"), F.col("col"))).over(w)
        return df.withColumn("__c", last).withColumn("label", F.when(hit & F.col("__at") & (F.col("col") == F.col("__c")), up).otherwise(label)).drop("__at", "__c")
    if kind == "wrong_operator":
        swap = {"op_plus": "op_minus", "op_minus": "op_plus", "op_times": "op_plus", "op_divide": "op_times"}
        other = F.create_map(*[F.lit(x) for kv in swap.items() for x in kv])[label]
        return tokens.withColumn("label", F.when(hit & other.isNotNull(), other).otherwise(label))
    if kind in ("drop_bar", "drop_marks", "drop_partial"):
        gone = {"drop_bar": label == "result_bar", "drop_marks": is_mark(), "drop_partial": F.col("row") == 6}[kind]
        return tokens.where(~(hit & gone))
    if kind == "wrong_mark":
        return tokens.withColumn("label", F.when(hit & is_mark(), up).otherwise(label))
    if kind == "shifted_marks":
        return tokens.withColumn("col", F.when(hit & is_mark(), F.col("col") - 1).otherwise(F.col("col")))
    raise ValueError(f"unknown error kind {kind}")


# ---- completion stages of a scene case ----

# Stages with their weights, and the scene cases by the stages they allow.
STAGE_WEIGHTS = {"full": 0.65, "done_80": 0.15, "done_60": 0.07, "done_40": 0.06, "done_20": 0.07}
STAGES_OF = {
    ("full", "done_80", "done_60", "done_40", "done_20"): (
        "addition", "subtraction", "addition_op_right", "subtraction_op_right", "subtraction_heavy_borrow", "addition_dense_carries", "addition_no_carries", "subtraction_crowded_borrow",
        "addition_crowded_carry", "multiplication_simple", "multiplication_multi", "multiplication_simple_op_right", "division_short", "division_long",
    ),
    ("full", "done_60", "done_40", "done_20"): ("addition_no_bar", "subtraction_no_bar", "multiplication_simple_no_bar"),
    ("full", "done_80", "done_40"): ("division_simple",),
    ("full",): ("bare_digits", "bare_digit_grid", "standalone_bar", "standalone_bracket"),
}


def stage_weights(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    """scene_case, place, stage, upto: the stages of each case with the upper end of their share; the last one takes the rest."""
    weights = STAGE_WEIGHTS if weights is None else weights
    rows = []
    for stages, cases in STAGES_OF.items():
        ends = [round(sum(weights[s] for s in stages[: i + 1]), 9) for i in range(len(stages) - 1)] + [1.0]
        rows += [(case, i, stage, end) for case in cases for i, (stage, end) in enumerate(zip(stages, ends, strict=True))]
    return spark.createDataFrame(rows, "scene_case string, place int, stage string, upto double")


def drawn_stage(scenes: DataFrame, uniform: str | None = None, seed: int = 11, weights: dict[str, float] | None = None) -> DataFrame:
    """scenes (exercise_id, scene_case) with a stage drawn by weight; cases that are not known stay full.

    uniform: a column of numbers from 0 to 1; without it they are digests of the exercise.
    """
    listed = stage_weights(scenes.sparkSession, weights).groupBy("scene_case").agg(F.sort_array(F.collect_list(F.struct("place", "upto", "stage"))).alias("__s"))
    u = chance(seed, ID) if uniform is None else F.col(uniform)
    return scenes.join(F.broadcast(listed), "scene_case", "left").withColumn("stage", F.coalesce(F.get(F.filter("__s", lambda s: u < s["upto"]), 0)["stage"], F.lit("full"))).drop("__s")
