"""Grading of submitted cells against expected cells.

expected: exercise_id, x, y, c, role, given. submitted: submission_id, exercise_id, token_id, c, x, y, type, tags. Bars have
the character '' or '_'. Every step is keyed by submission_id, so one shuffle serves the whole of a submission.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import stats
from .quality import issues

SUB, EX = "submission_id", "exercise_id"
STEP_ROLES = ("carry", "borrow", "partial")
ANSWER_ROLES = ("answer",)
MOST_DY = 6
TOKEN = ("token_id", "c", "x", "y", "type")
CELL = ("x", "y", "c", "role", "given")


def is_bar(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).isin("", "_")


def as_submission(expected: DataFrame) -> DataFrame:
    """Expected cells as tokens: borrows REPLACE, carries OVERFLOW, others SYMBOL; given cells tagged FIXED."""
    kind = F.when(F.col("role") == "borrow", "REPLACE").when(F.col("role") == "carry", "OVERFLOW").otherwise("SYMBOL")
    ident = F.concat(F.lit("E"), (F.row_number().over(W.partitionBy(EX).orderBy("y", "x", "role")) - 1).cast("string"))
    return expected.select(EX, ident.alias("token_id"), "c", "x", "y", F.when(F.col("given"), F.array(F.lit("FIXED"))).otherwise(F.array().cast("array<string>")).alias("tags"), kind.alias("type"))


def with_given(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """Child tokens on given cells dropped and the given cells added as FIXED tokens."""
    given = expected.where("given")
    child = submitted.join(given.select(EX, "x", "y"), [EX, "x", "y"], "left_anti")
    subs = submitted.select(SUB, EX).distinct()
    fixed = subs.join(as_submission(given), EX).withColumn("token_id", F.concat(F.lit("G"), "token_id"))
    cols = [SUB, EX, "token_id", "c", "x", "y", "tags", "type"]
    return child.select(*cols).unionByName(fixed.select(*cols))


def together(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """submission_id, exercise_id, tokens and cells: one row for each submission. All that follows stays inside the row."""
    tokens = submitted.groupBy(SUB, EX).agg(F.collect_list(F.struct("token_id", "c", "x", "y", "type")).alias("tokens"))
    cells = expected.groupBy(EX).agg(F.collect_list(F.struct("x", "y", "c", "role", "given")).alias("cells"))
    none = F.array().cast("array<struct<x:int,y:int,c:string,role:string,given:boolean>>")
    return tokens.join(cells, EX, "left").withColumn("cells", F.coalesce("cells", none))


def _shift(tokens: Column, cells: Column, most: int = MOST_DY) -> Column:
    rows = lambda of: F.array_distinct(F.transform(F.filter(of, lambda v: ~is_bar(v["c"])), lambda v: v["y"]))
    own, levels = rows(tokens), rows(cells)
    votes = F.transform(F.sequence(F.lit(-most), F.lit(most)), lambda dy: F.struct((-F.size(F.filter(own, lambda y: F.array_contains(levels, y + dy)))).alias("n"), F.abs(dy).alias("d"), dy.alias("dy")))
    return F.coalesce(F.array_min(F.filter(votes, lambda v: v["n"] < 0))["dy"], F.lit(0))


def row_shift(submitted: DataFrame, expected: DataFrame, most: int = MOST_DY) -> DataFrame:
    """submission_id, dy: the vertical shift that puts most of a submission's rows on expected rows; nearest to 0, then negative."""
    return together(submitted, expected).select(SUB, _shift(F.col("tokens"), F.col("cells"), most).alias("dy"))


def _levels(cells: Column) -> Column:
    """The rows of cells: y, whether they are bars only, and their last x."""

    def level(y: Column) -> Column:
        own = F.filter(cells, lambda e: e["y"] == y)
        return F.struct(y.alias("y"), F.forall(own, lambda e: is_bar(e["c"])).alias("bar"), F.array_max(F.transform(own, lambda e: e["x"])).alias("last"))

    return F.transform(F.array_distinct(F.transform(cells, lambda e: e["y"])), level)


def matching(tokens: Column, cells: Column) -> Column:
    """The tokens with ex, ey, the cell that each fills; see ``structure_match``."""

    def placed(t: Column, dy: Column, levels: Column) -> Column:
        y = F.when(is_bar(t["c"]), t["y"]).otherwise(t["y"] + dy)
        costs = F.transform(levels, lambda v: F.struct((is_bar(t["c"]) != v["bar"]).cast("int").alias("k"), F.abs(y - v["y"]).alias("d"), v["y"].alias("ey"), v["last"].alias("last")))
        return F.struct(*[t[c].alias(c) for c in TOKEN], F.array_min(costs).alias("to"))

    def found(t: Column, all_placed: Column) -> Column:
        mates = F.filter(all_placed, lambda o: o["to"]["ey"] == t["to"]["ey"])
        ex = t["to"]["last"] - (F.array_max(F.transform(mates, lambda o: o["x"])) - t["x"])
        first = ~F.exists(mates, lambda o: (o["x"] == t["x"]) & (o["token_id"] > t["token_id"]))
        here = stats.let(ex, lambda x: F.when(first & F.exists(cells, lambda e: (e["y"] == t["to"]["ey"]) & (e["x"] == x)), x))
        return stats.let(here, lambda x: F.struct(*[t[c].alias(c) for c in TOKEN], x.alias("ex"), F.when(x.isNotNull(), t["to"]["ey"]).alias("ey")))

    each = stats.let(_shift(tokens, cells), lambda dy: stats.let(_levels(cells), lambda levels: F.transform(tokens, lambda t: placed(t, dy, levels))))
    return stats.let(F.filter(each, lambda t: t["to"].isNotNull()), lambda ts: F.transform(ts, lambda t: found(t, ts)))


def structure_match(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """Each submitted token with the expected cell that it fills: ex, ey are null for extras.

    After the shift of ``row_shift`` (bars stay) a token goes to the nearest expected row, a row of its own kind (bar or not)
    first, the smaller y among equals. In a row, cells and tokens are counted from the right, and equal slots match; of
    several tokens in one slot the last by order of token_id counts.
    """
    both = together(submitted, expected)
    return both.select(SUB, EX, F.explode(matching(F.col("tokens"), F.col("cells"))).alias("t")).select(SUB, EX, "t.*")


def groups(expected: DataFrame) -> DataFrame:
    """Expected cells with the first x of their group: cells side by side in one row with one role."""
    w = W.partitionBy(EX, "y", "role").orderBy("x")
    df = expected.withColumn("__k", F.col("x") - F.row_number().over(w))
    return df.withColumn("group_x", F.min("x").over(W.partitionBy(EX, "y", "role", "__k"))).drop("__k")


def _core(expected: DataFrame) -> DataFrame:
    return expected.where(~((F.col("role") == "borrow") & ~F.col("given")))


def graded_rows(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """Each submission with its cells (es), and for each cell what was written there and its group's status.

    Steps (carry, borrow, partial) count by presence: one token makes the group OK. Other groups are OK when every cell is
    right, else wrong cells are ERROR and empty ones MISSING if any is wrong, else the group is MISSING as a whole; given
    groups without a wrong cell are always OK. Borrows are optional: only drawn ones (type REPLACE) count, by value.
    """
    optional = lambda e: (e["role"] == "borrow") & ~e["given"]
    drawn = lambda t: t["type"] == "REPLACE"
    right = lambda e: F.coalesce(e["got"] == e["c"], F.lit(False))
    wrong = lambda e: F.coalesce(e["got"] != e["c"], F.lit(False))

    def filled(e: Column, cells: Column, placed: Column) -> Column:
        """The cell with what was written there and the first x of its group."""
        xs = F.transform(F.filter(cells, lambda o: (o["y"] == e["y"]) & (o["role"] == e["role"]) & (o["x"] <= e["x"])), lambda o: o["x"])
        first = F.array_max(F.filter(xs, lambda x: ~F.array_contains(xs, x - 1)))
        written = F.get(F.filter(placed, lambda p: (p["ex"] == e["x"]) & (p["ey"] == e["y"])), 0)
        return stats.let(written, lambda t: F.struct(*[e[c].alias(c) for c in CELL], first.alias("group_x"), t["c"].alias("got"), t["token_id"].alias("token_id")))

    def judged(e: Column, cells: Column) -> Column:
        own = F.filter(cells, lambda o: (o["y"] == e["y"]) & (o["role"] == e["role"]) & (o["group_x"] == e["group_x"]))
        facts = lambda g: F.struct(
            F.forall(g, lambda o: o["given"]).alias("given"), F.forall(g, right).alias("all"), F.exists(g, wrong).alias("bad"), F.exists(g, lambda o: o["got"].isNotNull()).alias("some")
        )
        return stats.let(stats.let(own, facts), lambda f: result(e, f))

    def result(e: Column, f: Column) -> Column:
        step = e["role"].isin(*STEP_ROLES) & ~f["given"]
        status = (
            F.when(step, F.when(f["some"], "OK").otherwise("MISSING"))
            .when(f["all"], "OK")
            .when(f["bad"], F.when(wrong(e), "ERROR").when(e["got"].isNull(), "MISSING").otherwise("OK"))
            .when(f["given"], "OK").otherwise("MISSING")
        )
        counts = F.when(step, f["some"]).otherwise(f["all"] & ~e["given"])
        return _graded(e, e["group_x"], e["got"], e["token_id"], status, step | ~e["given"], counts, f["bad"])

    def borrowed(e: Column, tokens: Column) -> Column:
        here = F.filter(tokens, lambda t: drawn(t) & (t["x"] == e["x"]) & (t["y"] == e["y"]))
        ok = lambda t: F.coalesce(t["c"] == e["c"], F.lit(False))
        return F.transform(here, lambda t: _graded(e, e["x"], t["c"], t["token_id"], F.when(ok(t), "OK").otherwise("ERROR"), F.lit(True), ok(t), ~ok(t)))

    def whole(tokens: Column, cells: Column) -> Column:
        core = F.filter(cells, lambda e: ~optional(e))
        placed = lambda es: matching(F.filter(tokens, lambda t: ~drawn(t)), es)
        graded = stats.let(core, lambda es: stats.let(placed(es), lambda ps: stats.let(F.transform(es, lambda e: filled(e, es, ps)), lambda fs: F.transform(fs, lambda e: judged(e, fs)))))
        return F.concat(graded, F.flatten(F.transform(F.filter(cells, optional), lambda e: borrowed(e, tokens))))

    both = together(submitted, expected)
    return both.select(SUB, EX, whole(F.col("tokens"), F.col("cells")).alias("es"))


def graded_cells(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """The cells of ``graded_rows``, a row for each."""
    return graded_rows(submitted, expected).select(SUB, EX, F.explode("es").alias("e")).select(SUB, EX, "e.*")


def _graded(e: Column, group_x: Column, got: Column, token_id: Column, status: Column, required: Column, matched: Column, group_wrong: Column) -> Column:
    return F.struct(
        *[e[c].alias(c) for c in CELL], group_x.alias("group_x"), got.alias("got"), token_id.alias("token_id"), status.alias("status"),
        required.alias("required"), matched.alias("matched"), group_wrong.alias("group_wrong"),
    )


def graded_elements(cells: DataFrame) -> DataFrame:
    """One row for each element: whole groups, but cell by cell where a group has a wrong cell (its right cells are left out)."""
    alone = cells.where("group_wrong and status <> 'OK'").select(SUB, "role", F.col("x").alias("left_x"), "y", F.lit(1).cast("long").alias("width"), F.col("c").alias("num"), "status", F.coalesce(F.array_compact(F.array("token_id")), F.array().cast("array<string>")).alias("token_ids"))
    whole = cells.where("not group_wrong or role in ('carry', 'partial') or (role = 'borrow' and status = 'OK')").groupBy(SUB, "role", "y", F.col("group_x").alias("left_x"), "status")
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "c"))), lambda v: v["c"]), "")
    ids = F.transform(F.array_compact(F.sort_array(F.collect_list(F.when(F.col("token_id").isNotNull(), F.struct("x", "token_id"))))), lambda v: v["token_id"])
    return whole.agg(F.count(F.lit(1)).alias("width"), texts.alias("num"), ids.alias("token_ids")).select(SUB, "role", "left_x", "y", "width", "num", "status", "token_ids").unionByName(alone)


def extras(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """Unexpected tokens: no cell, no bar, and not on a row of steps."""
    steps = expected.where(F.col("role").isin(*STEP_ROLES) & ~F.col("given") & (F.col("role") != "borrow")).select(EX, "y").distinct()
    out = structure_match(submitted.where("type <> 'REPLACE'"), _core(expected)).where(F.col("ex").isNull() & ~is_bar(F.col("c")))
    return out.join(steps, [EX, "y"], "left_anti").select(SUB, EX, "token_id", "c", "x", "y")


def progress(cells: DataFrame) -> DataFrame:
    """matched, total and progress of each submission (1 when nothing is required); finished at 1."""
    n = lambda c: F.sum(c.cast("long"))
    required = F.col("required")
    df = cells.groupBy(SUB).agg(n(F.col("matched") & required).alias("matched"), n(required).alias("total"))
    share = F.when(F.col("total") > 0, F.col("matched") / F.col("total")).otherwise(1.0)
    return df.withColumn("progress", share).withColumn("finished", F.col("progress") >= 1)


def verdicts(cells: DataFrame) -> DataFrame:
    """mistake > incomplete > missing_step > correct; and the shorter form correct, mistake or incomplete of any element."""
    own = ~F.col("given")
    any_of = lambda c: F.coalesce(F.max(c), F.lit(False))
    answer, step = F.col("role").isin(*ANSWER_ROLES) & own, F.col("role").isin(*STEP_ROLES) & own
    error, missing = F.col("status") == "ERROR", F.col("status") == "MISSING"
    df = cells.groupBy(SUB).agg(any_of(error & answer).alias("e"), any_of(missing & answer).alias("m"), any_of(missing & step).alias("s"), any_of(error).alias("ae"))
    df = df.join(progress(cells), SUB)
    done = F.col("progress") >= 1
    long = F.when(F.col("e"), "mistake").when(F.col("m"), "incomplete").when(F.col("s"), "missing_step").when(done, "correct").otherwise("incomplete")
    short = F.when(done, "correct").when(F.col("ae"), "mistake").otherwise("incomplete")
    return df.select(SUB, "progress", long.alias("outcome"), short.alias("short_outcome"))


def evaluated(submitted: DataFrame, expected: DataFrame) -> DataFrame:
    """One row for each submission: progress, finished, outcome, short_outcome, hint and elements.

    Given cells replace what was drawn over them; then everything is matched, graded and judged inside the row, in one
    exchange of the tokens and one of the cells. hint: (role, left_x, y) of the missing group nearest the lowest answer row,
    the rightmost first; null when nothing is missing. elements: as ``graded_elements``, sorted, with their token ids.
    """
    graded = graded_rows(with_given(submitted, expected), expected)
    es = F.col("es")
    own = lambda e: ~e["given"]
    is_step = lambda e: e["role"].isin(*STEP_ROLES) & own(e)
    is_answer = lambda e: e["role"].isin(*ANSWER_ROLES) & own(e)
    error, missing = lambda e: e["status"] == "ERROR", lambda e: e["status"] == "MISSING"
    count = lambda holds: F.size(F.filter(es, holds)).cast("long")
    some = lambda holds: F.exists(es, holds)
    answer_y = F.array_max(F.transform(F.filter(es, is_answer), lambda e: e["y"]))
    open_cells = F.filter(es, lambda e: missing(e) & ~e["group_wrong"] & own(e))
    hint = lambda y: F.array_min(F.transform(open_cells, lambda e: F.struct(F.abs(e["y"] - y).alias("d"), (-e["x"]).alias("n"), e["y"].alias("y"), e["group_x"].alias("left_x"), e["role"].alias("role"))))
    df = graded.select(
        SUB, count(lambda e: e["matched"] & e["required"]).alias("m"), count(lambda e: e["required"]).alias("n"), some(lambda e: error(e) & is_answer(e)).alias("e"),
        some(lambda e: missing(e) & is_answer(e)).alias("mi"), some(lambda e: missing(e) & is_step(e)).alias("s"), some(error).alias("ae"), stats.let(answer_y, hint).alias("h"), _elements(es).alias("elements"),
    )
    done = F.col("m") == F.col("n")
    long = F.when(F.col("e"), "mistake").when(F.col("mi"), "incomplete").when(F.col("s"), "missing_step").when(done, "correct").otherwise("incomplete")
    return df.select(
        SUB, F.when(F.col("n") > 0, F.col("m") / F.col("n")).otherwise(1.0).alias("progress"), done.alias("finished"), long.alias("outcome"),
        F.when(done, "correct").when(F.col("ae"), "mistake").otherwise("incomplete").alias("short_outcome"), F.when(F.col("h").isNotNull(), F.struct("h.role", "h.left_x", "h.y")).alias("hint"), "elements",
    )


def _elements(es: Column) -> Column:
    """The elements of a row of graded cells: whole groups, but the cells that are not right of a group with a wrong one."""
    ids = lambda part: F.array_compact(F.transform(part, lambda e: e["token_id"]))
    element = lambda e, left, width, num, tokens: F.struct(e["role"].alias("role"), left.alias("left_x"), e["y"].alias("y"), width.alias("width"), num.alias("num"), e["status"].alias("status"), tokens.alias("token_ids"))
    alone = F.filter(es, lambda e: e["group_wrong"] & (e["status"] != "OK"))
    whole = F.filter(es, lambda e: ~e["group_wrong"] | e["role"].isin("carry", "partial") | ((e["role"] == "borrow") & (e["status"] == "OK")))
    key = lambda e: F.struct(e["role"].alias("role"), e["y"].alias("y"), e["group_x"].alias("group_x"), e["status"].alias("status"))

    def group(k: Column, cells: Column) -> Column:
        part = F.sort_array(F.filter(cells, lambda e: key(e) == k))
        return stats.let(part, lambda p: element(k, k["group_x"], F.size(p).cast("long"), F.array_join(F.transform(p, lambda e: e["c"]), ""), ids(p)))

    groups_ = stats.let(whole, lambda cells: F.transform(F.array_distinct(F.transform(cells, key)), lambda k: group(k, cells)))
    single = F.transform(alone, lambda e: element(e, e["x"], F.lit(1).cast("long"), e["c"], F.array_compact(F.array(e["token_id"]))))
    return F.sort_array(F.concat(groups_, single))


def next_hint(cells: DataFrame, answer_rows: DataFrame) -> DataFrame:
    """The missing group nearest the answer row, the rightmost first (answer_rows: exercise_id, answer_y)."""
    miss = cells.where("status = 'MISSING' and not group_wrong and not given").groupBy(SUB, EX, "role", "y", "group_x").agg(F.max("x").alias("last_x"))
    miss = miss.join(answer_rows, EX)
    best = F.min(F.struct(F.abs(F.col("y") - F.col("answer_y")).alias("d"), (-F.col("last_x")).alias("n"), "y", "group_x", "role"))
    return miss.groupBy(SUB).agg(best.alias("b")).select(SUB, F.col("b.group_x").alias("left_x"), F.col("b.y").alias("y"), F.col("b.role").alias("role"))


def calibration_report(sent: DataFrame, elements: DataFrame) -> DataFrame:
    """Offsets between sent tokens and the elements that echo them: matched, unmatched, aligned and a single offset, if there is one."""
    echo = elements.select(SUB, "ex", "ey", F.explode("token_ids").alias("token_id"))
    both = sent.join(echo, [SUB, "token_id"], "left")
    off = F.when(F.col("ex").isNotNull(), F.struct((F.col("x") - F.col("ex")).alias("dx"), (F.col("y") - F.col("ey")).alias("dy")))
    df = both.groupBy(SUB).agg(F.count(off).alias("matched"), (F.count(F.lit(1)) - F.count(off)).alias("unmatched"), F.count_distinct(off).alias("n"), F.min(off).alias("o"))
    single = F.col("n") == 1
    zero = (F.col("o.dx") == 0) & (F.col("o.dy") == 0)
    return df.select(SUB, "matched", "unmatched", (single & F.coalesce(zero, F.lit(False))).alias("aligned"), F.when(single & ~zero, F.col("o.dx")).alias("dx"), F.when(single & ~zero, F.col("o.dy")).alias("dy"))


def union_boxes(elements: DataFrame, tokens: DataFrame, key: str = SUB) -> DataFrame:
    """The box around the tokens of each element (columns element_id, token_ids)."""
    ids = elements.select(key, "element_id", F.explode("token_ids").alias("token_id"))
    return ids.join(tokens, [key, "token_id"]).groupBy(key, "element_id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def layout_bounds(cells: DataFrame, size: float = 512.0, margin: float = 32.0, key: str = EX) -> DataFrame:
    """Used cell box of each layout, with pitch and origin that centre it on the canvas."""
    df = cells.groupBy(key).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))
    wide, high = F.col("max_x") - F.col("min_x") + 1, F.col("max_y") - F.col("min_y") + 1
    df = df.withColumn("pitch", F.floor((size - 2 * margin) / F.greatest(wide, high)))
    return df.withColumns({"origin_x": (size - F.col("pitch") * wide) / 2, "origin_y": (size - F.col("pitch") * high) / 2})


def snapped(glyphs: DataFrame, typed: DataFrame, pitch: float, key: str = SUB) -> DataFrame:
    """Clusters of glyphs moved to the nearest typed cell whose centre lies within 1.5 cells on both axes; else each stays in its cell.

    glyphs: key, cluster_id, token_id, c, cx, cy. typed: key, x, y, type. A snapped cluster is one token: characters from left to
    right, the first one's id.
    """
    return tokens_to_grid(glyphs, typed, pitch, key=key)


def tokens_to_grid(glyphs: DataFrame, typed: DataFrame, pitch: float, origin_x: float = 0.0, origin_y: float = 0.0, cells: int | None = None, key: str = SUB) -> DataFrame:
    """Glyphs at pixel centres to tokens on a grid (cells: its size, to which places are clamped); see ``snapped`` for the columns and the snapping."""
    centre = glyphs.groupBy(key, "cluster_id").agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"))
    dx, dy = (F.abs(F.col(m) - (F.col(c) + 0.5) * pitch - o) for m, c, o in (("mx", "x", origin_x), ("my", "y", origin_y)))
    near = F.min(F.struct((dx * dx + dy * dy).alias("d"), "y", "x", "type", ((dx <= 1.5 * pitch) & (dy <= 1.5 * pitch)).alias("fits")))
    best = centre.join(typed, key).groupBy(key, "cluster_id").agg(near.alias("b"))
    joined = glyphs.join(best, [key, "cluster_id"], "left")
    fits = F.coalesce(F.col("b.fits"), F.lit(False))
    order = F.sort_array(F.collect_list(F.struct("cx", "token_id", "c")))
    moved = joined.where(fits).groupBy(key, F.col("b.x").alias("x"), F.col("b.y").alias("y"), F.col("b.type").alias("type")).agg(order.alias("o"))
    moved = moved.select(key, F.get("o", 0)["token_id"].alias("token_id"), F.array_join(F.transform("o", lambda g: g["c"]), "").alias("c"), "x", "y", "type")

    def cell(c: str, origin: float) -> Column:
        at = F.floor((F.col(c) - origin) / pitch)
        return (at if cells is None else F.greatest(F.lit(0), F.least(F.lit(cells - 1), at))).cast("int")

    stay = joined.where(~fits).select(key, "token_id", "c", cell("cx", origin_x).alias("x"), cell("cy", origin_y).alias("y"), F.lit("SYMBOL").alias("type"))
    return moved.unionByName(stay)


# Signs of the operators in exercise cells.
OPERATOR_SIGNS = {"+": "op_plus", "-": "op_minus", "*": "op_times", "×": "op_times", "x": "op_times", "/": "op_divide", "÷": "op_divide"}


def given_prior(expected: DataFrame, pitch: float, origin_x: float, origin_y: float, top: int) -> tuple[DataFrame, DataFrame]:
    """Pixel boxes and labels of an exercise's given cells (row ``top`` is the uppermost), and issues for cells that cannot be used.

    Boxes are cut to whole pixels. Only printed scaffold may enter: bars, brackets, operators and operand digits. A given
    cell of a role that a child fills in is refused (not_given), a sign without a label too (unknown_label).
    """
    c, role = F.col("c"), F.col("role")
    sign = F.create_map(*[F.lit(x) for kv in OPERATOR_SIGNS.items() for x in kv])[c]
    fine = (
        F.when(role.isin("bar", "result_bar"), "result_bar").when(role.isin("bracket", "div_bracket"), "div_bracket").when(role == "operator", sign)
        .when((role == "operand") & c.rlike("^[0-9]$"), F.concat(F.lit("main_"), c))
    )
    df = expected.where("given").withColumn("fine_label", fine)
    coarse = F.when(role == "operator", "operator").when(F.col("fine_label") == "div_bracket", "divide_bracket").when(F.col("fine_label") == "result_bar", "result_bar").otherwise("digit_main")
    left, upper = F.col("x") * pitch + origin_x, (top - F.col("y")) * pitch + origin_y
    whole = lambda v: v.cast("int")
    nodes = df.where("fine_label is not null").select(
        EX, "x", "y", "c", whole(left).alias("x0"), whole(upper).alias("y0"), whole(left + pitch).alias("x1"), whole(upper + pitch).alias("y1"), "fine_label", coarse.alias("coarse_label")
    )
    filled = role.isin(*STEP_ROLES, *ANSWER_ROLES)
    found = issues(df, F.concat_ws("/", EX, "x", "y"), [(filled, "not_given", role), (F.col("fine_label").isNull() & ~filled, "unknown_label", c)])
    return nodes, found


def derived_exercise(tokens: DataFrame) -> DataFrame:
    """Expected cells from solution tokens (exercise_id, x, y, c, tags, type).

    The bar row is the lowest row of '_' cells. Tokens tagged AUTOSHOW are given; REPLACE cells are borrows, OVERFLOW cells carries;
    digits below the bar are answers on the lowest row and partial products above it; separators (',' and ' ') go.
    """
    w = W.partitionBy(EX)
    bar = F.min(F.when(F.col("c") == "_", F.col("y"))).over(w)
    df = tokens.where(~F.col("c").isin(",", " ")).withColumn("bar_y", bar)
    below = (F.col("c") != "_") & (F.col("y") < F.col("bar_y"))
    df = df.withColumn("answer_y", F.min(F.when(below, F.col("y"))).over(w)).withColumn("given", F.array_contains("tags", "AUTOSHOW"))
    role = (
        F.when(F.col("type") == "REPLACE", "borrow").when(F.col("type") == "OVERFLOW", "carry").when(F.col("c") == "_", "bar")
        .when(F.col("c").isin("+", "-", "×", "÷"), "operator").when(F.col("y") == F.col("answer_y"), "answer").when(below, "partial").otherwise("operand")
    )
    return df.select(EX, "x", "y", "c", role.alias("role"), "given", "answer_y")
