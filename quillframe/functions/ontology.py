"""Label vocabulary: fine labels such as main_5 or op_plus, their roles, coarse classes and glyphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the vocabulary.
ROLES = ("main", "carry", "borrow")
OPERATORS = ("plus", "minus", "times", "divide")
COARSE = ("digit_main", "digit_carry", "digit_borrow", "operator", "result_bar", "divide_bracket")
FINE_LABELS = tuple(f"{r}_{d}" for r in ROLES for d in range(10)) + tuple(f"op_{o}" for o in OPERATORS) + ("result_bar", "div_bracket")
COLLAPSED_LABELS = tuple(str(d) for d in range(10)) + tuple(f"op_{o}" for o in OPERATORS) + ("result_bar", "div_bracket")
GLYPHS = {"op_plus": "+", "op_minus": "−", "op_times": "×", "op_divide": "÷", "result_bar": "─" * 5, "div_bracket": ""}
KINDS = {"add": "addition", "subtract": "subtraction", "multiply": "multiplication", "divide": "division", "bare_digits": "bare_digits"}
KIND_NAMES = {
    "addition": "Addition", "subtraction": "Subtraction", "multiplication": "Multiplication", "division": "Division",
    "bare_digits": "Bare digits (no equation)", "unknown": "Unknown (out of distribution)",
}
TRAINED_KINDS = ("addition", "subtraction", "multiplication", "division")


def _digit_of(label: Column) -> Column:
    return F.regexp_extract(label, "^(?:main|carry|borrow)_([0-9])$", 1)


def role(label: Column) -> Column:
    """main, carry, borrow, operator, structure or unknown. div_bracket is unknown; a bare digit is main."""
    return (
        F.when(label == "result_bar", "structure")
        .when(label.rlike("^[0-9]$"), "main")
        .when(label.isin(*OPERATORS) | label.startswith("op_"), "operator")
        .when(_digit_of(label) != "", F.split_part(label, F.lit("_"), F.lit(1)))
        .otherwise("unknown")
    )


def detail(label: Column) -> Column:
    """The digit, operator or structure that a label names; null where it is unknown."""
    return (
        F.when((label == "result_bar") | label.rlike("^[0-9]$") | label.isin(*OPERATORS), label)
        .when(label.startswith("op_"), F.substr(label, F.lit(4)))
        .when(_digit_of(label) != "", _digit_of(label))
    )


def coarse(label: Column) -> Column:
    """Coarse class; null where the label has none (div_bracket among them)."""
    r = role(label)
    return F.when(r.isin(*ROLES), F.concat(F.lit("digit_"), r)).when(r == "operator", r).when(label == "result_bar", label)


def coarse_or_main(label: Column) -> Column:
    """Coarse class, digit_main where there is none."""
    return F.coalesce(coarse(label), F.lit("digit_main"))


def coarse_for_export(label: Column) -> Column:
    """Coarse class with the bracket's own class."""
    return F.when(label == "div_bracket", "divide_bracket").otherwise(coarse_or_main(label))


def collapsed(label: Column) -> Column:
    """The role-free label: digits without their role; null where unknown."""
    r = role(label)
    return (
        F.when(r.isin(*ROLES), detail(label))
        .when(r == "operator", F.concat(F.lit("op_"), detail(label)))
        .when((r == "structure") | (label == "div_bracket"), label)
    )


def expanded(label: Column, coarse_class: Column) -> Column:
    """The fine label of a role-free label and a coarse class."""
    r = F.when(coarse_class == "digit_carry", "carry").when(coarse_class == "digit_borrow", "borrow").otherwise("main")
    return F.when(label.rlike("^[0-9]$"), F.concat(r, F.lit("_"), label)).otherwise(label)


def glyph_key(label: Column) -> Column:
    """Name of the glyph pool folder; null where unknown."""
    return detail(label)


def display_glyph(label: Column) -> Column:
    """What a panel shows: the digit of a main label, an operator's sign, else the label itself."""
    out = F.when(label.rlike("^main_[0-9]$"), F.substr(label, F.lit(6)))
    for name, sign in GLYPHS.items():
        out = out.when(label == name, sign)
    return out.otherwise(label)


def cell_text(label: Column) -> Column:
    """What a grid cell holds: every digit bare, bars and brackets empty."""
    return F.when(label.isin("result_bar", "div_bracket"), "").when(role(label).isin(*ROLES), detail(label)).otherwise(display_glyph(label))


def long_kind(kind: Column) -> Column:
    """add -> addition and so on; null for kinds without a long name."""
    return _mapped(kind, KINDS)


def kind_class(kind: Column) -> Column:
    """Class number of a kind in training; masked kinds (bare digits) are -1, unknown strings are class 0."""
    name = F.coalesce(long_kind(kind), kind)
    out = F.when(name == "bare_digits", -1)
    for i, k in enumerate(TRAINED_KINDS):
        out = out.when(name == k, i)
    return out.otherwise(0)


def kind_title(kind: Column) -> Column:
    """Display name of a short or long kind; other names are capitalised with blanks for underscores."""
    name = F.coalesce(long_kind(kind), kind)
    words = F.lower(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.coalesce(_mapped(name, KIND_NAMES), F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2))))


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def table(spark: SparkSession) -> DataFrame:
    """The vocabulary as a dimension table (36 rows)."""
    labels = spark.createDataFrame([(i, x) for i, x in enumerate(FINE_LABELS)], "fine_id int, fine string")
    f = F.col("fine")
    return labels.select("fine_id", "fine", role(f).alias("role"), detail(f).alias("detail"), coarse_for_export(f).alias("coarse"), collapsed(f).alias("collapsed"), glyph_key(f).alias("glyph_key"), display_glyph(f).alias("glyph"))
