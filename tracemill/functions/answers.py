"""Answer extraction, normalization and matching for LaTeX-flavoured text.

The multi-step functions are lists of named steps that `run_steps` binds into one expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from . import constants as K
from .text import after_last, as_column, empty_to_null, find_all, last_line, last_match, strip, strip_chars

Step = tuple[str, Callable[[dict[str, Column]], Column]]

_ANY_CASE = "(?iu)"
_ANSWER_PHRASE = _ANY_CASE + K.with_whitespace(K.ANSWER_PHRASE)
_CONCLUSION = _ANY_CASE + K.with_whitespace(K.CONCLUSION_PHRASE)
_TRAILING_EQUALS = _ANY_CASE + K.with_whitespace(K.TRAILING_EQUALS)
# Digits of any script, as in Python's \d.
_NUMBER = K.NUMBER.replace(r"\d", r"\p{Nd}")
# Possessive loops match the same strings here and keep the JVM matcher off the stack.
_BOXED_NESTED = K.BOXED_NESTED.replace("]*", "]*+").replace(")*", ")*+")

# Spellings that Python's Fraction() and float() accept (finite values only).
_DIGITS = r"\p{Nd}+(?:_\p{Nd}+)*"
_FRACTION_LITERAL = rf"\A[-+]?{_DIGITS}{K.WHITESPACE_CLASS}*/{K.WHITESPACE_CLASS}*{_DIGITS}\z"
_FLOAT_LITERAL = rf"\A[-+]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][-+]?{_DIGITS})?\z"


def clean_answer(answer) -> Column:
    """Strip whitespace, dollar signs and leading colons, in that nesting."""
    inner = strip(strip_chars(strip(answer), "$"))
    return strip(strip_chars(strip(F.ltrim(inner, F.lit(":"))), "$"))


def extract_answer(response) -> Column:
    """Body of the last box (one nested brace level), else the last "answer is" phrase, else ''."""
    response = as_column(response)
    found = F.coalesce(last_match(response, _BOXED_NESTED, 1), last_match(response, _ANSWER_PHRASE, 1))
    return F.coalesce(clean_answer(found), F.when(response.isNotNull(), F.lit("")))


def strip_latex(text) -> Column:
    """Delete spacing and sizing commands, unwrap text boxes, write fractions with a slash."""
    raw = text = as_column(text)
    for token in K.LATEX_DELETED:
        text = F.replace(text, F.lit(token), F.lit(""))
    text = F.regexp_replace(text, K.LATEX_UNWRAPPED, "$1")
    text = F.regexp_replace(text, K.LATEX_FRACTION, "$1/$2")
    # Nothing to do, and no scan per command, without a backslash or dollar sign.
    return F.when(F.contains(raw, F.lit("\\")) | F.contains(raw, F.lit("$")), text).otherwise(raw)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9, as Python's number parsers read them."""
    plain = F.translate(text, K.OTHER_DIGITS, K.OTHER_DIGIT_VALUES)
    return F.when(text.rlike(r"[\p{Nd}&&[^0-9]]"), plain).otherwise(text)


def number_tokens(text) -> Column:
    return find_all(text, _NUMBER, 0)


# Steps -----------------------------------------------------------------------


def _missing(c: dict[str, Column], *names: str) -> Column:
    test = F.lit(True)
    for name in names:
        test = test & c[name].isNull()
    return test


FINAL_ANSWER_STEPS: list[Step] = [
    ("plain", lambda c: strip(strip_latex(c["input"]))),
    ("boxed", lambda c: last_match(c["plain"], K.BOXED_FLAT, 1)),
    (
        "marked",
        lambda c: F.when(
            _missing(c, "boxed") & F.contains(c["plain"], F.lit(K.FINAL_MARKER)),
            after_last(c["plain"], K.FINAL_MARKER),
        ),
    ),
    (
        "stated",
        lambda c: F.when(
            _missing(c, "boxed", "marked"),
            F.coalesce(last_match(c["plain"], _CONCLUSION, 1), last_match(c["plain"], _TRAILING_EQUALS, 1)),
        ),
    ),
    (
        "final",
        lambda c: F.when(
            c["plain"] != "",
            F.coalesce(
                strip(c["boxed"]),
                strip(c["marked"]),
                last_match(strip(c["stated"]), _NUMBER, 0),
                strip(c["stated"]),
                last_match(c["plain"], _NUMBER, 0),
                last_line(c["plain"]),
            ),
        ),
    ),
]


def _number_steps(source: str) -> list[Step]:
    return [
        (
            "digits",
            lambda c: strip(F.rtrim(F.replace(strip(c[source]), F.lit(","), F.lit("")), F.lit("."))),
        ),
        ("literal", lambda c: ascii_digits(F.replace(c["digits"], F.lit("_"), F.lit("")))),
        (
            "value",
            lambda c: F.when(c["digits"].rlike(_FLOAT_LITERAL), c["literal"].try_cast("double")).when(
                F.contains(c["digits"], F.lit("/")) & c["digits"].rlike(_FRACTION_LITERAL),
                F.try_divide(
                    strip(F.substring_index(c["literal"], "/", 1)).try_cast("double"),
                    strip(F.substring_index(c["literal"], "/", -1)).try_cast("double"),
                ),
            ),
        ),
        ("number", lambda c: F.when(F.abs(c["value"]) < F.lit(float("inf")), c["value"])),
    ]


# Exact decimal text of doubles --------------------------------------------------

_LIMB = 10**9
#: Bits that a limb is multiplied by at once: limb times factor stays below 2^63.
_LIMB_BITS = 29


def _times(limbs: Column, factor: Column) -> Column:
    """Limbs (base 10^9, lowest first) times a factor of at most _LIMB_BITS bits."""

    def step(state: Column, limb: Column) -> Column:
        product = limb * factor + state["carry"]
        high = F.call_function("div", product, F.lit(_LIMB))
        return F.struct(high.alias("carry"), F.concat(state["done"], F.array(product % _LIMB)).alias("done"))

    start = F.struct(F.lit(0).cast("long").alias("carry"), F.array().cast("array<bigint>").alias("done"))
    return F.aggregate(limbs, start, step, lambda s: F.when(s["carry"] > 0, F.concat(s["done"], F.array(s["carry"]))).otherwise(s["done"]))


def _power_of_two(bits: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), bits.cast("int"))


# A large whole number is mantissa x 2^bits; the mantissa has a few bits more than a double's, so that it
# is whole even where the logarithm is one off.
_WHOLE_STEPS: list[Step] = [
    ("bits", lambda c: F.greatest(F.floor(F.log2(c["input"])) - 54, F.lit(0))),
    ("mantissa", lambda c: (c["input"] / F.pow(F.lit(2.0), c["bits"])).cast("long")),
    (
        "limbs",
        lambda c: F.array(c["mantissa"] % _LIMB, F.call_function("div", c["mantissa"], F.lit(_LIMB))),
    ),
    (
        "raised",
        lambda c: F.aggregate(
            F.filter(F.sequence(F.lit(0), F.call_function("div", c["bits"], F.lit(_LIMB_BITS)).cast("int")), lambda i: i > 0),
            c["limbs"],
            lambda limbs, _: _times(limbs, F.lit(1 << _LIMB_BITS)),
        ),
    ),
    ("all", lambda c: _times(c["raised"], _power_of_two(c["bits"] % _LIMB_BITS))),
    (
        "text",
        lambda c: F.ltrim(
            F.array_join(F.transform(F.reverse(c["all"]), lambda x: F.lpad(x.cast("string"), 9, "0")), ""), F.lit("0")
        ),
    ),
]


def whole_number_text(number: Column) -> Column:
    """All digits of an integer-valued double, whatever its size."""
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    return F.when(F.abs(number) < 9.0e18, number.cast("long").cast("string")).otherwise(
        F.concat(sign, run_steps(F.abs(number), _WHOLE_STEPS, "text"))
    )


def _decimal(whole: Column) -> Column:
    return whole.cast("long").cast("decimal(19,0)")


# With f bits behind the point, x * 2^f is whole, and ten digits of x are x * 2^f * 10^p / 2^f rounded to a
# whole number, half to even: below 38 digits throughout, so decimals hold every step.
_TEN_DIGIT_STEPS: list[Step] = [
    ("places", lambda c: 9 - F.floor(F.log10(c["input"]))),
    ("bits", lambda c: 53 - F.floor(F.log2(c["input"]))),
    ("whole", lambda c: (c["input"] * F.pow(F.lit(2.0), c["bits"])).cast("long")),
    ("top", lambda c: _decimal(c["whole"]) * _decimal(F.pow(F.lit(10.0), F.greatest(c["places"], F.lit(0))))),
    (
        "bottom",
        lambda c: (
            _decimal(_power_of_two(F.least(c["bits"], F.lit(42))))
            * _decimal(_power_of_two(F.greatest(c["bits"] - 42, F.lit(0))))
        ).cast("decimal(38,0)")
        * _decimal(F.pow(F.lit(10.0), F.greatest(-c["places"], F.lit(0)))),
    ),
    ("floor", lambda c: F.call_function("div", c["top"], c["bottom"])),
    ("twice", lambda c: (c["top"] - _decimal(c["floor"]) * c["bottom"]) * 2),
    (
        "digits",
        lambda c: c["floor"]
        + F.when(
            (c["twice"] > c["bottom"]) | ((c["twice"] == c["bottom"]) & (c["floor"] % 2 == 1)), F.lit(1)
        ).otherwise(F.lit(0)),
    ),
    ("shown", lambda c: c["digits"].cast("string")),
    ("text", lambda c: F.lpad(c["shown"], F.greatest(c["places"] + 1, F.length(c["shown"])).cast("int"), F.lit("0"))),
    ("exponent", lambda c: F.length(c["shown"]) - 1 - c["places"]),
    (
        "plain",
        lambda c: F.concat(
            c["text"].substr(F.lit(1), (F.length(c["text"]) - c["places"]).cast("int")),
            F.lit("."),
            c["text"].substr((F.length(c["text"]) - c["places"] + 1).cast("int"), F.lit(30)),
        ),
    ),
    (
        "scientific",
        lambda c: F.concat(
            _without_zeros(
                F.concat(F.substring(c["shown"], 1, 1), F.lit("."), F.substring(c["shown"], 2, 20))
            ),
            F.lit("e"),
            F.when(c["exponent"] < 0, F.lit("-")).otherwise(F.lit("+")),
            F.lpad(F.abs(c["exponent"]).cast("string"), 2, "0"),
        ),
    ),
    (
        "printed",
        lambda c: F.when(c["exponent"].between(-4, 9), _without_zeros(c["plain"])).otherwise(c["scientific"]),
    ),
]


def _without_zeros(text: Column) -> Column:
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def ten_digit_text(number: Column) -> Column:
    """printf's %.10g: ten significant digits of the exact value, ties to even, no trailing zeros, exponent when
    very small or large. Outside 1e-9 to 1e16, where numbers count as whole, ties go by the shortest digits."""
    size = F.abs(number)
    sign = F.when(number < 0, F.lit("-")).otherwise(F.lit(""))
    exact = F.concat(sign, run_steps(size, _TEN_DIGIT_STEPS, "printed"))
    return F.when(size.between(1.0e-9, 1.0e16), exact).otherwise(_ten_shortest_digits(number))


def _ten_shortest_digits(number: Column) -> Column:
    scientific = F.format_string("%.9e", number)
    mantissa = F.substring_index(scientific, "e", 1)
    exponent = F.substring_index(scientific, "e", -1)
    plain = scientific.try_cast("decimal(38,20)").cast("string")
    return F.when(exponent.try_cast("int").between(-4, 9), _without_zeros(plain)).otherwise(
        F.concat(_without_zeros(mantissa), F.lit("e"), exponent)
    )


# Of a final answer.
_FORM_STEPS: list[Step] = [
    ("bare", lambda c: strip(strip_latex(c["input"]))),
    # Without capitals and letters beyond ASCII there is nothing to lower; the check is the cheaper scan.
    (
        "tidy",
        lambda c: strip_chars(
            F.regexp_replace(
                F.replace(
                    F.when(c["bare"].rlike(r"[^\x00-@\[-\x7f]"), F.lower(c["bare"])).otherwise(c["bare"]), F.lit(","), F.lit("")
                ),
                K.WHITESPACE_CLASS + "+",
                " ",
            ),
            K.ANSWER_EDGE_CHARS,
        ),
    ),
    *_number_steps("tidy"),
    (
        "normal",
        lambda c: F.when(
            F.abs(c["number"] - F.rint(c["number"])) < K.INTEGER_TOLERANCE,
            whole_number_text(F.rint(c["number"])),
        )
        .when(c["number"].isNotNull(), ten_digit_text(c["number"]))
        .otherwise(c["tidy"]),
    ),
]


def _form(c: dict[str, Column]) -> Column:
    """The normalized text and its value: only numbers print as numbers, rounded as printed."""
    number = F.when(
        F.abs(c["number"] - F.rint(c["number"])) < K.INTEGER_TOLERANCE, F.rint(c["number"])
    ).when(c["number"].isNotNull(), c["normal"].try_cast("double"))
    return F.struct(c["normal"].alias("normal"), number.alias("number"))


# Whole numbers that a double holds exactly and prints as they stand: their own final answer and normal form.
_PLAIN_INTEGER = r"\A(?:0|-?[1-9][0-9]{0,14})\z"


def _unless_plain(text: Column, form: Column) -> Column:
    own = F.struct(text.alias("normal"), text.try_cast("double").alias("number"))
    return F.when(text.rlike(_PLAIN_INTEGER), own).otherwise(form)


NUMBER_STEPS = _number_steps("input")


def run_steps(
    source, steps: list[Step], output: str = "", then: Callable[[dict[str, Column]], Column] | None = None
) -> Column:
    """The value of a step, or of an expression over the last step's and all before it, as one expression.

    Each intermediate is bound once by a lambda over a one-element array. Chained projections would
    look simpler, but a filter on the result is pushed through them by substitution, which doubles
    the expression at every step.
    """

    def bind(index: int, bound: dict[str, Column]) -> Column:
        if output in bound:
            return bound[output]
        if then and index == len(steps):
            return then(bound)
        name, build = steps[index]
        bound_once = F.transform(F.array(build(bound)), lambda v: bind(index + 1, {**bound, name: v}))
        return F.element_at(bound_once, 1)

    return bind(0, {"input": as_column(source)})


# Column forms ----------------------------------------------------------------


def extract_final_answer(text) -> Column:
    return run_steps(text, FINAL_ANSWER_STEPS, "final")


def to_number(value) -> Column:
    return run_steps(value, NUMBER_STEPS, "number")


def normalize_answer(answer) -> Column:
    return normal_form(answer)["normal"]


def normal_form(answer) -> Column:
    """struct<normal, number>: the normalized answer and its numeric value."""
    form = run_steps(
        answer,
        FINAL_ANSWER_STEPS,
        then=lambda c: _unless_plain(c["final"], run_steps(c["final"], _FORM_STEPS, then=_form)),
    )
    return form.cast("struct<normal:string,number:double>")


def gold_forms(targets) -> Column:
    """The normal forms of the non-null targets, computed once per example."""
    present = F.filter(as_column(targets), lambda t: t.isNotNull())
    return F.filter(F.transform(present, lambda t: _unless_plain(t, normal_form(t))), lambda f: f["normal"].isNotNull())


def matches_gold(form, gold, atol: float = K.ANSWER_TOLERANCE) -> Column:
    """True when the normal form of a prediction equals any gold form, as text or within `atol`."""
    hit = lambda p: F.exists(
        as_column(gold),
        lambda g: (g["normal"] == p["normal"]) | F.coalesce(F.abs(g["number"] - p["number"]) <= atol, F.lit(False)),
    )
    return F.coalesce(F.element_at(F.transform(F.array(as_column(form)), hit), 1), F.lit(False))


def answers_match(prediction, targets, atol: float = K.ANSWER_TOLERANCE) -> Column:
    """The whole comparison; a bare string column may be passed as F.array(col)."""
    return matches_gold(normal_form(prediction), gold_forms(targets), atol)


def target_array(raw) -> Column:
    """Targets read as a variant, where a record holds either one value or a JSON list of them. A text that
    looks like a list stays one target; an empty text or JSON null is no target."""
    raw = as_column(raw)
    several = F.variant_get(raw, "$", "array<string>")
    single = empty_to_null(F.variant_get(raw, "$", "string"))
    return F.when(F.schema_of_variant(raw).startswith("ARRAY"), several).when(single.isNotNull(), F.array(single))
