"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latin letters and their ASCII forms, by position.
_ACCENTED = ("àáâãäåāăąÀÁÂÃÄÅĀĂĄçćĉċčÇĆĈĊČďđĎĐèéêëēĕėęěÈÉÊËĒĔĖĘĚĝğġģĜĞĠĢĥħĤĦìíîïĩīĭįıÌÍÎÏĨĪĬĮİ"
             "ĵĴķĶĺļľłĹĻĽŁñńņňÑŃŅŇòóôõöøōŏőÒÓÔÕÖØŌŎŐŕŗřŔŖŘśŝşšŚŜŞŠţťŧŢŤŦùúûüũūŭůűųÙÚÛÜŨŪŬŮŰŲ"
             "ŵŴýÿŷÝŸŶźżžŹŻŽ")
_PLAIN = ("aaaaaaaaaAAAAAAAAAcccccCCCCCddDDeeeeeeeeeEEEEEEEEEggggGGGGhhHHiiiiiiiiiIIIIIIIII"
          "jJkKllllLLLLnnnnNNNNoooooooooOOOOOOOOOrrrRRRssssSSSStttTTTuuuuuuuuuuUUUUUUUUUU"
          "wWyyyYYYzzzZZZ")
# Greek and Cyrillic letters and their ASCII forms, by position.
_OTHER_SCRIPTS = "αβγδεζηικλμνξοπρσςτυωάέήίόύώабвгдезийклмнопрстуфыэіў"
_OTHER_PLAIN = "abgdezeiklmnxoprsstuoaeeiouoabvgdeziiklmnoprstufyeiu"
# Letters that become several ASCII letters.
_EXPANDED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
# The same of Greek and Cyrillic.
_OTHER_EXPANDED = {"θ": "th", "φ": "ph", "χ": "kh", "ψ": "ps", "ё": "io", "ж": "zh", "х": "kh",
                   "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ю": "iu", "я": "ia",
                   "є": "ie", "ї": "yi"}

assert len(_ACCENTED) == len(_PLAIN)
assert len(_OTHER_SCRIPTS) == len(_OTHER_PLAIN)


def _two_cases(letters: str) -> str:
    return letters + "".join(c.upper() for c in letters)


def escape_name(name: Column) -> Column:
    """ASCII letters, digits and single underscores; other characters disappear.

    Latin, Greek and Cyrillic letters are written in ASCII first.
    """
    text = F.translate(name, _ACCENTED + _two_cases(_OTHER_SCRIPTS),
                       _PLAIN + _two_cases(_OTHER_PLAIN))
    expanded = _EXPANDED | _OTHER_EXPANDED | {
        letter.upper(): plain.capitalize() for letter, plain in _OTHER_EXPANDED.items()}
    for letter, plain in expanded.items():
        text = F.replace(text, F.lit(letter), F.lit(plain))
    text = F.regexp_replace(text, "[- ]", "_")
    text = F.regexp_replace(text, "[^a-zA-Z0-9_]", "")
    return F.regexp_replace(text, "_+", "_")


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded and never -0.0, for reports and comparisons."""
    return F.round(value, digits) + F.lit(0.0)


def round_significant(value: Column, digits: int) -> Column:
    """Round to a number of significant digits."""
    power = F.lit(digits - 1) - F.floor(F.log10(F.abs(value)))
    scale = F.pow(F.lit(10.0), power.cast("double"))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value * scale) / scale)


def no_nan(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def ratio(value: Column, by: Column) -> Column:
    """Quotient, null for a zero divisor."""
    return F.try_divide(value, by)


def weighted_mean(value: Column, w: Column) -> Column:
    """Null when the weights sum to zero."""
    return ratio(F.sum(value * w), F.sum(w))


def no_model() -> Column:
    """The error of a row whose part has no fitted model."""
    return F.raise_error(F.lit("no model was fitted for this part")).cast("double")


def kernel_weight(distance: Column, bandwidth: Column, kernel: str) -> Column:
    """Weight of a row at ``distance``; 1 when every distance is zero."""
    u = distance / bandwidth
    shape = {
        "triangular": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - u)),
        "rectangular": (u <= 1).cast("double"),
        "gaussian": F.exp(-0.5 * u * u),
    }
    if kernel not in shape:
        raise ValueError(f"unknown kernel {kernel!r}")
    return F.when(bandwidth > 0, shape[kernel]).otherwise(F.lit(1.0))


def poisson_deviance(y: Column, x: Column) -> Column:
    """Unit deviance; the logarithmic term vanishes at y = 0."""
    return 2 * (F.when(y > 0, y * F.log(ratio(y, x))).otherwise(F.lit(0.0)) - y + x)


def gamma_deviance(y: Column, x: Column) -> Column:
    return 2 * (F.log(ratio(x, y)) + ratio(y, x) - 1)


def tweedie_deviance(y: Column, x: Column, power: float) -> Column:
    if power == 0:
        return (y - x) * (y - x)
    if power == 1:
        return poisson_deviance(y, x)
    if power == 2:
        return gamma_deviance(y, x)
    a, b = 1 - power, 2 - power
    return 2 * (F.pow(F.greatest(y, F.lit(0.0)), F.lit(b)) / (a * b)
                - y * F.pow(x, F.lit(a)) / a + F.pow(x, F.lit(b)) / b)


def interval_label(value: Column, edges: list[float], right_closed: bool = False,
                   labels: list[str] | None = None) -> Column:
    """Name of the interval holding ``value``; null outside all of them."""
    def text(edge: float) -> str:
        if edge in (float("inf"), float("-inf")):
            return "infty" if edge > 0 else "-infty"
        return f"{edge:g}"

    pairs = list(zip(edges[:-1], edges[1:]))
    if labels is None:
        shape = "({},{}]" if right_closed else "[{},{})"
        labels = [shape.format(text(a), text(b)) for a, b in pairs]
    if len(labels) != len(pairs):
        raise ValueError("one label per interval is needed")

    def inside(a: float, b: float) -> Column:
        if right_closed:
            return (value > a) & (value <= b)
        return (value >= a) & (value < b)

    branches = [(inside(a, b), F.lit(label)) for (a, b), label in zip(pairs, labels)]
    first, *rest = branches
    return reduce(lambda acc, br: acc.when(*br), rest, F.when(*first))


def sorted_place(value: Column, edges: Column, most: int) -> Column:
    """Number of ``edges`` (a sorted array of at most ``most``) that are <= ``value``, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.size(edges)) & (F.get(edges, at + step - 1) <= value), at + step).otherwise(at))


def step_bin(value: Column, edges: Column) -> Column:
    """Number of ``edges`` (a short sorted array) that are <= ``value``."""
    return F.size(F.filter(edges, lambda e: e <= value))
