"""Column expressions: cleaning, ratios, odds, decisions. None of them needs Python at run time."""

from __future__ import annotations

from functools import reduce

import math

from pyspark.sql import Column, DataFrame, functions as F

# Spellings of a missing string, names that are no one yet, and results by label.
NULL_SPELLINGS = ("nan", "null", "unknown", "Unknown", "N/A")
NO_ONE = ("tba", "tbd")
NO_IDENTITY = ("", "nan", "<na>", "none")
RESULTS = {"w": 1.0, "win": 1.0, "true": 1.0, "1": 1.0, "l": 0.0, "loss": 0.0, "lose": 0.0, "false": 0.0, "0": 0.0}


def clean_id(c: str) -> Column:
    """Trimmed; spellings of null become null."""
    x = F.trim(F.col(c).cast("string"))
    return F.when(~x.isin(*NULL_SPELLINGS), x)


def minutes(c: str) -> Column:
    return F.col(c).cast("string").try_cast("double") / 60


def identity(id_: str, name: str) -> Column:
    """The id, or else the name, before any cast could spell out a null; null where neither says who it is."""
    x = F.coalesce(F.col(id_).cast("string"), F.col(name).cast("string"))
    return F.when(~F.lower(F.trim(x)).isin(*NO_IDENTITY), x)


def is_unknown(name: str, kind: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit(""))) == f"unknown {kind}"


def normal_result(c: str) -> Column:
    """Numbers pass, labels are looked up without case, anything else is null."""
    x = F.lower(F.trim(F.col(c).cast("string")))
    table = F.create_map(*(F.lit(y) for kv in RESULTS.items() for y in kv))
    return F.coalesce(F.try_element_at(table, x), x.try_cast("double"))


def clean_text(c: str) -> Column:
    """White space collapsed; placeholder names become empty."""
    x = F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " "))
    return F.when(F.lower(x).isin(*NO_ONE), "").otherwise(x)


def safe_ratio(num: Column, den: Column) -> Column:
    """Over the denominator's absolute value; null where it is 0."""
    return num / F.nullif(F.abs(den), F.lit(0))


def kda(kills: Column, deaths: Column, assists: Column) -> Column:
    return F.when(deaths == 0, kills + assists).otherwise((kills + assists) / F.nullif(deaths, F.lit(0)))


def row_sum(*columns: Column) -> Column:
    """Nulls count as 0."""
    return reduce(lambda a, b: a + b, (F.coalesce(c, F.lit(0.0)) for c in columns))


def row_mean(*columns: Column) -> Column:
    """Of those that aren't null; null if none is."""
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))
    return row_sum(*columns) / F.nullif(n, F.lit(0))


def row_std(*columns: Column) -> Column:
    """Sample deviation of those that aren't null; 0 for fewer than two."""
    n = reduce(lambda a, b: a + b, (c.isNotNull().cast("int") for c in columns))
    mean = row_mean(*columns)
    squares = row_sum(*((c - mean) * (c - mean) for c in columns))
    return F.when(n > 1, F.sqrt(squares / F.nullif(n - 1, F.lit(0)))).otherwise(F.lit(0.0))


def one_hot(c: str, levels: list[str]) -> dict[str, Column]:
    return {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in levels}


def growth(names: list[tuple[str, str]], prefix: str = "growth_") -> dict[str, Column]:
    """Later minus earlier for each pair of adjacent checkpoints."""
    return {f"{prefix}{a}_{b}": F.col(b) - F.col(a) for a, b in names}


def lead_flags(lead: Column, won: Column) -> dict[str, Column]:
    """Ahead or behind, won or lost; a null is in none of the four."""
    flag = lambda a, b: F.coalesce((a & b).cast("int"), F.lit(0))
    return {"ahead_won": flag(lead > 0, won == 1), "ahead_lost": flag(lead > 0, won == 0), "behind_won": flag(lead < 0, won == 1), "behind_lost": flag(lead < 0, won == 0)}


def best_of(df: DataFrame, candidates: list[str]) -> Column:
    """The digits of the first of these columns that the table has."""
    c = next((c for c in candidates if c in df.columns), None)
    return F.regexp_extract(F.coalesce(F.col(c).cast("string"), F.lit("")), r"(\d+)", 1).try_cast("int") if c else F.lit(None).cast("int")


def logit(p: Column, eps: float = 1e-12) -> Column:
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return F.ln(q / (1 - q))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def implied(odds: Column) -> Column:
    return 1 / F.nullif(odds, F.lit(0.0))


def edge(p: Column, odds: Column) -> Column:
    return p * odds - 1


def kelly(p: Column, odds: Column, fraction: float = 1.0) -> Column:
    """Share of the bankroll; 0 without an edge, at odds of 1 or less, and where a value is missing."""
    return F.when(odds > 1, F.greatest(F.lit(0.0), fraction * ((odds - 1) * p - (1 - p)) / F.nullif(odds - 1, F.lit(0.0)))).otherwise(F.lit(0.0))


def round_down_cents(x: Column) -> Column:
    return F.floor(x * 100) / 100


def settled_pnl(result: Column, stake: Column, odds: Column) -> Column:
    return F.when(result == "win", stake * (odds - 1)).when(result == "loss", -stake).when(result.isin("push", "void"), F.lit(0.0))


def line_result(total: Column, line: Column, over: Column) -> Column:
    return F.when(total == line, "push").when((total > line) == over, "win").otherwise("loss")


# Numerators and denominators of Cody's rational approximations (1969) of erf below 0.46875 and of erfc up to 4 and beyond, highest power first.
ERF = ((1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3), (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3))
ERFC = (
    (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3),
    (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3),
)
ERFC_FAR = ((1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4), (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3))


def _ratio(x: Column, both: tuple[tuple[float, ...], tuple[float, ...]]) -> Column:
    top, bottom = (reduce(lambda acc, k: acc * x + k, c[1:], F.lit(c[0])) for c in both)
    return top / bottom


def normal_cdf(z: Column) -> Column:
    """The standard normal distribution, by rational approximations of its error function; |z| is cut at 7.5, and the tail has its own digits.

    `z` is worked out once for each row, however often the approximations read it.
    """

    def cdf(x: Column) -> Column:
        y = F.abs(x)
        far = (1 / math.pi**0.5 - _ratio(1 / (x * x), ERFC_FAR) / (x * x)) / y
        tail = 0.5 * F.exp(-x * x) * F.when(y <= 4, _ratio(y, ERFC)).otherwise(far)
        return F.when(y <= 0.46875, 0.5 + 0.5 * x * _ratio(x * x, ERF)).when(x < 0, tail).otherwise(1 - tail)

    cut = F.greatest(F.least(z, F.lit(7.5)), F.lit(-7.5)) / 2**0.5
    return F.transform(F.array(F.when(z.isNotNull(), cut)), cdf)[0]


def normal_over(mean: Column, sigma: Column, line: Column) -> Column:
    """P(total > line) of a normal total."""
    return normal_cdf((mean - line) / F.nullif(sigma, F.lit(0.0)))
