"""Features as known before a time. Every function adds columns and takes one shuffle by the entity's id.

Prior means and exponential means count the rows of an entity first: one with more than `slices.MOST` is scanned in slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.keys import EntitySpec, micros
from antecede.operators.slices import SLICE, carried, sliced

DAY = 86_400_000_000
#: Observations after which an exponential weight starts anew, so that none overflows.
BLOCK = 4096


def days_since_previous(df: DataFrame, e: EntitySpec, out: str = "days_since_previous") -> DataFrame:
    """Whole days since the entity's previous distinct time; null at its first."""
    before = F.max(micros(e.time)).over(e.earlier_times())
    return df.withColumn(out, F.floor((micros(e.time) - before) / DAY).cast("long"))


def break_flags(df: DataFrame, e: EntitySpec, season: str, days: int = 45) -> DataFrame:
    """after_break: over `days` since the previous time, 0 if there is none; first_of_season: the entity's first row in it."""
    out = days_since_previous(df, e, "__days")
    flags = {"after_break": F.coalesce((F.col("__days") > days).cast("int"), F.lit(0)), "first_of_season": (F.row_number().over(e.all_rows(season)) == 1).cast("int")}
    return out.withColumns(flags).drop("__days")


def prior_mean(df: DataFrame, e: EntitySpec, values: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over strictly earlier times; values: output name to column. Nulls don't count."""
    return prior_means(df, e, {out: F.col(c) for out, c in values.items()}, by)


def prior_means(df: DataFrame, e: EntitySpec, values: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """As `prior_mean`, of expressions."""
    cut = sliced(df, (*e.id, *by), e.time)
    if cut is None:
        return df.withColumns({out: F.avg(c).over(e.earlier_times(*by)) for out, c in values.items()})
    names = {out: f"__{k}" for k, out in enumerate(values)}
    cut = cut.withColumns({f"{names[out]}v": c.cast("double") for out, c in values.items()})
    totals = {f"{n}{a}": f(f"{n}v") for n in names.values() for a, f in (("s", F.sum), ("n", F.count))}
    rows, inside, made = carried(cut, (*e.id, *by), totals, {n: F.sum(n) for n in totals}), e.earlier_times(*by, SLICE), {}
    for out, n in names.items():
        total, count = (F.coalesce(f(f"{n}v").over(inside), F.lit(0)) + F.coalesce(f"{n}{a}", F.lit(0)) for a, f in (("s", F.sum), ("n", F.count)))
        made[out] = F.when(count > 0, total / F.nullif(count, F.lit(0)))
    return rows.withColumns(made).drop(*totals, *(f"{n}v" for n in names.values()), SLICE)


def prior_mean_by_row(df: DataFrame, e: EntitySpec, value: str, out: str) -> DataFrame:
    """Mean over earlier rows, of the same time too; here rows with a null count in the denominator."""
    before = e.all_rows().rowsBetween(Window.unboundedPreceding, -1)
    n = F.count(F.lit(1)).over(before)
    return df.withColumn(out, F.when(n > 0, F.coalesce(F.sum(value).over(before), F.lit(0.0)) / F.nullif(n, F.lit(0))))


def recent_mean(df: DataFrame, e: EntitySpec, value: str, rows: int, out: str) -> DataFrame:
    """Mean of the last `rows` rows before this one."""
    return df.withColumn(out, F.avg(value).over(e.all_rows().rowsBetween(-rows, -1)))


def conditional_prior_means(df: DataFrame, e: EntitySpec, values: list[str], conditions: dict[str, str], groups: list[str]) -> DataFrame:
    """<value>_<condition>_<group>: mean over strictly earlier times where the condition holds, within each group."""
    made = lambda g: {f"{v}_{name}_{g}": F.when(F.expr(test), F.col(v)) for v in values for name, test in conditions.items()}
    for g in groups:
        df = prior_means(df, e, made(g), (g,))
    return df


def head_to_head(df: DataFrame, e: EntitySpec, opponent: str, won: str, least: int = 2) -> DataFrame:
    """h2h_games, h2h_wins and h2h_rate against this opponent before; the rate is null under `least` games."""
    before = e.earlier_times(opponent)
    games, wins = F.count(won).over(before), F.coalesce(F.sum(won).over(before), F.lit(0))
    return df.withColumns({"h2h_games": games, "h2h_wins": wins, "h2h_rate": F.when(games >= least, wins / F.nullif(games, F.lit(0)))})


def ewm(df: DataFrame, e: EntitySpec, value: str, halflife: float = 9, by: tuple[str, ...] = (), name: str | None = None, prior: float | None = None) -> DataFrame:
    """ema_<name>_after: the mean with weights halving every `halflife` observations, nulls ignored and carried.

    ema_<name>_before: the one of the previous row, frozen to the first row of a day; `prior` fills it.
    Weights grow inside blocks of observations. Older blocks than the one before are below double precision.
    """
    name, key = name or value, (*e.id, *by)
    cut = sliced(df, key, e.time)
    part = key if cut is None else (*key, SLICE)
    rows = Window.partitionBy(*part).orderBy(e.time, *e.order)
    far = 2.0 ** (-BLOCK / halflife)
    n = (df if cut is None else cut).withColumn("__n", F.count(value).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    n = n.withColumn("__b", F.floor(F.greatest(F.col("__n") - 1, F.lit(0)) / BLOCK).cast("long"))
    weight = F.when(F.col(value).isNotNull(), F.pow(F.lit(2.0), (F.col("__n") - F.col("__b") * BLOCK) / halflife))
    run = Window.partitionBy(*part, "__b").orderBy(e.time, *e.order).rowsBetween(Window.unboundedPreceding, 0)
    n = n.withColumns({"__x": F.coalesce(F.sum(F.col(value) * weight).over(run), F.lit(0.0)), "__w": F.coalesce(F.sum(weight).over(run), F.lit(0.0))})
    last = F.max_by(F.struct("__x", "__w"), F.col("__n")).over(Window.partitionBy(*part).orderBy("__b").rangeBetween(-1, -1))
    n = n.withColumn("__last", last)
    total = lambda c: F.col(f"__{c}") + F.coalesce(F.col(f"__last.__{c}") * far, F.lit(0.0))
    x, w, before = total("x"), total("w"), F.lag(f"ema_{name}_after").over(rows)
    if cut is not None:
        # Inside a slice the pair is of weights that grow from its first block on; as weights that fall from its last observation, pairs of slices add up.
        level = F.pow(F.lit(2.0), (F.col("__b") * BLOCK - F.col("__n")) / halflife)
        order = F.struct(e.time, *e.order)
        n = n.withColumns({"__tx": x * level, "__tw": w * level})
        ends = F.collect_list(F.struct("__en", "__ex", "__ew"))
        sums = {"__en": F.max("__n"), "__ex": F.max_by("__tx", order), "__ew": F.max_by("__tw", order)}
        n = carried(n, key, sums, {"__ends": ends}).withColumn("__carry", carry_of(halflife)).drop("__ends")
        fade = F.pow(F.lit(2.0), -F.col("__n") / halflife)
        x, w = (F.col(f"__t{c}") + F.coalesce(F.col(f"__carry.{c}"), F.lit(0.0)) * fade for c in "xw")
        first = F.when(F.col("__carry.w") > 0, F.col("__carry.x") / F.nullif(F.col("__carry.w"), F.lit(0.0)))
        before = F.when(F.row_number().over(rows) == 1, first).otherwise(before)
    n = n.withColumn(f"ema_{name}_after", F.when(w > 0, x / F.nullif(w, F.lit(0.0))))
    n = n.withColumn(f"ema_{name}_before", before)
    day = Window.partitionBy(*part, e.day()).orderBy(e.time, *e.order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frozen = F.first(f"ema_{name}_before").over(day)
    return n.withColumn(f"ema_{name}_before", frozen if prior is None else F.coalesce(frozen, F.lit(prior))).drop("__n", "__b", "__x", "__w", "__last", "__tx", "__tw", "__carry", SLICE)


def carry_of(halflife: float) -> Column:
    """The pair (x, w) at the end of slices, from their own pairs and numbers of observations in order (`__ends`)."""
    fade = lambda s: F.pow(F.lit(2.0), -s["__en"] / halflife)
    step = lambda a, s: F.struct((a["x"] * fade(s) + s["__ex"]).alias("x"), (a["w"] * fade(s) + s["__ew"]).alias("w"))
    return F.aggregate("__ends", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("w")), step)


def effective_games(df: DataFrame, e: EntitySpec, by: tuple[str, ...], halflife: float = 9, out: str = "effective_games_before") -> DataFrame:
    """Sum of the weights of the earlier rows, (1 - w^n) / (1 - w), frozen to the first row of a day; 0 if there are none."""
    w = 2.0 ** (-1 / halflife)
    n = F.row_number().over(e.all_rows(*by)) - 1
    first = F.min("__n").over(Window.partitionBy(*e.id, *by, e.day()))
    return df.withColumn("__n", n).withColumn(out, (1 - F.pow(F.lit(w), first)) / (1 - w)).drop("__n")


def side_ewm(df: DataFrame, e: EntitySpec, side: str, value: str, sides: tuple[str, str], halflife: float = 9, prior: float = 0.5) -> DataFrame:
    """ema_<side>_before for both sides on every row: the last value known of that side, carried, then frozen to the day, then filled."""
    out = ewm(df, e, value, halflife, (side,), "__side")
    of = {s: F.when(F.col(side) == s, F.col("ema___side_after")) for s in sides}
    cut = sliced(out, e.id, e.time)
    before = e.all_rows(*([] if cut is None else [SLICE])).rowsBetween(Window.unboundedPreceding, -1)
    known = {f"__{s}": F.last(c, True).over(before) for s, c in of.items()}
    if cut is not None:
        ends = {f"__c{s}": F.max_by(c, F.when(c.isNotNull(), F.struct(e.time, *e.order))) for s, c in of.items()}
        out = carried(cut, e.id, ends, {n: F.last(n, True) for n in ends})
        known = {f"__{s}": F.coalesce(known[f"__{s}"], F.col(f"__c{s}")) for s in sides}
    out = out.withColumns(known)
    return out.withColumns({f"ema_{s}_before": F.coalesce(F.first(f"__{s}").over(e.whole_day()), F.lit(prior)) for s in sides}).drop("ema___side_after", "ema___side_before", *(f"__{x}{s}" for s in sides for x in ("", "c")), SLICE)


def freeze_day(df: DataFrame, e: EntitySpec, columns: list[str]) -> DataFrame:
    """Every row of an entity's day takes the day's first value, null included."""
    return df.withColumns({c: F.first(c).over(e.whole_day()) for c in columns})


def likelihood(mine: Column, theirs: Column) -> Column:
    return F.greatest(F.least(mine / (mine + theirs + 1e-8), F.lit(1.0)), F.lit(0.0))


def roster_continuity(df: DataFrame, group: str, time: str, member: str, size: int = 5) -> DataFrame:
    """group, time, continuity (share kept since the previous time; null unless both have `size`), uncertainty."""
    sets = df.groupBy(group, time).agg(F.collect_set(member).alias("now"))
    before = F.lag("now").over(Window.partitionBy(group).orderBy(time))
    kept = F.when((F.size("now") == size) & (F.size(before) == size), F.size(F.array_intersect(F.col("now"), before)) / F.lit(float(size)))
    return sets.withColumn("continuity", kept).select(group, time, "continuity", F.coalesce(1 - F.col("continuity"), F.lit(1.0)).alias("uncertainty"))


def pick_row(df: DataFrame, e: EntitySpec, latest: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The entity's latest or earliest row."""
    order = [c.desc() if latest else c.asc() for c in map(F.col, (e.time, *e.order))]
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*e.id, *by).orderBy(*order))).where("__k = 1").drop("__k")


def forward_fill(df: DataFrame, time: str, order: tuple[str, ...], column: str) -> DataFrame:
    """The last value known in global time order, in two levels: inside each day, then over one row for each day."""
    day = F.to_date(time)
    inside = F.last(column, True).over(Window.partitionBy(day).orderBy(time, *order).rowsBetween(Window.unboundedPreceding, 0))
    last = df.where(F.col(column).isNotNull()).groupBy(day.alias("__day")).agg(F.max_by(column, F.struct(time, *order)).alias("__last"))
    days = df.select(day.alias("__day")).distinct().join(last, "__day", "left")
    carried = days.withColumn("__before", F.last("__last", True).over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))).select("__day", "__before")
    return df.withColumns({"__day": day, "__in": inside}).join(carried, "__day", "left").withColumn(column, F.coalesce("__in", "__before")).drop("__day", "__in", "__before")


def cumulative(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], value: str, out: str, how: str = "sum") -> DataFrame:
    """Running sum or mean of each group in order, in two levels: inside each day of order[0] (a time), then over one row for each day."""
    day, day_key = F.to_date(order[0]), [*by, "__day"]
    x = df.withColumn("__day", day)
    days = x.groupBy(*day_key).agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
    earlier = Window.partitionBy(*by).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.select(*day_key, F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__s"), F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__n"))
    run = Window.partitionBy(*day_key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({"__in": F.coalesce(F.sum(value).over(run), F.lit(0)), "__k": F.count(value).over(run)})
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"b.{c}")) for c in day_key]
    both = x.alias("x").join(before.alias("b"), same)
    total, n = F.col("__s") + F.col("__in"), F.col("__n") + F.col("__k")
    return both.select("x.*", (F.when(n > 0, total) if how == "sum" else total / F.nullif(n, F.lit(0))).alias(out)).drop("__day", "__in", "__k")


def drawdown(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], pnl: str, start: float, net_ties: bool = False) -> DataFrame:
    """max_drawdown and max_drawdown_share from equity that begins at `start`; ties in order[0] can be netted first."""
    if net_ties:
        df, order = df.groupBy(*by, order[0]).agg(F.sum(pnl).alias(pnl)), order[:1]
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    equity = df.withColumn("__e", F.sum(pnl).over(run) + start)
    peak = equity.withColumn("__p", F.greatest(F.max("__e").over(run), F.lit(start)))
    return peak.groupBy(*by).agg(F.max(F.col("__p") - F.col("__e")).alias("max_drawdown"), F.max((F.col("__p") - F.col("__e")) / F.nullif(F.col("__p"), F.lit(0.0))).alias("max_drawdown_share"))
