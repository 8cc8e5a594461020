"""Pairing, as-of and tolerance joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from antecede.operators.slices import RUNS, SLICE, carried, sliced


def pair_opponents(df: DataFrame, keys: list[str], side: str, sides: tuple[str, str], columns: list[str], prefix: str = "opp_", strict: bool = False) -> DataFrame:
    """Adds `prefix` + column of the row on the other side with the same keys; `strict` fails if one has no such row."""
    other = df.select(*keys, F.when(F.col(side) == sides[0], sides[1]).when(F.col(side) == sides[1], sides[0]).alias(side), *(F.col(c).alias(prefix + c) for c in columns))
    if strict and (bad := df.join(other, [*keys, side], "left_anti").first()):
        raise ValueError(f"no opponent for {bad.asDict()}")
    return df.join(other, [*keys, side], "inner" if strict else "left")


def with_differences(df: DataFrame, columns: list[str], prefix: str = "opp_", out: str = "diff_") -> DataFrame:
    return df.withColumns({out + c: F.col(c) - F.col(prefix + c) for c in columns})


def enemy_totals(df: DataFrame, keys: list[str], side: str, sides: tuple[str, str], columns: list[str]) -> DataFrame:
    """enemy_<column>: the other side's sum; sums are made before the join."""
    sums = df.groupBy(*keys, F.when(F.col(side) == sides[0], sides[1]).otherwise(sides[0]).alias(side)).agg(*(F.sum(c).alias(f"enemy_{c}") for c in columns))
    return df.join(sums, [*keys, side], "left")


def dimension_join(df: DataFrame, dimension: DataFrame, key: str, defaults: dict[str, object], strict: bool = False, most: int = 100_000) -> DataFrame:
    """Left join to a dimension whose size is checked before it is broadcast; unknown keys take defaults, or fail if `strict`."""
    small = dimension.limit(most + 1).count() <= most
    dimension = F.broadcast(dimension) if small else dimension
    if strict and (bad := df.where(F.col(key).isNotNull()).join(dimension, key, "left_anti").first()):
        raise ValueError(f"unknown {key}: {bad[key]}")
    return df.join(dimension, key, "left").fillna(defaults)


def running(rows: DataFrame, by: list[str], order: list[str], value: str, how: str) -> DataFrame:
    """`rows` with the last known or the largest `value` of their key so far, in order of `order` (a time first), in its place.

    A key with more rows than a task should hold is scanned in slices of days.
    """
    cut = sliced(rows, by, order[0]) if rows.schema[order[0]].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else None
    w = Window.partitionBy(*by, *([] if cut is None else [SLICE])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.last(value, True).over(w) if how == "last" else F.max(value).over(w)
    if cut is None:
        return rows.withColumn(value, inside)
    total = F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))) if how == "last" else F.max(value)
    held = carried(cut, by, {"__c": total}, {"__c": F.last("__c", True) if how == "last" else F.max("__c")})
    return held.withColumn(value, F.coalesce(inside, "__c") if how == "last" else F.greatest(inside, F.col("__c"))).drop("__c", SLICE)


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], tie: list[str] | None = None) -> DataFrame:
    """For each left row the latest right row at or before its time: one union and one window, no inequality join.

    Of right rows at one time the last by `tie` counts.
    """
    value = F.struct(*(F.col(c) for c in columns))
    a = left.select(F.struct(*left.columns).alias("__row"), *by, F.col(left_time).alias("__t"), F.lit(1).alias("__side"), *(F.lit(None).cast(right.schema[c].dataType).alias(f"__{c}") for c in tie or []), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("__v"))
    b = right.select(F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), *by, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), *(F.col(c).alias(f"__{c}") for c in tie or []), value.alias("__v"))
    found = running(a.unionByName(b), by, ["__t", "__side", *(f"__{c}" for c in tie or [])], "__v", "last").where("__side = 1")
    return found.select("__row.*", *(F.col(f"__v.{c}").alias(c) for c in columns))


def asof_state(left: DataFrame, states: DataFrame, by: list[str], as_of: str, decision: str, available: str, started: str, columns: list[str], id_: str) -> DataFrame:
    """The latest state available by the earlier of two times, whose event started before that day; null if there is none.

    A state counts from the later of its availability and the midnight after its start; so one union and one running
    maximum by entity find it, however many states an entity has. `id_` names the left row and is only carried.
    """
    made = F.struct(F.col(available).alias("__av"), F.col(started).alias("__st"), *columns)
    counts_from = F.greatest(F.col(available), (F.date_trunc("day", started) + F.expr("INTERVAL 1 DAY")).cast(states.schema[available].dataType))
    b = states.where(F.col(available).isNotNull() & F.col(started).isNotNull()).select(*by, counts_from.alias("__t"), F.lit(0).alias("__side"), made.alias("__v"))
    a = left.select(F.struct(*left.columns).alias("__row"), *by, F.least(F.col(as_of), F.col(decision)).alias("__t"), F.lit(1).alias("__side"))
    both = a.unionByName(b, allowMissingColumns=True)
    found = running(both, by, ["__t", "__side"], "__v", "max").where("__side = 1")
    # A row without a time sorts first and so finds nothing.
    return found.select("__row.*", *(F.when(F.col("__t").isNotNull(), F.col(f"__v.{c}")).alias(c) for c in columns))


def match_within(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal keys whose times are within `seconds`: an equi-join on time buckets, each right row in three of them."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000)).cast("long")
    a = left.withColumn("__k", bucket(left_time))
    b = right.withColumn("__k", F.explode(F.array(*(bucket(right_time) + d for d in (-1, 0, 1)))))
    gap = F.abs(F.unix_micros(F.col(left_time).cast("timestamp")) - F.unix_micros(F.col(right_time).cast("timestamp")))
    return a.join(b, [*keys, "__k"]).where(gap <= seconds * 1_000_000).drop("__k")


def reasons(tests: dict[str, Column]) -> Column:
    """The names of the tests that hold, in order; a test that is null doesn't hold."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in tests.items())), lambda x: x.isNotNull())


def contains_tokens(tokens: Column, title: Column) -> Column:
    """Whether all tokens are words of the title."""
    return F.size(F.array_except(tokens, F.split(F.lower(title), r"[^a-z0-9]+"))) == 0


def not_superseded(df: DataFrame, corrections: DataFrame, key: str, corrected: str) -> DataFrame:
    return df.join(corrections.select(F.col(corrected).alias(key)), key, "left_anti")


def closing_quotes(bets: DataFrame, quotes: DataFrame, on: list[str], bet: str, entered: str, start: str, observed: str, provider_time: str, lag: int, columns: list[str]) -> DataFrame:
    """For each bet the latest quote observed strictly after entry and before the start; `comparable` is false if its provider lags too far.

    The latest quote before the start is found by one union and one running maximum; it counts if it came after entry. `bet` names the row.
    """
    made = F.struct(observed, provider_time, *columns)
    b = quotes.where(F.col(observed).isNotNull()).select(*on, F.col(observed).alias("__t"), F.lit(1).alias("__side"), made.alias("__q"))
    a = bets.select(F.struct(*bets.columns).alias("__row"), *on, F.col(start).alias("__t"), F.lit(0).alias("__side"))
    found = running(a.unionByName(b, allowMissingColumns=True), on, ["__t", "__side"], "__q", "max").where("__side = 0")
    met = found.withColumn("__q", F.when(F.col("__t").isNotNull() & (F.col(f"__q.{observed}") > F.col(f"__row.{entered}")), F.col("__q")))
    fresh = (F.col(f"__q.{observed}").cast("timestamp").cast("double") - F.col(f"__q.{provider_time}").cast("timestamp").cast("double")) <= lag
    return met.select("__row.*", *(F.col(f"__q.{c}").alias(c) for c in (observed, *columns)), F.coalesce(fresh, F.lit(False)).alias("comparable"))


def resolve_chains(links: DataFrame, rounds: int = 20, write=None, owner: str | None = None) -> DataFrame:
    """id, tip, hops: follows `next` to the end by doubling; tip is null on a cycle. links: id, next (null at the end).

    Each round halves the way left. `write` keeps a round's rows (a written table), so that lineage stays short. With `owner`, a column
    of the links, a chain that leads to a row of another owner has no tip either, and `problem` says "owner" or "cycle".
    """
    from antecede.sources.tables import written

    write = write or (lambda df: written(df, "chains"))
    now = links.select("id", F.col("next").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"))
    if owner:
        # Whether all rows on the way so far have one owner: true of a way if it is of both its halves.
        of = lambda c, o: links.select(F.col("id").alias(c), F.col(owner).alias(o))
        now = now.join(of("id", "__a"), "id").join(of("to", "__b").withColumn("__known", F.lit(True)), "to", "left").select("id", "to", "hops", (F.col("__known").isNull() | F.col("__a").eqNullSafe(F.col("__b"))).alias("ok"))
    else:
        now = now.withColumn("ok", F.lit(True))
    now = write(now)
    for _ in range(rounds):
        on = now.select(F.col("id").alias("to"), F.col("to").alias("far"), F.col("hops").alias("more"), F.col("ok").alias("ok_after"))
        # A link to an id without a row ends there.
        stepped = now.join(on, "to", "left").select("id", F.col("to").alias("near"), F.when(F.col("more").isNull() | F.col("far").isNull(), F.col("to")).otherwise(F.col("far")).alias("to"), (F.col("hops") + F.coalesce(F.when(F.col("far").isNotNull(), F.col("more")), F.lit(0))).alias("hops"), (F.col("ok") & F.coalesce("ok_after", F.lit(True))).alias("ok"))
        moved = write(stepped)
        left = moved.where("NOT (near <=> to)").limit(1).count()
        now = moved.drop("near")
        if not left:
            break
    ends = links.where("next IS NULL").select(F.col("id").alias("to"), F.lit(True).alias("end"))
    known = links.select(F.col("id").alias("to"), F.lit(True).alias("known"))
    out = now.join(known, "to", "left").join(ends, "to", "left")
    ended = F.col("to").isNull() | F.col("known").isNull() | F.coalesce("end", F.lit(False))
    tip = F.when(F.col("to").isNull(), F.col("id")).when(ended, F.col("to"))
    if not owner:
        return out.select("id", tip.alias("tip"), F.when(ended, F.col("hops")).alias("hops"))
    problem = F.when(~F.col("ok"), "owner").when(~ended, "cycle")
    return out.select("id", F.when(F.col("ok"), tip).alias("tip"), F.when(F.col("ok") & ended, F.col("hops")).alias("hops"), problem.alias("problem"))


#: Rows that each row may become in a coverage grid.
MOST_CELLS = 1_000


def coverage_grid(rows: DataFrame, wanted: list[DataFrame], actions: DataFrame, on: list[str], state: str) -> DataFrame:
    """rows x each of the small tables `wanted`: captured if any action says so, unsupported if all say that, else missing.

    The grid is the result, so it has as many rows as their product; more than MOST_CELLS a row are refused.
    """
    grid, cells = rows, 1
    for w in wanted:
        cells *= w.limit(MOST_CELLS + 1).count()
        if cells > MOST_CELLS:
            raise ValueError(f"every row would become more than {MOST_CELLS:,}")
        grid = grid.crossJoin(F.broadcast(w))
    seen = actions.groupBy(*on).agg(F.bool_or(F.col(state) == "captured").alias("__c"), F.bool_and(F.col(state) == "unsupported").alias("__u"))
    return grid.join(seen, on, "left").withColumn("coverage", F.when(F.col("__c"), "captured").when(F.col("__u"), "unsupported").otherwise("missing")).drop("__c", "__u")


def compare_tables(left: DataFrame, right: DataFrame, key: str, columns: list[str], tolerance: float = 1e-8) -> DataFrame:
    """key and the columns that differ, `missing_left` or `missing_right`; null equals null and nothing else."""
    a, b = (df.select(F.col(key).alias("__key"), F.lit(True).alias("here"), *columns).alias(n) for df, n in ((left, "a"), (right, "b")))
    same = {c: F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) | F.coalesce(F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) <= tolerance, F.lit(False)) for c in columns}
    both = a.join(b, "__key", "full")
    tests = {"missing_left": F.col("a.here").isNull(), "missing_right": F.col("b.here").isNull()} | {c: F.col("a.here") & F.col("b.here") & ~x for c, x in same.items()}
    return both.select(F.col("__key").alias(key), reasons(tests).alias("differs")).where("size(differs) > 0")


def unique_pair_match(left: DataFrame, right: DataFrame, id_: str, group: str, names: tuple[str, str], left_time: str, right_time: str, seconds: int, right_id: str) -> DataFrame:
    """left id and right id of the only right row in the group with the same two names, in either order, near enough in time."""
    pair = F.array_sort(F.array(*names))
    a = left.select(id_, group, pair.alias("__p"), F.col(left_time).alias("__l"))
    b = right.select(F.col(right_id).alias("match_id"), group, pair.alias("__p"), F.col(right_time).alias("__r"))
    met = match_within(a, b, [group, "__p"], "__l", "__r", seconds)
    return met.groupBy(id_).agg(F.count("*").alias("n"), F.min("match_id").alias("match_id")).where("n = 1").select(id_, "match_id")


#: Rows that a task groups at a time, about. What is dealt into a given number of parts isn't put together again by the size of its files.
TASK_ROWS = 600_000


def link_issues(links: DataFrame, fixtures: DataFrame, link: str) -> DataFrame:
    """fixture, issue, links: `conflict` and how many, for each fixture with several values of `link`; `no link`, for each row of `fixtures`
    that `links` lacks; `no fixture`, for each fixture of `links` without an open row. fixtures: fixture, open. A null fixture equals no other.

    Rows are dealt by (fixture, run), so a task holds about TASK_ROWS of them at any size. Runs are of row numbers first, which
    leaves repeats behind, then of a link's hash: no fixture and no pair goes to one task whole.
    """
    parts = max(links.sparkSession.sparkContext.defaultParallelism, -(-(links.count() + fixtures.count()) // TASK_ROWS))
    # What is known of a fixture: 1 for a link, 2 for an open row.
    seen = links.select("fixture", link, F.lit(1).alias("known"), F.lit(0).cast("long").alias("rows"))
    rows = fixtures.where("fixture IS NOT NULL").select("fixture", F.lit(None).cast(links.schema[link].dataType).alias(link), F.when(F.col("open"), 2).otherwise(0).alias("known"), F.lit(1).cast("long").alias("rows"))
    sums = [F.bit_or("known").alias("known"), F.sum("rows").alias("rows")]
    run = lambda c: F.pmod(c, F.lit(RUNS)).cast("int")
    dealt = seen.unionByName(rows).withColumn("run", run(F.monotonically_increasing_id())).repartition(parts, "fixture", "run")
    pairs = dealt.groupBy("fixture", "run", link).agg(*sums).withColumn("run", run(F.xxhash64(link))).repartition(parts, "fixture", "run")
    counts = pairs.groupBy("fixture", "run", link).agg(*sums).groupBy("fixture", "run").agg(F.count(link).alias("links"), *sums)
    one = counts.repartition(parts, "fixture").groupBy("fixture").agg(F.sum("links").alias("links"), *sums)
    issue = lambda name, when, n, times: F.when(when, F.struct(F.lit(name).alias("issue"), n.alias("links"), times.alias("times")))
    none, once = F.lit(0).cast("long"), F.lit(1).cast("long")
    found = F.array_compact(F.array(
        issue("conflict", F.col("links") > 1, F.col("links"), once),
        issue("no link", F.col("known").bitwiseAND(1) == 0, none, F.col("rows")),
        issue("no fixture", F.col("known") == 1, none, once),
    ))
    out = one.select("fixture", F.explode(found).alias("x")).select("fixture", "x.issue", "x.links", F.explode(F.sequence(once, F.col("x.times")))).select("fixture", "issue", "links")
    return out.unionByName(fixtures.where("fixture IS NULL").select("fixture", F.lit("no link").alias("issue"), none.alias("links")))


def resolve_names(asked: DataFrame, name: str, known: DataFrame, aliases: DataFrame, suffixes: str) -> DataFrame:
    """name, id, tier: exact without case, then a curated alias, then without suffixes if only one id fits; else no id.

    known: (id, name); aliases: (alias, id). All three tiers are equi-joins on distinct names.
    """
    fold = lambda c: F.lower(F.trim(F.col(c)))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(fold(c), suffixes, ""), r"\s+", " "))
    one = lambda df, key, tier: df.where(F.col("k").isNotNull() & (F.col("k") != "")).groupBy("k").agg(F.min("id").alias(tier), F.count_distinct("id").alias("n")).where("n = 1").select("k", tier)
    exact = one(known.select("id", fold("name").alias("k")), "k", "exact")
    alias = one(aliases.select("id", fold("alias").alias("k")), "k", "alias")
    bare = one(known.select("id", plain("name").alias("k")), "k", "normal")
    names = asked.select(name).distinct().withColumns({"f": fold(name), "p": plain(name)})
    out = names.join(exact.withColumnRenamed("k", "f"), "f", "left").join(alias.withColumnRenamed("k", "f"), "f", "left").join(bare.withColumnRenamed("k", "p"), "p", "left")
    return out.select(name, F.coalesce("exact", "alias", "normal").alias("id"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("alias").isNotNull(), "alias").when(F.col("normal").isNotNull(), "normal").otherwise("none").alias("tier"))


def names_by_trigrams(asked: DataFrame, name: str, known: DataFrame, most: int = 3, least: float = 0.6) -> DataFrame:
    """name, suggestion, similarity, rank: up to `most` known names that share a trigram; suggestions only.

    Candidates come from an equi-join on the rare trigrams of distinct names, which loses none; their similarity is the Jaccard of the trigrams.
    """
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c) - 2, F.lit(1))), lambda i: F.substring(F.lower(F.col(c)), i, F.lit(3))))
    a = asked.select(name).distinct().withColumn("ga", grams(name))
    b = known.select(F.col("name").alias("suggestion")).distinct().withColumn("gb", grams("suggestion"))
    # Rare trigrams first: two sets whose similarity reaches `least` share one of their first n - ceil(n * least) + 1.
    held = b.select(F.explode("gb").alias("g")).groupBy("g").agg(F.count("*").alias("holders"))

    def prefix(df: DataFrame, key: str, all_: str) -> DataFrame:
        rows = df.select(key, all_, F.explode(all_).alias("g")).join(held, "g", "left").withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy(F.coalesce("holders", F.lit(0)), "g")))
        return rows.where(F.col("k") <= F.size(all_) - F.ceil(F.size(all_) * F.lit(least) - 1e-9) + 1).select(key, all_, "g")

    met = prefix(a, name, "ga").join(prefix(b, "suggestion", "gb"), "g").dropDuplicates([name, "suggestion"])
    shared = F.size(F.array_intersect("ga", "gb"))
    scored = met.withColumn("similarity", shared / (F.size("ga") + F.size("gb") - shared)).where(F.col("similarity") >= least)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("similarity"), "suggestion"))).where(F.col("rank") <= most).select(name, "suggestion", "similarity", "rank")
