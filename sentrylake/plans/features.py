"""Plans grammar features: a list of names becomes a few shared aggregations, joined on the account-day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sentrylake.functions import predicates as P
from sentrylake.operators.history import ACCOUNT, KEYS, at, robust_z
from sentrylake.operators.intraday import evenness
from sentrylake.operators.ordered import quantiles
from sentrylake.plans.grammar import Feature, by_name
from sentrylake.storage import Scratch

MINUTES = {"5m": 300, "15m": 900, "60m": 3600}


def prepared(events: DataFrame) -> DataFrame:
    """One projection: object flags and entity columns; a value that isn't usable is null and isn't counted."""
    value = lambda c: F.when(P.template_value(F.col(c)), P.stripped(F.col(c)))
    source, host = value("Source"), value("LogHost")
    return events.select(
        *KEYS,
        "Time",
        F.lit(True).alias("all"),
        (F.col("EventID") == 4625).alias("fail"),
        (F.col("EventID") == 4624).alias("success"),
        P.off_hours(F.col("Time")).alias("night"),
        source.alias("Source"),
        host.alias("LogHost"),
        F.when(source.isNotNull() & host.isNotNull(), F.concat_ws("␟", source, host)).alias("pair"),
        P.hour(F.col("Time")).cast("string").alias("hour"),
        F.col("LogonType").cast("string").alias("logon_type"),
        F.nullif(P.stripped(F.col("AuthenticationPackage")), F.lit("")).alias("auth"),
        F.nullif(P.stripped(F.col("FailureReason")), F.lit("")).alias("fail_reason"),
    )


#: columns that a profile can be asked for, besides the account-day
VALUES = ["Source", "LogHost", "pair", "hour", "logon_type", "auth", "fail_reason"]
FLAGS = ["fail", "success", "night"]


class Planner:
    """Turns features into one table of (account-day, f, x), f being a feature's place in ``names``.

    The events are read once into a cube: counts by account-day, flags and values, written. The profiles that the
    features need (how often each value occurs among an object's events) come from the cube by one aggregation and are written too, each
    under its number. Features of one measure are computed together, for all their profiles at once. The table has
    a row only where a feature isn't at its default.
    """

    def __init__(self, events: DataFrame, features: list[Feature], types: DataFrame | None = None):
        bad = [f.name for f in features if not f.grammatical]
        if bad:
            raise ValueError(f"{bad} mean nothing")
        self.events, self.features, self.scratch = prepared(events), features, Scratch(events.sparkSession, "features")
        self.cube = self.scratch.write(self.events.groupBy(*KEYS, *FLAGS, *VALUES).agg(F.count("*").alias("n")), "cube")
        self.days = self.scratch.write(self.cube.groupBy(*KEYS).agg(F.sum("n").alias("n_all"), *[F.sum(F.when(F.col(o), F.col("n")).otherwise(0)).alias(f"n_{o}") for o in FLAGS]), "days")
        self.types = types if types is not None else self.days.select(*KEYS, P.entity_type(F.col("UserName")).alias("entity_type"))
        self.first = self.days.agg(F.min("day")).first()[0]
        self.pairs = sorted({(f.obj, f.entity) for f in features if f.entity in VALUES})
        self._profiles: DataFrame | None = None

    def profiles(self, places: list[int]) -> DataFrame:
        """keys, f, v, n of the features at these places, which have different profiles."""
        if self._profiles is None:
            kinds = [F.struct(F.lit(i).alias("pid"), (F.col(e) if o == "all" else F.when(F.col(o), F.col(e))).alias("v")) for i, (o, e) in enumerate(self.pairs)]
            rows = self.cube.select(*KEYS, "n", F.explode(F.array(*kinds)).alias("k")).select(*KEYS, "n", "k.*").filter("v is not null")
            self._profiles = self.scratch.write(rows.groupBy(*KEYS, "pid", "v").agg(F.sum("n").alias("n")), "profiles")
        numbers = [self.pairs.index((self.features[i].obj, self.features[i].entity)) for i in places]
        f = F.element_at(F.create_map(*[F.lit(x) for pair in zip(numbers, places) for x in pair]), F.col("pid"))
        return self._profiles.filter(F.col("pid").isin(*numbers)).select(*KEYS, f.alias("f"), "v", "n")

    def bases(self, places: list[int]) -> DataFrame:
        """keys, f, base of all account-days."""
        plain = {i: F.log1p(f"n_{self.features[i].obj}") if self.features[i].base == "count" else F.col(f"n_{self.features[i].obj}") / F.col("n_all") for i in places if self.features[i].base != "distinct"}
        counted = [i for i in places if i not in plain]
        out = None
        if plain:
            out = self.days.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(i).alias("f"), c.alias("base")) for i, c in plain.items()])).alias("b")).select(*KEYS, "b.*")
        if counted:
            none = self.days.select(*KEYS, F.explode(F.array(*[F.lit(i) for i in counted])).alias("f"), F.lit(0).alias("k"))
            k = self.profiles(counted).select(*KEYS, "f", F.lit(1).alias("k")).unionByName(none)
            k = k.groupBy(*KEYS, "f").agg(F.log1p(F.sum("k")).alias("base"))
            out = k if out is None else out.unionByName(k)
        return out

    def _warm(self, df: DataFrame, days: int) -> DataFrame:
        return df.select(*KEYS, "f", F.when(F.col("day") - days >= F.lit(self.first), F.col("x")).alias("x"))

    def default(self, place: int) -> float | None:
        return 0.0 if self.features[place].measure in ("count", "distinct", "fanout", "novelty") else None

    def table(self, window: int | None = None) -> DataFrame:
        """keys, f, x of all features; ``window`` overrides the days of the past."""
        groups: dict[tuple[str, str, int, bool], list[int]] = {}
        for i, f in enumerate(self.features):
            short = f.window if f.window in MINUTES else ""
            single = bool(short) or f.entity == "event" and f.measure == "recency" or (f.obj, f.entity) in {(g.obj, g.entity) for g in (self.features[j] for j in groups.get((f.measure, short, window or f.days, False), []))}
            groups.setdefault((f.measure, short, window or f.days, i if single else False), []).append(i)
        out = self.days.select(*KEYS, F.lit(-1).alias("f"), F.lit(None).cast("double").alias("x"))
        for (measure, short, days, _), places in groups.items():
            part = getattr(self, f"_{measure}")(places, days, short)
            out = out.unionByName(part.select(*KEYS, "f", F.col("x").cast("double").alias("x")))
        return out

    def _count(self, places: list[int], w: int, short: str) -> DataFrame:
        if not short:
            values = [F.struct(F.lit(i).alias("f"), F.log1p(f"n_{self.features[i].obj}").alias("x")) for i in places]
            return self.days.select(*KEYS, F.explode(F.array(*values)).alias("v")).select(*KEYS, "v.*")
        most = self.events.filter(F.col(self.features[places[0]].obj)).groupBy(*KEYS, F.floor(F.col("Time") / MINUTES[short]).alias("b")).agg(F.count("*").alias("n"))
        return most.groupBy(*KEYS).agg(F.log1p(F.max("n")).alias("x")).withColumn("f", F.lit(places[0]))

    def _share(self, places: list[int], w: int, short: str) -> DataFrame:
        values = [F.struct(F.lit(i).alias("f"), (F.col(f"n_{self.features[i].obj}") / F.col("n_all")).alias("x")) for i in places]
        return self.days.select(*KEYS, F.explode(F.array(*values)).alias("v")).select(*KEYS, "v.*")

    def _distinct(self, places: list[int], w: int, short: str) -> DataFrame:
        if not short:
            return self.profiles(places).groupBy(*KEYS, "f").agg(F.log1p(F.count("*")).alias("x"))
        f = self.features[places[0]]
        rows = self.events.filter(F.col(f.obj) & F.col(f.entity).isNotNull()).groupBy(*KEYS, F.floor(F.col("Time") / MINUTES[short]).alias("b"), f.entity).agg(F.lit(1).alias("one"))
        return rows.groupBy(*KEYS, "b").agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.log1p(F.max("n")).alias("x")).withColumn("f", F.lit(places[0]))

    def _evenness(self, places: list[int], w: int, short: str) -> DataFrame:
        agg = self.profiles(places).groupBy(*KEYS, "f").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln(F.col("n").cast("double"))).alias("s"), F.count("*").alias("k"))
        return agg.select(*KEYS, "f", evenness(F.ln(F.col("t").cast("double")) - F.col("s") / F.col("t"), F.col("k")).alias("x"))

    def _fanout(self, places: list[int], w: int, short: str) -> DataFrame:
        # accounts per value of a day are counted before they meet the accounts again: a value that all accounts have is one row
        n = self.profiles(places).select(*KEYS, "f", "v")
        return n.join(n.groupBy("day", "f", "v").agg(F.count("*").alias("m")), ["day", "f", "v"]).groupBy(*KEYS, "f").agg(F.log1p(F.max("m")).alias("x"))

    def _dated(self, places: list[int], w: int) -> DataFrame:
        prev = F.lag("day").over(Window.partitionBy(*ACCOUNT, "f", "v").orderBy("day"))
        return self.profiles(places).withColumn("prev", prev).withColumn("new", F.col("prev").isNull() | (F.col("prev") < F.col("day") - w))

    def _novelty(self, places: list[int], w: int, short: str) -> DataFrame:
        return self._dated(places, w).groupBy(*KEYS, "f").agg(F.log1p(F.count_if("new")).alias("x"))

    def _novelty_share(self, places: list[int], w: int, short: str) -> DataFrame:
        return self._dated(places, w).groupBy(*KEYS, "f").agg((F.sum(F.when(F.col("new"), F.col("n")).otherwise(0)) / F.sum("n")).alias("x"))

    def _recency(self, places: list[int], w: int, short: str) -> DataFrame:
        if self.features[places[0]].entity == "event":
            gap = F.col("day") - F.lag("day").over(Window.partitionBy(*ACCOUNT).orderBy("day"))
            return self.days.select(*KEYS, F.lit(places[0]).alias("f"), gap.cast("double").alias("x"))
        return self._dated(places, 0).groupBy(*KEYS, "f").agg(F.min(F.col("day") - F.col("prev")).cast("double").alias("x"))

    def _both(self, places: list[int], w: int) -> DataFrame:
        """keys, f, v, now, past: today's values and those of the ``w`` days before, pooled, for active days; one union and one aggregation."""
        own = self.profiles(places)
        now = own.select(*KEYS, "f", "v", F.col("n").alias("now"), F.lit(0).cast("long").alias("past"))
        ahead = F.explode(F.sequence(F.col("day") + 1, F.col("day") + w))
        spread = own.select(*ACCOUNT, ahead.alias("day"), "f", "v", "n").join(self.days.select(*KEYS), KEYS, "left_semi")
        then = spread.select(*KEYS, "f", "v", F.lit(0).cast("long").alias("now"), F.col("n").alias("past"))
        return now.unionByName(then).groupBy(*KEYS, "f", "v").agg(F.sum("now").alias("now"), F.sum("past").alias("past"))

    def _jaccard(self, places: list[int], w: int, short: str) -> DataFrame:
        a = self._both(places, w).groupBy(*KEYS, "f").agg(F.count_if((F.col("now") > 0) & (F.col("past") > 0)).alias("i"), F.count("*").alias("u"), F.count_if(F.col("past") > 0).alias("h"))
        return a.select(*KEYS, "f", F.when(F.col("h") > 0, F.col("i") / F.col("u")).alias("x"))

    def _dist_shift(self, places: list[int], w: int, short: str) -> DataFrame:
        per = Window.partitionBy(*KEYS, "f")
        both = self._both(places, w).withColumn("tn", F.sum("now").over(per)).withColumn("tp", F.sum("past").over(per))
        gap = F.abs(F.coalesce(F.col("now") / F.nullif("tn", F.lit(0)), F.lit(0.0)) - F.col("past") / F.nullif("tp", F.lit(0)))
        a = both.groupBy(*KEYS, "f").agg((F.sum(gap) / 2).alias("d"), F.max("tn").alias("tn"), F.max("tp").alias("tp"))
        return a.select(*KEYS, "f", F.when((F.col("tp") > 0) & (F.col("tn") > 0), F.col("d")).alias("x"))

    def _delta_mean(self, places: list[int], w: int, short: str) -> DataFrame:
        past = Window.partitionBy(*ACCOUNT, "f").orderBy("day").rangeBetween(-w, -1)
        # counts of inactive days are 0, shares of inactive days don't exist
        shares = [i for i in places if self.features[i].base == "share"]
        zero = F.coalesce(F.sum("base").over(past), F.lit(0.0)) / w
        mean = F.when(F.col("f").isin(*shares), F.avg("base").over(past)).otherwise(zero) if shares else zero
        return self._warm(self.bases(places).withColumn("x", F.col("base") - mean), w)

    def _deviation(self, places: list[int], w: int, short: str) -> DataFrame:
        past = Window.partitionBy(*ACCOUNT, "f").orderBy("day").rangeBetween(-w, -1)
        b = self.bases(places).withColumn("p", F.collect_list("base").over(past))
        b = b.withColumn("p", F.sort_array(F.concat("p", F.array_repeat(F.lit(0.0), F.lit(w) - F.size("p")))))
        p = F.col("p")
        b = b.withColumn("m", F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / w)
        b = b.withColumn("s", F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + (x - F.col("m")) * (x - F.col("m"))) / (w - 1)))
        return self._warm(b.withColumn("x", robust_z(F.col("base"), at(p, 0.5, w), at(p, 0.25, w), at(p, 0.75, w), F.col("s"))), w)

    def _active_days(self, places: list[int], w: int, short: str) -> DataFrame:
        past = Window.partitionBy(*ACCOUNT).orderBy("day").rangeBetween(-w, -1)
        return self._warm(self.days.withColumn("x", F.count("*").over(past).cast("double")).withColumn("f", F.lit(places[0])), w)

    def _peer_z(self, places: list[int], w: int, short: str) -> DataFrame:
        b, by = self.bases(places).join(self.types, KEYS), ["day", "entity_type", "f"]
        # peers by aggregation and join, not by a window that holds a whole peer group in one task
        peers = quantiles(b, "base", [0.25, 0.5, 0.75], by).join(b.groupBy(*by).agg(F.stddev_samp("base").alias("sd")), by)
        z = robust_z(F.col("base"), F.col("q")[1], F.col("q")[0], F.col("q")[2], F.coalesce("sd", F.lit(0.0)))
        return b.join(peers, by).select(*KEYS, "f", z.alias("x"))


def build(events: DataFrame, names: list[str], window: int | None = None, suffix: str = "") -> DataFrame:
    """All account-days with the named features; ``suffix`` marks another window's columns (``window`` days of the past)."""
    planner = Planner(events, [by_name(n) for n in names])
    x = lambda i: F.max(F.when(F.col("f") == i, F.col("x")))
    columns = [x(i) if planner.default(i) is None else F.coalesce(x(i), F.lit(planner.default(i))) for i in range(len(names))]
    return planner.table(window).groupBy(*KEYS).agg(*[c.alias(n + suffix) for c, n in zip(columns, names)])
