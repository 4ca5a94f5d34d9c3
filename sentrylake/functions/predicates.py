"""Column builders for authentication logs: each is one named rule, JVM-side, with its null behaviour stated."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\f"
DAY = 86_400
#: logon type descriptions; fixed values
LOGON_TYPES = {
    0: "System",
    2: "Interactive",
    3: "Network",
    4: "Batch",
    5: "Service",
    7: "Unlock",
    8: "NetworkCleartext",
    9: "NewCredentials",
    10: "RemoteInteractive",
    11: "CachedInteractive",
    12: "CachedRemoteInteractive",
    13: "CachedUnlock",
}


def stripped(c: Column) -> Column:
    """Trims every kind of ASCII white space (``trim`` alone takes blanks only)."""
    return F.btrim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    """Null or nothing but white space; never null."""
    return c.isNull() | (stripped(c) == "")


def valid_user(user: Column) -> Column:
    return ~blank(user) & ~F.lower(stripped(user)).isin("null", "none", "nan")


def normal_domain(domain: Column) -> Column:
    return F.when(blank(domain), F.lit("Unknown")).otherwise(F.lower(stripped(domain)))


def or_unknown(c: Column) -> Column:
    return F.when(blank(c), F.lit("Unknown")).otherwise(stripped(c))


def logon_description(description: Column, logon_type: Column) -> Column:
    known = F.create_map(*[x for k, v in LOGON_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.when(~blank(description), description).otherwise(F.coalesce(F.try_element_at(known, logon_type), F.lit("Unknown")))


def shifted_time(time: Column, day: Column, start_day: int = 42, seconds: int = 3600) -> Column:
    """Daylight saving: times of days from ``start_day`` on move back."""
    return F.when(day >= start_day, time - seconds).otherwise(time)


# three notions of a usable source or host, kept apart on purpose
def present(c: Column) -> Column:
    return ~blank(c)


def profile_source(source: Column) -> Column:
    return ~blank(source) & (stripped(source) != "Unknown")


def template_value(c: Column) -> Column:
    return ~blank(c) & (stripped(c) != "Unknown")


def entity_type(user: Column, admins: Iterable[str] = ("administrator",), system: Iterable[str] = ("system", "local service", "network service", "anonymous logon"), services: Iterable[str] = ("svc", "service")) -> Column:
    """Admin, System, Machine (``*$``), User (``User*``), Service, Other; name lists compare trimmed and lower-cased."""
    low = F.lower(stripped(user))
    return (
        F.when(low.isin(*admins), "Admin")
        .when(low.isin(*system), "System")
        .when(user.endswith("$"), "Machine")
        .when(user.startswith("User"), "User")
        .when(low.isin(*services), "Service")
        .otherwise("Other")
    )


def population(user: Column, drop_machine: bool = False, drop_system: bool = False) -> Column:
    """Rows that stay: all, or all but machines, or all but system accounts."""
    gone = [k for k, drop in (("Machine", drop_machine), ("System", drop_system)) if drop]
    return ~entity_type(user).isin(*gone) if gone else F.lit(True)


def failure_kind(event_id: Column, reason: Column) -> Column:
    """locked, bad_pw or other for a failure; null for anything else."""
    low = F.lower(reason)
    return F.when(event_id == 4625, F.when(low.contains("account locked out"), "locked").when(low.contains("bad password"), "bad_pw").otherwise("other"))


def hour(time: Column) -> Column:
    return F.floor((time % DAY) / 3600).cast("int")


def off_hours(time: Column, last: int = 7) -> Column:
    """18h to 7h, the hour 7 included (``last=6`` for the survey's rule)."""
    return (hour(time) >= 18) | (hour(time) <= last)


def object_filter(name: str) -> Column:
    return {"all": F.lit(True), "fail": F.col("EventID") == 4625, "success": F.col("EventID") == 4624, "night": off_hours(F.col("Time"))}[name]


def rule(value: Column, op: str, threshold: float) -> Column:
    near = F.abs(value - threshold) <= 1e-8 + 1e-5 * abs(threshold)
    return {">=": value >= threshold, ">": value > threshold, "<=": value <= threshold, "<": value < threshold, "==": near, "!=": ~near}[op]


def clipped(c: Column, low: float = -10.0, high: float = 10.0) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def host_band(n: Column) -> Column:
    return F.when(n == 1, "1").when(n == 2, "2").when(n <= 5, "3-5").when(n <= 10, "6-10").otherwise(">10")


def ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def higher_quantile(values: Column, p: float) -> Column:
    """Of a sorted array: the value at the ceiling of (n - 1) p."""
    return F.get(values, F.ceil(F.lit(p) * (F.size(values) - 1)).cast("int"))


def nearest_quantile(values: Column, p: float) -> Column:
    return F.get(values, F.bround(F.lit(p) * (F.size(values) - 1)).cast("int"))


def hash_uniform(*keys: Column) -> Column:
    """A value in [0, 1) that depends on the keys alone: seeded sampling that survives any partitioning, and any engine.

    The first 52 bits of the MD5 of the keys' texts, joined by a bar; a null key is an empty text.
    """
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)
