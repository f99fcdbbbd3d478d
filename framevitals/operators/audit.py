"""Audit trail of dataset actions: filter, geo lookup, nested entries, newest rows, display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framevitals.functions import net
from framevitals.functions.ordered import last_before
from framevitals.operators.lookup import SMALL_BYTES, attach
from framevitals.sources.scratch import checkpointed

UNKNOWN = "Unknown"
NO_CITY = "—"
ACTOR_SHOWN = 8
DISPLAY_DEFAULTS = {"user": "anonymous", "country": "Cloud", "city": "Remote", "ip": "0.0.0.0", "entity": "-"}


def public_only(events: DataFrame, ip: str = "ip") -> DataFrame:
    """Drop events from local, private or unparseable addresses; a predicate, not a join."""
    return events.where(~net.is_local(F.col(ip)))


def geo_lookup(events: DataFrame, ranges: DataFrame, ip: str = "ip", small: int = SMALL_BYTES) -> DataFrame:
    """Add ``country`` from non-overlapping ``ranges`` (lo, hi, country); 'Unknown' without a match.

    ``lo`` and ``hi`` are addresses as text, IPv4 or IPv6, or IPv4 numbers. Each distinct address is looked up once, by
    predecessor search: addresses and range starts are sorted together over all tasks, every address takes the last
    start before it and checks that range's end. The answers are then attached to the events. However many addresses or ranges
    share a network, no pairs of them are formed.
    """
    kinds = dict(ranges.dtypes)
    low, high = (net.sort_key(F.col(c)) if kinds[c] == "string" else net.number_key(F.col(c)) for c in ("lo", "hi"))
    starts = ranges.select(low.alias("at"), F.lit(0).alias("kind"), F.struct(high.alias("hi"), "country").alias("found"))
    starts = starts.where("at is not null and found.hi is not null")
    addresses = events.groupBy(F.col(ip).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    asked = addresses.withColumn("at", net.sort_key(F.col("value"))).where("at is not null").withColumn("kind", F.lit(1))
    rows = asked.unionByName(starts, allowMissingColumns=True)
    near = last_before(rows, "found", "at", "kind").where("kind = 1")
    inside = (F.col("at") <= F.col("found.hi")) & (F.length("at") == F.length("found.hi"))
    answers = checkpointed(near.where(inside).select("value", F.col("found.country").alias("found"), "n"))
    found = attach(events, F.col(ip), answers, "__country", small)
    return found.select(*events.columns, F.coalesce("__country", F.lit(UNKNOWN)).alias("country"))


def entries(
    events: DataFrame,
    ranges: DataFrame,
    *,
    user: Column,
    role: Column,
    slug: Column,
    entity: Column,
    delta: Column,
    timestamp: Column,
    ip: str = "ip",
    device: Column | None = None,
    os: Column | None = None,
    browser: Column | None = None,
) -> DataFrame:
    """Nested audit records (timestamp, actor, action, environment) of public traffic.

    ``delta`` is a map<string,string>. Device, os and browser are taken as given.
    """
    located = geo_lookup(public_only(events, ip), ranges, ip)
    text = F.lit(None).cast("string")
    return located.select(
        timestamp.alias("timestamp"),
        F.struct(user.cast("string").alias("user_id"), role.cast("string").alias("role")).alias("actor"),
        F.struct(slug.alias("slug"), entity.cast("string").alias("entity"), delta.alias("delta")).alias("action"),
        F.struct(
            F.col(ip).alias("ip"),
            F.struct(F.col("country").alias("country"), F.lit(NO_CITY).alias("city")).alias("geo"),
            (text if device is None else device).alias("device"),
            (text if os is None else os).alias("os"),
            (text if browser is None else browser).alias("browser"),
        ).alias("environment"),
    )


def recent(log: DataFrame, n: int = 100, tie: tuple[str, ...] = ()) -> DataFrame:
    """The newest ``n`` records; ``tie`` columns make the choice among equal times repeatable."""
    return log.orderBy(F.desc("timestamp"), *[F.col(c) for c in tie]).limit(n)


def view(log: DataFrame) -> DataFrame:
    """time, user, action, entity, place, ip with the display defaults for missing parts."""

    def shown(column: str, part: str) -> Column:
        value = F.col(column)
        return F.when(value.isNull() | (value == ""), DISPLAY_DEFAULTS[part]).otherwise(value)

    user = shown("actor.user_id", "user")
    place = F.concat(shown("environment.geo.city", "city"), F.lit(", "), shown("environment.geo.country", "country"))
    return log.select(
        F.col("timestamp").alias("time"),
        F.concat(F.substring(user, 1, ACTOR_SHOWN), F.lit("...")).alias("user"),
        F.col("action.slug").alias("action"),
        shown("action.entity", "entity").alias("entity"),
        place.alias("place"),
        shown("environment.ip", "ip").alias("ip"),
    )
