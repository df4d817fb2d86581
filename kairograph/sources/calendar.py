"""Calendar events, as a calendar API returns them in JSON: one object a line."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kairograph.functions.temporal import parse_time
from kairograph.functions.text import first_truthy, strip, word_count

MIN_WORDS = 20
LOOK_BACK_DAYS = 180
UNTITLED = "Untitled event"
EVENT = (
    "id string, status string, summary string, description string, location string, htmlLink string, updated string,"
    " start struct<dateTime:string,date:string>, end struct<dateTime:string,date:string>, organizer struct<displayName:string,email:string>,"
    " attendees array<struct<displayName:string,email:string,self:boolean>>"
)


def _name(person: Column) -> Column:
    return F.coalesce(first_truthy(person["displayName"], person["email"]), F.lit(""))


def _labelled(label: str, text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(label), text))


def event_text() -> Column:
    """Title, time, organizer, other attendees, description and place, a line each; absent ones are left out."""
    start, end = first_truthy(F.col("start.dateTime"), F.col("start.date")), first_truthy(F.col("end.dateTime"), F.col("end.date"))
    others = F.transform(F.filter("attendees", lambda a: ~F.coalesce(a["self"], F.lit(False))), _name)
    return F.concat_ws(
        "\n",
        F.coalesce("summary", F.lit(UNTITLED)),
        F.when(start.isNotNull(), F.concat(F.lit("Time: "), start, F.lit(" to "), F.coalesce(end, F.lit("")))),
        _labelled("Organizer: ", first_truthy(F.col("organizer.displayName"), F.col("organizer.email"))),
        F.when(F.size(others) > 0, F.concat(F.lit("Attendees: "), F.array_join(others, ", "))),
        F.nullif(strip(F.col("description")), F.lit("")),
        _labelled("Location: ", strip(F.col("location"))),
    )


def since(cursor: str | None, now: dt.datetime, days_back: int = LOOK_BACK_DAYS) -> str:
    return cursor or (now - dt.timedelta(days=days_back)).isoformat()


def fetch(events: DataFrame, now: dt.datetime, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of events that aren't cancelled and have enough words. attendees includes the calendar's owner."""
    started = F.lit(now.isoformat())
    # generated, as a filter on a projected text would be pushed below and make every text twice
    long_enough = F.explode_outer(F.filter(F.array(event_text()), lambda t: word_count(t) >= min_words)).alias("__text")
    rows = events.where(F.coalesce("status", F.lit("")) != "cancelled").select("*", long_enough).where("__text is not null")
    return rows.select(
        F.col("id").alias("event_id"), F.coalesce("summary", F.lit(UNTITLED)).alias("title"), F.col("__text").alias("plain_text_content"),
        F.coalesce(first_truthy(F.col("start.dateTime"), F.col("start.date")), started).alias("event_time"), F.coalesce("updated", started).alias("updated"),
        F.coalesce("htmlLink", F.lit("")).alias("url"), F.coalesce("organizer.email", F.lit("")).alias("organizer"),
        F.coalesce(F.transform("attendees", _name), F.array().cast("array<string>")).alias("attendees"),
    )


def as_episodes(rows: DataFrame) -> DataFrame:
    """source_id, source_type, text, reference_time, metadata."""
    return rows.select(
        F.col("event_id").alias("source_id"), F.lit("gcal_event").alias("source_type"), F.col("plain_text_content").alias("text"),
        parse_time(F.col("event_time")).alias("reference_time"), F.to_json(F.struct("title", "event_time", "url", "organizer", "attendees")).alias("metadata"),
    )
