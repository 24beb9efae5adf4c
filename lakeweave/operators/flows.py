"""Flows over tables of records and entities, put together from the other operators: votes to graph rows, repair of dates
that could not be read, undo, product records from observations, hooks around the creation of entities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut, spread
from . import products as P
from . import quality as Q
from . import records as R

FIELDS = ("headliner", "title", "venue_name", "event_date", "year", "city")


@dataclass
class Flow:
    #: subject, fields, confidence, decision, observations.
    records: DataFrame
    entities: DataFrame
    relations: DataFrame
    #: subject, decision, n_relations; done for subjects that were processed before.
    outcomes: DataFrame


def records_of(votes: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """subject, a column a field, confidence, conflicts of scalar votes (subject, field, value, confidence): one consensus a field."""
    agreed = Q.consensus_value(votes.where(F.col("field").isin(*fields)))
    values = [F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True).alias(f) for f in fields]
    flags = F.array_sort(F.collect_list(F.when(F.col("conflict"), F.col("field")))).alias("conflicts")
    return agreed.groupBy("subject").agg(*values, Q.overall_of_fields(), flags)


def process_records(votes: DataFrame, done: DataFrame, corrections: DataFrame, accept: float = 0.6) -> Flow:
    """Votes on records all the way to graph rows: subjects of `done` (subject) are skipped; consensus, cleaning, venue and
    date split where the venue holds a date, corrections (subject, field, value, confidence), a gate by confidence, observation
    lines, and for records that pass, entities and relations: one for the headliner, the venue, and each show by date. Votes are
    dealt by subject once, over tasks of a bounded number of rows: consensus, fields and confidences need no other shuffle."""
    votes = spread(votes, votes.count(), "subject")
    todo = votes.join(done.select("subject").distinct(), "subject", "left_anti")
    r = R.clean_records(records_of(todo), ["headliner", "title", "venue_name", "city"], []).drop(*[f"{c}_rejected" for c in ("headliner", "title", "venue_name", "city")])
    r = cut(P.split_venue_date(r, "venue_name"))
    r = r.withColumns({"venue_name": F.col("venue"), "event_date": F.coalesce(T.normalise_date(F.col("event_date")), F.col("date")), "year": F.coalesce(F.col("year").try_cast("int"), F.col("venue_year"))}).drop("venue", "date", "venue_year", "venue_confidence")
    r = R.apply_corrections(spread(r, r.count(), "subject"), corrections, "subject", ["headliner", "title", "venue_name", "city"])
    lines = R.observation_lines({"Headliner": F.col("headliner"), "Title": F.col("title"), "Venue": F.col("venue_name"), "Event date": F.col("event_date"), "Year": F.col("year"), "City": F.col("city")})
    r = r.withColumns({"decision": R.gate(F.col("confidence"), F.array().cast("array<string>"), accept), "observations": lines, "name": F.concat(F.lit("record_"), F.col("subject").cast("string"))})
    r = cut(r)
    good = r.where("decision = 'process'")
    entities, relations = R.fan_out(good, "name", [("headliner", "artist", "HEADLINED_BY", 0.9), ("venue_name", "venue", "ADVERTISES_VENUE", 0.8), ("city", "city", "IN_CITY", 0.7)])
    show = T.slug(F.concat_ws(" ", F.coalesce("headliner", F.lit("unknown")), F.coalesce("venue_name", F.lit("none")), "event_date"), "show_")
    shows = good.where("event_date is not null").select(F.col("name").alias("src"), show.alias("dst"), F.lit("ADVERTISES_SHOW").alias("relation_type"), F.lit(0.8).alias("confidence"))
    relations = relations.unionByName(shows)
    entities = entities.unionByName(shows.select(F.col("dst").alias("name"), F.lit("show").alias("entity_type")).distinct())
    n = relations.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("n"))
    outcomes = r.select("subject", "name", "decision").join(n, "name", "left").select("subject", "decision", F.coalesce("n", F.lit(0)).alias("n_relations"))
    skipped = votes.select("subject").distinct().join(done.select("subject").distinct(), "subject", "left_semi").select("subject", F.lit("done").alias("decision"), F.lit(0).cast("long").alias("n_relations"))
    return Flow(r, entities, relations, outcomes.unionByName(skipped))


def _line(observations: Column, prefix: str) -> Column:
    """What follows the prefix in the first observation that begins with it."""
    first = F.get(F.filter(observations, lambda o: o.startswith(prefix)), F.lit(0))
    return F.nullif(F.trim(F.substring(first, F.lit(len(prefix) + 1), F.length(first))), F.lit(""))


NOTE = "Date could not be parsed:"


@dataclass
class Repair:
    #: name, status (repaired, skipped), message, raw, dates.
    outcomes: DataFrame
    #: name, observations of the shows, and the repaired entities' new observations.
    shows: DataFrame
    relations: DataFrame
    entities: DataFrame


def repair_dates(entities: DataFrame, relations: DataFrame) -> Repair:
    """Dates that a note of an entity (name, observations) says could not be parsed are read again, each of several dates on
    its own. Readable ones give a show each, with links to the entity, its venue, headliner and event (ADVERTISES_EVENT of
    `relations`), and replace the note; every entity has an outcome."""
    o = F.col("observations")
    note = F.get(F.filter(o, lambda x: F.contains(x, F.lit(NOTE))), F.lit(0))
    raw = F.nullif(F.regexp_extract(note, NOTE + r'\s*"([^"]+)"', 1), F.lit(""))
    e = entities.select("name", "observations", note.alias("note"), raw.alias("raw"))
    e = e.withColumn("dates", F.filter(F.transform(T.expand_dates(F.col("raw")), lambda x: T.normalise_date(x)), lambda x: x.isNotNull()))
    message = F.when(F.col("note").isNull(), "no unparsed date").when(F.col("raw").isNull(), "no date in the note").when(F.size("dates") == 0, "still unreadable")
    e = cut(e.withColumns({"message": message, "status": F.when(message.isNull(), "repaired").otherwise("skipped")}))
    fixed = e.where("status = 'repaired'").withColumns({"headliner": _line(o, "Headliner:"), "venue": _line(o, "Venue:"), "city": _line(o, "City:")})
    years = F.filter(F.transform("dates", lambda x: T.extract_year(x)), lambda y: y.isNotNull())
    fixed = fixed.withColumn("year", F.coalesce(_line(o, "Year:").try_cast("int"), F.get(years, F.lit(0)), T.extract_year(F.col("raw"))))
    each = fixed.select("*", F.posexplode("dates").alias("i", "date"))
    show = T.slug(F.concat_ws(" ", F.coalesce("headliner", F.lit("unknown")), F.coalesce("venue", F.lit("none")), "date"), "show_")
    number = F.when(F.size("dates") > 1, F.format_string("%d of %d", F.col("i") + 1, F.size("dates")))
    each = each.withColumn("show", show)
    shows = each.select(F.col("show").alias("name"), R.observation_lines({"Date": F.col("date"), "Year": F.col("year"), "Headliner": F.col("headliner"), "Venue": F.col("venue"), "City": F.col("city"), "Show": number}).alias("observations")).dropDuplicates(["name"])
    event = relations.where("relation_type = 'ADVERTISES_EVENT'").groupBy(F.col("src").alias("name")).agg(F.min("dst").alias("event"))
    each = each.join(event, "name", "left")
    link = lambda a, b, kind: each.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("relation_type"))
    own = F.col("show")
    links = [link(F.col("name"), own, "ADVERTISES_SHOW"), link(own, T.slug(F.col("venue"), "venue_"), "HELD_AT"), link(T.slug(F.col("headliner"), "artist_"), own, "PERFORMS_IN"), link(own, F.col("event"), "PART_OF_EVENT")]
    new = reduce(DataFrame.unionByName, links).where("src is not null and dst is not null").distinct()
    told = F.array_join("dates", ", ")
    more = F.array_compact(F.array(F.concat(F.lit("Date repaired: "), told, F.lit(' (from: "'), F.col("raw"), F.lit('")')), F.concat(F.lit("Event date: "), F.get("dates", F.lit(0))), F.when(F.size("dates") > 1, F.concat(F.lit("Event dates: "), told)), F.concat(F.lit("Year: "), F.col("year").cast("string"))))
    changed = fixed.select("name", F.array_union(F.filter("observations", lambda x: x != F.col("note")), more).alias("observations"))
    return Repair(e.select("name", "status", "message", "raw", "dates"), shows, new, changed)


def undo_and_requeue(entities: DataFrame, relations: DataFrame, live: DataFrame, sessions: DataFrame, fresh: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, relations, live, queued) after undoing sessions (session_id): graph rows that come from their live rows
    (entity_name, session_id) go, with entities that nothing refers to any more; the rows are queued anew under session `fresh`
    and leave the live table."""
    theirs = live.join(sessions.select("session_id").distinct(), "session_id", "left_semi")
    left, rels = R.cascade_delete(entities, relations, theirs.select(F.col("entity_name").alias("name")).where("name is not null"), ["artist", "venue", "event", "show"])
    queued = theirs.drop("entity_name").withColumn("session_id", fresh)
    return left, rels, live.join(sessions.select("session_id").distinct(), "session_id", "left_anti"), queued


def product_record(df: DataFrame, observations: str = "observations", name: str | None = None) -> DataFrame:
    """`df` with columns of a product record read from its observations: product_name, product_code, overview, description,
    container_sizes, ph_min, ph_max, ph, colour, odour, warnings, ratios, ready_to_use, and other: observations not used."""
    o = F.col(observations)
    low = lambda x: F.lower(x)
    first = lambda test: F.get(F.filter(o, test), F.lit(0))
    number = lambda x: F.when(x.rlike(r"\d"), F.regexp_extract(x, r"(\d+\.?\d*)", 1)).try_cast("double")
    valid = lambda x: F.when(x.between(0, 14), x)
    called = F.coalesce(_line(o, "Product:"), F.col(name) if name else F.lit(None).cast("string"), F.lit(""))
    overview = F.regexp_replace(first(lambda x: x.startswith("Overview:") | F.contains(low(x), F.lit("what is"))), r"(?i)^(?:Overview:\s*)?(?:What is \w+\??\s*)?", "")
    description = F.trim(F.regexp_replace(F.coalesce(_line(o, "Description:"), F.lit("")), r"(?i)(?:Description)?How Does It Work\?", ""))
    sizes = F.regexp_extract(first(lambda x: F.contains(low(x), F.lit("container size"))), r"(?i)Container Sizes?[:\s]+(.+)$", 1)
    sizes = F.transform(F.filter(F.transform(F.split(F.coalesce(sizes, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d+")), lambda x: F.upper(F.regexp_replace(x, r"\s+", "")))
    like = lambda p: first(lambda x: x.rlike(p))
    single, least, most = like(r"(?i)^ph\s*[:\s]"), like(r"(?i)^ph\s*min"), like(r"(?i)^ph\s*max")
    alone = least.isNull() & most.isNull()
    span = r"(\d+\.?\d*)\s*[-–]\s*(\d+\.?\d*)"
    a, b = (F.when(alone & single.rlike(span), F.regexp_extract(single, span, g)).try_cast("double") for g in (1, 2))
    both = a.between(0, 14) & b.between(0, 14)
    ph_min, ph_max = F.coalesce(valid(number(least)), F.when(both, F.least(a, b))), F.coalesce(valid(number(most)), F.when(both, F.greatest(a, b)))
    colour = F.coalesce(_line(o, "Color:"), _line(o, "Colour:"))
    used = r"(?i)^(?:Product|Overview|Description|Colou?r|Odou?r|pH(?:\s*(?:min|max))?)\s*[:\s]|container size|what is"
    out = {
        "product_name": called, "product_code": F.substring(F.upper(F.regexp_replace(called, "[^A-Za-z0-9]", "")), 1, 20), "overview": F.coalesce(F.trim(overview), F.lit("")), "description": description,
        "container_sizes": sizes, "ph_min": ph_min, "ph_max": ph_max, "ph": F.coalesce(F.when(alone & ~single.rlike(span), valid(number(single))), (ph_min + ph_max) / 2),
        "colour": F.when(~colour.rlike(r"(?i)fastness|^\d+$|^on\s|^and\s"), colour), "odour": F.coalesce(_line(o, "Odor:"), _line(o, "Odour:")),
        "warnings": P.safety_warnings(description), "ratios": P.dilutions(description), "ready_to_use": F.size(P.dilutions(description)) == 0, "other": F.filter(o, lambda x: ~x.rlike(used)),
    }
    return df.withColumns(out)


#: Hooks of areas: (area, stage) -> functions of a DataFrame; stage is before or after.
_hooks: dict[tuple[str, str], list[Callable[[DataFrame], DataFrame | None]]] = {}


def register_hook(area: str, stage: str, fn: Callable[[DataFrame], DataFrame | None]) -> None:
    """before: gives the rows to create from those asked for; after: sees the rows that were created."""
    if stage not in ("before", "after"):
        raise ValueError(stage)
    _hooks.setdefault((area, stage), []).append(fn)


def clear_hooks(area: str) -> None:
    for stage in ("before", "after"):
        _hooks.pop((area, stage), None)


def create_with_hooks(existing: DataFrame, batch: DataFrame, area: str, key: str = "name") -> DataFrame:
    """`existing` with the rows of `batch` that its area's hooks let through and whose key is new."""
    for fn in _hooks.get((area, "before"), []):
        batch = fn(batch)
    new = batch.join(existing.select(key).distinct(), key, "left_anti").dropDuplicates([key]).select(*existing.columns)
    for fn in _hooks.get((area, "after"), []):
        fn(new)
    return existing.unionByName(new)
