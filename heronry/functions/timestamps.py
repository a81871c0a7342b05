"""Mixed timestamp notations to one UTC instant, wholly in JVM expressions.

A value is split by one regular expression into its calendar fields, clock fields and zone. An all-numeric date has up
to two valid parses: day first or month first where the year comes last, month or day second where it comes first.
Which one a source means is settled by expectation-maximisation over the source's mixture of formats, one mixture for
either place of the year:

* the values of a source are pre-aggregated to counts by their set of valid parses,
* E-step: a value valid under both parses is shared between them by the current mixture weights,
* M-step: the weights are the shares plus the prior counts,
* the posterior of a parse decides; below ``CERTAIN`` the value stays unresolved and is marked so. A value with one
  valid parse may still be no date of that format: the parse competes with the share ``GARBLED`` of impossible dates.

A source's declared order (``dmy``, ``mdy``) is a prior: it decides where the values say nothing, and gives way where
too many of them cannot be read in that order. So there are two mixtures, one under which the declaration holds and
what contradicts it is garbled, and a free one; the values' odds between the two weigh their weights. Year, month, day is
what a leading year is expected to mean.
"""

from __future__ import annotations

import math
import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronry.session import settled, tune

#: English month names in order, and the abbreviations of the zones that the feeds name.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "UT": "+00:00",
    "EST": "-05:00", "EDT": "-04:00", "PST": "-08:00", "PDT": "-07:00",
    "CET": "+01:00", "CEST": "+02:00", "BST": "+01:00",
    "AEST": "+10:00", "AEDT": "+11:00", "IST": "+05:30", "JST": "+09:00",
}

_SEP = "\u0001"
_DATE = (
    r"(?:(?<y1>\d{4})(?<s1>[-/.])(?<m1>\d{1,2})\k<s1>(?<d1>\d{1,2})"
    r"|(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})(?![0-9])"
    r"|(?<a>\d{1,2})(?<s2>[-/.])(?<b>\d{1,2})\k<s2>(?<yl>\d{4})(?![0-9])"
    r"|(?<d3>\d{1,2})[ -](?<n3>[A-Za-z]{3,9})\.?,?[ -](?<y3>\d{4})(?![0-9])"
    r"|(?<n4>[A-Za-z]{3,9})\.? (?<d4>\d{1,2}),? (?<y4>\d{4})(?![0-9]))"
)
_CLOCK = r"(?:(?:\s+|[Tt]|,\s*)(?<hh>\d{1,2}):?(?<mi>\d{2})(?::?(?<ss>\d{2})(?:[.,](?<us>\d{1,6})\d*)?)?(?:\s*(?<ap>[AaPp])\.?[Mm]\b\.?)?)?"
_ZONE = r"(?:\s*\[?(?:(?:UTC|GMT)?(?<zs>[+-])(?<zh>\d{1,2})(?::?(?<zm>\d{2}))?|(?<zn>[A-Za-z]{1,5}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+))\]?)?"
PATTERN = rf"^(?:[A-Za-z]{{3,9}},\s+)?{_DATE}{_CLOCK}{_ZONE}$"
#: What becomes of a matched value: its fields in this order; of the alternatives only one is not empty.
FIELDS = {
    "y": "${y1}${y2}${y3}${y4}", "m": "${m1}${m2}", "n": "${n3}${n4}", "d": "${d1}${d2}${d3}${d4}", "a": "${a}", "b": "${b}", "yl": "${yl}",
    "hh": "${hh}", "mi": "${mi}", "ss": "${ss}", "us": "${us}", "ap": "${ap}", "zs": "${zs}", "zh": "${zh}", "zm": "${zm}", "zn": "${zn}",
}

#: Which parse each calendar text is of.
WALLS = {"c1": "one", "c2": "dmy", "c3": "mdy", "c4": "ymd", "c5": "ydm"}
#: Columns that ``normalise`` adds.
RESULT = ("utc_us", "reading", "posterior")

EM_ROUNDS = 30
#: Prior counts of either format in the free mixture, and of the declared (or expected) format and the other where that holds.
PRIOR, EXPECTED, OTHER = 1.0, 2.0, 0.02
CERTAIN = 0.95
#: Odds that a declaration holds before any value is seen, and the share of garbled dates under it.
RELIABLE, SLIPS = 999.0, 0.05
#: Share of a source's dates that are taken for impossible, whatever they look like in another format.
GARBLED = 0.02


def known_zones() -> list[str]:
    """Area/City names and UTC."""
    return sorted(z for z in zoneinfo.available_timezones() if "/" in z and not z.startswith(("SystemV/", "posix/", "right/"))) + ["UTC"]


def _orelse(c: Column, default: str) -> Column:
    return F.when(c == "", default).otherwise(c)


def read_fields(df: DataFrame, value: str, prefix: str = "_t_") -> DataFrame:
    """Adds what ``value`` says: ``epoch``, and the wall clock in microseconds as if it were UTC under each reading
    (``one`` for a named month, ``ymd`` and ``ydm`` for numeric dates with the year first, ``dmy`` and ``mdy`` for
    those with the year last), all null where they don't hold; ``zone`` as a fixed offset or a zone name, empty if the value has none, null if unknown.
    """
    p = lambda n: F.col(prefix + n)
    v = F.regexp_replace(F.col(value), r"^\s+|\s+$", "")
    df = df.withColumn(prefix + "v", v)
    df = df.withColumn(prefix + "f", F.split(F.regexp_replace(p("v"), PATTERN, _SEP.join(FIELDS.values())), _SEP, -1))
    at = {n: F.get(p("f"), i) for i, n in enumerate(FIELDS)}
    month = F.position(F.lower(F.substring(at["n"], 1, 3)), F.lit(MONTHS))
    clock = F.concat(
        F.lit("T"),
        F.when(at["hh"] == "", "00").when(at["ap"] == "", at["hh"]).when(
            at["hh"].try_cast("int").between(1, 12), (at["hh"].try_cast("int") % 12 + F.when(F.upper(at["ap"]) == "P", 12).otherwise(0)).cast("string")
        ).otherwise("99"),
        F.lit(":"), _orelse(at["mi"], "00"), F.lit(":"), _orelse(at["ss"], "00"), F.lit("."), _orelse(at["us"], "0"), F.lit("Z"),
    )
    offset = F.concat(at["zs"], F.lpad(at["zh"], 2, "0"), F.lit(":"), _orelse(at["zm"], "00"))
    names = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    df = df.select(
        "*",
        F.when(p("v").rlike(r"^(\d{10}|\d{13}|\d{16})$"), F.rpad(p("v"), 16, "0").try_cast("long")).alias(prefix + "epoch"),
        clock.alias(prefix + "clock"),
        F.concat_ws("-", _orelse(at["y"], "x"), F.when((at["n"] != "") & (month % 3 == 1), ((month + 2) / 3).cast("int").cast("string")).otherwise("x"), at["d"]).alias(prefix + "c1"),
        F.concat_ws("-", _orelse(at["y"], "x"), _orelse(at["m"], "x"), at["d"]).alias(prefix + "c4"),
        F.concat_ws("-", _orelse(at["y"], "x"), at["d"], _orelse(at["m"], "x")).alias(prefix + "c5"),
        F.concat_ws("-", at["yl"], at["b"], at["a"]).alias(prefix + "c2"),
        F.concat_ws("-", at["yl"], at["a"], at["b"]).alias(prefix + "c3"),
        F.when(at["zs"] != "", F.when(offset.rlike(r"^[+-](0\d|1[0-7]):[0-5]\d$"), offset))
        .when(at["zn"] == "", "")
        .when(at["zn"].contains("/"), at["zn"])
        .otherwise(F.try_element_at(names, F.upper(at["zn"])))
        .alias(prefix + "zone"),
    )
    wall = lambda c: F.when(~p(c).startswith("0000"), F.unix_micros(F.concat(p(c), p("clock")).try_cast("timestamp"))).alias(prefix + WALLS[c])
    own = [prefix + n for n in ("v", "f", "clock", *WALLS, "epoch", "zone")]
    return settled(df, [c for c in df.columns if c not in own], [p("epoch"), p("zone"), *map(wall, WALLS)])


def mixture_weights(fields: DataFrame, source: str, order: str, prefix: str = "_t_") -> DataFrame:
    """EM per source over the counts of values valid in the one, the other or both formats; ``order`` is what it declares.

    One row per source that has any numeric date: ``w_dmy``, the weight of day-first among its dates with the year last,
    and ``w_ymd``, that of month-second among those with the year first. The fold over EM_ROUNDS runs in the JVM on three
    counts each; nothing is collected.
    """
    valid = lambda c: F.col(prefix + c).isNotNull()
    pairs = (("dmy", "mdy"), ("ymd", "ydm"))
    counts = (
        fields.filter(valid("dmy") | valid("mdy") | valid("ymd") | valid("ydm"))
        .groupBy(source).agg(
            F.max(order).alias("_order"),
            *[F.count_if(test).cast("double").alias(f"n_{name}") for a, b in pairs for name, test in ((a, valid(a) & ~valid(b)), (b, valid(b) & ~valid(a)), (a + b, valid(a) & valid(b)))],
        )
    )
    n = lambda c: F.col(f"n_{c}")

    def em(own: float, other: float, n_own: Column, n_other: Column, n_both: Column) -> Column:
        step = lambda w, _: (F.lit(own) + n_own + n_both * w) / (F.lit(own + other) + n_own + n_other + n_both)
        return F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), F.lit(own / (own + other)), step)

    def expected(a: str, b: str) -> Column:
        """The weight of ``a``, if that is what the source declares."""
        odds = math.log(RELIABLE) + math.log(SLIPS / 0.5) * n(b) + math.log((1 - SLIPS) / 0.5) * n(a)
        holds = 1.0 / (1.0 + F.exp(-F.greatest(F.least(odds, F.lit(500.0)), F.lit(-500.0))))
        return holds * em(EXPECTED, OTHER, n(a), F.lit(0.0), n(a + b)) + (1.0 - holds) * free(a, b)

    def free(a: str, b: str) -> Column:
        return em(PRIOR, PRIOR, n(a), n(b), n(a + b))

    declared = F.coalesce("_order", F.lit(""))
    return counts.withColumn("n_mdydmy", n("dmymdy")).select(
        source, F.when(declared == "dmy", expected("dmy", "mdy")).when(declared == "mdy", 1.0 - expected("mdy", "dmy")).otherwise(free("dmy", "mdy")).alias("w_dmy"), expected("ymd", "ydm").alias("w_ymd")
    )


def normalise(df: DataFrame, value: str, source: str, sources: DataFrame, zone_col: str = "tz_name", order_col: str = "date_order") -> DataFrame:
    """Adds ``utc_us`` (bigint), ``reading`` and ``posterior`` for the timestamp text in ``value``.

    ``sources`` has one row per source (the name in ``source``) with its zone and declared date order; a source that
    is missing there, or null, has no zone and no order; of several rows of one source the least holds. ``reading`` is
    ``epoch``, ``single`` (a named month, or year, month, day), ``dmy``, ``mdy`` or ``ydm`` (chosen), ``ambiguous`` (no
    parse reaches CERTAIN), ``no_zone`` (no zone in the value, none known for the source) or ``unreadable``; only the
    first five have ``utc_us``. ``posterior`` is that of the chosen parse. Null, empty and blank values, impossible days
    or times and values without a full day are ``unreadable``. A repeated wall time means its first occurrence, a skipped
    one is read with the offset before the change. Rows are kept one to one, repeats included; other columns pass
    through, but for those that have a result's name or the prefix ``_t_``, which are replaced or left out.
    """
    p = lambda n: F.col("_t_" + n)
    known = sources.groupBy(F.col(source).alias("_t_src")).agg(F.min(F.struct(F.col(zone_col).alias("tz"), F.lower(F.col(order_col)).alias("order"))).alias("_t_said"))
    known = known.select("_t_src", F.col("_t_said.tz").alias("_t_tz"), F.col("_t_said.order").alias("_t_order"))
    tune(df.sparkSession)
    keep = [c for c in df.columns if c not in RESULT and not c.startswith("_t_")]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    # One row per source on both sides: their size follows the number of sources, and Spark's own size check picks the join.
    fields = read_fields(df, value).join(known, F.col(source) == p("src"), "left")
    weights = mixture_weights(fields, source, "_t_order").select(F.col(source).alias("_t_wsrc"), "w_dmy", "w_ymd")
    out = fields.join(weights, F.col(source).eqNullSafe(p("wsrc")), "left")

    def parse(a: str, b: str, w: Column) -> tuple[Column, Column]:
        """The parse chosen of two formats, ``ambiguous`` or null if there is none, and its posterior."""
        one = lambda w: w / (w + GARBLED)
        both = p(a).isNotNull() & p(b).isNotNull()
        post = F.when(both, F.when(p(a) == p(b), 1.0).otherwise(w)).when(p(a).isNotNull(), one(w)).when(p(b).isNotNull(), 1 - one(1 - w))
        chosen = (
            F.when(both, F.when(post >= CERTAIN, a).when(post <= 1 - CERTAIN, b).otherwise("ambiguous"))
            .when(p(a).isNotNull() & (post >= 0.5), a).when(p(b).isNotNull() & (post <= 0.5), b)
        )
        return chosen, F.greatest(post, 1 - post)

    (last, p_last), (first, p_first) = parse("dmy", "mdy", F.coalesce("w_dmy", F.lit(0.5))), parse("ymd", "ydm", F.coalesce("w_ymd", F.lit(0.5)))
    chosen = F.when(p("epoch").isNotNull(), "epoch").when(p("one").isNotNull(), "one").otherwise(F.coalesce(last, first, F.lit("unreadable")))
    out = settled(out, [*keep, "_t_epoch", "_t_zone", "_t_tz", *[f"_t_{c}" for c in WALLS.values()]], [chosen.alias("_t_reading"), F.coalesce(p_last, p_first, F.lit(1.0)).alias("_t_post")])
    zone = F.when(p("zone") == "", p("tz")).otherwise(p("zone"))
    out = out.withColumn("_t_at", F.when(zone.rlike(r"^[+-]") | zone.isin(known_zones()), zone))
    wall = F.coalesce(*[F.when(p("reading") == c, p(c)) for c in WALLS.values()])
    out = out.withColumn("_t_wall", wall)
    out = out.withColumn("_t_utc", F.coalesce(p("epoch"), F.when(p("wall").isNotNull() & p("at").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(p("wall")), p("at"))))))
    named = F.when(p("reading").isin("one", "ymd"), "single").otherwise(p("reading"))
    state = F.when(p("utc").isNull() & p("wall").isNotNull(), F.when(p("zone") == "", "no_zone").otherwise("unreadable")).otherwise(named)
    certain = F.when(p("utc").isNotNull(), F.when(p("reading").isin("epoch", "one"), 1.0).otherwise(p("post")))
    return settled(out, keep, [p("utc").alias("utc_us"), state.alias("reading"), certain.alias("posterior")])
