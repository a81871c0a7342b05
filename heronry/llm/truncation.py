"""Text cut off by field limits: length hazards per source, and places at which complete texts do not end.

The chance that a text of a source stops at a length, given that it got that far, is a discrete hazard; window
functions give it for every length in characters and in bytes. A field limit lifts the hazard of one length far above
that of its neighbours; every length is tested against them and the false-discovery rate is held over all sources and
lengths. Limits that fall back to the last whole word are sought in bands of BAND lengths, by the hazard of incomplete
endings alone.

What an ending looks like is its *form*, told from punctuation, brackets and line breaks only (``forms``). What a form
means is learned from each source: one pseudo-random place of every text shows what a cut at any place would look like,
and a form's relative hazard is how often texts end in it against how often they pass through it. Complete endings are
passed rarely and ended in often; a break in transfer is the other way round.

* At a significant length, endings that look unfinished are cut, and others without a sentence end too if that length
  cuts (``judge``), unless they are more frequent there than cuts at random places could make them.
* At any other length an ending that looks unfinished is a break in transfer if such endings have a relative hazard of
  at most DEPLETED in its source, and its own form is not one that the source's texts end in ENRICHED times as often as
  they pass through it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronry.session import materialise, settled, tune

#: Lengths on either side that a length is tested against, the false-discovery rate, and texts a limit needs at least.
NEIGHBOURS = 25
FDR = 0.01
LEAST = 5
#: A hazard this many times that of its neighbours is a limit; the neighbours are taken narrowly and widely, the larger hazard counts.
EXCESS, NARROW = 3.0, 3
#: Lengths of a band; bands begin at multiples of it and halfway between them.
BAND = 16
#: Relative hazard up to which unfinished forms are ones that complete texts of the source do not end in.
DEPLETED = 0.5
#: What is taken for the relative hazard of an unfinished form, and with the weight of how many places, before anything is seen.
PRIOR, WEIGHT = 0.1, 10.0
#: A form this many times as frequent among endings as at random places is the texts' doing, not a cut's.
ENRICHED = 3.0
#: A length cuts if it has this share of the unfinished endings that random places would give, or if nearly no text goes beyond it and at most half of all end there.
CUTTING, CEILING = 0.5, 0.95
#: Most characters that marks of an omission, or what closes a sentence, can take at the very end.
MARK_SPAN = 64

#: White space of any script, and what takes no space at all.
_BLANK = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFEFF)))
#: What may stand after a break to say that something was left out; sentence ends; what may follow one.
_OMISSION = r"(?:…|\.\.\.+|\ufffd|[\[(<{]\s*(?:…|\.\.\.+|(?i:truncated|clipped|cut(?: off)?|continued|cont(?:inue|'d|\.)?|more|read more|snip(?:ped)?|omitted|abridged|shortened|elided|trimmed|text truncated))\.{0,3}\s*[\])>}]|(?i:read more)\.{0,3})"
_MARKS = rf"(?:\s*{_OMISSION})+\s*$"
_STOP = r"[.!?。！？؟।][\"'”’»›)\]*_`\s]*$"
_ABBREVIATION = r"(?:^|[\s(])(?:e\.g|i\.e|cf|vs|et al|Figs?|Eqs?|Sec|Tab|resp|approx|z\.B|bzw|p\.ej)\.$"
#: A sentence end within a line, after more than an abbreviation or an initial, with something behind it.
_WITHIN = r"(?:[\p{L}\p{N}][\p{L}\p{N}%$}][\p{L}\p{N}%$})\]]|[)\]}%$*_`\"”»]|\d)[.!?][\"'”’»)\]]*\s+\S|[。！？]\s*\S"
#: A line that says what it is: a bullet, number, bracket, heading, rule or indent, or a label of up to three words.
_LABELLED = r"^(?:[^\p{L}\p{N}(\"'“‘«¿¡\\$]|\d{1,3}[.)]\s|\\[a-z]+\*?\{|\p{L}[\p{L}\p{N}_-]{0,24}(?: [\p{L}\p{N}_.-]{1,12}){0,2} ?[:：]\s?\S)"
_HANGING = r"[,;:(\[{\\=+&-]$"
_CLOSED_BLOCK = r"(?:```|\\end\{[A-Za-z]+\*?\}|</[A-Za-z][A-Za-z0-9]*>)$"
_RECORD = r"^\s*(?:\w{1,20}: ?)?[\[{]\s*[\"{\[]"

#: Forms that look unfinished; those that may be complete; all others are complete.
UNFINISHED = ("marked", "inside", "hanging", "running", "lead")
DOUBTFUL = ("labelled", "block", "title", "number")


def _times(c: Column, what: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))


def forms(df: DataFrame, text: str, following: str | None = None) -> DataFrame:
    """Adds ``form`` to every row, of the whole text without outer white space and without marks of omission at its end.

    ``blank`` (null or nothing), ``closed`` (a sentence end, or the end of a record, table row, formula or block),
    ``number`` (a sentence end that may be the point of a number), ``marked`` (no sentence end, but a mark of
    omission), ``inside`` (an unclosed bracket, record, formula or block), ``hanging`` (punctuation that wants more),
    ``running`` (words behind a sentence end within the last line, or behind a record there), ``labelled`` (a last line
    that begins with a bullet, number, bracket or label), ``lead`` (a line of its own below earlier text), ``block`` (the last of several lines),
    ``title`` (one line that is the whole text). With ``following``, the character behind a place within a text,
    ``number`` is kept for places where it is a digit.
    """
    tune(df.sparkSession)
    keep = df.columns
    b, line, record, end = F.col("_body"), F.col("_line"), F.col("_record"), F.col("_end")
    t, blank = F.col(text), F.lit(_BLANK)
    # Only the tail is trimmed, unless it is nothing but blanks: trimming a whole text by a set of characters is slow.
    df = df.withColumn("_tail", F.right(t, F.lit(MARK_SPAN))).withColumn("_trimmed", F.rtrim("_tail", blank))
    df = df.withColumn("_off", F.length("_tail") - F.length("_trimmed")).withColumn("_mark", F.length(F.regexp_extract("_trimmed", _MARKS, 0)))
    short = F.when(F.col("_trimmed") == "", F.rtrim(t, blank)).otherwise(F.left(t, F.length(t) - F.col("_off")))
    df = df.withColumn("_bare", F.when((F.col("_trimmed") == "") | (F.col("_off") > 0) & (F.col("_mark") == 0), short).otherwise(t))
    # A tail of blanks alone hides the marks before it; they are looked for again.
    df = df.withColumn("_mark", F.when(F.col("_trimmed") == "", F.length(F.regexp_extract(F.right("_bare", F.lit(MARK_SPAN)), _MARKS, 0))).otherwise(F.col("_mark") + F.when(F.col("_mark") > 0, F.col("_off")).otherwise(0)))
    df = df.withColumn("_body", F.when(F.col("_mark") > 0, F.rtrim(F.left("_bare", F.length("_bare") - F.col("_mark")), blank)).otherwise(F.col("_bare")))
    df = df.withColumn("_end", F.when((F.col("_mark") == 0) & (F.col("_trimmed") != ""), F.col("_trimmed")).otherwise(F.right(b, F.lit(MARK_SPAN)))).withColumn("_line", F.substring_index(b, "\n", -1)).withColumn("_para", F.substring_index(b, "\n\n", -1))
    df = df.withColumn("_record", F.when(line.rlike(_RECORD), line).when(F.col("_para").rlike(_RECORD), F.col("_para")))
    more = lambda c, a, z: _times(c, a) > _times(c, z)
    opened = lambda a, z: F.substring_index(line, z, -1).contains(a)
    unclosed = (
        b.contains("\\begin{") & ~F.substring_index(b, "\\begin{", -1).contains("\\end{")
        | b.contains("```") & (_times(b, "```") % 6 == 3)
        | F.coalesce(more(record, "{", "}") | more(record, "[", "]"), F.lit(False))
    )
    behind = F.lit(True) if following is None else F.col(following).rlike(r"^\d")
    form = (
        F.when(F.coalesce(b, F.lit("")) == "", "blank")
        .when(unclosed, F.when(F.col("_mark") > 0, "marked").otherwise("inside"))
        .when(end.rlike(_STOP), F.when(end.rlike(_ABBREVIATION), F.when(F.col("_mark") > 0, "marked").otherwise("hanging")).when(end.rlike(r"(?:^|\s)\d{1,3}\.$") & behind, "number").otherwise("closed"))
        .when(end.rlike(_CLOSED_BLOCK) | (record.isNotNull() & end.rlike(r"[}\]]$")) | line.rlike(r"^\|.*\|$"), "closed")
        .when(F.col("_mark") > 0, "marked")
        .when(line.startswith("|") | opened("(", ")") | opened("[", "]") | opened("{", "}"), "inside")
        .when(end.rlike(_HANGING), "hanging")
        .when((record.isNotNull() | ~line.rlike(_LABELLED)) & line.rlike(_WITHIN), "running")
        .when(line.rlike(_LABELLED), "labelled")
        .when(~b.contains("\n"), "title")
        .when(F.col("_para").contains("\n") | ~line.rlike(r"\s\p{Ll}|\p{Lo}"), "block")
        .otherwise("lead")
    )
    return settled(df, keep, [form.alias("form")])


def hazards(lengths: DataFrame) -> DataFrame:
    """Hazard of every (source, unit, length): n_ended, n_reached, hazard, expected, p_value.

    ``lengths`` has (source, unit, length, event) per text: a text whose ``event`` is false reaches its length and
    leaves without the event. It is pre-aggregated, so that windows run over at most as many rows as there are lengths.
    ``expected`` is the pooled hazard of the lengths near by on both sides; the p-value is the Chernoff bound of the
    binomial tail, which is never below the exact one.
    """
    counts = lengths.groupBy("source", "unit", "length").agg(F.count_if("event").alias("n_ended"), F.count("*").alias("_left"))
    w = Window.partitionBy("source", "unit").orderBy("length")
    reached = counts.withColumn("n_reached", F.sum("_left").over(w.rowsBetween(0, Window.unboundedFollowing)))
    # Lengths at which no text ends have no row, yet texts reach them: a row stands for the gap before it too.
    gap = F.least(F.col("length") - F.coalesce(F.lag("length").over(w), F.col("length") - 1), F.lit(NEIGHBOURS))
    reached = reached.withColumn("_exposed", F.col("n_reached") * gap)

    def pooled(reach: int) -> Column:
        near = lambda c: F.coalesce(F.sum(c).over(w.rangeBetween(-reach, -1)), F.lit(0)) + F.coalesce(F.sum(c).over(w.rangeBetween(1, reach)), F.lit(0))
        # Half an event more than seen: at the outermost lengths there are few neighbours to learn from.
        return (near("n_ended") + 0.5) / (near("_exposed") + 1.0)

    both = reached.withColumn("_h", F.least(F.greatest(pooled(NEIGHBOURS), pooled(NARROW)), F.lit(1.0)))
    q, h = F.col("n_ended") / F.col("n_reached"), F.col("_h")
    kl = F.when(q >= 1, -F.ln(h)).otherwise(q * F.ln(q / h) + (1 - q) * F.ln((1 - q) / (1 - h)))
    p = F.when((q > h) & (h < 1), F.exp(-F.col("n_reached") * kl)).otherwise(1.0)
    return both.select("source", "unit", "length", "n_ended", "n_reached", q.alias("hazard"), h.alias("expected"), p.alias("p_value"))


def significant(tested: DataFrame) -> DataFrame:
    """Lengths whose hazard is significant at a false-discovery rate of FDR (Benjamini and Hochberg over all tests).

    The step-up threshold is found on a histogram of -log10(p), whose bins stand for their largest p-value, so no
    ordering of all tests in one task is needed; it is never laxer than the exact one.
    """
    bins = 40
    b = F.least(F.floor(-F.log10(F.greatest("p_value", F.lit(1e-300))) * bins), F.lit(300 * bins)).cast("int")
    binned = tested.withColumn("_bin", b)
    hist = binned.groupBy("_bin").agg(F.count("*").alias("n"))
    down = Window.orderBy(F.col("_bin").desc())  # at most 12,001 rows
    total = F.sum("n").over(Window.partitionBy())
    ranked = hist.select("_bin", F.sum("n").over(down).alias("rank"), total.alias("m"))
    cut = ranked.filter(F.pow(F.lit(10.0), -F.col("_bin") / F.lit(float(bins))) <= FDR * F.col("rank") / F.col("m")).agg(F.min("_bin").alias("_cut"))
    return binned.crossJoin(F.broadcast(cut)).filter((F.col("_bin") >= F.col("_cut")) & (F.col("n_ended") >= LEAST) & (F.col("hazard") >= EXCESS * F.col("expected"))).drop("_bin", "_cut")


def measured(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, form, passed, chars, bytes, copy) of every text that is not blank, read once.

    ``passed`` is the form of a pseudo-random place within the text (null for texts of one character), ``copy`` a hash
    of the text: copies have the same place.
    """
    t = F.col("text")
    one = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), t.alias("text") if text == "text" else F.col(text).alias("text"))
    n = F.length(t)
    place = (F.pmod(F.xxhash64(t, F.lit("place")), n - 1) + 1).cast("int")
    one = settled(one, ["key", "source", "text"], [n.alias("chars"), F.octet_length(t).alias("bytes"), F.xxhash64(t).alias("copy"), F.when(n > 1, place).alias("place")])
    one = settled(one, ["key", "source", "text", "chars", "bytes", "copy"], [F.when(F.col("place").isNotNull(), F.left("text", F.col("place"))).alias("before"), F.expr("substring(text, place + 1, 1)").alias("next")])
    one = forms(one, "text").withColumnRenamed("form", "_own")
    one = forms(one, "before", "next")
    return one.filter("_own <> 'blank'").select("key", "source", F.col("_own").alias("form"), F.col("form").alias("passed"), "chars", "bytes", "copy")


def texts(found: DataFrame) -> DataFrame:
    """The different texts of each source: copies of one text say nothing more about lengths and forms, and count once."""
    return found.select("source", "form", "passed", "chars", "bytes", "copy").distinct()


def limits(found: DataFrame) -> DataFrame:
    """The significant lengths of every source of ``measured`` texts, by unit: ``chars`` and UTF-8 ``bytes``, and bands
    (``length`` is where the band begins) of BAND of them, for which only unfinished endings are events.
    """
    half = BAND // 2
    bands = ", ".join(f"'{u}+{o}', cast(floor(({u} + {o}) / {BAND}) as int)" for u in ("chars", "bytes") for o in (0, half))
    each = found.select("source", F.col("form").isin(*UNFINISHED).alias("_broken"), F.expr(f"stack(6, 'chars', chars, 'bytes', bytes, {bands}) as (unit, length)"))
    each = each.select("source", "unit", "length", (F.col("_broken") | ~F.col("unit").contains("+")).alias("event"))
    return significant(hazards(each))


def located(found: DataFrame, lim: DataFrame) -> DataFrame:
    """``found`` with ``unit`` and ``length`` of the significant length it ends at, if any: characters before bytes before bands.

    The significant lengths of a source are one row, so that each text meets one row; their number is bounded by the
    lengths that texts have, whatever the number of texts.
    """
    half = BAND // 2
    at = [("chars", F.col("chars")), ("bytes", F.col("bytes"))] + [(f"{u}+{o}", F.floor((F.col(u) + o) / BAND)) for u in ("chars", "bytes") for o in (0, half)]
    name = lambda unit, length: F.concat(unit, F.lit(" "), length.cast("string"))
    per_source = lim.groupBy(F.col("source").alias("_ls")).agg(F.collect_set(name(F.col("unit"), F.col("length"))).alias("_known"))
    spots = [F.when(F.array_contains("_known", name(F.lit(u), c)), F.struct(F.lit(u).alias("unit"), c.cast("int").alias("length"))) for u, c in at]
    met = found.join(per_source, F.col("source").eqNullSafe(F.col("_ls")), "left").withColumn("_at", F.coalesce(*spots))
    return met.select(*found.columns, "_at.unit", "_at.length")


def judge(found: DataFrame, lim: DataFrame) -> DataFrame:
    """Which forms are cut where: (source, unit, length, form, n, share, places, relative_hazard, cut).

    ``found`` are the different texts, ``located``. Unit and length are null for all lengths that are not significant.
    ``places`` is the share of the form among random places of the source, ``share`` that among the endings of the
    cell. A mark of omission behind an unfinished ending needs no further evidence.
    """
    of_cell, of_source = Window.partitionBy("source", "unit", "length"), Window.partitionBy("source")
    broken = F.col("form").isin(*UNFINISHED)
    ends = found.groupBy("source", "unit", "length", "form").agg(F.count("*").alias("n"))
    passed = found.filter("passed is not null and passed <> 'blank'").groupBy("source", "passed").agg(F.count("*").alias("_passed"))
    passed = passed.select(
        F.col("source").alias("_ps"), F.col("passed").alias("_pf"), "_passed", F.sum("_passed").over(of_source).alias("_all"),
        F.sum(F.when(F.col("passed").isin(*UNFINISHED), F.col("_passed")).otherwise(0)).over(of_source).alias("_passed_broken"),
    )
    every = passed.select(F.col("_ps").alias("_as"), "_all", "_passed_broken").distinct()
    ends = (
        ends.withColumn("_cell", F.sum("n").over(of_cell)).withColumn("_texts", F.sum("n").over(of_source))
        .withColumn("_broken", F.sum(F.when(broken, F.col("n")).otherwise(0)).over(of_cell))
        .withColumn("_else", F.sum(F.when(F.col("unit").isNull(), F.col("n")).otherwise(0)).over(of_source))
        .withColumn("_form_else", F.sum(F.when(F.col("unit").isNull(), F.col("n")).otherwise(0)).over(Window.partitionBy("source", "form")))
        .join(every, F.col("source").eqNullSafe(F.col("_as")), "left")
        .join(passed.select("_ps", "_pf", "_passed"), F.col("source").eqNullSafe(F.col("_ps")) & (F.col("form") == F.col("_pf")), "left")
        .withColumn("_passed", F.coalesce("_passed", F.lit(0))).withColumn("_places", F.col("_passed") / F.col("_all"))
    )
    # What a form's relative hazard is over all sources is what a source's own is drawn to while it has few texts.
    over_all = (
        ends.filter("unit is null").groupBy(F.col("form").alias("_f"))
        .agg(((F.sum("n") + PRIOR * WEIGHT) / (F.sum(F.col("_cell") * F.coalesce("_places", F.lit(0.0))) + WEIGHT)).alias("_usual"))
    )
    of_lim = lim.select(F.col("source").alias("_ls"), F.col("unit").alias("_lu"), F.col("length").alias("_ll"), "hazard", "expected")
    ends = ends.join(over_all, F.col("form") == F.col("_f"), "left").join(
        of_lim, F.col("source").eqNullSafe(F.col("_ls")) & (F.col("unit") == F.col("_lu")) & (F.col("length") == F.col("_ll")), "left"
    )
    relative = (F.col("n") + WEIGHT * F.coalesce("_usual", F.lit(PRIOR))) / (F.col("_cell") * F.coalesce("_places", F.lit(0.0)) + WEIGHT)
    spread = F.coalesce("_places", F.lit(0.0))
    # The unfinished forms of a source are judged together: where in its texts a transfer breaks is not evenly spread.
    at_rest = F.when(F.col("unit").isNull() & broken & (F.col("form") != "marked"), F.col("n")).otherwise(0)
    unfinished = (F.sum(at_rest).over(of_source) + WEIGHT * PRIOR) / (F.col("_else") * F.coalesce(F.col("_passed_broken") / F.col("_all"), F.lit(0.0)) + WEIGHT)
    cuts = (F.col("_broken") / F.col("_cell") >= CUTTING * F.col("_passed_broken") / F.col("_all")) & (F.col("_broken") > 0) | (
        (F.col("hazard") >= CEILING) & (F.col("_cell") <= F.col("_texts") / 2)
    )
    by_limit = (
        F.col("unit").isin("chars", "bytes") & cuts & (F.col("n") <= ENRICHED * spread * F.col("_cell"))
        & ((F.col("hazard") - F.col("expected")) * spread >= F.col("expected") * F.col("_form_else") / F.greatest("_else", F.lit(1)))
    )
    ends = ends.withColumn("_unfinished", unfinished)
    cut = (
        F.when(F.col("form") == "marked", True)
        .when(broken, F.col("unit").isNotNull() | ((F.col("_unfinished") <= DEPLETED) & (relative < ENRICHED)))
        .when(F.col("form").isin(*DOUBTFUL), F.coalesce(by_limit, F.lit(False)))
        .otherwise(False)
    )
    return ends.select("source", "unit", "length", "form", "n", (F.col("n") / F.col("_cell")).alias("share"), F.col("_places").alias("places"), relative.alias("relative_hazard"), cut.alias("cut"))


def _judged(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Limits, and what ``judge`` says of every source, place and form; both are small and wanted more than once."""
    one = materialise(texts(found))
    lim = materialise(limits(one))
    return lim, materialise(judge(located(one, lim), lim))


def truncated(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """(key, source, how) of every text that breaks off: ``how`` is ``limit`` at a significant length, else ``transfer``.

    Null and blank texts are never truncated. A null source is a source of its own. Rows with equal keys or texts are
    judged each on their own and all kept. The texts are read once; what the tests need of them is checkpointed.
    """
    found = materialise(measured(docs, key, text, source))
    lim, said = _judged(found)
    said = said.filter("cut").select(F.col("source").alias("_js"), F.col("unit").alias("_ju"), F.col("length").alias("_jl"), F.col("form").alias("_jf"))
    same = F.col("source").eqNullSafe(F.col("_js")) & F.col("unit").eqNullSafe(F.col("_ju")) & F.col("length").eqNullSafe(F.col("_jl")) & (F.col("form") == F.col("_jf"))
    out = located(found, lim).join(said, same, "left_semi")
    return out.select(F.col("key").alias(key), F.col("source").alias(source), F.when(F.col("unit").isNotNull(), "limit").otherwise("transfer").alias("how"))


def evidence(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """What ``judge`` found of the documents."""
    return _judged(materialise(measured(docs, key, text, source)))[1]


def rates(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """Per source: texts (blank ones included), truncated at a limit, in transfer, and the rate of both."""
    cut = truncated(docs, key, text, source).groupBy(source).agg(F.count_if(F.col("how") == "limit").alias("at_limit"), F.count_if(F.col("how") == "transfer").alias("in_transfer"))
    every = docs.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("n_docs"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    both = every.join(cut, F.col("_s").eqNullSafe(F.col(source)), "left").select(F.col("_s").alias(source), "n_docs", zero("at_limit"), zero("in_transfer"))
    return both.withColumn("rate", F.round((F.col("at_limit") + F.col("in_transfer")) / F.col("n_docs"), 6))
