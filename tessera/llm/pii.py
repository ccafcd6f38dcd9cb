"""Personal data (2), in DataFrame functions only.

Base spans come from one expression per kind.  The method adds to them.  A
text is cut into units: words, values apart from a prefix glued to them
(``key=``), and runs of words that a base span or adjacent digits hold
together.  Units with a base span (or a key) in them are seeds; the units
around them induce lexical patterns; patterns and the identifier-like units
they surround form a graph.  Each round scores a pattern by the share of its
places in the whole corpus that hold a known identifier, and an instance by
the patterns around it.  Instances that high-confidence patterns surround and
no base span covers become spans.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import NON_WORD, WORD_GAP, stored

log = logging.getLogger(__name__)

#: The kinds in the order of their spans.
KINDS = ("email", "ip", "card", "phone", "key")
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
#: The expressions as Java runs them.  A run that fails from its first character
#: fails from all others, so a match starts where a run does, or where the last
#: match ended (``\\G``); possessive repeats keep the search linear.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KEY = "^(?=[A-Fa-f]*[0-9])(?=[0-9]*[A-Fa-f])[0-9A-Fa-f]{32,128}$"

#: Stands for each blank inside a unit, so positions stay (a code point that Unicode leaves to programs).
JOINT = "\ufdd0"
#: Blanks between words with digits on both sides, and cuts behind a glued prefix.
DIGIT_GAP = r"(?<=[0-9][A-Za-z]{0,4}[)]?)\x20(?=[(]?[A-Za-z]{0,4}[0-9])"
GLUE = "(?<=[A-Za-z\"'][:=])(?=[^:=])"

STEP = 256                 # elements summed at once by ``starts_at``
LEAST_CHARS, LEAST_DIGITS = 6, 4
MOST_ROUNDS = 64           # a bound against rounds that never settle; a chain of n patterns takes n + 1
LEAST_SUPPORT = 3          # different known identifiers that a pattern needs
LEAST_CONFIDENCE = 0.5
#: Borders of the parts in which places are counted, in 64ths of the corpus.
PARTS = (0, 1, 8, 64)


def let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def starts_at(lengths: Column, at: Column) -> Column:
    """Sums of the first ``i`` of ``lengths``, for each ``i`` in ``at``; adds
    up whole steps first, so long arrays cost no more than n * sqrt(n)."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda a, b: a + b)

    def inside(n: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(0), F.floor(F.size(n) / STEP).cast("int")),
                            lambda s: total(F.slice(n, s * STEP + 1, STEP)))

        def sums(steps: Column) -> Column:
            first = F.transform(steps, lambda _, s: total(F.slice(steps, 1, s)))
            return let(first, lambda f: F.transform(at, lambda i: F.get(f, F.floor(i / STEP).cast("int"))
                                                    + total(F.slice(n, F.floor(i / STEP).cast("int") * STEP + 1, i % STEP))))
        return let(steps, sums)
    return let(lengths, inside)


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def step(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)
    digit_sum = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + step(i))
    return digit_sum % 10 == 0


def valid(kind: str, x: Column) -> Column:
    """Whether a match of the kind's expression counts."""
    if kind == "ip":
        def small(p: Column) -> Column:
            n = F.regexp_replace(p, "^0+(?=.)", "")
            return F.when(F.length(n) > 3, F.lit(False)).otherwise(n.cast("int") <= 255)
        return F.forall(F.split(x, "[.]"), small)
    if kind == "card":
        return let(digits_of(x), luhn)
    if kind == "phone":
        return F.length(digits_of(x)).between(9, 15)
    return F.lit(True)


def spans_of(kind: str, text: Column) -> Column:
    """Array of (start, rank of the kind, end) of the base spans of a kind, in code points."""
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}[kind]
    rank = KINDS.index(kind)

    def place(found: Column) -> Column:
        n = F.size(found)

        def spans(gaps: Column) -> Column:
            both = F.transform(found, lambda m, i: F.length(m) + F.length(F.get(gaps, i)))
            starts = let(starts_at(both, F.sequence(F.lit(0), n - 1)), lambda s: F.transform(
                found, lambda m, i: F.struct(
                    (F.get(s, i) + F.length(F.get(gaps, i))).alias("start"), F.lit(rank).alias("kind"),
                    (F.get(s, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"), valid(kind, m).alias("ok"))))
            good = F.filter(starts, lambda s: s["ok"])
            return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
        return F.when(n > 0, let(F.split(text, pattern, -1), spans)).otherwise(no_spans())

    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(IP), "card": text.rlike(CARD),
           "phone": F.contains(text, F.lit("+"))}[kind]
    return F.when(may, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(no_spans())


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), "array<struct<start: int, kind: int, end: int>>")


def base_spans(text: Column) -> Column:
    """Base spans of all kinds by start, then kind."""
    return F.sort_array(F.concat(*[spans_of(k, text) for k in KINDS[:4]]))


def written(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


# --- the method ---------------------------------------------------------------

def plain(text: Column) -> Column:
    """A unit as patterns hold it: lower case, every digit as 0."""
    return F.translate(F.lower(text), "123456789", "000000000")


def contexts(w: Column, i: Column) -> Column:
    """Keys of the patterns around unit ``i`` of plain units: the two units
    before it, and the units on either side."""
    near = lambda k: F.get(w, i + k)
    return F.array(F.xxhash64(F.lit(0), near(-2), near(-1)), F.xxhash64(F.lit(1), near(-1), near(1)))


def joined(text: Column) -> Column:
    """The text with ``JOINT`` for the blanks inside phones and between adjacent words with digits."""
    def phones(found: Column) -> Column:
        whole = lambda gaps: F.concat(F.array_join(F.transform(
            found, lambda m, i: F.concat(F.get(gaps, i), F.translate(m, " ", JOINT))), ""), F.get(gaps, F.size(found)))
        return F.when(F.size(found) > 0, let(F.split(text, PHONE, -1), whole)).otherwise(text)
    found = F.regexp_extract_all(text, F.lit(PHONE), F.lit(0))
    return F.regexp_replace(F.when(F.contains(text, F.lit("+")), let(found, phones)).otherwise(text), DIGIT_GAP, JOINT)


def pieces(word: Column) -> Column:
    return F.when(word.rlike("[:=]."), F.split(word, GLUE)).otherwise(F.array(word))


def units(t: Column) -> Column:
    """Units of a joined text."""
    return F.flatten(F.transform(F.filter(F.split(t, WORD_GAP), lambda x: x != ""), pieces))


def identifiers(text: Column) -> Column:
    """Identifier-like units of a text, and such first words of runs: value, span, and the patterns around them."""
    def core(x: Column) -> Column:      # from the first letter, digit, plus or bracketed number to the last letter or digit
        return F.regexp_extract(x, r"(?:\((?=[0-9]+\)[^)]*[0-9]))?[A-Za-z0-9+](?:.*[A-Za-z0-9])?", 0)

    def long_enough(v: Column) -> Column:
        return (F.length(v) >= LEAST_CHARS) & (F.contains(v, F.lit("@")) | (F.length(digits_of(v)) >= LEAST_DIGITS))

    def may(x: Column) -> Column:
        return x.rlike("[0-9@]") & let(core(x), long_enough)

    def one(x: Column, start: Column, patterns: Column) -> Column:
        value = lambda v: F.struct(F.translate(v, JOINT, " ").alias("value"),
                                   (start + F.position(v, x) - 1).cast("int").alias("start"), patterns.alias("patterns"))
        return let(core(x), value)

    def both(x: Column, start: Column, patterns: Column) -> Column:
        """The unit, and the first word of a run, which the same two units precede."""
        first = F.substring_index(x, JOINT, 1)
        return F.when(F.contains(x, F.lit(JOINT)) & may(first), F.array(one(x, start, patterns), one(first, start, F.slice(patterns, 1, 1)))) \
                .otherwise(F.array(one(x, start, patterns)))

    def found(t: Column) -> Column:
        def of_units(w: Column) -> Column:
            def placed(at: Column) -> Column:
                def rows(gaps: Column) -> Column:
                    # length of each unit, and of the blanks in front of it
                    parts = F.flatten(F.transform(F.filter(F.split(t, WORD_GAP), lambda x: x != ""), lambda x, i: F.transform(
                        pieces(x), lambda p, k: F.struct(F.length(p).alias("n"), F.when(k == 0, F.length(F.get(gaps, i))).otherwise(0).alias("gap")))))
                    return let(parts, lambda g: let(
                        starts_at(F.transform(g, lambda x: x["n"] + x["gap"]), at), lambda s: F.flatten(F.transform(at, lambda i, k: both(
                            F.get(w, i), F.get(s, k) + F.get(g, i)["gap"],
                            contexts(F.transform(F.slice(w, F.greatest(i - 1, F.lit(1)), F.lit(4)), plain), F.least(i, F.lit(2))))))))
                return let(F.split(t, NON_WORD, -1), rows)
            at = F.filter(F.transform(w, lambda x, i: F.when(may(x), i)), lambda i: i.isNotNull())
            return let(at, lambda at: F.when(F.size(at) > 0, placed(at)))
        return let(units(t), of_units)
    return F.when(text.rlike("[0-9@]"), let(joined(text), found))


def seed_kind(value: Column) -> Column:
    """Rank of the kind of the first base span in a unit (a key is a whole
    unit), or null.  Runs of words are cards or phones only."""
    def holds(kind: str, pattern: str) -> Column:
        return value.rlike(pattern) & F.exists(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), lambda m: valid(kind, m))
    word = ~F.contains(value, F.lit(" "))
    return (F.when(word & F.contains(value, F.lit("@")) & holds("email", EMAIL), F.lit(0))
             .when(word & holds("ip", IP), F.lit(1))
             .when(holds("card", CARD), F.lit(2))
             .when(holds("phone", PHONE), F.lit(3))
             .when(value.rlike(KEY), F.lit(4)))


def discovered(docs: DataFrame, places: DataFrame, rounds: int = MOST_ROUNDS, support: int = LEAST_SUPPORT,
               confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(value, kind) of the instances that confident patterns surround, after
    the round that adds no new instance (``rounds`` at most; logged).

    ``places``: one row per identifier-like unit and pattern around it:
    value, pattern.  ``docs``: texts, to count all places of a pattern.
    """
    graph = stored(places.groupBy("pattern", "value").agg(F.count("*").alias("n")), "pii-graph")
    seeds = graph.select("value", seed_kind(F.col("value")).alias("kind")).filter("kind IS NOT NULL").distinct()
    seeds = stored(seeds.withColumn("score", F.lit(1.0)), "pii-seeds")
    known, accepted, counted = seeds, None, None
    for n in range(1, rounds + 1):
        hits = graph.join(known, "value").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("score")).alias("good"), F.count("*").alias("different"))
        hits = stored(hits.filter(F.col("different") >= support), "pii-hits")
        good, counted = confident(docs, hits, confidence, counted)
        miss = F.sum(F.log(F.lit(1.0) - F.least(F.lit(0.999), F.col("confidence"))))
        of_kind = graph.join(good, "pattern").filter(~F.contains("value", F.lit(" ")) | F.col("kind").isin(2, 3))   # runs: cards and phones
        by_kind = of_kind.groupBy("value", "kind").agg((1 - F.exp(miss)).alias("score"))
        best = by_kind.groupBy("value").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))
        accepted = best.filter(F.col("b.score") >= confidence) \
                       .select("value", (-F.col("b.k")).alias("kind"), F.round("b.score", 9).alias("score"))
        accepted = stored(accepted, "pii-accepted")
        found = stored(accepted.join(seeds, "value", "left_anti").select("value", "kind", "score"), "pii-found")
        if found.join(known, "value", "left_anti").isEmpty():
            log.info("personal data: settled after round %d", n)
            break
        known = seeds.union(found)
    else:
        log.warning("personal data: round %d, the last, still added instances", rounds)
    return accepted.select("value", "kind")


def confident(docs: DataFrame, hits: DataFrame, confidence: float, counted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) of the hits whose share of all places of
    their pattern reaches ``confidence``, and (pattern, places) of all patterns
    counted so far; ``counted`` has those of earlier rounds.

    Places are counted part by part over the whole corpus.  A pattern whose
    places so far already rule it out is not looked for in the later parts,
    so common word pairs cost one small part and the result is exact."""
    enough = F.col("good") >= confidence * F.col("places")
    new = hits if counted is None else hits.join(counted, "pattern", "left_anti")
    left = new.withColumn("places", F.lit(0).cast("long"))
    part = F.pmod(F.xxhash64("text"), F.lit(PARTS[-1]))
    for lo, hi in zip(PARTS, PARTS[1:]):
        if left.isEmpty():
            break
        more = pattern_places(docs.filter((part >= lo) & (part < hi)), left.select("pattern").distinct())
        left = left.join(more.withColumnRenamed("places", "more"), "pattern", "left") \
                   .withColumn("places", F.col("places") + F.coalesce("more", F.lit(0))).drop("more")
        left = stored(left.filter(enough), "pii-places")
    whole = left.select("pattern", "places").distinct()
    if counted is not None:
        left = left.unionByName(hits.join(counted, "pattern").filter(enough))
        whole = stored(counted.union(whole), "pii-counted")
    return left.select("pattern", "kind", F.least(F.lit(1.0), F.col("good") / F.greatest("places", F.lit(1))).alias("confidence")), whole


def pattern_places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(pattern, places) over every unit of every text, for the given patterns."""
    w = F.transform(units(joined(F.col("text"))), plain)
    keys = let(w, lambda p: F.flatten(F.transform(p, lambda _, i: contexts(p, i))))
    return docs.select(F.explode(keys).alias("pattern")).join(patterns, "pattern") \
               .groupBy("pattern").agg(F.count("*").alias("places"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = MOST_ROUNDS,
                  support: int = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """Per row of ``docs``: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone``
    (base spans), ``base_sha256``, ``spans`` (all spans), ``n_found`` (spans
    that the method adds; kinds as above, or ``key`` for secret keys).

    Positions count code points, ends are exclusive.  Null texts count as
    empty: no spans, and the digest of the empty string.  Rows are told apart
    by place, so ids may repeat or be null.  Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = stored(texts.select(F.monotonically_increasing_id().alias("row"), "id", base_spans(F.col("text")).alias("base"),
                               identifiers(F.col("text")).alias("words")), "pii-rows")
    at = rows.filter("words IS NOT NULL").select("row", "base", F.explode("words").alias("w")) \
             .select("row", "base", "w.value", "w.start", (F.col("w.start") + F.length("w.value")).alias("end"), "w.patterns")
    places = at.select("value", F.explode("patterns").alias("pattern"))
    names = discovered(texts, places, rounds, support, confidence)
    free = ~F.exists("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    more = at.filter(free).join(names, "value").select("row", F.struct("start", "kind", "end").alias("s"))
    # a first word lies inside its run and starts with it: the longest from each start stays
    more = more.groupBy("row", "s.start").agg(F.max_by("s", "s.end").alias("s"))
    more = more.groupBy("row").agg(F.sort_array(F.collect_list("s")).alias("more"))
    out = rows.select("row", "id", "base").join(more, "row", "left")
    more_or_none = F.coalesce("more", no_spans())
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("bigint")
    return out.select(F.col("id").alias(id_col), *[count(k).alias(f"n_{k}") for k in KINDS[:4]],
                      F.sha2(written(F.col("base")), 256).alias("base_sha256"),
                      written(F.sort_array(F.concat("base", more_or_none))).alias("spans"),
                      F.size(more_or_none).cast("bigint").alias("n_found"))
