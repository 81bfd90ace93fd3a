"""Personal data by weak supervision, with DataFrame functions only.

Base rules find e-mail addresses, IP addresses, payment cards and phone numbers. Finer patterns propose further candidates,
such as a phone number that runs into a card number, which a base rule takes as one invalid match. Labelers vote
on each candidate (1 yes, -1 no, 0 abstains): form, validity, gazetteer, context and neighbouring characters. Votes are
counted by pattern; there are at most a few thousand patterns, whatever the input. Expectation-maximisation
over the pattern table estimates the labelers' reliabilities and each pattern's probability, and a logistic
classifier is trained on these. Candidates that it accepts are added to the base spans; base spans always stay.

Spans are in code points, end exclusive. Null text is read as empty and has no span. Without any candidate the
starting weights are kept. Rows are judged one by one, so repeated rows and rows without doc_id give a row each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("form", "validity", "gazetteer", "context", "neighbours")
#: Candidates from this probability on are personal data.
ACCEPT = 0.5
EM_STEPS, FIT_STEPS, FIT_RATE, FIT_PULL = 30, 150, 2.0, 1e-3

# Base rules. A run that can't start a match is entered at its start only (lookbehind, or \G after a match), which
# finds the same matches as trying every character, in linear time; possessive repeats need no stack.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # Shorter runs fail anyway; leaving them to the pattern keeps texts full of numbers cheap.
    "card": r"[0-9](?:[ -]?[0-9]){15,}+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: Cheap tests that any match of the base rule, or of the candidate pattern, passes.
BASE_GATE = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){15}", "phone": r"\+[0-9]"}
GATE = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[ -]?[0-9]){12}", "phone": r"[0-9][ .)-]{1,2}[0-9]{2,4}[ .-]?[0-9]"}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|[\[(]at[\])]) ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}|[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
# Canonical forms, gazetteers and context words of the labelers.
FORM = {
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$",
    "card": r"^([0-9]{15,16}|[0-9]{4}( [0-9]{4}){3}|[0-9]{4}(-[0-9]{4}){3})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}$",
}
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|at|ch)$",
    "ip": r"^([1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(4|5[1-5]|2[2-7]|3[47]|35|6011|65)",
    "phone": r"^(\+(1|33|34|39|41|43|44|49)|\(?[2-9])",
}
POSITIVE = {
    "email": r"(?i)(e-?mail|contact|write|kontakt|correo|courriel|@)",
    "ip": r"(?i)(\bip\b|host|server|address|adresse|from)",
    "card": r"(?i)(card|visa|credit|karte|carte|tarjeta|pay)",
    "phone": r"(?i)(phone|\btel|call|fax|mobile|telefon|téléphone|llam)",
}
NEGATIVE = r"(?i)(version|\bv\.?|isbn|order|invoice|\bref|\bno\.|section|chapter|figure|page|build)\W*$"


#: Items whose results are gathered at once below.
RUN = 256


def _running(items: Column, kind: str, result: Callable[[Column, Column], Column], after: Callable[[Column, Column], Column]) -> Column:
    """result(state, item) of each item in order, where the state starts at 0 and becomes after(state, item).

    Arrays grow by copying, so results are gathered in stretches of RUN items, which keeps long arrays cheap.
    """
    none = F.array().cast(f"array<{kind}>")
    stretches = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda b: F.slice(items, b * RUN + 1, F.lit(RUN)))

    def step(state: Column, item: Column) -> Column:
        return F.struct(after(state["at"], item).alias("at"), F.concat(state["out"], F.array(result(state["at"], item))).alias("out"))

    def stretch(state: Column, some: Column) -> Column:
        inner = F.aggregate(some, F.struct(state["at"].alias("at"), none.alias("out")), step)
        # A one-element array stands for a local name.
        return F.element_at(F.transform(F.array(inner), lambda i: F.struct(
            i["at"].alias("at"), F.concat(state["out"], F.array(i["out"])).alias("out"))), 1)

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return F.when(F.size(items) > 0, F.aggregate(stretches, start, stretch, lambda s: F.flatten(s["out"]))).otherwise(none)


def _matches(text: Column, pattern: str, gate: str) -> Column:
    """Array of (start, end, found) of the pattern's matches, from the lengths of what lies between and in them.

    Texts in which `gate` finds nothing have none.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pieces = F.zip_with(found, between, lambda f, b: F.struct(F.length(b).cast("long").alias("skip"), F.length(f).cast("long").alias("n"), f.alias("found")))
    span = "struct<start:bigint,end:bigint,found:string>"

    def placed(at: Column, piece: Column) -> Column:
        begin = at + piece["skip"]
        return F.struct(begin.alias("start"), (begin + piece["n"]).alias("end"), piece["found"].alias("found"))

    spans = _running(pieces, span, placed, lambda at, piece: at + piece["skip"] + piece["n"])
    return F.when(text.rlike(gate), spans).otherwise(F.array().cast(f"array<{span}>"))


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def valid(kind: str, found: Column) -> Column:
    """The base rule's own condition."""
    if kind == "ip":
        return F.forall(F.split(found, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        return F.length(digits(found)).between(16, 19) & F.call_function("luhn_check", digits(found))
    if kind == "phone":
        return F.length(digits(found)).between(8, 15)
    return F.lit(True)


def _votes(kind: str, c: Column, text: Column) -> Column:
    """Votes of the labelers on a candidate, in their order."""
    found = c["found"]
    before = F.substring(text, F.greatest(c["start"] - 23, F.lit(1)).cast("int"), F.least(c["start"], F.lit(24)).cast("int"))
    last = F.substring(text, c["start"].cast("int"), F.when(c["start"] > 0, 1).otherwise(0))
    after = F.substring(text, (c["end"] + 1).cast("int"), F.lit(1))
    sound = {
        "email": found.rlike(r"^[^.].*[^.][ ]?(@|.at.)") & ~found.contains(".."),
        "ip": valid("ip", found),
        "card": F.coalesce(F.call_function("luhn_check", digits(found)), F.lit(False)),
        "phone": F.length(digits(found)).between(9, 15),
    }[kind]
    return F.array(
        F.when(found.rlike(FORM[kind]), 1).otherwise(-1),
        F.when(sound, 1).otherwise(-1),
        F.when(F.when(F.lit(kind == "card"), digits(found)).otherwise(found).rlike(GAZETTEER[kind]), 1).otherwise(-1),
        F.when(before.rlike(NEGATIVE), -1).when(before.rlike(POSITIVE[kind]), 1).otherwise(0),
        F.when(last.rlike(r"[\p{L}0-9_]") | after.rlike(r"[\p{L}0-9_]"), -1).otherwise(1),
    )


def _features(kind: Column, votes: Column, size: Column) -> Column:
    """Inputs of the classifier: votes, kind, size of the span, constant."""
    of_kind = F.transform(F.sequence(F.lit(0), F.lit(len(KINDS) - 1)), lambda k: F.when(k == kind, 1.0).otherwise(0.0))
    return F.concat(votes.cast("array<double>"), of_kind, F.array(size / 4.0, F.lit(1.0)))


N_FEATURES = len(LABELERS) + len(KINDS) + 2


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def _size(c: Column) -> Column:
    """Size class of a span, 0 to 4."""
    return F.least(F.floor((c["end"] - c["start"]) / 6), F.lit(4)).cast("int")


def proposals(text: Column) -> Column:
    """Array of the candidates (kind, start, end, votes, size)."""

    def of_kind(k: int, kind: str) -> Column:
        return F.transform(_matches(text, CANDIDATES[kind], GATE[kind]), lambda c: F.struct(
            F.lit(k).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _votes(kind, c, text).alias("votes"), _size(c).alias("size")))

    return F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])


def estimate(patterns: Column) -> Column:
    """Patterns with probability `q`, by expectation-maximisation.

    A labeler says yes to personal data with probability a, to other candidates with probability b; kinds have a prior each.
    """
    labelers, kinds = F.sequence(F.lit(0), F.lit(len(LABELERS) - 1)), F.sequence(F.lit(0), F.lit(len(KINDS) - 1))

    def likelihood(x: Column, rate: Column, prior: Column) -> Column:
        terms = F.zip_with(x["votes"], rate, lambda v, p: F.when(v > 0, F.log(p)).when(v < 0, F.log(1 - p)).otherwise(0.0))
        return F.aggregate(terms, F.log(prior), lambda s, t: s + t)

    def judged(s: Column) -> Column:
        return F.transform(patterns, lambda x: F.struct(
            x["n"].alias("n"), x["kind"].alias("kind"), x["votes"].alias("votes"), x["size"].alias("size"),
            _sigmoid(likelihood(x, s["a"], F.element_at(s["p"], x["kind"] + 1)) - likelihood(x, s["b"], 1 - F.element_at(s["p"], x["kind"] + 1))).alias("q")))

    def total(rows: Column, weight: object) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, x: s + weight(x))

    def rate(rows: Column, l: Column, weight: object, start: float) -> Column:
        """Share of yes among a labeler's votes; ten imagined votes keep it near its start."""
        yes = total(rows, lambda x: F.when(F.element_at(x["votes"], l + 1) > 0, weight(x)).otherwise(0.0))
        cast = total(rows, lambda x: F.when(F.element_at(x["votes"], l + 1) != 0, weight(x)).otherwise(0.0))
        return (yes + 10 * start) / (cast + 10)

    def better(rows: Column) -> Column:
        return F.struct(
            F.transform(kinds, lambda k: (total(rows, lambda x: F.when(x["kind"] == k, x["n"] * x["q"]).otherwise(0.0)) + 1)
                        / (total(rows, lambda x: F.when(x["kind"] == k, x["n"]).otherwise(0.0)) + 2)).alias("p"),
            F.transform(labelers, lambda l: rate(rows, l, lambda x: x["n"] * x["q"], 0.8)).alias("a"),
            F.transform(labelers, lambda l: rate(rows, l, lambda x: x["n"] * (1 - x["q"]), 0.2)).alias("b"),
        )

    start = F.struct(
        F.array(*[F.lit(0.5)] * len(KINDS)).alias("p"), F.array(*[F.lit(0.8)] * len(LABELERS)).alias("a"), F.array(*[F.lit(0.2)] * len(LABELERS)).alias("b"))
    # A one-element array stands for a local name: the judged patterns are computed once a step.
    step = lambda s, _: F.element_at(F.transform(F.array(judged(s)), better), 1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(EM_STEPS)), start, step, judged)


def fit(judged: Column) -> Column:
    """Weights of a logistic classifier of the patterns' probabilities, by gradient steps."""
    places = F.sequence(F.lit(1), F.lit(N_FEATURES))
    count = F.aggregate(judged, F.lit(0.0), lambda s, x: s + x["n"])

    def step(w: Column, _: Column) -> Column:
        errors = F.transform(judged, lambda x: F.struct(
            x["x"].alias("x"), (x["n"] / count * (x["q"] - _sigmoid(_dot(w, x["x"])))).alias("d")))
        moved = F.transform(F.array(errors), lambda e: F.transform(places, lambda j: F.element_at(w, j) * (1 - FIT_RATE * FIT_PULL) + FIT_RATE * F.aggregate(
            e, F.lit(0.0), lambda s, x: s + x["d"] * F.element_at(x["x"], j))))
        return F.element_at(moved, 1)

    return F.aggregate(F.sequence(F.lit(1), F.lit(FIT_STEPS)), F.array(*map(F.lit, START)), step)


#: Starting weights: every labeler's vote counts the same.
START = [1.0] * len(LABELERS) + [0.0] * len(KINDS) + [0.0, 0.0]


def train(texts: DataFrame) -> list[float]:
    """Classifier weights from all candidates of (text). Only the table of vote patterns is brought together."""
    one = texts.select(F.explode(proposals(F.col("text"))).alias("c")).select("c.kind", "c.votes", "c.size")
    counts = one.groupBy("kind", "votes", "size").agg(F.count("*").cast("double").alias("n"))
    table = counts.agg(F.sort_array(F.collect_list(F.struct("n", "kind", "votes", "size"))).alias("patterns"))
    judged = table.select(estimate(F.col("patterns")).alias("judged")).select(F.transform("judged", lambda x: F.struct(
        x["n"].alias("n"), x["q"].alias("q"), _features(x["kind"], x["votes"], x["size"]).alias("x"))).alias("judged"))
    weights = judged.select(F.when(F.size("judged") > 0, fit(F.col("judged"))).alias("w")).first()["w"]
    return list(weights) if weights else START


def _spans(frame: DataFrame, weights: list[float]) -> DataFrame:
    """`frame` with `_base` and `_all`: arrays of (kind, start, end) by kind, then start."""
    text, model = F.coalesce(F.col("text").cast("string"), F.lit("")), F.array(*map(F.lit, weights))

    def of_kind(k: int, kind: str) -> Column:
        held = F.filter(_matches(text, BASE[kind], BASE_GATE[kind]), lambda m: valid(kind, m["found"]))
        return F.transform(held, lambda m: F.struct(F.lit(k).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    base = F.concat(*[of_kind(k, kind) for k, kind in enumerate(KINDS)])
    accepted = F.filter(proposals(text), lambda c: _sigmoid(_dot(model, _features(c["kind"], c["votes"], c["size"]))) >= ACCEPT)
    frame = frame.withColumns({"_base": base, "_more": accepted})
    new = F.filter("_more", lambda c: ~F.exists("_base", lambda b: (b["kind"] == c["kind"]) & (b["start"] < c["end"]) & (c["start"] < b["end"])))
    bare = F.transform(new, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return frame.withColumn("_all", F.sort_array(F.concat("_base", bare))).drop("_more")


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, and all spans, a row per row of `docs`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = _spans(texts, train(texts))

    def count(k: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")

    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_all").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in angle brackets; overlapping spans become one. Other columns stay, whatever their names,
    but n_chars, where there is one, is counted anew for changed texts."""
    weights = train(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")))
    columns = docs.columns
    # All columns travel as one, so that no name of theirs meets one of the working columns.
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("text"))
    found = _spans(packed, weights).withColumn("_all", F.sort_array(F.transform("_all", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    cut = "struct<before:bigint,start:bigint,end:bigint,kind:int>"
    # Each span with the end of what the spans before it have covered; one that starts earlier is part of these.
    found = found.withColumn("_all", _running(
        F.col("_all"), cut, lambda reach, s: F.struct(reach.alias("before"), s["start"].alias("start"), F.greatest(reach, s["end"]).alias("end"), s["kind"].alias("kind")),
        lambda reach, s: F.greatest(reach, s["end"])))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    text = F.col("text")
    parts = F.transform("_all", lambda s: F.when(s["start"] >= s["before"], F.concat(
        F.substring(text, (s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int")), F.element_at(names, s["kind"] + 1))).otherwise(""))
    rest = F.substring(text, (F.element_at("_all", -1)["end"] + 1).cast("int"), F.length(text))
    new = F.when(F.size("_all") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(text)
    found = found.withColumn("_text", new)
    keep = {"text": F.col("_text")}
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        keep["n_chars"] = F.when(F.size("_all") > 0, F.length("_text").cast(kind)).otherwise(F.col("_row")["n_chars"])
    return found.select(*[(keep[c] if c in keep else F.col("_row")[c]).alias(c) for c in columns])
