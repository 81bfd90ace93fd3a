"""SimHash fingerprints and their Hamming neighbours, with DataFrame functions only.

A text's terms are its pairs of neighbouring words (the last word stands alone). Each term is hashed to 64 bits; every bit
votes for or against with the term's weight, and the fingerprint has the bits with a majority. Votes of two bits at a
time are summed in one 64-bit number, so a text needs 32 sums, in compiled code, over its exploded terms.

Neighbours within a Hamming radius come from permuted block tables: the bits are cut into blocks; if at most `radius` bits
differ, some `blocks - radius` blocks agree. For each choice of that many blocks there is a table keyed by their
bits, in which fingerprints meet; the distance of each pair that meets is checked in full. Equal fingerprints are
held once, with their number, so groups of copies are not paired.

Null text is read as empty; a text without words has the fingerprint 0. Rows without doc_id get fingerprints, but stand
outside the order: they have no next document and are no document's next. Repeated rows are rows of their own, in
the order of doc_id, then text.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import written

RADIUS = 3
BLOCKS = 6
#: Ids of a block of neighbouring doc_ids; bounds the rows that are sorted together.
SPAN = 4_096
#: At most so many rows of two numbers are broadcast.
BROADCAST_ROWS = 250_000
LANES = 32
_PAIR = (1 << 32) | 1
#: What stands between words.
_BETWEEN = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    """The pairs of neighbouring words, as hashes whose two lowest bits hold the term's weight less 1.

    Pairs of long words are rarer and weigh more, up to 4.
    """
    words = F.array_remove(F.split(F.lower(text), _BETWEEN), "")

    def term(a: Column, b: Column) -> Column:
        heavier = F.least(F.floor((F.length(a) + F.coalesce(F.length(b), F.lit(0))) / 5), F.lit(3)).cast("long")
        return F.xxhash64(a, b).bitwiseAND(F.lit(-4).cast("long")).bitwiseOR(heavier)

    return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), term)


def fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """The keys, which name a row, and its fingerprint as a long."""
    votes = texts.select(*keys, F.explode_outer(terms(F.col(text))).alias("term"))
    votes = votes.select(
        *keys, (F.col("term").bitwiseAND(F.lit(3).cast("long")) + 1).alias("weight"),
        F.col("term").bitwiseXOR(F.shiftrightunsigned("term", 32)).alias("bits"))
    sums = [F.sum(F.shiftrightunsigned("bits", s).bitwiseAND(F.lit(_PAIR)) * F.col("weight")).alias(f"v{s}") for s in range(LANES)]
    counted = votes.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums)
    bits = F.lit(0).cast("long")
    for s in range(LANES):
        low, high = F.col(f"v{s}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{s}", 32)
        for votes_for, bit in ((low, s), (high, s + LANES)):
            value = 1 << bit if bit < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(2 * votes_for > F.col("total"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def shown(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def next_keys(ids: DataFrame, span: int = SPAN) -> DataFrame:
    """(id, next): the next larger id of each, the smallest after the largest; `ids` holds distinct ids in `id`.

    Ids are grouped by id div span, groups by group div span, and so on up to one group. Inside a group a window finds the next one;
    the last of a group takes the first of the next group. No window sees more than `span` rows.
    """
    spark = ids.sparkSession
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None:
        return ids.select("id", F.col("id").alias("next"))
    level, bottom, top, steps = ids.select("id", F.col("id").alias("first")), low, high, []
    while True:
        whole = top - bottom < span
        # Spark divides towards zero; pmod makes groups of negative ids whole as well.
        up = F.lit(0).cast("long") if whole else F.expr(f"(id - pmod(id, {span})) div {span}")
        named = level.withColumn("up", up)
        named = written(spark, named.withColumn("next", F.lead("first").over(Window.partitionBy("up").orderBy("id"))), "next-level")
        steps.append(named)
        if whole:
            break
        bottom, top = bottom // span, top // span
        level = named.groupBy(F.col("up").alias("id")).agg(F.min("first").alias("first"))
    resolved = steps[-1].select("id", F.coalesce("next", F.lit(low)).alias("next"))
    for named in reversed(steps[:-1]):
        outer = resolved.select(F.col("id").alias("up"), F.col("next").alias("beyond"))
        resolved = named.join(outer, "up").select("id", F.coalesce("next", "beyond").alias("next"))
    return resolved


def neighbours(queries: DataFrame, prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, other): pairs of distinct fingerprints within the radius; both inputs hold distinct ones in `fingerprint`."""
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    begins = [sum(widths[:i]) for i in range(blocks)]
    tables = list(combinations(range(blocks), blocks - radius))

    def keyed(frame: DataFrame, name: str) -> DataFrame:
        masks = []
        for chosen in tables:
            mask = sum(((1 << widths[b]) - 1) << begins[b] for b in chosen)
            masks.append(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)).cast("long"))
        return frame.select(F.col("fingerprint").alias(name), F.posexplode(F.array(*masks)).alias("table", "mask")).select(
            name, "table", F.col(name).bitwiseAND(F.col("mask")).alias("block"))

    met = keyed(queries, "query").join(keyed(prints, "other"), ["table", "block"])
    return met.filter((F.col("query") != F.col("other")) & (F.bit_count(F.col("query").bitwiseXOR(F.col("other"))) <= radius)).select("query", "other").distinct()


def _with_next(texts: DataFrame) -> DataFrame:
    """block, place, halo, doc_id, text and ahead, the next document's text, for rows of (doc_id, text).

    Blocks hold SPAN neighbouring ids. A block also gets a copy (halo) of the document after its last one, so each text is
    shuffled once and no window spans more than a block.
    """
    def block(name: str) -> Column:
        return F.expr(f"({name} - pmod({name}, {SPAN})) div {SPAN}")

    known = texts.filter(F.col("doc_id").isNotNull())
    follow = next_keys(known.select(F.col("doc_id").alias("id")).distinct())
    heads = follow.filter((block("id") != block("next")) | (F.col("next") <= F.col("id"))).select(F.col("next").alias("doc_id"), block("id").alias("block"))
    # One row for each block that holds ids. Up to a checked number they are sent to the texts instead of the texts to them.
    heads = written(texts.sparkSession, heads, "fingerprint-heads")
    if heads.count() <= BROADCAST_ROWS:
        heads = F.broadcast(heads)
    halo = known.join(heads, "doc_id").select("doc_id", "text", "block", F.lit(True).alias("halo"))
    both = known.select("doc_id", "text", block("doc_id").alias("block"), F.lit(False).alias("halo")).union(halo)
    inside = Window.partitionBy("block").orderBy("halo", "doc_id", "text")
    return both.select("block", F.row_number().over(inside).alias("place"), "halo", "doc_id", "text", F.lead("text").over(inside).alias("ahead"))


def compare(docs: DataFrame, every: int = 100) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many of the next document.
    n_near is the number of other documents within RADIUS, for every doc_id divisible by `every` (null for others), and near_fingerprints
    lists their fingerprints, each once with the number of these documents, so groups of copies aren't written out.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    nameless = texts.filter(F.col("doc_id").isNull()).select(
        F.monotonically_increasing_id().alias("block"), F.lit(1).alias("place"), F.lit(False).alias("halo"), "doc_id", "text", F.lit("").alias("ahead"))
    rows = _with_next(texts).withColumn("named", F.lit(True)).union(nameless.withColumn("named", F.lit(False)))
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.select("named", "block", "place", "halo", "doc_id", "text", n.cast("long").alias("n_chars"), F.when(~F.col("halo"), F.concat(
        F.substring("text", F.lit(1), n - quarter), F.substring(F.coalesce("ahead", "text"), F.lit(1), quarter))).alias("edited"))
    keys = ["named", "block", "place"]
    facts = rows.select(*keys, "halo", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"))
    versions = rows.select(*keys, F.explode(F.array(
        F.struct(F.lit(0).alias("version"), F.col("text").alias("body")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))).alias("v"))
    prints = fingerprints(versions.select(*keys, "v.version", "v.body"), [*keys, "version"], "body")
    prints = prints.groupBy(*keys).agg(
        F.max(F.when(F.col("version") == 0, F.col("fingerprint"))).alias("own"), F.max(F.when(F.col("version") == 1, F.col("fingerprint"))).alias("changed"))
    after = F.lead("own").over(Window.partitionBy("named", "block").orderBy("place"))
    result = facts.join(prints, keys).withColumn("after", after).filter(~F.col("halo"))
    result = written(docs.sparkSession, result.select("doc_id", "n_chars", "edited_sha256", "own", "changed", "after"), "fingerprints")

    held = result.groupBy(F.col("own").alias("fingerprint")).agg(F.count("*").alias("n"))
    asked = result.filter(F.col("doc_id") % every == 0).select(F.col("own").alias("fingerprint")).distinct()
    near = neighbours(asked, held.select("fingerprint")).join(held.withColumnRenamed("fingerprint", "other"), "other")
    near = asked.join(held, "fingerprint").select(F.col("fingerprint").alias("own"), F.col("fingerprint").alias("other"), (F.col("n") - 1).alias("n")).union(
        near.select(F.col("query").alias("own"), "other", "n"))
    # At most as many entries as there are fingerprints within the radius; a document's own one only if others have it too.
    entry = F.when(F.col("n") > 0, F.concat_ws(":", shown(F.col("other")), F.col("n").cast("string")))
    near = near.groupBy("own").agg(F.sum("n").alias("n_near"), F.array_join(F.sort_array(F.collect_list(entry)), ",").alias("near_fingerprints"))
    return result.join(near, "own", "left").select(
        "doc_id", "n_chars", "edited_sha256", shown(F.col("own")).alias("fingerprint"), shown(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"),
        *[F.when(F.col("doc_id") % every == 0, F.col(c)).alias(c) for c in ("n_near", "near_fingerprints")])
