"""Spelling variants of a corpus' words, found on sorted permuterm rotations.

A word marked with its end sign is turned round at every place: y$x for word xy. A word x c y has, turned after c, the
rotation y$xc. Words that differ by a replaced, added or missing code point meet where these rotations are sorted: they
share the prefix y$x and differ only in what follows, the edited code point or nothing. So each word sends its rotations,
cut into the prefix and the code point behind it; sorted runs of one prefix are scanned, and each member gets from a run
the number of its neighbours there and the best of them. A prefix fixes all but one code point, so a run has no
more members than the alphabet has letters (90), one more for the word without it. Every pair of near words meets in one
run: a replaced code point fixes the prefix, and of equal code points in a row only the first counts as the missing one.

A word's form is its most frequent near word, if that is at least five times as frequent; following forms leads to its
root. Frequencies grow fivefold at each step, so five rounds of doubled steps always suffice.

Words are runs of ASCII letters and of U+00C0 to U+00FF in whole texts, ASCII letters folded. Null and empty texts have none, repeated
rows count each, rows without doc_id count with nothing deleted. Columns other than doc_id and text are left out, whatever
their names; an empty table gives an empty result. Texts of any length are read in windows. Where more than 64 code points
remain around the edited one, two 128-bit BLAKE2b digests stand for the parts x and y, so that a run of letters of any length
costs rows of fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import plain_texts, slices, written

LEAST_LENGTH = 6
LEAST_COUNT = 5
LEAST_RATIO = 5
#: Of so many (document, word) pairs one loses a code point.
EDITED = 199
#: Code points up to which a word and the rest of an edited one are spelt out.
SPELT = 64
WINDOW = 1 << 20
#: Words a task counts before it passes them on, and rotations in one batch.
HELD = 500_000
TOGETHER = 100_000
#: Rounds after which every chain of forms has been followed: 2 ** 5 steps of a factor of five exceed any count.
ROUNDS = 5
_END = "$"
_WORD = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
_BETWEEN = re.compile("[^A-Za-zÀ-ÿ]")


def windows(text: str) -> Iterator[str]:
    """The text in windows that end between words."""
    at = 0
    while len(text) - at > WINDOW:
        end = _BETWEEN.search(text, at + WINDOW)
        if end is None:
            break
        yield text[at:end.start()]
        at = end.start()
    yield text[at:] if at else text


def edited(doc_id: int | None, word: str, seed: int) -> str:
    """The word as it counts in a document: one of 199 loses a code point."""
    if doc_id is None:
        return word
    h = zlib.crc32(word.encode(), seed)
    if h % EDITED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1:]


def word_counts(docs: DataFrame) -> DataFrame:
    """word and n of all words long and frequent enough, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for piece in slices(batches):
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                seed = zlib.crc32(f"{doc_id}:".encode())
                for window in windows(text):
                    for word, n in Counter(_WORD.findall(window.encode().lower().decode())).items():
                        word = edited(doc_id, word, seed)
                        if len(word) >= LEAST_LENGTH:
                            counts[word] += n
                    if len(counts) > HELD:
                        yield batch()
                        counts.clear()
        if counts:
            yield batch()

    parts = plain_texts(docs).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _digests(letters: str) -> bytearray:
    """Digests of the first 0, 1, ... letters, one after another."""
    state, out = blake2b(digest_size=16), bytearray()
    out += state.digest()
    for c in letters:
        state.update(c.encode())
        out += state.copy().digest()
    return out


def rotations(word: str) -> Iterator[tuple[str, str, bool]]:
    """Prefix, code point behind it, and whether it differs from the code point before it, of all rotations.

    A rotation with nothing behind the prefix is that of the word itself; it comes once per place.
    """
    n = len(word)
    heads = tails = bytearray()
    if n > SPELT:
        heads, tails = _digests(word), _digests(word[::-1])

    def prefix(at: int, after: int) -> str:
        """Of the rest word[:at] and word[after:]."""
        if n - (after - at) <= SPELT:
            return word[after:] + _END + word[:at]
        return f"{heads[16 * at:16 * at + 16].hex()}{_END}{tails[16 * (n - after):16 * (n - after) + 16].hex()}"

    for at in range(n + 1):
        yield prefix(at, at), "", False
    for at in range(n):
        yield prefix(at, at + 1), word[at], at == 0 or word[at - 1] != word[at]


def name(word: str) -> str:
    """The word, or what stands for a long one in rotations."""
    return word if len(word) <= SPELT else "#" + blake2b(word.encode(), digest_size=32).hexdigest()


def all_rotations(words: DataFrame) -> DataFrame:
    """prefix, behind, first, name and n of all rotations of (word, n)."""
    schema = "prefix string, behind string, first boolean, name string, n long"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                own = name(word)
                for prefix, behind, first in rotations(word):
                    rows.append((prefix, behind, first, own, n))
                    if len(rows) == TOGETHER:
                        yield _batch(rows, _ROTATION)
                        rows = []
            if rows:
                yield _batch(rows, _ROTATION)

    return words.mapInArrow(run, schema)


_ROTATION = pa.schema([("prefix", pa.string()), ("behind", pa.string()), ("first", pa.bool_()), ("name", pa.string()), ("n", pa.int64())])
_NEAR = pa.schema([("name", pa.string()), ("n_near", pa.int64()), ("other", pa.string()), ("other_n", pa.int64())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def scan(members: list[tuple[str, bool, str, int]]) -> Iterator[tuple[str, int, str | None, int | None]]:
    """Per member of a run (behind, first, name, n): neighbours in this run, and the best one if frequent enough."""
    plain = next((m for m in members if not m[0]), None)
    # The words of a run differ only in the code point behind the prefix, so it orders them.
    others = sorted((m for m in members if m[0]), key=lambda m: (-m[3], m[0]))

    def row(own: tuple, count: int, best: tuple) -> tuple:
        return (own[2], count, best[2], best[3]) if best[3] >= LEAST_RATIO * own[3] else (own[2], count, None, None)

    if len(others) > 1:
        for k, own in enumerate(others):
            yield row(own, len(others) - 1, others[0 if k else 1])
    if plain is not None:
        longer = [m for m in others if m[1]]
        for own in longer:
            yield row(own, 1, plain)
        if longer:
            yield row(plain, len(longer), longer[0])


def near_words(words: DataFrame) -> DataFrame:
    """name, n_near, other and other_n: what each run of equal prefixes says on each of its members."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple] = []
        last: str | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            prefix = batch.column("prefix")
            same = pc.equal(prefix.slice(1), prefix.slice(0, len(prefix) - 1)).to_numpy(zero_copy_only=False) if len(prefix) > 1 else []
            rows = []
            # A run may go on from the batch before and into the next one.
            met = [k for k in range(len(prefix)) if k == 0 or k == len(prefix) - 1 or same[k - 1] or (k < len(same) and same[k])]
            some = batch.take(pa.array(met))
            for key, *member in zip(*(some.column(c).to_pylist() for c in ("prefix", "behind", "first", "name", "n"))):
                if key != last:
                    if len(open_) > 1:
                        rows += scan(open_)
                    open_, last = [], key
                open_.append(tuple(member))
            if rows:
                yield _batch(rows, _NEAR)
        rows = list(scan(open_)) if len(open_) > 1 else []
        if rows:
            yield _batch(rows, _NEAR)

    dealt = all_rotations(words).repartition("prefix").sortWithinPartitions("prefix", "behind")
    return dealt.mapInArrow(run, "name string, n_near long, other string, other_n long")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of all words that are long and frequent enough."""
    spark = docs.sparkSession
    spelt = F.length("word") <= SPELT
    words = written(spark, word_counts(docs), "spelling-words")
    found = near_words(words)
    # Long words come as digests and are spelt out before words are compared.
    long = words.filter(~spelt).mapInArrow(_named, "other string, other_word string")
    is_long = F.coalesce(F.col("other").startswith("#"), F.lit(False))
    found = written(spark, found, "spelling-near")
    found = found.filter(~is_long).withColumn("other_word", F.col("other")).unionByName(found.filter(is_long).join(long, "other"))
    best = F.struct((-F.col("other_n")).alias("n"), F.col("other_word").alias("word"))
    best = found.groupBy("name").agg(F.sum("n_near").alias("n_near"), F.min(F.when(F.col("other_word").isNotNull(), best)).alias("best"))
    named = words.filter(spelt).select("word", "n", F.col("word").alias("name"))
    named = named.unionByName(words.filter(~spelt).join(long.select(F.col("other_word").alias("word"), F.col("other").alias("name")), "word"))
    result = named.join(best, "name", "left").select(
        "word", F.col("best.word").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.n")).alias("form_n"))
    result = written(spark, result, "spelling-forms")
    return result.join(roots(spark, result.filter("form IS NOT NULL").select("word", "form")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _named(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column("word").to_pylist()
        yield pa.RecordBatch.from_arrays([pa.array(map(name, words), pa.string()), pa.array(words, pa.string())], ["other", "other_word"])


def roots(spark: SparkSession, forms: DataFrame) -> DataFrame:
    """word and root: the last word on the chain of forms, the steps doubled in each round."""
    reached = forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved"))
    for _ in range(ROUNDS):
        ahead = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = reached.select("word", "root").join(ahead, "root", "left")
        reached = reached.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        reached = written(spark, reached, "spelling-roots")
        if reached.filter("moved").isEmpty():
            break
    return reached.select("word", "root")
