"""Quality rules by n-gram perplexity: a modified Kneser-Ney model counted by Spark, with bands for each language.

The model is over the bytes of UTF-8, as they are: an n-gram of six bytes packs into a number, which is its hash without
collisions, and the model grows with what the corpus holds. Each task folds its documents into one count per n-gram and Spark
adds these up; lower orders, discounts, contexts and probabilities are groupings, windows and joins by Spark. What is counted
are documents, not places, and an n-gram that a single document holds is discounted in full: it would only be evidence of that
document for itself. So the model keeps the n-grams with a count of two or more and the weights of their contexts, as sorted
arrays that are searched by bisection.

Up to ``BROADCAST_ROWS`` entries (12 bytes each) the arrays are broadcast. Beyond that, documents are dealt to parts, and each
part gets the entries that its n-grams may need by a join. Both ways give the same scores.

A document is rejected if its mean log-perplexity lies outside the band of its language: the median over all documents of
the language, plus and minus a number of robust deviations. Medians come from a histogram, so they do not depend on the
order of rows. Simple rules (too few words, too many repeated three-word windows) reject first.

Defined results: a NULL or empty text has no words and fails the simple rules; a NULL language is a language of its own;
texts are read whole; repeated rows are judged each on their own; an empty table gives an empty table; a corpus without
words gives a uniform model. Columns with the names of the measures are replaced by them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.llm.frames import bounded_batches, slices, with_fields
from censora.session import materialise

# Bytes of an n-gram: with their order they fit into 63 bits.
ORDER = 6
# Entries that are broadcast (192 MB); bytes of text in a part where the model is larger.
BROADCAST_ROWS, PART_BYTES = 16_000_000, 1 << 25
# Bins per unit of log-perplexity; deviations from the median that a document may have below and above; least deviation.
BINS, BELOW, ABOVE, LEAST = 1000, 6.0, 7.0, 0.02
# Simple rules: words a document needs, and percent of its words that repeated windows may cover.
MIN_WORDS, MAX_REPEATED = 50, 50
# Bytes one step works on, and n-grams a task holds before they go on: they bound the memory of a task.
STEP, HELD = 1 << 20, 1 << 21
# Bytes that are scored in one step, which takes more memory a byte than counting.
SCORED = 1 << 18
# Slots of a worker's memory of n-grams looked up before.
SLOTS = 20

SPACES, MARKS = " \t\n\x0b\x0c\r", "#*$%&|<>"
_BEFORE = b"\n" * (ORDER - 1)
PROBABILITY, WEIGHT = 0, 8


def chunks(texts: Sequence[str | None], step: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Steps of about ``step`` bytes: places of texts, how many bytes each has in the step, and an n-gram for each byte.

    Before a text stand line feeds; a long text goes on in further steps.
    """
    step = step or STEP
    held: list[tuple[int, bytes]] = []
    size = 0

    def packed():
        lengths = np.array([len(e) - ORDER + 1 for _, e in held], np.int64)
        joined = np.frombuffer(b"".join(e for _, e in held), np.uint8)
        size = len(joined) - ORDER + 1
        grams = joined[:size].astype(np.uint64)
        for k in range(1, ORDER):
            grams <<= np.uint64(8)
            grams |= joined[k : size + k]
        inside = np.ones(size, bool)
        inside[(np.cumsum(lengths + ORDER - 1)[:-1, None] - np.arange(1, ORDER)).ravel()] = False
        return np.array([i for i, _ in held], np.int64), lengths, grams[inside]

    for i, text in enumerate(texts):
        encoded = _BEFORE + text.encode("utf-8", "replace") if text else b""
        for at in range(0, len(encoded) - ORDER + 1, step):
            held.append((i, encoded[at : at + step + ORDER - 1]))
            size += len(held[-1][1])
            if size >= step:
                yield packed()
                held, size = [], 0
    if held:
        yield packed()


def runs(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted n-grams and their added counts. ``parts`` is emptied, so that no n-gram is held twice."""
    if all(counts.max(initial=0) < 1 << 16 for _, counts in parts):
        # Six bytes of an n-gram and two of its count sort as one number, which is much faster.
        grams, at = np.empty(sum(len(g) for g, _ in parts), np.uint64), 0
        while parts:
            own, counts = parts.pop()
            here = grams[at : at + len(own)]
            np.left_shift(own, np.uint64(16), out=here)
            here |= counts.astype(np.uint16)
            at += len(own)
        own = counts = None
        grams.sort()
        counts = (grams & np.uint64(0xFFFF)).astype(np.uint16)
        grams >>= np.uint64(16)
    else:
        grams, counts = (np.concatenate([p[k] for p in parts]) for k in range(2))
        parts.clear()
        by = np.argsort(grams)
        grams, counts = grams[by], counts[by]
    first = runs(grams)
    return grams[first], np.add.reduceat(counts, first, dtype=np.int64) if len(first) else counts.astype(np.int64)


def document_counts(texts: Sequence[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams and how many of ``texts`` (256 at most) hold them; long texts come alone."""
    long = {i for i, t in enumerate(texts) if t and len(t) > STEP // 4}
    for at, lengths, grams in chunks([None if i in long else t for i, t in enumerate(texts)]):
        # The place of a text is the lowest byte; in place, for these are the largest arrays of a task.
        grams <<= np.uint64(8)
        grams |= np.repeat(at.astype(np.uint8), lengths)
        grams.sort()
        one = grams[runs(grams)]
        one >>= np.uint64(8)
        first = runs(one)
        yield one[first], np.diff(first, append=len(one)).astype(np.uint16)
    for i in long:
        own = np.zeros(0, np.uint64)
        for _, _, grams in chunks([texts[i]]):
            own = np.union1d(own, grams)
        yield own, np.ones(len(own), np.uint16)


def gram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``gram`` and ``n``: how many documents hold it, over all documents."""

    def batch_of(grams, counts):
        for at in range(0, len(grams), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(grams[at : at + 100_000].view(np.int64)), pa.array(counts[at : at + 100_000])], ["gram", "n"])

    bounded_batches(docs.sparkSession)

    def run(batches):
        # A worker lives on between jobs: the model of an earlier one is not held beside the counts.
        _SCORERS.clear()
        held, rows = [], 0
        for batch in slices(batches):
            for part in document_counts(batch.column(0).to_pylist()):
                held.append(part)
                rows += len(part[0])
                if rows > HELD:
                    held = [merged(held)]
                    rows = len(held[0][0])
                    if 4 * rows > 3 * HELD:
                        yield from batch_of(*held[0])
                        held, rows = [], 0
        if held:
            yield from batch_of(*merged(held))

    parts = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(n: Sequence[int]) -> tuple[float, float]:
    """What counts of 2, and of 3 or more, give up (modified Kneser-Ney), from how many n-grams have the counts 1, 2, 3 and 4."""
    if not all(n):
        return 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    return min(max(2 - 3 * y * n[2] / n[1], 0.0), 1.99), min(max(3 - 4 * y * n[3] / n[2], 0.0), 2.99)


def train(docs: DataFrame, text: str = "text") -> DataFrame:
    """The model of all documents, a stored table: ``key`` (n-gram, order and kind) and ``value`` (a logarithm).

    p(byte | context) = (n - discount) / total of the context + weight of the context * p(byte | shorter context). Orders below
    the highest count the different bytes before an n-gram. At most 256 n-grams share a context or an end.
    """
    last = lambda order: F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))
    levels = {ORDER: materialise(gram_counts(docs, text), "grams")}
    for order in range(ORDER - 1, 0, -1):
        levels[order] = materialise(levels[order + 1].groupBy(last(order).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "grams")
    entries, shorter = [], None
    for order in range(1, ORDER + 1):
        level = levels[order]
        seen = {r["n"]: r["rows"] for r in level.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("rows")).collect()}  # four rows
        two, more = discounts([seen.get(k, 0) for k in (1, 2, 3, 4)])
        same = W.partitionBy("context")
        of = lambda rule: F.sum(F.when(rule, 1).otherwise(0)).over(same)
        given = of(F.col("n") == 1) + two * of(F.col("n") == 2) + more * of(F.col("n") > 2)
        own = F.col("n") - F.when(F.col("n") == 1, 1.0).when(F.col("n") == 2, two).otherwise(more)
        found = level.withColumn("context", F.shiftrightunsigned("gram", 8)).select("gram", "n", "context", F.sum("n").over(same).alias("total"), given.alias("given"))
        found = found.select("gram", "n", "context", (F.col("given") / F.col("total")).alias("weight"), (own / F.col("total")).alias("own"), last(order - 1).alias("end"))
        found = found.withColumn("lower", F.lit(1 / 256)) if shorter is None else found.join(shorter, "end")
        shown = materialise(found.select("gram", "n", "context", "weight", (F.col("own") + F.col("weight") * F.col("lower")).alias("p")), "levels")
        shorter = shown.select(F.col("gram").alias("end"), F.col("p").alias("lower"))
        tag = lambda column, kind, order: (F.col(column) + F.lit((kind + order) << 48)).alias("key")
        entries.append(shown.where("n >= 2").select(tag("gram", PROBABILITY, order), F.log("p").cast("float").alias("value")))
        weights = shown.where("weight < 1").groupBy("context").agg(F.max("weight").alias("weight"))
        entries.append(weights.select(tag("context", WEIGHT, order - 1), F.log(F.greatest("weight", F.lit(1e-30))).cast("float").alias("value")))
    whole = entries[0]
    for more in entries[1:]:
        whole = whole.unionByName(more)
    return materialise(whole, "model")


class Model(NamedTuple):
    """The entries of the model, or those that a part needs, sorted by key."""

    keys: np.ndarray
    values: np.ndarray
    token: str  # tells models apart


def arrays(keys: np.ndarray, values: np.ndarray) -> Model:
    by = np.argsort(keys)
    return Model(keys[by], values[by], uuid.uuid4().hex)


def keyed(kind: int, order: int, grams: np.ndarray) -> np.ndarray:
    return (grams + np.uint64((kind + order) << 48)).view(np.int64)


def find(model: Model, kind: int, order: int, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of n-grams by bisection, 0 where they are not in the model, and which of them are."""
    if not len(model.keys):
        return np.zeros(len(grams)), np.zeros(len(grams), bool)
    wanted = keyed(kind, order, grams)
    at = np.minimum(np.searchsorted(model.keys, wanted), len(model.keys) - 1)
    there = model.keys[at] == wanted
    return np.where(there, model.values[at], 0.0), there


def log_probability(model: Model, grams: np.ndarray, order: int = ORDER) -> np.ndarray:
    """log p of each n-gram's last byte after the others: its own entry, or the context's weight and the shorter n-gram."""
    if order == 0:
        return np.full(len(grams), -np.log(256))
    out, there = find(model, PROBABILITY, order, grams)
    rest = np.flatnonzero(~there)
    if len(rest):
        weight, _ = find(model, WEIGHT, order - 1, grams[rest] >> np.uint64(8))
        out[rest] = weight + log_probability(model, grams[rest] & np.uint64((1 << 8 * (order - 1)) - 1), order - 1)
    return out


class Scorer:
    """Scores by a model, with a memory of the n-grams looked up before (a table of fixed size, the latest one in each slot)."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = np.full(1 << SLOTS, np.iinfo(np.uint64).max, np.uint64)
        self.logs = np.zeros(1 << SLOTS)

    def logs_of(self, grams: np.ndarray) -> np.ndarray:
        slot = (grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)
        out = self.logs[slot]
        new = np.flatnonzero(self.grams[slot] != grams)
        if len(new):
            wanted, back = np.unique(grams[new], return_inverse=True)
            found = log_probability(self.model, wanted)
            out[new] = found[back]
            # One n-gram for each slot, so that n-gram and value belong together.
            into, one = np.unique((wanted * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS), return_index=True)
            self.grams[into], self.logs[into] = wanted[one], found[one]
        return out

    def log_perplexities(self, texts: Sequence[str | None]) -> list[float | None]:
        """The mean over the bytes of each text; None where there are none."""
        total, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for at, lengths, grams in chunks(texts, min(STEP, SCORED)):
            np.add.at(total, at, np.add.reduceat(self.logs_of(grams), np.cumsum(lengths) - lengths))
            np.add.at(size, at, lengths)
        return [-t / n if n else None for t, n in zip(total.tolist(), size.tolist())]


_SCORERS: dict[str, Scorer] = {}


def scorer(model) -> Scorer:
    """The worker's scorer of a broadcast model; one is held at a time."""
    token = model.value.token
    if token not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[token] = Scorer(model.value)
    return _SCORERS[token]


def repeated_words(words: Sequence[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        windows = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
    ordered = np.sort(windows)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    inside = np.zeros(n, bool)
    at = np.flatnonzero(np.isin(windows, twice))
    for k in range(3):
        inside[at + k] = True
    return int(inside.sum())


class Measures(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


def measures(text: str | None) -> Measures:
    """Words are runs of other characters than the six ASCII white spaces."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return Measures(
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, MARKS)), len(lines) - len(set(lines)), repeated_words(words)
    )


ADDED = (*Measures._fields, "base_failed", "log_perplexity", "low", "high", "kept")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def measured(docs: DataFrame, model: DataFrame, text: str, added: str, rows_of: Callable[[Scorer, list], list[list]]) -> DataFrame:
    """``docs`` with the columns ``added``, which ``rows_of`` gives for a list of texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.withColumn(text, F.col(f"`{text}`").cast("string"))
    names, place, schema = rows.columns, rows.columns.index(text), with_fields(rows.schema, added)
    fields = schema.fields[len(names) :]
    types = [pa.int64() if f.dataType.simpleString() == "bigint" else pa.float64() for f in fields]

    def batch_of(batch, of):
        found = rows_of(of, batch.column(place).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(found, types))], [*names, *(f.name for f in fields)])

    size = model.count()
    if size <= BROADCAST_ROWS:
        entries = model.toArrow()  # BROADCAST_ROWS at most
        held = spark.sparkContext.broadcast(arrays(entries["key"].to_numpy(), entries["value"].to_numpy()))

        def run(batches):
            of = scorer(held)
            for batch in slices(batches):
                yield batch_of(batch, of)

        return rows.mapInArrow(run, schema)

    total = rows.agg(F.sum(F.octet_length(f"`{text}`").cast("long"))).first()[0] or 0
    parts = -(-total // PART_BYTES) + 1
    dealt = materialise(rows.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")), "parts")

    def needs(batches):
        for batch in slices(batches):
            parts_of = batch.column(1).to_numpy()
            for at, lengths, grams in chunks(batch.column(0).to_pylist()):
                part = np.repeat(parts_of[at], lengths).astype(np.int64)
                for order in range(ORDER, 0, -1):
                    for own, key in ((part, keyed(PROBABILITY, order, grams)), (part, keyed(WEIGHT, order - 1, grams >> np.uint64(8)))):
                        pairs = np.unique(np.stack([own, key]), axis=1) if len(key) else np.zeros((2, 0), np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1])], ["_part", "key"])
                    both = np.unique(np.stack([part, (grams & np.uint64((1 << 8 * (order - 1)) - 1)).view(np.int64)]), axis=1)
                    part, grams = both[0], both[1].view(np.uint64)

    wanted = dealt.select(f"`{text}`", "_part").mapInArrow(needs, "_part int, key long").distinct()
    slice_of = wanted.join(model, "key")

    def score(texts: pa.Table, entries: pa.Table) -> pa.Table:
        of = Scorer(arrays(entries["key"].to_numpy(), entries["value"].to_numpy()))
        whole = [batch_of(b, of) for b in slices(texts.select(names).combine_chunks().to_batches())]
        return pa.Table.from_batches(whole)

    return dealt.groupBy("_part").cogroup(slice_of.groupBy("_part")).applyInArrow(score, schema)


def scores(docs: DataFrame, model: DataFrame, text: str = "text", keep: Sequence[str] = ("lang",)) -> DataFrame:
    """``keep`` columns and the text's ``log_perplexity`` (NULL without characters)."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    return measured(rows, model, "_text", "log_perplexity double", lambda of, texts: [of.log_perplexities(texts)]).drop("_text")


def bands(scored: DataFrame, language: str = "lang") -> DataFrame:
    """``language``, ``low`` and ``high``: median and robust deviation of each language's documents, from a histogram."""

    def median(rows: DataFrame, name: str) -> DataFrame:
        upto = W.partitionBy("_lang").orderBy("bin")
        halves = rows.withColumn("seen", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(W.partitionBy("_lang")))
        return halves.where(F.col("seen") * 2 >= F.col("all")).groupBy("_lang").agg(F.min("bin").alias(name))

    # A NULL language has a key of its own that no text can be.
    key = F.coalesce(F.concat(F.lit("="), F.col(language).cast("string")), F.lit(""))
    counted = scored.where("log_perplexity IS NOT NULL").select(key.alias("_lang"), F.floor(F.col("log_perplexity") * BINS).alias("bin"))
    histogram = materialise(counted.groupBy("_lang", "bin").agg(F.count(F.lit(1)).alias("n")), "perplexity-histogram")
    middle = median(histogram, "middle")
    away = histogram.join(middle, "_lang").withColumn("bin", F.abs(F.col("bin") - F.col("middle"))).groupBy("_lang", "bin").agg(F.sum("n").alias("n"))
    spread = F.greatest(F.col("away") * 1.4826 / BINS, F.lit(LEAST))
    return middle.join(median(away, "away"), "_lang").select(
        "_lang", ((F.col("middle") + 0.5) / BINS - BELOW * spread).alias("low"), ((F.col("middle") + 0.5) / BINS + ABOVE * spread).alias("high")
    )


def judged(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """``docs`` with the measures, ``base_failed``, ``log_perplexity``, its band (``low``, ``high``) and ``kept``.

    Three scans of the texts (count, score, judge), and no shuffle of them unless the model is too large for a broadcast.
    """
    docs = docs.drop(*ADDED)
    model = train(docs, text)
    limits = materialise(bands(scores(docs, model, text, (language,)), language), "perplexity-bands")

    def rows_of(of, texts):
        return [*([*c] for c in zip(*map(measures, texts))), of.log_perplexities(texts)]

    added = ", ".join(f"{m} long" for m in Measures._fields) + ", log_perplexity double"
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{language}`").cast("string")), F.lit(""))
    # One row per language, read back from a file: Spark sees its size and broadcasts it.
    placed = measured(docs, model, text, added, rows_of).withColumn("_lang", key).join(limits, "_lang", "left").drop("_lang").withColumn("base_failed", base_failed())
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return placed.withColumn("kept", ~F.col("base_failed") & inside).select(*[F.col(f"`{c}`") for c in docs.columns], *ADDED)
