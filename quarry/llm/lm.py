"""Language-model scoring: prediction by partial matching over a byte-context trie, and a unigram base.

Training documents are those whose crc32(doc_id as text) mod 7 is not 2.  One Arrow pass over them counts
words and byte 6-grams; both counts are summed by Spark over the whole corpus.

The model's nodes are all contexts of up to ``ORDER`` bytes that the training text has; nothing is pruned.
The trie is a table of (context, byte, count), dealt by context.  A node with total T and D distinct
successors gives a seen byte c / (T + D) and escapes with D / (T + D) (method C); after an escape the bytes
seen there are excluded from the shorter context, and so on down to a uniform choice among the bytes not
excluded.  A byte's probability depends on it and the ORDER bytes before only, so that a text's score is a
sum over its grams.  The probabilities of the ``MAX_GRAMS`` most frequent grams at most are sent to all
tasks (16 bytes each); the other grams of a text are counted in its row and joined by key, those that the
training text has with their probabilities, those that it has not with the nodes that they escape through.
A text is its ASCII-lower-cased UTF-8 bytes and an end mark; the byte 0xFF, which UTF-8 never uses, is the
mark, and also stands before each text.

The base sums log10((c + 1) / (N + V + 1)) over words and one end.  Words of up to ``LONG_WORD`` bytes seen at
least once in ``MAX_WORDS`` tokens, at most that many, are broadcast; the others are joined by key.

Defined cases: a null text is empty and scores as the end alone; a very long text is scored in stretches; a
null doc_id counts as empty text for the split; repeated rows are learnt from and scored one by one; grams of
equal counts go either way, with the same result; without training documents all bytes are uniform; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import written

ORDER = 5
MAX_WORDS = 1 << 20
LONG_WORD = 64
MAX_GRAMS = 1 << 22
MARK = 0xFF
END = b"\xff"
_STEP = 1 << 20
_FLUSH = 250_000
_EMPTY = -1
#: The broadcast grams that a worker has a table of, and the table.
_made: list = []


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def prepared(text: str | None) -> bytes:
    return (text or "").encode().lower()


def _grams(data: bytes | np.ndarray) -> np.ndarray:
    """Keys of all bytes with the ORDER before each; ``data`` starts with ORDER bytes of context."""
    b = np.frombuffer(data, np.uint8)
    key = np.zeros(max(0, len(b) - ORDER), np.int64)
    for i in range(ORDER + 1):
        key <<= 8
        key |= b[i : len(b) - ORDER + i]
    return key


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each is there; sorts in place."""
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _count(batches):
    """Rows (word, gram, n): partial counts of words, or of byte grams where word is null."""
    _made.clear()  # the table of an earlier model
    words: Counter = Counter()
    buffer: list[bytes] = []
    size = empty = 0

    def emit_words():
        items = list(words.items())
        words.clear()
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _ in part], pa.binary()),
                    pa.nulls(len(part), pa.int64()),
                    pa.array([n for _, n in part], pa.int64()),
                ],
                ["word", "gram", "n"],
            )

    def emit_grams(texts: list[bytes]):
        """A mark after a mark is the end of an empty text, and is counted on its own."""
        marks = END * ORDER
        data = marks + marks.join(texts) + END
        for at in range(0, len(data) - ORDER, 8 * _STEP):
            keys, n = _runs(_grams(data[at : at + 8 * _STEP + ORDER]))
            real = keys & 0xFFFF != MARK << 8 | MARK
            keys, n = keys[real], n[real]
            for i in range(0, len(keys), 100_000):
                k = keys[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(k), pa.binary()), pa.array(k), pa.array(n[i : i + 100_000])], ["word", "gram", "n"]
                )

    for batch in batches:
        for t in batch.column(0):
            data = prepared(t.as_py())
            words.update(data.split())
            if not data:
                empty += 1
                continue
            buffer.append(data)
            size += len(data)
            if size > 8 * _STEP:
                yield from emit_grams(buffer)
                buffer, size = [], 0
            if len(words) > _FLUSH:
                yield from emit_words()
    if buffer:
        yield from emit_grams(buffer)
    if empty:
        whole = pa.array([(1 << 8 * (ORDER + 1)) - 1], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), whole, pa.array([empty], pa.int64())], ["word", "gram", "n"])
    yield from emit_words()


class Lookup:
    """Values of distinct keys that are not negative, in an open-addressing table: one or two reads a key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, (2 * len(keys) - 1).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY, np.int64)
        self.values = np.zeros(1 << self.bits)
        at, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            slot = at[left]
            free = np.flatnonzero(self.keys[slot] == _EMPTY)
            slots, first = np.unique(slot[free], return_index=True)
            won = left[free[first]]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            left = left[self.keys[slot] != keys[left]]
            at[left] = at[left] + 1 & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a key is there, its value or 0)."""
        at = self._slot(keys)
        there = self.keys[at]
        left = np.flatnonzero((there != keys) & (there != _EMPTY))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            now = self.keys[at[left]]
            there[left] = now
            left = left[(now != keys[left]) & (now != _EMPTY)]
        found = there == keys
        return found, np.where(found, self.values[at], 0.0)


def score_texts(texts: list[bytes], table: Lookup) -> tuple[np.ndarray, list, list]:
    """log10 probability of each text and its end, over the grams that the table has; and for each text its
    other grams, and how often it has them."""
    out = np.zeros(len(texts))
    rare: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    times: list[np.ndarray] = [np.zeros(0, np.int64)] * len(texts)
    lead = END * ORDER
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) < _STEP):
            size += len(texts[last])
            last += 1
        data = np.frombuffer(b"".join(lead + t for t in texts[first:last]) + lead, np.uint8)
        lengths = np.fromiter(map(len, texts[first:last]), np.int64, last - first)
        starts = np.cumsum(lengths + ORDER) - lengths  # of the bytes to predict: a text and the mark after it
        left: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(ORDER, len(data) - ORDER + 1, _STEP):
            to = min(at + _STEP, len(data) - ORDER + 1)
            here = np.arange(at, to)
            which = np.searchsorted(starts, here, "right") - 1
            real = here - starts[which] <= lengths[which]
            which, keys = which[real], _grams(data[at - ORDER : to])[real]
            found, logs = table.get(keys)
            out[first:last] += np.bincount(which, logs, last - first)
            left.append((which[~found], keys[~found]))
        which, keys = (np.concatenate(x) for x in zip(*left, strict=True))
        order = np.argsort(which, kind="stable")
        which, keys = which[order], keys[order]
        cuts = np.searchsorted(which, np.arange(last - first + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            rare[first + i], times[first + i] = _runs(keys[cuts[i] : cuts[i + 1]])
        first = last
    return out, rare, times


def counted(docs: DataFrame) -> DataFrame:
    """(word, gram, n): counts of all words, and of all byte grams where word is null, in training documents."""
    train = docs.where(~held_out(F.col("doc_id")))
    parts = train.select("text").mapInArrow(_count, "word binary, gram long, n long")
    return written(parts.groupBy("word", "gram").agg(F.sum("n").alias("n")), "lm-counts")


def _low(gram: str, n: int) -> Column:
    """The latest n bytes."""
    return F.col(gram).bitwiseAND(F.lit((1 << 8 * n) - 1).cast("long"))


def _seen(grams: DataFrame) -> DataFrame:
    """(gram, n, logp) of all grams of the training text."""
    node = Window.partitionBy(F.shiftright("gram", 8))  # at most 256 rows
    rows = grams.select("gram", "n", F.sum("n").over(node).alias("t"), F.count(F.lit(1)).over(node).alias("d"))
    return rows.select("gram", "n", F.log10(F.col("n") / (F.col("t") + F.col("d"))).alias("logp"))


def _common_from(seen: DataFrame) -> int:
    """The smallest count such that at most MAX_GRAMS grams have it or more."""
    top = 1 << 16
    sizes = seen.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    held, at = 0, 1 << 62
    for n, rows in sorted(map(tuple, sizes), reverse=True):
        held += rows
        if held > MAX_GRAMS:
            break
        at = n
    return at


def _never_seen(novel: DataFrame, grams: DataFrame, total: int) -> DataFrame:
    """(gram, logp) of grams that the training text does not have, by escapes to shorter contexts.

    What a context has seen its suffix has seen too.  A context's ``s`` is the sum of its suffix's counts
    of the bytes that it has seen itself, all of which are excluded there.  Only nodes that a gram escapes
    through are put together.
    """
    kinds = grams.select(_low("gram", 1)).distinct().count()
    x = novel
    for k in range(ORDER, 0, -1):
        m = grams.groupBy(_low("gram", k + 1).alias("g")).agg(F.sum("n").alias("n"))
        m = m.withColumn("p", F.sum("n").over(Window.partitionBy(_low("g", k))))  # at most 256 rows
        m = m.withColumn("ctx", F.shiftright("g", 8))
        if k > 2:  # no more than 65,536 contexts otherwise
            m = m.join(novel.select(F.shiftright(_low("gram", k + 1), 8).alias("ctx")).distinct(), "ctx", "left_semi")
        nodes = m.groupBy("ctx").agg(
            F.sum("n").alias("t"),
            F.count(F.lit(1)).alias("d"),
            F.sum("p").alias("s"),
            F.map_from_entries(F.collect_list(F.struct(_low("g", 1).alias("b"), "n"))).alias("m"),
        )
        nodes = F.broadcast(nodes) if k <= 2 else nodes
        x = x.withColumn("ctx", F.shiftright(_low("gram", k + 1), 8)).join(nodes, "ctx", "left")
        x = x.withColumn("c", F.col("m")[_low("gram", 1)]).drop("ctx", "m")
        x = x.withColumnsRenamed({name: f"{name}{k}" for name in "tdsc"})
    bytes_ = grams.groupBy(_low("gram", 1).alias("b")).agg(F.sum("n").alias("c0"))
    x = x.withColumn("b", _low("gram", 1)).join(F.broadcast(bytes_), "b", "left")
    x = x.withColumn("t0", F.lit(total).cast("long")).withColumn("d0", F.lit(kinds).cast("long"))
    steps = []
    for k in range(ORDER, -1, -1):
        zero = F.lit(0).cast("long")
        t = F.col(f"t{k}") - (F.coalesce(f"s{k + 1}", zero) if k < ORDER else zero)
        d = F.col(f"d{k}") - (F.coalesce(f"d{k + 1}", zero) if k < ORDER else zero)
        steps.append(F.when(t > 0, F.log10(d / (t + d))).otherwise(F.lit(0.0)).alias(f"e{k}"))
        steps.append(F.log10(F.col(f"c{k}") / (t + d)).alias(f"q{k}"))
    x = x.select("gram", *steps)
    found, left = [], F.lit(0.0)
    for k in range(ORDER, -1, -1):
        found.append(left + F.col(f"q{k}"))
        left = left + F.col(f"e{k}")
    return x.select("gram", F.coalesce(*found, left - F.log10(F.lit(256.0 - kinds))).alias("logp"))


def _lookup(held: tuple[np.ndarray, np.ndarray]) -> Lookup:
    """The table of a broadcast model, made once in a worker."""
    if not _made or _made[0] is not held:
        _made[:] = [held, Lookup(*held)]
    return _made[1]


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per document."""
    spark = docs.sparkSession
    both = counted(docs)
    words = both.where("word IS NOT NULL").select("word", F.col("n").alias("c"))
    grams = both.where("gram IS NOT NULL").select("gram", "n")
    positions = grams.agg(F.sum("n")).first()[0] or 0
    seen_grams = written(_seen(grams), "lm-grams")
    at_least = _common_from(seen_grams)
    held = seen_grams.where(F.col("n") >= at_least).select("gram", "logp").toArrow()  # at most MAX_GRAMS rows
    held = (held.column("gram").to_numpy(), held.column("logp").to_numpy())
    # each training text ends once
    ends = docs.where(~held_out(F.col("doc_id"))).count()
    seen, distinct = words.agg(F.sum("c"), F.count(F.lit(1))).first()
    total, kinds = (seen or 0) + ends, distinct + (ends > 0)
    under = float(total + kinds + 1)
    often = (F.col("c") * MAX_WORDS >= F.lit(total)) & (F.length("word") <= LONG_WORD)
    common = words.where(often).toArrow()  # at most MAX_WORDS rows
    logs = np.log10((common.column("c").to_numpy() + 1) / under)
    known = dict(zip(common.column("word").to_pylist(), logs.tolist(), strict=True))
    model = spark.sparkContext.broadcast((known, held, np.log10((ends + 1) / under)))

    def run(batches):
        table, held, end = model.value
        lookup = _lookup(held)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [prepared(t.as_py()) for t in part.column(3)]
                tokens, hits, base, rare, times = [], [], [], [], []
                for t in texts:
                    n = k = 0
                    s, r, o = end, [], []
                    for w, m in Counter(t.split()).items():
                        n += m
                        if (x := table.get(w)) is None:
                            r.append(w)
                            o.append(m)
                        else:
                            k += m
                            s += m * x
                    tokens.append(n + 1)
                    hits.append(k + (ends > 0))
                    base.append(s)
                    rare.append(r)
                    times.append(o)
                scores, grams, gram_times = score_texts(texts, lookup)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        part.column(2),
                        pa.array(tokens, pa.int64()),
                        pa.array(hits, pa.int64()),
                        pa.array(base, pa.float64()),
                        pa.array(scores, pa.float64()),
                        pa.array(rare, pa.list_(pa.binary())),
                        pa.array(times, pa.list_(pa.int32())),
                        pa.array(grams, pa.list_(pa.int64())),
                        pa.array(gram_times, pa.list_(pa.int64())),
                    ],
                    [
                        "uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "score",
                        "rare", "times", "grams", "gram_times",
                    ],
                )

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        "text",
    ).mapInArrow(
        run,
        "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
        "rare array<binary>, times array<int>, grams array<long>, gram_times array<long>",
    )
    rows = written(rows, "lm-rows")
    model.destroy()  # its rows are stored
    pairs = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "uid", F.col("x.rare").alias("word"), F.col("x.times").alias("m")
    )
    found = pairs.join(words.where(~often), "word", "left")
    tails = found.groupBy("uid").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("m")).otherwise(0)).alias("k"),
        F.sum(F.col("m") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(under))).alias("s"),
    )
    met = rows.select("uid", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select(
        "uid", F.col("x.grams").alias("gram"), F.col("x.gram_times").alias("m")
    )
    seldom = seen_grams.where(F.col("n") < at_least).select("gram", "logp")
    novel = written(met.select("gram").distinct().join(seldom, "gram", "left_anti"), "lm-novel")
    logs = seldom.unionAll(_never_seen(novel, grams, positions))
    sums = met.join(logs, "gram").groupBy("uid").agg(F.sum(F.col("m") * F.col("logp")).alias("g"))
    rows = rows.drop("rare", "times", "grams", "gram_times").join(tails, "uid", "left").join(sums, "uid", "left")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("s", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("g", F.lit(0.0))).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    return score(docs)
