"""LM scoring by masked pseudo-likelihood.

1. Words are counted over all documents. The commonest are tokens of their own; each of the rest
   belongs to the token of its ending (the commonest endings of three bytes, then of two), within which
   it has the share of its count, so that every word has a probability of its own.
2. A window network predicts each token from the tokens on both sides of it: a table a position sums
   into a hidden layer, and the answer is a group of tokens, then a token of the group. It starts from
   the counts, as a unigram model does.
3. Documents are dealt by a hash to shards of a fixed size, whatever files they come from. In each round
   every shard trains a copy on all its tokens, and the copies are averaged by the windows they saw.
4. A document's score is the sum of its words' conditional log-probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, words, written

GROUPS, EACH = 32, 64
SIZE = GROUPS * EACH
ENDINGS = {3: 600, 2: 199}  # endings that have a token, by their bytes; one more token has all other words
OTHERS = sum(ENDINGS.values()) + 1
KNOWN = SIZE - OTHERS
COUNTED = 200_000  # commonest words whose counts go to the tasks; those of others are joined
HIDDEN, SIDE = 16, 2
PAD = SIZE
SHARD = 4_000_000  # tokens a shard
PARTS = 50_000  # tasks that train at most; beyond it a task trains several shards, one after another
ROUNDS = 2
_OFFSETS = [d for d in range(-SIDE, SIDE + 1) if d]
BATCH = 16384


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all documents; tasks add up before the shuffle, within a bound. Null texts have no words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words(text))
            if len(held) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("text").cast("string")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Tokens(dict):
    """Numbers of words: known ones by rank, the rest by their ending; a worker keeps those it met, up to a bound.

    Words whose counts are at hand have numbers from SIZE on, each with its token in `token` and the logarithm of its
    count in `gain`. `times` holds how often each token stands in the documents, at least one.
    """

    def __init__(self, known: list[bytes], endings: dict[bytes, int], times: np.ndarray, counted: dict[bytes, int] | None = None):
        super().__init__({w: k for k, w in enumerate(known)})
        self.known, self.endings, self.times = dict(self), endings, times
        counted = counted or {}
        self.token = np.concatenate([np.arange(SIZE), np.array([self.ending(w) for w in counted], np.int64)]).astype(np.int32)
        self.gain = np.concatenate([np.zeros(SIZE), np.log(np.array(list(counted.values()), np.float64))])
        self.update({w: SIZE + k for k, w in enumerate(counted)})
        self.fixed = dict(self)

    def ending(self, word: bytes) -> int:
        for n in ENDINGS:
            if word[-n:] in self.endings:
                return self.endings[word[-n:]]
        return SIZE - 1

    def __missing__(self, word: bytes) -> int:
        if len(self) > 600_000:
            self.clear()
            self.update(self.fixed)
            if word in self:
                return self[word]
        value = self[word] = self.ending(word)
        return value

    def numbers(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def _commonest(counts: DataFrame, most: int) -> list:
    """Rows of counts(word, n) from the greatest counts down, in whole classes of count, up to a number; the classes are few, as they are of logarithms."""
    grade = F.floor(F.log("n") * 64)
    left, least = most, None
    for r in sorted(counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("m")).collect(), key=lambda r: -r["grade"]):
        left -= r["m"]
        if left < 0:
            break
        least = r["grade"]
    return counts.where(grade >= least).collect() if least is not None else []


def vocabulary(counts: DataFrame) -> Tokens:
    """The commonest words and endings of counts(word, n), ties by bytes; COUNTED and SIZE of them, which bounds what the driver holds."""
    spark = counts.sparkSession
    top = counts.orderBy(F.desc("n"), "word").limit(KNOWN).collect()
    known = [bytes(r["word"]) for r in top]
    times = np.ones(SIZE)
    times[: len(top)] = [r["n"] for r in top]
    names = spark.createDataFrame([(bytearray(w),) for w in known], "word binary")
    rare = counts.join(F.broadcast(names), "word", "left_anti")
    endings: dict[bytes, int] = {}
    for n, most in ENDINGS.items():
        ending = F.expr(f"substring(word, -{n}, {n})")
        found = rare.where(F.octet_length("word") >= n).groupBy(ending.alias("ending")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "ending").limit(most).collect()
        for k, r in enumerate(found):
            endings[bytes(r["ending"])] = KNOWN + sum(m for size, m in ENDINGS.items() if size > n) + k
    shared = spark.sparkContext.broadcast(Tokens(known, endings, times))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told, sums = shared.value, np.zeros(OTHERS, np.int64)
        for batch in batches:
            np.add.at(sums, told.numbers(batch.column(0).to_pylist()) - KNOWN, batch.column(1).to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(OTHERS)), pa.array(sums)], ["k", "n"])

    for r in rare.select("word", "n").mapInArrow(totals, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where("n > 0").collect():
        times[KNOWN + r["k"]] = r["n"]
    known_set = set(known)
    counted = {w: r["n"] for r in _commonest(counts, COUNTED) if (w := bytes(r["word"])) not in known_set}
    return Tokens(known, endings, times, counted)


def padded(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in one array with SIDE pads before, between and after, and the places of their tokens."""
    gap = np.full(SIDE, PAD, np.int32)
    parts = [gap]
    for d in documents:
        parts += [d, gap]
    flat = np.concatenate(parts)
    return flat, np.flatnonzero(flat != PAD)


class Network:
    """Parameters by name, all float32. With how often tokens occur it starts as a unigram model."""

    def __init__(self, times: np.ndarray | None = None, seed: int = 5):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        share = (np.ones(SIZE) if times is None else np.asarray(times, float)).reshape(GROUPS, EACH)
        start = lambda x: np.log(x).astype(np.float32)
        self.p = {"tables": draw(len(_OFFSETS), SIZE + 1, HIDDEN), "bias": np.zeros(HIDDEN, np.float32), "wc": draw(HIDDEN, GROUPS) * 0, "bc": start(share.sum(1) / share.sum()), "wt": draw(GROUPS, HIDDEN, EACH) * 0, "bt": start(share / share.sum(1)[:, None])}

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def hidden(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = self.p["bias"] + self.p["tables"][0][flat[at + _OFFSETS[0]]]
        for k in range(1, len(_OFFSETS)):
            h += self.p["tables"][k][flat[at + _OFFSETS[k]]]
        return np.tanh(h, out=h)

    def log_probs(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log P(token | window) at places of a padded array."""
        out = np.empty(len(at), np.float64)
        for s in range(0, len(at), 65536):
            here = at[s : s + 65536]
            target = flat[here]
            order = np.argsort((target // EACH).astype(np.uint8), kind="stable")
            h, target = self.hidden(flat, here[order]), target[order]
            group, token = target // EACH, target % EACH
            logits = h @ self.p["wc"] + self.p["bc"]
            rows = np.arange(len(here))
            value = logits[rows, group] - _log_sum(logits)
            edges = np.searchsorted(group, np.arange(GROUPS + 1))
            for c in range(GROUPS):
                a, b = edges[c], edges[c + 1]
                if a < b:
                    inner = h[a:b] @ self.p["wt"][c] + self.p["bt"][c]
                    value[a:b] += inner[np.arange(b - a), token[a:b]] - _log_sum(inner)
            out[s + order] = value
        return out


def _log_sum(x: np.ndarray) -> np.ndarray:
    return np.log(np.exp(np.minimum(x, 80)).sum(1))


class Trainer:
    """Adagrad on a network, a batch of windows at a time."""

    def __init__(self, network: Network, rate: float = 0.2):
        self.n, self.rate = network, rate
        self.square = {k: np.full(v.shape, 1e-4, np.float32) for k, v in network.p.items()}

    def _step(self, name: str, gradient: np.ndarray, where=slice(None)) -> None:
        square = self.square[name]
        square[where] += gradient * gradient
        self.n.p[name][where] -= self.rate * gradient / np.sqrt(square[where])

    def batch(self, flat: np.ndarray, at: np.ndarray) -> None:
        target = flat[at]
        order = np.argsort((target // EACH).astype(np.uint8), kind="stable")
        at, target = at[order], target[order]
        group, token, size = target // EACH, target % EACH, np.float32(len(at))
        p = self.n.p
        h = self.n.hidden(flat, at)
        g = _softmax(h @ p["wc"] + p["bc"])
        g[np.arange(len(at)), group] -= 1
        g /= size
        dh = g @ p["wc"].T
        changes = [("wc", h.T @ g, slice(None)), ("bc", g.sum(0), slice(None))]
        wt, bt = np.zeros_like(p["wt"]), np.zeros_like(p["bt"])
        edges = np.searchsorted(group, np.arange(GROUPS + 1))
        for c in range(GROUPS):
            a, b = edges[c], edges[c + 1]
            if a < b:
                g = _softmax(h[a:b] @ p["wt"][c] + p["bt"][c])
                g[np.arange(b - a), token[a:b]] -= 1
                g /= size
                dh[a:b] += g @ p["wt"][c].T
                wt[c], bt[c] = h[a:b].T @ g, g.sum(0)
        changes += [("wt", wt, slice(None)), ("bt", bt, slice(None))]
        dh *= 1 - h * h
        self._step("bias", dh.sum(0))
        columns = np.ascontiguousarray(dh.T, np.float64)
        for k, d in enumerate(_OFFSETS):
            near = flat[at + d]
            self._step("tables", np.array([np.bincount(near, c, SIZE + 1) for c in columns]).T.astype(np.float32), k)
        for name, gradient, where in changes:
            self._step(name, gradient, where)


def _softmax(x: np.ndarray) -> np.ndarray:
    np.exp(np.minimum(x, 80, out=x), out=x)  # hidden values lie within one, so that no logit is anywhere near
    x /= x.sum(1)[:, None]
    return x


def _trained(start: np.ndarray, documents: Iterator[np.ndarray], seed: int, turn: int, batch: int) -> tuple[np.ndarray, int]:
    """A copy trained on every token of documents, half a million at a time in a mixed order, and the tokens seen."""
    copy = Network().load(start)
    trainer, seen = Trainer(copy, 0.2 / (1 + turn)), 0
    held: list[np.ndarray] = []
    size = 0

    def learn() -> int:
        flat, at = padded(held)
        np.random.default_rng([seed, seen, turn]).shuffle(at)
        for s in range(0, len(at), batch):
            trainer.batch(flat, at[s : s + batch])
        return len(at)

    for ids in documents:
        held.append(ids)
        size += len(ids)
        if size > 500_000:
            seen += learn()
            held, size = [], 0
    if size:
        seen += learn()
    return copy.flat(), seen


BLOCK = 4096  # parameters a row of the averaging


def encoded(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """(row, doc_id, h, n_tokens, ids, gain, rare, times) of each row: token numbers as 16-bit integers, and of its words that are no tokens of their own the sum of the logarithms of their counts.

    Words whose counts the tasks lack are in rare, with how often they stand.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        told = shared.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            lengths, ids, gains, rare, times = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = words(text)
                numbers = told.numbers(found)
                odd = Counter([found[k] for k in np.flatnonzero((numbers >= KNOWN) & (numbers < SIZE)).tolist()])
                gains.append(float(told.gain[numbers].sum()))
                lengths.append(len(found))
                ids.append(told.token[numbers].astype("<u2").tobytes())
                rare.append(list(odd))
                times.append(list(odd.values()))
            n = len(lengths)
            columns = [pa.array(np.arange(row, row + n)), batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(gains, pa.float64()), pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "h", "n_tokens", "ids", "gain", "rare", "times"])
            row += n

    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("h"), text.alias("text"))
    return kept.mapInArrow(work, "row long, doc_id long, h long, n_tokens long, ids binary, gain double, rare array<binary>, times array<long>")


def train(base: DataFrame, tokens: Tokens, rounds: int = ROUNDS, shard: int = SHARD, batch: int = BATCH) -> Network:
    """A network trained on all rows of encoded documents. The driver holds one set of parameters, tasks one copy and one sum.

    Shards, and the order within them, follow from the documents alone, so that files and partitions
    change nothing but the last digits of the averages.
    """
    spark = base.sparkSession
    network = Network(tokens.times)
    total = base.agg(F.sum("n_tokens")).first()[0] or 0
    shards = max(1, -(-total // shard))
    parts = min(shards, PARTS)
    dealt = base.where("n_tokens > 0").select(F.pmod("h", F.lit(shards)).alias("shard"), "h", "ids")
    dealt = dealt.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "h")
    size = len(network.flat())
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(network.flat())

        def work(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            sums, weight = np.zeros(size), 0
            for number, documents in _by_shard(batches):
                copy, seen = _trained(shared.value, documents, number, turn, batch)
                sums += copy * float(seen)
                weight += seen
            if weight:
                for b in range(0, size, BLOCK):
                    yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([float(weight)]), pa.array([(sums[b : b + BLOCK] / weight).astype("<f4").tobytes()], pa.binary())], ["block", "weight", "part"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for block, weight, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    total = sums.setdefault(block, [0.0, 0.0])
                    total[0] = total[0] + weight * np.frombuffer(part, "<f4").astype(np.float64)
                    total[1] += weight
            for block, (total, weight) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([(total / weight).astype("<f4").tobytes()], pa.binary())], ["block", "part"])

        small_batches(spark)
        copies = dealt.mapInArrow(work, "block int, weight double, part binary")
        rows = copies.repartition("block").mapInArrow(average, "block int, part binary").orderBy("block").collect()
        if rows:
            network = Network().load(np.concatenate([np.frombuffer(r["part"], "<f4") for r in rows]))
    return network


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
    """The documents of each shard, one after another, from batches sorted by shard."""
    rows = ((int(s), np.frombuffer(x, "<u2").astype(np.int32)) for b in batches for s, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
    for number, group in groupby(rows, key=lambda r: r[0]):
        yield number, (ids for _, ids in group)


def score(base: DataFrame, tokens: Tokens, network: Network, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of each row of encoded documents.

    The network tells the ending of a word that is no token of its own; among the words of its ending a
    word has its share of counts, and one that counts lack counts as met once. A null or wordless text
    has no tokens, the sum 0 and no mean. Repeated rows and null ids are kept.
    """
    shared = base.sparkSession.sparkContext.broadcast((network.flat(), np.log(tokens.times[KNOWN:])))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat_, within = shared.value
        model = Network().load(flat_)
        for batch in batches:
            ids = [np.frombuffer(x, "<u2").astype(np.int32) for x in batch.column(3).to_pylist()]
            lengths = batch.column(2).to_numpy()
            flat, at = padded(ids)
            values = model.log_probs(flat, at)
            classed = flat[at] >= KNOWN
            values[classed] -= within[flat[at][classed] - KNOWN]
            values = np.append(values, 0.0)
            starts = np.cumsum(lengths) - lengths
            sums = np.where(lengths > 0, np.add.reduceat(values, np.minimum(starts, len(values) - 1)), 0.0) if len(ids) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums + batch.column(4).to_numpy())], ["row", "doc_id", "n_tokens", "log_prob"])

    small_batches(base.sparkSession)
    scored = base.select("row", "doc_id", "n_tokens", "ids", "gain").mapInArrow(work, "row long, doc_id long, n_tokens long, log_prob double")
    met = base.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), "times")).alias("word", "times"))
    logs = counts.where("n > 1").select("word", F.log("n").alias("log_n"))
    gains = met.join(logs, "word").groupBy("row").agg(F.sum(F.col("times") * F.col("log_n")).alias("gain"))
    whole = scored.join(gains, "row", "left").select("doc_id", "n_tokens", (F.col("log_prob") + F.coalesce("gain", F.lit(0.0))).alias("log_prob"))
    return whole.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def lm_score(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Count words, train and score on the same documents; an empty table gives an empty table, other columns are ignored."""
    counts = written(word_counts(docs), "words")
    tokens = vocabulary(counts)
    # written, as row numbers must be the same for all readers
    base = written(encoded(docs, tokens), "encoded")
    return score(base, tokens, train(base, tokens, rounds), counts)
