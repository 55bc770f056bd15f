"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is hidden in turn and predicted from the words around it; the sum of the log
probabilities of the words that stood there scores the document. The network adds up an embedding
for each word and offset of the window and applies a softmax of two levels, groups of word classes
and the classes of a group: the most frequent
words of the corpus are classes of their own, all others share classes by their hash. A word's
probability is that of its class, times its share of the class. Shares come from the counts of all
words: ``count / (N + s + 1)`` with the ``N`` occurrences in the class and its ``s`` words seen
once; a word never seen has ``(s + 1) / (N + s + 1)`` divided by one more than all words counted.

The corpus trains it where it lies. Words are counted over all documents. Then every task trains a
copy of the network on the documents it holds, in each round on a word in ``stride`` of every
document, so that ``stride`` rounds visit every word once,
and the copies are averaged by the number of words they have seen, part by part on executors, so
that the driver gets one network whatever the number of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..durable import materialise
from .rows import fresh, append, bounded_batches, schema_of, text_key, without
from .shingles import words_of_texts

OFFSETS = (-2, -1, 1, 2)
_BATCH, _PARTS, _SALTS = 1024, 16, 64
#: Bytes of text worked on at once, so that the arrays of their words stay in the cache.
_PIECE = 1 << 18
#: The bias of a place that no class has.
_NEVER = -1e30


@dataclass
class Vocabulary:
    frequent: np.ndarray  # sorted hashes of the words that are classes of their own
    shared: int           # classes of all other words
    total: np.ndarray     # log(N + s + 1) of each shared class
    unseen: np.ndarray    # log of what stands for the count of a word never seen, by shared class
    common: np.ndarray    # sorted hashes of words that make up a known part of the corpus
    logs: np.ndarray      # log counts of those
    rare: DataFrame | None = None  # (word, count) of the other words; None if there are none

    @property
    def classes(self) -> int:
        return len(self.frequent) + self.shared

    def hashes(self, text: str | None) -> np.ndarray:
        return words_of_texts([text])[0]

    @cached_property
    def _frequent(self) -> _Places:
        return _Places(self.frequent)

    @cached_property
    def _common(self) -> _Places:
        return _Places(self.common)

    def classes_of(self, h: np.ndarray) -> np.ndarray:
        at, own = self._frequent.found(h)
        shared = np.uint64(self.shared)
        return np.where(own, at, len(self.frequent) + (h - h // shared * shared).astype(np.int64))

    def of(self, text: str | None) -> np.ndarray:
        """The class of each word."""
        return self.classes_of(self.hashes(text))

    def shares(self, h: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of words in their classes, and which words only ``rare`` tells; those count
        as never seen here. ``classes`` are those of the words, if they are known."""
        c = (self.classes_of(h) if classes is None else classes) - len(self.frequent)
        other, logs, rare = np.flatnonzero(c >= 0), np.zeros(len(h)), np.zeros(len(h), bool)
        c, (at, common) = c[other], self._common.found(h[other])
        logs[other] = np.where(common, self.logs[at] if len(self.logs) else 0.0, self.unseen[c]) - self.total[c]
        rare[other] = ~common
        return logs, rare


class _Places:
    """Places of hashes in a sorted table, looked for from where their first bits begin."""

    def __init__(self, table: np.ndarray):
        bits = len(table).bit_length() + 2
        self.table, self.shift = table, np.uint64(64 - bits)
        self.first = np.searchsorted(table, np.arange(1 << bits, dtype=np.uint64) << self.shift)

    def found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each hash, and whether the table holds it."""
        if not len(self.table):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        last = len(self.table) - 1
        at = np.minimum(self.first.take(h >> self.shift), last)
        value = self.table.take(at)
        on = np.flatnonzero((value < h) & (at < last))
        while len(on):
            at[on] += 1
            value[on] = self.table.take(at[on])
            on = on[(value[on] < h[on]) & (at[on] < last)]
        return at, value == h


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) over all documents; ``word`` is its hash. Tasks add up before they send."""
    def run(batches):
        for batch in bounded_batches(batches, 64 << 20):
            words, counts = np.unique(words_of_texts(batch.column(0).to_pylist())[0],
                                      return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {"word": pa.array(words.view(np.int64)), "count": pa.array(counts, pa.int64())})

    return (docs.select(text).mapInArrow(run, "word long, count long")
            .groupBy("word").agg(F.sum("count").alias("count")))


def vocabulary(docs: DataFrame, frequent: int = 384, shared: int = 128, text: str = "text",
               common: int = 1 << 18) -> Vocabulary:
    """Classes and shares of all words of ``docs``.

    Classes grow with the square root of the number of different words; ``frequent`` and
    ``shared`` are the least numbers of both kinds. Words that make up at least one ``common``th
    of the corpus, so at most ``common`` words, come to the driver; the others stay in a table.
    """
    counts = materialise(count_words(docs, text), "words")
    # Octaves of counts, in sixteenths: from them follows what the most frequent words have at least.
    steps = (counts.groupBy(F.floor(F.log2("count") * 16).alias("step"))
             .agg(F.count(F.lit(1)).alias("words"), F.sum("count").alias("held"),
                  F.min("count").alias("least")).orderBy(F.desc("step")).collect())
    n_words, held = sum(r.words for r in steps), sum(r.held for r in steps)
    frequent = max(frequent, int(n_words ** 0.5 / 4))
    shared = max(shared, int(n_words ** 0.5 / 12))
    least, above = 1, 0
    for r in steps:
        least, above = r.least, above + r.words
        if above >= frequent:
            break
    top = _unsigned(counts.filter(F.col("count") >= least).orderBy(F.desc("count"), "word")
                    .limit(frequent).select("word").toArrow()["word"])
    words = Vocabulary(np.sort(top), shared, np.zeros(shared), np.zeros(shared),
                       np.empty(0, np.uint64), np.empty(0))
    known = counts.sparkSession.sparkContext.broadcast(words.frequent)

    def run(batches):
        sums, own = np.zeros((2, shared), np.int64), _Places(known.value)
        for batch in batches:
            h, n = _unsigned(batch.column(0)), batch.column(1).to_numpy()
            h, n = (x[~own.found(h)[1]] for x in (h, n))
            c = (h % np.uint64(shared)).astype(np.int64)
            np.add.at(sums[0], c, n)
            np.add.at(sums[1], c, n == 1)
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_pydict({"at": pa.array(at), "held": sums[0][at], "once": sums[1][at]})

    for r in (counts.mapInArrow(run, "at long, held long, once long").groupBy("at")
              .agg(F.sum("held").alias("held"), F.sum("once").alias("once")).collect()):
        words.total[r["at"]], words.unseen[r["at"]] = np.log(r.held + r.once + 1), np.log(r.once + 1)
    words.unseen -= np.log(n_words + 1)
    border = F.col("count") >= max(1, -(-held // common))
    told = counts.filter(border).toArrow()
    order = np.argsort(_unsigned(told["word"]))
    words.common = _unsigned(told["word"])[order]
    words.logs = np.log(told["count"].to_numpy())[order]
    if len(order) < n_words:
        words.rare = counts.filter(~border)
    return words


def _unsigned(column) -> np.ndarray:
    return column.to_numpy().astype(np.int64).view(np.uint64)


class Network:
    """Arrays ``e`` (offset, class or outside, width), ``w`` (width, group), ``b`` (group), ``v``
    (group, width, member) and ``c`` (group, member).

    The softmax has two levels: log P(class) = log P(group) + log P(class | group), with about as
    many groups as members. Class ``k`` is member ``k // groups`` of group ``k % groups``, so that
    classes of many words lie in different groups; last places that no class has are so unlikely
    that they weigh nothing.
    """

    def __init__(self, classes: int, width: int, seed: int):
        rng = np.random.default_rng(seed)
        self.classes, self.groups = classes, max(1, int(np.ceil(classes ** 0.5)))
        groups, members = self.groups, -(-classes // self.groups)
        self.e = rng.normal(0, 0.1, (len(OFFSETS), classes + 1, width)).astype(np.float32)
        self.w = rng.normal(0, 0.1, (width, groups)).astype(np.float32)
        self.b = np.zeros(groups, np.float32)
        self.v = rng.normal(0, 0.1, (groups, width, members)).astype(np.float32)
        self.c = np.zeros((groups, members), np.float32)
        self.c[np.arange(groups * members).reshape(members, groups).T >= classes] = _NEVER

    def _arrays(self) -> tuple[np.ndarray, ...]:
        return self.e, self.w, self.b, self.v, self.c

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self._arrays()])

    def load(self, flat: np.ndarray) -> Network:
        at = 0
        for a in self._arrays():
            a[...] = flat[at:at + a.size].reshape(a.shape)
            at += a.size
        return self

    def hidden(self, around: np.ndarray) -> np.ndarray:
        h = self.e[0].take(around[:, 0], axis=0)
        for o in range(1, len(OFFSETS)):
            h += self.e[o].take(around[:, o], axis=0)
        return h

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Log probabilities of all classes."""
        outer, inner = h @ self.w + self.b, np.einsum("nd,gdk->ngk", h, self.v) + self.c
        outer, inner = (z - np.log(t) for z, _, t in (_exponentials(z) for z in (outer, inner)))
        return (outer[:, :, None] + inner).swapaxes(1, 2).reshape(len(h), -1)[:, :self.classes]

    def tame(self) -> bool:
        """Whether no window at all gives a score whose exponential leaves the range of doubles."""
        h = sum(np.sqrt((e * e).sum(axis=1).max()) for e in self.e)
        used = self.c[self.c > _NEVER / 2]
        return bool(h * np.sqrt((self.w * self.w).sum(axis=0).max()) + np.abs(self.b).max() < 700
                    and h * np.sqrt((self.v * self.v).sum(axis=1).max()) + np.abs(used).max() < 700)

    def log_probabilities(self, around: np.ndarray, center: np.ndarray) -> np.ndarray:
        """Log probability of each center given its window, by blocks that stay in the cache.

        Each word is worked out by itself, so it does not matter what shares its block.
        """
        out, tame = np.empty(len(center)), self.tame()
        for at in range(0, len(center), _BATCH // 4):
            part = slice(at, at + _BATCH // 4)
            h = self.hidden(around[part])[:, None]
            member, group = np.divmod(center[part], self.groups)
            n, logs = np.arange(len(h)), 0.0
            for z, own in ((np.einsum("nd,dg->ng", h[:, 0], self.w) + self.b, group),
                           ((h @ self.v.take(group, axis=0))[:, 0] + self.c.take(group, axis=0), member)):
                z, _, total = _exponentials(z.astype(float), tame)
                logs = logs + z[n, own] - np.log(total[:, 0])
            out[part] = logs
        return out

    def learn(self, around: np.ndarray, center: np.ndarray, memory: Network, rate: float) -> None:
        """One step on a batch; ``memory`` holds the sums of squared gradients."""
        n, scale = np.arange(len(center)), np.float32(1 / len(center))
        member, group = np.divmod(center, self.groups)
        h = self.hidden(around)

        def step(value, past, gradient):
            past += gradient * gradient
            value -= rate * gradient / np.sqrt(past + 1e-8)

        _, p, total = _exponentials(h @ self.w + self.b)
        p *= scale / total
        p[n, group] -= scale
        back = p @ self.w.T
        step(self.w, memory.w, h.T @ p)
        step(self.b, memory.b, np.ones(len(p), np.float32) @ p)
        # The words of each group side by side, as many places for each as the largest one needs.
        order, first, met = _by_value(group)
        held = np.diff(np.r_[first, len(order)])
        at = np.empty_like(order)
        at[order] = np.repeat(met * held.max() - first, held) + n
        some = np.zeros((len(self.b) * held.max(), h.shape[1]), np.float32)
        used = np.zeros((len(some), 1), np.float32)
        some[at], used[at] = h, scale
        some = some.reshape(len(self.b), -1, h.shape[1])
        _, full, total = _exponentials(some @ self.v + self.c[:, None])
        full *= used.reshape(total.shape) / total
        full.reshape(-1, full.shape[2])[at, member] -= scale
        back += (full @ self.v.transpose(0, 2, 1)).reshape(-1, h.shape[1])[at]
        step(self.v, memory.v, some.transpose(0, 2, 1) @ full)
        step(self.c, memory.c, np.ones(full.shape[1], np.float32) @ full)
        for o in range(len(OFFSETS)):  # only the embeddings that the batch meets
            order, first, met = _by_value(around[:, o])
            gradient = np.add.reduceat(back.take(order, axis=0), first, axis=0)
            past = memory.e[o].take(met, axis=0) + gradient * gradient
            memory.e[o][met] = past
            self.e[o][met] -= rate * gradient / np.sqrt(past + 1e-8)


def _exponentials(z: np.ndarray, tame: bool | None = None):
    """Scores, their exponentials and the sums of these along the last axis.

    ``tame`` scores are taken as they are, others less the largest one, which is a slow look for;
    None leaves it to the scores themselves.
    """
    ones = np.ones((z.shape[-1], 1), z.dtype)
    if tame or tame is None and z.max(initial=0) < 80:
        e = np.exp(z)
        total = e @ ones
        if tame or total.min(initial=1) > 1e-30:
            return z, e, total
    z = z - z.max(axis=-1, keepdims=True)
    e = np.exp(z)
    return z, e, e @ ones


def _by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by value, where each distinct value starts in it, and these values."""
    if values.max(initial=0) < 1 << 16:
        values = values.astype(np.uint16)  # sorted by digits
    order = np.argsort(values, kind="stable")
    held = values[order]
    new = np.ones(len(held), bool)
    np.not_equal(held[1:], held[:-1], out=new[1:])
    first = np.flatnonzero(new)
    return order, first, held[first]


def windows(ids: np.ndarray, outside: int, sizes: np.ndarray | None = None,
            pick: np.ndarray | slice = slice(None)) -> np.ndarray:
    """The classes around each word that ``pick`` picks; beyond the ends of a text stands
    ``outside``. ``sizes`` are the numbers of words of texts that follow one another in ``ids``;
    without them it is one."""
    sizes = np.array([len(ids)]) if sizes is None else sizes
    reach = max(map(abs, OFFSETS))
    # Every text is followed, and the first one preceded, by places outside.
    at = np.arange(len(ids)) + reach * (1 + np.repeat(np.arange(len(sizes)), sizes))
    padded = np.full(len(ids) + reach * (len(sizes) + 1), outside)
    padded[at] = ids
    at = at[pick]
    return np.stack([padded.take(at + o) for o in OFFSETS]).T  # each offset's classes side by side


def _trained(docs: DataFrame, words: Vocabulary, network: Network, stride: int, phase: int,
             rate: float, text: str) -> Network:
    """The average of the networks that all tasks make of ``network``."""
    start, width = network.flat(), network.w.shape[0]
    shared = docs.sparkSession.sparkContext.broadcast((replace(words, rare=None), start))

    def train(batches):
        vocabulary, flat = shared.value
        own = Network(vocabulary.classes, width, 0).load(flat)
        memory = Network(vocabulary.classes, width, 0).load(np.zeros_like(flat))
        held, waiting, seen = [], 0, 0

        def step():
            around, center = (np.concatenate(c) for c in zip(*held))
            for at in range(0, len(center), _BATCH):
                own.learn(around[at:at + _BATCH], center[at:at + _BATCH], memory, rate)
            return len(center)

        for batch in bounded_batches(batches, 4 << 20):
            for piece in bounded_batches([batch], _PIECE):
                texts = piece.column(0).to_pylist()
                h, sizes = words_of_texts(texts)
                ids = vocabulary.classes_of(h)
                # An offset from the text itself: texts of few words take turns as well.
                turn = np.array([crc32((t or "").encode()) % stride for t in texts], np.int64)
                place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes + turn, sizes)
                pick = np.flatnonzero((place - phase) % stride == 0)
                held.append((windows(ids, vocabulary.classes, sizes, pick), ids[pick]))
                waiting += len(pick)
            if waiting >= 16 * _BATCH:
                seen += step()
                held, waiting = [], 0
        if waiting:
            seen += step()
        if seen:
            parts = np.array_split(own.flat().astype(np.float64) * seen, _PARTS)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(range(_PARTS), pa.int32()),
                "salt": pa.array([seen % _SALTS] * _PARTS, pa.int32()),
                "seen": pa.array([seen] * _PARTS, pa.int64()),
                "sums": [p.tobytes() for p in parts]})

    def add(batches):
        total: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for part, seen, sums in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                n, s = total.get(part, (0, 0.0))
                total[part] = (n + seen, s + np.frombuffer(sums))
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(list(total), pa.int32()),
            "salt": pa.array([0] * len(total), pa.int32()),
            "seen": pa.array([n for n, _ in total.values()], pa.int64()),
            "sums": pa.array([s.tobytes() for _, s in total.values()], pa.binary())})

    schema = "part int, salt int, seen long, sums binary"
    rows = (docs.select(text).mapInArrow(train, schema)
            .repartition("part", "salt").mapInArrow(add, schema)
            .repartition(_PARTS, "part").mapInArrow(add, schema).collect())
    if not rows:
        return network
    flat = np.concatenate([np.frombuffer(r.sums) / r.seen
                           for r in sorted(rows, key=lambda r: r.part)])
    return Network(words.classes, width, 0).load(flat)


def fit_network(docs: DataFrame, frequent: int = 384, shared: int = 128, width: int = 16,
                stride: int = 2, rounds: int = 2, rate: float = 0.3, seed: int = 1,
                text: str = "text") -> tuple[Vocabulary, Network]:
    """Count all words and train on one word in ``stride`` of all documents in each round.

    With as many rounds as ``stride`` every word of ``docs`` is a target once, in texts of any
    length; fewer rounds are a sample. A corpus without words leaves the network untrained.
    """
    words = vocabulary(docs, frequent, shared, text)
    network = Network(words.classes, width, seed)
    for phase in range(rounds):
        network = _trained(docs, words, network, stride, phase, rate, text)
    return words, network


def _rare_shares(source: DataFrame, words: Vocabulary, shared, text: str) -> DataFrame:
    """(_key, _check, _more) for rows with words that only ``words.rare`` tells: what their counts
    add to the sum of logs."""
    def run(batches):
        vocabulary = shared.value[0]
        for piece in bounded_batches(batches, _PIECE):
            key, check = (piece.column(i).to_numpy() for i in (0, 1))
            h, sizes = words_of_texts(piece.column(2).to_pylist())
            rare = vocabulary.shares(h)[1]
            h, row = h[rare], np.repeat(np.arange(len(sizes)), sizes)[rare]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            first = np.flatnonzero(new)
            row = row[first]
            if len(row):
                yield pa.RecordBatch.from_pydict({
                    "_key": key[row], "_check": check[row],
                    "_words": np.bincount(row)[row], "n": np.diff(first, append=len(h)),
                    "word": h[first].view(np.int64)})

    def gained(batches):
        vocabulary = shared.value[0]
        for batch in batches:
            c = (_unsigned(batch.column(0)) % np.uint64(vocabulary.shared)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "word": batch.column(0),
                "gain": pa.array(np.log(batch.column(1).to_numpy()) - vocabulary.unseen[c])})

    # Of equal rows each sends its words: a key has ``_words`` rows for each of them.
    return (source.select("_key", "_check", text)
            .mapInArrow(run, "_key long, _check long, _words long, n long, word long")
            .join(words.rare.select("word", "count").mapInArrow(gained, "word long, gain double"),
                  "word", "left").groupBy("_key", "_check")
            .agg((F.sum(F.expr("n * coalesce(gain, 0)")) * F.max("_words")
                  / F.count(F.lit(1))).alias("_more")))


def score_documents(docs: DataFrame, words: Vocabulary, network: Network,
                    text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``n_tokens``, ``pseudo_log_likelihood`` (the sum over all words, each given
    the two words on both sides) and ``per_token`` (its mean, null without words).

    A null, empty or blank text has no words and sum 0. Rows are scored one by one on the whole
    text, repeated rows alike. Columns of ``docs`` with the new names are replaced. Shares of rare
    words are joined by the word; rows are told by ``doc_id``, if there is one, and text.
    """
    made = {"n_tokens": "long", "pseudo_log_likelihood": "double", "per_token": "double"}
    keep = without(docs, list(made))
    source = docs.select(*keep) if text in keep else docs.select(*keep, text)
    shared = docs.sparkSession.sparkContext.broadcast((replace(words, rare=None), network))
    if words.rare is not None:
        key = text_key(doc_id, text) if doc_id in source.columns else F.xxhash64(text)
        own, check, more = fresh(source, "_key", "_check", "_more")
        source = source.withColumns({own: key, check: F.hash(text).cast("long")})
        rare = _rare_shares(source.select(F.col(own).alias("_key"), F.col(check).alias("_check"), text),
                            words, shared, text).toDF(own, check, more)
        keep = [*keep, own, check]

    def scored(vocabulary, net, texts):
        h, sizes = words_of_texts(texts)
        ids = vocabulary.classes_of(h)
        logs = (net.log_probabilities(windows(ids, vocabulary.classes, sizes), ids)
                + vocabulary.shares(h, ids)[0])
        return sizes, np.bincount(np.repeat(np.arange(len(sizes)), sizes), logs, len(sizes))

    def run(batches):
        vocabulary, net = shared.value
        for batch in bounded_batches(batches, 4 << 20):
            texts = batch.select([text])
            sizes, sums = (np.concatenate(c) for c in zip(*(
                scored(vocabulary, net, piece.column(0).to_pylist())
                for piece in bounded_batches([texts], _PIECE))))
            yield append(batch, keep, {
                "n_tokens": pa.array(sizes), "pseudo_log_likelihood": pa.array(sums),
                "per_token": pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)})

    ddl = ", ".join(f"{k} {v}" for k, v in made.items())
    scored = source.mapInArrow(run, schema_of(source, keep, ddl))
    if words.rare is None:
        return scored
    total = F.col("pseudo_log_likelihood") + F.coalesce(more, F.lit(0.0))
    return (scored.join(rare, [own, check], "left")
            .withColumns({"pseudo_log_likelihood": total,
                          "per_token": F.when(F.col("n_tokens") > 0, total / F.col("n_tokens"))})
            .drop(own, check, more))
