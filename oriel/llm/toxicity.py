"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier.

Voters answer yes or abstain by the words of a text. Some are fixed (a small lexicon, insults addressed to a
reader); the others are mined: words and word beginnings whose document frequency among toxic training texts
is far above that among others, divided into lexicons by kind and hash. The label model sees only votes: a
tree-augmented naive Bayes model, whose conditional tables are the voters' accuracies and whose tree holds
their strongest correlations given the class, fitted by expectation-maximisation on the vote patterns of all
texts, with the training labels fixing the class where they are known. A logistic classifier over the
mined features then learns the posterior labels of the training texts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oriel.llm.common import keep_columns, pieces, prepare, text_or_empty
from oriel.session import materialise

WORD = re.compile(r"\w+")
#: Labelled texts that the classifier is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
BITS = 20
PREFIXES = (4, 5, 6, 7)
#: A mined feature occurs in so many toxic training texts at least, with such a z-score of its log odds, and
#: such a share of the training texts that hold it are toxic.
LEAST_TOXIC, LEAST_Z, LEAST_SHARE = 3, 3.5, 0.7
#: Words that a worker remembers before it starts anew; a cache only.
MEMORY_WORDS = 100_000
GROUPS_PER_KIND = 3
LEXICON = frozenset(
    "idiot idiots stupid moron morons imbecile dumb dumbass loser losers scum trash garbage worthless pathetic disgusting clown fool fools "
    "jerk freak creep pig bastard bitch whore slut retard retarded cunt asshole shit fuck fucking crap bullshit vermin filth degenerate "
    "subhuman parasite hate kill die".split()
)
ADDRESS = re.compile(r"\b(?:you|u|your|ye|they|he|she)\W+(?:are|r|re|is)\W+(?:\w+\W+){0,2}?(?:" + "|".join(sorted(LEXICON)) + r")\b")
N_VOTERS = 2 + (1 + len(PREFIXES)) * GROUPS_PER_KIND


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def hashed(name: str) -> int:
    return zlib.crc32(name.encode()) & ((1 << BITS) - 1)


def features(words: set[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and kinds of a text's words (kind 0) and their beginnings (kinds 1 to 4)."""
    out = {hashed("w" + w): 0 for w in words}
    for k, n in enumerate(PREFIXES, 1):
        for p in {w[:n] for w in words if len(w) >= n}:
            out[hashed(f"{n}{p}")] = k
    return np.fromiter(out, np.int32, len(out)), np.fromiter(out.values(), np.int8, len(out))


@dataclass
class Model:
    """What scoring needs: mined features with their voters and weights. A few thousand numbers."""

    index: dict[int, int]  # mined feature's hash -> place
    voter: np.ndarray  # voter of each place
    weight: np.ndarray  # classifier's weights: mined features, two fixed voters, share of hits, bias

    def hits(self, text: str) -> tuple[np.ndarray, int, float]:
        """Places of mined features in a text, its votes as bits, and the share of its words that are hits."""
        lower = text.lower()
        words = WORD.findall(lower)
        seen: dict[str, np.ndarray] = {}
        n_hit = 0
        index, memory = self.index, _memory(self)
        for w in words:
            at = memory.get(w)
            if at is None:
                names = ["w" + w, *(f"{n}{w[:n]}" for n in PREFIXES if len(w) >= n)]
                at = tuple(p for p in (index.get(hashed(x)) for x in names) if p is not None)
                if len(memory) > MEMORY_WORDS:
                    memory.clear()
                memory[w] = at
            if at:
                seen[w] = at
                n_hit += 1
        places = np.unique(np.fromiter((p for at in seen.values() for p in at), np.int64)) if seen else np.zeros(0, np.int64)
        votes = 0
        for v in np.unique(self.voter[places]).tolist():
            votes |= 1 << v
        if not LEXICON.isdisjoint(seen.keys() | (LEXICON & set(words))):
            votes |= 1
            if ADDRESS.search(lower):
                votes |= 2
        return places, votes, n_hit / max(1, len(words))

    def score(self, text: str) -> float:
        places, votes, share = self.hits(text)
        z = self.weight[places].sum() + self.weight[-4] * (votes & 1) + self.weight[-3] * (votes >> 1 & 1) + self.weight[-2] * share + self.weight[-1]
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, float(z)))))


_memories: dict[int, dict[str, tuple[int, ...]]] = {}


def _memory(model: Model) -> dict[str, tuple[int, ...]]:
    """Words already looked up in this process for this model."""
    key = id(model)
    if key not in _memories:
        _memories.clear()
        _memories[key] = {}
    return _memories[key]


class LabelModel:
    """P(class) and P(vote | class, vote of the tree's parent), for yes/no voters given as bits of a pattern."""

    def __init__(self, voters: int) -> None:
        self.n = voters
        self.parent = [-1] * voters
        self.prior = np.array([0.9, 0.1])
        self.table = np.zeros((voters, 2, 2, 2))  # voter, class, parent's vote, own vote

    def _log(self, votes: np.ndarray) -> np.ndarray:
        out = np.log(self.prior)[None, :].repeat(len(votes), 0)
        for v in range(self.n):
            above = votes[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(votes), np.int64)
            out += np.log(self.table[v][:, above, votes[:, v]]).T
        return out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(class 1) of each row of votes."""
        z = self._log(votes)
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -50, 50)))

    def _tables(self, votes: np.ndarray, weight: np.ndarray) -> None:
        self.prior = (weight.sum(0) + 1) / (weight.sum() + 2)
        for v in range(self.n):
            above = votes[:, self.parent[v]] if self.parent[v] >= 0 else np.zeros(len(votes), np.int64)
            for c in range(2):
                count = np.bincount(above * 2 + votes[:, v], weight[:, c], 4).reshape(2, 2)
                marginal = count.sum(0) + 0.5
                # backs off to the voter's own accuracy where its parent's vote is rare
                self.table[v, c] = (count + 2 * marginal / marginal.sum()) / (count.sum(1, keepdims=True) + 2)

    def _tree(self, votes: np.ndarray, weight: np.ndarray) -> None:
        """Correlations: the spanning tree of largest mutual information given the class (Chow and Liu)."""
        info = np.zeros((self.n, self.n))
        total = weight.sum()
        for i in range(self.n):
            for j in range(i):
                for c in range(2):
                    p = (np.bincount(votes[:, i] * 2 + votes[:, j], weight[:, c], 4).reshape(2, 2) + 0.25) / (weight[:, c].sum() + 1)
                    info[i, j] += weight[:, c].sum() / total * (p * np.log(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum()
        info += info.T
        joined, self.parent = [0], [-1] * self.n
        while len(joined) < self.n:
            rest = [i for i in range(self.n) if i not in joined]
            part = info[np.ix_(rest, joined)]
            r, k = np.unravel_index(int(part.argmax()), part.shape)
            self.parent[rest[r]] = joined[k] if part[r, k] > 1e-4 else -1
            joined.append(rest[r])

    def fit(self, votes: np.ndarray, count: np.ndarray, known: np.ndarray, rounds: int = 30) -> LabelModel:
        """votes: rows of 0/1; count: times each row stands for; known: its class, or -1."""
        p = np.where(known >= 0, known, (votes.sum(1) > 0).astype(float) * 0.9 + 0.01)
        for r in range(rounds):
            weight = np.stack([(1 - p) * count, p * count], 1)
            if r in (2, 8, 16):
                self._tree(votes, weight)
            self._tables(votes, weight)
            q = np.where(known >= 0, known, self.posterior(votes))
            if r > 16 and np.abs(q - p).max() < 1e-5:
                break
            p = q
        return self


def fit_linear(model: Model, rows: list[tuple[np.ndarray, int, float]], target: np.ndarray, rounds: int = 400, l2: float = 0.02) -> np.ndarray:
    """Logistic regression on soft labels by full-batch gradient descent with adaptive steps."""
    n_features = len(model.index) + 4
    row = np.concatenate([np.full(len(p), i) for i, (p, _, _) in enumerate(rows)] + [np.zeros(0, np.int64)]).astype(np.int64)
    col = np.concatenate([p for p, _, _ in rows] + [np.zeros(0, np.int64)]).astype(np.int64)
    dense = np.array([[v & 1, v >> 1 & 1, s, 1.0] for _, v, s in rows])
    w, seen = np.zeros(n_features), np.full(n_features, 1e-6)
    w[-1] = math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    for _ in range(rounds):
        z = np.bincount(row, w[col], len(rows)) + dense @ w[-4:]
        g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        grad = np.concatenate([np.bincount(col, g[row], n_features - 4), dense.T @ g]) + l2 * np.append(w[:-1], 0)
        seen += grad * grad
        w -= 0.5 * grad / np.sqrt(seen)
    return w


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit the voters, the label model and the classifier.

    Labels are used of at most ``TRAIN_ROWS`` rows whose crc32(key as text) mod 5 isn't 0: those with the
    smallest hashes. The label model's vote patterns come from all texts; there are few of them.
    """
    spark = docs.sparkSession
    prepare(spark)
    label = labels.select(F.col(key).cast("long").alias("k"), F.col("toxic").cast("int").alias("y")).where(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("k")))
    label = label.groupBy("k").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    chosen = label.orderBy(F.xxhash64("k"), "k").limit(TRAIN_ROWS)  # the documented bound; safe to broadcast
    sample = texts.join(F.broadcast(chosen), "k")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            pairs = [features(set(WORD.findall(t.lower()))) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([h for h, _ in pairs], pa.list_(pa.int32())), pa.array([k for _, k in pairs], pa.list_(pa.int8()))], names=["k", "y", "h", "kind"])

    # summed on the executors: the driver sees document frequencies, a bounded table, not texts
    found = materialise(sample.select("k", "t", "y").mapInArrow(extract, "k long, y int, h array<int>, kind array<tinyint>"), "features")
    totals = {r.y: r.n for r in found.groupBy("y").agg(F.count("*").alias("n")).collect()}
    each = found.select("y", F.explode(F.arrays_zip("h", "kind")).alias("f")).select("y", "f.h", "f.kind")
    table = each.groupBy("h").agg(F.max("kind").alias("kind"), F.sum("y").alias("toxic"), F.count("*").alias("n")).where(F.col("toxic") >= LEAST_TOXIC)
    rows = table.toPandas()
    n1, n0 = float(totals.get(1, 0)), float(totals.get(0, 0))
    d1, d0 = rows["toxic"].to_numpy(float), (rows["n"] - rows["toxic"]).to_numpy(float)
    z = (np.log((d1 + 0.5) / (n1 - d1 + 0.5)) - np.log((d0 + 0.5) / (n0 - d0 + 0.5))) / np.sqrt(1 / (d1 + 0.5) + 1 / (d0 + 0.5))
    hashes, kinds = rows["h"].to_numpy(np.int64), rows["kind"].to_numpy(np.int64)
    good = np.flatnonzero((z >= LEAST_Z) & (d1 >= LEAST_SHARE * (d1 + d0)))
    good = good[np.lexsort((hashes[good], -z[good]))]  # as many as the bounded sample has words for
    model = Model({int(h): i for i, h in enumerate(hashes[good])}, 2 + kinds[good] * GROUPS_PER_KIND + hashes[good] % GROUPS_PER_KIND, np.zeros(len(good) + 4))
    sent = spark.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([sent.value.hits(t)[1] for t in part.column(0).to_pylist()], pa.int64())], names=["votes"])

    def vote_in_full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            hits = [sent.value.hits(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[0] for h in hits], pa.list_(pa.int64())), pa.array([h[2] for h in hits], pa.float64())], names=["k", "y", "votes", "places", "share"])

    patterns = texts.select("t").mapInArrow(vote, "votes long").groupBy("votes").agg(F.count("*").alias("n")).toPandas()  # 2 ** 17 rows at most
    mine_rows = sample.select("k", "t", "y").mapInArrow(vote_in_full, "k long, y int, votes long, places array<long>, share double").toPandas().sort_values("k", kind="stable")
    bits = lambda v: (v.to_numpy(np.int64)[:, None] >> np.arange(N_VOTERS)) & 1
    y = mine_rows["y"].to_numpy(np.int64)
    votes = np.concatenate([bits(patterns["votes"]), bits(mine_rows["votes"])])
    count = np.concatenate([patterns["n"].to_numpy(float), np.ones(len(y))])
    count[: len(patterns)] *= min(1.0, max(1, len(y)) / max(1.0, count[: len(patterns)].sum()))  # weigh both alike
    if len(y):
        label_model = LabelModel(N_VOTERS).fit(votes, count, np.concatenate([np.full(len(patterns), -1), y]))
        posterior = label_model.posterior(bits(mine_rows["votes"]))
        rows_ = [(np.asarray(p, np.int64), int(v), float(s)) for p, v, s in zip(mine_rows["places"], mine_rows["votes"], mine_rows["share"], strict=True)]
        model.weight = fit_linear(model, rows_, posterior)
    else:
        model.weight[-1] = -3.0
        model.weight[-4:-2] = 4.0  # no labels: the fixed voters alone
    return model


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", whole_rows: bool = False) -> DataFrame:
    """(key, held_out, score, predicted) per row, or with ``whole_rows`` all columns and ``score``.

    Null and empty texts get the score of a text without hits. Nothing but the text is an input of a score.
    """
    spark = docs.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(model)
    docs = keep_columns(docs, "score", "held_out", "predicted") if whole_rows else docs.select(key, text)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, place):
            scores = pa.array([sent.value.score(t or "") for t in part.column(place).to_pylist()], pa.float64())
            columns = part.columns if whole_rows else [part.column(0)]
            yield pa.RecordBatch.from_arrays([*columns, scores], names=[*(f"c{i}" for i in range(len(columns))), "score"])

    names = docs.columns if whole_rows else [key]
    schema = ", ".join(f"c{i} {docs.schema[n].dataType.simpleString()}" for i, n in enumerate(names)) + ", score double"
    out = docs.mapInArrow(run, schema).toDF(*names, "score")
    if whole_rows:
        return out
    return out.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
