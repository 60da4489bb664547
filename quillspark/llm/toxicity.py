"""Toxicity scores by weak supervision.

Many voters look at a text: lexicons in four languages, surface patterns, and lexicons of word beginnings that separate
the labelled training rows. Each votes toxic or abstains. A generative model of the votes on a sample of all documents,
labelled or not, estimates by expectation maximisation how often each voter fires in toxic and in clean texts, and how
voters depend on each other: in each class a voter's vote depends on one other's, along the tree that explains most of
what they share. Labels give the share of toxic rows and the prior of the voters' rates, and calibrate the posterior; on its own row
a label then is one more vote, of estimated accuracy. This posterior is what a linear (logistic) classifier over words
and word beginnings is trained on. The classifier scores.

The fit sees bounded samples (Limits); everything else covers all rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import decoded, discard, filter_rows, materialize, small_batches, texts


@dataclass(frozen=True)
class Limits:
    """What a fit takes: labelled rows by label, and any documents (in each case the least digests of doc_id); the mined
    voters and the classifier's features, both the surest; the toxic rows that must hold a feature; and how sure a mined
    voter must be (a lower bound of its log odds)."""

    clean: int = 5000
    toxic: int = 3000
    documents: int = 4000
    mined: int = 150
    features: int = 2000
    support: int = 5
    sure: float = 1.5


MEMO = 200_000
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+")

#: Lexicon voters: common insults and threats, one voter a line.
LEXICONS = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumber dumbest imbecile imbeciles",
    "folly": "fool fools foolish dimwit dimwits halfwit cretin cretins clown clowns dunce simpleton airhead blockhead",
    "worth": "loser losers worthless pathetic useless hopeless failure failures nobody waste",
    "filth": "scum trash garbage vermin filth filthy rat rats pig pigs maggot maggots cockroach parasite parasites",
    "disgust": "disgusting gross revolting vile repulsive sickening nasty hideous ugly",
    "hatred": "hate hated hateful despise detest loathe loathsome disgrace",
    "threat": "kill killed die dies hurt strangle destroy murder stab beat punish crush",
    "silence": "shut shutup quiet begone leave vanish rot choke",
    "coarse": "damn damned crap crappy bastard bastards bitch bitches shit shitty bloody",
    "vulgar": "asshole assholes arsehole fuck fucking fucked fucker dick prick wanker",
    "lies": "liar liars lying fraud frauds fake coward cowards traitor traitors hypocrite hypocrites",
    "german": "idiot idioten dumm dummkopf trottel depp deppen blödmann schwachkopf vollidiot",
    "german coarse": "arschloch abschaum versager wertlos ekelhaft scheisse scheiße dreck drecksack hau verpiss hasse",
    "french": "idiot idiote idiots stupide imbécile imbéciles crétin crétins abruti débile nul nulle",
    "french coarse": "connard connards salaud salope ordure minable merde dégoûtant pourri déteste ferme",
    "spanish": "idiota idiotas estúpido estúpida imbécil imbéciles tonto tonta payaso payasa inútil",
    "spanish coarse": "basura asqueroso asquerosa mierda cabrón patético patética escoria odio cállate maldito",
}
#: Pattern voters: shouting, masked words, letters written as digits, and insults addressed to the reader.
PATTERNS = {
    "shouting": r"\b[A-Z]{4,}\b(?:\W+[A-Z]{4,}\b){3,}",
    "exclaiming": r"[!?]{4,}",
    "masked": r"\b[a-zA-Z]+\*{2,}[a-zA-Z]*\b",
    "masked letter": r"(?i)\b(?:f[*@#]ck|sh[*@#]t|b[*@#]tch|a[*@#]{2}hole)",
    "digits": r"\b(?:1d10t|m0r0n|l0ser|stup1d|tr4sh|1diot|id1ot)\b",
    "drawn out": r"(?i)\b\w*([a-z])\1{4,}\w*\b",
    "address": r"(?i)\byou(?:'re| are)? (?:an? |such an? |all |so )?(?:idiot|moron|loser|clown|scum|trash|fool|pathetic|worthless|stupid|dumb)",
    "command": r"(?i)\b(?:shut up|get lost|drop dead|go to hell|go away)\b",
    "german address": r"(?i)\bdu (?:bist )?(?:ein(?:e)? )?(?:idiot|trottel|dumm|versager|depp|arschloch)",
    "french address": r"(?i)\b(?:tu es|espèce d[e'])\s*(?:un(?:e)? )?(?:idiot|imbécile|crétin|connard|nul|abruti)",
    "spanish address": r"(?i)\b(?:eres|pedazo de)\s*(?:un(?:a)? )?(?:idiota|imbécil|estúpid|inútil|basura|payas)",
}


def stems(word: str) -> list[str]:
    """The word, and its beginnings of three to nine letters."""
    return [word, *(f"{word[:n]}-" for n in range(3, min(len(word), 9) + 1))]


def code(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature)


def again(code: int) -> int:
    """The feature that at least two distinct words of a text have the feature `code`."""
    return (code * 2654435761 + 97) % 2**32


def present(counts: Counter[int]) -> set[int]:
    return {*counts, *(again(c) for c, n in counts.items() if n > 1)}


def surface() -> list:
    words = [set(x.split()) for x in LEXICONS.values()]
    found = [re.compile(x) for x in PATTERNS.values()]
    return [lambda t, w, x=x: not x.isdisjoint(w) for x in words] + [lambda t, w, x=x: bool(x.search(t)) for x in found]


class Model:
    """A bias and a weight for each feature code. `of` remembers a bounded number of words' weighty features."""

    def __init__(self, bias: float, weights: dict[int, float]):
        self.bias, self.weights, self.of = bias, weights, {}

    def __getstate__(self):
        return self.bias, self.weights

    def __setstate__(self, state):
        self.__init__(*state)

    def codes(self, word: str) -> tuple[int, ...]:
        if len(self.of) >= MEMO:
            self.of.clear()
        self.of[word] = out = tuple(c for c in map(code, stems(word)) if c in self.weights or again(c) in self.weights)
        return out

    def score(self, text: str) -> float:
        counts: Counter[int] = Counter()
        for word in set(WORD.findall(text.lower())):
            codes = self.of.get(word)
            codes = self.codes(word) if codes is None else codes
            if codes:
                counts.update(codes)
        z = self.bias + sum(self.weights.get(c, 0.0) for c in sorted(present(counts)))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(doc_id) -> F.Column:
    """The rows that no fit may see: crc32 of the id as text leaves 1 when divided by 3; null ids are held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def sampled(docs: DataFrame, labels: DataFrame, limits: Limits, paths: list[str]) -> tuple[DataFrame | None, tuple[int, int]]:
    """(doc_id, label, votes, codes) of the sampled rows, label null where there is none or it is held out; and how many
    clean and toxic labels may be learnt from. Without one of these there is no sample."""
    spark = docs.sparkSession
    usable = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    usable = materialize(usable.groupBy("doc_id").agg(F.max("label").alias("label")), "labels", paths)  # an id labelled twice: toxic if any label says so
    n = usable.agg(F.count("*").alias("all"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    n_labels = n["all"] - n["toxic"], n["toxic"]
    if not all(n_labels):
        return None, n_labels
    least = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    known = docs.select("doc_id").where(~held_out(F.col("doc_id")))
    picks = [least(usable.where(F.col("label") == label), n).select("doc_id") for label, n in enumerate((limits.clean, limits.toxic))]
    ids = picks[0].union(picks[1]).union(least(known, limits.documents)).distinct().join(usable, "doc_id", "left")
    picked = F.broadcast(spark.createDataFrame(ids.collect(), "doc_id bigint, label int"))  # at most clean + toxic + documents rows
    rows = docs.select("doc_id", "text").join(picked, "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = surface()
        for batch in batches:
            votes, codes = [], []
            for raw in texts(batch):
                text = decoded(raw)
                words = set(WORD.findall(text.lower()))
                votes.append(bytes(int(v(text, words)) for v in voters))
                codes.append(np.array(sorted(present(Counter(code(s) for w in words for s in stems(w)))), np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int32)
            flat = pa.array(np.concatenate([*codes, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(votes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["doc_id", "label", "votes", "codes"])

    return materialize(rows.mapInArrow(run, "doc_id bigint, label int, votes binary, codes array<bigint>"), "sample", paths), n_labels


def informative(rows: DataFrame, limits: Limits) -> list[tuple[int, float]]:
    """The feature codes that mark toxic texts with a lower bound of their log odds over the base rate, the surest first: by
    this bound times the root of how many toxic texts have them."""
    seen = rows.where("label IS NOT NULL")
    n = seen.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not n["toxic"] or not n["clean"]:  # labels without documents
        return []
    by = seen.select("label", F.explode("codes").alias("code")).groupBy("code").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    odds = F.log((F.col("t") + 0.5) / (n["toxic"] + 1) / ((F.col("c") + 0.5) / (n["clean"] + 1)))
    by = by.where(F.col("t") >= limits.support).withColumn("bound", odds - 1.64 * F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)))
    best = by.where("bound > 0.7").orderBy(F.desc(F.col("bound") * F.sqrt("t")), "code").limit(limits.features)
    return [(r["code"], r["bound"]) for r in best.select("code", "bound").collect()]


def matrix(rows: DataFrame, codes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(labels, -1 for none; surface votes; which row has which code) of the sample, in order of doc_id."""
    columns, place = np.sort(np.array(codes, np.int64)), np.argsort(np.array(codes, np.int64), kind="stable")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for row in batch.column(3):
                own = np.asarray(row.values, np.int64)
                at = np.searchsorted(columns, own)
                at[at == len(columns)] = 0
                kept.append(place[at[columns[at] == own]].astype("<i4").tobytes() if len(columns) else b"")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(kept, pa.binary())], ["doc_id", "label", "votes", "has"])

    got = sorted(rows.mapInArrow(run, "doc_id bigint, label int, votes binary, has binary").collect())  # the sample, at most `features` numbers a row
    x = np.zeros((len(got), len(codes)), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["has"], "<i4")] = 1
    return np.array([-1 if r["label"] is None else r["label"] for r in got]), np.array([np.frombuffer(r["votes"], np.uint8) for r in got], np.float64), x


def distinct(x: np.ndarray, columns: list[int], most: int) -> list[int]:
    """The first of the columns, `most` at most, of which no two fire in much the same rows (a Jaccard similarity of 0.8)."""
    chosen: list[int] = []
    sizes = x.sum(axis=0)
    for j in columns:
        both = x[:, j] @ x[:, chosen]
        if len(chosen) < most and sizes[j] and not (both >= 0.8 * (sizes[j] + sizes[chosen] - both)).any():
            chosen.append(j)
    return chosen


@dataclass
class Voters:
    """The label model: the share of toxic rows; by class (clean, toxic) each voter's rate of firing when its parent in the
    tree does not fire and when it does; its parent (itself: none)."""

    share: float
    rates: np.ndarray  # class, parent's vote, voter
    parents: np.ndarray

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic for each row of votes. A voter that does not fire abstains; one that fires counts by its rates beside its parent's vote."""
        at = self.rates[:, beside(votes, self.parents).astype(int), np.arange(votes.shape[1])]
        return (votes * np.log(at[1] / at[0])).sum(axis=1) + np.log(self.share / (1 - self.share))


def beside(votes: np.ndarray, parents: np.ndarray) -> np.ndarray:
    """For each row and voter, its parent's vote; 0 without one."""
    after = votes[:, parents]
    after[:, parents == np.arange(len(parents))] = 0
    return after


def dependence(votes: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    """The voters' mutual information in pairs, given the class."""
    out, total = 0.0, sum(w.sum() for w in weights)
    for w in weights:
        n = w.sum() + 4.0
        both = (votes * w[:, None]).T @ votes + 1.0
        one = w @ votes + 2.0
        cells = ((both, one[:, None], one), (one[:, None] - both, one[:, None], n - one), (one - both, n - one[:, None], one), (n - one[:, None] - one + both, n - one[:, None], n - one))
        out = out + w.sum() / total * sum(np.maximum(c, 1e-9) / n * np.log(np.maximum(c, 1e-9) * n / (x * y)) for c, x, y in cells)
    return out


def tree(shared: np.ndarray, least: float) -> np.ndarray:
    """Each voter's parent in the maximum spanning tree, itself where what it shares is under `least`."""
    n = len(shared)
    parents, best, near, left = np.arange(n), np.full(n, -np.inf), np.zeros(n, int), np.ones(n, bool)
    at = 0
    for _ in range(n):
        left[at] = False
        closer = left & (shared[at] > best)
        best[closer], near[closer] = shared[at][closer], at
        if not left.any():
            break
        at = int(np.argmax(np.where(left, best, -np.inf)))
        if best[at] >= least:
            parents[at] = near[at]
    return parents


def rates_of(votes: np.ndarray, parents: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The voters' rates (parent's vote, voter) over weighted rows, a little drawn to the rate beside any vote of the parent."""
    alone, after = (weight @ votes + 0.5) / (weight.sum() + 1), beside(votes, parents)
    w = weight[:, None]
    return np.array([((w * (after == k) * votes).sum(axis=0) + 2 * alone) / ((w * (after == k)).sum(axis=0) + 2) for k in (0, 1)])


def label_model(votes: np.ndarray, labels: np.ndarray, share: float, rounds: int = 60) -> Voters:
    """Estimates the voters by expectation maximisation over all rows; labels: 0, 1, or -1 for none.

    Labelled rows count once more in their class, as the prior of the rates. `share`, of toxic rows, is given: under
    abstaining voters the votes say nothing about it. For the same reason the posterior is a little high, which
    calibrated() takes back.
    """
    hard, least = [(labels == k).astype(float) for k in (0, 1)], 13.8 / (2 * len(votes))  # a likelihood ratio test at one in a thousand
    parents = np.arange(votes.shape[1])
    model = Voters(share, np.array([rates_of(votes, parents, h) for h in hard]), parents)
    post = 1 / (1 + np.exp(-np.clip(model.odds(votes), -30, 30)))
    for _ in range(rounds):
        weights = [1 - post + hard[0], post + hard[1]]
        parents = tree(dependence(votes, weights), least)
        model = Voters(share, np.array([rates_of(votes, parents, w) for w in weights]), parents)
        new = 1 / (1 + np.exp(-np.clip(model.odds(votes), -30, 30)))
        done, post = np.abs(new - post).max() < 1e-5, new
        if done:
            break
    return model


def calibrated(odds: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """P(toxic) of each row: a logistic curve in the model's log odds through the labelled rows (-1: not labelled); it never falls."""
    z = np.clip(odds, -12, 12)
    y, seen = labels[labels >= 0], z[labels >= 0]
    at = np.array([1.0, 0.0])  # slope and bias; the loss draws the slope a little to the model's own odds
    loss = lambda v: (np.logaddexp(0, v[0] * seen + v[1]) - y * (v[0] * seen + v[1])).sum() + (v[0] - 1) ** 2 / 2 + 0.005 * v[1] ** 2
    for _ in range(100):  # Newton's method with halved steps
        p = 1 / (1 + np.exp(-(at[0] * seen + at[1])))
        g = np.array([(p - y) @ seen + (at[0] - 1), (p - y).sum() + 0.01 * at[1]])
        d = p * (1 - p)
        step = np.linalg.solve([[d @ seen**2 + 1, d @ seen], [d @ seen, d.sum() + 0.01]], g)
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step = step / 2
        at = at - step
        if np.abs(step).max() < 1e-8:
            break
    slope, bias = at
    return 1 / (1 + np.exp(-(max(slope, 0.05) * z + bias)))


def with_labels(post: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The posterior with the given label as one more vote of its row, as often right in each class as the posterior says; rows without one stay."""
    seen = labels >= 0
    y, p = labels[seen], post[seen]
    right = [float(((w * (y == k)).sum() + 1) / (w.sum() + 2)) for k, w in enumerate((1 - p, p))]
    odds = np.log(p / (1 - p)) + np.where(y == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0]))
    out = post.copy()
    out[seen] = 1 / (1 + np.exp(-odds))
    return out


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, penalty: float = 0.1, steps: int = 600) -> tuple[float, np.ndarray]:
    """Bias and weights by accelerated gradient steps on the penalised, weighted log loss."""
    w = np.zeros(x.shape[1] + 1)
    z, momentum = w.copy(), 1.0
    v = np.ones(x.shape[1] + 1)
    for _ in range(30):  # the largest eigenvalue of the weighted Gram matrix bounds the step
        v /= np.linalg.norm(v)
        d = weight * (x @ v[1:].astype(np.float32) + v[0])
        v = np.concatenate([[d.sum()], (x.T @ d.astype(np.float32)).astype(np.float64)])
    step = 1 / (0.3 * np.linalg.norm(v) + penalty)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z[1:].astype(np.float32) + z[0], -30, 30)))
        d = weight * (p - target)
        grad = np.concatenate([[d.sum()], (x.T @ d.astype(np.float32)).astype(np.float64) + penalty * z[1:]])
        new = z - step * grad
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, w, momentum = new + (momentum - 1) / following * (new - w), new, following
    return float(w[0]), w[1:]


def fit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), report: list | None = None) -> Model:
    """A model of the rows that may be learnt from; without labels of both classes every score is the prior, one half at most.

    `report` gets a tuple for each voter: name, rows in which it fires, estimated share of toxic ones among them, name of
    the voter that it depends on (its own: none).
    """
    paths: list[str] = []
    small_batches(docs.sparkSession)
    try:
        rows, n_labels = sampled(docs, labels, limits, paths)
        known = (n_labels[1] + 1) / (sum(n_labels) + 2)
        if rows is None:
            p = min(known, 0.5)
            return Model(float(np.log(p / (1 - p))), {})
        marks = informative(rows, limits)
        codes = [c for c, _ in marks]
        y, given, x = matrix(rows, codes)
    finally:
        discard(docs.sparkSession, paths)
    if not (y == 0).any() or not (y == 1).any():  # labels without documents
        return Model(0.0, {})
    mined = distinct(x, [j for j, (_, bound) in enumerate(marks) if bound >= limits.sure], limits.mined)
    votes = np.column_stack([given, x[:, mined]]).astype(np.float64)
    voters = label_model(votes, y, known)
    odds = voters.odds(votes)
    post = with_labels(np.clip(calibrated(odds, y), 1e-6, 1 - 1e-6), y)
    if report is not None:
        names = [*LEXICONS, *PATTERNS, *(f"mined {codes[j]:08x}" for j in mined)]
        sure = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        report += [(name, int(v.sum()), float(sure @ v / max(v.sum(), 1)), names[q]) for name, v, q in zip(names, votes.T, voters.parents, strict=True)]
    # Back from the sample's shares to the documents' own, as rows without a label show them (all, if there are none).
    rate, share = float(np.clip(post[y < 0].mean() if (y < 0).any() else post.mean(), 1e-3, 0.5)), float(np.clip(post.mean(), 1e-3, 0.999))
    bias, w = logistic(x, post, post * rate / share + (1 - post) * (1 - rate) / (1 - share))
    return Model(bias, {int(c): float(v) for c, v in zip(codes, w, strict=True)})


def voter_report(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """voter, fires, accuracy, depends_on: what the label model found; no rows without labels of both classes."""
    found: list = []
    fit(docs, labels, limits, found)
    return docs.sparkSession.createDataFrame(found, "voter string, fires bigint, accuracy double, depends_on string")


def scores(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of `docs` (doc_id, text; other columns are not read).

    Null, empty and wordless texts get the score of a text without features; bytes that aren't UTF-8 are read as U+FFFD.
    Repeated rows score alike; of rows that share an id one is taken for the fit. Labels that are null or neither 0 nor 1
    are not used; labels and texts of held-out and null ids never are. Empty tables: no rows, or prior scores. Texts of
    any length are read whole.
    """
    small_batches(docs.sparkSession)
    model = fit(docs, labels, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(decoded(x)) for x in texts(batch)], pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of `docs`, all columns, that score under the threshold; nothing is shuffled. See scores() for odd rows."""
    small_batches(docs.sparkSession)
    model = fit(docs, labels, limits)
    return filter_rows(docs, "text", lambda batch: [model.score(decoded(x)) < THRESHOLD for x in batch])
