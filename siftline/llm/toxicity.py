"""Toxicity by weak supervision.

Voters look at a document's words and vote "toxic", "clean", or abstain:
* lexicon voters: a word, from a short seed list and from the labelled sample;
* pattern voters: a word's beginning (3 to 6 letters), and shapes of tokens;
* clean voters: words of the sample that toxic documents hardly hold, and two that
  speak where the others are silent: no word of any lexicon, no shape.
A generative label model sees nothing but the votes.  Expectation-maximisation, begun
at the majority of the votes, estimates how often each voter votes each way in toxic
and in clean documents (its accuracy), and how voters correlate given the class;
correlated voters share their weight.  A linear classifier (logistic regression) is
trained on the model's posterior labels and scores every document from its whole text.

The given labels of the sample serve for three documented choices only: which words
and beginnings become voters (LEAST_SUPPORT, LEAST_PRECISION), the class prior of the
label model, and nothing after it: they are no votes, no start and no target.

The voters, the label model and the classifier are fitted on at most SAMPLE labelled
ids (the documented bound), the same ones whatever the cluster; of rows that share an
id the least text counts.  Without labels, or with one class only, the seed voters and
the prior remain.

Null and empty texts have no votes but those of silence; rows are scored one by one;
several labels of one id count as the greatest; a null doc_id is never learned from.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunked, column, split_mod, table, written
from .textops import Words

SAMPLE = 20_000
VOTERS = 400
PRIOR = 0.1
THRESHOLD = 0.7
LEAST_SUPPORT = 6
LEAST_PRECISION = 0.85
#: clean voters: how many at most, how many documents they need, and how rarely toxic ones
CLEAN_VOTERS = 60
CLEAN_SUPPORT = 100
CLEAN_PRECISION = 0.98
# Common English insults.
SEEDS = ["idiot", "moron", "loser", "scum", "stupid", "pathetic", "worthless", "disgusting", "trash", "clown", "bastard", "bitch", "asshole", "fuck", "shit", "whore", "cunt"]
SHAPES = ["#caps", "#masked", "#shout"]
#: correlation given the class from which voters share their weight
SAME = 0.6
#: clean voters of silence
NO_WORD, NO_SHAPE = "#no-word", "#no-shape"
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»“”„‘’…"


def features_of(token: str) -> list:
    """The voters that a token could belong to."""
    bare = token.strip(_PUNCTUATION)
    low = bare.lower()
    out = []
    if low:
        out.append(low)
        if low.isalpha():
            out += [low[:k] + "~" for k in range(3, 7) if len(low) > k]
        if len(bare) > 3 and bare.isupper():
            out.append("#caps")
        if "*" in bare:
            out.append("#masked")
    if token.endswith("!!"):
        out.append("#shout")
    return out


def _distinct(batch, keep):
    """(row, feature) pairs of a slice, each once; keep(features) of each distinct token."""
    words = Words(column(batch, "text"))
    if not len(words.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words.rows
    _, at, inverse = np.unique(words.hash, return_index=True, return_inverse=True)
    data = words.data.tobytes()
    found = [keep(data[a:b].decode()) for a, b in zip(words.starts[at].tolist(), words.ends[at].tolist())]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((x for f in found for x in f), np.int64, int(sizes.sum()))
    n = sizes[inverse]
    rows = np.repeat(words.row, n)
    offset = np.repeat((np.cumsum(sizes) - sizes)[inverse], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pair = np.unique(rows * (1 << 32) + flat[offset])
    return pair >> 32, pair & 0xFFFFFFFF, words.rows


def _mine(batches):
    """(feature, toxic documents, documents) over slices."""
    for batch in chunked(batches, most=4 << 20):  # tokens are looked at once a slice
        names, index = [], {}

        def keep(token):
            out = []
            for f in features_of(token):
                if f not in index:
                    index[f] = len(names)
                    names.append(f)
                out.append(index[f])
            return out

        rows, feats, _ = _distinct(batch, keep)
        toxic = column(batch, "toxic").to_numpy()
        a = np.bincount(feats, weights=toxic[rows], minlength=len(names)).astype(np.int64)
        n = np.bincount(feats, minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(a), pa.array(n)], ["feature", "a", "n"])


def _votes(shared, extra: list):
    """Per row: the extra columns and the sorted ids of the voters that vote."""

    def run(batches):
        index = {f: i for i, f in enumerate(shared.value)}
        for batch in chunked(batches):
            rows, feats, n = _distinct(batch, lambda t: [index[f] for f in features_of(t) if f in index])
            offs = np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[column(batch, c) for c in extra], pa.ListArray.from_arrays(pa.array(offs), pa.array(feats))], [*extra, "votes"])

    return run


def voters_of(sample: DataFrame, most: int = VOTERS) -> tuple:
    """(toxic voters, clean voters) from the labelled sample.

    Toxic ones are rarely wrong and chosen so that toxic documents are covered several times; clean ones are the commonest
    that toxic documents hardly hold.  What is collected are the candidates that pass these tests, of a bounded sample.
    """
    spark = sample.sparkSession
    found = written(sample.mapInArrow(_mine, "feature string, a long, n long").groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n")))
    good = found.where((F.col("a") >= LEAST_SUPPORT) & (F.col("a") >= LEAST_PRECISION * F.col("n")))
    candidates = [r.feature for r in good.orderBy(F.desc("a"), "feature").collect()]
    calm = found.where((F.col("n") >= CLEAN_SUPPORT) & (F.col("n") - F.col("a") >= CLEAN_PRECISION * F.col("n")))
    calm = [r.feature for r in calm.orderBy(F.desc("n"), "feature").limit(CLEAN_VOTERS).collect()]  # a top-k by support
    if not candidates:
        return [], calm
    shared = spark.sparkContext.broadcast(candidates)
    hits = [r.votes for r in sample.where("toxic = 1").mapInArrow(_votes(shared, []), "votes array<long>").collect()]
    shared.destroy()
    weight = np.ones(len(hits))
    by_feature = {}
    for d, h in enumerate(hits):
        for i in h:
            by_feature.setdefault(i, []).append(d)
    by_feature = {i: np.array(d) for i, d in by_feature.items()}
    chosen, gains = [], {i: float(len(d)) for i, d in by_feature.items()}
    while gains and len(chosen) < most:  # lazy greedy: a gain only falls
        best = max(gains, key=lambda i: (gains[i], -i))
        now = float(weight[by_feature[best]].sum())
        if now < gains[best] - 1e-9:
            gains[best] = now
            continue
        if now < LEAST_SUPPORT / 2:
            break
        chosen.append(candidates[best])
        weight[by_feature[best]] *= 0.5
        del gains[best]
    return chosen, calm


class LabelModel:
    """Class-conditional rates of voters that vote (1) or abstain (0), fitted to the votes alone.

    toxic: which voters speak for the toxic class; the others speak for the clean one.  hit and miss are a voter's rates
    in toxic and clean documents; weight is what a voter keeps beside those it agrees with beyond the class.
    """

    def __init__(self, votes: np.ndarray, toxic: np.ndarray, prior: float, rounds: int = 30):
        x, self.prior = votes.astype(float), prior
        m = x.shape[1]
        share = np.log(prior / (1 - prior))
        # the majority: one toxic voter outweighs the voters of silence
        y = 1 / (1 + np.exp(-np.clip(share + 3.0 * x[:, toxic].sum(1) - 0.5 * x[:, ~toxic].sum(1), -30, 30)))
        self.weight = np.ones(m)
        for step in range(rounds):
            up, down = y.sum() + 2, (1 - y).sum() + 2
            self.hit = np.clip((x.T @ y + np.where(toxic, 0.5, 0.05)) / up, 1e-5, 0.999)
            self.miss = np.clip((x.T @ (1 - y) + np.where(toxic, 0.05, 0.5)) / down, 1e-5, 0.999)
            # a voter is never worse than chance for its own side
            self.miss[toxic] = np.minimum(self.miss[toxic], self.hit[toxic])
            self.hit[~toxic] = np.minimum(self.hit[~toxic], self.miss[~toxic])
            if step >= rounds // 2:
                self.weight = 1 / (1 + self._correlated(x, y, self.hit, self.miss))
            y = self.posterior(x)
        self.labels = y

    @staticmethod
    def _correlated(x, y, hit, miss):
        """Sum over the other voters of the correlation that is left given the class."""
        rest = x - np.outer(y, hit) - np.outer(1 - y, miss)
        norm = np.sqrt((rest**2).sum(0)) + 1e-9
        corr = (rest.T @ rest) / np.outer(norm, norm)
        np.fill_diagonal(corr, 0)
        corr[corr < SAME] = 0
        return corr.sum(0)

    @property
    def accuracy(self) -> np.ndarray:
        """How often a voter is right where it votes."""
        right = np.maximum(self.hit * self.prior, self.miss * (1 - self.prior))
        return right / (self.hit * self.prior + self.miss * (1 - self.prior))

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """An abstention says nothing: a voter of one language is silent on the toxic texts of the others."""
        z = x @ (np.log(self.hit / self.miss) * self.weight) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02, rounds: int = 25):
    """Weights and intercept of a logistic regression on soft labels, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], w[-1]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """docs (doc_id, text), labels (doc_id, toxic): the voters, their weights, the intercept and the label model's view of the voters."""
    spark = docs.sparkSession
    ids = (labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most `sample` ids of two numbers are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = written(rows.select("text", "toxic"))
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    mined, calm = voters_of(rows) if counts.get(1) and counts.get(0) else ([], [])
    lexicon = list(dict.fromkeys([*mined, *SEEDS]))
    names = [*lexicon, *SHAPES, *(f for f in calm if f not in lexicon and f not in SHAPES)]
    if not mined:
        return {"names": names, "weights": np.where(np.isin(names, SEEDS), 4.0, 0.0), "bias": float(np.log(PRIOR / (1 - PRIOR)) - 0.5), "voters": None}
    shared = spark.sparkContext.broadcast(names)
    found = rows.select("text").mapInArrow(_votes(shared, []), "votes array<long>").collect()  # at most `sample` rows
    shared.destroy()
    x = np.zeros((len(found), len(names)), np.float32)
    for i, r in enumerate(found):
        x[i, r.votes] = 1
    silent = np.column_stack([~x[:, : len(lexicon)].any(1), ~x[:, len(lexicon) : len(lexicon) + len(SHAPES)].any(1)])
    votes, voters = np.hstack([x, silent]), [*names, NO_WORD, NO_SHAPE]
    toxic = np.arange(len(voters)) < len(lexicon) + len(SHAPES)
    cast = votes.any(0)
    model = LabelModel(votes[:, cast], toxic[cast], counts[1] / (counts[0] + counts[1]))
    used = x.any(0)
    weights = np.where(np.isin(names, SEEDS), 4.0, 0.0)
    weights[used], bias = logistic(x[:, used].astype(float), model.labels)
    seen = [{"voter": v, "side": "toxic" if t else "clean", "accuracy": float(a), "weight": float(w)}
            for v, t, a, w in zip(np.array(voters)[cast], toxic[cast], model.accuracy, model.weight)]
    return {"names": names, "weights": weights, "bias": float(bias), "voters": seen}


def _score(shared):
    def run(batches):
        names, weights, bias = shared.value
        index = {f: i for i, f in enumerate(names)}
        for batch in chunked(batches, most=2 << 20):
            rows, feats, n = _distinct(batch, lambda t: [index[f] for f in features_of(t) if f in index])
            z = bias + np.bincount(rows, weights=weights[feats], minlength=n)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "held_out", "score"])

    return run


def scored(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model["names"], np.asarray(model["weights"]), model["bias"]))
    rows = docs.select("doc_id", "held_out", "text").mapInArrow(_score(shared), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", split_mod(3, 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~split_mod(3, 1))
    return scored(docs, fit(docs.where("not held_out"), labels))
