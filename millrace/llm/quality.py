"""Quality classifier with hierarchical empirical Bayes over sites.

Two logistic heads (low quality, toxic) are fitted on the driver from a bounded sample of labelled rows (`max_train`), on the
presence and share of selected hashed words and word prefixes and on a few shape measures; every document is then scored where it lies. A site is a host and a
path within it. With s = sum of the documents' probabilities and n = their count, summed over all documents,

    host rate  = (s_host + K1 * global rate) / (n_host + K1)
    path rate  = (s_path + K2 * host rate) / (n_path + K2)

where K1 and K2 come from the spread of rates between hosts and between paths (moment estimators), so sparse sites shrink towards
their parent. A document's posterior log-odds are its classifier's log-odds with the global prior replaced by its path's rate.
Only grouped sums are exchanged, and partial sums are formed before the shuffle, so a site with a third of all rows is one row a task.

Defined results: null or empty text is low quality only if the shape measures say so, never toxic; null hosts and paths form sites of
their own; labels that are null or name no document are ignored, and a document with several labels gives several training rows;
a head without both classes in the sample rejects nothing; repeated rows are scored alike; an empty table gives no rows; other
columns pass through `classify` unchanged, and those named like its results are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textops as T
from millrace.llm.common import cut, drop, wrapped

BITS = 20  # two of them tell how much of the row's words a feature makes up
PREFIXES = (4, 5, 7)
SHARES = (0.004, 0.01, 0.02)
HEADS = ("low", "toxic")
GAP = np.ones(256, bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_KINDS = np.zeros((6, 256), np.int32)
_KINDS[0, 65:91] = 1
_KINDS[1, 48:58] = 1
_KINDS[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KINDS[3, ord("!")] = 1
_KINDS[4, [ord("|"), ord("<"), ord(">"), ord("{"), ord("}")]] = 1
_KINDS[5, 10] = 1
N_DENSE = 11


def measure(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature id) of every distinct word and word prefix of each row, once more per share of the words it reaches, and the shape measures."""
    rows, ids, dense = [], [], np.zeros((len(column), N_DENSE), np.float32)
    for first, data, at in T.runs(column):
        n = len(at) - 1
        h, row, start, end = T.word_hashes(data, at, GAP)
        prefix, found, owner = T.prefix_hash(T.LOWER[data]), [h], [row]
        for k in PREFIXES:
            on = np.flatnonzero(end - start > k)
            found.append(T.span_hash(prefix, start[on], start[on] + k) ^ np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            owner.append(row[on])
        count = np.bincount(row, minlength=n)
        both = (np.concatenate(owner).astype(np.uint64) << np.uint64(BITS - 2)) | (np.concatenate(found) >> np.uint64(66 - BITS))
        both.sort()
        new = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
        key = both[new]
        of = (key >> np.uint64(BITS - 2)).astype(np.int64)
        share = np.diff(np.append(new, len(both))) / np.maximum(count[of], 1)
        id4 = (key & np.uint64((1 << (BITS - 2)) - 1)).astype(np.int64) << 2
        level = [np.flatnonzero(share >= x) for x in SHARES]
        where = np.concatenate([of, *(of[x] for x in level)])
        order = np.argsort(where, kind="stable")
        rows.append(where[order] + first)
        ids.append(np.concatenate([id4, *(id4[x] + i for i, x in enumerate(level, 1))])[order])
        size = np.diff(at)
        part = dense[first : first + n]
        some = np.maximum(size, 1)
        for k in range(6):
            sums = np.concatenate([[0], np.cumsum(_KINDS[k][data])])
            part[:, k] = (sums[at[1:]] - sums[at[:-1]]) / some
        part[:, 6] = np.log1p(size)
        part[:, 7] = np.bincount(row, weights=end - start, minlength=n) / np.maximum(count, 1)
        part[:, 8] = np.bincount(of, minlength=n) / np.maximum(count, 1)
        sh, srow, _ = T.shingles(h, row, n, 5)
        n_sh = np.bincount(srow, minlength=n)
        own = np.unique((sh & ~np.uint64(0xFFFF)) | srow.astype(np.uint64))
        part[:, 9] = 1 - np.bincount((own & np.uint64(0xFFFF)).astype(np.int64), minlength=n) / np.maximum(n_sh, 1)
        part[:, 10] = count == 0
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), dense
    return np.concatenate(rows), np.concatenate(ids), dense


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 600, l2: float = 2e-4) -> np.ndarray:
    """Logistic regression by Adam on whole batches; the last column of x is 1 and its weight the intercept."""
    y = y.astype(np.float32)
    w = np.zeros(x.shape[1], np.float64)
    rate = float(y.mean())
    w[-1] = np.log(rate / (1 - rate))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32), -30, 30)))
        g = (p - y) @ x / len(y) + l2 * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


class Model:
    """Both heads: per head the selected word ids with weights, the shape weights, the intercept and the sample's rate.

    best: each head's selected ids, sorted. For every sample row, ids: its ids among both heads' selected ones; dense: its shape measures;
    y: per head 0, 1 or NaN.
    """

    def __init__(self, best: list[np.ndarray], ids: list[np.ndarray], dense: np.ndarray, y: np.ndarray):
        self.mean = dense.mean(0) if len(dense) else np.zeros(N_DENSE, np.float32)
        self.std = dense.std(0) + 1e-3 if len(dense) else np.ones(N_DENSE, np.float32)
        self.heads: list[tuple[np.ndarray, np.ndarray, float, float] | None] = []
        for k in range(2):
            on = np.flatnonzero(~np.isnan(y[:, k]))
            if not len(on) or not 0 < y[on, k].mean() < 1:
                self.heads.append(None)
                continue
            n = len(best[k])
            x = np.zeros((len(on), n + N_DENSE + 1), np.float32)
            for i, r in enumerate(on):
                x[i, np.flatnonzero(np.isin(best[k], ids[r], assume_unique=True))] = 1
            x[:, n:-1] = self.shape(dense[on])
            x[:, -1] = 1
            w = _fit(x, y[on, k])
            table = np.zeros(1 << BITS, np.float32)
            table[best[k]] = w[:n]
            self.heads.append((table, w[n:-1], float(w[-1]), float(y[on, k].mean())))

    def shape(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.std, -6, 6)

    def logits(self, column: pa.Array) -> list[np.ndarray]:
        row, word, dense = measure(column)
        shape, out = self.shape(dense), []
        for h in self.heads:
            if h is None:
                out.append(np.full(len(column), -30.0))
                continue
            out.append(np.clip(np.bincount(row, weights=h[0][word], minlength=len(column)) + shape @ h[1] + h[2], -30, 30))
        return out


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 8000, n_words: int = 768, min_chi2: float = 25.0) -> Model:
    """Fits on about max_train labelled rows, taken by a hash of their id: the one bounded sample of this operator.

    The n_words ids that tell most are chosen by sums over the sample's partitions; the driver gets those ids alone of each row.
    """
    labels = labels.select(F.col("doc_id").alias("label_id"), F.col("quality").cast("double").alias("q"), F.col("toxic").cast("double").alias("t")).where("label_id is not null")
    n = labels.count()
    few = labels.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < (1 << 20) * min(1.0, max_train / max(n, 1)))

    def take(batches):
        for b in batches:
            row, word, dense = measure(b.column(0))
            at = np.searchsorted(row, np.arange(len(b) + 1))
            ids = [word[at[i] : at[i + 1]].astype(np.uint32).tobytes() for i in range(len(b))]
            yield pa.record_batch([pa.array(ids, pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary()), b.column(1), b.column(2)], ["words", "dense", "y0", "y1"])

    pick = docs.select("doc_id", "text").join(F.broadcast(few), F.col("doc_id") == F.col("label_id")).select("text", (1 - F.col("q")).alias("y0"), F.col("t").alias("y1"))  # few: bounded by max_train
    sample = cut(pick.mapInArrow(take, "words binary, dense binary, y0 double, y1 double"))
    total = sample.agg(*(f(f"y{k}").alias(f"{n}{k}") for k in range(2) for n, f in (("n", F.count), ("s", F.sum)))).first()

    def tally(batches):
        """Of each id, the sample rows that hold it and those of them in the class, per head."""
        out = np.zeros((4, 1 << BITS), np.int32)
        for b in batches:
            y = [b.column(c).to_numpy(zero_copy_only=False) for c in ("y0", "y1")]
            for i, w in enumerate(b.column("words").to_pylist()):
                w = np.frombuffer(w, np.uint32)
                for k in range(2):
                    if y[k][i] == y[k][i]:
                        out[2 * k, w] += 1
                        out[2 * k + 1, w] += y[k][i] == 1
        at = np.flatnonzero(out.any(0))
        yield pa.record_batch([pa.array(at.astype(np.int32)), *(pa.array(r[at]) for r in out)], ["id", "d0", "h0", "d1", "h1"])

    counts = sample.select("words", "y0", "y1").mapInArrow(tally, "id int, d0 int, h0 int, d1 int, h1 int").groupBy("id").agg(*(F.sum(c).cast("double").alias(c) for c in ("d0", "h0", "d1", "h1")))
    best = []
    for k in range(2):
        n, rate = total[f"n{k}"], (total[f"s{k}"] or 0.0) / max(total[f"n{k}"], 1)
        df, hit = F.col(f"d{k}"), F.col(f"h{k}")
        chi2 = (hit - df * rate) ** 2 / F.greatest(df * rate * (1 - rate) * (1 - df / max(n, 1)), F.lit(1e-9))
        top = counts.where((df >= 5) & (df <= n - 5)).select("id", chi2.alias("x")).where(F.col("x") >= min_chi2).orderBy(F.desc("x"), "id").limit(n_words)
        best.append(np.sort(top.toArrow()["id"].to_numpy().astype(np.int64)))
    chosen = np.union1d(*best)

    def narrow(batches):
        for b in batches:
            ids = [np.intersect1d(np.frombuffer(w, np.uint32), chosen).astype(np.uint32).tobytes() for w in b.column("words").to_pylist()]
            yield pa.record_batch([pa.array(ids, pa.binary()), b.column("dense"), b.column("y0"), b.column("y1")], ["ids", "dense", "y0", "y1"])

    got = sample.mapInArrow(narrow, "ids binary, dense binary, y0 double, y1 double").orderBy("ids", "dense", "y0", "y1").toArrow()
    ids = [np.frombuffer(x, np.uint32) for x in got["ids"].to_pylist()]
    dense = np.frombuffer(b"".join(got["dense"].to_pylist()), np.float32).reshape(-1, N_DENSE)
    y = np.stack([got[c].to_numpy() for c in ("y0", "y1")], 1) if len(ids) else np.zeros((0, 2))
    drop(sample)
    return Model(best, ids, dense, y)


def _score(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    schema = docs.select(*columns).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input

    def run(batches):
        for b in batches:
            low, toxic = shared.value.logits(b.column(b.schema.get_field_index("__text")))
            keep = [i for i, name in enumerate(b.schema.names) if name != "__text"]
            yield pa.record_batch([*(b.column(i) for i in keep), pa.array(low, pa.float64()), pa.array(toxic, pa.float64())], [*(b.schema.names[i] for i in keep), "__low", "__toxic"])

    kept = docs.select(*columns, F.col("text").alias("__text"))
    return kept.mapInArrow(run, schema.add("__low", "double").add("__toxic", "double"))


def _pool(n_sum: float, s_sum: float, sq_rate: float, n2: float, groups: int) -> float:
    """Moment estimate of the prior's weight: within variance over between variance, 1 to 1e6."""
    if groups < 2 or n_sum <= 0:
        return 1e6
    m = s_sum / n_sum
    within = max(m * (1 - m), 1e-9)
    c = n_sum - n2 / n_sum
    between = (sq_rate - s_sum * s_sum / n_sum - (groups - 1) * within) / c if c > 0 else 0
    return float(min(1e6, max(1.0, within / between - 1))) if between > 0 else 1e6


def sites(scored: DataFrame) -> DataFrame:
    """host, path, and per head the log-odds that replace the global prior's: <head>_shift; <head>_rate is the path's posterior rate."""
    p = {h: 1 / (1 + F.exp(-F.col(f"__{h}"))) for h in HEADS}
    paths = scored.groupBy("__host", "__path").agg(F.count("*").cast("double").alias("n"), *(F.sum(p[h]).alias(f"s_{h}") for h in HEADS)).persist()
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{h}").alias(f"hs_{h}") for h in HEADS))
    top = hosts.agg(F.count("*").alias("g"), F.sum("hn").alias("n"), F.sum(F.col("hn") ** 2).alias("n2"), *(F.sum(f"hs_{h}").alias(f"s_{h}") for h in HEADS), *(F.sum(F.col(f"hs_{h}") ** 2 / F.col("hn")).alias(f"r_{h}") for h in HEADS)).first()
    low = paths.agg(F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.col("n") ** 2).alias("n2"), *(F.sum(f"s_{h}").alias(f"s_{h}") for h in HEADS), *(F.sum(F.col(f"s_{h}") ** 2 / F.col("n")).alias(f"r_{h}") for h in HEADS)).first()
    out = paths.join(hosts, "__host")
    for h in HEADS:
        n = top["n"] or 0.0
        rate = min(1 - 1e-9, max(1e-9, top[f"s_{h}"] / n)) if n else 0.5
        k1 = _pool(n, top[f"s_{h}"] or 0, top[f"r_{h}"] or 0, top["n2"] or 0, top["g"])
        k2 = _pool(n, low[f"s_{h}"] or 0, low[f"r_{h}"] or 0, low["n2"] or 0, low["g"])
        host = (F.col(f"hs_{h}") + k1 * rate) / (F.col("hn") + k1)
        path = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), (F.col(f"s_{h}") + k2 * host) / (F.col("n") + k2)))
        out = out.withColumn(f"{h}_rate", path).withColumn(f"{h}_shift", F.log(path / (1 - path)) - float(np.log(rate / (1 - rate))))
    return out.select("__host", "__path", *(f"{h}_{x}" for h in HEADS for x in ("rate", "shift")))


def classify(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """docs' columns and p_low, p_toxic (posteriors), low_rate, toxic_rate (of the site), keep (neither posterior over the threshold).

    Scores are computed once for the sites' sums and once again beside the row, which spares the texts a shuffle; the join
    moves them only if the site table is larger than the session lets it broadcast.
    """
    new = ("p_low", "p_toxic", "low_rate", "toxic_rate", "keep")
    named = lambda c: F.coalesce(F.col(f"row.`{c}`").cast("string"), F.lit("\x00"))
    keyed = wrapped(docs.drop(*new)).withColumns({"__host": named(host), "__path": named(path), "text": F.col("row.text")})
    table = sites(_score(keyed, model, ["__host", "__path"]))
    scored = _score(keyed, model, ["row", "__host", "__path"]).join(table, ["__host", "__path"])
    p = {h: 1 / (1 + F.exp(-(F.col(f"__{h}") + F.col(f"{h}_shift")))) for h in HEADS}
    keep = (p["low"] <= threshold) & (p["toxic"] <= threshold)
    own = [F.col("row").getField(c).alias(c) for c in docs.drop(*new).columns]
    return scored.select(*own, p["low"].alias("p_low"), p["toxic"].alias("p_toxic"), "low_rate", "toxic_rate", keep.alias("keep"))
