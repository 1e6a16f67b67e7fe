"""URL filter: rules by host and path, and gradient-boosted trees on lexical features for the URLs without a rule."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from stratum.llm.common import stored

#: Labelled URLs that the trees are fitted on, at most: those with the least hash.
MAX_LABELLED = 20_000
#: Parts of the labelled URLs, by domain, that take each other's suffix rates.
FOLDS = 5
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
FEATURES = ("length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "tld_rate", "tld_share", "domain_rate", "domain_share")


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, and for paths that begin with the rule's. Written like example.com/de/."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].translate(LOWER)

    @property
    def path(self) -> str:
        return self.text[self.text.find("/") :] if "/" in self.text else ""


def parts(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z in lower case), path and query of a URL; all empty where it is null or has no ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    stop = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    query = rest[stop + 1 :].partition("#")[0] if rest[stop : stop + 1] == "?" else ""
    return host.translate(LOWER), rest[:stop], query


class Rules:
    """Rules by host. Of those that fit, the longest counts; of equally long ones, that of the longer host, then the first."""

    def __init__(self, rules: Sequence[Rule]) -> None:
        self.by_host: dict[str, list[Rule]] = {}
        for r in rules:
            self.by_host.setdefault(r.host, []).append(r)

    def find(self, host: str, path: str) -> Rule | None:
        best, labels = None, host.split(".") if host else []
        for i in range(len(labels)):
            for r in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(r.path) and (best is None or len(r.text) > len(best.text)):
                    best = r
        return best


@dataclass
class Suffixes:
    """How often a host's last label and last two labels occur among the labelled URLs, and how often they are blocked."""

    total: Counter = field(default_factory=Counter)
    blocked: Counter = field(default_factory=Counter)
    rows: int = 0
    rate: float = 0.0

    @staticmethod
    def of(host: str) -> tuple[str, str]:
        labels = host.split(".")
        return labels[-1], ".".join(labels[-2:])

    def learn(self, hosts: Sequence[str], labels: Sequence[int]) -> None:
        self.rows, self.rate = len(hosts), sum(labels) / max(1, len(hosts))
        for h, y in zip(hosts, labels, strict=True):
            for s in set(self.of(h)):
                self.total[s] += 1
                self.blocked[s] += y

    def features(self, host: str) -> list[float]:
        """Rates are smoothed by ten URLs at the overall rate."""
        out = []
        for s in self.of(host):
            out += [(self.blocked[s] + 10 * self.rate) / (self.total[s] + 10), self.total[s] / max(1, self.rows)]
        return out


def features(url: str | None, suffixes: Suffixes) -> list[float]:
    """The lexical features of a URL, as FEATURES names them; a null URL is an empty one."""
    url = url or ""
    host, path, query = parts(url)
    n = len(url)
    counts = Counter(url).values()
    entropy = math.log2(n) - sum(c * math.log2(c) for c in counts) / n if n else 0.0
    digits = sum(map(url.count, "0123456789"))
    return [n, len(host), len(path), len([p for p in path.split("/") if p]), digits / n if n else 0.0, entropy, len([q for q in query.split("&") if q]), host.count(".") + bool(host), host.count("-"), *suffixes.features(host)]


@dataclass
class BoostedTrees:
    """Boosted trees for two classes under the logistic loss. Each tree is complete: node k has the children 2k + 1 and 2k + 2."""

    trees: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    start: float = 0.0
    fitted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = (y.sum() + 0.5) / (len(y) + 1)
        self.start = math.log(p / (1 - p))
        if len(y) == 0 or y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(column, np.linspace(0, 1, self.bins + 1)[1:-1])) for column in x.T]
        binned = np.stack([np.searchsorted(c, column, side="left") for c, column in zip(cuts, x.T, strict=True)], axis=1)
        margin = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            inner = 2**self.depth - 1
            feature, cut = np.full(inner, -1), np.full(inner, np.inf)
            node = np.zeros(len(y), int)
            for k in range(inner):
                here = np.flatnonzero(node == k)
                best = self.split(binned[here], grad[here], hess[here], cuts)
                if best:
                    feature[k], b = best
                    cut[k] = cuts[best[0]][b]
                    node[here] = 2 * k + 1 + (binned[here, best[0]] > b)
                else:
                    node[here] = 2 * k + 1
            leaf = node - inner
            g, h = (np.bincount(leaf, v, 2**self.depth) for v in (grad, hess))
            value = self.rate * g / (h + self.l2)
            self.fitted.append((feature, cut, value))
            margin += value[leaf]
        return self

    def split(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, int] | None:
        """The feature and bin whose cut gains most; None if no cut gains."""
        best, most = None, 1e-6
        whole = grad.sum() ** 2 / (hess.sum() + self.l2)
        for f, c in enumerate(cuts):
            g, h = (np.cumsum(np.bincount(binned[:, f], v, len(c) + 1))[:-1] for v in (grad, hess))
            gain = g**2 / (h + self.l2) + (grad.sum() - g) ** 2 / (hess.sum() - h + self.l2) - whole
            if len(gain) and gain.max() > most:
                most, best = gain.max(), (f, int(gain.argmax()))
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1."""
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.fitted:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                node = 2 * node + 1 + ((f >= 0) & (x[rows, f] > cut[node]))
            margin += value[node - len(feature)]
        return 1 / (1 + np.exp(-margin))


@dataclass
class Model:
    suffixes: Suffixes
    trees: BoostedTrees

    def block_probability(self, urls: Sequence[str | None]) -> np.ndarray:
        return self.trees.predict(np.array([features(u, self.suffixes) for u in urls], float).reshape(len(urls), len(FEATURES)))


def fit(urls: Sequence[str | None], labels: Sequence[int]) -> Model:
    """Labels: 1 is blocked. Without rows or with one class only, the model gives the overall rate.

    The suffix rates that a URL is trained with come from the other folds, and a fold has all URLs of its domains:
    what a domain's own labels say is not taken for what its lexical features do.
    """
    hosts, folds = [parts(u)[0] for u in urls], domain_folds(urls)
    x = np.zeros((len(urls), len(FEATURES)))
    for fold in set(folds):
        others = Suffixes()
        others.learn([h for h, f in zip(hosts, folds, strict=True) if f != fold], [y for y, f in zip(labels, folds, strict=True) if f != fold])
        for i, f in enumerate(folds):
            if f == fold:
                x[i] = features(urls[i], others)
    suffixes = Suffixes()
    suffixes.learn(hosts, labels)
    return Model(suffixes, BoostedTrees().fit(x, np.array(labels, float)))


def domain_folds(urls: Sequence[str | None]) -> list[int]:
    """A fold below FOLDS for each URL; those of one domain (a host's last two labels) are in one."""
    return [crc32(Suffixes.of(parts(u)[0])[1].encode("utf-8", "surrogatepass")) % FOLDS for u in urls]


def held_out_auc(urls: Sequence[str | None], labels: Sequence[int]) -> float:
    """The area under the curve of models that were fitted on the other folds' domains, over all URLs; ties count half. Without both classes it is 0.5."""
    folds = np.array(domain_folds(urls))
    y, p = np.array(labels, int), np.zeros(len(urls))
    for fold in set(folds.tolist()):
        rest, own = np.flatnonzero(folds != fold), np.flatnonzero(folds == fold)
        p[own] = fit([urls[i] for i in rest], [labels[i] for i in rest]).block_probability([urls[i] for i in own])
    values, of, counts = np.unique(p, return_inverse=True, return_counts=True)
    middle = np.cumsum(counts) - (counts - 1) / 2  # the mean rank of each value
    bad, good = int(y.sum()), int(len(y) - y.sum())
    return float((middle[of][y == 1].sum() - bad * (bad + 1) / 2) / (bad * good)) if bad and good else 0.5


def train(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fits the model on labelled_sample() of rows (url, label)."""
    sample = labelled_sample(labelled, max_labelled)
    return fit([r[0] for r in sample], [r[1] for r in sample])


def labelled_sample(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Row]:
    """At most max_labelled distinct rows (url, label), those of least hash; rows with a null url or label don't count."""
    rows = stored(labelled.where("url is not null and label is not null").select("url", "label").distinct(), "labelled")
    # Every task would send its own least rows, so most rows go before: about max_labelled have a hash below the bound.
    share = min(1.0, 1.2 * max_labelled / max(1, rows.count()) + 1e-6)
    near = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 40)) <= int(share * (1 << 40)))
    return near.orderBy(F.pmod(F.xxhash64("url"), F.lit(1 << 40)), "url", "label").limit(max_labelled).collect()


def rule_labels(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> DataFrame:
    """(url, label) of the URLs that a rule fits: label 1 where it blocks."""
    known = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, labels = [], []
            for url in batch.column(0).to_pylist():
                if rule := known.find(*parts(url)[:2]):
                    urls.append(url)
                    labels.append(int(rule.verdict == "block"))
            yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(labels, pa.int32())], ["url", "label"])

    return pages.select(pages[url_col].cast("string").alias("url")).mapInArrow(run, "url string, label int")


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of pages: id, host, path, rule (its text, or null), verdict (allow or block) and score.

    score is the trees' probability of block; it decides at 0.5 where no rule fits. A null URL, or one without
    ://, has an empty host and path. Repeated rows and null ids come out as they go in.
    """
    known = Rules(rules)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded: max_labelled rows at most have made it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            scores = shared.value.block_probability(urls)
            split = [parts(u) for u in urls]
            found = [known.find(h, p) for h, p, _ in split]
            verdicts = [r.verdict if r else "block" if s >= 0.5 else "allow" for r, s in zip(found, scores, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s[0] for s in split], pa.string()), pa.array([s[1] for s in split], pa.string()), pa.array([r.text if r else None for r in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())], ["id", "host", "path", "rule", "verdict", "score"])

    rows = pages.select(pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)
