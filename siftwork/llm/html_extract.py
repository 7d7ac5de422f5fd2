"""Main text of web pages: gradient-boosted trees over DOM nodes, then hierarchical decoding.

Every structural node gets features (tag, attribute tokens of itself, its
ancestors and its subtree, text, link and sentence density of the subtree,
depth, place among siblings).  Trees boosted by Spark ML on labelled nodes of
``TRAINED`` generated pages give each node's odds to hold main text; decoding
picks the likeliest labels in which no kept node lies below a dropped one.
Blocks of kept nodes are the text, in page order.

Defined cases: null or empty html gives an empty text; markup without any main
text does too; broken markup is read as far as it goes; text inside scripts,
styles and form controls never counts; repeated rows give equal rows; null
ids and urls are carried through; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_training import Maker
from .html_tree import Page, decode, features, main_text
from .shared import small_batches

#: Generated pages for training; a bound on the sample, not on the data.
TRAINED = 1200
ROUNDS, DEPTH = 24, 5
#: Nodes that are scored together.
NODES = 4000

#: Boosted trees as arrays: feature, threshold, left, right, value; one row a tree.
Trees = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]
_models: dict[tuple[int, int], Trees] = {}


def labelled_nodes(pages: range) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels; a node is positive if main text lies in it or it lies in main text."""
    rows, labels = [], []
    for seed in pages:
        html, main = Maker(seed).page()
        page = Page(html)
        wanted = set(main)
        holds = np.zeros(len(page.tags), bool)
        for owner, text in page.blocks:
            if text in wanted:
                while owner >= 0 and not holds[owner]:
                    holds[owner] = True
                    owner = page.parent[owner]
        rows.append(features(page)[1:])
        labels.append(holds[1:])
    return np.concatenate(rows), np.concatenate(labels)


def train(spark: SparkSession, pages: int = TRAINED, first_seed: int = 1) -> Trees:
    """Fits the trees once a driver; their nodes become arrays for the workers."""
    if (pages, first_seed) in _models:
        return _models[pages, first_seed]
    x, y = labelled_nodes(range(first_seed, first_seed + pages))
    table = pa.table({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "label": pa.array(y.astype(float))})
    rows = spark.createDataFrame(table).select(array_to_vector("x").alias("features"), "label")
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=5, maxBins=32).fit(rows)
    size = 2 ** (DEPTH + 1)
    feature, left, right = (np.zeros((ROUNDS, size), np.int32) for _ in range(3))
    threshold, value = np.full((ROUNDS, size), np.inf), np.zeros((ROUNDS, size))
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        # Places: the root is 0; a leaf points at itself.
        places = [tree._java_obj.rootNode()]
        for at, node in enumerate(places):
            if node.subtreeDepth() == 0:
                left[t, at] = right[t, at] = at
                value[t, at] = weight * node.prediction()
                continue
            feature[t, at], threshold[t, at] = node.split().featureIndex(), node.split().threshold()
            left[t, at], right[t, at] = len(places), len(places) + 1
            places += [node.leftChild(), node.rightChild()]
    _models[pages, first_seed] = feature, threshold, left, right, value
    return _models[pages, first_seed]


def log_odds(trees: Trees, x: np.ndarray) -> np.ndarray:
    """The boosted sum for each row of x; rows walk down one tree together, whichever pages they are of."""
    out, flat, first = np.zeros(len(x)), np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
    for feature, threshold, left, right, value in zip(*trees, strict=True):
        at = np.zeros(len(x), np.int32)
        for _ in range(DEPTH):
            below = flat.take(first + feature.take(at)) <= threshold.take(at)
            at = np.where(below, left.take(at), right.take(at))
        out += value.take(at)
    return 2 * out


def extract_all(pages: Iterator[str], trees: Trees) -> Iterator[str]:
    """The main text of each page; pages are scored together until they have NODES nodes, so memory is bounded by that or one page."""
    group: list[Page] = []

    def texts() -> Iterator[str]:
        odds = log_odds(trees, np.concatenate([features(p) for p in group]))
        at = 0
        for page in group:
            own = odds[at : at + len(page.tags)]
            at += len(page.tags)
            yield main_text(page, decode(page, own))
        group.clear()

    nodes = 0
    for html in pages:
        group.append(Page(html))
        nodes += len(group[-1].tags)
        if nodes >= NODES:
            yield from texts()
            nodes = 0
    if group:
        yield from texts()


def extract(html: str, trees: Trees) -> str:
    return next(extract_all(iter([html]), trees))


def extract_pages(pages: DataFrame, trees: Trees) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages(page_id, url, html)."""
    small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = list(extract_all((h.as_py() or "" for h in batch.column("html")), trees))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
