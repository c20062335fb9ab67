"""Main text of web pages: flat blocks classified by a small decision tree.

A page becomes a flat list of text blocks (``html_blocks``).  Each block is
described by its word count and link density, those of the blocks before and
after it, and by where it stands (heading; inside article or main; inside a
menu, header, footer, sidebar or form; inside an element whose class or id
names an advert, a notice, comments and the like).  A decision tree, trained
by MLlib on the small labelled table ``LABELLED``, keeps a block or not.

The tree has a few dozen nodes; it goes to the tasks, where each page is
handled on its own, so nothing is shuffled.

Defined cases: null html counts as empty and has empty text; text outside any
block element is a block of its own; a tag cut off by the page's end is
dropped; an unknown or unclosed element is read on as browsers do; repeated
rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, take
from .html_blocks import Block, blocks

FEATURES = ("words", "density", "prev_words", "prev_density", "next_words", "next_density",
            "heading", "in_body", "region", "hint", "page_has_body")

# Shapes of blocks: the first six features.
SHAPES = (
    (60, 0.0, 10, 0.0, 45, 0.0), (45, 0.02, 60, 0.0, 80, 0.05), (150, 0.1, 5, 1.0, 3, 0.0),
    (85, 0.0, 40, 0.0, 35, 0.0), (25, 0.6, 44, 0.1, 21, 0.0), (12, 0.4, 50, 0.0, 33, 0.1),
    (9, 0.0, 6, 0.0, 12, 0.0), (5, 0.0, 30, 0.0, 70, 0.0), (3, 0.0, 55, 0.0, 40, 0.0),
    (2, 0.0, 0, 0.0, 0, 0.0), (1, 0.0, 20, 0.0, 9, 0.0), (2, 1.0, 70, 0.0, 60, 0.0),
    (4, 1.0, 3, 1.0, 90, 0.0), (1, 1.0, 1, 1.0, 1, 1.0), (14, 1.0, 20, 0.0, 9, 1.0),
    (40, 0.0, 60, 0.0, 0, 0.0), (7, 0.0, 2, 1.0, 2, 1.0), (30, 0.0, 1, 1.0, 11, 0.0),
)

# Where a block stands: heading, in_body, region, hint, page_has_body; then 1 for main text.
PLACES = (
    (0, 1, 0, 0, 1, 1),     # in an article
    (1, 1, 0, 0, 1, 1),     # a heading there
    (0, 0, 1, 0, 1, 0),     # in a menu, header, footer, sidebar or form
    (0, 0, 1, 0, 0, 0),
    (0, 1, 1, 0, 1, 0),     # ... of an article
    (1, 0, 1, 0, 1, 0),
    (0, 0, 0, 1, 1, 0),     # in an advert, a notice, comments
    (0, 0, 0, 1, 0, 0),
    (0, 1, 0, 1, 1, 0),
    (1, 0, 0, 1, 1, 0),
    (0, 0, 1, 1, 1, 0),
    (0, 1, 1, 1, 1, 0),
    (0, 0, 0, 0, 1, 0),     # beside the article, without any sign
    (1, 0, 0, 0, 1, 0),
)

# Pages without an article element, blocks without any sign: told by their shape.
# words, density, prev_words, prev_density, next_words, next_density, heading; 1 for main text.
PLAIN = (
    (60, 0.0, 40, 0.0, 55, 0.0, 0, 1), (35, 0.1, 8, 0.0, 70, 0.0, 0, 1), (120, 0.05, 2, 1.0, 3, 1.0, 0, 1),
    (18, 0.0, 60, 0.0, 30, 0.0, 0, 1), (22, 0.0, 0, 0.0, 0, 0.0, 0, 1), (16, 0.2, 2, 1.0, 40, 0.0, 0, 1),
    (9, 0.0, 60, 0.0, 50, 0.0, 0, 1), (4, 0.0, 45, 0.0, 70, 0.0, 0, 1), (1, 0.0, 50, 0.0, 40, 0.0, 0, 1),
    (6, 0.0, 2, 1.0, 50, 0.0, 1, 1), (3, 0.0, 60, 0.0, 40, 0.0, 1, 1), (8, 0.0, 0, 0.0, 30, 0.0, 1, 1),
    (10, 0.0, 70, 0.0, 25, 0.0, 1, 1), (7, 0.0, 35, 0.0, 3, 0.0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 1),
    (2, 0.0, 30, 0.0, 0, 0.0, 0, 1), (3, 0.0, 0, 0.0, 45, 0.0, 0, 1), (12, 0.0, 7, 0.0, 9, 0.0, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 0, 0), (3, 1.0, 3, 1.0, 60, 0.0, 0, 0),
    (9, 0.9, 50, 0.0, 8, 1.0, 0, 0), (25, 0.8, 4, 1.0, 5, 1.0, 0, 0), (60, 0.7, 60, 0.6, 50, 0.8, 0, 0),
    (12, 0.6, 30, 0.0, 2, 1.0, 0, 0), (30, 1.0, 80, 0.0, 60, 0.0, 0, 0), (4, 1.0, 40, 0.0, 60, 0.0, 0, 0),
    (2, 0.0, 1, 1.0, 1, 1.0, 0, 0), (3, 0.0, 2, 1.0, 2, 1.0, 0, 0), (2, 0.0, 2, 1.0, 1, 1.0, 1, 0),
)

# The labelled table: the features of a block in order, then its label.
LABELLED = ([(*shape, *place) for place in PLACES for shape in SHAPES]
            + [(*row[:6], row[6], 0, 0, 0, 0, row[7]) for row in PLAIN])

Tree = tuple | int


def train(spark: SparkSession) -> Tree:
    """The decision tree learned from ``LABELLED``: (feature, threshold, left, right) or a label."""
    rows = spark.createDataFrame([([float(v) for v in r[:-1]], float(r[-1])) for r in LABELLED],
                                 "x array<double>, label double")
    model = DecisionTreeClassifier(maxDepth=8, maxBins=128, minInstancesPerNode=1, seed=1).fit(
        rows.select(array_to_vector(F.col("x")).alias("features"), "label"))

    def walk(node) -> Tree:
        if node.numDescendants() == 0:
            return int(node.prediction())
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return walk(model._java_obj.rootNode())


def classify(tree: Tree, x: tuple[float, ...]) -> int:
    while not isinstance(tree, int):
        feature, threshold, left, right = tree
        tree = left if x[feature] <= threshold else right
    return tree


def features(page: list[Block]) -> list[tuple[float, ...]]:
    has_body = float(any(b.in_body for b in page))
    out = []
    for i, b in enumerate(page):
        p = page[i - 1] if i else None
        n = page[i + 1] if i + 1 < len(page) else None
        out.append((b.words, b.density, p.words if p else 0, p.density if p else 0.0,
                    n.words if n else 0, n.density if n else 0.0,
                    float(b.heading), float(b.in_body), float(b.region), float(b.hint), has_body))
    return out


def main_text(html: str, tree: Tree) -> str:
    page = blocks(html)
    return "\n".join(b.text for b, x in zip(page, features(page), strict=True) if classify(tree, x))


def extract(df: DataFrame, id: str = "page_id", html: str = "html", keep: tuple[str, ...] = (),
            text: str = "text") -> DataFrame:
    """``id``, the columns ``keep``, and ``text``: the main text of each page."""
    rows = take(df, **{id: id, **{k: k for k in keep}, "__html": html})
    tree = train(df.sparkSession)

    def one(columns: list[pa.Array]) -> list[pa.Array]:
        found = [main_text(h.as_py() or "", tree) for h in columns[-1].cast(pa.string())]
        return [*columns[:-1], pa.array(found, pa.string())]

    return map_batches(rows, one, [*rows.dtypes[:-1], (text, "string")])
