"""Operator 9: main text by a linear-chain conditional random field over DOM leaf blocks.

A page is the sequence of its leaf blocks (dom.py).  A block's features are its
ancestors' tags and the words of their class, id and role, and how its text
looks: length, links, punctuation, place.  Two labels, main and other, form a
linear chain; weights are trained by gradient ascent on the conditional
likelihood of labelled pages (page_samples.py makes them, or give your own), and
the labels of a page are decoded by Viterbi.  Main blocks are joined by two
newlines, in page order.

Defined results: null, empty or textless html gives "" and 0; null urls and ids
stay null; broken or unended markup is read leniently; nothing is cut or capped
however long; repeated rows have a row each; extra columns aren't read; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from .common import batches_of, table
from .dom import Block, Node, leaf_blocks
from .page_samples import labelled_pages

#: Pages that the model is trained on, and their seed.
TRAINING_PAGES, SEED = 900, 11
#: Words that notices, adverts and forms carry, in any language's interface.
CUES = frozenset("cookie cookies copyright subscribe newsletter share login advertisement sponsored comment comments reply rights reserved privacy terms menu related".split())

#: Cues are dense where there is one in so many words of the block.
CUE_WORDS = 40


def step(value: float, *edges: float) -> int:
    return sum(value >= e for e in edges)


def path_features(node: Node | None) -> list[str]:
    """The tags of the elements around and the words of their class, id and role, each once."""
    out = []
    while node:
        out += node.new
        node = node.parent
    return out


def block_features(blocks: list[Block]) -> list[list[str]]:
    """All features of each block."""
    return [f + path_features(b.node) for f, b in zip(text_features(blocks), blocks, strict=True)]


def text_features(blocks: list[Block]) -> list[list[str]]:
    """Those that aren't path_features."""
    out, n = [], len(blocks)
    for i, b in enumerate(blocks):
        words = b.text.split()
        m = max(len(words), 1)
        f = ["bias"]
        leaf, around = (b.node.tag, b.node.parent) if b.node else ("", None)
        holder = b.node.holder if b.node else "none"
        f.append(f"leaf:{leaf}")
        f.append(f"leaf2:{around.tag + '/' if around else ''}{leaf}")
        if b.node and b.node.hidden:
            f.append("hidden")
        f.append(f"holder:{holder}")
        f.append(f"holder:{holder}/{leaf}")
        f.append(f"words:{step(m, 2, 4, 8, 15, 30, 60, 120)}")
        f.append(f"links:{step(b.linked / max(len(b.text), 1), 0.01, 0.2, 0.5, 0.9)}")
        f.append(f"ends:{'stop' if b.text[-1] in '.!?…»”' else 'other'}")
        f.append(f"commas:{step(sum(w.endswith((',', '.')) for w in words) / m, 0.01, 0.08, 0.2)}")
        f.append(f"caps:{step(sum(w[0].isupper() for w in words) / m, 0.1, 0.4, 0.8)}")
        f.append(f"place:{step(i / max(n - 1, 1), 0.1, 0.3, 0.7, 0.9)}")
        told = [w.strip(".,:!?()").lower() for w in words]
        cues = [w for w in told if w in CUES]
        # a long text may hold a cue by chance: cues count in full where they are dense, wherever they stand
        weight = "cue" if CUE_WORDS * len(cues) >= m else "rare"
        f += {f"{weight}:{w}" for w in cues}
        if "©" in b.text:
            f.append("cue:©")
        out.append(f)
    return out


@dataclass
class Crf:
    index: dict[str, int]
    weights: np.ndarray  # features x 2
    moves: np.ndarray  # from label, to label
    ends: np.ndarray  # first row: of beginning with a label; second: of ending with it

    @cached_property
    def by_name(self) -> dict[str, list[float]]:
        """Each feature's two weights."""
        w = self.weights.tolist()
        return {x: w[i] for x, i in self.index.items()}

    def unary(self, blocks: list[Block]) -> list[tuple[float, float]]:
        """What each block's features weigh for either label; what an element's path weighs is added up once."""
        weights = self.by_name

        def weigh(features: list[str], a: float = 0.0, b: float = 0.0) -> tuple[float, float]:
            for x in features:
                if x in weights:
                    p, q = weights[x]
                    a, b = a + p, b + q
            return a, b

        known: dict[int, tuple[float, float]] = {}
        out = []
        for f, b in zip(text_features(blocks), blocks, strict=True):
            way, node = [], b.node
            while node and id(node) not in known:
                way.append(node)
                node = node.parent
            path = known[id(node)] if node else (0.0, 0.0)
            for node in reversed(way):
                path = known[id(node)] = weigh(node.new, *path)
            out.append(weigh(f, *path))
        return out

    def viterbi(self, blocks: list[Block]) -> list[int]:
        if not blocks:
            return []
        u = self.unary(blocks)
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = u[0][0] + self.ends[0, 0], u[0][1] + self.ends[0, 1]
        back = []
        for x, y in u[1:]:
            from0, from1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((from0, from1))
            a, b = (b + m10 if from0 else a + m00) + x, (b + m11 if from1 else a + m01) + y
        label = int(b + self.ends[1, 1] > a + self.ends[1, 0])
        labels = [label]
        for pair in reversed(back):
            label = int(pair[label])
            labels.append(label)
        return labels[::-1]

    @classmethod
    def fit(cls, pages: Iterable[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.1, ridge: float = 2e-4, least: int = 3) -> Crf:
        """Adam on the mean log-likelihood of all pages at once; features on fewer than `least` blocks are left out."""
        pages = [p for p in pages if p[0]]
        seen: dict[str, int] = {}
        for features, _ in pages:
            for f in features:
                for x in f:
                    seen[x] = seen.get(x, 0) + 1
        index = {x: i for i, x in enumerate(sorted(x for x, c in seen.items() if c >= least))}
        longest, count = max(len(f) for f, _ in pages), len(pages)
        rows = [(p, t, index[x]) for p, (features, _) in enumerate(pages) for t, f in enumerate(features) for x in f if x in index]
        page, place, feature = np.array(rows).T
        cell = page * longest + place
        y = np.zeros((count, longest), np.int64)
        there = np.zeros((count, longest), bool)
        for p, (_, labels) in enumerate(pages):
            y[p, : len(labels)], there[p, : len(labels)] = labels, True
        last = there.sum(axis=1) - 1
        one = np.eye(2)[y] * there[..., None]
        every = np.arange(count)
        k = len(index)
        theta, m1, m2 = np.zeros(2 * k + 8), np.zeros(2 * k + 8), np.zeros(2 * k + 8)
        for r in range(1, rounds + 1):
            w, moves, ends = theta[: 2 * k].reshape(k, 2), theta[2 * k : 2 * k + 4].reshape(2, 2), theta[2 * k + 4 :].reshape(2, 2)
            u = np.column_stack([np.bincount(cell, w[feature, j], count * longest) for j in (0, 1)]).reshape(count, longest, 2)
            u[:, 0] += ends[0]
            u[every, last] += ends[1]
            forward, backward = np.empty_like(u), np.zeros_like(u)
            forward[:, 0] = u[:, 0]
            for t in range(1, longest):
                forward[:, t] = np.where(there[:, t, None], u[:, t] + np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1), forward[:, t - 1])
            for t in range(longest - 2, -1, -1):
                into = np.logaddexp.reduce(moves + (u[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(there[:, t + 1, None], into, 0.0)
            z = np.logaddexp.reduce(forward[every, last], axis=1)
            p = np.exp(forward + backward - z[:, None, None]) * there[..., None]
            error = one - p
            pair = np.exp(forward[:, :-1, :, None] + moves + (u + backward)[:, 1:, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
            seen_pairs = (one[:, :-1, :, None] * one[:, 1:, None, :]).sum(axis=(0, 1))
            flat = error.reshape(-1, 2)
            g = np.concatenate(
                [
                    np.column_stack([np.bincount(feature, flat[cell, j], k) for j in (0, 1)]).reshape(-1),
                    (seen_pairs - pair.sum(axis=(0, 1))).reshape(-1), error[:, 0].sum(axis=0), error[every, last].sum(axis=0),
                ]
            ) / count - ridge * theta
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
            theta += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
        return cls(index, theta[: 2 * k].reshape(k, 2).copy(), theta[2 * k : 2 * k + 4].reshape(2, 2).copy(), theta[2 * k + 4 :].reshape(2, 2).copy())


@lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> Crf:
    """A model of labelled sample pages; a label belongs to the text that the sample marks as main."""
    data = []
    for page, main in labelled_pages(pages, seed):
        blocks = leaf_blocks(page)
        data.append((block_features(blocks), [int(b.text in main) for b in blocks]))
    return Crf.fit(data)


def main_text(page: str, model: Crf) -> str:
    blocks = leaf_blocks(page)
    return "\n\n".join(b.text for b, label in zip(blocks, model.viterbi(blocks), strict=True) if label)


def extract(pages: DataFrame, model: Crf) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for part in batches_of(batch, text="html"):
                texts = [main_text(h or "", model) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(pages["page_id"].cast("long"), pages["url"], pages["html"]).mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), trained())
