"""Periodic runs of words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of words with a smallest period that no neighbouring word extends. Per document: blocks of the Lempel-Ziv parse
give squares (tandem repeats) that cover the first occurrence of every kind; their places in the suffix tree, walked along suffix
links by rotation, complete the vocabulary of all kinds; the leaves below a place are its occurrences, and occurrences of one
period that begin at neighbouring words merge into a run. Only kinds with a primitive root are located, so there are
O(n log n) occurrences at most.

Documents are independent rows, so Spark only maps over them. In a run of LEAST_WORDS words and LEAST_TIMES periods every window
of 16 words occurs twice, so the method works on stretches of such windows, found by hashing, and other words are passed over.
A hash can only let too many through: the result is exact.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

LEAST_WORDS = 24
LEAST_TIMES = 3


def words_of(text: str | None) -> list[bytes]:
    """The words in UTF-8: of bytes, ``split`` parts at \\x20 and \\x09 to \\x0D only."""
    return (text or "").encode().split()


class Substrings:
    """Names of all substrings of lengths 2 ** k: equal names for equal substrings, so that extensions can be measured."""

    def __init__(self, x: np.ndarray) -> None:
        self.n = len(x)
        names = np.unique(x, return_inverse=True)[1]
        self.names, self.distinct = [names], len(names) and int(names.max()) + 1
        while (1 << len(self.names)) < self.n and self.distinct < self.n:
            width, one = 1 << (len(self.names) - 1), self.names[-1]
            after = np.full(self.n, -1)
            after[: self.n - width] = one[width:]
            # Shorter ones at the end sort before all longer ones.
            self.names.append(np.unique(one * (self.n + 1) + after + 1, return_inverse=True)[1])
            self.distinct = int(self.names[-1].max()) + 1

    def suffix_array(self) -> np.ndarray:
        return np.argsort(self.names[-1], kind="stable")

    def equal(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the same number is at i and j; there is none before the first and behind the last."""
        fits = (i >= 0) & (j >= 0) & (i < self.n) & (j < self.n)
        return fits & (self.names[0][np.where(fits, i, 0)] == self.names[0][np.where(fits, j, 0)])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b, width = i + out, j + out, 1 << k
            fits = (a + width <= self.n) & (b + width <= self.n)
            out += width * (fits & (self.names[k][np.where(fits, a, 0)] == self.names[k][np.where(fits, b, 0)]))
        # Where the last level is not the last power of two below n, all its names differ, so nothing longer is equal.
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of the prefixes that end with i and j; -1 is the empty one."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            fits = (a >= 0) & (b >= 0)
            out += (1 << k) * (fits & (self.names[k][np.where(fits, a, 0)] == self.names[k][np.where(fits, b, 0)]))
        return out


class SuffixTree:
    """The suffix tree of numbers that end with one that occurs nowhere else.

    Inner nodes are intervals of the suffix array, each numbered after its children; the leaf of rank r is node ``inner + r``.
    """

    def __init__(self, x: np.ndarray, parts: Substrings) -> None:
        n = len(x)
        order = parts.suffix_array()
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.order = order
        shared = self.shared = np.append(parts.ahead(order[:-1], order[1:]), 0)
        low, high, depth, parent, leaf_parent = [], [], [], [], [0] * n
        open_nodes: list[tuple[int, int, list[int]]] = [(0, 0, [])]  # depth, first rank, children (leaves as -1 - rank)

        def close(last: int) -> int:
            d, first, children = open_nodes.pop()
            node = len(low)
            low.append(first)
            high.append(last)
            depth.append(d)
            parent.append(node)
            for c in children:
                if c < 0:
                    leaf_parent[-1 - c] = node
                else:
                    parent[c] = node
            return node

        for r, common in enumerate(shared.tolist()):
            below, first = -1 - r, r
            while open_nodes[-1][0] > common:
                open_nodes[-1][2].append(below)
                first = open_nodes[-1][1]
                below = close(r)
            if open_nodes[-1][0] < common:
                open_nodes.append((common, first, [below]))
            else:
                open_nodes[-1][2].append(below)
        self.root = close(n - 1)
        inner = self.inner = len(low)
        self.low, self.high = np.append(low, np.arange(n)), np.append(high, np.arange(n))
        self.depths = np.append(depth, n - order)
        self.parents = np.array(parent + leaf_parent)
        child = np.flatnonzero(np.arange(inner + n) != self.root)
        self.base = int(x.max()) + 1
        key = self.parents[child] * self.base + x[order[self.low[child]] + self.depths[self.parents[child]]]
        by = np.argsort(key)
        self.keys, self.children = key[by].tolist(), child[by].tolist()
        self.text, self.begin = x.tolist(), order[self.low].tolist()
        self.depth, self.parent = self.depths.tolist(), self.parents.tolist()
        self.link = [self.root] * inner
        for v in range(inner - 2, -1, -1):
            self.link[v] = self._rest(v, self.depth[v])

    def child(self, v: int, word: int) -> int:
        key = v * self.base + word
        at = bisect_left(self.keys, key)
        return self.children[at] if at < len(self.keys) and self.keys[at] == key else -1

    def _rest(self, v: int, length: int) -> int:
        """The node at or below which the first ``length`` words on the way to v, without the first of them, end."""
        up, at = self.parent[v], self.begin[v] + 1
        u = self.root if up == self.root else self.link[up]
        while self.depth[u] < length - 1:
            u = self.child(u, self.text[at + self.depth[u]])
        return u

    def rotated(self, v: int, length: int) -> int:
        """Where the string of that length on the way to v ends once its first word has become its last; -1 if it occurs nowhere."""
        word, u = self.text[self.begin[v]], self._rest(v, length)
        if self.depth[u] == length - 1:
            return self.child(u, word)
        return u if self.text[self.begin[u] + length - 1] == word else -1

    def locate(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Nodes at or above which the substrings end: from their leaves, as far up as they reach, by doubled steps."""
        steps = [self.parents]
        while (steps[-1] != self.root).any():
            steps.append(steps[-1][steps[-1]])
        at = self.inner + self.rank[start]
        for step in reversed(steps):
            up = step[at]
            at = np.where(self.depths[up] >= length, up, at)
        return at


def blocks(order: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Begins of the blocks of the Lempel-Ziv parse: each is the longest prefix of the rest that also begins earlier, or one word.

    ``shared``: how much each suffix of the order has in common with the next; 0 for the last.
    """
    longest, waiting = [0] * len(order), []
    for i, before in zip([*order.tolist(), -1], [0, *shared.tolist()], strict=True):
        common = before
        while waiting:
            at, own = waiting[-1]
            if i < at:
                longest[at] = max(own, common)
                common = min(own, common)
            elif common <= own:
                longest[at] = own
            else:
                break
            waiting.pop()
        waiting.append((i, common))
    begins, i = [], 0
    while i < len(longest):
        begins.append(i)
        i += max(1, longest[i])
    return np.array(begins)


def covering_squares(begins: np.ndarray, parts: Substrings) -> tuple[np.ndarray, np.ndarray]:
    """Starts and half lengths of squares of which rotations to the right give the first occurrence of every kind of square.

    Such an occurrence has its center in a block and lies not wholly in it: it goes on behind the block or begins before it.
    """
    n = parts.n
    ends = np.append(begins[1:], n)
    nexts = np.append(ends[1:], n)

    def all_halves(most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = np.repeat(np.arange(len(begins)), most)
        return block, np.arange(len(block)) - np.repeat(np.cumsum(most) - most, most) + 1

    block, half = all_halves(ends - begins)
    h = ends[block]
    q = h - half
    fits = parts.equal(h, q)
    h, q, half = h[fits], q[fits], half[fits]
    ahead, behind = parts.ahead(h, q), parts.behind(h - 1, q - 1)
    found = ahead + behind >= half
    starts, halves = [np.maximum(q - behind, q - half + 1)[found]], [half[found]]
    block, half = all_halves(nexts - begins)
    h = begins[block]
    q = h + half
    fits = parts.equal(h, q) & parts.equal(h - 1, q - 1)
    block, h, q, half = block[fits], h[fits], q[fits], half[fits]
    ahead, behind = parts.ahead(h, q), parts.behind(h - 1, q - 1)
    start = np.maximum(h - behind, h - half + 1)
    found = (ahead + behind >= half) & (start + half <= ends[block])
    return np.concatenate([*starts, start[found]]), np.concatenate([*halves, half[found]])


def primitive(start: np.ndarray, half: np.ndarray, parts: Substrings) -> np.ndarray:
    """Whether the roots, ``half`` words from ``start``, are no repetitions of a shorter string."""
    factor = np.arange(int(half.max(initial=0)) + 1)
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            multiples = factor[p * p :: p]
            multiples[multiples == np.arange(p * p, len(factor), p)] = p
    out, rest = np.ones(len(half), bool), half.copy()
    while (rest > 1).any():
        p = np.where(rest > 1, factor[rest], 1)
        shorter = half // p
        out &= (p == 1) | (parts.ahead(start, start + shorter) < half - shorter)
        rest //= p
    return out


def all_runs(x: np.ndarray) -> np.ndarray:
    """start, length, period of every run of at least two periods among numbers from 0, in rows, in no order."""
    if len(x) < 2:
        return np.zeros((0, 3), np.int64)
    x = np.append(x, x.max() + 1)
    parts = Substrings(x)
    tree = SuffixTree(x, parts)
    start, half = covering_squares(blocks(tree.order, tree.shared), parts)
    marked: set[tuple[int, int]] = set()
    for v, k in zip(tree.locate(start, 2 * half).tolist(), half.tolist(), strict=True):
        while v >= 0 and (v, k) not in marked:
            marked.add((v, k))
            v = tree.rotated(v, 2 * k)
    if not marked:
        return np.zeros((0, 3), np.int64)
    node, half = np.array(list(marked)).T
    rooted = primitive(tree.order[tree.low[node]], half, parts)
    node, half = node[rooted], half[rooted]
    count = tree.high[node] - tree.low[node] + 1
    leaf = np.repeat(tree.low[node] - np.cumsum(count) + count, count) + np.arange(count.sum())
    begin, period = tree.order[leaf], np.repeat(half, count)
    by = np.lexsort((begin, period))
    begin, period = begin[by], period[by]
    new = np.flatnonzero((np.diff(begin, prepend=-2) != 1) | (np.diff(period, prepend=-1) != 0))
    last = np.append(new[1:], len(begin)) - 1
    return np.stack([begin[new], begin[last] - begin[new] + 2 * period[new], period[new]], axis=1)


def repeated_stretches(words: list[bytes], window: int) -> list[tuple[int, int]]:
    """Begins and ends of the maximal stretches covered by windows of that many words that occur twice, by their hashes."""
    n = len(words) - window + 1
    if n < 2:
        return []
    with np.errstate(over="ignore"):
        doubled, factor = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64), np.uint64(0x9E3779B97F4A7C15)
        total, at = np.zeros(n, np.uint64), 0
        for k in range(window.bit_length()):  # doubled: hashes of 2 ** k words
            if window >> k & 1:
                total = total * factor + doubled[at : at + n]
                at += 1 << k
            doubled, factor = doubled[: -(1 << k)] * factor + doubled[1 << k :], factor * factor
    by = np.argsort(total)
    same = total[by[1:]] == total[by[:-1]]
    if not same.any():
        return []
    at = np.unique(np.concatenate([by[1:][same], by[:-1][same]]))
    new = np.flatnonzero(np.diff(at, prepend=-window - 1) > window)
    last = np.append(new[1:], len(at)) - 1
    return list(zip(at[new].tolist(), (at[last] + window).tolist(), strict=True))


def runs(words: list[bytes], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """start, length, period of the runs of at least that many words and periods (two or more), by start, then period."""
    found = []
    for lo, hi in repeated_stretches(words, max(1, least_words * (least_times - 1) // least_times)):
        ids: dict[bytes, int] = {}
        x = np.array([ids.setdefault(w, len(ids)) for w in words[lo:hi]])
        rows = all_runs(x)
        rows = rows[(rows[:, 1] >= least_words) & (rows[:, 1] >= least_times * rows[:, 2])]
        found += [(s + lo, length, q) for s, length, q in rows.tolist()]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but those that a run has after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, length, q in found:
        gone[s + q] += 1
        gone[s + length] -= 1
    return [w for w, g in zip(words, gone.cumsum().tolist(), strict=False) if not g] if found else words


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """doc_id, runs (start, length, period by start, then period) and text, the words that are kept, joined by spaces.

    A null or empty text has no runs and an empty text. Very long texts are searched whole in their task, repeated rows alike; an
    empty table gives no rows, a null doc_id stays, other columns are ignored.
    """

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            words = words_of(text)
            found = runs(words, least_words, least_times)
            yield doc_id, [{"start": s, "length": n, "period": q} for s, n, q in found], b" ".join(collapsed(words, found)).decode()

    return map_rows(docs, ["doc_id", "text"], "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string", run)


def edited(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a period from some word on, by its id's checksum; a null id has none."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: the edited words of each text, joined by spaces."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            yield doc_id, b" ".join(edited(doc_id, words_of(text))).decode()

    return map_rows(docs, ["doc_id", "text"], "doc_id long, text string", run)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_periods(table(spark, sf_dir, "documents")))

    r = F.col("runs")
    # Exact: a ratio is compared by products, which fit a long for texts of under 3e9 words.
    best = F.reduce(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.get(r, F.lit(0)), lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform(r, lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size(r) > 0, "\n").otherwise(""))
    digests = found.select("doc_id", F.size(r).cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * best.length) div best.period")
    return digests.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
