"""Benchmark decontamination by latent semantic retrieval.

Items and documents are cut into passages of 64 words, every 32 words. Passages are TF-IDF vectors over the words of the
benchmark, with document frequencies of the whole corpus; words that many items share weigh less. They are projected on
the ``rank`` leading right singular vectors of a randomised singular value decomposition, which is fitted once, on the whole
corpus and the items, and whose products are summed over the executors.

The search is by cosine in the projection: windows of 32 and 64 words of a document against the items' passages, all of
them, in bounded blocks of a matrix product. Only an item that a window meets is a candidate there; its words about the
window decide. It is leaked verbatim if the longest common subsequence is long, and as a paraphrase if the subsequence has a
lower length and enough of the item's answer is there. Counts of words that follow from these tests are asked first.

Texts are read once: the numbers of their words are kept in a table, and document frequencies, the two rounds of the fit and the
search read that. The benchmark is a query set that every task holds, ``block_items`` items at a time; a block costs one pass
over the table, the frequencies and the fit three more for all blocks. No text is shuffled. All weights are those of the whole benchmark, so the
result does not depend on the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm._common import Scratch, numbered, read, text_of

PASSAGE, STRIDE = 64, 32
#: Windows of a text that are held against the items, each a half over the next of its size.
WINDOWS = (32, 64)
COSINES_AT_ONCE = 1 << 22
WORDS_AT_ONCE = 1 << 15
_CUT = bytes.maketrans(b".,;:!?\"'()[]{}", b" " * 14)


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space and marks, A-Z lower-cased."""
    return text.lower().translate(_CUT).split()


def word_ids(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Number of each word, -1 for words that no item has."""
    words = words_of(text)
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), dtype=np.int32, count=len(words))


def passage_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - PASSAGE + STRIDE), STRIDE)


def passage_vectors(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passages that have known words, and for each the sum of these words' rows (a row for each word known)."""
    at = np.flatnonzero(ids >= 0)
    starts = passage_starts(len(ids))
    first, last = np.searchsorted(at, starts), np.searchsorted(at, starts + PASSAGE)
    some = np.flatnonzero(last > first)
    sums = np.zeros((len(at) + 1, rows.shape[1]))
    np.cumsum(rows[ids[at]], axis=0, dtype=np.float64, out=sums[1:])
    return some, sums[last[some]] - sums[first[some]]


def lcs(masks: dict[int, int], size: int, ids: list[int]) -> int:
    """Length of the longest common subsequence of an item, given as word -> bit mask of its places, and ``ids``."""
    full = (1 << size) - 1
    v = full
    for x in ids:
        if m := masks.get(x):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


@dataclass
class Item:
    item_id: int
    ids: np.ndarray  # its words, in order
    said: np.ndarray  # distinct words of its answer
    least_said: int  # how many of them a paraphrase has


@dataclass
class Benchmark:
    """The items, and what is known of their words; ``vocabulary`` numbers them."""

    vocabulary: dict[bytes, int]
    items: list[Item]
    projection: np.ndarray | None = None  # weight times right singular vectors, a row for each word and one for unknown ones
    queries: np.ndarray | None = None  # a normed column for each passage of the items
    owner: np.ndarray | None = None  # the item of each column


@dataclass
class Index:
    """Which of a block's items a document can leak, from its distinct words alone.

    ``places`` are the postings of each word: items, how often the word is in the item, and whether it is in the answer. Words
    that very many items share have no postings in most of them; ``spare`` counts these words of an item as if found.
    """

    start: np.ndarray
    items: np.ndarray
    times: np.ndarray
    said: np.ndarray
    spare: np.ndarray
    least: np.ndarray  # words that a verbatim leak has
    least_paraphrase: np.ndarray
    least_said: np.ndarray
    masks: dict[int, dict[int, int]] = field(default_factory=dict)

    def candidates(self, words: np.ndarray) -> np.ndarray:
        sizes = self.start[words + 1] - self.start[words]
        at = np.repeat(self.start[words] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        found = self.items[at]
        held = np.bincount(found, self.times[at], len(self.spare)) + self.spare
        said = np.bincount(found, self.said[at], len(self.spare))
        return np.flatnonzero((held >= self.least) | (held >= self.least_paraphrase) & (said >= self.least_said))


def index_of(items: list[Item], words: int, verbatim: float, paraphrase: float, most_items: int = 500) -> Index:
    share = np.zeros(words, dtype=np.int64)
    for item in items:
        share[np.unique(item.ids)] += 1
    rows, spare = [], np.zeros(len(items))
    least = np.array([math.ceil(verbatim * len(x.ids) - 1e-6) for x in items])
    less = np.array([math.ceil(paraphrase * len(x.ids) - 1e-6) for x in items])
    for k, item in enumerate(items):
        own, times = np.unique(item.ids, return_counts=True)
        said = np.isin(own, item.said)
        for w, n, a in sorted(zip(own.tolist(), times.tolist(), said.tolist(), strict=True), key=lambda x: -share[x[0]]):
            if share[w] > most_items and not a and spare[k] + n < less[k]:
                spare[k] += n
            else:
                rows.append((w, k, n, a))
        rows += [(w, k, 0, True) for w in np.setdiff1d(item.said, own).tolist()]
    rows.sort()
    w, k, n, a = (np.array(x) for x in zip(*rows, strict=True))
    return Index(np.searchsorted(w, np.arange(words + 1)), k, n.astype(np.float64), a.astype(np.float64), spare, least, less, np.array([x.least_said for x in items]))


def benchmark_of(rows: list[tuple[int, str, str | None]]) -> Benchmark:
    """Items that have words; the answers are filled in where given."""
    vocabulary: dict[bytes, int] = {}
    items = []
    for item_id, text, answer in rows:
        if words := words_of(text.encode()):
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int32)
            said = np.array(sorted({vocabulary.setdefault(w, len(vocabulary)) for w in words_of((answer or "").encode())}), dtype=np.int32)
            items.append(Item(item_id, ids, said, len(said)))
    return Benchmark(vocabulary, items)


def coded(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(key, ids) of ``texts`` (text, maybe key): the number of each word, in the smallest type that holds them; see ``decoded``."""
    sent, kind = texts.sparkSession.sparkContext.broadcast(vocabulary), _kind(len(vocabulary))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = sent.value
        for batch in batches:
            ids = [word_ids(text, numbers).astype(kind).tobytes() for text in batch["text"].cast(pa.binary()).to_pylist()]  # -1 becomes the largest
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(ids, pa.binary())], names=["key", "ids"])

    key = F.col("key") if "key" in texts.columns else F.lit(None).cast("long").alias("key")
    return texts.select(key, "text").mapInArrow(code, "key long, ids binary")


def _kind(words: int) -> type:
    return np.uint16 if words < 1 << 16 else np.int32


def decoded(ids: bytes, words: int) -> np.ndarray:
    """Numbers of words as ``word_ids`` gives them, from a row of ``coded`` over a vocabulary of so many ``words``."""
    out = np.frombuffer(ids, dtype=_kind(words)).astype(np.int32)
    out[out >= words] = -1
    return out


def document_frequencies(documents: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """In how many of all documents, as ``coded`` gives them, each word of the benchmark is, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(words + 1, dtype=np.int64), 0
        for batch in batches:
            for ids in batch["ids"].to_pylist():
                counts[np.unique(decoded(ids, words))] += 1
                rows += 1
        some = np.flatnonzero(counts[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], rows))], names=["word", "n"])

    total = documents.select("ids").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(words, dtype=np.int64), 0
    for row in total.toLocalIterator():
        if row["word"] < 0:
            rows = row["n"]
        else:
            out[row["word"]] = row["n"]
    return out, rows


def words_held(words: np.ndarray, most: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """How many of ``words`` are in each slice first:last, no word more than its ``most`` times; both bounds ascend."""
    order = np.argsort(words, kind="stable")
    place = np.arange(len(words))
    back = place - most[order]  # the place in order of the same word, its most times before
    same = (back >= 0) & (words[order[np.maximum(back, 0)]] == words[order])
    before = np.empty(len(words), dtype=np.int64)
    before[order] = np.where(same, order[np.maximum(back, 0)], -1)
    # A word counts in the slices that hold it and begin after ``before``: a run of slices.
    start = np.maximum(np.searchsorted(first, before, "right"), np.searchsorted(last, place, "right"))
    end = np.maximum(np.searchsorted(first, place, "right"), start)
    size = len(first) + 1
    return np.cumsum(np.bincount(start, minlength=size) - np.bincount(end, minlength=size))[:-1]


def passages_that_leak(ids: np.ndarray, item: Item, index: Index, number: int, near: np.ndarray, shares: np.ndarray, said: np.ndarray, paraphrase: float) -> Iterator[tuple[int, float, int]]:
    """(start, lcs, answer words) of each passage about which the item stands, of those that ``near`` marks.

    Words that the item lacks can't be in the sequence. ``shares`` and ``said`` tell for each word how often it is in the item
    and whether in its answer.
    """
    n, starts = len(item.ids), passage_starts(len(ids))
    low, high = starts - n, starts + PASSAGE + n
    at, answered = np.flatnonzero(shares[ids]), np.flatnonzero(said[ids])
    first, last = np.searchsorted(at, low), np.searchsorted(at, high)
    held = words_held(ids[at], shares[ids[at]], first, last)
    there = words_held(ids[answered], np.ones(len(answered), dtype=np.int64), np.searchsorted(answered, low), np.searchsorted(answered, high))
    if number not in index.masks:
        places: dict[int, int] = {}
        for place, w in enumerate(item.ids.tolist()):
            places[w] = places.get(w, 0) | 1 << place
        index.masks[number] = places
    for p in np.flatnonzero(near & ((held >= index.least[number]) | (held >= index.least_paraphrase[number]) & (there >= item.least_said))).tolist():
        share = lcs(index.masks[number], n, ids[at[first[p] : last[p]]].tolist()) / n
        if share >= paraphrase:
            yield int(starts[p]), share, int(there[p])


def windows(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, sum of the words' rows) of the windows of all ``WINDOWS``, each a half over the next.

    The last of ``rows`` is that of unknown words. Words are added up in steps of a half of the smallest window first.
    """
    step = WINDOWS[0] // 2
    cuts = np.arange(0, max(len(ids), 1), step)
    sums = np.zeros((len(cuts) + 1, rows.shape[1]))
    if len(ids):
        np.cumsum(np.add.reduceat(rows[ids], cuts, axis=0), axis=0, dtype=np.float64, out=sums[1:])
    first, last = [], []
    for k, size in enumerate(WINDOWS):
        if k and len(ids) <= WINDOWS[k - 1]:
            break
        starts = np.arange(0, max(1, len(cuts) - size // step + size // step // 2), size // step // 2)
        first.append(starts)
        last.append(np.minimum(starts + size // step, len(cuts)))
    low, high = np.concatenate(first), np.concatenate(last)
    return low * step, np.minimum(high * step, len(ids)), (sums[high] - sums[low]).astype(np.float32)


def retrieved(ids: np.ndarray, benchmark: Benchmark, index: Index, least_cosine: float) -> tuple[np.ndarray, ...]:
    """(item, first, last, cosine) of the windows of a text whose cosine with a passage of the item reaches ``least_cosine``.

    The search: every window against every passage of the block, in pieces of bounded size. Of what it finds, items that the
    tests could not confirm, from the words of the whole text, are left out before the cosines are taken exactly, pair by
    pair, so that their last digits don't depend on the block.
    """
    first, last, vectors = windows(ids, benchmark.projection)
    norms = np.linalg.norm(vectors, axis=1)
    some = np.flatnonzero(norms > 1e-6)
    units = vectors[some] / norms[some, None]
    at_once = max(1, COSINES_AT_ONCE // max(1, benchmark.queries.shape[1]))
    window, query = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for k in range(0, len(some), at_once):
        found = np.flatnonzero(units[k : k + at_once] @ benchmark.queries >= least_cosine - 1e-3)
        window.append(some[k + found // benchmark.queries.shape[1]])
        query.append(found % benchmark.queries.shape[1])
    window, query = np.concatenate(window), np.concatenate(query)
    if len(query):
        words = np.unique(ids)
        possible = np.zeros(len(benchmark.items), dtype=bool)
        possible[index.candidates(words[words >= 0])] = True
        kept = possible[benchmark.owner[query]]
        window, query = window[kept], query[kept]
    exact = np.einsum("ij,ij->i", vectors[window], benchmark.queries.T[query], dtype=np.float64) / norms[window]
    enough = exact >= least_cosine
    window = window[enough]
    return benchmark.owner[query[enough]], first[window], last[window], exact[enough]


def word_pieces(documents: Iterator[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(word, stride, document of each stride) of the known words of some documents at a time, ``WORDS_AT_ONCE`` or one more document."""
    words, strides, owners, held, number = [], [], [], 0, 0
    for ids in documents:
        at, n = np.flatnonzero(ids >= 0), max(1, -(-len(ids) // STRIDE))
        words.append(ids[at])
        strides.append(number + at // STRIDE)
        owners.append(np.full(n, len(owners)))
        held, number = held + len(ids), number + n
        if held >= WORDS_AT_ONCE:
            yield np.concatenate(words), np.concatenate(strides), np.concatenate(owners)
            words, strides, owners, held, number = [], [], [], 0, 0
    if owners:
        yield np.concatenate(words), np.concatenate(strides), np.concatenate(owners)


def piece_products(word: np.ndarray, stride: np.ndarray, owner: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stride: the sum of the words' rows over the passage that begins there (none: zero), and over all passages that it is in.

    A passage is two strides, or the only one of a document.
    """
    sums = np.zeros((len(owner), rows.shape[1]), dtype=rows.dtype)
    if len(word):
        first = np.flatnonzero(np.diff(stride, prepend=-1))
        sums[stride[first]] = np.add.reduceat(rows[word], first, axis=0)
    goes_on = owner[1:] == owner[:-1]
    next_too, last_too = np.append(goes_on, False), np.append(False, goes_on)
    passages = sums.copy()
    passages[next_too] += sums[last_too]
    passages[last_too & ~next_too] = 0
    back = passages.copy()
    back[last_too] += passages[next_too]
    return passages, back


def fit_projection(documents: DataFrame, benchmark: Benchmark, weight: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Randomised singular value decomposition of the TF-IDF passages of all ``documents``, texts or what ``coded`` makes of them.

    The passages stay where they are. Each partition multiplies its own by a random matrix and back; the sums of these
    products, words times rank, are added up in a tree over the executors. A second round does the same in the subspace
    found and gives the singular vectors.
    """
    size = min(rank + 16, max(1, len(weight)))
    context, words = documents.sparkSession.sparkContext, len(benchmark.vocabulary)
    documents = documents if "ids" in documents.columns else coded(documents, benchmark.vocabulary)

    def summed(left: np.ndarray, back: bool) -> np.ndarray:
        sent = context.broadcast((weight, left))

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, matrix = sent.value
            rows = (weights[:, None] * matrix).astype(np.float32)
            out = np.zeros((len(weights) if back else matrix.shape[1], matrix.shape[1]))
            for word, stride, owner in word_pieces(decoded(ids, words) for batch in batches for ids in batch["ids"].to_pylist()):
                passages, of_strides = piece_products(word, stride, owner, rows)
                if not back:
                    passages = passages.astype(np.float64)
                    out += passages.T @ passages
                elif len(word):
                    order = np.argsort(word, kind="stable")
                    first = np.flatnonzero(np.diff(word[order], prepend=-1))
                    found = word[order[first]]
                    out[found] += weights[found, None] * np.add.reduceat(of_strides.astype(np.float64)[stride[order]], first, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

        shape = (len(weight) if back else left.shape[1], left.shape[1])
        parts = documents.select("ids").mapInArrow(partial, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(shape))
        return parts.treeReduce(np.add) if parts.getNumPartitions() else np.zeros(shape)

    random = np.random.default_rng(seed).standard_normal((len(weight), size))
    base, _ = np.linalg.qr(summed(random, True))
    _, vectors = np.linalg.eigh(summed(base, False))
    return base @ vectors[:, ::-1][:, :rank]


LEAKS = "cosine double, lcs double, answer double, kind string"


def searched(texts: DataFrame, benchmark: DataFrame, scratch: Scratch, verbatim: float, paraphrase: float, least_cosine: float, least_answer: float, rank: int, block_items: int, seed: int) -> DataFrame:
    """(key, item_id, cosine, lcs, answer, kind) for each row of ``texts`` (key long, text) and item that it leaks."""
    spark = texts.sparkSession
    schema = "key long, item_id long, " + LEAKS
    said = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    rows = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"), said.alias("answer"))
    rows = [tuple(r) for r in rows.toLocalIterator()]  # the query set, which every task is to hold
    known = benchmark_of(sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")))
    if not known.items:
        return spark.createDataFrame([], schema)
    words = scratch.table(coded(texts, known.vocabulary), "words")
    counts, documents = document_frequencies(words, len(known.vocabulary))
    # Over the different texts of the benchmark, so that repeats of an item make no difference.
    of_items, different = np.zeros(len(known.vocabulary), dtype=np.int64), {x.ids.tobytes(): x.ids for x in known.items}
    for ids in different.values():
        of_items[np.unique(ids)] += 1
    weight = np.maximum(np.log((documents + 1) / (counts + 1)), 1.5)
    weight *= np.maximum(np.log((len(different) + 1) / np.maximum(of_items, 1)) / np.log(len(different) + 1), 0.1)
    of_benchmark = coded(benchmark.filter("text IS NOT NULL").select(F.col("text").cast("string")).coalesce(1), known.vocabulary)
    projection = weight[:, None] * fit_projection(words.unionByName(of_benchmark), known, weight, rank, seed)
    known.projection = np.vstack([projection, np.zeros((1, projection.shape[1]))]).astype(np.float32)
    names = list(known.vocabulary)
    for item in known.items:
        if not len(item.said):
            rare = sorted(set(item.ids.tolist()), key=lambda w: (counts[w], names[w]))
            item.said = np.array(rare[: math.ceil(len(rare) / 5)], dtype=np.int32)
            item.least_said = math.ceil(least_answer * len(item.said))
    out = spark.createDataFrame([], schema)
    for k in range(0, len(known.items), block_items):
        items = known.items[k : k + block_items]
        block = block_of(items, known)
        sent = spark.sparkContext.broadcast((block, index_of(items, len(known.vocabulary), verbatim, min(verbatim, paraphrase))))
        out = out.unionByName(words.mapInArrow(_search(sent, verbatim, paraphrase, least_cosine), schema))
    return out


def block_of(items: list[Item], known: Benchmark) -> Benchmark:
    """The queries of a block: each passage of each item, projected and normed."""
    vectors = [passage_vectors(item.ids, known.projection)[1] for item in items]
    rows = np.concatenate(vectors)
    queries = (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return Benchmark(known.vocabulary, items, known.projection, np.ascontiguousarray(queries.T), np.repeat(np.arange(len(items)), [len(v) for v in vectors]))


def _search(sent, verbatim: float, paraphrase: float, least_cosine: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = sent.value
        size = len(block.vocabulary)
        shares, said = np.zeros(size + 1, dtype=np.int64), np.zeros(size + 1, dtype=bool)  # the last: a word that no item has
        for batch in batches:
            rows = []
            for key, coded_ids in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                ids = decoded(coded_ids, size)
                hits = retrieved(ids, block, index, least_cosine)
                starts = passage_starts(len(ids))
                for number in np.unique(hits[0]).tolist():
                    item, of = block.items[number], hits[0] == number
                    marks = np.zeros(len(starts) + 1, dtype=np.int64)
                    np.add.at(marks, np.searchsorted(starts, hits[1][of] - PASSAGE, "right"), 1)
                    np.add.at(marks, np.searchsorted(starts, hits[2][of], "left"), -1)
                    own, times = np.unique(item.ids, return_counts=True)
                    shares[own], said[item.said] = times, True
                    best, cosine = None, float(min(1.0, hits[3][of].max()))
                    for _, share, there in passages_that_leak(ids, item, index, number, np.cumsum(marks)[:-1] > 0, shares, said, min(verbatim, paraphrase)):
                        exact = share >= verbatim
                        if exact or there >= item.least_said:
                            best = max(best or (False, 0.0, 0.0), (exact, share, there / len(item.said)))
                    shares[own], said[item.said] = 0, False
                    if best:
                        rows.append((key, item.item_id, cosine, best[1], best[2], "verbatim" if best[0] else "paraphrase"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()), strict=True)], names=["key", "item_id", "cosine", "lcs", "answer", "kind"])

    return search


def find_leaks(documents: DataFrame, benchmark: DataFrame, verbatim: float = 0.8, paraphrase: float = 0.25, least_cosine: float = 0.5, least_answer: float = 0.4, rank: int = 64, block_items: int = 20_000, seed: int = 7, scratch: Scratch | None = None, key: str | None = None) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, kind) for each document (doc_id, text) and benchmark item that it leaks.

    lcs is the share of the item's words in the longest common subsequence of the item and the words about a passage, answer the
    share of the item's answer found there, cosine the largest of a window of the document with the item in the projection. The
    answer is the item's column ``answer`` if there is one, else the fifth of its distinct words that the fewest documents
    have. Only items whose cosine reaches ``least_cosine`` are looked at, about the windows where it does. A leak is
    ``verbatim`` if lcs reaches that threshold. It is a ``paraphrase`` if lcs reaches the lower one and the whole of a given
    answer is there, or ``least_answer`` of one that was derived.

    The decomposition is fitted on the items and all documents, as all else. Null texts count as empty; items without words or with a null id can't be found. Repeated
    rows and items are each reported. Empty tables give an empty result; other columns are ignored. ``key`` names a long column
    that takes the place of doc_id in the result.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    texts = documents.select(F.col(key or "doc_id").cast("long").alias("key"), text_of().alias("text"))
    found = searched(texts, benchmark, scratch, verbatim, paraphrase, least_cosine, least_answer, rank, block_items, seed)
    return found.withColumnRenamed("key", "row" if key else "doc_id")


def without_leaks(documents: DataFrame, benchmark: DataFrame, scratch: Scratch | None = None, **options) -> DataFrame:
    """``documents`` without the rows that leak an item; columns unchanged, whatever their names.

    Each row is judged by its own text, with or without a doc_id; null and empty texts leak nothing and stay, as do all rows
    where the benchmark is empty. An empty table gives an empty result.
    """
    scratch = scratch or Scratch(documents.sparkSession)
    rows, row = numbered(documents, scratch, "numbered")
    leaks = find_leaks(rows, benchmark, scratch=scratch, key=row, **options).select(F.col("row").alias(row)).distinct()
    leaks = scratch.table(leaks, "leaks")
    scratch.drop("words")
    return rows.join(leaks, row, "left_anti").select(*documents.columns)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
