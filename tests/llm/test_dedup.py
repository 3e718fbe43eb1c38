"""Exact, SimHash and line deduplication, and removal of repeats, against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import components, exact_dedup, line_dedup, ngram_join, repeat_removal, simhash_dedup
from textloom.llm._common import Scratch, read, with_groups

WORD = r"[^\x20\x09-\x0D]+"


def brute_exact(rows):
    groups = defaultdict(list)
    for k, (d, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), d is None, d or 0, k))
    out = []
    for k, (d, t) in enumerate(rows):
        normal = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        n, none, keep, _ = min(groups[normal])
        out.append((d, None if none else keep, len(groups[normal]), hashlib.sha256(normal.encode()).hexdigest()))
    return out


def pairs(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", ["odd_documents", "no_documents", "documents"])
def test_exact(spark, data, request, name):
    frame = read(spark, data, "documents") if name == "documents" else request.getfixturevalue(name)
    got = exact_dedup.exact_dedup(frame).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(brute_exact(pairs(frame)))
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept) == {r.text_sha256 for r in got} and set(kept.values()) <= {1}


def test_chunks_depend_on_content_only():
    random.seed(1)
    text = bytes(random.randrange(97, 123) for _ in range(60_000))
    ends = exact_dedup.chunk_ends(text)
    assert ends[-1] == len(text) and all(b - a <= 16_384 for a, b in zip([0, *ends], ends, strict=False))
    shifted = {e - 5 for e in exact_dedup.chunk_ends(b"12345" + text)}
    assert len(shifted & set(ends)) >= len(ends) - 3
    assert exact_dedup.chunk_ends(b"") == [] and exact_dedup.chunk_ends(b"a" * 100) == [100]


def test_groups_that_hold_most_rows(spark):
    """Rows of large groups stay where they are; the result is that of a plain join."""
    scratch = Scratch(spark)
    rows = scratch.table(spark.range(3000).selectExpr("id AS row", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k"), "rows")
    groups = scratch.table(rows.groupBy("k").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("k % 2 = 1"), "groups")
    for how in ("inner", "left"):
        expected = rows.join(groups.drop("n"), "k", how).select("k", "row", "first").collect()
        got = with_groups(rows, groups, ["k"], "n", how)
        assert sorted(map(str, got.select("k", "row", "first").collect())) == sorted(map(str, expected))
    assert with_groups(rows, groups.limit(0), ["k"], "n", "left").count() == 3000
    scratch.close()


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(5, "one two three four"), (5, "one two three four"), (None, "one two three four"), (None, "other words here now"), (6, None), (7, "")]
    kept = simhash_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == [(0, "other words here now"), (5, "one two three four"), (6, "")]


def brute_print(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: doc_id -> fingerprint."""
    parent = {d: d for d in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_simhash(spark, data):
    frame = read(spark, data, "documents")
    prints = {d: brute_print(t) for d, t in pairs(frame)}
    expected = brute_components(prints)
    got = simhash_dedup.simhash_components(frame).collect()
    assert len(got) == len(prints)
    for r in got:
        assert int(r.fingerprint, 16) == prints[r.doc_id] and len(r.fingerprint) == 16 and r.component_id == expected[r.doc_id]


def test_simhash_odd(odd_documents, no_documents):
    got = {r.doc_id: r for r in simhash_dedup.simhash_components(odd_documents).collect()}
    assert simhash_dedup.simhash_components(odd_documents).count() == odd_documents.count()
    assert got[3].component_id == got[4].component_id == got[5].component_id == 3 and got[3].fingerprint == "0" * 16
    assert got[2].component_id == 1
    assert simhash_dedup.simhash_components(no_documents).count() == 0
    kept = simhash_dedup.near_dedup(odd_documents)
    assert kept.columns == odd_documents.columns and {r.doc_id for r in kept.collect()} >= {1, 3, None}


@pytest.mark.parametrize("small_cell", [64, 2])
def test_links_find_every_close_pair(spark, small_cell):
    random.seed(7)
    prints = [random.getrandbits(64) for _ in range(30)]
    for p in prints[:15]:
        a, b, c, d = random.sample(range(64), 4)
        prints += [p ^ 1 << a, p ^ 1 << a ^ 1 << b, p ^ 1 << a ^ 1 << b ^ 1 << c, p ^ 1 << a ^ 1 << b ^ 1 << c ^ 1 << d]
    prints += [0, 3, (1 << 63) | 1, 1 << 63]
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    frame = spark.createDataFrame([(s,) for s in signed], "print long")
    scratch = Scratch(spark)
    found = dict(tuple(r) for r in components.connected_components(simhash_dedup.fingerprint_links(frame, scratch, small_cell), scratch).collect())
    got = defaultdict(set)
    for s in signed:
        got[found.get(s, s)].add(s)
    expected = defaultdict(set)
    for s, root in brute_components(signed).items():
        expected[root].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)], "u long, v long")
    got = components.connected_components(edges, Scratch(spark)).collect()
    assert len(got) == n and {r.component for r in got} == {0}


def brute_removal(texts, window):
    seen = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept))
    return out


def test_repeat_removal_small(spark):
    random.seed(3)
    passage = "".join(random.choice("abcdefgh ") for _ in range(90))
    texts = [passage, "x" + passage + "y", passage[:50] + "Q" + passage[50:], passage[5:45], "a" * 200, "ab" * 100, "", None, passage[20:] + passage[:60], "é" * 60, "é" * 60]
    texts += ["".join(random.choice("ab") for _ in range(120)) for _ in range(20)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeat_removal.remove_repeats(frame, window=40, gram=20).collect()}
    assert got == dict(enumerate(brute_removal([(t or "").encode() for t in texts], 40)))


def test_repeat_removal_data(spark, data):
    frame = read(spark, data, "documents")
    rows = pairs(frame)
    expected = dict(zip((d for d, _ in rows), brute_removal([t.encode() for _, t in rows], 400), strict=True))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeat_removal.remove_repeats(frame).collect()}
    assert got == expected


def test_repeat_removal_of_planted_passages(spark, data):
    """Passages of 51 words in two documents each: one of 400 bytes goes whole, a shorter one stays, other documents are left alone."""
    random.seed(19)
    texts = dict(pairs(read(spark, data, "documents")))

    def removed():
        frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
        return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeat_removal.remove_repeats(frame).collect()}

    before = removed()
    words = sorted({w for t in texts.values() for w in re.findall(WORD, t)})
    clean = random.sample(sorted(d for d, r in before.items() if r[1] == 0), 40)
    expected = dict(before)
    for k in range(20):
        passage = " ".join(random.choices([w for w in words if (len(w.encode()) >= 8) == (k % 2 == 0)], k=51))
        assert (len(passage.encode()) >= 400) == (k % 2 == 0)
        for d, seam in zip(clean[2 * k : 2 * k + 2], "AB", strict=True):
            texts[d] += seam + passage
            whole, gone = texts[d].encode(), len(passage.encode()) if k % 2 == 0 else 0
            expected[d] = (len(whole), gone, int(gone > 0), whole[: len(whole) - gone])
    assert removed() == expected


def test_repeat_removal_slices(spark):
    """Texts longer than a slice: the borders of slices make no difference."""
    random.seed(5)
    body = bytes(random.randrange(97, 105) for _ in range(repeat_removal.SLICE + 50_000)).decode()
    at = repeat_removal.SLICE
    texts = [body, "q" + body[at - 700 : at + 800] + "z" * 300, body[at - 390 : at + 10], body[:100], body[at - 1000 : at - 601]]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeat_removal.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_removal([t.encode() for t in texts], 400)))
    assert got[0][1] == got[1][1] == 1500 and got[2][1] == 400 and got[4][1] == 0


def test_repeat_removal_odd(odd_documents, no_documents):
    got = repeat_removal.remove_repeats(odd_documents)
    assert got.count() == odd_documents.count() and repeat_removal.remove_repeats(no_documents).count() == 0
    by_id = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert by_id[6].n_removed == by_id[6].n_bytes and by_id[3].n_bytes == 0


def brute_lines(docs, least=5):
    seen, out = [], {}
    for d, text in sorted(docs):
        kinds = []
        for no, line in enumerate(text.split("\n")):
            words = tuple(re.findall(WORD, line))
            if not words:
                continue
            exact = any(words == s for s in seen)
            near = len(words) >= least and any(len(s) >= least and within(words, s) for s in seen if s != words)
            kinds.append((no, "near" if near else "exact" if exact else "first"))
            seen.append(words)
        out[d] = kinds
    # A line that is near an earlier one is near wherever it stands again.
    return out


def within(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


@pytest.mark.parametrize("least", [5, 2])
def test_lines_random(spark, least):
    random.seed(11)
    words = [f"w{i}" for i in range(6)]
    bases = [[random.choice(words) for _ in range(random.randrange(1, 14))] for _ in range(25)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(4):
            line = list(random.choice(bases))
            for _ in range(random.randrange(3)):
                i = random.randrange(len(line) + 1)
                kind = random.randrange(3)
                line[i : i + (kind > 0)] = [] if kind == 1 else [random.choice(words)]
            lines.append("  ".join(line) if random.random() < 0.2 else " ".join(line))
        docs.append((d, "\n".join([*lines, "", " \t"])))
    expected = brute_lines(docs, least)
    got = defaultdict(list)
    for r in line_dedup.line_decisions(spark.createDataFrame(docs, "doc_id long, text string"), least).collect():
        got[r.doc_id].append((r.no, r.kind))
    for d, kinds in expected.items():
        mine = dict(got[d])
        for no, kind in kinds:
            # brute force judges each occurrence by what stands before it; the first occurrence decides for a near line
            assert (mine[no] == "first") == (kind == "first"), (d, no, kind, mine[no])


def test_a_template_line_that_very_many_share(spark):
    docs = [(d, f"the same template with word{d} in it\nexactly this line is everywhere") for d in range(400)]
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id > 0, r.n_near, r.n_exact) for r in got} == {(False, 0, 0), (True, 1, 1)}
    with pytest.raises(ValueError):
        line_dedup.dedup_lines(spark.createDataFrame(docs[:1], "doc_id long, text string"), least_words=1)


def test_lines_odd(odd_documents, no_documents):
    got = line_dedup.dedup_lines(odd_documents)
    assert got.count() == odd_documents.distinct().count()
    assert line_dedup.dedup_lines(no_documents).count() == 0
    texts = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(odd_documents).collect()}
    assert texts[5] == "   \n" and texts[1].startswith("Alpha")


def brute_sets(rows, size=5):
    out = []
    for _, text in rows:
        words = re.findall(WORD, (text or "").translate({k: k + 32 for k in range(65, 91)}))
        out.append({" ".join(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else {" ".join(words)} if words else set())
    return out


def brute_jaccard(rows, size=5, percent=80):
    """(doc_id, n_shingles, component_id) of each row over all pairs."""
    sets = brute_sets(rows, size)
    least = list(range(len(rows)))

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                least[root(a)] = root(b)
    smallest = defaultdict(list)
    for k, (d, _) in enumerate(rows):
        smallest[root(k)].append(d)
    return [(d, len(sets[k]), min((x for x in smallest[root(k)] if x is not None), default=None)) for k, (d, _) in enumerate(rows)]


@pytest.mark.parametrize("name", ["odd_documents", "no_documents", "documents"])
def test_ngram_join(spark, data, request, name):
    frame = read(spark, data, "documents") if name == "documents" else request.getfixturevalue(name)
    got = ngram_join.jaccard_components(frame)
    assert Counter(map(tuple, got.collect())) == Counter(brute_jaccard(pairs(frame)))


@pytest.mark.parametrize(("size", "percent", "further"), [(5, 80, 0.5), (2, 50, 0.25), (1, 20, 1.0), (3, 95, 0.0)])
def test_ngram_join_of_chains_and_hubs(spark, size, percent, further):
    """Near copies in chains, about a hub, and texts that share a passage without being alike."""
    rng = random.Random(size)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = []
    for family in range(8):
        words = rng.choices(vocabulary, k=rng.choice([3, 5, 12, 40, 80]))
        for copy in range(12):
            if family % 2:
                changed = words  # a chain: each differs from the one before
            else:
                changed = list(words)
            for _ in range(rng.choice([0, 1, 1, 2])):
                at = rng.randrange(len(changed))
                changed[at : at + 1] = rng.choice([[], [rng.choice(vocabulary)], [changed[at], "New"]]) if len(changed) > 1 else ["new"]
            texts.append(" ".join(changed))
    passage = " ".join(rng.choices(vocabulary, k=30))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=15)) for _ in range(20)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), size, percent, further)
    assert Counter(map(tuple, got.collect())) == Counter(brute_jaccard(rows, size, percent))


def test_ngram_join_counts_hot_tokens_by_partial_sums(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, " ".join(["same"] * 5 + [f"x{rng.randrange(10)}" for _ in range(10)])) for k in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert ngram_join.hot_cells(frame.select(F.lit(7).cast("long").alias("token"))) == {7: 300}
    monkeypatch.setattr(ngram_join, "hot_cells", lambda tokens: {k: 5 for k in range(0, ngram_join.CELLS, 2)})
    assert Counter(map(tuple, ngram_join.jaccard_components(frame).collect())) == Counter(brute_jaccard(rows))
