"""Toxicity, personal data, decontamination and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_formats import brute_targets
from textloom.llm import decontamination, mixing, pii, simhash_dedup, token_store, toxicity
from textloom.llm._common import read

SF = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    rows = toxicity.op7_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in read(spark, SF, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    clean, toxic = [r for r in held if not labels[r.doc_id]], [r for r in held if labels[r.doc_id]]
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)
    ranks = sum(a.score > b.score for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert ranks > 0.85


def naive_ftrl(rows, alpha, beta, l1, l2, epochs):
    """FTRL-proximal coordinate by coordinate, in dictionaries."""
    z, n = defaultdict(float), defaultdict(float)
    positive = sum(y for _, y in rows)
    bias, seen = math.log((positive + 0.5) / (len(rows) - positive + 0.5)), 0.0

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for x, y in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + math.exp(-bias - sum(w.values()))) - y
            for i in x:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
            seen += g * g
            bias -= 0.05 * g / (1 + math.sqrt(seen))
    return {i: weight(i) for i in z if weight(i)}, bias


def test_ftrl_equals_a_naive_version():
    random.seed(31)
    rows = [(sorted(random.sample(range(200), random.randrange(0, 15))), int(random.random() < 0.3)) for _ in range(300)]
    rows += [([*x, 250], 1) for x, _ in rows[:60]]
    weights, bias = naive_ftrl(rows, 1.0, 1.0, 0.5, 0.1, 3)
    model = toxicity.ftrl([(np.array(x, dtype=np.int32), y) for x, y in rows], 8, 1.0, 1.0, 0.5, 0.1, 3)
    assert dict(zip(model.index.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(weights, rel=1e-5) and model.bias == pytest.approx(bias)
    assert 0 < len(model.index) < 201 and weights[250] > 0


def test_scores_equal_a_naive_version(spark):
    words = [f"w{i}" for i in range(40)]
    random.seed(32)
    texts = [" ".join(random.choices(words, k=random.randrange(0, 30))) for _ in range(60)] + [None, "", "W1 w2, (w3).", "word " * 50_000]
    make = toxicity.Features(12)
    features = {t: {int(i) for i in make((t or "").encode())} for t in texts}
    weights = {i: (i % 7 - 3) / 5 for f in features.values() for i in f}
    model = toxicity.ToxicityModel(12, np.array(sorted(weights), dtype=np.int32), np.array([weights[i] for i in sorted(weights)], dtype=np.float32), -0.4)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.score_toxicity(frame, model).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(0.4 - sum(weights[i] for i in features[texts[r.doc_id]]))), abs=1e-6)


def test_rows_of_one_doc_id_with_other_texts(spark):
    docs = spark.createDataFrame([(1, "awful words"), (1, "kind words"), (1, "awful words"), (2, "plain")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    a, b = toxicity.fit_toxicity(docs, labels), toxicity.fit_toxicity(docs.repartition(3), labels)
    assert a.bias == b.bias and a.index.tolist() == b.index.tolist()
    kept = toxicity.keep_clean(docs, labels, threshold=1.1)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, docs.collect()))


def test_held_out_labels_are_not_read(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    flipped = labels.withColumn("toxic", (toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic"))).cast("int"))
    a, b = toxicity.learnt_model(docs, labels), toxicity.learnt_model(docs, flipped)
    assert a.bias == b.bias and (a.index == b.index).all() and (a.weight == b.weight).all()
    assert len(a.index) < 20_000  # L1 keeps the model short


def test_toxicity_odd(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (3, 1)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(odd_documents, labels)
    scored = toxicity.score_toxicity(odd_documents, model)
    assert scored.count() == odd_documents.count() and scored.filter("score IS NULL").count() == 0
    assert toxicity.score_toxicity(no_documents, toxicity.fit_toxicity(no_documents, labels)).count() == 0
    assert toxicity.keep_clean(odd_documents, labels.limit(0)).count() == odd_documents.count()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if passes(k, m[0])]


def texts_of_pieces(n):
    random.seed(13)
    pieces = ["a@b.c", "_d@e.f", "@", ".", "x.y.z", "1.2.3.4", "300.1.1.1", "00012.0.0.1", ".5", "4111 1111 1111 1111", "4111111111111111", "-", " ", "+1 (555) 010-9999", "+", "12", "é😀", "a" * 30, "\n", "79927398713", "٣", "a@b", "..c", "%+-@q.w.e.r"]
    return ["".join(random.choice(pieces) for _ in range(random.randrange(1, 12))) for _ in range(n)]


def test_base_spans(spark, odd_documents, no_documents):
    texts = [*texts_of_pieces(400), "", None, "9" * 20_000, "a" * 20_000 + "@", "a@" + "b." * 5_000 + "c", "1." * 9_000]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = pii.KINDS
    for r in pii.find_personal_data(frame).collect():
        got = [f"{names[s.kind]}:{s.start}:{s.end}" for s in r.spans or () if s.kind < 4]
        assert got == brute_spans(texts[r.doc_id] or ""), texts[r.doc_id]
    assert pii.find_personal_data(odd_documents).count() == odd_documents.distinct().count()
    assert pii.find_personal_data(no_documents).count() == 0


def test_query_digest(spark, data):
    texts = {r.doc_id: r.text for r in read(spark, data, "documents").collect()}
    for r in pii.op8_personal_data(spark, data).collect():
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in BASE]


def test_terms_that_disclose(spark):
    random.seed(4)
    common = [f"word{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(200):
        words = random.sample(common, 8)
        if i < 8:
            words += ["Zebulon", "write", "to", "z.q@example.org"]
        rows.append((i, " ".join([*words, f"tail{chr(97 + i % 26)}{chr(97 + i // 26)}"])))
    rows += [(300 + i, "copyonly text of one@copy.org") for i in range(6)]  # copies of one text are no evidence
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = defaultdict(set)
    for r in pii.find_personal_data(frame).collect():
        for s in r.spans or ():
            if s.kind == 4:
                got[texts[r.doc_id][s.start : s.end]].add((r.doc_id, s.action))
    assert set(got) == {"Zebulon", "write", "to"} and got["Zebulon"] == {(i, "remove") for i in range(8)}
    clean = {r.doc_id: r.text for r in pii.sanitised(frame).collect()}
    assert "[EMAIL]" in clean[0] and "Zebulon" not in clean[0] and clean[100] == texts[100]


def named_terms(spark, rows, **options):
    """{term: actions} of the terms found in ``rows`` of (doc_id, text)."""
    texts, got = dict(rows), defaultdict(set)
    for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect():
        for s in r.spans or ():
            if s.kind == 4:
                got[texts[r.doc_id][s.start : s.end]].add(s.action)
    return got


def brute_terms(rows, support=3, generalise=0.8, remove=0.95):
    """{(doc_id, start, end): action} by counting every pair of an entity and a term."""
    docs = {}
    for d, t in rows:
        docs.setdefault((d, t or ""), 0)
        docs[d, t or ""] += 1
    n, base, words = sum(docs.values()), {}, {}
    for key in docs:
        spans = [(k, m.start(), m.end(), k + ":" + (m[0].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", m[0]))) for k, p in BASE.items() for m in re.finditer(p, key[1]) if passes(k, m[0])]
        base[key] = spans
        words[key] = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W_]+", key[1])]
    entity, n_term, both, texts, entity_texts = Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    near = defaultdict(set)
    for key, times in docs.items():
        for w in {w for _, _, w in words[key]}:
            n_term[w] += times
        clear = [(s, e, w) for s, e, w in words[key] if not any(a < e and b > s for _, a, b, _ in base[key])]
        for e in {x[3] for x in base[key]}:
            entity[e] += times
            entity_texts[e].add(key[1])
            places = {a // pii.PASSAGE for _, a, _, x in base[key] if x == e}
            for w in {w for s, _, w in clear if any(abs(s // pii.PASSAGE - p) <= 1 for p in places)}:
                both[e, w] += times
                texts[e, w].add(key[1])
                near[key].add((e, w))
    share = {}
    for (e, w), count in both.items():
        if len(entity_texts[e]) > 1 and entity[e] >= support and count >= support and len(texts[e, w]) >= support and entity[e] < n:
            share[e, w] = math.log(n * count / (entity[e] * n_term[w])) / math.log(n / entity[e])
    out = {}
    for key in docs:
        clear = [(s, e, w) for s, e, w in words[key] if not any(a < e and b > s for _, a, b, _ in base[key])]
        for s, e, w in clear:
            top = max((share[x] for x in near[key] if x[1] == w and x in share), default=0.0)
            if top >= generalise:
                out[key[0], key[1], s, e] = "remove" if top >= remove else "generalise"
    return out


def test_terms_equal_brute_force(spark):
    random.seed(51)
    common = [f"w{i}" for i in range(25)]
    people = [(f"name{i}", f"u{i}@mail.org", f"+1 555 010 {1000 + i}") for i in range(12)]
    rows = []
    for d in range(150):
        words = random.choices(common, k=random.randrange(3, 200))
        for _ in range(random.randrange(3)):
            name, mail, phone = random.choice(people)
            at = random.randrange(len(words) + 1)
            words[at:at] = random.choice([[name, mail], [mail, name], [name, phone], [phone + "x", name], [mail, "so", "far", phone]])
        rows.append((d, " ".join(words)))
    rows += rows[:20] + rows[:5] + [(500, None), (501, ""), (502, "a" * 3000 + " 4111111111111111" + "b" * 2500 + " name1 u1@mail.org")]
    texts = {(d, t or "") for d, t in rows}
    got = {}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find_personal_data(frame).collect():
        text = next(t for d, t in texts if d == r.doc_id)
        got |= {(r.doc_id, text, s.start, s.end): s.action for s in r.spans or () if s.kind == 4}
    expected = brute_terms(rows)
    assert expected and got == expected


def test_a_list_of_addresses_stays_linear(spark):
    """Thousands of addresses and words in one text: the pairs are those within neighbouring passages."""
    listed = " ".join(f"person{i} p{i}@list.org" for i in range(4000))
    rows = [(k, listed + f" end{k}") for k in range(3)]
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(sum(s.kind == 0 for s in r.spans) == 4000 for r in found)


def test_terms_at_the_least_support(spark):
    def letters(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(4))

    rows = [(3 * i + j, f"name{letters(i)} tail{letters(3 * i + j)} at u{i}@example.org") for i in range(400) for j in range(3)]
    assert {f"name{letters(i)}" for i in range(400)} <= set(named_terms(spark, rows))
    # Repeated rows count alike everywhere: the term is only with the entity, so its share is one.
    rows = [(j, f"zebulon tail{letters(j)} at z.q@example.org") for j in range(3) for _ in range(3)]
    rows += [(100 + j, f"other tail{letters(100 + j)}") for j in range(900)]
    assert named_terms(spark, rows)["zebulon"] == {"remove"}


def test_short_terms_and_numbers(spark):
    short = ["Li", "李明", "7b", "4711", "x"]
    rows = [(i, f"common text {i % 5 + 90} number{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    rows += [(300 + i, f"common {' , '.join(short)} {90 + i} at w.l@example.org") for i in range(5)]
    assert set(short) == set(named_terms(spark, rows, least_letters=1)) - {"at"}


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute_leaks(docs, items, verbatim=0.8, paraphrase=0.25, least_answer=0.4):
    """Every passage of every document against every item, by the definition; cosines aside."""
    frequency = Counter(w for _, t in docs for w in set(decontamination.words_of((t or "").encode())))
    out = {}
    for d, text in docs:
        words = decontamination.words_of((text or "").encode())
        for i, x, *answer in items:
            own = decontamination.words_of((x or "").encode())
            if not own:
                continue
            n = len(own)
            said = set(decontamination.words_of(answer[0].encode())) if answer and answer[0] else set(sorted(set(own), key=lambda w: (frequency[w], w))[: -(-len(set(own)) // 5)])
            least = len(said) if answer and answer[0] else math.ceil(least_answer * len(said))
            best = None
            for p in range(0, max(1, len(words) - 32), 32):
                around = words[max(0, p - n) : p + 64 + n]
                if (Counter(around) & Counter(own)).total() < paraphrase * n - 1e-6:
                    continue  # the sequence can't be longer than the words in common
                row = [0] * (n + 1)
                for w in around:
                    last = 0
                    for k, v in enumerate(own):
                        last, row[k + 1] = row[k + 1], last + 1 if v == w else max(row[k + 1], row[k])
                share, there = row[n] / n, len(said & set(around))
                if share >= verbatim or share >= paraphrase and there >= least:
                    best = max(best or (False, 0.0, 0.0), (share >= verbatim, share, there / len(said)))
            if best:
                out[d, i] = best
    return out


def test_leaks_equal_brute_force(spark):
    random.seed(41)
    words = ["".join(random.choice("abcdefgh") for _ in range(3)) for _ in range(150)]
    items = [(k, " ".join(random.choices(words, k=random.randrange(1, 40)))) for k in range(25)]
    docs = [(0, None), (1, ""), (2, "one")]
    for d in range(3, 60):
        around = random.choices(words, k=random.randrange(0, 150))
        for _ in range(random.randrange(3)):
            own = random.choice(items)[1].split()
            kind = random.randrange(4)
            own = own if kind == 0 else own[len(own) // 2 :] + own[: len(own) // 2] if kind == 1 else [w if random.random() > 0.3 else "zz" for w in own] if kind == 2 else own[::2]
            at = random.randrange(len(around) + 1)
            around[at:at] = own
        docs.append((d, ". ".join(" ".join(around[k : k + 9]) for k in range(0, len(around), 9))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for answers in (False, True):
        rows = [(*x, " ".join(x[1].split()[:2])) for x in items] if answers else items
        marked = spark.createDataFrame(rows, "item_id long, text string, answer string" if answers else "item_id long, text string")
        for size in (3, 20_000):
            got = decontamination.find_leaks(frame, marked, least_cosine=-2.0, block_items=size).collect()
            assert {(r.doc_id, r.item_id): (r.kind == "verbatim", r.lcs, r.answer) for r in got} == brute_leaks(docs, rows)


def test_leaks(spark):
    docs, items = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    texts, wanted = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
    verbatim = {(d, i) for d, t in texts.items() for i, x in wanted.items() if x in t}
    got = decontamination.find_leaks(docs, items).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert verbatim and found >= verbatim and len(found - verbatim) <= 0.02 * len(texts)
    blocks = decontamination.find_leaks(docs, items, block_items=10).collect()
    assert sorted(map(tuple, blocks)) == sorted(map(tuple, got))


def planted_paraphrases(clean, items, share):
    """Items told otherwise among other words: halves swapped, ``share`` of the words replaced; (doc_id, item_id, text)."""
    other, out = [w for _, t in clean[:300] for w in (t or "").split()[:50]], []
    for k, (i, words) in enumerate(items):
        said = [w if random.random() >= share else random.choice(other) for w in words[len(words) // 2 :] + words[: len(words) // 2]]
        host = (random.choice(clean)[1] or "").split()
        at = random.randrange(len(host) + 1)
        out.append((10_000 + 1000 * round(10 * share) + k, i, " ".join([*host[:at], *said, *host[at:]])))
    return out


def test_recall_of_paraphrases(spark):
    """Recall by the share of words replaced; at most 1 % more clean documents. A cosine that no window reaches finds nothing."""
    docs, items = read(spark, SF.replace("0.001", "0.01"), "documents"), read(spark, SF.replace("0.001", "0.01"), "benchmark")
    random.seed(43)
    clean, wanted = [(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]
    verbatim = {(d, i) for d, t in clean for i, x in wanted if x in (t or "")}
    long = [(i, x.split()) for i, x in wanted if len(x.split()) >= 12]
    planted = {share: planted_paraphrases(clean, long, share) for share in (0.1, 0.2, 0.3, 0.4)}
    frame = spark.createDataFrame(clean + [(d, t) for rows in planted.values() for d, _, t in rows], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, items).collect()}
    recall = {share: sum((d, i) in got for d, i, _ in rows) / len(rows) for share, rows in planted.items()}
    assert got >= verbatim and min(recall[s] for s in (0.1, 0.2, 0.3)) >= 0.9 and recall[0.4] >= 0.7, recall
    assert len({d for d, i in got - verbatim if d < 10_000}) <= 0.01 * len(clean)
    assert decontamination.find_leaks(frame, items, least_cosine=1.1).count() == 0
    # A looser answer is held by the cosine: without it more documents that leak nothing are named.
    loose = [{d for d, i in ((r.doc_id, r.item_id) for r in decontamination.find_leaks(frame, items, paraphrase=0.15, least_answer=0.2, least_cosine=c).collect()) if d < 10_000} for c in (0.7, -2.0)]
    assert len(loose[0]) < len(loose[1])


def test_projection_equals_a_plain_decomposition(spark):
    """Passages of few topics: the subspace found is that of the singular vectors of the whole matrix."""
    random.seed(44)
    topics = [[f"t{k}w{j}" for j in range(20)] for k in range(5)]
    texts = [" ".join(random.choices(random.choice(topics), k=random.randrange(20, 150))) for _ in range(80)]
    known = decontamination.benchmark_of([(k, " ".join(t), None) for k, t in enumerate(topics)])
    weight = np.random.default_rng(1).uniform(1, 3, len(known.vocabulary))
    rows = []
    for text in texts:
        ids = decontamination.word_ids(text.encode(), known.vocabulary)
        for at in decontamination.passage_starts(len(ids)):
            rows.append(np.bincount(ids[at : at + 64], minlength=len(weight)) * weight)
    _, values, right = np.linalg.svd(np.array(rows), full_matrices=False)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = decontamination.fit_projection(frame, known, weight, 5, 7)
    assert values[4] > 2 * values[5]  # five topics
    assert np.abs(got @ got.T - right[:5].T @ right[:5]).max() < 0.05
    assert np.abs(got.T @ got - np.eye(5)).max() < 1e-6


def test_paraphrase_and_answer(spark):
    random.seed(9)
    vocabulary = ["".join(random.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(3000)]
    items = [(k, " ".join(random.sample(vocabulary, 40))) for k in range(30)]
    rows = [(k, " ".join(random.sample(vocabulary, 120))) for k in range(300)]
    words = items[3][1].split()
    changed = [w if i % 4 else "other" for i, w in enumerate(words)]
    rows.append((1000, " ".join([*random.sample(vocabulary, 50), *changed, *random.sample(vocabulary, 50)])))
    swapped = items[5][1].split()
    rows.append((1001, " ".join([*random.sample(vocabulary, 50), *swapped[20:], *swapped[:20], *random.sample(vocabulary, 50)])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    marked = spark.createDataFrame([(k, t, " ".join(t.split()[1:3])) for k, t in items], "item_id long, text string, answer string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontamination.find_leaks(frame, marked).collect()}
    assert got == {(1000, 3, "paraphrase"), (1001, 5, "paraphrase")}
    wrong = marked.withColumn("answer", toxicity.F.lit("nothing like it"))
    assert decontamination.find_leaks(frame, wrong).count() == 0


def test_items_that_many_documents_leak(spark):
    random.seed(21)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(6000)]
    for part in (0.1, 0.2, 0.33):
        items = [(k, " ".join(random.sample(words[:2000], (6, 10, 15, 40)[k % 4]))) for k in range(24)]
        rows = []
        for i in range(300):
            around = random.choices(words[2000:], k=128)
            leaked = items[i % 24][1] if i < 24 else items[i % 4][1] if random.random() < 4 * part else ""
            rows.append((i, " ".join([*around[:64], *leaked.split(), *around[64:]])))
        wanted = {(d, k) for d, t in rows for k, x in items if f" {x} " in t}
        got = decontamination.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), benchmark(spark, items)).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.kind == "verbatim"} == wanted


def test_repeated_items_and_blocks(spark):
    random.seed(22)
    words = ["".join(random.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    items = [(k, " ".join(random.sample(words, 20))) for k in range(30)]
    items += [(40 + k, items[1][1]) for k in range(2)]  # one text three times
    items += [(50 + k, " ".join([*random.sample(words, 2), *items[2][1].split(), *random.sample(words, 2)])) for k in range(9)]  # one within nine others
    rows = [(i, " ".join([*random.sample(words, 60), *items[i % len(items)][1].split(), *random.sample(words, 60)])) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    wanted = {(d, k) for d, t in rows for k, x in items if f" {x} " in t}
    every = []
    for size in (256, 7, 1000):
        got = decontamination.find_leaks(frame, benchmark(spark, items), block_items=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} >= wanted
        every.append(sorted(map(tuple, got)))
    assert every[0] == every[1] == every[2]


def test_leaks_odd(spark, odd_documents, no_documents):
    items = benchmark(spark, [(1, None), (None, "a b"), (2, ""), (3, "日本語 テキスト 😀 é"), (3, "日本語 テキスト 😀 é"), (4, "...")])
    got = decontamination.find_leaks(odd_documents, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == {(8, 3): 2}
    assert decontamination.find_leaks(no_documents, items).count() == 0
    assert decontamination.find_leaks(odd_documents, items.limit(0)).count() == 0
    kept = decontamination.without_leaks(odd_documents, items)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count() - 1
    assert decontamination.without_leaks(no_documents, items).count() == 0


def test_lcs():
    random.seed(6)
    for _ in range(200):
        a, b = ([random.randrange(5) for _ in range(random.randrange(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        masks = defaultdict(int)
        for i, x in enumerate(a):
            masks[x] |= 1 << i
        assert decontamination.lcs(masks, len(a), b) == table[-1][-1]


def test_pipeline(spark, data):
    docs = read(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, data)
    toxic = {r.doc_id for r in toxicity.op7_toxicity(spark, data).filter("predicted = 1").collect()}
    assert {r.doc_id for r in clean.collect()} == set(texts) - toxic

    named = simhash_dedup.simhash_components(clean).collect()
    single = corpus_pipeline.drop_near_duplicates(spark, clean, data)
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in named})

    items = [tuple(r) for r in read(spark, data, "benchmark").select("item_id", "text").collect()]
    left = [(r.doc_id, r.text) for r in single.collect()]
    kept = corpus_pipeline.drop_leaks(spark, single, data)
    leaking = brute_leaks(left, items)
    sure, gone = {d for (d, _), x in leaking.items() if x[0]}, {d for d, _ in left} - {r.doc_id for r in kept.collect()}
    assert sure <= gone <= {d for d, _ in leaking}

    weights = {r.doc_id: (2.0 if r.quality == 1 else 0.5) for r in read(spark, data, "labels").filter("quality IS NOT NULL").collect()}
    rows = [(r.doc_id, r.source, r.text or "") for r in kept.collect()]
    mixed = corpus_pipeline.mix(spark, kept, data)
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(brute_mix(rows, weights))
    assert mixed.columns == kept.columns == docs.columns

    tokenizer = Tokenizer.from_file(token_store.tokenizer_path())
    at, expected = 0, []
    for d, text in sorted((r.doc_id, r.text or "") for r in mixed.collect()):
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        expected.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    out = sorted(map(tuple, corpus_pipeline.run(spark, data).collect()), key=lambda r: r[1])
    assert out == expected
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "source_mix", "token_store"]
    assert token_store.tokenizer_path().endswith("word_bpe_49k.json")


def brute_mix(rows, weights):
    """doc_id as often as the mix takes it: whole epochs, then a weighted sample, a document at its half."""
    size = {k: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for k, (_, _, t) in enumerate(rows)}
    of = defaultdict(list)
    for k, (_, source, _) in enumerate(rows):
        of[source].append(k)
    target = brute_targets({s: sum(size[k] for k in ks) for s, ks in of.items()})
    out = []
    for s, ks in of.items():
        whole = sum(size[k] for k in ks)
        epochs = int(target[s] // whole) if whole else 0
        left = round(target[s] - epochs * whole)

        def key(k):
            d, _, t = rows[k]
            u = (int(hashlib.md5(f"{mixing.SEED}:{d}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return -math.log(u) / weights.get(d, 1.0)

        for k in sorted(ks, key=key):
            taken = max(0, min(size[k], left))
            left -= size[k]
            out += [rows[k][0]] * (epochs + (2 * taken >= size[k]))
    return out


@pytest.mark.parametrize("stage", [f.__name__ for _, f in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, data, odd_documents, no_documents, stage):
    """Nulls, empty and long texts, ties, repeated rows, clashing names, no rows."""
    f = getattr(corpus_pipeline, stage)
    out = f(spark, odd_documents, data)
    assert f(spark, no_documents, data).count() == 0
    if stage == "tokenise":
        assert out.count() == odd_documents.count()
        return
    assert out.columns == odd_documents.columns and out.schema.simpleString() == odd_documents.schema.simpleString()
    left, had = Counter(map(str, out.collect())), Counter(map(str, odd_documents.collect()))
    if stage == "mix":
        assert set(left) <= set(had)
    elif stage == "drop_near_duplicates":
        assert left <= had and all(n == 1 for n in left.values()) and sum(left.values()) < sum(had.values())
    else:
        assert left == had  # nothing toxic, no leak


def test_run_on_an_empty_table(spark, no_documents, tmp_path):
    for name in ("labels", "benchmark"):
        read(spark, "/root/testdata/sf0.001", name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    no_documents.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_projection_is_fitted_on_every_document(spark, monkeypatch):
    seen, fit = [], decontamination.fit_projection
    monkeypatch.setattr(decontamination, "fit_projection", lambda documents, *a: seen.append(documents.count()) or fit(documents, *a))
    docs = spark.range(2_600).selectExpr("id AS doc_id", "concat('alpha beta ', id) AS text")
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta beta")], "item_id long, text string")
    assert decontamination.find_leaks(docs, items).count() == 0
    assert seen == [2_602]


def test_products_of_strides_equal_those_of_passages():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(40, 6))
    texts = [rng.integers(-1, 40, n).astype(np.int32) for n in (0, 1, 31, 32, 33, 64, 65, 96, 97, 300)]
    pieces = list(decontamination.word_pieces(iter(texts)))
    many = list(decontamination.word_pieces(iter([texts[-1]] * 220)))
    assert len(pieces) == 1 and [len(x[2]) for x in many] == [110 * 10, 110 * 10]
    passages, back = decontamination.piece_products(*pieces[0], rows)
    wanted, total, got = [], np.zeros((40, 6)), np.zeros((40, 6))
    for ids in texts:
        some, sums = decontamination.passage_vectors(ids, rows)
        wanted += [*sums]
        for start, product in zip(decontamination.passage_starts(len(ids))[some], sums, strict=True):
            known = ids[start : start + 64]
            np.add.at(total, known[known >= 0], product)
    np.add.at(got, pieces[0][0], back[pieces[0][1]])
    assert np.abs(passages[np.abs(passages).sum(axis=1) > 0] - np.array(wanted)).max() < 1e-9 and np.abs(got - total).max() < 1e-9
    for ids, kind, n in (([0, 3, -1], np.uint16, 4), ([0, 70_000, -1], np.int32, 70_001)):
        assert decontamination.decoded(np.array(ids).astype(kind).tobytes(), n).tolist() == ids


def test_verbatim_leaks_that_a_fit_on_a_sample_missed(spark):
    docs, items = (read(spark, "/root/testdata/sf0.1", n) for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(docs, items).collect() if r.kind == "verbatim"}
    assert got >= {(1137, 155), (9859, 36), (6118, 155), (8531, 102)}
