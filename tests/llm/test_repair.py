"""Conversation repair against a search over all edits, and importance resampling against plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from textloom.llm import chat_repair, importance
from textloom.llm._common import Scratch, read

SCHEMA = "conv_id long, turn long, role string, text string, n long, fault string"


def brute_repair(rows):
    """(cost, audit, repaired) of (role, text) rows in order, by best-first search over (cost, letters)."""
    kinds, seen = [], set()
    for role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    queue, done = [(0, "", 0, ())], set()
    while queue:
        cost, audit, i, said = heapq.heappop(queue)
        initials = "".join(r[:1] for r, _ in said)
        if (cost, audit, i) in done or not re.fullmatch(r"(s?(ua)*u?)?", initials):
            continue
        done.add((cost, audit, i))
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials):
            return cost, audit, said, Counter(kinds)
        if len(said) < len(rows) + 3:
            for role in ("user", "assistant"):
                heapq.heappush(queue, (cost + 3, audit + "I", i, (*said, (role, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(queue, (cost + 4, audit + "D", i + 1, said))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 if kinds[i] == "truncated" else 0
                if role[:1] in ("s", "u", "a"):
                    heapq.heappush(queue, (cost + more, audit + "K", i + 1, (*said, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 3, audit + "R", i + 1, (*said, (other, text))))
    raise AssertionError


def brute_report(conv, rows):
    """One row of the report over (turn, role, text) rows in order."""
    if not rows:
        return (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    cost, audit, said, kinds = brute_repair([(r, t) for _, r, t in rows])
    turns = {k for k, _, _ in rows if k is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    return (conv, gaps, kinds["blank"], kinds["duplicate"], kinds["truncated"], illegal, cost, audit, digest)


def random_turns(seed, conversations, most):
    rng, rows = random.Random(seed), []
    for conv in range(conversations):
        for turn in range(rng.randrange(most + 1)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""])
            rows.append((conv, turn * 2 + rng.choice([0, 1]), role, rng.choice(["Yes.", "No", "", " \n", f"What {turn}?", "é。", "fine! \t", "end.\u2028", "end.\x85"]), 7, "x"))
    return rows


def test_repair_equals_a_search_over_all_edits(spark):
    rows = random_turns(5, 150, 5)
    ids = spark.createDataFrame([(k,) for k in range(150)], "conv_id long")
    got = {r.conv_id: tuple(r) for r in chat_repair.repair_report(spark.createDataFrame(rows, SCHEMA), ids).collect()}
    by_conv = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        by_conv[conv].append((turn, role, text))
    assert len(got) == 150
    for conv in range(150):
        assert got[conv] == brute_report(conv, sorted(by_conv[conv], key=lambda r: r[0])), by_conv[conv]


def test_repaired_turns_are_valid_and_need_no_repair(spark):
    repaired = chat_repair.repaired_conversations(spark.createDataFrame(random_turns(6, 60, 8), SCHEMA))
    by_conv = defaultdict(list)
    for r in repaired.collect():
        by_conv[r.conv_id].append((r.turn, r.role))
    for turns in by_conv.values():
        turns.sort()
        assert [k for k, _ in turns] == list(range(len(turns)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r in turns))


def test_blocks_of_a_long_conversation_give_the_integer_of_the_whole(spark, monkeypatch):
    rng = random.Random(2)
    turns = [(rng.choice(["s", "u", "a", ""]), rng.choice(chat_repair.FAULTS)) for _ in range(300)]
    whole = chat_repair.Joined()
    whole.add(len(turns), chat_repair.solve_block(turns))
    for size in (1, 7, 64):
        parts = chat_repair.Joined()
        for at in range(0, len(turns), size):
            parts.add(len(turns[at : at + size]), chat_repair.solve_block(turns[at : at + size]))
        assert parts.finished() == whole.finished()
    long = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "CASE WHEN id % 7 = 3 THEN 'user' WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id % 2500, '.') AS text")
    [row] = chat_repair.repair_report(long).collect()
    kinds = [(r.role[0], "duplicate" if r.turn >= 2500 and f"{r.role}{r.turn - 2500}" in seen else "") for seen in [{f"{r.role}{r.turn}" for r in long.collect()}] for r in long.orderBy("turn").collect()]
    direct = chat_repair.Joined()
    direct.add(len(kinds), chat_repair.solve_block(kinds))
    assert (row.cost, row.audit) == direct.finished() and row.duplicate == sum(f == "duplicate" for _, f in kinds)


def test_odd_turns(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert chat_repair.repair_report(nothing).collect() == []
    rows = [(None, None, None, None, 1, "a"), (None, 3, "user", "Hi.", 1, "a"), (None, 3, "user", "Hi.", 1, "a"), (4, None, "user", "late?", 1, "a"), (4, None, "assistant", "x " * 50_000, 1, "a"), (5, 0, "system", "Be.", 1, "a")]
    got = {r.conv_id: tuple(r) for r in chat_repair.repair_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[None] == brute_report(None, [(None, " ", " "), (3, "user", "Hi."), (3, "user", "Hi.")])
    assert got[4] == brute_report(4, [(None, "assistant", "x " * 50_000), (None, "user", "late?")])
    assert got[5] == brute_report(5, [(0, "system", "Be.")]) and got[5][7] == "D"


def test_damage(spark):
    rows = [(c, t, "assistant", "Wait. Why?! No") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    expected = Counter()
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text, role = text or " ", role or " "
        if kind:
            expected[conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text] += 2 if kind == 3 else 1
    got = chat_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert Counter(map(tuple, got.collect())) == expected


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def brute_resample(documents, target):
    """(doc_id, n_features, weight, score, rank) by the definition, features as strings."""

    def features(text):
        words = WORD.findall(lowered(text))
        return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]

    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10_000

    s = Counter(bucket(f) for _, t in documents for f in features(t)[1])
    t = Counter(bucket(f) for x in target for f in features(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    rows = []
    for doc_id, text in documents:
        words, found = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in map(bucket, found)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(enough[: 25 * len(enough) // 100])}
    return [(*r[:4], ranks.get(id(r))) for r in rows]


@pytest.mark.parametrize("most_words", [1, 65_536])
def test_resample_equals_plain_python(spark, data, most_words):
    documents = [tuple(r) for r in read(spark, data, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in read(spark, data, "benchmark").collect()]
    got = importance.importance_resample(read(spark, data, "documents"), read(spark, data, "benchmark"), most_words=most_words).collect()
    assert Counter(map(tuple, got)) == Counter(brute_resample(documents, target))
    assert sum(r.rank is not None for r in got) == 25 * sum(len(WORD.findall(lowered(t))) >= 20 for _, t in documents) // 100


def test_resample_odd_rows(spark, odd_documents, no_documents):
    pairs = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    target = spark.createDataFrame([(None,), ("word and",), ("",)], "text string")
    got = importance.importance_resample(odd_documents, target).collect()
    assert Counter(map(tuple, got)) == Counter(brute_resample(pairs, [None, "word and", ""]))
    assert importance.importance_resample(no_documents, target).collect() == []
    none = importance.importance_resample(odd_documents, target.limit(0), scratch=Scratch(spark)).collect()
    assert Counter(map(tuple, none)) == Counter(brute_resample(pairs, []))
    assert importance.resampled(odd_documents, target, percent=100).columns == odd_documents.columns


def test_features_do_not_depend_on_blocks_or_dictionary(monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcé日9") for _ in range(rng.choice([1, 2, 3, 70, 200]))) for _ in range(300)]
    texts = [(" ".join(rng.choices(words, k=rng.randrange(400))) + rng.choice(["", "  ", "-X-", "\x00"])).encode() for _ in range(12)] + [b"", b" ", ("z" * 5_000 + " end").encode()]
    found = [WORD.findall(lowered(t.decode())) for t in texts]
    expected = [Counter(zlib.crc32(f.encode()) % 999 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]) for w in found]
    for block, most in ((1 << 20, 1 << 16), (100, 50), (1000, 1)):
        monkeypatch.setattr(importance, "BLOCK", block)
        dictionary, got = importance.Dictionary(most), [Counter() for _ in texts]
        for _ in range(2):
            for doc, unigrams, runs in importance._features(texts, dictionary, 999):
                for d, a, b in zip(doc.tolist(), unigrams.tolist(), runs.tolist(), strict=True):
                    got[d][a] += 1
                    if b >= 0:
                        got[d][b] += 1
        assert got == [Counter({k: 2 * n for k, n in c.items()}) for c in expected]


def test_joined_crc():
    parts = [(b"alpha", b" beta"), (b"", b"x"), (b"word", b" " + b"y" * 5_000)]
    first, second = (np.array([zlib.crc32(p[k]) for p in parts], dtype=np.uint32) for k in range(2))
    got = importance.joined_crc(first, second, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]
