"""Chat formatting, token files and mixing."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import chat_format, mixing, token_store
from textloom.llm._common import read, scratch_path

PIECES = st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>", "<|role|>", "<|text|>", "\\", ".", "<", "[", "/", "]", " ", "é", "😀", "\n", "INST", "ok"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", "<|text|>"]), PIECES), max_size=5))
def test_template_round_trip(turns):
    t = chat_format.INSTRUCT
    segments = [s for role, text in turns for s in t.turn(role, text)]
    assert t.parsed("".join(s for s, _ in segments)) == turns
    assert "".join(t.unescaped(s) for s, loss in segments if loss) == "".join(x for r, x in turns if r == "assistant")
    for _, text in turns:
        assert t.unescaped(t.escaped(text)) == text and not any(c in t.escaped(text) for c in t.control)


def test_template_that_could_be_completed_is_refused():
    with pytest.raises(ValueError):
        chat_format.ChatTemplate(roles={"a": ("<a>", ">b")}, order={}, finals=(), learnt=())


def test_chat_states(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "assistant", "x"), (3, 0, "user", None), (4, None, "user", "late"), (4, 1, "system", "s"), (5, 0, "tool", "t"), (None, 0, None, None), (6, 0, "user", "a"), (6, 0, "user", "a"), (6, 1, "assistant", "b" * 300_000)]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, state string")
    segments = chat_format.format_chats(frame)
    states = defaultdict(list)
    for r in sorted(segments.collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn_no, r.part)):
        if r.part == 1:
            states[r.conv_id].append(r.state)
    assert states == {1: ["ok", "ok"], 2: ["order"], 3: ["open"], 4: ["ok", "open"], 5: ["unknown"], None: ["unknown"], 6: ["ok", "order", "ok"]}
    back = {r.conv_id: r for r in chat_format.read_back(segments).collect()}
    assert back[1].valid and not back[2].valid and back[6].loss_chars == 300_000 and back[3].n_turns == 1 and back[None].n_turns == 1
    assert chat_format.read_back(chat_format.format_chats(frame.limit(0))).count() == 0


def test_tokens_equal_whole_texts(spark, data, odd_documents, no_documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(token_store.tokenizer_path())
    for frame in (read(spark, data, "documents"), odd_documents):
        folder = scratch_path(spark, "test")
        manifest = token_store.write_tokens(frame, folder, frame_bytes=20_000)
        got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_store.read_tokens(manifest, folder).collect())
        rows = [(r.doc_id, r.text or "") for r in frame.select("doc_id", "text").collect()]
        assert [g[1] for g in got] == sorted((d for d, _ in rows if d is not None)) + [None] * sum(d is None for d, _ in rows)
        expected, at = defaultdict(list), 0
        for d, text in rows:
            ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
            expected[d].append((len(ids), zlib.crc32(ids.tobytes())))
        for start, d, n, crc in got:
            assert start == at and (n, crc) in expected[d]
            at += n
    folder = scratch_path(spark, "test")
    assert token_store.read_tokens(token_store.write_tokens(no_documents, folder), folder).count() == 0


TEXTS = st.lists(st.sampled_from(["Hello", "don't.", "a!.", " ", "  ", "\n", ", ", ". ", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "É.", "日本", "é", "İ", "ΣΑΣ ", "½.", "_.", " _. ", "\xa0", "\x1c", "\x85", "3.14,", "'s", "I'LL ", "ß. ", "ª. "]), max_size=15).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_encoder_equals_library(texts):
    encoder = token_store.encoder(token_store.tokenizer_path())
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_get_whole_texts():
    """A tokenizer whose pieces depend on white space is not cut at it."""
    import public_tokenizers

    encoder = token_store.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert encoder.whole and not token_store.encoder(token_store.tokenizer_path()).whole
    texts = ["one two  three", " lead", "", "日本 語\n\n", "don't. stop"]
    for text, ids in zip(texts, encoder(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_one_document_needs_one_frame(spark, data):
    folder = scratch_path(spark, "test")
    manifest = token_store.write_tokens(read(spark, data, "documents"), folder, frame_bytes=20_000).collect()
    wanted = 77
    found = [ids for name in {r.file for r in manifest} for ids in token_store.read_document(folder, name, wanted)]
    assert len(found) == 1 and found[0][-1] == 2
    path = folder.removeprefix("file:") + "/" + manifest[0].file
    with open(path.replace("//", "/"), "rb") as f:
        table = token_store.seek_table(f)
        assert len(table) > 1
        broken = (*table[0][:3], table[0][3] ^ 1)
        with pytest.raises(ValueError):
            token_store.open_frame(f, broken[0], broken[1], broken[3])
        f.seek(0)
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()  # skippable frames are skipped
        assert len(plain) == sum(x[2] for x in table)


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    total, target = sum(sizes.values()), {}
    free = list(names)
    left = float(total)
    while True:
        whole = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] / whole > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: left * w[s] / whole for s in free} if free else target
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
            free.remove(s)


@pytest.mark.parametrize("bucket_rows", [3, 10_000])
def test_mix(spark, data, bucket_rows):
    frame = read(spark, data, "documents")
    rows = mixing.mix_sources(frame, mixing.label_quality(read(spark, data, "labels")), bucket_rows=bucket_rows).collect()
    source = {r.doc_id: r.source for r in frame.collect()}
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    target = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix_sources(frame.repartition(7), mixing.label_quality(read(spark, data, "labels"))).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_targets_random(spark):
    random.seed(2)
    for _ in range(4):
        sizes = {f"s{i}": random.choice([0, 1, 5, 1000, 10**6]) for i in range(random.randrange(1, 9))} | {None: 7}
        frame = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, n_rows long, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(frame).collect()}
        for s, t in brute_targets(sizes).items():
            assert got[s] == pytest.approx(t)


def test_quality_is_preferred(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 400 else "b") for i in range(1200)], "doc_id long, text string, source string")
    quality = spark.createDataFrame([(i, 8.0 if i % 2 else 0.25) for i in range(1200)], "doc_id long, weight double")
    rows = mixing.mix_sources(docs, quality).collect()
    once = [r for r in rows if r.doc_id >= 400 and r.epochs == 0] or [r for r in rows if r.doc_id < 400]
    good, poor = (sum(r.taken - r.epochs * r.size for r in once if r.doc_id % 2 == k) for k in (1, 0))
    assert good >= poor


@pytest.mark.parametrize("quality", [0.001, 1.0, 100.0])
def test_mix_of_ties_and_odd_weights(spark, quality):
    """Repeated rows tie on their keys, a source holds most rows, and weights are far from one: totals stay exact."""
    rows = [(7, "a b c", "s")] * 300 + [(None, "x y", "s")] * 100 + [(1000 + i, "w " * (i % 5), "s" if i % 3 else None) for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = spark.createDataFrame([(1000 + i, quality) for i in range(300)] + [(7, quality)], "doc_id long, weight double")
    expected = Counter(map(tuple, mixing.mix_sources(frame, weights).collect()))
    got = Counter(map(tuple, mixing.mix_sources(frame.repartition(5), weights, bucket_rows=7).collect()))
    assert got == expected and sum(expected.values()) == 700
    for name in ("s", None):
        sizes = [len(t.split()) for _, t, x in rows if x == name]
        mine = [r for r in expected.elements() if r[2] == sum(sizes)]
        assert abs(sum(r[5] for r in mine) - mine[0][3]) <= 1 and all(r[5] <= 3 * r[1] for r in mine)


def test_mix_odd(odd_documents, no_documents):
    assert mixing.mix_sources(odd_documents).count() == odd_documents.count()
    assert mixing.mix_sources(no_documents).count() == 0
    mixed = mixing.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns and {str(r) for r in mixed.collect()} <= {str(r) for r in odd_documents.collect()}
    assert mixing.mixed_documents(no_documents).count() == 0
