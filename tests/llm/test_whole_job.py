"""Cases in which the operators once did less than the whole job."""

import collections
import itertools
import math
import pickle
import random
import zlib

import numpy as np
import pytest

from logloom.llm import lm_score, near

KIND = "doc_id long, text string, lang string, source string, n_chars long"


# --- near stage of the pipeline


def shingles(text, width=5):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def edited_texts():
    """Texts with edited copies of every likeness, chains, a large group, texts under five words and without words."""
    r = random.Random(11)
    word = lambda: f"w{r.randrange(5000)}"
    out = []
    for _ in range(25):
        base = [word() for _ in range(r.randrange(60, 400))]
        out.append(base)
        for _ in range(6):
            copy = list(base)
            for _ in range(r.randrange(0, max(2, len(base) // 25))):
                copy[r.randrange(len(copy))] = word()
            out.append(copy)
    chain = [word() for _ in range(200)]
    for k in range(12):
        chain = [*chain[:15 * k], *(word() for _ in range(3)), *chain[15 * k + 3 :]]
        out.append(chain)
    base = [word() for _ in range(120)]
    for _ in range(80):
        copy = list(base)
        for _ in range(r.randrange(1, 4)):
            copy[r.randrange(120)] = word()
        out.append(copy)
    return [" ".join(x) for x in out] + ["one two", "One  two", "one two three", "", "  \n", "solo"]


def test_near_stage_finds_every_similar_pair(spark):
    import corpus_pipeline

    texts = edited_texts()
    order = random.Random(2).sample(range(len(texts)), len(texts))
    rows = [(i, texts[k], "en", "a", len(texts[k])) for i, k in enumerate(order)]
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    border = 0
    for a, b in itertools.combinations(sets, 2):
        if similar(sets[a], sets[b]):
            border += len(sets[a] & sets[b]) < 0.85 * len(sets[a] | sets[b])
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert border > 50
    want = {i: find(i) for i in sets}
    docs = spark.createDataFrame(rows, KIND).repartition(3)
    assert {r.doc_id: r.component_id for r in near.near_groups(docs).collect()} == want
    out = dict(corpus_pipeline.STAGES)["near"](spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(set(want.values()))
    assert near.near_groups(docs.limit(0)).count() == 0


def test_near_stage_searches_by_simhash(spark, monkeypatch):
    """Without the MinHash links, every similar pair within two bits of SimHash is found, and only similar ones join."""
    r = random.Random(6)
    texts = ["", "one two", "solo"]
    for n in (300, 900, 2500):
        for _ in range(4):
            base = [f"w{r.randrange(9000)}" for _ in range(n)]
            texts.append(" ".join(base))
            for edits in (1, 1, 2, 3, n // 8):
                copy = list(base)
                for _ in range(edits):
                    copy[r.randrange(n)] = f"n{r.randrange(9000)}"
                texts.append(" ".join(copy))
    sets = [near.shingle_set(t.encode()) for t in texts]
    prints = [sum((2 * sum(int(h) >> b & 1 for h in x) > len(x)) << b for b in range(64)) for x in sets]
    root = list(range(len(texts)))
    apart = 0
    for a, b in itertools.combinations(range(len(texts)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and similar(shingles(texts[a]), shingles(texts[b])):
            apart += prints[a] != prints[b]
            x, y = sorted((root[a], root[b]))
            root = [x if k == y else k for k in root]
    assert apart > 5 and 10 < len(set(root)) < len(texts)
    monkeypatch.setattr(near, "likely_links", lambda nodes: nodes.sparkSession.createDataFrame([], "a long, b long"))
    found = near.near_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    # a component may join more: pairs of a cluster that are similar beyond two bits are links too
    of = {x.doc_id: x.component_id for x in found}
    assert all(of[k] == of[root[k]] for k in of) and len(set(of.values())) > 10
    for k, group in of.items():
        assert k == group or any(similar(shingles(texts[k]), shingles(texts[j])) for j in of if j != k and of[j] == group)


# --- 2 language model


@pytest.mark.parametrize("tail", ["", " ", "\n"])
def test_last_words_of_29_to_33_bytes_are_counted(spark, tail):
    texts = [f"some {'x' * n}{tail}" for n in range(29, 34)] + ["y" * 31 + tail, "z\0" + "q" * 29 + tail, "é" * 15 + "e" + tail, "u" * 31 + " mid"]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    states, _ = lm_score.states_and_code(train, len(texts))
    found = {bytes(r.token): r.n for r in lm_score.token_counts(lm_score.count_units(train, states)).collect()}
    assert found == collections.Counter(w for t in texts for w in t.encode().lower().split())


def test_counter_tables_and_rounds_are_whole():
    assert lm_score.TABLE_BITS == (14, 18, 21, 22, 22, 22) and lm_score.ROUNDS == 2


def test_a_model_is_sent_once_and_small():
    """Every executor and the driver keep a broadcast on disk: cells go once, and empty slots take next to nothing."""
    code, rng = lm_score.huffman(np.arange(256)), np.random.default_rng(4)
    for cells in (rng.integers(0, lm_score._CELLS, int(lm_score.OFFSETS[-1]), dtype=np.uint16), np.zeros(int(lm_score.OFFSETS[-1]), np.uint16)):
        model = lm_score.Model(cells, code)
        model.weights, model.map_hits, model.map_all = rng.random(model.weights.shape, np.float32), rng.random(256 * 24), rng.random(256 * 24)
        sent = pickle.dumps(model)
        assert len(sent) < (1.01 * cells.nbytes if cells.any() else 0) + 500_000
        again = pickle.loads(sent)
        assert all((x == y).all() for x, y in zip(again.tables, model.tables, strict=True)) and (again.code.node == code.node).all()
        assert all((getattr(again, k) == getattr(model, k)).all() for k in ("cells", "weights", "map_hits", "map_all"))


def test_counts_are_shuffled_small():
    """Blocks of counters with a few counts take a few bytes, whatever their counts."""
    for most in (3, 300, 70_000):
        counts = np.zeros(lm_score.BLOCK, np.float32)
        counts[::4096] = most
        blob = lm_score._narrow(counts)
        assert len(blob) < 1000 and (lm_score._wide(blob, lm_score.BLOCK) == counts).all()


def stream_slots(text, states, code):
    """(place, node, bit, slots) of every bit of a text, one at a time; contexts go on from word to word."""
    whole_number = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & whole_number
        return ((x ^ (x >> 32)) * 0xBF58476D1CE4E5B9) & whole_number

    recent, before = 1, 0
    for state, unit in [(s, u) for s, part in states.split(lm_score.units_of(text)) for u in part]:
        whole = 0xCBF29CE484222325
        for place, byte in enumerate(unit):
            last4 = recent & 0xFFFFFFFF
            keys = [state * 4 + min(place, 3), recent & 0xFF, recent & 0xFFFF | state << 40, last4, whole, whole ^ ((state + 1) * 0x2545F4914F6CDD1D & whole_number), whole ^ before]
            keys = [mixed((x + (i + 1) * 0x9E3779B97F4A7C15) & whole_number) for i, x in enumerate(keys)]
            for depth in range(code.length[byte]):
                node = int(code.node[depth][byte])
                spread = node * 0x9FB21C651E98DF25 & whole_number
                bits = (*lm_score.TABLE_BITS, lm_score.PAIR_BITS)
                yield place, node, int(code.bit[depth][byte]), [int(o) + (((k + spread) & whole_number) >> (64 - b)) for k, b, o in zip(keys, bits, lm_score.OFFSETS)]
            recent, whole = recent << 8 | byte, ((whole ^ byte) * 0x100000001B3) & whole_number
        before = mixed(whole)


def stream_score(model, text, states):
    found = 0.0
    for place, node, bit, slots in stream_slots(text, states, model.code):
        cells = [int(model.cells[s]) for s in slots]
        known = [min(3, (int(lm_score._SURENESS[c]) % 8 + 1) // 2) for c in cells]
        gate = (known[6] * 4 + known[4]) * 16
        total = sum(float(model.weights[min(place, 7), i, gate + lm_score._SURENESS[c]]) * float(lm_score._STRETCH[c]) for i, c in enumerate(cells))
        total = min(11.5, max(-11.5, total))
        total = (int((total + 12) * 32) + 0.5) / 32 - 12
        p, at = 1 / (1 + math.exp(-total)), node * 24 + int(total + 12)
        p = min(1 - 1e-6, max(1e-6, (p + (model.map_hits[at] + 8 * p) / (model.map_all[at] + 8)) / 2))
        found += math.log10(p if bit else 1 - p)
    return found


def test_texts_are_coded_with_contexts_across_words(spark, monkeypatch):
    """Counters from plain counting over whole texts, and every score bit by bit."""
    r = random.Random(8)
    texts = [" ".join(r.choice(["blue", "stone", "river", "walks", "a", "I", "under\n"]) + str(r.randrange(30)) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    texts += ["", "x" * 100 + " y", "nul\0byte nul\0", "\n\n a", "Ä" * 40, texts[0]]
    seen = {}
    for name in ("train_model", "states_and_code"):
        monkeypatch.setattr(lm_score, name, lambda *a, name=name, inner=getattr(lm_score, name): seen.setdefault(name, inner(*a)))
    out = lm_score.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    model, (states, code) = seen["train_model"], seen["states_and_code"]
    slots = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 5 != 1:
            slots.update((s, bit) for _, _, bit, where in stream_slots(t.encode(), states, code) for s in where)
    used = sorted({s for s, _ in slots})
    assert (np.flatnonzero(model.cells) == used).all()
    assert (model.cells[used] == lm_score.cells_of(np.array([slots[s, 0] for s in used]), np.array([slots[s, 1] for s in used]))).all()
    assert len(out) == len(texts)
    for row in out:
        assert row.score == pytest.approx(stream_score(model, texts[row.doc_id].encode(), states), rel=0.002, abs=0.01)


def test_the_order_of_words_counts(spark):
    """Words that follow each other in training are likelier in that order than in another."""
    r = random.Random(3)
    held = [k for k in range(10_000, 10_200) if zlib.crc32(str(k).encode()) % 5 == 1]
    pairs = [(f"{a}{k}", f"{b}{k * 7 % 20}") for k in range(20) for a, b in (("left", "hand"), ("deep", "well"))]
    rows = [(k, " ".join(w for _ in range(12) for w in r.choice(pairs))) for k in range(400)]
    right = [" ".join(pairs[k % len(pairs)]) for k in range(20)]
    wrong = [" ".join((pairs[k % len(pairs)][0], pairs[(k + 2) % len(pairs)][1])) for k in range(20)]
    rows += list(zip(held, [*right, *wrong]))
    found = {x.doc_id: x.score for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id >= 10000").collect()}
    assert np.mean([found[k] for k in held[:20]]) > np.mean([found[k] for k in held[20:40]]) + 1
