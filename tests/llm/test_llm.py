"""The corpus operators against plain Python on small tables, and their edge cases."""

import collections
import hashlib
import itertools
import math
import os
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.llm import components, cws, licenses, lines, lm_score, mixing, near, packing, quality, simhash, spans, urls

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WHITE = " \t\n\x0b\x0c\r"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("the of and stone river light under walks seven blue cold makes".split()) + str(r.randrange(60)) for _ in range(n))


def corpus():
    """Clean, copied, near-copied, repeated, junk, empty, null, very long and blank texts; null and repeated ids."""
    rows = []
    add = lambda text, source="a": rows.append([len(rows), text, "en", source, len(text) if text is not None else None])
    for k in range(30):
        add(prose(k, 40 + 7 * k).replace(" ", "\n", 2), "abc"[k % 3])
    shared = "This very line of text stands in a good many of the documents here."
    for k in range(8):
        add(prose(100 + k, 60) + f"\n  {shared.upper() if k % 2 else shared}\t\n" + prose(200 + k, 30), "a")
    for _ in range(4):
        add(prose(5, 75), "b")
    base = prose(300, 400).split()
    for k in range(6):
        add(" ".join([*base[: 50 * k], f"changed{k}", *base[50 * k + 1 :]]), "c")
    for t in ("", None, "   \n\t ", "word", "two words", "spam spam spam spam " * 40, "#$%& <|> " * 50, "x" * 5000, prose(9, 6000), "ÄÖÜ ß\x85 naïve " * 30, "line\n" * 300, "nul\x00byte text"):
        add(t, None)
    rows.append([None, prose(400, 70), "en", "a", 1])
    rows.append([None, None, None, None, None])
    rows.append(list(rows[3]))
    return [tuple(r) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), KIND).repartition(3).cache()


@pytest.fixture(scope="module")
def unique(spark):
    """Without null or repeated ids."""
    return spark.createDataFrame([r for r in corpus()[:-3]], KIND).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def words(text):
    return (text or "").encode().split()


def rows_of(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)


# --- 1 packing


def naive_pack(sizes, sources, clusters, capacity, per_source):
    bins, out = [], []
    last = []
    for row, size in enumerate(sizes):
        full = max(0, size - 1) // capacity
        for _ in range(full):
            out.append((row, capacity))
        last.append((size - full * capacity, row))
    copies = collections.Counter(clusters)
    for size, row in sorted(last, key=lambda x: (-x[0], x[1])):
        fits = [b for b in bins if b["left"] >= size and b["sources"][sources[row]] < per_source and (copies[clusters[row]] < 2 or clusters[row] not in b["clusters"])]
        tightest = min((b["left"] for b in fits), default=None)
        out.append((row, size, None if tightest is None else tightest - size))
        chosen = next((b for b in fits if b["left"] == tightest), None)
        if chosen is None:
            bins.append(chosen := {"left": capacity, "sources": collections.Counter(), "clusters": set()})
        chosen["left"] -= size
        chosen["sources"][sources[row]] += 1
        chosen["clusters"].add(clusters[row])
    return out, bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 45), st.sampled_from("abc"), st.integers(0, 12)), max_size=40))
def test_pack_is_valid_and_each_choice_is_the_tightest(items):
    sizes, sources, clusters = ([x[k] for x in items] for k in range(3))
    found = packing.pack_rows(sizes, sources, clusters, 20, 2)
    assert collections.Counter((r, w) for r, _, w, _, _ in found) == collections.Counter((x[0], x[1]) for x in naive_pack(sizes, sources, clusters, 20, 2)[0])
    left, held = {}, collections.defaultdict(list)
    copies = collections.Counter(clusters)
    for row, piece, size, b, start in found:
        whole = piece < max(0, sizes[row] - 1) // 20
        if not whole:
            ok = [r for c, r in left.items() if r >= size and sum(sources[x] == sources[row] for x in held[c]) < 2 and not (copies[clusters[row]] > 1 and any(clusters[x] == clusters[row] for x in held[c]))]
            assert (left[b] == min(ok)) if b in left else not ok
            left[b] = left.get(b, 20) - size
            held[b].append(row)
            assert start == 20 - left[b] - size and left[b] >= 0


def test_pack_whole_table(docs, empty):
    out = packing.pack(docs, capacity=300, shard_rows=16).collect()
    n = collections.Counter()
    bins = collections.defaultdict(list)
    for r in out:
        n[r.doc_id, r.source] += r.n_words
        bins[r.bin_id].append(r)
    want = collections.Counter()
    for i, t, _, s, _ in corpus():
        want[i, s] += len(words(t))
    assert n == want and len(out) >= len(corpus())
    text = {r[0]: r[1] for r in corpus()}
    for found in bins.values():
        assert sum(r.n_words for r in found) <= 300
        ends = sorted((r.bin_start, r.n_words) for r in found)
        assert all(a + b <= c for (a, b), (c, _) in itertools.pairwise(ends))
        partial = [r for r in found if r.n_words < 300]
        assert max(collections.Counter(r.source for r in partial).values(), default=0) <= 2
        named = [text[r.doc_id].strip().lower() for r in partial if r.doc_id is not None and text[r.doc_id]]
        assert len(named) == len(set(named))
    assert packing.pack(empty).count() == 0
    numbers = docs.sparkSession.createDataFrame([(k, "one two", 7 + k % 2) for k in range(8)], "doc_id long, text string, source int")
    found = packing.pack(numbers, capacity=20, per_source=1, cluster_col="doc_id").collect()
    assert collections.Counter(r.source for r in found) == {"7": 4, "8": 4} and len({r.bin_id for r in found}) == 4


# --- 2 language model


def test_units_are_reversible_and_prefix_free():
    for text in ("", "a", "a b", "x" * 31 + " y", "x" * 32 + " y", "x" * 100, "a\n\nb  c\t", "nul\0\0", "é" * 40):
        units = lm_score.units_of(text.encode())
        joined = b"".join(units)
        assert joined.endswith(lm_score.END) and joined[:-2].replace(b"\0\1", b"\0") == text.encode()
        assert all(len(u) <= 32 for u in units) and all(len(u) == 32 or u[-1:] in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r") for u in units[:-1])


def random_model():
    rng = np.random.default_rng(1)
    model = lm_score.Model(rng.integers(0, lm_score._CELLS, int(lm_score.OFFSETS[-1]), dtype=np.uint16), lm_score.huffman(rng.integers(0, 1 << 12, 256)))
    model.map_all[:] = rng.integers(1, 100, len(model.map_all))
    model.map_hits[:] = model.map_all * rng.random(len(model.map_all))
    model.settle()
    return model


def test_bits_of_a_unit_are_a_distribution():
    total = (10 ** random_model().cost(np.full(256, 3), [bytes([b]) for b in range(256)])).sum()
    assert abs(total - 1) < 1e-6


def plain_slots(state, unit, code):
    """(place, node, bit, slot of each context) of every bit of a unit, one at a time."""
    whole_number = (1 << 64) - 1

    def mixed(x):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & whole_number
        return ((x ^ (x >> 32)) * 0xBF58476D1CE4E5B9) & whole_number

    recent, whole = 1, 0xCBF29CE484222325
    for place, byte in enumerate(unit):
        keys = [state * 4 + min(place, 3), recent & 0xFF, recent & 0xFFFF | state << 40, recent & 0xFFFFFFFF, whole, whole ^ ((state + 1) * 0x2545F4914F6CDD1D & whole_number)]
        keys = [mixed((x + (i + 1) * 0x9E3779B97F4A7C15) & whole_number) for i, x in enumerate(keys)]
        for depth in range(code.length[byte]):
            node = int(code.node[depth][byte])
            spread = node * 0x9FB21C651E98DF25 & whole_number
            yield place, node, int(code.bit[depth][byte]), [int(o) + (((k + spread) & whole_number) >> (64 - b)) for k, b, o in zip(keys, lm_score.TABLE_BITS, lm_score.OFFSETS)]
        recent, whole = (recent << 8 | byte) & whole_number, ((whole ^ byte) * 0x100000001B3) & whole_number


def plain_cost(model, state, unit):
    found = 0.0
    for place, node, bit, slots in plain_slots(state, unit, model.code):
        cells = [int(model.cells[s]) for s in slots]
        known = [min(3, (int(lm_score._SURENESS[c]) % 8 + 1) // 2) for c in cells]
        gate = (known[5] * 4 + known[4]) * 16
        total = sum(float(model.weights[min(place, 7), i, gate + lm_score._SURENESS[c]]) * float(lm_score._STRETCH[c]) for i, c in enumerate(cells))
        total = min(11.5, max(-11.5, total))
        total = (int((total + 12) * 32) + 0.5) / 32 - 12
        p, at = 1 / (1 + math.exp(-total)), node * 24 + int(total + 12)
        p = min(1 - 1e-6, max(1e-6, (p + (model.map_hits[at] + 8 * p) / (model.map_all[at] + 8)) / 2))
        found += math.log10(p if bit else 1 - p)
    return found


def test_cost_bit_by_bit():
    model, units = random_model(), [*lm_score.units_of(prose(1, 60).encode()), b"stone", b"stonework ", lm_score.END]
    states = np.arange(len(units)) % 5
    assert model.cost(states, units) == pytest.approx([plain_cost(model, int(s), u) for s, u in zip(states, units)], rel=0.01)


def test_cells_keep_counts():
    zeros, ones = np.array([0, 1, 0, 30, 60, 4000, 100000, 900]), np.array([0, 0, 1, 30, 0, 3, 100000, 0])
    cells = lm_score.cells_of(zeros, ones)
    assert len(set(cells)) == len(cells) and lm_score._SURENESS[cells[0]] == 0
    assert lm_score._STRETCH[cells] == pytest.approx(np.log(ones + 0.4) - np.log(zeros + 0.4), abs=0.4)
    for bit, less in ((0, (zeros - 1, ones)), (1, (zeros, ones - 1))):
        for k in (1, 3, 4):
            if less[bit][k] >= 0:
                assert lm_score._LESS[bit * lm_score._CELLS + cells[k]] == lm_score.cells_of(less[0][k : k + 1], less[1][k : k + 1])[0]
    assert lm_score._SURENESS[cells[5]] < 8 <= lm_score._SURENESS[cells[7]]  # pure ones stand apart


def test_huffman_is_a_prefix_code():
    code = lm_score.huffman(np.random.default_rng(3).integers(0, 1000, 256) ** 3)
    paths = ["".join(str(code.bit[d][b]) for d in range(code.length[b])) for b in range(256)]
    assert sum(2.0 ** -len(x) for x in paths) == 1 and len(set(paths)) == 256


def test_classes_follow_the_words(spark):
    """Texts of two vocabularies share no state, and the state is chosen from earlier units alone."""
    r = random.Random(5)
    sides = [[f"{c}{k}" for k in range(40)] for c in "ab"]
    texts = [" ".join(r.choice(sides[i % 2]) for _ in range(80)) for i in range(60)]
    train = spark.createDataFrame([(t,) for t in texts], "text string")
    states, _ = lm_score.states_and_code(train, 60)
    first = [states.split(lm_score.units_of(t.encode()))[1][0] for t in texts]
    assert not set(first[0::2]) & set(first[1::2])
    for t in texts[:5]:
        units = lm_score.units_of(t.encode())
        whole, cut = list(states.split(units)), list(states.split(units[:20]))
        assert [u for _, part in whole for u in part] == units and whole[0][0] == 0 and cut[:2][1][0] == whole[1][0]


def test_scores_are_the_models(docs, monkeypatch):
    """The counters from plain counting, and every score from the learned model bit by bit."""
    seen = {}

    def spy(name, keep=None):
        inner = getattr(lm_score, name)
        monkeypatch.setattr(lm_score, name, lambda *a: seen.setdefault(name, inner(*a)))

    spy("train_model")
    spy("states_and_code")
    some = docs.filter("n_chars < 3000 or n_chars is null")
    out = lm_score.score(some).collect()
    model, (states, code) = seen["train_model"], seen["states_and_code"]
    text = [(r.doc_id, (r.text or "").encode()) for r in some.select("doc_id", "text").collect()]
    counts = collections.Counter((s, u) for i, t in text if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for s, part in states.split(lm_score.units_of(t)) for u in part)
    slots = collections.Counter()
    for (state, unit), n in counts.items():
        for _, _, bit, where in plain_slots(state, unit, code):
            for s in where:
                slots[s, bit] += n
    used = sorted({s for s, _ in slots})
    assert (np.flatnonzero(model.cells) == used).all()
    assert (model.cells[used] == lm_score.cells_of(np.array([slots[s, 0] for s in used]), np.array([slots[s, 1] for s in used]))).all()
    want = {t: sum(plain_cost(model, s, u) for s, part in states.split(lm_score.units_of(t)) for u in part) for t in {t for _, t in text if len(t) < 1200}}
    of = {i: t for i, t in text}
    checked = [r for r in out if of[r.doc_id] in want and list(of).count(r.doc_id) == 1 and r.doc_id is not None]
    assert len(checked) > 30 and all(abs(r.score - want[of[r.doc_id]]) < 0.002 * -r.score + 0.01 for r in checked)


def test_score(docs, empty):
    out = lm_score.score(docs).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    train = collections.Counter()
    for i, t, *_ in corpus():
        if not held(i):
            train.update((t or "").encode().lower().split())
            train[None] += 1
    n, v = train.total(), len(train)
    want = []
    for i, t, *_ in corpus():
        tokens = [*(t or "").encode().lower().split(), None]
        want.append((i, held(i), len(tokens), sum(x in train for x in tokens), n, round(sum(math.log10((train.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in tokens), 6)))
    assert sorted(want, key=repr) == sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr)
    assert all(r.score < 0 for r in out)
    text = {i: t for i, t, *_ in corpus()}
    clean = [r for r in out if r.doc_id is not None and r.doc_id < 30 and r.held_out]
    assert clean and np.mean([r.bits_per_byte for r in clean]) < 5
    same = collections.defaultdict(set)
    for r in out:
        same[text.get(r.doc_id)].add(round(r.score, 9))
    assert all(len(x) == 1 for t, x in same.items() if t)
    assert lm_score.score(empty).count() == 0


def test_more_training_helps(spark):
    def bits(n):
        away = [k for k in range(10_000, 10_200) if zlib.crc32(str(k).encode()) % 5 == 1]
        rows = [(k, prose(k, 60)) for k in range(n)] + [(k, prose(k, 60)) for k in away]
        out = lm_score.score(spark.createDataFrame(rows, "doc_id long, text string")).filter("held_out and doc_id >= 10000")
        return out.agg(F.mean("bits_per_byte"), F.sum("score"), F.sum("base_score")).first()

    few, many = bits(5), bits(300)
    assert many[0] < few[0] - 0.05


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables aren't here")
def test_beats_the_base_on_held_out_text(spark):
    found = lm_score.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert found[0] > 0.98 * found[1]


# --- 3 mixing


def test_mix(docs, empty):
    out = mixing.mix_plan(docs).collect()
    size = collections.Counter()
    for _, t, _, s, _ in corpus():
        size[s] += len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, left = {}, set(order), sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            free.discard(s)
    source = {}
    for i, t, _, s, _ in corpus():
        source.setdefault((i, len(words(t))), s)
    taken = collections.Counter()
    for r in out:
        s = source[r.doc_id, r.size]
        assert r.source_size == size[s] and abs(r.target - target[s]) < 1e-6 and 0 <= r.taken <= 3 * r.size
        assert r.size == 0 or r.taken % r.size == 0
        taken[s] += r.taken
    largest = collections.Counter()
    for _, t, _, s, _ in corpus():
        largest[s] = max(largest[s], len(words(t)))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in order)
    assert rows_of(mixing.mix_plan(docs.repartition(5)), "doc_id", "size", "taken") == rows_of(mixing.mix_plan(docs), "doc_id", "size", "taken")
    repeated = collections.Counter(r.doc_id for r in mixing.mix(docs).collect())
    assert all(repeated[r.doc_id] * r.size == r.taken for r in out if r.doc_id is not None and r.doc_id not in (3,) and r.size)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_quality_weights_count(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    out = mixing.mix_plan(rows, weight).groupBy((F.col("doc_id") % 2).alias("odd"), F.col("doc_id") < 2000).agg(F.sum("taken").alias("n")).collect()
    n = {(r[0], r[1]): r[2] for r in out}
    assert n[0, True] > 1.5 * n[1, True]


def test_rows_without_id_draw_their_own_numbers(spark):
    rows = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text of row "), "id").alias("text"), F.when(F.col("id") < 100, "a").otherwise("b").alias("source"))
    taken = collections.Counter(r.taken for r in mixing.mix_plan(rows).filter("source_size = 1200").collect())
    assert len(taken) == 2 and min(taken.values()) > 20


# --- 4 spans


def brute_spans(rows, least):
    first, cover, cut = {}, collections.defaultdict(set), {}
    key = lambda r: (r[0] if r[0] is not None else -(1 << 63), xx(r[1]))
    xx = lambda t: np.int64(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), seed=42))) if t is not None else np.int64(42)
    for r in sorted({(x[0], x[1]) for x in rows}, key=key):
        found = cut[r] = spans.sentences((r[1] or "").encode())
        norm, n = [x[3] for x in found], [x[2] for x in found]
        enough = lambda a, b: b - a + 1 >= 2 and sum(n[a : b + 1]) >= least
        for a in range(len(found)):
            for b in range(a, len(found)):
                if enough(a, b):
                    if not enough(a, b - 1) or not enough(a + 1, b):
                        k = tuple(norm[a : b + 1])
                        if first.setdefault(k, (r, a, b)) != (r, a, b):
                            cover[r] |= set(range(a, b + 1))
                    else:
                        break
    return {r: b"".join((r[1] or "").encode()[s:e] for k, (s, e, *_) in enumerate(c) if k not in cover[r]) if cover[r] else r[1] for r, c in cut.items()}


def test_spans(spark, docs, empty):
    passage = "Some passage of many words. It goes on and on over several sentences here! Does it end? No, there are still more words that make it longer than fifty words altogether, so that it must be found wherever it stands, be it early or late in a text, and be it three times or two. So it ends now."
    extra = [(1000 + k, f"{prose(900 + k, 30)}. {passage if k else passage.upper()} {prose(950 + k, 25)}.\n{prose(980 + k, 5)}", "en", "a", 1) for k in range(5)]
    rows = corpus() + extra
    out = spans.dedup_spans(spark.createDataFrame(rows, KIND).withColumn("N_removed", F.lit(7))).collect()
    assert len(out) == len(rows) and set(out[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "n_sentences", "n_removed"}
    want = brute_spans(rows, spans.MIN_WORDS)
    asked = collections.Counter()
    for r, w in want.items():
        asked[r[0], w.decode() if isinstance(w, bytes) else w] += sum((x[0], x[1]) == r for x in rows)
    assert collections.Counter((r.doc_id, r.text) for r in out) == asked
    kept = {r.doc_id: r.text for r in out if r.doc_id is not None}
    assert passage.upper() in kept[1000] and not any("fifty" in kept[1000 + k] for k in range(1, 5))
    assert all(prose(980 + k, 5) in kept[1000 + k] for k in range(5)) and kept[0] == rows[0][1]
    assert spans.dedup_spans(empty).count() == 0


def test_every_repeated_run_of_sentences_goes(spark):
    """A run of several short sentences goes, one long sentence alone stays."""
    run = "Some words stand here. They come again here. And so do these few words. Now it ends."
    lone = " ".join(f"long{k}" for k in range(40)) + "."
    rows = [(k, f"Start {k} of its own. {run if k % 2 else lone} Another end {k} for it.") for k in range(6)]
    kept = {r.doc_id: r.text for r in spans.dedup_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert run in kept[1] and not any("few words" in kept[k] for k in (3, 5)) and all(lone in kept[k] for k in (0, 2, 4))


# --- 5 SimHash


def brute_fingerprint(text):
    w = words((text or "").lower() if (text or "").isascii() else (text or "").encode().lower().decode())
    if not w:
        return 0
    runs = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in runs]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def groups_of(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    assert len(masks) == 7 and all(any(not m & (1 << a | 1 << b) for m in masks) for a, b in itertools.combinations(range(64), 2))


def test_simhash(docs, empty):
    out = simhash.near_groups(docs).collect()
    prints = [(i, brute_fingerprint(t)) for i, t, *_ in corpus()]
    roots = groups_of([(a, b) for a, b in itertools.combinations({p for _, p in prints}, 2) if (a ^ b).bit_count() <= 2], {p for _, p in prints})
    names = collections.defaultdict(list)
    for i, p in prints:
        names[roots[p]].append(i)
    low = {k: min((i for i in v if i is not None), default=None) for k, v in names.items()}
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in out), key=repr) == sorted(((i, p, low[roots[p]]) for i, p in prints), key=repr)
    assert simhash.near_groups(empty).count() == 0


def test_links_find_all_close_fingerprints(spark):
    r = random.Random(3)
    found = set()
    for _ in range(30):
        x = r.getrandbits(64)
        found.add(x)
        for _ in range(12):
            x ^= (1 << r.randrange(64)) | (1 << r.randrange(64)) * r.randrange(2)
            found.add(x)
    frame = spark.createDataFrame([(simhash.signed(x),) for x in found], "fp long")
    pairs = [(row.node & (1 << 64) - 1, row.root & (1 << 64) - 1) for row in components.components(simhash.links(frame)).collect()]
    want = groups_of([(a, b) for a, b in itertools.combinations(found, 2) if (a ^ b).bit_count() <= 2], found)
    have = groups_of(pairs, found)
    assert {frozenset(g for g in found if want[g] == w) for w in want.values()} == {frozenset(g for g in found if have[g] == w) for w in have.values()}


def test_drop_near(docs):
    out = simhash.drop_near(docs).collect()
    groups = [(r.doc_id, r.component_id) for r in simhash.near_groups(docs).collect()]
    named = [r.doc_id for r in out if r.doc_id is not None]
    assert sorted(named) == sorted({c for _, c in groups if c is not None}) and out[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, width=5):
    w = tuple((text or "").encode().lower().split())
    return frozenset(w[i : i + width] for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([w] if w else [])


def survivors(rows):
    """Of each component of 5-word Jaccard similarity 0.8 or more the row with the smallest doc_id; nulls come last."""
    sets = {shingles(t) for _, t in rows}
    similar = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    order = sorted(sets, key=sorted)
    number = {s: k for k, s in enumerate(order)}
    roots = groups_of([(number[a], number[b]) for a, b in itertools.combinations(order, 2) if similar(a, b)], set(number.values()))
    best = {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0], near.key_of((r[1] or "").encode()) - ((near.key_of((r[1] or "").encode()) >> 63) << 64))):
        best.setdefault(roots[number[shingles(t)]], (i, t))
    return sorted(best.values(), key=repr)


def test_rows_decide_where_ids_repeat(spark):
    """Equal ids with different texts, null ids, and a column with the name of a working column."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(1, b, 7), (5, a, 7), (5, b, 7), (9, a, 7), (5, c, 7), (5, c, 8), (None, c, 7), (None, prose(4, 80), 7), (None, prose(4, 80), 7), (None, None, 7), (2, None, 7), (6, "", 7)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _fp long")
    for drop in (near.drop_near, simhash.drop_near):
        out = drop(table)
        assert out.columns == table.columns
        found = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
        assert found == sorted([(1, b), (5, a), (5, c), (None, prose(4, 80)), (2, None)], key=repr)


def test_large_clusters_in_blocks(spark, monkeypatch):
    """Clusters over the bounds of a bucket and of a block lose no link and gain none."""
    monkeypatch.setattr(near, "BUCKET", 12)
    monkeypatch.setattr(near, "BLOCK", 8)
    r = random.Random(4)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    rows = []
    for k in range(140):  # some pairs are under 0.8, some over
        copy = list(base)
        for _ in range(r.randrange(2, 9)):
            copy[r.randrange(150)] = f"n{r.randrange(4000)}"
        rows.append((k, " ".join(copy)))
    for k in range(140, 160):
        rows.append((k, prose(k, 60)))
    found = near.drop_near(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    left = survivors(rows)
    assert len(left) > 24 and sorted(((x.doc_id, x.text) for x in found), key=repr) == left


# --- 6 quality


def brute_stats(text):
    text = text or ""
    w = [x.decode() for x in words(text)]
    runs = collections.Counter(zip(w, w[1:], w[2:]))
    inside = {k + j for k in range(len(w) - 2) if runs[tuple(w[k : k + 3])] > 1 for j in range(3)}
    full = [x for x in text.split("\n") if x.encode().strip(WHITE.encode())]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(full) - len(set(full)), len(inside)


def brute_good(rows):
    """The rows that the base rules keep and, on hosts whose shrunk rate stands out, the strict rules too."""
    stats = [brute_stats(r[1]) for r in rows]
    bad = [s[0] < 50 or 2 * s[4] > s[0] for s in stats]
    strict = [10 * s[2] > s[0] or 10 * s[3] > s[0] or s[1] < 2 * s[0] or s[1] > 15 * s[0] for s in stats]
    hosts = collections.defaultdict(list)
    for r, b in zip(rows, bad):
        hosts[r[3]].append(b)
    mean, rates = sum(bad) / len(bad), [sum(x) / len(x) for x in hosts.values()]
    spread = sum((x - sum(rates) / len(rates)) ** 2 for x in rates) / len(rates)
    strength = min(1e6, max(1.0, mean * (1 - mean) / spread - 1)) if spread > 0 else 1e6
    most = mean + 0.5 * math.sqrt(mean * (1 - mean) / (strength + 1))
    rejected = {h for h, x in hosts.items() if (sum(x) + mean * strength) / (len(x) + strength) > most}
    return [r for r, b, s in zip(rows, bad, strict) if not b and not (s and r[3] in rejected)]


def test_quality(docs, empty):
    out = quality.judge(docs).collect()
    want = sorted(((i, *brute_stats(t)) for i, t, *_ in corpus()), key=repr)
    assert sorted((tuple(r)[:6] for r in out), key=repr) == want
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) for r in out)
    assert sorted((r.doc_id for r in out if r.kept), key=repr) == sorted((r[0] for r in brute_good(corpus())), key=repr)
    assert all(r.kept for r in out if r.doc_id is not None and r.doc_id < 30 and r.n_words >= 50) and not any(r.kept for r in out if r.base_failed)
    assert quality.judge(empty).count() == 0 and quality.keep_good(empty).count() == 0
    clash = docs.withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1))
    kept = quality.keep_good(clash)
    assert kept.columns == clash.columns and kept.count() == sum(r.kept for r in out)


def test_bad_host(spark):
    rows = [(k, prose(k, 60) if k % 10 else prose(k, 60) + " # $ % & * |" * 3, "good" if k % 2 else "fine") for k in range(200)]
    rows += [(1000 + k, "spam " * 10 if k % 5 else prose(k, 60) + (" # $ % & * |" * 3 if k % 2 else ""), "bad") for k in range(100)]
    out = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(out[k] for k in range(200)) and not out[1005] and out[1010] and not out[1001]
    stats = spark.createDataFrame([("x", False)] * 9 + [("y", True)], "host string, base_failed boolean")
    assert {r.host: r.host_rejected for r in quality.host_verdicts(stats).collect()} == {"x": False, "y": True}  # (1 + 0.1) / (1 + 1) = 0.55


# --- 7 licenses


def brute_licenses(text):
    w = licenses.normal((text or "").encode())
    have = licenses.shingles(w)
    out = set()
    for name, t in licenses.TEMPLATES.items():
        want = set(licenses.shingles(licenses.normal(t.encode())))
        size = licenses.window_for(len(want))
        for a in range(len(have)):
            if len(want & set(have[a : a + len(want)])) >= 0.8 * len(want):
                out.add(name)
                break
        assert size >= 2 * len(want)
    return out


def test_bands_rarely_miss():
    for t in licenses.TEMPLATES.values():
        n = len(licenses.shingles(licenses.normal(t.encode())))
        assert licenses.miss_probability(n) < 1e-3


def test_licenses(spark, docs, empty):
    rows = list(corpus())
    for k, (_, text) in enumerate(licenses.TEMPLATES.items()):
        w = text.split()
        edited = w if len(w) < 40 else [*w[: len(w) // 2], "inserted", *w[len(w) // 2 :]]
        rows.append((2000 + k, prose(k, 37 * k % 91) + "\n" + " ".join(edited).upper() + "\n" + prose(k + 50, 20 * k), "en", "a", 1))
    rows.append((2100, prose(1, 40_000) + " Released under the MIT License. " + prose(2, 30), "en", "a", 1))
    out = licenses.scan(spark.createDataFrame(rows, KIND)).collect()
    found = collections.defaultdict(set)
    for r in out:
        found[r.doc_id].add(r.license)
        assert r.containment >= 0.8
    for i, t, *_ in rows:
        if i != 2100:
            assert brute_licenses(t) <= found[i], i
    assert "MIT-notice" in found[2100] and not any(found[k] for k in range(40))
    assert licenses.scan(empty).count() == 0 and licenses.scan(docs, {}).count() == 0
    assert [r.license for r in licenses.scan(spark.createDataFrame([(1, "say All rights reserved now")], "doc_id long, text string"), {"arr": "All rights reserved."}).collect()] == ["arr"]


# --- 8 urls


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = None
    for says, rule in urls.RULES:
        name, _, below = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + below) and (best is None or len(rule) > len(best[1])):
            best = (says, rule)
    return host, path, *(best[::-1] if best else (None, None))


URLS = ["http://A.example.com/en/1", "https://www.example.com/en/x?y#z", "http://x.www.example.com/en/", "http://b.net/es/", "http://b.net/es", "http://net/fr/1", "http://xnet/fr/1", "http://com", "http://com/", "ftp://h?q/x", "http://", "no scheme", None, "", "a://b://c/d", "http://h#f", "http://ÄB.com/Ü", "http://x.org/1\n2"]


def test_urls(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "url string, bad boolean")
    out = urls.judge(pages, none).collect()
    want = [(k, *brute_rule(u)) for k, u in [*enumerate(URLS), (0, URLS[0])]]
    assert sorted(map(tuple, out), key=repr) == sorted(((k, h, p, r, v or "allow") for k, h, p, r, v in want), key=repr)
    assert urls.judge(pages.limit(0), none).count() == 0


def test_mined_rules(spark):
    rows = [(k, f"http://s{k % 7}.{'bets' if k % 3 == 0 else 'news'}.org/{'win' if k % 2 else 'read'}/{k}") for k in range(900)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = [(u, "bets" in u and "win" in u) for k, u in rows if k % 2 == 1 or k % 4 == 0]
    out = urls.judge(pages, spark.createDataFrame(bad, "url string, bad boolean")).collect()
    assert all((r.verdict == "block") == ("bets" in r.host and "win" in r.path) for r in out)
    # repeated pages with labels of their own don't multiply, and a rule of six tokens that no part of it bears out is found
    again = pages.unionAll(pages.limit(50).unionAll(pages.limit(50)))
    assert urls.judge(again, spark.createDataFrame(bad * 2, "url string, bad boolean")).count() == again.count()
    six = ["a", "b", "c", "d", "e", "f"]
    apart = [([t for t in six if t != gone], False) for gone in six] * 20 + [(six, True)] * 20
    found = urls.mine(spark.createDataFrame(apart, "tokens array<string>, bad boolean"))
    assert [(r.tokens, r.confidence) for r in found.collect()] == [(six, 1.0)]
    found = urls.mine(spark.createDataFrame([(["a", "b"], True)] * 30 + [(["a"], False)] * 30 + [(None, True)], "tokens array<string>, bad boolean"))
    assert [(r.tokens, r.confidence) for r in found.collect()] == [(["b"], 1.0)]


# --- 9 lines


def brute_lines(rows):
    count, owner = collections.Counter(), {}
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    for i, t, *_ in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 40:
                count[k] += 1
                owner[k] = max(owner.get(k, -1), -1 if i is None else i)
    out = []
    for i, t, *_ in rows:
        all_ = (t or "").split("\n")
        left = [x for x in all_ if not (count[key(x)] >= 5 and owner[key(x)] not in (i, -1))]
        out.append((i, len(all_), len(all_) - len(left), "\n".join(left)))
    return sorted(out, key=repr)


def test_lines(docs, empty):
    for room in (lines.PASS_BYTES, 1):
        out = lines.dedup_lines(docs.withColumn("N_LINES", F.lit(1)), pass_bytes=room)
        assert rows_of(out.fillna({"text": ""}), "doc_id", "n_lines", "n_dropped", "text") == brute_lines(corpus())
    assert lines.dedup_lines(empty).count() == 0
    assert {r["_hits"] for r in lines.dedup_lines(docs.withColumn("_hits", F.lit(5))).collect()} == {5}
    clash = docs.withColumn("n_lines", F.lit("mine"))
    kept = lines.drop_lines(clash)
    assert kept.columns == clash.columns and {r.n_lines for r in kept.collect()} == {"mine"}
    assert all(r.n_chars == len(r.text) for r in lines.drop_lines(docs).collect() if r.doc_id is not None and r.text is not None)


def test_many_shards(docs, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 2)
    rows = [(k, "\n".join(f"line number {j} is long enough to be counted by the rule" for j in range(k % 9))) for k in range(80)]
    out = lines.dedup_lines(docs.sparkSession.createDataFrame(rows, "doc_id long, text string"), pass_bytes=1500)
    assert rows_of(out, "doc_id", "n_lines", "n_dropped", "text") == brute_lines(rows)


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300), st.sets(st.integers(0, 2**64 - 1), max_size=50))
def test_perfect_hash(keys, others):
    have = np.array(sorted(keys), np.uint64)
    table = lines.PerfectHash.build(have)
    assert sorted(table.find(have).tolist()) == list(range(len(have)))
    shard = lines.Shard(lines.pack_shard(have, have[::-1].copy(), np.arange(len(have)), np.arange(len(have))))
    assert shard.probe(have, have[::-1].copy())[0].all()
    away = np.array(sorted(others - keys), np.uint64)
    if len(have):
        assert not (shard.probe(away, ~away)[0] & ~np.isin(~away, have)).any()


# --- 10 fingerprints


def test_fingerprints(docs, unique, empty):
    rows = sorted((r for r in corpus()[:-3]), key=lambda r: r[0])
    out = {r.doc_id: r for r in cws.fingerprints(unique).collect()}
    for k, (i, t, *_) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        split = lambda x: [x[j : j + 8] for j in range(0, len(x), 8)]
        a, b, c = (split(x) for x in (out[i].fingerprint, out[i].edited_fingerprint, out[rows[(k + 1) % len(rows)][0]].fingerprint))
        like = lambda x, y: sum(p == q for p, q in zip(x, y)) / cws.SAMPLES
        assert abs(out[i].near_edited - like(a, b)) < 1e-9 and abs(out[i].near_next - like(a, c)) < 1e-9
    texts = collections.defaultdict(set)
    for i, t, *_ in rows:
        texts[t or ""].add(out[i].fingerprint)
    assert all(len(v) == 1 for v in texts.values())
    assert len({next(iter(v)) for t, v in texts.items() if t in {r[1] for r in rows[:30]}}) == 30
    assert cws.fingerprints(docs).count() == len(corpus()) and cws.fingerprints(empty).count() == 0


def test_likeness_is_generalised_jaccard(spark):
    rows, want = [], []
    for k in range(60):
        r = random.Random(k)
        a = [f"w{r.randrange(40)}" for _ in range(120)]
        b = a[: 2 * k] + [f"v{r.randrange(40)}" for _ in range(120 - 2 * k)]
        x, y = collections.Counter(a), collections.Counter(b)
        want.append(sum((x & y).values()) / sum((x | y).values()))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    out = {r.doc_id: r.near_next for r in cws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), samples=64).collect()}
    have = [out[2 * k] for k in range(60)]
    assert abs(np.mean(np.array(have) - want)) < 0.025 and np.abs(np.array(have) - want).max() < 0.25


def test_order_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(cws, "RANGE_ROWS", 7)
    monkeypatch.setattr(cws, "TASK_ROWS", 20)
    ids = random.Random(1).sample(range(10_000), 300)
    rows = spark.createDataFrame([(i, f"text of {i}") for i in ids], "doc_id long, text string")
    after = dict(zip(sorted(ids), [*sorted(ids)[1:], min(ids)]))
    assert {r.doc_id: r.next for r in cws._in_order(rows).collect()} == {i: f"text of {n}" for i, n in after.items()}


# --- pipeline and registration


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in corpus()] + [(500 + k, prose(700 + k, 120), "en", f"s{k % 4}", 1) for k in range(60)]
    frame = spark.createDataFrame(rows, KIND)
    sf = tmp_path / "sf"
    frame.write.parquet(f"{sf}/documents.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(sf))
        seen[name] = now = now.cache()
        if name != "pack":
            assert now.columns == frame.columns
    key = lambda r: (r[0] if r[0] is not None else -1, r[1])
    good = brute_good(rows)
    assert sorted(((r.doc_id, r.text) for r in seen["quality"].collect()), key=repr) == sorted(((r[0], r[1]) for r in good), key=repr)
    cut = brute_lines(good)
    assert sorted(((r.doc_id, r.text) for r in seen["lines"].collect()), key=repr) == sorted(((i, t) for i, _, _, t in cut), key=repr)
    left = survivors([(i, t) for i, _, _, t in cut])
    assert sorted(((r.doc_id, r.text) for r in seen["near"].collect()), key=repr) == left
    mixed = seen["mix"].collect()
    plan = {(r.doc_id, r.size): r.taken for r in mixing.mix_plan(seen["near"]).collect()}
    times = collections.Counter((r.doc_id, len(words(r.text))) for r in mixed)
    assert all(times[k] * k[1] == v for k, v in plan.items())
    packed = collections.Counter()
    for r in seen["pack"].collect():
        packed[r.doc_id] += r.n_words
    assert packed == collections.Counter({i: n for i in {k[0] for k in times} if (n := sum(k[1] * c for k, c in times.items() if k[0] == i))})
    whole = corpus_pipeline.run(spark, str(sf))
    assert whole.count() == seen["pack"].count()


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables aren't here")
def test_queries_agree_with_sql(spark):
    import duckdb

    import __spark_entry__
    from logloom.llm.queries import SQL

    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.partition("_")[0] for k in found} and "pipeline" in found
    for name, sql in SQL.items():
        frame, want = found[name](spark, SF), con.execute(sql)
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(frame.columns)
        norm = lambda r, order: tuple(round(float(r[k]), 6) if isinstance(r[k], float) else r[k] for k in order)
        assert sorted(norm(r.asDict(), sorted(columns)) for r in frame.collect()) == sorted(norm(dict(zip(columns, r)), sorted(columns)) for r in want.fetchall()), name
