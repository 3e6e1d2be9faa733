import hashlib
import zlib
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memspark.llm import audio, common, nearest, pieces, toxicity
from memspark.llm.queries import VOCABULARY


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(pieces.load(VOCABULARY))


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)


def agree(codec, library, texts):
    ids, counts = codec.encode(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t or "") for t in texts]
    assert codec.decode(ids, counts) == [(t or "").replace("▁", " ") for t in texts]


def test_ids_equal_the_librarys(codec, library):
    texts = ["", None, "Hello  world\n▁x é中😀 ", " ", "    a", "▁", "a" * 700, "aaaa aaaaa", "\n\n\t x", "日本語テキスト混在 test", "́x", "the the " * 300, "x" * 40 + "☃" + "the"]
    agree(codec, library, texts)
    rng = np.random.default_rng(0)
    names = [codec.pieces[i].replace("▁", " ") for i in rng.integers(259, 32000, 4000)]
    agree(codec, library, ["".join(rng.choice(names, rng.integers(0, 12))) for _ in range(400)])


@given(st.lists(st.text(max_size=40), min_size=1, max_size=12))
@settings(max_examples=60, deadline=None)
def test_ids_equal_the_librarys_for_any_text(codec, library, texts):
    agree(codec, library, texts)


def test_long_words_and_small_bounds_give_the_same(codec, library, monkeypatch):
    texts = ["ab" * 3000, "banana" * 900 + "☃" + "in" * 400, "e" * 5001, "▁" * 600, "overwhelmingly " * 50]
    agree(codec, library, texts)
    monkeypatch.setattr(pieces, "ENDS", 17)
    monkeypatch.setattr(pieces, "GROUP", 64)
    monkeypatch.setattr(pieces, "KEPT", 500)
    codec._clear()
    agree(codec, library, texts)


def test_words_of_all_lengths_advance_together(codec, library, monkeypatch):
    texts = [" ".join("overwhelmingly"[i:] + "banana" * n for n in range(12) for i in range(14))]
    codec._clear()
    steps = []
    monkeypatch.setattr(codec, "_apart", lambda a, b, of=codec._apart: steps.append(len(a)) or of(a, b))
    agree(codec, library, texts)
    assert len(steps) <= 1 + max(map(len, texts[0].split())) and sum(steps) < 8 * len(texts[0])


def test_slices_have_bounded_bytes():
    texts = ["a" * n if n is not None else None for n in (3, None, 50, 0, 9, 9, 9, 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(10)), pa.array(["x", "y", *texts])], names=["i", "t"]).slice(2)
    got = list(common.parts([batch, batch.slice(0, 0)], 1, 20))
    assert [t for b in got for t in b.column(1).to_pylist()] == texts
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 20 for b in got) and len(got) == 4


def test_encoded_frame(spark):
    rows = [(1, "a b", 5), (1, "a b", 5), (2, None, 6), (3, "", 7), (None, "x" * 5000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS int").withColumn("__text2", F.lit("k"))
    out = pieces.encoded(docs, pieces.load(VOCABULARY)).collect()
    assert [r.n_ids for r in out[:4]] == [len(out[0].ids)] * 2 + [0, 0] and out[0].ids == out[1].ids
    assert out[0].decoded_crc32 == zlib.crc32(b"a b") and out[2].decoded_crc32 == 0 and out[4].decoded_crc32 == zlib.crc32(b"x" * 5000)
    assert pieces.encoded(docs.limit(0), pieces.load(VOCABULARY)).count() == 0


def brute(rows, k=5):
    good = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n in {len(v) for _, v in good}:
        ids, x = np.array([i for i, v in good if len(v) == n]), np.array([v for _, v in good if len(v) == n], np.float64)
        norm = np.sqrt((x * x).sum(1))
        for at in np.flatnonzero(ids % 50 == 0):
            s = np.round((x @ x[at]) / (norm * norm[at]), 12)
            s[at] = -np.inf
            out.setdefault(int(ids[at]), []).extend(int(ids[j]) for j in np.lexsort((ids, -s))[:k] if j != at)
    return out


def search(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"__list": F.lit(1), "score": F.lit("x")})
    out = {}
    for r in sorted(nearest.search(df).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_neighbors_of_odd_vectors_are_exact_when_few(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(1, 60)]
    rows += [(0, [1.0] + [0.0] * 7), (100, [2.0] + [0.0] * 7), (101, [3.0] + [0.0] * 7), (102, [0.5] + [0.0] * 7), (103, None), (104, [0.0] * 8), (105, [float("nan")] * 8), (106, [None] * 8), (107, [float("inf")] * 8), (None, [1.0] * 8), (108, []), (101, [3.0] + [0.0] * 7)]
    got = search(spark, rows)
    assert got[0][:4] == [100, 101, 101, 102] and got[100][:4] == [0, 101, 101, 102]
    assert got == brute(rows)
    assert search(spark, rows[:3]) == {} and search(spark, [(50, [1.0, 0.0]), (3, [0.0, 1.0])]) == {50: [3]}
    assert search(spark, []) == {}


def test_every_row_and_every_length_takes_part(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (50, [1.0, 0.1]), (2, [1.0, 1.0]), (50, [1.0, 0.0, 0.0]), (3, [1.0, 1.0, 0.0]), (100, [1.0]), (200, [1.0, 2.0, 3.0, 4.0])]
    got = {}
    for r in nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, round(r.score, 4)))
    assert sorted(got[50]) == [(1, 1, 0.995), (1, 3, 0.7071), (2, 2, 0.7740), (3, 1, 0.0995)] and set(got) == {50}
    twins = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (7, [1.0, 0.1])]
    assert search(spark, twins) == {50: [50, 50, 7, 7]} or search(spark, twins) == {50: [50, 7, 50, 7]}


@pytest.mark.parametrize("n", [3000, 12000])
def test_recall_and_ties(spark, n):
    """Of clustered vectors few lists are probed, and nearly all neighbours found."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    rows = [(i, (centres[i % 60] + 0.4 * rng.standard_normal(32)).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(n // 2)]  # one very common vector
    got, want = search(spark, rows), brute(rows)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9
    model = nearest.fit(np.array([v for _, v in rows[: nearest.SAMPLE]], np.float64), len(rows), 5)
    assert model["probes"] < len(model["centres"]) / 3


def test_very_large_and_very_small_vectors_have_cosines(spark):
    rows = [(0, [1e200, 1e200, 1.0]), (50, [1e-200, 0.0, 0.0]), (1, [3.0, 3.0, 0.0]), (2, [0.0, 0.0, 2e-310])]
    out = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    got = {(r.query_id, r.vec_id): r.score for r in out}
    assert got[0, 1] == pytest.approx(1) and got[50, 1] == pytest.approx(2**-0.5) and got[0, 50] == pytest.approx(2**-0.5) and got[50, 2] == 0
    assert len(out) == 6


def test_scan_drops_no_near_pair():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = x[:20]
    i, j = nearest.scan(q, x, np.arange(20)[:, None] == np.arange(500)[None, :], 5)
    found = set(zip(i.tolist(), j.tolist()))
    s = q @ x.T
    s[np.arange(20), np.arange(20)] = -2
    best = [(a, int(b)) for a in range(20) for b in np.argsort(-s[a])[:5]]
    assert len(found & set(best)) >= 0.95 * len(best) and all(a != b for a, b in found)


def test_wav_round_trip_and_padding():
    for text in ("", "é", "x" * 576, "x" * 577):
        payload, n = audio.payload_of(text)
        assert n == len(text.encode()) and len(payload) % 576 == 0 and payload[n:] == b"\xff" * (len(payload) - n)
        assert audio.samples_of(audio.wav(payload)) == (payload, audio.RATE)
    with pytest.raises(ValueError):
        audio.samples_of(b"RIFFxxxxJUNK")


@pytest.mark.parametrize("up, down", [(1, 2), (2, 3), (3, 2), (1, 1), (5, 8)])
def test_polyphase_equals_filtering_the_raised_signal(up, down):
    x = np.random.default_rng(0).standard_normal(300).astype(np.float32)
    phases = audio._phases(up, down)
    whole = audio.resample(x, 0, 300 * up // down - 5, up, down)
    width = phases.shape[1]
    for k in (0, 7, 60, len(whole) - 1):
        at = k * down
        base, phase = at // up - audio.REACH, at % up
        want = sum(phases[phase, width - 1 - i] * (x[base + i] if 0 <= base + i < len(x) else 0) for i in range(width))
        assert whole[k] == pytest.approx(want, abs=1e-4)
    assert np.allclose(audio.resample(x, 40, 50, up, down), whole[40:90], atol=1e-5)


def test_features_have_fixed_shapes_and_spans(monkeypatch):
    rng = np.random.default_rng(0)
    loud = (128 + 100 * np.sin(np.arange(16000) / 5)).astype(np.uint8)
    clip = np.concatenate([np.full(16000, 128, np.uint8), loud, np.full(16000, 128, np.uint8), rng.integers(100, 156, 5000).astype(np.uint8)]).tobytes()
    tensors, spans, parts = audio.features(clip)
    assert tensors.shape[1:] == (audio.TENSOR, audio.MELS) and len(spans) == len(tensors)
    assert all(a[1] == pytest.approx(b[0]) for a, b in pairwise(spans)) and spans[-1][1] == pytest.approx(len(clip) / audio.RATE, abs=0.6)
    assert parts[0][0] == pytest.approx(1.0, abs=0.05) and parts[0][1] == pytest.approx(2.0, abs=0.05)
    arrow = audio.fixed_shape(tensors)
    assert isinstance(arrow.type, pa.FixedShapeTensorType) and np.array_equal(arrow.to_numpy_ndarray(), tensors)
    monkeypatch.setattr(audio, "BLOCK", 50)
    again = audio.features(clip)
    assert np.allclose(again[0], tensors, atol=5e-3) and again[2] == parts


def test_digests_are_of_the_stored_bytes(spark, monkeypatch):
    rows = [(1, "abc"), (2, None), (3, ""), (4, "abc"), (None, "é" * 3000), (1, "abc")]
    media = audio.store(spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash")))
    monkeypatch.setattr(audio, "SLICE", 1000)
    stored = audio.analysed(media)
    out = audio.digests(stored).collect()
    assert len(out) == 6 and audio.digests(audio.analysed(media.limit(0))).count() == 0
    for r in out:
        text = dict(rows)[r.doc_id]
        payload, n = audio.payload_of(text)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(audio.wav(payload)), hashlib.sha256(audio.wav(payload)).hexdigest())
        want, spans, voiced = audio.features(payload)
        assert r.feature == plain_feature(len(payload), want, spans, voiced)
        mine = sorted((x.number, x.start, x.end, x.tensor) for x in audio_rows(stored) if x.doc_id == r.doc_id)
        assert [x[1:3] for x in mine][: len(spans)] == spans if r.doc_id != 1 else len(mine) == 2 * len(spans)
        assert all(np.array_equal(np.array(x[3], np.float32).reshape(audio.TENSOR, audio.MELS), want[x[0]]) for x in mine)
    assert len({r.feature for r in out if r.n_bytes == 3}) == 1
    for r in stored.collect():
        kept = pa.ipc.open_stream(r.tensors).read_all()
        assert kept.schema.field("tensor").type == pa.fixed_shape_tensor(pa.float16(), [audio.TENSOR, audio.MELS]) and kept.column_names == ["tensor", "start", "end"]
    assert stored.count() > 1


def audio_rows(stored, memo={}):
    return memo.setdefault(id(stored), audio.tensors(stored).collect())


def plain_feature(n_bytes, tensors, spans, voiced):
    n = audio.frames_of(n_bytes)
    mean = tensors.reshape(-1, audio.MELS)[:n].astype(np.float64).mean(0)
    return f"frames={n};tensors={len(tensors)};seconds={spans[-1][1]:.3f};segments={len(voiced)};voiced={sum(b - a for a, b in voiced):.3f};mel=" + ",".join(f"{v:.1f}" for v in mean)


def test_features_equal_those_worked_out_one_by_one():
    rng = np.random.default_rng(3)
    clip = np.concatenate([rng.integers(0, 256, 3000), 128 + rng.integers(-3, 4, 2500), rng.integers(60, 200, 2000)]).astype(np.uint8)
    x, step = (clip.astype(np.float64) - 128) / 128, audio.HOP * audio.DOWN / audio.UP / audio.RATE
    reach, raised = audio.REACH * audio.UP, max(audio.UP, audio.DOWN)

    def sample(k):
        """The k-th resampled value: a windowed sinc around its place at the raised rate, over the input's places."""
        middle, total, weight = k * audio.DOWN, 0.0, 0.0
        for i in range(-(-(middle - reach) // audio.UP), (middle + reach) // audio.UP + 1):
            d = middle - i * audio.UP
            tap = np.sinc(d / raised) * (0.5 + 0.5 * np.cos(np.pi * d / (reach + 1)))
            weight += tap
            total += tap * (x[i] if 0 <= i < len(x) else 0.0)
        return total / weight

    n = audio.frames_of(len(x))
    y = np.array([sample(k) for k in range((n - 1) * audio.HOP + audio.FRAME)])
    rate, mel = audio.RATE * audio.UP / audio.DOWN, lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(rate / 2) * i / (audio.MELS + 1) / 2595) - 1) for i in range(audio.MELS + 2)]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(audio.FFT // 2 + 1), np.arange(audio.FRAME)) / audio.FFT)
    tensors, spans, found = audio.features(clip.tobytes())
    got, energy = tensors.reshape(-1, audio.MELS)[:n], []
    for i in range(n):
        frame = y[i * audio.HOP : i * audio.HOP + audio.FRAME]
        energy.append(np.log10((frame**2).mean() + 1e-6))
        power = np.abs(wave @ (frame * window)) ** 2
        for m in range(audio.MELS):
            low, top, high = edges[m : m + 3]
            f = np.arange(audio.FFT // 2 + 1) * rate / audio.FFT
            rise = np.clip(np.minimum((f - low) / (top - low), (high - f) / (high - top)), 0, None)
            assert got[i, m] == pytest.approx(np.log10((power * rise).sum() + 1e-6), abs=4e-3)
    level, on, want = np.array(energy) - np.mean(energy), None, []
    for i, v in enumerate([*level, -9]):
        if on is None and v > audio.OPEN:
            on = i
        elif on is not None and v < audio.CLOSE:
            if i - on >= audio.LEAST:
                want.append((on * step, min(len(x) / audio.RATE, i * step)))
            on = None
    assert len(found) == len(want) and np.allclose(found, want) and len(spans) == -(-n // audio.TENSOR)


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = toxicity.parameters(rng)
    x = rng.standard_normal((6, toxicity.INPUTS, 4)).astype(np.float32)
    mask = np.ones((6, 4), bool)
    mask[4:, 1] = False
    mask[2:, 3] = False
    y, weight = np.array([0, 1, 1, 0], np.float32), np.array([1, 2, 1, 0.5], np.float32)

    def loss():
        s = toxicity.logits(p, np.concatenate([np.matmul(p["Wf"].T, x), np.matmul(p["Wb"].T, x)], axis=1), mask).astype(np.float64)
        return float((weight * (np.logaddexp(0, s) - y * s)).mean())

    for name, g in toxicity.gradients(p, x, mask, y, weight).items():
        flat = x.reshape(-1) if name == "x" else p[name].reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            old = flat[i]
            flat[i] = old + 1e-2
            high = loss()
            flat[i] = old - 1e-2
            low = loss()
            flat[i] = old
            assert (high - low) / 2e-2 == pytest.approx(g.reshape(-1)[i], abs=2e-3), name


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 47, 48, 49, 88, 500):
        at = toxicity.starts(n)
        assert at[-1] + toxicity.WINDOW >= n and all(b - a < toxicity.WINDOW for a, b in pairwise(at))


def toxic_corpus(n=600):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abdeilmnorst"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(3, 160)))
        bad = i % 6 == 0
        if bad:
            text.insert(int(rng.integers(0, len(text))), f"zug{rng.choice(words)}" if i % 12 else "Vile!")
        rows.append((i, " ".join(text), int(bad)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, None), (9000, ""), (9001, "clean " * 30_000 + "zugabc"), (3, rows[3][1])], "doc_id long, text string").withColumns({"score": F.lit("clash"), "kind": F.lit(1)})
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None), (777_777, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.scored(docs, model).collect()
    assert len(out) == len(rows) + 4
    got = {r.doc_id: r for r in out}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    right = [got[i].predicted == y for i, y in held]
    assert np.mean(right) >= 0.95 and np.mean([got[i].predicted for i, y in held if y]) >= 0.8
    assert got[9001].predicted == 1 and got[None].score == got[9000].score and all(0 <= r.score <= 1 for r in out)
    assert toxicity.scored(docs.limit(0), model).count() == 0


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    for rows, score in (([], 0.0), ([(1, 0), (2, 0)], 0.0)):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))
        assert [r.score for r in toxicity.scored(docs, model).collect()] == [score, score]


def test_long_labelled_texts_are_in_the_training_sample(spark):
    rows = [(i, " ".join(["word"] * (3000 if i % 3 == 0 else 20)) + f" {i}", int(i % 3 == 0)) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    sample, share = toxicity.training_sample(docs, labels)
    got = sample.collect()
    assert {(r.text, r[2]) for r in got} == {(t, v) for i, t, v in rows if zlib.crc32(str(i).encode()) % 5} and 0.2 < share < 0.5
    drawn = toxicity._drawn(sample, [{"p": None, "table": {}, "chars": np.zeros((toxicity.BUCKETS, toxicity.CHARS))}] * 2)
    assert drawn.groupby(["__id", "__toxic"]).size().max() <= max(toxicity.DRAWN.values()) and drawn["window"].str.split().str.len().max() <= toxicity.WINDOW


def slow_logit(model, text):
    """The largest logit of a text's windows, a word at a time."""
    p, h = model["p"], toxicity.HIDDEN
    words = (text or "").split()

    def vector(raw):
        w = toxicity.plain(raw)
        grams = [model["chars"][g] for g in toxicity.trigrams([w])[0]]
        odds = np.zeros(toxicity.ODDS)
        for kind, piece in toxicity.pieces(w):
            odds[kind] = model["table"].get(piece, 0)
        return np.concatenate([odds, np.mean(grams, axis=0), [toxicity.length_input(w), 1]])

    def run(xs, W, U):
        state, out = np.zeros(h), []
        for x in xs:
            u, v = state @ U, x @ W
            z, r = 1 / (1 + np.exp(-(u + v)[:h])), 1 / (1 + np.exp(-(u + v)[h : 2 * h]))
            c = np.tanh(r * u[2 * h :] + v[2 * h :])
            state = z * state + (1 - z) * c
            out.append(state)
        return np.array(out)

    best = -np.inf
    for at in toxicity.starts(len(words)):
        xs = [vector(w) for w in words[at : at + toxicity.WINDOW]]
        if not xs:
            return float(p["c"][0])
        states = np.concatenate([run(xs, p["Wf"], p["Uf"]), run(xs[::-1], p["Wb"], p["Ub"])[::-1]], axis=1)
        a = np.exp(states @ p["v"])
        best = max(best, float((a / a.sum()) @ states @ p["w"] + p["c"][0]))
    return best


def test_scores_equal_a_plain_pass_over_all_windows(monkeypatch):
    rng = np.random.default_rng(1)
    model = toxicity.Trainer(3).model({k: float(rng.normal()) for _, t, _ in toxic_corpus(30) for w in t.split() for _, k in toxicity.pieces(toxicity.plain(w))}) | {"share": 0.1}
    model["chars"] = model["chars"] * 10
    texts = [None, "", " \n", "one", "x" * 500] + [" ".join(rng.choice([w for _, t, _ in toxic_corpus(30) for w in t.split()], n)) for n in (47, 48, 49, 88, 89, 400)]
    want = [slow_logit(model, t) for t in texts]
    assert toxicity.Scorer(model).largest(texts) == pytest.approx(want, abs=1e-4)
    assert [max(x) for x in toxicity.Scorer(model).windows([(t or "").split() for t in texts])] == pytest.approx(want, abs=1e-4)
    monkeypatch.setattr(toxicity, "KEPT", 20)
    monkeypatch.setattr(toxicity, "GROUP", 50)
    assert toxicity.Scorer(model).largest(texts) == pytest.approx(want, abs=1e-4)
