"""The operators' inner functions against brute force, without Spark."""

import io
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import public_tokenizers as P
from turnstile.llm import bpe, html, quality, rules, simhash, suffix, token_files, toxicity
from turnstile.llm.common import local_components, squeeze, unsqueeze

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def test_bpe_equals_the_library():
    import tiktoken

    own = bpe.encoder(RANKS, P.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    r = random.Random(2)
    texts = ["", " ", "  a", "a  b", " a b ", "x\n\ny  \n z", "a" * 2000, " " * 600, "é" * 700 + "  " + "ab" * 900, "don't we'll 'tis", "<|endoftext|>", "日本語 テスト  ok", "a\x1c b", "x   y"]
    texts += ["".join(r.choice(" \n\tab'sé1.,日") for _ in range(r.randint(1, 60))) for _ in range(500)]
    ids = bpe.id_bytes(*own.encode(pa.array(texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in ids.to_pylist()] == [ref.encode_ordinary(t) for t in texts]
    table = bpe.token_bytes(RANKS)
    assert [bpe.decoded(x, table) for x in ids.to_pylist()] == [t.encode() for t in texts]
    assert bpe.id_bytes(*own.encode(pa.array(texts))) == ids  # remembered pieces
    own.forget()
    assert bpe.id_bytes(*own.encode(pa.array([None, *texts, None], pa.string()).slice(1, len(texts)))) == ids
    assert len(bpe.id_bytes(*own.encode(pa.array([], pa.string())))) == 0


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    own, _ = token_files.library(P.path("byte_bpe_50k.json"))
    ref = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert isinstance(own, token_files.Words)
    r = random.Random(4)
    some = ["a", "b", "The", " ", "  ", "\n", ".", ",", "é", "1", "23", "'s", "'", "<|endoftext|>", "\t", "\u00a0", "\x1c", "中", "#", "ñ", "\x85", "е", "W", "\u1e9e", "²", "😀"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(8000)] + [None, "", " ", ".", " .", "x" * 3000, " " * 900 + "y", "!" * 50, "a " * 4000]
    got = bpe.id_bytes(*own.encode(pa.array(texts)))
    assert [np.frombuffer(x, "<u4").tolist() for x in got.to_pylist()] == [ref.encode(t or "", add_special_tokens=False).ids for t in texts]
    for few in ([], [None], [""], ["", None, " "]):
        got = bpe.id_bytes(*own.encode(pa.array(few, pa.string())))
        assert [len(x) // 4 for x in got.to_pylist()] == [len(ref.encode(t or "", add_special_tokens=False).ids) for t in few]


def test_bpe_long_and_matrix_merges_agree():
    own = bpe.encoder(RANKS, P.PATTERN)
    words = ["".join(random.Random(i).choice("abcdeé") for _ in range(30)) for i in range(50)]
    assert own.encode_matches(words) == [own.merge_long(w.encode()) for w in words]


def test_token_files_read_what_was_written():
    class Out(io.BytesIO):
        def close(self):
            pass

        def size(self):
            return len(self.getvalue())

    docs = [(None, np.array([0])), (-5, np.arange(300_000) % 60_000), (7, np.array([1, 2, 0])), (7, np.empty(0))]
    for width in (2, 4):
        out = Out()
        w = token_files.Writer(out, width)
        for i, ids in docs:
            w.add(i, ids.astype("<u4"))
        w.close()
        r = token_files.Reader(out)
        assert r.ids == [i for i, _ in docs] and all((r.document(k) == ids).all() for k, (_, ids) in enumerate(docs))
        import zstandard

        plain = b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read1() for _ in range(1))
        assert plain  # the frames are standard ones
        bad = bytearray(out.getvalue())
        bad[20] ^= 1
        with pytest.raises(Exception):
            token_files.Reader(Out(bytes(bad))).document(1)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=8))
def test_manhattan_is_a_lower_bound(x, flips):
    y = x
    for f in flips:
        y ^= 1 << f
    a, b = np.array([x], np.uint64), np.array([y], np.uint64)
    counts = lambda v: [bin(v >> 2 * i & 3).count("1") for i in range(32)]
    exact = sum(abs(p - q) for p, q in zip(counts(x), counts(y)))
    assert simhash.manhattan(simhash.counts_of(a), simhash.counts_of(b))[0] == exact <= bin(x ^ y).count("1")


def test_large_cells_join_what_links_join():
    r = np.random.default_rng(1)
    seeds = r.integers(0, 2**63, 12, dtype=np.uint64)
    f = np.unique(np.concatenate([s ^ (np.uint64(1) << r.integers(0, 20, 80).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 20, 80).astype(np.uint64)) for s in seeds]))
    a, b = simhash.linked_large(f, 4)
    i, j = np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 4)
    all_nodes, all_roots = local_components(f[i], f[j])
    nodes, roots = local_components(np.concatenate([a, f]), np.concatenate([b, f]))
    assert (nodes == all_nodes).all() and (roots == all_roots).all()


def test_squeeze():
    arrays = [np.arange(5), np.empty(0, np.uint64), np.array([2**63], np.uint64), np.array([1.5, 2], np.float32)]
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, unsqueeze(squeeze(*arrays))))


def test_sample_covers_every_window(monkeypatch):
    """Equal windows pick equal names and steps, also where a long document is cut into parts."""
    monkeypatch.setattr(suffix, "CHUNK_BITS", 9)
    raw = [bytes(random.Random(i).choices(b"abc ", k=n)) for i, n in enumerate((0, 10, 49, 50, 51, 300, 2000))]
    s = suffix.Sample(raw)
    seen = sorted((d, w) for d, a, b in zip(s.doc, s.low, s.high) for w in range(a, b + 1))
    assert seen == [(d, w) for d, t in enumerate(raw) for w in range(len(t) - 49)]
    run, start, hashed = s.windows(np.ones(len(s.doc), bool))
    by = {}
    for r, w, h in zip(run, start, hashed):
        by.setdefault(raw[s.doc[r]][w : w + 50], set()).add(int(h))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30))
def test_repeated_words(found):
    c = Counter(tuple(found[k : k + 3]) for k in range(len(found) - 2))
    hit = {k + i for k in range(len(found) - 2) if c[tuple(found[k : k + 3])] > 1 for i in range(3)}
    assert rules.repeated_words(found) == (len(hit), len(set(found)))


def test_rules_are_learned_and_pruned():
    r = np.random.default_rng(0)
    n = 2000
    counts = {c: r.integers(0, 50, n) for c in rules.COUNTS}
    counts["n_words"] = r.integers(60, 500, n)
    bad = (counts["n_symbols"] / (counts["n_words"] + 1.0) > 0.3) | ((counts["n_dup_lines"] / (counts["n_words"] + 1.0) > 0.2) & (counts["n_words"] < 200))
    found = rules.learn(counts, bad)
    x = {k: f(lambda c: counts[c].astype(float)) for k, f in rules.FEATURES.items()}
    hit = np.zeros(n, bool)
    for rule in found.rules:
        hit |= rules.covered(rule, x, n)
    assert (hit & ~bad).sum() <= 0.02 * hit.sum() and (hit & bad).sum() > 0.8 * bad.sum() and "reject" in found.text()
    assert rules.learn(counts, np.zeros(n, bool)).rules == ()


def test_ordinal_regression_of_three_grades():
    own = quality.Features()
    texts = [t for _ in range(60) for t in ("bad bad junk###", "fair text here", "fine prose indeed now")]
    grade = np.array([0, 1, 2] * 60)
    model = quality.fit([own.of(t) for t in texts], grade, epochs=20)
    tails = model.tails(np.array([float(v @ model.weights[p]) for p, v in map(own.of, texts[:3])]))
    assert (np.diff(model.thresholds) > 0).all() and (np.diff(tails, axis=1) <= 0).all()
    assert (np.abs(model.expected(tails) - [0, 1, 2]) < 0.5).all()
    assert quality.fit([own.of("a")], np.array([1])).tails(np.array([0.0])).shape == (1, 0) and len(own.of(None)[0]) == 1


def test_gradients_of_the_network():
    net = toxicity.Network.fresh(np.zeros(toxicity.BUCKETS))
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    r = np.random.default_rng(0)
    features = r.integers(0, 50, (9, toxicity.PLACES))
    words = np.array([[0, 1, 2, 9], [3, 4, 9, 9], [5, 6, 7, 8]])
    y, w = np.array([1.0, 0, 1]), np.ones(3)
    g, _ = net.gradients(words, features, y, w)
    for name, at in [("out", 3), ("pick", 2), ("att", (1, 2)), ("inf", (2, 5)), ("inb", (1, 20)), ("ref", (2, 3)), ("reb", (1, 18)), ("offf", 7), ("bias", 0)]:
        old = net.p[name][at]
        loss = []
        for step in (1e-4, -1e-4):
            net.p[name][at] = old + step
            loss.append(net.gradients(words, features, y, w)[1])
        net.p[name][at] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - g[name][at]) < 2e-3, name


def test_toxicity_learns_a_word_and_covers_the_text():
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    texts = [r.choices(vocab, k=r.randint(5, 150)) for _ in range(600)]
    y = np.array([i % 3 == 0 for i in range(600)]).astype(int)
    for t, label in zip(texts, y):
        if label:
            t.insert(r.randrange(len(t) + 1), r.choice(["zqxidiot", "zqxidiots", "zqxidiotic"]))
    docs = [np.array([toxicity.places(w.encode()) for w in t], np.int64) for t in texts]
    net = toxicity.train(docs[:450], y[:450], epochs=3)
    got = toxicity.Scorer(net).of([" ".join(t) for t in texts[450:]]) >= 0.5
    assert (got == y[450:].astype(bool)).mean() > 0.95
    score = toxicity.Scorer(net).of([None, "", " ".join(vocab * 20), " ".join([*vocab * 20, "zqxidiot"])])
    assert (score[:3] < 0.5).all() and score[3] > 0.5
    for n in (0, 1, 16, 17, 32, 33, 100):
        w = toxicity.cut(n, 5, -1)
        assert {*w[w >= 0].tolist()} == set(range(5, 5 + n)) and w.shape[1] == toxicity.WINDOW


@pytest.mark.parametrize(
    "page, expected",
    [
        (None, []), ("", []), ("<p>a<p>b<div>c</div>", ["a", "b", "c"]), ("<article>unclosed <b>x", ["unclosed x"]),
        ("<nav>m</nav><article><header>H</header><h1>A &amp; B</h1><p>x<br>y <i>z</i>q<p class='notice'>n<p>w</article><div>o</div>", ["A & B", "x y zq", "w"]),
        ("<main><p>t</p><form><p>f</p></form><section id=comments><p>c</p></section></main><footer>f</footer>", ["t"]),
        ("<article><script>var t='</p><p>no'</script><p>a\n\n b</p><!-- <p>c --><div class='ad-box'><div>x</div>y</div><p hidden>h</p>z</article>", ["a b", "z"]),
        ("<article><ul><li>1<li class=share>2<li>3</ul></article>", ["1", "3"]), ("<article><p title='a > b'>k</p></article>", ["k"]),
        ("<script>'<article>'</script><!-- <main> --><p>body</p>", ["body"]), ("<article></article><p>out</p>", []), ("<ARTICLE>İİİ<SCRIPT>x</Script>ok</ARTICLE>", ["İİİok"]),
    ],
)
def test_blocks(page, expected):
    assert html.blocks(page) == expected


def test_vocabularies_stay_outside():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert not any(f.endswith((".tiktoken", ".model")) for _, _, fs in os.walk(root) for f in fs)


@pytest.mark.parametrize("piece", ["<a ", "</", '<a ">', '<a "', "<a '\"", "<!-", "<p", "<script>", "<!--", '<a "><b \'>'])
def test_broken_pages_take_linear_time(piece):
    import time

    for tail in ("", ">", "'", '">'):
        began = time.process_time()
        html.blocks("<p>one</p>" + piece * (600_000 // len(piece)) + tail)
        assert time.process_time() - began < 30  # a square would take hours


def test_tags_of_broken_pages():
    assert html.blocks('<p title="a > b">one</p><p>two < three</p>') == ["one", "two < three"]
    assert html.blocks('<p>one</p><a title="x>two</a><p>three</p>') == ["one", "two", "three"]
    assert html.blocks("<p>one</p><!-- <p>no</p> --><p>two</p><!-- <p>no") == ["one", "two"]
    assert html.blocks("<p>one <b") == ["one <b"] and html.blocks("<p>1 < 2") == ["1 < 2"]
