"""Every operator and the pipeline on rows with nulls, blanks, copies, long texts and clashing columns, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from turnstile.llm import bpe, decontam, html, lm, quality, rules, simhash, suffix, token_files, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp long, b int, ids string, p int, _text string, label int, kept boolean"
R = random.Random(5)
VOCAB = ["".join(R.choice("abcdefgß") for _ in range(R.randint(1, 6))) for _ in range(200)]
ITEM = " ".join(R.choices(VOCAB, k=20))


def prose(n):
    return " ".join(R.choices(VOCAB, k=n))


def texts():
    one, two = prose(120), prose(300)
    near = two.split()
    near[150] = "changed"
    passage = prose(25)
    return [
        (3, one), (1, one), (9, one), (2, two), (5, " ".join(near)), (4, None), (6, ""), (7, " \n\t "), (8, "word"), (10, prose(10) + " " + passage + "\n" + prose(30)),
        (11, passage + "\n" + passage), (12, prose(40) + " " + ITEM + " " + prose(5)), (13, ITEM.upper()), (14, "short item"), (15, "A short ITEM, it is."), (16, "x" * 5000), (17, prose(20_000)),
        (-4, "ünï " * 30), (18, "line one\nline one\n\nline one\nother"), (19, "### ** junk$$$ " * 40), (3, one), (None, prose(15)), (20, "BIG!! WORDS!! " * 60),
    ]


ROWS = texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1, 2, "x", 3, "y", 4, False) for i, t in ROWS]
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(df, *names):
    """Rows as a multiset, so that repeated rows count."""
    return Counter(tuple(r[n] for n in names) for r in df.select(*names).collect())


def test_simhash(docs, empty):
    prints = [simhash.fingerprint((t or "").encode().lower().split()) for _, t in ROWS]
    root = list(range(len(ROWS)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(ROWS)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(ROWS):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    expected = Counter((d, f"{prints[i]:016x}", least.get(find(i))) for i, (d, _) in enumerate(ROWS))
    got = simhash.near_duplicates(docs).withColumn("hex", simhash.hex_fingerprint(F.col("fp")))
    assert rows_of(got, "doc_id", "hex", "component_id") == expected
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in expected}
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("groups, block", [(5, 4096), (6, 3), (7, 4096)])
def test_simhash_cells(spark, groups, block):
    """Any cutting and any block size join the same fingerprints."""
    r = np.random.default_rng(groups)
    seeds = r.integers(0, 2**63, 5)
    f = sorted({int(s) ^ (1 << int(r.integers(0, 63))) ^ (1 << int(r.integers(0, 12))) for s in seeds for _ in range(12)})
    found = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in f], "fp long"), groups=groups, block=block).collect()
    a, b = np.array([x.a for x in found]), np.array([x.b for x in found])
    from turnstile.llm.common import local_components

    arr = np.array(f, np.int64)
    i, j = np.nonzero(np.bitwise_count(arr.view(np.uint64)[:, None] ^ arr.view(np.uint64)) <= 4)
    own, ref = local_components(np.concatenate([a, arr]), np.concatenate([b, arr])), local_components(arr[i], arr[j])
    assert (own[0] == ref[0]).all() and (own[1] == ref[1]).all()


def test_token_files(docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    ref = Tokenizer.from_file(path)
    manifest, got = token_files.token_files(docs, path, folder=f"file://{tmp_path}/t")
    rows = got.orderBy("start").collect()
    assert sorted(rows, key=lambda r: r.start) == rows and [r.id for r in rows] == sorted((i for i, _ in ROWS), key=lambda i: -(10**9) if i is None else i)
    at = 0
    for r in rows:
        assert r.start == at
        at += len(r.ids) // 4
    expected = Counter((i, tuple([*ref.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in ROWS)
    assert Counter((r.id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == expected
    some = token_files.read_tokens(manifest, f"file://{tmp_path}/t", [17, 8]).collect()
    assert {r.id for r in some} == {17, 8} and manifest.agg(F.sum("n_docs")).first()[0] == len(ROWS)
    assert token_files.token_files(empty, path, folder=f"file://{tmp_path}/e")[1].count() == 0


def test_lm(docs, empty, monkeypatch):
    """Words one by one, by the formula, for two orders and with lanes shorter than most texts."""
    out = [zlib.crc32(str("" if i is None else i).encode()) % 10 == 0 for i, _ in ROWS]
    tok = [[*(t or "").encode().lower().split(), b""] for _, t in ROWS]
    c = Counter(w for t, h in zip(tok, out) if not h for w in t)
    n, v = sum(c.values()), len(c)
    base = [round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 6) for t in tok]
    for order in (2, 3):
        grams = Counter(tuple([b"", *t][max(0, i - k) : i + 1]) for t, h in zip(tok, out) if not h for i in range(1, len(t) + 1) for k in range(1, order) if k <= i)

        def p(h, w):
            if not h:
                return (c[w] or v) / (n + v)
            seen = c[h[0]] if len(h) == 1 else grams[h]
            share = lm.MIX * seen / (seen + lm.DAMP)
            return (share * grams[*h, w] / seen if seen else 0) + (1 - share) * p(h[1:], w)

        def score(t):
            own = [b"", *t]
            return sum(math.log10(p(tuple(own[max(0, i - order + 1) : i]), own[i])) for i in range(1, len(own)))

        expected = Counter((i, h, len(t), sum(c[w] > 0 for w in t), n, b, round(score(t), 6)) for (i, _), h, t, b in zip(ROWS, out, tok, base))
        for lane in (lm.LANE, 3):
            monkeypatch.setattr(lm, "LANE", lane)
            got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.scored(docs, order=order).collect())
            assert got == expected
        states = [(), *[(w,) for w in [*list(c)[:20], b"never"]], *[g for g in list(grams)[:60] if len(g) == order - 1 and g[-1]]]
        for h in states:  # every state's probabilities add up to 1
            assert abs(sum(p(h, w) for w in c) + p(h, None) - 1) < 1e-9
    assert lm.scored(empty).count() == 0


def test_lm_parts():
    """Parts are ranges of names; steps give a name back less its part's start, and blocks of equal parts agree."""
    rng = np.random.default_rng(3)
    for bits, parts in ((64, 1), (64, 7), (48, 5000), (40, 12)):
        key = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) >> np.uint64(64 - bits))
        key = rng.permutation(np.append(key, np.uint64(0)))
        key = np.unique(key)[::-1].copy()
        order, met, cut, step = lm.parted(key, parts, bits)
        assert (np.diff(met) > 0).all() and met[-1] < parts and len(step) == len(key) == cut[-1]
        for p, i, j in zip(met.tolist(), cut, cut[1:]):
            start = -(-(p << 32) // parts) << (bits - 32)
            assert [start + int(x) for x in np.cumsum(step[i:j])] == [int(x) for x in key[order][i:j]]


def labels_of(spark):
    return spark.createDataFrame([(i, int(i not in (19, 20)), int(i % 5 == 0)) for i, _ in ROWS if i is not None] + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark, docs, empty):
    labels = labels_of(spark)
    got = quality.graded(docs, labels)
    assert got.count() == len(ROWS) and not {r.doc_id for r in got.where("not kept").collect()} - {19, 20}
    assert quality.accepted(docs, labels).columns == docs.columns
    assert quality.graded(docs, labels.limit(0)).where("kept").count() == len(ROWS) and quality.graded(empty, labels).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, ITEM), (2, "Short item"), (3, ""), (4, None), (2, "Short item"), (10, "no such words ever")], "item_id long, text string")
    read = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")) if w]
    windows = {(str(i), tuple(w[s : s + 13])) for i, w in ((i, read(t)) for i, t in [(1, ITEM), (2, "Short item"), (10, "no such words ever")]) for s in range(max(1, len(w) - 12))}
    expected = Counter()
    for i, t in ROWS:
        w, hit, found = read(t), set(), set()
        for item, win in windows:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    found.add(item)
        expected[i, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    got = decontam.decontamination(docs, items).withColumn("items", F.concat_ws(",", "items"))
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items", "contaminated") == expected and sum(k[4] for k in expected) >= 3
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in expected.items() if not k[4])
    assert decontam.decontamination(empty, items).count() == 0 and decontam.decontamination(docs, items.limit(0)).where("contaminated").count() == 0
    near = decontam.PositionalIndex(docs, items).near(2).where("item = '2'").collect()
    assert {(r.doc, r.distance) for r in near} == {(14, 1), (15, 1)}


def test_html(spark):
    foot = "Terms and conditions of this site apply to all of its visitors at all times."
    rows = [(1, "http://h.example/a", f"<p>Only here.</p><p>{foot}</p>"), (2, "http://h.example/b", f"<div>{foot}</div><p>Another text.</p>"), (3, "http://other.example/", f"<p>{foot}</p>"), (4, "http://h.example/c", "<article>Art</article>" + foot), (5, None, None), (6, "x", ""), (1, "http://h.example/a", f"<p>Only here.</p><p>{foot}</p>")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html.main_text(pages)
    assert rows_of(got, "page_id", "text") == Counter([(1, "Only here."), (2, "Another text."), (3, foot), (4, "Art"), (5, ""), (6, ""), (1, "Only here.")])
    assert html.main_text(pages.limit(0)).count() == 0


def test_bpe(docs, empty):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    got = bpe.decode(bpe.encode(docs, path, P.PATTERN, keep=("text", "p")), path)
    assert all(r.decoded == (r.text or "").encode() for r in got.collect()) and got.count() == len(ROWS)
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def repeats():
    raw = [(-(10**18) if i is None else i, (t or "").encode()) for i, t in ROWS]
    first = {}
    for i, r in sorted(raw):
        for k in range(len(r) - 49):
            first.setdefault(r[k : k + 50], i)
    for (i, _), (d, r) in zip(ROWS, raw):
        m = np.zeros(len(r) + 2, bool)
        for k in range(len(r) - 49):
            if first[r[k : k + 50]] < d:
                m[k + 1 : k + 51] = True
        yield i, len(r), int(m.sum()), int((np.diff(m.astype(int)) == 1).sum()), np.frombuffer(r, np.uint8)[~m[1:-1]].tobytes()


def test_suffix(docs, empty):
    got = suffix.repeated_spans(docs).select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("gone"), F.size("spans").alias("n"), F.sha2("kept", 256).alias("sha"))
    assert rows_of(got, "doc_id", "n_bytes", "gone", "n", "sha") == Counter((i, n, g, s, hashlib.sha256(k).hexdigest()) for i, n, g, s, k in repeats())
    cut = suffix.without_repeats(docs)
    assert cut.columns == docs.columns and rows_of(cut.withColumn("text", F.coalesce("text", F.lit(""))), "doc_id", "text") == Counter((i, k.decode("utf-8", "ignore")) for i, _, _, _, k in repeats())
    assert suffix.repeated_spans(empty).count() == 0


def test_toxicity(spark, docs, empty):
    labels = labels_of(spark)
    got = toxicity.toxicity(docs, labels)
    assert got.count() == len(ROWS) and got.where("score between 0 and 1 and predicted = cast(score >= 0.5 as int)").count() == len(ROWS)
    assert toxicity.toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0 and toxicity.toxicity(empty, labels).count() == 0


def test_rules(spark, docs, empty):
    labels = labels_of(spark)
    expected = Counter()
    for i, t in ROWS:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        expected[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)] += 1
    got = rules.quality_rules(docs, labels)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected
    assert got.where("base_failed and kept").count() == 0
    assert rules.quality_rules(empty, labels).count() == 0 and rules.quality_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_pipeline(spark, docs, tmp_path):
    """Every stage against brute force on what the one before kept."""
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    plain.write.parquet(f"{tmp_path}/documents.parquet")
    labels_of(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert after.dtypes == plain.dtypes, name
        now = after
    kept = [rows_of(spark.read.parquet(f"{tmp_path}/{k}"), "doc_id") for k in range(5)]
    assert all(a & b == a for a, b in zip(kept[1:], kept)) and kept[2] == kept[1]
    assert (12,) not in kept[3] and (8,) in kept[4] and now.where("not round_trip").count() == 0
    assert Counter({(r.doc_id,): 1 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == Counter(set(kept[4]))
