
from collections import Counter

import numpy as np
import pytest

import public_tokenizers as P
from turnstile.llm import decontam, html, simhash, suffix, token_files

MARK = "<|endoftext|>"


@pytest.mark.parametrize("token, how", [(None, {}), ("two words", {}), ("</s>.", {}), ("<eat>", {"rstrip": True, "lstrip": True})])
def test_added_tokens(spark, tmp_path, token, how):
    """op2: ids of texts that spell an added token out are those of the library, and so are the starts behind them."""
    from tokenizers import AddedToken, Tokenizer

    path = P.path("byte_bpe_50k.json")
    if token:
        own = Tokenizer.from_file(path)
        own.add_tokens([AddedToken(token, normalized=False, **how)])
        own.save(path := f"{tmp_path}/own.json")
    ref = Tokenizer.from_file(path)
    texts = ["a doc<|endoftext|> next", MARK, f"{MARK}{MARK} x", f"a  {MARK}  b \n{MARK}", f"end.{MARK}. Word{MARK}word, {MARK}!", " " + MARK, "plain words", f"one {token} next, a {token}. b {token}", None]
    rows = token_files.token_files(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path, folder=f"file://{tmp_path}/t")[1].orderBy("start").collect()
    expected = [[*ref.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == expected
    assert [r.start for r in rows] == np.cumsum([0, *map(len, expected[:-1])]).tolist()


def prose(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice([*"abcdefgh"], 5)) for _ in range(n))


def test_one_row_of_each_component(spark):
    """pipeline: documents without an id, and different texts of one id, are documents of their own."""
    a, b, c, d, e, f = (prose(s) for s in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (3, c), (1, d), (1, e), (1, e), (2, e.upper()), (9, f), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text) for r in simhash.deduplicated(docs).collect()]
    blank = [x for x in got if not x[1]]
    assert len(blank) == 1 and blank[0][0] is None
    assert Counter(x for x in got if x[1]) == Counter([(None, a), (None, b), (3, c), (1, d), (1, e), (9, f)])
    assert simhash.deduplicated(docs.limit(0)).count() == 0


def test_clean_judges_rows(spark):
    """pipeline: a contaminated document takes no other with its id along."""
    item, a, b = prose(11, 20), prose(12), prose(13)
    rows = [(None, a), (None, f"{item} {b}"), (None, item), (5, b), (5, item), (5, b), (6, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontam.clean(docs, items)
    assert got.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(None, a), (5, b), (5, b), (6, None), (None, None)])


def test_copied_articles(spark):
    """op6: on a host's unmarked pages a mirrored article and a quoted sentence stay, what its pages share goes."""
    foot, article, quote, first, second = (prose(s, 30) for s in range(20, 25))
    rows = [(1, "a", article, foot), (2, "b", article, foot), (3, "c", f"{first} {quote}", foot), (4, "d", f"{quote} {second}", foot), (5, "e", "short", foot), (6, "f", article, "other foot")]
    rows = [(i, f"http://h.example/{u}", f"<p>{t}</p><p>{f}</p>") for i, u, t, f in rows] + [(i, f"http://one.example/{i}", f"<p>{article}</p>") for i in (7, 8, 9)]
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string")
    expected = {1: article, 2: article, 3: f"{first} {quote}", 4: f"{quote} {second}", 5: "short", 6: f"{article}\n\nother foot", 7: article, 8: article, 9: article}
    got = [(r.page_id, r.text) for r in html.main_text(pages).collect()]
    assert Counter(got) == Counter([*expected.items(), (1, article)])


def test_strings_of_a_scope(spark):
    """op6: what goes from all is what brute force counts in enough distinct documents of a scope."""
    r = np.random.default_rng(4)
    parts = [prose(s, 15) for s in range(30, 42)]
    docs = [(i, int(r.integers(0, 3)) if i < 60 else 3, " ".join([parts[k] for k in r.integers(0, 12 if i < 30 else 5, 3)] + [prose(100 + i, 4)])) for i in range(62)]
    docs += [(100 + i, 4, f"{parts[i % 12 if i % 4 else 1]} {prose(200 + i, 4)} {parts[(i * 5) % 12]}") for i in range(45)]
    got = suffix.repeated_spans(spark.createDataFrame(docs, "doc_id long, scope long, text string"), scope_col="scope", every=True).collect()
    held, size = {}, Counter(s for _, s, _ in docs)
    for i, s, t in docs:
        for k in range(len(t) - 49):
            held.setdefault((s, t[k : k + 50]), set()).add(i)
    expected = {}
    for i, s, t in docs:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if len(held[s, t[k : k + 50]]) >= max(min(3, size[s]), size[s] / 10):
                gone[k : k + 50] = True
        expected[i] = "".join(c for c, g in zip(t, gone) if not g)
    assert {x.doc_id: x.kept.decode() for x in got} == expected
    assert 0 < sum(map(len, expected.values())) < sum(len(t) for _, _, t in docs)


T, U = prose(50, 30), prose(51, 5)


@pytest.mark.parametrize(
    "page, expected",
    [
        (f"<article></article><p>{T}</p>", ([T], True)), (f"<div>{T}</div><article class='related'>{U}</article>", ([T], True)),
        (f"<main><p>{T}</p><article>{U}</article></main>", ([T, U], False)), (f"<main><p>{T}</p><article class=related>{U}</article></main>", ([T], False)),
        (f"<article>{T}</article><article role=complementary>{U}</article><p>{U}</p>", ([T], False)), (f"<div>{U}</div><article class='post has-sidebar'>{T}</article>", ([U, T], True)),
        (f"<article class=promo><article>{U}</article></article><article>{T}</article>", ([T], False)), (f"<main></main><article>{T}</article>", ([T], False)),
        (f"<article-card>{T}</article-card>", ([T], True)), (f"<script>'<article>'</script><!-- <main> -->{T}", ([T], True)), (None, ([], True)),
    ],
)
def test_main_blocks(page, expected):
    """op6: an article that does not hold the larger part of a page is not its text; whether a page is open is told by elements."""
    assert html.main_blocks(page) == expected


def test_open_pages(spark):
    """op6: pages that only mention an article element lose what their host shares, and keep their text."""
    foot, own = prose(60, 30), [f"{prose(s, 30)} {s}" for s in (61, 72, 83, 94)]
    rows = [(i, f"http://h.example/{i}", f"<script>'<article>'</script><p>{t}</p><p>{foot}</p><article></article>") for i, t in enumerate(own)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in got.collect()} == dict(enumerate(own))
