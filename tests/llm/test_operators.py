"""The ten operators and the pipeline against brute force on small tables.

The shared table holds nulls in every column, empty and long texts, ties,
repeated rows, near copies and clashing extra columns; each operator also gets
an empty table.
"""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from oriel.llm import bpe, exact_dedup, html, knn_quality, line_dedup, ngram_join, packing, quality_rules, substring_dedup, token_counts
from oriel.llm.base import Bloom
from oriel.llm.components import components
from oriel.llm.kernels import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, h string, t string, i string, tk string, blob string"


def words(t):
    return WORD.findall(t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["été", "naïve", "漢字", "😀"]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(120)
    texts = [None, "", " \t\n", "one", "One", "a b c", base, base, base.upper(), base.replace(" ", "  "), "\n".join([prose(9), "Licensed to all who read this line here.", prose(8)]), "\n".join(["Licensed to all who read this line here.", prose(7)])]
    for _ in range(40):
        w = base.split()
        for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [f"{prose(20)} {passage} {prose(15)}" for _ in range(6)]
    texts += [prose(rng.randrange(1, 300)) for _ in range(40)]
    texts += ["x " * 3000, prose(12_000), "Spam*** buy### now!! " * 30, "<|endoftext|> a  b <|endoftext|>", "\n".join([passage] * 3), "it's we'll \r\n\x0b don't  "]
    out = [(k, t) for k, t in enumerate(texts)]
    return [*out, (3, "one"), (3, "one"), (5, "other text of a repeated identifier"), (None, "no identifier at all"), (None, base)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [None if k % 2 else "x" for k in range(len(rows))]
    return spark.createDataFrame([(i, t, c, c, None, c, c, c, c, c, c) for (i, t), c in zip(rows, clash, strict=True)], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def same(found, expected):
    assert collections.Counter(found) == collections.Counter(expected)


def test_word_kernel(rows):
    raw = [(t or "").encode() for _, t in rows]
    w = Words(raw)
    assert w.count.tolist() == [len(words(t)) for _, t in rows]
    by = {}
    for h, s, e, d in zip(w.hash.tolist(), w.start.tolist(), w.end.tolist(), w.doc.tolist(), strict=True):
        at = w.text_at[d]
        assert by.setdefault(h, raw[d][s - at : e - at]) == raw[d][s - at : e - at]
    h, at = w.runs(5)
    one = {}
    lists = [words(t) for _, t in rows]
    for x, k in zip(h.tolist(), at.tolist(), strict=True):
        d = int(w.doc[k])
        p = k - int(w.first[d])
        assert one.setdefault(x, tuple(lists[d][p : p + 5])) == tuple(lists[d][p : p + 5])
    assert len(h) == sum(max(0, len(x) - 4) for x in lists)


def brute_components(rows, shingle, percent):
    sets = []
    for _, t in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(t)]
        sets.append({tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[root(k)].append(k)
    out = []
    for m in groups.values():
        ids = [rows[k][0] for k in m if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids) if ids else None) for k in m]
    return out


@pytest.mark.parametrize("shingle,percent,block,heavy,name", [(4, 85, 2048, 1 << 16, 64), (5, 80, 2, 1, 3)])
def test_ngram_join(docs, none, rows, shingle, percent, block, heavy, name, monkeypatch):
    """Also with blocks of two members, with every list salted, and with names of three bits for all sets."""
    monkeypatch.setattr(ngram_join, "LIST", block)
    monkeypatch.setattr(ngram_join, "HEAVY", heavy)
    monkeypatch.setattr(ngram_join, "NAME", name)
    got = ngram_join.linked(docs, shingle=shingle, percent=percent)
    same([tuple(r) for r in got.collect()], brute_components(rows, shingle, percent))
    if block == 2048:
        assert ngram_join.linked(none).count() == 0


def test_ngram_join_of_a_list_of_thousands_of_blocks(spark, monkeypatch):
    """A group of near copies and a rarest shingle that all texts share: far more blocks than one task's."""
    monkeypatch.setattr(ngram_join, "LIST", 2)
    rng = random.Random(5)
    base = [f"b{k}" for k in range(60)]
    texts = []
    for k in range(3000):
        w = list(base)
        w[rng.randrange(60)] = f"x{k}"
        texts.append(" ".join(w) if k % 3 else f"{k} {k + 1} same five words stand here {k + 2} {k + 3}")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.linked(df, shingle=3, percent=60).collect()}
    assert got == {k: 1 if k % 3 else k for k in range(3000)}


def test_suffix_filter_never_parts_a_pair_that_links():
    rng = np.random.default_rng(3)
    for n in (3, 40, 900, 20_000):
        x = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)
        y = np.concatenate((x[: n - n // 10], rng.integers(0, 2**63, n // 10).astype(np.uint64)))
        s = object.__new__(ngram_join.Sets)
        s.hash, s.doc, s.n = np.concatenate((x, y)), np.repeat([0, 1], n), np.array([n, n])
        a, b = s.profiles().astype(int)
        assert abs(a - b).sum() <= len(set(x.tolist()) ^ set(y.tolist()))


def test_components_of_a_long_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 102), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><header>Site</header><div class="ad">Buy now.</div><div class="cookie-notice">We use</div>
<article><h1>Head &amp; line</h1><p>First  &eacute; paragraph<b> bold</b> here.<p>Second <a href="x">link</a> one.</p><!-- gone --><div class="comments"><p>Nice!</p></div>
<form><input name=q><button>Go</button></form><ul><li>Item one</li></ul></article><aside>Side</aside><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    pages = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "plain text only, of the kind that has no markup but is long enough to be the article of a page"), (None, "u", "<p>unclosed <b>and <i>broken"), (1, "u", PAGE)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = collections.defaultdict(list)
    for r in html.extract(df).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == ["Head & line\n\nFirst é paragraph bold here.\n\nSecond link one.\n\nItem one"] * 2
    assert got[2] == [""] and got[3] == [""] and got[4] == [pages[3][2]]
    assert html.extract(df.where("false")).count() == 0
    # without an article the two passes decide
    long = "the story of a town and of the people in it who went on with the work that was to be done"
    loose = f"<body><div><a>Home</a> <a>About</a></div><div>{long}</div><div>Short one.</div><div>{long}</div><div><a>Imprint</a></div></body>"
    assert html.main_text(loose) == f"{long}\n\nShort one.\n\n{long}"


def test_html_outside_of_an_article():
    long = "the story of a town and of the people in it who went on with the work that was to be done"
    # main text outside, the article only a teaser or a comment
    for teaser in ("<article>Read on here.</article>", "<article class=comment>So true.</article>"):
        text = html.main_text(f"<body>{teaser}<div><p>{long}<p>{long}<p>Short one.<p>{long}</div></body>")
        assert text.endswith(f"{long}\n\n{long}\n\nShort one.\n\n{long}")
        assert "So true" not in text
    # both passes inside: an open block between link lists goes, one beside text or at the edge stays
    links = "<ul><li><a>one of many</a><li><a>two of many</a></ul>"
    assert html.main_text(f"<article><h1>Head</h1><p>{long}{links}<p>See more:{links}<p>{long}<p>End.</article><div>Made by us.</div>") == f"Head\n\n{long}\n\n{long}\n\nEnd."


LONG = "the story of a town and of the people in it who went on with the work that was to be done"


@pytest.mark.parametrize("page,text", [
    (f"<body><nav><a>Home</a><a>About</a><article><h1>Head</h1><p>{LONG}</article></body>", f"Head\n\n{LONG}"),  # a menu never closed
    (f"<article><p>{LONG}<div class=ad>Buy now.<p>{LONG}</article>", f"{LONG}\n\n{LONG}"),  # an advert never closed
    (f"<article><p class='search results'>{LONG}</p><div class='comments'><p>{LONG}</div></article>", LONG),
    (f"<article><p>{LONG}<script>var x = 1;\n<p>{LONG}</article>", f"{LONG}\n\n{LONG}"),  # a script never closed
    (f"<p>{LONG}</p><ul><li><a href=x>one</a><li><a href=y>two three</a></ul><p>Tail.</p>", LONG),  # the nearer neighbour is a list of links
    (f"<h2>Head</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p>", f"Head\n\n{LONG}\n\nShort.\n\n{LONG}"),
    (f"<div><a>{LONG}</a></div><p>a &lt;b&gt; &amp;c &#233; {LONG}</p>", f"a <b> &c é {LONG}"),
    ("<article>" + f"<p>{LONG}</p>" * 3000 + "</article>", "\n\n".join([LONG] * 3000)),
])
def test_html_pages(page, text):
    assert html.main_text(page) == text


def brute_labels(blocks):
    """The two passes by their rules, block by block and without running sums."""
    first = []
    framed = sum(len(b[0]) for b in blocks if b[2]) > sum(len(b[0]) for b in blocks if not b[2])
    for text, linked, inside, heading in blocks:
        w = text.split(" ")
        share = len([x for x in w if x.strip(".,;:!?\"'()").lower() in html.STOP]) / len(w)
        signs = (len(w) >= 20) + (share >= 0.1)
        first.append(-1 if linked > (0.5 if inside else 0.33) * len(text) else 0 if heading or len(w) < 8 else int(signs >= (2 if framed and not inside else 1)))
    out = []
    for k, (label, (_, _, inside, heading)) in enumerate(zip(first, blocks, strict=True)):
        back = [j for j in range(k - 1, -1, -1) if first[j]][:1]
        ahead = [j for j in range(k + 1, len(blocks)) if first[j]][:1]
        words_between = lambda i, j: sum(len(b[0].split(" ")) for b in blocks[i + 1 : j])
        b, a = (first[back[0]] if back else 0), (first[ahead[0]] if ahead else 0)
        if label:
            out.append(label)
            continue
        if inside:
            b, a = (b if back and blocks[back[0]][2] else 1), (a if ahead and blocks[ahead[0]][2] else 1)
            out.append(a if heading else 1 if 1 in (a, b) else -1)
            continue
        b, a = (-1 if back and blocks[back[0]][2] else b), (-1 if ahead and blocks[ahead[0]][2] else a)
        if heading and a:
            out.append(a)
        elif b and a and b != a:
            x, y = words_between(back[0], k), words_between(k, ahead[0])
            out.append(b if x < y else a if y < x else -1)
        else:
            out.append(b or a or 1)
    return out


def test_html_two_passes_equal_brute_force():
    rng = random.Random(9)
    for _ in range(300):
        blocks = []
        for _ in range(rng.randrange(1, 15)):
            text = " ".join(rng.choice(["the", "stone", "of", "river", "x"]) for _ in range(rng.choice([1, 3, 7, 9, 25])))
            blocks.append((text, rng.choice([0, 0, len(text)]), rng.random() < 0.5, rng.random() < 0.2))
        assert html.second_pass(blocks, html.first_pass(blocks)) == brute_labels(blocks)


def test_html_of_given_pages_needs_no_article_element(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    with_tags = [html.main_text(x) for x in pages]
    without = [html.main_text(re.sub(r"<(/?)article\b", r"<\1div", x)) for x in pages]
    blocks = sum(len(x.split("\n\n")) for x in with_tags)
    same_blocks = sum(len(set(x.split("\n\n")) & set(y.split("\n\n"))) for x, y in zip(with_tags, without, strict=True))
    assert all(with_tags) and same_blocks >= 0.98 * sum(len(set(x.split("\n\n"))) for x in with_tags) and blocks > 2000


def test_nearest_neighbours_vote_by_exact_cosine():
    """The blocked votes against cosines taken one pair at a time."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["aa", "bcd", "the", "of", "!!", "Zed", "42"]) for _ in range(rng.randrange(1, 40))).encode() for _ in range(90)]
    fit = knn_quality.Fit(neighbours=5, dimensions=12)
    labels = np.array([k % 2 for k in range(60)], np.float32)
    model = knn_quality.train(knn_quality.term_counts(texts[:60]), labels, fit)
    got = model.score(knn_quality.term_counts(texts))
    unit = lambda v: v / math.sqrt(sum(float(x) ** 2 for x in v))
    place = lambda t: unit((knn_quality.weighted(knn_quality.term_counts([t]))[0] * model.idf) @ model.projection)
    known = [place(t) for t in texts[:60]]
    for t, score in zip(texts, got, strict=True):
        v = place(t)
        cosines = [sum(float(a) * float(b) for a, b in zip(v, x, strict=True)) for x in known]
        cut = sorted(cosines)[-5]
        expected = []
        for slack in (0, 1e-6, -1e-6):  # near ties for the last place may fall either way in 32 bits
            votes = [(max(c, 0) ** 8 + 1e-12, y) for c, y in zip(cosines, labels, strict=True) if c >= cut - slack] or [(1, 0.5)]
            expected.append(sum(w * y for w, y in votes) / sum(w for w, _ in votes))
        assert min(abs(score - x) for x in expected) < 1e-4


def test_quality_classifier(spark, none):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["stone", "river", "and", "the", "walked", "over", "green", "hill"]) for _ in range(60)) + "."
    bad = lambda: " ".join(rng.choice(["BUY!!", "now***", "###", "win$$$"]) for _ in range(40))
    table = [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(300)]
    df = spark.createDataFrame([(k, t) for k, t, _ in table] + [(900, None), (None, "x"), (901, ""), (1, table[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y, 0) for k, _, y in table] + [(None, 1, 0), (900, None, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in knn_quality.quality(df, labels).collect()}
    assert len(got) == 303
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 300]
    assert len(held) > 30 and all(r["predicted"] == table[r["doc_id"]][2] for r in held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    # labels of held-out rows change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r["doc_id"]: r["score"] for r in knn_quality.quality(df, flipped).collect()}
    assert all(again[k] == pytest.approx(r["score"], abs=1e-6) for k, r in got.items())
    assert knn_quality.quality(df, labels.where("false")).where("score <> 0.5").count() == 0
    assert knn_quality.quality(none, labels).count() == 0


def test_quality_rules(docs, none, rows):
    expected = []
    for i, t in rows:
        w, t = words(t), t or ""
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        at = {p for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(at) > 50 * len(w)
        expected.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(at), failed))
    got = quality_rules.verdict(quality_rules.ledger(docs))
    same([tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()], expected)
    assert got.where("base_failed and kept").isEmpty() and not got.where("kept").isEmpty()
    table = {r["rule"]: r for r in quality_rules.ablation(got).collect()}
    assert table["few_words"]["n_failed"] == sum(x[1] < 50 for x in expected)
    masks = [r["failures"] for r in got.collect()]
    assert all(table[k]["n_only"] == masks.count(b) for k, b in quality_rules.RULES.items())
    assert quality_rules.ledger(none).count() == 0 and len(quality_rules.ablation(quality_rules.ledger(none)).collect()) == len(quality_rules.RULES)


@pytest.fixture(scope="module")
def tokens(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t, [t.encode(x or "", add_special_tokens=False).ids for _, x in rows]


def test_bpe(docs, none, rows, tokens):
    tool, ids = tokens
    expected = [(i, len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(tool.decode(x, skip_special_tokens=False).encode()).hexdigest()) for (i, _), x in zip(rows, ids, strict=True)]
    same([tuple(r) for r in bpe.digests(docs).collect()], expected)
    for r in bpe.encode_decode(docs).collect():
        assert r["n_tokens"] * 4 == len(r["ids"]) and tool.decode(np.frombuffer(r["ids"], "<u4").tolist(), skip_special_tokens=False) == r["decoded"]
    assert bpe.digests(none).count() == 0


def test_pair_index_equals_one_word_at_a_time(monkeypatch):
    """Random rules against merging the least rank again and again, with and without arrays."""
    rng = random.Random(8)
    letters = bpe.byte_letters()
    for many in (0, 10**9):
        monkeypatch.setattr(bpe, "MANY", many)
        for _ in range(30):
            vocab, merges = {c: b for c, b in letters.items()}, []
            tokens = ["a", "b", "c"]
            for _ in range(12):
                x, y = rng.choice(tokens), rng.choice(tokens)
                if x + y not in vocab:
                    vocab[x + y] = len(vocab)
                    merges.append([x, y])
                    tokens.append(x + y)
            rank = {tuple(m): k for k, m in enumerate(merges)}
            words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 20))) for _ in range(50)] + ["a" * 33]
            ids, count = bpe.PairIndex(vocab, merges).encode("".join(words).encode(), np.array(list(map(len, words))))
            at = 0
            for w, n in zip(words, count.tolist(), strict=True):
                t = list(w)
                while True:
                    best = min((rank.get(p, 99) for p in zip(t, t[1:], strict=False)), default=99)
                    if best == 99:
                        break
                    x, y = merges[best]
                    k, out = 0, []
                    while k < len(t):
                        hit = t[k : k + 2] == [x, y]
                        out.append(x + y if hit else t[k])
                        k += 2 if hit else 1
                    t = out
                assert ids[at : at + n].tolist() == [vocab[x] for x in t]
                at += n
    with pytest.raises(ValueError):
        bpe.PairIndex(letters | {"ab": 300, "abc": 301}, [["ab", "c"], ["a", "b"]])


def test_bpe_with_a_tiny_cache(monkeypatch, tokens):
    monkeypatch.setattr(bpe, "CACHED", 3)
    e = bpe.Encoder()
    for text in ("the cat sat on the mat\nand the dog  too", "the cat again", "", " \n ", "aaaaaaaaaa aaaa"):
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == tokens[0].encode(text, add_special_tokens=False).ids


def test_packing(docs, none, rows, tokens):
    whole = collections.Counter(tuple([i, *x, 2]) for (i, _), x in zip(rows, tokens[1], strict=True))
    got = [r.asDict() for r in packing.packed(docs).collect()]
    by_id = collections.defaultdict(list)
    for (i, _), x in zip(rows, tokens[1], strict=True):
        by_id[i].append([*x, 2])
    for r in got:
        assert any(len(x) >= r["start"] + r["length"] and zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in by_id[r["doc_id"]])
        assert r["length"] == 1024 or r["start"] == 0
    assert sum(r["length"] for r in got) == sum(len(k) - 1 for k in whole.elements())
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 1024
    assert len(bins) <= math.ceil(sum(r["length"] for r in got) / 1024) + 2
    assert packing.packed(none).count() == 0


def test_packing_needs_no_more_than_the_fewest_sequences():
    """Against an exhaustive search on small cases."""
    rng = random.Random(6)

    def fewest(sizes, cap):
        best = len(sizes)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(sizes):
                best = len(bins)
                return
            for b in {x: j for j, x in enumerate(bins)}.values():
                if bins[b] + sizes[k] <= cap:
                    place(k + 1, [*bins[:b], bins[b] + sizes[k], *bins[b + 1 :]])
            place(k + 1, [*bins, sizes[k]])

        place(0, [])
        return best

    over = 0
    for _ in range(60):
        sizes = sorted((rng.randrange(1, 21) for _ in range(9)), reverse=True)
        _, n = packing.plan(collections.Counter(sizes), packing.Capacity(tokens=20, documents=20, cost=400))
        over += n - fewest(sizes, 20)
    assert over <= 2  # best fit on descending sizes is nearly always optimal on such


def test_packing_plan_keeps_every_constraint():
    rng = random.Random(2)
    counts = collections.Counter(rng.randrange(1, 101) for _ in range(500))
    cap = packing.Capacity(tokens=100, documents=3, cost=6000)
    with pytest.raises(ValueError):
        packing.plan(counts | {90: 1}, cap)
    counts = collections.Counter({k: v for k, v in counts.items() if k * k <= 6000})
    slots, n = packing.plan(counts, cap)
    content = collections.defaultdict(list)
    for size, total in counts.items():
        own = slots[slots[:, 0] == size]
        for rank in range(total):
            s = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            content[s[2] + (rank - s[1]) // s[3]].append((int(s[4] + (rank - s[1]) % s[3] * size), size))
    assert len(content) == n and sum(map(len, content.values())) == sum(counts.values())
    for b in content.values():
        b.sort()
        assert len(b) <= 3 and sum(x for _, x in b) <= 100 and sum(x * x for _, x in b) <= 6000
        assert [o for o, _ in b] == [sum(x for _, x in b[:k]) for k in range(len(b))]


def test_exact_dedup(docs, none, rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = collections.defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    keep = {t: min((i for i in m if i is not None), default=None) for t, m in groups.items()}
    got = exact_dedup.exact_groups(docs).collect()
    same([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], [(i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)])
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_groups(none).count() == 0


def test_exact_dedup_tells_colliding_texts_apart(docs, rows, monkeypatch):
    """Digests of one byte: nearly all texts share one with others; the bytes decide."""
    monkeypatch.setattr(exact_dedup, "digest_of", lambda sha: F.substring(F.unhex(sha), 1, 1))
    expected = collections.Counter((r["doc_id"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs).collect())
    got = exact_dedup.exact_groups(docs, batches=3).collect()
    size = collections.Counter(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows)
    assert collections.Counter((r["doc_id"], r["text_sha256"]) for r in got) == expected
    assert collections.Counter(r["group_size"] for r in got) == collections.Counter(n for n in size.values() for _ in range(n))
    assert sum(r["kept"] for r in got) == len(size)


def test_digest_index_levels(spark):
    """Batches meet older levels through filters; compaction keeps the smallest identifiers."""
    index = exact_dedup.DigestIndex(levels=2)
    seen = {}
    for k in range(4):
        ids = [(bytes([x % 7 + 3 * k]), (False, 100 * k + x, x)) for x in range(5)]
        hits = index.add(spark.createDataFrame(ids, "digest binary, keep struct<anonymous:boolean,id:long,row:long>"))
        assert {bytes(r["digest"]) for r in hits.collect()} == {d for d, _ in ids if d in seen}
        for d, (_, i, _) in ids:
            seen.setdefault(d, []).append(i)
        assert len(index.levels) <= 2
    assert {bytes(r["digest"]): (r["keep"]["id"], r["n"]) for r in index.compact().collect()} == {d: (min(v), len(v)) for d, v in seen.items()}


def test_exact_dedup_memtables(spark):
    rows = [(bytes([k % 3]), (False, k, k)) for k in range(30)]
    df = spark.createDataFrame(rows, "digest binary, keep struct<anonymous:boolean,id:long,row:long>").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        runs = exact_dedup.flushed_runs(df, memtable=2)
        assert runs.count() == 9  # three flushes of three digests
        got = {bytes(r["digest"])[0]: (r["keep"]["id"], r["n"]) for r in exact_dedup.compacted(runs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: (k, 10) for k in range(3)}


def test_token_counts(docs, none, rows, tokens):
    tool, ids = tokens
    tool.encode_special_tokens = True
    plain = [tool.encode(x or "", add_special_tokens=False).ids for _, x in rows]
    tool.encode_special_tokens = False
    for block in (1 << 16, 64):
        same([tuple(r) for r in token_counts.counted(docs, block=block).collect()], [(i, len(x)) for (i, _), x in zip(rows, plain, strict=True)])
    assert token_counts.counted(none).count() == 0


def test_token_scan_of_a_foreign_file(spark, monkeypatch):
    """Blocks without a separator, empty documents, an unclosed tail, segments of two blocks."""
    monkeypatch.setattr(token_counts, "SEGMENT", 2)
    flat = np.array([5] * 37 + [9] + [9] + [5] * 3 + [9] + [5] * 25, "<u2")
    blocks = [(f, k, flat[k * 4 : k * 4 + 4].tobytes()) for f in (0, 1) for k in range(-(-len(flat) // 4))]
    got = token_counts.document_lengths(spark.createDataFrame(blocks, "file long, block long, tokens binary"), end_id=9).orderBy("file", "ordinal").collect()
    assert [tuple(r) for r in got] == [(f, o, n) for f in (0, 1) for o, n in enumerate([37, 0, 3, 25])]


def brute_windows(rows, n=35):
    count = collections.Counter(tuple(w[k : k + n]) for _, t in rows for w in [words(t)] for k in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if count[tuple(w[k : k + n])] > 1:
                gone[k : k + n] = [True] * n
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("group,bucket,most_bits", [(256, 1 << 17, 1 << 27), (1, 100, 1 << 27), (2, 1 << 17, 0)])
def test_substring_dedup(docs, none, rows, group, bucket, most_bits, monkeypatch):
    """Also with many groups and buckets, and beyond the size of a filter."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    monkeypatch.setattr(substring_dedup, "BUCKET", bucket)
    got = substring_dedup.without_repeats(docs, most_bits=most_bits).collect()
    same([(r["doc_id"], r["n_words"], r["n_removed"], r["kept_words"]) for r in got], brute_windows(rows))
    for r in got:
        assert words(r["kept_text"]) == words(r["kept_words"])
        assert r["n_removed"] or r["kept_text"] == (r["text"] or "")
    if group == 256:
        assert substring_dedup.without_repeats(none).count() == 0


def test_fingerprint_index_is_incremental(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = substring_dedup.FingerprintIndex()
    whole.add(df)
    parts = substring_dedup.FingerprintIndex()
    first = parts.add(df.where("doc_id < 30"))
    second = parts.add(df.where("doc_id >= 30 or doc_id is null"))
    prints = lambda x: sorted(r["fp"] for r in x.history.collect())
    assert prints(whole) == prints(parts)
    assert first.count() and second.join(first, "fp").count()  # a later batch meets what the history holds


def test_line_dedup(docs, none, rows):
    lines = lambda t: [(k, " ".join(words(x))) for k, x in enumerate((t or "").split("\n"))]
    keyed = {}
    for i, t in rows:
        keyed[(-(2**63) if i is None else i, t or "")] = (i, t)
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    tk = {r["t"]: r["k"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("k")).collect()}
    order = sorted(keyed, key=lambda k: (k[0], tk[k[1]]))
    first, removed = {}, {}
    for k in order:
        own = [(n, x) for n, x in lines(k[1]) if x]
        a, size = [x for _, x in own], [len(x.split(" ")) for _, x in own]
        gone = set()
        for p in {first[x] for x, s in zip(a, size, strict=True) if s >= 5 and x in first}:
            gone |= set(line_dedup.common_blocks(a, [x for _, x in lines(p[1]) if x], size, 5))
        removed[k] = {own[g][0] for g in gone}
        for x, s in zip(a, size, strict=True):
            if s >= 5:
                first.setdefault(x, k)
    expected = []
    for i, t in rows:
        k = (-(2**63) if i is None else i, t or "")
        expected.append((i, sum(bool(x) for _, x in lines(t)), len(removed[k]), "\n".join(x for n, x in enumerate((t or "").split("\n")) if n not in removed[k])))
    got = line_dedup.without_shared_lines(docs).collect()
    same([(r["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in got], expected)
    assert line_dedup.without_shared_lines(none).count() == 0


def test_line_dedup_meets_every_earlier_holder(spark):
    rng = random.Random(11)
    line = [f"template line number {k} of many words" for k in range(6)] + ["by me", "read on", "top", "three short words"]
    texts = [[line[0], line[1]], [line[1], line[0]], [line[1], "own words of this document only", line[0]], [line[0], line[0]], [line[2], line[0], line[0]]]
    texts += [[rng.choice(line) if rng.random() < 0.7 else f"own line {k} {j} of one document" for j in range(rng.randrange(1, 9))] for k in range(300)]
    docs = spark.createDataFrame([(k, "\n".join(x)) for k, x in enumerate(texts)], "doc_id long, text string").repartition(3)
    expected = []
    for k, a in enumerate(texts):
        size, gone = [len(x.split()) for x in a], set()
        for b in texts[:k]:
            if any(n >= 5 and x in b for x, n in zip(a, size, strict=True)):
                gone |= set(line_dedup.common_blocks(a, b, size, 5))
        expected.append((k, len(a), len(gone), "\n".join(x for n, x in enumerate(a) if n not in gone)))
    same([(r["doc_id"], r["n_lines"], r["n_removed"], r["kept_text"]) for r in line_dedup.without_shared_lines(docs).collect()], expected)


def test_patience():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in range(2))
        m = line_dedup.patience(a, b)
        assert all(a[i] == b[j] for i, j in m) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:], strict=False))
    assert line_dedup.patience([1, 2, 3], [9, 1, 2, 8, 3]) == [(0, 1), (1, 2), (2, 4)]


def test_bloom():
    keys = np.random.default_rng(0).integers(0, 2**63, 2000).astype(np.uint64)
    b = Bloom(1 << 16)
    b.add(keys[:1000])
    assert b.has(keys[:1000]).all() and b.has(keys[1000:]).mean() < 0.05


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    documents = docs.select(corpus_pipeline.COLUMNS)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k % 2 == 0), 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    near = corpus_pipeline.near_duplicates(spark, d, str(tmp_path))
    kept = collections.Counter((r["doc_id"], r["text"]) for r in near.collect())
    pairs = [(r["doc_id"] if r["doc_id"] is not None else -(2**63), r["text"]) for r in d.collect()]
    smallest = {c for _, _, c in brute_components(pairs, 5, 80)}
    assert {(-(2**63) if i is None else i) for i, _ in kept} == smallest and max(kept.values()) == 1
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == corpus_pipeline.COLUMNS, name
        assert stage(spark, d.where("false"), str(tmp_path)).count() == 0
    # each stage against brute force on its own input
    scores = {(r["doc_id"], r["text"]): r["quality_score"] for r in knn_quality.scored(d, knn_quality.fitted(d, spark.read.parquet(f"{tmp_path}/labels.parquet"))).collect()}
    good = corpus_pipeline.quality_classifier(spark, d, str(tmp_path))
    same([(r["doc_id"], r["text"]) for r in good.collect()], [(r["doc_id"], r["text"]) for r in d.collect() if scores[r["doc_id"], r["text"]] >= 0.3])
    rows_of = [(r["doc_id"], r["text"]) for r in d.collect()]
    left = {(i, t): (n, kept) for (i, t), (_, _, n, kept) in zip(rows_of, brute_windows(rows_of), strict=True)}
    out = corpus_pipeline.substring_deduplication(spark, d, str(tmp_path))
    same([(r["doc_id"], tuple(words(r["text"]))) for r in out.collect()], [(i, tuple(kept.split())) for (i, t) in rows_of for n, kept in [left[i, t]] if not n or kept.strip()])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert packed and {r["doc_id"] for r in packed} <= {i for i, _ in rows_of}
    assert all(sum(x["length"] for x in packed if x["sequence_id"] == q) <= 1024 for q in {r["sequence_id"] for r in packed})


def test_clashing_names_and_filters(spark, docs, monkeypatch):
    """Columns named like an operator's own, and key sets beyond a filter's size."""
    from oriel.llm import base

    clash = docs.select("doc_id", "text", F.lit("mine").alias("n_lines"), F.lit("mine").alias("N_Removed"), F.lit(1).alias("kept_text"), F.lit("x").alias("gone"), F.lit("y").alias("quality_score"), F.lit("z").alias("key"), F.lit("f").alias("file"))
    out = line_dedup.without_shared_lines(clash)
    assert sorted(out.columns) == sorted(["doc_id", "text", "gone", "quality_score", "key", "file", "n_lines", "n_removed", "kept_text"])
    assert dict(out.dtypes)["n_removed"] == "bigint" and out.where("gone <> 'x' or n_removed < 0").count() == 0
    model = knn_quality.train(np.zeros((0, knn_quality.TERMS), np.float32), np.zeros(0, np.float32), knn_quality.Fit())
    assert knn_quality.scored(clash, model).where("quality_score = 0.5 and file = 'f'").count() == clash.count()
    assert token_counts.counted(clash.withColumnRenamed("doc_id", "ordinal2").withColumnRenamed("ordinal2", "file2"), key="file").where("file = 'f'").count() == clash.count()
    rows = spark.range(1000).select(F.xxhash64("id").alias("k"), "id")
    keys = rows.where("id < 50").select(F.col("k").alias("x"))
    assert base.bloom_of(keys, "x", 16) is None
    kept = [base.thinned(rows, "k", keys, "x").where("id < 50").count()]
    monkeypatch.setattr(base, "bloom_of", lambda *a: None)
    kept.append(base.thinned(rows, "k", keys, "x").count())
    assert kept == [50, 50]
    filled = spark.range(300_000).select(F.xxhash64("id").alias("k"))
    monkeypatch.undo()
    sieve = base.bloom_of(filled, "k")
    own = np.array([r["k"] for r in filled.limit(2000).collect()], np.int64).view(np.uint64)
    others = np.array([r["k"] for r in spark.range(10**6, 10**6 + 2000).select(F.xxhash64("id").alias("k")).collect()], np.int64).view(np.uint64)
    assert sieve.slices > 1 and sieve.has(own).all() and sieve.has(others).mean() < 0.05


def test_shared_folder_is_never_a_local_one_on_a_cluster():
    from types import SimpleNamespace

    from oriel.llm import base

    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local-cluster[3,2,3000]", getConf=lambda: conf))
    with pytest.raises(RuntimeError):
        base.shared_dir(cluster)
