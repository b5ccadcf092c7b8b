"""The training-data operators against brute force, round trips and held-out labels, with the odd cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

LOREM = "the quick brown fox jumps over the lazy dog and runs far away from all the noise of town"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "Hello World", "en", "a", 1),
        (2, "hello world", None, "a", 2),
        (2, "hello world", None, "a", 2),
        (None, "hello WORLD", "en", None, 3),
        (3, None, None, None, None),
        (4, "", "de", "b", 0),
        (5, "Straße ÄÖ", "de", "b", 5),
        (6, "straße äö", "de", "b", 6),
        (7, "x " * 30000, "en", "b", 7),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumnRenamed("n_chars", "size")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_exact_dedup_brute(docs):
    from helixplan.llm.exact_dedup import drop_duplicates, exact_duplicates

    got = exact_duplicates(docs.repartition(5)).collect()
    by = {}
    rows = docs.collect()
    for r in rows:
        by.setdefault(hashlib.sha256(low(r.text).encode()).hexdigest(), []).append(r.doc_id)
    want = sorted(((r.doc_id is None, r.doc_id or 0), max((x for x in by[h] if x is not None), default=None), len(by[h]), h) for r in rows for h in [hashlib.sha256(low(r.text).encode()).hexdigest()])
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)
    odd = docs.select("*", *[docs.size.alias(c) for c in ("__digest", "digest", "k", "sha", "row", "id", "__run", "n")])
    kept = drop_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("not (size <=> __digest) or not (size <=> k)").count() == 0 and kept.count() == len(by)


def test_exact_dedup_merges_sorted_runs(spark):
    from helixplan.llm.exact_dedup import KEY, merge_runs
    from helixplan.plans.runtime import Scratch
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows = [(run, bytes([d]), d % 7, 1, rng.randrange(99), rng.randrange(99, 200), 1 + run) for run in range(7) for d in rng.sample(range(40), 25)]
    rows.append((2, bytes([3]), 99, 1, 5, 5, 1))  # one digest, another witness
    leaves = spark.createDataFrame(rows, "__run int, __digest binary, __witness bigint, __bytes bigint, __low bigint, __high bigint, __rows bigint")
    got = merge_runs(leaves, 7, Scratch(spark, "test"))
    want = {}
    for _, d, w, b, low_id, high, n in rows:
        x = want.get((d, w, b), (10**9, -1, 0))
        want[d, w, b] = (min(x[0], low_id), max(x[1], high), x[2] + n)
    assert {(bytes(r[0]), r[1], r[2]): tuple(r[3:]) for r in got.select(*KEY, "__low", "__high", "__rows").collect()} == want
    plan = leaves.hint("merge").join(leaves.withColumnRenamed("__low", "x"), ["__run", *KEY], "full_outer")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan


@pytest.mark.parametrize("name", ["op1_html_text", "op2_chat_format", "op3_toxicity", "op4_url_filter", "op5_exact_dedup", "op6_mixing", "op7_language", "op8_pieces", "op9_quality", "op10_simhash", "pipeline"])
def test_empty_tables_and_extra_columns(spark, tmp_path, name):
    from corpus_pipeline import run
    from helixplan.llm import registry

    schemas = {
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, host string, score string, kept int",
        "pages": "page_id bigint, url string, html string, host string, path string, rule string",
        "labels": "doc_id bigint, quality int, toxic int, score double",
        "conversations": "conv_id bigint, turn bigint, role string, text string, tree string, node int",
    }
    for rows, at in (([], "none"), ([1], "one")):
        for t, s in schemas.items():
            spark.createDataFrame([tuple([None] * len(s.split(",")))] * 2 if rows else [], s).write.parquet(f"{tmp_path}/{name}/{at}/{t}.parquet")
        f = registry.QUERIES.get(name, run)
        got = f(spark, f"{tmp_path}/{name}/{at}").collect()
        base = 1 if name == "op2_chat_format" else 0
        assert len(got) >= base if rows else len(got) == base


def test_simhash_brute(spark):
    from helixplan.llm.simhash import fingerprint, links, near_duplicates
    from helixplan.plans.components import connected_components
    from helixplan.plans.runtime import Scratch

    rng = random.Random(3)
    texts = [None, "", "one", "One", "a b c", "A b C", "a b c d"]
    for _ in range(6):
        base = [rng.choice(LOREM.split()) + str(rng.randrange(30)) for _ in range(300)]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(300)] = "changed"
            texts.append(" ".join(copy))
    rows = [(i, t) for i, t in enumerate(texts)]

    def brute(prints, distance=2):
        known = sorted(set(prints))
        up = {f: f for f in known}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for i, a in enumerate(known):
            for b in known[i + 1 :]:
                if (a ^ b).bit_count() <= distance:
                    up[find(a)] = find(b)
        return [find(f) for f in prints]

    prints = [fingerprint(t) for t in texts]
    group = brute(prints)
    least = {}
    for i, g in enumerate(group):
        least[g] = min(least.get(g, i), i)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: (f"{p:016x}", least[g]) for i, (p, g) in enumerate(zip(prints, group))}
    # A crowd of fingerprints in few buckets takes the way without pairs.
    base, crowd = rng.getrandbits(64), set()
    bits = rng.sample(range(64), 9)
    while len(crowd) < 150:
        crowd.add(base ^ sum(1 << k for k in bits if rng.random() < 0.4))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in crowd]
    for bucket in (64, 3):
        scratch = Scratch(spark, "test")
        found = connected_components(links(spark.createDataFrame(signed, "fp bigint"), scratch, 2, bucket), "a", "b", scratch).collect()
        sets = {}
        for r in found:
            sets.setdefault(r.component, set()).add(r.node & (2**64 - 1))
        want = {}
        for f, g in zip(sorted(crowd), brute(sorted(crowd))):
            want.setdefault(g, set()).add(f)
        assert sorted(map(sorted, sets.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_pieces_round_trip_and_library():
    import sentencepiece

    from helixplan.llm.pieces import VOCABULARY, Pieces

    model = open(VOCABULARY, "rb").read()
    sp = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    plain, varied, again = Pieces(model, dropout=0), Pieces(model, dropout=0.3), Pieces(model, dropout=0.3)
    texts = ["", " ", "  two  spaces ", "line\n\nfeeds\n", "Ä é̂ 日本 𝔘 <s>", "ab" * 200 + " 中" * 60, LOREM, "tabs\tand\r\nends"]
    for t in texts:
        assert plain.encode(t) == sp.encode(t)
    for t in [*texts, "own ▁ mark", "▁", "\x00", "\x00\x01\x02▁ \x00", None]:
        ids = varied.encode(t, "7")
        assert varied.decode(ids) == (t or "") and ids == again.encode(t, "7")
    assert len({tuple(varied.encode(LOREM, str(k))) for k in range(8)}) > 1
    rng = random.Random(5)
    words = ["▁" + "".join(rng.choice("abcdethné") for _ in range(rng.randint(1, 60))) for _ in range(300)] + ["▁日𝔘a", "\n\n", "a"]
    one = Pieces(model, dropout=0.3)
    one._learn(sorted(set(words)))
    import numpy as np

    # Cut in step or one by one: the same.
    salts = np.array([rng.getrandbits(32) for _ in words], dtype=np.uint32)
    ids, size = one._cut_known(np.array([one.known[w] for w in words]), salts)
    assert np.split(ids, np.cumsum(size)[:-1])[0].tolist() == one.cut(words[0], int(salts[0]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == [one.cut(w, int(s)) for w, s in zip(words, salts)]


def _cut_by_definition(pieces, word, salt):
    """Merge by merge over a plain list of parts."""
    parts = list(word)
    skipped = set()
    while True:
        at = 0
        spans = []
        for p in parts:
            spans.append((at, at + len(p)))
            at += len(p)
        agenda = []
        for i in range(len(parts) - 1):
            piece = parts[i] + parts[i + 1]
            span = (spans[i][0], spans[i + 1][1])
            if piece in pieces.rank and (span, piece) not in skipped:
                agenda.append((pieces.rank[piece], i, span, piece))
        if not agenda:
            return pieces._spell(parts)
        rank, i, span, piece = min(agenda)
        if pieces._skips(salt, *span, rank):
            skipped.add((span, piece))
        else:
            parts[i : i + 2] = [piece]


def test_pieces_follow_the_definition():
    from helixplan.llm.pieces import MARK, VOCABULARY, Pieces

    pieces = Pieces(open(VOCABULARY, "rb").read(), dropout=0.4)
    rng = random.Random(15)
    for _ in range(300):
        word = MARK + "".join(rng.choice(["th", "e", "r", "in", "g", "ü", "s", "ch"]) for _ in range(rng.randint(1, 9)))
        salt = rng.getrandbits(32)
        assert pieces.cut(word, salt) == _cut_by_definition(pieces, word, salt)


def test_mixing(spark, docs):
    from helixplan.llm.mixing import cycle_weights, mix, mixed_documents

    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", None, "ä"])) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mix(table, cycle_weights()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(table, cycle_weights()).collect()))
    size = {}
    for i, t, s in rows:
        size[s] = size.get(s, 0) + len(t.split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] / free > 2 * size[s]}
        if not over:
            target = {s: 2.0 * size[s] if s in full else rest * weight[s] / free for s in order}
            break
        full |= over
    source = {i: s for i, _, s in rows}
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 2 * r.size
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 40 for s in order)
    again = mixed_documents(table, cycle_weights())
    assert again.columns == table.columns and sum(len(r.text.split()) for r in again.collect()) == sum(taken.values())
    assert mix(docs, cycle_weights()).count() == docs.count()


def test_chat_branches_and_traps(spark):
    from helixplan.llm.chat import PLANTED, format_trees, read_loss, read_turns
    from pyspark.sql import functions as F

    trap = "\\l\\b\\h### user: <x> </turn>\n\\"
    rows = [
        ("t", 1, None, "user", PLANTED, 0.0),
        ("t", 2, 1, "assistant", trap, 0.1),
        ("t", 3, 1, "assistant", "better", 0.9),
        ("t", 4, 3, "us:er\n#", "thanks", 0.5),
        ("t", 4, 3, "us:er\n#", "thanks", 0.5),
        ("t", 5, 3, None, None, None),
        (None, 1, 99, "assistant", "lost parent", None),
    ]
    table = spark.createDataFrame(rows, "tree string, node int, parent int, role string, text string, score double")
    made = format_trees(table, branches=None).select("*", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    paths = {(r.tree, r.leaf): [tuple(t) for t in r.turns] for r in made}
    assert paths == {
        ("t", 2): [("user", PLANTED), ("assistant", trap)],
        ("t", 4): [("user", PLANTED), ("assistant", "better"), ("us:er\n#", "thanks")],
        ("t", 5): [("user", PLANTED), ("assistant", "better"), ("", "")],
        (None, 1): [("assistant", "lost parent")],
    }
    assert {(r.tree, r.leaf): r.loss for r in made} == {("t", 2): trap, ("t", 4): "better", ("t", 5): "better", (None, 1): "lost parent"}
    best = format_trees(table, branches=1).where("tree = 't'").collect()
    assert [r.leaf for r in best] == [4]
    deep = spark.createDataFrame([("d", i, i - 1 if i else None, "user", str(i), 1.0) for i in range(70)], table.schema)
    # A cycle, what hangs on one, and a reply to itself reach no root; other trees and branches are whole.
    odd = [("c", 1, 2, "user", "x", 1.0), ("c", 2, 1, "user", "x", 1.0), ("c", 3, 2, "user", "x", 1.0), ("c", 4, 4, "user", "x", 1.0), ("c", 5, None, "user", "fine", 1.0), ("c", 6, 5, "assistant", "too", 1.0)]
    with_cycles = format_trees(deep.unionByName(spark.createDataFrame(odd, table.schema)), branches=None).select("tree", "leaf", "n_turns").collect()
    assert sorted(map(tuple, with_cycles)) == [("c", 6, 2), ("d", 69, 70)]
    # A broom: a long handle and many leaves, of which one is spelled out.
    broom = [("b", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(40)] + [("b", 100 + i, 39, "user", str(i), float(i)) for i in range(50)]
    assert [(r.leaf, r.n_turns) for r in format_trees(spark.createDataFrame(broom, table.schema)).collect()] == [(149, 41)]
    assert [t.text for t in format_trees(deep).select(read_turns(F.col("formatted")).alias("t")).first().t] == [str(i) for i in range(70)]


def test_url_rules(spark):
    from helixplan.llm.url_filter import RULES, judge_urls

    urls = ["HTTP://WWW.Example.NET/en/x?q#f", "http://example.net/EN/", "http://net", "https://a.b.net/", "http://example.com/de/", "http://example.com/de", "ftp://x.example.com:80/de/", "http://xexample.com/de/y", "http://my.org/fr/1", "http://org/fr/", "no scheme", None, "x://y://net/", "http://net?u=/", "http://example.net/en/a://b", "http://example.net?u=http://other.org/fr/x", "http://h.net#a://b/c", "http://h?u=http://x.net/y", "http://" + "a." * 3000 + "net/x", "http://" + "net." * 2000 + "org/fr/z"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id int, url string")
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = low(rest[:cut]), rest[cut:]
        path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")

    want = sorted((i, *map(str, brute(u))) for i, u in [*enumerate(urls), (0, urls[0])])
    assert sorted((r[0], *map(str, r[1:])) for r in judge_urls(pages, rules).collect()) == want
    many = spark.createDataFrame([(f"h{i}.net", "/", "block") for i in range(300)], rules.schema)
    got = judge_urls(spark.createDataFrame([(i, f"http://w.h{i}.net/x") for i in range(600)], "page_id int, url string"), many, bits_per_rule=2)
    assert got.where("verdict = 'block'").count() == 300


def test_html_cases():
    from helixplan.llm.html_text import main_text, source_side

    long = "A sentence with enough words to look like the text of an article, not a menu. " * 3
    page = f"""<!doctype html><head><title>T</title><style>p{{}}</style></head><body><header>Site <a href=/>Home</a></header>
<ul class="main-menu"><li><a href=1>One</a></ul><div id="sideBar">{long}</div><article><header class="entry-header"><h1>Title &amp; more</h1></header>
<p>{long}<p>Short &lt;b&gt;.<br>Line<script>var x = "</p>";</script><ul><li>first<li>second</ul><div class="ad">{long}</div><form>{long}</form>
<blockquote>{long}</blockquote></article><section id="comments"><article><p>{long}</p></article></section><div class="cookie-notice">{long}</div><footer>{long}</footer>"""
    clean = long.strip()
    assert main_text(page).split("\n\n") == ["Title & more", clean, "Short <b>. Line", "first", "second", clean]
    assert [main_text(x) for x in (None, "", "<p>", "<!-- a", "<script>a")] == [""] * 5
    assert main_text(f"<p>{long}</div></b><p><i>{long}") == f"{clean}\n\n{clean}"
    # Wrappers with a name of boilerplate in a name of theirs, and quotes where none belong.
    nav, foot = "<nav><a href=/>Home</a></nav>", f"<footer>{long}</footer>"
    for wrapper in ('class="overflow-hidden"', 'class="content with-sidebar"', 'class="has-sidebar"', 'class="ad-free"', 'class="sidebar-right-page"', "title=it's", "class=nav-down data-x=it's", 'class="sidebar-layout"', 'class="sidebar"'):
        for tag in ("div", "main", "section"):
            assert main_text(f"<body>{nav}<{tag} {wrapper}><h1>Title</h1><p>{long}</p><p>{long}</p><p>Short.</p></{tag}>{foot}") == f"Title\n\n{clean}\n\n{clean}\n\nShort."
    assert main_text(f'<body>{nav}<article class="post tags-news"><p>{long}</article>{foot}') == clean
    for beside in ("sidebar", "widget-area", "main-menu", "site-footer", "cookie-notice", "ad", "adBox", "related", "comments", "comment-list", "newsletter-signup", "is-hidden ad-slot", "social-share"):
        assert main_text(f'<article><p>{long}</p><p>{long}</p></article><div class="{beside}"><p>{long}</p></div><p>{long}') in (f"{clean}\n\n{clean}", f"{clean}\n\n{clean}\n\n{clean}")
        assert main_text(f'<article><p>{long}</p><div class="{beside}"><p>{long}</p></div><p>{long}</p></article>') == f"{clean}\n\n{clean}"
    # Comments stay out although they are the longer part.
    assert main_text(f'<article><p>{long}</p></article><div id="comments">{f"<p>{long}</p>" * 9}</div>') == clean
    # Time in proportion to the tags, however they are nested.
    import time

    for deep in ("<div>x", "<b>", "<div>x<b>", "<ul><li>x", "<p><i>x", "<article><div class=ad>x"):
        took = []
        for n in (5_000, 40_000):
            start = time.perf_counter()
            main_text(deep * n + "</b>" * n)
            took.append(time.perf_counter() - start)
        assert took[1] < 40 * took[0] + 1, deep
    rng = random.Random(2)
    for _ in range(60):
        n = 6
        s, t = [rng.choice([0, rng.random() * 4]) for _ in range(n)], [rng.choice([0, rng.random() * 4]) for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(side):
            return sum(t[i] if side[i] else s[i] for i in range(n)) + sum(w for i, j, w in edges if side[i] != side[j])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert cost(source_side(s, t, edges)) == pytest.approx(best)


def test_quality_counts_brute(spark):
    from helixplan.llm.quality import base_counts, js_distance, judge, learn, numbered, words_of
    import numpy as np

    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["a", "b", "c ", " ", "\n", "\t", "#", "\u00a0", "é "]) for _ in range(rng.randrange(60)))
        words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
        lines = text.split("\n")
        dup = sum(1 for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r") and x in lines[:i])
        tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        rep = len({j for i, w in enumerate(tri) if tri.count(w) > 1 for j in range(i, i + 3)})
        assert [w.decode() for w in words_of(text)] == words
        assert base_counts(text, numbered(words_of(text))[1]) == (sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, rep)
    assert js_distance(np.array([1.0, 0]), np.array([[0, 1.0], [1, 0]])).tolist() == [1.0, 0.0]
    words = LOREM.split()
    good = [(i, " ".join(rng.choice(words) for _ in range(120)) + ".", "en") for i in range(40)]
    odd = [(100, " ".join("#$%&"[rng.randrange(4)] * rng.randrange(1, 9) + str(rng.randrange(99)) for k in range(200)), None), (101, None, None), (102, "few words", "en")]
    table = spark.createDataFrame(good + odd, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in judge(table, learn(table)).collect()}
    # The verdict against a plain form of it.
    import math
    import re
    from collections import Counter

    from helixplan.llm.quality import CLASSES, class_counts

    strip = [(t, [low(w.strip(".,;:!?'\"()-")) for w in re.findall(r"[^\x20\x09-\x0D]+", t)]) for _, t, lang in good + odd if t and lang]
    all_words = Counter(w for _, ws in strip for w in ws)
    common = [w for w, _ in sorted(all_words.items(), key=lambda x: (-x[1], x[0].encode()))[:200]]
    classes = sum(class_counts(t) for t, _ in strip).tolist()

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q)]
        return math.sqrt(max(sum(x * math.log2(x / c) for v in (p, q) for x, c in zip(v, m) if x > 0) / 2, 0))

    def bins(count):
        return [count[w] for w in common] + [sum(count.values()) - sum(count[w] for w in common)]

    for i, t, _ in good + odd[:1]:
        ws = Counter(low(w.strip(".,;:!?'\"()-")) for w in t.split())
        chars, apart = distance(class_counts(t).tolist(), classes), distance(bins(ws), bins(all_words))
        assert got[i].js_chars == pytest.approx(chars, abs=1e-9) and got[i].js_words == pytest.approx(apart, abs=1e-9)
        assert got[i].kept == (not got[i].base_failed and chars <= 0.28 and apart <= 0.56)
    assert all(got[i].kept for i, _, _ in good)
    assert not any(got[i].kept for i in (100, 101, 102)) and not got[100].base_failed and got[101].base_failed


def test_toxicity_and_language_held_out(spark):
    from helixplan.llm.language import identify, train as train_language
    from helixplan.llm.toxicity import score_documents, train

    rng = random.Random(6)
    vocabulary = {"xx": [f"w{i}a" for i in range(300)], "yy": [f"öv{i}é" for i in range(300)]}
    rows, labels = [], []
    for i in range(900):
        lang = "xx" if i % 3 else "yy"
        toxic = i % 4 == 0
        words = [rng.choice(vocabulary[lang]) for _ in range(80)]
        if toxic:
            for k in range(6):
                words[rng.randrange(80)] = f"insult{rng.randrange(5)}"
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(None, None, None), (5000, "", None)], "doc_id bigint, text string, lang string")
    marks = spark.createDataFrame(labels + [(None, 1), (5001, None)], "doc_id bigint, toxic int")
    model = train(docs, marks)
    got = {r.doc_id: r.score for r in score_documents(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.98 * len(held)
    assert got[5000] == got[None] == pytest.approx(0.25, abs=0.03)
    found = {r.doc_id: r for r in identify(docs, train_language(docs)).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(found[i].lang_pred == rows[i][2] for i in held)
    assert found[5000].lang_pred == found[None].lang_pred == "und" and found[5000].score == 0


def _kneser_ney(texts, order, discount=0.75):
    """Plain interpolated Kneser-Ney over characters: probability of a character after those before it in its text."""
    from collections import Counter

    streams = [" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) for t in texts]
    counts = []
    for k in range(1, order + 1):
        if k == order:
            counts.append(Counter(s[i : i + k] for s in streams for i in range(len(s) - k + 1)))
        else:
            counts.append(Counter(g[1:] for g in {s[i : i + k + 1] for s in streams for i in range(len(s) - k)}))
    letters = {s[i] for s in streams for i in range(len(s))}

    def prob(before, c):
        k = len(before) + 1
        if k == 1:
            total = sum(counts[0].values())
            gone = sum(min(n, discount) for n in counts[0].values())
            return max(counts[0][c] - discount, 0) / total + gone / total / (len(letters) + 1)
        known = {g: n for g, n in counts[k - 1].items() if g[:-1] == before}
        total = sum(known.values())
        if not total:
            return prob(before[1:], c)
        return max(known.get(before + c, 0) - discount, 0) / total + sum(min(n, discount) for n in known.values()) / total * prob(before[1:], c)

    return prob, letters


def test_language_scores_like_a_plain_model():
    import math

    import numpy as np

    from helixplan.llm import language

    rng = random.Random(8)
    texts = ["".join(rng.choice("abc, ") for _ in range(rng.randrange(1, 40))).strip(" ,") or "a" for _ in range(36)]
    model = language.fit(texts, ["x"] * 36, order=3)
    prob, letters = _kneser_ney([t for i, t in enumerate(texts, 1) if i % 6], 3)
    # After any context the probabilities of all known characters and of one unknown sum to one.
    for before in ("", "a", "ab", " ", "c "):
        unknown = prob(before, "?")
        assert sum(prob(before, c) for c in letters) + unknown == pytest.approx(1)
    for t in ["abc", "a", "cab ba", *texts[:8]]:
        stream = " " + " ".join("".join(c if c.isalpha() else " " for c in t).split())
        want = sum(math.log(prob(stream[max(i - 2, 0) : i], stream[i])) for i in range(len(stream))) / len(stream)
        assert -model.cross_entropy([t])[0][0, 0] == pytest.approx(want, abs=1e-4)


def test_language_depends_on_the_text_alone(monkeypatch):
    import numpy as np

    from helixplan.llm import language

    rng = random.Random(18)
    texts = ["".join(rng.choice("abcdé ,.\n" if i % 2 else "cdefñ ,-") for _ in range(rng.randrange(1, 50))) for i in range(200)]
    model = language.fit(texts, ["xy"[i % 2] for i in range(200)])
    for t in ("ab", "", None, "  a", "b ", " \n"):
        texts.append(t)
    alone = np.concatenate([model.cross_entropy([t])[0] for t in texts])
    order = rng.sample(range(len(texts)), len(texts))
    mixed = model.cross_entropy([texts[i] for i in order])[0]
    assert np.array_equal(mixed, alone[order])
    # Nor does it depend on the pieces that a long text is scored in.
    monkeypatch.setattr(language, "PIECE", 7)
    monkeypatch.setattr(language, "CELLS", 8)
    assert np.array_equal(np.concatenate([model.cross_entropy([t])[0] for t in texts]), alone)


def test_pipeline_keeps_clean(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(240):
        text = [rng.choice(words) for _ in range(100)]
        if i % 6 == 0:
            text[10:14] = ["nasty", "brute", "nasty", "fool"]
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 0))
        labels.append((i, 0, int(i % 6 == 0)))
    rows += [(1000 + i, rows[i][1].upper(), "en", "s0", 0) for i in (1, 2, 3)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == before.columns
    assert not any(i % 6 == 0 for i in seen[0] if i < 240) and len(seen[0]) >= 200
    assert seen[1] == seen[0] - {1, 2, 3} and seen[2] == seen[1]
    assert docs.where("not lossless").isEmpty()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_sources_without_words_take_nothing(spark):
    from helixplan.llm.mixing import cycle_weights, mix, mixed_documents

    docs = spark.createDataFrame([(1, "", "a"), (2, None, "a"), (3, "some words here", "b")], "doc_id bigint, text string, source string")
    taken = {r.doc_id: r.taken for r in mix(docs, cycle_weights()).collect()}
    assert taken[1] == taken[2] == 0 and {r.doc_id for r in mixed_documents(docs, cycle_weights()).collect()} == {3}


def test_toxicity_learns_long_texts_and_few_labels(spark):
    from helixplan.llm.toxicity import score_documents, train

    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    foul = lambda n: " ".join(x for _ in range(n) for x in (rng.choice(words), rng.choice(["nasty", "brute"]), rng.choice(["fool", "swine"])))
    fair = lambda n: " ".join(rng.choice(words) for _ in range(3 * n))
    long = [(i, foul(14000)) for i in range(12)] + [(100 + i, fair(30)) for i in range(60)]
    assert min(len(t) for _, t in long[:12]) > 200_000
    few = [(i, foul(40)) for i in range(5)] + [(100 + i, fair(40)) for i in range(5)]
    for rows in (long, few):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
        labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in rows], "doc_id bigint, toxic int")
        model = train(docs, labels)
        asked = spark.createDataFrame([(k, foul(20) if k < 5 else fair(20)) for k in range(10)], "doc_id bigint, text string")
        scores = {r.doc_id: r.score for r in score_documents(asked, model).collect()}
        assert min(scores[k] for k in range(5)) > max(scores[k] for k in range(5, 10))


def test_html_boilerplate_longer_than_the_article():
    from helixplan.llm.html_text import main_text

    article = "<article><h1>Title</h1>" + "<p>This is the text of the article. It says something of worth.</p>" * 4 + "</article>"
    want = main_text(article)
    assert want.startswith("Title\n\nThis is") and want.count("worth") == 4
    other = "<p>We say much else on this page. Please read it all and agree.</p>" * 28
    for kind in ("sidebar", "cookie-notice", "discussion", "responses", "adslot", "related"):
        assert main_text(f"<body>{article}<div class={kind}>{other}</div>") == want
        assert main_text(f"<body><div class={kind}>{other}</div><main>{article}</main>") == want
    assert main_text(f"<body><form action=x><div id=main>{article}</div><div class=sidebar>{other}</div></form>") == want
    assert main_text(f"<body>{article}<form>{other}</form>") == want
    assert main_text(f"<body><div class=cookie-notice>{other[:64]}</div>") == ""


def test_html_block_texts_brute():
    """Every text of a page of nested blocks without a hint of boilerplate comes out, in page order."""
    from helixplan.llm.html_text import blocks_of

    rng = random.Random(4)

    def page(depth):
        out, told = [], []
        for _ in range(rng.randint(1, 4)):
            if depth and rng.random() < 0.5:
                inner, texts = page(depth - 1)
                tag = rng.choice(["div", "section", "article", "ul", "table"])
                out.append(f"<{tag}>{inner}</{tag}>")
                told += texts
            else:
                words = [f"w{rng.randrange(99)}" for _ in range(rng.randint(1, 6))]
                out.append("<p>" + rng.choice([" ", "\n", " &nbsp; "[0:1]]).join(f"<b>{w}</b>" if rng.random() < 0.3 else w for w in words) + "</p><script>var x = '<p>no</p>';</script>")
                told.append(" ".join(words))
        return "".join(out), told

    for _ in range(200):
        text, told = page(4)
        assert [b.text for b in blocks_of(text)] == told


def test_toxicity_scores_like_a_plain_model(spark):
    import math
    from collections import defaultdict

    from helixplan.llm.toxicity import count, model_of
    from helixplan.plans.runtime import Scratch

    draw = random.Random(5)
    sample = []
    for i in range(120):
        words = [f"w{int(draw.paretovariate(0.7))}" for _ in range(60)]
        if i % 3 == 0:
            words[7:9] = ["bad", draw.choice(["word", "thing"])]
            words[20:23] = [f"insult{draw.choice('abcdefgh')}{i}", "w1", f"insulti{i}"]
        words[30:32] = [f"common{i}", f"insul{i}"] if i % 10 == 1 else words[30:32]
        sample.append((int(i % 3 == 0), " ".join(words)))
    sample += sample[:20] * 3  # copies bring no new contexts
    counts = count(spark.createDataFrame(sample, "y int, text string"), Scratch(spark, "test"))
    weight, floor = 3.0, 0.1
    model = model_of(counts, weight, floor, 0.3)
    # The plain model: sets of contexts and dictionaries.
    pairs, words = [defaultdict(set), defaultdict(set)], [defaultdict(set), defaultdict(set)]
    for y, t in sample:
        at = [None, None, *t.split()]
        for a, b, c in zip(at, at[1:], at[2:]):
            pairs[y][b, c].add(a)
            words[y][c].add(b)
    counted = [{w: len(x) for w, x in words[y].items()} for y in (0, 1)]
    many = [{p: len(x) for p, x in pairs[y].items() if p[0] is not None} for y in (0, 1)]

    def discount(table):
        n1, n2 = (sum(n == k for n in table.values()) for k in (1, 2))
        return max(n1 / max(n1 + 2 * n2, 1), 0.1)

    d1, d2, totals = [discount(x) for x in counted], [discount(x) for x in many], [sum(x.values()) for x in counted]

    begin = [defaultdict(int), defaultdict(int)]
    for y in (0, 1):
        for w, n in counted[y].items():
            for k in (5, 7):
                if len(w) > k:
                    begin[y][w[:k]] += n

    def backed(y, w, table, n, weigh):
        """Likelihood over the shared counts, of a word or a beginning: its own counts, or what it backs off to."""
        up = [w[:k] for k in (5, 7) if len(w) > k and max(begin[0].get(w[:k], 0), begin[1].get(w[:k], 0)) >= 8]
        lift = backed(y, up[-1], begin, lambda s: len(s) == len(up[-1]) and max(begin[0][s], begin[1][s]) >= 8, True) if up else 1.0
        own = [table[k].get(w, 0) if weigh else 0 for k in (0, 1)]
        shared = min(own[k] / totals[k] for k in (0, 1)) + floor * max(d1) / min(totals)
        kept = sum(c - d1[y] for s, c in table[y].items() if c > 1 and n(s))
        more = own[y] - d1[y] if own[y] > 1 else 0
        return more / ((1 + weight) * totals[y] * shared) + (1 - kept / totals[y] + weight) / (1 + weight) * lift

    def logs(y, before, w):
        known = max(counted[k].get(w, 0) for k in (0, 1)) >= 2 or any(n >= 3 for k in (0, 1) for p, n in many[k].items() if p[1] == w)
        one = backed(y, w, counted, lambda s: True, known)
        if before is None or not any(n >= 3 for k in (0, 1) for p, n in many[k].items() if p[0] == before):
            return math.log(one)
        after = [max(sum(n for p, n in many[k].items() if p[0] == before), 1) for k in (0, 1)]
        over = {p[1]: n - d2[y] for p, n in many[y].items() if p[0] == before and n >= 3}
        rest = (1 - sum(over.values()) / after[y] + weight) / (1 + weight)
        pair = [many[k].get((before, w), 0) for k in (0, 1)]
        if max(pair) < 3:
            return math.log(rest * one)
        shared = min(pair[k] / after[k] for k in (0, 1)) + floor * max(max(d, 0.1) for d in d2) / min(after)
        return math.log(over.get(w, 0) / ((1 + weight) * after[y] * shared) + rest * one)

    for _, t in sample[:12] + [(0, "bad word new w1 w2 bad thing insultx insultiy insul insulz commonx common5")]:
        w = t.split()
        want = sum(logs(1, a, b) - logs(0, a, b) for a, b in zip([None, *w], w)) / len(w)
        assert model.evidence([t])[0][0] == pytest.approx(want, abs=1e-9)
    assert list(model.evidence(["", None, "..."])[1]) == [0, 0, 0]


def _similar(a, b, words=5):
    """Exact Jaccard similarity of two texts' shingles."""
    sets = []
    for t in (a, b):
        w = low(t).split()
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_pipeline_drops_near_copies(spark, tmp_path):
    from corpus_pipeline import drop_near_copies
    from helixplan.llm.near_copies import near_copies

    rng = random.Random(12)
    texts = [None, "", " \n", "one two", "one two three"]
    for base in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        texts.append(" ".join(words))
        # One copy on either side of similarity 0.8, and a copy of a copy.
        for changes in (2, 5, 9):
            copy = list(words)
            for at in rng.sample(range(200), changes):
                copy[at] = f"new{base}"
            texts.append(" ".join(copy))
            if changes == 2:
                copy[100] = "again"
                texts.append(" ".join(copy))
    # A crowd about one text, a text at its rim and one that only the rim is near to.
    words = [f"c{i}" for i in range(200)]
    for k in range(20):
        texts.append(" ".join(words[:k] + ["x"] + words[k + 1 :]))
    rim = words[:184] + [f"r{i}" for i in range(16)]
    texts += [" ".join(rim), " ".join([f"s{i}" for i in range(16)] + rim[16:])]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if _similar(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    want = {i for i in range(len(texts)) if find(i) == i}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert 60 < len(want) < len(texts) - 60
    assert {r.doc_id for r in drop_near_copies(spark, docs, str(tmp_path)).collect()} == want
    # Crowded groups are first compared with one of their sets.
    got = {r.doc_id: r.component_id for r in near_copies(docs, crowd=2).collect()}
    assert got == {i: find(i) for i in range(len(texts)) if sum(find(j) == find(i) for j in range(len(texts))) > 1}


def test_pieces_draw_dropout_for_every_occurrence(spark, tmp_path):
    import numpy as np

    from corpus_pipeline import cut_pieces
    from helixplan.llm.pieces import MARK, VOCABULARY, Pieces, encode_documents

    model = open(VOCABULARY, "rb").read()
    pieces = Pieces(model)
    word = MARK + "understanding"
    n = 4000
    whole = pieces.encode(" ".join(["understanding"] * n), "5")
    salts = pieces._salts("5", n)
    each = [pieces.cut(word, int(x)) for x in salts]
    # What is remembered gives each occurrence's own cut.
    assert whole == [i for ids in each for i in ids]
    assert len({tuple(x) for x in each}) > 10
    merges: list = []
    plain = pieces.cut(word, None, merges)
    changed = pieces._changed(np.full(n, pieces.known[word]), salts)
    assert abs(changed.mean() - (1 - 0.9 ** len(merges))) < 0.04
    assert all(x == plain for x, c in zip(each, changed) if not c)
    assert not np.array_equal(salts, pieces._salts("6", n))
    texts = [LOREM, "odd 中中 éé " + "ab" * 60, "\x00 ▁ word"] * 3
    ids, ends = pieces.encode_many(texts, [str(k) for k in range(9)])
    got = [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]
    for k, t in enumerate(texts):
        words = pieces.stretch.findall(MARK + pieces._marked(t))
        assert got[k] == [i for w, x in zip(words, pieces._salts(str(k), len(words))) for i in pieces.cut(w, int(x))]
    docs = spark.createDataFrame([(1, LOREM * 5)] * 3 + [(2, LOREM * 5)], "doc_id bigint, text string").coalesce(1)
    assert len({tuple(r.ids) for r in cut_pieces(spark, docs, str(tmp_path)).collect()}) == 4
    assert len({tuple(r.ids) for r in encode_documents(docs).collect()}) == 2
    # Copies in many partitions or files are cut apart too, the same set of cuts however they lie.
    six = spark.createDataFrame([(1, LOREM * 5)] * 6 + [(None, None), (None, None)], "doc_id bigint, text string")
    cuts = []
    for n in (6, 1):
        six.repartition(n).write.parquet(f"{tmp_path}/six{n}")
        for rows in (spark.read.parquet(f"{tmp_path}/six{n}"), six.repartition(n)):
            cuts.append(sorted(r.ids for r in cut_pieces(spark, rows, str(tmp_path)).collect()))
            assert len({tuple(i) for i in cuts[-1]}) == 7
    assert all(c == cuts[0] for c in cuts)


def test_language_learns_long_documents_and_every_language(spark):
    from helixplan.llm.language import train

    rows = [(i, f"wort{i} und mehr", "aa") for i in range(40)] + [(None, f"null {i}", "bb") for i in range(80)] + [(i, "ñandú " * 60, "cc") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert train(docs, per_lang=10, longest=100).langs == ["aa", "bb", "cc"]


def test_own_names_of_a_table_survive(spark):
    """Columns that bear the operators' inner names come through whole, and results don't change."""
    from helixplan.llm import exact_dedup, mixing, near_copies, pieces, quality, simhash, toxicity

    names = ["__k", "__at", "__b", "__n", "__s", "__text", "__score", "__digest", "__set", "__fp", "row", "id", "k", "text_", "c0", "c1", "n", "score", "y", "l", "w", "t", "salt"]
    rows = [(i % 40, f"word{i % 30} " * (i % 7) + "some more of it", "en", f"s{i % 3}") + tuple(f"{n}{i}" for n in names) for i in range(80)] + [(None,) * (4 + len(names))] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names))
    plain = docs.select("doc_id", "text", "lang", "source")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id bigint, toxic int")
    drops = {
        "exact": exact_dedup.drop_duplicates,
        "mix": lambda d: mixing.mixed_documents(d, mixing.cycle_weights()),
        "near": near_copies.drop_near_copies,
        "simhash": simhash.drop_near_duplicates,
        "toxic": lambda d: toxicity.drop_toxic(d, labels),
    }
    for name, drop in drops.items():
        got, want = drop(docs), drop(plain)
        assert got.columns == docs.columns, name
        kept = got.collect()
        assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, ((r.doc_id, r.text) for r in want.collect()))), name
        assert all(r[n] is None and r.doc_id is None or r[n].startswith(n) for r in kept for n in names), name
    for judge in (lambda d: quality.judge(d, quality.learn(d)), pieces.encode_documents, simhash.near_duplicates):
        assert sorted(map(repr, judge(docs).collect())) == sorted(map(repr, judge(plain).collect()))


def test_very_long_texts(spark):
    """Texts of millions of characters are read whole by every operator of documents."""
    from helixplan.llm import exact_dedup, mixing, near_copies, pieces, quality, simhash
    from helixplan.llm.language import fit

    long = " ".join(f"w{i % 5000}é" for i in range(400_000))
    docs = spark.createDataFrame([(1, long, "en", "a"), (2, long + " end", "en", "a"), (3, "short text", "en", "a")], "doc_id bigint, text string, lang string, source string")
    assert len(long) > 2_000_000
    assert exact_dedup.exact_duplicates(docs).where("group_size = 1").count() == 3
    assert {r.doc_id: r.size for r in mixing.mix(docs, mixing.cycle_weights()).collect()} == {1: 400_000, 2: 400_001, 3: 2}
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == {1, 3}
    assert {r.doc_id: r.n_words for r in quality.judge(docs, quality.learn(docs)).collect()} == {1: 400_000, 2: 400_001, 3: 2}
    assert pieces.encode_documents(docs).where("lossless").count() == 3
    assert len({r.component_id for r in simhash.near_duplicates(docs).collect()}) <= 2
    model = fit([long[:3000], "xyz zyx " * 40] * 6, ["en", "xx"] * 6)
    assert model.predict([long])[0] == ["en"]
