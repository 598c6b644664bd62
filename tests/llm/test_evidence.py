"""Language, urls, benchmark leaks, top-k search, licenses and the pipeline, on planted cases and held-out rows."""

from __future__ import annotations

import random
import re
import textwrap

import numpy as np
import pytest

import corpus_pipeline
from certame.llm import components, decontamination, language, licences, topk, url_filter
from certame.llm.queries import QUERIES
from certame.llm.storage import table
from tests.llm import brute

PAGES = "page_id long, url string, html string"


def test_language_of_held_out_documents(spark, sf_dir):
    """Texts alone, without what the rows declare, fitted on the other half."""
    docs = table(spark, sf_dir, "documents").where("lang is not null and length(text) > 200")
    model = language.train(docs.where("doc_id % 2 = 0"))
    rows = docs.where("doc_id % 2 = 1").selectExpr("doc_id as key", "text", "cast(null as string) as declared", "cast(null as string) as host")
    said = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(rows, model).collect()
    assert np.mean([r.lang == said[r.key] for r in got]) >= 0.9


def test_language_of_pages(spark, sf_dir):
    got = {r.page_id: r for r in QUERIES["op1_language"](spark, sf_dir).collect()}
    pages = table(spark, sf_dir, "pages").collect()
    assert len(got) == len(pages)
    told = [(got[p.page_id].lang, m[1]) for p in pages if (m := re.search(r"://[^/]+/(en|de|fr|es)/", p.url or ""))]
    assert len(told) >= 40 and np.mean([a == b for a, b in told]) >= 0.9


def test_evidence_decides_where_the_text_is_silent(spark, sf_dir):
    model = language.train(table(spark, sf_dir, "documents"))
    rows = [(1, "12345", None, "x.de"), (2, None, "fr", "x.de"), (3, "", None, None), (4, "ab zz", "de-AT", "y.at"), (5, "ab", "xx", "y.zz"), (None, "ab cd", None, None)]
    got = {r.key: r for r in language.identify(spark.createDataFrame([(*r, 7) for r in rows], "key long, text string, declared string, host string, share int"), model).collect()}
    assert len(got) == 6
    assert {k: got[k].lang for k in (1, 2, 3)} == dict.fromkeys((1, 2, 3), "und") and not got[3].accepted
    assert got[4].lang == "de"
    empty = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r.lang for r in language.identify(spark.createDataFrame([(1, "some words", "en", "h")], "key long, text string, declared string, host string"), empty).collect()] == ["und"]
    assert language.identify(spark.createDataFrame([], "key long, text string, declared string, host string"), model).collect() == []


def fused(rows, model):
    """The fusion once more, row by row: likelihoods of text, declared language and suffix, times smoothed priors of domain and host without the row's own share."""
    names = list(model.languages)
    known = [n for n in names if n != language.NONE]

    def chance(said, name, right):
        if said not in known:
            return 0.0
        return np.log(1.0 / (len(names) - 1)) if name == language.NONE else np.log(right) if said == name else np.log((1 - right) / max(len(names) - 2, 1))

    def normal(logs):
        odds = np.exp(np.array(logs) - np.max(logs))
        return odds / odds.sum()

    told = []
    for key, text, declared, host in rows:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        bucket, _ = language.features(raw, np.array([0, len(raw)]))
        log = model.table[bucket].sum(axis=0) * (min(len(bucket), language.TEXT_WEIGHT) / max(len(bucket), 1))
        last = re.search(r"\.([A-Za-z]+)$", host or "")
        own = [log[k] + chance((declared or "").strip().lower()[:2], n, language.DECLARED_RIGHT) + chance(language.SUFFIXES.get(last[1].lower()) if last else None, n, language.SUFFIX_RIGHT) for k, n in enumerate(names)]
        told.append((key, host or "", ".".join((host or "").split(".")[-2:]), np.array(own), normal(own), len(bucket)))
    everywhere = sum((t[4] for t in told), np.zeros(len(names))) + 1.0
    everywhere /= everywhere.sum()
    out = []
    for key, host, domain, own, share, n in told:
        def prior(sums, strength, above, share=share):
            return (np.maximum(sums - share, 0) + strength * above) / (max(sums.sum() - 1, 0) + strength)

        at_domain = prior(sum(t[4] for t in told if t[2] == domain), language.DOMAIN_STRENGTH, everywhere)
        post = normal(own + np.log(prior(sum(t[4] for t in told if t[1] == host), language.HOST_STRENGTH, at_domain)))
        lang, sure = (names[int(np.argmax(post))], float(post.max())) if n else (language.NONE, 0.0)
        out.append((key, lang, sure, lang != language.NONE and sure >= language.ACCEPT))
    return out


def test_fusion_against_plain_python(spark, sf_dir):
    rng = random.Random(6)
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs)
    texts = [r.text for r in docs.where("length(text) > 100").orderBy("doc_id").limit(40).collect()]
    hosts = ["a.x.de", "b.x.de", "x.de", "n.example.com", "m.example.com", "z.fr", "z.fr", "plain", "", None]
    rows = [(k, rng.choice([None, "", "12 34", *[t[a : a + rng.choice([8, 20, 60])] for t in rng.choices(texts, k=9) for a in (rng.randint(0, 80),)]]), rng.choice([None, "en", " DE-at", "xx", "fr", ""]), rng.choice(hosts)) for k in range(250)]
    rows += [(900, texts[0], "de", "a.x.de")] * 3 + [(901, "the " * 40000, None, "n.example.com"), (None, texts[1], None, "z.fr")]
    got = language.identify(spark.createDataFrame([(*r, 1, "y") for r in rows], "key long, text string, declared string, host string, share int, own string"), model).collect()
    order = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    mine = sorted([(r.key, r.lang, r.confidence, r.accepted) for r in got], key=order)
    want = sorted(fused(rows, model), key=order)
    assert [(m[0], m[1], m[3]) for m in mine] == [(w[0], w[1], w[3]) for w in want]
    assert np.allclose([m[2] for m in mine], [w[2] for w in want], atol=1e-9)


def test_rules_of_pages(spark, sf_dir):
    rules = [(r.verdict, r.host, r.path) for r in url_filter.RULES]
    pages = {p.page_id: p.url for p in table(spark, sf_dir, "pages").collect()}
    got = QUERIES["op2_url_filter"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        url = pages[r.page_id]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (m[1].translate(brute.LOWER), m[2]) if m else ("", "")
        fits = sorted(((h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: -len(x[0]))
        assert (r.host, r.path, r.rule) == (host, path, fits[0][0] if fits else None)
        assert r.verdict == (fits[0][1] if fits else r.verdict) and r.verdict in ("allow", "block")


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">x</a>' for h in hosts)
    rows = [
        (1, "http://good.net/de/1", link("friend.io", "friend.io")), (2, "HTTP://A.FRIEND.io/", None), (3, "http://friend.io/a?b#c", link("last.io")), (4, "http://bad.com/en/1", ""),
        (5, "http://points.io/", link("bad.com")), (6, "http://last.io", ""), (7, None, link("bad.com")), (8, "no address", "x"), (9, "http://example.com/en/77", ""), (9, "http://example.com/en/77", ""), (None, "http://x.org/es/", None),
    ]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame([(*r, 1, "k") for r in rows], PAGES + ", n int, kind string")).collect()}
    assert {k: got[k].verdict for k in got} == {1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", None: "block"}
    assert got[1].trust > got[3].trust > got[6].trust > 0 and got[5].distrust > 0 and got[2].host == "a.friend.io"
    assert (got[7].host, got[7].path, got[8].host) == ("", "", "")
    assert url_filter.judge(spark.createDataFrame([], PAGES)).collect() == []


def solved(w: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Personalised PageRank as a linear system."""
    return 0.15 * np.linalg.solve(np.eye(len(w)) - 0.85 * w.T, start)


def test_spread_is_personalised_pagerank(spark):
    """With the operator's own parameters: on a random graph, and on a ring, which is slow to settle."""
    rng = random.Random(8)
    n = 8
    w = np.array([[rng.random() if i != j and rng.random() < 0.3 else 0.0 for j in range(n)] for i in range(n)])
    out = w.sum(axis=1, keepdims=True)
    w = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    ring = np.roll(np.eye(n), 1, axis=1)
    kinds = {"k": w, "r": ring}
    edges = spark.createDataFrame([(k, str(i), str(j), float(m[i, j])) for k, m in kinds.items() for i in range(n) for j in range(n) if m[i, j]], "kind string, a string, b string, w double")
    seeds = spark.createDataFrame([(k, node, s) for k in kinds for node, s in (("0", 0.75), ("3", 0.25))], "kind string, node string, s double")
    start = np.zeros(n)
    start[0], start[3] = 0.75, 0.25
    got = {(r.kind, int(r.node)): r.s for r in url_filter.spread(edges, seeds).collect()}
    for k, m in kinds.items():
        assert [got.get((k, i), 0.0) for i in range(n)] == pytest.approx(solved(m, start).tolist(), abs=1e-6)
    with pytest.raises(RuntimeError, match="did not settle"):
        url_filter.spread(edges, seeds, most=8)


def test_verdicts_over_links_between_hosts(spark):
    """judge() over pages that link across hosts, against a linear solver; far more pages are blocked than allowed."""
    rng = random.Random(21)
    hosts = [f"h{k}.{'net' if k < 4 else 'com' if k < 10 else 'io'}" for k in range(30)]
    rows = []
    for k, h in enumerate(hosts):
        for n in range(rng.randint(1, 6) * (5 if 4 <= k < 10 else 1)):
            path = "/de/" if k < 4 else "/en/" if k < 10 else "/x/"
            to = [rng.choice(hosts) for _ in range(rng.randint(0, 3))]
            rows.append((len(rows), f"https://{h}{path}{n}", "".join(f'<a href="//{t.upper()}/p">t</a>' for t in to)))
    n = len(hosts)
    links, seeds = np.zeros((n, n)), {"allow": np.zeros(n), "block": np.zeros(n)}
    for _, url, html in rows:
        a = hosts.index(re.match(r"https://([^/]+)", url)[1])
        for t in re.findall(r'"//([^/]+)/', html):
            b = hosts.index(t.lower())
            links[a, b] += a != b
        if a < 10:
            seeds["allow" if a < 4 else "block"][a] += 1
    share = lambda m: np.divide(m, m.sum(axis=1, keepdims=True), out=np.zeros_like(m), where=m.sum(axis=1, keepdims=True) > 0)
    trust = solved(share(links), seeds["allow"] / seeds["allow"].sum())
    distrust = solved(share(links.T), seeds["block"] / seeds["block"].sum())
    verdicts = set()
    for r in url_filter.judge(spark.createDataFrame(rows, PAGES)).collect():
        k = hosts.index(r.host)
        assert (r.trust, r.distrust) == pytest.approx((trust[k], distrust[k]), abs=1e-6)
        if k >= 10:
            verdicts.add(r.verdict)
            assert r.verdict == ("block" if distrust[k] > trust[k] else "allow")
    assert verdicts == {"allow", "block"}


def test_leaks_of_documents(spark, sf_dir):
    """Documents that hold an item's whole text are found, and nearly nothing else is."""
    docs = table(spark, sf_dir, "documents").collect()
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in table(spark, sf_dir, "benchmark").collect()]
    leak = {d.doc_id for d in docs if any(i in " ".join(re.findall(r"\w+", (d.text or "").lower())) for i in items)}
    got = {r.doc_id: r.contaminated for r in QUERIES["op4_decontamination"](spark, sf_dir).collect()}
    assert set(got) == {d.doc_id for d in docs}
    found = {d for d, c in got.items() if c}
    assert leak <= found and len(found - leak) <= max(2, 0.02 * len(docs))


def test_paraphrases_need_the_answer(spark):
    rng = random.Random(6)
    noise = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    question = "which river crosses the old stone bridge near the northern harbour before it meets the wide grey sea"
    answer = "it is the silver alder river"
    item = f"{question}. {answer}"
    words = item.replace(".", "").split()
    changed = " ".join(w for k, w in enumerate(words) if k % 5 != 2 or k > len(words) - 7)
    rows = [(1, f"{noise(200)} {item} {noise(200)}"), (2, f"{noise(50)} {changed} {noise(50)}"), (3, noise(300)), (4, None), (5, ""), (6, item.upper()), (7, " ".join(words[:6]) + noise(60)), (8, f"{noise(9000)} {item}"), (6, item.upper())]
    rows += [(100 + k, noise(120)) for k in range(40)]
    benchmark = spark.createDataFrame([(1, item, 3), (2, noise(30), 4), (3, None, 5), (None, item, 6), (4, "", 7)], "item_id long, text string, cosine int")
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, lcs double")
    got = [(r.doc_id, r.contaminated, r.item_id) for r in decontamination.contamination(docs, benchmark).collect()]
    assert len(got) == len(rows)
    assert {d for d, c, _ in got if c} == {1, 2, 6, 8} and all(i == 1 for _, c, i in got if c)
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontamination.contamination(docs, none).collect())
    assert decontamination.contamination(docs.limit(0), benchmark).collect() == []


def test_an_item_in_a_third_of_all_rows_is_found(spark):
    """And one in every row; the leaks stand among words that are rare."""
    rng = random.Random(12)
    noise = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    often, always = (" ".join(f"{c}{k}" for k in range(18)) for c in "ab")
    benchmark = spark.createDataFrame([(1, often), (2, noise(30))], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{noise(60)} {often if k % 3 == 0 else noise(18)} {noise(60)}") for k in range(90)], "doc_id long, text string")
    got = {r.doc_id for r in decontamination.contamination(docs, benchmark).collect() if r.contaminated and r.item_id == 1}
    assert got == set(range(0, 90, 3))
    docs = spark.createDataFrame([(k, f"{noise(60)} {always} {noise(60)}") for k in range(60)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, always), (2, noise(30))], "item_id long, text string")
    assert all(r.contaminated and r.item_id == 1 for r in decontamination.contamination(docs, benchmark).collect())


def test_a_denser_stretch_does_not_hide_a_leak(spark):
    """The item's words in another order, beside a leak that is parted by other words."""
    rng = random.Random(13)
    noise = lambda n: [f"w{rng.randint(0, 4000)}" for _ in range(n)]
    item = [f"k{n}" for n in range(32)]
    parted = [x for k, w in enumerate(item) for x in ((w, *noise(1)) if k % 2 else (w,))]
    rows = [(1, [*item[::-1], *noise(200), *parted]), (2, [*item[::-1], *noise(248)])] + [(10 + k, noise(150)) for k in range(40)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(noise(30)))], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contamination(docs, benchmark).collect() if r.contaminated} == {(1, 1)}


def test_latent_space_holds_every_item(spark):
    """With more items than the space once had dimensions, and with pieces of long ones, each piece lies wholly in it."""
    rng = random.Random(14)
    noise = lambda n: " ".join(f"w{rng.randint(0, 1500)}" for _ in range(n))
    items = [(k, noise(rng.randint(15, 59)), None) for k in range(200)] + [(200 + k, noise(100 + 100 * k), None) for k in range(2)]
    index = decontamination.build_index(spark, items, np.ones(decontamination.DF_BUCKETS))
    for k in range(200):
        words = index.words[k]
        v = index.latent[np.searchsorted(index.vocabulary, words)].sum(axis=0)
        n = np.unique(words, return_counts=True)[1]
        assert np.linalg.norm(v) == pytest.approx(np.linalg.norm(n), rel=1e-3)
    assert np.bincount(index.owners).tolist()[198:] == [1, 1, 4, 7]


def test_long_items_are_found(spark):
    """Paraphrases of items of 100 to 1,000 words, and every item of blocks that are cut by their pieces."""
    rng = random.Random(15)
    noise = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    items = [(k, noise(n)) for k, n in enumerate((100, 300, 600, 1000))]
    told = [w if k % 10 < 7 or k > len(own) - 10 else f"x{rng.randint(0, 3000)}" for _, own in items for k, w in enumerate(own)]
    rows, at = [], 0
    for i, own in items:
        rows.append((i, " ".join([*noise(80), *told[at : at + len(own)], *noise(80)])))
        at += len(own)
    rows += [(100 + k, " ".join(noise(200))) for k in range(40)]
    benchmark = spark.createDataFrame([(i, " ".join(own)) for i, own in items], "item_id long, text string")
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert {(r.doc_id, r.item_id) for r in got.collect() if r.contaminated} == {(i, i) for i, _ in items}
    blocks = decontamination.blocks_of([(i, " ".join(own), None) for i, own in items], 24)
    assert [[i for i, _, _ in b] for b in blocks] == [[0, 1], [2], [3]]


def test_blocks_of_items_agree_with_one(spark, monkeypatch, sf_dir):
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    one = {r.doc_id: r.contaminated for r in decontamination.contamination(docs, bench).collect()}
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 8)
    many = {r.doc_id: r.contaminated for r in decontamination.contamination(docs, bench).collect()}
    assert set(one) == set(many) and np.mean([one[d] == many[d] for d in one]) >= 0.99


def test_rows_keep_their_identity_over_blocks(spark, monkeypatch):
    """Null and repeated ids, and more items than a block holds: a row for each row."""
    rng = random.Random(23)
    noise = lambda n: " ".join(f"w{rng.randint(0, 4000)}" for _ in range(n))
    items = [(k, noise(12)) for k in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = [(None, noise(30)), (None, f"{noise(30)} {items[39][1]}"), (7, items[3][1]), (7, noise(20)), (8, None)]
    monkeypatch.setattr(decontamination, "BLOCK_ITEMS", 16)
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert sorted(((r.doc_id or 0, r.contaminated, r.item_id if r.contaminated else None) for r in got), key=str) == sorted([(0, False, None), (0, True, 39), (7, True, 3), (7, False, None), (8, False, None)], key=str)


def test_paraphrases_are_recalled(spark):
    """100 planted ones that keep three quarters of an item's words in order, and its last sentence; and as many texts without."""
    rng = random.Random(24)
    noise = lambda n: [f"w{rng.randint(0, 5000)}" for _ in range(n)]
    items, rows = [], []
    for k in range(100):
        question, answer = noise(rng.randint(16, 40)), noise(6)
        items.append((k, f"{' '.join(question)}. {' '.join(answer)}"))
        told = [w if rng.random() < 0.75 else f"x{rng.randint(0, 5000)}" for w in question]
        rows += [(k, " ".join([*noise(60), *told, *answer, *noise(60)])), (1000 + k, " ".join(noise(150)))]
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sum(r.contaminated and r.item_id == r.doc_id for r in got) >= 90
    assert not any(r.contaminated for r in got if r.doc_id >= 1000)


def test_common_subsequence():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontamination.common_subsequence(np.array(a, np.int64), np.array(b, np.int64)) == best[-1][-1]


def test_common_subsequences_at_once(spark):
    rng = random.Random(17)
    items = [(k, " ".join(f"v{rng.randint(0, 30)}" for _ in range(n)), None) for k, n in enumerate((1, 5, 40, 63, 64, 65, 90))]
    index = decontamination.build_index(spark, items, np.ones(decontamination.DF_BUCKETS))
    words = decontamination._hash_text(" ".join(f"v{rng.randint(0, 40)}" for _ in range(500)))
    found = [(lo, min(500, lo + rng.randint(1, 200)), rng.randrange(len(items))) for lo in (rng.randrange(490) for _ in range(200))]
    lo, hi, item = (np.array(x) for x in zip(*found, strict=True))
    got = decontamination.common_subsequences(words, decontamination._places(words, index), lo, hi, item, index)
    assert got.tolist() == [decontamination.common_subsequence(index.words[k], words[a:b]) for a, b, k in found]


def test_randomised_svd_finds_the_space(spark):
    rng = np.random.default_rng(0)
    a = rng.standard_normal((40, 5)) @ rng.standard_normal((5, 30))
    rows = spark.createDataFrame([(list(range(30)), r.tolist()) for r in a], "terms array<int>, weights array<double>")
    basis, values = decontamination.randomised_svd(rows, 30, 5)
    assert values == pytest.approx(np.linalg.svd(a)[1][:5], rel=1e-6)
    assert np.abs(a - a @ basis @ basis.T).max() < 1e-6


def test_top_search_of_edge_cases(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1 / 64, 0.99]) for _ in range(4)]) for i in range(130)]
    rows += [(140, None), (160, [0.1, None, 0.2, 0.3]), (180, [float("nan"), 0.0, 0.0, 0.0]), (200, [float("inf"), 0.0, 0.0, 0.0]), (220, [0.0, 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, v string, rank int")
    vectors = topk.scaled(frame)
    for block in (topk.CANDIDATE_BLOCK, 16):
        found = topk.exact_top(vectors, vectors.where("vec_id % 20 = 0"), candidate_block=block, query_block=3)
        assert {(r.query_id, r.rank, r.vec_id, int(r.score)) for r in found.collect()} == brute.top_scores([(i, None if v is None else [np.float32(x) if x is not None else None for x in v]) for i, v in rows])
    few = topk.scaled(frame.where("vec_id < 5"))
    assert len(topk.exact_top(few, few.where("vec_id % 20 = 0")).collect()) == 4
    assert topk.exact_top(few.limit(0), few.limit(0)).collect() == []


def test_top_search_of_large_numbers(spark):
    """Products beyond what doubles tell apart, and beyond long."""
    rng = random.Random(19)
    big = [(i, [float(rng.choice([2**40, -(2**40), 2**30, 3]) + rng.randint(0, 9)) for _ in range(3)]) for i in range(60)]
    vectors = spark.createDataFrame(big, "vec_id long, v array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.whole) for r in topk.exact_top(vectors, vectors.where("vec_id % 20 = 0"), candidate_block=16).collect()}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (0, 20, 40):
        dot = {i: sum(int(a) * int(b) for a, b in zip(big[q][1], v, strict=True)) for i, v in big if i != q}
        own = sorted((r for r in got if r[0] == q), key=lambda r: r[1])
        assert [r[3] for r in own] == [clip(x) for x in sorted(dot.values(), reverse=True)[:20]]
        assert all(r[3] == clip(dot[r[2]]) for r in own)
    huge = spark.createDataFrame([(i, [1e10, 3e38 * (i % 3 - 1), 0.5]) for i in range(0, 60, 10)], "vec_id long, embedding array<float>")
    rows = topk.exact_top(topk.scaled(huge), topk.scaled(huge).where("vec_id % 20 = 0")).collect()
    assert len(rows) == 15 and max(r.whole for r in rows) == 2**63 - 1 and min(r.whole for r in rows) == -(2**63)


def test_top_search_of_repeated_rows_and_lengths(spark):
    """Each row of a vec_id is a candidate; which length counts does not hang on blocks."""
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [2.0, 1.0]), (20, [1.0, 1.0]), (20, [3.0, 3.0]), (3, [9.0]), (4, [9.0]), (5, [9.0, 9.0, 9.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<double>")
    for block in (1, 2, 100):
        found = topk.exact_top(vectors, vectors.where("vec_id = 20"), candidate_block=block)
        assert sorted((r.rank, r.vec_id, r.whole) for r in found.collect()) == [(1, 1, 3), (2, 1, 3), (3, 2, 3)]


def test_licenses(spark):
    mit, apache = licences.TEMPLATES["MIT"][1], licences.TEMPLATES["Apache-2.0"][1]
    rows = [
        (1, f"code\n\n{mit}\n\nmore"), (2, "x\n" + apache.replace(" the ", "\nthe ")), (3, "Licensed under CC BY-NC 4.0."), (4, "Licensed under CC BY 4.0."), (5, "Nothing here."), (6, None), (7, ""), (8, "All copyright stays with the town council of the city."),
        (9, "This work is licensed under the GNU General Public License, version 3."), (10, "This work is licensed under the GNU General Public License, version 2."), (11, "word " * 60_000 + "\n" + mit), (None, mit), (1, f"code\n\n{mit}\n\nmore"),
    ]
    got = licences.license_blocks(spark.createDataFrame([(*r, 1, "l") for r in rows], "doc_id long, text string, block int, license string")).collect()
    named = {(r.doc_id, r.license) for r in got if r.confirmed}
    assert named == {(1, "MIT"), (2, "Apache-2.0"), (3, "CC-BY-NC-4.0"), (4, "CC-BY-4.0"), (9, "GPL-3.0"), (10, "GPL-2.0"), (11, "MIT"), (None, "MIT")}
    assert sum(r.doc_id == 1 for r in got) == 2 and not any(r.confirmed for r in got if r.doc_id == 8)
    text = dict(rows[:5])
    assert all(text[r.doc_id][r.start : r.end].strip() for r in got if r.doc_id in text)
    assert licences.license_blocks(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licenses_beside_prose_and_each_other():
    mit, apache = licences.TEMPLATES["MIT"], licences.TEMPLATES["Apache-2.0"]
    prose = "the town council met by the river and spoke of roads and of the harbour "
    of = lambda text: [(r[3], text[r[1] : r[2]]) for r in licences.scan(text) if r[-1]]
    for n in (1, 5, 30, 300):
        for notice, name in ((apache[0], "Apache-2.0"), (mit[1], "MIT"), (apache[1], "Apache-2.0")):
            assert [x for x, _ in of(f"{prose * n}{notice} {prose * n}")] == [name]
    assert [x for x, _ in of("\n".join(f"Copyright {1990 + k} some holder" for k in range(10)) + "\n" + apache[0])] == ["Apache-2.0"]
    for a, b in ((mit[0], apache[0]), (mit[1], apache[1])):
        assert [x for x, _ in of(f"{a}\n{b}")] == ["MIT", "Apache-2.0"]
        assert [x for x, _ in of(f"{a} {b}")] == ["MIT", "Apache-2.0"]
    assert [x for x, _ in of(f"{apache[0]} {prose * 9}{apache[0]}")] == ["Apache-2.0"] * 2


def canonical():
    """License files and headers as they are found: a title, a holder, paragraphs of lines."""
    full = {name: max(texts, key=len) for name, texts in licences.TEMPLATES.items()}
    parts = {
        "MIT": [licences.MIT.split(" The above")[0], "The above" + licences.MIT.split(" The above")[1], licences.AS_IS_MIT], "ISC": [licences.ISC, licences.AS_IS_ISC],
        "BSD-2-Clause": [*re.split(r" (?=\d\. )", licences.BSD_2), licences.AS_IS_BSD], "BSD-3-Clause": [*re.split(r" (?=\d\. )", licences.BSD_3), licences.AS_IS_BSD], "Zlib": re.split(r" (?=\d\. |Permission)", full["Zlib"]),
        **{name: re.split(r"(?<=\.) (?=This |If |Unless )", full[name]) for name in ("Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0")},
    }
    return {name: "\n\n".join(textwrap.fill(p, 78) for p in own) for name, own in parts.items()}


@pytest.mark.parametrize("name", sorted(canonical()))
def test_canonical_licenses(name):
    """Each is one block, confirmed by its own name, alone, under a title and a holder of some year, and as a comment above code."""
    text = canonical()[name]
    for head in ("", f"{name} License\n\nCopyright (c) 2019-2024, A. Holder <a@example.org>\nAll rights reserved.\n\n"):
        for file in (head + text, "/*\n" + "".join(f" * {line}\n" for line in (head + text).split("\n")) + " */\nint main(void) { return 0; }\n"):
            assert [(r[3], r[-1]) for r in licences.scan(file)] == [(name, True)]


@pytest.mark.parametrize("name", sorted(licences.TEMPLATES))
def test_spdx_lines(name):
    assert [(r[3], r[-1]) for r in licences.scan(f"// SPDX-License-Identifier: {name}\nimport x\n")] == [(name, True)]


def test_licenses_of_documents(spark, sf_dir):
    """Every document with a line of the usual wordings is found, by the right name."""
    docs = {r.doc_id: r.text or "" for r in table(spark, sf_dir, "documents").collect()}
    lines = {name: [t for t in texts if len(t) < 120] for name, texts in licences.TEMPLATES.items()}
    want = {(d, name) for d, text in docs.items() for name, own in lines.items() for t in own if t in text}
    got = {(r.doc_id, r.license) for r in QUERIES["op9_licenses"](spark, sf_dir).collect() if r.confirmed}
    assert want <= got


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 250)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 250: 200, 300: 200}


def test_pipeline_stages(spark, sf_dir):
    """Each stage on what the one before kept, held against brute force."""
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), None if name == "packing" else docs.schema)
        kept.append((name, docs.collect(), docs.columns))
    assert [k[0] for k in kept] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
    assert all(k[2] == columns for k in kept[:-1])
    by = {name: {r.doc_id: r.text for r in rows} for name, rows, _ in kept[:-1]}
    whole = {r.doc_id: r for r in table(spark, sf_dir, "documents").collect()}
    gone = [whole[d] for d in whole if d not in by["language_id"]]
    assert len(gone) <= 0.03 * len(whole) and not any(len(re.findall(r"[^\W\d_]{3,}", r.text or "")) > 40 and r.lang for r in gone)
    near = brute.near_duplicates(list(by["language_id"].items()))
    assert set(by["near_dedup"]) == {d for d, x in near.items() if x[2]}
    cut = brute.suffix_dedup(list(by["near_dedup"].items()))
    assert set(by["suffix_dedup"]) == set(by["near_dedup"])
    assert all(by["suffix_dedup"][d] == by["near_dedup"][d] for d, x in cut.items() if not x[1])
    assert all(abs(len((by["suffix_dedup"][d] or "").encode()) - (x[0] - x[1])) <= 3 * x[2] for d, x in cut.items())
    assert set(by["decontamination"]) <= set(by["suffix_dedup"])
    assert {r.doc_id for r in kept[-1][1]} == set(by["decontamination"])


def test_pipeline_of_no_and_odd_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = spark.createDataFrame([(None, "some text", "en", "s", 9), (1, None, "en", None, None), (2, "", None, "s", 0), (3, "the same text of many words in this language and so on", "en", "s", 1), (3, "the same text of many words in this language and so on", "en", "s", 1)], docs.schema)
    for rows in (docs.limit(0), odd):
        now = rows
        for name, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, sf_dir)
            if name != "packing":
                now = spark.createDataFrame(now.collect(), docs.schema)
        assert {r.doc_id for r in now.collect()} <= {1, 2, 3}
