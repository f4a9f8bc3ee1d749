"""Small tests of the ten operators: brute force, round trips, and rows that nothing should trip over."""

import collections
import glob
import hashlib
import html
import math
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from lectern.llm import embeddings, graph, html_wrapper, jaccard, line_chunks, mixing, pii, quality, sentencepiece_bpe, simhash, substrings
from lectern.llm import textvec as tv
from lectern.llm.queries import ORACLE_SQL, QUERIES

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, "x y z é w"), (None, "a b c d e f g h"), (7, "one"), (7, "one"), (8, "word " * 30000)]


def words(text):
    return [w.decode("utf-8") for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8"))]


def frame(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:  # columns whose names the operators use themselves
        for name in ("ids", "n_words", "n_removed", "kept_text", "score", "keep", "h", "n", "kind", "copy", "range", "rep", "n_lines", "toxic"):
            df = df.withColumn(name, F.lit("mine"))
    return df


def corpus(n=300, seed=1):
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for i in range(n):
        body = [rng.choice(vocabulary) for _ in range(rng.choice([0, 2, 5, 25, 60, 120]))]
        if i % 5 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage[rng.randrange(20) :][: rng.choice([19, 20, 21, 40])]
        if i % 7 == 0 and out:
            body = out[rng.randrange(len(out))][1].split()
            for _ in range(rng.choice([0, 1, 2, 6])):
                if body:
                    body[rng.randrange(len(body))] = rng.choice(vocabulary)
        out.append((i, "".join(w + rng.choice([" ", " ", "\n", "\t "]) for w in body)))
    return out


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = QUERIES[name](spark, sf)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    order = [got.columns.index(c) for c in columns]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(repr(tuple(r[i] for i in order)) for r in got.collect()) == sorted(map(repr, cursor.fetchall()))


# --- 1 ---


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_encoding_and_decoding_equal_the_library(model):
    coder = sentencepiece_bpe.PieceCoder(model)
    rng = random.Random(2)
    texts = ["", " ", "  a  b ", " " * 5000, "a" * 3000, "▁a ▁▁b", "<s><0x41>", "line\nline\x00", "🙂漢字ß", "the" * 2000]
    texts += ["".join(rng.choice("ab  ▁▁\n\téß漢🙂the in on1239<>.,'erinǵ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for text in texts:
        ids = coder.library.encode(text)
        assert coder.encode(text) == ids
        assert coder.decode(ids) == coder.library.decode(ids)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 13, 35, 259, rng.randrange(32000), rng.randrange(3, 259)]) for _ in range(rng.randrange(8))]
        assert coder.decode(ids) == coder.library.decode(ids)


def test_encode_odd_rows(spark, model):
    df = sentencepiece_bpe.encode(frame(spark), model)
    rows = sentencepiece_bpe.decode(df, model).collect()
    library = sentencepiece_bpe.PieceCoder(model).library
    assert len(rows) == len(ODD) and rows[0]["kind"] == "mine"
    for r in rows:
        assert list(r["ids"]) == library.encode(r["text"] or "") and r["decoded"] == library.decode(list(r["ids"]))
    assert sentencepiece_bpe.encode(frame(spark).limit(0), model).count() == 0


# --- 2 ---


def test_simhash_against_brute_force(spark):
    rows = corpus(60) + [(100, ""), (101, None), (102, "🙂é")]
    got = {r["doc_id"]: r for r in simhash.compare_edited(frame(spark, rows)).collect()}
    ordered = sorted((i, t or "") for i, t in rows)
    for at, (i, text) in enumerate(ordered):
        other = ordered[(at + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert got[i]["n_chars"] == len(text)
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        near = 1 - bin(int(got[i]["fingerprint"], 16) ^ int(got[ordered[(at + 1) % len(ordered)][0]]["fingerprint"], 16)).count("1") / 128
        assert got[i]["near_next"] == pytest.approx(near)
        if edited == text:
            assert got[i]["near_edited"] == 1.0 and got[i]["fingerprint"] == got[i]["edited_fingerprint"]
    assert simhash.compare_edited(frame(spark)).count() == len(ODD) - 1
    assert simhash.compare_edited(frame(spark).limit(0)).count() == 0


def test_fingerprint_votes(spark):
    text = "alpha beta beta gamma Alpha"
    rows = spark.createDataFrame([(1, text), (2, "")], "k long, t string")
    got = {r["k"]: (r["high"], r["low"]) for r in simhash.fingerprints(rows, ["k"], "t").collect()}
    terms = [("alpha", 4), ("beta", 4), ("gamma", 4)]
    hashes = spark.createDataFrame(terms, "t string, w int").select("w", *[F.xxhash64(F.lit(s), "t").alias(f"h{i}") for i, s in enumerate(simhash.SEEDS)]).collect()
    for half in (0, 1):
        bits = 0
        for b in range(64):
            votes = sum(r["w"] * (1 if r[f"h{half}"] >> b & 1 else -1) for r in hashes)
            bits |= (votes > 0) << b
        assert got[1][half] % 2**64 == bits
    assert got[2] == (0, 0)


def test_proportions_count_and_the_query_has_near_fingerprints(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in corpus(60) if t.strip()]
    base = [f"term{rng.randrange(900)}" for _ in range(900)]
    for i in range(6):
        body = base[:]
        body[rng.randrange(900)] = f"new{i}"
        rows.append((500 + i, " ".join(body)))
    rows += [(600, "alpha " * 30 + "beta gamma delta"), (601, "alpha beta " + "gamma delta " * 30)]
    got = {r["doc_id"]: r for r in simhash.compare_edited(frame(spark, rows)).collect()}
    prints = {int(r["fingerprint"], 16) for r in got.values()}
    for r in got.values():
        p = int(r["fingerprint"], 16)
        assert r["n_near"] == sum(0 < bin(p ^ q).count("1") <= 3 for q in prints)
    assert any(r["n_near"] for r in got.values()) and got[600]["fingerprint"] != got[601]["fingerprint"]


@pytest.mark.parametrize("crowd,part", [(1024, 512), (2, 3)])
def test_block_tables_find_all_near_fingerprints(spark, crowd, part, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "PART", part)
    rng = random.Random(4)
    base = [rng.getrandbits(128) for _ in range(40)]
    prints = set(base)
    for b in base[:20]:
        for n in (1, 2, 3, 4):
            x = b
            for bit in rng.sample(range(128), n):
                x ^= 1 << bit
            prints.add(x)
    for n in range(60):  # many that differ in a few bits here and there
        prints.add(base[30] ^ 1 << rng.randrange(128) ^ 1 << rng.randrange(128))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    rows = [(signed(p >> 64), signed(p & (2**64 - 1))) for p in prints]
    got = simhash.near_fingerprints(spark.createDataFrame([*rows, rows[0], (None, 1)], "high long, low long"), 3).collect()
    found = {frozenset(((r["high_a"] % 2**64 << 64) + r["low_a"] % 2**64, (r["high_b"] % 2**64 << 64) + r["low_b"] % 2**64)) for r in got}
    listed = list(prints)
    want = {frozenset((a, b)) for i, a in enumerate(listed) for b in listed[:i] if bin(a ^ b).count("1") <= 3}
    assert found == want and len(got) == len(want)


# --- 3 ---


def test_near_vectors_odd_rows_and_recall(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 16))
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 20] + 0.08 * rng.standard_normal(16)).tolist(), int(i % 20 % 3)) for i in range(200)]
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] * 16, 1), (403, [None] * 16, 1), (404, base[0].tolist(), None), (405, [1.0, 2.0], 0), (406, base[0].tolist(), 0), (407, [], 0), (408, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("mine")).withColumn("pivot", F.lit(1))
    got = {r["vec_id"]: r for r in embeddings.near_vectors(df).collect()}
    ok = [(i, np.array(v), l) for i, v, l in rows if l is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = collections.defaultdict(set)
    for i, v, l in ok:
        for j, w, m in ok:
            if i != j and l == m and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i].add(j)
    total = sum(map(len, links.values()))
    assert len(got) == len(rows)
    assert sum(r["n_links"] for r in got.values()) >= 0.9 * total and total
    assert all(got[i]["n_links"] <= len(links[i]) for i in got)
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in got)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_very_large_and_very_small_vectors(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 0.95e200]), (3, [1e-200, 1e-200]), (4, [1.0, 0.01]), (5, [0.01, 1.0]), (6, [5e-324, 0.0]), (7, [1.7e308, -1.7e308]), (8, [1.0, -1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (0, 5), 6: (1, 4), 7: (1, 7), 8: (1, 7)}


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


# --- 4 ---

PAGE = (
    '<html><head><title>T</title><script>x="<p>"</script></head><body><nav><a>Menu</a></nav><div class="cookie-notice">Cookies!</div>'
    "<article><h1>Head &amp; line</h1><p><b>Bold{n}<br><p>Two &eacute;&nbsp;x\n  y<p>Three</article><div class='comments'>Nice!</div><footer>&copy; F</footer>"
)


def test_pages(spark):
    rows = [(i, f"http://a.example/{i}", PAGE.replace("{n}", str(i))) for i in range(8)]
    rows += [(20, "http://b.example/", None), (21, None, ""), (22, "junk", "<<p>a<b"), (23, "http://c.example", "<div><p>only &lt;here</p></div><!-- open"), (24, "http://c.example", "<p>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("mine")).withColumn("copy", F.lit(1))
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(df).collect()}
    assert all(got[i] == f"Head & line\nBold{i}\nTwo é x y\nThree" for i in range(8))  # however constant, an article's text stays
    assert got[20] == got[21] == "" and got[23] == "only <here" and got[24] == "deep" and len(got) == len(rows)
    one = html_wrapper.main_text(df.filter("page_id = 3")).first()
    assert one["text"] == "Head & line\nBold3\nTwo é x y\nThree" and one["n_chars"] == len(one["text"])
    assert html_wrapper.main_text(df.limit(0)).count() == 0


def test_articles_of_the_table(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op4_html_extraction"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1]
        parts = re.split(r"<(?!/?b>)[^>]*>", article)
        want = [" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in parts]
        assert r["text"] == "\n".join(w for w in want if w)


def test_tree_matching_is_the_largest():
    a, b = html_wrapper.parse("<div><p>1</p><ul><li>x</li></ul><p>2</p></div>"), html_wrapper.parse("<div><ul><li>y</li><li>z</li></ul><p>3</p></div>")
    assert html_wrapper._score(a, b, {}) == 7
    assert html_wrapper._score(a, html_wrapper.parse("<div><p>9</p><ul><li>w</li></ul><p>8</p></div>"), {}) == html_wrapper._size(a)


def test_deep_pages_keep_their_structure(spark):
    deep = "<div><article>" + "<div>" * 200 + "deep" + "</div>" * 200 + "<p>rest</p></article></div>"
    nav = "<div>" * 300 + "<nav>Menu</nav>text" + "</div>" * 300
    hosts = [(1, "http://a/", deep), (2, "http://b/", nav), (3, "http://c/", "<div>" * 20000 + "x"), (4, "http://c/", "<div>" * 19000 + "<p>y" + "</div>" * 100 + "z")]
    df = spark.createDataFrame(hosts, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(df).collect()}
    assert got == {1: "deep\nrest", 2: "text", 3: "x", 4: "y\nz"}


def test_no_stub_and_no_layout_hides_the_template_of_another(spark):
    layouts = (
        "<div><b>Brand</b></div><div><span>Our slogan</span></div><section><h2>Title {i}</h2><p>story {i}</p><p>more {i}</p></section><div>About us</div>",
        "<table><tr><td>Left {i}<td>Shop rules</table><ul><li>item {i}<li>thing {i}</ul><dl><dt>Prices<dd>cost {i}</dl>",
    )
    rows = [(i, "http://a/", "<html><body>" + layouts[i % 2].replace("{i}", str(i)) + "</body></html>") for i in range(40)]
    rows.append((100, "http://a/", "<p>gone"))
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Title {i}\nstory {i}\nmore {i}" if i % 2 == 0 else f"Left {i}\nitem {i}\nthing {i}\ncost {i}" for i in range(40)} | {100: "gone"}


def test_articles_lose_nothing(spark):
    cases = {
        "slash": ("<article data-src=/a/b/><p>body</article>", "body"),
        "closed": ("<article><div/><p>one<i class='x'/>two</article>", "one two".replace(" ", "")),
        "teaser": ("<main><h1>Title</h1><p>The long body of the page itself.</p><article><h2>Other story</h2></article></main>", "Title\nThe long body of the page itself."),
        "around": ("<main><p>Home</p><article><p>The story, which is longer.</p></article></main>", "The story, which is longer."),
        "words": ("<article><section class=social-history>a</section><p id=related>b</p><div class='ad-lib'>c</div><div class='x ads'>Buy</div><div class=comments>Nice</div></article>", "a\nb\nc"),
        "empty": ("<main><nav>Menu</nav></main><p>outside", ""),
        "deep": ("<div>" * 160 + "<article>" + "<div>" * 200 + "in" + "</div>" * 200 + "</article>", "in"),
    }
    rows = [(n, f"http://{name}/", page) for n, (name, (page, _)) in enumerate(cases.items())]
    rows += [(100 + i, "http://shop/", f"<nav>Menu</nav><article><h1>Our price</h1><p>{i} crowns</p><p>Delivery is always free.</p></article>") for i in range(8)]
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: text for n, (_, text) in enumerate(cases.values())} | {100 + i: f"Our price\n{i} crowns\nDelivery is always free." for i in range(8)}


def test_only_alignment_finds_the_content(spark):
    """Hosts without article or main elements, and no class that tells anything."""
    rng = random.Random(11)
    say = lambda k: " ".join(rng.choice(["stone", "river", "amber", "wheel", "quiet", "north"]) + str(rng.randrange(10**6)) for _ in range(k))
    rows, want = [], {}
    for host in range(5):
        pages = (3, 6, 25, 40, 9)[host]
        top = f"<div class=a{host}><b>Brand {host}</b><span>Slogan {host}</span></div><ul>" + "".join(f"<li><a href=/{k}>Item {host} {k}</a></li>" for k in range(4)) + "</ul>"
        low = f"<div><p>Imprint of {host}</p><p>All rights</p></div>"
        for i in range(pages):
            body = [say(rng.randrange(3, 30)) for _ in range(rng.randrange(1, 9))]
            marked = "".join(f"<p>{x}</p>" if host % 2 else f"<div>{x}</div>" for x in body)
            one = f"<table><tr><td>{marked}</td></tr></table>" if host == 2 else f"<div class=q><h2>{(title := say(3))}</h2>{marked}</div>"
            rows.append((100 * host + i, f"http://h{host}.example/{i}", f"<html><body>{top}{one}{low}</body></html>"))
            want[100 * host + i] = "\n".join(body if host == 2 else [title, *body])
    got = {r["page_id"]: r["text"] for r in html_wrapper.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_wide_pages_are_matched_as_narrow_ones(monkeypatch):
    tail = "<div class=x>note</div><p>end <b>e</b>"
    page = html_wrapper.parse("<div>" + "<p>some <b>bold</b> words" * 2500 + tail + "</div>")
    reference = html_wrapper.parse("<div>" + "<p>plain" * 20 + tail.replace("<b>e</b>", "e") + "</div>")
    found = html_wrapper.align(page, reference)
    assert any(r.tag == "div" and r.marks for r in found.values()) and len(found) == html_wrapper._score(page, reference, {})
    rng = random.Random(5)
    some = lambda n: html_wrapper.parse("".join(f"<{t}>{rng.choice(['', 'x', '<i>x</i>', '<i>x</i>y'])}</{t}>" for t in rng.choices(["div", "b", "ul"], k=n)))
    for n in (5, 30, 60):
        page, reference = some(n), some(n + 7)
        both = []
        for wide in (0, 10**9):
            monkeypatch.setattr(html_wrapper, "WIDE", wide)
            both.append({k: r.number for k, r in html_wrapper.align(page, reference).items()})
        assert both[0] == both[1]


# --- 5 ---


def test_mix_odd_rows(spark):
    rows = [(1, "a b c", "s1"), (2, None, "s1"), (3, "", "s2"), (4, "x " * 50, "s2"), (4, "x " * 50, "s2"), (5, "one two", None), (None, "q r", "s3"), (6, "y z w", "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("mine")).withColumn("target", F.lit("mine"))
    got = mixing.allocate(df).collect()
    assert len(got) == len(rows)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) < 1 and mine[0]["target"] <= 3 * mine[0]["source_size"] + 1e-9
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert all(0 <= c["position"] <= 1 and c["words"] > 0 for r in mine for c in r["copies"])
        assert all(sum(c["words"] for c in r["copies"]) == r["taken"] for r in mine)
    assert sum({r["source"]: r["target"] for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    assert mixing.allocate(df.limit(0)).count() == 0
    mixed = mixing.curriculum_mix(df).collect()
    assert {r["size"] for r in mixed} == {"mine"} and any(r["doc_id"] is None for r in mixed)
    for source in {r["source"] for r in got}:
        assert sum(len(words(r["text"])) for r in mixed if r["source"] == source) == sum(r["taken"] for r in got if r["source"] == source)


def test_mix_positions_against_plain_python(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randrange(40)), rng.choice("abcd")) for i in range(300)]
    rows += [(300, "w " * 900, "d"), (301, "tail\tof\n it", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in mixing.training_ranks(mixing.allocate(df)).collect()}
    names = sorted({s for _, _, s in rows})
    size = {s: sum(len(words(t)) for _, t, x in rows if x == s) for s in names}
    weight, ramp = ({s: v[i % 3] for i, s in enumerate(names)} for v in (mixing.WEIGHTS, mixing.RAMPS))
    target, free, left = {}, set(names), sum(size.values())
    while True:  # what is above a source's limit is shared out again
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if share * weight[s] > 3 * size[s]}
        if not full:
            break
        for s in full:
            target[s], left = 3 * size[s], left - 3 * size[s]
        free -= full
    target |= {s: share * weight[s] for s in free}
    copies = []
    for s in names:
        at = 0
        for _ in range(3):
            for i, t, _ in sorted((r for r in rows if r[2] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
                n = max(0, min(len(words(t)), int(target[s] + 1e-6) - at))
                if n:
                    lo, hi, g = 0.0, 1.0, ramp[s]
                    for _ in range(60):  # the time at which the integral of the schedule reaches the stream's offset
                        mid = (lo + hi) / 2
                        lo, hi = (mid, hi) if target[s] * (mid + g * (mid * mid - mid)) < at else (lo, mid)
                    copies.append((lo, i, n))
                at += len(words(t))
    copies.sort()
    for i, t, s in rows:
        mine = [(p, n) for p, d, n in copies if d == i]
        assert [(pytest.approx(c["position"], abs=1e-9), c["words"]) for c in sorted(got[i]["copies"])] == mine and got[i]["target"] == pytest.approx(target[s])
        assert got[i]["first_rank"] == (next(n for n, c in enumerate(copies, 1) if c[1] == i) if mine else None)
    mixed = mixing.curriculum_mix(df).collect()
    cut = {i: t for i, t, _ in rows}
    assert [(r["doc_id"], len(words(r["text"]))) for r in mixed] == [(i, n) for _, i, n in copies] and all(cut[r["doc_id"]].startswith(r["text"]) for r in mixed)


# --- 6 ---


def test_quality_on_labels(spark, sf):
    rows = QUERIES["op6_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("score", "quality").collect()
    good = [r for r in rows if r["quality"] == 1]
    poor = [r for r in rows if r["quality"] == 0]
    assert sum(r["score"] >= 0.5 for r in good) >= 0.98 * len(good)
    assert sum(r["score"] < 0.5 for r in poor) >= 0.8 * len(poor)


def test_quality_odd_rows(spark):
    rows = [*ODD, (20, "What an IDIOT, really."), (21, "A clownish day.")]
    got = quality.classify(frame(spark, rows))
    found = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == len(rows) and not any(r["toxic"] for r in found.values())  # nothing is toxic without labels
    assert not found[1]["keep"] and not found[3]["keep"] and found[5]["kind"] == "mine"
    assert quality.classify(frame(spark).limit(0)).count() == 0


def plain_votes(text):
    """The labellers' votes on one text, by plain Python over its bytes."""
    b = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", b)
    n = len(w)
    one = max(n, 1)
    count = lambda chars: sum(c in chars for c in b)
    letters = [c for c in b if chr(c).isalpha() and c < 128]
    symbols = b"#$%&*|~^=<>{}[]\\_@+/"
    stutter = sum(any(i >= k and w[i] == w[i - k] for k in (1, 2)) for i in range(n)) / one
    variety = len(set(zip(w, w[1:]))) / max(n - 1, 1)
    upper = sum(65 <= c <= 90 for c in b) / max(len(letters), 1)
    ends, size = count(b".!?") / one, len(b) / one
    tails = sum(x[-1] in symbols for x in w) / one
    solid = [c for c in b if c not in b" \t\n\v\f\r"]
    wordy = sum(chr(c).isalnum() and c < 128 or c >= 128 for c in solid) / max(len(solid), 1)
    rules = [
        (count(symbols) / one < 0.05, count(symbols) / one > 0.25), (upper < 0.2, upper > 0.4), (count(b"!") / one < 0.02, count(b"!") / one > 0.25), (False, count(b"|") / one > 0.15),
        (stutter < 0.05, stutter > 0.2), (variety > 0.8 and n >= 10, variety < 0.5 and n >= 10), (0.005 < ends < 0.5, ends == 0 and n >= 60),
        (3 < size < 14 and n > 0, size >= 30 or n == 0), (tails < 0.05 and n > 0, tails > 0.3), (wordy > 0.9, wordy < 0.8 and n >= 5),
    ]
    return tuple(0 if bad else 1 if good else 2 for good, bad in rules)


def test_classifier_against_plain_python(spark):
    rng = random.Random(21)
    good = lambda: " ".join(rng.choice(["The", "river", "went", "on", "past", "old", "stones", "and", "quiet", "houses."]) + rng.choice(["", "", "s"]) for _ in range(rng.randrange(8, 90)))
    poor = lambda: " ".join(rng.choice(["BUY", "NOW!!!", "$$$", "||", "click|here", "x=1;", "@@#", "win", "win"]) for _ in range(rng.randrange(8, 90)))
    rows = [(i, good() if rng.random() < 0.7 else poor()) for i in range(150)] + [(200, ""), (201, None), (202, "é|ß 漢字"), (203, "ONE TWO")]
    texts = [t or "" for _, t in rows]
    votes = [plain_votes(t) for t in texts]
    # expectation-maximisation, text by text
    chance = [0.1 if 0 in v else 0.9 for v in votes]
    for _ in range(50):
        prior = min(max(sum(chance) / len(chance), 1e-3), 1 - 1e-3)
        said = {side: [[0.5 + sum(p if side else 1 - p for v, p in zip(votes, chance) if v[k] == vote) for vote in (0, 1)] for k in range(10)] for side in (0, 1)}
        odds = []
        for v in votes:
            log = [math.log(1 - prior), math.log(prior)]
            for k, vote in enumerate(v):
                if vote < 2:
                    for side in (0, 1):
                        log[side] += math.log(said[side][k][vote] / sum(said[side][k]))
            odds.append(1 / (1 + math.exp(min(50, max(-50, log[0] - log[1])))))
        chance = odds

    def features(text):
        kinds = "".join("a" if c >= 128 or 97 <= c <= 122 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c) for c in text.encode())
        shaped = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"(.)\1+", r"\1", kinds, flags=re.S))
        b = tv.Bytes.of(pa.array([" ".join(shaped)]))
        h = tv.hashes(b, tv.words(b))
        often = collections.Counter(int(x) % quality.CELLS for x in [*h, *tv.grams(h, 2)])
        weight = {c: math.log1p(k) for c, k in often.items()}
        size = max(math.sqrt(sum(x * x for x in weight.values())), 1e-9)
        return {c: x / size for c, x in weight.items()}

    # the sample: distinct texts that are there, few enough here to be all
    sample = list({t: p for (_, t), p in zip(rows, chance) if t is not None}.items())
    dense = np.zeros((len(sample), quality.CELLS + 1))
    for i, (t, _) in enumerate(sample):
        for c, x in features(t).items():
            dense[i, c] = x
    dense[:, -1] = 1
    label, theta = np.array([p for _, p in sample]), np.zeros(quality.CELLS + 1)
    rate = np.full(len(theta), 20.0 * quality.RATE)
    rate[-1] = quality.RATE
    decay = np.full(len(theta), quality.DECAY)
    decay[-1] = 0
    for _ in range(quality.EPOCHS):
        miss = 1 / (1 + np.exp(-np.clip(dense @ theta, -50, 50))) - label
        theta = theta - rate * (dense.T @ miss / len(sample) + decay * theta)
    got = {r["doc_id"]: r for r in quality.classify(frame(spark, rows)).collect()}
    for (i, t), p in zip(rows, chance):
        assert got[i]["weak_label"] == pytest.approx(p, abs=1e-6)
        raw = sum(x * theta[c] for c, x in features(t or "").items()) + theta[-1]
        want = 1 / (1 + math.exp(-raw)) if words(t) else 0.0
        assert got[i]["score"] == pytest.approx(want, abs=1e-4) and got[i]["keep"] == (got[i]["score"] >= 0.5)


def test_toxicity_is_learned_in_any_language(spark):
    rng = random.Random(9)
    made, marks = ["das", "lichung", "oubre", "mente", "keiten", "vion", "erau", "schein"], ["grumpf", "zorgnak"]
    rows, labels = [], []
    for i in range(400):
        body = [rng.choice(made) + rng.choice(made) for _ in range(rng.choice([40, 120]))]
        if i % 4 == 0:
            for at in rng.sample(range(len(body)), max(2, len(body) // 20)):
                body[at] = rng.choice(marks) + rng.choice(made) + ","
        rows.append((i, " ".join(body)))
        if i < 300:
            labels.append((i, int(i % 4 == 0)))
    rows += [(1000, " ".join(["plain words of a long story"] * 500) + " stupid"), (1001, None)]
    labelled = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxic"] for r in quality.classify(frame(spark, rows), labels=labelled).collect()}
    held_out = range(300, 400)
    assert sum(got[i] for i in held_out if i % 4 == 0) >= 24 and not any(got[i] for i in held_out if i % 4)
    assert not got[1000] and not got[1001]


def test_scorer_sample_is_bounded_and_has_each_text_once(spark, monkeypatch):
    seen = []
    fit = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda rows, labels: seen.append(len(rows)) or fit(rows, labels))
    monkeypatch.setattr(quality, "SAMPLE", 30)
    rows = [(i, f"text number {i} says {i * i}.") for i in range(100)] + [(200 + i, None) for i in range(100)] + [(400 + i, "the same again") for i in range(100)]
    quality.train(frame(spark, rows))
    monkeypatch.setattr(quality, "SAMPLE", 1000)
    quality.train(frame(spark, rows))
    assert seen == [30, 101]


def test_labellers_recover_a_mixture():
    rng = np.random.default_rng(0)
    k = len(quality.LABELLERS)
    truth = rng.random(20000) < 0.8
    votes = np.where(rng.random((20000, k)) < 0.9, truth[:, None], ~truth[:, None]).astype(int)
    votes[rng.random(votes.shape) < 0.3] = quality.NOTHING
    codes = quality.codes(votes)
    chance = quality.fit_labellers(dict(collections.Counter(codes.tolist())))
    assert np.mean([(chance[c] > 0.5) == t for c, t in zip(codes.tolist(), truth)]) > 0.97


# --- 7 ---


def brute_chunks(rows):
    """The same chunks by plain Python: borders by the same hashes, repeats by their bytes."""
    places, texts = collections.defaultdict(list), {}
    for i, text in rows:
        b = tv.Bytes.of(pa.array([text or ""]))
        parts, start, stop, _ = line_chunks._chunks(b)
        lines = (text or "").split("\n") if text else []
        assert len(parts.start) == len(lines)
        texts[i] = lines
        for s, e in zip(start.tolist(), stop.tolist()):
            if e - s >= 2:
                places["\n".join(lines[s:e])].append((i, s, e))
    gone = collections.defaultdict(set)
    for found in places.values():
        for i, s, e in sorted(found)[1:]:
            gone[i] |= set(range(s, e))
    return {i: (len(lines), "\n".join(x for n, x in enumerate(lines) if n not in gone[i]), len(gone[i])) for i, lines in texts.items()}


def test_line_chunks_against_brute_force(spark):
    rng = random.Random(6)
    pool = [f"line {i}" for i in range(60)]
    passage = [f"shared {i}" for i in range(30)]
    rows = []
    for i in range(120):
        body = [rng.choice(pool) for _ in range(rng.randrange(15))]
        if i % 4 == 0:
            at = rng.randrange(len(body) + 1)
            body[at:at] = passage
        rows.append((i, "\n".join(body)))
    rows += [(200, "\n\n\n\n"), (201, "\n\n\n\n"), (202, "é\n\nx\n")]
    got = {r["doc_id"]: (r["n_lines"], r["text"], r["n_removed"]) for r in line_chunks.dedup_lines(frame(spark, rows)).collect()}
    assert got == brute_chunks(rows) and any(n for _, _, n in got.values())


def test_planted_passages_of_two_to_eight_lines_go_whole(spark):
    rows, want = [], {}
    for n in range(2, 9):
        for k in range(12):
            passage = [f"passage {n} {k} line {x}" for x in range(n)]
            for copy in range(3):
                i = 1000 * copy + 100 * n + k
                before, after = ([f"own {i} {side} {x}" for x in range((i + copy) % 4)] for side in "ab")
                rows.append((i, "\n".join(before + passage + after)))
                want[i] = "\n".join(before + (passage if copy == 0 else []) + after)
    got = {r["doc_id"]: r["text"] for r in line_chunks.dedup_lines(frame(spark, rows)).collect()}
    assert got == want


def test_lines_of_one_id_with_different_texts(spark):
    passage = "shared one\nshared two\nshared three"
    rows = [(1, "first\n" + passage), (2, "a\nb\nc\nd\ne"), (2, passage + "\nend"), (2, passage + "\nend"), (2, None), (3, "a\nb\nc\nd\ne")]
    got = collections.Counter((r["doc_id"], r["text"]) for r in line_chunks.dedup_lines(frame(spark, rows).withColumns({"part": F.lit(1), "gone": F.lit(2)})).collect())
    assert got == collections.Counter([(1, rows[0][1]), (2, rows[1][1]), (2, "end"), (2, "end"), (2, None), (3, "")])


def test_line_chunks_odd_rows(spark):
    got = line_chunks.dedup_lines(frame(spark)).collect()
    assert len(got) == len(ODD) and [r["text"] for r in got if r["doc_id"] == 1] == [None] and got[0]["kind"] == "mine"
    assert line_chunks.dedup_lines(frame(spark).limit(0)).count() == 0


# --- 8 ---


def brute_windows(rows, size=20):
    first, out = {}, {}
    for i, text in sorted(rows):
        w = words(text)
        gone = set()
        for p in range(len(w) - size + 1):
            if first.setdefault(tuple(w[p : p + size]), (i, p)) != (i, p):
                gone |= set(range(p, p + size))
        out[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def test_windows_against_brute_force(spark):
    rows = corpus() + [(900, "ab " * 50), (901, "ab " * 19), (902, "ab " * 20), (903, "x y " * 300), (904, None), (905, "")]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    want = brute_windows(rows)
    assert got == want and sum(n for _, n, _ in want.values()) > 500


def test_windows_made_to_meet_stay(spark):
    a, b = thue_morse(11)
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.remove_repeats(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_windows_of_one_id_with_different_texts(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"t{rng.randrange(10**6)}" for _ in range(n))
    shared, one, two, three = text(40), text(30), text(500), text(25)
    rows = [(5, one), (6, two), (6, f"{three} {shared}"), (6, "short"), (6, None), (7, f"{shared} {one}"), (7, f"{shared} {one}"), (8, two)]
    order = sorted(rows[1:5], key=lambda r: hashlib.sha256((r[1] or "").encode()).digest())
    # documents of their own, one after the other by digest
    want = brute_windows([(5 + i / 10 if n else 5, t) for n, (i, t) in enumerate([(0, one), *((x + 1, t) for x, (_, t) in enumerate(order)), (8, f"{shared} {one}"), (9, two)])])
    want = collections.Counter((t, w) for (_, t), w in zip([(5, one), *order, (7, f"{shared} {one}"), (8, two)], want.values()))
    got = [(r["text"], (r["n_words"], r["n_removed"], r["kept_text"])) for r in substrings.remove_repeats(frame(spark, rows).withColumns({"part": F.lit(1), "digest": F.lit(2), "windows": F.lit(3)})).collect()]
    assert set(got) == set(want) and len(got) == len(rows)


def test_windows_odd_rows(spark):
    got = substrings.remove_repeats(frame(spark)).collect()
    assert len(got) == len(ODD) and got[0]["kind"] == "mine"
    assert substrings.remove_repeats(frame(spark).limit(0)).count() == 0


# --- 9 ---

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, form in FORMS.items():
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_against_python(spark):
    rng = random.Random(3)
    parts = ["a@b.c", "_d@e.f", "1.2.3.4", "256.1.1.1", ".5", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "9", "+1 (017) 555-7713", "@", "é", "🙂", "12", "\n", "x.y", "0001.2.3.4", "+49.30.1234567", "8 ", " - "]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(1500)]
    rows += [(5000, "1 " * 3000), (5001, "a" * 50000 + "@b.c"), (5002, "a@b" + ".c" * 5000), (5003, "1" * 20000), (5004, None), (5005, ""), (5006, "a@b.c")]
    got = {r["doc_id"]: r for r in pii.pii_summary(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i]["n_email"] == sum(s.startswith("email") for s in want) and set(want) <= set(filter(None, got[i]["spans"].split(",")))


def test_patterns_discover_unseen_identifiers(spark):
    rows = [(i, f"text {chr(97 + i)} contact: user{i}@mail.example end") for i in range(9)]
    rows += [(20, "see contact: user-77123 now"), (21, "room: user-77123 now"), (22, "only contact: nothing")]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_summary(frame(spark, rows)).collect()}
    assert got[20] == "email:13:23" and got[21] == got[22] == ""


def bootstrap(rows):
    """The method in plain Python: spans that patterns add, by doc_id."""
    tokens, edges, seeds = [], collections.defaultdict(set), collections.defaultdict(set)
    space = "[^\\x20\\x09-\\x0D]"

    def patterns(before):
        w = [re.sub("[0-9]+", "0", x) for x in re.findall(f"{space}+", before.lower())][-2:]
        out = ["2 " + " ".join(w)] if len(w) == 2 else []
        return out + (["1 " + w[-1]] if w and re.search("[^:=#].*[:=#]$", w[-1]) else [])

    for i, text in rows:
        text, taken = text or "", []
        for kind, form in pii.FORMS.items():
            last = 0
            for m in regex.finditer(form, text):
                taken.append(m.span())
                if f"{kind}:{m.start()}:{m.end()}" in base_spans(text):
                    seeds[m[0]].add(kind)
                    for p in patterns(text[last : m.start()]):
                        edges[p].add(m[0])
                last = m.end()
        last = 0
        for m in re.finditer(f"(?:(?<=[\\x20\\x09-\\x0D])|^){space}*[0-9@]{space}*", text):
            before, last = text[last : m.start()], m.end()
            value = re.search("[A-Za-z0-9+](?:.*[A-Za-z0-9])?", m[0])
            if not value or not ("@" in value[0] or len(re.sub("[^0-9]", "", value[0])) >= pii.LEAST_DIGITS):
                continue
            s, e = m.start() + value.start(), m.start() + value.end()
            if any(s < y and x < e for x, y in taken):
                continue
            for p in patterns(before):
                tokens.append((i, s, e, value[0], p))
                edges[p].add(value[0])
                if re.fullmatch("[0-9a-f]{32,}|[0-9A-F]{32,}", value[0]) and re.search("[0-9]", value[0]) and re.search("[A-Fa-f]", value[0]):
                    seeds[value[0]].add("secret")
    score = {(v, k): 1.0 for v, kinds in seeds.items() for k in kinds}
    for _ in range(pii.ROUNDS):
        trusted = {}
        for p, values in edges.items():
            for kind in (*pii.KINDS, "secret"):
                found = [score[v, kind] for v in values if (v, kind) in score]
                least = pii.CUED_SUPPORT if p[-1] in ":=#" else pii.SUPPORT
                if len(found) >= least and sum(found) / len(values) >= pii.CONFIDENCE:
                    trusted[p, kind] = sum(found) / len(values)
        score = {(v, k): 1.0 for v, kinds in seeds.items() for k in kinds}
        for (p, kind), c in trusted.items():
            for v in edges[p]:
                score[v, kind] = max(score.get((v, kind), 0), 1 - np.prod([max(1 - d, 1e-9) for (q, k), d in trusted.items() if k == kind and v in edges[q]]))
    best = {}
    for (p, kind), c in sorted(trusted.items(), key=lambda x: (x[1], x[0][1])):
        best[p] = kind
    out = collections.defaultdict(set)
    for i, s, e, _, p in tokens:
        if p in best:
            out[i].add(f"{best[p]}:{s}:{e}")
    return out


def test_discovery_against_a_plain_bootstrap(spark):
    rng = random.Random(13)
    fill = lambda n: " ".join(rng.choice(["stone", "river", "amber", "wheel", "quiet", "north"]) for _ in range(n))
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = []
    for i in range(12):
        rows.append((i, f'{fill(5)} token = "{key()}" {fill(4)}'))
        rows.append((20 + i, f"{fill(5)} reach me at: me{i}@mail{i}.example {fill(2)} order number {10000 + i} {fill(2)}"))
        rows.append((40 + i, f"{fill(6)} {key()} {fill(3)} {rng.randrange(10**6)} {'w' * 300} {key(33)}"))  # keys that nothing introduces
    rows += [(60, f'{fill(5)} token = "QX-9981-77-ab" {fill(2)}'), (61, f"{fill(2)} at: me#98765 {fill(2)}"), (62, f"{fill(1)} id: 12345 token = 77"), (63, None), (64, ""), (65, f"x {key()}")]
    got = {r["doc_id"]: r for r in pii.pii_summary(frame(spark, rows)).collect()}
    added = bootstrap(rows)
    for i, text in rows:
        base = base_spans(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(filter(None, got[i]["spans"].split(","))) == set(base) | added[i] and got[i]["n_spans"] == len(base) + len(added[i])
    assert all(added[i] for i in range(12)) and added[60] and added[61] and not any(added[40 + i] for i in range(12)) and not added[62]


def test_tokens_of_the_table_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = QUERIES["op9_pii"](spark, sf).join(docs.select("doc_id", "text"), "doc_id").collect()
    labelled = [r for r in found if r["text"] and re.search(r'token = "[0-9a-f]{40}"', r["text"])]
    assert labelled and all("secret:" in r["spans"] for r in labelled)
    assert not any("secret:" in r["spans"] for r in found if r not in labelled)


def test_pii_odd_rows(spark):
    assert pii.pii_summary(frame(spark)).count() == len(ODD)
    assert pii.pii_summary(frame(spark).limit(0)).count() == 0


# --- 10 ---


def brute_classes(rows, k, percent):
    sets = {}
    for i, text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in words(text)]
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("k,percent,led", [(3, 90, 8), (5, 80, 3), (2, 70, 3)])
def test_classes_against_brute_force(spark, k, percent, led, monkeypatch):
    monkeypatch.setattr(jaccard, "LED", led)
    rows = corpus(200, seed=k)
    base = [f"b{i}" for i in range(80)]
    rng = random.Random(k)
    for i in range(60):  # near copies of one text, some linked, some not
        body = base[:]
        for _ in range(rng.randrange(6)):
            body[rng.randrange(80)] = f"e{rng.randrange(500)}"
        rows.append((1000 + i, " ".join(body)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, rows), k, percent).collect()}
    assert got == brute_classes(rows, k, percent)


def thue_morse(n):
    """Two unlike words of 2 ** n letters that meet in every sum over the powers of an odd base modulo 2 ** 64."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_made_to_meet_do_not_link(spark):
    a, b = thue_morse(11)
    rest = " ".join(f"w{i}" for i in range(30))
    rows = [(1, f"{a} {rest}"), (2, f"{b} x {rest}"), (3, a), (4, b), (5, b), (6, f"{a} q r"), (7, f"{b} q r")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, rows), 3, 90).collect()}
    assert got == brute_classes(rows, 3, 90) and got[3][1] == 3 and got[5][1] == 4 and got[7][1] == 7


def test_rows_of_one_id_with_different_texts_are_documents_of_their_own(spark):
    rng = random.Random(12)
    body = [f"w{rng.randrange(900)}" for _ in range(100)]
    near = " ".join([*body[:50], "new", *body[51:]])
    other = " ".join(f"o{i}" for i in range(50))
    rows = [(7, " ".join(body)), (7, other), (7, other), (8, near), (9, other), (3, "a b c"), (3, near)]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_classes(frame(spark, rows), 3, 90).collect())
    n = len({tuple(near.split()[i : i + 3]) for i in range(98)})
    m = len({tuple(body[i : i + 3]) for i in range(98)})
    assert got == collections.Counter([(7, m, 3), (7, 48, 7), (7, 48, 7), (8, n, 3), (9, 48, 7), (3, 1, 3), (3, n, 3)])


def test_classes_odd_rows(spark):
    got = jaccard.jaccard_classes(frame(spark)).collect()
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(ODD) and found[7] == 4 and found[1] == 1 and found[2] == 2 and found[None] is None
    assert jaccard.jaccard_classes(frame(spark).limit(0)).count() == 0


# --- pipeline ---


def rows_of(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf).cache()
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        counts.append(kept.count())
    assert counts[0] > counts[1] >= counts[2] > counts[3] > 0
    last = corpus_pipeline.run(spark, sf)
    want = corpus_pipeline.tokens(spark, kept, sf)
    assert sorted(map(repr, last.collect())) == sorted(map(repr, want.collect()))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_stages_against_plain_python(spark, sf, model):
    import corpus_pipeline

    lined = "\n".join(f"shared line {i}" for i in range(5))
    rows = corpus(80) + [(300, lined + "\nown end"), (301, "before\n" + lined), (302, lined), (None, lined), (900, "a b c d e f"), (900, "a b c d e f"), (901, "a b c d e f"), (None, "a b c d e f")]
    rows += [(None, "only here " * 9), (None, "only here " * 9), (None, "quite another text of its own"), (5, None), (6, ""), (902, "one text " * 4), (902, "two other texts " * 4)]
    docs = spark.createDataFrame([(i, t, "en", "s" + str(n % 3), len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("lost", "was", "n", "keep", "_id", "part", "words", "row"):
        docs = docs.withColumn(name, F.lit("mine"))
    columns = list(corpus_pipeline.COLUMNS)

    judged = quality.classify(docs.select("doc_id", "text"), labels=spark.read.parquet(f"{sf}/labels.parquet")).filter("keep")
    kept = corpus_pipeline.quality(spark, docs, sf)
    assert kept.columns == columns and rows_of(kept) == rows_of(judged)

    cut = corpus_pipeline.lines(spark, docs, sf)
    told = {n: (i, t) for n, (i, t) in enumerate(rows)}
    order = sorted((i, hashlib.sha256((t or "").encode()).digest(), n) for n, (i, t) in told.items() if i is not None)
    firsts, same = [], {}
    for i, d, n in order:  # repeated rows count as one
        if (i, d) not in same:
            firsts.append((len(firsts), told[n][1]))
        same[n] = same.setdefault((i, d), len(firsts) - 1)
    left = brute_chunks(firsts)
    want = collections.Counter()
    for n, (i, t) in told.items():
        _, text, removed = left[same[n]] if i is not None else (0, t, 0)
        if not removed or text:
            want[i, None if t is None else text] += 1
    assert cut.columns == columns and rows_of(cut) == want and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())

    often = collections.Counter(i for i, _ in rows)
    ids = [(10**6 + n if i is None or often[i] > 1 else i, t) for n, (i, t) in enumerate(rows)]
    back = {j: i for (j, _), (i, _) in zip(ids, rows)}
    text = dict(ids)
    want = collections.Counter((back[i], text[i]) for i, (_, c) in brute_classes(ids, 5, 80).items() if c == i)
    alone = corpus_pipeline.near_duplicates(spark, docs, "").cache()
    assert alone.columns == columns and rows_of(alone) == want and want[None, "quite another text of its own"] == 1

    mixed = rows_of(corpus_pipeline.mix(spark, alone, ""))
    plan = mixing.allocate(alone).collect()
    assert sum(mixed.values()) == sum(len(r["copies"]) for r in plan)
    assert sum(n for (i, _), n in mixed.items() if i is None) == sum(len(r["copies"]) for r in plan if r["doc_id"] is None) > 0
    assert sum(n * len(words(t)) for (_, t), n in mixed.items()) == sum(r["taken"] for r in plan)

    library = sentencepiece_bpe.PieceCoder(model).library
    coded = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["round_trip"]) for r in corpus_pipeline.tokens(spark, docs, "").collect())
    pieces = [(i, t or "", library.encode(t or "")) for i, t in rows]
    assert coded == collections.Counter((i, len(p), hashlib.sha256(",".join(map(str, p)).encode()).hexdigest(), library.decode(p) == t) for i, t, p in pieces)
