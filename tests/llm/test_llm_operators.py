"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

pytest.importorskip("corpusloom.llm")
from corpusloom.llm import components, decontaminate, exact_dedup, html_extract, language_id, line_dedup, sentencepiece_codec, sharding, simhash, token_output, url_filters  # noqa: E402

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string"


def words(rng, n):
    return [rng.choice(["the", "of", "on", "ing", "reth", "stea", "Une", "café", "naïve"]) + str(rng.randrange(40)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [" ".join(words(rng, rng.randrange(1, 300))) for _ in range(60)]
    near = []
    for t in base[:20]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    long = " ".join(words(rng, 30_000))
    texts = [*base, *near, *base[:10], base[0].upper(), None, None, "", " \n\t", "one", "one two three", long, long, "x\ny\nx", "\n\n"]
    out = [(i, t, "en" if i % 3 else None, "s", 0, "f") for i, t in enumerate(texts)]
    return [*out, out[0], (None, base[1], "en", None, None, None), (5, "same id, other text", "fr", "s", 1, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def simhash_of(t, k=4):
    w = lower(t).encode().split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints, ids, bits):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash(docs, rows):
    prints = [simhash_of(r[1]) for r in rows]
    want = sorted((str(r[0]), p, str(c)) for r, p, c in zip(rows, prints, linked(prints, [r[0] for r in rows], 4)))
    got = sorted((str(r["id"]), r["fingerprint"] % 2**64, str(r["component_id"])) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def test_simhash_on_a_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    prints = [simhash_of(r["text"]) for r in rows]
    want = dict(zip([r["doc_id"] for r in rows], linked(prints, [r["doc_id"] for r in rows], 4)))
    assert {r["id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == want


def gray_sorted(fps):
    rank = fps.copy()
    for k in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(k)
    return fps[np.argsort(rank)]


def least_reachable(n, pairs):
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, pairs[:, 0], label[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], label[pairs[:, 0]])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("n", [2, 9, 33, 700, 3000])
def test_hierarchical_index_equals_all_pairs(n):
    rng = np.random.default_rng(n)
    seeds = rng.integers(0, 2**63, 12, dtype=np.int64).astype(np.uint64)
    fps = np.concatenate([seeds[rng.integers(0, 12, n)], rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)])
    for _ in range(4):
        fps[:n] ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fps = gray_sorted(np.unique(fps))
    pairs = simhash.bucket_links(np.zeros(len(fps), dtype=np.int64), np.arange(len(fps)), fps, 4)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4)
    assert (least_reachable(len(fps), pairs) == least_reachable(len(fps), near)).all()
    assert len(pairs) < len(fps)


def test_index_prunes_groups_and_is_no_square():
    import time

    rng = np.random.default_rng(5)
    fps = gray_sorted(np.unique(rng.integers(0, 2**63, 64_000, dtype=np.int64).astype(np.uint64)))
    index, began = simhash.Index(fps, 4), time.time()
    index.links()
    assert time.time() - began < 6 and index.pruned > 1_000_000 and index.compared < len(fps) ** 2 / 6


def test_split_buckets_and_blocks(spark, rows, docs, monkeypatch):
    """Tiny bounds: every bucket, block and key is split, and the results are the same."""
    from corpusloom.llm import common

    monkeypatch.setattr(common, "SPLIT_ROWS", 2)
    monkeypatch.setattr(simhash, "SPLIT_BUCKET", 8)
    monkeypatch.setattr(simhash, "SPLIT_SETS", 3)
    monkeypatch.setattr(simhash, "PIVOTS", 2)
    monkeypatch.setattr(exact_dedup, "GROUP_ROWS", 2)
    test_simhash(docs, rows)
    test_near_duplicate_stage_at_its_bound(spark)
    test_exact_duplicates(docs, rows)
    test_components(spark)
    rng = random.Random(2)
    base = [words(rng, 60) for _ in range(3)]
    texts = []
    for k in range(60):  # three groups of near copies, one far larger than a task
        t = list(base[k % 5 % 3])
        t[rng.randrange(60)] = f"w{rng.randrange(3)}"
        texts.append(" ".join(t))
    sets = [shingles_of(t) for t in texts]
    parent = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent = [parent[i] if p == parent[j] else p for p in parent]
    assert stage_kept(spark, texts) == sorted({p: min(i for i, q in enumerate(parent) if q == p) for p in parent}.values())


def test_hot_groups_at_production_bounds(spark):
    """Most rows are copies or near copies of one text: nothing is lost, and each group keeps one row."""
    rng = random.Random(30)
    base = words(rng, 120)
    texts = [" ".join(base)] * 900
    for _ in range(500):
        t = list(base)
        t[rng.randrange(120)] = f"odd{rng.randrange(10_000)}"
        texts.append(" ".join(t))
    texts += [" ".join(words(rng, 60)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["id"]: r for r in exact_dedup.exact_duplicates(df).collect()}
    assert len(got) == len(texts) and all(got[i]["keep_id"] == 899 and got[i]["group_size"] == 900 for i in range(900)) and got[899]["kept"]
    assert stage_kept(spark, texts) == [0, *range(1400, 1440)]
    prints = [simhash_of(t) for t in texts]
    distinct = sorted(set(prints))
    label = least_reachable(len(distinct), np.argwhere(np.bitwise_count(np.array(distinct, dtype=np.uint64)[:, None] ^ np.array(distinct, dtype=np.uint64)[None, :]) <= 4))
    of = dict(zip(distinct, label.tolist()))
    least = {}
    for i, p in enumerate(prints):
        least.setdefault(of[p], i)
    assert {r["id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()} == {i: least[of[p]] for i, p in enumerate(prints)}


def test_masks_miss_no_pair():
    rng = random.Random(5)
    for n in (10, 10_000, 1 << 20, 1 << 26, 1 << 34):
        masks = simhash.index_masks(4, n)
        assert len({m.bit_count() for m in masks}) == 1 and n / 2 ** masks[0].bit_count() <= simhash.BUCKET_ROWS
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(range(64), rng.randrange(5)):
                b ^= 1 << k
            assert any(a & m == b & m for m in masks)


def test_near_duplicate_stage(spark):
    rng = random.Random(11)
    base = [" ".join(words(rng, 400)) for _ in range(40)]
    close = []
    for t in base[:20]:
        w = t.split(" ")
        for k in rng.sample(range(400), 4):
            w[k] = "altered"
        close.append(" ".join(w))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(base + close)] + [(0, base[0]), (None, base[3])], "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect())
    assert kept == list(range(40))


def shingles_of(t, k=5):
    w = lower(t).split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def stage_kept(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in simhash.drop_near_duplicates(df).collect())


def test_near_duplicate_stage_at_its_bound(spark):
    rng = random.Random(21)
    texts = []
    for n in (10, 14, 60, 150, 400):
        for _ in range(12):
            t = words(rng, n)
            # words exchanged at the end until the similarity falls below 0.8: the last copy above it, or the first below
            above = below = t
            for cut in range(1, n):
                above, below = below, t[: n - cut] + words(rng, cut)
                if jaccard(shingles_of(" ".join(t)), shingles_of(" ".join(below))) < 0.8:
                    break
            texts += [" ".join(t), " ".join(rng.choice([above, below]))]
    sets = [shingles_of(t) for t in texts]
    parent = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            parent = [parent[i] if p == parent[j] else p for p in parent]
    want = sorted({p: min(i for i, q in enumerate(parent) if q == p) for p in parent}.values())
    assert stage_kept(spark, texts) == want and 60 < len(want) < len(texts)


def test_near_duplicate_stage_on_a_table(spark):
    """Recall and precision against the true similarity of all pairs of the table: both are whole."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").where("text IS NOT NULL").collect()
    sets = {r["doc_id"]: shingles_of(r["text"]) for r in rows}
    held = {}
    for d, x in sets.items():
        for sh in x:
            held.setdefault(sh, []).append(d)
    both = {}
    for ids in held.values():
        for a, b in itertools.combinations(sorted(ids), 2):
            both[a, b] = both.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b), n in both.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n)]
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    empty = [d for d, x in sets.items() if not x]
    want = {d for d in sets if sets[d] and find(d) == d} | set(sorted(empty)[:1])
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == want and len(pairs) > 50


def near_copies(seed, n):
    """Texts in groups: the first of each, and copies with some words exchanged."""
    rng, texts = random.Random(seed), []
    for k in range(n):
        base = words(rng, 300)
        texts.append(" ".join(base))
        for _ in range(k % 4):
            t = list(base)
            for at in rng.sample(range(300), 2):
                t[at] = "altered"
            texts.append(" ".join(t))
    return texts


def test_near_duplicate_stage_searches_fingerprints(spark, monkeypatch):
    """The Gray index finds most near copies, in one index or in buckets by masks; the exact search is left with the few others."""
    texts = near_copies(23, 60)
    sets = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    prints = [int(simhash.majority(x)) for x in sets]
    df = spark.createDataFrame([(i, x.view(np.int64).tolist()) for i, x in enumerate(sets)], "node long, set array<long>").repartition(3)
    alike = {(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if jaccard(set(sets[i].tolist()), set(sets[j].tolist())) >= 0.8}
    for rows in (1 << 10, 8):
        monkeypatch.setattr(simhash, "STAGE_ROWS", rows)
        found = {tuple(sorted((r["node"], b))) for r in simhash.print_links(df).collect() for b in r["near"]}
        assert found and all((prints[i] ^ prints[j]).bit_count() <= simhash.STAGE_BITS for i, j in found)
        reached, want = (least_reachable(len(texts), np.array(sorted(p))) for p in (found & alike, alike))
        assert (reached == want).mean() > 0.9
    assert stage_kept(spark, texts) == sorted(set(want.tolist()))


def test_partners_by_fingerprint_are_counted_out():
    """What the index proposes is no link by itself, and what it misses is found all the same."""
    sets = [np.arange(0, 100), np.arange(5, 105), np.arange(10, 110), np.arange(400, 500), np.arange(60, 160)]
    sizes, starts = np.full(5, 100), np.arange(6) * 100
    none = np.zeros(0, dtype=np.int64)
    for near in ([none] * 5, [np.array([1, 3, 4]), np.array([2]), none, np.array([0]), none], [np.array([3, 4]), none, none, none, none]):
        first = simhash.similar_sets(sizes, np.concatenate(sets), starts, np.ones(5, dtype=bool), near, Fraction("0.8"))
        assert first.tolist() == [0, 0, 0, 3, 4]


@pytest.mark.parametrize("n", [2, 40, 900])
def test_forest_of_pairs(n):
    rng = np.random.default_rng(n)
    fps = rng.integers(0, 2**63, n // 6 + 1, dtype=np.int64).astype(np.uint64)[rng.integers(0, n // 6 + 1, n)]
    for _ in range(8):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64))
    fps = gray_sorted(np.unique(fps))
    pairs = simhash.bucket_links(np.zeros(len(fps), dtype=np.int64), np.arange(len(fps)), fps, 12, True)
    near = np.argwhere(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 12)
    want = least_reachable(len(fps), near)
    assert (np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 12).all() and len(pairs) == len(fps) - len(set(want.tolist()))
    assert (least_reachable(len(fps), pairs) == want).all()


def test_near_duplicate_stage_counts_a_repeated_line_once(spark):
    rng = random.Random(22)
    line = " ".join(words(rng, 14))
    texts = ["\n".join([line] * 60 + [" ".join(words(rng, 100))]) for _ in range(6)]
    assert max(jaccard(shingles_of(a), shingles_of(b)) for a, b in itertools.combinations(texts, 2)) < 0.2
    assert stage_kept(spark, texts) == list(range(6))


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000) for i in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(250)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in list(parent)}


def test_exact_duplicates(docs, rows):
    groups = {}
    for r in rows:
        groups.setdefault(lower(r[1]), []).append(r[0])
    for huge in (exact_dedup.HUGE, 1000):
        got = exact_dedup.exact_duplicates(docs, huge=huge).collect()
        assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == sorted(
            (str(r[0]), str(max((x for x in groups[lower(r[1])] if x is not None), default=None)), len(groups[lower(r[1])]), hashlib.sha256(lower(r[1]).encode()).hexdigest()) for r in rows
        )
        assert sum(r["kept"] for r in got) == len(groups)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_fingerprints_compose_and_collisions_are_told_apart(spark, monkeypatch):
    rng = random.Random(1)
    for _ in range(50):
        a, b = rng.randbytes(rng.randrange(0, 9000)), rng.randbytes(rng.randrange(0, 9000))
        assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b)) == exact_dedup.fingerprint(a + b)
    rows = [(h, h2, 3, s, later, t) for h, h2, s, later, t in [(1, 1, 0, False, "abc"), (1, 1, 0, True, "ABC"), (1, 1, 0, True, "abd"), (2, 1, 0, False, "abd"), (2, 1, 0, True, "abd")]]
    out = list(exact_dedup.differing([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list("abcdef"))]))[0]
    assert out.column("sha").to_pylist() == [hashlib.sha256(b"abd").hexdigest()]


def test_html_extraction(spark):
    prose = "<p>Real &amp; true&nbsp;text  of page {0}.</p><ul><li>point {0}</li></ul>"
    page = (
        '<html><head><title>t</title><style>x</style></head><body><header>H</header><nav><a>N</a></nav><div class="cookie-notice">we use</div>'
        f"<article><h1>Head {{0}}</h1>{prose}<script>var a='</p>'</script><div class='box'><p>Read our other sites</p></div><p>line one<br>line two<form>f</form></article>"
        '<section id="comments"><p>me too</p></section><div class="strip">Same everywhere</div><footer>F</footer></body></html>'
    )
    plain = "<body><div class='x1'>Same everywhere, all pages</div><div>own text {0}<p>more {0}</div></body>"
    rows = [(i, "http://a.b/%d" % i, page.replace("{0}", str(i))) for i in range(30)]
    rows += [(100 + i, "http://c.d/%d" % i, plain.replace("{0}", str(i))) for i in range(30)]
    rows += [(200, None, None), (201, "http://e.f/", ""), (202, "x", "<p><b>open &am <i>tags <div>end &lt"), (None, "http://a.b/1", "a < b and c"), rows[0]]
    wrapped = "<body><div class='layout with-sidebar'><main>Kept <p>text</main><div class='sidebar'>S</div></div><section class='comments'><article class='comment'>me</article></section></body>"
    rows += [(300, "u://w", wrapped), (301, "u://w", "<div>only <b>this</b></div><section id=comments><article>c</article></section>")]
    got = {(r["page_id"], r["text"]) for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert (i, f"Head {i}\nReal & true text of page {i}.\npoint {i}\nline one line two") in got
        assert (100 + i, f"own text {i}\nmore {i}") in got
    assert {(300, "Kept\ntext"), (301, "only this"), (200, ""), (201, ""), (202, "open &am tags\nend <"), (None, "a < b and c")} <= got


def article_lines(page):
    """What stands in the article of a page of the tables, by regular expressions."""
    import html
    import re

    article = page[page.index("<article>") : (page + "</article>").index("</article>")]
    lines = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>?", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article)]
    return [w for w in lines if w]


@pytest.mark.parametrize("how", [{}, {"article": False}, {"declared": False, "article": False}])
def test_html_pages_of_the_table(spark, how):
    """With names and the article element switched off, recurrence on the host alone gives the same texts."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    if how:  # hosts with enough pages for anything to recur
        pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract(pages, **how).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = got[r["page_id"]]
        assert x["text"].split("\n") == article_lines(r["html"]) and x["n_chars"] == len(x["text"])


def test_html_templates_equal_a_count_by_hand(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):
        host = ["a.b", "c.d", "few.e"][0 if k < 30 else 1 if k < 56 else 2]
        links = "".join(f"<li><a href=/x>{rng.choice('pqrs')}</a></li>" for _ in range(rng.randrange(3, 7)))
        prose = "".join(f"<p>{' '.join(words(rng, rng.randrange(20, 60)))}</p>" for _ in range(rng.randrange(1, 5)))
        strip = "<div>same on most pages</div>" if rng.random() < 0.7 else ""
        odd = "<div><section><p>seldom</p></section></div>" if rng.random() < 0.1 else ""
        rows.append((k, f"http://{host}/{k}", f"<body><div><ul>{links}</ul></div>{strip}{odd}<div class=c{k % 2}><h1>{k}</h1>{prose}</div><span>x</span></body>"))
    rows.append((99, "http://a.b/copy", rows[0][2]))  # a copy counts once
    held = {}
    for host in ("a.b", "c.d", "few.e"):
        of = {h for _, u, h in rows if f"//{host}/" in u}
        pages = []
        for h in of:
            root = html_extract.parse(h)
            html_extract.measure(root)
            pages.append((html_extract.slots_of(root), root.chars))
        total, found = sum(c for _, c in pages), set()
        for path in {s[0] for slots, _ in pages for s in slots}:
            own = [s for slots, _ in pages for s in slots if s[0] == path]
            top = lambda i: max(sum(x[i] == y[i] for y in own) for x in own)  # noqa: B023, E731
            if len(own) >= 5 and len(own) >= 0.3 * len(pages) and (top(3) >= 0.5 * len(own) or top(1) >= 0.8 * len(own) and sum(x[4] for x in own) <= 0.15 * total):
                found.add(path)
        if found:
            held[host] = found
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    seen = df.select(html_extract.host_of(df.url).alias("host"), html_extract.subtrees_of("html").alias("s")).select("host", "s.*")
    got = {r["host"]: set(r["templates"]) for r in html_extract.templates(seen).collect()}
    assert got == held and set(held) == {"a.b", "c.d"} and all(held.values())


def test_html_keeps_prose_and_survives_odd_pages(spark, monkeypatch):
    kept = "<article><header><h1>Head</h1><label>by me</label></header><p class='legal'>law</p><p class=notice>note</p><ul class=tags><li>one</li></ul><fieldset>set</fieldset><div class='ad-box'>buy</div></article>"
    deep = "<div>" * 30_000 + "deep" + "</div>" * 100
    rows = [(0, "u://a/0", kept, "x", "y"), (1, "u://a/1", deep, "x", "y"), (2, "u://a/2", "<p>" + "long text " * 200_000, "x", "y"), (3, "u://a/3", "<div class=ad>" * 2000 + "<article>in", "x", "y"), (4, "u://a/4", "<a <b <<p>c</", "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, templates string")
    for hosts in (html_extract.BROADCAST_HOSTS, -1):  # the second joins by a shuffle
        monkeypatch.setattr(html_extract, "BROADCAST_HOSTS", hosts)
        got = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
        assert got[0] == "Head\nby me\nlaw\nnote\none\nset" and got[1] == "deep" and got[2] == ("long text " * 200_000).strip() and got[3] == "in" and len(got) == 5


def test_token_files(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "a<|endoftext|>b  c\u0301 İ'S\u00a0x\n\n y"), (901, " " * 50)], "doc_id long, text string"))
    every = [(r[0], r[1]) for r in rows] + [(900, "a<|endoftext|>b  c\u0301 İ'S\u00a0x\n\n y"), (901, " " * 50)]
    got = token_output.token_digests(more, path).collect()
    ids = {}
    for d, t in every:
        e = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        ids.setdefault(d, []).append((len(e), zlib.crc32(np.array(e, dtype="<u4").tobytes())))
    have = {}
    for r in got:
        have.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in ids.items()}
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"]) if r["doc_id"] is not None]
    assert order == sorted(order)


def test_words_of_the_token_encoder_equal_whole_texts():
    import public_tokenizers

    enc = token_output.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    bits = ["a", "B", "'s", "'S", "'", ".", ",", "é", "É", "—", "\u0301", "1", "22", "-", " ", "\n", "  ", "İ", "ß", "x'", "\u00a0", "\t", "!?", "#", "Z", "…", "<", "|>", "<|endoftext|>", "<|ENDOFTEXT|>"]
    for trial in range(12):
        texts = ["".join(rng.choice(bits[:26] if trial % 2 else bits) for _ in range(rng.randrange(0, 120))) for _ in range(150)] + [None, "", "\n"]
        ids, at = enc.encode(pa.array(texts), None)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == enc.tokenizer.encode(t or "", add_special_tokens=False).ids
    assert enc.folds and enc.marks_apart


def test_token_files_are_selective(spark, tmp_path):
    import glob

    import public_tokenizers
    import pyarrow.parquet as pq

    token_output.write_tokens(spark.read.parquet(f"{DATA}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), f"{tmp_path}/t")
    file = pq.ParquetFile(max(glob.glob(f"{tmp_path}/t/*.parquet")))
    group = file.metadata.row_group(0)
    cols = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    assert all(c.has_offset_index and c.has_column_index for c in cols.values())
    assert any("DELTA" in e for e in cols["doc_id"].encodings)
    assert any("DICTIONARY" in e for p, c in cols.items() if p.startswith("ids") for e in c.encodings)


def test_url_filters(spark):
    urls = ["http://a.example.com/en/7x?q", "HTTP://EXAMPLE.COM/en/8", "x://example.net/de/8#f", "x://notexample.net/de/1", "x://n.org/es/", "x://n.org/fr", None, "no scheme", "http://", "http://h?/en/", "http://bad.site/1", "http://bad.site:80/2", "http://sub.bad.site/3", "http://é.com/en/É"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0]), (None, urls[1])], "page_id long, url string")
    bad = spark.createDataFrame([(1000 + i, True) for i in range(40)] + [(2000 + i, False) for i in range(40)] + [(None, True), (3, None)], "page_id long, bad boolean")
    more = spark.createDataFrame([(1000 + i, "http://bad.site/") for i in range(40)] + [(2000 + i, f"http://good{i % 5}.example.org/") for i in range(40)], "page_id long, url string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages.unionByName(more), bad).where("page_id < 1000 OR page_id IS NULL").collect()}
    assert got == {
        (0, "a.example.com", "/en/7x", "example.com/en/7", "allow"), (1, "example.com", "/en/8", "com/en/", "block"), (2, "example.net", "/de/8", "example.net/de/8", "block"), (3, "notexample.net", "/de/1", "net/de/", "block"),
        (4, "n.org", "/es/", "org/es/", "block"), (5, "n.org", "/fr", None, "allow"), (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "", "", None, "allow"), (9, "h", "", None, "allow"),
        (10, "bad.site", "/1", None, "block"), (11, "bad.site:80", "/2", None, "block"), (12, "sub.bad.site", "/3", None, "block"), (13, "é.com", "/en/É", "com/en/", "block"), (None, "example.com", "/en/8", "com/en/", "block"),
    }


def test_url_reputations_block_some_hosts(spark, tmp_path):
    """Hosts of different records under several domains and suffixes; the SQL and a computation by hand agree, and no constant does."""
    import math

    from corpusloom.llm import queries

    rng = random.Random(14)
    pages, labels, counts = [], [], {}
    for h in range(40):
        host, share = f"h{h}.d{h % 9}.{['com', 'net', 'co.uk'][h % 3]}", [0.02, 0.1, 0.6, 0.95][h % 4]
        for _ in range(rng.randrange(1, 60)):
            n = len(pages)
            pages.append((n, f"https://{host}/en/{n}?x"))
            if rng.random() < 0.7:
                bad = rng.random() < share
                labels.append((n, int(not bad), 0))
                counts.setdefault(host, []).append(bad)
    pages += [(9000, "http://new.d2.co.uk/fr/1"), (9001, "http://elsewhere.org/" + "x" * 100_000), (9002, "http://h2.d2.co.uk/de/99999999999999999999")]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op5_url_filters(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP5})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"])) for r in got)

    def prior(units):
        n, b, k = sum(x[0] for x in units), sum(x[1] for x in units), len(units)
        m = b / n
        v = m * (1 - m)
        rho = (sum(x[1] ** 2 / x[0] for x in units) - b * b / n - v * (k - 1)) / (v * (n - sum(x[0] ** 2 for x in units) / n - (k - 1)))
        rho = min(0.9999, max(0.0001, rho))
        return (1 - rho) / rho, (b + 0.5) / (n + 1)

    up = lambda d, f: {k: tuple(map(sum, zip(*[v for x, v in d.items() if f(x) == k]))) for k in map(f, d)}
    domain = lambda h: ".".join(h.split(".")[-(3 if h.endswith("co.uk") else 2) :])
    suffix = lambda d: d.split(".", 1)[1]
    hosts = {h: (len(x), sum(x)) for h, x in counts.items()}
    domains = up(hosts, domain)
    suffixes = up(domains, suffix)
    (kh, root), (kd, _), (ks, _) = (prior(list(x.values())) for x in (hosts, domains, suffixes))
    verdicts = {}
    for h in {r["host"] for r in got}:
        d = domain(h)
        (hn, hb), (dn, db), (sn, sb) = hosts.get(h, (0, 0)), domains.get(d, (0, 0)), suffixes.get(suffix(d), (0, 0))
        m = (kh * ((kd * ((ks * root + sb) / (ks + sn)) + db) / (kd + dn)) + hb) / (kh + hn)
        verdicts[h] = "block" if m - 1.645 * math.sqrt(m * (1 - m) / (kh + hn + 1)) > min(1.5 * root, (1 + root) / 2) else "allow"
    assert all(r["verdict"] == verdicts[r["host"]] for r in got if r["rule"] is None)
    own = [verdicts[h] for h in hosts]
    assert 5 < own.count("block") < 30


def alike(a, b):
    """Equal, or one character apart where both lines are long enough and their digits agree."""
    if a == b:
        return True
    if min(len(a), len(b)) < line_dedup.LEAST or [c for c in a if c in "0123456789"] != [c for c in b if c in "0123456789"]:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def changed_line(rng, line):
    k = rng.randrange(len(line) + 1)
    return rng.choice([line[:k] + line[k + 1 :], line[:k] + "q" + line[k:], line[:k] + "q" + line[k + 1 :], line[:k] + "é" + line[k + 1 :], line[:k] + "7" + line[k + 1 :], line[:k] + " " + line[k:]])


def test_line_dedup(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 3)
    pool = [" ".join(word() for _ in range(n)) for n in (1, 1, 2, 3, 5, 8, 8, 11, 16, 30, 31, 32, 33, 64, 90) for _ in range(6)]
    pool += ["x" * n for n in (14, 15, 16, 17, 18, 62, 63, 64, 65, 66, 127, 128, 129)]
    for line in list(pool):
        pool += [changed_line(rng, line) for _ in range(3)]
    texts = ["\n".join(rng.choice(pool).replace("a", rng.choice("aA")) for _ in range(rng.randrange(0, 14))) for _ in range(70)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "\n \n\t"), (903, texts[3].replace(" ", " \t ")), (None, texts[3]), (0, texts[0]), (904, "y" * 5000), (905, "y" * 2000 + "z" + "y" * 3000), (906, "w" * 5000)]
    df = spark.createDataFrame([(*r, "k", "l") for r in rows], "doc_id long, text string, key string, nos string").repartition(4)
    lines = []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for no, line in enumerate((t or "").split("\n")) if t is not None else ():
            if w := " ".join(line.lower().split()):
                lines.append((d, no, w))
    gone = {(d, no) for i, (d, no, w) in enumerate(lines) if any(alike(w, v) for _, _, v in lines[:i])}
    assert len({w for _, _, w in lines}) > len(lines) - len(gone) and (905, 0) in gone and (906, 0) not in gone
    report = line_dedup.line_report(df).collect()
    assert {(r["doc_id"], int(no)) for r in report if r["dropped"] for no in r["dropped"].split(",")} == gone
    assert sorted((str(r["doc_id"]), r["n_lines"]) for r in report) == sorted((str(d), 0 if t is None else t.count("\n") + 1) for d, t in rows)
    out = {r["doc_id"]: r["text"] for r in line_dedup.without_repeated_lines(df).collect()}
    assert len(out) == len({r[0] for r in rows})
    for d, t in rows:
        assert out[d] == (None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (d, no) not in gone))


def test_short_lines_numbers_and_dates_stay(spark):
    texts = ["Yes\nNo\nTotal 12\n2019-01-01\nred", "Never\nblue car\nTotal 99\nalpha beta gamma delta\nPaid in full on 2019-01-01", "omega beta gamma delta\nPaid in full on 2019-01-02\nYES\nalpha beta gamma delt", "a line of its own kind\na line of its own kin d"]
    got = {r["doc_id"]: r["dropped"] for r in line_dedup.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "", 1: "", 2: "2,3", 3: "1"}


def test_a_very_long_line_costs_no_square(spark):
    import time

    rng = random.Random(4)
    line = " ".join(words(rng, 40_000))
    began = time.time()
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(spark.createDataFrame([(0, line), (1, line[:90_000] + line[90_001:]), (2, line + "x"), (3, line[::-1])], "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0} and time.time() - began < 60


def test_sentencepiece(docs, rows):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = SentencePieceProcessor(model_file=path), sentencepiece_codec.model_of(path)
    rng = random.Random(1)
    bits = [" ", "  ", "a", "b", "th", "e", "\n", "é", "▁", "漢", "😀", "<s>", "<0x0A>", "\t", "er", "ing", "\x00", "Z", "1", "..."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 200))) for _ in range(300)] + [r[1] for r in rows] + [" " * 300, "a" * 500]
    ids, at = sentencepiece_codec.encode_batch(model, pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == sp.encode(t or "")
    assert [b.decode() for b in sentencepiece_codec.decode_batch(model, ids, at)] == [(t or "").replace("▁", " ") for t in texts]
    text = " ".join(words(rng, 5000))
    marked = "▁" + text.replace(" ", "▁")
    for size in (1, 7, 4096):
        run, out = sentencepiece_codec.Stream(model), []
        for k in range(0, len(marked), size):
            out += run.feed(marked[k : k + size])
        assert len(out) > 0.9 * len(sp.encode(text))  # committed on the way
        assert out + run.end() == sp.encode(text)
        assert run.most_held <= 8 * model.longest
    got = sentencepiece_codec.digests(docs, path).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(r[0]), len(e := sp.encode(r[1] or "")), zlib.crc32(np.array(e, dtype="<u4").tobytes())) for r in rows)
    assert all(r["round_trip"] for r in got)


def test_lanes_commit_and_equal_the_library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, model = SentencePieceProcessor(model_file=path), sentencepiece_codec.Model(path)
    rng = random.Random(12)
    long = ["".join(rng.choice("aehinorst") for _ in range(rng.randrange(1, sentencepiece_codec.LANE))) for _ in range(300)]
    odd = ["a" * 200, "ab" * 100, "=-" * 90, "0" * 250, "th" * 128, "_" * 255]
    units = sorted(dict.fromkeys(long + odd), key=len, reverse=True)
    found = model.search_block(["▁" + w for w in units])
    assert sum(f is None for f in found) < 20  # all lanes but a few of repeated characters commit within the window
    for w, f in zip(units, found):
        assert f is None or np.frombuffer(f, dtype=np.int32).tolist() == sp.encode(w)
    assert [np.frombuffer(f, dtype=np.int32).tolist() for f in model.search_many(["▁" + w for w in units])] == [sp.encode(w) for w in units]


def test_word_table_is_only_a_cache():
    from corpusloom.llm import common

    rng = random.Random(3)
    pool = ["".join(rng.choice("abcé\0") for _ in range(rng.randrange(1, 60))) for _ in range(500)]
    make = lambda words: [np.arange(len(w) % 7, dtype=np.int32).tobytes() for w in words]
    for most in (1 << 20, 64):
        table = common.WordTable(make, most)
        table.BLOCK = 100
        for _ in range(5):
            texts = [None, "", " \n "] + [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 200))) + rng.choice(["", "\n"]) for _ in range(20)]
            data, at = common.text_bytes(pa.array(texts).slice(1))
            first, after, begin = common.word_spans(data, at, b" \n")
            values, sizes = table.lists(data, first, after)
            ends = np.concatenate([[0], np.cumsum(sizes)])[begin]
            for k, t in enumerate(texts[1:]):
                assert values[ends[k] : ends[k + 1]].tolist() == [x for w in t.encode().replace(b"\n", b" ").split(b" ") if w for x in range(len(w) % 7)]


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.predictions(docs).collect()}
    held = [(r["lang"], got[r["doc_id"]]) for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert all(g["held_out"] for _, g in held) and sum(g["held_out"] for g in got.values()) == len(held)
    assert np.mean([lang == g["lang_pred"] for lang, g in held]) > 0.97


def test_language_spans_and_odd_rows(spark):
    en, ru, fr = "the cat sat on the mat with the dog and the bird ", "мама мыла раму и папа читал книгу ", "le chat est sur la table avec les chiens et les oiseaux "
    rows = [(i, (en, ru, fr)[i % 3] * 3, ("en", "ru", "fr")[i % 3]) for i in range(60)]
    odd = [(100, None, "en"), (101, "123 !!", "en"), (102, "", None), (103, en * 5 + ru * 3 + en * 5, None), (104, "漢字 " + en, None), (None, fr, "fr"), (0, rows[0][1], "en")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.predictions(df).collect()}
    assert [got[k]["lang_pred"] for k in (100, 101, 102, 103, 104, None)] == ["und", "und", "und", "en", "en", "fr"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    marks = spark.createDataFrame([(1, "\u0301\u0300 \u0302"), (2, "e\u0301te\u0301 chat")], "doc_id long, text string")
    model = language_id.fit(df, "text", "lang", "doc_id")
    assert [r["language"]["lang"] for r in language_id.identify(marks, model).orderBy("doc_id").collect()] == ["und", "fr"]
    spans = language_id.identify(df.where("doc_id = 103"), model).first()["language"]["spans"]
    assert [s["lang"] for s in spans] == ["en", "ru", "en"]
    assert sorted(r["doc_id"] for r in language_id.keep_identified(df).where("doc_id >= 100").collect()) == [103, 104]
    empty = df.where("false")
    assert language_id.predictions(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.predictions(df.selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")).collect()} == {"und"}


def test_many_languages_have_fewer_slots(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rng = random.Random(19)
    names = [f"l{i}" for i in range(600)]
    rows = [(k * 600 + i, " ".join(letters[i % 26] + letters[i // 26] + rng.choice("xyz") for _ in range(8)), n) for k in range(3) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "ENTRIES", 1 << 21)
    model = language_id.fit(df, "text", "lang", "doc_id")
    assert model.logs.shape[0] * len(model.languages) <= 1 << 21 and len(model.languages) > 500
    got = language_id.identify(df, model).collect()
    assert np.mean([r["language"]["lang"] == r["lang"] for r in got]) > 0.8


def path_value(emit, codes, path, penalty):
    return sum(float(emit[c, x]) for c, x in zip(codes, path)) - penalty * sum(x != y for x, y in zip(path, path[1:]))


@pytest.mark.parametrize("piece", [2, 3, 256])
def test_viterbi_equals_enumeration(piece):
    rng = np.random.default_rng(4)
    emit = rng.normal(size=(9, 3)).astype(np.float32)
    lens = [0, 1, 5, 3, 7, 0, 8]
    codes = rng.integers(0, 9, sum(lens))
    starts = np.concatenate([[0], np.cumsum(lens)])
    path = language_id.viterbi(emit, codes, starts, 0.8, piece)
    for a, b in itertools.pairwise(starts.tolist()):
        best = max((path_value(emit, codes[a:b], p, 0.8) for p in itertools.product(range(3), repeat=b - a)), default=0)
        assert path_value(emit, codes[a:b], path[a:b].tolist(), 0.8) == pytest.approx(best, abs=1e-5)


def test_viterbi_in_pieces_equals_whole():
    rng = np.random.default_rng(5)
    lens = np.concatenate([rng.integers(0, 900, 30), [5000]])
    starts = np.concatenate([[0], np.cumsum(lens)])
    emit = rng.normal(size=(starts[-1], 4)).astype(np.float32) * 3
    emit[50:60, 1] = -1e6
    codes = np.arange(len(emit))
    whole, parts = (language_id.viterbi(emit, codes, starts, 6.0, piece) for piece in (10_000, 64))
    for a, b in itertools.pairwise(starts.tolist()):
        assert path_value(emit, codes[a:b], parts[a:b].tolist(), 6.0) == pytest.approx(path_value(emit, codes[a:b], whole[a:b].tolist(), 6.0), abs=1e-2)


def brute_windows(texts, items, n=10):
    out = []
    for t in texts:
        w = decontaminate.words_of(t)
        hit, names = set(), set()
        for k, x in items:
            v = decontaminate.words_of(x)
            m = min(n, len(v))
            wins = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
            for i in range(len(w) - m + 1 if m else 0):
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    names.add(k)
        out.append((len(w), hit, names))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_decontamination(spark, short):
    rng = random.Random(6)
    w = lambda n: [rng.choice(["ab", "c", "d1", "é", "the"]) for _ in range(n)]
    items = [(str(i), " ".join(w(rng.randrange(10, 25)))) for i in range(20)] + [("99", ""), ("98", "..")]
    items += [("50", "qq"), ("51", "the c d1")] if short else []
    texts = []
    for _ in range(80):
        t = w(rng.randrange(0, 60))
        if rng.random() < 0.5:
            t[3:3] = decontaminate.words_of(rng.choice(items)[1].upper()) and rng.choice(items)[1].upper().split()
        texts.append(", ".join(t) if rng.random() < 0.5 else " ".join(t))
    texts += ["", None, "qq", "the C; d1", items[0][1] + " x " + items[0][1]]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    bench = spark.createDataFrame([*items, items[0], (None, "ab ab"), ("7x", None)], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.digests(decontaminate.find_contamination(df.select("doc_id", "text"), bench)).collect()}
    clean = {r["doc_id"]: r["text"] for r in decontaminate.remove_contamination(df, bench).collect()}
    for i, (n, hit, names) in enumerate(brute_windows(texts, items)):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, len(hit), len(names), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        left = [x for k, x in enumerate(decontaminate.words_of(texts[i])) if k not in hit]
        if hit and not left:
            assert i not in clean
        elif hit:
            assert decontaminate.words_of(clean[i]) == left
        else:
            assert clean[i] == texts[i]


def test_decontamination_in_blocks(spark, monkeypatch):
    """A benchmark of many blocks gives what one block gives; a text with copies is one key."""
    rng = random.Random(16)
    w = lambda n: " ".join(rng.choice(["ab", "c", "d1", "é", "the", "zz"]) for _ in range(n))
    items = [(i, w(rng.randrange(1, 40))) for i in range(30)]
    texts = [w(rng.randrange(0, 40)) + " " + rng.choice(items)[1] + " " + w(9) for _ in range(40)] + [None, "", "."]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(texts * 2)], "doc_id long, text string, found string, __rows_ int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.find_contamination(df, bench)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    for broadcast in (decontaminate.BROADCAST_ROWS, -1):
        monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
        many = decontaminate.find_contamination(df, bench)
        assert many.columns == one.columns
        assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
        cut = decontaminate.remove_contamination(df, bench)
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 1 << 20)
        assert sorted(map(str, cut.collect())) == sorted(map(str, decontaminate.remove_contamination(df, bench).collect()))
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)


def test_windows_of_a_block_are_small():
    import tracemalloc

    rng = random.Random(17)
    items = [(str(i), " ".join(words(rng, 500))) for i in range(300)]
    tracemalloc.start()
    held = decontaminate.Windows(items, 10)
    assert tracemalloc.get_traced_memory()[0] < 12 * sum(len(t) for _, t in items) and held.by_length
    tracemalloc.stop()


def test_fm_index():
    rng = np.random.default_rng(0)
    seq = rng.integers(1, 5, 500)
    index = decontaminate.FMIndex(seq, 6)
    for n in (1, 2, 5):
        pats = rng.integers(1, 6, (40, n))
        low, high = index.search(pats)
        for p, a, b in zip(pats, low, high):
            want = [i for i in range(len(seq) - n + 1) if (seq[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def least(sizes, shards):
    def fits(c):
        n, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("ranges", [4, 50, sharding.RANGES])
def test_sharding(docs, rows, ranges, monkeypatch):
    monkeypatch.setattr(sharding.minimax_cuts, "__defaults__", (ranges,))
    got = sharding.shard(docs.where("n_chars IS NULL OR n_chars < 9")).collect()
    assert sorted((str(r["id"]), r["size"], r["text_crc32"]) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    groups = {}
    for r in rows:
        t = (r[1] or "").encode()
        groups.setdefault(hashlib.sha256(t).hexdigest(), []).append(len(t) + 1)
    by_shard = {}
    for r in got:
        by_shard.setdefault(r["shard"], []).append(r)
    assert max(sum(r["size"] for r in x) for x in by_shard.values()) == least([sum(groups[g]) for g in sorted(groups)], 16)
    assert set(by_shard) <= set(range(16))
    for x in by_shard.values():
        assert sorted(r["slot"] for r in x) == list(range(len(x)))
    home = {}
    for r in got:
        home.setdefault((r["size"], r["text_crc32"]), set()).add(r["shard"])
    assert all(len(s) == 1 for s in home.values())


def test_empty_tables(spark, docs):
    import public_tokenizers

    none = docs.where("false")
    word, piece = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    bench = spark.createDataFrame([], "item_id long, text string")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    outcomes = spark.createDataFrame([], "page_id long, bad boolean")
    for df in (
        simhash.near_duplicates(none), simhash.drop_near_duplicates(none), exact_dedup.exact_duplicates(none), token_output.token_digests(none, word), line_dedup.line_report(none), sentencepiece_codec.digests(none, piece),
        decontaminate.find_contamination(none, bench), sharding.shard(none), html_extract.extract(pages), url_filters.judge(pages, outcomes),
    ):
        assert df.count() == 0
    assert decontaminate.remove_contamination(docs, bench).count() == docs.count()


@pytest.mark.parametrize("name", ["op3_exact_dedup", "op5_url_filters", "op6_line_dedup", "op9_decontaminate"])
def test_sql(spark, name, tmp_path):
    from corpusloom.llm import queries

    df = queries.queries()[name](spark, DATA)
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cols = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*cols).collect())


def test_work_tables_can_be_dropped(spark, docs):
    import os

    from corpusloom.llm import common

    common.materialise(docs, "x")
    folder = common.session_dir(spark).removeprefix("file:")
    assert os.listdir(folder)
    common.drop_work_tables(spark)
    assert not os.path.exists(folder)
