"""URL filters over aliases, periodic runs and vector codes, against brute-force versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pandas as pd
import pytest

from gristmill.llm import periodic, queries, scratch, urlfilter, vectorcode

# --- 11 ---

PAGES = "page_id long, url string, html string, host int, node string, `a.b` int"


def page(*tags):
    return "<!DOCTYPE html><html><head>" + "".join(tags) + "</head><body>canonical refresh</body></html>"


def canonical(to):
    return f'<link rel="canonical" href="{to}">'


def refresh(to):
    return f"<META content='0; URL={to}' HTTP-EQUIV=refresh>"


ROWS = [
    (1, "http://a.net/es/1", page()),  # blocked by rule
    (2, "http://b.org/x?q=1#top", page(canonical("http://A.net/es/1"))),  # alias of it
    (3, "http://c.org/", page(refresh("http://b.org/x?q=1"))),  # alias of an alias
    (4, "http://www.example.com/en/1", page(canonical("http://c.org"))),  # explicit allow, in the same component
    (5, "http://d.org/5", page(canonical("http://www.example.com/en/1"))),  # blocked over an allowed one
    (6, "http://d.org/6", page(canonical("http://sub.example.com/en/nowhere"))),  # its target is no page here, but is blocked
    (7, "http://d.org/7", page(canonical("http://d.org/8"))),
    (8, "http://d.org/8", page()),
    (9, "http://d.org/9", page("<!--", canonical("http://a.net/es/1"), "-->", "<script>", canonical("http://a.net/es/1"), "</script>")),
    (10, "http://E.Org/dir/page", page("<base href='/other/'>", "<link href=../../dir/sub rel='x CANONICAL y'>")),
    (11, "http://e.org/dir/sub", page(refresh("//a.net/es/2?a=1&amp;b=2"))),
    (12, "http://f.net/fr/1", None),
    (13, None, page(canonical("http://a.net/es/1"))),
    (14, "no scheme a.net/es/1", page(canonical("http://a.net/es/1"))),
    (15, "", ""),
    (None, "http://b.org/x?q=1", "x" * 3_000_000),
    (2, "http://b.org/x?q=1#top", page(canonical("http://a.net/es/1"))),
    (16, "http://com", page()),
    (17, "http://net/es/", page()),
    (18, "https://COM.example.COM/EN/?a://b/", page(canonical("http://[bad"), refresh("http://d.org/8"))),
    (19, "http://examplexcom/en/", page("<link rel=canonical>", "<meta http-equiv=refresh content=5>")),
]


def plain_verdicts(rows, rules):
    def split(u):
        if not u or "://" not in u:
            return "", "", None
        scheme, rest = u.split("://", 1)
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, rest = rest[:cut].lower(), rest[cut:].split("#")[0]
        path = rest.split("?")[0]
        return host, path, f"{scheme.lower()}://{host}{path or '/'}{rest[len(path):]}"

    def rule(u):
        host, path, _ = split(u)
        fit = [(len(h + p), a == "allow", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fit)[2:] if fit else None

    edges = {2: "http://a.net/es/1", 3: "http://b.org/x?q=1", 4: "http://c.org/", 5: "http://www.example.com/en/1", 6: "http://sub.example.com/en/nowhere", 7: "http://d.org/8", 10: "http://e.org/dir/sub", 11: "http://a.net/es/2?a=1&b=2", 18: "http://d.org/8"}
    near = collections.defaultdict(set)
    blocked = set()
    for i, u, _ in rows:
        for v in (u, edges.get(i)):
            if v and split(v)[2] and (r := rule(v)) and r[1] == "block":
                blocked.add(split(v)[2])
        if i in edges:
            a, b = split(u)[2], split(edges[i])[2]
            near[a].add(b)
            near[b].add(a)
    todo = list(blocked)
    while todo:
        for v in near[todo.pop()] - blocked:
            blocked.add(v)
            todo.append(v)
    out = []
    for i, u, _ in rows:
        host, path, node = split(u)
        r = rule(u)
        out.append((i, host, path, r and r[0], r[1] if r else "block" if node in blocked else "allow"))
    return collections.Counter(out)


def test_verdicts_reach_aliases(spark):
    frame = spark.createDataFrame([(*r, 1, "clash", 2) for r in ROWS], PAGES).repartition(3)
    found = urlfilter.judge(frame, queries.URL_RULES)
    got = found.collect()
    assert collections.Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == plain_verdicts(ROWS, queries.URL_RULES)
    assert {r.page_id for r in got if r.via_alias} == {2, 3, 5, 6, 10, 11, None}
    assert urlfilter.judge(frame.where("false"), queries.URL_RULES).count() == 0


def test_redirect_logs_and_ties(spark):
    frame = spark.createDataFrame([(1, "http://x.org/", None), (2, "http://y.org/", None), (3, "http://a.b/xcd", "")], "page_id long, url string, html string")
    log = spark.createDataFrame([("http://x.org", "http://Bad.org/"), (None, "http://y.org/"), ("http://y.org/", "relative")], "src string, dst string")
    rules = [("block", "bad.org", ""), ("block", "b", "/xcd"), ("allow", "a.b", "/x")]
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(frame, rules, log).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: ("a.b/x", "allow")}
    assert {r.verdict for r in urlfilter.judge(frame, [], log).collect()} == {"allow"}


def test_long_chains_and_hubs(spark):
    """A chain of 300 redirects ends at a blocked address; 500 pages share one canonical address that is not."""
    rows = [(i, f"http://h.org/{i}", page(refresh(f"/{i + 1}"))) for i in range(300)] + [(300, "http://h.org/300", page(canonical("http://x.net/fr/z")))]
    rows += [(1000 + i, f"http://hub.org/?{i}", page(canonical("/"))) for i in range(500)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(frame, queries.URL_RULES).collect()}
    assert got == {i: "block" if i < 1000 else "allow" for i, *_ in rows}


# --- 12 ---


def plain_runs(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i:
                start, length = i, j - i + q
                part = w[start : start + length]
                smallest = next(d for d in range(1, q + 1) if part[d:] == part[:-d])
                if smallest == q and length >= max(6, 4 * q):
                    out.append((start, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(i, text, plant):
    w = text.encode().split() if text else []
    n = len(w)
    if plant and i is not None and n and zlib.crc32(str(i).encode()) % 10 == 0:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % n
        p = 1 + math.floor((n - a) / (3 + g % 8))
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {k for s, m, q in runs for k in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(kept))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(250):
        w = []
        while len(w) < rng.randint(0, 70):
            unit = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
            w += unit * rng.choice([1, 1, 2, 4, 5, 7])
            w += unit[: rng.randint(0, len(unit))]
        assert periodic.find_runs(np.array(w, np.int64)) == plain_runs(w), w


def test_common_prefixes_are_right():
    rng = random.Random(9)
    for _ in range(60):
        w = [rng.randrange(2) for _ in range(rng.randint(2, 60))]
        left, right, lcp = periodic.suffix_neighbours(np.array(w))
        order = sorted(range(len(w)), key=lambda i: w[i:])
        assert [*left, right[-1]] == order
        for a, b, n in zip(left, right, lcp, strict=True):
            assert w[a : a + n] == w[b : b + n] and (max(a, b) + n == len(w) or w[a + n] != w[b + n])


def test_periodic_runs(spark):
    rng = random.Random(12)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 120)))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, " \t\n"), (203, "a " * 6), (204, "A a A a A a A a"), (205, "é\u00a0x é\u00a0x é\u00a0x é\u00a0x é\u00a0x é\u00a0x"), (206, "a\x0bb\x1ca b\fa " * 4), (None, "x " * 9), (None, None), (3, "z " * 8), (3, "z " * 8), (207, "a a a a a a b b b b b b")]
    texts += [(208, "the same line of words again\n" * 40), (209, " ".join(f"w{i}" for i in range(20_000)) + " loop the loop" * 900)]
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts], "doc_id long, text string, start int, id string, `n.runs` int").repartition(3)
    for plant in (True, False):
        got = collections.Counter(tuple(r) for r in periodic.periodic_runs(frame, change=periodic.repeating if plant else None).collect())
        assert got == collections.Counter(plain_row(i, t, plant) for i, t in texts if i != 209) + collections.Counter(r for r in got if r[0] == 209)
        assert plant or next(r for r in got if r[0] == 209)[1:6] == (1, 20000, 2700, 3, 900000)
    assert periodic.periodic_runs(frame.where("false")).count() == 0


def test_very_long_periodic_texts_are_quick():
    """Texts of 200,000 words: one word, a period of a third of a third, and copies of one passage."""
    rng = np.random.default_rng(3)
    n = 200_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    unit = rng.integers(0, 50, n // 9)
    assert (0, 9 * len(unit), len(unit)) in periodic.find_runs(np.tile(unit, 9))
    passage = rng.integers(0, 1 << 40, 1000)
    apart = np.concatenate([np.r_[passage, rng.integers(0, 1 << 40, 7)] for _ in range(200)])
    assert periodic.find_runs(apart) == []


# --- 13 ---


def plain_codes(rows):
    """Rows (vec_id, vector, label) to the contract's rows, one part at a time."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return collections.Counter()
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    cuts = [k * dim // 4 for k in range(5)]
    part = lambda v, k: v[cuts[k] : cuts[k + 1]]
    books = [[part(v, k) for _, v, _ in kept[:256]] for k in range(4)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(4):
        for k in range(4):
            own = collections.defaultdict(list)
            for _, v, _ in kept:
                own[best(part(v, k), books[k])[1]].append(part(v, k))
            for e, xs in own.items():
                books[k][e] = [sum(c) // len(xs) for c in zip(*xs)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, lab, [best(part(v, k), books[k]) for k in range(4)]) for i, v, lab in kept]
    total = collections.Counter()
    for _, lab, b in found:
        total[lab] += sum(d for d, _ in b)
    most = (1 << 63) - 1
    return collections.Counter((i, "".join(f"{e:02x}" for _, e in b), min(sum(d for d, _ in b), most), min(total[lab], most), sha) for i, lab, b in found)


VECTORS = "vec_id long, embedding array<double>, label int, vec int, error string, `a.b` int"


@pytest.mark.parametrize("dim", [8, 6, 3, 0])
def test_codes_equal_brute_force(spark, dim):
    rng = random.Random(dim)
    point = lambda: [rng.choice([-1.5, 0.001, rng.gauss(0, 1)]) for _ in range(dim)]
    rows = [(rng.randrange(1000), point(), rng.choice([0, 1, None])) for _ in range(400)]
    rows += [(5000 + i, rows[0][1], 7) for i in range(200)]  # a third of all rows are one vector
    rows += [(1, None, 1), (2, [None] * max(1, dim), 1), (3, [float("nan")] * max(1, dim), 1), (4, [float("inf")] + [0.0] * max(0, dim - 1), 1), (None, point(), 2), (6000, [1.0] * (dim + 1), 1)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS).repartition(5)
    got = collections.Counter(tuple(r) for r in vectorcode.compress(frame).collect())
    assert got == plain_codes(rows)


def test_codes_of_few_rows_and_large_numbers(spark):
    rows = [(3, [1e300, -1e300, 2.0**52, 0.1], 1), (1, [1e18, 3.0, -0.0, 1 / 3], 1), (2, [5.0, 4.0, 3.0, 2.0], None), (2, [5.0, 4.0, 3.0, 2.0], None)]
    frame = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], VECTORS)
    assert collections.Counter(tuple(r) for r in vectorcode.compress(frame).collect()) == plain_codes(rows)
    assert vectorcode.compress(frame.where("false")).count() == 0
    assert vectorcode.compress(frame.where("false")).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_members_stay_with_their_owner(spark):
    """Only parts that change their entry are shuffled after the first round, and hot entries are spread."""
    owners = vectorcode.Owners(40)
    at = owners(2, np.full(1000, 7), np.arange(1000))
    assert len(set(at.tolist())) == owners.salts == 10 and collections.Counter(at.tolist()).most_common(1)[0][1] == 100
    parts = np.array([[0], [1], [9], [10]], np.int32)
    books = [np.array([[0], [10]])] * 4
    moved = list(vectorcode.dealt([(1, np.array([0, 1, 1, 1], np.int16), np.zeros(4, np.int32), parts)], books, owners))
    stay = [m for _, stays, m in moved if stays]
    assert [m[3].ravel().tolist() for m in stay] == [[0, 9, 10]]
    assert [(m[1].tolist(), m[3].ravel().tolist()) for _, stays, m in moved if not stays] == [([0], [1])]


def test_tables_hold_links_runs_and_codes(spark):
    """The registered queries answer every row of their whole table."""
    for name, table in (("op11_url_filters", "pages"), ("op12_periodic_runs", "documents"), ("op13_vector_codes", "embeddings")):
        out = scratch.write(queries.queries()[name](spark, "/root/testdata/sf0.001"), "whole")
        assert out.count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    for r in docs:
        if len(r.text or "") < 6000:
            assert got[r.doc_id] == plain_row(r.doc_id, r.text, True)


# --- large tiles of the Jaccard join ---


def test_boundary_sets_are_never_missed():
    """Every pair of sets of different groups that links is flagged, over all widths of bitmaps; sets far from all others are not."""
    from gristmill.llm import jaccard

    rng = np.random.default_rng(7)
    for percent in (80, 90):
        sets, groups = [], []
        for g in range(30):
            base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(20, 300)), dtype=np.uint64))
            for _ in range(int(rng.integers(1, 4))):
                keep = rng.random(len(base)) > rng.choice([0.0, 0.04, 0.15])
                sets.append(base[keep])
                groups.append(int(rng.integers(0, 60)))
        sizes, groups = np.array([len(s) for s in sets]), np.array(groups)
        got = set(jaccard.boundary(sizes, groups, [jaccard.bitmap(s, jaccard.width_of(len(s))) for s in sets], percent).tolist())
        near = set()
        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if groups[i] != groups[j] and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    near |= {i, j}
        assert near and near <= got and len(got) < len(sets)


# --- faults that were found in earlier operators ---


def test_a_dominant_text_hides_no_language(spark, monkeypatch):
    from gristmill.llm import langid

    monkeypatch.setattr(langid, "TRAIN_TEXTS", 10)
    monkeypatch.setattr(langid, "STEPS", 2)
    rows = [("toujours le même texte", "fr")] * 4000 + [(f"un autre texte numéro {i} de plus", "fr") for i in range(5)] + [(f"some english words {i} here", "en") for i in range(30)]
    model = langid.train_model(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    assert model.languages == ["en", "fr"]


def test_context_of_a_key_that_stands_twice(spark):
    from gristmill.llm import secrets

    key = "a1B2c3D4e5F6a7B8c9D0"
    frame = spark.createDataFrame([(1, f"see id={key}&token={key};x end", "s")], "doc_id long, text string, source string")
    got = [(r.part, r.before, r.behind) for r in secrets.candidates(frame).orderBy("part").collect()]
    assert [(b, c) for _, b, c in got] == [("see id=", f"&token={key};x end"), (f"see id={key}&token=", ";x end")]


def test_equal_rows_are_split_between_shards(spark, monkeypatch):
    from gristmill.llm import packing

    monkeypatch.setattr(packing, "SHARD_BYTES", 1 << 14)
    rows = [(7, "the very same words in the very same row " * 3)] * 3000 + [(None, "no id at all")] * 2000
    frame = spark.createDataFrame(rows, "id long, text string").repartition(4)
    total = sum(len(t) + 8 for _, t in rows)
    sizes = [r.b for r in packing.dealt(frame, total).selectExpr("shard", "octet_length(text) + 8 as b").groupBy("shard").agg({"b": "sum"}).withColumnRenamed("sum(b)", "b").collect()]
    assert sum(sizes) == total and max(sizes) <= 1.5 * packing.SHARD_BYTES
