"""Pipeline operators on small tables: odd rows, and results against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sourcelight.llm import (
    components, exact_dedup, html_text, mixing, oracles, packing, parity_join, pii, quality, queries, simhash, spans, url_rules,
)

FOLDER = "/root/testdata/sf0.001"
#: Names that the operators use inside must not matter in a table.
EXTRA = "doc string, key string, digest string, n string, _w string, bucket string, score string, _gone_id string, page string"
SHAPE = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
LONG = "the quick brown fox jumps over it. " * 4000
ODD = [
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, "   \n\t ", None, "a"),
    (4, "one", "en", "a"),
    (5, "one", "en", "b"),
    (5, "one", "en", "b"),
    (6, LONG, "en", "b"),
    (7, LONG, "en", "b"),
    (8, "É à ß 漢字 😀 naïve " * 30, "fr", "c"),
    (None, "a text without an id, as long as others. It has sentences. Three of them.", "en", "a"),
    (9, "A text without an id, as long as others. It has sentences. Three of them.", "en", "a"),
]


def docs_of(spark, rows):
    extra = ("x",) * len(EXTRA.split(","))
    full = [(i, t, lang, s, None if t is None else len(t), *extra) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SHAPE)


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [])


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] or "" for r in df.select("doc_id", "text").collect()}


# --- exact dedup ----------------------------------------------------------------------


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    keep = {t: max(v, key=lambda i: (i is not None, i)) for t, v in groups.items()}
    return {(i, keep[t], len(groups[t]), i == keep[t], t) for i, t in [(i, t or "") for i, t in rows]}


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_groups(spark, odd, none, bits):
    """Also with a digest of one hex digit, where different texts meet."""

    def short(text):
        return F.substring(exact_dedup.sha256(text), 1, bits)

    rows = exact_dedup.exact_groups(odd, digest=short).collect()
    by_hash = defaultdict(set)
    for _, t, *_ in ODD:
        by_hash[hashlib.sha256((t or "").encode()).hexdigest()[:bits]].add(t or "")
    want = brute_exact([(i, t) for i, t, *_ in ODD])
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows)
    assert got == Counter(w[:4] for w in want)
    assert {r["repeats"] for r in rows if r["doc_id"] == 5} == {2}
    assert exact_dedup.exact_groups(none).count() == 0


def test_many_clashing_digests(spark):
    rows = [(i, f"text {i % 37}", "en", "a") for i in range(300)]
    got = exact_dedup.exact_groups(docs_of(spark, rows), digest=lambda t: F.substring(exact_dedup.sha256(t), 1, 1))
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()}
    assert found == {w[:4] for w in brute_exact([r[:2] for r in rows])}


def test_state_goes_on(spark, tmp_path):
    """A second call continues the state; nothing expires."""
    arrivals, state = str(tmp_path / "in"), str(tmp_path / "state")
    for first in (0, 100):
        rows = spark.range(first, first + 100).select(
            F.col("id").alias("doc_id"), (F.col("id") % 30).cast("string").alias("digest"), F.lit("f").alias("locator")
        )
        rows.repartition(3).write.mode("append").parquet(arrivals)
        out = exact_dedup.advance_state(spark, arrivals, state, max_files_per_trigger=1).collect()
    assert {(r["digest"], r["keep"]["doc_id"], r["group_size"]) for r in out} == {
        (str(k), max(range(k, 200, 30)), len(range(k, 200, 30))) for k in range(30)
    }


def test_exact_stage(spark, odd, none):
    kept = exact_dedup.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([2, 3, 5, 7, 8, None, 9])
    assert exact_dedup.keep_one_of_each(none).count() == 0


def test_exact_stage_keeps_other_texts_of_an_id(spark):
    rows = [(1, "same", "en", "a"), (1, "other", "en", "a"), (2, "same", "en", "a"), (None, "same", "en", "a"), (None, "alone", "en", "a")]
    kept = exact_dedup.keep_one_of_each(docs_of(spark, rows)).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(1, "other"), (2, "same"), (None, "alone")]))


def test_one_id_never_floods_the_sample(spark):
    rows = [(i, "good words here and there " * 3, "en", "a") for i in range(30)] + [(40, f"bad {i} !!!", "en", "a") for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(40, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs_of(spark, rows), labels)
    used = [i for i in [*range(30), 40] if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(model.labels) == len(used)


# --- personal data --------------------------------------------------------------------


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(d) <= 19 and luhn(d),
                "phone": 9 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


TRICKY = [
    "a@b.c_d@e.f x.@y.z..q@r.s",
    "call +1 (017) 555-7713 or +1--------2 or +123456789012345678",
    "1.2.3.4.5.6.7.8 256.1.1.1 001.02.003.4 1.2.3.00000000000000000255",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 41111111111111111111111",
    "😀😀 é4111111111111111 a@b.co\n+4912345678901",
    "5" * 30000,
    "a" * 5000 + "@" + "b-" * 3000 + ".c",
    "@@@ +++ ...",
]


def test_pii(spark, odd, none, given):
    rows = [(100 + i, t, "en", "a") for i, t in enumerate(TRICKY)]
    rng = random.Random(5)
    rows += [(200 + i, "".join(rng.choice("0123456789.@+-( a\x1f") for _ in range(60)), "en", "a") for i in range(300)]
    for docs in (docs_of(spark, rows), odd.where("doc_id is not null"), given):
        texts = texts_of(docs)
        got = pii.pii_report(docs).collect()
        assert {r["doc_id"] for r in got} == set(texts)
        for r in got:
            want = base_spans(texts[r["doc_id"]])
            assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (texts[r["doc_id"]], r["spans"], want)
            assert r["n_card"] == want.count("card:")
    assert pii.pii_report(none).count() == 0


def test_added_kinds(spark):
    rows = [
        (1, "my IBAN is GB82 WEST 1234 5698 7654 32, thanks", "en", "a"),
        (2, "no: GB82 WEST 1234 5698 7654 33", "en", "a"),
        (3, "social security 219-09-9999", "en", "a"),
        (4, "part number 219-09-9999", "en", "a"),
    ]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(docs_of(spark, rows)).collect()}
    assert got == {1: "iban:11:38", 2: "", 3: "ssn:16:27", 4: ""}


def test_account_numbers_before_words(spark):
    """A number ends where its country's length says, whatever follows."""
    de, no = "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"
    follow = [" BIC COBADEFF370", " EUR 20", " 20.50 EUR", ", thanks", ""]
    rows = [(i, f"IBAN {n}{f}", "en", "a") for i, (n, f) in enumerate((n, f) for n in (de, de.replace(" ", ""), no) for f in follow)]
    rows.append((90, "IBAN DE89 3704 0044 0532 0130 01 BIC COBADEFF370", "en", "a"))
    got = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith("iban")] for r in pii.pii_report(docs_of(spark, rows)).collect()}
    ends = [5 + len(n) for n in (de, de.replace(" ", ""), no) for _ in follow]
    assert got == {i: [f"iban:5:{e}"] for i, e in enumerate(ends)} | {90: []}


# --- mixing ---------------------------------------------------------------------------


def test_mixing(spark, given, odd, none):
    rows = mixing.measured(given)
    weights, exponent = mixing.mixture(rows, max_repetition=1.25)
    w = {r["source"]: r for r in weights.collect()}
    assert 0 <= exponent <= 1 and abs(sum(r["weight"] for r in w.values()) - 1) < 1e-6
    assert max(r["epochs"] for r in w.values()) <= 1.251 and min(r["epochs"] for r in w.values()) >= 1
    placed = mixing.schedule(rows, weights, block_tokens=20000).collect()
    drawn = Counter(r["doc_id"] for r in placed)
    assert set(drawn) == set(texts_of(given))
    tokens = defaultdict(int)
    for r in placed:
        tokens[r["source"]] += r["n_tokens"]
    longest = max(r["n_tokens"] for r in placed)
    for s, r in w.items():
        assert r["quota"] - longest <= tokens[s] <= r["quota"] + longest
    blocks = defaultdict(list)
    for r in placed:
        blocks[r["block"]].append(r["place"])
    assert all(sorted(v) == list(range(len(v))) for v in blocks.values())
    assert {r["doc_id"] for r in mixing.mix_sources(odd).collect()} == {i for i, *_ in ODD}
    assert mixing.mix_sources(none).count() == 0


def test_mixing_targets(spark):
    shares = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "source string, tokens bigint")
    for target in (0.5, 0.9, 1.0):
        a = mixing.find_exponent(shares, target_entropy=target)
        p = [x**a for x in (0.9, 0.09, 0.01)]
        h = -sum(x / sum(p) * math.log(x / sum(p)) for x in p) / math.log(3)
        assert abs(h - target) < 1e-4
    assert abs(mixing.find_exponent(shares, max_repetition=3.0) - (1 - math.log(3) / math.log(90))) < 2e-6
    with pytest.raises(ValueError):
        mixing.find_exponent(shares)


def test_mixing_budget(spark, given):
    rows = mixing.measured(given)
    weights, _ = mixing.mixture(rows, max_repetition=2.0, budget=5000)
    total = sum(r["n_tokens"] for r in mixing.schedule(rows, weights, 1000).collect())
    assert total >= 5000 * 0.9
    mixed = mixing.mixed_documents(given)
    assert mixed.columns == given.columns and set(texts_of(mixed)) == set(texts_of(given))


# --- main text ------------------------------------------------------------------------


def page(nav, body, extra=""):
    return (
        f"<html><head><title>t</title></head><body><nav><a>{nav}</a></nav>{extra}<article>{body}</article>"
        "<footer>f &copy;</footer></body></html>"
    )


def test_main_text_markup(spark):
    rows = [
        (1, "http://a.b/1", page("x", "<h1>T &amp;amp; t</h1><p>one<b>two</b><br>three<p> four \n\t five&nbsp;six")),
        (2, "http://a.b/2", None),
        (3, None, ""),
        (4, "http://a.b/4", page("x", "<p>keep</p><div class='share-bar'>no</div><form>no</form><aside>no</aside>")),
        (5, "http://a.b/5", page("x", "<p>a<script>if (a<b) '</p>'</script>b</p><!-- c --><style>p{}</style>")),
        (6, "http://a.b/6", page("x", "<p>x</p><section id='comments'><p>reader</p></section>", "<div class=ad>ad</div>")),
        (7, "no scheme", "<div>just <i>text</i></div><div>more &lt;b&gt;</div>"),
        (8, "http://a.b/8", "<ul><li>one<li>two</ul><table><tr><td>a<td>b</table> tail &am"),
        (10, "http://a.b/10", page("x", "<div class='entry-header'><h1>Title</h1></div><p>text</p><ol class=commentlist><li>no</ol>",
                                   "<div id=site-header>no</div>")),
        (9, "http://a.b/9", page("x", "<a title='x > y'>link</a> 2 < 3")),
    ]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_texts(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = {
        1: "T &amp; t onetwo three four five six", 2: "", 3: "", 4: "keep", 5: "ab", 6: "x",
        7: "just text more <b>", 8: "one two a b tail &am", 9: "link 2 < 3", 10: "Title text",
    }
    assert got == {k: (v, len(v)) for k, v in want.items()}
    assert html_text.main_texts(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_site_templates(spark):
    """A box that stands around many texts of one host goes, there alone; a passage that articles share stays."""
    box = "<div><span>Best offers</span></div>"
    shared = "<p>A passage that all of them quote.</p>"
    rows = [(i, f"http://x.org/{i}", f"<body>{box}<div><p>text {i}</p></div></body>") for i in range(20)]
    rows += [(100 + i, f"http://y.org/{i}", f"<body>{box}<div><p>text {i}</p></div></body>") for i in range(3)]
    rows += [(200 + i, f"http://z.org/{i}", page("n", f"{shared}<p>own {i}</p>{box}")) for i in range(20)]
    rows += [(300 + i, "http://c.org/", page("n", "<div>copied article</div>")) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(pages).collect()}
    assert all(got[i] == f"text {i}" for i in range(20))
    assert all(got[100 + i] == f"Best offers text {i}" for i in range(3))
    assert all(got[200 + i] == f"A passage that all of them quote. own {i}" for i in range(20))
    assert all(got[300 + i] == "copied article" for i in range(20))


# --- URL rules ------------------------------------------------------------------------


def test_url_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "x.b.a.com", "net", "a.net", "", "A.COM", "ba.com"]
    paths = ["", "/", "/e", "/en", "/en/", "/en/x", "/en/x/y", "/é/", "/en/\U0010ffff"]
    rules = sorted({(rng.choice(hosts[:6]), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)})
    urls = [None, "none", "://", *(f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?q=/en/", "#/"))]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0])], "page_id int, url string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    merged = {}
    for h, p, v in rules:
        merged[h, p] = max(v, merged.get((h, p), v))
    rows = got.collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, v) for (h, p), v in merged.items()
               if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        assert (r["rule"], r["verdict"]) == (max(fit)[2:] if fit else (None, "allow")), (r, sorted(fit))


# --- SimHash --------------------------------------------------------------------------


def test_simhash(spark, given, odd, none):
    for docs in (given, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        prints = simhash.edited_fingerprints(docs).collect()
        assert Counter(r["doc_id"] for r in prints) == Counter(i for i, _ in rows)
        ids = [i for i, _ in rows]
        if len(set(ids)) == len(ids):
            order = sorted(rows, key=lambda r: -r[0])
            edited = {}
            for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
                half = len(t) // 2
                edited[i] = hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
            assert {r["doc_id"]: r["edited_sha256"] for r in prints} == edited
        of = defaultdict(set)
        texts = dict(rows)
        for r in prints:
            of[texts[r["doc_id"]]].add((r["f1"], r["f2"]))
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert all(len(v) == 1 for v in of.values())
    assert simhash.edited_fingerprints(none).count() == 0


@pytest.mark.parametrize(("radius", "kept"), [(3, 1), (4, 2), (1, 1)])
def test_hamming_search(spark, radius, kept):
    rng = random.Random(radius)
    prints = []
    for i in range(120):
        f = [rng.getrandbits(64), rng.getrandbits(64)] if i % 4 == 0 else list(prints[-1][1:])
        for _ in range(rng.randint(0, 3)):
            f[rng.randint(0, 1)] ^= 1 << rng.randint(0, 63)
        prints.append((i, *f))
    signed = [(i, a - (a >> 63 << 64), b - (b >> 63 << 64)) for i, a, b in prints]
    df = spark.createDataFrame(signed, "doc_id bigint, f1 bigint, f2 bigint")
    got = {r["doc_id"]: r["n_near"] for r in simhash.near_counts(df, F.col("doc_id") % 5 == 0, radius, kept).collect()}
    far = lambda x, y: ((x[1] ^ y[1]).bit_count() + (x[2] ^ y[2]).bit_count())
    assert got == {p[0]: sum(far(p, o) <= radius for o in prints) - 1 for p in prints if p[0] % 5 == 0}


def test_near_copies_are_counted(spark, tmp_path):
    """Texts with one word replaced count as near, and the search by changed blocks misses none within its radius."""
    rng = random.Random(17)
    rows = []
    for g in range(6):
        base = [f"{rng.choice('abcdefgh') * rng.randint(1, 9)}{rng.randrange(900)}" for _ in range(250)]
        for k in range(6):
            text = list(base)
            if k:
                text[rng.randrange(250)] = f"other{k}"
            rows.append((g * 50 + k, " ".join(text), "en", "a"))
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["n_near"] for r in queries.op5_simhash(spark, str(tmp_path)).collect() if r["doc_id"] % 50 == 0}
    assert got == {g * 50: 5 for g in range(6)}
    f = [[rng.getrandbits(64), rng.getrandbits(64)]]
    for i in range(150):
        x = list(f[rng.randrange(len(f))])
        for _ in range(rng.randint(0, 14)):
            x[rng.randint(0, 1)] ^= 1 << rng.randint(0, 63)
        f.append(x)
    signed = [(i, a - (a >> 63 << 64), b - (b >> 63 << 64)) for i, (a, b) in enumerate(f)]
    df = spark.createDataFrame(signed, "doc_id bigint, f1 bigint, f2 bigint")
    got = {r["doc_id"]: r["n_near"] for r in simhash.near_counts(df, F.col("doc_id") % 5 == 0, radius=17, flips=2).collect()}
    far = lambda x, y: (x[0] ^ y[0]).bit_count() + (x[1] ^ y[1]).bit_count()
    assert got == {i: sum(far(x, y) <= 17 for y in f) - 1 for i, x in enumerate(f) if i % 5 == 0}


# --- Jaccard join ---------------------------------------------------------------------


def brute_groups(texts, like):
    table = str.maketrans(parity_join.UPPER, parity_join.LOWER)
    sets, n = {}, like.words
    for d, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate(table))
        sets[d] = set(zip(*[w[i:] for i in range(n)], strict=False)) if len(w) >= n else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and like.den * i >= like.num * (len(sets[a]) + len(sets[b]) - i):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def near_copies(seed, n=160):
    """Groups of edited copies around the threshold, of all sizes."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "the", "x"]
    rows = []
    for i in range(n):
        if i % 8 == 0:
            base = [rng.choice(words) for _ in range(rng.choice([0, 1, 3, 5, 9, 14, 25, 60, 200, 500]))]
        text = list(base)
        for _ in range(rng.randint(0, max(1, len(base) // 40))):
            if text:
                text[rng.randrange(len(text))] = rng.choice(words)
        if rng.random() < 0.2:
            text = text[rng.randint(0, 2):]
        rows.append((i * 3, rng.choice([" ", "  ", "\n"]).join(text), "en", "a"))
    return rows


@pytest.mark.parametrize(("words", "num"), [(4, 85), (5, 80), (2, 95)])
def test_parity_join(spark, words, num):
    like = parity_join.Likeness(words, num, 100)
    rows = near_copies(words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in
           parity_join.similar_groups(docs_of(spark, rows), like).collect()}
    assert got == brute_groups({i: t for i, t, *_ in rows}, like)


def test_parity_join_given(spark, given, odd, none):
    like = parity_join.Likeness(4, 85, 100)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.similar_groups(given, like).collect()}
    assert got == brute_groups(texts_of(given), like)
    groups = parity_join.similar_groups(odd, like).collect()
    assert Counter(r["doc_id"] for r in groups) == Counter({i for i, *_ in ODD})
    of = {r["doc_id"]: r["component_id"] for r in groups}
    assert of[7] == 6 and of[5] == 4 and of[1] == 1 and of[2] == 2 and of[3] == 3 and of[9] is None
    assert parity_join.similar_groups(none, like).count() == 0
    assert set(parity_join.keep_one_of_each_group(odd, like).columns) == set(odd.columns)


def test_blocks_never_miss_a_similar_set():
    rng = np.random.default_rng(1)
    for words, num in ((4, 85), (5, 80), (4, 95)):
        like = parity_join.Likeness(words, num, 100)
        for n in [*range(1, 40), 77, 300, 1000]:
            for _ in range(6):
                a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
                out, more = rng.integers(0, n + 1), rng.integers(0, n + 1)
                b = np.concatenate([a[out:], rng.integers(0, 1 << 63, more, dtype=np.uint64)])
                inter = n - out
                if len(b) and 100 * inter >= num * (n + len(b) - inter):
                    (x, xs), (y, ys) = parity_join.block_keys(a, like), parity_join.block_keys(b, like)
                    both = Counter(k & 1 for k in set(x.tolist()) & set(y.tolist()))
                    # more common blocks than both together may leave out
                    assert any(both[bit] > xs[bit] + ys[bit] for bit in both)
                x, y = parity_join.parity_sketch(a), parity_join.parity_sketch(b)
                short = parity_join.folded(x) ^ parity_join.folded(y)
                assert np.unpackbits(short.view(np.uint8)).sum() <= out + more
                if len(x) == 2 * len(y):
                    x = x[: len(y)] ^ x[len(y):]
                if len(x) == len(y):
                    assert np.unpackbits((x ^ y).view(np.uint8)).sum() <= out + more


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    edges += [(5000, 5000 + i) for i in range(1, 40)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- quality --------------------------------------------------------------------------


def test_quality_held_out(spark, odd, none):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    scored = quality.classify(odd, labels).collect()
    assert len(scored) == len(ODD) and all(0 <= r["score"] <= 1 for r in scored)
    assert {r["score"] for r in scored if r["doc_id"] in (1, 2)} == {0.0}
    assert quality.classify(none, labels).count() == 0
    unlabelled = labels.limit(0)
    assert quality.accepted(odd, unlabelled).count() == len(ODD)
    assert {r["score"] for r in quality.classify(odd, unlabelled).collect()} == {0.5}


def test_scores_do_not_read_held_out_labels(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.classify(docs, x).select("doc_id", "score") for x in (labels, turned))
    assert sorted(a.collect()) == sorted(b.collect())


# --- packing --------------------------------------------------------------------------


def plain_best_fit(lengths, size):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, c in enumerate(left) if c >= n]
        if fits:
            left[min(fits, key=left.__getitem__)] -= n
        else:
            left.append(size - n)
    return sorted(left)


@pytest.mark.parametrize("size", [10, 37, 64])
def test_best_fit(size):
    rng = random.Random(size)
    for _ in range(60):
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 150))]
        filled = defaultdict(list)
        for r in packing.best_fit_decreasing(Counter(lengths), size):
            for k in range(r.count):
                filled[r.bin + k // r.per_bin].append((r.offset + k % r.per_bin * r.length, r.length))
        for pieces in filled.values():
            end = 0
            for offset, length in sorted(pieces):
                assert offset == end
                end += length
        assert sorted(size - sum(n for _, n in p) for p in filled.values()) == plain_best_fit(lengths, size)


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_files()[0])
    ids = {d: np.array(tokenizer.encode(t, add_special_tokens=False).ids + [2], dtype="<u4") for d, t in texts.items()}
    seen = defaultdict(int)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        seen[r["doc_id"]] += r["length"]
    assert {d: len(v) for d, v in ids.items()} == {d: n // max(1, sum(r["doc_id"] == d and r["piece"] == 0 for r in rows)) for d, n in seen.items()}
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 1024
    assert sorted(1024 - sum(n for _, n in p) for p in bins.values()) == plain_best_fit([r["length"] for r in rows], 1024)


def test_packing(spark, given, odd, none):
    check_packing(packing.pack_documents(given, queries.tokenizer_files()).collect(), texts_of(given))
    more = docs_of(spark, [(50, "<|endoftext|> as text", "en", "a"), (51, " " * 5000 + "x", "en", "a")])
    both = odd.unionByName(more)
    check_packing(packing.pack_documents(both, queries.tokenizer_files()).collect(), texts_of(both))
    assert packing.pack_documents(none, queries.tokenizer_files()).count() == 0


def test_labels_are_whole_words(spark):
    """Blocks whose names only begin like page furniture keep their text; hidden blocks and furniture lose it."""
    keep = ["class='navy-theme'", "class='share-price'", "class='cookie-recipe'", "id='related-work'", "class='social-history'",
            "class='search-results-analysis'"]
    drop = ["class='share-bar'", "style='color:red; display: none'", "id='cookie-banner'", "class='x related-posts'", "class='navbar'"]
    rows = [(i, "http://a.b/", page("x", f"<div {k}><p>Body text here.</p></div>")) for i, k in enumerate(keep + drop)]
    got = {r["page_id"]: r["text"] for r in html_text.main_texts(
        spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {i: "Body text here." if i < len(keep) else "" for i in range(len(rows))}


def test_deep_pages_take_linear_time():
    import time

    for close in ("</div>", ""):
        source = "<article>" + "<div>x" * 50_000 + close * 50_000 + "<p>end"
        started = time.perf_counter()
        read = html_text.Page(source)
        read.candidates()
        assert len(read.article(frozenset({1}))) == 50_001
        assert time.perf_counter() - started < 10  # quadratic work takes minutes


def test_templates_brute_force(spark):
    """Boxes, some of them in articles, go from hosts where they stand around eight different texts, by a plain count."""
    rng = random.Random(8)
    boxes = [f"<div><b>box {i}</b><p>line {i}</p></div>" for i in range(6)]
    rows = []
    for i in range(150):
        chosen = [b for j, b in enumerate(boxes) if rng.random() < 0.05 * (j + 1)]
        rows.append((i, f"http://h{i % 3}.org/{i}", page("n", f"<p>own {i % 40}</p>{''.join(chosen)}")))
    odd = [(None, None, None), (500, "http://h0.org/", page("n", "<p>z</p>")), (500, "http://h0.org/", page("n", "<p>z</p>"))]
    shape = "page_id bigint, url string, html string, host string, page bigint, text string"
    pages = spark.createDataFrame([(*r, "x", 1, "y") for r in rows + odd], shape)
    around = defaultdict(set)
    for i, url, source in rows:
        for j, box in enumerate(boxes):
            if box in source:
                around[url.split("/")[2], j].add(" ".join(html_text.Page(source).article()))
    got = defaultdict(list)
    for r in html_text.main_texts(pages).collect():
        got[r["page_id"]].append(r["text"])
    for i, url, source in rows:
        left = [f"box {j} line {j}" for j, b in enumerate(boxes) if b in source and len(around[url.split("/")[2], j]) < 8]
        assert got[i] == [" ".join([f"own {i % 40}", *left])]
    assert got[None] == [""] and got[500] == ["z", "z"]
    assert any(len(v) >= 8 for v in around.values()) and any(len(v) < 8 for v in around.values())


# --- repeated passages ----------------------------------------------------------------


def test_spans(spark, given, odd, none):
    passage = " ".join(f"word{i} and{i} then{i}." if i % 3 else f"word{i} more{i}" for i in range(25))
    rows = [(i, f"Own start {i} of it.\n{passage}\nOwn end {i} of it.", "en", "a") for i in range(5)]
    rows.append((9, "A short line. It repeats.\nA short line. It repeats.", "en", "a"))
    got = {r["doc_id"]: r for r in spans.drop_repeated_passages(docs_of(spark, rows)).collect()}
    assert got[0]["text"] == rows[0][1] and got[9]["text"] == rows[5][1]
    for i in range(1, 5):
        assert got[i]["text"] == f"Own start {i} of it.\nOwn end {i} of it."
        assert got[i]["removed_chars"] == len(rows[i][1]) - len(got[i]["text"])
    assert spans.drop_repeated_passages(none).count() == 0
    kept = spans.drop_repeated_passages(odd).collect()
    assert Counter(r["doc_id"] for r in kept) == Counter(i for i, *_ in ODD)
    assert {r["text"] for r in kept if r["doc_id"] == 7} == {""}


def test_spans_brute_force(spark, given):
    texts = texts_of(given)
    found = {d: spans.spans(t, spans.sentences(t)) for d, t in texts.items()}
    first = {}
    for d in sorted(texts):
        for i, j, h in found[d]:
            first.setdefault(h, (d, i, j))
    for r in spans.drop_repeated_passages(given).collect():
        d, cuts = r["doc_id"], spans.sentences(texts[r["doc_id"]])
        dead = {k for i, j, h in found[d] if first[h] != (d, i, j) for k in range(i, j + 1)}
        assert r["text"] == "".join(texts[d][a:b] for k, (a, b) in enumerate(cuts) if k not in dead)
        assert (r["n_sentences"], r["n_removed"]) == (len(cuts), len(dead))


def test_spans_of_whole_sentences(spark):
    """Against a plain count of all runs of three or more sentences with 15 words, cut by a rule of its own."""
    rng = random.Random(4)
    pool = [" ".join(rng.choices("alpha beta gamma delta eta".split(), k=rng.randint(1, 12))).capitalize() + "." for _ in range(25)]
    rows = []
    for i in range(60):
        told = [rng.choice(pool) if rng.random() < 0.2 else f"Own {i} {j} words here." for j in range(rng.randint(0, 12))]
        at = rng.randint(0, len(pool) - 5)
        told += pool[at : at + rng.randint(0, 5)]
        rows.append((i, " ".join(told), "en", "a"))
    first, runs = {}, {}
    for i, text, *_ in rows:
        parts = [p for p in re.split(r"(?<=[.]) ", text) if p]
        runs[i] = parts, [(a, b, " ".join(parts[a:b]).lower()) for a in range(len(parts)) for b in range(a + 3, len(parts) + 1)
                          if len(" ".join(parts[a:b]).split()) >= 15]
        for a, b, key in runs[i][1]:
            first.setdefault(key, (i, a))
    got = {r["doc_id"]: r for r in spans.drop_repeated_passages(docs_of(spark, rows)).collect()}
    for i, (parts, found) in runs.items():
        dead = {n for a, b, key in found if first[key] != (i, a) for n in range(a, b)}
        assert got[i]["text"].split() == " ".join(p for n, p in enumerate(parts) if n not in dead).split()
        assert (got[i]["n_sentences"], got[i]["n_removed"]) == (len(parts), len(dead))
    assert sum(r["n_removed"] for r in got.values()) > 20


def test_spans_within_long_sentences(spark):
    """A passage goes wherever it starts in a sentence without ends, also in scripts without spaces; all but words at its ends."""
    rng = random.Random(10)
    own = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = own(50)
    rows = [(0, f"{own(40)} {passage} {own(40)}", "en", "a")]
    rows += [(i, f"{own(i)} {passage} {own(30)}", "en", "a") for i in range(1, 40)]
    signs = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(100))
    own_signs = lambda n: "".join(chr(0x6E00 + rng.randrange(5000)) for _ in range(n))
    rows += [(100 + i, f"{own_signs(10 + i)}\u3002{own_signs(i)}{signs}\u3002{own_signs(30)}", "zh", "a") for i in range(10)]
    got = {r["doc_id"]: r for r in spans.drop_repeated_passages(docs_of(spark, rows)).collect()}
    words = set(passage.split())
    for i, text, *_ in rows:
        if i in (0, 100):
            assert got[i]["text"] == text
        elif i < 100:
            assert len(words & set(got[i]["text"].split())) <= 26, i
            assert set(text.split()) - words <= set(got[i]["text"].split())
        else:
            assert sum(c in signs for c in got[i]["text"]) <= 30, i


def test_spans_of_few_sentences():
    """A run of 51 words of prose is found wherever it starts: one or two whole sentences, or none, lie in it."""
    rng = random.Random(12)
    prose = lambda: " ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(12, 36))) + "." for _ in range(12))
    found = 0
    for _ in range(200):
        words = prose().split()
        at = rng.randrange(20, len(words) - 71)
        passage = " ".join(words[at : at + 51])
        one, two = ([h for *_, h in spans.spans(f"{prose()[: rng.randint(300, 900)]} {passage} {prose()}")] for _ in range(2))
        assert len(set(one)) == len(one)
        found += bool(set(one) & set(two))
    assert found >= 190
    for text in ("", "one", "a. b.", " ".join(f"w{i}" for i in range(14)) + ". Then. End."):
        assert len(spans.spans(text)) <= 1 and all(j > i for i, j, _ in spans.spans(text))


def test_registered_queries():
    """SQL twins where SQL can say it; the others are tested against brute force here."""
    names = set(queries.REGISTRY)
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    told = {re.match(r"op\d+", n)[0] for n in oracles.oracle_sql()}
    assert set(oracles.oracle_sql()) <= names and told == {"op1", "op3", "op6", "op7", "op8"}


# --- pipeline -------------------------------------------------------------------------


def test_pipeline_stages(spark, given):
    docs = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER).cache()
        assert after.columns == given.columns, name
        before, texts = texts_of(docs), texts_of(after)
        if name == "exact dedup":
            groups = brute_exact(list(before.items()))
            assert set(texts) == {w[0] for w in groups if w[3]}
        if name == "n-gram jaccard join":
            groups = brute_groups(before, parity_join.Likeness(5, 80, 100))
            assert set(texts) == {d for d, (_, c) in groups.items() if d == c}
        if name == "source mixing":
            assert set(texts) == set(before)
        assert all(before[d] == t for d, t in texts.items())
        docs = after
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs.dropDuplicates(["doc_id"]), FOLDER).collect(), texts_of(docs))


def test_pipeline_odd_rows(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == odd.columns
        corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count()
