"""The training-data operators: brute force, round trips, held-out accuracy, and awkward tables."""

import base64
import collections
import hashlib
import random
import re
import struct
import sys
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import spark_rows, sql_rows, tables  # noqa: E402

import public_tokenizers  # noqa: E402

import corpus_pipeline  # noqa: E402
from contentsec.llm import byte_bpe, chunk_dedup, components, html_extract, language_id, license_scan, mixing, parsing, quality, simhash, suffix_dedup  # noqa: E402
from contentsec.llm.queries import ORACLE_SQL, QUERIES, bpe_digests, removal_digests  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
random.seed(7)
LONG = " ".join(random.choice(["stone", "river", "glass", "Über", "tree", "9", "night", "wind,"]) for _ in range(40_000))
BASE = "".join(random.choice("abcdé fgh") for _ in range(3000))


def documents(spark, rows):
    """Documents with columns that clash with the operators' own names."""
    whole = [(i, t, lang, source, len(t) if t is not None else None) for i, t, lang, source in rows]
    df = spark.createDataFrame(whole, DOCS)
    for name in ("size", "key", "h", "k", "fp", "score", "words", "_id", "taken", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


AWKWARD = [
    (1, "one two three four", "en", "a"),
    (1, "one two three four", "en", "a"),
    (2, "One TWO three four", "de", None),
    (None, "one two three four", None, "a"),
    (None, None, None, None),
    (3, None, "en", "b"),
    (4, "", "fr", "b"),
    (5, " \n\t ", "fr", "b"),
    (6, "!?%&", "es", "c"),
    (7, "É é ß 的 😀", "es", "c"),
    (8, LONG, "en", "a"),
    (9, BASE, "en", "a"),
    (10, BASE[:1500] + "X" + BASE[1501:], "en", "d"),
    (1, "another text of the same id", "en", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    return documents(spark, AWKWARD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


@pytest.fixture(scope="module")
def docs(spark, data):
    return [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, data, name):
    df = QUERIES[name](spark, data)
    assert spark_rows(df) == sql_rows(tables(data), ORACLE_SQL[name], df.columns)


# 1


def test_parsing_of_queries(spark, data, docs):
    got = {r.doc_id: r for r in QUERIES["op1_consistent_parsing"](spark, data).collect()}
    docs = sorted(docs)
    for (i, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        k = len(text) // 4
        new = text[: len(text) - k] + after[:k]
        own, changed, other = (parsing.fingerprints([t.encode()])[0] for t in (text, new, after))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), hashlib.sha256(new.encode()).hexdigest(), own, changed)
        assert r.near_edited == parsing.likeness(own, changed) and r.near_next == parsing.likeness(own, other)
    long = [r.near_edited for r in got.values() if r.n_chars > 500]
    assert 0.5 < np.mean(long) < 0.7  # three quarters of the content: 0.75 / 1.25


def test_equal_substrings_share_phrases():
    middle = LONG[:4000].encode()
    a, b = (parsing.fingerprints([x + middle])[0] for x in (b"", b"some other start, shifted: "))
    assert parsing.likeness(a, b) > 0.8
    assert parsing.fingerprints([middle, b"", middle]) == [a, "", a]


def test_parsing_of_awkward_rows(spark, awkward, empty):
    for buckets in (1, 3, 50):
        rows = parsing.compared(awkward, buckets=buckets).collect()
        assert len(rows) == len(AWKWARD)
    ordered = sorted(AWKWARD, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh3_64_intdigest(r[1] or "") >> 1))
    got = collections.Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in rows)
    want = collections.Counter()
    for (i, t, *_), (_, n, *_) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        want[i, len(t), hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()] += 1
    assert got == want
    assert parsing.compared(empty).count() == 0 and parsing.fingerprint(empty).count() == 0
    assert {r.fingerprint for r in parsing.fingerprint(awkward).filter("doc_id in (3, 4)").collect()} == {""}
    sole = parsing.compared(documents(spark, [(1, "alone here", "en", "a")])).first()
    assert sole.near_next == 1.0


# 2


def test_language_held_out(spark, data):
    got = QUERIES["op2_language_mixture"](spark, data.replace("0.001", "0.01"))
    truth = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    right = got.join(truth, "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97


def test_language_mixture(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.fit(docs)
    halves = [r.text for r in docs.filter("lang = 'de' and n_chars > 1500").limit(1).collect()] + [r.text for r in docs.filter("lang = 'fr' and n_chars > 1500").limit(1).collect()]
    mixed = documents(spark, [(1, halves[0][:1200] + " " + halves[1][:1200], None, None)])
    row = language_id.predict(mixed, model).first()
    assert {x.split(":")[0] for x in row.mixture.split(",")} == {"de", "fr"} and 0.3 < row.score < 0.7


def test_language_mixture_of_four(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    parts = [docs.filter(f"lang = '{x}' and n_chars > 1500").first().text[:1500] for x in ("en", "fr", "de", "es")]
    row = language_id.predict(documents(spark, [(1, " ".join(parts), None, None)]), language_id.fit(docs)).first()
    assert {x.split(":")[0] for x in row.mixture.split(",")} == {"en", "fr", "de", "es"} and 0.2 < row.score < 0.31


def test_language_of_awkward_rows(spark, awkward, empty, data):
    model = language_id.fit(spark.read.parquet(f"{data}/documents.parquet"))
    got = language_id.predict(awkward, model).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5, 6)} == {"und"}
    assert language_id.identify(empty).count() == 0
    assert {r.lang_pred for r in language_id.predict(awkward, None).collect()} == {"und"}
    assert language_id.identify(awkward).count() == len(AWKWARD)


# 3


def brute_groups(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[lower(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [64, 1])
def test_exact_groups(spark, awkward, empty, bits):
    rows = [*((i, t) for i, t, *_ in AWKWARD)]
    got = chunk_dedup.exact_groups(awkward, key_bits=bits)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(rows)
    assert chunk_dedup.exact_groups(empty, key_bits=bits).count() == 0


def test_chunks_are_content_defined():
    data = np.frombuffer(LONG.encode(), np.uint8)
    ends, shifted = chunk_dedup.bounds(data), chunk_dedup.bounds(np.concatenate([np.frombuffer(b"shift ", np.uint8), data]))
    assert len({e + 6 for e in ends} & set(shifted)) > 0.9 * len(ends) and ends[-1] == len(data)


# 4


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text).encode())
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def brute_near(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    least = collections.defaultdict(list)
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r].append(i)
    return sorted(((i, f"{p:016x}", min(least[r], default=None)) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)


@pytest.mark.parametrize("bucket", [128, 1])
def test_near_groups(spark, data, docs, awkward, empty, bucket):
    got = simhash.near_groups(spark.read.parquet(f"{data}/documents.parquet"), bucket=bucket)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_near(docs)
    rows = [(i, t) for i, t, *_ in AWKWARD]
    assert sorted(map(tuple, simhash.near_groups(awkward, bucket=bucket).collect()), key=repr) == brute_near(rows)
    assert simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("plan", [[(list(range(32)), 0), (list(range(32, 64)), 1)], [(list(range(0, 64, 3)), 0), (list(range(1, 64, 3)), 0), (list(range(2, 64, 3)), 0)], [(list(range(20)), 2)], [(list(range(40)), 1), (list(range(40, 64)), 0)]])
@pytest.mark.parametrize("bucket", [128, 2])
def test_links_lose_nothing(spark, plan, bucket):
    r = random.Random(3)
    prints = {r.getrandbits(64) for _ in range(30)}
    for _ in range(150):
        prints.add(r.choice(sorted(prints)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64) if r.random() < 0.5 else 0))
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp bigint")
    got = {x.node: x.component for x in components.components(simhash.links(df, plan, bucket)).collect()}
    mine = [got.get(p, p) for p in signed]
    assert len(set(zip(mine, brute_components(prints), strict=True))) == len(set(mine)) == len(set(brute_components(prints)))


def test_allocation_is_the_cheapest():
    costs = [[0, 5, 50, 500], [0, 1, 9, 90], [0, 7, 70, 700]]
    cost, limits = simhash.allocate(costs)
    assert cost == 13 and sum(t + 1 for t in limits) == 3


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a bigint, b bigint")
    assert {(r.node, r.component) for r in components.components(chain).collect()} == {(i, 0) for i in range(61)} | {(100, 100), (101, 100)}
    assert components.components(chain.limit(0)).count() == 0


# 5


def brute_removal(rows, width=200):
    count = collections.Counter()
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, b in texts:
        count.update(b[s : s + width] for s in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group", [1000, 3])
def test_suffix_dedup(spark, empty, group):
    r = random.Random(4)
    rows = [(1, BASE), (2, BASE[:1500] + "X" + BASE[1501:]), (3, "pre " + BASE[100:420]), (4, BASE[50:249]), (5, BASE[50:250]), (6, "a" * 900), (7, "ab" * 300 + "c"), (8, None), (9, ""), (10, BASE[1000:1300] * 2), (10, "same id"), (None, BASE[:300]), (None, BASE[:300])]
    for k in range(30):
        t = list(BASE[:1200])
        for _ in range(6):
            t[r.randrange(1200)] = r.choice("xyz")
        rows.append((100 + k, "".join(t)))
    rows += [(500 + k, f"{r.random()}" * 3 + BASE[600:1100] + f"{r.random()}" * 20) for k in range(30)]
    got = removal_digests(documents(spark, [(i, t, "en", "a") for i, t in rows]), group)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_removal(rows)
    assert suffix_dedup.dedup(empty).count() == 0


def test_suffix_dedup_of_queries(spark, data, docs):
    assert sorted(map(tuple, QUERIES["op5_suffix_sort"](spark, data).collect()), key=repr) == brute_removal(docs)


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = np.frombuffer(LONG.encode(), np.uint8)
    first, n, _, _ = suffix_dedup.anchored(text)
    assert first[0] == 0 and (first[1:] == first[:-1] + n[:-1]).all() and first[-1] + n[-1] == len(text) - 199


@pytest.mark.parametrize("seed", range(3))
def test_suffix_order(seed):
    r = np.random.default_rng(seed)
    rows, group = r.integers(0, 2, (60, 12), np.uint8), np.sort(r.integers(0, 4, 60))
    order, shared = suffix_dedup.suffix_order(rows, group)
    keys = [(int(group[i]), bytes(rows[i])) for i in order]
    assert keys == sorted(keys)
    for a, b, s in zip(keys, keys[1:], shared[1:], strict=False):
        assert s == (-1 if a[0] != b[0] else next((k for k in range(12) if a[1][k] != b[1][k]), 12))


# 6


def test_quality_held_out(spark, data):
    at = data.replace("0.001", "0.01")
    got = QUERIES["op6_neighbour_voting"](spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id").filter("held_out").collect()
    for label in (0, 1):
        own = [r.predicted == label for r in got if r.quality == label]
        assert sum(own) / len(own) > (0.8 if label == 0 else 0.95)


def test_quality_of_awkward_rows(spark, awkward, empty, data):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (8, 1), (9, 1), (10, 0), (None, 1), (4, None), (3, 7)], "doc_id bigint, quality int")
    got = quality.classify(awkward, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in quality.classify(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty, labels).count() == 0
    assert quality.accepted(awkward, labels.limit(0)).count() == len(AWKWARD)
    assert quality.accepted(awkward, labels).columns == awkward.columns


def test_repeated_words_are_counted():
    texts = [b"a a b", b"", b"b b b", b"b"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert quality.repeats(data, offsets).tolist() == [1, 0, 2, 0]


# 7


def test_extraction_of_queries(spark, data):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in QUERIES["op7_tag_path_ratios"](spark, data).collect():
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("plain words", "plain words"),
        ("<p>a<p>b", "a\n\nb"),
        ("<p>x &amp; y &#228; &nbsp; z", "x & y ä z"),
        ("a < b <!-- x", "a < b"),
        ("<script>var a = '<p>no</p>';</script><p>yes, it is.</p>", "yes, it is."),
        ("<body><nav>menu</nav><article><h1>Head</h1><p>Long text, with marks. More of it.</p></article><footer>foot</footer>", "Head\n\nLong text, with marks. More of it."),
        ("<body><div class='sidebar'>Side, bar. Text!</div><div class='content'><h2>T</h2><p>Some long text, yes. And more of it here.</p><div id='comments'><p>I like it, a lot.</p></div></div>", "T\n\nSome long text, yes. And more of it here."),
        ("<main><p>One,\n two<br>three.</p><ul><li>four<li>five</ul><form><label>Name</label></form></main>", "One, two three.\n\nfour\n\nfive"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<div class='content has-sidebar'><main><p>One, two.</p></main><div class='sidebar'>Side.</div></div>", "One, two."),
        ("<div id='content-sidebar-wrap'><article><p>One, two.</p></article></div><footer>foot</footer>", "One, two."),
        ("<body class='no-sidebar'><div class='no-sidebar'><p>One, two.</p><p>Three, four.</p></div>", "One, two.\n\nThree, four."),
        ("<div class='sidebar'><main><p>One, two.</p></main></div>", "One, two."),
        ("<form><div><p>A long text, in a form that is the page.</p><p>More of it, and more.</p></div></form><nav>x</nav>", "A long text, in a form that is the page.\n\nMore of it, and more."),
        ("<p>One, two.<svg width='1'/> three.</p><math/><p>Four, five.</p>", "One, two. three.\n\nFour, five."),
        ("<article><p>Short.</p></article><div class='comments'><article>" + "Long, long talk. " * 20 + "</article></div>", "Short."),
        ("<p>Seen, and read.</p><div style='display:none'>" + "Hidden, never. " * 20 + "</div>", "Seen, and read."),
        ("<p>a <span class='sidebar'>side</span> b, and more of the text here.</p>", "a b, and more of the text here."),
    ],
)
def test_side_content_holds_no_article(html, text):
    assert html_extract.main_text(html) == text


def test_extraction_of_awkward_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>x"), (2, "v", "<p>" + LONG), (3, "w", "<" * 2000), (4, "w", "<div>" * 3000 + "deep, text."), (5, "w", '<a href="' * 500)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit(1))
    got = html_extract.extract(df).collect()
    assert len(got) == len(rows) and [r.text for r in got if r.page_id in (1, None)] == ["", "", "x"]
    assert next(r for r in got if r.page_id == 2).text == " ".join(LONG.split())
    assert html_extract.extract(df.limit(0)).count() == 0


# 8


def test_mixing(spark, awkward, empty, docs):
    got = mixing.mixture(awkward).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r.taken <= 2 * r.size for r in got)
    total = sum(r["size"] for r in got)
    per = {r.source_size: r.target for r in got}
    assert all(t <= 2 * s for s, t in per.items())
    assert abs(sum(r.taken for r in got) - 1.5 * total) <= 5
    assert mixing.mixture(empty).count() == 0 and mixing.mixed(empty).count() == 0
    assert sorted(map(tuple, mixing.mixture(awkward).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mixed_rows_are_what_is_taken(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    words = mixed.groupBy("doc_id").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(mixing.WORD), F.lit(0)))).alias("n"))
    both = mixing.mixture(docs).filter("taken > 0").join(words, "doc_id", "full")
    assert both.filter("n is null or taken is null or n <> taken").count() == 0
    assert mixed.filter("n_chars <> length(text)").count() == 0


def test_water_filling(spark):
    sizes = spark.createDataFrame([("=a", "a", 10), ("=b", "b", 1000), ("=c", "c", 1000), ("", None, 0)], "key string, source string, size bigint")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got[None] == 0
    assert got["b"] == pytest.approx((3015 - 20) * 2 / 3) and got["c"] == pytest.approx((3015 - 20) / 3)


# 9


def test_licences(spark, awkward, empty):
    long = next(p for label, p, kind in license_scan.TEMPLATES if label == "mit" and kind == "long").split()
    rows = [
        (1, "Released under the MIT License. CC BY-NC 4.0; under the mit\nlicense", "mit", "cc-by-nc,mit", 3, 1, 10),
        (2, " ".join(long[:20] + ["and", "so"] + long[20:]), "mit", "", 0, None, None),
        (3, " ".join(long[:10]), "", "", 0, None, None),
        (4, "under the (mit) license", "mit", "mit", 1, 0, 0),
        (5, "GNU General Public License, version 3", "gpl-3", "", 0, None, None),
        (6, "under the MİT license ﬁ Kelvin", "", "", 0, None, None),
        (7, None, "", "", 0, None, None),
    ]
    got = {r.doc_id: r for r in license_scan.scan(documents(spark, [(i, t, None, None) for i, t, *_ in rows])).collect()}
    for i, _, labels, base, n, first, last in rows:
        r = got[i]
        assert (r.base_labels, r.n_base, r.first_word, r.last_word) == (base, n, first, last), i
        assert r.labels == ",".join(sorted({*filter(None, base.split(",")), *filter(None, labels.split(","))})), i
        assert 0 <= r.score <= 1
    assert license_scan.scan(awkward).count() == len(AWKWARD) and license_scan.scan(empty).count() == 0


def test_licences_run_no_python(spark, data):
    plan = QUERIES["op9_diagonal_voting"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# 10


PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tiktoken_ids():
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_encoding_is_tiktokens(tiktoken_ids):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    of = byte_bpe.encoder(PATH, public_tokenizers.PATTERN)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=120) | st.text("ab '\n", max_size=300), max_size=6))
    def same(texts):
        for text, ids in zip(texts, of.encode_all(texts), strict=True):
            want = tiktoken_ids(text)
            assert ids == struct.pack(f"<{len(want)}I", *want)
            assert of.decode(np.array(want, "<u4")) == text.encode()

    same()
    for text in ("a" * 500, "的" * 100, "=-" * 40, "x" * 63, "x" * 64):
        want = tiktoken_ids(text)
        assert of.encode_all([text])[0] == struct.pack(f"<{len(want)}I", *want)


def test_a_long_text_is_encoded_in_runs(tiktoken_ids, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_TEXT", 1000)
    monkeypatch.setattr(byte_bpe, "RUN", 100)
    want = tiktoken_ids(LONG)
    assert byte_bpe.encoder(PATH, public_tokenizers.PATTERN).encode_all([LONG])[0] == struct.pack(f"<{len(want)}I", *want)


def test_bpe_of_awkward_rows(spark, awkward, empty, tiktoken_ids):
    got = bpe_digests(awkward, PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t, *_ in AWKWARD:
        ids = tiktoken_ids(t or "")
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert bpe_digests(empty, PATH, public_tokenizers.PATTERN).count() == 0
    apart = byte_bpe.decode(byte_bpe.encode(awkward, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert apart.filter("decoded <> ''").count() == sum(bool(t) for _, t, *_ in AWKWARD)


# The pipeline


def test_pipeline_stages(spark, data, docs, tiktoken_ids):
    source = spark.read.parquet(f"{data}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_classifier"](spark, source, data)
    scores = {r.doc_id: r.predicted for r in quality.classify(source, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert kept.columns == source.columns and set(texts) == {i for i, p in scores.items() if p}

    once = stages["exact_dedup"](spark, kept, data)
    assert {r.doc_id for r in once.collect()} == {i for i, _, _, own, _ in brute_groups(sorted(texts.items())) if own} and once.columns == source.columns

    rows = sorted((r.doc_id, r.text) for r in once.collect())
    near = stages["simhash_near_dedup"](spark, once, data)
    assert {r.doc_id for r in near.collect()} == {i for i, _, least in brute_near(rows) if i == least} and near.columns == source.columns

    mixed = stages["source_mixing"](spark, near, data)
    taken = {r.doc_id: r.taken for r in mixing.mixture(near).collect()}
    words = collections.Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert {i: n for i, n in taken.items() if n} == dict(words) and mixed.columns == source.columns

    final = stages["byte_bpe"](spark, mixed, data).collect()
    want = collections.Counter((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(tiktoken_ids(r.text))) for r in mixed.collect())
    assert collections.Counter((r.doc_id, r.decoded_sha256, r.n_tokens) for r in final) == want


def test_near_copies_go_by_row(spark):
    near = ["the quick brown fox jumps over the lazy dog " * 30 + x for x in ("", " ", "  ")]
    other, third = "an unlike text about ships, sails and harbours, with winds from the north " * 30, "numbers 1 2 3 and some more about mountains, snow and the long way down " * 30
    assert len({brute_fingerprint(t) for t in near}) == 1 and len(set(brute_components([brute_fingerprint(t) for t in (near[0], other, third)]))) == 3

    def kept(rows):
        return sorted(((r.doc_id, r.text) for r in simhash.keep_one(documents(spark, [(i, t, None, None) for i, t in rows])).collect()), key=repr)

    least = min(near, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert kept([(1, near[0]), (5, near[1]), (5, other)]) == [(1, near[0]), (5, other)]
    assert kept([(7, near[0]), (None, near[1]), (None, near[2]), (None, third)]) == sorted([(7, near[0]), (None, third)], key=repr)
    assert kept([(None, t) for t in near] + [(None, other)]) == sorted([(None, least), (None, other)], key=repr)
    rows = [(2, near[0]), (2, near[0]), (2, near[1])]
    assert kept(rows) == [x for x in rows if x[1] == min(near[:2], key=lambda t: hashlib.sha256(t.encode()).hexdigest())]


def test_pipeline_runs_whole(spark, data):
    assert corpus_pipeline.run(spark, data).count() > 100
