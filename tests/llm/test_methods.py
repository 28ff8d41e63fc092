"""The operators' methods: that results come through them, against slow versions written apart."""

import collections
import hashlib
import html as entities
import itertools
import math
import random
import re
import zlib
from xml.etree import ElementTree

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from contentsec.llm import byte_bpe, chunk_dedup, common, html_extract, language_id, license_scan, parsing, quality, sampling, suffix_dedup
from contentsec.llm.queries import removal_digests

random.seed(11)
_occurrences = suffix_dedup.occurrences


# 7


def _article(page):
    inside = re.search("<article>(.*)</article>", page, re.DOTALL)[1]
    found = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
    return collections.Counter(b for b in found if b)


def test_ratios_need_no_names(spark, data):
    """With neutral names and no article element nearly all of the article comes out, and little else."""
    want = got = extra = 0
    for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/pages.parquet").collect():
        page = re.sub(' (class|id)="[^"]*"', r' \1="x1"', r.html).replace("<article>", "<div>").replace("</article>", "</div>")
        expected, found = _article(r.html), collections.Counter(html_extract.main_text(page).split("\n\n"))
        size = lambda c: sum(len(t) * n for t, n in c.items())
        want, got, extra = want + size(expected), got + size(expected & found), extra + size(found - expected)
    assert got > 0.999 * want and extra < 0.01 * want


def test_the_threshold_decides(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    changed = sum(html_extract.main_text(p) != html_extract.main_text(p, 0) for p in pages)
    assert changed > 0.9 * len(pages)


def brute_content(page):
    """Content texts of a well-formed page of boxes and text blocks, by path ratios over a real tree."""
    nodes = []  # text, path, boxes (innermost last), list-like boxes, heading, linked

    def walk(element, path, boxes):
        path = (*path, element.tag + (f".{element.get('class')}" if element.get("class") else ""))
        if element.tag in ("p", "h2", "li"):
            inner = list(element)
            linked = len(inner) == 1 and inner[0].tag == "a" and not (element.text or "").strip() and not (inner[0].tail or "").strip()
            text = " ".join("".join(element.itertext()).split())
            if text:
                nodes.append((text, (*path, "a") if linked else path, boxes, element.tag == "h2", linked))
        else:
            for child in element:
                walk(child, path, (*boxes, element))

    root = ElementTree.fromstring(page)
    walk(root, (), ())
    per = collections.defaultdict(list)
    for text, path, *_ in nodes:
        per[path].append(text)
    ratio = {p: sum(map(len, ts)) / len(ts) * (1 + sum(sum(c in ".,;:!?" for c in t) for t in ts) / len(ts)) for p, ts in per.items()}
    page_ratio = math.exp(sum(len(n[0]) * math.log(ratio[n[1]]) for n in nodes) / sum(len(n[0]) for n in nodes))
    out = []
    for text, path, boxes, heading, _ in nodes:
        best, share = ratio[path], 1.0
        for k in range(len(boxes) - 1, -1, -1):
            own = [n for n in nodes if n[2] and n[2][-1] is boxes[k]]
            if own:
                best = max(best, share * sum(len(n[0]) * ratio[n[1]] for n in own) / sum(len(n[0]) for n in own))
                if all(n[4] for n in own):
                    break
            share *= html_extract.LIST if boxes[k].tag in ("ul", "blockquote") or heading else html_extract.BOX
        if best >= html_extract.SHARE * page_ratio:
            out.append(text)
    return "\n\n".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_path_scores_agree_with_a_tree(seed):
    r = random.Random(seed)
    words = lambda most: " ".join(r.choice(["stone", "river,", "glass", "wind.", "on", "the"]) for _ in range(r.randint(1, most)))

    def box(depth):
        kind = r.choice(["div", "section", "ul", "blockquote"])
        label = r.choice(["", ' class="q"', ' class="z"'])
        inner = ""
        for _ in range(r.randint(1, 5)):
            k = r.random()
            if k < 0.3 and depth < 3:
                inner += box(depth + 1)
            elif kind == "ul":
                inner += f"<li><a>{words(3)}</a></li>" if r.random() < 0.5 else f"<li>{words(9)}</li>"
            elif k < 0.5:
                inner += f"<h2>{words(4)}</h2>"
            else:
                inner += f"<p{label}>{words(r.choice([3, 60]))}</p>"
        return f"<{kind}{label}>{inner}</{kind}>"

    page = f"<html><body>{''.join(box(0) for _ in range(r.randint(1, 4)))}</body></html>"
    assert html_extract.main_text(page) == brute_content(page)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>&<b>lt;</b>x", "&lt;x"),
        ("<p>a &am<i>p; b", "a &amp; b"),
        ("<p>x <math><mi>y</mi></math> z <object>w</object></p>", "x y z w"),
        # two candidates: the longer reads like an article, the shorter box of links and teasers doesn't
        ("<div class='x1'><p>Go on.</p><p>See more</p></div><div class='x2'><h2>Head</h2><p>" + "A long text, with marks. " * 8 + "</p><p>Short.</p></div>", "Head\n\n" + ("A long text, with marks. " * 8).strip() + "\n\nShort."),
        # two articles of like kind both are content
        ("<article><p>" + "One, two, three. " * 5 + "</p></article><article><p>" + "Four, five, six. " * 5 + "</p></article>", ("One, two, three. " * 5).strip() + "\n\n" + ("Four, five, six. " * 5).strip()),
        ("<div><h2>T</h2><p>" + "A text, with a list. " * 9 + "</p><ul><li>one</li><li>two</li></ul></div><div><ul><li><a href='/'>home</a></li><li><a href='/x'>all</a></li></ul></div>", "T\n\n" + ("A text, with a list. " * 9).strip() + "\n\none\n\ntwo"),
    ],
)
def test_content_by_ratio(html, text):
    assert html_extract.main_text(html) == text


# 10


def brute_bpe(word, ranks):
    """Least rank first, leftmost first, one merge after the other."""
    parts = [bytes([b]) for b in word]
    while True:
        known = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not known:
            return [ranks[p] for p in parts]
        _, i = min(known)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("seed", range(30))
def test_replay_of_any_ranks(seed):
    """Ranks in any order, so that merges of a lower rank come up late; words of every length at once."""
    r = random.Random(seed)
    tokens = {bytes(r.choice(b"abc") for _ in range(r.randint(2, 5))) for _ in range(40)}
    order = [bytes([b]) for b in range(256)] + sorted(tokens)
    r.shuffle(order)
    ranks = {t: k for k, t in enumerate(order)}
    of = byte_bpe.Encoder(ranks, ".+")
    words = [bytes(r.choice(b"abcd") for _ in range(r.choice([1, 2, 5, 20, 63, 64, 65, 400]))) for _ in range(60)]
    assert [list(memoryview(x).cast("I")) for x in of.replay(words)] == [brute_bpe(w, ranks) for w in words]


def test_blocks_of_a_corpus(spark, monkeypatch):
    """Many blocks that ask for the same words, in slices of few words: every word is encoded once in its slice."""
    rows = [(i, " ".join(f"w{(i * 7 + k) % 50}x é的{k}" for k in range(30)) if i % 9 else None) for i in range(200)] + [(None, "x" * 3000 + " y"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole = byte_bpe.encoder(path, public_tokenizers.PATTERN).encode_all([t or "" for _, t in rows])
    want = sorted(((i, w) for (i, _), w in zip(rows, whole, strict=True)), key=repr)
    monkeypatch.setattr(byte_bpe, "BLOCK", 2000)
    got = byte_bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got.collect()), key=repr) == want
    asked = [dict(zip(("h", "words"), x, strict=True)) for x in [(1, [b"ab", b"cd"]), (2, [b"cd"])]]
    of, seen = byte_bpe.encoder(path, public_tokenizers.PATTERN), []
    monkeypatch.setattr(of.__class__, "replay", lambda self, words: seen.append(sorted(words)) or [b"\0\0\0\0"] * len(words))
    import pyarrow as pa

    batch = pa.record_batch([pa.array([x["h"] for x in asked]), pa.array([0, 0]), pa.array([byte_bpe._packed(*byte_bpe._joined(x["words"])) for x in asked])], ["block", "slice", "words"])
    assert sum(b.num_rows for b in byte_bpe._answered(path, public_tokenizers.PATTERN)(iter([batch]))) == 2 and seen == [[b"ab", b"cd"]]


def test_tokens_of_the_vocabulary(monkeypatch):
    """Replayed, an entry of the vocabulary gives itself, as the short cut says."""
    of = byte_bpe.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    tokens = sorted(of.ranks)
    assert of.replay(tokens) == [of.ranks[t].to_bytes(4, "little") for t in tokens]


# 5


def brute_removal(rows, width=200):
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[s : s + width] for _, b in texts for s in range(len(b) - width + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - width + 1):
            if count[b[s : s + width]] > 1:
                gone[s : s + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def _near_copies():
    r = random.Random(4)
    base = "".join(r.choice("abcdé fgh") for _ in range(2500))
    rows = [(1, base), (2, base[:1200] + "X" + base[1201:]), (3, "pre " + base[100:420]), (4, "a" * 900), (5, "ab" * 300 + "c"), (6, None), (7, ""), (8, base[900:1200] * 2), (8, "same id"), (None, base[:300]), (None, base[:300]), (9, base[:700]), (9, base[:700])]
    for k in range(20):
        t = list(base[:900])
        for _ in range(5):
            t[r.randrange(900)] = r.choice("xyz")
        rows.append((100 + k, "".join(t)))
    return rows + [(500 + k, f"{r.random()}" * 3 + base[600:1100] + f"{r.random()}" * 20) for k in range(20)]


@pytest.mark.parametrize(("bits", "group"), [(8, 256), (8, 3), (3, 256), (64, 3)])
def test_removal_with_colliding_hashes(spark, bits, group):
    """Hashes of grams and contexts only bring together what is compared: with few bits nothing changes."""
    rows = _near_copies()
    got = removal_digests(spark.createDataFrame(rows, "doc_id bigint, text string"), group, bits)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_removal(rows)


def test_removal_across_pieces(spark, monkeypatch):
    """Long texts are read in pieces; windows at the seams are found too."""
    rows = _near_copies()
    monkeypatch.setattr(suffix_dedup, "PIECE", 137)
    monkeypatch.setattr(suffix_dedup, "HELD", 10)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(suffix_dedup, "occurrences", lambda d, bits: _pieces(spark, d))
    assert sorted(map(tuple, removal_digests(docs).collect()), key=repr) == brute_removal(rows)


def _pieces(spark, docs):
    """occurrences() with pieces of 137 windows, run here: workers don't see the test's setting."""
    import pyarrow as pa

    out = []
    table = docs.toArrow()

    class Maps:
        @staticmethod
        def mapInArrow(run, schema):  # noqa: N802
            out.extend(run(table.to_batches()))
            return schema

    schema = _occurrences(Maps)
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert isinstance(table, pa.Table) and max(r[5] for r in rows) <= 137
    return spark.createDataFrame(rows, schema)


# 2


def brute_language(text, model):
    """Expectation-maximisation unit by unit over every language set, the smallest first."""
    data = np.frombuffer(text.encode(), np.uint8)
    rows = model.logs[language_id.grams(data)].astype(float)
    units = [rows[i : i + language_id.UNIT].sum(axis=0) for i in range(0, len(rows), language_id.UNIT)]

    def fitted(langs):
        share = {k: 1 / len(langs) for k in langs}
        for _ in range(language_id.ROUNDS):
            total = dict.fromkeys(langs, 0.0)
            for u in units:
                p = {k: share[k] * math.exp(u[k] - max(u)) for k in langs}
                for k in langs:
                    total[k] += p[k] / max(sum(p.values()), 1e-300)
            share = {k: t / len(units) for k, t in total.items()}
        return share, sum(math.log(max(sum(share[k] * math.exp(u[k] - max(u)) for k in langs), 1e-300)) + max(u) for u in units)

    whole, _ = fitted(range(len(model.langs)))
    ranked = sorted(whole, key=lambda k: (-whole[k], k))
    best = max(((fitted(ranked[:k]), k) for k in range(1, len(ranked) + 1)), key=lambda x: (x[0][1] - language_id.PENALTY * x[1] * math.log(len(units) + 1), -x[1]))
    share = best[0][0]
    top = min(share, key=lambda k: (-share[k], k))
    return model.langs[top], share[top]


def test_mixtures_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language_id.fit(docs)
    texts = [r.text for r in docs.filter("n_chars between 100 and 3000").orderBy("doc_id").limit(25).collect()]
    texts += [a[:900] + " " + b[:700] for a, b in zip(texts, texts[7:], strict=False)]
    got = language_id.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()
    for r, text in zip(got, texts, strict=True):
        lang, share = brute_language(text, model)
        assert r.lang_pred == lang and r.score == pytest.approx(share, abs=1e-5)


def test_a_common_id_neither_fills_nor_starves_a_sample(spark):
    rows = [(1, f"the common words of one id {i % 7}", "en") for i in range(5000)] + [(10 + i, f"other words of id {i}", "en") for i in range(400)] + [(1000 + i, f"andere Wörter der Nummer {i}", "de") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for most in (20, 200):
        ids = [(r[0], r[1]) for r in sampling.bounded(docs, "lang", most).select("doc_id", "lang").collect()]
        assert len(ids) == len(set(ids)) == 2 * most
    whole = sampling.bounded(docs, "lang", 1000).select("doc_id", "lang").collect()
    assert len(whole) == 401 + 300
    got = language_id.identify(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id >= 1000} == {"de"}


def test_too_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(language_id, "LANGS", 3)
    docs = spark.createDataFrame([(4 * i, "some text", f"l{i}") for i in range(40)], "doc_id bigint, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs)


# 6


def test_votes_by_brute_force(spark, data):
    """Cosines in the latent space, one pair after the other."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").limit(60).collect()]
    got = [r.score for r in quality.score(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), model).orderBy("doc_id").collect()]
    for text, score in zip(texts, got, strict=True):
        logs = quality.counts(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))[0]
        point = (logs * model.idf).astype(float) @ model.axes
        cosines = [float(point @ k) / max(float(np.linalg.norm(point)), 1e-12) for k in model.known]
        near = sorted(range(len(cosines)), key=lambda k: -cosines[k])[: quality.NEIGHBOURS]
        votes = [max(cosines[k], 0) ** quality.POWER * model.weights[k] for k in near]
        assert score == pytest.approx(sum(v * model.labels[k] for v, k in zip(votes, near, strict=True)) / sum(votes), abs=2e-3)


def test_terms_of_a_text():
    text = b"The Tree, the TREE ### \n the the"
    logs = quality.counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]
    words = collections.Counter(np.round(np.expm1(logs[: quality.WORDS])).astype(int)[logs[: quality.WORDS] > 0].tolist())
    assert words == {4: 1, 2: 1, 1: 3}  # the; tree; comma, ###, line end
    assert round(math.expm1(logs[-1])) == 1


def test_a_common_labelled_id_is_one_row(spark):
    rows = [(3, f"good words in a row, number {i}") for i in range(5000)] + [(10 + i, f"some text of id {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(3, 1)] * 100 + [(10 + i, i % 2) for i in range(50)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    ids = {i for i in [3, *range(10, 60)] if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(model.known) == len(ids)
    assert quality.classify(docs, labels).count() == len(rows)


# 9


def test_words_in_java_and_in_sql(spark):
    text = "aZ09 é_ß-的😀x \x7f\x80\x81 ﬁ {|} `@[ İK" + "".join(map(chr, range(1, 300)))
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    got = spark.createDataFrame([(text,)], "t string").select(license_scan.words_of(F.col("t")).alias("w")).first().w
    assert got == re.findall(license_scan.WORD, low)


def _long(label):
    return next(p for x, p, kind in license_scan.TEMPLATES if x == label and kind == "long").split()


def test_spans_are_aligned(spark):
    """Shares by hand: shuffled pieces don't align, a repeated place counts once, a wide chain is no span."""
    gpl = _long("gpl")
    n = len(gpl) - 2
    texts = {
        1: (gpl, 1.0),
        2: (gpl[:10] + ["x"] + gpl[10:], (n - 2) / n),
        3: (gpl[:12] + gpl[9:], None),  # three words twice: nothing is lost, nothing counts twice
        4: (gpl[20:] + gpl[:20], None),
        5: ([w for k in range(0, len(gpl), 4) for w in [*gpl[k : k + 4], "x", "y", "z"]], None),
        6: (gpl[:3] * 40, 1 / n),
    }
    docs = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in texts.items()], "doc_id bigint, text string")
    spans = license_scan.spans(license_scan.hits(license_scan.candidates(docs))).filter("label = 'gpl'").collect()
    best = {i: max(r.share for r in spans if r.doc_id == i) for i in texts}
    for i, (_, share) in texts.items():
        if share is not None:
            assert best[i] == pytest.approx(share), i
    assert all(s <= 1 for s in best.values())
    assert best[3] > 0.9 and best[4] < 0.7 and best[5] < 0.6
    labels = {r.doc_id: r.labels for r in license_scan.scan(docs).collect()}
    assert "gpl" in labels[2].split(",") and "gpl" not in labels[5].split(",") and "gpl" not in labels[6].split(",")


def test_a_common_row_is_scanned_once(spark):
    docs = spark.createDataFrame([(1, "under the MIT license")] * 5000 + [(2, "cc by nc")], "doc_id bigint, text string")
    got = license_scan.scan(docs).groupBy("doc_id", "n_base", "labels").count().collect()
    assert sorted(map(tuple, got)) == [(1, 1, "mit", 5000), (2, 1, "cc-by-nc", 1)]
    votes = license_scan.hits(license_scan.candidates(docs))
    assert votes.filter("doc_id = 1").count() < 20


# Tables and the pipeline


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context  # noqa: N815

        class conf:  # noqa: N801
            named = None

            @classmethod
            def get(cls, name, default):
                return cls.named if name == "spark.checkpoint.dir" else default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_folder(Session)
    Session.conf.named = "hdfs://x/y/"
    assert common.shared_folder(Session) == "hdfs://x/y"
    Session.conf.named, Context.master = None, "local[2]"
    assert common.shared_folder(Session).startswith("file://")


def test_the_pipeline_leaves_one_table(spark, data):
    before = list(common._written)
    rows = corpus_pipeline.run(spark, data)
    left = [p for p in common._written if p not in before]
    assert len(left) == 1 and rows.count() > 100
    common.remove_tables(spark, left)


@pytest.mark.parametrize("sent", [500_000, 0])
def test_exact_copies_go_by_row(spark, monkeypatch, sent):
    monkeypatch.setattr(chunk_dedup, "SENT", sent)
    rows = [(1, "A text"), (5, "a TEXT"), (5, "another"), (3, "another"), (None, "a text"), (None, "x"), (None, "X"), (7, None), (8, ""), (2, "é"), (2, "É")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text_sha256", F.lit("clash")).withColumn("kept", F.lit(0))
    got = sorted(((r.doc_id, r.text) for r in chunk_dedup.keep_one(docs).collect()), key=repr)
    assert got == sorted([(5, "a TEXT"), (5, "another"), (None, "x"), (None, "X"), (8, ""), (2, "é"), (2, "É")], key=repr)


# 1


def brute_fingerprint(text):
    """Phrases symbol by symbol: runs, three rounds of coin tossing, local maxima, names of phrases; three levels."""
    full, symbols, found = 2**64 - 1, [int(parsing._BYTE[b]) for b in text], []
    mixed = lambda x: int(common.mix64(np.array([x], np.uint64))[0])

    def toss(before, x):
        low = (before ^ x) & -(before ^ x)
        bit = max(low, 1).bit_length() - 1
        return 2 * bit + (x >> bit & 1)

    for level in range(1, max(parsing.LEVELS) + 1):
        runs = [(x, len(list(same))) for x, same in itertools.groupby(symbols)]
        symbols = [(x + (n - 1) * 0x9E3779B97F4A7C15) & full for x, n in runs]
        labels = [toss(symbols[i - 1] if i else symbols[0] ^ 1, x) for i, x in enumerate(symbols)]
        for _ in range(parsing.ROUNDS - 1):
            labels = [toss(labels[i - 1] if i else labels[0] ^ 1, x) for i, x in enumerate(labels)]
        heads = [i == 0 or (i < len(labels) - 1 and labels[i - 1] < labels[i] >= labels[i + 1]) for i in range(len(labels))]
        names, place = [], 0
        for x, head in zip(symbols, heads, strict=True):
            if head:
                names.append(0)
                place = 0
            names[-1] = (names[-1] + x * int(parsing._POWER[place & 63])) & full
            place += 1
        symbols = [mixed(x) for x in names]
        if level in parsing.LEVELS:
            found.append("".join(f"{x:08x}" for x in sorted({s >> 32 for s in symbols})[: parsing.SKETCH]))
    return ".".join(found) if text else ""


def test_fingerprints_by_brute_force():
    r = random.Random(8)
    texts = [b"", b"a", b"aa", b"aaaa", b"ab" * 50, bytes(r.choice(b"abc") for _ in range(300)), "Straße é 的 ".encode() * 9, bytes(r.choice(b"abcdefgh \n") for _ in range(4000))]
    assert parsing.fingerprints(texts) == [brute_fingerprint(t) for t in texts]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    both = either = 0
    for x, y in zip(a.split("."), b.split("."), strict=True):
        p, q = ([s[i : i + 8] for i in range(0, len(s), 8)] for s in (x, y))
        least = sorted(set(p) | set(q))[: parsing.SKETCH]
        both, either = both + sum(n in p and n in q for n in least), either + len(least)
    return both / either


def brute_compared(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, xxhash.xxh3_64_intdigest(r[1] or "") >> 1))
    out = collections.Counter()
    for (i, t), (_, n) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, n = t or "", n or ""
        k = len(t) // 4
        new = t[: len(t) - k] + n[:k]
        own, changed, other = (brute_fingerprint(x.encode()) for x in (t, new, n))
        out[i, len(t), hashlib.sha256(new.encode()).hexdigest(), own, changed, brute_likeness(own, changed), brute_likeness(own, other)] += 1
    return out


@pytest.mark.parametrize("ids", ["null", "one", "hot", "copies"])
@pytest.mark.parametrize("buckets", [1, 7, 40])
def test_neighbours_of_common_ids(spark, ids, buckets, monkeypatch):
    r = random.Random(3)
    text = lambda: " ".join(r.choice(["stone", "river", "glass", "é"]) for _ in range(r.randint(0, 12)))
    rows = {
        "null": [(None, text()) for _ in range(60)],
        "one": [(5, text()) for _ in range(60)],
        "hot": [(r.choice([1, 2, 3, 3, 3, 3, None]), text()) for _ in range(90)],
        "copies": [(7, "one and the same")] * 200 + [(i, text()) for i in range(9)] + [(None, None)] * 50,
    }[ids]
    monkeypatch.setattr(parsing, "BLOCK", 300)
    got = parsing.compared(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), buckets=buckets).collect()
    assert collections.Counter(map(tuple, got)) == brute_compared(rows)


def test_a_common_id_is_split(spark):
    rows = [(5, f"text {i}") for i in range(3000)] + [(i, "x") for i in range(100)] + [(None, f"y {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sizes = [r["count"] for r in parsing.in_order(docs, 40).filter("not ahead").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < len(rows) / 10
