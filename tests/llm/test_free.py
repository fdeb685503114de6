import hashlib
import importlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from jobweave.llm import langid, line_dedup, minhash, quality, spm, warc
from test_native import brute_contamination

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, digest string"


def docs(spark, rows, langs=None):
    return spark.createDataFrame([(i, t, langs[k] if langs else None, None, len(t or ""), "clash", "clash") for k, (i, t) in enumerate(rows)], DOCS)


def sets(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    s = [sets(t, k) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= percent * len(s[a] | s[b]):
                top[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(s[x]), least.get(find(x)), i == least.get(find(x))) for x, (i, _) in enumerate(rows)), key=str)


def near_rows(n=60):
    rng = random.Random(1)
    base = [[f"b{g}x{i}" for i in range(120)] for g in range(3)]
    rows = []
    for k in range(n):
        w = list(base[k % 3])
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{k}{rng.random()}"
        rows.append((1000 - k, " ".join(w)))
    return rows + [(1, None), (2, ""), (3, " \t"), (4, "one two"), (5, "ONE two"), (6, "two one"), (None, rows[0][1]), (990, rows[10][1]), (990, "other text for a repeated id"), (7, "w" * 5000)]


def test_minhash(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 8)  # several blocks a bucket
    for k, percent in ((3, 85), (5, 80)):
        rows = near_rows()
        out = minhash.near_duplicates(docs(spark, rows), k, percent).drop("at")
        assert sorted((tuple(r) for r in out.collect()), key=str) == brute_components(rows, k, percent)
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_minhash_blocks_alone(spark, monkeypatch):
    """Without hub rounds the blocks have to find all links of large buckets."""
    monkeypatch.setattr(minhash, "HUBS", 1)
    monkeypatch.setattr(minhash, "HUB_ROUNDS", 1)
    rows = near_rows(90)
    out = minhash.near_duplicates(docs(spark, rows), 3, 85).drop("at")
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute_components(rows, 3, 85)


def test_components(spark):
    rng = random.Random(3)
    pairs = [(f"{rng.randrange(300):03d}", f"{rng.randrange(300):03d}") for _ in range(200)] + [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(40)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    got = {r.node: r.root for r in minhash.connected_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    nodes = {x for p in pairs if p[0] != p[1] for x in p}
    assert all(got.get(x, x) == find(x) for x in nodes)


def test_word_hashes_cross_stretches(monkeypatch):
    text = "ab\tcd\n" * 50 + "long" * 20 + " x y"
    whole = minhash.word_hashes(text)
    monkeypatch.setattr(minhash, "STRETCH", 16)
    assert (minhash.word_hashes(text) == whole).all() and len(whole) == len(text.split())


@pytest.mark.parametrize("forest", [1 << 20, 0])
@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components(spark, monkeypatch, forest, kind):
    monkeypatch.setattr(minhash, "FOREST", forest)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(3, 3), (5, 6), (6, 5), (5, 6)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        top[y] = x
    to = (lambda k: k - 150) if kind == "long" else (lambda k: k.to_bytes(4, "big"))
    rows = spark.createDataFrame([(to(a), to(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(3)
    got = sorted((r.node if kind == "long" else bytes(r.node), r.root if kind == "long" else bytes(r.root)) for r in minhash.connected_components(rows).collect())
    assert got == sorted((to(k), to(find(k))) for k in top if find(k) != k)
    assert minhash.connected_components(rows.where("false")).collect() == []


def plain_word_hash(word):
    total = 0
    for c in reversed(word.encode().lower()):
        total = (total * minhash.BASE + int(minhash._byte[c])) % (1 << 64)
    return int(minhash._mix(np.array([total], np.uint64))[0])


@pytest.mark.parametrize("stretch", [1 << 20, 1 << 10, 64])
def test_a_word_has_one_hash(monkeypatch, stretch):
    monkeypatch.setattr(minhash, "STRETCH", stretch)
    rng = random.Random(4)
    for _ in range(20):
        lengths = [rng.choice([1, 2, 5, stretch // 2, stretch - 1, stretch, stretch + 1, 2 * stretch, 2 * stretch + 1, 5 * stretch]) if stretch < 1 << 20 else rng.randrange(1, 9) for _ in range(rng.randrange(1, 30))]
        words = [("Wé" + str(rng.random())) * n for n in lengths]
        words = [w[:n] for w, n in zip(words, lengths, strict=True)]
        text = rng.choice(["", " ", "\n"]) + "".join(w + rng.choice([" ", "\t", "  \n ", " " * min(3 * stretch, 9999)]) for w in words)
        for t in (text, text.rstrip()):
            assert minhash.word_hashes(t).tolist() == [plain_word_hash(w) for w in words]


def test_minhash_beside_giant_words(spark):
    words = [f"w{i}" for i in range(1000)]
    giant = ["x" * n for n in (1_100_000, 2_200_000, 5_000_000)]
    rows = [(1, " ".join(words)), *((2 + k, " ".join(words[: 300 * k] + [g] + words[300 * k :])) for k, g in enumerate(giant)), (9, " ".join([giant[1], *["s t"] * 400_000, *words, giant[1]]))]
    got = sorted(tuple(r)[:4] for r in minhash.near_duplicates(docs(spark, rows), words=3, percent=85).collect())
    assert got == brute_components(rows, 3, 85)
    assert {r[2] for r in got[:4]} == {1}


def test_one_document_of_each_group_stays(spark):
    a, b = " ".join(f"word{i}" for i in range(80)), " ".join(f"term{i}" for i in range(80))
    rows = [(3, a), (3, a + " more"), (5, a + " extra"), (None, b), (None, b + " more"), (None, b), (None, "alone here"), (None, "another one"), (7, None), (7, ""), (8, "x")]
    got = minhash.drop_near_duplicates(docs(spark, rows)).collect()
    groups = [[r for r in got if (r.text or "").startswith(w)] for w in ("word", "term")]
    assert [len(g) for g in groups] == [1, 1] and groups[0][0].doc_id == 3 and groups[1][0].doc_id is None
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None) for r in got if r not in (groups[0][0], groups[1][0])) == [(False, 7, "", False), (False, 7, "", True), (False, 8, "x", False), (True, 0, "alone here", False), (True, 0, "another one", False)]


def test_rows_of_numbers_stay(spark):
    rows = [(k, f"{k} {k + 1}.5 {k * 7} {k}\nid {k} of {k + 2} {k + 3}\nitem number {k} was sold today") for k in range(4)]
    out = {r.doc_id: r.text.split("\n") for r in line_dedup.drop_recurring_lines(docs(spark, rows)).collect()}
    assert out[0] == rows[0][1].split("\n")
    assert all(out[k] == rows[k][1].split("\n")[:2] for k in (1, 2, 3))


def test_line_dedup(spark):
    long = " ".join(f"word{chr(97 + i % 26)}" for i in range(60))
    rows = [(1, f"own line of the first text\n{long}\nshort one"), (2, f"{long}\nanother line that stands alone\nshort one"), (3, "request 12 took 5 ms in all"), (4, "request 99 took 7 ms in all\n\ntail of the fourth text here"), (5, None), (6, ""), (None, long), (7, long), (7, long)]
    out = {(r.doc_id, k): r for k, r in enumerate(line_dedup.drop_recurring_lines(docs(spark, rows)).collect())}
    text = {}
    for (i, _), r in out.items():
        text.setdefault(i, []).append(r.text)
        assert r.n_chars == len(r.text or "") and r.score == "clash"
    assert text[1] == [rows[0][1]] and text[2] == ["another line that stands alone\nshort one"]
    assert text[3] == [rows[2][1]] and text[4] == ["\ntail of the fourth text here"]
    assert text[5] == [None] and text[6] == [""] and text[None] == [""] and text[7] == ["", ""]
    assert line_dedup.drop_recurring_lines(docs(spark, [])).count() == 0


def test_cluster():
    a, b = "the quick brown fox jumps over the lazy dog now".split(), "the quick brown cat jumps over the lazy dog now".split()
    assert line_dedup.cluster([a, b, list("abcdefghij"), a]) == [0, 0, 1, 0]


def parts_of(spark, texts):
    return {r.m: r.p for r in spark.createDataFrame([(t, bytearray(line_dedup.xxhash.xxh3_128_digest(t))) for t in texts], "m string, h binary").select("m", F.pmod(F.xxhash64("h"), F.lit(line_dedup.PARTS)).alias("p")).collect()}


def brute_templates(texts, part):
    """The template of each masked line of a leaf: greedy in each part of the leaf, then greedy over the parts' templates."""
    first, lines = [], {}
    for p in range(line_dedup.PARTS):
        mine = sorted(t for t in texts if part[t] == p)
        chosen, shown = brute_cluster([t.split() for t in mine], True)
        for k, t in enumerate(mine):
            lines[t] = (p, chosen[k])
        first += [(" ".join(x), line_dedup.xxhash.xxh3_128_digest(mine[chosen.index(k)]), (p, k)) for k, x in enumerate(shown)]
    first.sort()
    whole = dict(zip((x[2] for x in first), brute_cluster([x[0].split() for x in first]), strict=True))
    return {t: whole[k] for t, k in lines.items()}


@pytest.mark.parametrize("at", ["late", "early", "random"])
def test_template_rule_holds_at_every_size(spark, at):
    """300 variants of one line and 3000 give the same result: all lose it but the first (random: but the first of each template)."""
    left = {}
    for n in (300, 3000):
        rng, rows = random.Random(1), []
        for i in range(n):
            line = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
            for j, k in enumerate({"late": (20, 30, 40), "early": (5, 7, 40), "random": rng.sample(range(4, 60), 3)}[at]):
                line[k] = "".join(chr(97 + int(d)) for d in f"{i}{j}")
            rows.append((i, " ".join(line)))
        out = line_dedup.drop_recurring_lines(docs(spark, rows)).select("doc_id", "text").collect()
        left[n] = sum(r.text != "" for r in out)
        if at != "random":
            assert sorted(r.doc_id for r in out if r.text) == [0]
        assert left[n] == len(set(brute_templates([t for _, t in rows], parts_of(spark, [t for _, t in rows])).values()))
    assert left[3000] < 3000 * max(left[300], 10) / 300


def test_lines_without_a_template_go_as_exact_repeats(spark):
    zh = "版权所有未经许可不得转载本站任何内容"
    rows = [(1, f"Les.\n10 20 30 40 50\nown 1\n\n{zh}甲\n12"), (2, f"Les.\n10 20 30 40 51\nown 2\n\n{zh}乙\n12\n版权"), (3, f"{zh}丙\n10 20 30 40 50\n les. \n版权\n13"), (4, "Les.\nLes.\nown 1 2")]
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_recurring_lines(docs(spark, rows), repeats=True).collect()}
    assert out == {1: (rows[0][1], 6, 0), 2: ("10 20 30 40 51\nown 2\n\n版权", 7, 3), 3: (" les. \n13", 5, 3), 4: ("own 1 2", 3, 2)}
    assert line_dedup._tokens("ab 日本語2024年 ไท") == ["ab", "日", "本", "語", line_dedup.ANY, "年", "ไ", "ท"]


def brute_cluster(rows, shown=False):
    templates, chosen = [], []
    for tokens in rows:
        same = [sum(x == y for x, y in zip(t, tokens, strict=True)) for t in templates]
        if same and max(same) >= line_dedup.AGREE * len(tokens):
            at = same.index(max(same))
            templates[at] = [x if x == y else line_dedup.ANY for x, y in zip(templates[at], tokens, strict=True)]
        else:
            at = len(templates)
            templates.append(tokens)
        chosen.append(at)
    return (chosen, templates) if shown else chosen


@pytest.mark.parametrize("n", [4, 5, 6, 9, 10, 23])
def test_templates_compare_all_that_agree(n):
    rng = random.Random(n)
    rows = [["a", "b", "c", "d", *rng.choices(["<*>", "x", "y", *map(str, range(8))], [3, 9, 3, *[1] * 8], k=n - 4)] for _ in range(600)]
    whole, led = line_dedup.Templates(n), line_dedup.Templates(n, 4)
    want = brute_cluster(rows)
    assert [whole.add(r) for r in rows] == want and [led.add(r) for r in rows] == want


@pytest.mark.parametrize("few", [200_000, 0])
def test_warc(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    big = "é" * 600
    rows = [(1, "http://a/ b", big), (5, None, big), (3, "x", big), (2, "y", "small"), (4, "z", "small"), (6, "q", None), (None, "n", big), (5, "again", big)] + [(i, "u", f"page {i} " + "t" * 3000) for i in range(100, 300)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, size string")
    archive = warc.write_archive(pages, str(tmp_path / "w"))
    got = sorted((tuple(r) for r in warc.read_archive(archive).collect()), key=str)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        revisit = t == big and i != 5
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None))
    assert got == sorted(want, key=str)
    fetched = {r.record_id: r.record for r in warc.fetch_records(archive, spark.createDataFrame([("urn:x-page:150",), ("urn:x-page:none",), ("urn:x-page:9",)], "record_id string")).collect()}
    assert set(fetched) == {"urn:x-page:150", "urn:x-page:none"}
    head, payload, end = warc.parse_record(fetched["urn:x-page:150"])
    assert payload == rows[-150][2].encode() and end == len(fetched["urn:x-page:150"]) and head["warc-type"] == "response"
    assert warc.read_archive(warc.write_archive(pages.limit(0))).count() == 0


@pytest.fixture(scope="module")
def encoder():
    with open(spm.default_model(), "rb") as f:
        return spm.BacktrackingEncoder(f.read())


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(), st.text(alphabet=" ▁ath\ne.sing0é"), st.text(alphabet="a b", min_size=50)))
def test_sentencepiece_equals_library(encoder, text):
    ids = np.frombuffer(encoder.encode(text), "<u4").tolist()
    assert ids == encoder.library.encode(text, add_bos=True, add_eos=True)


def test_sentencepiece_table(spark, encoder):
    rows = [(1, None), (2, ""), (3, "hello  world"), (3, "hello  world"), (None, "x" * 20_000 + "é" * 3000)]
    out = spm.encode_decode(docs(spark, rows)).collect()
    for r, (i, t) in zip(sorted(out, key=str), sorted(((r.doc_id, None) for r in out), key=str), strict=True):
        assert r.n_tokens == len(r.ids) and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    texts = {r.doc_id: (r.ids, r.decoded) for r in out}
    for i, t in rows:
        assert texts[i][0] == encoder.library.encode(t or "", add_bos=True, add_eos=True) and texts[i][1] == (t or "")


def labelled(n=240):
    rng = random.Random(2)
    pools = {"aa": ["the", "of", "and", "thing", "with"], "bb": ["der", "und", "nicht", "über", "schon"]}
    rows, langs = [], []
    for i in range(n):
        lang = ("aa", "bb")[i % 2]
        rows.append((i, " ".join(rng.choice(pools[lang]) for _ in range(rng.randrange(5, 200)))))
        langs.append(lang)
    return rows, langs


def test_language(spark):
    rows, langs = labelled()
    extra = [(1000, None), (1001, ""), (1002, "123 !?"), (None, "der und nicht schon über der und")]
    df = docs(spark, rows + extra, langs + [None] * 4)
    out = langid.predict_language(df).collect()
    known = {r.doc_id: r for r in out}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 50 and np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.95
    assert all((known[i].lang_pred, known[i].score) == ("und", 0.0) for i in (1000, 1001, 1002)) and known[None].lang_pred == "bb"
    kept = langid.keep_known_languages(df)
    assert kept.columns == df.columns and {r.score for r in kept.collect()} == {"clash"} and kept.where("doc_id IN (1000, 1001, 1002)").count() == 0
    assert langid.predict_language(docs(spark, [(1, "text")])).first().lang_pred == "und"
    assert langid.predict_language(docs(spark, [])).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["good", "plain", "words"] if i % 3 else ["$$$", "&&&", "junk%%%"]) for _ in range(40))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i, _ in rows] + [(1, None, None), (2, 7, None)], "doc_id long, quality int, y string")
    df = docs(spark, rows + [(900, None), (901, ""), (902, "é"), (None, "good")])
    out = {r.doc_id: r for r in quality.score_quality(df, labels).collect()}
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in out.values()) and len(out) == 304
    assert {r.score for r in quality.score_quality(df, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(docs(spark, []), labels).count() == 0


def test_language_gradients():
    rng = np.random.default_rng(0)
    mask = langid.kernel_mask().astype(np.float64)
    n = langid.FILTERS * len(langid.WIDTHS)
    m = langid.Model(["a", "b", "c"], rng.normal(0, 0.5, (256, langid.DIM)), rng.normal(0, 0.35, mask.shape) * mask, rng.normal(0, 0.1, n), rng.normal(0, 0.5, (n, 3)), rng.normal(0, 0.1, 3))
    m.embed[0] = 0
    windows, y, w = np.concatenate([langid.cut(t)[0] for t in ("some text to try", "und noch einer", "ünï")]), np.array([0, 1, 2]), np.array([1.0, 0.5, 2.0])
    loss = lambda: float(-(w * np.log(m.probabilities(windows)[np.arange(3), y])).sum() / 3)
    for name, grad in langid.gradients(m, windows, y, w, mask).items():
        values = getattr(m, name)
        for at in np.argsort(-np.abs(grad).ravel())[:6]:
            k = np.unravel_index(at, values.shape)
            before, sides = values[k], []
            for step in (1e-5, -1e-5):
                values[k] = before + step
                sides.append(loss())
            values[k] = before
            assert abs((sides[0] - sides[1]) / 2e-5 - grad[k]) < 1e-5 * max(1, abs(grad[k])), name


def test_quality_gradients_and_features():
    rng = np.random.default_rng(1)
    vectors, share, out, bias = rng.normal(0, 1, (5, 8)), rng.random(5), rng.normal(0, 1, (8, 2)), rng.normal(0, 1, 2)

    def loss():
        z = share @ vectors @ out + bias
        return float(np.log(np.exp(z).sum()) - z[1])

    for values, grad in zip((vectors, out, bias), quality.gradients(vectors, share, out, bias, 1), strict=True):
        for k in np.ndindex(values.shape):
            before, sides = values[k], []
            for step in (1e-6, -1e-6):
                values[k] = before + step
                sides.append(loss())
            values[k] = before
            assert abs((sides[0] - sides[1]) / 2e-6 - grad[k]) < 1e-6
    # Two words, one pair of them, and the n-grams of three and four of six characters, spaces at the ends included.
    flat = lambda text: [int(x) for part in quality.buckets(text) for x in part]
    assert len(flat("ab \u4f60")) == 2 + 1 + 4 + 3
    assert flat("ab cd") == flat("ab\u3000cd") and flat(" \n") == []


def plain_buckets(text):
    """Buckets of a text, feature by feature."""
    white = set(map(int, quality._WHITE)) | set(range(33))
    codes = [32, *(32 if ord(c) in white else ord(c) for c in text), 32]
    if set(codes) == {32}:
        return []
    p = [int(x) for x in quality._powers]
    word = lambda w: sum((c + 1) * p[k % 64] for k, c in enumerate(w))
    words, w = [], []
    for c in codes:
        if c != 32:
            w.append(c)
        elif w:
            words.append(word(w))
            w = []
    grams = lambda n: [sum(c * q for c, q in zip(codes[k : k + n], p)) for k in range(len(codes) - n + 1)]

    def bucket(x, kind):
        x %= 1 << 32
        return (((x ^ (x >> 15)) * 2654435761) % (1 << 32) >> (32 - quality.BITS)) + (kind << quality.BITS)

    pairs = [a % (1 << 32) * p[4] + b % (1 << 32) * p[5] for a, b in zip(words, words[1:])]
    return [bucket(x, kind) for kind, xs in enumerate((words, pairs, grams(3), grams(4))) for x in xs]


@pytest.mark.parametrize("stretch", [1 << 19, 1, 2, 3, 7, 64])
def test_features_know_no_seams(monkeypatch, stretch):
    monkeypatch.setattr(quality, "STRETCH", stretch)
    rng = random.Random(stretch)
    texts = ["", " ", "a", "ab", "abc def", "x" * 200, " lead and trail \n", "\u4f60\u597d " * 9, "\x01\x02", "a\u3000b"]
    texts += ["".join(rng.choice("abc \n\u00e9") for _ in range(rng.randrange(150))) for _ in range(20)]
    for t in texts:
        assert sorted(int(x) for part in quality.buckets(t) for x in part) == sorted(plain_buckets(t)), t


def test_quality_equals_a_plain_version(spark, monkeypatch):
    """Scores of a plain scorer, from a fit on plainly counted features of all labelled rows; some texts cross a stretch."""
    monkeypatch.setattr(quality, "STRETCH", 1000)
    rng = random.Random(9)
    texts = [(k, " ".join(rng.choice(["good", "fine", "text", "here"] if k % 2 else ["spam", "buy", "now", "text"]) for _ in range(rng.choice([3, 40, 900])))) for k in range(30)] + [(90, None), (91, "")]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, k % 2) for k, _ in texts[:28]], "doc_id long, quality int")
    count = lambda t: Counter(plain_buckets(t or ""))
    sample = []
    for k, t in texts[:28]:
        if zlib.crc32(str(k).encode()) % 3 != 1:
            c = count(t)
            at = sorted(c)
            sample.append((np.array(at, np.int32), np.array([c[x] / max(sum(c.values()), 1) for x in at], np.float32), k % 2))
    m = quality.fit(sample, (1.0, 1.0))
    for r in quality.score_quality(df, labels).collect():
        c = count(dict(texts)[r.doc_id])
        z = sum(n * float(m.weight[x]) for x, n in c.items()) / max(sum(c.values()), 1) + m.bias
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-6 and r.predicted == int(r.score >= 0.5)


def test_many_languages(spark, monkeypatch):
    """More languages than the fit's bound: the most frequent are learned; no plan grows with their number."""
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rows = [(k, f"word{k % 3000} text") for k in range(4000)]
    df = docs(spark, rows, [f"l{k % 3000:04d}" for k in range(4000)])
    assert langid.predict_language(df).where("lang_pred IS NULL OR score < 0 OR score > 1").count() == 0
    model = langid.train(df, F.lit(True), most=500)
    assert len(model.langs) <= 500 and set(model.langs) <= {f"l{k:04d}" for k in range(1000)}


def test_very_long_texts_and_repeated_rows(spark):
    long = [(1, "good words " * 150_000), (1, "good words " * 150_000), (2, "x" * 1_500_000), (3, "a\n" * 400_000)]
    df = docs(spark, long, ["aa", "aa", "bb", "bb"])
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    scores = quality.score_quality(df, labels).collect()
    assert len(scores) == 4 and len({r.score for r in scores if r.doc_id == 1}) == 1
    assert langid.predict_language(df).where("lang_pred IN ('aa', 'bb')").count() == 4
    out = {r.doc_id: r for r in line_dedup.drop_recurring_lines(df, repeats=True).collect()}
    assert out[2].text == long[2][1] and out[3].n_lines == 400_001 and out[3].n_dropped == 0 and out[1].n_dropped == 0


def test_another_kind_of_model_is_refused(spark, monkeypatch):
    monkeypatch.setattr(spm, "PROBES", ("a",))
    monkeypatch.setattr(spm.BacktrackingEncoder, "encode", lambda self, text: b"")
    with pytest.raises(ValueError, match="only BPE models"):
        spm.encode_decode(docs(spark, [(1, "a")]))


def test_shared_folder_off_local_masters(spark, monkeypatch):
    from types import SimpleNamespace

    from jobweave.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(far)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None)
    t = common.materialize(spark.range(3), "t")
    assert t.count() == 3 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) == before
    common.forget(t)
    with pytest.raises(Exception):
        t.count()


def test_stages_on_an_empty_table_nulls_and_repeats(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    long = " ".join(f"uniq{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    tables = {"empty": [], "odd": [(1, None), (2, ""), (None, long), (None, long), (5, long), (5, long), (6, " \n ")]}
    for name, rows in tables.items():
        d = tmp_path / name
        spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in rows], kind).coalesce(1).write.parquet(str(d / "documents.parquet"))
        spark.createDataFrame([(1, "some other item text"), (2, None)], "item_id long, text string").coalesce(1).write.parquet(str(d / "benchmark.parquet"))
        docs_ = spark.read.parquet(str(d / "documents.parquet"))
        for stage, f in pipeline.STAGES:
            out = f(spark, docs_, str(d))
            n = out.count()
            assert n <= len(rows) and (stage == "encode" or out.columns == docs_.columns)
            if stage == "near_copies" and rows:
                assert sorted(str(r.doc_id) for r in out.collect() if r.text == long) == ["5"]
            if stage == "benchmark":
                assert n == len(rows)
        assert pipeline.run(spark, str(d)).count() == 0  # no language is known


def test_pipeline(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    rows, langs = labelled(90)
    long = " ".join(f"uniq{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    item = " ".join(f"bench{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(20))
    rows += [(500, "123 456"), (501, long), (502, long + " more"), (503, item + " und der")]
    df = docs(spark, rows, langs + [None] * 4).select("doc_id", "text", "lang", "source", "n_chars")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert not {500, 502, 503} & set(out) and 501 in out and len(out) >= 85
    assert len(pipeline.STAGES) == 5


def brute_language(model, text):
    """The best language's score, one window and one place at a time; 0 without a letter."""
    if not any(map(str.isalpha, text or "")):
        return 0.0
    data = text.encode()
    total = np.zeros(len(model.langs))
    for at in range(0, len(data), langid.WINDOW):
        piece = data[at : at + langid.WINDOW]
        vectors = model.embed[list(piece.ljust(langid.WINDOW, b"\0"))]
        wide = max(langid.WIDTHS)
        best = np.max([vectors[k : k + wide].ravel() @ model.kernel for k in range(langid.WINDOW - wide + 1)], axis=0)
        z = np.maximum(best + model.bias, 0) @ model.out + model.out_bias
        total += np.exp(z - z.max()) / np.exp(z - z.max()).sum() * len(piece) / len(data)
    return total.max()


def brute_lines(spark, rows):
    leaves = {}
    for i, t in rows:
        for no, line in enumerate(t.split("\n")):
            words = line.split()
            tokens = [line_dedup.ANY if re.search("[0-9]", w) else w for w in words]
            if len(tokens) >= max(line_dedup.MIN_TOKENS, 2 * tokens.count(line_dedup.ANY)):
                leaf, key = (len(tokens), *tokens[: line_dedup.DEPTH]), " ".join(tokens)
            elif words:
                leaf, key = ("exact", *words), ""
            else:
                continue
            leaves.setdefault(leaf, {}).setdefault(key, []).append((i, no))
    part, drop = parts_of(spark, [k for keys in leaves.values() for k in keys if k]), set()
    for keys in leaves.values():
        of = brute_templates(list(keys), part) if "" not in keys else {"": 0}
        places = {}
        for key, found in keys.items():
            places.setdefault(of[key], []).extend(found)
        for found in places.values():
            if len({i for i, _ in found}) > 1:
                drop |= set(found) - {min(found)}
    out = []
    for i, t in rows:
        stay = [line for no, line in enumerate(t.split("\n")) if (i, no) not in drop]
        if any(map(str.strip, stay)):
            out.append((i, "\n".join(stay)))
    return out


def mixed_corpus():
    """Two languages, lines of templates and exact repeats, near copies with other line ends, benchmark passages, rows without a letter."""
    rng, rows, langs = random.Random(7), [], []
    pools = {"aa": ["the", "of", "and", "thing", "with"], "bb": ["der", "und", "nicht", "über", "schon"]}
    pools = {lang: [a + b for a in pool for b in ["", *pool]] for lang, pool in pools.items()}
    draw = lambda lang, n: [rng.choice(pools[lang]) for _ in range(n)]
    wrap = lambda ws, n: "\n".join(" ".join(ws[k : k + n]) for k in range(0, len(ws), n))
    item = [f"bench{chr(97 + i)}" for i in range(20)]
    bases = [draw(("aa", "bb")[k % 2], 150) for k in range(4)]
    for i in range(130):
        lang = ("aa", "bb")[i % 2]
        if i < 80:
            text = wrap(draw(lang, rng.randrange(20, 160)), rng.randrange(5, 10))
            text += f"\npage {i} of {i * 3} was printed for reader {i}" * (rng.random() < 0.5) + "\n\nLes." * (rng.random() < 0.3)
            text = text if i % 9 else "Les.\npage 7 of 9 was printed for reader 5"
        elif i < 116:
            words = list(bases[i % 4])
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(pools[lang])
            text = wrap(words, 6 + i % 11)
        else:
            words = draw(lang, (60, 60, 900, 395)[i % 4])
            words[7:7] = item if i % 4 else item[:12]
            text = wrap(words, 37 + i)
        rows.append((i, text))
        langs.append(lang)
    odd = [(200, None), (201, ""), (202, "123 !?"), (203, " \n "), (None, "und der nicht schon über und der")]
    return rows + odd, langs + [None] * len(odd), " ".join(item)


def test_pipeline_equals_brute_force(spark, tmp_path, monkeypatch, encoder):
    pipeline = importlib.import_module("corpus_pipeline")
    rows, langs, item = mixed_corpus()
    df = docs(spark, rows, langs).select("doc_id", "text", "lang", "source", "n_chars")
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}

    def noted(name, stage):
        def run(spark, documents, sf_dir):
            seen[name] = sorted(((r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()), key=str)
            return stage(spark, documents, sf_dir)

        return name, run

    monkeypatch.setattr(pipeline, "STAGES", [noted(*s) for s in pipeline.STAGES])
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, str(tmp_path)).collect()), key=str)

    model = langid.train(df, ~langid.held_out(F.col("doc_id")))
    last = line_dedup.LAST
    want = [(last if i is None else i, t) for i, t in rows if brute_language(model, t) >= 0.3]
    by_stage = {"lines": want}
    by_stage["near_copies"] = want = brute_lines(spark, want)
    stay = {i for i, _, _, kept in brute_components(want, 5, 80) if kept}
    by_stage["benchmark"] = want = [(i, t) for i, t in want if i in stay]
    dirty = {r[0] for r in brute_contamination(want, [(1, item)]) if r[-1]}
    by_stage["encode"] = want = [(i, t) for i, t in want if i not in dirty]
    public = lambda i: None if i == last else i
    for name, some in by_stage.items():
        assert seen[name] == sorted(((public(i), t) for i, t in some), key=str), name
    sizes = [len(seen[name]) for name, _ in pipeline.STAGES]
    assert sizes == sorted(set(sizes), reverse=True), sizes  # every stage drops some
    out = []
    for i, t in want:
        ids = encoder.library.encode(t, add_bos=True, add_eos=True)
        decoded = encoder.library.decode(ids)
        out.append((public(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(out, key=str)


def test_emptied_documents_leave_the_pipeline(spark):
    pipeline = importlib.import_module("corpus_pipeline")
    line, other = "one line that several documents hold", "and one more of that kind here"
    rows = [(1, f"{line}\n{other}"), (2, line), (3, f"{other}\n\n\u00a0\n{line}"), (4, f"{line}\nown"), (5, None), (6, ""), (7, " \n"), (None, line)]
    out = pipeline.lines(spark, docs(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == [(1, rows[0][1]), (4, "own"), (5, ""), (6, ""), (7, " \n")]
