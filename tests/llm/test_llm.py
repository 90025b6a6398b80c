"""Training-data operators against brute force, on small frames with nulls, ties, copies and clashing columns."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from likeness.llm import vector_duplicates
from likeness.llm.common import components
from likeness.llm.contamination import decontaminate
from likeness.llm.host_trust import filter_urls
from likeness.llm.main_text import extract_main_text, minimum_cut
from likeness.llm.near_duplicates import near_duplicates, one_of_each
from likeness.llm.queries import RULES
from likeness.llm.repeated_spans import merge, repeated_spans, transform
from likeness.llm.site_quality import quality
from likeness.llm.source_mixing import mix_sources, mixed_corpus
from likeness.llm.surrogates import replace_entities
from likeness.llm.toxicity import toxicity
from likeness.llm.vector_duplicates import near_duplicate_vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, h string, _keep string"
RNG = np.random.default_rng(5)
WORDS = ["w" + "".join(RNG.choice(list("abcdefgh"), 4)) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = prose(120, 1)
TEXTS = [(1, BASE), (1, BASE), (2, BASE + " tail"), (3, prose(90, 2)), (4, None), (5, ""), (6, "One two"), (None, prose(60, 3)),
         (7, prose(40, 4) + " " + BASE[100:420] + " " + prose(30, 5)), (8, "é" * 260 + prose(5, 6)), (9, "é" * 300), (10, prose(20_000, 7)),
         (3, prose(30, 8)), (11, " \t\n ")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i != 3 else None, None if i == 2 else f"s{(i or 0) % 3}", len(t or ""), "x", "y", "z") for i, t in TEXTS]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def removed(texts, length=200):
    seen = {}
    for t in texts:
        for j in range(len(t) - length + 1):
            seen[t[j:j + length]] = seen.get(t[j:j + length], 0) + 1
    for t in texts:
        mask = np.zeros(len(t), bool)
        for j in range(len(t) - length + 1):
            if seen[t[j:j + length]] > 1:
                mask[j:j + length] = True
        yield mask


def test_repeated_spans(docs, nothing):
    texts = [(t or "").encode() for _, t in TEXTS]
    want = sorted((str(i), len(t), int(m.sum()), int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum()),
                   hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~m])).hexdigest())
                  for (i, _), t, m in zip(TEXTS, texts, removed(texts), strict=True))
    got = sorted((str(r[0]), *r[1:5]) for r in repeated_spans(docs).collect())
    assert got == want
    assert repeated_spans(nothing).count() == 0


def test_merged_transforms_find_repeats():
    rows = RNG.integers(97, 99, (60, 12)).astype(np.uint8)
    found = merge([transform(rows[:25]), transform(rows[25:40]), transform(rows[40:])], 5)
    for c in range(8):
        parts = [bytes(r[c:c + 5]) for r in rows]
        assert found[:, c].tolist() == [parts.count(p) > 1 for p in parts]


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[j:j + width]) for j in range(len(w) - width + 1)])


def test_near_duplicates(docs, nothing):
    sets = [shingles(t, 3) for _, t in TEXTS]
    up = list(range(len(sets)))
    for _ in sets:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if x and y and TEXTS[a][0] and TEXTS[b][0] and 100 * len(x & y) >= 85 * len(x | y):
                    up[a] = up[b] = min(up[a], up[b])
    want = []
    for a, (i, _) in enumerate(TEXTS):
        ids = [TEXTS[b][0] for b in range(len(up)) if up[b] == up[a] and TEXTS[b][0] is not None]
        c = min(ids) if ids and i is not None else i
        want.append((str(i), len(sets[a]), str(c), i is None or i == c))
    got = near_duplicates(docs, width=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((str(r[0]), r[1], str(r[2]), r[3]) for r in got) == sorted(want)
    left = one_of_each(docs)
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "10", "11", "3", "3", "4", "5", "6", "7", "8", "9", "None"])
    assert near_duplicates(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 110)] + [(109, 110), (100, 100), (50, 51), (51, 50)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 111)}, 50: 50, 51: 50}
    assert components(spark.createDataFrame([(7, 7)], "a long, b long")).count() == 0


def test_decontamination(spark, docs, nothing):
    items = [(1, BASE[100:300]), (2, "one TWO"), (3, None), (4, ""), (5, BASE[100:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for g in [tuple(w)] if 0 < len(w) < 10 else [tuple(w[j:j + 10]) for j in range(len(w) - 9)]:
            windows.setdefault(g, set()).add(str(i))
    want = []
    for i, t in TEXTS:
        w, hit, ids = words(t), set(), set()
        for g, names in windows.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j:j + len(g)]) == g:
                    hit.update(range(j, j + len(g)))
                    ids |= names
        want.append((str(i), len(w), len(hit), ",".join(sorted(ids))))
    found = decontaminate(docs, bench)
    assert sorted((str(r["doc_id"]), r["_n_words"], r["_n_hit"], ",".join(r["_items"])) for r in found.collect()) == sorted(want)
    assert decontaminate(nothing, bench).count() == 0
    again = decontaminate(found.where("_clean is not null").select("doc_id", F.col("_clean").alias("text")), bench)
    assert again.where("_n_hit > 0").count() == 0


def test_mixing(docs, nothing):
    rows = mix_sources(docs).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        got = by.setdefault((r["source_size"], r["target"]), [0, 0])
        got[0] += r["taken"]
        got[1] += r["size"]
    assert all(abs(taken - target) <= 1 for (_, target), (taken, _) in by.items())
    assert abs(sum(t for _, t in by) - 1.5 * sum(r["size"] for r in rows)) < 1e-6
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs.repartition(5)).collect()))
    assert mix_sources(nothing).count() == 0


def test_mix_is_carried_out(spark, docs, nothing):
    texts = {(i, t): len((t or "").split()) for i, t in TEXTS}
    taken, got = {}, {}
    for r in mix_sources(docs).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    for r in mixed_corpus(docs).collect():
        words = len(r["_mixed"].split())
        assert words and r["text"].startswith(r["_mixed"]) and set(docs.columns) < set(r.asDict())
        assert words <= texts[r["doc_id"], r["text"]]
        got.setdefault(r["doc_id"], []).append((r["_copy"], words))
    assert {i: sum(w for _, w in x) for i, x in got.items()} == {i: n for i, n in taken.items() if n}
    assert any(c for x in got.values() for c, _ in x) and any(not n for n in taken.values())
    stage = corpus_pipeline.mixed(spark, docs, "").collect()
    assert sorted((str(r["doc_id"]), r["copy"], len(r["text"].split())) for r in stage) == sorted((str(i), c, w) for i, x in got.items() for c, w in x)
    assert all(r["n_chars"] == len(r["text"]) for r in stage)
    assert mixed_corpus(nothing).count() == 0


def test_vectors(spark):
    base = RNG.normal(size=16)
    near = [(base + 0.05 * RNG.normal(size=16)).tolist() for _ in range(30)]
    rows = [(i, v) for i, v in enumerate(near)] + [(100 + i, RNG.normal(size=16).tolist()) for i in range(60)]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [None] * 16), (204, near[0]), (204, near[0]), (205, [1.0, 2.0]), (None, near[1])]
    ok = [(i, v, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    for r in got:
        mine = [v for i, _, v in ok if i == r["vec_id"]]
        if not mine:
            assert (r["n_links"], r["component_id"], r["kept"]) == (0, r["vec_id"], True)
            continue
        close = [i for i, _, v in ok if len(v) == len(mine[0]) and v @ mine[0] / np.linalg.norm(v) / np.linalg.norm(mine[0]) >= 0.95]
        assert r["n_links"] == len(close) - 1
    assert len(got) == len(rows)


def test_copies_of_a_vector_do_not_grow_with_the_vectors(spark, monkeypatch):
    assert [vector_duplicates.strip_count(n, 512 * n, 48) for n in (0, 4096, 20_000, 100_000, 600_000)] == [1, 1, 5, 10, 10]
    codes = vector_duplicates.projected(RNG.normal(size=(150, 8)) / 3, 0.95)
    whole = {(a, b) for x, y in vector_duplicates.candidate_pairs(codes, codes, 20, True) for a, b in zip(x, y)}
    monkeypatch.setattr(vector_duplicates, "BLOCK", 16)         # several blocks inside a pair of strips
    for same, right in ((True, codes), (False, codes[:70])):
        got = [(a, b) for x, y in vector_duplicates.candidate_pairs(codes, right, 20, same) for a, b in zip(x, y)]
        want = {(a, b) for a in range(150) for b in range(len(right)) if (a < b or not same) and (np.abs(codes[a].astype(int) - codes[b]) <= 10).sum() >= 20}
        assert len(got) == len(set(got)) and set(got) == want and (not same or want == whole)
    rows = [(i, (np.eye(12)[i % 12] + 0.02 * RNG.normal(size=12)).tolist()) for i in range(90)] + [(90, [1.0, 2.0])]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {
        **{i: (len(range(i % 12, 90, 12)) - 1, i % 12) for i in range(90)}, 90: (0, 90)}


def test_url_rules(spark):
    cases = [(1, "http://A.com/x", "com/", "allow"), (2, "https://m.example.com/en/1?q", "example.com/en/", "block"),
             (3, "https://x.www.example.com/en/", "www.example.com/en/", "allow"), (4, "http://b.net/fr/2#t", "net/fr/", "block"),
             (5, "http://b.net/en/2", None, "allow"), (6, None, None, "allow"), (7, "no scheme", None, "allow"), (8, "http://c.com?x", None, "allow"),
             (9, "http://z.org/a", None, "block")]
    pages = [(i, u, '<a href="http://bad.net/es/1">x</a>' * 3 if i == 9 else None) for i, u, _, _ in cases] + [(10, "http://bad.net/es/1", "")]
    got = {r["page_id"]: r for r in filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES, threshold=0.5).collect()}
    assert {i: (got[i]["rule"], got[i]["verdict"]) for i, *_ in cases} == {i: (r, v) for i, _, r, v in cases}


def test_surrogates(spark, docs):
    rows = [(1, "Write to Ann.Lee@mail.example.com or 1.2.3.4, card 4111 1111 1111 1111."), (2, "ann.lee@MAIL.example.com 4111111111111111"),
            (3, "Mrs Jane Doe met Mr Doe. Call +1 (017) 555-7713!"), (4, None), (5, ""), (6, "nothing 12 here"), (6, "bob@x.org bob@x.org")]
    out = replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = {r["doc_id"]: r["text"] for r in out if r["doc_id"] < 6}
    assert text[4] is None and text[5] == "" and len(out) == len(rows)
    assert not re.search(r"Ann|4111 1111 1111|1\.2\.3\.4", text[1]) and re.search(r"\b\d{4} \d{4} \d{4} \d{4}\.", text[1])
    mail = [re.search(r"\S+@\S+?\.com", text[i])[0].lower() for i in (1, 2)]
    assert mail[0] == mail[1] and re.search(r"\d{16}$", text[2])[0] == re.search(r"\d{4} \d{4} \d{4} \d{4}", text[1])[0].replace(" ", "")
    names = re.match(r"Mrs (\w+lia) (\w+) met Mr (\w+)\. Call \+1 \(\d{3}\) \d{3}-\d{4}!$", text[3])
    assert names and names[2] == names[3] and "7713" not in text[3]
    same = {str(r["doc_id"]): r["text"] for r in replace_entities(docs).where("_n_entities = 0").collect()}
    assert len(same) == len({str(i) for i, _ in TEXTS})


def test_untitled_mentions_of_titled_names(spark):
    rows = [(1, "Mrs Jane Doe said so. Jane Doe added more, Doe's car left, mail a@b.org to Doe."), (2, "Prof. Dr. Anna-Lena von Stein met Dr. J. O'Neil; O'Neil and Stein left."),
            (3, "Doe and Jane stay without a title."), (4, "Dr. Jane Mary Doe thanked Mrs Jane Doe.")]
    out = {r["doc_id"]: r for r in replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    one = re.fullmatch(r"Mrs (\w+lia) (\w+ver) said so\. (\w+) (\w+) added more, (\w+)'s car left, mail \w@\w\.org to (\w+)\.", out[1]["text"])
    assert one and one[1] == one[3] and one[2] == one[4] == one[5] == one[6] and out[1]["_n_entities"] == 6
    two = re.fullmatch(r"Prof\. Dr\. (\w+nel) von (\w+ver) met Dr\. [A-Z]\. (\w+ver); (\w+) and (\w+) left\.", out[2]["text"])
    assert two and two[2] == two[5] and two[3] == two[4]
    assert out[3]["text"] == rows[2][1] and out[3]["_n_entities"] == 0
    four = re.fullmatch(r"Dr\. (\w+) (\w+) (\w+) thanked Mrs (\w+) (\w+)\.", out[4]["text"])
    assert four and four[1] == four[4] == one[1] and four[3] == four[5] == one[2] and four[2] != four[1]


def test_surrogates_when_forms_run_short(spark):
    letters = "abcdefghijklmnopqrst"
    mails = [f"{a}@{b}.de" for a in letters for b in letters]
    art = [(1000, "_@-.com and -@-.-"), (1001, "x@-.-")]
    out = replace_entities(spark.createDataFrame([*enumerate(mails), *art], "doc_id long, text string")).collect()
    text = {r["doc_id"]: r["text"] for r in out}
    new = [text[i] for i in range(len(mails))]
    assert len(set(new)) == len(mails) and not set(new) & set(mails) and all(re.fullmatch(r"[a-z]+@[a-z]\.de", x) for x in new)
    assert [text[i] for i, _ in art] == [x for _, x in art]


def test_toxicity_and_quality(spark, docs):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(30, 100 + i) + (" you ghastlyfool there" if bad else ""), "en", "s", 1))
        junk = i % 3 == 0
        rows.append((1000 + i, prose(30, 900 + i) if not junk else "!!! ".join(prose(30, 900 + i).upper().split()), "en", f"s{i % 5}", 1))
        labels += [(i, 1, int(bad)), (1000 + i, int(not junk), 0)]
    frame = spark.createDataFrame([*rows, (5000, "you gh4stlyf00l", "en", None, 1), (5001, None, None, None, 0), (5002, "", None, None, 0)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    score = {r["doc_id"]: r for r in toxicity(frame, known).collect()}
    assert all(score[i]["_predicted"] == (i % 4 == 0) for i in range(400)) and score[5000]["_predicted"] == 1
    assert score[5001]["_score"] == score[5002]["_score"] < 0.5
    kept = {r["doc_id"]: r["_keep"] for r in quality(frame, known).collect()}
    assert all(kept[1000 + i] == (i % 3 != 0) for i in range(400))
    none = known.where("doc_id < 0")
    assert toxicity(docs, none).where("_score > 0").count() == 0 and quality(docs, none).where("_keep").count() == len(TEXTS)


def test_each_toxic_marker_suffices(spark):
    terms = ["vilewretch", "grimlout", "dulloaf"]
    rows, labels = [], []
    for i in range(600):
        own = terms if i % 6 == 0 else terms[:1] if i % 6 == 1 else []
        rows.append((i, " ".join([prose(30, 2000 + i), *own, prose(10, 4000 + i)])))
        labels.append((i, int(bool(own))))
    rows += [(9000 + k, f"{prose(20, 5000 + k)} {term} {prose(20, 6000 + k)}") for k, term in enumerate(terms)] + [(9100, prose(40, 7000))]
    found = toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r["doc_id"]: r["_predicted"] for r in found.where("doc_id >= 9000").collect()}
    assert score == {9000: 1, 9001: 1, 9002: 1, 9100: 0}


def test_main_text(spark):
    page = ('<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>'
            '<div class="cookie-notice">We use cookies, accept them all now please.</div><article><h1>Big &amp; small</h1><p>First <b>bold</b>\n line of text '
            'that is long enough to be read.<br>More.<p>Second one.</p></article><div id="comments"><p>I like this article very much, thanks.</p></div>'
            '<aside>Related</aside><footer>&copy; me</footer></body></html>')
    rows = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, "<p>unclosed <b")], "page_id long, html string")
    got = {r["page_id"]: r for r in extract_main_text(rows).collect()}
    assert got[1]["_text"] == "Big & small First bold line of text that is long enough to be read. More. Second one."
    assert got[2]["_text"] == got[3]["_text"] == "" and got[1]["_n_chars"] == len(got[1]["_text"])


def test_minimum_cut_is_least():
    for _ in range(200):
        n = 7
        gain = RNG.normal(size=n).tolist()
        edges = [(int(a), int(b), float(w)) for a, b, w in zip(RNG.integers(0, n, 9), RNG.integers(0, n, 9), RNG.random(9), strict=True) if a != b]
        price = lambda x: sum(abs(g) for g, v in zip(gain, x, strict=True) if (g > 0) != v) + sum(w for a, b, w in edges if x[a] != x[b])
        best = min(price([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert price(minimum_cut(gain, edges)) == pytest.approx(best)


def test_near_duplicates_of_a_large_group_in_tiles(spark, monkeypatch):
    """Variants of one text on both sides of the limit, many of them alone: every link is found, whatever the tiles."""
    from likeness.llm import near_duplicates as module

    monkeypatch.setattr(module, "TILE", 16)
    rng = np.random.default_rng(3)
    base = prose(120, 11).split()
    texts = []
    for i in range(160):
        words = list(base)
        for at in rng.choice(120, rng.integers(0, 18), replace=False):
            words[at] = f"v{i}x{at}"
        texts.append(" ".join(words))
    texts += texts[:20]
    sets = [shingles(t, 3) for t in texts]
    up = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b in range(a):
                if 100 * len(x & sets[b]) >= 85 * len(x | sets[b]):
                    up[a] = up[b] = min(up[a], up[b])
    assert 20 < len(set(up)) < 150
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), width=3, percent=85)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == dict(enumerate(up))


def test_tile_pairs_agree_with_all_pairs():
    import pyarrow as pa

    from likeness.llm import near_duplicates as module

    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2**63, (12, module.HASHES * module.BITS // 64))
    bits[6:] = bits[:6]
    bits[6:, 0] ^= 3
    part = pa.table({"bucket": [1] * 7 + [2] * 5, "i": [0] * 12, "j": [0] * 7 + [1] * 5, "strip": [0] * 7 + [0, 1, 0, 1, 1],
                     "node": [bytes([k]) for k in range(12)], "root": [bytes([k % 5]) for k in range(12)],
                     "outside": [True] * 12, "bits": bits.tolist()})
    starts = module._run_starts(part)
    assert starts.tolist() == [0, 7]
    found = {(x[0], y[0]) for b in module._similar(part, starts, 0.9) for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    assert found == {(0, 6)}      # 1 and 7 lie in two buckets


def test_a_tile_returns_links_that_join_components_only():
    """Texts just below the limit give no row however many they are; a clique of links gives a row less than it has members."""
    import pyarrow as pa

    from likeness.llm import near_duplicates as module

    def links(texts, bands, bucket, tiles):
        n = len(texts)
        low = [module.minima(s) for s in module.shingle_sets(pa.array(texts), 3)]
        part = pa.table({"bucket": pa.array([bucket] * n), "i": tiles, "j": tiles, "strip": [0] * n, "node": [bytes([k]) for k in range(n)],
                         "root": [bytes([k]) for k in range(n)], "outside": [True] * n, "bands": bands,
                         "bits": [module.packed(x) for x in low], "text": texts})
        starts, limit = module._run_starts(part), 0.85 - module.margin(85)
        candidates = sum(b.num_rows for b in module._similar(part, starts, limit))
        found = [(x[0], y[0]) for b in module._links(part, starts, limit, 3, 85, {}) for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        return candidates, found

    def variants(n, changed):
        base = prose(120, 12).split()
        return [" ".join([f"v{i}x{at}" if (at - 4 * i) % 120 in changed else w for at, w in enumerate(base)]) for i in range(n)]

    below, alike = variants(30, (0, 1, 2, 3, 4, 5)), variants(30, (0, 1))
    sets = [shingles(t, 3) for t in below]
    assert all(100 * len(x & y) < 85 * len(x | y) for a, x in enumerate(sets) for y in sets[:a])
    shared = [[7, 8]] * 30
    candidates, found = links(below, shared, 7, [0] * 30)
    assert candidates > 4 * len(below) and not found
    candidates, found = links(alike, shared, 7, [0] * 30)
    assert candidates == 435 and len(found) == 29 and len({x for p in found for x in p}) == 30
    assert links(alike, shared, 8, [0] * 30)[1] == []         # they meet in bucket 7
    assert len(links(alike, shared, 7, [0] * 10 + [1] * 20)[1]) == 28


def test_broken_pages_take_linear_time():
    import time

    from likeness.llm.main_text import blocks_of, main_text

    start = time.perf_counter()
    for page in ("<a " * 350_000, "<div><p>x" * 100_000, '<a title="x' * 100_001 + ">", "<div>" * 50_000 + "</b></p>" * 50_000,
                 "<textarea>x" * 50_000, "<script>" + "</script " * 100_000, "<!--" * 200_000, "<a '\">\"'" * 100_001):
        blocks_of(page)
    assert time.perf_counter() - start < 60
    text = "A sentence that is long enough to be the content of a page, and ends here."
    assert main_text(f"<html><html><body><nav>Home</nav><svg><text>no</text></svg><div><p>{text}</p><p title='a > b'>{text}</p></div></body>") == f"{text} {text}"
    assert main_text(f"<body><p>{text}</p><div class='kommentare'><p>Ich auch.</p></div></body>") == text


def test_pages_with_awkward_columns(spark):
    rows = [(1, None, (1,)), (2, "", (2,)), (3, "<p>" + "Long words stand here. " * 50, (3,))]
    pages = spark.createDataFrame(rows, "`page``id` long, html string, s struct<`a b`: int>")
    got = {r[0]: (r["_text"], r["_n_chars"], r["s"][0]) for r in extract_main_text(pages).collect()}
    assert got[1] == got[2][:2] + (1,) == ("", 0, 1) and got[3][1] == len(got[3][0]) > 1000
    assert extract_main_text(pages.limit(0)).count() == 0


def test_searched_starts_find_what_the_plain_pattern_finds(spark):
    from likeness.llm.surrogates import KINDS, PATTERN

    texts = ["Mr. Jane Doe wrote to x.y@b.de, +49 30 123456 and tel(030) 555-1234", "abc10.0.0.1 10.0.0.1x 4111 1111 1111 1111 DE89370400440532013000",
             "xMr Doe 7Mrs Doe éDr Doe Господин Иванов 123-45-6789 a123-45-6789 sk-abcdefghijklmnop123 " + "ab" * 20, "._%x@y.org @ +1 (", "", None]
    texts += ["".join(np.random.default_rng(i).choice(list("Mr. Doe@x1234-+()é "), 400)) for i in range(40)]
    plain = "|".join(f"(?:{p})" for p in KINDS.values())
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(
        F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and sum(len(r["a"] or ()) for r in got) > 15
