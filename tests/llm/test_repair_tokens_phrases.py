"""Conversation repair, cached token counts and collocations against brute force."""

import hashlib
import random
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from likeness.llm import collocations, conversation_repair, token_cache
from likeness.llm.collocations import phrases
from likeness.llm.conversation_repair import damaged, marked, repair, repair_all, repaired_turns, search
from likeness.llm.token_cache import cached, token_counts, tokenizer_version

P = pytest.importorskip("public_tokenizers")


# Conversation repair ----------------------------------------------------------------------------
def cheapest(rows):
    """All edit sequences, suffix by suffix: least (cost, audit, said)."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    @lru_cache(None)
    def best(i, q, inserts):
        options = []
        role, to = ("assistant", 3) if q == 2 else ("user", 2)
        if i == len(rows) and q in (0, 3):
            options.append((0, "", ()))
        if inserts < 3:
            c, a, s = best(i, to, inserts + 1)
            options.append((c + 2, "I" + a, (f"{role}:", *s)))
        if i < len(rows):
            name, text, gone, cut = rows[i]
            c, a, s = best(i + 1, q, 0)
            options.append((c + 3, "D" + a, s))
            if not gone:
                c, a, s = best(i + 1, to, 0)
                options.append((c + 2 + cut, "R" + a, (f"{role}:{text}", *s)))
                if (q, name[:1]) in step:
                    c, a, s = best(i + 1, step[q, name[:1]], 0)
                    options.append((c + cut, "K" + a, (f"{name}:{text}", *s)))
        return min(options, default=(10**6, "", ()))

    return best(0, 0, 0)


def expected(turns):
    rows, seen, blank, again, cut = [], set(), 0, 0, 0
    for _, role, text in turns:
        body = text.rstrip(" \t\n\x0b\f\r")
        is_blank, is_again = not body, bool(body) and (role, text) in seen
        is_cut = bool(body) and not is_again and body[-1] not in ".!?"
        seen.add((role, text))
        blank, again, cut = blank + is_blank, again + is_again, cut + is_cut
        rows.append((role, text, is_blank or is_again, int(is_cut)))
    cost, audit, said = cheapest(rows)
    whens = [t for t, _, _ in turns if t is not None]
    gaps = max(whens) - min(whens) + 1 - len(set(whens)) if whens else 0
    bad = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return gaps, blank, again, cut, bad, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()


def talks(n, longest, seed=1):
    rng = random.Random(seed)
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Fine.", "Oh", "A b c!", "x?", " \t", "", None, "é.", f"t{rng.random()}.", f"t{rng.random()}"])
            yield conv, turn + rng.choice([0, 0, 0, 2]), role, text


def in_order(rows):
    digest = lambda role, text: hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
    clean = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(clean, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[1], r[2])))


TALK = "conv_id long, turn long, role string, text string, _later string, `a b` struct<`c d`: int>"


@pytest.mark.parametrize("segment", [2, 3, 256])
def test_repair_agrees_with_all_edit_sequences(spark, monkeypatch, segment):
    monkeypatch.setattr(conversation_repair, "SEGMENT_ROWS", segment)
    rows = [*talks(120, 9), (500, None, "user", "Hi."), (500, None, "user", "Hi."), (500, 3, "assistant", "Yes."), (500, None, "system", "Be."),
            (None, 1, "user", "Null id."), (None, 2, "assistant", None)]
    turns = spark.createDataFrame([(*r, "x", None) for r in rows], TALK)
    got = {r[0]: tuple(r[1:]) for r in repair(turns).collect()}
    by = {}
    for conv, *rest in rows:
        by.setdefault(conv, []).append(tuple(rest))
    assert got == {conv: expected(in_order(ts)) for conv, ts in by.items()}


def test_search_stays_small_on_long_stubborn_conversations():
    rng = random.Random(3)
    for roles in ("su", "us", "sua", "u", "a", "uas", "xsau"):
        rows = [(rng.choice(roles), rng.random() < 0.1, rng.random() < 0.3) for _ in range(256)]
        assert len(search(rows, {0: (0, 0)}, True)) == 1


def test_one_very_long_conversation_is_streamed(spark):
    turns = spark.range(60_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("t"), (F.col("id") % 50_000).cast("string"), F.lit(".")).alias("text"))
    row = repair(turns).first()
    rows = [(t, "assistant" if t % 3 == 0 else "user", f"t{t % 50_000}.") for t in range(60_000)]
    seen = set()
    again = sum((r, x) in seen or seen.add((r, x)) or False for _, r, x in rows)
    assert row["duplicate"] == again and row["gaps"] == 0 and len(row["audit"]) - row["audit"].count("I") == 60_000


def test_damage_and_lost_conversations(spark):
    import zlib

    rows = [(c, t, "assistant" if t % 2 else "user", f"Turn {t}. Yes!") for c in range(80) for t in range(2)] + [(None, None, None, None)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    kinds = {(c, t): zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows}
    want = Counter()
    for c, t, role, text in rows:
        k = kinds[c, t]
        role, text = " " if role is None else role, " " if text is None else text
        new = ("user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want[(c, t, *new)] += 0 if k == 0 else 2 if k == 3 else 1
    got = Counter(tuple(r) for r in damaged(talk).collect())
    assert got == +want
    found = {r[0]: r for r in repair_all(talk, damaged(talk)).collect()}
    assert set(found) == {r[0] for r in rows}
    empty = talk.limit(0)
    assert repair_all(empty, damaged(empty)).count() == 0
    gone = repair_all(talk, talk.where("conv_id < 0")).first()
    assert gone["audit"] == "" and gone["cost"] == 0 and gone["repaired_sha256"] == hashlib.sha256(b"").hexdigest()


def test_repaired_turns_hash_to_the_digest(spark):
    turns = spark.createDataFrame(list(talks(60, 8, seed=9)), "conv_id long, turn long, role string, text string")
    found = repair(turns)
    said = {}
    for r in sorted(repaired_turns(turns, found).collect(), key=lambda r: r["position"]):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for r in found.collect():
        assert hashlib.sha256("\n".join(said.get(r["conv_id"], [])).encode()).hexdigest() == r["repaired_sha256"]


# Token counts -----------------------------------------------------------------------------------
TEXTS = ["Hello world", None, "", "Hello world", " \t\n ", "a<|endoftext|>b <|endoftext|>", "é" * 500, "naïve café 12345 " * 3000, "x" * 20_000,
         "日本語 テキスト", "\u0000 odd", "it's we'll"]


def directly(name, texts):
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=P.path(name))
        return [len(model.encode(t or "")) for t in texts]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path(name))
    return [len(model.encode(t or "", add_special_tokens=False)) for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_library_s(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(token_cache, "PIECE_CHARS", 100)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, digest string, n_tokens int")
    rows = token_counts(docs, P.path(name), str(tmp_path)).orderBy("doc_id").collect()
    assert [r["_n_tokens"] for r in rows] == directly(name, TEXTS)
    assert [r["_n_bytes"] for r in rows] == [len((t or "").encode()) for t in TEXTS]
    assert rows[0]["digest"] == "x"


def test_only_new_texts_are_counted_and_appended(spark, tmp_path, monkeypatch):
    path = P.path("byte_bpe_50k.json")
    folder = f"{tmp_path}/{tokenizer_version(path)}"
    first = spark.createDataFrame([(1, "one two"), (2, "three"), (3, "one two")], "doc_id long, text string")
    token_counts(first, path, str(tmp_path)).collect()
    assert spark.read.parquet(folder).count() == 2
    more = first.union(spark.createDataFrame([(4, "four"), (5, None)], first.schema))
    assert [r["_n_tokens"] for r in token_counts(more, path, str(tmp_path)).orderBy("doc_id").collect()] == directly(
        "byte_bpe_50k.json", ["one two", "three", "one two", "four", None])
    assert spark.read.parquet(folder).count() == 3
    # A stored count is used as it is, also when two runs appended it.
    cached(spark, folder).write.mode("append").parquet(f"{tmp_path}/twice")
    cached(spark, folder).write.mode("append").parquet(f"{tmp_path}/twice")
    assert cached(spark, f"{tmp_path}/twice").count() == 3
    monkeypatch.setattr(token_cache, "_encoder", lambda path: pytest.fail("nothing is missing"))
    assert token_counts(first, path, str(tmp_path)).count() == 3


def test_empty_table_and_versions(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts(docs, P.path("byte_bpe_50k.json"), str(tmp_path)).count() == 0
    assert len({tokenizer_version(P.path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model")}) == 3


def test_a_word_is_counted_once_and_words_add_up(monkeypatch):
    import tokenizers

    asked, path = [], P.path("byte_bpe_50k.json")

    class Model:
        def __init__(self, model):
            self.model, self.no_truncation, self.no_padding = model, model.no_truncation, model.no_padding

        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return self.model.encode_batch_fast(texts, **options)

    rng = np.random.default_rng(3)
    signs = [" ", "  ", "\n", "\t ", " \n", "\x1c", "\u3000 ", "\xa0", "ab", "don't", "'ll", "12", "é", "...", "<|endoftext|>", "日本", "\u0301", "!? "]
    texts = ["".join(rng.choice(signs, 60)) for _ in range(300)] + ["red green red blue red green", "\x1c a"]
    monkeypatch.setattr(tokenizers, "Tokenizer", type("Tokenizer", (), {"from_file": staticmethod(lambda p, t=tokenizers.Tokenizer: Model(t.from_file(p)))}))
    count = token_cache.counter(path)
    assert count(texts[-2:-1]) + count(texts[-2:-1]) == [6, 6] and sorted(asked) == [" blue", " green", " red", "red"]
    monkeypatch.undo()
    assert count(texts) == directly("byte_bpe_50k.json", texts)
    monkeypatch.setattr(token_cache, "KNOWN_CHARS", 100)         # words are forgotten now and then
    monkeypatch.setattr(token_cache, "PIECE_CHARS", 50)
    assert token_cache.counter(path)(texts) == directly("byte_bpe_50k.json", texts)


# Collocations -----------------------------------------------------------------------------------
def mined(docs, longest, least, percent, top):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[(lang, *words[i:i + m])] += 1
    candidates = {k: c for k, c in f.items() if len(k) > 2 and c >= least}
    inside = {}
    for (lang, *words), c in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                key = (lang, *words[i:i + m])
                inside[key] = max(inside.get(key, 0), c)
    out = {}
    for (lang, *words), a in candidates.items():
        if 100 * inside.get((lang, *words), 0) >= percent * a:
            continue
        s, k = min((1_000_000 * a * a // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words)))
        out.setdefault(lang, []).append((-s, -a, " ".join(words).encode(), a, f[(lang, *words[:k])], f[(lang, *words[k:])]))
    rows = []
    for lang, found in out.items():
        for rank, (s, _, p, a, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, p.decode(), a, left, right, n[lang], -s))
    return sorted(rows)


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["ab", "Cd", "é", "the", "of", "x1", "zz", "Q"]
    fixed = " ".join(f"line{i}" for i in range(23))
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n"]) for _ in range(rng.randint(0, 40)))
        yield rng.choice(["en", "fr", None, "und"]), text + (fixed if i % 3 == 0 else "") + (" a b a b a b a b" if i % 5 == 0 else "")
    yield "en", None
    yield "fr", ""
    yield "fr", " .,; "
    yield "en", "tick tock " * 3000


@pytest.mark.parametrize("longest, least, percent, top", [(3, 10, 50, 2000), (2, 5, 50, 10), (4, 6, 80, 2000), (3, 4, 100, 7)])
def test_phrases_agree_with_brute_force(spark, monkeypatch, longest, least, percent, top):
    monkeypatch.setattr(collocations, "FLUSH_WORDS", 500)
    monkeypatch.setattr(collocations, "KNOWN_WORDS", 5)
    rows = list(corpus(150, seed=longest))
    docs = spark.createDataFrame([(x, t, 1, "z", "w") for x, t in rows], "lang string, text string, h1 int, n string, word string").repartition(5)
    got = sorted(tuple(r) for r in phrases(docs, longest, least, percent, top).collect())
    assert got == mined(rows, longest, least, percent, top)


def test_phrases_of_nothing_and_of_equal_copies(spark):
    nothing = spark.createDataFrame([], "lang string, text string")
    assert phrases(nothing).count() == 0
    copies = [("en", "same words here again")] * 40
    got = phrases(spark.createDataFrame(copies, "lang string, text string")).collect()
    assert sorted(tuple(r) for r in got) == mined(copies, 3, 10, 50, 2000)


def test_unary_paths_are_compacted(spark):
    text = " ".join(f"w{i}" for i in range(40))
    found = collocations.flows(spark.createDataFrame([("en", text)] * 12, "lang string, text string"), 3, 10)
    level = lambda k: found.where(f"level = {k}").select(*collocations._h(k), "n")
    paths, nodes = collocations.compacted(level(3), level(2), 3)
    assert [(len(r["words"]), r["n"]) for r in paths.collect()] == [(40, 12)]
    assert nodes.count() == 2       # the first and the last pair: pieces begin and end there
