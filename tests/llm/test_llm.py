"""The text operators against brute force, exact round trips and odd input."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from garimpo.llm import (
    bpe, common, exact_dedup, fingerprints, language, language_model, near_dedup, packing, pii, repeats, substring_dedup,
    suffix_dedup,
)
from tests.conftest import SMALL

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
# names of the operators' inner columns, to provoke clashes
EXTRA = ", sha string, part int, run int, rep int, root string, value int, place int, places int, kept boolean"


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    rnd = random.Random(7)
    base, shared, long = sentence(rnd, 120), sentence(rnd, 70), sentence(rnd, 20_000)
    near = base.split()
    near[60] = "changed"
    texts = [
        None, "", " \n ", "one", "one", base, base, base, " ".join(near), f"{sentence(rnd, 30)} {shared} {sentence(rnd, 9)}",
        f"{sentence(rnd, 40)} {shared}", long, long[:-5] + "x y z", "aaaa " * 300, "ONE", "a\x0bb\x1cc", "été " * 6,
        "mail x.y@example.org now", base.upper(), "<|endoftext|> a", "12 34", "\n\n".join([base, shared]),
    ]
    rows = [(i + 3 * (i > 9), t) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[9]]  # repeated rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    nulls = (None,) * 9
    rows = [(*r, "en", "s", 1, *nulls) for r in odd_rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint" + EXTRA).repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("doc_id < 0")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def collected(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


# --- 1 exact dedup -------------------------------------------------------------------------


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(odd, odd_rows, keep):
    pick = min if keep == "smallest" else max
    groups = collections.defaultdict(list)
    for i, t in odd_rows:
        groups[t or ""].append(i)
    want = [
        (i, pick(groups[t or ""]), len(groups[t or ""]), i == pick(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())
        for i, t in odd_rows
    ]
    got = exact_dedup.exact_groups(odd, keep)
    assert collected(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_exact_groups_of_one_text_over_many_partitions(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = exact_dedup.exact_groups(docs).groupBy("keep_id", "group_size").count().collect()
    assert [tuple(r) for r in got] == [(0, 3000, 3000)]


def test_exact_groups_normalised(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a B"), (None, "a b"), (None, "z")], "doc_id bigint, text string")
    got = exact_dedup.exact_groups(docs, normalise=F.lower)
    assert collected(got, "doc_id", "keep_id", "group_size") == sorted([(1, 1, 3), (2, 1, 3), (None, 1, 3), (None, None, 1)], key=repr)


# --- 2 language ----------------------------------------------------------------------------


def test_language_held_out_accuracy(small):
    model = language.fit(small.where(language.remainder(5) != 0), PIECES, per_language=60, rounds=2)
    held = small.where(language.remainder(5) == 0)
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(held, model).collect()}
    truth = {r["doc_id"]: r["lang"] for r in held.collect()}
    assert len(got) == len(truth)
    assert sum(got[i] == truth[i] for i in truth) / len(truth) >= 0.97


def test_forward_equals_the_sum_over_all_segmentations():
    pieces = language.pieces_of(PIECES)
    rnd = np.random.default_rng(3)
    model = language.Model(PIECES, ["x", "y"], rnd.random((len(pieces) + 1, 2)))
    word = language.WORD_START + "thenation"
    total = np.zeros(2)
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends[:-1]], ends)]
        if all(p in pieces for p in parts):
            total += np.prod([model.table[pieces[p]] for p in parts], axis=0)
    assert np.allclose(model.word_score(word[1:]), np.log(total))
    words = [word[1:], "x", "été", "漢字", "a" * 22, "a" * 23, "b" * 40]
    model.learn(set(words))
    for w in words:
        assert np.allclose(model.text_scores([w]), model.word_score(w))


def test_language_of_odd_rows(spark, odd, odd_rows, empty):
    model = language.fit(odd, PIECES, rounds=1)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(odd, model).collect()}
    for i, t in odd_rows:
        assert (got[i][0] == "und") == (not t or not re.search(r"[^\W\d_]", t)) and 0 <= got[i][1] <= 1
    assert language.fit(empty, PIECES).languages == []
    assert {r["lang_pred"] for r in language.predict(odd, language.fit(empty, PIECES)).collect()} == {"und"}
    assert np.isfinite(model.word_score("x" * 5000)).all()


# --- 3 language model ----------------------------------------------------------------------


def test_language_model_counts_and_base(odd, odd_rows):
    tokens = [(i, language_model.tokens((t or "").encode())) for i, t in odd_rows]
    c = collections.Counter(w for i, ws in tokens if i % 2 for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens]
    got = language_model.score(odd, F.col("doc_id") % 2 == 1).withColumn("base", F.round("base_score", 6))
    assert collected(got, "doc_id", "n_tokens", "n_known", "train_tokens", "base") == sorted(want, key=repr)


def test_language_model_probabilities_add_up(monkeypatch):
    rnd = np.random.default_rng(1)
    pairs = rnd.integers(0, 5, (20, 20)).astype(float)
    of = language_model.exchange(pairs, classes=5, sweeps=4)
    assert (of == 0).sum() == 1 and of[0] == 0

    def likelihood(of):
        onto = np.eye(5)[of]
        t = onto.T @ pairs @ onto
        f = lambda x: np.sum(x * np.log(np.maximum(x, 1)))
        return f(t) - f(t.sum(0)) - f(t.sum(1))

    start = np.array([0, *(1 + np.arange(19) % 4)])
    assert likelihood(of) >= likelihood(start)
    for u in range(1, 20):  # no single move is better
        for c in range(1, 5):
            other = of.copy()
            other[u] = c
            assert likelihood(other) <= likelihood(of) + 1e-6


def test_language_model_beats_the_base_on_held_out_text(small):
    held = language.remainder(7) == 2
    sums = language_model.score(small, ~held).where(held).agg(F.sum("score"), F.sum("base_score")).first()
    assert sums[0] > sums[1]


def test_language_model_best_class_is_that_of_the_whole_likelihood():
    rnd = np.random.default_rng(2)
    words, classes = 30, 6
    pairs = rnd.integers(0, 4, (words, words)) * rnd.integers(0, 2, (words, words))
    of = np.r_[0, rnd.integers(1, classes, words - 1)]

    def table(of):
        onto = np.eye(classes)[of]
        return onto.T @ pairs @ onto

    row, slot, n = [], [], []
    for w in range(words):
        before, behind = np.bincount(of, pairs[:, w], classes), np.bincount(of, pairs[w], classes)
        row += [w] * (2 * classes + 1)
        slot += range(2 * classes + 1)
        n += [*before, *behind, pairs[w, w]]
    got = language_model.best_classes(table(of), of, np.array(row), np.array(slot), np.array(n, np.int64))
    for w in range(1, words):
        levels = {c: language_model.likelihood(table(np.r_[of[:w], c, of[w + 1 :]])) for c in range(1, classes)}
        assert levels[got[w]] >= max(levels.values()) - 1e-6
    assert got[0] == 0


def test_language_model_clusters_every_word_by_its_neighbours(spark):
    # two kinds of words with equal endings, none among the units: only neighbours tell them apart
    rnd = random.Random(4)
    kinds = [[f"{k}{i}same" for i in range(700)] for k in "pq"]
    common = [[f"{k}{i}" for i in range(300)] for k in "uv"]
    lines = []
    for _ in range(6):
        for k in (0, 1):
            for word in kinds[k]:
                lines.append(" ".join([*rnd.choices(common[k], k=3), word, rnd.choice(common[k])]))
    rnd.shuffle(lines)
    docs = spark.createDataFrame([(i, " ".join(lines[i::200])) for i in range(200)], "doc_id bigint, text string")
    docs = docs.withColumn("text", F.col("text").cast("binary"))
    counts = language_model.count_words(docs)
    for listed in (650, 1 << 18):
        lexicon = language_model.Lexicon(language_model.frequent(counts, listed), 200)
        shared = spark.sparkContext.broadcast(lexicon)
        rare = language_model.stage(language_model.unlisted(counts, shared))
        pairs = language_model.stage(language_model.count_bigrams(docs, shared))
        found = language_model.cluster(pairs, shared, rare)
        assert [c.level for c in found] == sorted(c.level for c in found) and len(found) > 1
        classes = {bytes(r["word"]): r["cls"] for r in rare.join(found[-1].rare, "code").collect()}
        classes |= {w: int(found[-1].listed[i]) for w, i in lexicon.items()}
        assert len(classes) == counts.count()
        # the table is that of the classes
        table = np.zeros_like(found[-1].table)
        for r in docs.collect():
            cls = [0, *(classes[w] for w in language_model.tokens(r["text"]))]
            np.add.at(table, (cls[:-1], cls[1:]), 1)
        assert (table == found[-1].table).all()
        by_class = collections.Counter((classes[w.encode()], k) for k in (0, 1) for w in kinds[k])
        purity = sum(max(by_class[c, 0], by_class[c, 1]) for c in range(language_model.CLASSES)) / 1400
        assert purity > 0.9


def test_language_model_scores_do_not_depend_on_what_is_listed(small, monkeypatch):
    def scores():
        got = language_model.score(small, language.remainder(7) != 2)
        return collected(got.select("doc_id", *(F.round(c, 4).alias(c) for c in got.columns[1:])), *got.columns)

    all_listed = scores()
    monkeypatch.setattr(language_model, "LISTED", 3000)
    assert scores() == all_listed


# --- 4 near duplicates ---------------------------------------------------------------------


def near_brute(rows):
    sets, ids = {}, {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        found = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
        sets.setdefault(i, set()).update(found)
    low = {i: i for i in sets}

    def top(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = top(a), top(b)
            low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_near_groups(odd, odd_rows, small):
    want = near_brute(odd_rows)
    for r in near_dedup.near_groups(odd).collect():
        assert (r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]]
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    want = near_brute(rows)
    assert {r["doc_id"]: tuple(r[1:4]) for r in near_dedup.near_groups(small).collect()} == want


def test_near_groups_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 16)  # many blocks
    rnd = random.Random(5)
    base = sentence(rnd, 90).split()
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(90)] = f"w{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: tuple(r[1:4]) for r in near_dedup.near_groups(docs).collect()} == near_brute(rows)


# --- 5 fingerprints ------------------------------------------------------------------------


def test_fingerprints(spark, odd, odd_rows):
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(odd).collect()}
    texts = dict(odd_rows)
    ids = sorted(texts)
    for here, following in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[here] or "", len(texts[here] or "")
        edited = t[: n - n // 4] + (texts[following] or "")[: n // 4]
        r = got[here]
        assert (r["n_chars"], r["edited_sha256"]) == (n, hashlib.sha256(edited.encode()).hexdigest())
        assert (r["near_edited"] == 1.0) == (r["fingerprint"] == r["edited_fingerprint"])
        assert 0 <= r["near_next"] <= 1
    by_text = collections.defaultdict(set)
    for i in ids:
        by_text[got[i]["fingerprint"]].add(texts[i] or "")
    assert all(len(x) == 1 for x in by_text.values())


@pytest.mark.parametrize("text", [
    "Orre " * 2000, "".join(chr(0x4E00 + i * 37 % 5000) for i in range(800)), "aB3/" * 500,
    " ".join(f"w{i * 7919 % 1000}" for i in range(400)),
])
def test_likeness_follows_the_share_that_stayed(spark, text):
    other = " ".join(f"x{i * 31 % 977}" for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, other)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in fingerprints.edited_likeness(docs).collect()}
    assert 0.5 < got[1]["near_edited"] < 1.0
    assert got[1]["near_next"] < 0.2


def test_numbered_codes_count_repeats(spark):
    rows = [(["b" * 8, "a" * 8, "b" * 8],), ([],)]
    df = spark.createDataFrame(rows, "codes array<string>").select(fingerprints.numbered(F.col("codes")).alias("n"))
    assert [sorted(r["n"]) for r in df.collect()] == [["a" * 8 + "1", "b" * 8 + "1", "b" * 8 + "2"], []]


def test_models_of_other_operators_are_released():
    kept, other, memo = common.models(), common.models(), common.Memo(len)
    kept["a"], other["b"] = 1, 2
    assert memo["four"] == 4
    common.keep_memos(kept)
    assert kept == {"a": 1} and not other and not memo and memo["four"] == 4
    common.MODELS[:] = [m for m in common.MODELS if m is not kept and m is not other]


def test_edits_are_located(spark):
    a = spark.createDataFrame([(1, "p one\np two\n\nq one\nq two"), (2, "same")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "p one\np two\n\nq one\nq three"), (2, "same")], "doc_id bigint, text string")
    got = fingerprints.edits(fingerprints.fingerprints(a), fingerprints.fingerprints(b))
    assert collected(got, "doc_id", "section", "paragraph") == [(1, 1, 1)]


# --- 6 personal data -----------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ADDRESS = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal_brute(t):
    number = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in ADDRESS.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(number(m)) <= 19 and pii.luhn(number(m))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(number(m)) <= 15],
    }


def test_personal_data_equals_the_patterns():
    rnd = random.Random(11)
    parts = ["1.2.3.4", ".", "1", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1111", " ", "-", "a@b.c", "+1 (23) 456-78", "+", "é"]
    texts = ["".join(rnd.choice("ab@@..-+% 1122334 ()0é") for _ in range(rnd.randint(0, 50))) for _ in range(4000)]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 9))) for _ in range(4000)]
    for t in texts:
        found = pii.find(t)
        assert {k: found[k] for k in pii.KINDS} == personal_brute(t), t


def test_personal_data_further_kinds_and_redaction(odd, odd_rows):
    t = "mail a@b.co or +1 234 567 8901, IBAN DE89 3704 0044 0532 0130 00 end https://u:p@h.com/x ssn 123-45-6789"
    assert pii.redacted(t, pii.find(t)) == "mail [EMAIL] or [PHONE], IBAN [IBAN] end [LOGIN]/x ssn [SSN]"
    got = pii.redact(odd)
    assert got.columns == odd.columns and got.count() == len(odd_rows)
    assert {r["text"] for r in got.where("text like 'mail%'").collect()} == {"mail [EMAIL] now"}
    assert pii.find_personal_data(odd).where("n_email = 1").count() == 1


# --- 7 packing -----------------------------------------------------------------------------


@pytest.mark.parametrize("window", [7, 2048])
def test_packing(odd, odd_rows, window):
    library = Tokenizer.from_file(WORD_BPE)
    pieces = [r.asDict() for r in packing.pack(odd, WORD_BPE, window, with_ids=True).collect()]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and p["length"] == len(p["ids"]) > 0
    times = collections.Counter(i for i, _ in odd_rows)
    for i, t in odd_rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert sum(p["length"] for p in by_doc[i]) == len(ids) * times[i]
        for p in by_doc[i]:
            assert p["ids"] == ids[p["start"] : p["start"] + p["length"]] and p["doc_tokens"] == len(ids)
    last = max(by_sequence)
    for s, found in by_sequence.items():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == window or s == last and at <= window
    assert sorted(by_sequence) == list(range(last + 1))


# --- 8 byte-level BPE ----------------------------------------------------------------------


def test_bpe_equals_the_library(odd, odd_rows):
    library, own = Tokenizer.from_file(BYTE_BPE), bpe.vocabulary(BYTE_BPE)
    rnd = random.Random(1)
    alphabet = "ab cd\n\t  '.,!?09éüñß漢字🙂  \x1c\x85sSdrevlm<|>İσΣ́‍*%&$"
    words = ["hello", " world", "'s", " 've", "<|endoftext|>", "\n\n", "   ", "aaaaaaaaaaaaaaaa", "the", "====", "&&&", "***", "%%%", "$$$", " \n x"]
    texts = [t or "" for _, t in odd_rows]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))) for _ in range(1500)]
    texts += ["".join(rnd.choice("etaoin") for _ in range(rnd.randint(1, 80))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, t
        assert own.decode(got).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)
    word, pack = Tokenizer.from_file(WORD_BPE), packing.encoder(WORD_BPE)
    for t in texts:
        assert np.frombuffer(pack(t), "<u4").tolist() == word.encode(t, add_special_tokens=False).ids, t


def test_bpe_round_trip(odd, odd_rows):
    back = bpe.decode_documents(bpe.encode_documents(odd, BYTE_BPE), BYTE_BPE)
    assert collected(back, "doc_id", "text") == sorted([(i, t or "") for i, t in odd_rows], key=repr)


# --- 9 and 10 repeats ----------------------------------------------------------------------


def repeats_brute(rows, cut, window, own):
    texts = {}
    for i, t in rows:
        texts[i] = cut((t or "").encode())
    first, out = {}, {}
    for i in sorted(texts):
        u = texts[i]
        gone = bytearray(len(u))
        for s in range(len(u) - window + 1):
            key = tuple(u[s : s + window])
            if key in first and (own or first[key] < i):
                gone[s : s + window] = b"\1" * window
            first.setdefault(key, i)
        out[i] = [x for x, g in zip(u, gone) if not g], sum(gone), len(u)
    return out


def test_repeated_bytes(odd, odd_rows, small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    for docs, given in ((odd, odd_rows), (small, rows)):
        want = repeats_brute(given, bytes, suffix_dedup.WINDOW, True)
        for r in suffix_dedup.without_repeats(docs).collect():
            kept, removed, n = want[r["doc_id"]]
            assert (r["n_bytes"], r["n_removed"], r["kept_sha256"]) == (n, removed, hashlib.sha256(bytes(kept)).hexdigest())
            assert r["n_spans"] == len(r["removed"]) and sum(b - a for a, b in r["removed"]) == removed


def test_repeated_words(odd, odd_rows, small):
    rows = [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()]
    for docs, given in ((odd, odd_rows), (small, rows)):
        want = repeats_brute(given, bytes.split, substring_dedup.WINDOW, False)
        for r in substring_dedup.without_repeats(docs).collect():
            kept, removed, n = want[r["doc_id"]]
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, removed, hashlib.sha256(b" ".join(kept)).hexdigest())


def test_repeats_in_segments_of_long_texts(odd, odd_rows):
    shape = repeats.Shape(window=20, gram=6, part=4, own=True, segment=64)
    want = repeats_brute(odd_rows, bytes, 20, True)
    for r in suffix_dedup.without_repeats(odd, shape).collect():
        kept, removed, n = want[r["doc_id"]]
        assert (r["n_removed"], r["kept_sha256"]) == (removed, hashlib.sha256(bytes(kept)).hexdigest())


# --- all -----------------------------------------------------------------------------------


def test_empty_tables(empty):
    for run in (
        exact_dedup.exact_groups, near_dedup.near_groups, fingerprints.edited_likeness, pii.find_personal_data,
        lambda d: packing.pack(d, WORD_BPE), lambda d: bpe.digests(d, BYTE_BPE), suffix_dedup.without_repeats,
        substring_dedup.without_repeats, language_model.score,
    ):
        assert run(empty).count() == 0


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (None, None)], "doc_id bigint, text string")
    near = near_dedup.near_groups(docs)
    assert collected(near, "doc_id", "component_id") == sorted([(None, None), (None, None), (1, 1)], key=repr)
    for run in (
        exact_dedup.exact_groups, fingerprints.edited_likeness, pii.find_personal_data, lambda d: bpe.digests(d, BYTE_BPE),
        suffix_dedup.without_repeats, substring_dedup.without_repeats, language_model.score,
    ):
        assert run(docs).count() == 3


def test_pipeline(spark, odd, small):
    docs = small.withColumn("extra", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns and 0 < after.count() <= docs.count(), name
        docs = after
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    want = near_brute([(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()])
    assert left == {i for i, (_, _, kept) in want.items() if kept}
    assert corpus_pipeline.pack(spark, docs, SMALL).select("doc_id").distinct().count() == len(left)
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    assert docs.count() > 0


def test_pipeline_rejects_junk_and_foreign_text_only(spark, small):
    planted = [
        (900001, "OK"), (900002, "xqzv bbrt kkpl wqx zzt plk mnv qqq"), (900003, "asdf qwer zxcv uiop hjkl ghjk"),
        (900004, "Это обычное русское предложение о погоде и книгах"), (900005, "the of and"), (900006, "12 34"), (900007, None),
    ]
    more = spark.createDataFrame([(*r, None, "s", 1) for r in planted], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = small.unionByName(more, allowMissingColumns=True)
    left = {r["doc_id"] for r in corpus_pipeline.language_id(spark, docs, SMALL).select("doc_id").collect()}
    clean = {r["doc_id"] for r in small.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert left == clean | {900001, 900005}


def test_pipeline_keeps_what_only_shares_an_id(spark):
    rows = [
        (5, "A same"), (3, "A same"), (5, "B other"), (7, "dup"), (7, "dup"), (None, "dup"), (None, "x y"), (None, "x y"), (8, None), (9, ""),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("uses", F.lit(1))
    once = corpus_pipeline.exact(spark, docs, SMALL)
    want = [(3, "A same"), (5, "B other"), (7, "dup"), (8, None), (None, "x y")]
    assert collected(once, "doc_id", "text") == sorted(want, key=repr)
    words = sentence(random.Random(1), 60)
    rows = [(1, words), (2, words + " more"), (2, "another text under the id two"), (None, words), (4, "short")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shared_id", F.lit(1))
    left = corpus_pipeline.near(spark, docs, SMALL)
    texts = sorted(r["text"] for r in left.collect())
    assert "another text under the id two" in texts and "short" in texts and len(texts) == 4


def test_memos_skip_long_keys():
    from garimpo.llm.common import Memo

    memo = Memo(len, 10)
    assert memo["x" * 100] == 100 and memo["abc"] == 3 and list(memo) == ["abc"]
