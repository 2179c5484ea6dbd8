"""Filter audit, SimHash dedup and ranked search against brute force and odd input."""

import collections
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
import xxhash

from garimpo.llm import filter_audit, lexical_search, simhash
from garimpo.llm.common import positional_counts
from garimpo.llm.registry import REGISTRY
from tests.conftest import SMALL
from tests.oracle import compare, connect

# names of the operators' inner columns, to provoke clashes
EXTRA = ", part string, digest int, print int, uses int, root string, score string, item int, n int, good int, quality int"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdeéB3") for _ in range(rnd.randint(1, 4))) for _ in range(n))


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def odd_rows():
    rnd = random.Random(3)
    base, long = sentence(rnd, 230), sentence(rnd, 30_000)
    near = base.split()
    near[100] = "changed"
    texts = [
        None, "", " \n\x0b ", "one", "ONE", base, base, base, " ".join(near), long, long[:-5] + " x y z", "a b c", "a b c d",
        "aaaa " * 300, "été " * 260, "A" * 40, "100 % | of # it", "a\x0bb\x1cc\xa0d\x85e", "名前 は 名前 1x_2y", base.upper(), "\x00\x00",
    ]
    rows = [(i + 3 * (i > 9), t, (None, "en", "fr")[i % 3]) for i, t in enumerate(texts)]
    return rows + [rows[5], rows[10]]  # repeated rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(
        [(*r, *(None,) * 10) for r in odd_rows], "doc_id bigint, text string, lang string" + EXTRA
    ).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(0, 1, 0), (3, 1, None), (5, 0, 1), (5, 1, 0), (6, 1, 1), (7, None, None), (999, 1, 1), (None, 1, 1), (9, 1, 0), (13, 0, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_ranked_search"])
def test_queries_equal_their_sql(spark, name):
    q = REGISTRY[name]
    assert compare(q.run(spark, SMALL), connect(SMALL), q.sql) is None


# --- 11 filter audit -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 64, 1000])
def test_positional_counts(n):
    words = np.random.default_rng(n).integers(0, 2**32, n, np.uint32)
    want = [int(((words >> np.uint32(b)) & np.uint32(1)).sum()) for b in range(32)]
    assert positional_counts(words).tolist() == want


def failures(rows):
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang in rows:
        t = t or ""
        words = WORD.findall(t)
        yield i, lang or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i > first[t],
        }


def audited(rows, marked, letters):
    """Applies the filters of every order to every row, one after the other."""
    out, judged = {}, list(failures(rows))
    for part in {p for _, p, _ in judged}:
        mine = [(i, f) for i, p, f in judged if p == part]
        shares = collections.Counter()
        for order in permutations(letters):
            alive = mine
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in alive if f[letter]]
                alive_after = [(i, f) for i, f in alive if not f[letter]]
                out[part, "".join(order), step] = [
                    len(alive_after), len(gone), sum(f[letter] for _, f in mine) - len(gone),
                    sum(f[letter] and sum(f[x] for x in letters) == 1 for _, f in mine),
                    sum(marked.get(i, (0, 0))[0] for i, _ in gone), sum(marked.get(i, (0, 0))[1] for i, _ in gone),
                ]
                shares[letter] += len(gone)
                alive = alive_after
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shares[order[step - 1]])
    return out


def rows_of(audit):
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r.part, r.filter_order, r.step): [r[c] for c in columns] for r in audit.collect()}


MARKED = {0: (1, 0), 3: (1, 0), 5: (1, 1), 6: (1, 1), 9: (1, 0), 13: (0, 1)}


def test_filter_audit(odd, odd_rows, labels):
    got = rows_of(filter_audit.audit(odd, labels))
    assert len(got) == 3 * 600
    assert got == audited(odd_rows, MARKED, "ABCDE")


def test_filter_audit_of_fewer_filters(odd, odd_rows, labels):
    chosen = {x: filter_audit.FILTERS[x] for x in "EB"}
    assert rows_of(filter_audit.audit(odd, labels, chosen)) == audited(odd_rows, MARKED, "EB")
    with pytest.raises(ValueError):
        filter_audit.audit(odd, labels, {x: "true" for x in "ABCDEF"})


def test_filter_audit_of_nothing_and_of_nulls(spark, odd, labels):
    assert filter_audit.audit(odd.where("doc_id < 0"), labels).count() == 0
    rows = spark.createDataFrame([(None, "x", "en"), (None, "x", "en"), (4, "x", None)], "doc_id bigint, text string, lang string")
    got = rows_of(filter_audit.audit(rows, labels.where("doc_id < 0"), {"E": "copy", "A": "n_words < 1"}))
    assert got["en", "EA", 1] == [2, 0, 0, 0, 0, 0, 0]  # rows without an id are no copies
    assert got["", "AE", 2] == [1, 0, 0, 0, 0, 0, 0]


def test_filter_audit_of_one_text_over_many_rows(spark, labels):
    rows = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text", "'en' as lang")
    got = rows_of(filter_audit.audit(rows.repartition(7), labels.where("doc_id < 0"), {"E": "copy"}))
    assert got["en", "E", 1] == [2001, 999, 0, 999, 0, 0, 999]


# --- 12 SimHash ----------------------------------------------------------------------------


def fingerprint(text):
    words = WORD.findall(lowered(text or ""))
    take = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + take]).encode(), seed=42) for i in range(len(words) - take + 1) if take]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, differ=4):
    """Smallest key of the component of every key of ``prints``."""
    parent = {i: i for i in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= differ:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return {i: top(i) for i in prints}


def test_simhash_of_odd_rows(odd, odd_rows):
    prints = {i: fingerprint(t) for i, t, _ in odd_rows}
    want = grouped(prints)
    got = simhash.near_groups(odd).collect()
    assert len(got) == len(odd_rows)
    assert all((r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id]) for r in got)
    assert len({r.component_id for r in got}) < len(prints)


def near_prints(n, seed=5):
    """Fingerprints of which many differ in up to six bits from some others."""
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(4)] + [0]
    out = []
    for _ in range(n):
        value = rnd.choice(centres)
        for _ in range(rnd.randint(0, 6)):
            value ^= 1 << rnd.randrange(64)
        out.append(value)
    return sorted(set(out))


def signed(value):
    return value - (1 << 64) if value >> 63 else value


@pytest.mark.parametrize("differ, meeting", [(0, 8192), (1, 8192), (2, 8192), (4, 8192), (6, 8192), (4, 3)])
def test_simhash_links_connect_what_is_near(spark, monkeypatch, differ, meeting):
    monkeypatch.setattr(simhash, "MEETING", meeting)
    prints = near_prints(300)
    df = spark.createDataFrame([(signed(p),) for p in prints], "print bigint").repartition(3)
    links = {(r.u % 2**64, r.v % 2**64) for r in simhash.links_of(df, differ).collect()}
    assert all((a ^ b).bit_count() <= differ for a, b in links)
    want, parent = grouped({p: p for p in prints}, differ), {p: p for p in prints}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    assert {p: top(p) for p in prints} == want


def test_simhash_crowded_keys_are_handed_on():
    ring, prints = simhash.Ring(4), np.arange(40, dtype=np.uint64) << np.uint64(40)
    key = np.zeros(40, np.int64)
    batch = simhash.pa.RecordBatch.from_pydict({"key": key, "visiting": np.zeros(40, bool), "print": prints.view(np.int64)})
    out = [r for b in simhash._compare(ring, iter([batch, batch]), ["key"], 16) for r in b.to_pylist()]
    assert len(out) == 80 and all(r["key"] == 0 and r["v"] is None for r in out)


def test_simhash_of_nothing_and_of_nulls(spark, odd):
    assert simhash.near_groups(odd.where("doc_id < 0")).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (2, "a b"), (None, "only here"), (1, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.component_id, len(r.fingerprint)) for r in simhash.near_groups(rows).collect() if r.doc_id)
    assert got == [(1, 1, 16), (2, 2, 16)]
    assert simhash.near_groups(rows).where("doc_id is null and component_id is null").count() == 2


# --- 13 ranked search ----------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs, items, k=10):
    bags = [(i, collections.Counter(TERM.findall(lowered(t or "")))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(t for _, b in bags for t in b)
    out = {}
    for item, text in items:
        found = []
        for i, b in bags:
            m = 10 + 90 * sum(b.values()) * n // length
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m))
                for t in set(TERM.findall(lowered(text or ""))) if t in b
            )
            if score and i is not None:
                found.append((-score, i))
        out |= {(item, rank): (i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)}
    return out


@pytest.fixture(scope="module")
def questions(odd_rows):
    texts = {i: t for i, t, _ in odd_rows}
    long = texts[9].split()
    return [
        (1, "one ONE two"), (2, " ".join(texts[5].split()[20:50])), (3, " ".join(long[:400])), (4, None), (5, "!!"), (6, "名前 x_2y été"),
        (7, "a b c d"), (8, "nowhere"), (-1, " ".join(long[5000:9000])),
    ]


@pytest.mark.parametrize("block", [200_000, 20])
@pytest.mark.parametrize("k", [10, 1])
def test_ranked_search(spark, monkeypatch, odd, odd_rows, questions, block, k):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", block)
    monkeypatch.setattr(lexical_search, "SLICE_DOCS", 5)
    items = spark.createDataFrame([(i, t, None) for i, t in questions], "item_id bigint, text string, score int")
    got = {(r.item_id, r.rank): (r.doc_id, r.score) for r in lexical_search.search(odd, items, k).collect()}
    assert got == ranked([r[:2] for r in odd_rows], questions, k)


def test_ranked_search_starts_from_a_sample(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "SAMPLE", 20)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    got = {(r.item_id, r.rank): (r.doc_id, r.score) for r in lexical_search.search(docs, items).collect()}
    assert got == ranked([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])


def test_ranked_search_of_nothing_and_of_nulls(spark, odd, questions):
    items = spark.createDataFrame(questions, "item_id bigint, text string")
    assert lexical_search.search(odd.where("doc_id < 0"), items).count() == 0
    assert lexical_search.search(odd, items.where("item_id > 100")).count() == 0
    docs = spark.createDataFrame([(None, "cat dog"), (3, "cat dog"), (2, "cat dog"), (9, "bird"), (8, "fish eel")], "doc_id bigint, text string")
    twice = spark.createDataFrame([(1, "cat"), (1, "CAT bird"), (None, "cat")], "item_id bigint, text string")
    got = [(r.item_id, r.rank, r.doc_id) for r in lexical_search.search(docs, twice).collect()]
    assert sorted(got) == [(1, 1, 9), (1, 2, 2), (1, 3, 3)]


def test_search_prunes_without_changing_a_result():
    rng = np.random.default_rng(1)
    items = [np.unique(rng.integers(0, 60, 5)) for _ in range(30)]
    weights = rng.integers(1, 9, 60).astype(float)
    root, order = lexical_search.item_tree(items, weights)
    assert sorted(order) == list(range(30))
    impacts = np.where(rng.random((60, 400)) < 0.05, rng.integers(1, 50, (60, 400)), 0).astype(float)
    search = lexical_search.Search(root, weights, 3, np.zeros(30, np.int64))
    for at in range(0, 400, 100):
        search.add(impacts[:, at : at + 100], np.arange(at, at + 100))
    assert search.scored < 0.9 * 30 * 400
    for place, i in enumerate(order):
        scores = (impacts[items[i]] * weights[items[i]][:, None]).sum(0)
        want = sorted((-s, d) for d, s in enumerate(scores) if s)[:3]
        assert [(-s, d) for s, d in zip(search.scores[place], search.ids[place]) if s] == want


def test_a_word_is_remembered_once_with_or_without_marks():
    import public_tokenizers

    from garimpo.llm.packing import Encoder

    encode = Encoder(public_tokenizers.path("word_bpe_49k.json"), 1000)
    texts = ["Stone, stone stone. STONE!? (stone)", "Ação; ação Über über... ÜBER", "x1 don't a_b 7,5 naïve word", "ß ẞ İx ſ", ""]
    for text in texts:
        assert encode(text) == encode.encode(text)
    words = sum(w.lower() == "stone" for w in encode.chunks), sum("stone" in w.lower() for w in encode.marks)
    assert words[0] >= 1 and words[1] == 0 and not hasattr(encode, "pieces")
    tried = []
    encode.chunks.clear()
    encode.tokenize = lambda text: tried.append(text) or encode.tokenizer.model.tokenize(text)
    encode("stone stone, Stone; STONE.")
    assert tried.count("stone") == 1
