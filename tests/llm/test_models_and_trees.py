"""Katz backoff, Merkle manifest and prefix trie against brute force, with nulls, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readframe.llm import katz, merkle, prefix_trie, ranks
from readframe.llm.shared import cut

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, rank long, total long, node string, block int, h long, held string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3, 4, "z") for r in rows], SCHEMA).repartition(3)


def crc(number):
    return zlib.crc32(str(number).encode())


# --- ranks


@pytest.mark.parametrize("block_bits", [2, 10])
def test_ranks_are_places_in_sorted_order(spark, monkeypatch, block_bits):
    monkeypatch.setattr(ranks, "BLOCK_BITS", block_bits)
    monkeypatch.setattr(ranks, "COPIES", 7)
    rng = random.Random(block_bits)
    digest = [hashlib.sha256(bytes([k])).hexdigest() for k in range(3)]
    near = [digest[0][:20] + "0" * 44, digest[0][:20] + "1" * 44]  # alike where the order starts
    keys = [None, -(2**63), 2**63 - 1, -1, 0]
    rows = [(rng.choice("abbb"), rng.choice([*keys, rng.randrange(-99, 99), rng.getrandbits(62), k]), rng.choice(digest + near)) for k in range(200)]
    rows += rows[:50] + [("a", None, digest[0])] * 30
    found = ranks.ranked(spark.createDataFrame(rows, "g string, key long, digest string"), "g", "key", "digest").collect()
    for g in "ab":
        expected = sorted(((k, d) for h, k, d in rows if h == g), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        mine = sorted((r for r in found if r.g == g), key=lambda r: r["rank"])
        assert [(r["rank"], r.key, r.digest, r.total) for r in mine] == [(n, k, d, len(expected)) for n, (k, d) in enumerate(expected)]


@pytest.mark.parametrize("xor", [False, True])
def test_running_sums_over_several_levels(spark, monkeypatch, xor):
    monkeypatch.setattr(ranks, "BLOCK_BITS", 2)
    rng = random.Random(4)
    rows = [(g, k, rng.getrandbits(40)) for g in (1, 2) for k in rng.sample(range(-500, 500), 150)] + [(3, 5, 9)]
    found = ranks.running(cut(spark.createDataFrame(rows, "g long, k long, x long")), "g", "k", ["x"], xor=xor).collect()
    expected = []
    for g in (1, 2, 3):
        before = 0
        mine = sorted((k, x) for h, k, x in rows if h == g)
        steps = []
        for k, x in mine:
            steps.append((g, k, x, before))
            before = before ^ x if xor else before + x
        expected += [(*s, before) for s in steps]
    assert sorted((r.g, r.k, r.x, r.before_x, r.total_x) for r in found) == sorted(expected)


# --- 11 Katz backoff


def words_of(text):
    return (text or "").encode().translate(katz.LOWER).split() + [katz.END]


class Plain:
    """The model word by word."""

    def __init__(self, texts):
        self.words, self.pairs, self.contexts = Counter(), Counter(), Counter()
        for text in texts:
            words = words_of(text)
            for a, b in zip([katz.START, *words[:-1]], words, strict=True):
                self.words[b] += 1
                self.pairs[a, b] += 1
                self.contexts[a] += 1
        self.total = sum(self.words.values())
        self.one, self.two = self.factors(self.words), self.factors(self.pairs)
        self.free = sum(c * (1 - self.one[c]) for c in self.words.values())
        self.after = defaultdict(list)
        for (a, b), c in self.pairs.items():
            self.after[a].append((b, c))

    @staticmethod
    def factors(counts):
        known = katz.good_turing([sum(c == r for c in counts.values()) for r in range(1, 7)])
        return defaultdict(lambda: 1.0, enumerate(known, 1))

    def word(self, w):
        whole, c = self.total + (self.free == 0), self.words.get(w, 0)
        return c * self.one[c] / whole if c else (self.free or 1) / whole

    def pair(self, a, w):
        if a not in self.after:
            return self.word(w)
        whole, c = self.contexts[a] + (self.contexts[a] > 5), self.pairs.get((a, w), 0)
        if c:
            return c * self.two[c] / whole
        kept = sum(c * self.two[c] for _, c in self.after[a]) / whole
        return (1 - kept) / (1 - sum(self.word(b) for b, _ in self.after[a])) * self.word(w)

    def row(self, doc_id, held, text):
        words = words_of(text)
        base = sum(math.log10((self.words.get(w, 0) + 0.5) / (self.total + 0.5 * (len(self.words) + 1))) for w in words)
        score = sum(math.log10(self.pair(a, w)) for a, w in zip([katz.START, *words[:-1]], words, strict=True))
        return doc_id, held, len(words), sum(w in self.words for w in words), self.total, base, score


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["É", "The", "THE", "日本"]
    return [rng.choice([" ", "\n", "\t "]).join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 40, 200]))) for _ in range(n)]


@pytest.mark.parametrize("n, parts", [(0, 1), (1, 1), (300, 40)])
def test_scores_are_those_of_the_model_word_by_word(spark, monkeypatch, n, parts):
    monkeypatch.setattr(katz, "PART_TOKENS", 10**9 if parts == 1 else 500)
    rows = [(None if k % 11 == 7 else k, t) for k, t in enumerate(texts(n, n))]
    rows += [(None, None), (3, ""), (5, " \n"), (3, "a " * 3000)] * (n > 1) + rows[:9]
    held = [d is not None and crc(d) % 5 == 1 for d, _ in rows]
    model = Plain([t for (_, t), out in zip(rows, held, strict=True) if not out])
    expected = [model.row(d, out, t) for (d, t), out in zip(rows, held, strict=True)]
    found = [tuple(r) for r in katz.score_documents(documents(spark, [(d, t, None, None, None) for d, t in rows])).collect()]
    order = lambda r: (repr(r[:5]), round(r[6], 5))
    assert len(found) == len(expected)
    for mine, theirs in zip(sorted(found, key=order), sorted(expected, key=order), strict=True):
        assert mine[:5] == theirs[:5] and mine[5:] == pytest.approx(theirs[5:], abs=1e-6)


def test_without_training_documents_scores_are_zero(spark):
    ids = [d for d in range(40) if crc(d) % 5 == 1]
    found = katz.score_documents(documents(spark, [(d, "a b", None, None, None) for d in ids])).collect()
    assert [(r.train_tokens, r.n_known, r.base_score, r.score) for r in found] == [(0, 0, 0.0, 0.0)] * len(ids)


def test_every_context_sums_to_one(spark):
    given = texts(8, 80)
    docs = documents(spark, [(k, t, None, None, None) for k, t in enumerate(given)]).select("doc_id", F.lit(False).alias("held"), "text")
    model = katz.fit(docs, with_pairs=True)
    plain = Plain(given)
    weights = {r.h: r for r in model.weights().collect()}
    seen, lower = defaultdict(float), defaultdict(float)
    pairs = model.pairs().collect()
    assert len(pairs) == len(plain.pairs) and len(weights) == len(plain.after)
    for r in pairs:
        seen[r.h] += 10**r.log10_probability
        lower[r.h] += float(model.words.probability(np.array([r.word_n]))[0])
    for h, r in weights.items():
        assert seen[h] + 10**r.log10_weight * (1 - lower[h]) == pytest.approx(1, abs=1e-9)
        assert 0 < 10**r.log10_weight


@pytest.mark.parametrize("n", [[8e6, 1.2e6, 3e5, 1.5e5, 1e5, 6e4], [0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9], [9, 1, 0, 2, 0, 1], [6, 1, 1, 1, 1, 1]])
def test_discounts_leave_and_keep_something(n):
    factors = katz.good_turing(n)
    assert (0 < factors).all() and (factors < 1).all()


def test_hot_words_are_spread():
    w, h = np.full(5000, 7, np.uint64), np.random.default_rng(1).integers(2, 2**63, 5000).astype(np.uint64)
    alone = katz._place(w, h, 16, np.zeros(0, np.uint64))
    spread = katz._place(w, h, 16, np.array([7], np.uint64))
    assert len(set(alone.tolist())) == 1 and np.bincount(spread, minlength=16).min() > 200


# --- 12 Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, place):
    out = []
    for level in levels[:-1]:
        run = level[place // 8 * 8 : place // 8 * 8 + 8]
        out.append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        place //= 8
    return out


def manifest_of(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = tree_of([leaf(*r) for r in groups[lang]])
    top = tree_of([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, (doc_id, text, *rest) in enumerate(groups[lang]):
            path = siblings(trees[lang], place) + siblings(top, k)
            if doc_id is not None and text is not None and crc(doc_id) % 3 == 0:
                text = text.translate({c: c + 32 for c in range(65, 91)})
            folded = leaf(doc_id, text, *rest)
            for left, right in path:
                folded = sha(left + folded + right)
            proof = sha("".join(a + b for a, b in path))
            out.append((doc_id, trees[lang][0][place], trees[lang][-1][0], top[-1][0], proof, folded, folded == top[-1][0]))
    return Counter(out)


@pytest.mark.parametrize("n, langs", [(0, "a"), (60, "many"), (1500, "few")])
def test_manifest_is_the_tree_of_sorted_leaves(spark, n, langs):
    rng = random.Random(n)
    named = {"a": ["a"], "many": [None, "", "é", "zz", *map(str, range(20))], "few": [None, "en", "en", "en", "de"]}[langs]
    rows = [
        (rng.choice([None, rng.randrange(-50, 50), rng.getrandbits(62), k, k, k]), rng.choice([None, "", "Ab c", "xyz", f"ÄÖA{k}"]), rng.choice(named), rng.choice([None, "s"]), rng.choice([None, 3]))
        for k in range(n)
    ]
    rows += rows[: n // 3] + [(None, "Same", "en", None, 1)] * (n // 5)
    assert Counter(tuple(r) for r in merkle.tamper_check(documents(spark, rows)).collect()) == manifest_of(rows)


# --- 13 prefix trie


def trie_of(rows, rebuild=True):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, whole = defaultdict(list), {}
    for c, ts in own.items():
        h = crc(c) % 6 if rebuild else 0
        whole[c] = (*own.get(c - int(math.fmod(c, 100)), [])[:h], *ts[h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, mine in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(mine) - 1) * (len(k[-1][1]) if k else 0)
            leaves[k[:d]] += children[k] == 0
    ends = {k: ",".join(str(c) for c in sorted(mine) if len(whole[c]) == len(k)) for k, mine in members.items()}
    return Counter((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("n, rebuild", [(0, True), (700, True), (150, False)])
def test_trie_is_that_of_all_prefixes(spark, n, rebuild):
    rng = random.Random(n)
    rows = []
    for c in range(n):
        conv = rng.choice([c, c, c, -c, 10**12 + c])
        for t in range(rng.choice([0, 1, 2, 3, 4, 5, 8, 9, 20])):
            text = rng.choice(["hi", "hi", "hi", "hi" + "x" * (t % 3), None, "", "é日"])
            rows.append((conv, rng.choice([t, t, t, None]), rng.choice("ua") if rng.random() < 0.1 else "u", text))
    rows += [(None, 1, "u", "x")] * (n > 1) + rows[:20]
    rows += [(c, t, "u", "hi") for c in (5000, 5100) for t in range(c % 1000 // 10 + 150)] * (n == 700)
    given = spark.createDataFrame([(*r, 1, 2, "n") for r in rows], "conv_id long, turn long, role string, text string, conv long, pos long, node string")
    found = prefix_trie.rebuilt_trie(given) if rebuild else prefix_trie.prefix_trie(given).drop("node", "parent")
    assert found.columns == NODE
    assert Counter(tuple(r) for r in found.collect()) == trie_of(rows, rebuild)


def test_ids_that_end_at_a_node_are_hashed_in_order(spark):
    rows = [(c, 0, "u", "same") for c in range(-700, 2500, 3)]
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.depth: r.ends_sha256 for r in found} == {0: sha(""), 1: sha(",".join(str(r[0]) for r in rows))}
