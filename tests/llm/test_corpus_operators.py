"""Near-duplicates, passages, decontamination, preference pairs and the pipeline, against brute force."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from ledgerlake.llm import common, decontamination, passages, preference, queries, simhash
from ledgerlake.llm.common import components, table


def brute_print(text, shingle=4):
    w = text.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + shingle]), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    up = {i: i for i in ids}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def test_simhash_components(spark, small, messy):
    docs = small("documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {i: brute_print(t) for i, t in rows.items()}
    ids, fp = list(prints), np.array(list(prints.values()), np.uint64)
    near = [(ids[i], ids[j]) for i in range(len(ids)) for j in (np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 4) + i + 1).tolist()]
    want = brute_components(ids, near)
    got = queries.queries()["op7_simhash_bk_trees"](spark, "/root/testdata/sf0.01").collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}
    wild = simhash.near_duplicates(messy, 4).collect()
    assert len(wild) == messy.count()
    by_id = {}
    for r in wild:
        by_id.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert by_id[0] == by_id[1] == by_id[2] == {0} and by_id[4] == by_id[5] == {4} and by_id[None] == {0, 4}
    assert simhash.near_duplicates(messy.limit(0), 4).count() == 0


@pytest.mark.parametrize("n", [1, 2, 300])
def test_forest(n):
    rng = np.random.default_rng(n)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    fp = np.unique(np.concatenate(([centre], centre ^ (np.uint64(1) << rng.integers(0, 30, n, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 60, n, dtype=np.uint64)), rng.integers(0, 2**63, n, dtype=np.uint64))))
    rng.shuffle(fp)
    shard = np.sort(rng.integers(0, 3, len(fp)))
    found = {(int(a), int(b)) for x, y in simhash.Forest(fp, shard).within(3) for a, b in zip(x, y, strict=True)}
    want = {(i, j) for i in range(len(fp)) for j in range(len(fp)) if i != j and shard[i] == shard[j] and int(fp[i] ^ fp[j]).bit_count() <= 3}
    assert found == want


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + k: 1000 for k in range(200)}


def test_dedup_keeps_one_of_each_group(spark, messy, words):
    rows, groups = [], 40
    for g in range(groups):
        w = words(150).split()
        for c in range(4):
            v = list(w)
            if c:
                v[10 * c] = f"edit{c}"  # similar by more than 0.9
            rows.append((g * 10 + c, " ".join(v)))
        rows.append((g * 10 + 9, words(150)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.deduplicated(docs).collect()}
    assert {g * 10 + 9 for g in range(groups)} <= kept and {g * 10 for g in range(groups)} <= kept
    assert len(kept) <= 2 * groups + 2
    out = simhash.deduplicated(messy)
    assert out.columns == messy.columns
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(got, key=str) == sorted([0, 3, 4, 6, 7, 8, 9], key=str) or sorted(got, key=str) == sorted([0, 3, 4, 6, 7, 8], key=str)
    assert simhash.deduplicated(messy.limit(0)).count() == 0


def shingle_sets(texts):
    split = [t.lower().split() for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in split]


def test_dedup_among_weak_copies(spark, words, rng):
    """Copies too far from each other stand around the ones that are near enough; short texts have few pieces."""
    texts = []
    for size, edits in ((180, 7), (180, 5), (40, 1), (24, 1)):
        base = words(size).split()
        for _ in range(40):
            v = list(base)
            for _ in range(edits):
                v[rng.randrange(size)] = words(1)
            texts.append(" ".join(v))
            if rng.random() < 0.5:
                v[rng.choice((0, size - 1))] = words(1)
                texts.append(" ".join(v))
    sets = shingle_sets(texts)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    groups = brute_components(range(len(texts)), near)
    kept = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert len({groups[k] for k in kept}) == len(kept)


def test_prefixes_meet_wherever_sets_are_similar(words, rng):
    texts = []
    for size in (5, 6, 7, 9, 12, 30, 60, 200):
        base = words(size).split()
        for edits in (0, 0, 1, 1, 2, 4, 7):
            v = list(base)
            for _ in range(edits):
                v[rng.choice((0, size - 1, rng.randrange(size)))] = words(1)
            texts.append(" ".join(v))
    both, sets = simhash.Words([t.encode() for t in texts]), shingle_sets(texts)
    token, _ = both.shingles(5)
    for common in (np.zeros(0, np.uint64), np.unique(token[::3]), np.unique(token)):
        key, text = simhash.prefixes(both, 5, 0.8, common)
        own = [set(key[text == k].tolist()) for k in range(len(texts))]
        for i in range(len(texts)):
            for j in range(i):
                if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                    assert len(own[i] & own[j]) >= passages.AGREE


def test_dedup_links_texts_that_no_piece_and_no_order_brings_together(spark, words, rng, monkeypatch):
    """With one piece a text, most similar texts have none in common; all are found nevertheless."""
    monkeypatch.setattr(simhash, "SKETCH", 1)
    texts = []
    for size, edits in ((150, 4), (40, 1)):
        for _ in range(25):
            base = words(size).split()
            for _ in range(2):
                v = list(base)
                for _ in range(edits):
                    v[rng.randrange(size)] = words(1)
                texts.append(" ".join(v))
    sets = shingle_sets(texts)
    near = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    groups = brute_components(range(len(texts)), near)
    kept = [r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert len({groups[k] for k in kept}) == len(kept) < len(texts)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_linked_pairs_across_batches(size):
    rows = [(1, 5), (1, 5), (1, 6), (1, 2), (1, 9), (2, 9), (3, 4), (3, 7)]
    columns = lambda part: pa.record_batch({"key": [k for k, _ in part], "node": [n for _, n in part], "hot": [k == 3 for k, _ in part], "signature": [k for k, _ in part]}, pa.schema({"key": pa.int64(), "node": pa.int64(), "hot": pa.bool_(), "signature": pa.int64()}))
    for width, want in ((1, {(6, 5), (5, 2), (6, 2), (9, 2), (9, 5), (7, 4)}), (2, {(6, 5), (5, 2), (6, 2), (9, 2), (9, 6), (9, 5), (7, 4)})):
        got = [r for b in passages.linked((columns(rows[i : i + size]) for i in range(0, len(rows), size)), width) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in got if r["kind"] == passages.PAIR} == want
        assert [(r["a"], r["b"]) for r in got if r["kind"] == passages.BRIDGE] == [(4, 3)]
        assert sorted((r["b"], r["a"]) for r in got if r["kind"] == passages.MEMBER) == [(1, 2), (1, 5), (1, 6), (1, 9), (3, 4), (3, 7)]


def cartesian_root(v, a, b):
    """The root of the Cartesian tree over v[a:b], built with a stack; of equal values the first is above."""
    stack = []
    for k in range(a, b):
        while stack and v[stack[-1]] > v[k]:
            stack.pop()
        stack.append(k)
    return stack[0]


def test_windows_against_definition():
    rng = np.random.default_rng(0)
    for top, n in ((5, 400), (1000, 400), (1000, 10), (1000, 9)):
        v = rng.integers(0, top, n).astype(np.uint64) << np.uint64(24)
        want = [cartesian_root(v, a, a + 10) for a in range(n - 9)]
        assert passages.roots(v, 10).tolist() == want
        first, last, root = passages.compact_windows(v, 10)
        assert [r for a, b, r in zip(first, last, root, strict=True) for _ in range(b - a + 1)] == want


def test_signatures_are_agreeing_roots(words):
    """A text's signatures are those of the roots of all its runs, each alone; no run goes over into another text."""
    texts = [words(120), words(50), words(49), "", words(60)]
    least = passages.MIN_WORDS - passages.SHINGLE + 1
    key, text = passages.signatures(passages.Words([t.encode() for t in texts]))
    for k, t in enumerate(texts):
        split = t.split()
        runs = [" ".join(split[i : i + passages.MIN_WORDS]) for i in range(len(split) - passages.MIN_WORDS + 1)]
        alone = {int(s) for run in runs for s in passages.signatures(passages.Words([run.encode()]))[0]}
        assert set(key[text == k].tolist()) == alone
        assert not runs or len(passages.signatures(passages.Words([runs[0].encode()]))[0]) == passages.BANDS
    assert least == 46


def test_signatures_recall_edited_passages(words, rng):
    """Pairs of passages at the limits, with an edit or two anywhere, amid other words: all share a signature."""
    tried = 0
    while tried < 300:
        p = words(rng.randint(50, 70)).split()
        q = list(p)
        for _ in range(rng.choice((1, 1, 2))):
            q[rng.randrange(len(q))] = words(1)
        a, b = shingle_sets([" ".join(p), " ".join(q)])
        if 5 * len(a & b) < 4 * len(a | b):
            continue
        tried += 1
        x, y = (f"{words(100)} {' '.join(v)} {words(100)}".encode() for v in (p, q))
        key, text = passages.signatures(passages.Words([x, y]))
        assert set(key[text == 0].tolist()) & set(key[text == 1].tolist())


def test_seed_signatures_meet_wherever_a_passage_is_verified(words, rng):
    """Texts with a verified passage share AGREE signatures, whichever tokens are taken for common, also in texts that
    repeat a few words."""
    tried = 0
    while tried < 300:
        p = (words(rng.randint(50, 90)) if rng.random() < 0.7 else " ".join([words(rng.choice((3, 9, 30)))] * 20)).split()[:90]
        q = list(p)
        for _ in range(rng.choice((0, 1, 2))):
            q[rng.randrange(len(q))] = words(1)
        if rng.random() < 0.3:
            del q[rng.randrange(len(q))]
        pair = passages.Words([f"{words(60)} {' '.join(v)} {words(60)}".encode() for v in (p, q)])
        token, at = pair.shingles(passages.SHINGLE)
        x, y = (token[pair.text_of[at] == k] for k in (0, 1))
        if not passages.common_passages(x, y):
            continue
        tried += 1
        for common in (np.zeros(0, np.uint64), np.unique(x), np.unique(token[:: rng.randint(2, 5)]), np.unique(x[60 : 60 + rng.randint(20, 60)])):
            key, text = passages.seed_signatures(pair, common)
            assert len(set(key[text == 0].tolist()) & set(key[text == 1].tolist())) >= passages.AGREE
            assert len(key) == len(set(zip(key.tolist(), text.tolist(), strict=True)))


def test_pairs_out_of_reach_are_told_by_their_tokens_and_none_else(words, rng):
    """Texts that only repeat a word, or share lines far apart, aren't aligned; all that have a passage are."""
    tokens = lambda t: passages.Words([t.encode()]).shingles(passages.SHINGLE)[0]

    def reach(a, b):
        x, y = (passages.unpacked(passages.told_tokens(t)) for t in (a, b))
        assert (x[0] == tokens(a)).all()
        one, two = (passages.reachable([*some, u, *some], np.sort(v[0]), 46)[1 if some else 0] for u, v in ((x, y), (y, x)))
        return one and two

    lines, some = [words(13) for _ in range(4)], []
    apart = [" ".join(f"{line} {words(30)}" for line in lines) for _ in range(2)]
    assert not reach(*apart)
    the = [f"{words(60)} {'the ' * 40} {words(60)}" for _ in range(2)]
    assert passages.covered(tokens(the[0]), tokens(the[1]), 46) and not reach(*the)
    assert not reach("", the[0]) and not reach(the[0], "")
    found, some = 0, [passages.unpacked(passages.told_tokens(the[0]))]
    for n in range(400):
        base = words(rng.randint(30, 120)).split()
        if n % 3 == 0:
            base[10:10] = ["the"] * rng.randint(5, 60)
        texts = []
        for _ in range(2):
            v = list(base)
            for _ in range(rng.randint(0, 5)):
                v[rng.randrange(len(v))] = words(rng.choice([1, 1, 2, 9])) if rng.random() < 0.8 else ""
            texts.append(f"{words(rng.randint(0, 30))} {' '.join(v)} {words(rng.randint(0, 30))}")
        if passages.common_passages(*map(tokens, texts)):
            found += 1
            assert reach(*texts)
    assert found > 60


def test_no_class_is_cut(spark, monkeypatch):
    """One of many classes under a signature has a member whose only partner is one node of another: it is found without rounds."""
    from pyspark.sql import functions as F

    members = spark.createDataFrame([(s, k) for k in range(60) for s in (1, 2)] + [(3, 59), (3, 200)], "signature long, node long")
    first = spark.createDataFrame([(k, 0) for k in range(1, 60)], "a long, b long")
    only = lambda some: some.filter("a = 41 and b = 17 or a = 200")
    for rounds, agree, want in ((0, 1, {(41, 17), (200, 59)}), (1, 2, {(41, 17)})):
        links = passages.found_links(first, members, only, rounds, agree)
        assert {(r["a"], r["b"]) for r in links.collect()} == want


def test_passages_against_all_pairs(spark, words, rng):
    """Passages that share a line of 30 words, a common one, and part of which are edited: the classes are those of all pairs."""
    line, texts = words(30), []
    for k in range(120):
        texts.append(f"{words(rng.randint(5, 40))} {line} {words(rng.randint(30, 60))}")
    for _ in range(4):
        base = f"{line} {words(40)}".split()
        for _ in range(6):
            v = list(base)
            v[rng.randrange(30, 70)] = words(1)
            texts.append(f"{words(20)} {' '.join(v)} {words(20)}")
    tokens = [passages.Words([t.encode()]).shingles(passages.SHINGLE)[0] for t in texts]
    want = brute_components(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if passages.common_passages(tokens[i], tokens[j])])
    members = {k for k, g in want.items() if sum(other == g for other in want.values()) > 1}
    got = {r["doc_id"]: r["class_id"] for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert members and got == {k: want[k] for k in members}


def test_passage_whose_piece_stands_earlier(words):
    """A piece of the passage stands alone before it in one of the texts, or in both, once or several times."""
    tokens = lambda t: passages.Words([t.encode()]).shingles(passages.SHINGLE)[0]
    p = words(55)
    piece = " ".join(p.split()[15:40])
    for n_x, n_y in ((1, 0), (0, 1), (3, 0), (1, 1), (2, 1)):
        x, y = (" ".join([*[f"{words(20)} {piece} {words(30)}"] * n, words(40), p, words(25)]) for n in (n_x, n_y))
        (a, b, c, d, score), *more = passages.common_passages(tokens(x), tokens(y))
        assert not more and score == 1
        assert x.split()[a:b] == y.split()[c:d] == p.split()
    twice = f"{words(10)} {p} {words(30)} {p}"
    assert len(passages.common_passages(tokens(twice), tokens(f"{words(5)} {p} {words(5)}"))) == 2
    assert passages.common_passages(tokens(f"{words(30)} {piece}"), tokens(p)) == []


def test_planted_passages(spark, messy, words):
    p, q, short = words(55), words(70).split(), words(30)
    edited = [*q[:33], "edited", *q[34:]]
    texts = [f"{words(90)} {p} {words(40)}", f"{words(7)} {p}", f"{p} {words(200)}", f"{words(60)} {' '.join(q)} {words(9)}", f"{words(3)} {' '.join(edited)}", f"{words(50)} {short} {words(50)}", f"{words(70)} {short} {words(70)}"]
    copy = words(80)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(k, copy) for k in (20, 21, 22, 22)] + [(30, None), (31, ""), (None, copy)], "doc_id long, text string")
    got = passages.repeated_passages(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 20: 20, 21: 20, 22: 20}
    for r in got:
        if r["doc_id"] < 5:
            mine, other = (texts[r[x]].split()[r[a] : r[b]] for x, a, b in (("doc_id", "start", "end"), ("other_doc_id", "other_start", "other_end")))
            assert len(mine) >= 50 and r["similarity"] >= 0.8
            if r["similarity"] == 1:
                assert mine == other
    assert {r["doc_id"] for r in passages.repeated_passages(messy).collect()} >= {4, 5}
    assert passages.repeated_passages(messy.limit(0)).count() == 0


def test_hot_signatures_are_dealt_and_bridged(spark, monkeypatch):
    rows = [(7, k) for k in range(500)] + [(8, k) for k in range(0, 500, 100)] + [(9 + k, k) for k in range(50)]
    signed = spark.createDataFrame(rows, "signature long, node long")
    monkeypatch.setattr(passages, "HOT", 100)
    pairs, members = passages.candidates(signed, signed.select("signature"), [])
    assert {(r["signature"], r["node"]) for r in members.collect()} == {*rows[:505], *((9 + k, k) for k in range(0))} | {(8, k) for k in range(0, 500, 100)}
    pairs = [(r["a"], r["b"]) for r in pairs.collect()]
    assert len(pairs) <= 2 * 500 + 10 and len(pairs) == len(set(pairs))
    assert set(brute_components(range(500), pairs).values()) == {0}
    firsts = {b for _, b in pairs}
    assert len(firsts) > passages.SALTS  # several groups, not one


def test_families_of_edited_passages(spark, words, rng):
    """Passages of 90 words with 1 to 4 edits each amid other words, against a comparison of all pairs: at least 99 of
    100 of the documents with a partner are found, and stand in their class."""
    texts, tokens = [], lambda t: passages.Words([t.encode()]).shingles(passages.SHINGLE)[0]
    want = []
    for _ in range(5):
        base, first = words(90).split(), len(texts)
        for _ in range(30):
            v = list(base)
            for _ in range(rng.randint(1, 4)):
                v[rng.randrange(90)] = words(1)
            texts.append(f"{words(rng.randint(10, 60))} {' '.join(v)} {words(rng.randint(10, 60))}")
        own = {k: tokens(texts[k]) for k in range(first, len(texts))}
        want += [(i, j) for i in own for j in range(first, i) if passages.common_passages(own[i], own[j])]
    texts += [words(200) for _ in range(50)]
    groups = brute_components(range(len(texts)), want)
    members = {k for pair in want for k in pair}
    got = {r["doc_id"]: r["class_id"] for r in passages.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert set(got) <= members and len(got) >= 0.99 * len(members)
    assert sum(groups[k] == got.get(k) for k in members) >= 0.99 * len(members)


def test_rounds_find_partners_that_first_and_neighbour_are_not(spark, monkeypatch):
    """Signatures shared by 18 nodes, dealt over several tasks; only those of equal remainder by 2 may be linked: all end
    in two classes."""
    from pyspark.sql import functions as F

    members = spark.createDataFrame([(s, k) for k in range(18) for s in (1, 2)], "signature long, node long")
    first = spark.createDataFrame([(k, k - 1) for k in range(1, 18)] + [(6, 0)], "a long, b long")
    monkeypatch.setattr(passages, "SPLIT", 12)
    links = passages.found_links(first, members, lambda some: some.filter((F.col("a") - F.col("b")) % 2 == 0))
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert len(pairs) == len(set(pairs))
    assert len(set(brute_components(range(18), pairs).values())) == 2


@pytest.mark.parametrize("size", [1, 3, 100])
def test_neighbours_across_batches(size):
    rows = [(1, 5, 0), (1, 6, 1), (1, 2, 1), (2, 1, 0), (2, 9, 0), (2, 3, 4), (2, 7, 0), (2, 8, 0)]
    batch = lambda part: pa.record_batch({n: pa.array([r[i] for r in part], pa.int64()) for i, n in enumerate(("key", "node", "class"))})
    for width, want in ((1, {(6, 5), (5, 2), (9, 3), (7, 3), (8, 3)}), (2, {(6, 5), (5, 2), (9, 3), (3, 1), (7, 3), (8, 3)})):
        got = [r for b in passages.neighbours((batch(rows[i : i + size]) for i in range(0, len(rows), size)), width) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in got} == want


def brute_matches(docs, items, words_of):
    """(doc, item, start, item_start, n_words, n_windows, exact) by the definition: docs and items are dicts of text."""
    size, least, windows = decontamination.WINDOW, decontamination.LITERALS, {}
    own = {k: words_of(t) for k, t in items.items()}
    for k, (template, value) in own.items():
        n = min(size, len(template))
        for at in range(len(template) - n + 1) if n else ():
            literal = [p for p in range(at, at + n) if not template[p].startswith("#")]
            key = (n, "t", *template[at : at + n]) if literal else (n, "v", *value[at : at + n])
            windows.setdefault(key, []).append((k, at, set(literal)))
    out = set()
    for d, text in docs.items():
        template, value = words_of(text)
        hits = {}
        for n in {k[0] for k in windows}:
            for pos in range(len(template) - n + 1):
                for kind, side in (("t", template), ("v", value)):
                    for item, at, literal in windows.get((n, kind, *side[pos : pos + n]), ()):
                        hits.setdefault((item, pos - at), []).append((pos, at, n, literal))
        for (item, shift), found in hits.items():
            found.sort(key=lambda h: h[0])
            strong, parts = [h for h in found if len(h[3]) >= least], []
            for h in found:
                if parts and h[0] == parts[-1][-1][0] + 1:
                    parts[-1].append(h)
                else:
                    parts.append([h])
            kept = []
            for run in [strong] * bool(strong) + [p for p in parts if any(len(h[3]) < least for h in p)]:
                t, v = own[item]
                slots = {(v[p - shift], value[p]) for h in run for p in range(h[0], h[0] + h[2]) if t[p - shift].startswith("#")}
                if len({a for a, _ in slots}) < len(slots) or len({b for _, b in slots}) < len(slots):
                    continue
                exact, literal = all(a == b for a, b in slots), set().union(*(h[3] for h in run))
                n = run[-1][0] + run[-1][2] - run[0][0]
                if exact or len(literal) >= least or n == len(t) >= least and literal:
                    kept.append((run is strong, (d, item, run[0][0], run[0][1], n, len(run), exact)))
            out |= {r for s, r in kept if s or not any(x for x, _ in kept)}
    return out


def test_decontamination_against_definition(spark, small):
    """All windows of all documents and items of the given tables, and items that are alike but for their values."""
    from pyspark.sql import functions as F

    like = "A train goes {} km in {} hours from {} to Bonn, how far does it go in {} hours at most"
    shelf = "The first shelf of that shop holds exactly {} apples while the second shelf of it holds exactly {} plums by now"
    extra = [(9001, like.format(60, 2, "Ulm", 7)), (9002, like.format(90, 3, "Hof", 7)), (9003, "What is 12 + 7 * 3 - 4 / 2 ?"), (9004, "Solve 3 x + 4 y = 12 and 5 x - 2 y = 7"), (9005, "one two"), (9006, "12 13 14 15 16 17 18 19 20 21"), (9007, shelf.format(3, 5))]
    items = small("benchmark").select(F.col("item_id").cast("long"), "text").unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    texts = [like.format(90, 3, "Hof", 7), like.format(50, 5, "Ulm", 8), like.format(50, 4, "Ulm", 50), "so what is 12 + 7 * 3 - 4 / 2 then", "Solve 3 x + 4 y = 12 and 5 x - 2 y = 7 now", "one, two", "11 12 13 14 15 16 17 18 19 20 21", "1 2 3 4 5 6 7 8 9 10", shelf.format(4, 6), shelf.format(4, 4)]
    docs = small("documents").select("doc_id", "text").unionByName(spark.createDataFrame([(90000 + k, f"xx yy {t} zz") for k, t in enumerate(texts)], "doc_id long, text string"))
    known = {}
    for frame in (docs, items):
        text = F.coalesce("text", F.lit(""))
        for r in frame.select(text.alias("text"), decontamination.words(decontamination.templated(decontamination.valued(text))).alias("t"), decontamination.words(decontamination.valued(text)).alias("v")).collect():
            known[r["text"]] = r["t"], [w.replace(decontamination.MARK, "") for w in r["v"]]
    want = brute_matches({r["doc_id"]: r["text"] or "" for r in docs.collect()}, {r["item_id"]: r["text"] or "" for r in items.collect()}, known.__getitem__)
    rows = decontamination.matches(docs, items).collect()
    got = {(r["doc_id"], r["item_id"], r["start"], r["item_start"], r["n_words"], r["n_windows"], r["exact"]) for r in rows}
    assert got == want and len(rows) == len(got)
    found = {(d, i): e for d, i, *_, e in got if d >= 90000}
    assert found[90000, 9002] and found[90001, 9001] is False
    assert found[90008, 9007] is False and (90009, 9007) not in found  # 3 and 5 both went to 4
    assert found[90003, 9003] and found[90004, 9004] and found[90005, 9005] and found[90006, 9006]
    assert not any(d == 90007 for d, _ in found)


def test_a_worker_keeps_one_thing_until_it_is_released():
    """Workers go on to the next stage: what the toxicity stage built must not stay beside what that one needs."""
    assert common.kept("a", lambda: [1]) is common.kept("a", lambda: [2])
    common.kept("b", list)
    assert set(common._KEPT) == {"b"}
    common.release()
    assert not common._KEPT


def test_stages_keep_columns_with_any_name(spark, messy):
    odd = messy.withColumnRenamed("node", "a.b").withColumnRenamed("fp", "select").withColumnRenamed("spans", "c`d")
    bench = spark.createDataFrame([(1, "nothing of that kind stands in any of these texts at all")], "item_id long, text string")
    for out in (simhash.deduplicated(odd), decontamination.cleaned(odd, bench)):
        assert out.columns == odd.columns and out.count() > 0
    assert decontamination.cleaned(odd, bench.limit(0)).count() == odd.count()


def test_equal_hashes_of_different_texts(spark, monkeypatch):
    """With hashes of 3 bits most texts share one with others; a second one tells them apart."""
    from pyspark.sql import functions as F

    from ledgerlake.llm import common

    plain = F.xxhash64
    weak = lambda *c: F.pmod(plain(*c), F.lit(3)) if len(c) == 1 else plain(*c)
    docs = spark.createDataFrame([(k, f"text {k % 20}") for k in range(60)], "doc_id long, text string")
    monkeypatch.setattr(common.F, "xxhash64", weak)
    mark, groups = common.identified(docs, n=F.count(F.lit(1)))
    assert sorted(r["n"] for r in groups.collect()) == [3] * 20
    assert mark(docs, "text", "node").groupBy("node").agg(F.count_distinct("text").alias("n")).filter("n > 1").count() == 0


def test_decontamination(spark, small, messy):
    bench = spark.createDataFrame([(1, "If John has 12 apples and gives 3 kg of them to Mary, how many does John keep?"), (2, "Too short"), (3, None), (4, "")], "item_id long, text string")
    same = "xx yy. If Peter has 7 apples and gives 5 kg of them to Anna, how many does {} keep? zz"
    docs = spark.createDataFrame([(10, same.format("Peter")), (11, same.format("Bob")), (12, "if JOHN has 12 apples"), (13, None), (14, "so, if John has 12 apples, and gives 3.0 kg of them to Mary how many")], "doc_id long, text string")
    got = {r["doc_id"]: r["exact"] for r in decontamination.matches(docs, bench).collect()}
    assert got == {10: False, 14: False}
    assert {r["doc_id"] for r in decontamination.cleaned(docs, bench).collect()} == {11, 12, 13}
    found = {r["doc_id"] for r in decontamination.matches(small("documents"), small("benchmark")).collect()}
    items = [r["text"] for r in small("benchmark").collect()]
    planted = {r["doc_id"] for r in small("documents").collect() if any(i in r["text"] for i in items)}
    assert planted and planted <= found and len(found - planted) <= 2
    assert decontamination.matches(messy, bench).count() == 0 and decontamination.cleaned(messy, bench).count() == messy.count()
    assert decontamination.cleaned(messy, bench.limit(0)).columns == messy.columns
    assert decontamination.matches(docs.limit(0), bench).count() == 0


def test_decontamination_of_items_with_a_common_template(spark):
    same = "a train that covers {} km in {} min at a steady pace on a straight line has what speed"
    bench = spark.createDataFrame([(1, same.format(60, 60)), (2, same.format(90, 30)), (3, same.format(45, 15))], "item_id long, text string")
    docs = spark.createDataFrame([(10, f"zz {same.format(90, 30)} zz"), (11, same.format(70, 70)), (12, same.format(80, 20)), (13, "a train that covers a lot")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.matches(docs, bench).collect()}
    # consistent with an item: other values go to equal values at will, one value to two doesn't
    assert got == {(10, 2): True, (10, 3): False, (11, 1): False, (11, 2): False, (11, 3): False, (12, 2): False, (12, 3): False}
    assert {r["doc_id"] for r in decontamination.cleaned(docs, bench).collect()} == {13}


def test_decontamination_of_dense_and_short_items(spark):
    items = ["What is 12 + 7 * 3 - 4?", "John has 3 apples, Mary has 5 pears, Tom has 7 plums", "name the capital", "3 1 4 1 5 9 2 6 5", "pi 3"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    texts = {
        10: "so then what is 12 + 7 * 3 - 4? zz", 11: "so then what is 5 + 8 * 6 - 9? zz", 12: "Peter has 4 apples, Anna has 6 pears, Bob has 9 plums", 13: "xx. Name the capital! yy",
        14: "zz 3 1 4 1 5 9 2 6 5 zz", 15: "then pi 3 zz", 20: "what is 12 to you", 21: "zz 2 7 1 8 2 8 1 8 2 zz", 22: "then pi 4 zz", 23: "so then what is 5 + 5 * 6 - 5? zz, name the city", 24: "zz has 4 apples, Anna has 6 pears",
    }
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontamination.matches(docs, bench).collect()}
    # 23: 5 stands for 12 and for 7, which is consistent, as each value of the item went to one value
    assert got == {(10, 0): True, (11, 0): False, (12, 1): False, (13, 2): True, (14, 3): True, (15, 4): True, (23, 0): False}
    assert {r["doc_id"] for r in decontamination.cleaned(docs, bench).collect()} == {20, 21, 22, 24}


def test_preference_sql(spark):
    d = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    got = queries.queries()["op2_preference_format"](spark, d)
    rel = c.execute(queries.oracle_sql()["op2_preference_format"])
    names = [x[0] for x in rel.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(rel.fetchall())


def test_preference_brute_force(spark):
    chosen = {1: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], 2: [("user", "x")], 3: [("user", "same")], 4: []}
    rejected = {1: [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "e"), ("user", "f")], 2: [("user", "y"), ("assistant", "z")], 3: [("user", "same")], 4: [("assistant", "q")]}
    frame = lambda side: spark.createDataFrame([(p, k, r, t) for p, turns in side.items() for k, (r, t) in enumerate(turns)], "pair_id long, turn long, role string, text string")
    show = lambda turns: "".join(f"<|{r}|>\n{t}\n<|end|>\n" for r, t in turns)
    got = {r["pair_id"]: r for r in preference.formatted(preference.paired(frame(chosen), frame(rejected))).collect()}
    for p in chosen:
        a, b = chosen[p], rejected[p]
        n = next((k for k in range(max(len(a), len(b))) if k >= len(a) or k >= len(b) or a[k] != b[k]), len(a))
        r = got[p]
        assert (r["n_prefix_turns"], r["prompt"], r["chosen"], r["rejected"]) == (n, show(a[:n]), show(a[n:]), show(b[n:]))
        for text, mask, turns in ((r["chosen"], r["chosen_mask"], a[n:]), (r["rejected"], r["rejected_mask"], b[n:])):
            assert [text[m["start"] : m["end"]] for m in mask] == [f"{t}\n<|end|>" for role, t in turns if role == "assistant"]


def test_preference_messy_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "n"), (1, 1, "assistant", "b"), (0, 0, "assistant", "z" * 100_000), (None, 0, "user", "lost")], "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in preference.formatted(preference.swapped_pairs(turns)).collect()}
    assert set(got) == {0, 1} and got[1]["n_prefix_turns"] == 2 and "z" * 100_000 in got[1]["rejected"]
    assert preference.formatted(preference.swapped_pairs(turns.limit(0))).count() == 0


def test_pipeline(spark, words, tmp_path):
    rng = np.random.default_rng(2)
    bad = ["scum", "moron", "idiot", "trash", "loser"]
    rows, labelled = [], []
    for k in range(400):
        w = words(90).split()
        if k % 4 == 0:
            for b in rng.choice(bad, 4, replace=False):
                w[int(rng.integers(0, 90))] = str(b)
        rows.append((k, " ".join(w), "en", "s", 0))
        labelled.append((k, 1, int(k % 4 == 0)))
    item = words(30)
    rows += [(1000, rows[1][1], "en", "s", 0), (1001, rows[2][1] + " more", "en", "s", 0), (1002, f"{words(60)} {item} {words(9)}", "en", "s", 0), (1003, f"{words(80)} mail jo.1@mail.example.com", "en", "s", 0), (1004, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, left = table(spark, d, "documents"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        stage(spark, docs, d).write.parquet(f"{d}/out{k}")
        docs = spark.read.parquet(f"{d}/out{k}")
        assert docs.columns == columns, name
        left.append({r["doc_id"] for r in docs.collect()})
    assert left[0] == {r[0] for r in rows if not (r[0] < 1000 and r[0] % 4 == 0)}
    assert left[1] == left[0] - {1000, 1001}
    assert left[2] == left[1] - {1002} == left[3]
    assert "jo.1@" not in {r["doc_id"]: r["text"] for r in docs.collect()}[1003]
    pieces = corpus_pipeline.run(spark, d).collect()
    assert {p["doc_id"] for p in pieces} == left[3]
